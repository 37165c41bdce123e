"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The tree's leaves hold, for each symbol of a piece, the rank of the pair it begins and its place; the root is therefore
the leftmost pair of lowest rank. Merging it changes three leaves, whose paths to the root are renewed; it ends when no
pair at the root can be merged. Pieces of like length are worked on side by side as rows of one array.

Only distinct white-space-delimited chunks are worked on: no piece of this pre-tokenizer crosses white space. A task
remembers the ids of chunks that it has met lately, in REMEMBERED bytes. Normalising and splitting a chunk is the tokenizer file's own business.

Defined cases: null and empty texts have no tokens, ids and text ""; repeated rows each get a row; texts of one very long
piece take n log n steps; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Recent, per_text, texts

#: Bytes in which a task remembers chunks, and those in which a worker does that keeps its encoder between tasks.
REMEMBERED, KEPT = 32 << 20, 384 << 20
#: Bytes of text encoded at a time, as its ids, their places and the decoded text take many times as many.
STEP = 512 << 10
_NONE = np.int64(1) << 60
# Letters, lower-cased, and marks behind them: one piece each, whatever the tokenizer file's own rules for the rest. No line of these has an
# apostrophe, which may begin a piece, or a <, which may begin a special token.
_LINES = re.compile(r"^(?:([a-zß-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)|.*)$", re.M)


class SegmentTreeBpe:
    """A word-end BPE model file of the tokenizers library."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library, model = Tokenizer.from_file(path), spec["model"]
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.name = {i: x for x, i in self.vocab.items()} | {i: x for x, i in self.special.items()}
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.width = max(self.name) + 1
        keys = np.array([self.vocab[a] * self.width + self.vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], _NONE), np.append(order, 0).astype(np.int64)
        self.result = np.append(np.array([self.vocab[a + b] for a, b in merges], np.int64)[order], 0)
        # symbols of single characters, within a piece and at its end
        self.inner, self.outer = np.full(1024, -3, np.int64), np.full(1024, -3, np.int64)
        for x, i in self.vocab.items():
            if len(x) == 1:
                self.inner[ord(x)] = i
            elif x.endswith(self.end) and len(x) == 1 + len(self.end):
                self.outer[ord(x[0])] = i
        self.numbers = {i: str(i) for i in self.name}
        # the byte-level alphabet: a byte above 127 is shown by the character that the tokenizer file's splitter gives it
        self.shown = {b: self.split(c)[0][0][k] for c, k in [(bytes([x, y]).decode(), k) for x, y in ((0xC3, z) for z in range(0x80, 0xC0)) for k in (0, 1)] for b in [c.encode()[k]] if c.isalpha()}
        self.known = Recent(remembered)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of the merge of symbols a and b, or of none."""
        key = np.where((a < 0) | (b < 0), -1, a * self.width + b)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def merged(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces of byte-level characters. Those of like length go together; a row of the tree is a piece."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.array([len(x) for x in pieces], np.int64)
        start = np.cumsum(size) - size
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        symbols = self.inner[codes]
        symbols[start + size - 1] = self.outer[codes[start + size - 1]]
        group = np.where(size > 1, 2 << np.log2(np.maximum(size - 1, 1)).astype(np.int64), 0)
        for leaves in np.unique(group).tolist():
            members = np.flatnonzero(group == leaves)
            if not leaves:
                for i, x in zip(members.tolist(), symbols[start[members]].tolist(), strict=True):
                    out[i] = x.to_bytes(4, sys.byteorder)
                continue
            at_once = max(1, (1 << 16) // leaves)
            for k in range(0, len(members), at_once):
                part = members[k : k + at_once]
                column = np.arange(leaves + 1)
                inside = column < size[part, None]
                sym = np.where(inside, symbols[np.where(inside, start[part, None] + column, 0)], -1)
                for i, ids in zip(part.tolist(), self._merge(sym, leaves), strict=True):
                    out[i] = ids
        return out

    def _merge(self, sym: np.ndarray, leaves: int) -> list[bytes]:
        """``sym``: a piece's symbols a row, one more column than leaves, -1 behind the last; no more than ``leaves`` of them."""
        rows, none = len(sym), len(self.keys) - 1
        place = np.arange(leaves)
        after, before = np.tile(np.arange(1, leaves + 2), (rows, 1)), np.tile(np.arange(-1, leaves), (rows, 1))
        which = self._pair(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(rows, leaves)
        tree = np.full((rows, 2 * leaves), _NONE, np.int64)
        tree[:, leaves:] = np.where(which == none, _NONE, self.ranks[which] * leaves + place)
        level = leaves
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            at = tree[live, 1] % leaves
            gone = after[live, at]
            sym[live, at] = self.result[which[live, at]]
            then = after[live, gone]
            after[live, at] = then
            inside = then < leaves
            before[live[inside], then[inside]] = at[inside]
            sym[live, gone] = -2
            left = before[live, at]
            has = left >= 0
            # the leaves at the place gone, the merged symbol and its left neighbour
            r = np.concatenate([live, live, live[has]])
            p = np.concatenate([gone, at, left[has]])
            right = after[r, p]
            w = self._pair(sym[r, p], sym[r, np.minimum(right, leaves)])
            which[r, p] = w
            tree[r, leaves + p] = np.where(w == none, _NONE, self.ranks[w] * leaves + p)
            node = (leaves + p) >> 1
            while node[0] >= 1:
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                node >>= 1
            live = live[tree[live, 1] < _NONE]
        left = sym >= 0
        flat, ends = sym[left].astype(np.uint32).tobytes(), (4 * np.cumsum(left.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _pieces(self, chunk: str) -> list[str]:
        return [x for x, _ in self.split(self.normalise(chunk))]

    def learn(self, chunks: list[str]) -> None:
        """Remembers the ids of new chunks. None of them has a line's end."""
        if not chunks:
            return
        lines = _LINES.findall("\n".join(chunks).lower())
        # words and marks are pieces as they stand; other chunks are cut by the tokenizer file's rules
        pieces = dict.fromkeys([x for pair in lines for x in pair])
        pieces.pop("", None)
        odd = {i: self._cut(chunks[i]) for i, (word, _) in enumerate(lines) if not word}
        shown = [x if x.isascii() else x.encode().decode("latin-1").translate(self.shown) for x in pieces]
        more = [x for parts in odd.values() for x in parts if isinstance(x, str)]
        got = self.merged(shown + more) if pieces or more else []
        ids = dict(zip(pieces, got)) | {"": b""}
        found = [ids[word] + ids[marks] for word, marks in lines]
        rest = iter(got[len(shown) :])
        for i, parts in odd.items():
            found[i] = b"".join([next(rest) if isinstance(x, str) else x for x in parts])
        self.known.put(chunks, found)

    def _cut(self, chunk: str) -> list[str | bytes]:
        """The pieces of any chunk, and its special tokens' ids as bytes."""
        if "<|" not in chunk:
            return self._pieces(chunk)
        parts = (x for x in self.cut.split(chunk) if x)
        return [y for x in parts for y in ([self.special[x].to_bytes(4, sys.byteorder)] if x in self.special else self._pieces(x))]

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text, as 32-bit numbers of this machine. Chunks are cut and told apart by Arrow; only distinct ones are looked up."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        chunks = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.new.get, distinct))
        if None in found:
            self.learn(self.known.recalled([c for c, x in zip(distinct, found, strict=True) if x is None]))
            new = self.known.new
            found = [new[c] if x is None else x for c, x in zip(distinct, found, strict=True)]
        self.known.trim()
        # each chunk's ids are a stretch of those of all distinct ones
        held = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = coded.indices.to_numpy(zero_copy_only=False)
        size = held[which]
        end = np.cumsum(size)
        at = np.repeat((np.cumsum(held) - held)[which] - (end - size), size) + np.arange(size.sum())
        flat = np.frombuffer(b"".join(found), np.uint32)[at].tobytes()
        # of a text's chunks, of which there is one at least
        ends = (4 * end[chunks.offsets.to_numpy()[1:] - 1]).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def __call__(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: the number of ids, the ids and the decoded text. The file has no decoder: tokens are joined by a space."""
        out = []
        for x in self.ids(texts):
            ids = array("I", x).tolist()
            out.append((len(ids), " ".join(map(self.numbers.__getitem__, ids)), " ".join(map(self.name.__getitem__, ids))))
        return out


@functools.lru_cache(1)
def encoder(path: str) -> SegmentTreeBpe:
    """The encoder that a worker process keeps for its next tasks, with the chunks that it remembers; for jobs that do little else, as it stays when they are done."""
    return SegmentTreeBpe(path, KEPT)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``."""

    def make():
        bpe = SegmentTreeBpe(path)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

        def run(_, batch):
            got = bpe([x.decode() for x in batch])
            return {"n_tokens": [x[0] for x in got], "ids_sha256": [sha(x[1]) for x in got], "decoded_sha256": [sha(x[2]) for x in got]}

        return run

    return per_text(texts(docs), make, "n_tokens long, ids_sha256 string, decoded_sha256 string", size=STEP)


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every row of ``docs``."""

    def make():
        bpe = SegmentTreeBpe(path)

        def run(_, batch):
            got = bpe([x.decode() for x in batch])
            return {"ids": [[int(i) for i in x[1].split()] for x in got], "decoded": [x[2] for x in got]}

        return run

    return per_text(texts(docs), make, "ids array<int>, decoded string", size=STEP)
