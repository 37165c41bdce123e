"""Packing of examples into sequences under several limits at once: vector bin packing by the dot-product heuristic.

An example is a vector of tokens, one segment and loss-bearing tokens; a sequence has a limit of each. Of the examples that
fit what an open sequence has left, the heuristic takes the one with the greatest weighted dot product of its vector and what
is left, the weights being the dimensions' mean demands over the squares of their limits. When none fits, the example whose
head fills most of the rest is cut, and its remainder opens the next sequence. A sequence that can't be filled (the last of
a task, or one at its limit of segments or loss) is cut where its length is a power of two, as such lengths need no padding.

Each task packs the rows of its own partition as they come, without a shuffle, and holds little more than RESERVE
sequences of examples that aren't placed. A task that is run again gives its rows the same sequences, whose numbers begin
with that of the partition.

Defined cases: null and empty texts (and prompts) have no ids but the end's; repeated rows are examples of their own, and so
are rows with null ids; a text of any length is cut into whole sequences and a remainder; an empty table gives no rows;
columns other than doc_id, text and the prompt are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import steps, texts

#: The id behind each document.
END = 1
#: Examples of so many sequences wait for a better place until a task's end.
RESERVE = 32


class Limits(NamedTuple):
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


class Piece(NamedTuple):
    """``length`` ids of an example from ``start`` on; those from ``prompt`` on bear loss."""

    example: int
    start: int
    length: int
    prompt: int

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.prompt))

    def head(self, tokens: int, loss: int) -> int:
        """How many of its first ids keep to these limits."""
        return min(self.length, tokens, max(0, self.prompt - self.start) + loss)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(length=n), self._replace(start=self.start + n, length=self.length - n)


class Packer:
    """Takes examples and gives full sequences, each a list of pieces."""

    def __init__(self, limits: Limits = Limits()):
        if min(limits) < 1:
            raise ValueError("every limit must be 1 or more")
        self.limits, self.open, self.waiting = limits, [], 0
        self.pool: dict[tuple[int, int], list[Piece]] = {}

    def add(self, example: int, tokens: int, prompt: int = 0) -> list[list[Piece]]:
        """Sequences that the example fills alone; what is left of it waits."""
        full, rest = [], Piece(example, 0, tokens, prompt)
        while (n := rest.head(self.limits.tokens, self.limits.loss)) < rest.length:
            first, rest = rest.cut(n)
            if n == self.limits.tokens:
                full.append([first])
            else:
                self._wait(first)
        if rest.length == self.limits.tokens:
            full.append([rest])
        elif rest.length:
            self._wait(rest)
        return full

    def _wait(self, piece: Piece) -> None:
        self.pool.setdefault((piece.length, piece.loss), []).append(piece)
        self.waiting += piece.length

    def sequences(self, last: bool = False) -> list[list[Piece]]:
        """Fills sequences from what waits, until only RESERVE of them are left, or nothing if it is the ``last`` call."""
        out, most = [], self.limits
        kinds = sorted(self.pool, reverse=True)
        tokens, loss = (np.array([k[d] for k in kinds], np.int64) for d in (0, 1))
        left = np.array([len(self.pool[k]) for k in kinds], np.int64)
        # mean demand over the square of the limit, of tokens and loss; each example is one segment, so segments favour none
        by_tokens, by_loss = ((x @ left) / max(1, left.sum()) / d**2 for x, d in ((tokens, most.tokens), (loss, most.loss)))
        held, bearing = sum(x.length for x in self.open), sum(x.loss for x in self.open)

        def put(piece: Piece) -> None:
            nonlocal held, bearing
            self.open.append(piece)
            held, bearing = held + piece.length, bearing + piece.loss

        def close(remainder: Piece | None) -> None:
            nonlocal held, bearing
            out.extend([self.open] if held == most.tokens else powers(self.open))
            self.open, held, bearing = [], 0, 0
            if remainder:
                put(remainder)

        def take(k: int) -> Piece:
            left[k] -= 1
            self.waiting -= kinds[k][0]
            return self.pool[kinds[k]].pop()

        while self.waiting and (last or self.waiting > RESERVE * most.tokens):
            room, bear = most.tokens - held, most.loss - bearing
            if not room or len(self.open) == most.segments:
                close(None)
                continue
            fits = np.flatnonzero((left > 0) & (tokens <= room) & (loss <= bear))
            if len(fits):
                score = by_tokens * room * tokens[fits] + by_loss * bear * loss[fits]
                put(take(fits[np.argmax(score)]))
                continue
            some = np.flatnonzero(left)
            heads = np.minimum(room, tokens[some] - loss[some] + bear)  # none is longer than its head
            k = int(np.argmax(heads))
            if not heads[k]:
                close(None)
                continue
            first, rest = take(some[k]).cut(int(heads[k]))
            put(first)
            close(rest)
        self.pool = {k: v for k, v in self.pool.items() if v}
        if last or held == most.tokens:
            close(None)
        return [x for x in out if x]


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences of the same pieces, in their order, each as long as a power of two."""
    out, queue = [], pieces[::-1]
    total = sum(x.length for x in pieces)
    while total:
        want = 1 << total.bit_length() - 1
        total, now = total - want, []
        while want:
            piece = queue.pop()
            if piece.length > want:
                piece, rest = piece.cut(want)
                queue.append(rest)
            now.append(piece)
            want -= piece.length
        out.append(now)
    return out


SCHEMA = "doc_id long, start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long"


def packed(examples: DataFrame, path: str, limits: Limits = Limits(), prompt: str | None = None, end: int = END) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit numbers), loss_tokens, doc_tokens, sequence_id, offset.

    An example is the ids of its ``prompt`` column, if there is one, which bear no loss, then those of ``text``, then ``end``.
    """
    said = [F.coalesce(F.col(prompt), F.lit("")).cast("binary").alias("prompt")] if prompt else []

    def run(batches):
        bpe, packer, kept = encoder(path), Packer(limits), {}
        first, numbered, example = TaskContext.get().partitionId() << 36, 0, 0
        tail = int(end).to_bytes(4, "little")

        def rows(sequences):
            nonlocal numbered
            columns = [[] for _ in range(8)]
            for pieces in sequences:
                offset = 0
                for x in pieces:
                    doc_id, tokens, base, ids = kept[x.example]
                    at = 4 * (x.start - base)
                    row = (doc_id, x.start, x.length, ids[at : at + 4 * x.length], x.loss, tokens, first + numbered, offset)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += x.length
                numbered += 1
            kinds = [pa.binary() if i == 3 else pa.int64() for i in range(8)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for part in steps(batches, "text", *(["prompt"] if prompt else [])):
            said_by = lambda column: bpe.ids(part.column(column).cast(pa.string()))  # noqa: B023, E731
            asked = said_by("prompt") if prompt else [b""] * part.num_rows
            told, full = said_by("text"), []
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), asked, told, strict=True):
                tokens = (len(a) + len(b)) // 4 + 1
                kept[example] = doc_id, tokens, 0, a + b + tail
                full += packer.add(example, tokens, len(a) // 4)
                example += 1
            yield rows(full + packer.sequences())
            needed: dict[int, int] = {}
            for pieces in [*packer.pool.values(), packer.open]:
                for x in pieces:
                    needed[x.example] = min(x.start, needed.get(x.example, x.start))
            kept = {i: (kept[i][0], kept[i][1], start, kept[i][3][4 * (start - kept[i][2]) :]) for i, start in needed.items()}
        if kept:
            yield rows(packer.sequences(last=True))

    return texts(examples, *said).mapInArrow(run, SCHEMA)
