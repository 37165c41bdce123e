"""Packing, periodic runs and manifests against brute force, with nulls, blanks, very long texts, repeated rows and extra columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalflow.llm import bpe, manifest, packing, periodic, token_cache
from tidalflow.llm import queries as q
from tidalflow.llm.common import Recent
from tidalflow.llm.queries import tokenizer

R = random.Random(8)
VOCAB = ["".join(R.choice("abcdé") for _ in range(R.randint(1, 7))) for _ in range(60)]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


TEXTS = [(i, prose(R.choice([0, 1, 3, 40, 300, 900]))) for i in range(70)] + [
    (200, None), (201, ""), (202, " \n\t"), (203, prose(9000)), (204, "a " * 4000), (205, "xy" * 3000), (None, "no id " * 9), (206, prose(5) + " " + "b c d " * 50 + prose(7)), (206, "the same id"), (206, "the same id"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if (i or 0) % 5 == 0 else ["en", "de", "é", ""][(i or 0) % 4], None if i == 3 else f"s{(i or 0) % 3}", None if i in (7, 8) else len(t or "")) for i, t in TEXTS]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    # columns that the operators name too
    return df.withColumns({x: F.lit("x") for x in ("ids", "runs", "group", "place", "leaf", "start", "size", "node", "prompt_")}).cache()


@pytest.fixture(scope="module")
def table(docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    docs.write.parquet(f"{at}/documents.parquet")
    return at


# packing


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def whole(rows):
    """Each example's pieces lie end to end, and each sequence's too."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length, r.loss_tokens))
    for x in sequences.values():
        at = 0
        for offset, length, _ in sorted(x):
            assert offset == at and length > 0
            at += length
    return sequences


def test_packing_gives_each_id_once(docs):
    rows = packing.packed(docs, tokenizer("word_bpe_49k.json")).collect()
    lengths = [sum(n for _, n, _ in x) for x in whole(rows).values()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths) and max(lengths) == 2048
    assert all(len(x) <= 64 for x in whole(rows).values())
    got = defaultdict(dict)
    for r in rows:
        got[r.doc_id, r.doc_tokens].setdefault(r.start, []).append(np.frombuffer(r.ids, np.uint32).tolist())
    want = defaultdict(list)
    for (i, _), ids in zip(TEXTS, library([t or "" for _, t in TEXTS]), strict=True):
        want[i, len(ids) + 1].append([*ids, 1])
    assert set(got) == set(want)
    for k, copies in want.items():
        if len(copies) == 1:
            assert sum((got[k][s][0] for s in sorted(got[k])), []) == copies[0]
        else:  # rows alike
            assert sorted(sum(map(len, x)) for x in got[k].values()) and sum(len(y) for x in got[k].values() for y in x) == sum(map(len, copies))


def test_packing_keeps_all_three_limits(spark):
    rows = [(i, prose(R.randint(0, 200)), prose(R.randint(0, 90))) for i in range(300)] + [(400, prose(900), prose(700)), (401, None, prose(400)), (402, prose(300), None)]
    examples = spark.createDataFrame(rows, "doc_id long, asked string, text string").repartition(2)
    limits = packing.Limits(tokens=512, segments=5, loss=128)
    got = packing.packed(examples, tokenizer("word_bpe_49k.json"), limits, "asked").collect()
    for x in whole(got).values():
        tokens = sum(n for _, n, _ in x)
        assert len(x) <= 5 and sum(b for *_, b in x) <= 128 and tokens <= 512 and (tokens == 512 or tokens & (tokens - 1) == 0)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for (i, _, _), a, b in zip(rows, library([x[1] or "" for x in rows]), library([x[2] or "" for x in rows]), strict=True):
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(r.ids for r in mine), np.uint32).tolist() == [*a, *b, 1]
        assert sum(r.loss_tokens for r in mine) == len(b) + 1
        assert all(r.loss_tokens == max(0, r.start + r.length - max(r.start, len(a))) for r in mine)


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 64), packing.Limits(100, 1, 7), packing.Limits(1, 1, 1)])
def test_packer_alone(limits):
    packer, sizes, got, most = packing.Packer(limits), [R.choice([1, 1, 2, 30, 64, 2048, 5000]) for _ in range(400)], [], 0
    for i, n in enumerate(sizes):
        got += packer.add(i, n, R.randint(0, n))
        if i % 40 == 0:
            got += packer.sequences()
            most = max(most, packer.waiting)
    got += packer.sequences(last=True)
    assert most <= packing.RESERVE * limits.tokens and not packer.pool and not packer.open
    there = defaultdict(list)
    for x in got:
        total = sum(p.length for p in x)
        assert len(x) <= limits.segments and sum(p.loss for p in x) <= limits.loss and total <= limits.tokens
        assert total == limits.tokens or total & (total - 1) == 0
        for p in x:
            there[p.example].append((p.start, p.length))
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(there[i]):
            assert start == at
            at += length
        assert at == n


def test_dot_product_prefers_what_is_scarce():
    """With much loss left and few tokens, the example that bears loss goes first, though another has as many tokens."""
    packer = packing.Packer(packing.Limits(100, 10, 100))
    packer.add(0, 40, 40)
    packer.add(1, 40, 0)
    first = packer.sequences(last=True)[0]
    assert first[0].example == 1


def test_packing_pads_little(spark, sf):
    rows = q.op11_vector_packing(spark, sf).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    padded = sum(0 if r.n & (r.n - 1) == 0 else 2048 - r.n for r in rows)
    assert padded == 0 and sum(r.n == 2048 for r in rows) > 0.8 * len(rows)


def test_packing_of_nothing(docs):
    assert packing.packed(docs.limit(0), tokenizer("word_bpe_49k.json")).count() == 0


# periodic runs


def brute_runs(w, least=6, times=4):
    """Every maximal stretch of every period that has no smaller one."""
    out, n = [], len(w)
    for p in range(1, n + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i - s + p
            x = w[s : s + length]
            if length >= max(least, times * p) and not any(x[k:] == x[:-k] for k in range(1, p)):
                out.append((s, length, p))
    return sorted(out, key=lambda x: (x[0], x[2]))


def periodic_words(r, n):
    out = []
    while len(out) < n:
        unit = [r.choice("abcd") for _ in range(r.randint(1, 9))]
        out += unit * r.choice([1, 1, 2, 4, 5, 11]) + [r.choice("abxyz") for _ in range(r.randint(0, 6))]
    return out[:n]


@pytest.mark.parametrize("table", [1 << 14, 0])
def test_runs_are_brute_force(table, monkeypatch):
    monkeypatch.setattr(periodic, "TABLE", table)
    monkeypatch.setattr(periodic, "TOGETHER", 50)
    r = random.Random(3)
    for k in range(500):
        n = r.randint(0, 150)
        w = periodic_words(r, n) if k % 3 else [r.choice("ab") for _ in range(n)]
        numbers = periodic.numbers([x.encode() for x in w])
        if table or n:
            assert periodic.runs(numbers) == brute_runs(w), w
    for w in (["a"] * 200, ["a", "b"] * 90, (["a"] * 9 + ["b"]) * 12, (["a", "a", "b"] * 6 + ["c"]) * 7, list("abcabcabcabc"), list("aaaaa"), list("aaaaaa"), list("ababab"), list("abababab")):
        assert periodic.runs(periodic.numbers([x.encode() for x in w])) == brute_runs(w), w


def test_runs_of_other_lengths():
    r = random.Random(4)
    for _ in range(80):
        w = periodic_words(r, r.randint(0, 120))
        assert periodic.runs(periodic.numbers([x.encode() for x in w]), 10, 5) == brute_runs(w, 10, 5)
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(9, np.int32), 6, 2)


def test_grid_of_a_very_long_text():
    w = np.random.default_rng(2).integers(0, 5000, 200_000)
    for start, p, times in ((1000, 700, 5), (150_000, 9000, 4), (90_000, 3, 40)):
        w[start : start + p * times] = np.tile(w[start : start + p], times)
    assert {(x[0], x[2]) for x in periodic.runs(w)} >= {(1000, 700), (150_000, 9000), (90_000, 3)}


def test_periodic_query_is_brute_force(spark, docs, table):
    got = defaultdict(list)
    for r in q.op12_periodic_runs(spark, table).collect():
        got[r.doc_id].append(tuple(r))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = defaultdict(list)
    for i, t in TEXTS:
        w = (t or "").encode().split()
        if len(w) > 5000:
            want[i].append(None)
            continue
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = brute_runs([x.decode() for x in w]) if len(w) < 1000 or i == 204 else periodic.runs(periodic.numbers(w))
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        want[i].append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert set(got) == set(want)
    for i, rows in want.items():
        assert len(rows) == len(got[i]) and (None in rows or sorted(rows) == sorted(got[i]))
    assert any(r[1] for rows in got.values() for r in rows)
    assert periodic.collapsed(docs.limit(0)).count() == 0


# manifests


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def brute_tree(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        x = out[-1]
        out.append([H(*x[i : i + fanout]) for i in range(0, len(x), fanout)])
    return out


def brute_path(tree, i, fanout):
    path = []
    for level in tree[:-1]:
        run = level[i // fanout * fanout : i // fanout * fanout + fanout]
        path.append((i % fanout, run[: i % fanout] + run[i % fanout + 1 :]))
        i //= fanout
    return path


def brute_manifest(rows, fanout, tampered):
    f = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, more=0: H(f(r[0]), f(r[3]), f(r[2]), f(None if r[4] is None else r[4] + more), f(r[1]))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in names:
        groups[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = brute_tree([leaf(r) for r in groups[x]], fanout)
    top = brute_tree([trees[x][-1][0] for x in names], fanout)
    out = []
    for g, x in enumerate(names):
        for i, r in enumerate(groups[x]):
            path = brute_path(trees[x], i, fanout) + brute_path(top, g, fanout)
            node = leaf(r, tampered(r[0]))
            for own, others in path:
                node = H(*others[:own], node, *others[own:])
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], H(*(y for _, o in path for y in o)), node, node == top[-1][0]))
    return out


KEY = lambda r: (r[0] is not None, r[0] or 0, r[4])


@pytest.mark.parametrize("fanout, block", [(2, 1024), (2, 4), (3, 9), (5, 6), (2, 2)])
def test_manifest_is_brute_force(docs, fanout, block):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    odd = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0
    found = manifest.documents(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, fanout, block)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, H(r.proof), r.folded, r.folded == r.root) for r in found.collect()]
    assert sorted(got, key=KEY) == sorted(brute_manifest(rows, fanout, odd), key=KEY)
    assert {r[6] for r in got} == {True, False}


def test_manifest_query(spark, table, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = [tuple(r) for r in q.op13_merkle_manifest(spark, table).collect()]
    assert sorted(got, key=KEY) == sorted(brute_manifest(rows, 2, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0), key=KEY)


def test_manifest_of_little(spark, docs):
    assert manifest.documents(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(5, "x", "en", None, 1)], SCHEMA)
    r = manifest.documents(one).first()
    assert r.leaf == r.subroot == r.root == r.folded and r.proof == ""
    same = spark.createDataFrame([(5, "x", "en", None, 9223372036854775807)] * 40, SCHEMA)
    got = manifest.documents(same, F.lit(True), 2, 4).collect()
    assert len(got) == 40 and len({r.leaf for r in got}) == 1 and not any(r.folded == r.root for r in got)
    with pytest.raises(ValueError):
        manifest.documents(one, fanout=1)


def test_many_groups(spark):
    rows = [(i, "t", f"l{i % 50}", None, None) for i in range(220)]
    got = [(r.doc_id, r.leaf, r.subroot, r.root, H(r.proof), r.folded, r.folded == r.root) for r in manifest.documents(spark.createDataFrame(rows, SCHEMA), None, 2, 4).collect()]
    assert sorted(got, key=KEY) == sorted(brute_manifest(rows, 2, lambda i: 0), key=KEY)


# remembered keys


def test_remembered_keys_are_counted_by_their_bytes():
    import sys

    known = Recent(1 << 20)
    for k in range(0, 3000, 50):
        keys = [f"{i}" + "长" * 30_000 for i in range(k, k + 50)]
        assert known.lacking(set(keys)) and not known.put(keys, [b"v" * 100] * 50)
        assert all(x in known.new for x in keys)
        known.trim()
        assert not any(len(x) > Recent.LONG for x in [*known.new, *known.old])
    for k in range(0, 60_000, 500):
        keys = {f"key {i % 30_000}" for i in range(k, k + 500)}
        new = known.lacking(keys)
        known.put(new, [b"value"] * len(new))
        assert all(known.new[x] for x in keys)
        known.trim()
        held = sum(sys.getsizeof(a) + sys.getsizeof(b) for part in (known.new, known.old) for a, b in part.items()) + sys.getsizeof(known.new) + sys.getsizeof(known.old)
        assert held <= known.limit
    assert known.old


def test_texts_without_spaces_are_right_and_forgotten():
    """Each text is one key: 40 of 30,000 characters."""
    from tokenizers import Tokenizer

    texts = ["".join(R.choice("本語日中文字ab9") for _ in range(30_000)) for _ in range(12)] + ["", "plain words", "plain words again"]
    encoder, counter = bpe.SegmentTreeBpe(tokenizer("word_bpe_49k.json")), token_cache.Counter(tokenizer("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for text in texts[:2] + texts[-3:]:
        assert np.frombuffer(encoder.ids([text])[0], np.uint32).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert counter(texts) == [len(x.ids) for x in Tokenizer.from_file(tokenizer("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]
    for x in (encoder.known, counter.known):
        assert not any(len(k) > Recent.LONG for k in [*x.new, *x.old]) and "words" in "".join(x.new)
