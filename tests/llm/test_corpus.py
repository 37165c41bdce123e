"""Corpus operators against brute force, round trips and held-out labels, with nulls, blanks, ties, repeated rows and extra columns."""

import hashlib
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalflow.llm import bpe, chat, decontaminate, html_main, imatch, near_dup, pii, quality, suffix_dedup, token_cache
from tidalflow.llm.components import components
from tidalflow.llm.queries import tokenizer

random.seed(5)
WORDS = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 8))) for _ in range(80)]
PASSAGES = [" ".join(random.choice(WORDS) for _ in range(random.randint(20, 60))) for _ in range(12)]


def mixed(n=160):
    out = []
    for i in range(n):
        t = ""
        for _ in range(random.randint(0, 3)):
            x = random.choice(PASSAGES)
            t += x[random.randint(0, len(x) // 2) :] + " " + " ".join(random.choice(WORDS) for _ in range(random.randint(0, 25))) + "\n"
        out.append((3 * i % (n + 1), t))
    out += [(900, None), (901, ""), (902, " \n "), (903, out[5][1]), (904, "ab" * 400), (905, "x"), (906, "word " * 3000), (907, out[7][1] + " end")]
    return out


TEXTS = mixed()


@pytest.fixture(scope="module")
def docs(spark):
    # columns that the operators name too
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(5)
    return df.withColumns({"n_words": F.lit("x"), "score": F.lit(None).cast("double"), "digest": F.lit(1), "key": F.lit(2), "bucket": F.lit("b"), "n_chars": F.length("text").cast("long")}).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_imatch(docs, none):
    got = {r.doc_id: r for r in imatch.fingerprints(docs, low=0.01, high=0.4).collect()}
    texts = {i: t or "" for i, t in TEXTS}
    order = sorted(texts, reverse=True)
    for i, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, half = texts[i], len(texts[i]) // 2
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + texts[nxt][:half]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert got[nxt].fingerprint != got[i].fingerprint or got[i].near_next == 1
    for i in texts:
        for j in texts:
            assert (got[i].fingerprint == got[j].fingerprint) or texts[i] != texts[j]
    assert imatch.fingerprints(none).count() == 0
    one = docs.where("doc_id = 903").union(docs.where("doc_id = 903"))
    assert [r.near_next for r in imatch.fingerprints(one, 0.01, 1.0).collect()] == [1.0, 1.0]


@pytest.mark.parametrize("limit, bucket", [(imatch.BLOCK_BYTES, 4000), (imatch.BLOCK_BYTES, 30), (4000, 4000), (4000, 30)])
def test_imatch_is_brute_force(docs, limit, bucket):
    """Fingerprints and likeness worked out anew, with a lexicon of one block and of several, and one bucket of ids and several."""
    import xxhash

    texts = {i: t or "" for i, t in TEXTS}
    cut = lambda t: set(re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode().lower()))
    counts = {}
    for t in texts.values():
        for x in cut(t):
            counts[x] = counts.get(x, 0) + 1
    words = {x for x, n in counts.items() if max(2, 0.02 * len(texts)) <= n <= max(2, 0.4 * len(texts))}
    _, blocks = imatch.lexicon(docs, 0.02, 0.4, limit)
    assert (blocks > 1) == (limit == 4000) and len(words) > 20
    full, mask = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def fingerprint(t):
        kept = sorted(cut(t) & words) or sorted(cut(t)) or [b"\0" + t.encode()]
        out = [f"{xxhash.xxh3_64_intdigest(b' '.join(kept)):016x}"]
        for k in range(imatch.SCALES * imatch.EACH):
            total, some = 0, False
            for h in map(xxhash.xxh3_64_intdigest, kept):
                draw = (h ^ k * mask & full) * 0xBF58476D1CE4E5B9 & full
                draw = (draw ^ draw >> 29) * 0x94D049BB133111EB & full
                if draw < 1 << 63 - k // imatch.EACH:
                    total, some = total + (h ^ h >> 32) * 0xD6E8FEB86659FD93 & full, True
            out.append(f"{((total ^ total >> 31) * mask & full) >> 48:04x}" if some else "")
        return out

    def like(x, y):
        if x == y:
            return 1.0
        shares, pairs = [], [(a, b) for a, b in zip(x[1:], y[1:])]
        for k in range(0, len(pairs), imatch.EACH):
            told = [a == b for a, b in pairs[k : k + imatch.EACH] if a or b]
            if len(told) >= imatch.EACH // 3:
                shares.append(sum(told) / len(told))
        told = [a == b for a, b in pairs if a or b]
        return max(shares) if shares else sum(told) / len(told) if told else 0.0

    got = {r.doc_id: r for r in imatch.fingerprints(docs, 0.02, 0.4, limit, bucket).collect()}
    order = sorted(texts, reverse=True)
    own = {i: fingerprint(texts[i]) for i in order}
    assert set(got) == set(order)
    for i, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, half = texts[i], len(texts[i]) // 2
        other = fingerprint(t[: len(t) - half] + texts[nxt][:half])
        assert got[i].fingerprint == "-".join(own[i]) and got[i].edited_fingerprint == "-".join(other)
        assert got[i].near_edited == pytest.approx(like(own[i], other)) and got[i].near_next == pytest.approx(like(own[i], own[nxt]))


def test_imatch_blocks_of_repeated_rows_and_none(docs, none):
    twice = docs.union(docs).withColumn("doc_id", F.expr("nullif(doc_id, 903)"))
    key = lambda df: sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.edited_sha256, r.fingerprint, r.near_next))
    assert key(imatch.fingerprints(twice, 0.02, 0.4, 4000, 30)) == key(imatch.fingerprints(twice, 0.02, 0.4, bucket=30))
    assert imatch.fingerprints(none, limit=1).count() == 0


def test_token_cache(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(1000, "a <|endoftext|> b \x1c c  \n\n d"), (1000, None), (1001, "don't\t we'll  ")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    cache = str(tmp_path / "cache")
    for k in range(2):
        got = token_cache.counts(both, path, cache).collect()
        assert len(got) == len(TEXTS) + 3
        want = sorted((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in [(r.doc_id, r.text) for r in both.collect()])
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 512) for r in got)
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == len({r.text or "" for r in both.collect()})
    assert token_cache.counts(none, path).count() == 0


def brute_hits(text, items, n=13):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
    w, hit, found = words(text), set(), set()
    for i, x in items:
        x = words(x)
        for s in range(max(1, len(x) - n + 1)) if x else ():
            win = x[s : s + n]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [16 << 20, 200])
def test_decontamination(spark, docs, none, block):
    p = PASSAGES[0].split()
    items = [(1, PASSAGES[1].upper()), (2, " ".join(p[3:9])), (10, "x"), (3, "zzz absent"), (4, None), (5, ""), (1, PASSAGES[2])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.hits(docs, bench, block_bytes=block).collect()
    want = {i: brute_hits(t, items) for i, t in TEXTS}
    assert len(got) == len(TEXTS) and all(tuple(r)[1:] == want[r.doc_id] for r in got)
    kept = decontaminate.clean(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]}
    assert decontaminate.hits(none, bench).count() == 0 and decontaminate.hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_hits_come_from_longest_matches(monkeypatch):
    asked, find = [], decontaminate.TestSet.find
    monkeypatch.setattr(decontaminate.TestSet, "find", lambda self, w, matches=False: asked.append((matches, find(self, w, matches))) or asked[-1][1])
    item = [f"w{i}" for i in range(20)]
    doc = "x " + " ".join(item[2:18]) + " y " + " ".join(item[:12])
    _, begin, hit, items = decontaminate._shard(decontaminate.TestSet([("a", " ".join(item).encode())]), [b"w1", doc.encode(), b""])
    assert hit[begin[1] : begin[2]].nonzero()[0].tolist() == list(range(1, 17)) and items == [set(), {"a"}, set()]
    assert asked[0][0] and {(s, int(n)) for _, length, _, s in asked[0][1] for n in length} == {(2, 16), (3, 15), (4, 14), (5, 13)}


def test_longest_matches(spark):
    p = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "a " + " ".join(p[:20]) + " b"), (2, " ".join(p))], "doc_id long, text string")
    got = {(r.doc_id, r.item_start): (r.doc_start, r.n_words) for r in decontaminate.longest_matches(docs, spark.createDataFrame([(7, " ".join(p[5:35]))], "item_id long, text string")).collect()}
    assert got[(1, 0)] == (6, 15) and got[(2, 0)] == (5, 30) and got[(1, 2)] == (8, 13) and (1, 3) not in got


def brute_repeats(texts):
    seen, out = set(), {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k] += 1
                gone[k + 100] -= 1
            seen.add(b[k : k + 100])
        g = np.cumsum(gone)[: len(b)] > 0
        out[i] = (len(b), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest())
    return out


def test_suffix_dedup(docs, none):
    got = suffix_dedup.without_repeats(docs).collect()
    want = brute_repeats(TEXTS)
    assert len(got) == len(TEXTS) and all(tuple(r)[1:] == want[r.doc_id] for r in got)
    assert suffix_dedup.without_repeats(none).count() == 0
    kept = {r.doc_id: r for r in suffix_dedup.kept_texts(docs).collect()}
    assert kept[900].text == "" and kept[905].text == "x"


def test_suffix_dedup_of_a_group_beyond_a_task(spark, monkeypatch):
    draw = random.Random(8)
    noise = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    common, tail = noise(170), noise(60)
    texts = [(i, noise(draw.randint(0, 150)) + (tail if i % 3 else "") + common + (tail if i % 5 else "") + noise(draw.randint(0, 150))) for i in range(240)]
    limit, sort = 4000, suffix_dedup.repeated_starts

    def bounded(members):
        assert sum(len(m[3]) for m in members) <= 2 * limit
        return sort(members)

    monkeypatch.setattr(suffix_dedup, "SORTED", limit)
    monkeypatch.setattr(suffix_dedup, "repeated_starts", bounded)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.without_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute_repeats(texts)


def test_difference_cover():
    rng = np.random.default_rng(1)
    for _ in range(400):
        s = rng.integers(1, rng.integers(2, 5), rng.integers(1, 60))
        assert suffix_dedup.difference_cover(s, 10**9).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_very_long_text(spark):
    body = "".join(random.choice("abcd ") for _ in range(30_000))
    texts = [(1, body + body[:5000]), (2, "q" + body[100:400])]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.without_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute_repeats(texts)


def test_pii(spark, docs):
    same = ["4539 1488 0343 6467", "4539-1488-0343-6467", "4539148803436467"]
    values = [*same, "1234567890123456", "er.55@mail9.example.com", "+1 (017) 555-7713", "97.51.17.173", "2024-02-29", "31.12.1999", "DE89370400440532013000", "123-45-6789"]
    left = ["300.1.1.1", "2023-02-29", "a@b", "000-12-3456", "12345", "3.14", "1999"]
    df = spark.createDataFrame([(i, f"a {v} b") for i, v in enumerate(values + left)] + [(90, None), (91, ""), (92, f"{values[4]}, {values[4]}")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    new = [got[i].text[2:-2] for i in range(len(values))]
    assert all(a != b for a, b in zip(values, new, strict=True)) and all(got[len(values) + i].text == f"a {v} b" for i, v in enumerate(left))
    shape = lambda x: re.sub(r"[0-9]+", "9", x)
    assert all(re.sub("[0-9]", "9", a) == re.sub("[0-9]", "9", b) for a, b in zip(values, new, strict=True) if "@" not in a and a.count(".") < 3)
    assert len({x.replace(" ", "").replace("-", "") for x in new[:3]}) == 1 and shape(new[6]) == "9.9.9.9"
    digits = [int(c) for c in new[2][::-1]]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    iban = new[9][4:] + new[9][:4]
    assert int("".join(str(int(c, 36)) for c in iban)) % 97 == 1
    assert got[90].text is None and got[91].text == "" and got[92].text == f"{new[4]}, {new[4]}"
    out = pii.pseudonymised(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString().split("InMemory")[0])


def test_pii_without_two_digits_in_a_row(spark):
    texts = ["see 8.8.8.8", "see 8.8.8.8 in 2024", "card 4 5 3 9 5 7 8 7 6 3 6 2 1 4 8 6 now", "card 4 5 3 9 5 7 8 7 6 3 6 2 1 4 8 6 now, 2024", "1-1-1-1 or 9.9.9.9.9 or 7 8 (9)"]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].changed for i in range(5)] == [True, True, True, True, False]
    # equal values stay linked, whatever else a text holds
    assert got[1].text == got[0].text + " in 2024" and got[3].text == got[2].text + ", 2024"
    assert not any(w in got[0].text + got[2].text for w in ("8.8.8.8", "4 5 3 9 5 7 8 7"))
    # the gate is no narrower than the candidates
    for x in ("a@b.cc", "GB82 WEST 1234 5698 7654 32", "1.2.2001", "1.1.1.1", "123-45-6789", "+1(2)(3)", "+1.(2) 3", "(123) 456-7890", "1-2-3-4 5 6 7 8 9 1 2 3 4"):
        assert re.search(pii.CANDIDATE, x) and re.search(pii.GATE, x)


def test_feistel_is_a_bijection(spark):
    for size in (2, 3):
        n = 10**size
        df = spark.range(n).select(F.lpad(F.col("id").cast("string"), size, "0").alias("d"))
        assert df.select(pii.digits_permuted(F.col("d"), "k", "key").alias("x")).distinct().count() == n
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(pii.date(F.col("d"), "key").alias("x")).distinct().count() == 3000


def pii_twin(text, key=pii.KEY):
    """The pseudonyms in plain Python."""
    import datetime

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def feistel(a, b, m, n, tag):
        for i in range(pii.ROUNDS):
            f = int(sha(f"{key}|{tag}|{i}|{a if i % 2 else b}")[:15], 16)
            a, b = (a, (b + f % n) % n) if i % 2 else ((a + f % m) % m, b)
        return a, b

    def permuted(d, kind):
        if len(d) < 2:
            return d
        k = len(d) // 2
        a, b = feistel(int(d[:k]), int(d[k:]), 10**k, 10 ** (len(d) - k), f"{kind}|{len(d)}")
        return f"{a:0{k}}{b:0{len(d) - k}}"

    def refill(shape, new, what="[0-9]"):
        new = iter(new)
        return re.sub(what, lambda _: next(new), shape)

    luhn = lambda d: sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(d[::-1])) % 10
    digits = lambda x: re.sub("[^0-9]", "", x)

    def email(x):
        local, domain = x.split("@")
        plain = re.sub("[^a-z0-9]", "", local.lower())
        shape = re.sub("[0-9]", "0", re.sub("[a-z]", "a", plain)) + "|" + domain.lower()
        half = [plain[: len(plain) // 2], plain[len(plain) // 2 :]]
        for i in range(pii.ROUNDS):
            h = sha(f"{key}|email|{shape}|{i}|{half[1 - i % 2]}")
            by = lambda j, h=h: int(h[j % 32 * 2 : j % 32 * 2 + 2], 16)
            half[i % 2] = "".join(str((int(c) + by(j)) % 10) if c.isdigit() else chr((ord(c) - 97 + by(j)) % 26 + 97) for j, c in enumerate(half[i % 2]))
        new = refill(local, "".join(half), "[A-Za-z0-9]")
        return "".join(n.upper() if o.isupper() else n for o, n in zip(local, new, strict=True)) + "@" + domain

    def iban(x):
        v = x.replace(" ", "")
        mod = lambda v: int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97
        if not 15 <= len(v) <= 34 or mod(v) != 1:
            return x
        body = refill(v[4:], permuted(digits(v[4:])[:34], "iban"))
        return refill(x, f"{v[:2]}{98 - mod(v[:2] + '00' + body):02}{body}", "[A-Z0-9]")

    def date(x):
        p = re.split("[-/.]", x)
        iso = len(p[0]) == 4
        y, m, d = p if iso else p[::-1]
        swapped = not iso and int(m) > 12
        m, d = (d, m) if swapped else (m, d)
        try:
            datetime.date(int(y), int(m), int(d))
        except ValueError:
            return x
        kind = "i" if iso else ("m" if swapped else "d") + f"{len(p[0])}{len(p[1])}"
        if (int(m), int(d)) == (2, 29):
            a, b = feistel((int(y) - 1904) // 4 // 7, (int(y) - 1904) // 4 % 7, 7, 7, f"date|{kind}|29")
            y = 1904 + 4 * (7 * a + b)
        else:
            days = pii._days(kind).split(" ")
            a, b = feistel(days.index(f"{int(m):02}{int(d):02}"), int(y) - 1900, len(days), 200, f"date|{kind}")
            m, d, y = days[a][:2], days[a][2:], b + 1900
        if iso:
            return f"{y}-{int(m):02}-{int(d):02}"
        one, two = ((m, d) if swapped else (d, m))
        return f"{int(one):0{len(p[0])}}{x[len(p[0])]}{int(two):0{len(p[1])}}{x[len(p[0]) + len(p[1]) + 1]}{y}"

    def ipv4(x):
        p = [int(y) for y in x.split(".")]
        if max(p) > 255:
            return x
        a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ipv4")
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"

    def ssn(x):
        if not re.fullmatch(VALID_SSN, x):
            return x
        areas = [n for n in range(1, 900) if n != 666]
        area, group, serial = map(int, x.split("-"))
        a, b = feistel(areas.index(area), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
        return f"{areas[a]:03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"

    def phone(x):
        m = re.match(r"^\+[0-9]{1,3}(?=[^0-9])|^\+(?:1|7|[2-9][0-9])", x)
        code, rest = (m[0], x[len(m[0]) :]) if m else ("", x)
        return code + refill(rest, permuted(digits(rest), "phone")) if 7 <= len(digits(rest)) <= 14 else x

    def card(x):
        d, r = digits(x), luhn(digits(x))
        if r and len(d) != 16:
            return x
        body = permuted(d[:-1], "account" if r else "card")
        return refill(x, body + str((10 - luhn(body + "0") + r) % 10))

    kinds = ((pii.EMAIL, email), (pii.IBAN, iban), (pii.DATE, date), (pii.IPV4, ipv4), (pii.SSN, ssn), (pii.PHONE, phone), (pii.CARD, card))
    return re.sub(pii.CANDIDATE, lambda m: next((f(m[0]) for p, f in kinds if re.fullmatch(p, m[0])), m[0]), text, flags=re.A)


VALID_SSN = "(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"


def test_valid_numbers_have_valid_pseudonyms_of_their_own(spark):
    draw = random.Random(9)
    edges = [f"{a:03}-{g:02}-{n:04}" for a in (1, 665, 667, 899) for g in (1, 99) for n in (1, 9999)]
    valid = sorted({*edges, *(f"{draw.choice([*range(1, 666), *range(667, 900)]):03}-{draw.randint(1, 99):02}-{draw.randint(1, 9999):04}" for _ in range(5000))})
    invalid = ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-3456", "123-12-0000"]
    got = {r.doc_id: r.text for r in pii.report(spark.createDataFrame(list(enumerate(valid + invalid)), "doc_id long, text string")).collect()}
    new = [got[i] for i in range(len(valid))]
    assert all(re.fullmatch(VALID_SSN, x) for x in new) and len(set(new)) == len(valid) and sum(a == b for a, b in zip(valid, new, strict=True)) < 5
    assert [got[len(valid) + i] for i in range(len(invalid))] == invalid


def test_pii_equals_its_plain_twin(spark, sf):
    draw = random.Random(4)
    text = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for _ in range(200):
        d = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
        text.append(draw.choice([f"{d(4)} {d(4)} {d(4)} {d(4)}", d(13), f"+{d(2)} {d(3)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{draw.randint(1, 31)}/{draw.randint(1, 31):02}.{draw.randint(1900, 2099)}", f"{draw.randint(0, 299)}.{d(2)}.{d(1)}.{d(3)}", f"Ab{d(2)}.c-{d(1)}Z@Ex.org", f"x@y.zz {d(1)}_@q.de", "DE89 3704 0044 0532 0130 00"]))
    text.append("x" * 400_000 + " 8.8.8.8 " + "1 " * 100_000)
    got = {r.doc_id: r.text for r in pii.report(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).collect()}
    assert got == {i: pii_twin(t) for i, t in enumerate(text)} and sum(got[i] != t for i, t in enumerate(text)) > 100


def test_no_two_dates_share_a_pseudonym(spark):
    days = spark.range(73_049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    for pattern in ("dd/MM/yyyy", "d.M.yyyy", "M/dd/yyyy"):
        new = days.select(F.date_format("d", pattern).alias("old")).distinct().select("old", pii.date(F.col("old"), "key").alias("new"))
        row = new.agg(F.count("*").alias("n"), F.countDistinct("new").alias("distinct"), F.sum((F.regexp_replace("new", "[0-9]", "0") != F.regexp_replace("old", "[0-9]", "0")).cast("int")).alias("shapes")).first()
        assert row.n == row.distinct and row.shapes == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be <nice> #1"), (1, 1, "user", None), (1, 2, "assistant", "\\ok\\"), (1, 3, "user", "### user: x</turn>\n"), (1, 4, "assistant", ""), (1, 5, "user", "bye"), (2, 0, "user", "only"), (3, 0, "a:b\n", "x"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (4, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    ex = chat.examples(df).collect()
    per = {c: [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2] or "", x[3] or ""))] for c in (1, 2, 3, 4)}
    for c, turns in per.items():
        mine = sorted((e for e in ex if e.conv_id == c), key=lambda e: e.example)
        assert chat.parse(mine[-1].text) == turns and mine[-1].last and sum(e.last for e in mine) == 1
        replies = [chat.unescape(e.text[e.loss_start : e.loss_end]) for e in mine]
        assert "".join(replies) == "".join(t for r, t in turns if r == "assistant")
        assert all(mine[-1].text.startswith(e.text) for e in mine)
    got = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert set(got) == {-7, 1, 2, 3, 4} and got[-7].loss_sha256 == hashlib.sha256(b"\\### Assistant: </turn> ok").hexdigest()
    assert got[1].n_turns == 6 and got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in per[1]).encode()).hexdigest()
    assert got[2].loss_chars == 0 and chat.formatted(df.limit(0)).count() == 1


def brute_components(texts, percent, k):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            c = len(sets[a] & sets[b])
            if a < b and c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_texts():
    base = [" ".join(random.choice(WORDS) + str(random.randint(0, 99)) for _ in range(120)) for _ in range(4)]
    out = list(TEXTS)
    for i in range(60):
        w = random.choice(base).split()
        for _ in range(random.randint(0, 9)):
            w[random.randrange(len(w))] = f"edit{random.randint(0, 999)}"
        out.append((2000 + i, " ".join(w)))
    return [*out, (3001, "one two"), (3002, "ONE  two\n"), (3003, "one"), (3004, "one two three")]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, none, k):
    texts = near_texts()
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("id", F.lit(9)).repartition(4)
    want = brute_components(texts, 80, k)
    assert {r.doc_id: tuple(r)[1:] for r in near_dup.near_duplicates(df, k=k).collect()} == want
    if k == 5:
        kept = near_dup.deduplicated(df)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])
        assert near_dup.near_duplicates(none).count() == 0
        twice = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
        assert near_dup.deduplicated(twice).count() == 2


def test_sequential_test_bounds():
    least = [near_dup.least_matches(n, 0.8) for n in range(16, 161, 16)]
    assert least == sorted(least) and 0 < least[-1] < 0.8 * 160
    rng = np.random.default_rng(2)
    lost = 0
    for _ in range(3000):
        matches = np.cumsum(rng.random(160) < 0.8 + 0.2 / 256)[15::16]
        lost += (matches < least).any()
    assert lost <= 3


def test_lanes_of_unlike_sets_agree_in_one_of_256():
    sketch = near_dup.Sketcher(2)
    rng = np.random.default_rng(5)
    for n in (50, 2000, 20_000):
        x, y = (np.frombuffer(near_dup.lanes(sketch.signature(rng.integers(0, 1 << 63, n, np.uint64))), np.uint8) for _ in range(2))
        assert len(x) == near_dup.LANES and (x == y).sum() <= 8
    # the test on signatures of real sets: those at the threshold stay, unlike ones go with the first batch
    least = [near_dup.least_matches(n, 0.8) for n in range(near_dup.BATCH, near_dup.LANES + 1, near_dup.BATCH)]
    for n in (100, 5000):
        common = rng.integers(0, 1 << 63, 8 * n, np.uint64)
        x, y = (np.frombuffer(near_dup.lanes(sketch.signature(np.append(common, rng.integers(0, 1 << 63, n, np.uint64)))), np.uint8) for _ in range(2))
        assert ((x == y).reshape(-1, near_dup.BATCH).sum(1).cumsum() >= least).all()
        z = np.frombuffer(near_dup.lanes(sketch.signature(rng.integers(0, 1 << 63, n, np.uint64))), np.uint8)
        assert (x == z)[: near_dup.BATCH].sum() < least[0]


@pytest.mark.parametrize("block", [near_dup.BLOCK, 20_000])
def test_near_duplicates_of_a_large_group_of_unlike_copies(spark, monkeypatch, block):
    """Chains and clouds of copies with similarities on both sides of the threshold, in blocks of a few texts too."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    draw = random.Random(11)
    base = [f"w{draw.randint(0, 9999)}" for _ in range(90)]
    texts = []
    for i in range(320):
        w = list(base)
        for at in draw.sample(range(90), draw.choice((0, 2, 5, 6, 7, 8))):
            w[at] = f"e{draw.randint(0, 40)}"
        texts.append((i, " ".join(w)))
    chain = list(base[::-1])
    for i in range(60):
        chain = [*chain[4:], *(f"c{i}-{j}" for j in range(4))]
        texts.append((1000 + 7 * i % 60, " ".join(chain)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    got = {r.doc_id: tuple(r)[1:] for r in near_dup.near_duplicates(df).collect()}
    want = brute_components(texts, 80, 2)
    assert got == want and 3 < sum(w[2] for w in want.values()) < 300


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{200 + i: 200 for i in range(30)}}


def test_components_take_few_jobs(spark):
    """The driver pays for each job: a step has at most six, with what tells whether it changed anything, and stars need one step."""
    context, tell = spark.sparkContext, spark.sparkContext.statusTracker()

    def jobs(edges):
        context.setJobGroup(name := f"components of {len(edges)}", "")
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        context.setJobGroup("", "")
        return got, len(tell.getJobIdsForGroup(name))

    got, n = jobs([(200, 200 + i) for i in range(1, 30)])
    assert got == {200 + i: 200 for i in range(30)} and n <= 12  # 24 before
    got, n = jobs([(i, i + 1) for i in range(40)])
    assert got == {i: 0 for i in range(41)} and n <= 50  # 74 before
    assert jobs([])[0] == {}


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    pieces = "ab 'sé\n\t<|>.1Σİ́  "
    extra = [(2000 + i, "".join(random.choice(pieces) for _ in range(random.randint(1, 40)))) for i in range(300)]
    extra += [(3000, "a<|endoftext|>b <|startoftext|>"), (3001, "日本語 \U0001f600‍\U0001f467"), (3002, "ab" * 3000)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = {}
    for r in both.collect():
        e = t.encode(r.text or "", add_special_tokens=False)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[r.doc_id] = (len(e.ids), sha(" ".join(map(str, e.ids))), sha(t.decode(e.ids, skip_special_tokens=False)))
    assert {r.doc_id: tuple(r)[1:] for r in bpe.encoded(both, path).collect()} == want
    assert bpe.encoded(none, path).count() == 0
    assert bpe.token_ids(spark.createDataFrame([(1, "Hello hello")], "doc_id long, text string"), path).first().ids == t.encode("Hello hello", add_special_tokens=False).ids


def test_quality(spark, sf, docs, none):
    labels, table = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    got = quality.scored(table, labels)
    seen = got.join(labels, "doc_id").where("held_out").collect()
    assert len(seen) > 20 and sum(r.predicted == r.quality for r in seen) >= 0.95 * len(seen)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.collect())
    other = quality.scored(table.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")}), labels.union(labels.where("quality IS NULL")))
    assert sorted(other.collect()) == sorted(got.collect())
    blank = quality.scored(docs, labels.where("doc_id = -1")).collect()
    assert len(blank) == len(TEXTS) and {r.score for r in blank} == {0.5}
    assert quality.scored(none, labels).count() == 0 and quality.good(table, labels).columns == table.columns


def test_crf_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    m = quality.Crf(np.zeros(1), np.ones(1))
    m.table = rng.normal(size=(2, 2))
    count = np.array([1, 4, 3])
    odds = rng.normal(size=8)
    good, both, log_z = m.marginals(odds, count)
    at = 0
    for d, n in enumerate(count):
        o = odds[at : at + n]
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = np.exp([sum(o[i] for i in range(n) if p[i]) + sum(m.table[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
        assert np.isclose(np.log(w.sum()), log_z[d])
        assert np.allclose([(w * [p[i] for p in paths]).sum() / w.sum() for i in range(n)], good[at : at + n])
        assert np.isclose(both[d].sum(), n - 1)
        at += n


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><a>Menu</a></nav><div class="x{n}"><p>{tag}</p></div>{body}<footer>F</footer></body></html>'


def test_html(spark):
    article = "<article><header><h1>Head &amp; x</h1></header><p><b>one\n  two<br>three<p>four &lt;5<ul><li>a<li>b</ul><div class='comments'><p>no</p></div><div class='box'><p>{box}</p></div></article>"
    pages = [(i, "http://h.example/a", PAGE.format(n=0, tag="everywhere", body=article.format(box="Follow us")).replace("four", f"four{i}")) for i in range(8)]
    pages += [(20 + i, "http://plain.example/b", PAGE.format(n=1, tag="Template line", body=f"<div><p>Body {i}</p></div>")) for i in range(6)]
    pages += [(30 + i, "http://copies.example/c", PAGE.format(n=2, tag="t", body="<article><p>Same text</p><div><p>inner</p></div></article>")) for i in range(9)]
    pages += [(50, None, None), (51, "::bad[", ""), (52, "http://q.example", "<p>a < b &#x41; &nbsp;c<script>no</script>"), (52, "http://q.example", "unclosed <div class=sidebar>s")]
    got = {}
    for r in html_main.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    assert sum(map(len, got.values())) == len(pages)
    assert got[3] == ["Head & x\none two three\nfour3 <5\na\nb"]  # the box recurs over unlike pages of its host
    assert got[22] == ["Body 2"] and got[35] == ["Same text\ninner"] and got[50] == [""] and got[51] == [""]
    assert sorted(got[52]) == ["a < b A c", "unclosed"]
    assert html_main.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_templates_of_a_large_host(spark):
    # six variants of a box, each in a sixth of the pages; a heading as often, which is no container; a box on few pages
    page = lambda i: f"<body><div class=box>Offer {i % 6}</div>" + ("<h2>Summary</h2>" if i % 6 == 1 else "") + (f"<div>Rare {i % 40}</div>") + f"<p>Text number {i}.</p></body>"
    df = spark.createDataFrame([(i, f"http://big.example/{i}", page(i)) for i in range(360)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_main.main_text(df).collect()}
    assert got == {i: ("Summary\n" if i % 6 == 1 else "") + f"Rare {i % 40}\nText number {i}." for i in range(360)}


@pytest.mark.parametrize("sent", [html_main.SENT, 0])
def test_html_by_recurrence_alone(spark, monkeypatch, sent):
    monkeypatch.setattr(html_main, "SENT", sent)
    # nothing in these pages says what it is; and one host with too few pages for counts, where tags and places speak
    page = lambda i: f"<body><div><p>Where to go</p><a>Here</a></div><p>Text {i} of the page.</p><div>Only once: {i}</div><section>Write to us</section></body>"
    pages = [(i, f"http://many.example/{i}", page(i)) for i in range(30)] + [(100 + i, "http://few.example/", page(i)) for i in range(3)]
    pages += [(200 + i, "http://beside.example/", f"<body><div>Menu of variant {i % 2}</div><article><p>Story {i}</p></article>loose<div>Advert {i}</div></body>") for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_main.main_text(df).collect()}
    assert all(got[i] == f"Text {i} of the page.\nOnly once: {i}" for i in range(30)) and got[101].count("\n") == 4
    assert all(got[200 + i] == f"Story {i}" for i in range(12))
    off = {r.page_id: r.text for r in html_main.main_text(df, least_pages=10**9).collect()}
    assert all(off[i] != got[i] for i in range(30)) and off[205] == "Menu of variant 1\nStory 5" and off[101] == got[101]


def test_adverts_that_recur_in_articles_go(spark):
    """The same advert in 1, 2, 4, 10 or all of the articles of a host; and comments in containers that recur."""
    rows, want = [], {}
    for k, often in enumerate((1, 2, 4, 10, 100)):
        for i in range(100):
            advert = f'<div class="advert">Buy it, {k}</div>' if i < often else ""
            talk = f'<div class="comments"><p>Great, {i % 20}</p></div>'
            rows.append((1000 * k + i, f"http://host{k}.example/{i}", f"<body><article><h1>Title {i}</h1>{advert}<p>Story {k} {i}</p>{talk}</article></body>"))
            want[1000 * k + i] = f"Title {i}\nStory {k} {i}"
    got = html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == want


def brute_main_texts(rows, least_pages=5, least_share=0.2, many_pages=50, known_pages=5, named_pages=2):
    """Counts and decisions anew, from the parsed pages."""
    pages = [(i, html_main.host(url), *html_main.parsed(h or "")) for i, url, h in rows]
    main = ["\n".join(t for t, _, rare, inside in blocks if inside and not rare) for _, _, blocks, _ in pages]
    seen, sizes = {}, {}
    for (_, h, _, subtrees), text in zip(pages, main, strict=True):
        sizes.setdefault(h, set()).add(text)
        for s in subtrees:
            seen.setdefault((h, s), set()).add(text)

    def gone(h, s):
        n, of = len(seen[h, s]), len(sizes[h])
        return bool(s & 4) and n >= named_pages or n >= least_pages and (bool(s & 2) or n >= least_share * of or s & 1 and n >= max(many_pages, least_pages))

    def known(h, s):
        return len(seen[h, s]) >= (min(named_pages, least_pages) if s & 4 else min(least_pages, known_pages))

    return sorted((i, "\n".join(t for t, path, rare, _ in blocks if not any(gone(h, s) for s in path) and all(known(h, s) for s in rare))) for i, h, blocks, _ in pages)


def test_html_is_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in df.collect()]
    r = random.Random(6)
    parts = ["<nav>Home</nav>", "<div>Box {a}</div>", '<div class="promo">Deal {a}</div>', "<p>Text {b}</p>", "<section><p>Note {a}</p><div>In {c}</div></section>", "<article><p>Story {b}</p><div>Box {a}</div><aside>See {a}</aside></article>", "<h2>Head {c}</h2>", "<footer>Foot {c}</footer>"]
    for i in range(300):
        page = "".join(r.choice(parts).format(a=r.randint(0, 3), b=r.randint(0, 200), c=r.randint(0, 30)) for _ in range(r.randint(1, 7)))
        rows.append((10_000_000 + i, f"http://h{r.randint(0, 4)}.example/", f"<body>{page}</body>"))
    made = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((x.page_id, x.text) for x in html_main.main_text(made).collect())
    assert got == brute_main_texts(rows)
    few = {"least_pages": 3, "many_pages": 4, "known_pages": 2, "named_pages": 9}
    assert sorted((x.page_id, x.text) for x in html_main.main_text(made, **few).collect()) == brute_main_texts(rows, **few)


def test_html_takes_time_in_proportion():
    import time

    for piece in ('<a href="', "<a ", "<", "<!--", "<a b='", "</b>", "<p>x</b>"):
        began = time.process_time()
        html_main.parsed(piece * (300_000 // len(piece)))
        assert time.process_time() - began < 3


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    state, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, sf).cache()
        assert state.columns == docs.columns
        kept.append({r.doc_id: r for r in state.collect()})
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.scored(docs, labels).where("predicted = 1").collect()}
    assert set(kept[0]) == good
    alone = brute_components([(i, texts[i]) for i in good], 80, 5)
    assert set(kept[1]) == {i for i, w in alone.items() if w[2]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {i for i in kept[1] if brute_hits(texts[i], items)[4]}
    assert set(kept[2]) == set(kept[1]) - bad and set(kept[3]) == set(kept[2])
    # the last two stages by what they make: pseudonyms of the plain twin, and the library's ids and decoded texts
    assert {i: r.text for i, r in kept[3].items()} == {i: pii_twin(r.text) for i, r in kept[2].items()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for i, r in kept[3].items():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[i] = len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))
    last = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last} == want and len(last) == len(want)


def test_a_component_with_many_guests(spark, monkeypatch):
    """One large group of near copies, and as many texts at its edge, each with one of its members only: both are cut into blocks, and no task has more than two blocks' rows."""
    monkeypatch.setattr(near_dup, "BLOCK", 6000)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(60)]
    texts = []
    for i in range(60):
        w = list(base)
        w[r.randrange(60)] = word()
        texts.append((i, " ".join(w)))
    for i in range(60):  # at the edge of the similarity
        w = texts[i][1].split()
        for k in r.sample(range(60), r.choice([3, 4, 5, 6, 7])):
            w[k] = word()
        texts.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(df).collect()}
    assert got == {i: v[1] for i, v in brute_components(texts, 80, 2).items()}
    # the blocks by themselves: every link of guests and members is found, and blocks are bounded
    rows = near_dup.stored(near_dup.sketches(df, 2), "sketches")
    classes, buckets = near_dup._shared(rows)
    sets = near_dup._sets(df, classes, buckets, 2)
    ids = {x.id for x in sets.collect()}
    inside = sorted(i for i in ids if i < 100)
    roots = spark.createDataFrame([(i, inside[0]) for i in inside], "node long, root long")
    guests = spark.createDataFrame([(i, i, inside[0]) for i in sorted(ids) if i >= 100], "id long, root long, main long")
    met = []
    compared = near_dup.compared
    monkeypatch.setattr(near_dup, "compared", lambda groups, *a: met.append(groups) or compared(groups, *a))
    found = {tuple(sorted(x)) for x in near_dup.with_components(guests, roots, sets, 80).collect()}
    shingles = {i: {tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)} for i, t in texts}
    close = lambda a, b: 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])
    assert {b for _, b in found} == {g for g in ids if g >= 100 and any(close(g, m) for m in inside)} and all(close(a, b) for a, b in found)
    sizes = met[0].groupBy("group", "part", "side").count().agg(F.max("count"), F.count_distinct("part")).first()
    assert sizes[1] > 20 and sizes[0] <= 25


_MEMORY = """
import random
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tidalflow.llm import bpe
from tidalflow.llm.queries import tokenizer

def held(batches):
    status = dict(x.split(":", 1) for x in open("/proc/self/status"))
    for _ in batches:
        yield pa.RecordBatch.from_pydict({k: [int(status[k].split()[0]) >> 10] for k in ("VmRSS", "VmHWM")} | {"pid": [int(status["Pid"])]})

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
memory = lambda: spark.range(1, numPartitions=1).mapInArrow(held, "VmRSS long, VmHWM long, pid long").collect()[0]
random.seed(3)
words = ["".join(random.choices("abcdefghijklm", k=random.randint(2, 11))) for _ in range(40000)]
docs = spark.createDataFrame([(i, " ".join(random.choices(words, k=30000))) for i in range(40)], "doc_id long, text string").coalesce(1)
docs.cache().count()
before = memory()
n = bpe.encoded(docs, tokenizer("word_bpe_49k.json")).agg(F.sum("n_tokens")).first()[0]
after = memory()
print("MEMORY", n > 40 * 30000, before.pid == after.pid, after.VmHWM - before.VmRSS, after.VmRSS - before.VmRSS)
"""


def test_encoding_gives_its_memory_back():
    """A worker's memory, in MB, over what it had: at most while it encodes 9 MB of text, and once the task is over."""
    root = Path(__file__).parents[2]
    out = subprocess.run([sys.executable, "-c", _MEMORY], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=300).stdout
    whole, same, most, left = next(x.split()[1:] for x in out.splitlines() if x.startswith("MEMORY"))
    assert whole == same == "True"
    assert int(most) < 140 and int(left) < 90
