"""Periodic runs of words: harmonic grid probing.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of length max(LEAST, TIMES * q) at
least, which no neighbouring word extends. In it, words are equal to those q ahead for (TIMES - 1) * q places or more, so three grid
points jq, (j+1)q, (j+2)q in a row lie there: for every period p the words at jp and (j+1)p are compared, n/p probes and n log n
altogether. What survives three in a row, and two places between them, is extended both ways by comparing chunks of doubling
length. Periods go up, and grid points within found runs are skipped: two periods on a stretch as long as their sum would have
a common divisor as period, so a run of a smaller period holds no other run's grid points.

Each text is worked on by itself, whole, where it is read: there is no shuffle.

Defined cases: null and empty texts, and such of white space only, have no words and no runs; repeated rows each get a row; texts of
any length are searched whole (the grid of a text of over TABLE words is walked period by period); an empty table gives no rows;
columns other than doc_id and text are not read. Words are cut at ASCII white space and are otherwise any bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, texts

LEAST, TIMES = 6, 4
#: The grid of texts of up to so many words is laid out once a worker.
TABLE = 1 << 14
#: Words compared at first when a survivor is extended.
CHUNK = 32
#: Survivors of long texts that are looked at together.
TOGETHER = 1 << 16


@functools.cache
def grid(words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all grid points (j + 3)p below ``words``, by place: the place, its period p, and how many lie below each place."""
    place = np.concatenate([np.arange(3 * p, words, p, dtype=np.int32) for p in range(1, (words + 2) // 3 + 1)])
    period = np.repeat(np.arange(1, (words + 2) // 3 + 1, dtype=np.int32), [len(range(3 * p, words, p)) for p in range(1, (words + 2) // 3 + 1)])
    order = np.argsort(place, kind="stable")
    return place[order], period[order], np.searchsorted(place[order], np.arange(words + 1))


def survivors(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods p and places b, by p, then b, of which the words at b, b - p, b - 2p and b - 3p are equal; several of each a time."""
    n = len(words)
    if n <= TABLE:
        place, period, below = grid(TABLE)
        b, p = place[: below[n]], period[: below[n]]
        near = np.flatnonzero(words[b] == words[b - p])
        for k in (2, 3):
            near = near[words[b[near]] == words[b[near] - k * p[near]]]
        near = near[np.argsort(p[near], kind="stable")]
        yield p[near].astype(np.int64), b[near].astype(np.int64)
        return
    periods, places, held = [], [], 0
    for p in range(1, n // TIMES + 1):
        probe = words[::p]
        same = probe[1:] == probe[:-1]
        near = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        if len(near):
            periods.append(np.full(len(near), p, np.int64))
            places.append((near + 3) * p)
            held += len(near)
            if held >= TOGETHER:
                yield np.concatenate(periods), np.concatenate(places)
                periods, places, held = [], [], 0
    if held:
        yield np.concatenate(periods), np.concatenate(places)


def extent(words: np.ndarray, p: int, at: int) -> tuple[int, int]:
    """The greatest stretch around ``at`` on which words equal those ``p`` ahead, as start and end."""
    start, end, most, size = at, at, len(words) - p, CHUNK
    while end < most:
        upto = min(most, end + size)
        same = words[end:upto] == words[end + p : upto + p]
        if not same.all():
            end += int(same.argmin())
            break
        end, size = upto, 2 * size
    size = CHUNK
    while start > 0:
        upto = max(0, start - size)
        same = (words[upto:start] == words[upto + p : start + p])[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start, size = upto, 2 * size
    return start, end


def runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Every run of ``words``, given as numbers: start, length, period, by start, then period. ``times`` is 4 or more, ``least`` at most 2 * times."""
    if times < TIMES or least > 2 * times:
        raise ValueError("a run of a smaller period may be too short to be found first")
    found: list[tuple[int, int, int]] = []
    starts = ends = np.empty(0, np.int64)

    def outside(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which stretches don't lie within one found run."""
        if not len(starts):
            return np.ones(len(first), bool)
        k = np.searchsorted(starts, first, side="right") - 1
        return (k < 0) | (ends[np.maximum(k, 0)] <= last)

    if len(words) < least:
        return found
    for p, b in survivors(words):
        for k in (3, 2):
            between = b - k * p + p // 2
            same = words[between] == words[between + p]
            p, b = p[same], b[same]
        out = outside(b - 3 * p, b)
        p, b = p[out], b[out]
        while len(p):
            q, new = int(p[0]), []
            here = int(np.searchsorted(p, q, side="right"))
            places, i = b[:here], 0
            while i < here:
                start, end = extent(words, q, int(places[i]) - q)
                # a multiple of a found run's period can have a survivor whose outer grid points are equal by chance
                if end - start + q >= max(least, times * q) and outside(np.array([start]), np.array([end + q - 1]))[0]:
                    new.append((start, end - start + q, q))
                # places before end + q have a grid point in the same stretch
                i = max(i + 1, int(np.searchsorted(places, end + q)))
            p, b = p[here:], b[here:]
            if new:
                found += new
                order = sorted((s, s + length) for s, length, _ in found)
                starts = np.array([x for x, _ in order], np.int64)
                ends = np.maximum.accumulate(np.array([x for _, x in order], np.int64))
                out = outside(b - 3 * p, b)
                p, b = p[out], b[out]
    return sorted(found, key=lambda x: (x[0], x[2]))


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(x, len(seen)) for x in words), np.int32, len(words))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run contains after its first period."""
    edges = np.zeros(n + 1, np.int32)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def collapsed(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text without the repeats of its runs, words joined by one space.

    ``edit`` may change the words of a document before they are searched.
    """
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def run(batches):
        for part in steps(batches):
            ids, n, every, left = part.column("doc_id"), [], [], []
            for doc_id, text in zip(ids.to_pylist(), part.column("text").to_pylist(), strict=True):
                words = text.split()
                if edit:
                    words = edit(doc_id, words)
                found = runs(numbers(words), least, times)
                n.append(len(words))
                every.append([{"start": s, "length": length, "period": q} for s, length, q in found])
                left.append(b" ".join([words[i] for i in np.flatnonzero(kept(len(words), found))] if found else words))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(every, kind), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return texts(docs).mapInArrow(run, SCHEMA)


def summary(found: DataFrame) -> DataFrame:
    """Digests of ``collapsed``'s rows, and the longest run of each (ties: smallest start, then period)."""
    text = F.array_join(F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
