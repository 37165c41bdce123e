"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its reply under the loss
mask. A conversation that doesn't end with an assistant turn has one more example, without a target, so that no turn is
lost. A turn is written as ``### role: text</turn>`` and a line end; within roles and texts each backslash, ``#`` and ``<``
gets a backslash before it, and so does ``:`` within roles, so no control string can come from a text and the way back is exact.

The rows of a conversation are sorted by turn in the shuffle and streamed, so a task holds one prefix at a time. The size
of the examples grows with the square of a conversation's turns; that is what this format is.

Defined cases: null text and null role are empty; equal turn numbers are ordered by role, then text, and each row is a
turn; a null turn number comes first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps

_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def head(role: str) -> str:
    return f"### {escape(role).replace(':', chr(92) + ':')}: "


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted example."""
    out, at = [], 0
    while m := _TURN.match(formatted, at):
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def probe(spark: SparkSession) -> DataFrame:
    """A conversation of control strings."""
    text = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (0, 1, ...), text, loss_start, loss_end (code points; both at the end of the text where there is no target), last (whether the text is the whole conversation)."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "conv_id long, example long, text string, loss_start long, loss_end long, last boolean"
    fields = ("conv_id", "example", "text", "loss_start", "loss_end", "last")

    def run(batches):
        conv, prefix, size, count, pending = object(), [], 0, 0, None
        arrow = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("last", pa.bool_())])
        rows, taken = [], 0

        def close():
            # pending: the example of the turn before, if it was the assistant's; is it the last turn?
            if pending:
                return [(*pending, True)]
            return [(conv, count, "".join(prefix), size, size, True)] if prefix else []

        for part in steps(batches):
            for c, role, text in zip(part.column("conv_id").to_pylist(), part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True):
                if c != conv:
                    rows += close()
                    conv, prefix, size, count, pending = c, [], 0, 0, None
                elif pending:
                    rows.append((*pending, False))
                    pending = None
                start, body = head(role), escape(text)
                prefix += [start, body, "</turn>\n"]
                begin = size + len(start)
                size = begin + len(body) + 8
                if role == "assistant":
                    pending = (conv, count, "".join(prefix), begin, begin + len(body))
                    count += 1
                    taken += size
                if taken > 4 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(fields, r, strict=True)) for r in rows], schema=arrow)
                    rows, taken = [], 0
        rows += close()
        yield pa.RecordBatch.from_pylist([dict(zip(fields, r, strict=True)) for r in rows], schema=arrow)

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from the examples' texts and masks."""

    def run(batches):
        for part in steps(batches):
            ids, last = part.column("conv_id").to_pylist(), part.column("last").to_pylist()
            data = [(i, n, unescape(t[a:b]), len(t), *((len(p), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in p).encode()).hexdigest()) if end and (p := parse(t)) is not None else (None, None))) for i, n, t, a, b, end in zip(ids, part.column("example").to_pylist(), part.column("text").to_pylist(), part.column("loss_start").to_pylist(), part.column("loss_end").to_pylist(), last, strict=True)]
            columns = list(zip(*data, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "example", "loss", "chars", "n_turns", "turns_sha256"])

    one = formatted.mapInArrow(run, "conv_id long, example long, loss string, chars long, n_turns long, turns_sha256 string")
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return one.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars")).select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def formatted(conversations: DataFrame) -> DataFrame:
    """The digest of all conversations and the probe."""
    return read_back(examples(conversations.select("conv_id", "turn", "role", "text").unionByName(probe(conversations.sparkSession))))
