"""Chat formatting by perspective rotation: each participant in turn is the assistant, the others are named users."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainflow.llm.common import workspace, written

START, END = "<|im_start|>", "<|im_end|>"
UNKNOWN = "unknown"
#: Turns of one rendering, and the bytes of renderings that are handed on together.
TURNS, BATCH_BYTES = 1024, 1 << 24
_CONTROL = re.compile(r"[\x00-\x1f]")


def escaped(text: str) -> str:
    """A text that can neither begin nor end a turn."""
    return text.replace("<|im_", "< |im_")


def render(turns: list[tuple[str, str]], speaker: str) -> tuple[str, list[tuple[int, int]]]:
    """The dialogue as ``speaker`` sees it, and the spans (code points, end exclusive) that are to be learnt: the speaker's texts and their
    end marks. In a user's name control characters are spaces, so that no name ends its line."""
    out, at, mask = [], 0, []
    for role, text in turns:
        text = escaped(text)
        head = f"{START}{'system' if role == 'system' else 'assistant' if role == speaker else 'user name=' + _CONTROL.sub(' ', escaped(role))}\n"
        if role == speaker:
            mask.append((at + len(head), at + len(head) + len(text) + len(END)))
        out.append(f"{head}{text}{END}\n")
        at += len(out[-1])
    return "".join(out), mask


def rotate_perspectives(conversations: DataFrame, turns_each: int = TURNS) -> DataFrame:
    """A row for each conversation and participant, and for each part of it beyond ``turns_each`` turns: conv_id, part, speaker, n_turns, rendered, mask.

    conversations: conv_id (any type), turn, role, text. Participants are the roles of the whole conversation but ``system``, whose turns stay
    system turns for all. Turns are in the order (turn, role, text), nulls first. A null role is ``unknown``, a null text an empty one, a null
    conv_id a conversation. Repeated rows are one turn. A conversation without participants gives no rows, nor does an empty table. Other columns are ignored.

    Part k holds the turns from the (k * turns_each)-th on, so that a conversation of any length is dealt out. Every participant has a
    row for each part, one that is silent there too; it begins with the system turns of earlier parts, each different text once. n_turns counts them.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    long = turns.groupBy(F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > turns_each)
    long = written(long.select("c"), f"{workspace(turns.sparkSession, 'chat_rotation')}/long")
    if long.isEmpty():
        grouped = _whole(turns)
    else:
        same = F.col("conv_id").eqNullSafe(F.col("c"))
        grouped = _whole(turns.join(long, same, "left_anti")).unionByName(_in_parts(turns.join(long, same, "left_semi").distinct(), turns_each))

    def rotate(batches):
        for batch in batches:
            at, rows, size = [], [], 0
            for k in range(batch.num_rows):
                said = [("system", text) for text in batch.column(4)[k].as_py() or []] + [(t["role"], t["text"]) for t in batch.column(2)[k].as_py()]
                for speaker in batch.column(3)[k].as_py():
                    rendered, mask = render(said, speaker)
                    at.append(k)
                    rows.append({"speaker": speaker, "n_turns": len(said), "rendered": rendered, "mask": [{"start": a, "end": b} for a, b in mask]})
                    size += len(rendered)
                    if size >= BATCH_BYTES:
                        yield _batch(batch, at, rows)
                        at, rows, size = [], [], 0
            if rows:
                yield _batch(batch, at, rows)

    long, span = T.LongType(), T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [("conv_id", grouped.schema["conv_id"].dataType), ("part", long), ("speaker", T.StringType()), ("n_turns", long), ("rendered", T.StringType()), ("mask", span)]
    return grouped.mapInArrow(rotate, T.StructType([T.StructField(n, t) for n, t in fields]))


def _batch(batch: pa.RecordBatch, at: list[int], rows: list[dict]) -> pa.RecordBatch:
    found = pa.RecordBatch.from_pylist(rows, _ARROW)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), *found.columns], ["conv_id", "part", *found.schema.names])


_ORDERED = ["turn", "role", "text"]


def _said(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _whole(turns: DataFrame) -> DataFrame:
    """conv_id, part 0, turns, speakers, earlier (none) of conversations that are one rendering: one shuffle, everything else is within the row."""
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct(*_ORDERED))).alias("turns"))
    roles = F.filter(F.array_distinct("turns.role"), lambda r: r != "system")
    grouped = grouped.select("conv_id", F.lit(0).cast("long").alias("part"), _said(F.col("turns")).alias("turns"), F.sort_array(roles).alias("speakers"), F.array().cast("array<string>").alias("earlier"))
    return grouped.filter(F.size("speakers") > 0)


def _in_parts(turns: DataFrame, turns_each: int) -> DataFrame:
    """The same of conversations of several parts, a row for each. Turns are numbered in two levels: in ranges of the order, by the turns of the ranges before."""
    dense = turns.repartitionByRange("conv_id", *_ORDERED).withColumn("range", F.spark_partition_id())
    dense = written(dense, f"{workspace(turns.sparkSession, 'chat_rotation')}/ranges")
    upto = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dense.groupBy(F.col("conv_id").alias("c"), F.col("range").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    ranges = ranges.select("c", "r", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*_ORDERED)) - 1
    ranked = dense.withColumn("within", within).join(ranges, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    ranked = ranked.select("conv_id", *_ORDERED, F.floor((F.col("before") + F.col("within")) / turns_each).cast("long").alias("part"))
    grouped = ranked.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct(*_ORDERED))).alias("turns"))
    system = ranked.filter(F.col("role") == "system").groupBy("conv_id", "text").agg(F.min(F.struct("part", "turn")).alias("first"))
    system = system.groupBy(F.col("conv_id").alias("s")).agg(F.array_sort(F.collect_list(F.struct("first.part", "first.turn", "text"))).alias("system"))
    speakers = ranked.filter(F.col("role") != "system").groupBy(F.col("conv_id").alias("c")).agg(F.sort_array(F.collect_set("role")).alias("speakers"))
    grouped = grouped.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).join(system, F.col("conv_id").eqNullSafe(F.col("s")), "left")
    earlier = F.transform(F.filter("system", lambda t: t["part"] < F.col("part")), lambda t: t["text"])
    return grouped.select("conv_id", "part", _said(F.col("turns")).alias("turns"), "speakers", F.coalesce(earlier, F.array().cast("array<string>")).alias("earlier"))


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW = pa.schema([("speaker", pa.string()), ("n_turns", pa.int64()), ("rendered", pa.string()), ("mask", _SPAN)])
