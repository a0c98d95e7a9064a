"""Records of large CSV files, read by byte ranges.

A quoted value may hold line breaks, so the state in which a byte range begins is not known from the range.
The built-in text source splits files into ranges of whole lines. A first pass follows each range twice, once as if
it began outside quotes and once inside, and gives one row a range: where either start ends. Running over
these rows tells how every range begins. The second pass puts lines together to records; the parts of a record that
crosses ranges are joined afterwards, and only they are shuffled.

A quote opens a value only at its beginning; a doubled quote inside stands for one. A record ends at a line
feed outside quotes, a carriage return before it goes. Empty records are left out. A file that ends inside quotes
gives its rest as one record. Ranges are as long as ``spark.sql.files.maxPartitionBytes`` says; compressed files
are one range each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def open_after(line: bytes, quoted: bool) -> bool:
    """Whether a quoted value is still open at the end of a line that begins inside (``quoted``) or outside one."""
    if not quoted and b'"' not in line:
        return False
    at = 0
    while True:
        if quoted:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == b'"':
                at += 2
                continue
            quoted = False
        elif line[at : at + 1] == b'"':
            quoted, at = True, at + 1
            continue
        at = line.find(b",", at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, start, line``: the lines of each range in their order."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """Lines of a batch that lie in one range, with the range."""
    for batch in batches:
        files, starts, lines = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        while at < len(lines):
            end = at + 1
            while end < len(lines) and starts[end] == starts[at] and files[end] == files[at]:
                end += 1
            yield (files[at], starts[at]), lines[at:end]
            at = end


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, start, outside, inside``: whether quotes are open at the end of a range that began outside or inside them."""
    ends: dict[tuple[str, int], tuple[bool, bool]] = {}
    for key, lines in _runs(batches):
        outside, inside = ends.get(key, (False, True))
        for line in lines:
            if outside == inside:  # both ways have met
                outside = inside = open_after(line, outside)
            else:
                outside, inside = open_after(line, outside), open_after(line, inside)
        ends[key] = (outside, inside)
    if ends:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in ends]), pa.array([k[1] for k in ends], pa.int64()), pa.array([v[0] for v in ends.values()]), pa.array([v[1] for v in ends.values()])],
            ["file", "start", "outside", "inside"])


def range_states(lines: DataFrame) -> DataFrame:
    """``file, start, quoted`` of every range: whether it begins inside quotes. One row a range."""
    ends = lines.mapInArrow(_ends, "file string, start long, outside boolean, inside boolean")
    # a range fixes the state at its end, keeps it or turns it; the last one that fixes it and the turns since decide
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    fixes, turns = F.col("outside") == F.col("inside"), (F.col("outside") & ~F.col("inside")).cast("int")
    marked = ends.withColumns({"fixed": F.when(fixes, F.col("outside").cast("int")), "turned": F.sum(turns).over(W.partitionBy("file").orderBy("start"))})
    marked = marked.withColumn("at_fix", F.when(fixes, F.struct(F.col("fixed").alias("state"), F.col("turned").alias("turned"))))
    last = F.last("at_fix", ignorenulls=True).over(before)
    state = F.coalesce(last["state"], F.lit(0)) + F.coalesce(F.last("turned").over(before), F.lit(0)) - F.coalesce(last["turned"], F.lit(0))
    return marked.select("file", "start", (state % 2 == 1).alias("quoted"))


def csv_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, first, record``: the records of the files as text with one character a byte; ``first`` marks a file's first."""
    lines = _lines(spark, paths)
    # ranges that begin inside a quoted value: those that cut a value in two
    inside = {(r["file"], r["start"]) for r in range_states(lines).where("quoted").select("file", "start").collect()}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, quoted, head, first = None, [], False, False, False
        out: list[tuple] = []

        def finish(whole: bool) -> None:
            if held:
                out.append((*key, first, head, whole, b"\n".join(held).decode("latin-1")))
                held.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "first", "head", "whole", "record"])
            out.clear()
            return made

        for found, run in _runs(batches):
            if found != key:
                finish(False)
                key, quoted, first = found, found in inside, found[1] == 0
                head = quoted
            for line in run:
                held.append(line)
                quoted = open_after(line, quoted)
                if not quoted:
                    finish(not head)
                    head = first = False
            yield batch()
        finish(False)
        yield batch()

    found = lines.mapInArrow(records, "file string, start long, first boolean, head boolean, whole boolean, record string")
    whole = found.where("whole").select("file", "first", "record")
    # a part that is no head begins a record; heads that follow it belong to it, up to two parts a range
    order = W.partitionBy("file").orderBy("start", F.col("head").desc())
    parts = found.where("not whole").withColumn("number", F.sum((~F.col("head")).cast("int")).over(order))
    joined = parts.groupBy("file", "number").agg(F.bool_or("first").alias("first"), F.sort_array(F.collect_list(F.struct("start", "record"))).alias("parts"))
    crossing = joined.select("file", "first", F.array_join("parts.record", "\n").alias("record"))
    every = whole.unionByName(crossing).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return every.where("record <> ''")
