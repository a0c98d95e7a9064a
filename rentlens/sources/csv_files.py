"""Listing files in CSV form, of unknown encoding and with malformed rows."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.operators.lookup import lookup_join
from rentlens.sources.csv_ranges import csv_records
from rentlens.session import stage

# --- fixed values: characters of Windows-1252 for the bytes 80 to 9F; the other five are undefined ---
CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_UNDEFINED = "[\x81\x8d\x8f\x90\x9d]"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """First path of an ordered list that exists."""
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"no data file found, checked: {list(paths)}")


def _utf8(c: Column) -> Column:
    return F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")


def _kinds(records: DataFrame) -> dict[tuple[str, ...], list[str]]:
    """Distinct headers of the files by their column names."""
    out: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(records.where("first").select("record").distinct().collect()):
        decoded = row["record"].encode("latin-1").decode("utf-8", errors="replace").lstrip("\ufeff")
        names = tuple(n.strip() for n in next(csv.reader([decoded])))
        out.setdefault(names, []).append(row["record"])
    return out


def read_listings_csv(
    spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str] | None = None
) -> DataFrame:
    """All-string table of the first existing path, a file or a folder of files.

    Each file is read by its own header; files with other columns or another order are united by name. Quoted
    values may hold line breaks; large files are read by byte ranges all the same (``csv_ranges``).

    Each file is taken as UTF-8, else Windows-1252, else ISO-8859-1, whichever its bytes allow first.
    Records are put together once and stored with one character a byte, which loses nothing; one aggregate per
    file finds what the file allows and the text is then decoded by column expressions. Rows that are too
    long are skipped, short rows are filled with nulls. Missing ``columns`` are added as nulls.
    """
    path = first_existing(spark, [paths] if isinstance(paths, str) else paths)
    records = stage(csv_records(spark, [path]), "csv-records")
    kinds = _kinds(records)
    if not kinds:
        raise ValueError(f"no header in {path}")
    rows = records.where("not first")
    if len(kinds) > 1:
        rows = lookup_join(rows, records.where("first").select("file", F.col("record").alias("header")), ["file"])
    parts = [_read_kind(rows.where(F.col("header").isin(heads)) if len(kinds) > 1 else rows, list(names)) for names, heads in kinds.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    absent = [c for c in columns or [] if c not in out.columns]
    return out.withColumns({c: F.lit(None).cast("string") for c in absent})


def _read_kind(records: DataFrame, names: list[str]) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in [*names, "too_long"])
    parsed = F.from_csv("record", schema, {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    raw = records.select("file", parsed.alias("r")).select("file", "r.*")

    text = F.concat_ws(" ", *[F.col(f"`{n}`") for n in [*names, "too_long"]])
    allowed = raw.select("file", text.alias("text")).groupBy("file").agg(
        F.bool_and(F.is_valid_utf8(F.encode("text", "ISO-8859-1").cast("string"))).alias("is_utf8"),
        F.bool_and(~F.col("text").rlike(CP1252_UNDEFINED)).alias("is_cp1252"),
    )
    rows = lookup_join(raw.where(F.col("too_long").isNull()), allowed, ["file"])
    decoded = {}
    for n in names:
        c = F.col(f"`{n}`")
        decoded[n] = F.when(F.col("is_utf8"), _utf8(c)).when(
            F.col("is_cp1252"), F.translate(c, CP1252_BYTES, CP1252_CHARS)
        ).otherwise(c)
    return rows.select(*[c.alias(n) for n, c in decoded.items()])
