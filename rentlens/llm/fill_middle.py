"""Fill-in-the-middle rewriting of whole texts with one counted regular expression a row.

``regexp_count`` gives the number of units of a text; the row's own pattern then holds the counts: possessive
groups ``(unit{a}+)(unit{b-a}+)`` capture prefix and middle, the last group the suffix, and one match writes
the output. Possessive counts keep the Java matcher in loops, without recursion or backtracking, whatever
the length of the text. Everything is column functions.

A null text counts as empty and stays plain, as do texts that hold one of the markers; a null id is hashed as
the empty string, equal ids draw equal numbers. Each row stands for itself, so repeated rows give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.operators.clean import evaluate_once

BLANK = r"\x20\x09-\x0D"
UNIT = rf"(?:[{BLANK}]*+[^{BLANK}]++|[{BLANK}]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# what one match writes, and what one match reads back: groups are prefix, middle, suffix
WRITE = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
READ = {"psm": rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "spm": rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z"}
BACK = {"psm": "$1$3$2", "spm": "$2$3$1"}


def drawn(key: Column, seed: str) -> list[Column]:
    """Four whole numbers under 2**32 from the SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def rearranged(documents: DataFrame, seed: str = "42", rate: int = 50, spm: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the documents, then ``fim_n`` units, ``fim_form`` and ``fim_output``.

    ``rate`` of a hundred texts are rearranged, ``spm`` of a hundred of these with the suffix first. Columns
    that already have one of the three names are replaced.
    """
    made = ["fim_n", "fim_form", "fim_output"]
    kept = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in made])
    h1, h2, h3, h4 = drawn(F.col(f"`{key}`"), seed)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    form = F.when((whole == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    counted = evaluate_once(kept, {"fim_n": F.regexp_count(whole, F.lit(UNIT)).cast("long"), "fim_form": form})
    n = F.col("fim_n")
    first, last = F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1))
    pattern = F.concat(F.lit(rf"(?s)\A({UNIT}{{"), first.cast("string"), F.lit(rf"}}+)({UNIT}{{"), (last - first).cast("string"), F.lit(r"}+)(.*)\z"))
    written = F.when(F.col("fim_form") == "psm", WRITE["psm"]).otherwise(WRITE["spm"])
    output = F.when(F.col("fim_form") == "plain", whole).otherwise(F.regexp_replace(whole, pattern, written))
    return evaluate_once(counted, {"fim_output": output})


def restored(output: Column, form: Column) -> Column:
    """The text before rearranging, from output and form alone."""
    back = F.when(form == "psm", F.regexp_replace(output, READ["psm"], BACK["psm"]))
    return back.when(form == "spm", F.regexp_replace(output, READ["spm"], BACK["spm"])).otherwise(output)


def lengths(output: Column, form: Column) -> tuple[Column, Column]:
    """Code points of prefix and middle, null for plain texts. Markers occur only where they were written."""
    p, s, m = F.instr(output, PREFIX), F.instr(output, SUFFIX), F.instr(output, MIDDLE)
    prefix = F.when(form == "psm", s - p - 3).when(form == "spm", m - p - 3)
    return prefix.cast("long"), F.when(form != "plain", F.length(output) - m - 2).cast("long")


def digests(documents: DataFrame, seed: str = "42", rate: int = 50, spm: int = 80) -> DataFrame:
    """``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output_sha256`` and ``restored_sha256`` of every row."""
    rows = rearranged(documents.select("doc_id", "text"), seed, rate, spm).drop("text")
    output, form = F.col("fim_output"), F.col("fim_form")
    prefix, middle = lengths(output, form)
    return rows.select("doc_id", F.col("fim_n").alias("n"), form.alias("form"), prefix.alias("prefix_chars"), middle.alias("middle_chars"),
                       F.sha2(output, 256).alias("output_sha256"), F.sha2(restored(output, form), 256).alias("restored_sha256"))
