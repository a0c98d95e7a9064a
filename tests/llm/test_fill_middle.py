import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rentlens.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, n string, form string, fim_n string, fim_output string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(output), sha(text)


def rows():
    draw = random.Random(3)
    alphabet = ["a", "Zed", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", " ", " ", "\x1c", "\x85", "é", "漢字", "😀", "\x00", "<", "<P", "S>", "$1", "\\", "{3}", "."]
    texts = ["", None, "   ", "word", " word ", "<P> is a marker", "x<M>", "😀" * 9, "á b"]
    texts += ["".join(draw.choices(alphabet, k=draw.randint(1, 40))) for _ in range(500)]
    made = [(i, t, "n", "f", "m", "o") for i, t in enumerate(texts)]
    return made + [(None, "no id at all here", "n", "f", "m", "o")] + [(11, "same row twice", "n", "f", "m", "o")] * 2


def test_every_row_equals_plain_python(spark):
    given = rows()
    out = fill_middle.digests(spark.createDataFrame(given, SHAPE).repartition(6))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((expected(i, t) for i, t, *_ in given), key=repr)


def test_other_columns_stay_and_made_ones_are_replaced(spark):
    given = spark.createDataFrame(rows(), SHAPE)
    out = fill_middle.rearranged(given, rate=100, spm=50)
    assert out.columns == ["doc_id", "text", "n", "form", "fim_n", "fim_form", "fim_output"]
    back = out.withColumn("back", fill_middle.restored(F.col("fim_output"), F.col("fim_form")))
    assert back.where("not (back <=> coalesce(text, ''))").count() == 0
    assert {r[0] for r in out.select("fim_form").distinct().collect()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("text", ["a b\n" * 1_000_000, "x" * 4_000_000, " " * 4_000_000, "漢 " * 800_000], ids=["words", "one word", "blanks", "wide"])
def test_very_long_texts(spark, text):
    seen = set()
    given = [(i, text) for i in (0, 3, 4, 5)]
    for r in fill_middle.digests(spark.createDataFrame(given, "doc_id long, text string")).collect():
        assert tuple(r) == expected(r.doc_id, text)
        seen.add(r.form)
    assert seen - {"plain"}


def test_empty_table(spark):
    assert fill_middle.digests(spark.createDataFrame([], SHAPE)).collect() == []


def test_plan_has_no_python(spark):
    plan = fill_middle.digests(spark.createDataFrame(rows(), SHAPE))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
