import random
import re
from collections import defaultdict

import pytest

from rentlens.llm import bloom, exact_dedup

SHAPE = "doc_id long, text string, group_size string, kept string"


def rows():
    draw = random.Random(5)
    base = ["", "  ", None, "a b", "ab", " a\tb\n", "x" * 100_000, "é é", "e\u00a0e"] + [f"text {i}" for i in range(300)]
    made = [(i, draw.choice(base), "s", "k") for i in range(900)]
    return made + [(None, "a b", "s", "k"), (7, "ab", "s", "k"), (7, "ab", "s", "k")] + [(2000 + i, "hot  copy", "s", "k") for i in range(600)] + [(5000, "hotcopy   ", "s", "k")]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_copies_equal_brute_force(spark):
    given = rows()
    groups = defaultdict(list)
    for i, text, *_ in given:
        groups[normal(text)].append((-len(text or ""), i is None, i))
    best = {k: min(v, key=lambda r: (r[0], r[1], r[2] or 0)) for k, v in groups.items()}
    documents = spark.createDataFrame(given, SHAPE).repartition(7)
    out = exact_dedup.copies(documents).collect()
    assert len(out) == len(given)
    assert sum(r.kept for r in out) == len(groups)
    sizes = defaultdict(set)
    for r in out:
        sizes[r.text_sha256].add((r.keep_id, r.group_size))
    assert sorted(((k or -1), n) for s in sizes.values() for k, n in s) == sorted(((best[k][2] or -1), len(v)) for k, v in groups.items())


def test_rows_that_stay_are_whole(spark):
    documents = spark.createDataFrame(rows(), SHAPE).repartition(5)
    out = exact_dedup.distinct_documents(documents)
    assert out.columns == documents.columns
    kept = out.collect()
    assert sorted(normal(r.text) for r in kept) == sorted({normal(t) for _, t, *_ in rows()})
    assert {(r.doc_id, r.text) for r in kept} == {(r.doc_id, t) for r in kept for i, t, *_ in rows() if i == r.doc_id and t == r.text}
    hot = next(r for r in kept if normal(r.text) == "hotcopy")
    assert hot.doc_id == 5000


def test_empty_table(spark):
    none = spark.createDataFrame([], SHAPE)
    assert exact_dedup.copies(none).count() == 0
    assert exact_dedup.distinct_documents(none).count() == 0


@pytest.mark.parametrize("bits", [1, 3])
def test_filter_misses_no_key(spark, bits):
    keys = spark.range(20_000).selectExpr("xxhash64(id) as digest")
    pages = bloom.build(keys, "digest", bits)
    asked = bloom.ask(spark.range(40_000).selectExpr("id", "xxhash64(id) as digest"), "digest", pages, bits, "maybe")
    assert asked.where("id < 20000 and not maybe").count() == 0
    assert asked.count() == 40_000
    if bits == 3:
        assert asked.where("id >= 20000 and maybe").count() < 4_000


@pytest.mark.parametrize("keys_a_task", [1 << 22, 3_000])
def test_second_filter_holds_what_occurs_twice(spark, monkeypatch, keys_a_task):
    monkeypatch.setattr(exact_dedup, "KEYS_A_TASK", keys_a_task)
    once = spark.range(16_000).selectExpr("id", "xxhash64(id) as digest")
    again = spark.range(0, 16_000, 10).selectExpr("id", "xxhash64(id) as digest")
    hot = spark.range(4_000).selectExpr("-1L as id", "xxhash64(-1L) as digest")
    digests = once.union(again).union(hot).repartition(9)
    bits = bloom.page_bits(digests.count())
    pages = exact_dedup._repeated(digests, bits, digests.count())
    asked = bloom.ask(once.union(hot), "digest", pages, bits, "maybe")
    assert asked.where("id % 10 = 0 and not maybe").count() == 0
    assert asked.where("id = -1 and not maybe").count() == 0
    assert asked.where("id % 10 != 0 and id >= 0 and maybe").count() < 400
