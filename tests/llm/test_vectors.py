import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from rentlens.llm import segment_search, vector_codes
from pyspark.sql import functions as F

SHAPE = "vec_id long, embedding array<float>, label int, code string, error string, score string"


def made(count=400, size=32, seed=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 1, (7, size))
    rows = centres[draw.integers(0, 7, count)] + draw.normal(0, 0.05, (count, size)) * draw.integers(0, 3, (count, 1))
    rows = np.round(rows, 2).astype(np.float32)
    out = [(int(i), [float(x) for x in row], None if i % 9 == 0 else int(i % 4), "c", "e", "s") for i, row in enumerate(rows)]
    vector = out[5][1]
    out += [(1000 + i, vector, 1, "c", "e", "s") for i in range(150)] + [out[60], out[60], (None, vector, None, "c", "e", "s")]
    out += [(2000, None, 1, "c", "e", "s"), (2050, [None] + vector[1:], 1, "c", "e", "s"), (2100, [float("nan")] + vector[1:], 1, "c", "e", "s"),
            (2150, [float("-inf")] + vector[1:], 1, "c", "e", "s"), (2200, [0.0] * size, 1, "c", "e", "s")]
    return out


def kept(rows):
    return [(i, [math.floor(256 * x) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def coded(rows, parts, entries, rounds):
    rows = sorted(kept(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(cut(v, p)) for _, v, _ in rows[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for _, v, _ in rows:
                groups[near(cut(v, p), book)[1]].append(cut(v, p))
            for e, members in groups.items():
                book[e] = [sum(column) // len(members) for column in zip(*members)]
    out, sums = [], defaultdict(int)
    for i, v, label in rows:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        sums[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, code, error, sums[label], digest) for i, code, error, label in out]


@pytest.mark.parametrize("size, parts, entries", [(32, 16, 64), (32, 4, 200), (16, 16, 5)])
def test_codes_equal_plain_python(spark, size, parts, entries):
    rows = made(size=size)
    out = vector_codes.compressed(spark.createDataFrame(rows, SHAPE).repartition(5), parts, entries)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(coded(rows, parts, entries, 2), key=repr)


def test_fewer_vectors_than_entries_and_empty_tables(spark):
    rows = made(100)[:20]
    out = vector_codes.compressed(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(coded(rows, 16, 64, 2), key=repr)
    for none in ([], [(1, None, 1, "c", "e", "s")]):
        assert vector_codes.compressed(spark.createDataFrame(none, SHAPE)).collect() == []
        assert segment_search.top_k(spark.createDataFrame(none, SHAPE), F.lit(True)).collect() == []


def test_tree_finds_the_first_of_the_nearest_and_skips_subtrees():
    draw = np.random.default_rng(1)
    for points in (draw.integers(-6, 7, (64, 4)), np.repeat(draw.integers(-50, 50, (8, 2)), 8, axis=0), draw.integers(-10**8, 10**8, (200, 3)), np.zeros((70, 4), int)):
        queries = np.vstack([points, draw.integers(points.min() - 3, points.max() + 4, (3000, points.shape[1]))])
        apart = ((queries[:, None] - points[None]) ** 2).sum(2)
        index, squares = vector_codes.Gnat(points).nearest(queries)
        assert (index == apart.argmin(1)).all() and (squares == apart.min(1)).all()
    centres = draw.integers(-10_000, 10_000, (40, 4))
    tree = vector_codes.Gnat(np.vstack([c + draw.integers(-9, 10, (10, 4)) for c in centres]))
    asked = []
    plain = tree._squares
    tree._squares = lambda rows, entries: asked.append(len(rows) * len(entries)) or plain(rows, entries)
    tree.nearest(np.repeat(centres, 25, axis=0))
    assert sum(asked) < 1000 * 400 / 3


def test_vectors_that_cannot_be_cut_are_an_error(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compressed(spark.createDataFrame([(1, [0.5] * 9, 1)], "vec_id long, embedding array<float>, label int"))


def best(rows, asked, k):
    out, whole = [], kept(rows)
    queries = {(i, tuple(v)) for i, v, _ in whole if i is not None and asked(i)}
    for i, v in queries:
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for j, w, _ in whole if j != i and len(w) == len(v)))[:k]
        out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(scores, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size, cell", [(32, 1 << 25), (32, 4000), (3, 4000), (50, 1 << 25)])
def test_top_k_equals_plain_python(spark, size, cell):
    rows = made(300, size)
    found = segment_search.top_k(spark.createDataFrame(rows, SHAPE).repartition(6), F.col("vec_id") % 5 == 0, cell_bytes=cell, least_cells=3)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == best(rows, lambda i: i % 5 == 0, 5)


def test_top_k_meets_every_cell_when_partitions_stay_apart(spark):
    rows = made(300, 32)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        for cell in (1 << 25, 4000):
            found = segment_search.top_k(spark.createDataFrame(rows, SHAPE), F.col("vec_id") % 5 == 0, cell_bytes=cell)
            assert sorted(map(tuple, found.collect()), key=repr) == best(rows, lambda i: i % 5 == 0, 5)
    finally:
        spark.conf.set(name, before)


def test_top_k_of_few_vectors_other_lengths_and_large_numbers(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, -2.0]), (2, [1.0, 2.0, 3.0]), (50, []), (51, []), (100, [1e7, 1.0]), (7, [1e7, 1 / 256]), (8, [1e7, 2 / 256])]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = segment_search.top_k(given, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.collect()), key=repr) == best([(*r, None) for r in rows], lambda i: i % 50 == 0, 5)


def test_bounds_are_never_under_the_score_and_leave_candidates_out():
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 90, (12, 64))
    rows = np.floor(centres[draw.integers(0, 12, 5000)] + draw.normal(0, 8, (5000, 64)))
    for segments in segment_search.SEGMENTS:
        stats = segment_search.statistics(rows[:300], segments)
        assert (stats @ stats.T >= rows[:300] @ rows[:300].T - 1e-6).all()
    levels = list(segment_search.SEGMENTS)
    block = segment_search.Candidates(np.arange(5000), np.zeros(5000, bool), rows, levels)
    scored = []
    plain = block.scores
    block.scores = lambda at, query, norm: scored.append(len(at)) or plain(at, query, norm)
    found = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * 100
    segment_search.top_of_block(block, rows[:100], np.arange(100), levels, 5, found)
    assert sum(scored) < 100 * 5000 / 4
