import random
import re

import pytest

from rentlens.llm import decontaminate, forest

SHAPE = "doc_id long, text string, n long, similarity string, a string"


def shingles(text):
    found = re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def corpus():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    passage = text(40)
    rows = [" ".join(text(draw.randint(5, 120))) for _ in range(120)]
    rows += [" ".join(text(60) + passage + text(20)) for _ in range(60)]

    def changed(base, share):
        return [word() if draw.random() < share else w for w in base]

    for _ in range(25):
        base = text(150)
        rows += [" ".join(base)] + [" ".join(changed(base, draw.choice([0.003, 0.01, 0.03]))) for _ in range(3)]
    hot = text(150)
    rows += [" ".join(changed(hot, draw.choice([0.005, 0.015]))) for _ in range(150)]
    rows += [rows[0]] * 200 + ["One two", "one two!", "one two three", "", "...", None, None, "a " * 50_000]
    out = [(i, t, 1, "s", "a") for i, t in enumerate(rows)]
    return out + [(3, rows[3], 1, "s", "a"), (None, "nameless row of five words", 1, "s", "a")]


@pytest.fixture(scope="module")
def truth():
    rows = corpus()
    sets = sorted({shingles(t) for _, t, *_ in rows} - {frozenset()}, key=sorted)
    links = {(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8}
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        top[max(a, b)] = min(a, b)
    return rows, {s: root(i) for i, s in enumerate(sets)}, links


def test_groups_equal_brute_force(spark, truth):
    rows, root, links = truth
    documents = spark.createDataFrame(rows, SHAPE).repartition(6)
    out = forest.join(documents).collect()
    assert len(out) == len(rows)
    text = {i: t for i, t, *_ in rows}
    by_class = {}
    for r in out:
        s = shingles(text[r.doc_id])
        if s:
            by_class.setdefault(r.class_id, set()).add(root[s])
        else:
            assert r.class_id == r.doc_id and r.n_links == 0
    assert all(len(v) == 1 for v in by_class.values())
    assert len(by_class) == len({v for c in by_class.values() for v in c})  # no group is in two
    degree = {}
    names = {i: s for s, i in zip(sorted(root, key=sorted), range(len(root)))}
    for i, j in links:
        degree[names[i]] = degree.get(names[i], 0) + 1
        degree[names[j]] = degree.get(names[j], 0) + 1
    assert all(r.n_links <= degree.get(shingles(text[r.doc_id]), 0) for r in out)
    assert all(r.n_links > 0 for r in out if degree.get(shingles(text[r.doc_id]), 0))


def test_one_document_of_each_group_stays(spark, truth):
    rows, root, _ = truth
    documents = spark.createDataFrame(rows, SHAPE).repartition(6)
    kept = forest.one_of_each_group(documents)
    assert kept.columns == documents.columns
    kept = kept.collect()
    first = {}
    for i, t, *_ in rows:
        if shingles(t):
            r = root[shingles(t)]
            first[r] = min(first.get(r, 10**9), 10**8 if i is None else i)
    want = sorted([10**8 if i == 10**8 else i for i in first.values()] + [i for i, t, *_ in rows if not shingles(t)])
    assert sorted(10**8 if r.doc_id is None else r.doc_id for r in kept) == want


def test_links_equal_brute_force(spark, truth):
    rows, root, links = truth
    degree = dict.fromkeys(root, 0)
    names = sorted(root, key=sorted)
    for pair in links:
        for i in pair:
            degree[names[i]] += 1
    assert max(degree.values()) > forest.FEW
    text = {i: t for i, t, *_ in rows}
    documents = spark.createDataFrame(rows, SHAPE).repartition(6)
    out = forest.join(documents).collect()
    assert [(r.doc_id, r.n_links) for r in out if r.n_links != degree.get(shingles(text[r.doc_id]), 0)] == []


def test_links_of_large_groups_are_counted_by_blocks(spark, truth, monkeypatch):
    rows, *_ = truth
    documents = spark.createDataFrame(rows, SHAPE).repartition(6)
    whole = sorted(map(str, forest.join(documents).collect()))
    monkeypatch.setattr(forest, "BLOCK_CLASSES", 20)
    assert sorted(map(str, forest.join(documents).collect())) == whole


def test_near_copies_below_a_template(spark):
    # thousands of documents share a passage, each at 0.6 to 0.78 with the others; a few have one near-copy at 0.84
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(200)]
    rows = [passage + [word() for _ in range(30)] for _ in range(1500)]
    rows += [r[:-20] + [word() for _ in range(20)] for r in rows[::25]]
    rows = [(i, " ".join(r), 1, "s", "a") for i, r in enumerate(rows)]
    sets = [shingles(r[1]) for r in rows]
    assert 0.6 < jaccard(sets[0], sets[1]) < 0.78
    out = {r.doc_id: r.class_id for r in forest.join(spark.createDataFrame(rows, SHAPE).repartition(6)).collect()}
    want = {i: i for i in range(1500)} | {1500 + k: 25 * k for k in range(60)}
    assert out == want


def test_common_shingles_of_all_pairs():
    draw = random.Random(3)
    import numpy as np
    kinds = [(0, 40), (0, 4000), (0, 10**6)]
    sets = [np.unique(np.array([draw.randint(*kinds[k % 3]) for _ in range(draw.randint(1, 300))], np.int64)) for k in range(70)]
    found = forest._common(sets[:30], sets[20:])
    assert all(found[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(sets[:30]) for j, y in enumerate(sets[20:]))


def test_no_rows(spark):
    none = spark.createDataFrame([], SHAPE)
    assert forest.join(none).count() == 0 and forest.one_of_each_group(none).count() == 0


def test_shorter_prefixes_until_the_target(spark, truth):
    rows, root, _ = truth
    documents = spark.createDataFrame(rows, SHAPE).repartition(6)
    few = forest.join(documents, trees=6, depth=10, target=0.999)
    some = forest.join(documents, trees=6, depth=10, target=0.0)
    assert few.select("class_id").distinct().count() < some.select("class_id").distinct().count()


def test_signature_estimates_similarity():
    factors, shifts = forest._permutations(2000)
    draw = random.Random(1)
    import numpy as np
    a = np.array([draw.getrandbits(64) for _ in range(400)], np.uint64)
    b = np.concatenate([a[:300], np.array([draw.getrandbits(64) for _ in range(100)], np.uint64)])
    alike = (forest.signature(a, factors, shifts) == forest.signature(b, factors, shifts)).mean()
    assert abs(alike - 0.6) < 0.05


def bench_rows():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("stuvwxyz") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (3, 5, 12, 30, 30, 59)]
    docs = []
    for k, item in enumerate(items):
        around = lambda n: [word() for _ in range(n)]
        docs.append(around(20) + item + around(30))
        docs.append(item)
        docs.append(around(3) + [w.upper() for w in item])
        if len(item) > 20:
            docs += [around(9) + item[:-2] + around(9), around(9) + item[: len(item) // 2] + around(9), item[3:], around(4) + item[:10] + ["x"] + item[11:] + around(5)]
        docs.append(around(20) + item + around(10) + item)
    docs += [around(80) for _ in range(30)]
    return [" ".join(i) for i in items], [" ".join(d) for d in docs]


def test_windows_equal_brute_force(spark):
    items, docs = bench_rows()
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(90, None, "x"), (91, "", "x"), (92, items[3], "x")], "item_id long, text string, doc_id string")
    rows = [(i, t, 1, "s", "a") for i, t in enumerate(docs)] + [(900, None, 1, "s", "a"), (901, "", 1, "s", "a"), (902, "word " * 200_000, 1, "s", "a"), (0, docs[0], 1, "s", "a")]
    documents = spark.createDataFrame(rows, SHAPE).repartition(4)
    want = set()
    for d, text, *_ in rows[: len(docs)]:
        own = text.lower().split()
        for k, item in [*enumerate(items), (92, items[3])]:
            t = item.lower().split()
            size, width = min(len(t), len(own)), min(5, len(t))
            grams = lambda w: [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]  # noqa: B023, E731
            for start in range(len(own) - size + 1):
                a, b = grams(own[start : start + size]), grams(t)
                both = sum(min(a.count(g), b.count(g)) for g in set(a))
                if both and both / (len(a) + len(b) - both) >= 0.8:
                    want.add((d, k))
    found = decontaminate.matches(documents, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert len([r for r in found if (r.doc_id, r.item_id) == (0, 0)]) == 2
    chunks = decontaminate.matches(documents, benchmark, chunk_bytes=100).collect()
    assert sorted(map(tuple, chunks)) == sorted(map(tuple, found))
    clean = decontaminate.clean(documents, benchmark)
    assert clean.columns == documents.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, *_ in rows if i not in {d for d, _ in want})
    assert decontaminate.matches(documents.limit(0), benchmark).count() == 0
    assert decontaminate.matches(documents, benchmark.limit(0)).count() == 0
    assert decontaminate.clean(documents, benchmark.limit(0)).count() == len(rows)


def test_index_finds_every_fingerprint_within_the_radius():
    draw = random.Random(8)
    index = decontaminate.Index(list(range(50)), [" ".join(str(draw.random()) for _ in range(5)) for _ in range(50)], 0.8, 20)
    size = next(iter(index.sizes))
    for item in index.sizes[size]:
        for flips in (0, 5, 19, 20):
            asked = int(index.prints[item])
            for bit in draw.sample(range(64), flips):
                asked ^= 1 << bit
            assert item in index.near(size, asked)


def test_both_ways_to_groups_are_equal(spark):
    draw = random.Random(2)
    key = lambda i: i.to_bytes(4, "big")
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)]
    links = spark.createDataFrame([(key(min(p)), key(max(p)), 1.0) for p in pairs if p[0] != p[1]], "a binary, b binary, similarity double").repartition(5)
    one, many = (sorted((bytes(r.class_key), bytes(r.group)) for r in forest.merged(links, small).collect()) for small in (10**6, 0))
    assert one == many and len({g for _, g in one}) > 10
