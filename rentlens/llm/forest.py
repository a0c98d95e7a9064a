"""N-gram Jaccard join with a MinHash LSH forest.

Each document's set of five-word shingles gets ``trees * depth`` MinHash values; every run of ``depth``
values is its label in one prefix trie. Documents below one trie node are candidates. The join starts at
the full depth and shortens the matched prefixes as long as the recall of the links found, estimated from
their similarities and the depth, is under the target. Candidates are verified on the exact shingle sets.

Documents with the same shingle set are one class, so copies cost one row however many there are. Below a
node, each member is compared with leaders and not with all others: a round takes a leader in each node and
tree, different ones in different trees; what it links becomes one group, and only nodes that still hold
several groups go on. Nodes with few members left are compared pair by pair; rounds go on at larger nodes
until one adds next to nothing. What is then still mixed is dealt into blocks, and blocks are compared with
blocks until every pair of different groups below a node is verified. Work is linear in rows where leaders
join a node's members, and grows with the square of what they leave.

Words are runs of letters, digits and ``_`` in lower case; a text of one to four words has one shingle. A
text without words (also null) has no shingle and is linked with nothing: it is a class and a group of its
own. Repeated rows are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm import bloom, words
from rentlens.llm.quality import _pieces
from rentlens.session import stage

SHINGLE = 5
TREES, DEPTH = 24, 8
FEW = 24
LEADERS = 12
BLOCK_CLASSES = 256
BLOCK_SHINGLES = 1 << 20
LOOKUP_ROWS = 200_000
SMALL_GRAPH = 500_000
_BLOCK = 2048


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = words.mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return (drawn[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (drawn[count:] >> np.uint64(32)).astype(np.uint32)


def _shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text."""
    for part in _pieces(texts):
        data, offsets = words.utf8(part)
        hashes, owners, _ = words.word_hashes(data, offsets)
        bounds = words.by_text(owners, len(part))
        for i in range(len(part)):
            yield np.unique(words.shingle_hashes(hashes[bounds[i] : bounds[i + 1]], SHINGLE))


def signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Low 16 bits of the smallest value under each permutation."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _BLOCK):
        values = factors[:, None] * low[None, at : at + _BLOCK]
        values += shifts[:, None]
        np.minimum(best, values.min(axis=1), out=best)
    return best.astype(np.uint16)


def _identity():
    """Digest by which a text is found again; equal for equal texts."""
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def signatures(documents: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """``doc_id``, ``text_key``, ``class_key`` (of the shingle set; null if empty), ``n`` and ``signature``."""
    factors, shifts = _permutations(trees * depth)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, signs = [], [], []
            for s in _shingle_sets(batch.column(2)):
                other = words.mix(s ^ np.uint64(0x5851F42D4C957F2D))
                keys.append((np.bitwise_xor.reduce(other), s.sum(dtype=np.uint64)) if len(s) else None)
                sizes.append(len(s))
                signs.append(signature(s, factors, shifts).astype(">u2").tobytes() if len(s) else None)
            keys = [None if k is None else np.array(k, np.uint64).astype(">u8").tobytes() for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())], ["doc_id", "text_key", "class_key", "n", "signature"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return words.bounded_batches(documents).select("doc_id", _identity().alias("text_key"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(
        words.giving_back(rows), f"doc_id {kind}, text_key string, class_key binary, n long, signature binary")


def _nodes(classes: DataFrame, trees: int, depth: int, used: int) -> DataFrame:
    """One row for each class and tree: ``node`` (digest of tree and prefix of ``used`` values), ``class_key``."""
    label = lambda t: F.xxhash64(F.lit(t), F.substring("signature", t * depth * 2 + 1, used * 2))
    return classes.select(F.explode(F.array(*[label(t) for t in range(trees)])).alias("node"), "class_key")


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with ``group``, the class's group, by default itself, and ``size``, the classes in it."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("_size")).select(F.col("group").alias("_of"), "_size")
    held = groups.join(sizes, F.col("group") == F.col("_of")).select(F.col("class_key").alias("_class"), F.col("group").alias("_group"), "_size")
    held = F.broadcast(held) if groups.count() <= LOOKUP_ROWS else held
    joined = rows.join(held, F.col("class_key") == F.col("_class"), "left")
    return joined.withColumn("group", F.coalesce("_group", "class_key")).withColumn("size", F.coalesce("_size", F.lit(1))).drop("_class", "_group", "_size")


def _only(rows: DataFrame, column: str, digests: DataFrame, count: int) -> DataFrame:
    """Rows whose 64-bit ``column`` may be among ``digest``: a bounded filter that spares most others a shuffle."""
    bits = bloom.page_bits(count)
    return bloom.ask(rows, column, bloom.build(digests, "digest", bits), bits, "_maybe").where("_maybe").drop("_maybe")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows below nodes that hold several groups, with the number of ``members`` and ``top``, a digest of the largest group."""
    group = F.xxhash64("group")
    state = rows.groupBy("node").agg(F.count("*").alias("members"), F.min(group).alias("low"), F.max(group).alias("high"), F.max(F.struct(F.col("size"), group.alias("of"))).alias("top"))
    state = stage(state.where("low <> high").select(F.col("node").alias("_node"), "members", F.col("top.of").alias("top")), "forest-state")
    count = state.count()
    few = count <= LOOKUP_ROWS
    rows = rows.drop("members", "top", "size")
    rows = rows if few else _only(rows, "node", state.select(F.col("_node").alias("digest")), count)
    return rows.join(F.broadcast(state) if few else state, F.col("node") == F.col("_node")).drop("_node")


def _candidates(mixed: DataFrame, few: int, leaders: int, seed: int) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of different groups: all below small nodes, once, with leaders below others.

    Members draw one of as many lots as leaders are wanted; the first of each lot leads. With several leaders,
    members of the node's largest group are not asked: the others meet it through its leaders.
    """
    small = mixed.where(F.col("members") <= (few if leaders == 1 else 0))
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.node") == F.col("y.node")) & (F.col("x.class_key") < F.col("y.class_key")) & (F.col("x.group") != F.col("y.group")))
    pairs = pairs.select(F.col("x.class_key").alias("a"), F.col("y.class_key").alias("b"))
    large = mixed.where(F.col("members") > few)
    drawn = F.xxhash64(F.lit(seed), "node", "class_key")
    lot = F.pmod(drawn, F.lit(leaders)).alias("lot")
    first = large.groupBy("node", lot).agg(F.min(F.struct(drawn.alias("drawn"), "class_key", "group")).alias("first"))
    first = first.select(F.col("node").alias("_node"), F.col("first.class_key").alias("leader"), F.col("first.group").alias("leader_group"))
    asked = large if leaders == 1 else large.where(F.xxhash64("group") != F.col("top"))
    led = asked.join(first, (F.col("node") == F.col("_node")) & (F.col("group") != F.col("leader_group")))
    return pairs.unionByName(led.select(F.least("class_key", "leader").alias("a"), F.greatest("class_key", "leader").alias("b"))).distinct()


def _possible(rows: DataFrame, keys: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``text_key`` may be among the keys, and those where it is not: only the first need to shuffle."""
    pages = bloom.build(keys.select(F.xxhash64(keys.columns[0]).alias("digest")), "digest", bits)
    asked = bloom.ask(rows.withColumn("_digest", F.xxhash64("text_key")), "_digest", pages, bits, "_maybe").drop("_digest")
    return asked.where("_maybe").drop("_maybe"), asked.where("not _maybe").drop("_maybe")


def _shingles_of(documents: DataFrame, members: DataFrame, bits: int) -> DataFrame:
    """``class_key``, ``shingles`` of the texts named in ``members`` (``class_key``, ``doc_id``, ``text_key``)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in _shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["class_key", "shingles"])

    wanted = members.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "class_key")
    keyed = _possible(documents.select("doc_id", _identity().alias("text_key"), F.lower("text").alias("text")), wanted.select("_key"), bits)[0]
    found = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    return found.select("class_key", "text").dropDuplicates(["class_key"]).mapInArrow(words.giving_back(rows), "class_key binary, shingles array<long>")


def _verified(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """``a``, ``b``, ``similarity`` of the pairs that reach the threshold on exact shingle sets."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class_key")).distinct().select(F.xxhash64("class_key").alias("digest"))
    asked = stage(asked, "forest-asked")
    shingles = _only(shingles.withColumn("digest", F.xxhash64("class_key")), "digest", asked, asked.count())
    left = shingles.select(F.col("class_key").alias("a"), F.col("shingles").alias("sa"))
    right = shingles.select(F.col("class_key").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity"))
    return found.where(F.col("similarity") >= threshold)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common shingles of each set on the left with each on the right."""
    sides, width, height = [], len(right), len(left)
    for sets in (left, right):
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        sides.append((values[order], owners[order]))
    (a, of_a), (b, of_b) = sides
    both = np.intersect1d(a, b)
    at_a, at_b = np.searchsorted(a, both), np.searchsorted(b, both)
    n_a, n_b = np.searchsorted(a, both, side="right") - at_a, np.searchsorted(b, both, side="right") - at_b
    out = np.zeros((height, width))
    often = n_a * n_b * 16 >= height * width
    run = lambda at, n: np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
    for kind in (True, False):
        chosen = np.flatnonzero(often == kind)
        for start in range(0, len(chosen), 1024):
            part = chosen[start : start + 1024]
            if kind:
                has_a, has_b = np.zeros((height, len(part)), np.float32), np.zeros((width, len(part)), np.float32)
                for has, of, at, n in ((has_a, of_a, at_a[part], n_a[part]), (has_b, of_b, at_b[part], n_b[part])):
                    has[of[run(at, n)], np.repeat(np.arange(len(part)), n)] = 1
                out += has_a @ has_b.T
            else:
                pairs = n_a[part] * n_b[part]
                which, place = np.repeat(part, pairs), run(np.zeros(len(part), np.int64), pairs)
                cell = of_a[at_a[which] + place // n_b[which]] * width + of_b[at_b[which] + place % n_b[which]]
                out += np.bincount(cell, minlength=height * width).reshape(height, width)
    return out


def _block_pairs(rows: DataFrame, of: str, low: str, high: str) -> DataFrame:
    """Rows with ``shingles`` of ``of`` in ``block``, once for each block from ``low`` to ``high`` that theirs meets, in order of ``key``."""
    met = rows.withColumn("other", F.explode(F.sequence(low, high)))
    key = F.xxhash64(of, F.least("block", "other"), F.greatest("block", "other")).alias("key")
    side = F.when(F.col("block") < F.col("other"), 0).when(F.col("block") > F.col("other"), 1).otherwise(2).alias("side")
    dealt = met.select(key, side, "class_key", F.xxhash64("group").alias("group"), "shingles")
    return words.bounded_batches(dealt).repartition("key").sortWithinPartitions("key")


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[list[bytes], np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """For each block pair: classes and groups of both sides, and similarities, 0 where a pair does not reach the threshold or is met twice."""

    def one(held: list[pa.RecordBatch]):
        block = pa.Table.from_batches(held)
        side, keys, group = block["side"].to_numpy(), block["class_key"].to_pylist(), block["group"].to_numpy()
        sets = [s for b in held for s in _lists(b.column(4))]
        x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if len(x) and len(y):
            left, right = [sets[i] for i in x], [sets[i] for i in y]
            both = _common(left, right)
            like = both / (np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - both)
            like[like < threshold] = 0
            yield [keys[i] for i in x], group[x], [keys[i] for i in y], group[y], np.triu(like, 1) if (side == 2).all() else like

    held, last = [], None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
        for at, end in zip(bounds, bounds[1:]):
            if held and keys[at] != last:
                yield from one(held)
                held = []
            held.append(batch.slice(at, end - at))
            last = keys[at]
    if held:
        yield from one(held)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(offsets, offsets[1:])]


def _blocks(count, shingles):
    """How many blocks hold so many classes and shingles."""
    return F.ceil(F.greatest(count / BLOCK_CLASSES, shingles / BLOCK_SHINGLES)).cast("int")


def _rest(mixed: DataFrame, classes: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Links ``a``, ``b``, ``similarity`` that join all groups which any pair below a node joins: all pairs of different groups are verified.

    Members are dealt into blocks by digest, those of the node's largest group into blocks of their own, which
    meet the others' blocks but not each other. Of a block pair's links those that join groups are given.
    """
    own = F.xxhash64("group") == F.col("top")
    sized = mixed.join(classes.select(F.col("class_key").alias("_class"), "n"), F.col("class_key") == F.col("_class")).drop("_class")
    share = lambda which: _blocks(F.sum(which.cast("long")), F.sum(F.when(which, F.col("n")).otherwise(0)))
    state = stage(sized.groupBy("node").agg(share(~own).alias("others"), share(own).alias("tops")).withColumnRenamed("node", "_node"), "forest-blocks")
    lot = F.xxhash64(F.lit(7), "class_key")
    block = F.when(own, F.col("others") + F.pmod(lot, F.col("tops"))).otherwise(F.pmod(lot, F.col("others"))).cast("int")
    last = F.when(own, F.col("others") - 1).otherwise(F.col("others") + F.col("tops") - 1)
    rows = mixed.join(state, F.col("node") == F.col("_node")).select("node", "class_key", "group", block.alias("block"), F.lit(0).alias("low"), last.alias("high"))

    def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, of_left, right, of_right, like in _compared(batches, threshold):
            like = np.where(of_left[:, None] == of_right[None, :], 0, like)
            i, j = np.nonzero(like)
            order = np.argsort(like[i, j], kind="stable")  # the least alike count most in the recall
            top: dict[int, int] = {}

            def root(g: int) -> int:
                while top.setdefault(g, g) != g:
                    top[g] = top[top[g]]
                    g = top[g]
                return g

            out = []
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                g, h = root(int(of_left[x])), root(int(of_right[y]))
                if g != h:
                    top[g] = h
                    out.append((min(left[x], right[y]), max(left[x], right[y]), float(like[x, y])))
            a, b, s = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    pairs = _block_pairs(rows.join(shingles.select("class_key", "shingles"), "class_key"), "node", "low", "high")
    return pairs.mapInArrow(words.giving_back(joining), "a binary, b binary, similarity double").distinct()


def _degrees(groups: DataFrame, classes: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """``class_key``, ``n_links``: with how many others of its group a class reaches the threshold.

    Every pair of a group is verified once, in the one block pair that holds it; only counts leave a block pair.
    """
    sized = groups.join(classes.select(F.col("class_key").alias("_class"), "n"), F.col("class_key") == F.col("_class")).drop("_class")
    state = sized.groupBy("group").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks")).withColumnRenamed("group", "_group")
    held = groups.join(state, F.col("group") == F.col("_group"))
    held = stage(held.select("class_key", "group", F.pmod(F.xxhash64(F.lit(7), "class_key"), "blocks").cast("int").alias("block"), F.lit(0).alias("low"), (F.col("blocks") - 1).alias("high")), "forest-held")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, _, right, _, like in _compared(batches, threshold):
            n = [*np.count_nonzero(like, axis=1).tolist(), *np.count_nonzero(like, axis=0).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(left + right, pa.binary()), pa.array(n, pa.int64())], ["class_key", "n"])

    pairs = _block_pairs(held.join(shingles.select("class_key", "shingles"), "class_key"), "group", "low", "high")
    found = pairs.mapInArrow(words.giving_back(counts), "class_key binary, n long")
    return found.groupBy("class_key").agg(F.sum("n").alias("n_links"))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest key of each key's component, for the edges of one task."""
    top: dict[bytes, bytes] = {}

    def root(key: bytes) -> bytes:
        while top.setdefault(key, key) != key:
            top[key] = top[top[key]]
            key = top[key]
        return key

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.binary()), pa.array([root(k) for k in top], pa.binary())], ["class_key", "group"])


def merged(links: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """``class_key``, ``group`` (smallest key) of all keys in links ``a``, ``b``.

    Up to ``small`` edges fit one task, which joins them directly. Larger graphs take alternating star steps:
    each key's larger neighbours hang on its smallest one, then its smaller neighbours do; every step is
    stored, and their number grows with the logarithm of the longest chain. Both give the same groups.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if links.count() <= small:
        return stage(edges.coalesce(1).mapInArrow(_roots, "class_key binary, group binary"), "forest-groups")
    edges = stage(edges.where("u <> v").distinct(), "forest-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        wide = both.join(stage(least, "forest-least"), F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(wide.where("u <> v").distinct(), "forest-edges")
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        narrow = large.join(stage(down, "forest-least"), F.col("u") == F.col("_u")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stage(narrow.where("u <> v").distinct(), "forest-edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    top = edges.select(F.col("v").alias("class_key")).distinct().select("class_key", F.col("class_key").alias("group"))
    return edges.select(F.col("u").alias("class_key"), F.col("v").alias("group")).unionByName(top)


def _recall(links: DataFrame, trees: int, used: int) -> float:
    """Share of links found, estimated: each link stands for as many as its similarity makes likely."""
    chance = 1 - F.pow(1 - F.pow("similarity", F.lit(used)), F.lit(trees))
    found, total = links.agg(F.count("*"), F.sum(1 / chance)).first()
    return found / total if found else 1.0


def join(documents: DataFrame, threshold: float = 0.8, target: float = 0.995, trees: int = TREES, depth: int = DEPTH, few: int = FEW) -> DataFrame:
    """``doc_id``, ``class_id``, ``rep_id``, ``n_copies`` and ``n_links`` of every row.

    ``rep_id``: smallest id among rows with the same shingle set, ``n_copies`` their number. ``class_id``:
    smallest ``rep_id`` of the group that verified links hold together. ``n_links``: verified links of the
    row's shingle set to other sets, counted over all pairs of its group. Rows without shingles carry their own id.
    """
    signed = stage(signatures(documents, trees, depth), "forest-signatures")
    member = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key", "n", "signature")).alias("first")
    classes = signed.where("class_key is not null").groupBy("class_key").agg(member, F.count("*").alias("n_copies"))
    classes = stage(classes.select("class_key", "first.doc_id", "first.text_key", "first.n", "first.signature", "n_copies"), "forest-classes")
    groups, shingles = _linked(documents, classes, threshold, target, trees, depth, few)
    degree = _degrees(groups, classes, shingles, threshold)
    rep = F.col("doc_id").alias("rep_id")
    described = _with_groups(classes.select("class_key", rep, "n_copies"), groups)
    described = stage(described.join(degree, "class_key", "left"), "forest-described")
    first = described.groupBy("group").agg(F.min("rep_id").alias("class_id"))
    described = described.join(first, "group").select(F.col("class_key").alias("_class"), "class_id", "rep_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    described = stage(described, "forest-classes-described")
    with_words = signed.where("class_key is not null").select("doc_id", "class_key").join(described, F.col("class_key") == F.col("_class")).drop("class_key", "_class")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = signed.where("class_key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), one.alias("n_copies"), none.alias("n_links"))
    return with_words.unionByName(alone)


def _linked(documents: DataFrame, classes: DataFrame, threshold: float, target: float, trees: int, depth: int, few: int) -> tuple[DataFrame, DataFrame]:
    """The groups that verified links between classes make, and ``class_key``, ``shingles`` of all their members.

    The first round takes one leader a node, later ones up to ``LEADERS``, as long as the pairs of a round stay
    linear in the classes. What a round adds tells what is still missing: rounds end when one adds less than a
    tenth of the share of links that the target allows to miss, or nothing. Nodes still mixed are then compared
    whole, in blocks.
    """
    spark = documents.sparkSession
    links = spark.createDataFrame([], "a binary, b binary, similarity double")
    groups = spark.createDataFrame([], "class_key binary, group binary")
    shingles = None
    total = classes.count()
    bits = bloom.page_bits(total)
    used, seed = depth, 0
    while True:
        rows, leaders = _nodes(classes, trees, depth, used), 1
        while True:
            mixed = stage(_mixed(_with_groups(rows.select("node", "class_key"), groups)), "forest-round")
            if leaders == 1:
                members = mixed.select("class_key").distinct()
                missing = members if shingles is None else members.join(shingles.select("class_key"), "class_key", "left_anti")
                new = stage(_shingles_of(documents, classes.join(missing, "class_key"), bits), "forest-shingles")
                shingles = new if shingles is None else shingles.unionByName(new)
            pairs = stage(_candidates(mixed, few, leaders, seed), "forest-pairs")
            found = stage(_verified(pairs, shingles, threshold), "forest-links")
            seed += 1
            linked = found.count()
            if linked:
                links = links.unionByName(found)
                groups = merged(links)
            rows = mixed.where(F.col("members") > few)  # all pairs below the others are verified
            left = rows.count()
            affordable = max(1, total * trees // max(1, left))
            enough = linked <= (1 - target) / 10 * links.count()
            if not left:
                break
            if enough and (leaders > 1 or affordable == 1):
                mixed = stage(_mixed(_with_groups(rows.select("node", "class_key"), groups)), "forest-rest")
                found = stage(_rest(mixed, classes, shingles, threshold), "forest-links")
                if found.count():
                    links = links.unionByName(found)
                    groups = merged(links)
                break
            leaders = min(LEADERS, affordable)
        if used <= 2 or _recall(links, trees, used) >= target:
            return groups, shingles
        used -= 1


def one_of_each_group(documents: DataFrame, **settings) -> DataFrame:
    """The documents without near-copies: of each group the row with the smallest id stays, all its columns unchanged.

    Rows without words stay. Of repeated rows with one id and text one stays; rows of one id with different
    texts in one group are taken by text digest.
    """
    names = documents.columns
    signed = stage(signatures(documents, settings.get("trees", TREES), settings.get("depth", DEPTH)), "forest-signatures")
    member = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key", "n", "signature")).alias("first")
    classes = signed.where("class_key is not null").groupBy("class_key").agg(member)
    classes = stage(classes.select("class_key", "first.doc_id", "first.text_key", "first.n", "first.signature"), "forest-classes")
    use = {"threshold": 0.8, "target": 0.995, "trees": TREES, "depth": DEPTH, "few": FEW} | settings
    groups, _ = _linked(documents, classes, **use)
    grouped = _with_groups(classes.select("class_key", "doc_id", "text_key"), groups)
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")).alias("first")
    firsts = stage(grouped.groupBy("group").agg(stays).select(F.col("group").alias("_group"), F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key")), "forest-firsts")
    by_class = stage(grouped.join(firsts, F.col("group") == F.col("_group")).select(F.col("class_key").alias("_class"), "_id", "_key"), "forest-kept")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    decided = signed.where("class_key is not null").join(by_class, F.col("class_key") == F.col("_class")).select("doc_id", "text_key", same.alias("kept"))
    # only rows that go or are repeated need a look-up; all others pass straight through
    touched = decided.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("n > 1 or not kept")
    touched = stage(touched.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "kept"), "forest-touched")
    whole = documents.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("whole"), "doc_id", _identity().alias("text_key"))
    possible, through = _possible(whole, touched.select("_key"), bloom.page_bits(touched.count()))
    looked = possible.join(touched, same, "left")
    once = looked.where("kept").dropDuplicates(["doc_id", "text_key"])
    out = through.select("whole").unionByName(looked.where("kept is null").select("whole")).unionByName(once.select("whole"))
    return out.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(names)])
