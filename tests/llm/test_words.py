import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rentlens.llm import decontaminate, forest, quality, words

ALONE = "[　-鿿฀-໿က-Ⴟក-៿]"
WORD = re.compile(f"{ALONE}|(?:(?!{ALONE})[A-Za-z0-9_\u0080-\U0010ffff])+")
TEXTS = ["", None, "a b", "漢字かな and กขค x", "x" * 70_000, "é" * 100_000, "漢" * 400_000, "ab漢cd " * 3, ("w" * 3000 + " ") * 500, "x" * (3 << 20),
         "a " * 20 + "y" * (1 << 20) + " z " + "q" * 66_000, "“quoted” text’s"]


def plain(text):
    found = [m.encode() for m in WORD.findall(text or "")]
    return [w[i : i + words.LONGEST] for w in found for i in range(0, len(w), words.LONGEST)]


def hashed(batch):
    data, offsets = words.utf8(pa.array(batch, pa.string()))
    hashes, owners, _ = words.word_hashes(data, offsets, (3,))
    bounds = words.by_text(owners, len(batch))
    return [hashes[bounds[i] : bounds[i + 1]].tolist() for i in range(len(batch))]


def test_words_equal_a_plain_pattern_and_hash_alike():
    known = {}
    for text in TEXTS:
        found = hashed([text])[0]
        assert len(found) == len(plain(text))
        assert all(known.setdefault(w, h) == h for w, h in zip(plain(text), found))
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("seed", range(4))
def test_words_do_not_depend_on_neighbours(seed):
    draw = random.Random(seed)
    order = draw.sample(range(len(TEXTS)), len(TEXTS))
    batch = [t for i in order for t in ("k" * draw.randint(0, 900_000) + " m", TEXTS[i])]
    assert hashed(batch)[1::2] == [hashed([TEXTS[i]])[0] for i in order]


def test_equal_long_texts_are_one_class_wherever_they_stand(spark):
    long = ["汉" * 30_000 + "字" * 30_000, "x" * 100_000 + " y " + "z" * 100_000]
    rows = [(0, long[0]), (1, long[1])]
    for i in range(2, 40, 2):
        rows += [(i, "n" * (i * 20_011) + " end"), (i + 1, long[i // 2 % 2])]
    documents = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.class_id for r in forest.join(documents).collect()}
    for k in (0, 1):
        mine = {found[i] for i, t in rows if t == long[k]}
        assert len(mine) == 1
    assert found[0] != found[1]


def test_score_of_a_long_word_is_the_same_alone_and_in_a_batch():
    text = "good " * 50 + "汉" * 100_000 + "w" * 200_000
    alone = quality.text_features(pa.array([text], pa.string()))
    among = quality.text_features(pa.array(["k" * 950_000, text, "n" * 70_000, text], pa.string()))
    assert np.array_equal(alone[0], among[1]) and np.array_equal(alone[0], among[3])


def test_benchmark_item_in_unspaced_text_is_found_anywhere(spark):
    draw = random.Random(9)
    han = [chr(c) for c in range(0x4E00, 0x4F00)]
    item = "".join(draw.choices(han, k=60))
    rows = [(i, "k" * (i * 70_001) + " " + "".join(draw.choices(han, k=50_000)) + (item if i % 2 else "") + "".join(draw.choices(han, k=50_000))) for i in range(6)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), benchmark).collect()
    assert {r.doc_id for r in found} == {1, 3, 5}
