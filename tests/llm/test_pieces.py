import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from rentlens.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    with open(MODEL, "rb") as file:
        return pieces.Vocabulary(file.read())


def odd_texts():
    draw = random.Random(3)
    letters = "aábc  \n\t▁.ÿ漢字<s>\x00😀́ﬁ½-1230xyzTheing"
    made = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 200))) for _ in range(400)]
    return [*made, "", " ", "▁", "a" * 2000, "  a  ", " \n ", "漢字" * 300, "x " * 200 + "   ", "the" * 5000, "word " * 200_000]


def test_own_agenda_equals_the_library(vocabulary, library):
    vocabulary._as_library = lambda words, made: made
    for text in odd_texts():
        assert vocabulary.encode(text) == library.encode(text)


def test_heap_and_rounds_agree(vocabulary):
    words = ["▁" + w for t in odd_texts()[:100] for w in t.split() if len(w) < pieces.LONG - 1 and "▁" not in w]
    assert vocabulary._together(words) == [vocabulary._agenda(w) for w in words]


def test_cache_may_be_smaller_than_a_text(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 3)
    text = "one two three four five six seven eight nine ten"
    assert vocabulary.encode(text) == library.encode(text)


def test_digests_and_round_trip(spark, library):
    texts = [None, *odd_texts()]
    documents = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(0, None, 7)], "doc_id long, text string, n_tokens int")
    rows = pieces.digests(documents, MODEL).collect()
    assert len(rows) == len(texts) + 1
    for row in rows:
        ids = library.encode(row.text or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    back = pieces.decode(pieces.encode(documents.where("doc_id < 300"), MODEL), MODEL).collect()
    assert all(r.decoded == library.decode(library.encode(r.text or "")) for r in back)
    assert pieces.digests(documents.limit(0), MODEL).count() == 0


def test_words_that_differ_take_the_library_s_ids(vocabulary, library, caplog):
    words = [f"▁word{i}" for i in range(200)]
    right = vocabulary.encode_words(words)
    assert right == [tuple(library.encode(w[1:])) for w in words]
    words += [",", "word", "\n(", "▁▁▁"]
    right = vocabulary.encode_words(words)
    wrong = [(0,) if i % 70 == 0 or i in (200, 201, 202) else ids for i, ids in enumerate(right)]
    assert pieces.Vocabulary._as_library(vocabulary, words, wrong) == right
    assert "6 words of 204" in caplog.text


def test_parts_are_cut_where_no_piece_crosses(vocabulary):
    assert vocabulary.words("One, two.\nThree") == ["▁One", ",", "▁two", ".\n", "Three"]
    assert pieces._pattern(["▁a", "n't", "x²", "².", "b"]).findall("▁don't▁x².y,▁▁z▁") == ["▁don't", "▁x².", "y", ",", "▁▁z", "▁"]
    assert pieces._pattern(["a.", "▁b"]).findall("▁a,b▁c") == ["▁a,b", "▁c"]


def test_words_met_again_stay_in_the_cache(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 40)
    fresh = pieces.Vocabulary(vocabulary.library.serialized_model_proto())
    made = []
    monkeypatch.setattr(fresh, "_as_library", lambda words, ids: made.extend(words) or ids)
    for k in range(20):
        fresh.learn(["▁often", *(f"▁word{k}x{i}" for i in range(9))])
    assert made.count("▁often") == 1 and len(fresh.cache) + len(fresh.older) <= 40
