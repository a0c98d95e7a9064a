"""SentencePiece encoding and decoding for merge-type vocabularies with byte fallback.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they make, then from
the left, and merges the first until none is left. No piece has a space mark after another character, and
where none holds a word character beside a mark either, no merge crosses such a place. Text is cut there
and each distinct word is worked on once: short words of a batch side by side in numpy, one merge a word
and round; long ones with a heap and linked neighbours. Every new word is
compared with what the sentencepiece library makes of it, and the library's ids are taken if they differ.

Null counts as empty; an empty text has no ids. Texts may be of any length and are never cut. Memory of a
task is bounded by its longest text and by ``CACHE`` words.
"""

from __future__ import annotations

import hashlib
import heapq
import logging
import re
from collections.abc import Collection, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.llm.words import bounded_batches, give_back

SPACE = "▁"
CACHE = 120_000
LONG = 64
_PART = 1 << 20
_SIDE_BY_SIDE = 4096  # words whose arrays stay in a core's own cache
_COMPARED = 64  # words of one call of the library, whose agenda is then short
_NEVER = np.iinfo(np.int32).max
_SLOT_BITS = 20
_log = logging.getLogger(__name__)


class Vocabulary:
    """Symbols, merges and their order, read from a model through the library."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, size = self.library, self.library.get_piece_size()
        plain = [i for i in range(size) if not (lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(lib.is_byte, self.byte_ids)):
            raise ValueError("the vocabulary has no byte fallback")
        pieces = {lib.id_to_piece(i): i for i in plain}
        self.names = ["", *pieces, *sorted({c for p in pieces for c in p} - pieces.keys())]
        self.symbols = {name: k for k, name in enumerate(self.names)}
        self.ids = [pieces.get(name, -1) for name in self.names]
        self.id_of = np.array(self.ids)
        self.digits = [str(i) for i in range(size)]
        self.char_symbol = np.zeros(0x110000, np.int32)  # 0: in no piece
        for name, k in self.symbols.items():
            if len(name) == 1:
                self.char_symbol[ord(name)] = k
        ranks = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        merges = {}
        for name, i in pieces.items():
            for cut in range(1, len(name)):
                left, right = self.symbols.get(name[:cut]), self.symbols.get(name[cut:])
                if left and right:
                    merges[left * len(self.names) + right] = (ranks[lib.get_score(i)], self.symbols[name])
        self.merges = merges
        self.keys = np.array(sorted(merges), np.int64)
        self.ranks = np.array([merges[k][0] for k in self.keys.tolist()], np.int32)
        self.made = np.array([merges[k][1] for k in self.keys.tolist()], np.int32)
        # place of each key by its hash; keys that share one are searched for
        slots = self._slots(self.keys)
        self.table = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.table[slots] = np.arange(len(slots))
        crowded, number = np.unique(slots, return_counts=True)
        self.table[crowded[number > 1]] = -2
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.parts = _pattern(pieces)
        probe = "Ａﬁ  é\t\n½"
        self.as_is = lib.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place in ``keys`` of the merge of each pair of symbols, -1 where there is none."""
        key = left * len(self.names) + right
        at = self.table[self._slots(key)]
        crowded = np.flatnonzero(at == -2)
        if len(crowded):
            at[crowded] = np.minimum(np.searchsorted(self.keys, key[crowded]), len(self.keys) - 1)
        at[self.keys[at] != key] = -1
        return at

    def words(self, text: str) -> list[str]:
        """Parts of the normalised text that no piece crosses."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE) if self.as_is else self.library.normalize(text)
        return self.parts.findall(text) if self.by_word else [text]

    def _spelt(self, symbols: list[int], word: str) -> tuple[int, ...]:
        out, at = [], 0
        for k in symbols:
            size = len(self.names[k]) or 1
            if self.ids[k] >= 0:
                out.append(self.ids[k])
            else:
                out += [self.byte_ids[b] for b in word[at : at + size].encode()]
            at += size
        return tuple(out)

    def _agenda(self, word: str) -> tuple[int, ...]:
        """One word with a heap of (order, place, left symbol, right symbol) and linked neighbours."""
        symbols = self.char_symbol[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
        n, width = len(symbols), len(self.names)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.merges.get(symbols[i] * width + symbols[j])):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i] if symbols[i] == left else -1
            if j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return self._spelt([k for k in symbols if k >= 0], word)

    def _together(self, words: list[str]) -> list[tuple[int, ...]]:
        """Short words side by side: each round merges the first pair of the agenda of each word.

        Only the pairs on either side of a merge are looked up again.
        """
        symbols = self.char_symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].astype(np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ranks = np.append(self.ranks, np.int32(_NEVER))  # the last one stands for no merge
        pair = np.full(len(symbols), -1, np.int32)
        pair[:-1] = np.where(owner[:-1] == owner[1:], self._found(symbols[:-1], symbols[1:]), -1)
        done_symbols, done_owner = [], []
        while len(symbols):
            order = ranks[pair]
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(order, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            live = np.repeat(best < _NEVER, sizes)
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
            first = np.flatnonzero(live & (order == np.repeat(best, sizes)))
            first = first[np.append(True, owner[first[1:]] != owner[first[:-1]])[: len(first)]]
            symbols[first] = self.made[pair[first]]
            live[first + 1] = False
            place = np.cumsum(live) - 1
            symbols, owner, pair = symbols[live], owner[live], pair[live]
            left = place[first]
            left = np.concatenate([left, left[left > 0] - 1])
            pair[left] = -1
            left = left[left + 1 < len(symbols)]
            left = left[owner[left] == owner[left + 1]]
            pair[left] = self._found(symbols[left], symbols[left + 1])
        if not words:
            return []
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        symbols, bounds = symbols[order], np.searchsorted(owner[order], np.arange(len(words) + 1))
        plain = np.minimum.reduceat(self.id_of[symbols], bounds[:-1]) >= 0
        symbols, bounds, out = symbols.tolist(), bounds.tolist(), []
        for w, start, end, known in zip(words, bounds, bounds[1:], plain.tolist()):
            out.append(tuple(map(self.ids.__getitem__, symbols[start:end])) if known else self._spelt(symbols[start:end], w))
        return out

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of normalised words, without a look at the library."""
        short = [w for w in words if len(w) <= LONG]
        made = chain.from_iterable(self._together(short[k : k + _SIDE_BY_SIDE]) for k in range(0, len(short), _SIDE_BY_SIDE))
        return [next(made) if len(w) <= LONG else self._agenda(w) for w in words]

    def _as_library(self, words: list[str], made: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        """``made``, with the library's ids where they differ; the number of such words is logged."""
        if not self.as_is or not self.by_word:
            return made
        # joined again, each behind a space mark or a short word, they stay apart: one text holds many of them
        apart = [k for k, w in enumerate(words) if w[-1] != SPACE]
        runs = [apart[k : k + _COMPARED] for k in range(0, len(apart), _COMPARED)]
        heads = {"": (), **dict(zip(_HEADS, self.encode_words(list(_HEADS))))}
        head = ["" if w[0] == SPACE else _HEADS[not _WORD.match(w)] for w in words]
        texts = ["".join([head[k] + words[k] for k in run])[1:].replace(SPACE, " ") for run in runs]
        out, differing = list(made), 0
        for run, ids in zip(runs, self.library.encode(texts, num_threads=1)):
            if ids != list(chain.from_iterable([heads[head[k]] + made[k] for k in run])):
                for k in run:
                    alone = self.library.encode((head[k] + words[k])[1:].replace(SPACE, " "))
                    out[k] = tuple(alone[len(heads[head[k]]) :])
                    differing += out[k] != made[k]
        if differing:
            _log.warning("%d words of %d differ from the library, whose ids are taken", differing, len(words))
        return out

    def learn(self, words: Collection[str]) -> None:
        """Put words into the cache. Once half full it becomes the older half, whose words stay if they are met again."""
        missing = [w for w in words if w not in self.cache]
        again = {w: self.older[w] for w in missing if w in self.older}
        new = [w for w in missing if w not in again]
        if len(self.cache) + len(missing) > CACHE // 2:
            self.older, self.cache = self.cache, {w: self.cache[w] for w in words if w in self.cache}
        self.cache.update(again)
        self.cache.update(zip(new, self._as_library(new, self.encode_words(new))))

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        self.learn(dict.fromkeys(words))
        return list(chain.from_iterable(map(self.cache.__getitem__, words)))


_WORD = re.compile(r"\w")
_HEADS = (f"{SPACE}.", f"{SPACE}a")  # what a run of word characters, or of others, is put behind to be asked alone


def _pattern(pieces: Iterable[str]) -> re.Pattern:
    """Pattern of the parts of a text that no piece crosses, if pieces have space marks at their beginning only.

    Parts are runs of word characters or of others. Characters that some piece holds beside one of the other
    kind tie the runs on both sides together.
    """
    ties = set()
    for piece in pieces:
        bare = piece.lstrip(SPACE)
        for a, b in zip(bare, bare[1:]):
            if bool(_WORD.match(a)) != bool(_WORD.match(b)):
                word, mark = (a, b) if _WORD.match(a) else (b, a)
                ties.add(mark if word.isalpha() else word)
    if ties & set("a."):
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    tie = "".join(map(re.escape, sorted(ties)))
    runs = rf"[^\W{tie}]+|[^\w{SPACE}{tie}]+"
    if not ties:
        return re.compile(f"{SPACE}*(?:{runs})|{SPACE}+")
    return re.compile(f"{SPACE}*(?:{runs}|[{tie}]+(?:{runs})?)(?:[{tie}]+(?:{runs})?)*|{SPACE}+")


_known: dict[bytes, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary of a model, read once in each Python process."""
    name = hashlib.sha256(model).digest()
    if name not in _known:
        _known[name] = Vocabulary(model)
    return _known[name]


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= _PART:
            yield part
            part, held = [], 0
    if part:
        yield part


def _model(documents: DataFrame, path: str):
    with open(path, "rb") as file:
        return documents.sparkSession.sparkContext.broadcast(file.read())


def _mapped(documents: DataFrame, function, extra: list[T.StructField], keep: list[str] | None) -> DataFrame:
    """Run ``function(texts) -> arrays`` over the whole texts and add its arrays to the columns kept."""
    new = [f.name for f in extra]
    names = [c for c in (documents.columns if keep is None else keep) if c not in new]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(batch.column(batch.num_columns - 1))
            give_back()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], *new])

    plain = bounded_batches(documents).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.coalesce("text", F.lit("")).alias("whole"))
    shape = T.StructType([T.StructField(f"c{i}", documents.schema[c].dataType) for i, c in enumerate(names)] + extra)
    return plain.mapInArrow(rows, shape).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *new)


def encode(documents: DataFrame, model_path: str, keep: list[str] | None = None) -> DataFrame:
    """The documents, or their columns ``keep``, with ``ids``, the piece ids of the whole text. A column of that name is replaced."""
    model = _model(documents, model_path)

    def ids(texts: pa.Array) -> list[pa.Array]:
        v = vocabulary(model.value)
        return [pa.array([v.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))]

    return _mapped(documents, ids, [T.StructField("ids", T.ArrayType(T.IntegerType()))], keep)


def digests(documents: DataFrame, model_path: str, keep: list[str] | None = None) -> DataFrame:
    """The documents, or their columns ``keep``, with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encode, then decode again.

    Columns of these names are replaced.
    """
    model = _model(documents, model_path)

    def round_trip(texts: pa.Array) -> list[pa.Array]:
        v = vocabulary(model.value)
        counts, of_ids, of_text = [], [], []
        for part in _parts(texts.to_pylist()):
            split = [v.words(t) for t in part]
            v.learn(dict.fromkeys(chain.from_iterable(split)))
            ids = [list(chain.from_iterable(map(v.cache.__getitem__, words))) for words in split]
            counts += map(len, ids)
            of_ids += [hashlib.sha256(",".join(map(v.digits.__getitem__, made)).encode()).hexdigest() for made in ids]
            of_text += [hashlib.sha256(t.encode()).hexdigest() for t in v.library.decode(ids, num_threads=1)]
        return [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

    extra = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(documents, round_trip, extra, keep)


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """The rows with ``decoded``, the text of the piece ids in ``ids``; null for null."""
    model = _model(rows, model_path)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vocabulary(model.value)
            made = [None if ids is None else v.library.decode(ids) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], [*batch.schema.names[:-1], "decoded"])

    names = [c for c in rows.columns if c != "decoded"]
    plain = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("ids").alias("wanted"))
    shape = T.StructType([T.StructField(f"c{i}", rows.schema[c].dataType) for i, c in enumerate(names)] + [T.StructField("decoded", T.StringType())])
    return plain.mapInArrow(texts, shape).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "decoded")
