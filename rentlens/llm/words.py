"""Word and shingle hashes of Arrow text batches, computed on the UTF-8 bytes with numpy.

A word is a longest run of ASCII letters, digits, ``_`` and bytes over 127; in scripts written without spaces
(Han, kana, Thai, Lao, Burmese, Khmer) each character is a word. A run longer than ``LONGEST`` bytes is cut into
words of that many, counted from its own beginning, so a text has the same words whatever stands beside it.
Work goes in segments of at most a megabyte that begin and end between words, so that memory follows the
segment and not the batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_ROWS = 1000
LONGEST = 1 << 16
SEGMENT = 16 * LONGEST
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD_BYTE = np.array([b > 127 or chr(b).isalnum() or b == 95 for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def bounded_batches(documents: DataFrame) -> DataFrame:
    """The documents, with the session's Arrow batches held to ``BATCH_ROWS`` rows: whole texts are long."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", documents.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return documents


def give_back() -> None:
    """Return freed memory to the system: Python workers live on for the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(rows):
    """Generator over Arrow batches that gives freed memory back when its partition ends."""

    @functools.wraps(rows)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            give_back()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last ends. Null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, and two rows to work in, made once in each Python process."""
    if not _powers:
        _powers["scratch"] = np.zeros((2, SEGMENT + 1), np.uint64)
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(SEGMENT + 1, factor, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"], _powers["scratch"]


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Where a character of a script without spaces begins; each of them has three bytes in UTF-8."""
    begins = (data >= 0xE3) & (data <= 0xE9)  # Han and kana
    for lead, ranges in ((0xE0, ((0xB8, 0xBB),)), (0xE1, ((0x80, 0x82), (0x9E, 0x9F)))):  # Thai and Lao; Burmese and Khmer
        at = np.flatnonzero(data[:-1] == lead)
        for low, high in ranges if len(at) else ():
            begins[at[(data[at + 1] >= low) & (data[at + 1] <= high)]] = True
    return begins


def _edges(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in bytes that begin between two words; texts begin at ``cuts``. Long runs are whole."""
    inside = _WORD_BYTE[data]
    begins, ends = inside.copy(), np.zeros(len(data) + 1, bool)
    begins[1:] &= ~inside[:-1]
    ends[1:-1] = inside[:-1] & ~inside[1:]
    ends[-1] = len(data) > 0 and inside[-1]
    edges = [cuts]
    if len(data) and data.max() >= 0xE0:
        alone = np.flatnonzero(_unspaced(data))
        edges += [alone, alone + 3]
    for edge in edges:
        at = edge[(edge > 0) & (edge < len(data))]
        at = at[inside[at] & inside[at - 1]]
        begins[at] = True
        ends[at] = True
    return np.flatnonzero(begins), np.flatnonzero(ends)


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``SEGMENT`` bytes: whole texts, or parts of one text that is longer."""
    at, size = 0, len(data)
    while at < size:
        end = int(offsets[np.searchsorted(offsets, at + SEGMENT, side="right") - 1])
        if end > at:  # whole texts
            yield at, end
            at = end
            continue
        stop = int(offsets[np.searchsorted(offsets, at, side="right")])
        while stop - at > SEGMENT:
            end = at + SEGMENT
            begins, _ = _edges(data[at : end + 3], np.zeros(0, np.int64))
            last = at + int(begins[np.searchsorted(begins, SEGMENT, side="right") - 1]) if len(begins) else at
            covered = _WORD_BYTE[data[end - 1]] and _WORD_BYTE[data[end]]
            if covered and last > at:  # a word crosses the end: it goes to the next segment, unless it fills this one
                end = last
            yield at, end
            at = end
        yield at, stop
        at = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hash of each word, the text it is in, and for each asked length in bytes the hash of its first bytes.

    A word that is not longer than the asked length has 0 there.
    """
    up, down, scratch = _tables()
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    hashes, owners, heads = [], [], [[] for _ in prefixes]
    for at, end in _segments(data, offsets):
        s, e = _edges(data[at:end], firsts[np.searchsorted(firsts, at) : np.searchsorted(firsts, end)] - at)
        if not len(s):
            continue
        if (e - s).max() > LONGEST:
            pieces = -(-(e - s) // LONGEST)
            s, stop = np.repeat(s, pieces), np.repeat(e, pieces)
            s = s + LONGEST * (np.arange(len(s)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            e = np.minimum(s + LONGEST, stop)
        # segments differ in length: in arrays of their own they would leave the heap in pieces
        spread, total = scratch[0, : end - at], scratch[1, : end - at + 1]
        np.add(data[at:end], np.uint64(1), out=spread)
        np.multiply(spread, up[: end - at], out=spread)
        total[0] = 0
        np.cumsum(spread, out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        owners.append(np.searchsorted(offsets, s + at, side="right") - 1)
        for rows, length in zip(heads, prefixes):
            part = mix((total[np.minimum(s + length, e)] - total[s]) * down[s] + np.uint64(length * int(_INVERSE) % (1 << 64)))
            rows.append(np.where(e - s > length, part, np.uint64(0)))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(hashes, np.uint64), join(owners, np.int64), [join(rows, np.uint64) for rows in heads]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole text if it has fewer words, none if it has none."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total *= _BASE
        total += words[k : len(words) - size + 1 + k]
    return mix(total + np.uint64(size))


def by_text(owners: np.ndarray, count: int) -> np.ndarray:
    """Bounds of each text's words: words of text i are from ``bounds[i]`` to ``bounds[i + 1]``."""
    return np.searchsorted(owners, np.arange(count + 1))
