"""Where stretches of a fixed length repeat: anchors chosen by content, a count-min sketch of them, and runs of windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Texts, chunks, in_batches, mix

#: Cells of each of the sketch's two rows; the merged sketch has a bit a cell: 32 MB in all, whatever the input. A fuller sketch
#: lets more windows into the second pass and loses none.
CELL_BITS, DEPTH = 27, 2
_BLOCK = 16
#: Anchors that a task holds before it hands its sketch on.
HELD = 4_000_000
_PLACE = 28


#: Grams that anchor windows are hashed as polynomials modulo 2**64, which decides only where windows meet. Windows are hashed modulo this prime.
_PRIME = (1 << 61) - 1
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """powers(n): base**i and base**-i for i < n, by `times`. What is held doesn't travel with functions."""

    def __init__(self, base: int, modulus: int):
        self.base, self.modulus = base, modulus
        self.held = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __reduce__(self):
        return _Powers, (self.base, self.modulus)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[0]) < n:
            both = []
            for base in (self.base, pow(self.base, -1, self.modulus)):
                x = np.ones(1, np.uint64)
                while len(x) < n:
                    x = np.concatenate([x, self.times(x, np.uint64(pow(base, len(x), self.modulus)))])
                both.append(x)
            self.held = tuple(both)
        return self.held[0][:n], self.held[1][:n]

    def times(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.modulus != _PRIME:
            return a * b
        low = np.uint64((1 << 31) - 1)
        a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
        middle = a1 * b0 + a0 * b1
        return _reduced((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Modulo 2**61 - 1."""
    p = np.uint64(_PRIME)
    x = (x & p) + (x >> np.uint64(61))
    return np.where(x >= p, x - p, x)


_gram_powers = _Powers(0x9E3779B97F4A7C15, 1 << 64)
_window_powers = _Powers(0x1E3779B97F4A7C15, _PRIME)


def _grams(symbols: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(symbols) + 1, np.uint64)
    power, inverse = _gram_powers(len(h))
    np.cumsum(symbols * power[:-1], out=h[1:])
    return mix((h[size:] - h[:-size]) * inverse[: len(h) - size])


@dataclass
class Unit:
    """Windows of `length` symbols with anchors of `gram` symbols; symbols(texts) gives 64-bit symbols and each text's first one. raw: symbols are bytes."""

    length: int
    gram: int
    symbols: Callable[[Texts], tuple[np.ndarray, np.ndarray]]
    raw: bool = False


def word_symbols(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    _, _, words, first = texts.words()
    return words, first


def byte_symbols(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    return _BYTE[texts.data], texts.at


@dataclass
class Runs:
    """Runs of neighbouring windows that share an anchor: the gram with the least hash in a window, the rightmost of equals.

    Equal windows have equal anchors at equal places, so equal windows meet under one anchor hash.
    """

    text: np.ndarray
    start: np.ndarray  # of the first window, in its text
    count: np.ndarray  # windows of the run
    anchor: np.ndarray
    place: np.ndarray  # of the first window, in the chunk
    symbols: np.ndarray  # of the chunk: bytes, or hashes of words

    def covered(self, keep: np.ndarray, unit: Unit) -> np.ndarray:
        """Hash of all that each kept run's windows cover."""
        place = self.place[keep]
        ends = place + self.count[keep] + unit.length - 1
        whole = memoryview(np.ascontiguousarray(self.symbols))
        return np.array([xxhash.xxh3_64_intdigest(whole[a:b], 5) for a, b in zip(place.tolist(), ends.tolist(), strict=True)], np.uint64)


def runs_of(texts: Texts, unit: Unit) -> Runs:
    symbols, first = unit.symbols(texts)
    kept = texts.data if unit.raw else symbols
    w = unit.length - unit.gram + 1
    size = np.diff(first)
    windows = np.maximum(size - unit.length + 1, 0)
    total = int(windows.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none.astype(np.uint64), none, kept)
    grams = _grams(symbols, unit.gram)
    m = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | (np.uint64((1 << _PLACE) - 1) - np.arange(len(grams), dtype=np.uint64))
    reach = 1
    while 2 * reach <= w:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    if reach < w:
        m = np.minimum(m[: len(m) - (w - reach)], m[w - reach :])
    text = np.repeat(np.arange(len(size)), windows)
    place = np.arange(total) - np.repeat(np.cumsum(windows) - windows - first[:-1], windows)
    chosen = (1 << _PLACE) - 1 - (m[place] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate([at, [total]]))
    place = place[at]
    return Runs(text[at], place - first[text[at]], count, grams[chosen[at]], place, kept)


def window_hashes(runs: Runs, unit: Unit, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of the kept runs side by side, and where each run's begin. They are polynomials modulo a prime, in which no pattern of words cancels out."""
    count = runs.count[keep]
    at = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(at[-1]) - np.repeat(at[:-1] - runs.place[keep], count)
    power, inverse = _window_powers(len(runs.symbols) + 1)
    terms = _window_powers.times(_reduced(runs.symbols), power[:-1])
    high, low = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (terms >> np.uint64(31), terms & np.uint64((1 << 31) - 1)))
    h = _reduced(_window_powers.times(_reduced(high), np.uint64(1 << 31)) + _reduced(low))
    end = place + unit.length
    difference = _reduced(h[end] + (np.uint64(_PRIME) - h[place]))
    return mix(_window_powers.times(difference, inverse[place])), at


def _cells(anchor: np.ndarray) -> list[np.ndarray]:
    low = np.uint64((1 << CELL_BITS) - 1)
    return [(anchor & low).astype(np.uint32), ((anchor >> np.uint64(64 - CELL_BITS)) & low).astype(np.uint32)]


def sketch(docs: DataFrame, unit: Unit) -> np.ndarray:
    """Bits (depth x cells / 8) of the cells that count two anchors or more over all texts.

    Each task counts the anchors of its own texts; tasks' sketches are merged by blocks of cells, and the merged bits, of a fixed size, go to the driver.
    """
    schema = "block int, once binary, twice binary"

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                runs = runs_of(Texts(part.column("text")), unit)
                held.append(runs.anchor)
                size += len(runs.anchor)
                if size > HELD:
                    yield _sparse(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield _sparse(np.concatenate(held))

    def merge(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, once, twice in zip(*(batch.column(i) for i in range(3)), strict=True):
                c = counts.setdefault(block.as_py(), np.zeros(1 << _BLOCK, np.uint8))
                for x in (once, twice):
                    at = np.frombuffer(x.as_buffer(), np.uint16)
                    c[at] = np.minimum(c[at] + 1, 2)
        some = {b: np.packbits(c > 1).tobytes() for b, c in counts.items() if (c > 1).any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.int32()), pa.array(list(some.values()), pa.binary())], ["block", "bits"])

    merged = docs.select("text").transform(in_batches, count, schema).repartition("block").transform(in_batches, merge, "block int, bits binary").toArrow()
    out = np.zeros((DEPTH << (CELL_BITS - _BLOCK), 1 << (_BLOCK - 3)), np.uint8)
    for block, bits in zip(merged.column("block").to_pylist(), merged.column("bits").to_pylist(), strict=True):
        out[block] = np.frombuffer(bits, np.uint8)
    return out.reshape(DEPTH, -1)


def _sparse(anchor: np.ndarray) -> pa.RecordBatch:
    block, once, twice = [], [], []
    for row, cells in enumerate(_cells(anchor)):
        cells, count = np.unique(cells, return_counts=True)
        of = cells >> np.uint32(_BLOCK)
        low = (cells & np.uint32((1 << _BLOCK) - 1)).astype(np.uint16)
        ids, at = np.unique(of, return_index=True)
        for b, x, y in zip(ids.tolist(), at, [*at[1:], len(cells)], strict=True):
            block.append((row << (CELL_BITS - _BLOCK)) + b)
            once.append(low[x:y].tobytes())
            twice.append(low[x:y][count[x:y] > 1].tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["block", "once", "twice"]
    )


def estimated_repeated(anchor: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Anchors whose least count over the sketch's rows is two or more."""
    out = np.ones(len(anchor), bool)
    for row, cells in zip(bits, _cells(anchor), strict=True):
        out &= (row[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key that rows share only if they are equal in both."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


def covered(spans: pa.ListArray, length: int):
    """For each row a function from its number of symbols to a mask of those that its spans' windows cover; None without spans.

    spans: list<struct<start, n, which>>: windows start at start .. start + n - 1, or at start + w for w in which.
    """
    values, at = spans.values, np.asarray(spans.offsets)
    start, count = (np.asarray(values.field(f), dtype=np.int64) for f in ("start", "n"))
    which = values.field("which")
    some = np.asarray(which.is_valid()) if len(which) else np.zeros(0, bool)
    inner, offsets = np.asarray(which.values, dtype=np.int64), np.asarray(which.offsets, dtype=np.int64)

    def mask(a: int, b: int, n: int) -> np.ndarray:
        mark = np.zeros(n + 1, np.int32)
        part = some[a:b]
        first = start[a:b][~part]
        np.add.at(mark, first, 1)
        np.add.at(mark, first + count[a:b][~part] - 1 + length, -1)
        if part.any():
            lo, hi = offsets[a:b][part], offsets[a + 1 : b + 1][part]
            first = np.concatenate([s + inner[x:y] for s, x, y in zip(start[a:b][part], lo, hi, strict=True)])
            np.add.at(mark, first, 1)
            np.add.at(mark, first + length, -1)
        return np.cumsum(mark)[:-1] > 0

    for a, b, real in zip(at[:-1].tolist(), at[1:].tolist(), np.asarray(spans.is_valid()).tolist(), strict=True):
        yield (lambda n, a=a, b=b: mask(a, b, n)) if real else None
