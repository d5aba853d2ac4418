"""Whole Arrow batches of text as numpy arrays: words, lines and their 64-bit hashes.

A batch is looked at as one run of UTF-8 bytes, so that the cost is that of a
few vector operations and does not depend on how many documents it holds.
Words are ``[^\\x20\\x09-\\x0D]+``; a null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bases of the two hash families; odd, so they have inverses modulo 2**64.
STEP, SECOND_STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1024), U)
        out[0], done = 1, 1
        while done < len(out):
            k = min(done, len(out) - done)
            out[done : done + k] = out[:k] * U(pow(base, done, 2**64))
            done += k
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_table(fold: bool, factor: int = 0xD1342543DE82EF95) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U) * U(factor))
    if fold:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


EXACT, FOLDED = _byte_table(False), _byte_table(True)
SECOND = _byte_table(False, 0xA24BAED4963EE407)  # of the second family
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Runs:
    """Hashes of any stretches of one sequence of 64-bit numbers."""

    def __init__(self, values: np.ndarray, step: int = STEP):
        n = len(values)
        self.sums = np.zeros(n + 1, U)
        np.multiply(values, powers(step, n), out=self.sums[1:])
        np.cumsum(self.sums[1:], out=self.sums[1:])
        self.back = powers(pow(step, -1, 2**64), n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal stretches have equal hashes wherever they stand."""
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(raw + (end - start).astype(U) * U(0xA0761D6478BD642F))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours, by doubling."""
    if len(values) < width:
        return values[:0]
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if have < width else out


class Texts:
    """One batch of texts. ``doc`` numbers below count within the batch."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
        self.n = len(column)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = data[at[0] : at[-1]]
        if column.null_count:  # a null may stand on bytes of its own
            size = np.diff(at) * np.asarray(column.is_valid())
            if size.sum() != len(self.bytes):
                column = column.fill_null("")
                self.__init__(column)
                return
        self.at = at - at[0]
        self._words()

    def _words(self) -> None:
        b = self.bytes
        gap = np.empty(len(b) + 2, bool)
        gap[0] = gap[-1] = True
        gap[1:-1] = _SEPARATOR[b]
        self.inside = ~gap[1:-1]
        change = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = change[0::2], change[1::2]
        inner = self.at[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(b))])
        if len(inner):  # documents stand next to each other without a separator
            cut = inner[self.inside[inner] & self.inside[inner - 1]]
            if len(cut):
                start, end = np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, self.at)  # document i has the words first[i] to first[i + 1]
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.count)

    def word_hashes(self, table: np.ndarray = EXACT, step: int = STEP) -> np.ndarray:
        return Runs(table[self.bytes], step).hash(self.start, self.end)

    def per_doc(self, marks: np.ndarray) -> np.ndarray:
        """How many bytes of each document are marked."""
        total = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def windows(self, width: int) -> np.ndarray:
        """The first words of all runs of ``width`` words that lie in one document."""
        n = len(self.start)
        if n < width:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: n - width + 1] == self.doc[width - 1 :])


def _trim():
    """glibc's malloc_trim, where it is there."""
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0
    trim.argtypes, trim.restype = [ctypes.c_size_t], ctypes.c_int
    return trim


_malloc_trim = _trim()


#: What a worker keeps from task to task, by name: how to drop it.
CACHES: dict[str, Callable[[], None]] = {}


def release(keep: str | None = None) -> None:
    """Gives freed memory back to the system, and first drops all CACHES but ``keep``.

    A Python worker lives on for tasks of other operators, which would stand beside all that the largest task before them took.
    """
    for name, drop in CACHES.items():
        if name != keep:
            drop()
    pa.default_memory_pool().release_unused()
    _malloc_trim(0)


def slices(batch: pa.RecordBatch, limit: int, text: str = "text"):
    """The rows of a batch in blocks of about ``limit`` bytes of text; a longer text stands alone."""
    column = batch.column(batch.schema.get_field_index(text))
    total, begin = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)), 0
    while begin < batch.num_rows:
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def blocks(batches, limit: int, text: str = "text", keep: str | None = None):
    """The ``slices`` of all batches, with a ``release`` before the first and after the last."""
    release(keep)
    for batch in batches:
        yield from slices(batch, limit, text)
    batch = None
    release(keep)
