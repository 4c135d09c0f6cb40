"""Word and n-gram hashing over Arrow string buffers, whole batches at a time with numpy.

Words are found on UTF-8 bytes through a 256-entry class table (0 = separator, any other value = the byte
after case folding), so no Python object is made per word. Hashes are 64-bit polynomial prefix hashes over random
per-byte values followed by a finalising mix; callers verify matches exactly where exactness is promised.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
_BYTE_VALUES = np.random.RandomState(20240229).randint(1, 2**63, 256, dtype=np.int64).astype(_U)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def class_table(is_word) -> np.ndarray:
    """256 classes: bytes for which ``is_word`` holds keep their value, with A-Z folded to a-z; others are 0."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 0x41 <= b <= 0x5A else b
        if is_word(low):
            table[b] = low
    return table


#: Words are runs of anything but ASCII white space (U+0020, U+0009-U+000D).
SPACE_WORDS = class_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D) and b != 0)
SPACE_WORDS[0] = 0xFF  # U+0000 is a word character; no UTF-8 text holds the byte FF
#: Words are runs of digits, letters a-z and everything beyond ASCII.
ALNUM_WORDS = class_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = (out[0], out[1])
    a, b = _powers[base]
    return a[:n], b[:n]


def released() -> None:
    """Give memory that Arrow and the allocator keep for later back to the system; idle workers then hold little."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not a glibc system
    _trim = None


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive documents (first, end, bytes, offsets) of at most ``limit`` bytes together, or a single longer one."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """The words of some documents: byte spans, hashes, and where each document's words begin (``first``, n+1 long)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = data, offsets
        self.classes = table[data]
        on = np.zeros(len(data) + 1, bool)
        on[:-1] = self.classes != 0
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        before = np.zeros(len(data) + 1, bool)
        before[1:] = on[:-1]
        self.starts = np.flatnonzero(on & (~before | begins))
        self.ends = np.flatnonzero(before & (~on | begins))
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        """The document number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        power, inverse = powers(_BYTE_BASE, len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, _U)
        np.cumsum(_BYTE_VALUES[self.classes] * power[:-1], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * inverse[self.starts])

    def strings(self, doc: int) -> list[bytes]:
        """The folded words of one document."""
        a, b = self.first[doc], self.first[doc + 1]
        folded = self.classes.tobytes() if len(self.first) == 2 else self.classes[self.offsets[doc] : self.offsets[doc + 1]].tobytes()
        lo = self.offsets[doc]
        return [folded[s - lo : e - lo] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]


def gram_prefix(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = powers(_WORD_BASE, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * power[:-1], out=total[1:])
    return total, inverse


def grams(hashes: np.ndarray, k: int, prefix=None) -> np.ndarray:
    """Hash of words i..i+k-1 for every i with k words from it (document borders are the caller's)."""
    total, inverse = prefix or gram_prefix(hashes)
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    return mix((total[k:] - total[:-k]) * inverse[:n] + _U(k))
