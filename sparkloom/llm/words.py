"""Vectorised words of whole texts: spans and 64-bit hashes from raw UTF-8, without a Python loop over words.

The hash of a word is a polynomial in its bytes, taken from one prefix sum over the batch:
``sum(code[b_i] * P**i)`` between the word's ends, divided by ``P**start`` (P is odd, so it has an
inverse modulo 2**64) and then mixed. Equal words always have equal hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK_BYTES = 1 << 20

# Fixed values of the contracts: which bytes are part of a word once A-Z are lower-case.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: digits, letters and every byte of a non-ASCII character
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: everything but the space and \t \n \v \f \r
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[9:14] = NONSPACE[32] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _P)[_LOWER]
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P and its inverse to the powers 0 to n; kept for texts of up to two chunks."""
    if _powers and n < len(_powers[0]):
        return _powers[0][: n + 1], _powers[1][: n + 1]
    tables = []
    for base in (_P, _P_INVERSE):
        steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
        steps[0] = 1
        tables.append(np.multiply.accumulate(steps))
    if n <= 2 * CHUNK_BYTES:
        _powers[:] = tables
    return tables[0][: n + 1], tables[1][: n + 1]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and its n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first, last) rows of runs of whole texts of about ``limit`` bytes; a longer text is a run by itself."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (n + 1 long)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = member[data]
    here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(here & ~before)
    ends = np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the index of each text's first word."""
    starts, ends, first = spans(data, offsets, member)
    return hashes(data, starts, ends), first


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text of fewer words (but not none) has its whole sequence as one."""
    n = len(words)
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        full += mix(words[k : k + len(full)] + _K[k % 5] * np.uint64(k // 5 + 1)) * _K[(k + 1) % 5]
    full = mix(full)
    texts = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
    for a, b in texts:
        full[a : max(a, b - size + 1)].sort()
    # a text's first shingle is new whatever stands before it
    new = np.append(True, full[1:] != full[:-1])[: len(full)]
    new[first[:-1][first[:-1] < len(full)]] = True
    out = []
    for a, b in texts:
        if b - a >= size:
            own = slice(a, b - size + 1)
            out.append(full[own][new[own]])
        elif b > a:
            whole = np.full(1, b - a, np.uint64) * _K[4]
            for w in words[a:b]:
                whole = mix((whole ^ w) * _K[1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
