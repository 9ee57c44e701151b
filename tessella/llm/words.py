"""Words of texts and their hashes, for whole columns at once."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are runs of bytes other than space and 9 to 13; in UTF-8 that is the same as for code points.
IS_GAP = np.zeros(256, bool)
IS_GAP[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            _powers[size] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, b)]) for b in (_BASE, _BASE_INVERSE))
    return _powers[size]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes, mod 2^64; entry i is over the first i bytes."""
    up, _ = _power_table(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes: equal spans have equal hashes wherever they stand."""
    _, down = _power_table(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _GRAM)


#: Bytes of a word that are compared as numbers; longer words are told apart by a hash of all bytes.
HEAD = 24
_PART = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def heads(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """The first HEAD bytes of each span as three numbers, zeros beyond its end: with the length, the word itself up to HEAD."""
    raw = data.tobytes() + bytes(HEAD)
    ahead = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    n = end - start
    out = [ahead[start] & _PART[np.minimum(n, 8)]]
    for skip in (8, 16):
        part = np.zeros(len(start), np.uint64)
        some = np.flatnonzero(n > skip)
        part[some] = ahead[start[some] + skip] & _PART[np.minimum(n[some] - skip, 8)]
        out.append(part)
    return out


def head_hash(parts: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """One number from the parts and the length."""
    out = mix(parts[0] + n.astype(np.uint64) * _GRAM)
    for i, part in enumerate(parts[1:], 1):
        some = np.flatnonzero(n > 8 * i)
        out[some] = mix(out[some] ^ part[some] * _BASE)
    return out


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word: by its bytes as numbers, XXH3 over all of them where it is long."""
    if not len(start):
        return np.zeros(0, np.uint64)
    out = head_hash(heads(data, start, end), end - start)
    for i in np.flatnonzero(end - start > HEAD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def find(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (n + 1 entries)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~IS_GAP[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:] - 1
    ends = ends[ends >= 0]
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def cuts(data: np.ndarray, size: int) -> list[int]:
    """Places, from 0 to the end, that part a text at gaps into pieces of about ``size`` bytes; words stay whole."""
    out, at = [0], size
    while at < len(data):
        gaps = IS_GAP[data[at : at + size]]
        where = int(gaps.argmax())
        if gaps[where]:
            out.append(at + where)
            at += where
        at += size
    return out + [len(data)] if len(data) or len(out) > 1 else [0, 0]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, from the words' hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(count, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(n):
            out += words[i : i + count] * factor
            factor = factor * _GRAM
    return mix(out)


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` consecutive values, the leftmost on a tie."""
    least, at = values, np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        a, b = least[:-step], least[step:]
        right = b < a
        least, at = np.where(right, b, a), np.where(right, at[step:], at[:-step])
        done += step
    return at


def bitmap(anchors: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of 2 ** bits of a column ``anchor`` of hashes, each once: at most a row for every 64 bits comes to the driver."""
    bit = F.shiftrightunsigned("anchor", 64 - bits)
    cells = anchors.groupBy(F.shiftright(bit, 6).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    )
    got = cells.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def marked_places(marked: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Places of the hashes whose bit is set in a bitmap."""
    bit = hashed >> np.uint64(65 - (64 * len(marked)).bit_length())
    return np.flatnonzero(marked[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
