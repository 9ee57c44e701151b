"""Canonical length-limited Huffman codes: lengths, codes, packing and table-driven unpacking."""

from __future__ import annotations

import numpy as np

#: Longest code, and so log2 of the entries of the decoding table.
LIMIT = 20
#: Ids between two checkpoints.
STRIDE = 256
#: Ids of a block that are worked on at once, a multiple of STRIDE.
CHUNK = 1 << 20


def lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of each id; 0 where the count is 0. Optimal under the limit (package-merge, Larmore and Hirschberg 1990)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit into codes of {limit} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    row, levels = coins, []
    for _ in range(limit - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([coins, packages])
        place = np.argsort(both, kind="stable")
        levels.append(place < len(coins))
        row = both[place]
    take = 2 * len(coins) - 2
    found = np.zeros(len(coins), np.int64)
    for is_coin in reversed(levels):
        own = int(is_coin[:take].sum())
        found[:own] += 1
        take = 2 * (take - own)
    found[:take] += 1
    out[order] = found
    return out


def codes(size: np.ndarray) -> np.ndarray:
    """Canonical codes from lengths: by length, then by id."""
    out = np.zeros(len(size), np.uint64)
    order = np.lexsort((np.arange(len(size)), size))
    order = order[size[order] > 0]
    code = last = 0
    for i in order.tolist():
        code <<= int(size[i]) - last
        last = int(size[i])
        out[i] = code
        code += 1
    return out


def table(size: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For each ``limit`` bits to come: the id that starts there, and its length."""
    order = np.lexsort((np.arange(len(size)), size))
    order = order[size[order] > 0]
    span = 1 << (limit - size[order].astype(np.int64))
    ids, bits = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    filled = int(span.sum())
    ids[:filled], bits[:filled] = np.repeat(order, span), np.repeat(size[order], span)
    return ids, bits


def pack(ids: np.ndarray, code: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of a block, and the bit offset of each STRIDE-th id. Long blocks are worked on CHUNK ids at a time."""
    done, marks, cells, rest = 0, [], [], 0
    for i in range(0, len(ids), CHUNK):
        own = ids[i : i + CHUNK].astype(np.int64)
        n = size[own].astype(np.int64)
        at = done + np.cumsum(n) - n
        marks.append(at[::STRIDE])
        base = done >> 5
        word, shift = (at >> 5) - base, at & 31
        wide = code[own] << (64 - n - shift).astype(np.uint64)
        done = int(at[-1] + n[-1])
        count = (done >> 5) - base + 2
        # Codes share no bits, so their sum is their union; sums stay below 2 ** 32 and are exact in doubles.
        out = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), count)
        out[1:] += np.bincount(word, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), count)[:-1]
        out[0] += rest
        keep = (done >> 5) - base
        cells.append(out[:keep].astype(">u4"))
        rest = out[keep]
    cells.append(np.array([rest], ">u4"))
    return b"".join(c.tobytes() for c in cells)[: (done + 7) // 8], np.concatenate(marks) if marks else np.zeros(0, np.int64)


def unpack(data: bytes, starts: np.ndarray, wanted: np.ndarray, decoding: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """Ids from several places at once: ``wanted`` ids from each bit offset, many lanes a step at a time."""
    lanes = CHUNK // STRIDE
    whole = np.frombuffer(data, np.uint8)
    parts = []
    for i in range(0, len(starts), lanes):
        own, n = starts[i : i + lanes].astype(np.int64), wanted[i : i + lanes]
        low = int(own[0]) >> 3
        high = (int(starts[i + lanes]) >> 3) + 8 if i + lanes < len(starts) else len(whole)
        parts.append(_lanes(whole[low:high], own - 8 * low, n, decoding, limit))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _lanes(data: np.ndarray, at: np.ndarray, wanted: np.ndarray, decoding: tuple[np.ndarray, np.ndarray], limit: int) -> np.ndarray:
    raw = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    ids, bits = decoding
    at = at.copy()
    out = np.zeros((len(at), int(wanted.max()) if len(wanted) else 0), np.uint32)
    mask = (1 << limit) - 1
    for step in range(out.shape[1]):
        key = window[np.minimum(at >> 3, len(window) - 1)].astype(np.int64) >> (32 - limit - (at & 7)) & mask
        out[:, step] = ids[key]
        at += bits[key]
    return out[np.arange(out.shape[1])[None, :] < wanted[:, None]]
