"""Canonical length-limited Huffman codes over token ids, and table-driven decoding."""

from __future__ import annotations

import numpy as np

LIMIT = 18
#: Ids between two bit offsets from which decoding can begin.
STEP = 512


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length per symbol by package-merge; symbols that do not occur get 0, a lone symbol 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of the limit length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    rows, current = [], leaves
    for _ in range(limit - 1):
        is_leaf = np.ones(len(current), bool) if not rows else rows[-1]
        if not rows:
            rows.append(is_leaf)
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        current = both[place]
        rows.append(place < len(leaves))
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(rows):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol: the lengths alone define them."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    long = lengths[order].tolist()
    out = []
    for n in long:
        code <<= n - last
        last = n
        out.append(code)
        code += 1
    codes[order] = out
    return codes


def encode(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
    """Bits of consecutive documents, each from a byte border.

    Returns the bytes, the bytes per document, and per document the bit offset, counted from its
    first byte, of every ``STEP``-th id.
    """
    bits = lengths[ids].astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(bits)))
    first = np.concatenate(([0], np.cumsum(sizes)))
    used = (ends[first[1:]] - ends[first[:-1]] + 7) // 8
    base = np.concatenate(([0], np.cumsum(used)))
    at = ends[:-1] + np.repeat(base[:-1] * 8 - ends[first[:-1]], sizes)
    total = int(base[-1])
    words = np.zeros(total // 8 + 2, np.uint64)
    code, room = codes[ids].astype(np.uint64), 64 - bits - (at & 63)  # room < 0: the code goes on in the next word
    over = np.flatnonzero(room < 0)
    left = np.maximum(room, 0).astype(np.uint64)
    here = code << left
    here[over] = code[over] >> (-room[over]).astype(np.uint64)
    word = at >> 6
    if len(ids):
        heads = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
        words[word[heads]] = np.bitwise_or.reduceat(here, heads)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)  # one such code at most per word
    out = words.astype(">u8").view(np.uint8)
    marks = [at[a:b:STEP] - base[k] * 8 for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))]
    return out[:total].tobytes(), used, marks


class Decoder:
    """One table look-up per id: the next ``width`` bits name the symbol and the length of its code."""

    def __init__(self, lengths: np.ndarray):
        self.width = max(1, int(lengths.max(initial=1)))
        self.entry = np.ones(1 << self.width, np.uint64)  # symbol above, length in the low byte
        codes = canonical(lengths)
        for s in np.flatnonzero(lengths).tolist():
            n = int(lengths[s])
            a = int(codes[s]) << (self.width - n)
            self.entry[a : a + (1 << (self.width - n))] = (s << 8) | n

    def decode(self, payload: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of runs that begin at bit offsets ``starts``, all runs side by side, in the order given."""
        data = np.frombuffer(payload + bytes(4), np.uint8)
        words = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
        order = np.argsort(-sizes, kind="stable")
        at, first = starts[order].astype(np.uint64), (np.cumsum(sizes) - sizes)[order]
        active = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0)))).tolist()  # runs longer than k come first
        out = np.zeros(int(sizes.sum()), np.uint32)
        drop, byte, low, eight = np.uint32(32 - self.width), np.uint64(3), np.uint64(7), np.uint64(255)
        for k, n in enumerate(active):
            here = at[:n]
            found = self.entry[(words[here >> byte] << (here & low).astype(np.uint32)) >> drop]
            out[first[:n] + k] = found >> np.uint64(8)
            here += found & eight
        return out
