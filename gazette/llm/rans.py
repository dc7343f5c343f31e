"""Static range asymmetric numeral coding of token blocks with interleaved lanes (numpy).

A block holds up to BLOCK tokens, dealt in turn to LANES coder states (one a
token, if there are fewer); each lane
is a coder of its own, so one numpy operation moves all lanes on. The
probabilities come from one table shared by all blocks. Blocks are independent:
each carries its lanes' final states, which are where decoding starts, and a
checksum of its tokens.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Tokens of a block, and coder states of a block.
BLOCK, LANES = 1 << 18, 2048
#: Frequencies sum to 2**BITS; states stay in [2**LOW, 2**(LOW + 32)).
BITS, LOW = 18, 31
_WORD = np.uint64(32)


class Table:
    """Cumulative frequencies for ids 0..n-1, scaled to 2**BITS; every counted id keeps at least 1."""

    def __init__(self, freq: np.ndarray):
        if freq.sum() != 1 << BITS:
            raise ValueError("frequencies must sum to 2**BITS")
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        """Counts of ids, scaled to frequencies; the rounding goes to the most frequent ids."""
        total = 1 << BITS
        seen = counts > 0
        if seen.sum() > total:
            raise ValueError("more ids than slots")
        freq = np.where(seen, np.maximum(1, counts.astype(np.float64) / max(1, counts.sum()) * total).astype(np.int64), 0)
        order = np.argsort(-freq, kind="stable")
        over = int(freq.sum()) - total
        if over < 0:
            freq[order[0]] -= over
        for i in order:
            if over <= 0:
                break
            cut = min(over, int(freq[i]) - 1)
            freq[i] -= cut
            over -= cut
        return freq


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block: u32 tokens, u32 crc32 of the ids as u32, u32 words, a u64 state for each lane, u32 words."""
    n, lanes = len(ids), min(LANES, len(ids))
    rows = -(-n // lanes) if n else 0
    x = np.full(lanes, 1 << LOW, np.uint64)
    out = []
    shift = np.uint64(LOW + 32 - BITS)
    for r in range(rows - 1, -1, -1):
        part = ids[r * lanes:(r + 1) * lanes]
        m = len(part)
        f, s, own = table.freq[part], table.start[part], x[:m]
        full = own >= (f << shift)
        words = (own[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
        out.append(words[::-1])
        own = np.where(full, own >> _WORD, own)
        q, rest = np.divmod(own, f)
        x[:m] = (q << np.uint64(BITS)) + rest + s
    words = np.concatenate(out)[::-1] if out else np.zeros(0, "<u4")
    head = np.array([n, zlib.crc32(ids.astype("<u4").tobytes()), len(words)], "<u4")
    return head.tobytes() + x.astype("<u8").tobytes() + words.astype("<u4").tobytes()


def decode(block: bytes, table: Table) -> np.ndarray:
    """The block's ids; raises ValueError if they don't match its checksum."""
    n, crc, size = (int(v) for v in np.frombuffer(block, "<u4", 3))
    lanes = min(LANES, n)
    x = np.frombuffer(block, "<u8", lanes, 12).astype(np.uint64)
    words = np.frombuffer(block, "<u4", size, 12 + 8 * lanes).astype(np.uint64)
    out = np.empty(n, np.uint32)
    at, mask, low = 0, np.uint64((1 << BITS) - 1), np.uint64(1 << LOW)
    for r in range(-(-n // lanes) if n else 0):
        m = min(lanes, n - r * lanes)
        own = x[:m]
        slot = own & mask
        ids = table.symbol[slot]
        out[r * lanes:r * lanes + m] = ids
        own = table.freq[ids] * (own >> np.uint64(BITS)) + slot - table.start[ids]
        short = np.flatnonzero(own < low)
        if len(short):
            own[short] = (own[short] << _WORD) | words[at:at + len(short)]
            at += len(short)
        x[:m] = own
    if at != size or zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("block checksum mismatch")
    return out
