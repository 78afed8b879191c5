"""A minimal perfect hash over 64-bit keys, built level by level with numpy.

At each level the keys still unplaced are hashed into twice as many bits; a bit that exactly one
key hits keeps that key, the others go on. The rank of a key's bit among all set bits is its slot,
so n keys fill slots 0 .. n-1 with about three bits a key and a constant number of probes.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
GAMMA, MAX_LEVELS = 2.0, 64


def mix64(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mixer (SplitMix64 finaliser) of keys offset by a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(U64) + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits stored beside each slot, which tell foreign keys from indexed ones."""
    return (mix64(keys, 1_000_003) >> U64(32)).astype(np.uint32)


class MinimalPerfectHash:
    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        """sizes: bits of each level; bits: 0/1 bytes of all levels one after another."""
        self.sizes, self.bits = sizes.astype(np.int64), bits.astype(np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.ranks = np.concatenate([[0], np.cumsum(self.bits, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """keys: distinct unsigned 64-bit integers."""
        left, sizes, bits = keys.astype(U64), [], []
        for level in range(MAX_LEVELS):
            if not len(left):
                break
            m = int(np.ceil(GAMMA * len(left) / 64) * 64)
            at = (mix64(left, level) % U64(m)).astype(np.int64)
            once = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            bits.append(once)
            left = left[~once[at]]
        if len(left):
            raise ValueError("keys repeat")
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(bits) if bits else np.zeros(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where every level rejects it (only foreign keys)."""
        keys = keys.astype(U64)
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (m, start) in enumerate(zip(self.sizes, self.starts)):
            if not len(todo):
                break
            at = start + (mix64(keys[todo], level) % U64(m)).astype(np.int64)
            hit = self.bits[at] == 1
            out[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        packed = np.packbits(self.bits)
        head = np.array([len(self.sizes), len(self.bits)], dtype="<i8")
        return head.tobytes() + self.sizes.astype("<i8").tobytes() + packed.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[MinimalPerfectHash, int]:
        """The hash and the number of bytes it took."""
        n, n_bits = (int(v) for v in np.frombuffer(data, "<i8", 2))
        sizes = np.frombuffer(data, "<i8", n, offset=16)
        used = 16 + 8 * n
        packed = np.frombuffer(data, np.uint8, (n_bits + 7) // 8, offset=used)
        return cls(sizes, np.unpackbits(packed, count=n_bits)), used + len(packed)
