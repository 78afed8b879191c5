"""Hashes of the words of whole string columns, without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0xA24BAED4963EE407
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18

#: Letters: ASCII letters and all bytes of longer UTF-8 sequences.
LETTERS = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_VALUES = np.random.Generator(np.random.Philox(key=21)).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_VALUES[65:91] = _VALUES[97:123]
_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        _powers[:] = [np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(f))])) for f in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)), off


def run_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters of the texts data[off[i]:off[i + 1]], and each text's first run.

    Case is folded for ASCII and Latin-1 letters. A prefix sum of byte values times powers of a
    base is taken once; its difference over a run, divided by the power at the run's start, depends
    on the run alone.
    """
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    data = data.copy()
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    data[upper] += 0x20
    power, inverse = power_tables(len(data) + 1)
    solid = LETTERS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.append(False, solid[:-1]) & ~edge[:-1]
    after = np.append(solid[1:], False) & ~edge[1:]
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    sums = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(np.where(solid, _VALUES[data], U64(0)) * power[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + U64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, off)


def word_arrays(column: pa.Array) -> list[np.ndarray]:
    """The word hashes of each text of a column, in order."""
    if not len(column):
        return []
    data, off = column_bytes(column)
    out: list[np.ndarray] = []
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
        h, first = run_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        out += [h[a:z] for a, z in zip(first[:-1], first[1:])]
        i = j
    return out

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 65, 97, 48, 97
_PLAIN = np.random.Generator(np.random.Philox(key=22)).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _FOLDED[97:123]


def word_codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(case-folded hash, shape hash) of the blank-separated words of texts, and each text's first word.

    The shape of a word has A and a for letters, 0 for digits and other characters as they are, with
    runs cut to two.
    """
    none = np.zeros(0, U64)
    if not len(data):
        return none, none, np.zeros(len(off), np.int64)
    data = data.copy()
    lead = np.flatnonzero(data[:-1] == 0xC3)
    upper = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E) & (data[lead + 1] != 0x97)]
    kind = _CLASS[data]
    kind[upper], kind[upper + 1] = 65, 65
    data[upper + 1] += 0x20
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    joined = solid[:-1] & solid[1:] & ~edge[1:-1]  # byte i and i + 1 are of one word
    before, after = np.append(False, joined), np.append(joined, False)
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    same = joined & (kind[:-1] == kind[1:])
    keep = solid.copy()
    keep[2:] &= ~(same[1:] & same[:-1])
    power, inverse = power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(np.where(solid, _FOLDED[data], U64(0)) * power[: len(data)], out=sums[1:])
        folded = mix((sums[ends] - sums[starts]) * inverse[starts] + U64(3))
        kept = np.concatenate([[0], np.cumsum(keep)])
        values = _PLAIN[kind[keep]]
        sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * power[: len(values)], out=sums[1:])
        a, z = kept[starts], kept[ends]
        shapes = mix((sums[z] - sums[a]) * inverse[a] + U64(5))
    return folded, shapes, np.searchsorted(starts, off)
