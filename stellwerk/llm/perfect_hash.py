"""Minimal perfect hash of 32-byte digests, as a few bitmaps.

Level by level, each remaining key hashes to a place of a bitmap; keys alone on their place set its
bit and are done, the others go on to the next level.  The slot of a key is the number of bits set
before its own over all levels: n keys have the slots 0 to n - 1, at about three bits a key.  A
digest that is not among the keys may get a slot too, so slots must be checked against the key.
"""

from __future__ import annotations

import numpy as np

from stellwerk.llm.common import mixed

DIGEST_BYTES = 32
SPARE = 1.5  # places per remaining key
MOST_LEVELS = 200  # a level leaves about half; distinct digests part long before


def as_digests(data: bytes) -> np.ndarray:
    """Digests one after the other as rows of four 64-bit numbers."""
    return np.frombuffer(data, "<u8").reshape(-1, DIGEST_BYTES // 8)


def _places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """All 256 bits take part, so that distinct digests part at some level."""
    value = np.full(len(digests), 2 * level + 1, np.uint64)
    for column in range(digests.shape[1]):
        value = mixed(value ^ digests[:, column])
    return (value % np.uint64(size)).astype(np.int64)


def build(digests: np.ndarray) -> tuple[list[int], bytes]:
    """Sizes of the levels' bitmaps, and these one after the other; the digests are distinct."""
    sizes, maps = [], []
    left = digests
    while len(left):
        if len(sizes) == MOST_LEVELS:
            raise ValueError("digests are not distinct")
        size = -(-max(8, int(SPARE * len(left))) // 8) * 8
        place = _places(left, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        maps.append(np.packbits(alone))
        left = left[~alone[place]]
    return sizes, np.concatenate(maps).tobytes() if maps else b""


def slots(digests: np.ndarray, sizes: list[int], maps: bytes) -> np.ndarray:
    """Slot of every digest; -1 for those that no level holds."""
    bits = np.unpackbits(np.frombuffer(maps, np.uint8))
    rank = np.cumsum(bits, dtype=np.int64) - 1
    found = np.full(len(digests), -1, np.int64)
    left = np.arange(len(digests))
    start = 0
    for level, size in enumerate(sizes):
        at = start + _places(digests[left], level, size)
        hit = bits[at] == 1
        found[left[hit]] = rank[at[hit]]
        left = left[~hit]
        start += size
    return found
