"""Hamming distances of many 64-bit words at once, from vertical bit planes.

Plane ``b`` holds bit ``b`` of every word of a block, one lane a word. A query flips the planes of its own set bits;
carry-save adders then count the differing bits of all lanes together in two planes and a plane of lanes beyond
three. A block is abandoned as soon as all of its lanes are beyond.
"""

from __future__ import annotations

import numpy as np

BITS = 64
CHECK_EVERY = 8


def planes_of(words: np.ndarray) -> list[int]:
    """Bit planes of unsigned 64-bit words as integers with one bit a word."""
    rows = np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(rows.T, axis=1, bitorder="little")
    return [int.from_bytes(p.tobytes(), "little") for p in packed]


def within_three(planes: list[int], everyone: int, query: int) -> int:
    """Lanes of ``everyone`` that differ from ``query`` in at most three bits."""
    ones = twos = 0
    beyond = 0
    for b in range(BITS):
        differ = planes[b] ^ everyone if query >> b & 1 else planes[b]
        carry = ones & differ
        ones ^= differ
        beyond |= twos & carry
        twos ^= carry
        if b % CHECK_EVERY == CHECK_EVERY - 1 and everyone & ~beyond == 0:
            return 0
    return everyone & ~beyond


def lanes_within_three(differences: np.ndarray) -> np.ndarray:
    """Which of many differences (words XORed in pairs) have at most three bits set; the same adders over numpy words."""
    n = len(differences)
    rows = np.unpackbits(np.ascontiguousarray(differences, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(rows.T, axis=1, bitorder="little")
    packed = np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)
    ones, twos, beyond = (np.zeros(packed.shape[1], np.uint64) for _ in range(3))
    for b in range(BITS):
        carry = ones & packed[b]
        ones ^= packed[b]
        beyond |= twos & carry
        twos ^= carry
        if b % CHECK_EVERY == CHECK_EVERY - 1 and (~beyond == 0).all():
            break
    return np.unpackbits((~beyond).view(np.uint8), bitorder="little")[:n].astype(bool)


def spanning_links(words: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the words as all pairs within three bits would, at most one fewer than there are words."""
    planes, left = planes_of(words), (1 << len(words)) - 1
    values, links = words.tolist(), []
    while left:
        seed = (left & -left).bit_length() - 1
        left &= left - 1
        queue = [seed]
        while queue and left:
            at = queue.pop()
            near = within_three(planes, left, values[at])
            left &= ~near
            while near:
                lane = (near & -near).bit_length() - 1
                near &= near - 1
                links.append((values[at], values[lane]))
                queue.append(lane)
    return links
