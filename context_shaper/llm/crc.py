"""CRC-32 of word runs, for whole batches with numpy.

The checksum of a concatenation follows from those of its parts: advance the first by the second's
length in zero bytes, a linear map, and add the second.  So every byte of a text is read once,
however many runs a word is part of.
"""

from __future__ import annotations

import zlib

import numpy as np

SHORT = 64  # longer spans are hashed one at a time
ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_TABLE = _byte_table()


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values for each of the four bytes."""
    out = tables[0][crc & np.uint32(255)]
    for place in range(1, 4):
        out = out ^ tables[place][(crc >> np.uint32(8 * place)) & np.uint32(255)]
    return out


def _zero_tables() -> tuple[np.ndarray, np.ndarray]:
    """Maps that advance by 0 to 255 zero bytes, and by 256, 512, ... zero bytes."""
    image = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * place) for place in range(4)])
    few = []
    for _ in range(257):
        few.append(image)
        image = (image >> np.uint32(8)) ^ _TABLE[image & np.uint32(255)]
    many = [few.pop()]
    for _ in range(23):
        many.append(_apply(many[-1], many[-1]))
    return np.stack(few), np.stack(many)


_FEW, _MANY = _zero_tables()


def advance(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each checksum moved over ``lengths`` zero bytes."""
    low = (lengths & 255).astype(np.intp) * 1024
    flat = _FEW.reshape(-1)
    out = flat[low + (crc & np.uint32(255))]
    for place in range(1, 4):
        out ^= flat[low + 256 * place + ((crc >> np.uint32(8 * place)) & np.uint32(255))]
    high, step = lengths >> 8, 0
    while high.any():
        odd = np.flatnonzero(high & 1)
        out[odd] = _apply(_MANY[step], out[odd])
        high, step = high >> 1, step + 1
    return out


def append_byte(crc: np.ndarray, byte: int) -> np.ndarray:
    register = crc ^ ONES
    return ((register >> np.uint32(8)) ^ _TABLE[(register ^ np.uint32(byte)) & np.uint32(255)]) ^ ONES


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The checksum of each span of bytes."""
    lengths = ends - starts
    order = np.argsort(np.minimum(lengths, SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    first, size = starts[order], lengths[order]
    long = int(np.count_nonzero(size > SHORT))
    register = np.full(len(order), ONES, np.uint32)
    counts = np.bincount(np.minimum(size, SHORT + 1), minlength=SHORT + 2)
    left = len(order)
    for place in range(SHORT):
        left -= int(counts[place])
        if left <= long:
            break
        part = register[long:left]
        byte = data[first[long:left] + place]
        register[long:left] = (part >> np.uint32(8)) ^ _TABLE[(part ^ byte) & np.uint32(255)]
    out = np.empty(len(order), np.uint32)
    out[order] = register ^ ONES
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def run_crcs(crcs: np.ndarray, lengths: np.ndarray, most: int) -> list[np.ndarray]:
    """For sizes 1 to ``most``: the checksum of every run of neighbouring words, joined by one space."""
    runs = [crcs]
    for size in range(2, most + 1):
        begun = append_byte(runs[-1][:-1], 32)
        runs.append(advance(begun, lengths[size - 1 :]) ^ crcs[size - 1 :])
    return runs
