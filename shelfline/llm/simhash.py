"""SimHash votes: the bits that more than half of a row's hashes have set."""

from __future__ import annotations

import numpy as np

#: Byte value -> its eight bits, each in a byte lane of a 64-bit word.
LANES = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(i)) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))
#: So many ones fit a byte lane.
LANE_SUM = 255


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of rows; row i owns the next counts[i] of the unsigned 64-bit hashes.

    Votes are added eight bits at a time in byte lanes, in pieces of at most 255 hashes, then
    across the pieces of a row. A row without hashes has fingerprint zero.
    """
    result = np.zeros(len(counts), np.uint64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return result
    owned = counts[rows].astype(np.int64)
    first = np.concatenate(([0], np.cumsum(owned)[:-1]))
    pieces = -(-owned // LANE_SUM)
    piece_first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    within = np.arange(pieces.sum()) - np.repeat(piece_first, pieces)
    starts = np.repeat(first, pieces) + within * LANE_SUM
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    found = np.zeros(len(rows), np.uint64)
    for j in range(8):
        sums = np.add.reduceat(LANES[octets[:, j]], starts).view(np.uint8).reshape(-1, 8)
        votes = np.add.reduceat(sums.astype(np.int64), piece_first, axis=0)
        ones = (2 * votes > owned[:, None]).astype(np.uint64)
        for i in range(8):
            found |= ones[:, i] << np.uint64(8 * j + i)
    result[rows] = found
    return result
