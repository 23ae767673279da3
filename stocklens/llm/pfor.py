"""Patched frame-of-reference blocks of unsigned 32-bit integers.

A block holds up to 1,024 values. Its minimum is subtracted; the bit width is what a chosen share (percentile) of its
values needs; lower bits of all values are packed at that width, and values that need more keep their upper bits in an
exception list of (place, upper bits). The starts of all blocks form an index, so a reader can open any block alone.

Packed bits lie in 32 rows of 32 lanes: one numpy operation packs a row of every block of equal width.
"""

import numpy as np

BLOCK, LANES = 1024, 32
HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("pad", "u1"), ("count", "<u2"), ("exceptions", "<u4")])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits needed by each value; zero needs none."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _place(out: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> None:
    if rows.size:
        out[starts[:, None] + np.arange(rows.shape[1])] = rows


def _take(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(data[starts[:, None] + np.arange(width)])


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of consecutive groups of the given sizes."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def pack(values: np.ndarray, share: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all blocks and where each begins; the width of a block fits the given share of its values."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.uint64)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, values[-1], np.uint32)  # the last block is filled up with a value of its own
    grid[:n] = values
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    grid = grid - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1)
    width = _bits(np.partition(grid, rank, axis=1)[:, rank])
    over = np.where((width < 32)[:, None], grid >> np.minimum(width, 31).astype(np.uint32)[:, None], 0)
    at_block, at_place = np.nonzero(over)
    exceptions = np.bincount(at_block, minlength=blocks)
    head = np.zeros(blocks, HEAD)
    head["low"], head["width"], head["exceptions"] = low, width, exceptions
    head["count"] = BLOCK
    head["count"][-1] = n - (blocks - 1) * BLOCK
    packed_size = width * LANES * 4
    size = HEAD.itemsize + packed_size + exceptions * 6
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    _place(out, starts, head.view(np.uint8).reshape(blocks, HEAD.itemsize))
    for w in np.unique(width[width > 0]).tolist():
        chosen = np.flatnonzero(width == w)
        part = grid[chosen].reshape(-1, 32, LANES) & np.uint32((1 << w) - 1)
        words = np.zeros((len(chosen), w, LANES), np.uint32)
        for row in range(32):
            word, shift = divmod(row * w, 32)
            words[:, word] |= part[:, row] << np.uint32(shift)
            if shift + w > 32:
                words[:, word + 1] |= part[:, row] >> np.uint32(32 - shift)
        _place(out, starts[chosen] + HEAD.itemsize, words.reshape(len(chosen), -1).view(np.uint8))
    if len(at_block):
        first = (starts + HEAD.itemsize + packed_size)[at_block]
        k = _within(exceptions)
        _place(out, first + 2 * k, at_place.astype("<u2").view(np.uint8).reshape(-1, 2))
        _place(out, first + 2 * exceptions[at_block] + 4 * k, over[at_block, at_place].astype("<u4").view(np.uint8).reshape(-1, 4))
    return out, starts.astype(np.uint64)


def unpack(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The values of the blocks that begin at ``starts``, in that order."""
    starts = starts.astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    head = _take(data, starts, HEAD.itemsize).view(HEAD).reshape(-1)
    width, exceptions = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    grid = np.zeros((len(starts), 32, LANES), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        chosen = np.flatnonzero(width == w)
        words = _take(data, starts[chosen] + HEAD.itemsize, w * LANES * 4).view("<u4").reshape(-1, w, LANES)
        part, mask = np.empty((len(chosen), 32, LANES), np.uint32), np.uint32((1 << w) - 1)
        for row in range(32):
            word, shift = divmod(row * w, 32)
            value = words[:, word] >> np.uint32(shift)
            if shift + w > 32:
                value = value | words[:, word + 1] << np.uint32(32 - shift)
            part[:, row] = value & mask
        grid[chosen] = part
    grid = grid.reshape(len(starts), BLOCK)
    if exceptions.any():
        at_block = np.repeat(np.arange(len(starts)), exceptions)
        first = (starts + HEAD.itemsize + width * LANES * 4)[at_block]
        k = _within(exceptions)
        place = _take(data, first + 2 * k, 2).view("<u2").reshape(-1)
        upper = _take(data, first + 2 * exceptions[at_block] + 4 * k, 4).view("<u4").reshape(-1)
        grid[at_block, place] |= upper << width[at_block].astype(np.uint32)
    grid += head["low"][:, None]
    return grid[np.arange(BLOCK) < head["count"].astype(np.int64)[:, None]]
