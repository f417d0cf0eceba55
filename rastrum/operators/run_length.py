"""Run-length codes of many masks at a time, as flat arrays.

Masks are numbered from 0; their runs (y, x0, x1) or lengths lie one mask after the other, with how many each has. A task
holds about ``ROWS`` of them at once, or one mask, which has at most height x width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS = 1_000_000


def starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each mask."""
    return np.arange(int(counts.sum()), dtype=np.int64) - np.repeat(starts(counts)[:-1], counts)


def encode(counts: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of lengths of each mask, lengths): zeros first, then ones, and so on, in row order.

    Runs may overlap, touch (also across a row end) and lie in any order; a mask without pixels is one run of zeros."""
    total = width * height
    solid = x1 > x0
    mask = np.repeat(np.arange(len(counts), dtype=np.int64), counts)[solid]
    base = mask * (total + 1)  # one number line for all masks, so one sort orders all
    a, b = base + (y * width + x0)[solid], base + (y * width + x1)[solid]
    if np.any(a[1:] < a[:-1]):
        a = np.sort(a)
    if np.any(b[1:] < b[:-1]):
        b = np.sort(b)
    # with starts and ends sorted apart, a gap follows the i-th end where the next start lies beyond it
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    edges = np.empty(2 * int(new.sum()), np.int64)
    edges[0::2], edges[1::2] = a[new], b[np.append(new[1:], True)[:len(b)]]
    twice = 2 * np.bincount(mask[new], minlength=len(counts))
    owner = np.repeat(np.arange(len(counts), dtype=np.int64), twice)
    edges -= owner * (total + 1)
    last = np.zeros(len(counts), np.int64)
    last[twice > 0] = edges[starts(twice)[1:][twice > 0] - 1]
    size = twice + (last < total)
    before = np.concatenate([np.zeros(1, np.int64), edges[:-1]])[:len(edges)]
    before[starts(twice)[:-1][twice > 0]] = 0
    lengths = np.empty(int(size.sum()), np.int64)
    lengths[np.arange(len(edges)) + (starts(size)[:-1] - starts(twice)[:-1])[owner]] = edges - before
    tail = last < total
    lengths[starts(size)[1:][tail] - 1] = total - last[tail]
    return size, lengths


def decode(counts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of runs of each mask, y, x0, x1), a run a row."""
    ends = np.cumsum(lengths, dtype=np.int64)
    ends -= np.repeat(np.concatenate([np.zeros(1, np.int64), ends])[starts(counts)[:-1]], counts)
    one = (within(counts) % 2 == 1) & (lengths > 0)
    b = ends[one]
    a = b - lengths[one]
    first = a // width
    rows = (b - 1) // width - first + 1
    y = np.repeat(first, rows) + within(rows)
    x0 = np.maximum(np.repeat(a, rows), y * width) - y * width
    x1 = np.minimum(np.repeat(b, rows), (y + 1) * width) - y * width
    owner = np.repeat(np.arange(len(counts)), counts)[one]
    return np.bincount(owner, weights=rows, minlength=len(counts)).astype(np.int64), y, x0, x1


def sliced(counts: np.ndarray, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of masks with about so many runs each."""
    s, at = starts(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(s, s[at] + (rows or ROWS), "right")) - 1)
        yield at, to
        at = to


def numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(sizes, flat values) of a column of lists."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def list_of(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts(counts).astype(np.int32)), values)


def batches(keep: list[str], sizes: Callable[[pa.RecordBatch], np.ndarray], made: Callable[[pa.RecordBatch], dict[str, pa.Array]]):
    """A function for mapInArrow: the columns ``keep`` and those ``made`` of a slice of masks."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, to in sliced(sizes(part)):
                piece = part.slice(at, to - at)
                out = made(piece)
                yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index(c)) for c in keep] + list(out.values()), names=[*keep, *out])
    return run
