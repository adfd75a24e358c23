"""Integer vectors from Arrow columns, their Walsh-Hadamard transform, and an exact nearest-neighbour search on its coefficients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scaled components at or beyond this can't be held; up to SAFE all sums of squares fit 64 bits, beyond it Python's integers are used.
LARGEST, SAFE = 2**62, 2**24
#: Rows that are searched at once.
STEP = 1024


def integers(column: pa.Array, scale: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which, x): the places of the vectors that are kept and their components as floor(scale * component), exactly.

    Null vectors and those with a null or non-finite component go, and those with a scaled component of 2^62 or more; width: those of another length too. Without it, rows are as long as
    the longest and shorter ones end in zeros. x holds 64-bit integers where every square sum fits, else Python integers.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)  # a null part becomes not-a-number
        wrong = np.concatenate([[0], np.cumsum(~(np.abs(flat) < LARGEST))])
    end = np.cumsum(np.maximum(size, 0))
    start = end - np.maximum(size, 0)
    which = np.flatnonzero((size >= 0 if width is None else size == width) & (wrong[end] == wrong[start]))
    size, start = size[which], start[which]
    dim = width if width is not None else int(size.max(initial=0))
    at = np.arange(dim)
    x = np.zeros((len(which), dim))
    inside = at[None, :] < size[:, None]
    x[inside] = flat[(start[:, None] + at[None, :])[inside]]
    return which, narrowed(x)


def kept_rows(scale: int, width: int | None = None):
    """The rows of a batch whose vectors integers() keeps, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(integers(batch.column("embedding"), scale, width)[0]))

    return run


def narrowed(x: np.ndarray) -> np.ndarray:
    """Whole numbers as 64-bit integers where they are safe to square and sum, else as Python integers."""
    if not x.size or max(int(x.max()), -int(x.min())) <= SAFE:
        return x.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(x)


def padded(x: np.ndarray) -> np.ndarray:
    """x with zero columns up to a power of two."""
    return extended(x, 1 << max(0, x.shape[-1] - 1).bit_length())


def extended(x: np.ndarray, dim: int) -> np.ndarray:
    """x with zero columns up to dim, of x's own kind of integers."""
    return np.concatenate([x, np.zeros((*x.shape[:-1], dim - x.shape[-1]), x.dtype)], -1)


def transform(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis (a power of two), coefficients by the number of their sign changes. Square sums grow by the length, exactly."""
    n = x.shape[-1]
    y, h = x.copy(), 1
    while h < n:
        z = y.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        y = np.stack([z[..., 0, :] + z[..., 1, :], z[..., 0, :] - z[..., 1, :]], -2).reshape(x.shape)
        h *= 2
    return y[..., sequency(n)]


def sequency(n: int) -> np.ndarray:
    """For each number of sign changes, the natural place of the Walsh function that has it: the bits of its Gray code, reversed."""
    i = np.arange(n)
    gray, out = i ^ (i >> 1), np.zeros(n, np.int64)
    for b in range(n.bit_length() - 1):
        out |= ((gray >> b) & 1) << (n.bit_length() - 2 - b)
    return out


def nearest(w: np.ndarray, c: np.ndarray, first: int = 4, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of w the nearest row of c and the squared distance, ties to the earlier one; both are transforms of equal length, and so is the distance.

    Squared differences are summed over `first` coefficients, then over twice as many at each step. The one ahead is finished at once: its distance bounds the nearest, so an entry whose sum
    so far is greater is out for good and keeps it. Those left at the end have all coefficients. seen: gets the number of coefficient differences made.
    """
    near, far = np.zeros(len(w), np.int64), np.zeros(len(w), w.dtype)
    if w.dtype != c.dtype:
        w, c, far = w.astype(object), c.astype(object), far.astype(object)
    full = w.shape[1]
    for at in range(0, len(w), STEP):
        part = w[at : at + STEP]
        hi = min(first, full)
        d = part[:, None, :hi] - c[None, :, :hi]
        sums = (d * d).sum(2)
        made = d.size
        bound = None
        while hi < full:
            ahead = part - c[sums.argmin(1)]
            ahead = (ahead * ahead).sum(1)
            bound = ahead if bound is None else np.minimum(bound, ahead)
            lo, hi = hi, min(2 * hi, full)
            row, entry = np.nonzero(sums <= bound[:, None])
            d = part[row, lo:hi] - c[entry, lo:hi]
            sums[row, entry] += (d * d).sum(1)
            made += d.size + ahead.size
        near[at : at + STEP] = best = sums.argmin(1)
        far[at : at + STEP] = sums[np.arange(len(part)), best]
        if seen is not None:
            seen.append(made)
    return near, far


def longs(x: np.ndarray) -> pa.Array:
    """Whole numbers as a column of longs; null where one doesn't fit."""
    return pa.array(x, pa.int64()) if x.dtype != object else pa.array([int(v) if abs(v) < 2**63 else None for v in x], pa.int64())


class Sums:
    """Sums of integer vectors for each key, exact however many rows a task has."""

    def __init__(self) -> None:
        self.held: dict[tuple, list] = {}

    def add(self, key: np.ndarray, x: np.ndarray, *before: int) -> None:
        for k in np.unique(key).tolist():
            rows = x[key == k]
            n, total = self.held.get((*before, k), (0, 0))
            self.held[(*before, k)] = [n + len(rows), total + rows.sum(0).astype(object)]

    def batch(self, names: list[str]) -> pa.RecordBatch:
        """A row for each key and component: the key's columns, `at`, `total` and `n`."""
        rows = [(*k, i, int(v), n) for k, (n, total) in self.held.items() for i, v in enumerate(total)]
        cols = list(zip(*rows, strict=True)) or [[]] * (len(names) + 3)
        kinds = [pa.int32()] * (len(names) + 1) + [pa.decimal128(38, 0), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*names, "at", "total", "n"])
