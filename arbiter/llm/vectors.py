"""Vector columns as numpy matrices, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scaled entries of a larger magnitude count as not finite: their products have no place in a decimal.
LARGEST = float(1 << 56)


def scaled(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, values): the rows whose vector is whole, their lengths, and floor(scale * entry) end to end.

    A vector is whole if it is not null and holds neither nulls nor entries
    that are not finite (or too large for a long once scaled).
    """
    lists = column if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else column.cast(pa.list_(column.type.value_type))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    with np.errstate(over="ignore", invalid="ignore"):
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64) * scale
        bad = ~(np.abs(values) < LARGEST)  # NaN as well; nulls have become NaN
    if flat.null_count:
        bad |= flat.is_null().to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    before = np.concatenate([[0], np.cumsum(bad)])
    good = (np.diff(before[offsets]) == 0) & lists.is_valid().to_numpy(zero_copy_only=False)
    taken = values[np.repeat(good, lengths)]
    return np.flatnonzero(good), lengths[good], np.floor(taken).astype(np.int64)


def size_of(x: np.ndarray) -> int:
    """The largest magnitude of an integer array."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact matrix product of integer matrices: in doubles, longs or Python integers, whichever holds all partial sums."""
    most = size_of(a) * size_of(b) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64)
    return a.astype(object) @ b.astype(object)
