"""Arrow list columns as matrices, inside tasks, and blocks of rows that are shuffled as one value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows, and bytes of their vectors, that are packed into one value.
PACK_ROWS, PACK_BYTES = 4096, 1 << 20
#: Bytes of vectors that are gathered before they are dealt to groups, so that a group gets long blocks.
GATHER_BYTES = 16 << 20


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an equal-length numeric list column as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    values = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    n = len(column)
    if n == 0:
        return values.reshape(0, 0)
    if len(values) % n or column.null_count:
        raise ValueError("vectors of one table must have the same length")
    return values.reshape(n, len(values) // n)


def values(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """As ``matrix``, in single precision where the column is."""
    kind = column.type.value_type
    return matrix(column) if kind != pa.float32() else matrix(column).astype("float32")


def gathered(batches: Iterator[pa.RecordBatch], vec: str) -> Iterator[pa.Table]:
    """Batches put together until their vectors come to ``GATHER_BYTES``."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(batch.schema.get_field_index(vec)).nbytes
        if size >= GATHER_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def packed(keys: list[np.ndarray], src: np.ndarray, numbers: list[np.ndarray], x: np.ndarray) -> Iterator[tuple[list, int, bytes]]:
    """(values of the keys, rows, body) of blocks of the rows ``src`` that have the same ``keys``. A body holds whole
    ``numbers`` of every row, one column after the other, then its vector out of ``x``."""
    order = np.lexsort((src, *keys[::-1]))
    sorted_keys, src = [k[order] for k in keys], src[order]
    fresh = np.zeros(len(src), bool)
    fresh[:1] = True
    for k in sorted_keys:
        fresh[1:] |= k[1:] != k[:-1]
    starts = np.r_[np.flatnonzero(fresh), len(src)]
    step = max(1, min(PACK_ROWS, PACK_BYTES // max(1, x.shape[1] * x.itemsize)))
    for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
        for at in range(start, stop, step):
            rows = src[at : min(stop, at + step)]
            yield [k[at] for k in sorted_keys], len(rows), b"".join([*(c[rows].tobytes() for c in numbers), x[rows].tobytes()])


def block_batches(blocks: Iterator[tuple[list, int, bytes]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Packed blocks ``(*keys, n, body)`` in batches of about ``PACK_BYTES``."""
    held, size = [], 0
    for keys, n, body in blocks:
        held.append((*keys, n, body))
        size += len(body)
        if size >= PACK_BYTES:
            yield pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)


def unpacked(rows: pa.Array | pa.ChunkedArray, bodies: pa.Array | pa.ChunkedArray, numbers: int, dtype: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The whole numbers of packed blocks, a column each, and their vectors."""
    found, parts = [[] for _ in range(numbers)], []
    for n, body in zip(rows.to_pylist(), bodies):
        buffer = body.as_buffer()
        for k in range(numbers):
            found[k].append(np.frombuffer(buffer, "int64", n, 8 * n * k))
        parts.append(np.frombuffer(buffer, dtype, -1, 8 * n * numbers).reshape(n, -1))
    if not parts:
        return [np.zeros(0, "int64") for _ in range(numbers)], np.zeros((0, 1))
    return [np.concatenate(c) for c in found], np.concatenate(parts)
