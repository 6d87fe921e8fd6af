"""What the training-data operators share: token hashing over Arrow batches, vector decoding, slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles; only memory depends on it.
SLICE_BYTES = 4 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``limit`` characters each; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and (held + n > limit or i - start >= 32_768):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def word_bytes(underscore: bool) -> np.ndarray:
    """Which bytes of lower-cased UTF-8 text belong to a word."""
    table = np.zeros(256, dtype=bool)
    table[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
    table[ord("_")] = underscore
    return table


def token_hashes(texts: list[str | None], underscore: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, and the index of its text; null counts as empty.

    A word is a maximal run of ASCII letters and digits (and underscores) in the lower-cased text.
    """
    parts = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts)))
    inside = word_bytes(underscore)[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(inside)
    opens = first[at]
    place = np.cumsum(opens) - 1
    offset = at - begin[place]
    powers = np.empty(int(offset.max()) + 1, np.uint64)
    powers[0] = 1
    if len(powers) > 1:
        powers[1:] = np.cumprod(np.full(len(powers) - 1, 0x9E3779B97F4A7C15, np.uint64))
    letters = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    hashed = np.add.reduceat(letters[data[at]] * powers[offset], np.flatnonzero(opens))
    return mix64(hashed), np.searchsorted(ends, begin, side="right")


def decode_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a list column as float32 rows, and their positions.

    Usable: not null, exactly ``width`` elements, all finite, not all zero.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    empty = np.empty((0, width), np.float32), np.empty(0, np.int64)
    if not len(column):
        return empty
    offsets = column.offsets.to_numpy()
    right = (np.diff(offsets) == width) & ~column.is_null().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(right)
    if not len(at):
        return empty
    values = column.values.cast(pa.float32()).to_numpy(zero_copy_only=False)
    rows = values[offsets[at][:, None] + np.arange(width)].astype(np.float32)
    good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    return rows[good] + np.float32(0), at[good]


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Rows of a contiguous matrix as a binary column."""
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def ragged_binary(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of ``flat``, ``counts`` long, as a binary column."""
    flat = np.ascontiguousarray(flat)
    offsets = np.concatenate([[0], np.cumsum(counts)]) * flat.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def from_binary(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column without nulls end to end, and how many each row has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    size = np.dtype(dtype).itemsize
    return raw.view(dtype) if raw.ctypes.data % size == 0 else np.frombuffer(raw.tobytes(), dtype), np.diff(offsets) // size
