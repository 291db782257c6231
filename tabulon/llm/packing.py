"""Rows of packed arrays: integers in the least width that holds them, Arrow rows, buckets."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa


def ints(a: np.ndarray) -> bytes:
    """Packed unsigned integers in the least width that holds them; the first byte is the width."""
    top = int(a.max()) if len(a) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def unints(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1)


def planes(a: np.ndarray) -> bytes:
    """Four byte planes of 32-bit integers, which compress better than the integers."""
    return np.ascontiguousarray(a.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, "u1").reshape(4, -1).T).view("<u4").ravel()


def table_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))


def ddl(kinds: dict[str, pa.DataType]) -> str:
    names = {pa.string(): "string", pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int64()): "array<long>", pa.list_(pa.float64()): "array<double>"}
    return ", ".join(f"{k} {names[v]}" for k, v in kinds.items())


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def squeezed(arrays: Iterable[np.ndarray], deltas: Iterable[int] = ()) -> bytes:
    """Arrays of non-negative integers as one compressed blob: byte planes in the least width, those numbered in deltas as
    differences (modulo the width), which are small where values ascend."""
    import zstandard

    out, deltas = [], set(deltas)
    for k, a in enumerate(arrays):
        width = ints(a[:0] if not len(a) else np.array([a.max()]))[0]
        a = a.astype(f"<u{width}")
        if k in deltas:
            a = np.diff(a, prepend=np.zeros(1, a.dtype))
        out.append(len(a).to_bytes(8, "little") + bytes([width, k in deltas]) + np.ascontiguousarray(a.view("u1").reshape(-1, width).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unsqueezed(blob: bytes) -> list[np.ndarray]:
    import zstandard

    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n, width, delta = int.from_bytes(data[at : at + 8], "little"), data[at + 8], data[at + 9]
        at += 10
        a = np.ascontiguousarray(np.frombuffer(data, "u1", n * width, at).reshape(width, n).T).view(f"<u{width}").ravel()
        out.append(np.cumsum(a, dtype=a.dtype) if delta else a)
        at += n * width
    return out
