"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = column.cast(pa.large_binary())
    return [b"" if v is None else v for v in column.to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch behind one another, and the n + 1 places where they begin and end."""
    parts = text_bytes(column)
    ends = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), ends
