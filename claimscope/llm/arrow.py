"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash

ID128 = ("1", "2")


def digests(values: Iterable[bytes | str]) -> np.ndarray:
    """128-bit content identifiers, as an (n, 2) array of signed longs; the same for a value everywhere and always."""
    raw = b"".join(xxhash.xxh3_128_digest(v) for v in values)
    return np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


def list_array(flat: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
