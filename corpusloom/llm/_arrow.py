"""Small helpers for mapInArrow functions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa


def binary_column(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Byte strings of the given sizes, laid end to end in data."""
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))]).cast(pa.binary())


def sha256(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of True."""
    step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


WORD = re.compile(r"[^\x20\x09-\x0D]+")
