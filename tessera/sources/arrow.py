"""Rows to Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa


def batches(rows: Iterable[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of up to ``size`` rows, so that many small files cost few batches and one large file little memory."""
    for part in batched(rows, size):
        yield pa.RecordBatch.from_pylist(list(part), schema)
