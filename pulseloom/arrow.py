"""Arrow batches of bounded size for Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Text bytes that a Python worker unpacks at a time.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
