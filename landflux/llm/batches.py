"""Parts of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def slices(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``most`` in the sum of ``sizes``, one row at least."""
    upto = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = int(upto[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + most)))
        yield batch.slice(start, stop - start)
        start = stop
