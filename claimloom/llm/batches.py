"""Arrow helpers that keep the text held by one Python worker bounded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Bytes of text handled at once; one longer document is handled alone.
TEXT_BYTES = 2 << 20
#: Bytes of words and of what is known of them that a task remembers between slices; beyond that it starts anew.
CACHE_BYTES = 32 << 20


def _cuts(column: pa.Array, limit: int) -> list[tuple[int, int]]:
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // limit
    starts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
    return list(zip(starts, [*starts[1:], len(sizes)], strict=True))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes, whole rows only."""
    for batch in batches:
        for a, b in _cuts(batch.column(column), limit) if batch.num_rows else ():
            yield batch.slice(a, b - a)


def text_function(returns: str, start: Callable[[], Callable[[pa.Array], pa.Array]], limit: int = TEXT_BYTES):
    """A column function of one text column: ``start`` gives a task's function from a slice of texts to as many results.

    Only the text goes to Python and only the results come back; the other columns of a row
    wait in the JVM, so they may have any names.
    """

    @F.arrow_udf(returns)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        function = start()
        for t in texts:
            parts = [function(t.slice(a, b - a)) for a, b in _cuts(t, limit)] if len(t) else [function(t)]
            yield pa.concat_arrays(parts)
            pa.default_memory_pool().release_unused()

    return run


def texts(column: pa.Array) -> list[str]:
    """The column's strings, null as the empty string."""
    return column.fill_null("").to_pylist()


def remembered(words: list[str], each: int) -> int:
    """Bytes that a dictionary of these words takes, with ``each`` bytes beside every word."""
    return sum(map(len, words)) + (150 + each) * len(words)
