"""Arrow batches as Python values, a few rows at a time: a batch has ten thousand rows, and whole texts or files of these as objects at once are hundreds of megabytes a worker."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows that are Python objects at once.
ROWS = 256


def rows(columns: list[pa.Array] | tuple[pa.Array, ...]) -> Iterator[list[tuple]]:
    """The rows of columns of equal length, in lists of at most ROWS."""
    for lo in range(0, len(columns[0]), ROWS):
        yield list(zip(*(c.slice(lo, ROWS).to_pylist() for c in columns), strict=True))
