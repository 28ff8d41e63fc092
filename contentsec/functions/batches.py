"""Arrow batches in parts, so that an Arrow function holds Python objects of a few values, not of a whole batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Values and bytes of a part; a larger value is a part by itself.
VALUES, BYTES = 64, 1 << 20


def _bytes(column: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def _places(columns: Iterable[pa.Array]) -> Iterator[tuple[int, int]]:
    """Start and number of the values of each part."""
    start, held, at = 0, 0, -1
    for at, sizes in enumerate(zip(*map(_bytes, columns), strict=True)):
        size = sum(sizes)
        if at > start and (at - start == VALUES or held + size > BYTES):
            yield start, at - start
            start, held = at, 0
        held += size
    if start <= at:
        yield start, at + 1 - start


def in_parts(batches: Iterator, of: Callable[..., list], kind: pa.DataType) -> Iterator[pa.Array]:
    """of(values, ...) of each part of the batches (arrays, or tuples of them), as arrays. Parts are cut by what all arrays
    of strings or bytes hold together; others don't count, and at least one must be of these."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        if not len(columns[0]):
            yield pa.array([], kind)
        for start, n in _places(c for c in columns if not pa.types.is_primitive(c.type)):
            yield pa.array(of(*(c.slice(start, n).to_pylist() for c in columns)), kind)
