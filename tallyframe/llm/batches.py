"""Arrow batches inside tasks, with little memory at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; the memory of those before goes back to the system, as Arrow would hold on to it while the worker lives."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def slices(texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """The texts by runs of about ``most`` characters, each with the place of its first, so that a batch's pieces need little memory at once."""
    start = total = 0
    for i, n in enumerate(pc.utf8_length(texts).to_pylist()):
        total += n or 0
        if total >= most:
            yield start, texts.slice(start, i + 1 - start).to_pylist()
            start, total = i + 1, 0
    if start < len(texts):
        yield start, texts.slice(start).to_pylist()
