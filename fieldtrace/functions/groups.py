"""Groups of rows that lie behind one another in the batches of a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def whole_groups(answered: Callable) -> Callable:
    """``answered`` for rows of whole groups, in the order of groups; ``_i`` is 1 where one begins."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            starts = np.flatnonzero(b.column("_i").to_numpy() == 1)
            if len(starts):  # the group that begins last may go on in the next batch
                held.append(b.slice(0, starts[-1]))
                if sum(h.num_rows for h in held):
                    yield from answered(pa.Table.from_batches(held).combine_chunks())
                b, held = b.slice(starts[-1]), []
            held.append(b)
        if held:
            yield from answered(pa.Table.from_batches(held).combine_chunks())

    return streamed
