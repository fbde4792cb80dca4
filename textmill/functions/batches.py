"""Arrow batches in small pieces: besides the batch that Spark hands over (64 MB by its own setting), a task's Python
holds a few MB of text, however many rows the task has."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text, and rows, that are worked on or handed back at a time; a longer text is a piece of its own.
PIECE, ROWS = 1 << 21, 1_024
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def pieces(columns: Sequence[pa.Array]) -> Iterator[list[pa.Array]]:
    """Columns of one length in slices of about PIECE bytes of text."""
    n = len(columns[0])
    size = np.zeros(n, np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(size), 0
    while at < n:
        before = total[at - 1] if at else 0
        end = max(at + 1, min(at + ROWS, int(np.searchsorted(total, before + PIECE, "right"))))
        yield [c.slice(at, end - at) for c in columns]
        at = end


def flat_map(rows: DataFrame, make: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The tuples that make(*values) gives for each row; row-local. Types of the schema that ARROW lacks are those of
    the column of that name in rows."""
    fields = [f.split() for f in schema.split(",")]

    def run(batches):
        for batch in batches:
            target = pa.schema([(name, ARROW[kind] if kind in ARROW else batch.schema.field(name).type) for name, kind in fields])
            pack = lambda out, to=target: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), to)], schema=to)
            out, size = [], 0
            for part in pieces(batch.columns):
                for values in zip(*(c.to_pylist() for c in part)):
                    for row in make(*values):
                        out.append(row)
                        size += sum(len(x) for x in row if isinstance(x, str))
                        if size >= PIECE or len(out) >= ROWS:
                            yield pack(out)
                            out, size = [], 0
            if out:
                yield pack(out)

    return rows.mapInArrow(run, schema)


def udf(make: Callable[..., pa.Array], kind: str = "string"):
    """A column function of make(*lists), called for each piece: as many values as the lists have."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in pieces(batch if isinstance(batch, tuple) else (batch,)):
                yield make(*(c.to_pylist() for c in part))

    return run
