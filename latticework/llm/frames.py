"""Small helpers shared by the operators: appended Arrow columns and unique names."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Batches = Iterator[pa.RecordBatch]
#: Bytes of a batch that are worked on and handed back at once.
SLICE_BYTES = 4 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def fields(ddl: str) -> list[T.StructField]:
    return T._parse_datatype_string(ddl).fields  # type: ignore[attr-defined]


def slices(batch: pa.RecordBatch) -> Batches:
    """The batch in runs of rows of about ``SLICE_BYTES``."""
    rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def release() -> None:
    """Give freed memory back to the system: Python workers live on into other stages, beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def append_columns(df: DataFrame, ddl: str, make: Callable[[pa.RecordBatch], list], without: Sequence[str] = ()) -> DataFrame:
    """``df`` with the columns of ``ddl``, made from runs of rows of each Arrow batch; columns of the same names are replaced, those of ``without`` left out."""
    new = fields(ddl)
    names = {f.name for f in new} | set(without)
    old = [i for i, f in enumerate(df.schema.fields) if f.name not in names]
    schema = T.StructType([df.schema.fields[i] for i in old] + new)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch):
                arrays = [part.column(i) for i in old] + [pa.array(x) if not isinstance(x, pa.Array) else x for x in make(part)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])
            release()

    return df.mapInArrow(run, schema)


def standard(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, as ``doc_id`` and ``text``; every other column is left out."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
