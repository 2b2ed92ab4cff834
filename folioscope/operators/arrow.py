"""Texts in Arrow batches: bounded pieces, keys of any type, and the batch limits of the session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

Rows = Callable[[str], list[tuple]]


def pieces(batches: Iterator[pa.RecordBatch], text: str, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about so many characters at most; a longer text stands alone."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch[text]).fill_null(0).to_numpy(zero_copy_only=False), np.int64))
        at = 0
        while at < len(ends):
            held = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, held + chars, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def small_batches(df: DataFrame) -> DataFrame:
    """df; the session's Arrow batches are bounded from now on, so that long texts don't pile up in one. Spark reads these
    settings when a query runs, which is after this call; they are lowered only."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 16 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        held = conf.get(name).lower()
        if not held.isdigit() or not 0 < int(held) <= most:
            conf.set(name, most)
    return df


def exploded(df: DataFrame, key: str, text: str, columns: str, rows_of: Rows) -> DataFrame:
    """(key, columns): a row for each tuple that rows_of gives for a row's text; texts that are null are left out.
    columns: a schema as in "ord int, label string"."""
    small = small_batches(df).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter("text is not null")
    made = StructType.fromDDL(columns)
    kinds, names = [f.dataType for f in made.fields], made.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = [to_arrow_type(k) for k in kinds]
        for batch in pieces(batches, "text"):
            found = [rows_of(t) for t in batch["text"].to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            flat = [r for x in found for r in x]
            yield pa.RecordBatch.from_arrays([batch["key"].take(at), *(pa.array([r[k] for r in flat], kind) for k, kind in enumerate(arrow))], ["key", *names])

    kind = small.schema["key"].dataType.simpleString()
    return small.mapInArrow(run, f"key {kind}, {columns}").withColumnRenamed("key", key)
