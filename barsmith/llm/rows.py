"""Running a function over whole texts, batch by batch, beside the rows they belong to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Rows handed to the function at a time, so that what it builds for them stays small.
TOGETHER = 256


def with_vector(docs: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """(row struct of all columns, vector array<double>): ``make()`` runs once a task and gives the function.

    A null text is passed on as the empty text. Columns ride along in the struct, so no name can clash.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = StructType([StructField("row", rows.schema["row"].dataType), StructField("vector", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for i in range(0, len(batch), TOGETHER):
                part = batch.slice(i, TOGETHER)
                row = part.column(0)
                texts = [t or "" for t in row.field(text).to_pylist()] if row.offset == 0 else [t or "" for t in row.flatten()[row.type.get_field_index(text)].to_pylist()]
                vector = pa.array(function(texts), pa.list_(pa.float64()))
                yield pa.record_batch([row, vector], names=["row", "vector"])

    return rows.mapInArrow(run, schema)
