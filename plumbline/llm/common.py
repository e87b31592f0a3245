"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.runtime import ship

#: The white space of all text contracts here.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"
BITMAP_BITS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def append_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list]]]) -> DataFrame:
    """Add Arrow-computed columns to every row; columns of the same names are replaced.

    fn yields each batch with one list or array for each of the fields.
    """
    ship(df.sparkSession)
    names = [f.name for f in fields]
    keep = [i for i, c in enumerate(df.columns) if c not in names]
    schema = T.StructType([df.schema.fields[i] for i in keep] + fields)
    kinds = [arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, extra in fn(batches):
            arrays = [batch.column(i) for i in keep] + [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(extra, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def words_of(text: str | F.Column) -> F.Column:
    """The array of words of a text column; null and blank texts have none."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.trim(c, F.lit(WS_CHARS)), WS_CLASS + "+")
    return F.when(c.isNull() | (parts[0] == ""), F.array().cast("array<string>")).otherwise(parts)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of BITMAP_BITS over the column h: what it lacks is not in the column."""
    bits = np.zeros(BITMAP_BITS // 64, np.int64)
    bit = F.expr(f"h & {BITMAP_BITS - 1}L")
    words = hashes.select(bit.alias("bit")).select(F.expr("bit div 64").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bits[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return bits.view(np.uint8)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = (hashes & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
