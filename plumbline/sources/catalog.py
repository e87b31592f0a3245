"""Opening sources: verify, derive an identity, match a record. Nothing is published if any step fails."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.jobs import Job
from plumbline.model import Bounds, PlumblineError, SpatialReference, Transform
from plumbline.sources import las
from plumbline.sources.spans import content_digest, outside, source_bounds, source_id

#: Verification policies: decode everything; trust the file's token or fail; trust it or decode everything.
FULL, FAST_ONLY, FAST_THEN_FULL = "full", "fast_only", "fast_then_full"
ORDER_RULE = "ordinal"


@dataclass(frozen=True)
class SourceRecord:
    source_id: str
    content_hash: str
    adapter: str
    version: int
    point_count: int
    offset: tuple[float, float, float]
    scale: tuple[float, float, float]
    low: tuple[float, float, float] | None
    high: tuple[float, float, float] | None
    token: str | None = None

    def as_dict(self) -> dict:
        return asdict(self)


def from_points(spark: SparkSession, rows: list[tuple], schema: str, transform: Transform | None = None) -> tuple[DataFrame, SourceRecord]:
    """An in-memory source: ticks and attributes with ordinals by position."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ordinal long, {schema}")
    return df, verify(df, transform or Transform(), "memory")


def from_columns(spark: SparkSession, table, transform: Transform, declared: dict[str, str], point_count: int, bounds: Bounds | None = None) -> tuple[DataFrame, SourceRecord]:
    """An in-memory source from an Arrow table that the caller describes: the columns' types, the number of points and, on
    request, the bounds must be those that are declared. Ordinals follow the rows."""
    if table.num_rows != point_count:
        raise PlumblineError(f"{table.num_rows} rows; {point_count} are declared")
    df = spark.createDataFrame(table.append_column("ordinal", [list(range(table.num_rows))]))
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name != "ordinal"}
    if found != declared:
        raise PlumblineError(f"the columns differ from those declared: {sorted(set(found.items()) ^ set(declared.items()))}")
    return df, verify(df, transform, "memory", declared=bounds)


def open_memory(spark: SparkSession, rows: list[tuple], schema: str, transform: Transform | None = None) -> Job:
    """from_points as a background job: full verification, which can be waited for or cancelled."""

    def run(job: Job):
        out = from_points(spark, rows, schema, transform)
        job.check()
        return out

    return Job(spark, run)


def verify(points: DataFrame, transform: Transform, adapter: str, version: int = 1, declared: Bounds | None = None, token: str | None = None) -> SourceRecord:
    """Full verification: dense ordinals from 0, world bounds, declared bounds kept, an order-dependent content hash."""
    for c in ("ordinal", "tx", "ty", "tz"):
        if c not in points.columns:
            raise PlumblineError(f"a source needs {c}")
    row = source_bounds(points, transform).first()
    facts = points.agg(F.countDistinct("ordinal").alias("d"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b"), F.count_if(F.col("tx").isNull() | F.col("ty").isNull() | F.col("tz").isNull()).alias("nulls")).first()
    n = row.point_count
    if n and (facts.d, facts.a, facts.b, facts.nulls) != (n, 0, n - 1, 0):
        raise PlumblineError("ordinals must run from 0 without gaps, and positions must not be null")
    if declared is not None and n and outside(points, transform, declared).limit(1).count():
        raise PlumblineError("a point lies outside the declared bounds")
    digest = content_digest(points, sorted(points.columns)).first()[0]
    low, high = (tuple(row[f"{m}_{a}"] for a in "xyz") if n else None for m in ("min", "max"))
    return SourceRecord(source_id(adapter, version, ORDER_RULE, digest), digest, adapter, version, n, transform.offset, transform.scale, low, high, token)


def file_token(path: str) -> str:
    s = os.stat(path)
    return f"{s.st_size}:{s.st_mtime_ns}"


def open_las(spark: SparkSession, path: str, expected: SourceRecord | None = None, policy: str = FULL) -> tuple[DataFrame, SourceRecord, SpatialReference | str | None]:
    """A LAS file as points with its record and reference. With a record, a source that changed is an error."""
    las.register(spark)
    head = las._head(path)
    df = spark.read.format("las").load(path)
    reference = las.spatial_reference(head)
    token = file_token(path)
    if expected is not None and policy in (FAST_ONLY, FAST_THEN_FULL):
        if expected.token == token:
            return df, expected, reference
        if policy == FAST_ONLY:
            raise PlumblineError("the file's token differs from the record's")
    declared = Bounds(head.low, head.high) if head.point_count else None
    found = verify(df, head.transform, "las", 1, declared, token)
    if expected is not None:
        match(expected, found)
    return df, found, reference


def match(expected: SourceRecord, found: SourceRecord) -> None:
    """Content, adapter contract, metadata and id must all agree."""
    a, b = expected.as_dict() | {"token": None}, found.as_dict() | {"token": None}
    if a != b:
        raise PlumblineError(f"the source changed: {sorted(k for k in a if a[k] != b[k])}")
