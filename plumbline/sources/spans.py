"""Ordinal spans: union, reads, projections, and the checks on a verified source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.model import Bounds, PlumblineError, Transform
from plumbline.runtime import materialize


def normalize_spans(spans: DataFrame) -> DataFrame:
    """Unites half-open spans (first_ordinal, point_count) that overlap or touch: (first_ordinal, point_count), disjoint.

    Range partitions are swept each on its own; a row for each partition carries how far the ones before it reach, and how
    many islands they began.
    """
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = spans.where("point_count > 0").select("first_ordinal", (F.col("first_ordinal") + F.col("point_count")).alias("end"))
    s = materialize(s.repartitionByRange(n, "first_ordinal").select(F.spark_partition_id().alias("part"), "first_ordinal", "end"), "spans")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    carried = s.groupBy("part").agg(F.max("end").alias("top")).select("part", F.max("top").over(earlier).alias("carried"))
    order = Window.partitionBy("part").orderBy("first_ordinal", "end")
    reach = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), "carried")
    s = s.join(F.broadcast(carried), "part").withColumn("fresh", F.when(F.col("first_ordinal") <= reach, 0).otherwise(1))
    s = s.withColumn("begun", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = s.groupBy("part").agg(F.sum("fresh").alias("own")).select("part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"))
    return s.join(F.broadcast(before), "part").groupBy((F.col("begun") + F.col("before")).alias("island")).agg(F.min("first_ordinal").alias("first_ordinal"), F.max("end").alias("end")).select("first_ordinal", (F.col("end") - F.col("first_ordinal")).alias("point_count"))


def check_spans(spans: list[tuple[int, int]], point_count: int, limit: int = 1_048_576) -> list[tuple[int, int]]:
    """Sorted, united spans of a bounded request; out of range or over the limit is an error."""
    if len(spans) > limit:
        raise PlumblineError(f"{len(spans)} spans; the limit is {limit}")
    out: list[list[int]] = []
    for first, count in sorted(spans):
        if first < 0 or count <= 0 or first + count > point_count:
            raise PlumblineError(f"span {first}+{count} leaves the source's {point_count} points")
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], first + count)
        else:
            out.append([first, first + count])
    return [(a, b - a) for a, b in out]


def read_spans(points: DataFrame, spans: list[tuple[int, int]], columns: list[str] | None = None) -> DataFrame:
    """The points of the spans; range predicates on ordinal reach the scan. Unknown columns are an error."""
    if columns is not None:
        if missing := set(columns) - set(points.columns):
            raise PlumblineError(f"no such attributes: {sorted(missing)}")
        points = points.select("ordinal", *sorted(set(columns) - {"ordinal"}))
    inside = F.lit(False)
    for first, count in spans:
        inside = inside | ((F.col("ordinal") >= first) & (F.col("ordinal") < first + count))
    return points.where(inside)


def coverage(points: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """One row: expected and found points, distinct ordinals, and whether they tile the spans."""
    expected = sum(c for _, c in spans)
    return read_spans(points, spans).agg(F.lit(expected).cast("long").alias("expected"), F.count("*").alias("found"), F.countDistinct("ordinal").alias("distinct_ordinals")).withColumn(
        "complete", (F.col("found") == F.col("expected")) & (F.col("distinct_ordinals") == F.col("expected"))
    )


def source_bounds(points: DataFrame, transform: Transform) -> DataFrame:
    """Tick extremes by aggregation, then world coordinates of the extremes."""
    ticks = points.agg(*[f(a).alias(f"{n}_{a}") for a in ("tx", "ty", "tz") for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("point_count"))
    world = [transform.column(i, f"{n}_t{a}").alias(f"{n}_{a}") for i, a in enumerate("xyz") for n in ("min", "max")]
    return ticks.select("point_count", *world)


def outside(points: DataFrame, transform: Transform, bounds: Bounds) -> DataFrame:
    """Points beyond the declared bounds; a verified source has none."""
    return points.where(~bounds.contains(*[transform.column(i) for i in range(3)]))


#: Attributes that one projection may name; rows of one batch at most.
MAX_ATTRIBUTES, QUANTUM = 4096, 4096


def batch_points(schema, count: int, max_bytes: int) -> int:
    """Points of one batch: no more than there are, than QUANTUM, or than the bytes allow; a budget below one row is an error."""
    width = sum({"long": 8, "bigint": 8, "double": 8, "int": 4, "float": 4, "smallint": 2, "tinyint": 1}.get(f.dataType.simpleString(), 16) for f in schema.fields)
    if max_bytes < width:
        raise PlumblineError(f"{max_bytes} bytes are less than a row's {width}")
    return max(1, min(count, QUANTUM, max_bytes // width))


def slice_batch(batch, start: int, stop: int):
    """(first ordinal, rows) of a part of a batch whose ordinals are consecutive; a range beyond it is an error."""
    if not 0 <= start < stop <= batch.num_rows:
        raise PlumblineError(f"rows {start} to {stop} of a batch of {batch.num_rows}")
    part = batch.slice(start, stop - start)
    return part.column("ordinal")[0].as_py(), part


class Pull:
    """A scan of spans, batch by batch in ordinal order. Every batch is held against the schema, the ordinals that are due and
    the budget; after the first error nothing more comes."""

    def __init__(self, points: DataFrame, spans: list[tuple[int, int]], columns: list[str] | None = None, max_bytes: int = 1 << 20):
        if columns is not None and len(columns) > MAX_ATTRIBUTES:
            raise PlumblineError(f"more than {MAX_ATTRIBUTES} attributes")
        rows = read_spans(points, spans, columns)
        self.names, self.due, self.error = rows.columns, (o for first, n in spans for o in range(first, first + n)), None
        self.most = batch_points(rows.schema, sum(n for _, n in spans) or 1, max_bytes)
        self.batches = ordered_batches(rows, "ordinal", self.most)

    def next(self):
        """The next batch as an Arrow table, or None at the end."""
        if self.error:
            return None
        try:
            batch = next(self.batches, None)
            if batch is None:
                if next(self.due, None) is not None:
                    raise PlumblineError("the source ends before its spans")
                return None
            if batch.column_names != self.names or batch.num_rows > self.most:
                raise PlumblineError("a batch of another shape")
            if any(o != next(self.due, None) for o in batch.column("ordinal").to_pylist()):
                raise PlumblineError("the batch's ordinals aren't those that are due")
            return batch
        except Exception as error:
            self.error = error
            raise


def ordered_batches(df: DataFrame, key: str, rows: int = 65_536):
    """Rows in order of a key as Arrow batches of at most so many rows; one partition at a time comes to the driver."""
    import pyarrow as pa

    batch: list = []
    schema = None
    for row in df.repartitionByRange(F.col(key)).sortWithinPartitions(key).toLocalIterator():
        batch.append(row)
        if len(batch) == rows:
            yield (out := pa.Table.from_pylist([r.asDict() for r in batch], schema))
            schema, batch = out.schema, []
    if batch:
        yield pa.Table.from_pylist([r.asDict() for r in batch], schema)


def content_digest(points: DataFrame, columns: list[str], chunk: int = 4096) -> DataFrame:
    """An order-dependent digest that doesn't depend on partitions: rows by ordinal in chunks, then chunk digests in order.

    A chunk of rows is bounded; the last step sees 64 characters for each chunk of 4096 rows, in blocks of 4096 chunks.
    """
    level = points.select("ordinal", F.concat(*[framed(c) for c in columns]).alias("text"))
    rows = F.array_sort(F.collect_list(F.struct("ordinal", framed("text").alias("text"))))
    digest = F.sha2(F.array_join(F.transform("rows", lambda r: r.text), "").cast("binary"), 256)
    for _ in range(3):  # 4096^3 rows
        level = level.groupBy(F.expr(f"ordinal div {chunk}").alias("up")).agg(rows.alias("rows")).select(F.col("up").alias("ordinal"), digest.alias("text"))
    return level.agg(rows.alias("rows")).select(digest.alias("content_hash"))


def framed(column: str) -> Column:
    """A value's bytes after their number, so that neither values nor rows run into one another; a null is ~."""
    text = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def source_id(adapter: str, version: int, order_rule: str, content_hash: str) -> str:
    import hashlib

    return hashlib.sha256(f"plumbline-source|{adapter}|{version}|{order_rule}|{content_hash}".encode()).hexdigest()
