"""Point views derived from the relational tables, so that every operator runs on them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.model import Transform
from plumbline.runtime import materialize

TRANSFORM_E = Transform((0.0, 0.0, 0.0), (1.0, 1.0, 0.01))
TRANSFORM_L = Transform((100.25, -50.5, 1000.0), (0.25, 0.5, 0.01))
LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def with_ordinals(df: DataFrame, order: list[str]) -> DataFrame:
    """Dense ordinals from 0 in a total order: range partitions, sorted, each shifted by the rows before it.

    Only a count for each partition meets in one place, never the rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    held = materialize(dealt.select(F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__row"), "*"), "ordinals")
    counts = held.groupBy("__part").count()
    before = counts.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    return held.join(F.broadcast(before), "__part").withColumn("ordinal", F.col("__before") + F.col("__row")).drop("__part", "__row", "__before")


def points_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: the id is the ordinal."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = sorted(r[0] for r in events.select("event_type").distinct().collect())  # a handful by definition
    return events.select(
        F.col("event_id").alias("ordinal"),
        F.col("user_id").cast("long").alias("tx"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)").cast("long").alias("ty"),
        F.round(F.col("value") * 100).cast("long").alias("tz"),
        (F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")) - 1).cast("long").alias("classification"),
    )


def points_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as points, ordered by all columns."""
    lines = with_ordinals(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(LINE_COLUMNS), LINE_COLUMNS)
    return lines.select(
        "ordinal",
        F.col("l_partkey").cast("long").alias("tx"),
        F.col("l_suppkey").cast("long").alias("ty"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("tz"),
        F.col("l_linenumber").cast("long").alias("classification"),
        F.col("l_quantity").cast("long").alias("intensity"),
    )


def lines_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points_l without ordinals, for operators that don't show them: no sort."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_partkey").cast("long").alias("tx"),
        F.col("l_suppkey").cast("long").alias("ty"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("tz"),
        F.col("l_linenumber").cast("long").alias("classification"),
        F.col("l_quantity").cast("long").alias("intensity"),
    )


def grid_shape(parts: int) -> tuple[int, int]:
    """Rows and columns of a full grid of so many points, as near to a square as their divisors allow."""
    rows = next(k for k in range(math.isqrt(parts), 0, -1) if parts % k == 0)
    return rows, parts // rows


def grid_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """All parts as a full grid of terrain points; its rows and columns."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows, n = grid_shape(part.count())
    points = part.select(F.col("p_partkey").alias("ordinal"), F.expr(f"p_partkey div {n}").alias("tx"), (F.col("p_partkey") % n).alias("ty"), F.round(F.col("p_retailprice") * 10).cast("long").alias("tz"))
    return points, rows, n


def synthetic_points(spark: SparkSession, n: int, width: int, first: int = 0) -> DataFrame:
    """Test terrain: n points of a grid from an ordinal on, with slopes, steps and a hash's noise. The same for any split."""
    o = F.col("id")
    noise = F.pmod(F.xxhash64(F.lit(0x5EED), o), F.lit(9)) - 4
    tx, ty = F.expr(f"id div {width}"), o % width
    return spark.range(first, first + n).select(o.alias("ordinal"), tx.alias("tx"), ty.alias("ty"), (3 * tx + 5 * ty + F.when(tx % 64 < 8, 40).otherwise(0) + noise).alias("tz"), (F.pmod(noise, F.lit(2)) * 3 + 2).cast("long").alias("classification"))


def revision_rows(points: DataFrame) -> DataFrame:
    """Three revisions of the classification: 2 where ordinal % 7 = 0, then 1 where ordinal % 11 = 0, then the second undone.

    Rows that change nothing are dropped against the value that holds at that time.
    """
    own = points.select("ordinal", F.col("classification").alias("c0"))
    c1 = F.when(F.col("ordinal") % 7 == 0, 2).otherwise(F.col("c0"))
    own = own.withColumn("c1", c1.cast("long")).withColumn("c2", F.when(F.col("ordinal") % 11 == 0, 1).otherwise(F.col("c1")).cast("long"))
    changes = F.array(*[F.struct(F.lit(s).cast("long").alias("seq"), F.col(b).alias("before"), F.col(a).alias("after")) for s, b, a in ((1, "c0", "c1"), (2, "c1", "c2"), (3, "c2", "c1"))])
    return own.select("ordinal", F.explode(changes).alias("r")).select("r.seq", "ordinal", "r.before", "r.after").where("before <> after")
