"""Audits of one revision: what changed, where, and digests that bind the report to the rows."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import PlumblineError, Transform
from plumbline.operators import workspace
from plumbline.sources.spans import content_digest


def revision_audit(revision: DataFrame, points: DataFrame, transform: Transform) -> DataFrame:
    """One row: changed points, the transition histogram as a sorted array, the edit footprint in world coordinates (nulls
    if nothing changed) and the digest of the changed positions. A row whose point isn't of the source is an error."""
    moved = revision.select("ordinal", "before", "after").join(points.select("ordinal", "tx", "ty", "tz"), "ordinal", "left")
    checked = moved.withColumn("tx", F.when(F.col("tx").isNull(), F.raise_error(F.lit("a changed point isn't of this source"))).otherwise(F.col("tx")))
    histogram = workspace.transitions(revision).agg(F.array_sort(F.collect_list(F.struct("before", "after", "points"))).alias("transitions"), F.coalesce(F.sum("points"), F.lit(0)).alias("changed_points"))  # at most 256 x 256 of a byte's values
    box = checked.select(*transform.columns()).agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    digest = content_digest(checked, ["ordinal", "tx", "ty", "tz"]).withColumnRenamed("content_hash", "position_hash")
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(histogram).join(one(box), "k").join(one(digest), "k").drop("k")


def report_summary(entries: DataFrame) -> DataFrame:
    """One row over the entries (project, firm, disposition) of a corpus report; an unknown disposition is an error."""
    known = ("passed", "failed", "resource_limited")
    own = F.when(F.col("disposition").isin(*known), F.col("disposition")).otherwise(F.raise_error(F.concat(F.lit("no such disposition: "), F.coalesce("disposition", F.lit("null")))))
    counts = [F.count_if(F.col("own") == k).alias(k) for k in known]
    return entries.withColumn("own", own).agg(F.count("*").alias("entries"), *counts, F.countDistinct("project").alias("projects"), F.countDistinct("firm").alias("firms"))


@dataclass(frozen=True)
class RevisionAudit:
    source_id: str
    seq: int
    operation: str | None
    kind: str
    changed_points: int
    transitions: list[tuple[int, int, int]]
    footprint: dict[str, float] | None
    position_hash: str | None

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def audit(space: workspace.Workspace, seq: int) -> RevisionAudit:
    """The report on one revision of a workspace; the root's is empty. Counts must agree with the revision's record."""
    if seq == 0:
        return RevisionAudit(space.source_id, 0, None, "root", 0, [], None, None)
    known = {r["seq"]: r for r in space.revisions()}
    if seq not in known:
        raise PlumblineError(f"no revision {seq}")
    facts = known[seq]
    row = revision_audit(space.revision(seq), space.points, space.transform).first()
    transitions = [tuple(t) for t in row.transitions]
    if row.changed_points != facts["changed_points"] or any(n < 1 or a == b for a, b, n in transitions):
        raise PlumblineError(f"the histogram of revision {seq} contradicts its record")
    box = {c: row[c] for c in row.asDict() if c[:4] in ("min_", "max_")}
    return RevisionAudit(space.source_id, seq, facts["operation"], facts["kind"], row.changed_points, transitions, box, row.position_hash)
