"""Revisioned workspaces: snapshots over sparse overlays, commits, reverts, audits; tables in one folder.

Layout: revision_rows/seq=N (ordinal, before, after), revisions.jsonl and operations/<id>.json. A commit stages its rows,
renames the folder, then records the revision; an operation's file is created once, so a retry finds what it decided.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import Bounds, PlumblineError, Transform
from plumbline.sources.spans import content_digest, read_spans


def overlay(revision_rows: DataFrame, seq: int) -> DataFrame:
    """(ordinal, value): the last change up to a revision. max_by combines before the shuffle."""
    return revision_rows.where(F.col("seq") <= seq).groupBy("ordinal").agg(F.max_by("after", "seq").alias("value"))


def snapshot(points: DataFrame, revision_rows: DataFrame, seq: int) -> DataFrame:
    """The points with the classification that holds at a revision: an as-of join on ordinal."""
    return points.join(overlay(revision_rows, seq), "ordinal", "left").withColumn("classification", F.coalesce("value", "classification")).drop("value")


def snapshot_spans(points: DataFrame, revision_rows: DataFrame, seq: int, spans: list[tuple[int, int]]) -> DataFrame:
    """The part of a snapshot that some spans cover. Both sides get the spans' ranges, so that overlay files whose ordinals
    lie elsewhere are skipped by their statistics."""
    return snapshot(read_spans(points, spans), read_spans(revision_rows, spans), seq)


def query(rows: DataFrame, transform: Transform, bounds: Bounds | None = None, classification: int | None = None) -> DataFrame:
    """All rows in the box (closed) and of the class; either may be left out. Complete, never cut."""
    if bounds is not None:
        rows = rows.where(bounds.contains(*[transform.column(i) for i in range(3)]))
    return rows if classification is None else rows.where(F.col("classification") == classification)


def summary(rows: DataFrame, candidates: int | None = None) -> DataFrame:
    """Counts, extremes and an order-free check of a query's rows."""
    return rows.agg(F.lit(candidates).cast("long").alias("candidate_count"), F.count("*").alias("exact_count"), F.sum("ordinal").alias("ordinal_sum"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))


def select_ids(points: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """The points of an explicit id list; a foreign id or too many ids are an error, not a shorter result."""
    ids = ids.select("ordinal").distinct()
    if limit is not None and ids.limit(limit + 1).count() > limit:
        raise PlumblineError(f"more than {limit} ids")
    if ids.join(points, "ordinal", "left_anti").limit(1).count():
        raise PlumblineError("an id is not of this source")
    return points.join(ids, "ordinal", "left_semi")


def confirm_pick(rows: DataFrame, ordinal: int, transform: Transform) -> DataFrame:
    return rows.where(F.col("ordinal") == ordinal).select("ordinal", "tx", "ty", "tz", *transform.columns(), "classification")


def id_spans(ids: DataFrame) -> DataFrame:
    """Runs of consecutive ordinals: (first_ordinal, point_count).

    A run starts where the ordinal before is missing and ends where the next is: two anti-joins and a nearest match by
    position within blocks, so no window spans the table.
    """
    from pyspark.sql import Window

    ids = ids.select("ordinal").distinct()
    block = F.expr("ordinal div 65536")
    w = Window.partitionBy("block").orderBy("ordinal")
    runs = ids.withColumn("block", block).withColumn("run", F.col("ordinal") - F.row_number().over(w)).groupBy("block", "run").agg(F.min("ordinal").alias("first_ordinal"), F.count("*").alias("point_count"))
    from plumbline.sources.spans import normalize_spans

    return normalize_spans(runs)  # runs, not ids, meet there


def changes(rows: DataFrame, value: int) -> DataFrame:
    """What setting a class changes: rows already at the value drop out."""
    return rows.where(F.col("classification") != value).select("ordinal", F.col("classification").cast("long").alias("before"), F.lit(value).cast("long").alias("after"))


def reverted(revision: DataFrame) -> DataFrame:
    return revision.select("ordinal", F.col("after").alias("before"), F.col("before").alias("after"))


def transitions(revision: DataFrame) -> DataFrame:
    return revision.groupBy("before", "after").agg(F.count("*").alias("points"))


def footprint(revision: DataFrame, points: DataFrame, transform: Transform) -> DataFrame:
    """World bounds of the changed points; nulls if there are none."""
    world = revision.select("ordinal").join(points, "ordinal").select(*transform.columns())
    return world.agg(F.count("*").alias("points"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def rows_check() -> Column:
    """A check of a revision's rows that doesn't depend on their order."""
    return F.coalesce(F.bit_xor(F.xxhash64("ordinal", "before", "after")), F.lit(0))


def chained(before: str, body: dict) -> str:
    return hashlib.sha256((before + json.dumps(body, sort_keys=True)).encode()).hexdigest()


def root_revision(source_id: str) -> str:
    return hashlib.sha256(f"root|{source_id}".encode()).hexdigest()


@dataclass(frozen=True)
class Outcome:
    state: str  # committed, rejected or indeterminate
    seq: int | None = None
    reason: str | None = None


class Workspace:
    """A linear chain of revisions over a source. The folder must be one that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, points: DataFrame, source_id: str = "source", transform: Transform = Transform()):
        self.transform = transform
        self.spark, self.root, self.points, self.source_id, self._torn = spark, root, points, source_id, 0
        self._lock = None

    @classmethod
    def create(cls, spark: SparkSession, root: str, points: DataFrame, source_id: str = "source", transform: Transform = Transform()) -> Workspace:
        os.makedirs(os.path.join(root, "operations"), exist_ok=False)
        with open(os.path.join(root, "manifest.json"), "x") as f:
            json.dump({"source": source_id, "root": root_revision(source_id)}, f)
        made = cls(spark, root, points, source_id, transform)
        made.lock()
        return made

    @classmethod
    def open(cls, spark: SparkSession, root: str, points: DataFrame, transform: Transform = Transform()) -> Workspace:
        """Takes the workspace's lock, checks the manifest, the chain and that the rows of every revision are there in the
        recorded number; anything amiss is an error, and nothing is repaired but a torn last line."""
        with open(os.path.join(root, "manifest.json")) as f:
            held = json.load(f)
        found = cls(spark, root, points, held["source"], transform)
        if held.get("root") != root_revision(found.source_id):
            raise PlumblineError("the manifest is damaged")
        chain = found.revisions()
        if [r["seq"] for r in chain] != list(range(1, len(chain) + 1)):
            raise PlumblineError("the revision chain has a gap")
        counts = {r.seq: (r.n, r.h) for r in found.rows().groupBy("seq").agg(F.count("*").alias("n"), rows_check().alias("h")).collect()}  # a row for each revision
        if bad := [r["seq"] for r in chain if counts.get(r["seq"]) != (r["changed_points"], r["rows_check"])]:
            raise PlumblineError(f"the rows of revision {bad[0]} are damaged")
        found.lock()
        return found

    def lock(self) -> None:
        """One holder at a time: the file is created only once. A holder that died leaves it; unlock(root) removes it."""
        try:
            self._lock = os.open(os.path.join(self.root, "lock"), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            raise PlumblineError("the workspace is locked") from None
        os.write(self._lock, f"{os.getpid()}\n".encode())

    def close(self) -> None:
        if self._lock is not None:
            os.close(self._lock)
            self._lock = None
            os.remove(os.path.join(self.root, "lock"))

    @staticmethod
    def unlock(root: str) -> None:
        """Removes the lock of a holder that is known to have ended."""
        os.remove(os.path.join(root, "lock"))

    def revisions(self) -> list[dict]:
        path = os.path.join(self.root, "revisions.jsonl")
        if not os.path.exists(path):
            return []
        with open(path, "rb") as f:
            lines = f.read().split(b"\n")
        torn = lines.pop()  # what a crash cut off before its line end; never acknowledged
        out: list[dict] = []
        for line in lines:
            try:
                held = json.loads(line)
                body = {k: v for k, v in held.items() if k != "digest"}
                sound = held["digest"] == chained(out[-1]["digest"] if out else "", body)
            except (ValueError, KeyError, TypeError):
                sound = False
            if not sound:
                raise PlumblineError(f"revision line {len(out) + 1} is damaged")
            out.append(held)
        if torn:
            self._torn = len(torn)
        return out

    def head(self) -> int:
        return max((r["seq"] for r in self.revisions()), default=0)

    def rows(self) -> DataFrame:
        if not self.head():
            return self.spark.createDataFrame([], "ordinal long, before long, after long, seq long")
        return self.spark.read.schema("ordinal long, before long, after long, seq long").parquet(os.path.join(self.root, "revision_rows")).where(F.col("seq") <= self.head())

    def snapshot(self, seq: int | None = None) -> DataFrame:
        seq = self.head() if seq is None else seq
        if not 0 <= seq <= self.head():
            raise PlumblineError(f"no revision {seq}")
        return snapshot(self.points, self.rows(), seq)

    def revision(self, seq: int) -> DataFrame:
        return self.rows().where(F.col("seq") == seq).drop("seq")

    def _operation(self, operation: str) -> dict | None:
        path = os.path.join(self.root, "operations", f"{operation}.json")
        if not os.path.exists(path):
            return None
        with open(path) as f:
            return json.load(f)

    def _record(self, operation: str, digest: str, **facts) -> None:
        path = os.path.join(self.root, "operations", f"{operation}.json")
        with open(path + ".new", "w") as f:
            json.dump({"digest": digest, **facts}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(path + ".new", path)

    def resolve(self, operation: str) -> Outcome:
        held = self._operation(operation)
        if held is None:
            return Outcome("not recorded")
        if held["state"] == "ready":
            return Outcome("retryable", held["seq"])
        return Outcome(held["state"], held.get("seq"), held.get("reason"))

    def _existing(self, operation: str, digest: str) -> Outcome | None:
        held = self._operation(operation)
        if held is None:
            return None
        if held["digest"] != digest:
            return Outcome("rejected", reason="OperationConflict")
        return self.retry(operation) if held["state"] == "ready" else Outcome(held["state"], held.get("seq"), held.get("reason"))

    def _reject(self, operation: str, digest: str, reason: str) -> Outcome:
        self._record(operation, digest, state="rejected", reason=reason)
        return Outcome("rejected", reason=reason)

    def set_classification(self, operation: str, points: DataFrame, value: int, expected_head: int, source_id: str | None = None, max_points: int | None = None) -> Outcome:
        """Checks in order: known operation, foreign set, stale head, limit, nothing to change."""
        ids = points.select("ordinal").distinct()
        facts = [value, expected_head, source_id, max_points, ids.count(), content_digest(ids, ["ordinal"]).first()[0]]
        digest = hashlib.sha256(json.dumps(["set", *facts]).encode()).hexdigest()
        if found := self._existing(operation, digest):
            return found
        if source_id not in (None, self.source_id):
            return self._reject(operation, digest, "ForeignPointSet")
        if expected_head != self.head():
            return self._reject(operation, digest, "StaleHead")
        rows = changes(self.snapshot().join(ids, "ordinal", "left_semi"), value)
        return self._commit(operation, digest, rows, {"kind": "set", "value": value}, max_points)

    def revert_head(self, operation: str, expected_head: int) -> Outcome:
        digest = hashlib.sha256(f"revert|{expected_head}".encode()).hexdigest()
        if found := self._existing(operation, digest):
            return found
        if expected_head != self.head():
            return self._reject(operation, digest, "StaleHead")
        if not self.head():
            return self._reject(operation, digest, "RootNotRevertible")
        return self._commit(operation, digest, reverted(self.revision(self.head())), {"kind": "revert", "reverts": self.head()}, None)

    def _commit(self, operation: str, digest: str, rows: DataFrame, facts: dict, max_points: int | None) -> Outcome:
        seq = self.head() + 1
        staging = os.path.join(self.root, f"staging-{operation}")
        rows.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.mode("overwrite").parquet(staging)
        count, check = self.spark.read.schema("ordinal long, before long, after long").parquet(staging).agg(F.count("*"), rows_check()).first()
        if not count:
            return self._reject(operation, digest, "NoChanges")
        if max_points is not None and count > max_points:
            return self._reject(operation, digest, "LimitExceeded")
        self._record(operation, digest, state="ready", seq=seq, facts=facts | {"changed_points": count, "rows_check": check})
        return self.retry(operation)

    def retry(self, operation: str) -> Outcome:
        """Finishes a commit that was staged and recorded as ready; doesn't need the original point set."""
        held = self._operation(operation)
        if held is None or held["state"] != "ready":
            return self.resolve(operation)
        seq, target = held["seq"], os.path.join(self.root, "revision_rows", f"seq={held['seq']}")
        staging = os.path.join(self.root, f"staging-{operation}")
        if self.head() >= seq and not any(r["seq"] == seq and r["operation"] == operation for r in self.revisions()):
            return self._reject(operation, held["digest"], "StaleHead")
        try:
            if os.path.exists(staging):
                os.makedirs(os.path.dirname(target), exist_ok=True)
                os.rename(staging, target)
            if not any(r["seq"] == seq for r in self.revisions()):
                known = self.revisions()
                path = os.path.join(self.root, "revisions.jsonl")
                if self._torn:
                    os.truncate(path, os.path.getsize(path) - self._torn)
                    self._torn = 0
                body = {"seq": seq, "parent": seq - 1, "operation": operation, **held["facts"]}
                with open(path, "a") as f:
                    f.write(json.dumps(body | {"digest": chained(known[-1]["digest"] if known else "", body)}) + "\n")
                    f.flush()
                    os.fsync(f.fileno())
        except OSError:
            return Outcome("indeterminate", seq)
        self._record(operation, held["digest"], state="committed", seq=seq, facts=held["facts"])
        return Outcome("committed", seq)
