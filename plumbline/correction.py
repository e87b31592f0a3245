"""The correction run: from a source over an edit to a checked, exported surface, resumable after every phase."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.model import PlumblineError, SpatialReference, Transform
from plumbline.operators import audit, surfaces, terrain, workspace
from plumbline.sources import landxml
from plumbline.workflow import PHASES, Run, ensure_report


@dataclass(frozen=True)
class Intent:
    """What a run is to do; it is fixed by the first start, and a resume must bring the same."""

    source: str  # a LAS file
    ordinals: tuple[int, ...]  # the points to reclassify
    value: int
    check_points: tuple[tuple[int, float, float, float], ...]
    below: float = 0.05
    above: float = 0.05
    cell: float = 4.0
    ground_class: int = 2
    operation: str = "correction"

    def facts(self) -> dict:
        return json.loads(json.dumps(asdict(self)))

    @classmethod
    def of(cls, facts: dict) -> Intent:
        known = dict(facts)
        known["ordinals"] = tuple(known["ordinals"])
        known["check_points"] = tuple(tuple(p) for p in known["check_points"])
        return cls(**known)


class CorrectionRun:
    """A run's folder: workspace, surfaces, the export, the journal, and audit.json at the end."""

    def __init__(self, spark: SparkSession, root: str, intent: Intent):
        self.spark, self.root, self.intent = spark, root, intent
        self.run = Run(root, "correction", intent.facts())

    @classmethod
    def start(cls, spark: SparkSession, root: str, intent: Intent) -> CorrectionRun:
        if os.path.exists(os.path.join(root, "run.json")):
            raise PlumblineError("the run exists; resume it")
        return cls(spark, root, intent)

    @classmethod
    def resume(cls, spark: SparkSession, root: str, intent: Intent | None = None) -> CorrectionRun:
        path = os.path.join(root, "run.json")
        if not os.path.exists(path):
            raise PlumblineError("there is no run to resume")
        with open(path) as f:
            held = Intent.of(json.load(f)["intent"])
        if intent is not None and intent != held:
            raise PlumblineError("the run was started with another intent")
        return cls(spark, root, held)

    def advance(self, stop_after: str | None = None) -> dict:
        """Goes on from the first phase that isn't recorded. What recorded phases left is opened again and held against the
        journal's facts, so a run whose files changed stops."""
        from plumbline.sources import catalog

        points, record, reference = catalog.open_las(self.spark, self.intent.source)
        if not isinstance(reference, SpatialReference):
            raise PlumblineError("the source has no spatial reference that a surface can be built in")
        points = points.select("ordinal", "tx", "ty", "tz", F.col("classification").cast("long").alias("classification"))
        self.transform, self.reference, self.record = Transform(record.offset, record.scale), reference, record
        folder = os.path.join(self.root, "workspace")
        opens = workspace.Workspace.open if os.path.exists(os.path.join(folder, "manifest.json")) else None
        self.space = opens(self.spark, folder, points, self.transform) if opens else workspace.Workspace.create(self.spark, folder, points, record.source_id, self.transform)
        try:
            if self.space.source_id != record.source_id:
                raise PlumblineError("the source changed since the run began")
            self._check()
            steps = {"baseline_surface": self._surface(0), "correction_committed": self._commit, "changed_surface": self._surface(1), "comparison": self._compare, "residuals": self._residuals, "export": self._export, "complete": self._complete}
            return self.run.advance(steps, stop_after)
        finally:
            self.space.close()

    def _check(self) -> None:
        held = {c.phase: c.facts for c in self.run.journal.read(repair=True)}
        for phase, seq in (("baseline_surface", 0), ("changed_surface", 1)):
            if phase in held and self._surface(seq)({}) != held[phase]:
                raise PlumblineError(f"what {phase} left has changed")

    def _prepare(self, seq: int) -> surfaces.Surface:
        recipe = surfaces.Recipe(self.intent.ground_class)
        return surfaces.prepare(self.spark, os.path.join(self.root, "surfaces"), self.space.snapshot(seq), f"{self.record.source_id}@{seq}", recipe, self.transform, self.reference)

    def _surface(self, seq: int):
        def step(facts: dict) -> dict:
            d = self._prepare(seq).descriptor
            return {k: d[k] for k in ("vertices", "faces", "hull", "geometry", "topology", "artifact")}

        return step

    def _commit(self, facts: dict) -> dict:
        ids = self.spark.createDataFrame([(o,) for o in self.intent.ordinals], "ordinal long")
        workspace.select_ids(self.space.points, ids)
        out = self.space.set_classification(self.intent.operation, ids, self.intent.value, 0, self.space.source_id)
        if out.state != "committed":
            raise PlumblineError(f"the correction was {out.state}: {out.reason}")
        report = audit.audit(self.space, out.seq)
        return {"seq": out.seq, "changed_points": report.changed_points, "transitions": [list(t) for t in report.transitions], "audit": report.digest()}

    def _compare(self, facts: dict) -> dict:
        changed = surfaces.compare(self._prepare(0), self._prepare(1))
        counts = {r["change"]: r["count"] for r in changed.groupBy("change").count().collect()}
        box = terrain.change_bounds(changed, self.space.points).first()
        low, high = (self.transform.world(tuple(box[f"{m}_t{a}"] for a in "xyz")) if box.vertices else None for m in ("min", "max"))
        return {"added": counts.get("added", 0), "removed": counts.get("removed", 0), "low": low and list(low), "high": high and list(high)}

    def _report(self) -> tuple[surfaces.Surface, surfaces.Report]:
        s = self._prepare(1)
        checks = self.spark.createDataFrame([tuple(p) for p in self.intent.check_points], "id long, x double, y double, z double")
        rows = workspace.query(self.space.snapshot(1), self.transform, None, self.intent.ground_class)
        return s, surfaces.exact_qa(s.vertices, s.faces, self.transform, rows, checks, self.intent.below, self.intent.above, self.intent.cell)

    def _residuals(self, facts: dict) -> dict:
        s, report = self._report()
        t, held = report.tolerance.first(), report.statistics.first()
        lineage = f"{self.record.source_id}@1"
        return {"covered": held.covered, "gaps": held.gaps, "below": t.below, "within": t.within, "above": t.above, "digest": surfaces.results_digest(report, lineage, s.descriptor["artifact"], self.intent.below, self.intent.above)}

    def _export(self, facts: dict) -> dict:
        s = self._prepare(1)
        return {"sha256": landxml.write(s.vertices, s.faces, self.transform, self.reference, os.path.join(self.root, "surface.xml"), ensure=True)}

    def _complete(self, facts: dict) -> dict:
        return {"audit": ensure_report(os.path.join(self.root, "audit.json"), {p: facts[p] for p in PHASES if p in facts})}

