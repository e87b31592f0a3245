"""python -m plumbline.cli start RUN INTENT.json | resume RUN | inspect RUN | verify RUN | compare REFERENCE RETURNED --horizontal H --vertical V"""

from __future__ import annotations

import argparse
import json
import sys

from plumbline.model import PlumblineError
from plumbline.workflow import PHASES, Journal


def compare_files(spark, reference: str, returned: str, horizontal: float, vertical: float) -> dict:
    """Reference systems, counts, a one-to-one vertex match, then face sets. The first difference decides."""
    from plumbline.operators import roundtrip
    from plumbline.sources import landxml

    if landxml.read_reference(reference) != landxml.read_reference(returned):
        return {"equal": False, "reason": "reference_system"}
    (p, f), (q, g) = landxml.read(spark, reference), landxml.read(spark, returned)
    counts = [x.count() for x in (p, q, f, g)]
    if counts[0] != counts[1] or counts[2] != counts[3]:
        return {"equal": False, "reason": "counts", "counts": counts}
    for side, faces, points in (("reference", f, p), ("returned", g, q)):
        if bad := roundtrip.bad_faces(faces, points).limit(1).collect():
            return {"equal": False, "reason": f"{side}_{bad[0].reason}"}
    exact = horizontal == vertical == 0
    matches = roundtrip.match_exact(p, q) if exact else roundtrip.match_within(p, q, horizontal, vertical)
    if roundtrip.match_problems(matches, p, q).limit(1).count():
        return {"equal": False, "reason": "vertex_match"}
    drift = roundtrip.topology_drift(f, g, matches)
    if n := drift.count():
        return {"equal": False, "reason": "topology", "faces": n, "sample": [list(r) for r in drift.orderBy("side", "v1", "v2", "v3").limit(16).collect()]}
    return {"equal": True, "vertices": counts[0], "faces": counts[2]}


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="plumbline")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("inspect", "verify"):
        sub.add_parser(name).add_argument("run")
    for name in ("start", "resume"):
        p = sub.add_parser(name)
        p.add_argument("run")
        if name == "start":
            p.add_argument("intent")
        p.add_argument("--stop-after", choices=PHASES)
    c = sub.add_parser("compare")
    c.add_argument("reference")
    c.add_argument("returned")
    c.add_argument("--horizontal", type=float, default=0.0)
    c.add_argument("--vertical", type=float, default=0.0)
    a = top.parse_args(args)
    if a.command == "compare":
        from pyspark.sql import SparkSession

        out = compare_files(SparkSession.builder.getOrCreate(), a.reference, a.returned, a.horizontal, a.vertical)
        print(json.dumps(out))
        return int(not out["equal"])
    if a.command in ("start", "resume"):
        from pyspark.sql import SparkSession

        from plumbline.correction import CorrectionRun, Intent

        spark = SparkSession.builder.getOrCreate()
        try:
            if a.command == "start":
                with open(a.intent) as f:
                    run = CorrectionRun.start(spark, a.run, Intent.of(json.load(f)))
            else:
                run = CorrectionRun.resume(spark, a.run)
            print(json.dumps(run.advance(a.stop_after)))
        except (PlumblineError, OSError, TypeError) as error:
            print(error, file=sys.stderr)
            return 1
        return 0
    try:
        with open(f"{a.run}/run.json") as f:
            journal = Journal(f"{a.run}/journal.jsonl", json.load(f)["run_id"])
        held = journal.complete() if a.command == "verify" else journal.read(repair=True)
    except (PlumblineError, OSError) as error:
        print(error, file=sys.stderr)
        return 1
    print(json.dumps({"phases": [p.phase for p in held], "complete": len(held) == len(PHASES)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
