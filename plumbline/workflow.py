"""A resumable correction run: eight phases with an append-only, checksummed journal."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from plumbline.model import PlumblineError

#: The phases, in order.
PHASES = ("intent_recorded", "baseline_surface", "correction_committed", "changed_surface", "comparison", "residuals", "export", "complete")


@dataclass(frozen=True)
class Checkpoint:
    index: int
    phase: str
    facts: dict


class Journal:
    """One JSON line for each checkpoint, chained by digests. A torn or altered tail is dropped on reading."""

    def __init__(self, path: str, run_id: str):
        self.path, self.run_id = path, run_id

    def _digest(self, before: str, body: dict) -> str:
        return hashlib.sha256((before + json.dumps(body, sort_keys=True)).encode()).hexdigest()

    def read(self, repair: bool = False) -> list[Checkpoint]:
        out: list[Checkpoint] = []
        before, good = self.run_id, 0
        if not os.path.exists(self.path):
            return out
        with open(self.path, "rb") as f:
            for line in f:
                try:
                    held = json.loads(line)
                    body = held["body"]
                except (ValueError, KeyError, TypeError):
                    break
                if not line.endswith(b"\n") or held.get("digest") != self._digest(before, body) or body["index"] != len(out) or body["phase"] != PHASES[len(out)]:
                    break
                before = held["digest"]
                good += len(line)
                out.append(Checkpoint(body["index"], body["phase"], body["facts"]))
        if repair and good < os.path.getsize(self.path):
            os.truncate(self.path, good)
        return out

    def record(self, phase: str, facts: dict) -> bool:
        """Appends the next checkpoint; recording the last one again with the same facts changes nothing."""
        held = self.read(repair=True)
        if any(c.phase == phase for c in held):
            if next(c for c in held if c.phase == phase).facts != facts:
                raise PlumblineError(f"phase {phase} is recorded with other facts")
            return False
        if len(held) >= len(PHASES) or PHASES[len(held)] != phase:
            raise PlumblineError(f"phase {phase} is out of order")
        before = self.run_id
        for c in held:
            before = self._digest(before, {"index": c.index, "phase": c.phase, "facts": c.facts})
        body = {"index": len(held), "phase": phase, "facts": facts}
        with open(self.path, "a") as f:
            f.write(json.dumps({"body": body, "digest": self._digest(before, body)}) + "\n")
            f.flush()
            os.fsync(f.fileno())
        return True

    def complete(self) -> list[Checkpoint]:
        held = self.read()
        if len(held) != len(PHASES):
            raise PlumblineError(f"{len(held)} of {len(PHASES)} phases are recorded")
        return held


class Run:
    """Calls a step for each phase not yet recorded. A step gets the facts so far and returns its own; it may run again
    after a crash, so it must find what it did (commits by operation id, files by digest)."""

    def __init__(self, root: str, run_id: str, intent: dict):
        os.makedirs(root, exist_ok=True)
        path = os.path.join(root, "run.json")
        if os.path.exists(path):
            with open(path) as f:
                if json.load(f) != {"run_id": run_id, "intent": intent}:
                    raise PlumblineError("the run was started with another intent")
        else:
            ensure_report(path, {"run_id": run_id, "intent": intent})
        self.root = root
        self.journal, self.intent = Journal(os.path.join(root, "journal.jsonl"), run_id), intent

    def advance(self, steps: dict[str, Callable[[dict], dict]], stop_after: str | None = None) -> dict:
        facts: dict = {}
        held = {c.phase: c.facts for c in self.journal.read(repair=True)}
        if "intent_recorded" in held and held["intent_recorded"] != self.intent:
            raise PlumblineError("the run was started with another intent")
        for phase in PHASES:
            if phase not in held:
                own = self.intent if phase == "intent_recorded" else steps[phase](facts) if phase in steps else {}
                self.journal.record(phase, own)
                held[phase] = own
            facts[phase] = held[phase]
            if phase == stop_after:
                break
        return facts


def ensure_report(path: str, facts: dict) -> str:
    """Canonical JSON, created once; a file of other bytes is an error."""
    data = (json.dumps(facts, sort_keys=True, separators=(",", ":")) + "\n").encode()
    if os.path.exists(path):
        with open(path, "rb") as f:
            if f.read() != data:
                raise PlumblineError("the target holds other bytes")
    else:
        with open(path + ".new", "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.link(path + ".new", path)
        os.remove(path + ".new")
    return hashlib.sha256(data).hexdigest()
