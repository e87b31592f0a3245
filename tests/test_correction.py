"""The correction run on a LAS grid of 64 ground points, of which two are taken out: numbers known from closed forms."""

import json
import os
import struct

import pytest

from plumbline.cli import main
from plumbline.correction import CorrectionRun, Intent
from plumbline.model import PlumblineError
from plumbline.workflow import PHASES
from test_sources import las_bytes

KEYS = [1, 1, 0, 5, 1024, 0, 1, 1, 3072, 0, 1, 32647, 3076, 0, 1, 9001, 4096, 0, 1, 5703, 4099, 0, 1, 9001]


@pytest.fixture()
def intent(tmp_path):
    rows = [{"x": i % 8 * 100, "y": i // 8 * 100, "z": (3 * (i % 8) + 5 * (i // 8)) % 17 * 10, "bits": 0b00_001_001, "classes": 2} for i in range(64)]
    data = bytearray(las_bytes(0, rows, geo=KEYS))
    struct.pack_into("<3d", data, 131, 0.01, 0.01, 0.01)
    struct.pack_into("<3d", data, 155, 500000.0, 4600000.0, 120.0)
    path = tmp_path / "grid.las"
    path.write_bytes(bytes(data))
    top = 120.0 + (3 * 5 + 5 * 5) % 17 / 10
    return Intent(str(path), (9, 10), 1, ((1, 500005.0, 4600005.0, top), (2, 700000.0, 4600005.0, 0.0)))


def test_a_whole_run(spark, intent, tmp_path):
    facts = CorrectionRun.start(spark, str(tmp_path / "r"), intent).advance()
    assert list(facts) == list(PHASES)
    counts = lambda p: tuple(facts[p][k] for k in ("vertices", "faces", "hull"))
    assert counts("baseline_surface") == (64, 98, 28) and counts("changed_surface") == (62, 94, 28)
    assert facts["correction_committed"]["changed_points"] == 2 and facts["correction_committed"]["transitions"] == [[2, 1, 2]]
    c = facts["comparison"]
    assert (c["added"], c["removed"]) == (6, 10) and c["low"] == pytest.approx([500000, 4600000, 120]) and c["high"] == pytest.approx([500003, 4600002, 121.6])
    assert (facts["residuals"]["covered"], facts["residuals"]["gaps"], facts["residuals"]["within"]) == (63, 1, 63)
    with open(tmp_path / "r" / "audit.json") as f:
        assert json.load(f)["export"] == facts["export"]
    assert CorrectionRun.resume(spark, str(tmp_path / "r")).advance() == facts
    assert main(["inspect", str(tmp_path / "r")]) == 0 == main(["verify", str(tmp_path / "r")])


def test_runs_stop_resume_and_fail_closed(spark, intent, tmp_path, capsys):
    whole = CorrectionRun.start(spark, str(tmp_path / "whole"), intent).advance()
    root = str(tmp_path / "r")
    path = tmp_path / "intent.json"
    path.write_text(json.dumps(intent.facts()))
    assert main(["start", root, str(path), "--stop-after", "correction_committed"]) == 0
    assert main(["start", root, str(path)]) == 1 and main(["verify", root]) == 1
    with pytest.raises(PlumblineError):
        CorrectionRun.resume(spark, root, Intent(intent.source, (9,), 1, ()))
    with pytest.raises(PlumblineError):
        CorrectionRun.resume(spark, str(tmp_path / "none"))
    assert main(["resume", root]) == 0
    again = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert {k: again[k] for k in PHASES} == whole
    done = next(os.path.join(d, f) for d, _, fs in os.walk(os.path.join(root, "surfaces")) for f in fs if f == "descriptor.json")
    with open(done) as f:
        held = json.load(f)
    with open(done, "w") as f:
        json.dump(held | {"geometry": "0" * 64}, f)
    with pytest.raises(PlumblineError):
        CorrectionRun.resume(spark, root).advance()
    with open(intent.source, "r+b") as f:
        f.seek(375 + 54 + 2 * len(KEYS))
        f.write(b"\1")
    with pytest.raises(PlumblineError):
        CorrectionRun.resume(spark, root).advance()
