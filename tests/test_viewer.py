"""The gallery's viewer on a made page in Node: what clicks and keys do to a review, and what it exports."""

import json
import shutil
import subprocess
from pathlib import Path

import pytest

import panoquarry.plans

pytestmark = pytest.mark.skipif(not shutil.which("node"), reason="needs Node")
PAGE = Path(panoquarry.plans.__file__).with_name("viewer.html")


def entry(pid, group, *confs):
    crops = [{"img": f"{pid}_det{i}.jpg", "conf": c, "x": 0.25 * (i + 1), "y": 0.5, "cx": 0.5, "cy": 0.5} for i, c in enumerate(confs)]
    return {"pid": pid, "date": "2018-11", "group": group, "full": f"{pid}_full.jpg", "crops": crops}


ENTRIES = [entry("elm", "top", 0.9, 0.8, 0.7), entry("oak", "random", 0.66), entry("ash", "empty")]


def shown(tmp_path, *steps, entries=ENTRIES):
    """What the page shows after each step."""
    source = PAGE.read_text().replace("{{ABOUT}}", json.dumps({"run_key": "key", "run_name": "grove", "source": "r"})).replace("{{ENTRIES}}", json.dumps(entries))
    (tmp_path / "index.html").write_text(source)
    (tmp_path / "steps.json").write_text(json.dumps(steps))
    script = Path(__file__).with_name("viewer_page.js")
    out = subprocess.run(["node", str(script), str(tmp_path / "index.html"), str(tmp_path / "steps.json")], capture_output=True, text=True, timeout=60, check=False)
    assert out.returncode == 0, out.stderr
    return [json.loads(line) for line in out.stdout.splitlines()]


def kept(page, pid):
    return json.loads(page["kept"]["review/key"])[pid]


def test_verdicts_turn_in_their_order(tmp_path):
    pages = shown(tmp_path, ["key", "2"], ["cut", 1], ["pin", 1], ["key", "2"], ["key", "9"])
    assert [p["cuts"][1] for p in pages] == ["true", "false", "unsure", "null", "null"]
    assert all(p["cuts"][0] == p["cuts"][2] == "null" for p in pages)


def test_marks_and_the_statement_that_nothing_is_missed(tmp_path):
    pages = shown(tmp_path, ["key", "m"], ["scene", 0.125, 0.5], ["key", "m"], ["pin", 3], ["pin", 3], ["key", "M"], ["key", "m", {"ctrlKey": True}])
    states = [kept(p, "elm") for p in pages]
    assert [s["no_missed"] for s in states] == [True, False, False, False, False, True, True]
    assert [len(s["missed"]) for s in states] == [0, 1, 1, 1, 0, 0, 0] and states[1]["missed"] == [{"x": 0.125, "y": 0.5}] and states[3]["missed"][0]["unsure"]
    assert [p["locked"] for p in pages] == [False, True, True, True, False, False, False]
    assert pages[1]["pins"][3] == ["pin mark", "12.5%"] and pages[3]["pins"][3][0] == "pin mark unsure"


def test_a_review_is_complete_with_all_verdicts_and_a_scan(tmp_path):
    pages = shown(tmp_path, ["key", "1"], ["key", "2"], ["key", "3"], ["key", "m"], ["key", "3"], ["key", "3"], ["key", "3"])
    assert [p["progress"][0] for p in pages] == ["0", "0", "0", "1", "1", "1", "0"]
    assert shown(tmp_path, ["key", "ArrowLeft"], ["scene", 0.5, 0.5])[1]["progress"] == "1 of 3 reviewed"


def test_ways_through_the_entries(tmp_path):
    pages = shown(tmp_path, ["press", 1], ["key", "ArrowRight"], ["key", "ArrowRight"], ["press", 0], ["pick", "det"], ["pick", "empty"], ["key", "ArrowRight"], ["key", "m"], ["pick", "todo"], ["pick", "all"])
    assert [p["title"].split()[0] for p in pages] == ["oak", "ash", "elm", "ash", "elm", "ash", "ash", "ash", "elm", "elm"]
    assert "2 of 3" in pages[0]["title"] and "1 of 2" in pages[4]["title"] and "1 of 1" in pages[5]["title"]
    done = shown(tmp_path, ["key", "m"], ["pick", "todo"], entries=ENTRIES[2:])
    assert done[1]["title"] == "nothing to show" and done[1]["cuts"] == []


def test_export_has_what_was_seen(tmp_path):
    page = shown(tmp_path, ["key", "1"], ["key", "ArrowRight"], ["key", "1"], ["key", "1"], ["scene", 0.5, 0.25], ["press", "#save"])[-1]
    assert page["saved"] == ["grove_verdicts.json"]
    assert page["exported"]["run_key"] == "key" and page["exported"]["panos"] == {
        "elm": {"group": "top", "dets": [True, None, None], "missed": [], "no_missed": False},
        "oak": {"group": "random", "dets": [False], "missed": [{"x": 0.5, "y": 0.25}], "no_missed": False},
    }
