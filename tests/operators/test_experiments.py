from __future__ import annotations

import pytest

from tidemark.operators import experiments as ex


def test_life_of_an_experiment(spark, tmp_path):
    reg = ex.Registry(spark, str(tmp_path / "registry"))
    reg.design("e1", "momentum pays", {"months": 12}, ["in_sample"])
    assert reg.design("e1", "momentum pays", {"months": 12})["state"] == "designed"
    with pytest.raises(ValueError, match="another configuration"):
        reg.design("e1", "momentum pays", {"months": 6})
    with pytest.raises(ValueError, match="can't go"):
        reg.move("e1", "concluded")
    run = reg.run("e1", lambda c: {"cagr": c["months"] / 100, "risk": {"vol": 0.2}}, {"prices": "v1"})
    assert run == "e1-001" and reg.get("run", run)["metrics"] == {"cagr": 0.12, "risk.vol": 0.2}
    assert reg.rerun_agrees(run, lambda c: {"cagr": 0.12, "risk": {"vol": 0.2}}) and not reg.rerun_agrees(run, lambda c: {"cagr": 0.1, "risk": {"vol": 0.2}})
    assert reg.conclude("e1", "supported", run) == []
    with pytest.raises(ValueError, match="can't go"):
        reg.move("e1", "running")
    assert [(r.id, r.state) for r in reg.experiments().collect()] == [("e1", "concluded")]
    assert reg.runs().first().metrics["cagr"] == 0.12


def test_failures_and_confirmatory_rules(spark, tmp_path):
    reg = ex.Registry(spark, str(tmp_path / "registry"))
    reg.design("bad", "h", {})
    with pytest.raises(ZeroDivisionError):
        reg.run("bad", lambda c: {"x": 1 / 0}, {})
    assert reg.get("experiment", "bad")["state"] == "abandoned" and "error" in reg.get("run", "bad-001")
    reg.design("c", "h2", {}, confirmatory=True)
    run = reg.run("c", lambda c: {"x": 1}, {})
    with pytest.raises(ValueError, match="reproduced"):
        reg.conclude("c", "yes", run)
    assert reg.conclude("c", "yes", run, reproduced=True) == []
    assert ex.manifest_difference({"a": "1", "b": "2"}, {"a": "1", "c": "3"}) == {"b": ("2", None), "c": (None, "3")}
    assert "<td>1</td>" in ex.html_report("t", {"n": spark.range(1, 2)})
