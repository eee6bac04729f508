"""Stability studies: the runs, what they do to findings, and the analysis under all of them."""

import pytest

from voxarbor.operators import studies
from voxarbor.plans import cases

POINT = "case_id string, id long, x double, y double, z double"


def test_runs_change_one_thing_each():
    runs = studies.stability_runs(15.0, 0.40, 0.90, 5.0, 0.65)
    assert [r["run"] for r in runs] == list(range(1, 20)) and len({r["name"] for r in runs}) == 19
    base = {"budget": 15.0, "low": 0.40, "high": 0.90, "min_length": 5.0, "threshold": 0.65, "sigma": 0.0}
    changed = [{k for k, v in base.items() if r[k] != v} for r in runs]
    assert changed == [{"budget"}] * 4 + [{"low", "high"}] * 4 + [{"min_length"}] * 4 + [{"threshold"}] * 4 + [{"sigma"}] * 3
    assert [r["high"] for r in runs[4:8]] == pytest.approx([0.72, 0.81, 0.95, 0.95])


def test_fates_of_findings(spark):
    base = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("a", 2, 20.0, 0.0, 0.0)], POINT)
    other = spark.createDataFrame([
        (1, "a", 7, 1.0, 0.0, 0.0), (1, "a", 8, 23.0, 0.0, 0.0),  # one stays, one moves
        (2, "a", 7, 0.0, 2.0, 0.0), (2, "a", 8, 20.0, 0.0, 5.5),  # exactly the limit of moving; too far to be the same
        (2, "b", 1, 0.0, 0.0, 0.0), (3, "b", 1, 0.0, 0.0, 0.0), (3, "b", 2, 9.0, 0.0, 0.0)], "run int, " + POINT)
    names = ["more", "it's less", "noise"]
    fates, new = studies.compare_runs(base, other, names)
    assert fates.count() == 6
    found = studies.finding_stability(fates, names)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 2 / 3, ["noise"], []), ("a", 2, 0.0, ["it's less", "noise"], ["more"])]
    assert {(r.case_id, r.run): r.appeared for r in new.collect()} == {("a", 2): 1, ("b", 2): 1, ("b", 3): 2}
    three = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    out = {r.case_id: r for r in studies.case_stability(three, found, new, 3).collect()}
    assert (out["a"].n_baseline, out["a"].appearance_events, out["a"].spurious_rate) == (2, 1, None)
    assert out["a"].case_stability == pytest.approx(1 / 3) and out["b"].spurious_rate == pytest.approx(2 / 3)
    assert (out["b"].case_stability, out["b"].appeared) == (None, 3) and out["c"].spurious_rate == 0


def test_no_findings_and_no_cases(spark):
    none = spark.createDataFrame([], POINT)
    fates, new = studies.compare_runs(none, none.selectExpr("1 AS run", "*"), ["one"])
    found = studies.finding_stability(fates, ["one"])
    assert found.count() == 0 and new.count() == 0
    assert studies.case_stability(none, found, new, 1).count() == 0


def test_analysis_under_all_runs(spark, tmp_path, monkeypatch):
    """Analysis and report are stubs: what the study hands to them and reads from them is under test."""
    vox = spark.range(3).selectExpr("1L AS case_id", "id AS gid", "100D AS hu")
    made = []

    def features(vox, s, run):
        made.append((s.budget, round(s.low, 6), s.limits.min_length, [r.hu for r in vox.orderBy("gid").collect()]))
        return run.one("features", lambda: vox.limit(1).selectExpr("case_id", f"{s.budget}D - 15 AS x"))

    def told(found, cases_, s):
        at = "array(x, 0D, 0D)"
        return found.selectExpr("cast(case_id AS string) AS case_id", "named_struct('instance_id', 'aorta') AS parent",
                                f"CASE WHEN {s.limits.threshold} < 0.7 THEN array(named_struct('instance_id', 'branch_001', "
                                f"'parent_instance_id', 'aorta', 'ostium_xyz_mm', {at}, 'seed_xyz_mm', {at}, 'radius_mm', 1D, 'direction_xyz', {at})) "
                                "ELSE array() END AS daughters")

    monkeypatch.setattr(cases, "analyse", features)
    monkeypatch.setattr(cases, "report", told)
    s = cases.Settings()
    found, per = cases.stability(vox, spark.range(1, 3).withColumnRenamed("id", "case_id"), s, str(tmp_path / "study"))
    row = found.collect()
    assert len(row) == 1 and row[0].moved_in == ["budget-20%", "budget+20%"] and row[0].disappeared_in == ["threshold+10%", "threshold+20%"]
    assert row[0].stability == pytest.approx(15 / 19)
    assert {r.case_id: r.n_baseline for r in per.collect()} == {"1": 1, "2": 0}
    assert len(made) == 20 and len({str(m[:3]) for m in made}) == 13
    noisy = [m[3] for m in made if m[3] != [100.0] * 3]
    assert len(noisy) == 3 and len({tuple(n) for n in noisy}) == 3
    cases.stability(vox, spark.range(1, 3).withColumnRenamed("id", "case_id"), s, str(tmp_path / "study"))
    assert [m[3] for m in made[20:] if m[3] != [100.0] * 3] == noisy
