"""Parts of an assignment that leave no choice do not reach the solver."""

from voxarbor.operators import matching


def test_only_open_parts_are_solved(spark, monkeypatch):
    handed, plain = [], matching._picked
    monkeypatch.setattr(matching, "_picked", lambda case, part: handed.append(
        sorted(r.case_id for r in case.select("case_id").collect())) or plain(case, part))
    kind = "case_id long, id long, x double, y double, z double"
    preds = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 5.0, 0.0, 0.0), (2, 1, 1.0, 0.0, 0.0), (3, 1, 2.0, 0.0, 0.0), (3, 2, 2.0, 0.0, 0.0),
                                   (4, 1, 0.0, 0.0, 0.0), (4, 2, 2.0, 0.0, 0.0), (5, 1, 0.0, 0.0, 0.0), (5, 2, 9.0, 0.0, 0.0)], kind)
    refs = spark.createDataFrame([(1, 8, 5.0, 0.0, 0.0), (1, 9, 0.0, 0.0, 0.0), (2, 7, 4.0, 0.0, 0.0), (2, 8, 2.0, 0.0, 0.0), (2, 9, 1.5, 0.0, 0.0),
                                  (3, 8, 2.0, 0.0, 0.0), (3, 9, 2.0, 0.0, 0.0), (4, 8, 1.5, 0.0, 0.0), (4, 9, 3.5, 0.0, 0.0), (5, 9, 8.5, 0.0, 0.0)], kind)
    got = {(r.case_id, r.pred_id, r.ref_id, r.distance) for r in matching.match(preds, refs, 10.0).collect()}
    assert {g for g in got if g[0] != 3} == {(1, 1, 9, 0.0), (1, 2, 8, 0.0), (2, 1, 9, 0.5), (4, 1, 8, 1.5), (4, 2, 9, 1.5), (5, 2, 9, 0.5)}
    assert sorted(g[2] for g in got if g[0] == 3) == [8, 9]
    assert handed == [[3, 4]]
