import gzip
import json

import numpy as np
import pytest

from voxarbor import schema
from voxarbor.sources import phantom, predictions, volumes


def nifti(array, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), tilt=0.0, dtype=4):
    """Bytes of a NIfTI-1 file of a (z, y, x) array with a sform in RAS."""
    head = bytearray(352)
    put = lambda kind, at, *v: head.__setitem__(slice(at, at + np.dtype(kind).itemsize * len(v)), np.array(v, kind).tobytes())
    put("<i4", 0, 348)
    nz, ny, nx = array.shape
    put("<i2", 40, 3, nx, ny, nz, 1, 1, 1, 1)
    put("<i2", 70, dtype)
    put("<f4", 76, 1, *spacing, 1, 1, 1, 1)
    put("<f4", 108, 352)
    put("<f4", 112, 1, 0)
    put("<i2", 254, 1)
    put("<f4", 280, -spacing[0], tilt, 0, -origin[0])
    put("<f4", 296, 0, -spacing[1], 0, -origin[1])
    put("<f4", 312, 0, 0, spacing[2], origin[2])
    head[344:348] = b"n+1\0"
    return bytes(head) + np.ascontiguousarray(array, "<" + volumes.TYPES[dtype]).tobytes()


def test_read_volumes_and_pairs(spark, tmp_path):
    image = np.arange(24).reshape(2, 3, 4)
    mask = (image > 20).astype(int)
    for case, shift in (("subject001", 0.0), ("subject002", 5.0)):
        (tmp_path / case).mkdir()
        # compressed content behind a plain name
        (tmp_path / case / "orig1.nii").write_bytes(gzip.compress(nifti(image, (0.5, 1, 2), (3, 4, 5), tilt=1e-4)))
        (tmp_path / case / "mask1.nii").write_bytes(nifti(mask, (0.5, 1, 2), (3 + shift, 4, 5), dtype=2))
    (tmp_path / "subject003").mkdir()
    (tmp_path / "subject003" / "orig1.nii").write_bytes(b"broken")
    (tmp_path / "subject004").mkdir()
    whole = gzip.compress(nifti(np.arange(30000).reshape(30, 25, 40) % 977, (1, 1, 1)))
    (tmp_path / "subject004" / "orig1.nii.gz").write_bytes(whole[:600] + b"\xff" * 60 + whole[660:])
    slices = volumes.read_slices(volumes.list_cases(spark, str(tmp_path))).cache()
    good, bad = volumes.load_pairs(slices)
    assert [r.case_id for r in good.collect()] == ["subject001"]
    problems = {r.case_id: r.problem for r in bad.collect()}
    assert problems.pop("subject004") and problems == {"subject002": "origin", "subject003": "not a NIfTI-1 header"}
    grid = good.first().grid
    assert np.allclose(grid.spacing, (0.5, 1, 2), atol=1e-6) and np.allclose(grid.origin, (3, 4, 5)) and grid.size == [4, 3, 2]
    d = np.array(grid.direction).reshape(3, 3)
    assert np.allclose(d @ d.T, np.eye(3), atol=1e-9) and np.allclose(d, np.eye(3), atol=1e-3)
    rows = {(r.z, r.y, r.x): (r.hu, r.in_mask, r.vid) for r in volumes.voxels(slices, good).collect()}
    assert rows == {(z, y, x): (float(image[z, y, x]), bool(mask[z, y, x]), image[z, y, x]) for z, y, x in np.ndindex(2, 3, 4)}
    assert volumes.list_cases(spark, str(tmp_path), ["subject002"]).count() == 2


def daughter(i=1, **change):
    base = {"instance_id": f"branch_{i:03d}", "parent_instance_id": "aorta", "ostium_xyz_mm": [0.0, 0.0, 0.0],
            "seed_xyz_mm": [5.0, 0.0, 0.0], "radius_mm": 1.5, "direction_xyz": [1.0, 0.0, 0.0]}
    return {**base, **change}


def as_frame(spark, *daughters, case="c1"):
    return spark.createDataFrame([(case, ("aorta",), list(daughters))], schema.PREDICTION)


NAN, INF = float("nan"), float("inf")
# one broken rule at a time, derived from the order of the rules: places, radius, then the direction
BROKEN = [({}, None), ({"radius_mm": 1e-9}, None), ({"direction_xyz": [0.6, 0.8, 0.0]}, None)]
BROKEN += [({f: v}, f) for f in ("ostium_xyz_mm", "seed_xyz_mm", "direction_xyz")
           for v in (None, [], [1.0] * 4, [0.0, NAN, 0.0], [0.0, 0.0, -INF], [None, 0.0, 0.0])]
BROKEN += [({"radius_mm": v}, "radius_mm") for v in (None, 0.0, -0.0, -2.5, NAN, INF)]
BROKEN += [({"direction_xyz": [k, 0.0, 0.0]}, "direction_norm") for k in (0.0, 0.999, 1.01)]
BROKEN += [({"direction_xyz": [-0.8, 0.6, 0.0]}, "direction_inward"), ({"seed_xyz_mm": [0.0] * 3}, "seed_equals_ostium"),
           ({"instance_id": "branch_002"}, "instance_id"), ({"instance_id": None}, "instance_id"),
           ({"parent_instance_id": ""}, "parent_instance_id"), ({"instance_id": "", "radius_mm": -1.0}, "instance_id")]


@pytest.mark.parametrize("change, problem", BROKEN)
def test_validator(spark, change, problem):
    assert schema.validate(as_frame(spark, daughter(**change))).first().problem == problem


def test_duplicate_ids_are_rejected_and_nothing_is_written(spark, tmp_path):
    bad = as_frame(spark, daughter(1), daughter(1))
    assert schema.validate(bad).first().problem == "instance_id"
    with pytest.raises(Exception, match="invalid prediction"):
        predictions.write_predictions(bad, str(tmp_path / "out"))
    assert not list(tmp_path.glob("out/*.json"))


def test_round_trip_drops_extra_fields_and_reads_bare_lists(spark, tmp_path):
    predictions.write_predictions(as_frame(spark, daughter(1), daughter(2)), str(tmp_path / "out"))
    back = predictions.read_predictions(spark, str(tmp_path / "out")).collect()
    assert len(back) == 1 and len(back[0].daughters) == 2 and back[0].case_id == "c1"
    (tmp_path / "s9").mkdir()
    (tmp_path / "s9" / "bare.json").write_text(json.dumps([{**daughter(), "confidence": 0.9}]))
    (tmp_path / "s9" / "empty.json").write_text(json.dumps({"branches": []}))
    rows = predictions.read_predictions(spark, str(tmp_path / "s9" / "*.json"))
    assert sorted((r.case_id, len(r.daughters)) for r in rows.collect()) == [("s9", 0), ("s9", 1)]
    assert predictions.file_manifest(spark, str(tmp_path / "s9")).count() == 2


def test_generated_cases_and_truth(spark):
    suite = phantom.suite()
    assert len(suite) == 32 and len({p.case_id for p in suite}) == 32
    checked = schema.validate(phantom.truth(spark, suite))
    assert checked.where("problem IS NOT NULL").count() == 0
    small = phantom.Phantom("p", size_mm=(32, 32, 40), trunk_radius=4, trunk_z=(5, 35), branches=((20, 0, 1.5, 8),))
    vox = phantom.voxels(spark, small)
    assert vox.count() == 32 * 32 * 40
    row = vox.where("z = 20 AND y = 16 AND x IN (2, 18, 26)").orderBy("x").collect()
    assert [(r.hu, r.in_mask) for r in row] == [(40.0, False), (400.0, True), (400.0, False)]


def test_watch_predictions_once_each(spark, tmp_path):
    from voxarbor.streaming.incremental import watch_predictions

    src = tmp_path / "in"
    src.mkdir()
    doc = lambda case, d: json.dumps({"case_id": case, "parent": {"instance_id": "aorta"}, "daughters": [d]})
    (src / "a.json").write_text(doc("a", daughter()))
    (src / "b.json").write_text(doc("b", daughter(radius_mm=-1.0)))
    args = (spark, str(src), str(tmp_path / "out"), str(tmp_path / "state"))
    watch_predictions(*args).awaitTermination()
    (src / "c.json").write_text(doc("c", daughter()))
    watch_predictions(*args).awaitTermination()
    cases = lambda part: sorted(r.case_id for r in spark.read.json(str(tmp_path / "out" / part)).collect())
    assert cases("valid") == ["a", "c"] and cases("rejected") == ["b"]
