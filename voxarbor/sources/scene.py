"""Display tables: the data behind a viewer, without the viewer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scene_rows(scored: DataFrame, fate: DataFrame, centre: DataFrame) -> DataFrame:
    """Findings around the volume centre, accepted or with the reason of their rejection.

    ``centre`` is one row ``mx, my, mz``.
    """
    fate = fate.selectExpr("id", "folded_into", "true AS seen")
    rows = scored.join(fate, "id", "left").crossJoin(F.broadcast(centre))
    return rows.selectExpr(
        "case_id", "id", "x - mx AS x", "y - my AS y", "z - mz AS z", "confidence",
        "coalesce(seen, false) AND folded_into IS NULL AS accepted",
        "CASE WHEN veto IS NOT NULL THEN veto WHEN seen IS NULL THEN 'below_threshold' "
        "WHEN folded_into IS NOT NULL THEN 'merged' END AS rejected_by")


def scene_json(rows: DataFrame) -> DataFrame:
    """One JSON object per row, ready for a text sink."""
    return rows.selectExpr("case_id", "to_json(struct(*)) AS value")


def exposed_faces(vox: DataFrame) -> DataFrame:
    """Boundary faces of member cells, the relational part of a surface mesh: cell and face normal."""
    from voxarbor.operators import lattice

    sides = lattice.announce(vox, lattice.FACE, ["-o.dz AS nz", "-o.dy AS ny", "-o.dx AS nx"])
    outside = sides.join(vox.select(*lattice.CELL), lattice.CELL, "left_anti")
    # the empty cell knows the step back to the member it touches
    return outside.selectExpr("case_id", "cast(z + nz AS int) AS z", "cast(y + ny AS int) AS y",
                              "cast(x + nx AS int) AS x", "-nz AS nz", "-ny AS ny", "-nx AS nx")
