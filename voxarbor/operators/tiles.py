"""Lattice cells in cubic tiles: a task settles whole tiles at once, and only what crosses a tile's face goes through a shuffle.

Rows reach the task sorted by tile, many small tiles or one full tile at a time, so it holds no more than ``BATCH`` rows and
one tile. Keys of cells are padded by the longest offset, so neither rows nor tiles wrap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxarbor.operators import lattice

SIDE = 32
BATCH = 1 << 16
AXES = ("z", "y", "x")
TILE = [f"tile_{c}" for c in AXES]
PLACED = " AND ".join(f"{c} IS NOT NULL" for c in lattice.CELL)


def box() -> dict[str, Column]:
    """Box of all cells, to be observed while they are written."""
    return {f"{f}_{c}": F.expr(f"{f}({c})") for c in AXES for f in ("min", "max")}


class Tiling:
    """The tiles of a box of cells and the place of cells in them."""

    def __init__(self, box: dict, offsets: Sequence[lattice.Offset]):
        self.low = [box[f"min_{c}"] or 0 for c in AXES]
        self.high = [box[f"max_{c}"] or 0 for c in AXES]
        self.offsets = list(offsets)
        self.reach = max((abs(d) for o in self.offsets for d in o), default=0)
        self.side = SIDE
        self.single = all(b - a < self.side for a, b in zip(self.low, self.high))

    def columns(self, prefix: str = "") -> list[str]:
        return [f"cast((cast({c} AS bigint) - {a}) div {self.side} AS bigint) AS {prefix}{t}" for c, a, t in zip(AXES, self.low, TILE)]

    def sorted(self, df: DataFrame) -> DataFrame:
        """Rows with their tile, whole tiles in a partition and one after the other."""
        nested = isinstance(df.schema["case_id"].dataType, (T.StructType, T.ArrayType, T.MapType))
        rows = df.selectExpr("*", *self.columns(), f"{'to_json(case_id)' if nested else 'case_id'} AS tile_case")
        return rows.repartition("tile_case", *TILE).sortWithinPartitions("tile_case", *TILE)

    def rim(self, cells: str = "") -> str:
        """SQL: the cell lies within reach of a face of its tile."""
        return " OR ".join(f"pmod({cells}{c} - {a}, {self.side}) < {self.reach} OR pmod({cells}{c} - {a}, {self.side}) >= {self.side - self.reach}"
                           for c, a in zip(AXES, self.low))

    def keys(self, table: pa.Table) -> np.ndarray:
        """Number of each row's cell among all tiles of the table."""
        wide = self.side + 2 * self.reach
        key = np.cumsum(starts(table)).astype(np.int64)
        for c, a, t in zip(AXES, self.low, TILE):
            key = key * wide + (whole(table, c) - a - whole(table, t) * self.side + self.reach)
        return key

    def step(self, offset: lattice.Offset) -> int:
        wide = self.side + 2 * self.reach
        return (offset[0] * wide + offset[1]) * wide + offset[2]


def whole(table: pa.Table, name: str) -> np.ndarray:
    """A column of whole numbers, NULL as 0."""
    return table.column(name).cast(pa.int64()).fill_null(0).to_numpy()


def starts(table: pa.Table) -> np.ndarray:
    """Whether a row is the first of its tile."""
    case = table.column("tile_case").combine_chunks().dictionary_encode()
    case = case.combine_chunks() if isinstance(case, pa.ChunkedArray) else case
    new = np.zeros(table.num_rows, bool)
    for values in (case.indices.to_numpy(zero_copy_only=False), *(whole(table, t) for t in TILE)):
        new[1:] |= values[1:] != values[:-1]
    return new


def whole_tiles(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of sorted rows as tables that divide no tile."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= BATCH:
            table = pa.Table.from_batches(held)
            at = np.flatnonzero(starts(table))
            if len(at):
                yield table.slice(0, int(at[-1]))
                table = table.slice(int(at[-1]))
            held, n = table.to_batches(), table.num_rows
    if n:
        yield pa.Table.from_batches(held)


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted keys among sorted ones and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


# --- parts -------------------------------------------------------------------------------------

def labelled(tiling: Tiling, ident: str, columns: list[str]) -> Callable:
    """Map over sorted rows: ``columns`` and ``label``, the smallest id of the part that the cell has inside its tile."""
    def run(parts):
        for table in whole_tiles(parts):
            keys, at = np.unique(tiling.keys(table), return_inverse=True)
            ids, ends = whole(table, ident), []
            for o in tiling.offsets:
                there, hit = found(keys, keys + tiling.step(o))
                ends.append((np.flatnonzero(hit), there[hit]))
            a, b = (np.concatenate(side) for side in zip(*ends))
            top = np.arange(len(keys))
            while True:  # links hook the tops of their ends, pointers are followed to the top
                pa_, pb = top[a], top[b]
                low = np.minimum(pa_, pb)
                new = top.copy()
                np.minimum.at(new, pa_, low)
                np.minimum.at(new, pb, low)
                while not np.array_equal(further := new[new], new):
                    new = further
                if np.array_equal(new, top):
                    break
                top = new
            label = np.full(len(keys), np.iinfo(np.int64).max)
            np.minimum.at(label, top[at], ids)
            linked = np.zeros(len(keys), bool)
            linked[a] = linked[b] = True
            own = np.where(linked[at], label[top[at]], ids)  # rows of one cell are linked by a neighbour only
            yield from table.select(columns).append_column("label", pa.array(own, pa.int64())).to_batches()

    return run


# --- floods ------------------------------------------------------------------------------------

STATE = ["dist", "source", "hop", "parent"]


def relaxed(tiling: Tiling, weights: list[float], budget: float, distance: str, first: bool) -> Callable:
    """Map over sorted rows ``case_id, z, y, x, gid, start, dist, source, hop, parent`` of a flood.

    A row without ``gid`` is an offer from another tile to the cell. Cells come back with their nearest source inside
    the tile and of the offers; every cell that changed offers itself to its neighbours in other tiles.
    """
    kind = np.float64 if distance == "double" else np.int64
    far = np.inf if kind is np.float64 else np.iinfo(np.int64).max // 2
    near = min(weights) * (1 - 1e-9)

    def batch(case: pa.ChunkedArray, place, gid, start, state, blank) -> pa.Table:
        columns = [case, *[pa.array(p, pa.int32()) for p in place], gid, pa.array(start)]
        types = [pa.float64() if kind is np.float64 else pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns += [pa.array(s, t, mask=m) for s, t, m in zip(state, types, blank)]
        return pa.table(columns, names=[*lattice.CELL, "gid", "start", *STATE])

    def run(parts):
        for table in whole_tiles(parts):
            rows, gid, begin = tiling.keys(table), whole(table, "gid"), table.column("start").to_numpy()
            cell = np.asarray(table.column("gid").is_valid())
            order = np.flatnonzero(cell)
            if not len(order):
                continue
            order = order[np.lexsort((gid[order], ~begin[order], rows[order]))]
            order = order[np.concatenate([[True], np.diff(rows[order]) != 0])]
            keys, start = rows[order], begin[order]
            given = table.column("dist").fill_null(far).to_numpy().astype(kind)
            reached = [given, *(whole(table, c) for c in STATE[1:])]
            state = [s[order].copy() for s in reached]
            dist = state[0]
            dirty, told = start & first, np.zeros(len(keys), bool)

            def offer(to, new):
                """Cells (each once) take what is nearer; of equals the smaller source, fewer hops, the smaller parent."""
                less, same = np.zeros(len(to), bool), np.ones(len(to), bool)
                for have, value in zip(state, new):
                    less |= same & (value < have[to])
                    same &= value == have[to]
                for have, value in zip(state, new):
                    have[to[less]] = value[less]
                dirty[to[less]] = True

            sent = np.flatnonzero(~cell)
            sent = sent[np.lexsort(tuple(s[sent] for s in reversed([rows, *reached])))]
            sent = sent[np.diff(rows[sent], prepend=-1) != 0]
            to, hit = found(keys, rows[sent])
            hit &= ~start[to]
            offer(to[hit], [s[sent[hit]] for s in reached])
            while dirty.any():
                at = np.flatnonzero(dirty)
                at = at[dist[at] < dist[at].min() + near]
                dirty[at], told[at] = False, True
                for o, w in zip(tiling.offsets, weights):
                    to, hit = found(keys, keys[at] + tiling.step(o))
                    hit &= ~start[to]
                    by, to = at[hit], to[hit]
                    d = (dist[by] + w).astype(kind)
                    hit = d <= budget
                    by, to = by[hit], to[hit]
                    offer(to, [d[hit], state[1][by], state[2][by] + 1, gid[order[by]]])

            case, place = table.column("case_id"), [whole(table, c) for c in AXES]
            shown = np.flatnonzero(dist < far) if tiling.single else np.arange(len(keys))
            own, none = order[shown], dist[shown] >= far
            yield from batch(case.take(own), [p[own] for p in place], table.column("gid").take(own).cast(pa.int64()), start[shown],
                             [s[shown] for s in state], [none, none, none, none | start[shown]]).to_batches()
            if tiling.single:
                continue
            by = np.flatnonzero(told)
            spot = [p[order[by]] for p in place]
            for o, w in zip(tiling.offsets, weights):
                to = [p + d for p, d in zip(spot, o)]
                out = np.zeros(len(by), bool)
                for p, t, a, b in zip(spot, to, tiling.low, tiling.high):
                    out |= (p - a) // tiling.side != (t - a) // tiling.side
                for t, a, b in zip(to, tiling.low, tiling.high):
                    out &= (t >= a) & (t <= b)
                d = (dist[by] + w).astype(kind)
                out &= d <= budget
                if out.any():
                    own, no = order[by[out]], np.zeros(int(out.sum()), bool)
                    yield from batch(case.take(own), [t[out] for t in to], pa.nulls(len(own), pa.int64()), no,
                                     [d[out], state[1][by[out]], state[2][by[out]] + 1, gid[own]], [no] * 4).to_batches()

    return run
