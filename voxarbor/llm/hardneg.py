"""Hard negatives by the threshold algorithm of Fagin, Lotem and Naor.

Candidates lie in blocks; a block keeps, for every dimension, its rows in the
order of that coordinate. An anchor reads the lists from the end that its own
sign favours, to a growing depth, and scores each row it meets there by the whole
inner product. What is still unseen scores at most the sum of the next values of
all lists; once that bound is strictly below what every open window still needs,
the block is finished. Bounds reached in earlier blocks of a part hold for the next.

Anchors grow with the table, so they come in chunks of bounded size: a chunk is
sent to all parts, which return their best rows per window.
"""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxarbor.session import Rounds

#: Rows of a block; below 65,536, so that its lists fit 16 bits.
BLOCK = 8192
#: Anchors on the road at once.
CHUNK = 16_384
#: Coordinates are held within this range, so that scores stay whole numbers of 64 bits.
REACH = float(1 << 24)
LEAST = -(1 << 62)
BLOCK_SCHEMA = "ids binary, labels binary, x binary, lists binary"


def candidates(df: DataFrame, step: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id, label, x``: the vector on a grid of 1/step, one row per id.

    Rows without an id or label, or with a vector that is null, empty or not
    finite in every entry, take no part; of several rows with one id the least by
    label and vector counts. Vectors of another length than the commonest one (of
    several the longest) take no part.
    """
    c = F.col("vector")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf"))
    entry = lambda e: F.floor(F.greatest(F.least(e.cast("double") * step, F.lit(REACH)), F.lit(-REACH))).cast("int")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, bad))
    return rows.select("id", "label", F.transform(c, entry).alias("x"))


def _packed(batches):
    """Blocks of rows with the sorted list of every dimension."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(at, BLOCK)
            x = piece.column("x").flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1).astype(np.int32)
            lists = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16)
            yield pa.RecordBatch.from_pydict({
                "ids": [piece.column("id").to_numpy().tobytes()], "labels": [piece.column("label").to_numpy().tobytes()],
                "x": [x.tobytes()], "lists": [np.ascontiguousarray(lists).tobytes()]})


class Block:
    """One block's rows, lists and the values along each list."""

    def __init__(self, row: dict, size: int):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        x = np.frombuffer(row["x"], np.int32).reshape(-1, size)
        self.lists = np.frombuffer(row["lists"], np.uint16).reshape(size, -1)
        self.largest = int(np.abs(x).max(initial=0))
        self.values = np.take_along_axis(x.T, self.lists.astype(np.int64), axis=1)
        self.x = x
        self.kinds: dict = {}

    def scored(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Whole inner products, in the fastest arithmetic that is exact for them."""
        most = self.largest * int(np.abs(anchor).max(initial=0)) * len(anchor)
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        if kind not in self.kinds:
            self.kinds[kind] = self.x.astype(kind)
        return (self.kinds[kind][rows] @ anchor.astype(kind)).astype(np.int64)


class Wish:
    """The best ``k`` rows of one anchor with a score in [low, high], best score and then smallest id first."""

    __slots__ = ("low", "high", "k", "best")

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k, self.best = low, high, k, []

    def needs(self) -> int:
        """Rows below this score cannot enter; rows that reach it can."""
        return max(self.low, -self.best[-1][0]) if len(self.best) == self.k else self.low

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = np.flatnonzero((scores >= self.needs()) & (scores <= self.high))
        if len(fit) > self.k:
            fit = fit[np.lexsort((ids[fit], -scores[fit]))[:self.k]]
        for i in fit:
            insort(self.best, (-int(scores[i]), int(ids[i])))
        del self.best[self.k:]


def descend(block: Block, own: int, anchor: np.ndarray, label: int, wishes: list[Wish], same: bool) -> int:
    """Threshold algorithm of one anchor in one block; returns how many rows it scored."""
    m = len(block.ids)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    weights = anchor.astype(np.int64)
    seen, depth, touched = np.zeros(m, bool), 0, 0
    while depth < m:
        bound = int(weights[up] @ block.values[up, m - 1 - depth].astype(np.int64)
                    + weights[down] @ block.values[down, depth].astype(np.int64))
        if bound < min(w.needs() for w in wishes):
            break
        further = min(m, max(2 * depth, m // 128, 1))
        if len(up) + len(down) == 0:
            further = m  # an anchor of zeros has no list to read: every row scores nothing
            met = np.ones(m, bool)
        else:
            met = np.zeros(m, bool)
            met[block.lists[up, m - further:m - depth].ravel()] = True
            met[block.lists[down, depth:further].ravel()] = True
        new = np.flatnonzero(met & ~seen)
        seen |= met
        depth, touched = further, touched + len(new)
        new = new[(block.labels[new] == label) == same]
        new = new[block.ids[new] != own]
        scores = block.scored(new, anchor)
        likely = scores >= min(w.needs() for w in wishes)
        scores, ids = scores[likely], block.ids[new[likely]]
        for wish in wishes:
            wish.offer(scores, ids)
    return touched


def _search(blocks: DataFrame, size: int, chunk: dict, same: bool, k: int) -> DataFrame:
    """Each part's best rows of every window of the chunk: ``anchor, positive, positive_score, other, score``."""
    shared = blocks.sparkSession.sparkContext.broadcast(chunk)
    schema = "anchor bigint, positive bigint, positive_score bigint, other bigint, score bigint"

    def part(batches):
        held = shared.value
        wishes = [[Wish(low, high, k) for _, _, low, high in windows] for windows in held["windows"]]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block({n: batch.column(n)[i].as_py() for n in ("ids", "labels", "x", "lists")}, size)
                for at, wish in enumerate(wishes):
                    if wish:
                        descend(block, int(held["ids"][at]), held["x"][at], int(held["labels"][at]), wish, same)
        out = [(int(held["ids"][at]), *held["windows"][at][j][:2], other, -score)
               for at, own in enumerate(wishes) for j, wish in enumerate(own) for score, other in wish.best]
        for at in range(0, len(out), 50_000):
            columns = zip(*out[at:at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             ["anchor", "positive", "positive_score", "other", "score"])

    return blocks.mapInArrow(part, schema)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100),
         high: tuple[int, int] = (95, 100), block_parts: int | None = None, chunk_rows: int = CHUNK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``candidates``.

    An anchor's positives are the other rows of its label with the best scores;
    for each, the best rows of other labels whose score lies between the shares
    ``low`` and ``high`` of the positive's. A negative positive score leaves an
    empty window; labels without other rows leave no positives. Exact: the
    threshold only ends a block whose unseen rows cannot enter any window.

    The blocks are written once. Every chunk of anchors takes two searches over
    them, one for positives and one for all their windows, and writes its rows.
    """
    spark = rows.sparkSession
    schema = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
              "negative_score bigint")
    sizes = rows.groupBy(F.size("x").alias("size")).agg(
        F.count("*").alias("n"), F.sum(is_anchor.cast("long")).alias("anchors")).orderBy(F.desc("n"), F.desc("size")).first()
    if sizes is None or not sizes["anchors"]:
        return spark.createDataFrame([], schema)
    size = sizes["size"]
    parts = block_parts or max(2 * spark.sparkContext.defaultParallelism, math.ceil(sizes["n"] / (8 * BLOCK)))
    rounds = Rounds(spark, "hard-negatives")
    single = rows.where(F.size("x") == size).repartition(parts, "id").groupBy("id").agg(
        F.min(F.struct("label", "x")).alias("row")).select("id", "row.label", "row.x")
    blocks, _ = rounds.save(single.mapInArrow(_packed, BLOCK_SCHEMA))
    # the chunk is a hash of the id, so it holds about chunk_rows anchors and each anchor lies in one chunk
    chunks = math.ceil(sizes["anchors"] / chunk_rows)
    anchors, _ = rounds.save(rows.where((F.size("x") == size) & is_anchor).groupBy("id").agg(
        F.min(F.struct("label", "x")).alias("row")).select(
            "id", "row.label", "row.x", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk")))
    done = None
    for number in range(chunks):
        mine_now = anchors.where(F.col("chunk") == number).toArrow()
        if not mine_now.num_rows:
            continue
        ids = mine_now.column("id").to_pylist()
        chunk = {"ids": np.array(ids), "labels": mine_now.column("label").to_numpy(),
                 "x": np.array(mine_now.column("x").to_pylist(), np.int32),
                 "windows": [[(0, 0, LEAST, -LEAST)] for _ in ids]}
        best, _ = rounds.save(_first(_search(blocks, size, chunk, True, positives), ["anchor"], positives))
        place, windows = {a: i for i, a in enumerate(ids)}, [[] for _ in ids]
        for r in best.select("anchor", "other", "score").toArrow().to_pylist():
            score = r["score"]
            window = -(-low[0] * score // low[1]), high[0] * score // high[1]
            if window[0] <= window[1]:
                windows[place[r["anchor"]]].append((r["other"], score, *window))
        found = _first(_search(blocks, size, chunk | {"windows": windows}, False, negatives), ["anchor", "positive"], negatives)
        out, _ = rounds.save(found.select(
            F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
            F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        done = out if done is None else done.unionByName(out)
        rounds.retire(best)
    return done


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         list_dot_product(a.x, b.x)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3
"""
