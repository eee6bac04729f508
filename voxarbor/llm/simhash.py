"""SimHash fingerprints and near-duplicate groups by a binary trie self-join."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.llm.common import keyed_texts, settled, slices
from voxarbor.operators.graph import components

WIDTHS = (11, 11, 11, 11, 10, 10)


def prefixes(budget: int) -> list[int]:
    """Bit masks of the trie tops: two of six blocks, one mask per choice of blocks.

    Up to four differing bits leave two of the six blocks untouched, so every
    linked pair shares the bits under one of the fifteen masks.
    """
    if not 0 <= budget <= len(WIDTHS) - 2:
        raise ValueError("the trie tops serve at most four differing bits")
    blocks, at = [], 0
    for width in WIDTHS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [a | b for a, b in combinations(blocks, 2)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash of the word shingles of a text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxh64_intdigest(b" ".join(parts), 42)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in
                       zip(starts[:len(parts) - words + 1].tolist(), ends[words - 1:].tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, rows: int = 500) -> DataFrame:
    """``key, fp``: the fingerprint of every whole text as a signed long; null and blank texts have zero."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(parts):
        for whole in parts:
            for part in slices(whole, rows):
                found = [signed(fingerprint(t, words)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"key": part.column(0), "fp": found}, schema=schema)

    return keyed_texts(docs, key, text).mapInArrow(
        run, "key long, fp long")


def popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


def trie_join(left: np.ndarray, right: np.ndarray | None, bounds: np.ndarray, more: np.ndarray | None, budget: int):
    """Pairs of positions within ``budget`` differing bits, by descending tries together.

    ``left`` holds unsigned fingerprints, sorted inside each trie; trie i takes
    the positions ``bounds[i]:bounds[i + 1]``. With ``right`` and ``more`` trie i
    of the left meets trie i of the right, otherwise each trie meets itself.
    Node pairs of all tries descend bit by bit as one frontier; a pair is
    dropped as soon as its differing bits exceed the budget.
    """
    alone = right is None
    right, more = (left, bounds) if alone else (right, more)
    a0, a1, b0, b1 = bounds[:-1], bounds[1:], more[:-1], more[1:]
    spent, same = np.zeros(len(a0), np.int8), np.full(len(a0), alone)
    found = []
    for bit in range(63, -2, -1):
        live = (spent <= budget) & (a1 > a0) & (b1 > b0) & ~(same & (a1 - a0 < 2))
        done = live & (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[done], b0[done]
        close = popcount(left[i] ^ right[j]) <= budget
        found.append((i[close], j[close]))
        live &= ~done
        if bit < 0 or not live.any():
            break
        a0, a1, b0, b1, spent, same = (x[live] for x in (a0, a1, b0, b1, spent, same))
        ones_a = np.concatenate(([0], np.cumsum((left >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        ones_b = ones_a if alone else np.concatenate(
            ([0], np.cumsum((right >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        am, bm = a1 - (ones_a[a1] - ones_a[a0]), b1 - (ones_b[b1] - ones_b[b0])
        cross = ~same
        a0, a1, b0, b1, spent, same = (
            np.concatenate((a0, am, a0, am[cross])), np.concatenate((am, a1, am, a1[cross])),
            np.concatenate((b0, bm, bm, b0[cross])), np.concatenate((bm, b1, b1, bm[cross])),
            np.concatenate((spent, spent, spent + 1, spent[cross] + 1)),
            np.concatenate((same, same, np.zeros(len(same) + int(cross.sum()), bool))))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links with the components of the links ``a, b`` (values): one link per value but the smallest."""
    values, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = flat[:len(a)], flat[len(a):]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(values))
    return values[off], values[label[off]]


def trie_links(distinct: DataFrame, budget: int = 4, hot: int = 2048) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints ``fp`` that give the same components as all pairs
    within ``budget`` differing bits.

    A trie top is a mask of ``prefixes`` with its bits. Tops are dealt over the
    cluster; in each task the tries below them join themselves and every
    trie's pairs are reduced to stars, so a group of n near copies leaves fewer
    than n links per mask. A top with more than ``hot`` fingerprints is first
    split: its children over eight further bits become the node pairs within
    the budget, each pair a unit of its own.
    """
    masks = prefixes(budget)
    tops = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("top"))
        for i, m in enumerate(masks)])).alias("t")).select("fp", "t.mask", "t.top")
    sizes = tops.groupBy("mask", "top").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    sizes = settled(distinct.sparkSession, sizes, "simhash-hot")
    crowded = not sizes.isEmpty()
    cold = tops.join(sizes, ["mask", "top"], "left_anti") if crowded else tops
    units = cold.select("fp", "mask", "top", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"))
    if crowded:
        units = units.unionByName(_split(tops.join(sizes, ["mask", "top"]), masks, budget))
    dealt = units.repartition("mask", "top", "a", "b").sortWithinPartitions("mask", "top", "a", "b", "side")
    return dealt.mapInArrow(_joiner(budget), "a long, b long")


def _split(rows: DataFrame, masks: list[int], budget: int) -> DataFrame:
    """Rows of crowded tops, once for each node pair of their children that their own child belongs to."""
    spare = []
    for mask in masks:
        free = [b for b in range(64) if not mask >> b & 1]
        spare.append(free[::len(free) // 8][:8])
    child = F.lit(0)
    for i, bits in enumerate(spare):
        value = sum((F.shiftright(F.col("fp"), b).bitwiseAND(F.lit(1)).cast("int") * (1 << k)
                     for k, b in enumerate(bits)), F.lit(0))
        child = F.when(F.col("mask") == i, value).otherwise(child)
    rows = rows.select("fp", "mask", "top", child.alias("child"))
    have = rows.groupBy("mask", "top").agg(F.collect_set("child").alias("have"))  # at most 256 values
    near = F.filter("have", lambda c: F.bit_count(c.bitwiseXOR(F.col("child"))) <= budget)
    return rows.join(have, ["mask", "top"]).select("fp", "mask", "top", "child", F.explode(near).alias("other")).select(
        "fp", "mask", "top", F.least("child", "other").alias("a"), F.greatest("child", "other").alias("b"),
        F.when(F.col("child") > F.col("other"), 1).otherwise(0).alias("side"))


def _joiner(budget: int, rows: int = 200_000):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def units(parts):
        """Runs of whole units, as arrays ``fp, unit number, side``."""
        held = None
        for part in parts:
            if not part.num_rows:
                continue
            cols = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                    for c in ("fp", "mask", "top", "a", "b", "side")]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if len(held[0]) < rows:
                continue
            keys = np.stack(held[1:5])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0))
            if len(cut):
                at = cut[-1] + 1
                yield [x[:at] for x in held]
                held = [x[at:] for x in held]
        if held is not None:
            yield held

    def run(parts):
        for fp, *keys, side in units(parts):
            keys = np.stack(keys)
            unit = np.concatenate(([0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))))
            value = fp.view(np.uint64)
            order = np.lexsort((value, side, unit))
            value, unit, side = value[order], unit[order], side[order]
            crossed = np.flatnonzero(keys[2] != keys[3])  # units between two different children
            both = np.unique(unit[crossed]) if len(crossed) else np.zeros(0, np.int64)
            one = ~np.isin(unit, both)
            ends = [trie_pairs(value[one], unit[one], None, None, budget)]
            if len(both):
                a, b = ~one & (side == 0), ~one & (side == 1)
                ends.append(trie_pairs(value[a], unit[a], value[b], unit[b], budget, both))
            found = [(x, y, u) for x, y, u in ends if len(x)]
            if not found:
                continue
            x, y, u = (np.concatenate(z) for z in zip(*found))
            a, b = forest(x.view(np.int64), y.view(np.int64))
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=schema)

    return run


def trie_pairs(value, unit, other, of, budget, numbers=None):
    """Linked values of each unit, by ``trie_join``; with ``other`` between the two sides of each unit."""
    if other is None:
        at = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1]))) if len(unit) else np.zeros(0, np.int64)
        bounds = np.append(at, len(unit))
        i, j = trie_join(value, None, bounds, None, budget)
        return value[i], value[j], unit[i]
    bounds, more = np.searchsorted(unit, np.append(numbers, numbers[-1] + 1)), np.searchsorted(
        of, np.append(numbers, numbers[-1] + 1))
    i, j = trie_join(value, other, bounds, more, budget)
    return value[i], other[j], unit[i]


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, budget: int = 4) -> DataFrame:
    """``key, fingerprint, component_id`` of every document.

    Fingerprints link at ``budget`` or fewer differing bits; a component carries
    its smallest key. Exact copies meet as one fingerprint before the join.
    Null, blank and empty texts have fingerprint zero and are linked like any
    other; repeated rows keep their number; an empty table gives no row; other
    columns are dropped. Rows without a key keep a null key and take no part as
    a component's name.
    """
    spark = docs.sparkSession
    marked = settled(spark, fingerprints(docs, key, text, words), "simhash-fp")
    distinct = settled(spark, marked.groupBy("fp").agg(F.min("key").alias("first")), "simhash-distinct")
    links = settled(spark, trie_links(distinct.select("fp"), budget).distinct(), "simhash-links")
    found = components(distinct.select(F.col("fp").alias("id")), links)
    named = found.join(distinct.withColumnRenamed("fp", "id"), "id")
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    placed = named.join(lowest, "label").select(F.col("id").alias("fp"), "component_id")
    return marked.join(placed, "fp").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
