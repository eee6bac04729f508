"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are word sequences. The fingerprints of a text are, for each run of
``WINDOW`` words, the smallest hash of its ``GRAM``-word grams, so two texts
that share a run of ``WINDOW`` words share a fingerprint. Documents that share
one with the benchmark are candidates; in them each gram found in an item gives
an alignment, which is extended word by word over the whole item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxarbor.llm.common import settled

WINDOW = 13
GRAM = 6
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """Words of a text with A-Z in lower case; null has none. ASCII texts take the faster function."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.coalesce(F.array_remove(F.split(low, BETWEEN, -1), ""), F.array().cast("array<string>"))


def grams(words: str, size: int) -> Column:
    """64-bit hashes of the runs of ``size`` words, in order."""
    n = F.size(words)
    return F.when(n >= size, F.transform(
        F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))).otherwise(
        F.array().cast("array<bigint>"))


def winnowed(hashes: str) -> Column:
    """Distinct smallest hashes of the sliding windows over ``grams(words, GRAM)``."""
    width = WINDOW - GRAM + 1
    n = F.size(hashes)
    return F.when(n >= width, F.array_distinct(F.transform(
        F.sequence(F.lit(1), n - (width - 1)), lambda i: F.array_min(F.slice(hashes, i, F.lit(width)))))).otherwise(
        F.array().cast("array<bigint>"))


NAMELESS = "\0"


def with_names(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``benchmark`` with ids as strings; a row without one is named by its text, ``NAMELESS`` first.

    ``mark`` leaves rows without an id out; under these names their windows are hit like any other.
    """
    name = F.concat(F.lit(NAMELESS), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).cast("string"))
    return benchmark.withColumn(item, F.coalesce(F.col(item).cast("string"), name))


def without_nameless(items: Column) -> Column:
    """The ids in a list of ``mark``'s items without the names of rows that have none."""
    return F.filter(items, lambda i: ~i.startswith(NAMELESS))


def mark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """``key, n_words, n_hit, n_items, items, contaminated`` of every document.

    A window is ``WINDOW`` consecutive words of an item, or a whole shorter
    item; a document word inside an occurring window is hit. ``items`` lists
    the ids of occurring items, as strings in order. A document is contaminated
    if at least a twentieth of its words is hit. Null, empty and wordless texts
    have no words, hits or windows; repeated rows are marked row by row, items
    repeated under one id count once, items without an id are left out unless
    they are named (``with_names``); an empty table on either side gives no
    hits; other columns are dropped.

    Grams are compared as 64-bit hashes to find alignments, windows of long
    items word by word. The benchmark's side of each join is written first, so
    the planner knows its size and broadcasts it only below its threshold.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), words_of(item_text).alias("item_words")).where(
        (F.size("item_words") > 0) & F.col("item").isNotNull()).distinct()
    long = items.where(F.size("item_words") >= WINDOW).withColumn("hashes", grams("item_words", GRAM))
    short = items.where(F.size("item_words") < WINDOW).select(
        "item", F.size("item_words").alias("size"), F.xxhash64("item_words").alias("h"))
    short = settled(spark, short, "decon-short")
    sizes = sorted(r["size"] for r in short.select("size").distinct().collect())  # at most twelve numbers
    prints = long.select(F.explode(winnowed("hashes")).alias("h")).union(short.select("h")).distinct()
    prints = settled(spark, prints, "decon-prints")

    # every document: its words counted and its fingerprints, with all grams of the short items' lengths
    read = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    worded = read.withColumn("words", words_of("text"))
    seen = worded.withColumn("hashes", grams("words", GRAM)).select(
        "key", "body", F.size("words").cast("long").alias("n_words"),
        F.array_distinct(F.concat(winnowed("hashes"), *[grams("words", n) for n in sizes])).alias("prints"))
    seen = settled(spark, seen, "decon-seen")
    found = seen.select("key", "body", F.explode("prints").alias("h")).join(prints, "h", "left_semi")
    found = settled(spark, found.select("key", "body").distinct(), "decon-found")

    # candidates only: alignments from equal grams, then extension
    same = [F.col("d.key").eqNullSafe(F.col("f.key")), F.col("d.body") == F.col("f.body")]
    near = worded.alias("d").join(found.alias("f"), same, "left_semi").select("key", "body", "words")
    near = settled(spark, near.dropDuplicates(["key", "body"]).withColumn(
        "id", F.monotonically_increasing_id()), "decon-near")
    places = long.select("item", F.posexplode("hashes").alias("at", "h"))
    places = settled(spark, places, "decon-places")
    aligned = near.select("id", F.posexplode(grams("words", GRAM)).alias("place", "h")).join(places, "h").select(
        "id", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    facing = aligned.join(near.select("id", "words"), "id").join(long.select("item", "item_words"), "item").select(
        "id", "item", "shift", "item_words",
        F.slice("words", F.greatest("shift", F.lit(0)) + 1, F.size("item_words")).alias("facing"))
    first = F.greatest(-F.col("shift"), F.lit(0))  # first item word that faces a document word
    equal = facing.withColumn("equal", F.transform(
        "facing", lambda w, i: w == F.get("item_words", i + first)))
    # an item word past the item's end faces null, which is not equal
    equal = equal.withColumn("equal", F.transform("equal", lambda e: F.coalesce(e, F.lit(False))))
    hits = equal.where(F.size("equal") >= WINDOW).select(
        "id", "item", F.explode(F.filter(
            F.sequence(F.lit(1), F.size("equal") - (WINDOW - 1)),
            lambda i: ~F.array_contains(F.slice("equal", i, F.lit(WINDOW)), F.lit(False)))).alias("i"),
        F.greatest("shift", F.lit(0)).alias("base")).select(
        "id", "item", (F.col("base") + F.col("i") - 1).alias("start"), F.lit(WINDOW).alias("size"))
    for n in sizes:
        own = short.where(F.col("size") == n).select("item", "h")
        hits = hits.union(near.select("id", F.posexplode(grams("words", n)).alias("start", "h")).join(own, "h").select(
            "id", "item", "start", F.lit(n).alias("size")))

    spans = hits.groupBy("id", "start").agg(F.max("size").alias("size"))
    spans = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(
        "start", (F.col("start") + F.col("size")).alias("end")))).alias("spans")).select("id", F.aggregate(
            "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda acc, s: F.struct(
                (acc.n + F.greatest(s.end - F.greatest(acc.end, s.start), F.lit(0))).cast("long").alias("n"),
                F.greatest(acc.end, s.end).alias("end"))).n.alias("n_hit"))
    named = hits.select("id", "item").distinct().groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    marked = near.select("id", F.col("key").alias("k"), F.col("body").alias("b")).join(spans, "id").join(named, "id")
    full = seen.join(marked, F.col("key").eqNullSafe(F.col("k")) & (F.col("body") == F.col("b")), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return full.select(
        F.col("key").alias(key), "n_words", hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))


SQL = r"""
WITH low AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
it AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (
    SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
    FROM it WHERE len(w) > 0)),
grams AS (
  SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (
    SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i
    FROM low, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT rid, item_id, i, m FROM grams JOIN win USING (m, g)),
pos AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM hit))
  GROUP BY rid),
named AS (
  SELECT rid, count(*) AS k, sha256(string_agg(s, ',' ORDER BY s)) AS h
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(k, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM low LEFT JOIN pos USING (rid) LEFT JOIN named USING (rid)
"""
