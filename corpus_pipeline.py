"""Corpus pipeline: language ID, near-dedup, benchmark decontamination, redaction, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows to the
shared folder and reads them back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxarbor.llm import bpe, decontaminate, language, privacy, simhash
from voxarbor.llm.common import fold, settled, table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The stages keep whole rows and decide by hashed text where SQL has no equal, so tests hold them against brute force.
ORACLE_SQL = None


def row_key() -> Column:
    """The document's id; rows without one are named by their text, above all ids."""
    return F.coalesce(F.col("doc_id"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; dictionaries are learned from three quarters of the labelled ones."""
    docs = docs.select(*COLUMNS)
    learned = language.learn_dictionaries(docs.where(fold(folds=4) != 2))
    return language.recognised(docs, learned)


def row_id() -> Column:
    """Identity of a row: the hash of its document's id and its text, so two texts under one id are two rows."""
    return F.xxhash64(row_key(), F.col("text").isNull(), F.coalesce(F.col("text"), F.lit("")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each near-duplicate group, of several texts under that id the one with the
    smallest hash; rows of equal id and text are one."""
    keyed = docs.select(*COLUMNS, row_id().alias("row_id"))
    groups = simhash.near_groups(keyed, key="row_id").select("row_id", "component_id").distinct()
    ids = docs.select(row_id().alias("row_id"), row_key().alias("row_key")).distinct()
    first = groups.join(ids, "row_id").groupBy("component_id").agg(
        F.min(F.struct("row_key", "row_id")).alias("first")).select("first.row_id")
    return keyed.join(first, "row_id", "left_semi").dropDuplicates(["row_id"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark windows; each text under one id is judged by itself."""
    keyed = docs.select(*COLUMNS, row_id().alias("row_id"))
    marked = decontaminate.mark(keyed, decontaminate.with_names(table(spark, sf_dir, "benchmark")), key="row_id")
    bad = settled(spark, marked.where("contaminated").select("row_id").distinct(), "contaminated")
    return keyed.join(bad, "row_id", "left_anti").select(*COLUMNS)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, ``n_chars`` counted anew."""
    docs = docs.select(*COLUMNS)
    return privacy.redact(docs, privacy.learn(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed as little-endian 32-bit numbers, with the digests of ids and decoded bytes."""
    import public_tokenizers

    ranks = bpe.ranks(vocabulary("byte_bpe_50k.tiktoken"))
    # written in between: a task that encodes and decodes at once holds two Python processes until both are done
    coded = settled(spark, bpe.encode(docs, ranks, public_tokenizers.PATTERN, chars=2_000_000), "token-ids")
    return bpe.decode(coded, ranks).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_private),
    ("byte-level BPE", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = settled(spark, docs, f"pipeline-{number}")
    return docs
