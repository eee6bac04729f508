"""Language identification by compression with one dictionary per language."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from voxarbor.llm.common import bounded_sample, short_batches

UNKNOWN = "und"


def learn_dictionaries(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                       docs_per_language: int = 400, piece: int = 300, size: int = 60_000) -> dict[str, bytes]:
    """Raw-content dictionary of each language from a bounded sample of labelled rows.

    Of about ``docs_per_language`` rows, chosen by a hash of the key, a piece of
    ``piece`` characters at a hashed place is joined up to ``size`` bytes. Rows without text,
    letters or language teach nothing; an empty table gives no language.
    """
    labelled = labelled.where(F.col(text).rlike(r"\p{L}")).select(*dict.fromkeys((key, text, lang)))
    rows = bounded_sample(labelled, key, lang, docs_per_language).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("at"),
        F.expr(f"substring({text}, 1 + int(pmod(xxhash64({text}), greatest(1, length({text}) - {piece}))), {piece})")
        .alias("text")).collect()
    learned: dict[str, bytes] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["at"], r["text"])):
        have = learned.get(row["lang"], b"")
        if len(have) < size:
            learned[row["lang"]] = have + row["text"].lower().encode()[:size - len(have)] + b"\n"
    return learned


def judged(learned: dict[str, bytes], text: Column, block: int = 1024, level: int = 9, narrow: float = 0.002) -> Column:
    """Struct ``lang_pred, score, rejected`` of a text column; see ``identify``."""
    names = sorted(learned)

    def judge(parts):
        import regex
        import zstandard

        letter = regex.compile(r"\p{L}")
        coders = []
        for name in names:
            content = zstandard.ZstdCompressionDict(learned[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False,
                                                   write_checksum=False, write_dict_id=False).compress)

        def decide(value):
            if value is None or not names or not letter.search(value):
                return UNKNOWN, 0.0, True
            data = value.lower().encode()
            blocks = [data[i:i + block] for i in range(0, len(data), block)]
            sizes = sorted((sum(len(coder(b)) for b in blocks), name) for coder, name in zip(coders, names))
            if len(sizes) == 1:
                return sizes[0][1], 1.0, False
            lead = sizes[1][0] - sizes[0][0]
            return sizes[0][1], 1.0 - 2.0 ** -min(lead, 60), lead <= narrow * sizes[0][0]

        for part in parts:
            yield pd.DataFrame([decide(t) for t in part], columns=["lang_pred", "score", "rejected"])

    udf = F.pandas_udf(judge, "lang_pred string, score double, rejected boolean", PandasUDFType.SCALAR_ITER)
    return udf(text)


def identify(docs: DataFrame, learned: dict[str, bytes], key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``key, lang_pred, score, rejected``: the dictionary with which a text compresses to the fewest bytes.

    The whole text is compressed in blocks, so the dictionary keeps its say in
    long texts. ``score`` is 1 - 2^-d for a lead of d bytes over the second
    language, and ``rejected`` marks a lead of at most ``narrow`` of the best
    size; an exact tie takes the first language by name and is rejected. Null
    texts and texts without letters are ``und``, score 0, rejected, as is every
    text if no language was learned; with one language its score is 1. Repeated
    rows are judged row by row and other columns are dropped.
    """
    short_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("key"), judged(learned, F.col(text), **settings).alias("j")).select(
        F.col("key").alias(key), "j.*")


def recognised(docs: DataFrame, learned: dict[str, bytes], text: str = "text", **settings) -> DataFrame:
    """The rows whose language is not rejected, with all their columns."""
    short_batches(docs.sparkSession)
    found = docs.select(F.struct("*").alias("row"), judged(learned, F.col(text), **settings).alias("j"))
    return found.where(~F.col("j.rejected")).select("row.*")
