"""Token counts by overlap resynchronisation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.llm.common import short_batches, slices

SPACES = " \n\t\r"
DIGITS = "0123456789"


def stable(text: str, at: int) -> bool:
    """Whether a token boundary at ``at`` holds whatever stands before or after.

    The pre-tokenizer never crosses white space and takes every digit alone, so
    its scan starts afresh there; normalisation does not reach across either,
    as long as the next character is ASCII or follows white space.
    """
    return text[at - 1] in SPACES or text[at].isascii() and (text[at] in DIGITS or text[at - 1] in DIGITS)


def spliced_count(encode, text: str, chunk: int, overlap: int) -> int:
    """Tokens of ``text``; ``encode(part)`` returns the start offset of each token of a part.

    Neighbouring chunks are spliced at the last token start that both have in
    their overlap and that is proven stable. Without one the overlap widens
    until the next chunk begins at the last splice and replaces its
    predecessor; chunks then grow, so hopeless texts cost a constant factor.
    """
    counted, splice, end = 0, 0, min(chunk, len(text))
    held = encode(text[:end])
    while end < len(text):
        width = overlap
        while True:
            begin = max(end - width, splice)
            until = min(len(text), end + max(chunk - width, end - begin))
            new = [begin + s for s in encode(text[begin:until])]
            known = {s for s in new if begin < s < end}
            common = [s for s in held if s in known and stable(text, s)]
            if common:
                at = max(common)
                counted += sum(s < at for s in held)
                held, splice = [s for s in new if s >= at], at
                break
            if begin == splice:
                held = new
                break
            width *= 2
        end = until
    return counted + len(held)


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 2048,
                 chunk: int = 32768, overlap: int = 512, rows: int = 1000) -> DataFrame:
    """Bytes and tokens of every text as the tokenizer file ``vocabulary`` gives them.

    A text over ``chunk`` characters is encoded in overlapping chunks that are
    spliced (``spliced_count``). Shorter texts of a batch share their work: the
    distinct pieces between blanks are encoded once each, which the same
    boundary argument makes exact. Null and empty texts have no bytes and no
    tokens; repeated rows are counted row by row; other columns are dropped.
    Every text stays in its task, so there is no shuffle.
    """
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def count(parts):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def starts(part):
            return [a for a, _ in tokenizer.encode(part, add_special_tokens=False).offsets]

        known = {}
        for whole in parts:
            for part in slices(whole, rows):
                texts = [t or "" for t in part.column(1).to_pylist()]
                pieces = [None if len(t) > chunk else t.replace("\n", " ").split(" ") for t in texts]
                if len(known) > 400_000:  # bounds memory, not results
                    known.clear()
                fresh = list({w for p in pieces if p for w in p if w not in known})
                for at in range(0, len(fresh), 20_000):
                    some = fresh[at:at + 20_000]
                    for w, e in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                        known[w] = len(e)
                counts = [spliced_count(starts, t, chunk, overlap) if p is None else sum(map(known.__getitem__, p))
                          for t, p in zip(texts, pieces)]
                yield pa.RecordBatch.from_pydict(
                    {"key": part.column(0), "n_tokens": counts, "n_bytes": part.column(2)}, schema=schema)

    short_batches(docs.sparkSession)
    picked = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"),
                         F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return picked.mapInArrow(count, "key long, n_tokens long, n_bytes long").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
