"""Byte-level BPE over a corpus: every distinct word is encoded once, in one global shuffle of words.

Documents are taken in blocks. A block's pre-tokens are kept as positions of its
own distinct words, numbered by frequency. Its words travel, packed by hash
bucket, to the one task that encodes all words of that bucket; the ids travel
back to the block, where the positions put them in order. What is shuffled per
block is a word once, however often the block or the corpus repeats it, so a
word that makes up a third of all text weighs as much as any other.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.llm.common import keyed_texts, slices

BLOCK = "block long, bucket int, body binary"
LONG = 1_000_000
KEPT = 300_000


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a tiktoken rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes, each with its item type and length."""
    import zstandard

    out = []
    for x in arrays:
        x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)) if x.dtype.kind == "u" else x
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
        body = zstandard.ZstdCompressor(level=3).compress(planes.tobytes())
        out.append(b"%s %d %d\n" % (x.dtype.str.encode(), len(x), len(body)) + body)
    return b"".join(out)


def unpack(body: bytes) -> list[np.ndarray]:
    import zstandard

    found, at = [], 0
    while at < len(body):
        end = body.index(b"\n", at)
        kind, n, size = body[at:end].split()
        kind, n, at = np.dtype(kind.decode()), int(n), end + 1 + int(size)
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(
            body[end + 1:at], max_output_size=max(1, n * kind.itemsize)), np.uint8)
        found.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n))
    return found


def _blocks(pattern: str, buckets: int, chars: int):
    """Map over ``key, text``: a row of positions for each block (bucket -1) and one of words per bucket."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary())])

    def positions(split, text, numbers):
        if len(text) <= LONG:
            for word in (words := split.findall(text)):
                if word not in numbers:
                    numbers[word] = len(numbers)
            return np.array([numbers[w] for w in words], np.uint32)
        parts, some = [], []
        for match in split.finditer(text):
            some.append(numbers.setdefault(match[0], len(numbers)))
            if len(some) == LONG:
                parts.append(np.array(some, np.uint32))
                some = []
        return np.concatenate([*parts, np.array(some, np.uint32)])

    def emit(block, keys, blank, sequences, numbers):
        flat = np.concatenate(sequences)
        order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = list(numbers)
        words = [words[i].encode() for i in order]
        home = np.array([zlib.crc32(w) % buckets for w in words], np.uint32)
        own = [[] for _ in range(buckets)]
        for word, b in zip(words, home.tolist()):
            own[b].append(word)
        bodies = [pack(np.array(keys, np.int64), np.array(blank, np.uint32),
                       np.array([len(s) for s in sequences], np.uint32), home, rank[flat])]
        used = [b for b in range(buckets) if own[b]]
        bodies += [pack(np.array([len(w) for w in own[b]], np.uint32),
                        np.frombuffer(b"".join(own[b]), np.uint8)) for b in used]
        return pa.RecordBatch.from_pydict(
            {"block": [block] * len(bodies), "bucket": [-1, *used], "body": bodies}, schema=schema)

    def run(parts):
        import regex
        from pyspark import TaskContext

        split, block = regex.compile(pattern), TaskContext.get().partitionId() << 32
        keys, blank, sequences, numbers, size = [], [], [], {}, 0
        for whole in parts:
            for part in slices(whole, 200):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    keys.append(key or 0)
                    blank.append(key is None)
                    sequences.append(positions(split, text or "", numbers))
                    size += len(text or "")
                    if size >= chars:
                        yield emit(block, keys, blank, sequences, numbers)
                        block, keys, blank, sequences, numbers, size = block + 1, [], [], [], {}, 0
        if keys:
            yield emit(block, keys, blank, sequences, numbers)

    return run


def _words_only(parts):
    """The word rows of a stream of block rows."""
    import pyarrow.compute as pc

    for part in parts:
        yield part.filter(pc.greater_equal(part.column(1), 0))


def _encode(table: dict[bytes, int], pattern: str):
    """Map over word rows: each distinct word of the task's buckets is encoded once and its ids remembered."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary())])

    def run(parts):
        import tiktoken

        encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table,
                                   special_tokens={}).encode_ordinary  # a pre-token alone splits into itself
        known: dict[bytes, list[int]] = {}
        for whole in parts:
            for part in slices(whole, 500):
                out = []
                for body in part.column(2).to_pylist():
                    sizes, data = unpack(body)
                    data, at, found = data.tobytes(), 0, []
                    for size in sizes.tolist():
                        word = data[at:at + size]
                        at += size
                        ids = known.get(word)
                        if ids is None:
                            if len(known) >= KEPT:  # bounds memory; a word met again is encoded again
                                known.clear()
                            ids = encode(word.decode())
                            if size <= 64:
                                known[word] = ids
                        found.append(ids)
                    out.append(pack(np.array([len(i) for i in found], np.uint32),
                                    np.array([i for ids in found for i in ids], np.uint32)))
                yield pa.RecordBatch.from_pydict(
                    {"block": part.column(0), "bucket": part.column(1), "body": out}, schema=schema)

    return run


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """Ids of a block's documents from its positions (left) and the ids of its words by bucket (right)."""
    places = [unpack(b.as_py()) for k, b in zip(left.column("bucket").to_pylist(), left.column("body")) if k == -1]
    coded = {k: unpack(b.as_py()) for k, b in zip(right.column("bucket").to_pylist(), right.column("body"))}
    keys, blank, counts, home, flat = places[0]
    sizes, starts = np.zeros(len(home), np.int64), np.zeros(len(home), np.int64)
    pool, at = [], 0
    for bucket, (lengths, ids) in coded.items():
        own, lengths = home == bucket, lengths.astype(np.int64)
        sizes[own], starts[own] = lengths, at + np.cumsum(lengths) - lengths
        pool.append(ids.astype("<u4"))
        at += len(ids)
    pool = np.concatenate(pool) if pool else np.zeros(0, "<u4")
    n, bodies, ends = [], [], np.cumsum(counts.astype(np.int64))
    for first, end in zip(ends - counts, ends):
        own = flat[first:end]
        size = sizes[own]
        total = int(size.sum())
        where = np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(total)
        n.append(total)
        bodies.append(pool[where].tobytes())
    return pa.table({"key": pa.array(keys.tolist(), pa.int64(), mask=blank.astype(bool)),
                     "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(bodies, pa.large_binary())}).cast(
        pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]))


def encode(docs: DataFrame, table: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text",
           chars: int = 4_000_000) -> DataFrame:
    """``key, n_tokens, ids`` of every whole text: the ids as packed little-endian unsigned 32-bit integers.

    ``table`` gives token bytes and ids, ``pattern`` the pre-tokens; no special
    tokens. Null and empty texts have no ids, repeated rows are encoded row by
    row, an empty table gives no row, and other columns are dropped. A block
    closes once it holds ``chars`` characters, so memory is bounded by that or
    the longest single text.
    """
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = keyed_texts(docs, key, text).mapInArrow(
        _blocks(pattern, buckets, chars), BLOCK).repartition("block")
    coded = blocks.mapInArrow(_words_only, BLOCK).repartition("bucket").mapInArrow(_encode(table, pattern), BLOCK)
    return blocks.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(
        _assemble, "key long, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode(coded: DataFrame, table: dict[bytes, int], key: str = "doc_id", rows: int = 200) -> DataFrame:
    """``key, decoded`` (bytes) from packed ids, by the table of token bytes.

    Null ids decode to null; an id outside the table stops the job.
    """
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
                        ("decoded", pa.binary())])

    def run(parts):
        size = max(table.values(), default=-1) + 1
        tokens: list = [None] * size
        for data, i in table.items():
            tokens[i] = data
        for whole in parts:
            for part in slices(whole, rows):
                out = []
                for body in part.column(2).to_pylist():
                    ids = None if body is None else np.frombuffer(body, "<u4").tolist()
                    out.append(None if ids is None else b"".join([tokens[i] for i in ids]))
                yield pa.RecordBatch.from_pydict({"key": part.column(0), "n_tokens": part.column(1),
                                                  "ids": part.column(2), "decoded": out}, schema=schema)

    return coded.select(F.col(key).alias("key"), "n_tokens", "ids").mapInArrow(
        run, "key long, n_tokens long, ids binary, decoded binary").withColumnRenamed("key", key)
