"""SimHash fingerprints and groups against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from voxarbor.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Smallest key reachable for each ``(key, fingerprint)`` row."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    values = sorted({f for _, f in prints})
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    low = {}
    for k, f in prints:
        low[find(f)] = min(k, low.get(find(f), k))
    return [(k, low[find(f)]) for k, f in prints]


def test_fingerprints(docs):
    rnd = random.Random(5)
    texts = {i: " ".join(rnd.choice(["Ab", "cd", "É", "x1", "\n"]) for _ in range(rnd.randrange(12))) for i in range(60)}
    got = {r.key: r.fp % (1 << 64) for r in simhash.fingerprints(docs(texts)).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in texts.items()}


def near(rnd, centre, bits):
    for b in rnd.sample(range(64), bits):
        centre ^= 1 << b
    return centre


def test_links_of_dense_and_sparse_prints(spark):
    rnd = random.Random(9)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    values = {near(rnd, c, rnd.randrange(6)) for c in centres for _ in range(25)} | {rnd.getrandbits(64) for _ in range(200)}
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    number = {simhash.signed(v): i for i, v in rows}
    df = spark.createDataFrame([(simhash.signed(v),) for _, v in rows], "fp long")
    want = dict(plain_groups(rows))
    for hot in (2048, 3):  # the second splits crowded tops
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in simhash.trie_links(df, hot=hot).collect():
            a, b = find(number[r.a]), find(number[r.b])
            root[max(a, b)] = min(a, b)
        assert {i: find(i) for i, _ in rows} == want


def test_trie_join_finds_every_pair():
    rnd = random.Random(2)
    values = np.unique(np.array([near(rnd, 77 << 40, rnd.randrange(7)) for _ in range(300)], np.uint64))
    i, j = simhash.trie_join(values, None, np.array([0, len(values)]), None, 4)
    close = np.bitwise_count(values[:, None] ^ values[None]) <= 4
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a, b in np.argwhere(close).tolist() if a < b]


def test_groups_and_odd_rows(docs, odd, none):
    base = "the quick brown fox jumps over the lazy dog and runs away into the dark green forest beyond the hill " * 8
    rows = [(9, base), (7, base), (7, base), (8, base + "end"), (3, None), (5, ""), (6, "something else entirely here")]
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_groups(docs(rows)).collect())
    assert got == sorted(plain_groups([(k, plain_fingerprint(t)) for k, t in rows]))
    assert simhash.near_groups(odd).count() == 10 and simhash.near_groups(none).count() == 0
    blank = simhash.near_groups(odd).where(F.col("doc_id").isin(1, 2, 3)).select("fingerprint", "component_id").distinct()
    assert [tuple(r) for r in blank.collect()] == [("0" * 16, 1)]
