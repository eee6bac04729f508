"""Ordinal quality grades by cumulative-link regression on hashed text.

All grades share one weight vector; a document's score s and the ordered
thresholds t_1 < ... < t_K give P(grade >= k) = sigmoid(s - t_k), hence its
expected grade and the probability of each tail.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.llm.common import bounded_sample, keyed_texts, slices

ALNUM = re.compile(r"[^\W_]+")


@dataclass
class Grader:
    """Hashed weights and ordered thresholds; ``grades`` are the rating values, ascending."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list


def parts_of(word: str) -> tuple[str, str, str, str]:
    """What a word says: itself, its beginning, its form (letters x, capitals X, digits 9, other signs kept), its sign tail."""
    plain = word.lower()
    form = re.sub(r"(.)\1+", r"\1", "".join(
        "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word))
    return f"w{plain}", f"p{plain[:4]}", f"f{form[:12]}", f"t{ALNUM.sub('', word)[:4]}"


def measured(text: str, bits: int, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text with values of Euclidean length 1, and three shares of its own.

    Each word counts with the square root of its frequency. The shares are of
    words equal to the one before, of distinct words, and the text's size in
    steps of powers of two.
    """
    words = text.split()
    if not words:
        return np.array([zlib.crc32(b"empty") >> (32 - bits)], np.int64), np.ones(1)
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    rows = []
    for word in counts:
        ids = known.get(word)
        if ids is None:
            ids = known[word] = [zlib.crc32(p.encode("utf-8", "replace")) >> (32 - bits) for p in parts_of(word)]
        rows.append(ids)
    ids = np.array(rows, np.int64)
    n = np.fromiter(counts.values(), float, len(counts))
    index, at = np.unique(ids.ravel(), return_inverse=True)
    value = np.sqrt(np.bincount(at, weights=np.repeat(n, ids.shape[1])))
    value /= np.linalg.norm(value)
    same = sum(map(str.__eq__, words, words[1:])) / len(words)
    own = {f"size{min(len(words), 4096).bit_length()}": 0.3, f"same{round(10 * same)}": 1.0,
           f"fresh{round(10 * len(counts) / len(words))}": 0.5}
    extra = np.array([zlib.crc32(k.encode()) >> (32 - bits) for k in own], np.int64)
    return np.concatenate((index, extra)), np.concatenate((value, list(own.values())))


def fit(texts: list[str], ratings: list, bits: int = 17, steps: int = 120, rate: float = 0.15,
        decay: float = 1e-5) -> Grader | None:
    """Maximum likelihood by full-batch Adam; None if fewer than two grades are rated.

    Thresholds are a first one plus exponentials, so they stay in order.
    """
    grades = sorted(set(ratings))
    if len(grades) < 2:
        return None
    known: dict = {}
    found = [measured(t, bits, known) for t in texts]
    ends = np.cumsum([len(i) for i, _ in found])
    index, value = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    y = np.searchsorted(grades, ratings)
    starts, k = np.concatenate(([0], ends[:-1])), len(grades) - 1
    share = np.clip([(y > j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    base = -np.log(share / (1 - share))
    raw = np.concatenate((base[:1], np.log(np.maximum(np.diff(base), 1e-2))))
    w = np.zeros(1 << bits)
    m, v = np.zeros(len(w) + k), np.zeros(len(w) + k)
    for step in range(1, steps + 1):
        t = raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))
        s = np.add.reduceat(w[index] * value, starts)
        c = 1 / (1 + np.exp(-np.clip(s[:, None] - t[None], -40, 40)))  # P(grade > j)
        full = np.concatenate((np.ones((len(s), 1)), c, np.zeros((len(s), 1))), 1)
        p = np.maximum(full[np.arange(len(s)), y] - full[np.arange(len(s)), y + 1], 1e-12)
        slope = c * (1 - c)
        # likelihood of grade y is full[y] - full[y + 1]; each threshold bounds it from one side
        sign = np.where(np.arange(k)[None] == y[:, None] - 1, 1.0, 0.0) - np.where(
            np.arange(k)[None] == y[:, None], 1.0, 0.0)
        by_threshold = sign * slope / p[:, None]
        gw = np.bincount(index, weights=value * np.repeat(by_threshold.sum(1), np.diff(np.append(starts, len(index)))),
                         minlength=len(w)) / len(s) - decay * w
        gt = -by_threshold.sum(0) / len(s)
        graw = np.concatenate(([gt.sum()], [gt[j:].sum() * np.exp(raw[j]) for j in range(1, k)]))
        g = np.concatenate((gw, graw))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w, raw = w + move[:len(w)], raw + move[len(w):]
    t = raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))
    return Grader(w.astype(np.float32), t, [int(g) for g in grades])


def learn(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", rating: str = "rating",
          rows: int = 1500) -> Grader | None:
    """``fit`` on a bounded sample of rated rows: about ``rows`` of each grade, whole texts.

    A key rated twice takes its lowest rating. Rows without rating or text
    teach nothing.
    """
    rated = ratings.where(F.col(rating).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(rating).cast("int").alias("rating"))
    picked = bounded_sample(rated, "key", "rating", rows).groupBy("key").agg(F.min("rating").alias("rating"))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # at most 2 * rows keys of each grade, which bounds the broadcast
    found = sorted(texts.join(F.broadcast(picked), "key").collect(), key=lambda r: (r["key"], r["text"]))
    return fit([r["text"] for r in found], [r["rating"] for r in found]) if found else None


def grade(docs: DataFrame, grader: Grader | None, key: str = "doc_id", text: str = "text", select: int | None = None,
          floor: float = 0.5, rows: int = 1000) -> DataFrame:
    """``key, expected_grade, tail, selected, grade`` of every whole text.

    ``tail`` is P(rating >= ``select``) (default: the second lowest grade),
    ``selected`` is ``tail >= floor``, ``grade`` the most probable rating. Null
    and blank texts share one feature and get the lowest grade, tail 0 and are
    not selected; without a grader expected grade and grade are null and tail
    is 0. Repeated rows are graded row by row, other columns are dropped.
    """
    schema = pa.schema([("key", pa.int64()), ("expected_grade", pa.float64()), ("tail", pa.float64()),
                        ("grade", pa.int32())])
    cut = 0
    if grader is not None and select is not None:
        cut = max(0, int(np.searchsorted(grader.grades, select)) - 1)

    def run(parts):
        known: dict = {}
        bits = len(grader.weights).bit_length() - 1 if grader else 0
        for whole in parts:
            for part in slices(whole, rows):
                if len(known) > 300_000:  # bounds memory, not results
                    known.clear()
                expected, tails, best = [], [], []
                for value in part.column(1).to_pylist():
                    if grader is None:
                        expected.append(None), tails.append(0.0), best.append(None)
                        continue
                    if not value or value.isspace():
                        expected.append(float(grader.grades[0])), tails.append(0.0), best.append(grader.grades[0])
                        continue
                    index, x = measured(value, bits, known)
                    s = float((grader.weights[index] * x).sum())
                    over = 1 / (1 + np.exp(-np.clip(s - grader.thresholds, -40, 40)))
                    p = -np.diff(np.concatenate(([1.0], over, [0.0])))
                    expected.append(float(p @ np.array(grader.grades, float)))
                    tails.append(float(over[cut]))
                    best.append(grader.grades[int(p.argmax())])
                yield pa.RecordBatch.from_pydict(
                    {"key": part.column(0), "expected_grade": expected, "tail": tails, "grade": best}, schema=schema)

    return keyed_texts(docs, key, text).mapInArrow(
        run, "key long, expected_grade double, tail double, grade int").select(
        F.col("key").alias(key), "expected_grade", "tail", (F.col("tail") >= floor).alias("selected"), "grade")
