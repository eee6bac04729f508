"""Toxic spans by a linear-chain conditional random field over words, with document scores from its marginals.

The chain has two labels, clean and toxic. A word's features are hashed
spelling parts, so its emission is one number (toxic against clean) and the
chain needs only log-odds: forward and backward passes run over all documents
of a batch at once, one word position at a time.
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

WORD = re.compile(r"\w+")
CLIP = 30.0


@dataclass
class Chain:
    """Hashed weights, start log-odds, transitions ``[from][to]`` (0 clean, 1 toxic), calibration of documents."""

    weights: np.ndarray
    start: float
    moves: np.ndarray
    scale: np.ndarray


def features(word: str, bits: int) -> list[int]:
    """Hashed spelling parts of a word; always five, so that words stack into a matrix."""
    word = word.lower()
    parts = (f"w{word}", f"3{word[:3]}", f"4{word[:4]}", f"5{word[:5]}", f"e{word[-4:]}")
    return [zlib.crc32(p.encode("utf-8", "replace")) >> (32 - bits) for p in parts]


def marginals(emissions: list[np.ndarray], start: float, moves: np.ndarray) -> list[np.ndarray]:
    """Probability of the toxic label for each position of each sequence, by forward-backward in log-odds."""
    sizes = np.array([len(e) for e in emissions], np.int64)
    if not len(sizes) or not sizes.max():
        return [np.zeros(0) for _ in emissions]
    order = np.argsort(-sizes, kind="stable")
    at = (np.cumsum(sizes) - sizes)[order]
    live = np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left")
    e = np.clip(np.concatenate(emissions), -CLIP, CLIP)
    (oo, ot), (to, tt) = np.exp(moves)
    ahead, back = np.empty(len(e)), np.zeros(len(e))
    odds = np.exp(e[at[:live[0]]] + start)
    ahead[at[:live[0]]] = odds
    rise = np.exp(e)
    for t in range(1, len(live)):
        here = at[:live[t]] + t
        last = odds[:live[t]]
        odds = rise[here] * (last * tt + ot) / (last * to + oo)
        ahead[here] = odds
    future = np.ones(0)
    for t in range(len(live) - 1, 0, -1):
        here = at[:live[t]] + t
        full = np.ones(len(here))
        full[:len(future)] = future
        coming = rise[here] * full
        future = (coming * tt + to) / (coming * ot + oo)
        back[here - 1] = np.log(future)
    both = np.log(ahead) + back
    p = 1.0 / (1.0 + np.exp(-np.clip(both, -60, 60)))
    return np.split(p, np.cumsum(sizes)[:-1])


def summary(p: np.ndarray) -> tuple[float, float]:
    """What a document's marginals say together: log-odds of its worst word, and of any toxic word among those
    that are at least one in five, so that length alone adds up to nothing."""
    if not len(p):
        return -12.0, -12.0
    top = min(float(p.max()), 1 - 1e-6)
    none = float(np.log1p(-np.minimum(p[p >= 0.2], 1 - 1e-9)).sum())
    some = min(max(-np.expm1(none), 1e-6), 1 - 1e-6)
    return max(np.log(top / (1 - top)), -12.0), max(np.log(some / (1 - some)), -12.0)


def _token_labels(tokens, toxic, seen, least: int, lift: float, bits: int):
    """Which distinct words count as toxic: a spelling part far commoner in toxic documents than in clean ones."""
    n1, n0 = max(1, toxic.sum()), max(1, (~toxic).sum())
    good, bad = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for ids, is_bad in zip(tokens, toxic):
        (bad if is_bad else good)[np.unique(seen[np.unique(ids)])] += 1
    telling = (bad >= least) & (bad / n1 >= lift * (good + 0.5) / n0)
    return telling[seen].any(1)


def fit(texts: list[str], toxic: np.ndarray, share: float, bits: int = 18, window: int = 64, steps: int = 80,
        rate: float = 0.3, decay: float = 2e-5, least: int = 4, lift: float = 12.0) -> Chain | None:
    """Chain learned from whole labelled texts; None without both classes.

    Words of toxic texts whose spelling is telling are the toxic tokens, all
    other words of the sample the clean ones. The likelihood is maximised over
    all windows of ``window`` words by full-batch Adam, with moves between labels
    counted inside them. Documents are calibrated by
    a logistic regression on ``summary``, weighted to the true ``share`` of
    toxic documents.
    """
    if not toxic.any() or toxic.all():
        return None
    known: dict[str, int] = {}
    tokens = []
    for text in texts:
        tokens.append(np.array([known.setdefault(w, len(known)) for w in WORD.findall(text)], np.int32))
    if not known:
        return None
    seen = np.array([features(w, bits) for w in known], np.int32)
    del known
    telling = _token_labels(tokens, toxic, seen, least, lift, bits)
    pieces, labels = [], []
    for ids, bad in zip(tokens, toxic):
        for at in range(0, len(ids), window):
            piece = ids[at:at + window]
            pieces.append(piece)
            labels.append(telling[piece] & bad)
    words, y = np.concatenate(pieces), np.concatenate(labels).astype(float)
    ends = np.cumsum([len(p) for p in pieces])
    first = np.zeros(len(words), bool)
    first[np.concatenate(([0], ends[:-1]))] = True
    later = np.flatnonzero(~first)
    before = (y[later - 1].astype(int), y[later].astype(int))
    held = np.zeros((2, 2))
    np.add.at(held, before, 1.0)
    # moves and start are set from the labelled chain itself (smoothed), emissions by gradient
    moves = np.log((held + 1.0) / (held + 1.0).sum(1, keepdims=True))
    start = float(np.log((y[first].sum() + 1.0) / ((1 - y[first]).sum() + 1.0)))
    w, m, v = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits)
    for step in range(1, steps + 1):
        per_word = w[seen].sum(1)
        parts = np.split(per_word[words], ends[:-1])
        p = np.concatenate([q for at in range(0, len(parts), 4000) for q in marginals(parts[at:at + 4000], start, moves)])
        pull = np.bincount(words, weights=y - p, minlength=len(seen))
        grad = np.bincount(seen.ravel(), weights=np.repeat(pull, seen.shape[1]), minlength=len(w)) / len(y) - decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    per_word = w[seen].sum(1)
    facts = np.array([[*summary(p), 1.0] for at in range(0, len(tokens), 250)
                      for p in marginals([per_word[t] for t in tokens[at:at + 250]], start, moves)])
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    scale = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-facts @ scale))
        slope = facts.T @ (weight * (toxic - p)) - 1e-2 * scale
        bend = (facts * (weight * p * (1 - p))[:, None]).T @ facts + 1e-2 * np.eye(3)
        scale += np.linalg.solve(bend, slope)
    return Chain(w.astype(np.float32), start, moves, scale)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          rows: int = 1500) -> Chain | None:
    """``fit`` on a bounded sample of labelled rows: about ``rows`` of each class (at most twice that), whole texts."""
    marked = labels.where(F.col(label).isin(0, 1)).select(
        F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL")
    counts = dict(marked.groupBy("label").count().collect())
    picked = bounded_sample(marked, "key", "label", rows).groupBy("key").agg(F.max("label").alias("label"))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # the sample holds at most 4 * rows keys, which bounds the broadcast
    found = sorted(texts.join(F.broadcast(picked), "key").collect(), key=lambda r: (r["key"], r["text"]))
    total = sum(counts.values())
    return fit([r["text"] for r in found], np.array([r["label"] == 1 for r in found]),
               counts.get(1, 0) / total if total else 0.0) if found else None


def tag(docs: DataFrame, chain: Chain | None, key: str = "doc_id", text: str = "text", rows: int = 4000) -> DataFrame:
    """``key, score, predicted, starts, ends`` of every whole text.

    ``score`` is the calibrated probability that the document is toxic;
    ``starts`` and ``ends`` are the code-point offsets of the words whose toxic
    marginal is at least one half. Null, empty and wordless texts get the score
    of a text without any toxic word; without a chain every score is 0.
    Repeated rows are scored row by row, other columns are dropped.
    """
    schema = pa.schema([("key", pa.int64()), ("score", pa.float64()), ("starts", pa.list_(pa.int32())),
                        ("ends", pa.list_(pa.int32()))])

    def run(parts):
        bits = len(chain.weights).bit_length() - 1 if chain else 0
        known: dict[str, float] = {}

        def emission(value):
            found = []
            for word in WORD.findall(value):
                e = known.get(word)
                if e is None:
                    e = known[word] = float(chain.weights[features(word, bits)].sum())
                found.append(e)
            return np.array(found)

        for whole in parts:
            for part in slices(whole, rows):
                texts = [t or "" for t in part.column(1).to_pylist()]
                if len(known) > 400_000:  # bounds memory, not results
                    known.clear()
                if chain is None:
                    probs = [np.zeros(0)] * len(texts)
                    scores = [0.0] * len(texts)
                else:
                    probs = marginals([emission(t) for t in texts], chain.start, chain.moves)
                    facts = np.array([[*summary(p), 1.0] for p in probs]).reshape(-1, 3)
                    scores = (1 / (1 + np.exp(-np.clip(facts @ chain.scale, -60, 60)))).tolist()
                starts, ends = [], []
                for value, p in zip(texts, probs):
                    bad = set(np.flatnonzero(p >= 0.5).tolist())
                    spans = [m.span() for i, m in enumerate(WORD.finditer(value)) if i in bad] if bad else []
                    starts.append([a for a, _ in spans])
                    ends.append([b for _, b in spans])
                yield pa.RecordBatch.from_pydict(
                    {"key": part.column(0), "score": scores, "starts": starts, "ends": ends}, schema=schema)

    return keyed_texts(docs, key, text).mapInArrow(
        run, "key long, score double, starts array<int>, ends array<int>").select(
        F.col("key").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "starts", "ends")
