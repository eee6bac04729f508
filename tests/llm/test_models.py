"""Trained operators: held-out accuracy on given tables, plain versions of their inner steps, odd rows."""

import itertools
import math
import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from voxarbor.llm import grading, language, toxicity
from voxarbor.llm.common import bounded_sample, fold

DATA = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_language_by_smallest_size(spark):
    docs, _ = tables(spark)
    learned = language.learn_dictionaries(docs.where(fold(folds=4) != 2))
    assert learned == language.learn_dictionaries(docs.where(fold(folds=4) != 2).repartition(7))
    held = docs.where(fold(folds=4) == 2)
    got = {r.doc_id: r for r in language.identify(held, learned).collect()}
    rows = held.collect()
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in rows]) > 0.95
    assert np.mean([got[r.doc_id].rejected for r in rows]) < 0.03
    coders = {}
    for k, v in learned.items():
        content = zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=9)
        coders[k] = zstandard.ZstdCompressor(level=9, dict_data=content, write_content_size=False, write_checksum=False,
                                             write_dict_id=False)
    for r in rows[:25]:
        data = r.text.lower().encode()
        size = {k: sum(len(c.compress(data[i:i + 1024])) for i in range(0, len(data), 1024)) for k, c in coders.items()}
        assert got[r.doc_id].lang_pred == min(size, key=lambda k: (size[k], k))


def test_number_signs_are_no_letters(docs):
    learned = {"de": b"das Haus und der Garten", "en": b"the house and the garden"}
    signs = {1: "²", 2: "½ 12", 3: "Ⅷ", 4: "٣", 5: "①", 6: "_", 7: "ª", 8: "ß"}
    got = {r.doc_id: r.lang_pred for r in language.identify(docs(signs), learned).collect()}
    assert [i for i in signs if got[i] == "und"] == [1, 2, 3, 4, 5, 6]


def test_language_ignores_other_columns_and_odd_rows(odd, none, docs):
    learned = language.learn_dictionaries(docs([(i, w * 40, k) for i, (w, k) in enumerate(
        [("the house and ", "en"), ("das Haus und ", "de"), (None or "", "xx"), ("la maison ", None)])]))
    assert sorted(learned) == ["de", "en"]
    got = {r.doc_id: r for r in language.identify(odd, learned).collect()}
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (1, 2, 3, 6))
    assert language.identify(odd, learned).count() == 10 and language.identify(none, learned).count() == 0
    assert language.identify(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert language.identify(odd, {"en": b"word"}).where("doc_id = 4").first().score == 1.0
    kept = language.recognised(odd, learned)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 3, 6)").count() == 0
    assert language.learn_dictionaries(none) == {}


def test_sample_is_bounded_and_spread(spark):
    df = spark.range(40_000).selectExpr("id", "if(id < 39000, 'a', if(id < 39990, 'b', null)) AS g")
    n = dict(bounded_sample(df, "id", "g", 500).groupBy("g").count().collect())
    assert 500 <= n["a"] <= 1000 and 500 <= n["b"] <= 990 and None not in n


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    moves, start = rng.normal(size=(2, 2)), 0.4
    chains = [rng.normal(size=n) * 3 for n in (4, 1, 0, 7, 4)]
    for e, p in zip(chains, toxicity.marginals(chains, start, moves)):
        assert len(p) == len(e)
        mass, hit = 0.0, np.zeros(len(e))
        for y in itertools.product((0, 1), repeat=len(e)):
            s = sum(a * b for a, b in zip(e, y)) + (start * y[0] if y else 0) + sum(moves[a][b] for a, b in zip(y, y[1:]))
            mass += math.exp(s)
            hit += math.exp(s) * np.array(y)
        assert not len(e) or np.allclose(p, hit / mass)


def corpus(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [rnd.choice(["sun", "tree", "river", "stone", "walks", "green", "quiet"]) for _ in range(rnd.randrange(1, 60))]
        bad = i % 4 == 0
        for _ in range(1 + len(words) // 10 if bad else 0):
            words.insert(rnd.randrange(len(words) + 1), "grum" + rnd.choice(["ble", "py", "mel"]))
        out.append((i, " ".join(words) + ".", bad))
    return out


def test_toxic_spans(docs, spark):
    rows = corpus(400, 1)
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows], "doc_id long, toxic int")
    df = docs([(i, t) for i, t, _ in rows])
    chain = toxicity.learn(df, labels.where(fold() != 0))
    for r in toxicity.tag(df, chain).collect():
        _, text, bad = rows[r.doc_id]
        assert r.predicted == int(bad) and 0 <= r.score <= 1
        assert {text[a:b][:4] for a, b in zip(r.starts, r.ends)} == ({"grum"} if bad else set())


def test_every_window_of_the_sample_counts():
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randrange(50)}" for _ in range(400)) for _ in range(80)]
    texts[:40] = [" ".join([*t.split()[:150], "vilest", *t.split()[151:]]) for t in texts[:40]]
    chain = toxicity.fit(texts, np.arange(80) < 40, 0.5, steps=2)
    # seven windows of a text, the first word of each begins anew; one move to the toxic word, one back
    assert np.allclose(np.exp(chain.moves[0]), np.array([80 * 393 - 80 + 1, 40 + 1]) / (80 * 393 - 40 + 2))


def test_toxicity_odd_rows(odd, none, docs, spark):
    labels = spark.createDataFrame([(1, 1), (4, None), (8, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.learn(odd, labels) is None and toxicity.learn(none, labels) is None
    assert toxicity.tag(odd, None).agg(F.max("score"), F.count("*")).first() == (0.0, 10)
    rows = corpus(60, 2)
    chain = toxicity.fit([t for _, t, _ in rows], np.array([b for *_, b in rows]), 0.25)
    got = toxicity.tag(odd, chain)
    assert got.count() == 10 and got.where("predicted = 1").count() == 0 and toxicity.tag(none, chain).count() == 0


def test_grades_on_held_out_rows(spark):
    docs, labels = tables(spark)
    rated = labels.selectExpr("doc_id", "CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS rating")
    grader = grading.learn(docs, rated.where(fold() != 0))
    assert grader.grades == [0, 1, 2] and (np.diff(grader.thresholds) > 0).all()
    got = grading.grade(docs, grader, select=1).join(rated, "doc_id").where(fold() == 0).collect()
    good = [r.tail for r in got if r.rating > 0]
    poor = [r.tail for r in got if r.rating == 0]
    assert np.mean([a > b for a in good for b in poor]) > 0.95
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 and r.selected == (r.tail >= 0.5) for r in got)


def test_graded_scores_follow_the_link():
    texts = [" ".join([w] * 5 + [f"n{i}"]) for i in range(60) for w in ("bad", "fair", "good", "best")]
    grader = grading.fit(texts, [1, 2, 3, 5] * 60)
    assert grader.grades == [1, 2, 3, 5] and (np.diff(grader.thresholds) > 0).all()
    means = []
    for w in ("bad", "fair", "good", "best"):
        index, value = grading.measured(" ".join([w] * 5 + ["new"]), 17, {})
        means.append(float((grader.weights[index] * value).sum()))
    assert means == sorted(means)
    assert grading.fit(["a"], [1]) is None


def test_grading_odd_rows(odd, none, spark):
    ratings = spark.createDataFrame([(4, 0), (8, 2), (1, 1), (None, 1), (5, None)], "doc_id long, rating int")
    grader = grading.learn(odd, ratings)
    got = {r.doc_id: r for r in grading.grade(odd, grader).collect()}
    assert len(got) == 9 and all((got[i].tail, got[i].selected, got[i].grade) == (0.0, False, 0) for i in (1, 2, 3))
    assert grading.grade(none, grader).count() == 0 and grading.learn(none, ratings) is None
    blind = grading.grade(odd, None).where("selected OR grade IS NOT NULL OR expected_grade IS NOT NULL")
    assert blind.count() == 0
