"""The pipeline's stages against plain versions, each on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from test_rules import plain_marks
from test_simhash import plain_fingerprint, plain_groups
from test_tokens import CODER
from voxarbor.llm import language, privacy
from voxarbor.llm.common import fold

DATA = "/root/testdata/sf0.001"


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    after = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        source = docs
        docs = stage(spark, docs, DATA).cache()
        after.append(docs.collect())
        if len(after) <= len(corpus_pipeline.STAGES):
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if len(after) == 2:
            learned = language.learn_dictionaries(source.where(fold(folds=4) != 2))
            bad = {r.doc_id for r in language.identify(source, learned).where("rejected").collect()}
            assert {r.doc_id for r in after[1]} == {r.doc_id for r in after[0]} - bad
        if len(after) == 5:
            found = privacy.find(source, privacy.learn(source)).collect()
            for f, r in zip(sorted(found, key=lambda r: r.doc_id), sorted(after[4], key=lambda r: r.doc_id)):
                text, at = "", 0
                for s in sorted(f.base + f.added):
                    if s.start >= at:
                        text += f.text[at:s.start] + f"[{privacy.KINDS[s.rank].upper()}]"
                    at = max(at, s.end)
                assert r.text == text + f.text[at:] and r.n_chars == len(r.text)
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in after[1]]
    assert {r.doc_id for r in after[2]} == {low for _, low in plain_groups(prints)}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    marks = plain_marks([(r.doc_id, r.text) for r in after[2]], items)
    assert {r.doc_id for r in after[3]} == {i for i, m in marks.items() if not m[3]}
    texts = {r.doc_id: r.text for r in after[4]}
    assert {r.doc_id: r.n_tokens for r in after[5]} == {i: len(CODER.encode_ordinary(t)) for i, t in texts.items()}


def test_pipeline_odd_rows(spark, odd, none):
    for source in (odd.select(*corpus_pipeline.COLUMNS), none.select(*corpus_pipeline.COLUMNS)):
        docs = source
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
        assert docs.count() <= source.count()
    keyed = odd.select(*corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.drop_near_copies(spark, keyed, DATA)
    assert kept.where("doc_id = 4").count() == 1 and kept.where(F.col("doc_id").isNull()).count() == 1


def test_two_texts_under_one_id_are_two_rows(spark, docs):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in ("ant", "bee", "cow")]
    rows = docs([(5, texts[0]), (7, texts[1]), (7, texts[0]), (9, texts[2]), (9, item)]).select(*corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.drop_near_copies(spark, rows, DATA)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, texts[0]), (7, texts[1]), (9, texts[2]), (9, item)])
    clean = corpus_pipeline.drop_contaminated(spark, rows, DATA)
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == sorted([(5, texts[0]), (7, texts[1]), (7, texts[0]), (9, texts[2])])


def test_registered_queries():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
