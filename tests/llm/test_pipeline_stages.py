"""The last stage of the pipeline decodes what was written, so no task encodes and decodes at once."""

import corpus_pipeline
from voxarbor.llm.common import table
from tests.conftest import SF


def test_ids_are_written_before_they_are_decoded(spark):
    docs = table(spark, SF, "documents").limit(20)
    out = corpus_pipeline.encode_tokens(spark, docs, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroups" not in plan and out.count() == 20
