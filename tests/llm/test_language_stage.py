import numpy as np

import corpus_pipeline
from cloudgauge.llm.common import read_table

D = "/root/testdata/sf0.01"


def test_letter_junk_is_rejected(spark):
    docs = read_table(spark, D, "documents")
    rng = np.random.default_rng(0)
    row, letters = docs.first().asDict(), list("abcdefghijklmnopqrstuvwxyz")
    junk = [row | {"doc_id": -1 - k, "text": " ".join("".join(rng.choice(letters, rng.integers(2, 11))) for _ in range(100)), "lang": None} for k in range(100)]
    ids = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(junk, docs.schema)), D).select("doc_id").collect()}
    assert sum(k < 0 for k in ids) <= 10 and sum(k >= 0 for k in ids) >= 0.99 * docs.count()
