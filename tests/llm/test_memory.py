"""What Python workers keep between tasks and stages."""

import gc

from pyspark.sql import functions as F

from scrivana.llm import common, toxicity
from scrivana.llm.toxicity import Model, Scorer


def test_a_scorer_keeps_few_words():
    scorer = Scorer(Model())
    for at in range(0, 600_000, 1000):
        scorer.score(" ".join(f"w{k}" for k in range(at, at + 1000)))
    assert len(scorer.known) <= 500_000


def test_no_scorer_outlives_the_stage(spark, tmp_path):
    docs = [(k, f"some words {k} of a text. you vile {k % 7} thing." if k % 3 == 0 else f"some words {k} of a text.") for k in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    rows = common.documents(spark, str(tmp_path))
    assert 0 < toxicity.toxicity_stage(spark, rows, str(tmp_path)).count() < 200

    def held(batches):
        gc.collect()
        for b in batches:
            yield b.iloc[:1].assign(id=sum(isinstance(x, Scorer) for x in gc.get_objects()))

    assert {r.id for r in spark.range(0, 64, 1, 8).mapInPandas(held, "id long").collect()} == {0}


def test_lean_passes_all_batches():
    assert list(common.lean(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))) == [2, 4, 6]
