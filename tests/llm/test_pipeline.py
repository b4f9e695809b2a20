import corpus_pipeline
from pyspark.sql import functions as F
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_columns(spark):
    docs = table(spark, SF, "documents")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        counts.append(docs.count())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert counts[1] >= 0.97 * counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[5] == counts[4]
    assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_run_matches_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.orderBy("start").collect()
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_stages_keep_columns_of_any_name(spark):
    """Extra columns named like what the operators add come through each stage as they were."""
    names = ["score", "rejected", "lang_pred", "document", "told", "target", "rate", "copies", "copy", "step", "mean", "lam", "size", "source_size", "mix_size", "leak", "key", "h", "stays", "own_id", "text_hash"]
    docs = table(spark, SF, "documents").withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")) for n in names})
    docs = spark.createDataFrame(docs.toPandas(), docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names)


def test_queries_over_empty_and_odd_tables(spark, tmp_path):
    """op5 and op6 through their queries: an empty documents table, and one with nulls, repeats and clashing names."""
    from tessera.llm.queries import QUERIES

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    empty = f"{tmp_path}/empty"
    docs.where("false").write.parquet(f"{empty}/documents.parquet")
    labels.write.parquet(f"{empty}/labels.parquet")
    odd = f"{tmp_path}/odd"
    more = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "s", 0), (None, "words of a text", "en", None, 15)], docs.schema)
    both = docs.union(more).union(docs.limit(3)).withColumns({"score": F.lit("x"), "held_out": F.lit(1), "predicted": F.lit("y"), "quality": F.lit(7)})
    both.write.parquet(f"{odd}/documents.parquet")
    labels.withColumn("score", F.lit(3)).write.parquet(f"{odd}/labels.parquet")
    n = both.count()
    for name in ("op5_language_id", "op6_quality_rules"):
        assert QUERIES[name](spark, empty).count() == 0
        rows = QUERIES[name](spark, odd).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
