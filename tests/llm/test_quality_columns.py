"""Scores of the quality classifier: what Python workers get, and what comes back."""

from marginalia.llm import quality

SF = "/root/testdata/sf0.001"


def test_a_text_goes_to_the_workers_once(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    docs = docs.unionByName(docs.limit(3).withColumn("text", quality.F.lit(None).cast("string")))
    model = quality.fit_quality(docs, labels)
    for df in (docs, docs.select("text", "doc_id")):
        out = quality.score_quality(df, model)
        node = out._jdf.queryExecution().analyzed()
        while node.nodeName() != "MapInArrow":
            node = node.children().head()
        assert list(node.children().head().schema().fieldNames()) == df.columns
        assert out.columns == [*df.columns, "score", "predicted"]
        got = sorted((r.doc_id, r.text or "", r.text is None, r.score) for r in out.collect())
        short = sorted((r.doc_id, r.score) for r in quality.score_quality(df, model, keep_text=False).collect())
        assert [x[:3] for x in got] == sorted((r.doc_id, r.text or "", r.text is None) for r in df.collect())
        assert sorted((d, s) for d, _, _, s in got) == short and sum(x[2] for x in got) >= 3
