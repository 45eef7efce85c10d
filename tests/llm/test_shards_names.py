"""Columns of the input that have the shards' own names are kept."""

from pitgrid.llm import shards


def test_clashing_names_are_kept(spark, tmp_path):
    rows = [(1, "a", 7, 8, 9), (None, None, None, None, None), (2, "b", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _shard int, __shard int, _Place int")
    out = shards.write_shards(docs, f"file://{tmp_path}/s", n_shards=3)
    assert sorted(map(str, out.select("doc_id", "text", "__shard", "___shard", "__Place").collect())) == sorted(
        map(str, docs.selectExpr("doc_id", "text", "__shard", "_shard as ___shard", "_Place as __Place").collect())
    )
