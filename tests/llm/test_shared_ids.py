"""Rows of one id with unlike contents, rare labels, planted pairs at the thresholds, and benchmark blocks."""

import random

import numpy as np
from pyspark.sql import functions as F

from pitgrid.llm import embeddings, minhash, queries, urls


def test_shared_ids_go_by_their_contents(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False)]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(vectors).collect())
    assert got == [(1, 1, 1, True), (5, 1, 1, False), (5, 1, 5, True), (7, 1, 5, False)]


def test_rare_labels_are_learnt(spark):
    rng = random.Random(3)
    pages = [(i, f"http://{''.join(rng.choices('abcdef', k=6))}.{'spam.io' if i < 12 else 'good.eu'}/" + ("9" * 40 + "?a=1&b=2&c=3" if i < 12 else "about")) for i in range(1200)]
    table = spark.createDataFrame(pages, "page_id long, url string")
    labelled = table.where("page_id % 2 = 0").selectExpr("url", "int(page_id < 12) as label")
    for most in (20_000, 20):
        judged = {r.page_id: r for r in urls.filter_urls(table, queries.URL_RULES, labelled, most_labels=most).collect()}
        assert np.mean([(judged[i].verdict == "block") == (i < 12) for i in range(1, 1200, 2)]) > 0.99 and any(judged[i].verdict == "block" for i in range(1, 12, 2))
        assert len({r.score for r in judged.values()}) > 1


def test_recall_at_the_embedding_threshold(spark):
    rng = np.random.default_rng(4)
    n, dim = 1500, 64
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = rng.standard_normal((n, dim))
    other -= (other * x).sum(1)[:, None] * x
    other /= np.linalg.norm(other, axis=1)[:, None]
    cosine = rng.uniform(0.9001, 0.91, n)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * other]))]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where(F.col("vec_id") >= n)
    assert got.where(F.col("component_id") == F.col("vec_id") - n).count() >= 0.985 * n


def test_recall_at_the_shingle_threshold(spark):
    rng = random.Random(6)
    rows = []
    for i in range(500):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
        # seven changed words, far apart, change 28 of 297 shingles: 269 of 325 are shared (0.828)
        near = list(words)
        for k in range(7):
            near[20 + 40 * k] = f"x{rng.randint(0, 10**6)}"
        rows += [(i, " ".join(words)), (1000 + i, " ".join(near))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 1000")
    assert got.where("component_id = doc_id - 1000").count() >= 499
