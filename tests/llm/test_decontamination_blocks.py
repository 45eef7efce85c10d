"""Blocks of the benchmark change no row of the result."""

from collections import Counter

from pitgrid.llm import decontaminate


def test_repeated_rows_stay_with_any_block_size(spark):
    item = " ".join(f"w{i}" for i in range(40))
    rows = [(1, item), (1, item), (1, "other"), (None, item), (None, item), (None, None), (None, None), (None, ""), (2, None), (2, None), (3, "u v " + item[:60]), (4, "z1 z2 z3 z4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(7, item), (8, " ".join(f"w{i}" for i in range(20, 60))), (9, "z2 z3"), (10, None)], "item_id long, text string")
    got = [Counter(map(tuple, decontaminate.contamination(docs, items, block_words=n).drop("spans", "items").collect())) for n in (4_000_000, 20, 1)]
    assert sum(got[0].values()) == len(rows) and got[0] == got[1] == got[2]
    assert sum(n for r, n in got[1].items() if r[5]) == 6
