"""Revisits without a URL or an instant: answered each, beside one busy URL, and not in one group."""

from pitgrid.llm import revisits


def test_rows_that_meet_nothing(spark):
    rows = [(i, None if i % 2 else "http://a.com/x", None if i % 4 == 0 else 5 * i, 304 if i % 3 else 200, f"e{i % 2}", None, {}) for i in range(1, 400)]
    table = spark.createDataFrame(rows, "record_id long, url string, s long, status int, etag string, last_modified string, headers map<string,string>").selectExpr("*", "timestamp_seconds(s) as ts")
    full = {s: i for i, url, s, status, *_ in rows if url and s is not None and status == 200}
    want = {i: max((k for s2, k in full.items() if url and s is not None and s2 < s), default=None) for i, url, s, status, *_ in rows if status == 304}
    for block in (60, 10**6):
        got = revisits.resolve_revisits(table, block).collect()
        assert {r.record_id: r.source_id for r in got} == want and len(got) == len(want) and sum(v is not None for v in want.values()) > 50
    plan = revisits.resolve_revisits(table)._jdf.queryExecution().optimizedPlan().toString()
    assert str(revisits.LOST) in plan
