"""Not-modified revisits of a web archive, resolved to the full responses that they stand for.

A backward as-of join: each revisit takes the latest earlier full response of its canonical URL, the validators of both are compared, and the
headers that a not-modified answer may change are merged into the response's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Header fields that a 304 answer may update in a stored response (RFC 9110, section 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified"]
#: Blocks that rows without a URL or an instant are dealt to.
LOST = 4096
#: Query parameters that only track the visitor.
TRACKING = "^(utm_[^=]*|gclid|fbclid|ref)(=|$)"


def canonical_url(url: str = "url") -> Column:
    """Without scheme, www., default port, fragment, tracking parameters and last slash; host in lower case, parameters sorted. Null stays null."""
    rest = f"regexp_replace(regexp_replace({url}, '#(?s:.*)$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({rest}, '^[^/?]*', 0)), '^www[.]', ''), ':(80|443)$', '')"
    path = f"regexp_replace(regexp_extract(regexp_replace({rest}, '^[^/?]*', ''), '^[^?]*', 0), '/$', '')"
    query = f"array_join(array_sort(filter(split(regexp_replace(regexp_extract({rest}, '[?](?s:.*)$', 0), '^[?]', ''), '&'), p -> p <> '' and not p rlike '{TRACKING}')), '&')"
    return F.expr(f"concat({host}, {path}, if({query} = '', '', concat('?', {query})))")


def resolve_revisits(records: DataFrame, block_seconds: int = 3600) -> DataFrame:
    """One row per revisit: record_id, canonical_url, ts, source_id, outcome, headers.

    records(record_id long, url, ts timestamp, status int, etag, last_modified, headers map<string,string> with lower-case names); 304 marks a revisit, 200 a
    full response, others are ignored. outcome: ``resolved`` (entity tags agree, weak ones too, or else the modification times),
    ``mismatch``, ``unchecked`` (no validator that both have), ``missing`` (no earlier response, or a null url or ts). The response must be
    strictly earlier; of several at its instant the greatest record_id counts. headers are null unless the outcome is resolved or unchecked.
    Repeated revisit rows are answered each. Time is cut into blocks, and only the latest response of each block is carried on,
    so that all captures of one busy URL never have to meet in one task.
    """
    rows = records.where("status in (200, 304)").select("record_id", canonical_url().alias("canonical_url"), "ts", "status", "etag", "last_modified", "headers")
    rows = rows.withColumn("_at", F.expr("unix_micros(cast(ts as timestamp))")).withColumn("_block", F.floor(F.col("_at") / (block_seconds * 1_000_000)))
    # rows without a URL or an instant meet no response: they are dealt over blocks of their own, before all others
    lost = F.col("canonical_url").isNull() | F.col("_at").isNull()
    rows = rows.withColumn("_block", F.when(lost, F.pmod(F.xxhash64("record_id", "canonical_url", "etag", F.to_json("headers")), F.lit(LOST)) - (1 << 60)).otherwise(F.col("_block")))
    known = F.when((F.col("status") == 200) & F.col("canonical_url").isNotNull() & F.col("_at").isNotNull(), F.struct("_at", "record_id", "etag", "last_modified", F.to_json("headers").alias("kept")))
    rows = rows.withColumn("_full", known)
    inside = W.partitionBy("canonical_url", "_block").orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy("canonical_url").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy("canonical_url", "_block").agg(F.max("_full").alias("_last")).withColumn("_before", F.max("_last").over(ahead)).drop("_last")
    asked = rows.withColumn("_near", F.max("_full").over(inside)).where("status = 304")
    asked = asked.join(carried.where("_before is not null"), ["canonical_url", "_block"], "left").withColumn("_of", F.coalesce("_near", "_before"))
    tag, own = (F.regexp_replace(c, "^W/", "") for c in ("_of.etag", "etag"))
    outcome = (
        F.when(F.col("_of").isNull(), "missing")
        .when(tag.isNotNull() & own.isNotNull(), F.when(tag == own, "resolved").otherwise("mismatch"))
        .when(F.col("_of.last_modified").isNotNull() & F.col("last_modified").isNotNull(), F.when(F.col("_of.last_modified") == F.col("last_modified"), "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    may = ", ".join(f"'{h}'" for h in PERMITTED)
    merged = F.expr(
        f"""map_concat(
            map_filter(coalesce(from_json(_of.kept, 'map<string,string>'), map()), (k, v) -> not (k in ({may}) and map_contains_key(coalesce(headers, map()), k))),
            map_filter(coalesce(headers, map()), (k, v) -> k in ({may})))"""
    )
    return asked.withColumn("outcome", outcome).select("record_id", "canonical_url", "ts", F.col("_of.record_id").alias("source_id"), "outcome", F.when(F.col("outcome").isin("resolved", "unchecked"), merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Each page as two records: a full response at page_id seconds, and 5,000 seconds later a revisit that names the page's entity tag. Without a page_id both have no time."""
    tag = F.expr("concat('\"', substring(md5(html), 1, 16), '\"')")
    rows = pages.select("page_id", "url", tag.alias("etag"), F.expr("coalesce(octet_length(html), 0)").cast("string").alias("size"), F.explode(F.array(F.lit(200), F.lit(304))).alias("status"))
    late = F.col("status") == 304
    at = F.col("page_id") + F.when(late, 5000).otherwise(0)
    headers = F.map_filter(
        F.create_map(
            F.lit("cache-control"), F.when(late, "max-age=600").otherwise("max-age=60"),
            F.lit("content-length"), F.when(late, "0").otherwise(F.col("size")),
            F.lit("content-type"), F.when(~late, "text/html"),
            F.lit("date"), at.cast("string"),
            F.lit("etag"), F.col("etag"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return rows.select((F.col("page_id") * 2 + F.when(late, 1).otherwise(0)).alias("record_id"), "url", F.timestamp_seconds(at).alias("ts"), "status", "etag", F.lit(None).cast("string").alias("last_modified"), headers.alias("headers"))
