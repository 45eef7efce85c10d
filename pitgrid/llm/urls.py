"""URL filter: a rule list first, then gradient-boosted trees on lexical features.

The trees learn from the URLs that the rules decide, or from any labelled URLs: of each label the ``most_labels`` / 2 rows with the
least hashes, weighted to the labels' shares of all labelled rows. Suffix statistics are counted over all URLs.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.workspace import cut

#: Parts of the labelled URLs, by a hash of the URL, for shares that leave a row's own part out.
FOLDS = 5
FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_hyphens", "f_parameters", "f_entropy", "f_suffix_seen", "f_suffix_block", "f_domain_seen", "f_domain_block"]


def lowered(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path: the host follows the first ``://`` up to /, ?, # or the end, the path then goes up to ?, # or the end."""
    rest = F.expr("coalesce(if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), ''), '')")
    rows = pages.select("page_id", "url", rest.alias("_rest")).withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    return rows.select("page_id", "url", lowered(F.col("_host")).alias("host"), F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0).alias("path"))


def with_rule(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule and ruled: the longest rule (verdict, host/path) that fits the host or a domain above it and the path's start."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, ruled = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return rows.withColumns({"rule": rule, "ruled": ruled})


def with_features(rows: DataFrame, few_bytes: int = 8 << 20) -> DataFrame:
    """Adds the lexical features; label (1 block, 0 allow, null unknown) feeds the suffixes' shares only, and those of other folds than its own.

    Suffix statistics of at most ``few_bytes`` are broadcast, larger ones joined by a shuffle.
    """
    rows = rows.withColumns({"_u": F.coalesce("url", F.lit("")), "_suffix": F.element_at(F.split("host", r"\."), -1), "_domain": F.array_join(F.expr("slice(split(host, '\\\\.'), -least(2, size(split(host, '\\\\.'))), 2)"), ".")})
    rows = rows.withColumns(
        {
            "f_length": F.length("_u"),
            "f_host_length": F.length("host"),
            "f_path_length": F.length("path"),
            "f_depth": F.expr("length(path) - length(replace(path, '/', ''))"),
            "f_labels": F.expr("size(split(host, '\\\\.'))"),
            "f_digits": F.expr("length(regexp_replace(_u, '[^0-9]', '')) / greatest(1, length(_u))"),
            "f_hyphens": F.expr("length(_u) - length(replace(_u, '-', ''))"),
            "f_parameters": F.expr("if(instr(_u, '?') > 0, size(split(substring_index(_u, '?', -1), '&')), 0)"),
            "f_entropy": F.expr("aggregate(array_distinct(split(_u, '')), 0D, (s, c) -> s - if(c = '', 0D, ((length(_u) - length(replace(_u, c, ''))) / length(_u)) * log2((length(_u) - length(replace(_u, c, ''))) / length(_u))))"),
        }
    )
    rows = rows.withColumn("_fold", F.when(F.col("label").isNotNull(), F.pmod(F.xxhash64(F.lit(17), "_u"), F.lit(FOLDS))))
    for name in ("suffix", "domain"):
        sums = [(f"b{k}", F.sum(F.when(F.col("_fold") == k, F.col("label")).otherwise(0.0))) for k in range(FOLDS)] + [(f"k{k}", F.count(F.when(F.col("_fold") == k, 1))) for k in range(FOLDS)]
        seen = cut(rows.groupBy(f"_{name}").agg(F.count("*").alias("n"), *[c.alias(a) for a, c in sums]), name)
        size = seen.agg(F.sum(F.octet_length(f"_{name}") + 8 * (2 * FOLDS + 8))).first()[0] or 0
        seen = seen.selectExpr(f"_{name}", f"log1p(n) as f_{name}_seen", f"array({', '.join(f'b{k}' for k in range(FOLDS))}) as _b", f"array({', '.join(f'k{k}' for k in range(FOLDS))}) as _k")
        rows = rows.join(F.broadcast(seen) if size <= few_bytes else seen, f"_{name}", "left")
        # a labelled row's share leaves its own fold out, so it never holds the row's label
        total = "aggregate({0}, cast(0 as double), (s, x) -> s + x) - coalesce({0}[cast(_fold as int)], 0)"
        rows = rows.withColumn(f"f_{name}_block", F.expr(f"({total.format('_b')} + 1) / ({total.format('_k')} + 2)")).drop("_b", "_k")
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES})


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, most_labels: int = 20_000, trees: int = 12, depth: int = 4, seed: int = 3) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the trees' probability of block).

    pages(page_id, url), rules [(block or allow, host/path)], labelled(url, label: 1 block, 0 allow); without it the URLs that rules decide are the
    labelled ones. A null url has an empty host and path and is judged like any other. Repeated rows are judged each.
    Without labels of both kinds there are no trees: what no rule decides gets the only label there is, else allow.
    """
    rows = with_rule(with_parts(pages), rules)
    if labelled is None:
        rows = rows.withColumn("label", F.expr("case ruled when 'block' then 1.0D when 'allow' then 0.0D end"))
    else:
        known = labelled.groupBy(F.col("url").alias("_known")).agg(F.max(F.col("label").cast("double")).alias("label"))
        rows = rows.join(known, F.col("url") == F.col("_known"), "left").drop("_known")
    rows = with_features(rows)
    taught = rows.where("label is not null")
    sizes = {r.label: r["count"] for r in taught.groupBy("label").count().collect()}
    if len(sizes) < 2:
        only = "block" if 1.0 in sizes else "allow"
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(only)).alias("verdict"), F.lit(float(only == "block")).alias("score"))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    sample, most = None, max(1, most_labels // 2)
    for label, n in sorted(sizes.items()):
        own = taught.where(F.col("label") == label).withColumn("_h", F.xxhash64(F.lit(seed), "page_id", "url")).orderBy("_h", "page_id", "url").limit(most)
        own = own.select("label", *FEATURES, F.lit(n / min(n, most)).alias("_weight"))
        sample = own if sample is None else sample.unionByName(own)
    sample = cut(sample, "labelled")
    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="_weight", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed).fit(gather.transform(sample))
    judged = model.transform(gather.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
