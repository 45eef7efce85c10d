"""The lexical features of URLs against plain Python, and suffix shares that leave a row's own fold out."""

import math
import random

from pyspark.sql import functions as F

from pitgrid.llm import urls


def test_features_equal_brute_force(spark):
    rng = random.Random(2)
    hosts = ["a.io", "b.c.io", "X.Y.z.eu", "lone", "", "é.io", "a.io"]
    rows = [(i, rng.choice(["http://", "x://", ""]) + rng.choice(hosts) + rng.choice(["", "/", "/p/q-1", "/9/é/2//"]) + rng.choice(["", "?a=1", "?a=1&b=2&&", "#x", "?"]), rng.choice([0.0, 1.0, None])) for i in range(200)]
    rows += [(900, None, 1.0), (901, "", None)]
    parts = urls.with_parts(spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")).join(spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id long, label double"), "page_id")
    fold = F.when(F.col("label").isNotNull(), F.pmod(F.xxhash64(F.lit(17), F.coalesce("url", F.lit(""))), F.lit(urls.FOLDS)))
    known = {r.page_id: (r.host, r.path, r.label, r.fold) for r in parts.withColumn("fold", fold).collect()}
    ends = lambda host, n: ".".join(host.split(".")[-n:])
    for few in (8 << 20, 0):
        got = {r.page_id: r for r in urls.with_features(parts, few_bytes=few).collect()}
        assert len(got) == len(rows)
        for i, url, label in rows:
            url, (host, path, _, own) = url or "", known[i]
            rest = url.split("://", 1)[1] if "://" in url else ""
            plain = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            assert host == "".join(c.lower() if c.isascii() else c for c in rest[:plain])
            tail = rest[plain:]
            assert path == tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
            shares = {}
            for name, n in (("suffix", 1), ("domain", 2)):
                same = [known[j] for j, *_ in rows if ends(known[j][0], n) == ends(host, n)]
                other = [k for k in same if k[2] is not None and (label is None or k[3] != own)]
                shares |= {f"f_{name}_seen": math.log1p(len(same)), f"f_{name}_block": (sum(k[2] for k in other) + 1) / (len(other) + 2)}
            want = {
                "f_length": len(url), "f_host_length": len(host), "f_path_length": len(path), "f_depth": path.count("/"), "f_labels": len(host.split(".")), "f_digits": sum(c in "0123456789" for c in url) / max(1, len(url)),
                "f_hyphens": url.count("-"), "f_parameters": len(url.rsplit("?", 1)[1].split("&")) if "?" in url else 0, "f_entropy": -sum(url.count(c) / len(url) * math.log2(url.count(c) / len(url)) for c in set(url)),
            } | shares
            assert set(want) == set(urls.FEATURES)
            for c, v in want.items():
                assert math.isclose(got[i][c], v, abs_tol=1e-9), (c, url, got[i][c], v)
