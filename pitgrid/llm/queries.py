"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.llm import audits, conversations, decontaminate, embeddings, language, minhash, overlaps, packing, repeats, revisits, shards, tokens, urls

#: The rule list of the URL filter.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words found in every document, by an FM-index of each shard of documents."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items", "check")


HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, false)"


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from documents whose doc_id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(f"not {HELD_OUT}"))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from seekable token files in ascending doc_id order."""
    return tokens.token_table(table(spark, sf_dir, "documents"), vocabulary(), end=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 80 % of their four-word shingles in common."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors with a cosine of 0.9 or more."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 40 shuffled shards under the law ``key``."""
    return shards.shard_table(table(spark, sf_dir, "documents"), n_shards=40)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeats of 400 bytes, and its repeated passages of over 50 words."""
    return repeats.repeat_report(table(spark, sf_dir, "documents"), least=400, over=50)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for the URL of every page."""
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 2,048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), end=1).drop("bin_class")


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's revisit, resolved to an earlier response of its canonical URL."""
    found = revisits.resolve_revisits(revisits.captures(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical_url", "source_id", "outcome", F.expr("array_join(transform(array_sort(map_keys(headers)), k -> concat(k, ': ', headers[k])), '; ')").alias("headers"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    return conversations.audit_damaged(table(spark, sf_dir, "conversations"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the runs of 50 words that documents with smaller ids have too."""
    return overlaps.overlap_report(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every part of the documents, in each of their orders."""
    return audits.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_language_id, op3_token_files, op4_minhash, op5_embeddings, op6_sharding, op7_suffix_array, op8_url_filter, op9_packing, op10_revisits,
        op11_conversations, op12_substrings, op13_filter_audit,
    )
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        i AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS j0 FROM b WHERE len(w) > 0),
        g AS (SELECT DISTINCT item_id, n, array_to_string(w[j0:j0 + n - 1], ' ') AS gram FROM i),
        e AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j0 FROM d, (SELECT DISTINCT n FROM g)),
        h AS (SELECT e.doc_id, e.j0, e.n, g.item_id FROM (SELECT doc_id, j0, n, array_to_string(w[j0:j0 + n - 1], ' ') AS gram FROM e) e JOIN g USING (n, gram)),
        p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(j0, j0 + n)) AS pos FROM h) GROUP BY doc_id),
        s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(s.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op4_minhash": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[j0:j0 + 3], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS j0 FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        e AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
        l AS (SELECT a, b FROM e JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
        s AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT s.b, r.root FROM r JOIN s ON r.id = s.a WHERE r.root < s.b),
        c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.root AS component_id, c.root = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id""",
    "op5_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
        n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
        r(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON r.id = l.a WHERE r.root < l.b),
        c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
        SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.root AS component_id, c.root = v.vec_id AS kept
        FROM v LEFT JOIN n USING (vec_id) JOIN c ON c.id = v.vec_id""",
    "op7_suffix_array": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, j0, md5(substr(h, 2 * j0 + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS j0 FROM d WHERE length(h) >= 800)),
        r AS (SELECT doc_id, j0 FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
        o AS (SELECT doc_id, j0, CASE WHEN j0 <= lag(j0) OVER (PARTITION BY doc_id ORDER BY j0) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
        i AS (SELECT doc_id, j0, sum(fresh) OVER (PARTITION BY doc_id ORDER BY j0 ROWS UNBOUNDED PRECEDING) AS run FROM o),
        s AS (SELECT doc_id, min(j0) AS b, max(j0) + 400 AS e FROM i GROUP BY doc_id, run),
        p AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS since FROM s),
        k AS (SELECT p.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (b - since)), '' ORDER BY b) || substr(any_value(h), 2 * max(e) + 1) AS kept, sum(e - b) AS n_removed, count(*) AS n_spans FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
        , v AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents),
        g AS (SELECT doc_id, j0, md5(array_to_string(x[j0:j0 + 50], ' ')) AS k FROM (SELECT doc_id, x, unnest(range(1, len(x) - 49)) AS j0 FROM v WHERE len(x) > 50)),
        y AS (SELECT doc_id, j0 FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
        z AS (SELECT doc_id, sum(CASE WHEN j0 <= before + 51 THEN 0 ELSE 1 END) AS n FROM (SELECT doc_id, j0, lag(j0) OVER (PARTITION BY doc_id ORDER BY j0) AS before FROM y) GROUP BY doc_id)
        SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(k.kept, d.h))) AS kept_sha256, CAST(coalesce(z.n, 0) AS BIGINT) AS n_passages, coalesce(z.n, 0) > 0 AS has_passage
        FROM d LEFT JOIN k USING (doc_id) LEFT JOIN z USING (doc_id)""",
    "op10_revisits": r"""
        WITH u AS (SELECT page_id, url, html, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
        q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_replace(regexp_extract(rest, '(?s)[?].*$'), '^[?]', ''), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid|ref)(=|$)'))), '&') AS query FROM u),
        c AS (SELECT page_id, '"' || md5(html)[1:16] || '"' AS etag, CAST(coalesce(strlen(html), 0) AS VARCHAR) AS size,
                     regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '')
                     || regexp_replace(regexp_extract(regexp_replace(rest, '^[^/?]*', ''), '^[^?]*'), '/$', '')
                     || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url FROM q),
        j AS (SELECT r.page_id, r.url, r.etag, max(s.page_id) AS source FROM c r LEFT JOIN c s ON s.url = r.url AND s.page_id < r.page_id + 5000 GROUP BY r.page_id, r.url, r.etag),
        o AS (SELECT j.*, s.size, CASE WHEN j.source IS NULL THEN 'missing' WHEN s.etag IS NULL OR j.etag IS NULL THEN 'unchecked' WHEN s.etag = j.etag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j LEFT JOIN c s ON s.page_id = j.source)
        SELECT 2 * page_id + 1 AS record_id, url AS canonical_url, 2 * source AS source_id, outcome,
               CASE WHEN outcome IN ('resolved', 'unchecked') THEN 'cache-control: max-age=600; content-length: ' || size || '; content-type: text/html; date: ' || CAST(page_id + 5000 AS VARCHAR) || '; etag: ' || etag END AS headers
        FROM o""",
    "op11_conversations": r"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        f AS (SELECT *, xor(list_reduce(flatten(list_transform(string_split(key, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS fault FROM k),
        g AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fault <> 0),
        o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM g),
        d AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
        t AS (SELECT conv_id, turn, role, text, pos, body = '' AS blank, body <> '' AND again AS duplicate, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
            pos > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal, CASE WHEN body <> '' AND NOT again THEN left(role, 1) END AS own FROM d),
        s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate, sum(truncated::INT) AS truncated, sum(illegal::INT) AS illegal, max(pos) AS n FROM t GROUP BY 1),
        e(edit, from_, to_, cost, marks, before) AS (VALUES ('D', '', '', 3, 'D', NULL), ('D', 's', 's', 3, 'D', NULL), ('D', 'u', 'u', 3, 'D', NULL), ('D', 'a', 'a', 3, 'D', NULL),
            ('K', '', 's', 0, 'K', ''), ('K', '', 'u', 0, 'K', ''), ('K', 's', 'u', 0, 'K', ''), ('K', 'a', 'u', 0, 'K', ''), ('K', 'u', 'a', 0, 'K', ''), ('K', '', 'a', 2, 'IK', 'user:'), ('K', 's', 'a', 2, 'IK', 'user:'), ('K', 'a', 'a', 2, 'IK', 'user:'), ('K', 'u', 'u', 2, 'IK', 'assistant:'),
            ('R', '', 'u', 2, 'R', ''), ('R', 's', 'u', 2, 'R', ''), ('R', 'a', 'u', 2, 'R', ''), ('R', 'u', 'a', 2, 'R', ''), ('R', '', 'a', 4, 'IR', 'user:'), ('R', 's', 'a', 4, 'IR', 'user:'), ('R', 'a', 'a', 4, 'IR', 'user:'), ('R', 'u', 'u', 4, 'IR', 'assistant:')),
        w(conv_id, pos, state, cost, audit, lines) AS (
            SELECT conv_id, 0::BIGINT, '', 0::BIGINT, '', []::VARCHAR[] FROM s
            UNION ALL
            SELECT conv_id, pos, state, cost, audit, lines FROM (
                SELECT w.conv_id, t.pos, e.to_ AS state, w.cost + e.cost + CASE WHEN e.edit <> 'D' AND t.truncated THEN 1 ELSE 0 END AS cost, w.audit || e.marks AS audit,
                    w.lines || CASE WHEN e.before <> '' THEN [e.before] ELSE [] END || CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [CASE e.to_ WHEN 'u' THEN 'user:' ELSE 'assistant:' END || t.text] END AS lines
                FROM w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1 JOIN e ON e.from_ = w.state AND (e.edit = 'D' OR t.own IS NOT NULL AND (e.edit = 'R' OR t.own = e.to_)))
            QUALIFY row_number() OVER (PARTITION BY conv_id, pos, state ORDER BY cost, audit) = 1),
        z AS (SELECT w.conv_id, w.cost + CASE state WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END AS cost, audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit, lines || CASE state WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE [] END AS lines
            FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.pos),
        y AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
        SELECT c.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(s.blank, 0) AS BIGINT) AS blank, CAST(coalesce(s.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(s.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(s.illegal, 0) AS BIGINT) AS illegal,
            CAST(coalesce(y.cost, 0) AS BIGINT) AS cost, coalesce(y.audit, '') AS audit, sha256(coalesce(array_to_string(y.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op12_substrings": r"""
        WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        r AS (SELECT *, row_number() OVER () AS row FROM d),
        g AS (SELECT row, doc_id, j0, md5(array_to_string(w[j0:j0 + 49], ' ')) AS k FROM (SELECT *, unnest(range(1, len(w) - 48)) AS j0 FROM r WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
        f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
        h AS (SELECT row, j0 FROM g JOIN f USING (k) WHERE doc_id > first),
        o AS (SELECT row, j0, CASE WHEN j0 <= lag(j0) OVER (PARTITION BY row ORDER BY j0) + 50 THEN 0 ELSE 1 END AS fresh FROM h),
        i AS (SELECT row, j0, sum(fresh) OVER (PARTITION BY row ORDER BY j0 ROWS UNBOUNDED PRECEDING) AS run FROM o),
        s AS (SELECT row, min(j0) AS b, max(j0) + 50 AS e FROM i GROUP BY row, run),
        p AS (SELECT row, b, e, coalesce(lag(e) OVER (PARTITION BY row ORDER BY b), 1) AS since FROM s),
        q AS (SELECT p.row, flatten(list(r.w[since:b - 1] ORDER BY b)) || any_value(r.w[ends:]) AS kept, sum(e - b) AS n FROM (SELECT *, max(e) OVER (PARTITION BY row) AS ends FROM p) p JOIN r USING (row) GROUP BY p.row)
        SELECT r.doc_id, CAST(len(r.w) AS BIGINT) AS n_words, CAST(coalesce(q.n, 0) AS BIGINT) AS n_removed, sha256(array_to_string(coalesce(q.kept, r.w), ' ')) AS kept_sha256 FROM r LEFT JOIN q USING (row)""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        m AS (SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
            + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
        l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
        f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        p AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM p, (SELECT unnest(range(1, 6)) AS step)),
        x AS (SELECT part, filter_order, step, bit, before, sum(n) FILTER (mask & (bit | before) = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant,
            sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & bit <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0) AS toxic_lost FROM c, s GROUP BY ALL),
        h AS (SELECT part, bit, sum(removed) AS shapley FROM x GROUP BY part, bit)
        SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
            CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(shapley, 0) AS BIGINT) AS shapley FROM x JOIN h USING (part, bit)""",
}
