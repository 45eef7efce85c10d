"""The training-data operators against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitgrid.llm import components, decontaminate, embeddings, language, minhash, packing, queries, repeats, revisits, shards, tokens, urls

SYLLABLES = ["ba", "ko", "é", "tir", "mo", "ÄN", "su", "pla", "X9", "no"]


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = words(rng, 150)
    texts = [base, base, base.replace("ba", "BA", 1), base + " " + words(rng, 5), words(rng, 60) + "\n\n  " + base[200:760] + "\t" + words(rng, 40), None, "", "   \n", "one two", "one two", "ab" * 900, words(rng, 3000)]
    texts += [words(rng, rng.randint(1, 80)) for _ in range(40)]
    rows = [(i, t, "xx", 1, True) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, base, "xx", 1, True), (None, None, None, None, None)]


COLUMNS = "doc_id long, text string, component_id string, kept int, check boolean"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame([*links, links[0], (7, 7), (None, 3)], "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    loops = {a for a, b in links if a == b}
    assert {k: v for k, v in want.items() if k in got or k not in loops} == got


@pytest.mark.parametrize("split", [0, 1, 60, 200])
def test_extended_components(spark, split):
    """Components of a part of the links, extended by the others, are those of all links."""
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(140)] + [(i, i + 1) for i in range(400, 460)]
    rng.shuffle(links)
    frames = [spark.createDataFrame(x, "a long, b long") for x in (links[:split], links[split:])]
    got = {r.id: r.component for r in components.extended(components.components(frames[0]), frames[1]).collect()}
    want = roots({x for p in links for x in p}, links)
    assert {k: want[k] for k in got} == got and {x for a, b in links if a != b for x in (a, b)} == set(got)


@pytest.mark.parametrize("block_words", [4_000_000, 20])
def test_decontamination(spark, corpus, block_words):
    rng = random.Random(9)
    rows = [r for r in corpus if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    items = [(1, (rows[0][1])[:300]), (22, "ONE, two!"), (3, words(rng, 30)), (3, rows[11][1][500:700]), (4, None), (5, "..."), (None, "ab" * 900)]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add("" if item is None else str(item))
    got = {r.doc_id: r for r in decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()}
    for doc, text, *_ in rows:
        w, hit, found = word.findall(lower(text)), set(), set()
        for i in range(len(w)):
            for n in (1, 2, 13):
                if own := windows.get(tuple(w[i : i + n]), None) if i + n <= len(w) else None:
                    hit |= set(range(i, i + n))
                    found |= own
        r = got[doc]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontaminate.contamination(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


def test_language(spark):
    rng = random.Random(2)
    lists = {"aa": ["the", "and", "of", "ing"], "bb": ["und", "sch", "ein", "ß"], "cc": ["que", "é", "ou", "la"]}
    rows = [(i, " ".join(rng.choice(lists[k]) for _ in range(rng.randint(3, 60))), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    model = language.fit(spark.createDataFrame([*rows, (None, None, "aa"), (1, "", "bb"), (2, "x", None)], "doc_id long, text string, lang string"), per_language=40)
    asked = [*[(i, t, "zz", 1.0) for i, t, _ in rows], (900, None, None, None), (901, " 12 !?", None, None), (902, "the of " * 30000, None, None)]
    got = language.identify(spark.createDataFrame(asked, "doc_id long, text string, lang_pred string, score double"), model).collect()
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].lang_pred == k for i, _, k in rows]) > 0.97
    assert (by[900].lang_pred, by[901].lang_pred, by[902].lang_pred) == ("und", "und", "aa") and all(0 <= r.score <= 1 for r in got)
    assert (model.weights == 0).mean() > 0.5
    assert by[0].sure and not by[900].sure and not by[901].sure
    # other languages' texts are told whatever the number of learnt languages; those of learnt ones stay
    for n in (1, 2, 3, 4):
        known = [(i, " ".join(rng.choice(lists[k] if k in lists else ["zo", "ki", "y"]) for _ in range(rng.randint(3, 60))), k) for i, k in enumerate(["aa", "bb", "cc", "dd"][:n] * 80)]
        few = language.fit(spark.createDataFrame(known, "doc_id long, text string, lang string"), per_language=60)
        strange = [(1000 + i, " ".join("".join(chr(rng.randint(0x430, 0x44F)) for _ in range(6)) for _ in range(rng.randint(2, 40)))) for i in range(40)]
        told = language.identify(spark.createDataFrame([(i, t) for i, t, _ in known] + strange, "doc_id long, text string"), few).collect()
        assert np.mean([r.sure for r in told if r.doc_id < 1000]) > 0.97 and not any(r.sure for r in told if r.doc_id >= 1000)
    again = language.fit(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string").repartition(5), per_language=40)
    once = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=40)
    assert (again.weights == once.weights).all() and again[3:] == once[3:]
    assert language.fit(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
    assert {r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), None).collect()} == {"und"}


def reference(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def test_encoder_is_exact():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", " \n", "\t", "a", "B", "é", "'s", "'", "1", "23", ".", ",", "²", " ", "中", "😀", "\x1c", "\r\n", "_", "ª", "×", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["", "x" * 50000]
    use = tokens.Encoder(queries.vocabulary())
    got = [x for i in range(0, len(texts), 100) for x in use.encode(texts[i : i + 100])]
    assert got == [x[:-1].tobytes() for x in reference(texts, 0)]


def test_token_files(spark, corpus, tmp_path):
    import pyarrow.fs

    folder = f"file://{tmp_path}/ids"
    files = tokens.write_token_files(frame(spark, corpus), folder, queries.vocabulary(), 2)
    got = sorted(tokens.read_token_files(files, folder).collect(), key=lambda r: r.start)
    order = sorted(corpus, key=lambda r: -1 if r[0] is None else r[0])
    assert [r.doc_id for r in got] == [r[0] for r in order]
    at, sums = 0, defaultdict(list)
    for (doc, *_), ids in zip(order, reference([r[1] for r in order], 2), strict=True):
        sums[doc].append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in sums[r.doc_id]
        at += r.n_tokens
    file = next(r.file for r in got if r.doc_id == 11)
    fs = pyarrow.fs.LocalFileSystem()
    path = f"{tmp_path}/ids/{file}"
    with fs.open_input_file(path) as f:
        ids = tokens.SeekableReader(f, fs.get_file_info(path).size).document(11)
    assert [x.tolist() for x in ids] == [reference([corpus[11][1]], 2)[0].tolist()]
    assert tokens.token_table(frame(spark, []), queries.vocabulary()).count() == 0


def test_near_duplicates(spark, corpus):
    rng = random.Random(8)
    base = words(rng, 120).split()
    near = [(1000 + i, " ".join(w if rng.random() > 0.02 else "zz" + str(i) for w in base), "a", 1, None) for i in range(60)]
    rows = [*corpus, *near]
    got = minhash.near_duplicates(frame(spark, rows), block=16).collect()
    assert len(got) == len(rows)
    word, sets = re.compile(r"[^\x20\x09-\x0D]+"), {}
    for doc, text, *_ in rows:
        if doc is not None:
            w = word.findall(lower(text))
            sets[doc] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 32))
    x = np.concatenate([centres[rng.integers(0, 12, 300)] + 0.12 * rng.standard_normal((300, 32)), rng.standard_normal((100, 32))]).astype(np.float32)
    x[5] = x[6]
    rows = [(i, v.tolist(), "n") for i, v in enumerate(x)] + [(900, None, "n"), (901, [0.0] * 32, "n"), (902, [float("nan")] * 32, "n"), (903, [1.0, None], "n"), (904, [], "n"), (905, [1.0, 2.0], "n"), (None, x[5].tolist(), "n")]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links string"), block=50).collect()
    by = {r.vec_id: r for r in got}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    found = sum(by[i].n_links for i in range(400))
    assert len(got) == len(rows) and s.sum() * 0.99 <= found <= s.sum()
    assert all(by[i].n_links <= s[i].sum() for i in range(400)) and by[5].component_id == by[6].component_id
    assert all(by[i].n_links == 0 and by[i].kept for i in range(900, 906))
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_codes_estimate_without_bias():
    rng = np.random.default_rng(1)
    a = rng.standard_normal(64)
    b = a + 0.5 * rng.standard_normal(64)
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    guesses, inside = [], 0
    for seed in range(400):
        _, signs, factor = embeddings.encode(a[None], seed)
        query, _, _ = embeddings.encode(b[None], seed)
        guess, bound = embeddings.estimate(signs, factor, query)
        guesses.append(guess[0, 0])
        inside += abs(guess[0, 0] - a @ b) <= bound[0]
    assert abs(np.mean(guesses) - a @ b) < 0.02 and inside >= 396


def test_shards(spark, corpus):
    rows = [*corpus, *[(2000 + i, f"t{i}", "a", 0, None) for i in range(500)]]
    got = shards.shard_table(frame(spark, rows), n_shards=4, bucket_bytes=2000).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in rows)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(4))
    assert all(r.grown_shard in (r.shard, 4) for r in got)
    again = shards.shard_table(frame(spark, rows).repartition(7), n_shards=4, bucket_bytes=2000).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    grown = {r.doc_id: r.shard for r in shards.shard_table(frame(spark, rows), n_shards=5).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    assert sorted(shards.fisher_yates(50, [1, 2]).tolist()) == list(range(50))
    assert shards.shard_table(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("least", "options"), [(40, {}), (40, {"class_limit": 3}), (400, {}), (400, {"class_limit": 1})])
def test_repeats(spark, corpus, least, options):
    got = repeats.repeat_report(frame(spark, corpus), least=least, gram=12 if least == 40 else 100, **options).collect()
    texts = [(r[1] or "").encode() for r in corpus]
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    want = Counter()
    for (doc, *_), t in zip(corpus, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[doc, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    seen = Counter(tuple(w[i : i + 12]) for t in texts for w in [t.split()] for i in range(len(w) - 11))
    more = Counter((r.doc_id, r.n_removed, r.n_passages, r.has_passage) for r in repeats.repeat_report(frame(spark, corpus), least=least, gram=12 if least == 40 else 100, over=11, **options).collect())
    for (doc, *_), t, own in zip(corpus, texts, [t.split() for t in texts], strict=True):
        gone = np.zeros(len(own) + 2, int)
        for i in range(len(own) - 11):
            if seen[tuple(own[i : i + 12])] > 1:
                gone[i + 1 : i + 13] = 1
        runs = int((np.diff(gone) == 1).sum())
        assert any(k[0] == doc and k[2:] == (runs, runs > 0) for k in more)
    assert sum(more.values()) == len(corpus)
    kept = repeats.without_repeats(frame(spark, corpus), least=400).collect()
    assert len(kept) == len(corpus) and kept[0].__fields__ == ["doc_id", "text", "component_id", "kept", "check"]
    assert repeats.repeat_report(frame(spark, [])).count() == 0


def test_url_filter(spark):
    rows = [(i, f"http://{h}.example.{d}/{lang}/{i}" + ("?a=1&b=2" if i % 3 else "")) for i, (h, d, lang) in enumerate([("a", "com", "en"), ("B", "net", "de"), ("c", "org", "es"), ("d", "com", "fr")] * 30)]
    rows += [(500, None), (501, "no scheme"), (502, "http://EXAMPLE.com/en/7?x"), (503, "http://example.net/de/8"), (504, "x://com/en/"), (505, "http://notcom/en/"), (505, "http://notcom/en/"), (506, "http://com"), (507, "http://a.com?/en/")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    assert (by[500].host, by[500].path, by[501].host) == ("", "", "")
    assert (by[502].rule, by[502].verdict, by[503].rule, by[503].verdict) == ("example.com/en/7", "allow", "example.net/de/8", "block")
    assert by[504].rule == "com/en/" and by[505].rule is None and by[506].rule is None and (by[507].host, by[507].path) == ("a.com", "")
    assert by[1].host == "b.example.net" and by[1].rule == "net/de/"
    # trees from labelled URLs, judged on hosts whose labels they have not seen
    rng = random.Random(6)
    pages = [(i, f"http://{'x' * rng.randint(2, 6)}{i}.{'spam' if i % 2 else 'good'}.{rng.choice(['io', 'eu'])}/" + ("/".join(str(rng.randint(1000, 9999)) for _ in range(5)) + "?a=1&b=2&c=3" if i % 2 else "about")) for i in range(600)]
    table = spark.createDataFrame(pages, "page_id long, url string")
    judged = urls.filter_urls(table, queries.URL_RULES, labelled=table.where("page_id < 300").selectExpr("url", "page_id % 2 as label")).where("page_id >= 300").collect()
    assert np.mean([(r.verdict == "block") == (r.page_id % 2 == 1) for r in judged]) > 0.95
    # a labelled row's share never holds its own label: lone domains get the prior
    shares = urls.with_features(urls.with_parts(table.where("page_id < 20")).withColumn("label", F.expr("page_id % 2 + 0.0D")).withColumn("url", F.expr("concat(url, page_id)"))).collect()
    assert all(0 < r.f_domain_block < 1 for r in shares)
    lone = urls.filter_urls(spark.createDataFrame([(1, "http://x.y/z")], "page_id long, url string"), queries.URL_RULES).collect()
    assert lone[0].verdict == "allow" and urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


def test_packing(spark, corpus):
    got = packing.pack(frame(spark, corpus), queries.vocabulary(), end=1, capacity=256, keep_ids=True).collect()
    bins, docs = defaultdict(list), Counter()
    whole = Counter(x.tobytes() for x in reference([r[1] for r in corpus], 1))
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id] += r.length
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    for doc, text, *_ in corpus[:12]:
        if doc != 3:
            own = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in own) in whole
    assert sum(docs.values()) > 0.95 * 256 * (len(bins) - 1)
    assert all(r.bin_class == min(64, 256 // r.length) for r in got)
    # full bins of a class hold its number of pieces; only what workers leave open is mixed
    full = defaultdict(list)
    for r in got:
        if r.sequence_id < 1 << 62:
            full[r.sequence_id].append(r.bin_class)
    assert full and all(len(x) == x[0] and len(set(x)) == 1 for x in full.values()) and {3, 5, 6, 7} & {x[0] for x in full.values()}
    assert all(sum(packing.cuts(n, 256, 16)) == n for n in range(1200)) and packing.cuts(0, 256, 16) == []
    assert packing.pack(frame(spark, []), queries.vocabulary()).count() == 0


def test_revisits(spark):
    rows = [
        (1, "http://A.com/x/?b=2&a=1#f", 10, 200, "e1", None, {"etag": "e1", "content-length": "5", "date": "d0"}),
        (2, "https://www.a.com/x?a=1&b=2&utm_source=q", 20, 304, "W/e1", None, {"date": "d1", "content-length": "0"}),
        (3, "http://a.com/x?a=1&b=2", 9000, 200, "e2", "m", {"etag": "e2"}),
        (4, "http://a.com/x?a=1&b=2", 9000, 304, "e1", None, None),
        (5, "http://a.com/x?a=1&b=2", 20000, 304, None, "m", {}),
        (6, "http://a.com/x?a=1&b=2", 20000, 304, "e1", None, {}),
        (7, "http://a.com/other", 20000, 304, "e1", None, {}),
        (8, None, 1, 304, None, None, None),
        (9, "http://a.com/x?a=1&b=2", 20001, 304, None, None, {}),
        (9, "http://a.com/x?a=1&b=2", 20001, 304, None, None, {}),
        (10, "http://a.com/x", None, 304, None, None, {}),
    ]
    table = spark.createDataFrame(rows, "record_id long, url string, s long, status int, etag string, last_modified string, headers map<string,string>").selectExpr("*", "timestamp_seconds(s) as ts", "1 as source_id")
    for block in (1, 3600, 10**6):
        got = sorted(revisits.resolve_revisits(table, block).collect(), key=lambda r: r.record_id)
        assert [(r.record_id, r.source_id, r.outcome) for r in got] == [(2, 1, "resolved"), (4, 1, "resolved"), (5, 3, "resolved"), (6, 3, "mismatch"), (7, None, "missing"), (8, None, "missing"), (9, 3, "unchecked"), (9, 3, "unchecked"), (10, None, "missing")]
        assert got[0].headers == {"etag": "e1", "content-length": "5", "date": "d1"}
    assert revisits.resolve_revisits(table.limit(0)).count() == 0
    pages = revisits.resolve_revisits(revisits.captures(spark.createDataFrame([(None, "http://a", "x"), (None, None, None), (1, "http://a", None)], "page_id long, url string, html string"))).collect()
    assert sorted((str(r.record_id), r.outcome) for r in pages) == [("3", "unchecked"), ("None", "missing"), ("None", "missing")]


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns and kept.count() <= before.count()
        if name == "language_id":
            assert kept.count() >= 0.98 * before.count()
    assert minhash.near_duplicates(kept).where("not kept").count() <= 1
    assert p.STAGES[-1][1](spark, kept, sf).select("doc_id").distinct().count() == kept.count()
