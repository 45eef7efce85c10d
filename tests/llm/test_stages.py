"""The pipeline's stages against brute force."""

import random
import re

import corpus_pipeline as p
from pitgrid.llm import repeats

COLUMNS = "doc_id long, text string, lang string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "xx", len(t or "")) for i, t in rows], COLUMNS).repartition(3)


def shingles(text, size):
    w = re.findall(r"[^ \t-\r]+", (text or "").lower())
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def groups(rows, size):
    """Groups of row numbers: equal texts and texts at 0.8 or more of common shingles."""
    grams, parent = [shingles(t, size) for _, t in rows], list(range(len(rows)))
    root = lambda k: k if parent[k] == k else root(parent[k])
    for a in range(len(rows)):
        for b in range(a):
            both = len(grams[a] & grams[b])
            if (grams[a] and 10 * both >= 8 * len(grams[a] | grams[b])) or (not grams[a] and rows[a] == rows[b]):
                parent[root(a)] = root(b)
    found = {}
    for k in range(len(rows)):
        found.setdefault(root(k), []).append(k)
    return list(found.values())


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(4)
    a, b, c, d, e, f = (prose(rng, 120) for _ in range(6))
    rows = [(5, a), (5, a), (None, b), (None, b), (3, c), (9, c + " more"), (None, c), (None, d), (2, d), (4, e), (4, f), (4, f + " x"), (None, e + " tail"), (11, ""), (12, ""), (12, ""), (13, None)]
    rows += [(20 + i, prose(rng, 90)) for i in range(5)]
    # 0.81 of the four-word shingles in common, 0.77 of the five-word shingles
    near = prose(rng, 120).split(" ")
    rows += [(30, " ".join(near)), (31, " ".join("other" if i in (20, 60, 100) else w for i, w in enumerate(near)))]
    assert len(groups(rows[-2:], 4)) == 1 and len(groups(rows[-2:], 5)) == 2
    got = [(r.doc_id, r.text) for r in p.near_duplicates(spark, frame(spark, rows), "").collect()]
    want = groups(rows, 5)
    assert len(got) == len(want)
    for group in want:
        own = [rows[k] for k in group]
        assert sum(got.count(r) for r in set(own)) == 1
        ids = [i for i, _ in own if i is not None]
        kept = next(r for r in got if r in own)
        assert kept[0] == (min(ids) if ids else None)
    # what stays is not blanked as a repeat of its own copy
    after = {(r.doc_id, r.text) for r in p.exact_repeats(spark, frame(spark, got), "").collect()}
    assert {(5, a), (None, b), (2, d)} <= after


def without_passages(texts, over=50):
    """Words in windows of over + 1 whole words that occur twice go, with what stands between words that go."""
    spans = [[m.span() for m in re.finditer(rb"[^ \t-\r]+", t)] for t in texts]
    words = [[t[b:e] for b, e in own] for t, own in zip(texts, spans)]
    places = {}
    for k, own in enumerate(words):
        for i in range(len(own) - over):
            places.setdefault(tuple(own[i : i + over + 1]), []).append((k, i))
    gone = [set() for _ in texts]
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                gone[k].update(range(i, i + over + 1))
    out = []
    for t, own, go in zip(texts, spans, gone):
        cut = bytearray(len(t))
        for i in go:
            cut[own[i][0] : own[i][1]] = b"\1" * (own[i][1] - own[i][0])
            if i + 1 in go:
                cut[own[i][1] : own[i + 1][0]] = b"\1" * (own[i + 1][0] - own[i][1])
        out.append(bytes(x for x, c in zip(t, cut) if not c))
    return out


def test_passages_of_over_50_words_go(spark):
    rng = random.Random(8)
    short = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    passages = [prose(rng, n).replace(" ", "  ", 1) for n in range(48, 66)] + [short(50), short(51), short(65)]
    texts = []
    for x in passages:
        texts += [prose(rng, rng.randint(0, 9)) + " " + x + "\n" + prose(rng, 7) for _ in range(2)]
    inner = prose(rng, 60)
    texts += ["é" + inner, inner + "é ü", "x " + inner.replace(" ", "\t", 30), inner[3:], passages[5], prose(rng, 20) + " " + " ".join([inner[:200]] * 9), "w" * 900 + " end", "w" * 900 + " tail", "ab " * 300, "", " \n "]
    rows = [*enumerate(texts), (None, prose(rng, 30) + " " + passages[12] + " é"), (None, None)]
    got = {(r.doc_id, r.text, r.n_chars) for r in p.exact_repeats(spark, frame(spark, rows), "").collect()}
    small = {(r.doc_id, r.text) for r in repeats.without_passages(frame(spark, rows), class_limit=2).collect()}
    assert small == {r[:2] for r in got}
    want = without_passages([(t or "").encode() for _, t in rows])
    want = {(i, None if t is None else w.decode(), None if t is None else len(w.decode())) for (i, t), w in zip(rows, want)}
    assert got == want
    cut = {n for n, x in zip(range(48, 66), passages) if any(len(x.encode()) < 400 and t and x in t and (i, t, len(t)) not in got for i, t in rows)}
    assert {51, 52, 55} <= cut and not cut & {48, 49, 50}
