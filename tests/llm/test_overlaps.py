"""Shared passages against all windows of all documents."""

import hashlib
import random
import re

import numpy as np
import pytest

from pitgrid.llm import overlaps


def brute(rows, least):
    """(doc_id, n_words, n_removed, digest) of every row, from every window."""
    words = [re.findall(r"[^ \t-\r]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), own in zip(rows, words):
        for i in range(len(own) - least + 1):
            w = tuple(own[i : i + least])
            if doc is not None:
                first[w] = min(first.get(w, doc), doc)
    out = []
    for (doc, _), own in zip(rows, words):
        gone = set()
        for i in range(len(own) - least + 1):
            if doc is not None and first[tuple(own[i : i + least])] < doc:
                gone |= set(range(i, i + least))
        out.append((doc, len(own), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(own) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, least):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "É", "cc", "d.", f"w{rng.randint(0, 40)}"])
    some = lambda n: [word() for _ in range(n)]
    passages = [some(least + k) for k in (0, 1, 5, least)]
    texts = []
    for _ in range(60):
        own = some(rng.randint(0, 3 * least))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randint(0, 4)])
            at = rng.randint(0, len(own))
            own[at:at] = p[a : len(p) - rng.choice([0, 0, rng.randint(0, 3)])]
        texts.append("".join(w + rng.choice([" ", " ", "\n", " \t "]) for w in own))
    base = some(4 * least)
    for k in range(12):  # near copies: one word changed, and thousands of the same
        texts.append(" ".join(base[: k * 9] + ["changed"] + base[k * 9 + 1 :]))
    texts += [" ".join(base)] * 20 + ["x " * (5 * least), "x " * (3 * least), None, "", " \n", " ".join(base[: least - 1])]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows = [(i * 3 + 1, t) for i, (_, t) in enumerate(rows)]
    return [*rows, rows[3], rows[3], (rows[4][0], rows[5][1]), (rows[6][0], "own text " * 8), (None, " ".join(base)), (None, None)]


@pytest.mark.parametrize(("seed", "least"), [(1, 50), (2, 50), (3, 5), (4, 9), (5, 130)])
def test_equals_brute_force(spark, seed, least):
    rows = corpus(seed, least)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id int, text string, CHECK int, first string, n_words int").repartition(4)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in overlaps.overlap_report(df, least).collect()), key=str)
    want = brute(rows, least)
    assert got == want and sum(r[2] > 0 for r in want) > 10


def test_spans_texts_and_empty_tables(spark):
    text = " ".join(f"v{i}" for i in range(80))
    df = spark.createDataFrame([(1, text, "k"), (2, "before\n" + text + "\tafter", "k"), (3, "short  text", None)], "doc_id long, text string, left string")
    _, removed = overlaps.repeats_of_earlier(df)
    assert [(r.doc_id, [tuple(s) for s in r.spans], r.left) for r in removed.collect()] == [(2, [(1, 81)], "before after")]
    out = {r[0]: r[1] for r in overlaps.without_overlaps(df).collect()}
    assert out == {1: text, 2: "before after", 3: "short  text"}
    assert overlaps.overlap_report(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="five words"):
        overlaps.repeats_of_earlier(df, 3)


def test_leftmost_least_place():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 6, 200).astype(np.uint64)
    for span in (1, 2, 3, 7, 31, 32):
        assert overlaps.least_places(values, span).tolist() == [i + int(values[i : i + span].argmin()) for i in range(200 - span + 1)]
