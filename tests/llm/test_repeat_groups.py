"""Interval trees and the groups of maximal repeats against brute force."""

import random
from hashlib import sha256

import pytest

from pitgrid.llm import repeats

COLUMNS = "doc_id long, text string, passage string"


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(40))
def test_a_class_against_all_pairs(seed):
    """Each pair's shared context, closed over all members that have it, is a group, and there are no other groups."""
    rng = random.Random(seed)
    least, n = rng.randint(3, 7), rng.randint(2, 14)
    pairs = list({(bytes(rng.choices(b"ab", k=rng.randint(0, 5))), b"g" + bytes(rng.choices(b"ab", k=rng.randint(0, 5)))) for _ in range(n)})
    lefts, rights = [p[0] for p in pairs], [p[1] for p in pairs]
    want = set()
    for i in range(len(pairs)):
        for j in range(i):
            left, right = common(lefts[i], lefts[j]), common(rights[i], rights[j])
            if left + right >= least:
                members = [k for k in range(len(pairs)) if common(lefts[k], lefts[i]) >= left and common(rights[k], rights[i]) >= right]
                want.add((left, right, tuple(members)))
    got = [(left, right, tuple(sorted(m))) for left, right, m in repeats.maximal_repeats(rights, lefts, least)]
    assert len(got) == len(set(got)) and set(got) == want
    far = [(max((g[0] for g in want if k in g[2]), default=0), max((g[1] for g in want if k in g[2]), default=0)) for k in range(len(pairs))]
    assert list(zip(*(x.tolist() for x in repeats.reaches(rights, lefts, least)), strict=True)) == far
    wide = [[b"".join(bytes((0, 0, 0, 0, 0, 0, 0, c)) for c in x) for x in side] for side in (rights, lefts)]
    assert [(a, b, tuple(sorted(m))) for a, b, m in repeats.maximal_repeats(*wide, least, 8)] == got


def corpus():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    a, b, c, whole = word(60), word(45), word(41), word(90)
    texts = [a + word(20) + b, word(9) + a, b + c + word(7), c, c + word(5) + c, whole, whole, whole[:50] + word(30), "é" * 60 + word(30), word(8) + "é" * 60, "ab" * 60, None, "", word(30)]
    texts += [a + b, word(3) + a + b + word(4), b + c + word(1), word(100)]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    return [*rows, (17, texts[17], "x"), (17, texts[17], "x"), (None, texts[17], "x"), (None, None, "x")]


def starts(raw, part):
    return [k for k in range(len(raw) - len(part) + 1) if raw.startswith(part, k)]


@pytest.mark.parametrize("class_limit", [1, 2, 2000])
def test_groups_hold_all_places(spark, class_limit):
    rows, least = corpus(), 40
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    groups = {}
    for r in repeats.repeat_groups(spark.createDataFrame(rows, COLUMNS).repartition(3), least=least, gram=10, class_limit=class_limit).collect():
        groups.setdefault((r.passage, r.n_bytes, r.n_places), []).append((r.doc_id, r.start))
    by_id = {i: raw for i, raw in reversed(texts) if raw}
    shifted = set()
    for (passage, n, n_places), places in groups.items():
        part = by_id[places[0][0]][places[0][1] : places[0][1] + n]
        assert sha256(part).hexdigest() == passage and len(part) == n >= least and n_places == len(places) > 1
        assert sorted(places, key=str) == sorted(((i, s) for i, raw in texts for s in starts(raw, part)), key=str)
        shifted |= {tuple(sorted(((i, s + k) for i, s in places), key=str)) for k in range(n - least + 1)}
    want = {}
    for i, raw in texts:
        for s in range(len(raw) - least + 1):
            want.setdefault(raw[s : s + least], []).append((i, s))
    assert all(tuple(sorted(p, key=str)) in shifted for p in want.values() if len(p) > 1)
    # passages with the same places but for a shift neither overlap nor touch
    family = {}
    for (_, n, _), places in groups.items():
        i, first = min(places, key=lambda x: (str(x[0]), x[1]))
        family.setdefault((i, tuple(sorted(((j, s - first) for j, s in places), key=str))), []).append((first, first + n))
    assert all(a[1] < b[0] for spans in family.values() for a, b in zip(sorted(spans), sorted(spans)[1:], strict=False))
    assert (sha256(by_id[6]).hexdigest(), 90, 2) in groups


def test_no_rows(spark):
    assert repeats.repeat_groups(spark.createDataFrame([], COLUMNS)).count() == 0
    assert repeats.repeat_groups(spark.createDataFrame([(1, None, "x"), (None, "", "x")], COLUMNS)).count() == 0
