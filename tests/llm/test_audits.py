"""Filter interactions against every order applied to every document."""

import random
import re
from itertools import permutations

import pytest

from pitgrid.llm import audits


def brute(rows, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    fails = []
    for doc, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^ \t-\r]+", text)
        fails.append("".join(c for c, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)),
            doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows),
        )) if bad))
    out, parts = {}, {r[2] or "" for r in rows}
    for part in parts:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                total[c] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(c in f for _, f in own) - len(gone), sum(f == c for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for key in out:
            if key[0] == part and len(out[key]) == 6:
                out[key].append(total[key[1][key[2] - 1]])
    return out


def rows_of(seed):
    rng = random.Random(seed)
    long = [" ".join(rng.choice([f"w{rng.randint(0, 300)}", "é", "WORD", "It's"]) for _ in range(rng.choice([40, 99, 100, 130, 200]))) for _ in range(25)]
    texts = [*long, "AB" * 30, "a|b", "", " \t\n", None, "50 % " + long[3], long[4].upper(), "x\x1fy z " * 60]
    rows = [(rng.randint(0, 60), rng.choice(texts), rng.choice(["en", "de", "", None, "x"])) for _ in range(250)]
    rows += [(i, long[0], "en") for i in range(100, 140)] + [(7, long[1], "de")] * 5 + [(None, long[0], "en"), (None, None, None)]
    return rows


@pytest.mark.parametrize("held", [32 << 20, 500])
def test_equals_brute_force(spark, monkeypatch, held):
    rows = rows_of(held)
    rng = random.Random(1)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(0, 130, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    fold = audits._folded

    def bounded(part):
        audits.HELD_BYTES = held
        return fold(part)

    monkeypatch.setattr(audits, "_folded", bounded)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, N int, mask string").repartition(6)
    got = audits.interactions(docs, spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, part int")).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got} == brute(rows, labels) and len(got) == 4 * 600
    ids = {r.doc_id for r in audits.repeated_ids(docs).collect()}
    assert ids == {d for d, t, _ in rows if d is not None and any(e is not None and e < d and (u or "") == (t or "") for e, u, _ in rows)}


def test_texts_that_collide_stay_apart():
    chains = audits.Chains()
    out = [x for key, text, at in ((5, "a", 3), (5, "b", 1), (5, "a", 2), (5, "b", 9), (5, "a", 2)) for x in chains.add(key, text, None, at, {"p": 1})]
    assert [(x[0], x[2] & audits.COPY) for x in out] == [(3, 16), (9, 16)] and [(link[0], link[2], link[3]) for link in chains.of[5]] == [("a", 2, {"p": 2}), ("b", 1, {"p": 1})]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audits.interactions(docs, labels).collect() == []
    one = audits.interactions(spark.createDataFrame([(1, None, None)], docs.schema), labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.part, r.kept, r.removed, r.shapley) for r in one] == [("", 0, 1, 120)] + [("", 0, 0, 0)] * 4
