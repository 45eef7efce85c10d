"""Every stage on empty tables, null ids and texts, repeated rows and columns with the names that the stages use themselves."""

import random

import pytest

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"
EXTRA = ["t", "u", "spans", "_spans", "copies", "whole", "check", "key", "own", "row", "number", "first", "language", "Sure", "score", "lang_pred", "size", "n_hit"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


@pytest.fixture(scope="module")
def rows(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    out = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in given]
    words = random.Random(1).sample([w for r in given if r.text for w in r.text.split()], 80)
    passage = " ".join(words)
    out += [out[3], out[3], (None, out[4][1], None, None, None), (None, None, None, None, None), (None, None, None, None, None), (9000, None, "en", "x", 0), (9001, "", "en", "x", 0), (9002, " \n", "en", "x", 2), (9003, "1 2 3", "en", "x", 5)]
    out += [(9010 + i, f"{' '.join(words[i:i + 9])} {passage} {' '.join(words[2 * i:2 * i + 11])}", "en", "x", 1) for i in range(3)]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    out += [(None, item, "en", "x", 1), (9020, item, "en", "x", 1)]
    return [(*r, *[f"{c}{k}" for c in EXTRA]) for k, r in enumerate(out)]


def same(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))


def test_stages_keep_columns_and_decide_for_null_ids(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    whole = {tuple(r) for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got = [tuple(r) for r in out.collect()]
        if name == "exact_repeats":
            assert len(got) == len(rows) and {r[0:1] + r[5:] for r in got} == {r[0:1] + r[5:] for r in whole}
            texts = {r[0]: r[1] for r in got}
            assert all(len(texts[9010 + i].split()) == 20 for i in range(3)) and texts[9000] is None and texts[9002] == " \n"
        else:
            assert set(got) <= whole
        if name == "language_id":
            assert not {9000, 9001, 9002, 9003} & {r[0] for r in got} and len(got) >= len(rows) - 8
        if name == "near_duplicates":
            assert len({r[1] for r in got if r[1] and r[1].strip()}) == sum(bool(r[1] and r[1].strip()) for r in got)
        if name == "decontamination":
            assert not any(r[1] == rows[-1][1] for r in got) and len(got) >= 0.9 * len(rows)
    pieces = p.STAGES[-1][1](spark, docs, SF)
    assert pieces.groupBy("doc_id", "doc_tokens").sum("length").where("`sum(length)` % doc_tokens <> 0").count() == 0
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_on_an_empty_table(spark, rows):
    none = spark.createDataFrame([], COLUMNS)
    for name, stage in p.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


def test_near_copies_and_learnt_languages_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = docs.limit(5).selectExpr("doc_id + 500000 as doc_id", "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'абвгдежзийклмнопрстуфхцчшщ') as text", "cast(null as string) as lang", "source", "n_chars")
    kept = {r.doc_id for r in p.language_id(spark, docs.unionByName(strange), SF).select("doc_id").collect()}
    assert not any(i >= 500000 for i in kept) and len(kept) >= 0.98 * docs.where(r"text rlike '\\p{L}'").count()
