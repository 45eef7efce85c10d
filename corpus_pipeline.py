"""A corpus pipeline: language ID, near duplicates, exact repeats, benchmark decontamination, packing.

run() applies the stages to ``documents``; each stage's result is written as Parquet and read again as the next one's documents.
The first four return the columns of documents, extra ones included; an empty table gives an empty one. Their decisions:

* language_id drops documents without a letter and those in none of the learnt languages: by how far their calibrated confidence is above chance
  and how rare their n-grams are, against limits that nearly all held-back training rows keep (see language.limits);
* near_duplicates keeps one row of each group of near duplicates (0.8 of the five-word shingles in common; four words are op4's contract), equal texts
  and rows without a doc_id included: the one with the smallest doc_id;
* repeats cuts every occurrence of a passage of more than 50 words that occurs elsewhere too out of the texts (n_chars is counted anew) and keeps all
  rows; op7's bound of 400 bytes is that query's contract and not used here;
* decontamination drops documents that the 13-word rule calls contaminated;
* packing returns the pieces of the remaining documents in sequences of 2,048 token ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.llm import decontaminate, language, minhash, packing, queries, repeats
from pitgrid.llm.workspace import cut, fresh, quoted


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs.select("doc_id", "text", "lang").where(f"not {queries.HELD_OUT}"))
    names = tuple(fresh(docs.columns, "language", "confidence", "sure"))
    return language.identify(docs, model, names=names).where(F.col(names[2])).select(same_columns(docs))


def same_columns(docs: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in docs.columns]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: equal texts count once, whatever their ids, and each distinct text has an id of its own among the near duplicates.

    Of equal texts the row with the smallest doc_id stays (null ids last, then the other columns in order). A text that has its doc_id
    alone keeps it; texts without an id, and all but one of those that share an id, are numbered from 2^62 on, so after the others.
    Texts without words are in no group; of them only repeated rows (same doc_id and text) become one.
    """
    t, u, null, own, row, last, first, n, number = fresh([*docs.columns, "doc_id"], "t", "u", "null", "own", "row", "last", "first", "n", "number")
    rest = [F.col(quoted(c)) for c in docs.columns if c != "doc_id"]
    wordless = F.coalesce(~F.col("text").rlike(r"[^ \t-\r]"), F.lit(True))
    keys = docs.withColumns(dict(zip((t, u), repeats.identity(), strict=True)) | {null: F.col("text").isNull(), own: F.when(wordless, F.col("doc_id"))})
    one = keys.groupBy(t, u, null, own).agg(F.min(F.struct(F.col("doc_id").isNull().alias(last), "doc_id", *rest)).alias(row))
    one = cut(one.select(t, u, f"{row}.*").drop(last), "one-of-equals")
    shared = one.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(n), F.min(F.struct(t, u)).alias(first)).where(F.col(n) > 1).select("doc_id", first)
    at = F.expr(f"if(doc_id is null or {first} <> struct({t}, {u}), {1 << 62} + (xxhash64({t}, {u}) & {(1 << 62) - 1}), cast(doc_id as long))")
    one = cut(one.join(cut(shared, "shared-ids"), "doc_id", "left").withColumn(number, at).select(number, *same_columns(docs)), "numbered")
    gone = minhash.near_duplicates(one.select(F.col(number).alias("doc_id"), "text"), size=5).where("not kept").select(F.col("doc_id").alias(number)).distinct()
    return one.join(gone, number, "left_anti").select(same_columns(docs))


def exact_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every occurrence of a repeated passage of over 50 whole words goes, however few its bytes; see repeats.without_passages."""
    out = repeats.without_passages(docs, over=50)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(same_columns(docs)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs.select("doc_id", "text"), queries.table(spark, sf_dir, "benchmark"))
    key, check, own = fresh(docs.columns, "key", "check", "own")
    gone = found.where("contaminated").select(F.col("doc_id").alias(key), F.col("check").alias(check)).distinct()
    rows = docs.withColumn(own, F.xxhash64("text"))
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(check)), "left_anti").select(same_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"), queries.vocabulary(), end=1).drop("bin_class")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("exact_repeats", exact_repeats), ("decontamination", decontamination), ("packing", pack)]

#: Learnt models and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
