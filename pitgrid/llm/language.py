"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample, then calibrated by a temperature.
Document frequencies are counted over all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.workspace import ddl, gathered, quoted, small_batches

BITS = 15
SIZE = 1 << BITS
ORDERS = 3
_LETTER = regex.compile(r"\p{L}")
_FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


class Model(NamedTuple):
    """least: what a text's confidence above chance must be, most: what the mean weight of its n-grams may be, for its language to be one of the learnt."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    least: float
    most: float


#: A language is not told where the confidence above chance is under what all but this share of held-back rows have, or this at most.
LEFT_OUT, LEAST_MARGIN = 0.001, 0.2


def above_chance(p: np.ndarray) -> np.ndarray:
    """0 where all languages are equally likely, 1 where one is certain, whatever their number."""
    n = p.shape[-1]
    return (p.max(-1) - 1 / n) / (1 - 1 / n) if n > 1 else np.ones(p.shape[:-1])


def rarity(which: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> float:
    """Mean inverse document frequency of a text's n-grams: high where the training texts have few of them."""
    return float(idf[which] @ counts / max(1, counts.sum()))


def limits(chances: np.ndarray, rarities: np.ndarray) -> tuple[float, float]:
    """From held-back rows of learnt languages: the least confidence above chance, and the most rarity (half as far again from the median as nearly all)."""
    if not len(rarities):
        return LEAST_MARGIN, np.inf
    middle = float(np.median(rarities))
    return min(LEAST_MARGIN, float(np.quantile(above_chance(chances), LEFT_OUT))), middle + 1.5 * max(0.5, float(np.quantile(rarities, 1 - LEFT_OUT)) - middle)


def counts_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, the hashed character n-grams of one to three letters that it has, and their counts."""
    texts = [t.lower() for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    grams, run = [], np.zeros(len(points), np.uint32)
    for order in range(ORDERS):
        run = run[: len(points) - order] * _FACTORS[0] + (points[order:] + np.uint32(1)) * _FACTORS[1] + np.uint32(order)
        mixed = run ^ (run >> np.uint32(15))
        grams.append((mixed * _FACTORS[2]) >> np.uint32(32 - BITS))
    at = 0
    for text in texts:
        n = len(text)
        own = np.concatenate([g[at : at + max(0, n - order)] for order, g in enumerate(grams)])
        full = np.bincount(own, minlength=SIZE)
        which = np.flatnonzero(full)
        yield which, full[which]
        at += n


def vector(which: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[which]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int) -> np.ndarray:
    """Follow-the-regularised-leader with a learning rate for each coordinate; rows: (class, features, values)."""
    z, n = np.zeros((n_classes, SIZE)), np.zeros((n_classes, SIZE))
    order = np.random.default_rng(seed)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0)

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            label, which, x = rows[i]
            zi, ni = z[:, which], n[:, which]
            w = weights(zi, ni)
            p = softmax(w @ x)
            p[label] -= 1
            g = p[:, None] * x
            more = ni + g * g
            z[:, which] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[:, which] = more
    return weights(z, n)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search of its logarithm."""
    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean())

    low, high, ratio = np.log(0.05), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(SIZE, np.int64), 0
    for batch in gathered(batches):
        for which, _ in counts_of(batch.column("text").to_pylist()):
            total[which] += 1
            n += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"feature": np.append(some, -1).astype(np.int32), "n": np.append(total[some], n)})


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches):
        pairs = list(counts_of(batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_pydict({"at": batch.column("at"), "lang": batch.column("lang"), "which": [w.astype("<u4").tobytes() for w, _ in pairs], "counts": [c.astype("<u4").tobytes() for _, c in pairs]}, schema=pa.schema([("at", pa.int64()), ("lang", pa.string()), ("which", pa.binary()), ("counts", pa.binary())]))


def fit(labelled: DataFrame, per_language: int = 1000, alpha: float = 1.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, epochs: int = 3, seed: int = 7) -> Model | None:
    """Learns from labelled(doc_id, text, lang); rows with a null or empty text or a null lang are left out. None: nothing to learn from.

    Document frequencies come from all rows, and every language that a row has is learnt. The weights come from the ``per_language`` rows of each
    language whose hashes are least, whatever the partitions; a quarter of them is kept for the temperature and the limits.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("text is not null and text <> '' and lang is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    table = rows.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    n_docs = next(r.n for r in table if r.feature < 0)
    idf = np.full(SIZE, np.log(1 + n_docs) + 1)
    for r in table:
        if r.feature >= 0:
            idf[r.feature] = np.log((1 + n_docs) / (1 + r.n)) + 1
    steps = 1 << 40
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, 1.2 * per_language / n + 40 / n) * steps))])
    picked = rows.withColumn("at", F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps))).where(F.col("at") < shares[F.col("lang")])
    found: dict[str, list] = {lang: [] for lang in languages}
    for r in picked.select("at", "text", "lang").mapInArrow(_features, "at long, lang string, which binary, counts binary").toLocalIterator():
        found[r.lang].append((r.at, r.which, r.counts))
    learn, hold, rare = [], [], []
    for k, lang in enumerate(languages):
        for i, (_, which, counts) in enumerate(sorted(found[lang])[:per_language]):
            which, counts = np.frombuffer(which, "<u4").astype(np.int32), np.frombuffer(counts, "<u4")
            (hold if i % 4 == 3 else learn).append((k, which, vector(which, counts, idf).astype(np.float32)))
            if i % 4 == 3:
                rare.append(rarity(which, counts, idf))
    weights = train(learn, len(languages), alpha, beta, l1, l2, epochs, seed) if learn else np.zeros((len(languages), SIZE))
    hold = hold or learn
    logits = np.array([weights[:, w] @ x for _, w, x in hold]).reshape(-1, len(languages))
    heat = temperature_of(logits, np.array([k for k, _, _ in hold])) if hold and len(languages) > 1 else 1.0
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), heat, *limits(softmax(logits / heat), np.array(rare)))


def _predict(batches: Iterator[pa.RecordBatch], shared, text: str, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    model: Model | None = shared.value
    for batch in gathered(batches, text):
        texts = [t if t and _LETTER.search(t) else None for t in batch.column(text).to_pylist()]
        found: list[tuple[str, float, bool]] = [("und", 0.0, False)] * len(texts)
        if model:
            rows = [i for i, t in enumerate(texts) if t is not None]
            for i, (which, counts) in zip(rows, counts_of([texts[i] for i in rows]), strict=True):
                p = softmax(model.weights[:, which] @ vector(which, counts, model.idf) / model.temperature)
                best = int(p.argmax())
                sure = above_chance(p) >= model.least and rarity(which, counts, model.idf) <= model.most
                found[i] = model.languages[best], min(1.0, float(p[best])), bool(sure)
        for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_())):
            batch = batch.append_column(names[k], pa.array([x[k] for x in found], kind))
        yield batch


def identify(documents: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "sure")) -> DataFrame:
    """documents with three more columns: the language (``und`` if the text is null or has no letter, or there is no model), the confidence, and
    whether the text is in a learnt language at all, by the model's limits.

    Only the text is an input; columns that have the new names already are replaced. Rows are neither moved nor dropped.
    """
    spark = documents.sparkSession
    small_batches(spark)
    plain = documents.drop(*names)
    shared = spark.sparkContext.broadcast(model)
    schema = ddl(plain) + f", {quoted(names[0])} string, {quoted(names[1])} double, {quoted(names[2])} boolean"
    return plain.mapInArrow(lambda batches: _predict(batches, shared, text, names), schema)
