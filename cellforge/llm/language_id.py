"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every row that may be learned from; the weights are fitted on
a bounded sample of them (`sample_rows`, an equal share for each language, chosen by a hash of the
id), with follow-the-regularised-leader steps and an elastic-net penalty, so most weights are zero.
A quarter of the sample is kept apart and sets the temperature of the softmax.

Results for odd input: a null text, or one without a letter, is `und` with score 0. Very long texts
are counted in windows, with the same counts as whole. Rows with a null language, a null id, or whose
id's crc32 leaves 2 teach nothing. With nothing to learn from, every text is `und` with score 0. The
sample bounds the languages too: the `MOST` that most rows have are learned. Columns other than the id and the text never reach a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, may_train, quoted, written
from .features import letter_gram_counts

BUCKETS = 1 << 15
SAMPLE_ROWS = 2048
MOST = 1024


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x buckets, sparse in content
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        where, x = tf_idf(letter_gram_counts(text, len(self.idf)), self.idf)
        p = softmax((self.weights[:, where] @ x + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where = np.flatnonzero(counts)
    x = (1 + np.log(counts[where])) * idf[where]
    norm = np.sqrt((x * x).sum())
    return where, x / norm if norm else x


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, buckets: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001, epochs: int = 3, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias. Each coordinate follows the regularised leader on its own scale."""
    z, n = np.zeros((classes, buckets + 1)), np.zeros((classes, buckets + 1))

    def leader(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            where, x = np.append(rows[i][0], buckets), np.append(rows[i][1], 1.0)
            zi, ni = z[:, where], n[:, where]
            w = leader(zi, ni)
            g = softmax(w @ x)
            g[labels[i]] -= 1
            g = np.outer(g, x)
            grown = ni + g * g
            z[:, where] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[:, where] = grown
    w = leader(z, n)
    return w[:, :-1], w[:, -1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Minimises the negative log-likelihood by golden-section search over log temperature."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    if not len(labels):
        return 1.0
    a, b, g = np.log(0.25), np.log(20.0), (np.sqrt(5) - 1) / 2  # a few hundred rows can't justify a sharper one
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 11) -> Model:
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).alias("lang"))
    rows = rows.where(may_train("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(buckets), np.zeros((0, buckets)), np.zeros(0), 1.0)
    share = {k: min(1.0, sample_rows / len(sizes) / n) for k, n in sizes.items()}
    shares = F.create_map(*(F.lit(x) for kv in share.items() for x in kv))
    chance = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.select("text", F.when(chance < shares[F.col("lang")], F.col("lang")).alias("picked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, names = np.zeros(buckets, np.int64), ["bucket", "n", "lang", "where", "counts"]
        n = 0
        for batch in batches:
            out: list[tuple[str, bytes, bytes]] = []
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                counts = letter_gram_counts(text.as_py(), buckets)
                where = np.flatnonzero(counts)
                seen[where] += 1
                n += 1
                if lang.is_valid:
                    out.append((lang.as_py(), where.astype(np.int32).tobytes(), counts[where].astype(np.int32).tobytes()))
            if out:
                k = len(out)
                langs, wheres, values = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(langs), pa.array(wheres, pa.binary()), pa.array(values, pa.binary())], names=names)
        where = np.append(np.flatnonzero(seen), buckets).astype(np.int32)  # the last row counts the documents
        k = len(where)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.append(seen[where[:-1]], n)), pa.nulls(k, pa.string()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=names)

    gathered = written(rows.mapInArrow(run, "bucket int, n long, lang string, where binary, counts binary"), "ngrams")
    frequency = np.zeros(buckets + 1)
    for r in gathered.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # buckets + 1 rows at most
        frequency[r["bucket"]] = r["n"]
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    sample = gathered.where("lang is not null").select("lang", "where", "counts").orderBy(F.xxhash64("lang", "where", "counts")).collect()  # about sample_rows rows
    x, y = [], np.array([languages.index(r["lang"]) for r in sample], int)
    for r in sample:
        counts = np.zeros(buckets)
        counts[np.frombuffer(r["where"], np.int32)] = np.frombuffer(r["counts"], np.int32)
        x.append(tf_idf(counts, idf))
    learn = [i for i in range(len(x)) if i % 4] or list(range(len(x)))
    apart = [i for i in range(len(x)) if i % 4 == 0]
    w, b = fit_ftrl([x[i] for i in learn], y[learn], len(languages), buckets)
    logits = np.array([w[:, x[i][0]] @ x[i][1] + b for i in apart]).reshape(len(apart), len(languages))
    return Model(languages, idf, w, b, fit_temperature(logits, y[apart]))


def predictions(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns lang and score; columns that have these names already are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets numbers, MOST x BUCKETS at most

    @F.pandas_udf("lang string, score double")
    def predict(texts):
        import pandas as pd

        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    found = fresh(docs, "found")
    docs = docs.withColumn(found, predict(F.col(quoted(text_col))))
    return docs.withColumns({lang: F.col(found)["lang"], score: F.col(found)["score"]}).drop(found)


def known_language(docs: DataFrame) -> DataFrame:
    """docs without those whose language is `und`; how likely the best language is does not matter. So rows
    whose text is null or without a letter go, and all go where there is nothing to learn from."""
    lang, score = fresh(docs, "_lang"), fresh(docs, "_score")
    found = predictions(docs, fit(docs), lang=lang, score=score).where(F.col(lang) != "und")
    return found.select(*map(quoted, docs.columns))
