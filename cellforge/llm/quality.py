"""Quality classifier: supervised subword embeddings.

Words, pairs of words and character n-grams hash into learned vectors; a document is the average of
all its vectors, a softmax layer on top, both trained by plain numpy stochastic gradient descent on
a bounded sample of labelled rows (`sample_rows`, chosen by a hash of the id). After training the
layer is folded into the vectors: averaging and the layer are linear, so each bucket keeps one
number and a whole text costs one look-up a feature.

Results for odd input: a null text is the empty text; it has no features and gets the score of the
bias alone. Rows with a null label, a null id or whose id's crc32 leaves 2 teach nothing, nor does
an id with two different labels. Without labels every score is 0.5. Very long texts are read in
windows that end at a blank, with the same features as whole. Columns other than the text never reach a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import may_train, quoted
from .features import subword_features

BUCKETS = 1 << 16
SAMPLE_ROWS = 4000


@dataclass
class Model:
    bucket: np.ndarray  # log-odds that each bucket adds
    bias: float

    def score(self, text: str | None) -> float:
        found = subword_features(text or "", len(self.bucket))
        z = self.bias + (float(self.bucket[found].mean(dtype=np.float64)) if len(found) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, width: int = 8, epochs: int = 6, rate: float = 2.0, seed: int = 3) -> Model:
    """rows: for each document its distinct buckets and their share of all its features."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    layer, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            now = rate * (1 - done / steps)
            done += 1
            where, share = rows[i]
            h = share @ vectors[where]
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= now * np.outer(h, p)
            bias -= 0.05 * now * p
            # The vectors' step is scaled up: a share is one part in thousands.
            vectors[where] -= now * np.sqrt(share)[:, None] * back
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 17) -> Model:
    known = labels.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(label_col)).alias("label"))
    known = known.where(may_train("_id") & F.col("label").isin(0, 1)).groupBy("_id")
    known = known.agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    total = known.count()
    if not total:
        return Model(np.zeros(buckets, np.float32), 0.0)
    chosen = known.where(F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 30)) < int(min(1.0, sample_rows / total) * (1 << 30)))
    rows = docs.select(F.col(quoted(id_col)).alias("_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id").select("text", "label")  # about sample_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wheres, shares = [], []
            for text in batch.column(0):
                where, n = np.unique(subword_features(text.as_py(), buckets), return_counts=True)
                wheres.append(where.astype(np.int32).tobytes())
                shares.append((n / max(1, n.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(wheres, pa.binary()), pa.array(shares, pa.binary())], names=["label", "where", "share"])

    sample = rows.mapInArrow(run, "label int, where binary, share binary").orderBy(F.xxhash64("label", "where", "share")).collect()
    if not sample:
        return Model(np.zeros(buckets, np.float32), 0.0)
    return train([(np.frombuffer(r["where"], np.int32), np.frombuffer(r["share"], np.float32)) for r in sample], np.array([r["label"] for r in sample]), buckets)


def scores(docs: DataFrame, model: Model, text_col: str = "text", score: str = "score") -> DataFrame:
    """docs with the column score; a column that has this name already is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn(score, run(F.col(quoted(text_col))))
