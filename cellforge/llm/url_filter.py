"""URL filters: rules first, then the ratio of two character language models.

Two variable-order Markov models (orders 0 to 4, Witten-Bell smoothing: each order falls back to the
next lower one as far as its context was followed by new symbols) are counted over every URL that a
rule accepts or rejects, but for one in five, chosen by a hash of the URL. Those calibrate: a
logistic curve over the difference of the two log-likelihoods, divided by the length, is fitted on
`sample_rows` of them at most, and a URL that no rule fits is blocked where the curve passes one
half. URLs are folded to 64 symbols. Orders 0 to 2 are dense counters; of orders 3 and 4 each context
that occurs has counts of its own, so a model grows with the contexts in the table (64^5 counters at
most). The dense orders are held in memory by the driver and by each worker that scores; those above are
while they have MOST_CELLS counters at most. Beyond that they stay a table: each run of five symbols is
scored once, by joins, and a URL's runs are summed. Runs that are more than one in HOT of all, fewer than HOT
of them, are looked up by broadcast, so no key of the join is hot. Both ways give the same scores.

Results for odd input: a null URL, or one without `://`, has an empty host and path and no rule; a
null or empty URL has a difference of 0. Where the rules accept or reject nothing, there is nothing
to compare with, and what no rule fits is allowed. Repeated URLs count as often as they come.
Rows come back one for one; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
ORDER, DENSE = 4, 2  # orders up to DENSE have a counter for each context
HELD_CELLS = 1 << 21
SAMPLE_ROWS = 20_000
MOST_CELLS = 1 << 22  # counters above the dense orders that are held in memory, 64 MiB
HOT = 1 << 16
_SYMBOLS = np.full(256, 63, np.int64)  # 63: beyond ASCII; 62: other ASCII
_SYMBOLS[:128] = 62
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&#:%~+@,;!"):
    _SYMBOLS[[ord(_c), ord(_c.upper())]] = _i + 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, url: Column, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """pages with host, path, rule (the longest that fits) and ruled (its verdict)."""
    host, path = host_and_path(url)
    pages = pages.withColumns({"host": host, "path": path})
    rule = ruled = F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule, ruled = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return pages.withColumns({"rule": rule, "ruled": ruled})


def contexts(url: str | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The symbols of a URL and, for each order, the number of the context before each symbol."""
    s = _SYMBOLS[np.frombuffer((url or "").encode("utf-8", "surrogatepass"), np.uint8)]
    padded = np.concatenate([np.zeros(ORDER, np.int64), s])
    n, before = len(s), [np.zeros(len(s), np.int64)]
    key = np.zeros(n, np.int64)
    for k in range(1, ORDER + 1):
        key = key * 64 + padded[ORDER - k : ORDER - k + n]
        before.append(key)
    return s, before


def _sizes() -> list[int]:
    """Counters of the dense orders."""
    return [64 * 64**k for k in range(DENSE + 1)]


def cells(url: str | None) -> np.ndarray:
    """The dense counters that a URL adds one to: (order, context, symbol) as one number."""
    s, before = contexts(url)
    base = np.cumsum([0, *_sizes()])
    return np.concatenate([base[k] + before[k] * 64 + s for k in range(DENSE + 1)])


def _high(context: np.ndarray, k: int) -> np.ndarray:
    """One number for a context of order k, above DENSE, apart from those of other orders."""
    return context + sum(64**j for j in range(DENSE + 1, k))


def high_cells(url: str | None) -> np.ndarray:
    """The same for the orders above DENSE, numbered from 0."""
    s, before = contexts(url)
    return np.concatenate([_high(before[k], k) * 64 + s for k in range(DENSE + 1, ORDER + 1)])


@dataclass
class Markov:
    """counts[k]: contexts x symbols of a dense order. high: the counters above, sorted; times: their counts."""

    counts: list[np.ndarray]
    high: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, high: np.ndarray | None = None, times: np.ndarray | None = None) -> Markov:
        base = np.cumsum([0, *_sizes()])
        none = np.empty(0, np.int64)
        return cls([flat[base[k] : base[k + 1]].reshape(-1, 64).astype(np.float64) for k in range(DENSE + 1)], none if high is None else high, none if times is None else times)

    def __post_init__(self) -> None:
        self.totals = [c.sum(axis=1) for c in self.counts]
        self.kinds = [(c > 0).sum(axis=1) for c in self.counts]
        context = self.high // 64
        self.starts = np.flatnonzero(np.diff(context, prepend=-1))
        self.contexts = context[self.starts]
        self.high_kinds = np.diff(self.starts, append=len(context))
        self.high_totals = np.add.reduceat(self.times, self.starts) if len(context) else self.times

    def _seen(self, k: int, before: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(total, kinds, count of the symbol) in each context of order k."""
        if k <= DENSE:
            return self.totals[k][before], self.kinds[k][before], self.counts[k][before, s]
        if not len(self.contexts):
            return (np.zeros(len(s), np.int64),) * 3
        context = _high(before, k)
        cell = context * 64 + s
        at, of = (np.minimum(np.searchsorted(all_, x), len(all_) - 1) for all_, x in ((self.contexts, context), (self.high, cell)))
        known = self.contexts[at] == context
        return np.where(known, self.high_totals[at], 0), np.where(known, self.high_kinds[at], 0), np.where(self.high[of] == cell, self.times[of], 0)

    def log_likelihood(self, url: str | None) -> float:
        s, before = contexts(url)
        p = np.full(len(s), 1 / 64)
        for k in range(ORDER + 1):
            total, kinds, count = self._seen(k, before[k], s)
            known = total > 0
            p = np.where(known, (count + kinds * p) / np.where(known, total + kinds, 1), p)
        return float(np.log(p).sum())


@dataclass
class Filter:
    accepted: Markov | None
    rejected: Markov | None
    slope: float = 1.0
    bias: float = 0.0

    def difference(self, url: str | None) -> float:
        """Rejected less accepted log-likelihood for each byte."""
        if not url or self.accepted is None or self.rejected is None:
            return 0.0
        return (self.rejected.log_likelihood(url) - self.accepted.log_likelihood(url)) / len(url.encode("utf-8", "surrogatepass"))

    def chance_of_block(self, url: str | None) -> float:
        if self.accepted is None or self.rejected is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.difference(url) + self.bias, -500, 500))))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and bias by Newton's method with a little shrinkage; both classes weigh the same."""
    if not len(y) or y.min() == y.max():
        return 20.0, 0.0
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    a, t = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    shrink = np.diag([1e-2, 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ t, -30, 30)))
        hess = a.T @ (a * (weight * p * (1 - p))[:, None]) + shrink
        t = t - np.linalg.solve(hess, a.T @ (weight * (p - y)) + shrink @ t)
    return float(t[0]), float(t[1])


def counted(known: DataFrame) -> DataFrame:
    """(label, cell, n): how often each counter of each label is met in known (url, label); those of the high orders follow the dense ones."""
    dense = sum(_sizes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[list[np.ndarray]] = [[], []]
        held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for label in (0, 1):
                if not seen[label]:
                    continue
                where, n = np.unique(np.concatenate(seen[label]), return_counts=True)
                seen[label].clear()
                for at in range(0, len(where), 65536):
                    part = where[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), label, np.int32)), pa.array(part), pa.array(n[at : at + 65536])], names=["label", "cell", "n"])

        for batch in batches:
            for url, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label] += [cells(url), dense + high_cells(url)]
                held += len(seen[label][-1])
                if held > HELD_CELLS:
                    yield from counted()
                    held = 0
        yield from counted()

    return known.mapInArrow(run, "label int, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))


def models_of(counts: DataFrame) -> list[Markov | None]:
    """The models of both labels out of the given counters, which are held in memory."""
    dense = sum(_sizes())
    table = counts.toArrow()
    models: list[Markov | None] = [None, None]
    labels, where, n = (table.column(i).to_numpy() for i in range(3))
    for label in (0, 1):
        order = np.flatnonzero(labels == label)
        order = order[np.argsort(where[order])]
        cell, times = where[order], n[order]
        cut = int(np.searchsorted(cell, dense))
        flat = np.zeros(dense, np.int64)
        flat[cell[:cut]] = times[:cut]
        models[label] = Markov.of(flat, cell[cut:] - dense, times[cut:]) if flat.any() else None
    return models


def _apart(seed: int) -> Column:
    """URLs that calibrate and are not counted."""
    return F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(5)) == 0


def _known(ruled: DataFrame, url_col: str, *more: str) -> DataFrame:
    known = ruled.where(F.col("ruled").isNotNull() & F.col(url_col).isNotNull())
    return known.select(F.col(url_col).alias("url"), (F.col("ruled") == "block").cast("int").alias("label"), *more)


def _sample(known: DataFrame, sample_rows: int, seed: int) -> DataFrame:
    """The first few by hash of the URLs that calibrate, an equal share for each label."""
    parts = [known.where(_apart(seed) & (F.col("label") == label)).orderBy(F.xxhash64(F.lit(seed + 1), "url"), "url").limit(sample_rows // 2) for label in (0, 1)]
    return parts[0].union(parts[1])


def fit(ruled: DataFrame, url_col: str = "url", sample_rows: int = SAMPLE_ROWS, seed: int = 23, counts: DataFrame | None = None) -> Filter:
    """A filter that is held in memory, all its orders. ruled: with_rule's output; counts: its counters, if known."""
    known = _known(ruled, url_col)
    out = Filter(*models_of(counted(known.where(~_apart(seed))) if counts is None else counts))
    if out.accepted is None or out.rejected is None:
        return out
    sample = _sample(known, sample_rows, seed).collect()
    x, y = np.array([out.difference(r["url"]) for r in sample]), np.array([r["label"] for r in sample])
    out.slope, out.bias = fit_logistic(x, y)
    return out


def runs_of(rows: DataFrame) -> DataFrame:
    """(rid, run, times) of rows (rid, url): each context of the highest order with the symbol after it, as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                ids, runs, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for rid, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    s, before = contexts(url)
                    found, n = np.unique(before[ORDER] * 64 + s, return_counts=True)
                    ids.append(np.full(len(found), rid, np.int64))
                    runs.append(found)
                    times.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, runs, times)], names=["rid", "run", "times"])

    return rows.select("rid", "url").mapInArrow(run, "rid long, run long, times long")


def scored_runs(runs: DataFrame, counts: DataFrame, models: list[Markov]) -> DataFrame:
    """(run, n, diff): each run that occurs, how often, and its rejected less accepted log-probability."""
    dense = sum(_sizes())
    high = counts.where(F.col("cell") >= dense).withColumn("cell", F.col("cell") - dense)
    of = lambda label, value: F.sum(F.when(F.col("label") == label, value).otherwise(0))
    times = written(high.groupBy("cell").agg(of(0, F.col("n")).alias("n0"), of(1, F.col("n")).alias("n1")), "times")
    one = lambda c: (F.col(c) > 0).cast("long")
    about = times.groupBy(F.floor(F.col("cell") / 64).cast("long").alias("context")).agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.sum(one("n0")).alias("k0"), F.sum(one("n1")).alias("k1"))
    about = written(about, "contexts")
    out = runs.groupBy("run").agg(F.sum("times").alias("n"))
    facts = []
    for k in range(DENSE + 1, ORDER + 1):  # a context starts with the symbol just before, so a shorter one is its first digits
        first = sum(64**j for j in range(DENSE + 1, k))
        context = F.floor(F.col("run") / 64 ** (ORDER - k + 1)).cast("long") + first
        cell = context * 64 + F.pmod("run", F.lit(64))
        mine = [f"{c}_{k}" for c in ("t0", "t1", "k0", "k1", "n0", "n1")]
        out = out.withColumn("cell", cell).join(times.toDF("cell", *mine[4:]), "cell", "left").drop("cell")
        out = out.withColumn("context", context).join(about.toDF("context", *mine[:4]), "context", "left").drop("context")
        facts += mine
    shared = runs.sparkSession.sparkContext.broadcast(models)  # the dense orders only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = dict(zip(batch.schema.names, batch.columns, strict=True))
            runs = at["run"].to_numpy()
            s, context, logs = runs % 64, runs // 64, []
            for label, model in enumerate(shared.value):
                p = np.full(len(runs), 1 / 64)
                for k in range(ORDER + 1):
                    if k <= DENSE:
                        total, kinds, count = model._seen(k, context // 64 ** (ORDER - k), s)
                    else:
                        total, kinds, count = (at[f"{c}{label}_{k}"].to_numpy() for c in ("t", "k", "n"))
                    p = np.where(total > 0, (count + kinds * p) / np.where(total > 0, total + kinds, 1), p)
                logs.append(np.log(p))
            yield pa.RecordBatch.from_arrays([at["run"], at["n"], pa.array(logs[1] - logs[0])], names=["run", "n", "diff"])

    return out.select("run", "n", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in facts)).mapInArrow(run, "run long, n long, diff double")


def differences(rows: DataFrame, counts: DataFrame, models: list[Markov], hot: int = HOT) -> DataFrame:
    """(rid, difference) for each of rows (rid, url) whose URL is not empty: the counters above the dense orders stay a table."""
    runs = written(runs_of(rows), "runs")
    known = written(scored_runs(runs, counts, models), "scored")
    total = known.agg(F.sum("n")).first()[0] or 0
    often = known.where(F.col("n") > total / hot)  # fewer than `hot` rows
    met = runs.join(F.broadcast(often.select("run", "diff")), "run", "left")
    rest = met.where("diff is null").drop("diff").join(known.where(F.col("n") <= total / hot).select("run", "diff"), "run")
    met = met.where("diff is not null").select("rid", "times", "diff").union(rest.select("rid", "times", "diff"))
    return met.groupBy("rid").agg((F.sum(F.col("times") * F.col("diff")) / F.sum("times")).alias("difference"))  # a run for each byte


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, most_cells: int | None = None, seed: int = 23) -> DataFrame:
    """id, host, path, rule, verdict, score (the chance of a block by the models alone)."""
    most_cells = MOST_CELLS if most_cells is None else most_cells
    ruled = with_rule(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), F.col("url"), rules)
    counts = written(counted(_known(ruled, "url").where(~_apart(seed))), "counts")
    dense = F.col("cell") < sum(_sizes())
    out = None
    if counts.where(~dense).count() > most_cells:
        models = models_of(counts.where(dense))
        if None not in models:
            out = _judged_by_tables(ruled, counts, models, seed)
    if out is None:
        shared = pages.sparkSession.sparkContext.broadcast(fit(ruled, seed=seed, counts=counts))  # most_cells counters and the dense ones

        @F.pandas_udf("double")
        def chance(urls):
            import pandas as pd

            return pd.Series([shared.value.chance_of_block(u) for u in urls], dtype="float64")

        out = ruled.withColumn("score", chance("url"))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")


def _judged_by_tables(ruled: DataFrame, counts: DataFrame, models: list[Markov], seed: int) -> DataFrame:
    """ruled with score, the counters above the dense orders never held in one place."""
    rows = written(ruled.withColumn("rid", F.monotonically_increasing_id()), "rows")
    found = written(differences(rows.where("url is not null"), counts, models), "differences")
    sample = _sample(_known(rows, "url", "rid"), SAMPLE_ROWS, seed).select("rid", "label")
    tried = found.join(F.broadcast(sample), "rid", "right").select(F.coalesce("difference", F.lit(0.0)).alias("x"), "label").collect()  # SAMPLE_ROWS at most
    slope, bias = fit_logistic(np.array([r["x"] for r in tried]), np.array([r["label"] for r in tried]))
    line = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.coalesce("difference", F.lit(0.0)) * slope + bias))
    return rows.join(found, "rid", "left").withColumn("score", 1 / (1 + F.exp(-line)))
