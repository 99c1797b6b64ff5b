"""Exact dedup: tree-merge of sorted digest runs, DataFrame functions only.

Every input partition belongs to one of RUNS runs. A run is cut into ranges of the digest, and holds
for each range one sorted array of entries (digest, length, second hash, identifier that stays, number
of rows), one entry for each digest. Rounds are binomial: in round k the runs whose numbers differ in
bit k alone exchange, range by range, and two sorted arrays merge into one (the sort behind
`sort_array` merges presorted stretches), in which neighbours of one key become one entry that keeps
the larger identifier and the sum of the rows. After log2(RUNS) rounds one run is left, spread over
its ranges. Digests are uniform, so a range holds about RANGE_ROWS entries, however many there are.

Entries are equal only if SHA-256, length in bytes and a second, unrelated hash all agree; the merge
checks the three at every level. Rows are counted before the first exchange, so a group that holds a
third of all rows leaves one entry a run. Going back to the rows, groups of more than a
HOT_SHARE-th of all rows (so HOT_SHARE of them at most) are looked up by broadcast, the others by a
join, so no key brings one task more than that share.

Results for odd input: a null text is the empty text. Only A-Z are lower-cased. Rows that repeat
one doc_id with one text are the same document and share its fate (`kept` is doc_id = keep_id). A
null doc_id loses against any other; in a group of null ids only, keep_id is null and all are
kept. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, packed, quoted, unpacked, written

RUNS = 16  # a power of two
RANGE_ROWS = 4096
HOT_SHARE = 1024
KEY = ("digest", "bytes", "check")


def digest_columns(text: Column) -> dict[str, Column]:
    norm = ascii_lower(F.coalesce(text, F.lit("")))
    return {"digest": F.unhex(F.sha2(norm, 256)), "bytes": F.octet_length(norm), "check": F.xxhash64(norm)}


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, bytes, check) of every row; every text is read once."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return rows.select("id", *(c.alias(k) for k, c in digest_columns(F.col("text")).items()))


def _range_of(digest: Column, ranges: int) -> Column:
    """The range of a digest, by its first 32 bits."""
    first = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")
    return F.floor(first * ranges / F.lit(1 << 32)).cast("long")


def _merged(entries: Column, best: str) -> Column:
    """Sorted entries, of one key two at most, to one entry for each key."""

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["digest"] == b["digest"]) & (a["bytes"] == b["bytes"]) & (a["check"] == b["check"]), F.lit(False))

    pick = {"max": F.greatest, "min": F.least}[best]  # both leave out nulls
    at = lambda i: F.get(entries, i)

    def one(x: Column, i: Column) -> Column:
        twin, other = same(x, at(i + 1)), at(i + 1)
        both = F.struct(*(x[k].alias(k) for k in KEY), pick(x["id"], other["id"]).alias("id"), (x["n"] + other["n"]).alias("n"))
        return F.when(same(at(i - 1), x) & (i > 0), F.lit(None)).when(twin, both).otherwise(x)

    return F.filter(F.transform(entries, one), lambda x: x.isNotNull())


def merged_runs(digests: DataFrame, total: int, runs: int = RUNS, keep: str = "max") -> DataFrame:
    """(digest, bytes, check, keep_id, group_size), a row for each key, of rows (id, digest, bytes, check)."""
    ranges = max(1, -(-total // RANGE_ROWS))
    best = {"max": F.max, "min": F.min}[keep]
    counted = (
        digests.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs)).cast("int"))
        .groupBy("run", *KEY)
        .agg(best("id").alias("id"), F.count(F.lit(1)).alias("n"))
        .withColumn("range", _range_of(F.col("digest"), ranges))
    )
    level = counted.groupBy("range", "run").agg(F.sort_array(F.collect_list(F.struct(*KEY, "id", "n"))).alias("entries"))
    while runs > 1:
        runs //= 2
        # Runs r and r + runs differ in one bit; they meet at the smaller number.
        pairs = level.groupBy("range", F.pmod("run", F.lit(runs)).cast("int").alias("run")).agg(F.collect_list("entries").alias("two"))
        pairs = pairs.select("range", "run", F.sort_array(F.flatten("two")).alias("sorted"))
        level = pairs.select("range", "run", _merged(F.col("sorted"), keep).alias("entries"))
    left = level.select(F.explode("entries").alias("e"))
    return left.select(*(F.col("e")[k].alias(k) for k in KEY), F.col("e")["id"].alias("keep_id"), F.col("e")["n"].alias("group_size"))


def _grouped(digests: DataFrame, keep: str) -> DataFrame:
    """digests, which are stored, with keep_id and group_size of each row."""
    total = digests.count()
    repeated = written(merged_runs(digests, total, keep=keep).where("group_size > 1"), "repeated")
    hot = F.broadcast(repeated.where(F.col("group_size") > max(HOT_SHARE, total // HOT_SHARE)))  # HOT_SHARE rows at most
    cold = repeated.where(F.col("group_size") <= max(HOT_SHARE, total // HOT_SHARE))
    some = digests.join(hot, list(KEY))
    rest = digests.join(hot, list(KEY), "left_anti").join(cold, list(KEY), "left")
    alone = F.col("group_size").isNull()
    rest = rest.select(*KEY, "id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(alone, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"))
    return some.select(*KEY, "id", "keep_id", "group_size").union(rest)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256."""
    out = _grouped(written(digested(docs, id_col, text_col), "digests"), keep)
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs without the rows that exact_groups drops; its columns are unchanged."""
    out = _grouped(written(digested(docs, id_col, text_col), "digests"), keep)
    lost = out.where(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", *KEY).distinct()
    lost = lost.select(*(F.col(c).alias(f"lost_{c}") for c in lost.columns))
    rows = packed(docs, id=F.col(quoted(id_col)), **digest_columns(F.col(quoted(text_col))))
    on = [F.col("id").eqNullSafe(F.col("lost_id")), *(F.col(c) == F.col(f"lost_{c}") for c in KEY)]
    return unpacked(rows.join(lost, on, "left_anti"), docs.columns)


ORACLE = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
