"""MinHash near-dedup with min-max hashing.

Each permutation gives two values of a signature, the smallest and the largest hash of a shingle
set; 80 permutations make 160 values, 40 bands of 4. Texts with equal sets are one class (they
share a 128-bit fingerprint), and only one document of a class goes on. Classes that share a band
are candidates; every link is confirmed on the full sets. At the threshold, a pair misses all
bands with probability (1 - 0.75^4)^40, about 2e-7.

Each set also has an odd sketch: 1024 parities of its members' hashes. Two sketches never differ in
more bits than their sets in members, so a pair whose sketches differ too much for the threshold is
no link, for certain; only pairs that pass are sent to the full sets.

A bucket is never expanded into all pairs. First each document is held against the smallest id
among its buckets' members, then against the smallest of each bucket, and components are formed.
Only buckets whose members still lie in different components go on: a growing random choice of
members is held against the members of other components, until each bucket is one component or
every pair across components has been held. So no link between components is lost, while a large
group of copies costs a few comparisons a member. A bucket's members are dealt into tiles of TILE, and
the chosen into as many blocks: a task holds one block against one tile, however large the bucket.

Results for odd input: a null text, or one without words, has an empty set and is linked with
nothing; fewer than five words are one shingle. Rows that repeat a doc_id are one document: their
texts' links are all its links. A null doc_id, or one that is no integer, is linked with nothing
(component_id null, kept).
An empty table gives an empty result. Extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, passing, quoted, unpacked, written
from .components import components
from .shingles import mix, shingle_set, word_hashes

BANDS, ROWS = 40, 4
PERMUTATIONS = BANDS * ROWS // 2
PERCENT = 75
FIRST, GROWTH = 16, 256
TILE = 1024
SKETCH = 1024
_rng = np.random.default_rng(0xB0B)
_A = (_rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)[:, None]
_FOLD = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_max(shingles: np.ndarray) -> np.ndarray:
    """The signature: smallest and largest value under each permutation, interleaved."""
    low = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        h = _A * x[None, at : at + 1024] + _B
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_keys(shingles: np.ndarray) -> np.ndarray:
    rows = min_max(shingles).astype(np.uint64).reshape(BANDS, ROWS)
    return mix((rows * _FOLD).sum(axis=1) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the members in each of SKETCH hash cells, as SKETCH / 64 integers."""
    cells = ((shingles >> np.uint64(20)) & np.uint64(SKETCH - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """id, n (set size), f1, f2 (fingerprint of the set), bands, sketch, for docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                n, f1, f2, bands, ends, sketches = [], [], [], [np.empty(0, np.uint64)], [0], [np.empty(0, np.int64)]
                for words in word_hashes(batch.column(1)):
                    s = shingle_set(words)
                    n.append(len(s))
                    f1.append(s.sum(dtype=np.uint64))
                    f2.append(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64))
                    if len(s):
                        bands.append(band_keys(s))
                    sketches.append(odd_sketch(s))
                    ends.append(ends[-1] + (BANDS if len(s) else 0))
                flat = pa.array(np.concatenate(bands).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f1, f2)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(sketches)), SKETCH // 64).cast(pa.list_(pa.int64()))],
                    names=["id", "n", "f1", "f2", "bands", "sketch"],
                )

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """id, set for docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sets = [shingle_set(w) for w in word_hashes(batch.column(1))]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "set"])

    return docs.mapInArrow(run, "id long, set array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    linked = 100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)
    return pairs.join(right, "b").join(left, "a").where(linked).select("a", "b")


def _may_link(n: str, sketch: str, other_n: str, other_sketch: str):
    """False only for pairs that cannot be similar enough: by their sizes, or by more differing
    members than (n + other_n) * (100 - PERCENT) / (100 + PERCENT)."""
    sizes = 100 * F.least(n, other_n) >= PERCENT * F.greatest(n, other_n)
    differ = sum((F.bit_count(F.col(sketch)[i].bitwiseXOR(F.col(other_sketch)[i])) for i in range(SKETCH // 64)), F.lit(0))
    return sizes & ((100 + PERCENT) * differ <= (100 - PERCENT) * (F.col(n) + F.col(other_n)))


def tiled(chosen: DataFrame, held: DataFrame, most: int, tile: int | None = None) -> tuple[DataFrame, DataFrame]:
    """chosen (key, size, i, ...) and held (key, size, id, ...) with block and tile, so that each pair of one
    key meets once, in a cell of about `tile` of each side. most: about how many of a key are chosen."""
    tile = tile or TILE
    blocks = F.ceil(F.least(F.col("size"), F.lit(most)) / tile).cast("long")
    tiles = F.ceil(F.col("size") / tile).cast("long")
    deal = lambda of, n, salt: F.pmod(F.xxhash64(F.lit(salt), of), n)
    left = chosen.withColumn("block", deal("i", blocks, 1)).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1))).drop("size")
    right = held.withColumn("tile", deal("id", tiles, 2)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("size")
    return left, right


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(quoted(id_col)).try_cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    sig = written(signatures(rows), "signatures")
    known = sig.where("n > 0 and id is not null")
    classes = known.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("most"))
    several = written(classes.where("rep < most").drop("most"), "classes")
    extra = known.join(several, ["f1", "f2", "n"], "left").where("rep is not null and id <> rep").select("id", "f1", "f2", "n")
    members = known.join(extra, ["id", "f1", "f2", "n"], "left_anti").select("id", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("most"), F.count(F.lit(1)).alias("size"))
    buckets = buckets.where("center < most").drop("most")
    cand = written(members.join(buckets, "key"), "candidates")
    nodes = cand.select("id").distinct()
    faces = written(known.join(nodes, "id", "left_semi").select("id", "n", "sketch").distinct(), "sketches")
    sets = written(shingle_sets(rows.join(nodes, "id", "left_semi")).distinct(), "sets")

    def near(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that their sketches allow to be links."""
        left, right = faces.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka")), faces.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
        return pairs.join(left, "a").join(right, "b").where(_may_link("na", "ka", "nb", "kb")).select("a", "b").distinct()

    star = cand.where("id > center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    star = written(near(star), "star")
    pairs = written(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    # A doc_id with several texts belongs to the classes of all of them.
    twice = known.groupBy("id").agg(F.min("f1").alias("x"), F.max("f1").alias("y")).where("x <> y").select("id")
    own = known.join(twice, "id", "left_semi").join(several, ["f1", "f2", "n"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = written(_confirmed(pairs, sets).union(own), "links")
    comp = components(links)
    tested = pairs

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs in different components that have not been held against each other."""
        left, right = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        far = pairs.join(left, "a", "left").join(right, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        return written(far.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")

    done, pairs = 0, apart(star)
    while True:
        if pairs.limit(1).count():
            new = written(_confirmed(pairs, sets), "links")
            tested = tested.union(pairs)
            if new.limit(1).count():
                links = links.union(new)
                comp = components(links)
        marked = cand.where("size > 2 and id <> center").join(comp, "id", "left").select("key", "size", "id", F.coalesce("comp", "id").alias("comp"), F.pmod(F.xxhash64("key", "id"), F.col("size")).alias("rank"))
        split = marked.groupBy("key", "size").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("rank").alias("top")).where(f"x <> y and top >= {done}").select("key", "size")
        # A bucket's members go back to it by tiles, so a large one is no single task.
        tiles = F.ceil(F.col("size") / TILE).cast("long")
        split = split.select("key", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("part"))
        open_ = written(marked.where(f"rank >= {done}").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), tiles)).join(split, ["key", "part"]).drop("part"), "open")
        if not open_.limit(1).count():
            break
        most = done * GROWTH or FIRST
        held = open_.join(faces, "id")
        chosen = held.where(f"rank < {most}").select("key", "size", F.col("n").alias("ni"), F.col("id").alias("i"), F.col("sketch").alias("ki"), F.col("comp").alias("ci"))
        left, right = tiled(chosen, held, most)
        met = left.join(right, ["key", "block", "tile"]).where((F.col("comp") != F.col("ci")) & _may_link("n", "sketch", "ni", "ki"))
        pairs = apart(met.select(F.least("i", "id").alias("a"), F.greatest("i", "id").alias("b")).distinct())
        done = most

    out = sig.join(several, ["f1", "f2", "n"], "left").withColumn("node", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")))
    out = out.join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("component_id", F.coalesce("comp", "node"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that near_groups does not keep; its columns are unchanged."""
    with passing() as kept:
        lost = kept(near_groups(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("lost")).distinct(), "lost")
    rows = packed(docs, id=F.col(quoted(id_col)).try_cast("long"))
    return unpacked(rows.join(lost, F.col("id") == F.col("lost"), "left_anti"), docs.columns)


#: Brute force: all pairs that share a shingle, and all that can be reached from each.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), p AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w WHERE len(words) >= 5
), f AS MATERIALIZED (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS shingle
    FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)
    UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4
  ) WHERE shingle IS NOT NULL
), s AS MATERIALIZED (
  SELECT d.doc_id, count(f.shingle) AS n FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
), shared AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM f a JOIN f b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, s.n AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.a = s.doc_id
"""
