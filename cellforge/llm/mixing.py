"""Mixing sources to target weights, DataFrame functions only.

1. Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, ...; together they share all
   words, none above 3 times its own; the excess is shared again by weight (water filling).
2. Packing: each source's documents, one after the other, are one stream of words, cut into blocks
   of `block_words`. Prefix sums run in two levels (documents in a hash bucket, then buckets), so a
   source with a third of all rows is never one task.
3. Draws: each output shard of `shard_blocks` slots draws its source counts from a multinomial
   whose weights are the targets in blocks. A running total stops each source at its target; what
   the draws left over fills the last, balancing shards. So totals meet the targets.
4. Slots to blocks: slot j of a source goes to block P(j mod blocks), P a pseudorandom permutation
   (swap-or-not network) seeded by source and round j div blocks. A block is so used the same
   number of times as any other of its source, give or take one; at most 3 times.
5. Blocks join by (source, index); a document takes the words that its blocks bring.

Everything follows from hashes of ids and texts: reruns agree. Results for odd input: a null or
blank text has 0 words and takes 0. A null source is a source of its own. Null ids are allowed;
rows that repeat each count; rows are told apart by 256 bits of id, text and source. An empty table gives an empty result. No words at all: targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, packed, quoted, unpacked, written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 128
SHARD_BLOCKS = 1024
BUCKET_ROWS = 1024
SUPER = 1024
ROUNDS = 24


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(id_: Column, text: Column, source: Column) -> Column:
    """256 bits that tell rows apart that differ in id, text or source, nulls and all."""
    marked = [F.when(c.isNull(), "n").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in (id_, text, source)]
    return F.unhex(F.sha2(F.concat_ws(",", *marked), 256))


def with_base(sums: DataFrame, by: str, at: str, amount: str, base: str) -> DataFrame:
    """sums (by, at, amount), stored, with the sum of the amounts before each row: inside stretches of SUPER
    places, and over the stretches, so that no task holds all places of one `by`."""
    cut = sums.withColumn("stretch", F.floor(F.col(at) / SUPER))
    inside = F.sum(amount).over(W.partitionBy(by, "stretch").orderBy(at)) - F.col(amount)
    whole = cut.groupBy(by, "stretch").agg(F.sum(amount).alias("whole"))
    whole = whole.select(by, "stretch", (F.sum("whole").over(W.partitionBy(by).orderBy("stretch")) - F.col("whole")).alias("before"))
    out = cut.withColumn("inside", inside).join(whole, [by, "stretch"]).withColumn(base, F.col("inside") + F.col("before"))
    return out.drop("stretch", "inside", "before")


def source_targets(sized: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source, rank, source_size, target, blocks and slots (how many blocks the mix takes) of rows (source, size)."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * MOST).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = W.orderBy("ratio", "rank")
    capped = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy(F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - capped) / rest)
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * level, F.col("cap").cast("double"))))
    blocks = F.ceil(F.col("source_size") / block_words)
    slots = F.coalesce(F.round(F.col("target") * blocks / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0.0)).cast("long")
    return s.select("source", F.col("rank").cast("long").alias("rank"), "source_size", "target", blocks.alias("blocks"), F.least(slots, MOST * blocks).alias("slots"))


def permuted(x: Column, n: Column, seed: Column) -> Column:
    """Swap-or-not: a permutation of 0..n-1 for each seed, computed for one index."""

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r), n) - at + n, n)
        bit = F.xxhash64(seed, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(bit, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, swap)


def block_slots(sources: DataFrame, seed: int, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """rank, block, shard, place: the block of each slot of each output shard. The balancing shards come last."""
    spark = sources.sparkSession
    drawn = sources.where("slots > 0").withColumn("high", F.sum("slots").over(W.orderBy("rank"))).withColumn("low", F.col("high") - F.col("slots"))
    total, n = drawn.agg(F.max("high"), F.count(F.lit(1))).first()
    total = total or 0
    width = max(1, -(-total // max(1, n)))
    cells = drawn.select("rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"))
    tasks = max(1, -(-total // 65536))
    draws = spark.range(0, total, 1, tasks).select(
        F.floor(F.col("id") / shard_blocks).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(total, 1))).alias("v")
    )
    draws = draws.withColumn("cell", F.floor(F.col("v") / width)).join(cells, "cell").where("v >= low and v < high")
    counts = written(draws.groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("n")), "draws")
    left = counts.groupBy("rank").agg(F.sum("n").alias("end"))
    counts = with_base(counts, "rank", "shard", "n", "lo")
    facts = sources.where("slots > 0").select("rank", "blocks", "slots")
    taken = counts.join(facts, "rank").select("rank", "blocks", "shard", "lo", F.least(F.col("lo") + F.col("n"), "slots").alias("hi"))
    rest = facts.join(left, "rank", "left").select("rank", "blocks", F.coalesce("end", F.lit(0)).alias("from"), "slots").where("from < slots")
    step = F.explode(F.sequence(F.col("from"), F.col("slots") - 1, F.lit(shard_blocks).cast("long")))
    rest = rest.select("rank", "blocks", "slots", step.alias("lo"))
    rest = rest.select("rank", "blocks", (-(-total // shard_blocks) + F.floor(F.col("lo") / shard_blocks)).alias("shard"), "lo", F.least(F.col("lo") + shard_blocks, "slots").alias("hi"))
    spans = taken.where("lo < hi").unionByName(rest).repartition(tasks, "rank", "shard", "lo")
    slots = spans.select("rank", "blocks", "shard", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("place"))
    seeds = F.xxhash64(F.lit(seed), F.col("rank"), F.floor(F.col("place") / F.col("blocks")))
    block = permuted(F.col("place") % F.col("blocks"), F.col("blocks"), seeds)
    return slots.select("rank", block.alias("block"), "shard", "place")


def block_uses(sources: DataFrame, seed: int, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """rank, block, uses: how often the mix takes each block."""
    return block_slots(sources, seed, shard_blocks).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("uses"))


def packing(docs: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, placed, pieces). placed: one row for each document, with its place in its source's stream.
    pieces: one row for each document and block: rank, start, id, key, size, block, words."""
    cols = [F.col(quoted(c)) for c in (id_col, text_col, source_col)]
    base = docs.select(cols[0].alias("id"), cols[2].alias("source"), word_count(cols[1]).alias("size"), row_key(*cols).alias("key"))
    base = written(base, "sizes")
    sources = written(source_targets(base, block_words), "sources")
    buckets = max(1, -(-base.count() // BUCKET_ROWS))
    doc = base.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    doc = doc.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.id", "d.key", "d.size", "d.bucket", "s.rank", "s.source_size", "s.target")
    sums = with_base(written(doc.groupBy("rank", "bucket").agg(F.sum("size").alias("all")), "sums"), "rank", "bucket", "all", "base").drop("all")
    run = W.partitionBy("rank", "bucket").orderBy("id", "key", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = doc.withColumn("local", F.sum("size").over(run) - F.col("size")).join(sums, ["rank", "bucket"])
    placed = placed.select("id", "key", "size", "rank", "source_size", "target", (F.col("local") + F.col("base")).alias("start"))
    some = placed.where("size > 0").withColumn("end", F.col("start") + F.col("size"))
    pieces = some.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))))
    words = F.least("end", (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)
    return sources, placed, pieces.withColumn("words", words)


def mix_plan(docs: DataFrame, seed: int = 5, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(pieces with uses, placed)."""
    sources, placed, pieces = packing(docs, block_words, id_col, text_col, source_col)
    pieces = pieces.join(block_uses(sources, seed), ["rank", "block"], "left")
    return pieces.withColumn("uses", F.coalesce("uses", F.lit(0)).cast("long")), placed


def mixed_shards(docs: DataFrame, seed: int = 5, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The output shards: for each slot the pieces of documents in its block: shard, rank (of the source),
    place (of the slot among its source's), id, at (the piece's first word in the text, from 0), words."""
    sources, _, pieces = packing(docs, block_words, id_col, text_col, source_col)
    at = F.greatest("start", F.col("block") * block_words) - F.col("start")
    return pieces.join(block_slots(sources, seed), ["rank", "block"]).select("shard", "rank", "place", F.col("id").alias(id_col), at.alias("at"), "words")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: id, size, source_size, target (its source's), taken."""
    id_col = options.get("id_col", "doc_id")
    pieces, placed = mix_plan(docs, **options)
    facts = ["id", "key", "size", "rank", "source_size", "target", "start"]
    some = pieces.groupBy(*facts).agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    none = placed.where("size = 0").select(*facts, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).select(F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def mixed_documents(docs: DataFrame, seed: int = 5, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mix itself, with the columns of docs: a document comes once for each round in which it is
    taken, with the words of the blocks that the round takes (all of them: the text unchanged)."""
    pieces, _ = mix_plan(docs, seed, block_words, id_col, text_col, source_col)
    part = F.struct("block", (F.greatest("start", F.col("block") * block_words) - F.col("start")).cast("int").alias("at"), F.col("words").cast("int").alias("n"), "uses")
    uses = pieces.groupBy("id", "key", "start", "size").agg(F.sort_array(F.collect_list(part)).alias("_parts"), F.max("uses").cast("int").alias("_most"))
    # Rows that repeat have equal keys: pair the n-th with the n-th.
    uses = uses.where("_most > 0").groupBy("id", "key").agg(F.collect_list(F.struct("_parts", "_most")).alias("_plans"))
    keyed = packed(docs, key=row_key(*(F.col(quoted(c)) for c in (id_col, text_col, source_col))))
    repeats = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("same")).where("same > 1")
    single = keyed.join(repeats, "key", "left_anti")
    several = keyed.join(repeats, "key", "left_semi").dropDuplicates(["key"])  # equal in id, text and source
    rows = single.unionByName(several).join(uses.drop("id"), "key")
    rows = rows.withColumn("plan", F.explode("_plans")).withColumn("round", F.explode(F.sequence(F.lit(1), F.col("plan._most"))))
    chosen = F.filter("plan._parts", lambda p: p["uses"] >= F.col("round"))
    whole = F.size(chosen) == F.size("plan._parts")
    body = F.col("row")[text_col]
    words = F.regexp_extract_all(body, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    cut = F.array_join(F.flatten(F.transform("chosen", lambda p: F.slice(F.col("words"), p["at"] + 1, p["n"]))), "")
    rows = rows.withColumn("chosen", chosen).withColumn("words", F.when(~whole, words))
    text = F.when(F.size("chosen") == F.size("plan._parts"), body).otherwise(cut)
    rows = rows.withColumn("made", text)
    return unpacked(rows, docs.columns, **{text_col: F.col("made"), chars_col: F.length("made").cast("long")})
