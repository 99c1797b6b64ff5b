"""The training-data operators against brute force, and on odd input: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellforge.llm import ann, bpe, exact_dedup, language_id, licenses, mixing, near_dedup, quality, queries, sharding, url_filter
from cellforge.llm.features import letter_gram_counts, subword_features

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, shard string"
EN, DE = "the of and that with for this from when", "der die und das mit nicht ist von ein"


def make(rng, words, n):
    return " ".join(rng.choice(words.split()) + rng.choice(["", "s", "en", "ly"]) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [make(rng, EN if i % 2 else DE, rng.randint(1, 90)) for i in range(40)]
    texts = [*base, *base[:6], base[3].upper(), None, None, "", " \t\n", "1234 !!", "ÄÖ ä", "x " * 30000, base[0] + " tail", " ".join(base[2].split()[:-1]), "<|endoftext|> I'VE Σς"]
    out = [(i, t, "en" if i % 2 else "de", ["b", "a", None, "ü"][i % 4], len(t or ""), "k", "s", "x") for i, t in enumerate(texts)]
    return [*out, out[1], out[1], (None, base[1], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return (t or "").translate(LOWER)


def test_exact_dedup(docs, rows, empty):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = collections.Counter()
    for r in rows:
        ids = groups[norm(r[1])]
        keep = max((i for i in ids if i is not None), default=None)
        want[r[0], keep, len(ids), r[0] == keep, hashlib.sha256(norm(r[1]).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, exact_dedup.exact_groups(docs).collect())) == want
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and {norm(r["text"]) for r in left.collect()} == set(groups)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_merges_sorted_runs(spark, docs):
    digests = exact_dedup.digested(docs, "doc_id", "text").repartition(9)
    for keep, best in (("max", max), ("min", min)):
        groups = collections.defaultdict(list)
        for r in digests.collect():
            groups[bytes(r["digest"])].append(r["id"])
        df = exact_dedup.merged_runs(digests, digests.count(), runs=8, keep=keep)
        want = {d: (best((i for i in ids if i is not None), default=None), len(ids)) for d, ids in groups.items()}
        assert {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in df.collect()} == want and df.count() == len(want)
    # Three rounds of eight runs: each gathers arrays by range and the half of the runs, merges them in order, and joins neighbours.
    plans = df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
    assert plans[0].count("sort_array(flatten(collect_list(entries") == 3 and plans[0].count("sort_array(collect_list(struct(digest") == 1
    assert plans[1].partition("Initial Plan")[0].count("Exchange hashpartitioning(range") == 4 and "EvalPython" not in plans[1] and "MapIn" not in plans[1]


def test_exact_dedup_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 8)
    monkeypatch.setattr(exact_dedup, "RANGE_ROWS", 16)
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(600)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert got == {i: (max(groups[t]), len(groups[t])) for i, t in rows}


def test_sharding(spark, docs, rows, empty, tmp_path):
    got = sharding.assign_shards(docs, shards=7, bucket_rows=8).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    shards = collections.defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in shards.values()]
    assert len(shards) == 7 and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sharding.assign_shards(docs, shards=7, bucket_rows=8).collect()), key=str)
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order != sorted(order, key=lambda i: (i is None, i))
    few = sharding.assign_shards(docs.limit(3), shards=7).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.assign_shards(empty).count() == 0
    hot = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(500)))).select(F.lit(1).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    assert sharding.assign_shards(hot, shards=4, bucket_rows=16).groupBy("shard").count().select("count").distinct().collect()[0][0] == 125
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "out"), shards=3, bucket_bytes=2048)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def targets_by_sharing(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        rest = total - sum(done.values())
        open_ = [n for n in names if n not in done]
        share = {n: rest * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = [n for n in open_ if share[n] > 3 * sizes[n]]
        if not over:
            return done | share
        done |= {n: 3 * sizes[n] for n in over}


def test_mixing(docs, rows, empty):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = targets_by_sharing(sizes)
    got = mixing.mixed(docs, block_words=16).collect()
    source = {r[0]: r[3] for r in rows}
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 64 for s in want)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(docs, block_words=16).collect()), key=str)
    mix = mixing.mixed_documents(docs, block_words=16)
    assert mix.columns == docs.columns
    words = collections.Counter()
    whole = {r[0]: r[1] for r in rows}
    for r in mix.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert set(WORD.findall(r["text"])) <= set(WORD.findall(whole[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    sums = collections.Counter()
    for r in got:
        sums[r["doc_id"]] += r["taken"]
    assert words == +sums
    assert mixing.mixed(empty).count() == 0


def test_mixing_tells_rows_with_nulls_apart(spark):
    rows = [(5, None, "a b c d"), (5, "a b c d", None), (None, "5", "a b c d"), (5, "a b c d", ""), (None, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.lit(0).cast("long"))
    keys = docs.select(mixing.row_key(F.col("doc_id"), F.col("text"), F.col("source")).alias("k")).distinct().count()
    assert keys == len(rows)
    got = mixing.mixed_documents(docs, block_words=1).collect()
    assert got and all(r["text"] for r in got)


def test_mixed_shards_hold_what_the_mix_takes(docs, rows):
    taken, slots = collections.Counter(), collections.Counter()
    for r in mixing.mixed_shards(docs, block_words=16).collect():
        taken[r["doc_id"]] += r["words"]
        slots[r["shard"], r["rank"], r["place"]] += r["words"]
    want = collections.Counter()
    for r in mixing.mixed(docs, block_words=16).collect():
        want[r["doc_id"]] += r["taken"]
    assert taken == +want and max(slots.values()) <= 16


def test_running_sums_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SUPER", 4)
    rows = [(b, p, p * b + 1) for b in (1, 2) for p in range(0, 60, 1 + b)]
    got = mixing.with_base(spark.createDataFrame(rows, "b long, p long, n long"), "b", "p", "n", "base").collect()
    assert all(r["base"] == sum(n for b, p, n in rows if b == r["b"] and p < r["p"]) for r in got) and len(got) == len(rows)


CLASHES = [
    "_id", "id", "_digest", "digest", "bytes", "check", "row", "lost", "lost_id", "_found", "found", "_lang", "_score", "lang_pred", "_key", "key", "_plans", "plan", "_plan",
    "round", "_round", "words", "_words", "_text", "made", "chosen", "same", "uses", "rank", "start", "block", "size", "_shard", "_slot", "slot", "law", "_record", "bucket", "n", "sketch",
    "component_id", "kept", "keep_id", "group_size", "host", "path", "rule", "url", "license", "v", "list", "query_id",
]


def test_clashing_names_change_nothing(spark, docs, tmp_path):
    """Every name that an operator uses inside, as a column of the table."""
    few = docs.where("doc_id < 25").drop("kept", "score", "shard")
    clash = few.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    for run in (exact_dedup.exact_groups, near_dedup.near_groups, sharding.assign_shards, mixing.mixed, licenses.license_spans, queries.bpe_digests):
        assert key(run(clash)) == key(run(few)), run
    for run in (exact_dedup.drop_copies, near_dedup.drop_near_copies, mixing.mixed_documents, language_id.known_language):
        got = run(clash)
        assert got.columns == clash.columns and key(got.select(*few.columns)) == key(run(few)), run
        assert got.where(" or ".join(f"`{c}` <> 'own {c}'" for c in CLASHES)).count() == 0
    model = language_id.fit(clash)
    found = language_id.predictions(clash, model, lang="lang_out", score="score_out")
    assert found.columns == [*clash.columns, "lang_out", "score_out"] and key(found.select("doc_id", "lang_out")) == key(language_id.predictions(few, language_id.fit(few), lang="lang_out").select("doc_id", "lang_out"))
    scored = quality.scores(clash, quality.fit(clash, clash.selectExpr("doc_id", "int(doc_id % 2) quality", "'l' label", "'m' most", "'i' _id")), score="s_out")
    assert scored.columns == [*clash.columns, "s_out"]
    sharding.write_shards(clash, str(tmp_path / "out"), shards=3, bucket_bytes=4096)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*clash.columns, "shard"]) and key(back.select(*clash.columns)) == key(clash)
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    assert key(ann.nearest(vectors.select("*", *(F.lit(1).alias(c) for c in CLASHES)), every=10)) == key(ann.nearest(vectors, every=10))
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://example.com/en/")], "page_id long, url string")
    assert key(url_filter.judged(pages.select("*", *(F.lit("own").alias(c) for c in CLASHES if c != "url")))) == key(url_filter.judged(pages))


@pytest.mark.parametrize("n", [1, 2, 7, 64, 100])
def test_permutation_is_one(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long")).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))


def sets_of(text):
    w = WORD.findall(norm(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_dedup(spark, docs, rows, empty):
    ids = [r for r in rows if r[0] is not None]
    sets = {r[0]: sets_of(r[1]) for r in ids}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in itertools.combinations(sets, 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None or not r["kept"]
        else:
            i = r["doc_id"]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), find(i), find(i) == i)
    assert near_dedup.near_groups(empty).count() == 0


def test_near_dedup_of_one_large_loose_group(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = f"v{rng.random()}"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = {i: sets_of(t) for i, t in rows}
    comp = {i: i for i in sets}
    for _ in range(60):
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == comp


def test_words_longer_than_a_piece_are_one_word(monkeypatch):
    import pyarrow as pa

    from cellforge.llm import shingles

    monkeypatch.setattr(shingles, "PIECE", 64)
    monkeypatch.setattr(shingles, "_powers", {})  # tables of the patched size stay here
    rng = random.Random(6)
    words = ["".join(rng.choice("ab") for _ in range(n)) for n in (1, 5, 63, 64, 65, 127, 128, 129, 200, 300) for _ in range(3)]
    words += [words[-1], words[-1][:-1] + "c", words[8], words[-4]]
    texts = [" ".join(rng.sample(words, len(words))) + rng.choice(["", " ", "\n\n"]) for _ in range(40)] + [None, words[-1], words[8]]
    seen = {}
    for text, hashes in zip(texts, shingles.word_hashes(pa.array(texts)), strict=True):
        own = WORD.findall(text or "")
        assert len(own) == len(hashes)
        for word, h in zip(own, hashes.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen) == len(set(words))


def thue_morse(bytes_: int) -> tuple[str, str]:
    """Two words that have one hash under every polynomial with an odd base modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(bytes_)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [1024, 4096])
def test_thue_morse_words_stay_apart(spark, size):
    a, b = thue_morse(size)
    got = near_dedup.near_groups(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 2), (3, 1)]
    assert licenses.scan(b.encode(), licenses.Index({"x": a})) == [] and len(licenses.scan(a.encode(), licenses.Index({"x": a}))) == 1


def test_tiles_hold_each_pair_once_and_are_bounded(spark):
    n, most, tile = 20_000, 4096, 256
    members = spark.range(n).select(F.lit(7).alias("key"), F.lit(n).alias("size"), F.col("id"))
    chosen = members.where("id % 5 = 0").select("key", "size", F.col("id").alias("i"))
    left, right = near_dedup.tiled(chosen, members, most, tile)
    sides = [df.groupBy("block", "tile").count().agg(F.max("count")).first()[0] for df in (left, right)]
    assert max(sides) < 2 * tile
    few = near_dedup.tiled(chosen.where("i < 500"), members.where("id < 3000"), most, tile)
    met = few[0].join(few[1], ["key", "block", "tile"])
    assert met.count() == met.select("i", "id").distinct().count() == 100 * 3000


def test_odd_sketch_never_rules_out_a_link():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, 80, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(30, 80)], rng.integers(0, 2**63, 10, dtype=np.uint64)]))
        differ = sum(int(x).bit_count() for x in (near_dedup.odd_sketch(a) ^ near_dedup.odd_sketch(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))


def test_bpe_equals_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary_path())
    hard = ["<|endoftext|>x<|startoftext|> y", "ΑΣ ΟΔΟΣ İstanbul I'VE don't", " \t\x1c\x85 a\x1cb", "é é ﬁ ½ ①", "日本語テキスト 한국어", "qjqjxzxz" * 40, "a" * 3000, "<|endoftext|", "🙂👩‍👧 ok", "\0\0 a\0b\0"]
    coder = bpe.ForcedBoundaryBPE(queries.vocabulary_path(), cache=50)
    for t in hard + [r[1] for r in rows]:
        e = tok.encode(t or "", add_special_tokens=False)
        assert coder.encode(t) == e.ids and coder.both(t)[2] == tok.decode(e.ids, skip_special_tokens=False) == coder.decode(e.ids)
    got = {r["doc_id"]: r for r in queries.bpe_digests(docs).collect()}
    for r in rows:
        e = tok.encode(r[1] or "", add_special_tokens=False)
        d = got[r[0]]
        assert (d["n_tokens"], d["ids_sha256"]) == (len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest())
    assert bpe.encoded(docs, queries.vocabulary_path()).where("doc_id = 1").first()["ids"] == coder.encode(rows[1][1])
    assert queries.bpe_digests(empty).count() == 0


def test_bpe_of_many_special_tokens():
    from tokenizers import Tokenizer

    tok, coder = Tokenizer.from_file(queries.vocabulary_path()), bpe.ForcedBoundaryBPE(queries.vocabulary_path())
    for text in ("<|endoftext|>" * 5000, "a dump <|endoftext|> of Ω texts<|startoftext|>" * 3000 + "end"):
        e = tok.encode(text, add_special_tokens=False)
        assert coder.encode(text) == e.ids and coder.both(text)[2] == tok.decode(e.ids, skip_special_tokens=False)


def test_language_id(spark, docs, rows, empty):
    model = language_id.fit(docs)
    assert model.languages == ["de", "en"] and (model.weights == 0).mean() > 0.5
    got = {r["doc_id"]: r for r in language_id.predictions(docs.drop("lang"), model).collect()}
    right = [got[i]["lang_pred"] == rows[i][2] for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(right) > 0.8
    for r in rows:
        if r[0] is not None and not any(map(str.isalpha, r[1] or "")):
            assert (got[r[0]]["lang_pred"], got[r[0]]["score"]) == ("und", 0.0)
    assert language_id.fit(empty).predict("some text") == ("und", 0.0)
    assert language_id.known_language(docs).columns == docs.columns


def test_known_language_keeps_unlikely_languages(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a", "en", 0.9), (2, "b", "fr", 0.3), (3, "c", "und", 0.0)], "doc_id long, text string, l string, s double")
    monkeypatch.setattr(language_id, "fit", lambda docs: None)
    monkeypatch.setattr(language_id, "predictions", lambda docs, model, lang, score: docs.withColumns({lang: F.col("l"), score: F.col("s")}))
    assert sorted(r["doc_id"] for r in language_id.known_language(d).collect()) == [1, 2]


def test_windows_do_not_change_counts(monkeypatch):
    from cellforge.llm import features

    rng = random.Random(9)
    texts = ["Some words. " * 50, "ΑΣ ΟΔΟΣ İstanbul ΣΑΣ" * 40, "x" * 700, " \t" * 300, "..." * 200 + "a", "".join(rng.choice("ab  .Σ\u3000") for _ in range(900))]
    whole = [(letter_gram_counts(t, 1 << 12), np.bincount(subword_features(t, 1 << 12), minlength=1 << 12)) for t in texts]
    for window in (1, 2, 3, 7, 120, 500):
        monkeypatch.setattr(features, "WINDOW", window)
        for t, (grams, words) in zip(texts, whole, strict=True):
            assert (letter_gram_counts(t, 1 << 12) == grams).all() and (np.bincount(subword_features(t, 1 << 12), minlength=1 << 12) == words).all()


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST", 2)
    rows = [(i, f"{'abc'[i % 3]}{'xyz'[i % 3]} " * 5, "abcd"[min(i % 3, 3)]) for i in range(90)] + [(1000 + i, "qq", f"rare{i}") for i in range(5)]
    assert len(language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages) == 2


def test_quality(spark, docs, rows, empty):
    rng = random.Random(2)
    made = [(i, make(rng, EN, 40) if i % 2 else "Junk!! " * 30) for i in range(200)]
    d = spark.createDataFrame([*made, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, i % 2) for i in range(200)), (3, 0), (None, 1), (900, None)], "doc_id long, quality int")
    model = quality.fit(d, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scores(d, model).collect()}
    apart = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == bool(i % 2) for i in apart]) > 0.95 and got[900] == got[901]
    assert quality.fit(d, labels.limit(0)).score("x") == 0.5


def test_url_filter(spark):
    rules = url_filter.RULES
    hosts = ["good.example.com", "www.example.com", "bad.example.net", "x.org", "com", "EXAMPLE.com", "notexample.com"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/1", "/es/2?q#f", "/fr/3", "?x", "#y")] + [None, "", "no scheme", "a://b://c/d", "http://ü.com/é\n?"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    for r in url_filter.judged(pages).collect():
        u = urls[r["page_id"]]
        at = u.find("://") if u else -1
        rest = u[at + 3 :] if at >= 0 else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = norm(host)
        fits = [(t, v) for t, v in rules if (host == (n := t.partition("/")[0]) or host.endswith("." + n)) and path.startswith(t[len(n) :])]
        best = max(fits, key=lambda x: len(x[0]), default=(None, r["verdict"]))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *best)
    assert url_filter.judged(pages.limit(0)).count() == 0
    # Smoothed probabilities of every next symbol add up to one.
    flat = np.bincount(np.concatenate([url_filter.cells(u) for u in urls]), minlength=sum(url_filter._sizes()))
    model = url_filter.Markov.of(flat)
    both = [model.log_likelihood("ht" + c) - model.log_likelihood("ht") for c in "abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&#:%~+@,;!"]
    assert 0.5 < sum(np.exp(both)) <= 1.0001


def test_url_contexts_have_counts_of_their_own(spark):
    def probabilities(urls, url):
        """P(url) by the exact counts, in plain Python."""
        seen = collections.defaultdict(collections.Counter)
        padded = lambda u: [0] * 4 + url_filter._SYMBOLS[np.frombuffer(u.encode(), np.uint8)].tolist()
        for u in urls:
            w = padded(u)
            for i in range(4, len(w)):
                for k in range(5):
                    seen[tuple(w[i - k : i])][w[i]] += 1
        w, out = padded(url), 0.0
        for i in range(4, len(w)):
            p = 1 / 64
            for k in range(5):
                c = seen.get(tuple(w[i - k : i]))
                p = (c[w[i]] + len(c) * p) / (c.total() + len(c)) if c else p
            out += np.log(p)
        return out

    rng = random.Random(3)
    urls = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=40)) for _ in range(1500)]  # some 50,000 contexts
    rows = [(u, "block" if i % 2 else "allow") for i, u in enumerate(urls)]
    table = spark.createDataFrame(rows, "url string, ruled string")
    apart = {r["url"] for r in table.where("pmod(xxhash64(23, url), 5) = 0").collect()}
    got = url_filter.fit(table)
    for model, verdict in ((got.accepted, "allow"), (got.rejected, "block")):
        counted = [u for u, v in rows if v == verdict and u not in apart]
        for u in [*urls[:6], "no/such?one"]:
            assert model.log_likelihood(u) == pytest.approx(probabilities(counted, u), abs=1e-6)


def test_ann(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 16))
    x = (centers[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[100:160] = x[99]  # one vector many times
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    rows += [rows[5], (2000, None, "e"), (2100, [0.0] * 16, "e"), (2200, [float("nan")] * 16, "e"), (2300, [None] * 16, "e"), (2400, [1.0], "e"), (None, rows[3][1], "e")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = collections.defaultdict(list)
    for r in ann.nearest(table, every=25).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 25))
    hits, y = 0, x.astype(np.float64)
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        hits += len({v for v, _ in found} & set(want.tolist()))
        assert len(found) == 10 and all(abs(d[v] - s) < 1e-12 for v, s in found)
    assert hits >= 0.9 * 10 * len(got)
    assert [v for v, _ in got[100]] == [99, *range(101, 110)]
    few = ann.nearest(table.where("vec_id < 4"), every=2).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in few) == [(0, 1), (0, 2), (0, 3), (2, 0), (2, 1), (2, 3)]
    assert ann.nearest(table.limit(0)).count() == 0


def test_ann_recall_with_many_lists(spark):
    import pyarrow as pa

    rng = np.random.default_rng(11)
    y = rng.normal(size=(20_000, 64))
    y /= np.sqrt((y**2).sum(axis=1))[:, None]  # no clusters, and more than 64 lists
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(len(y)), "embedding": pa.array(list(y), pa.list_(pa.float64()))}))
    got = collections.defaultdict(set)
    for r in ann.nearest(table).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, len(y), 100):
        d = ((y - y[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.98 * 10 * len(got) and len(got) == 200


def test_urls_by_tables_score_as_in_memory(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [(-1, None), (-2, ""), (-3, "no scheme"), (-4, "http://\u00e9.org/\u4e2d"), (-5, "x" * 70_000), (None, "http://a.b/c"), (None, "http://a.b/c")]
    pages = pages.union(spark.createDataFrame(odd, pages.schema)).union(pages.limit(20))
    key = lambda rows: sorted(((r["page_id"] or 0, r["host"], r["path"], r["rule"] or "", r["verdict"], r["score"]) for r in rows))
    held, tables = (key(url_filter.judged(pages, most_cells=most).collect()) for most in (1 << 30, 0))
    assert [r[:-1] for r in held] == [r[:-1] for r in tables]
    assert np.allclose([r[-1] for r in held], [r[-1] for r in tables], rtol=0, atol=1e-9)
    assert url_filter.judged(pages.limit(0), most_cells=-1).count() == 0


def test_licenses(spark, docs):
    filler = " ".join(f"word{i}" for i in range(300))
    texts = {
        1: f"{filler} Released under the MIT License. {filler}",
        2: f"{filler}\nThis work is licensed under the GNU Public License, version 3. {filler}",  # a word is missing
        3: "Licensed under CC BY-NC 4.0. and again: licensed under cc by-nc 4.0",
        4: filler,
        5: None,
        6: "",
        7: "license released the under MIT",
        8: "x " * 700_000 + "Released under the MIT License.",
    }
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in licenses.license_spans(table).collect():
        got[r["doc_id"]].append(r)
    assert sorted((i, r["license"]) for i, rs in got.items() for r in rs) == [(1, "MIT"), (2, "GPL-3.0"), (3, "CC-BY-NC-4.0"), (3, "CC-BY-NC-4.0"), (8, "MIT")]
    for i, rs in got.items():
        for r in rs:
            span = texts[i].encode()[r["span_start"] : r["span_end"]].decode()
            assert span.split()[0].lower() in ("released", "this", "licensed") and span.split()[-1][0] in "L34"
    assert got[2][0]["coverage"] == pytest.approx(11 / 12) and got[1][0]["coverage"] == 1.0
    assert licenses.license_spans(table.limit(0)).count() == 0


def test_licenses_close_together_or_with_an_edit():
    index = licenses.Index(licenses.TEMPLATES)
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"):
        line = licenses.TEMPLATES[name]
        for n in (1, 2, 3, 50):
            got = licenses.scan(" ".join([line] * n).encode(), index)
            assert [(r[0], r[1]) for r in got] == [(name, 1.0)] * n
            assert [r[3] for r in got] == [i * (len(line) + 1) for i in range(n)]
        words = line.split()
        for i in range(len(words)):
            if name != "CC-BY-NC-4.0" or i < 3:  # the others are two words each
                for middle in ([], ["other"]):
                    text = " ".join(["before it", *words[:i], *middle, *words[i + 1 :], "after it"])
                    # At most one word of 5 to 12 is not as in the template, or two in "2.0."
                    agree = len(index.words[index.names.index(name)]) - len(licenses._tokens(np.frombuffer(words[i].encode(), np.uint8))[0])
                    want = [name] if agree >= 0.8 * len(index.words[index.names.index(name)]) else []
                    assert [r[0] for r in licenses.scan(text.encode(), index)] == want, text
        for i in range(1, len(words)):  # a word put in
            assert [r[0] for r in licenses.scan(" ".join([*words[:i], "truly", *words[i:]]).encode(), index)] == [name]


def test_licenses_against_alignment_at_every_offset():
    rng = random.Random(12)
    agreed = 0
    for _ in range(150):
        name = rng.choice(["MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "MPL-2.0", "MIT-condition", "BSD-text"])
        index = licenses.Index({name: licenses.TEMPLATES[name]})
        words = licenses.TEMPLATES[name].split()
        filler = [w for t in ("MIT-text", "GPL-text") for w in licenses.TEMPLATES[t].split()] + ["filler"] * 20
        for _ in range(rng.randint(0, max(2, len(words) // 3))):
            i = rng.randrange(len(words))
            words[i : i + rng.randint(0, 1)] = [rng.choice(filler)] * rng.randint(0, 1)
        text = [rng.choice(filler) for _ in range(rng.randint(0, 20))] + words + [rng.choice(filler) for _ in range(rng.randint(0, 20))]
        data = np.frombuffer(" ".join(text).encode(), np.uint8)
        hashes, m = licenses._tokens(data)[0].tolist(), len(index.lists[0])
        tried = [licenses.align(index.lists[0], hashes, start) for start in range(-licenses.BAND, len(hashes))]
        best = max((t[1] for t in tried if t), default=0)
        got = licenses.scan(data.tobytes(), index)
        assert bool(got) == (best >= licenses.LEAST * m - 1e-9), (name, text)
        agreed += bool(got)
    assert 30 < agreed < 140


def test_license_fingerprints_are_winnowed_and_hit_every_sure_run():
    index = licenses.Index(licenses.TEMPLATES)
    chosen = everything = 0
    for template, words in enumerate(index.words):
        run = licenses.sure_run(len(words), index.least)
        for at in range(len(words) - run + 1):
            assert template in index.picked(words[at : at + run]), (index.names[template], at)
        hashes = licenses.grams(words, min(licenses.GRAM, run))
        chosen, everything = chosen + len(licenses.winnow(hashes, run - min(licenses.GRAM, run) + 1)), everything + len(hashes)
    assert chosen < 0.8 * everything
    tiny = licenses.Index({"one": "alpha", "three": "beta gamma delta", "none": ""})
    assert [r[0] for r in licenses.scan(b"x alpha y beta gamma delta", tiny)] == ["one", "three"]


def test_the_best_of_templates_on_the_same_words():
    index = licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert [(r[0], r[1]) for r in licenses.scan(text.encode(), index)][:1] == [(name, 1.0)], name
    both = " ".join([licenses.TEMPLATES["GPL-2.0"], licenses.TEMPLATES["CC-BY-SA-4.0"], licenses.TEMPLATES["Apache-grant"]])
    assert [(r[0], r[1]) for r in licenses.scan(both.encode(), index)] == [("GPL-2.0", 1.0), ("CC-BY-SA-4.0", 1.0), ("Apache-grant", 1.0)]


def test_smallest_columns():
    """The m smallest, in order; which of equal ones at the border are taken does not matter."""
    d = np.random.default_rng(3).integers(0, 9, (50, 40)).astype(float)
    assert (np.take_along_axis(d, ann.smallest(d, 7), 1) == np.sort(d, axis=1)[:, :7]).all() and ann.smallest(d, 99).shape == (50, 40)


def test_pipeline_stages(spark, docs, rows, tmp_path, monkeypatch):
    import corpus_pipeline

    docs.where("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r[0] for r in rows}
    assert out and {r["doc_id"] for r in out} <= kept and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    silent = {r[0] for r in rows if not any(map(str.isalpha, r[1] or ""))}
    assert not silent & {r["doc_id"] for r in out}


def test_pipeline_stage_by_stage(spark, docs, rows, tmp_path):
    """Each stage on all that the one before kept, against brute force: nulls, ties, repeated rows and extra columns included."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    with_id = docs.where("doc_id is not null")
    known = stages["language_id"](spark, with_id, str(tmp_path))
    count = lambda rs: collections.Counter(map(tuple, rs))
    given = [r for r in with_id.collect() if any(map(str.isalpha, r["text"] or ""))]
    assert known.columns == docs.columns and count(known.collect()) == count(given)
    groups = collections.defaultdict(set)
    for r in given:
        groups[norm(r["text"])].add(r["doc_id"])
    single = stages["exact_dedup"](spark, known, str(tmp_path))
    rest = [r for r in given if r["doc_id"] == max(groups[norm(r["text"])])]
    assert single.columns == docs.columns and count(single.collect()) == count(rest)
    sets, root = {r["doc_id"]: sets_of(r["text"]) for r in rest}, {r["doc_id"]: r["doc_id"] for r in rest}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    apart = stages["near_dedup"](spark, single, str(tmp_path))
    rest = [r for r in rest if root[r["doc_id"]] == r["doc_id"]]
    assert apart.columns == docs.columns and count(apart.collect()) == count(rest)
    mix = stages["mixing"](spark, apart, str(tmp_path))
    sizes = collections.Counter()
    for r in rest:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    taken, texts = collections.Counter(), {r["doc_id"]: r for r in rest}
    made = mix.collect()
    for r in made:
        whole = texts[r["doc_id"]]
        assert (r["lang"], r["source"], r["kept"]) == (whole["lang"], whole["source"], whole["kept"])
        assert not collections.Counter(WORD.findall(r["text"])) - collections.Counter(WORD.findall(whole["text"]))
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert mix.columns == docs.columns and all(abs(taken[k] - v) <= 2 * mixing.BLOCK_WORDS for k, v in targets_by_sharing(sizes).items())
    tok = Tokenizer.from_file(queries.vocabulary_path())
    want = collections.Counter()
    for r in made:
        e = tok.encode(r["text"], add_special_tokens=False)
        want[r["doc_id"], len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert count(stages["bpe"](spark, spark.createDataFrame(made, docs.schema), str(tmp_path)).collect()) == want
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_passing_tables_are_deleted_and_kept_ones_stay(spark):
    from cellforge.llm import common

    with common.passing() as outer:
        with common.passing() as inner:
            gone = common.written(spark.range(3), "gone")
            stays = inner(gone.where("id > 0"), "stays")
        assert [r["id"] for r in stays.orderBy("id").collect()] == [1, 2]
        last = outer(stays.where("id > 1"), "last")
    assert [r["id"] for r in last.collect()] == [2]
    assert not any(path.endswith(("-gone", "-stays")) for path in common._written)
    with pytest.raises(Exception, match="(?i)not.exist"):
        gone.collect()
    before = set(common._written)
    assert near_dedup.drop_near_copies(spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "x")], "doc_id long, text string")).count() == 2
    assert {path.rpartition("-")[2] for path in set(common._written) - before} == {"lost"}
