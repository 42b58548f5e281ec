"""Small fixtures against brute force, with nulls, empty and long texts, repeats, ties, clashing columns, empty tables."""

import collections
import hashlib
import math
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leakscan.llm import ctw, jaccard, licenses, packing, pieces, quality, repeats, sharding, spotsigs, stages, toxicity
from leakscan.llm._graph import components

WORD_FILE, PIECE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["an", "er", "th", "ou", "ß", "é"]) for _ in range(rnd.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    base, passage = prose(120), prose(110)
    near = base.split()
    near[60] = "changed"
    rows = [None, "", "one", "a b", base, base, " ".join(near), base.upper(), "x " * 300, prose(9000), prose(40) + "\n" + passage + "\n" + prose(30), prose(50) + passage, "é" * 900, "line\nline\nline\n", "Released under the MIT License.", "cc by cc-by CC\tBY", "<|endoftext|> it's 日本 ▁ $$$ ###"]
    return rows + [prose(rnd.randint(3, 80)) for _ in range(15)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, 1.0, True) for i, t in enumerate(texts())] + [(None, "no id", "en", None, None, None, None), (5, texts()[5], "en", "s", 0, 1.0, True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, score double, kept boolean").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def by_id(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_packing(docs, empty, by_id):
    from tokenizers import Tokenizer

    t, rows = Tokenizer.from_file(WORD_FILE), packing.pack(docs, WORD_FILE, 64).collect()
    want = collections.Counter()
    for i, x in by_id:
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 64):
            want[i, p // 64, p, len(ids[p : p + 64]), zlib.crc32(np.array(ids[p : p + 64], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty, WORD_FILE).count() == 0


def test_word_encoder_looks_up_distinct_words_once():
    """The words of a batch are numbered by Arrow; slices, white space, special names and case come out as the tokenizer has them."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    t, words = Tokenizer.from_file(WORD_FILE), packing.WordEncoder(WORD_FILE)
    rows = ["the end. " * 500, None, "", " \t\r\n\x0b\x0c ", "The END of\x0bÀ É, end.", "<|endoftext|> THE End", "x<| THE", "lone ... it's (end)!", "日本 ß\u00a0é"] * 3
    asked, plain = [], words._learn
    words._learn = lambda distinct: asked.extend(distinct) or plain(distinct)
    for column in (pa.array(rows, pa.string()), pa.array(["A sliced ROW", *rows], pa.string()).slice(1), pa.array(rows, pa.large_string())):
        got = [np.frombuffer(x, "<u4").tolist() for x in words.encode(column)]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in rows]
    assert len(asked) == 3 * len(set(asked))


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rnd = random.Random(seed)
    counts = {n: rnd.randint(1, 60) for n in rnd.sample(range(1, 101), 50)}
    runs, fill, seen = packing.plan(dict(counts), 100), collections.Counter(), collections.Counter()
    for n, first, at, each, offset in sorted(runs):
        following = min([r[1] for r in runs if r[0] == n and r[1] > first], default=counts[n])
        for rank in range(first, following):
            inside = rank - first
            fill[at + inside // each] += n
            seen[n] += 1
    assert seen == counts and max(fill.values()) <= 100
    big = [n for n, c in counts.items() for _ in range(c) if 3 * n > 100]
    assert len(fill) <= 1.1 * max(sum(n * c for n, c in counts.items()) / 100, len([n for n in big if n > 50])) + 2


def test_fingerprints(docs, empty, by_id):
    order = sorted(by_id, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    rows = spotsigs.fingerprint_with_next(docs).collect()
    want = collections.Counter()
    for k, (i, x) in enumerate(order):
        y, q = order[(k + 1) % len(order)][1], len(x) // 4
        want[i, len(x), hashlib.sha256((x[: len(x) - q] + y[:q]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)}
    assert len(same) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    sets = {(i, x): set(s.tolist()) for (i, x), s in zip(order, spotsigs.signatures([x for _, x in order]))}
    jaccard_of = lambda a, b: len(a & b) / len(a | b) if a and b else float(not a and not b)
    want = collections.Counter()
    for k, (i, x) in enumerate(order):
        y, q = order[(k + 1) % len(order)], len(x) // 4
        edited = set(spotsigs.signatures([x[: len(x) - q] + y[1][:q]])[0].tolist())
        e, n = jaccard_of(sets[i, x], edited), jaccard_of(sets[i, x], sets[y])
        want[i, round(e, 9), round(n, 9), e >= spotsigs.THRESHOLD, n >= spotsigs.THRESHOLD] += 1
    assert collections.Counter((r["doc_id"], round(r["near_edited"], 9), round(r["near_next"], 9), r["edited_matches"], r["next_matches"]) for r in rows) == want
    assert any(w[3] for w in want) and any(w[4] for w in want) and not all(w[3] for w in want)
    a, b = spotsigs.signatures([texts()[4], texts()[6]])
    exact = len(set(a) & set(b)) / len(set(a) | set(b))
    assert spotsigs.likeness(a, b) == exact > 0.8 and spotsigs.likeness(a, b, 0.8) == exact and spotsigs.likeness(a, b, 0.999) == 0
    assert spotsigs.fingerprint_with_next(empty).count() == 0 and spotsigs.fingerprint_with_next(docs.where("doc_id = 4")).first()["near_next"] == 1


def test_fingerprint_buckets_have_partitions_of_their_own(spark):
    """A task sorts and holds one bucket's texts: none stands idle while another has several. Guests cost no second scan."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    ordered = spotsigs._in_order(docs)
    assert ordered._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 400") == 1
    rows = ordered.select(F.spark_partition_id().alias("task"), "bucket", "guest").collect()
    tasks = collections.Counter(r["task"] for r in rows if not r["guest"])
    assert len({(r["task"], r["bucket"]) for r in rows}) == len(tasks) == 4 and max(tasks.values()) < 200 and sum(tasks.values()) == 400


def test_pruned_comparison():
    """Partitions and early stops never change what a plain Jaccard says."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.75, 0.8, 0.82, 0.9, 1.0])], rng.integers(0, 1 << 40, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        exact = common / (len(a) + len(b) - common) if len(b) else 0.0
        for t in (0.5, 0.8, 0.95):
            assert spotsigs.matches(a, b, t) == (exact >= t) and spotsigs.likeness(a, b, t) == (exact if exact >= t else 0)


def test_fingerprints_at_every_length():
    """Near copies are alike on both sides of any word count."""
    rnd = random.Random(8)
    for n in range(30, 130):
        w = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(n)]
        a, b = spotsigs.signatures([" ".join(w), " ".join(w[:-1])])
        assert spotsigs.likeness(a, b) >= 0.9


def test_toxicity(spark, empty):
    rnd = random.Random(3)
    say = lambda n: [rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n)]
    rows = []
    for i in range(800):
        w, bad = say(30), int(i % 4 == 0)
        if bad:
            w[rnd.randrange(30)] = rnd.choice(["vile", "nasty"])
        rows.append((i, " ".join(w), "en" if i % 2 else "de", bad))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(df.select("doc_id", "text", "lang"), df.select("doc_id", "toxic")).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in got)
    assert np.mean([got[i]["predicted"] == rows[i][3] for i in held]) > 0.95
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "", None), (2, "vile " * 30_000, "en")], "doc_id long, text string, lang string")
    assert toxicity.classify(odd, df.select("doc_id", "toxic").where("false")).where("score = 0").count() == 4
    assert toxicity.classify(empty, df.select("doc_id", "toxic")).count() == 0


def test_toxicity_learns_from_whole_texts(spark):
    """The word that makes a text toxic stands behind 4,500 others."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(4500)) + (" vile" if i % 4 == 0 else " mild"), "en", int(i % 4 == 0)) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4).cache()
    sample = toxicity.labelled_sample(df.select("doc_id", "text", "lang"), df.select("doc_id", "toxic"))
    assert sample and all(len(t) == 4501 for t, *_ in sample)
    model = toxicity.train(sample)
    assert np.mean([(model.scores(t, np.array([0, len(t)]))[0] >= toxicity.BOUND) == y for t, y, _ in sample]) > 0.95


def test_toxicity_stage_reads_language_bounds(spark, tmp_path, monkeypatch):
    rows = [(1, "a", "en", "s", 1), (2, "b", "de", "s", 1), (3, "c", "fr", "s", 1), (4, "d", None, "s", 1)]
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(toxicity, "labelled_sample", lambda *_: [])
    monkeypatch.setattr(toxicity, "train", lambda _: toxicity.Calibrated(None, bounds={"en": 0.0, "de": 0.9}))  # scores 0
    kept = stages.toxicity_stage(spark, df, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4] and kept.columns == stages.COLUMNS
    some = spark.createDataFrame([("en", 0.5), ("de", 0.5), ("fr", 0.5), (None, 0.2)], "lang string, score double")
    bound = toxicity.bound_of(toxicity.Calibrated(None, bounds={"en": 0.1, "de": 0.9}), F.col("lang"))
    assert [r[0] for r in some.select(F.col("score") >= bound).collect()] == [True, False, True, False]


def test_sharding(docs, empty, by_id):
    rows = sharding.assign(docs, 4).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == collections.Counter((i, len(x.encode()) + 1, zlib.crc32(x.encode())) for i, x in by_id)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert len({r["shard"] for r in rows if r["doc_id"] in (4, 5)}) == 1 and sharding.assign(empty, 4).count() == 0


def test_sharding_hot_group(spark):
    df = spark.range(400).selectExpr("id AS doc_id", "CASE WHEN id < 150 THEN 'hot' ELSE concat('t', id div 2) END AS text")
    rows = sharding.assign(df, 16).collect()
    assert set(collections.Counter(r["shard"] for r in rows).values()) == {25}
    homes = collections.defaultdict(set)
    for r in rows:
        if r["doc_id"] >= 150:
            homes[r["doc_id"] // 2].add(r["shard"])
    assert np.mean([len(h) == 1 for h in homes.values()]) > 0.7


def brute_context_tree(train, depth):
    """log10 of a text's probability by the recursion, node by node: a node is (context bytes, newest first; bits so far)."""
    counts = {}

    def steps(text):
        data = b"\0" * depth + text + b"\0"
        for i in range(depth, len(data)):
            context, bits = data[i - depth : i][::-1], f"{data[i]:08b}"
            for k in range(8):
                yield context, bits[:k], int(bits[k])

    for text in train:
        for context, so_far, bit in steps(text):
            for d in range(depth + 1):
                counts.setdefault((context[:d], so_far), [0, 0])[bit] += 1
    below = collections.defaultdict(list)
    for context, so_far in counts:
        if context:
            below[context[:-1], so_far].append((context, so_far))
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(n[0] + n[1] + 1)
    weighted = {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(counts[node])
        weighted[node] = own if len(node[0]) == depth else np.logaddexp(own, sum(weighted[c] for c in below[node])) + math.log(0.5)

    def score(text):
        total = 0.0
        for context, so_far, bit in steps(text):
            p = None
            for d in range(depth, -1, -1):
                node = context[:d], so_far
                if node in counts:
                    here = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
                    share = math.exp(math.log(0.5) + kt(counts[node]) - weighted[node]) if d < depth else 0.5
                    p = here if p is None else share * here + (1 - share) * p
            total += math.log10(0.5 if p is None else p)
        return total

    return score


def test_context_trees(docs, by_id, spark, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK", 3000)  # several blocks, and counts added up in two rounds
    monkeypatch.setattr(ctw, "FAN", 3)
    rows = ctw.scores(docs, toxicity.remainder(10) == 0, depth=3).collect()
    score = brute_context_tree([x.encode() for i, x in by_id if i is not None and zlib.crc32(str(i).encode()) % 10], 3)
    want = collections.defaultdict(set)
    for i, x in by_id:
        if len(x) < 5000:
            want[i].add(round(score(x.encode()), 3))
    for r in rows:
        if want[r["doc_id"]]:
            assert min(abs(r["score"] - w) for w in want[r["doc_id"]]) < 2e-3
        assert r["bits_per_byte"] > 0
    train = collections.Counter()
    ends = 0
    for i, x in by_id:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            train.update(x.encode().lower().split())
            ends += 1
    total, distinct = sum(train.values()) + ends, len(train) + 1
    assert len(rows) == len(by_id)
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] != 5:
            words = dict(by_id)[r["doc_id"]].encode().lower().split()
            base = sum(np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in [*(train[w] for w in words), ends])
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words) + 1, sum(train[w] > 0 for w in words) + 1, total) and abs(base - r["base_score"]) < 1e-6 * abs(base) + 1e-9
        assert r["score"] < 0
    assert ctw.scores(docs.where("false"), toxicity.remainder(10) == 0).count() == 0


def test_context_reaches_five_bytes(spark):
    """What follows is told by the fifth byte before: both contexts of four are the same."""
    rows = [(i, f"{'ab'[i % 2]}----{'xy'[i % 2]}", i % 8 > 1) for i in range(400)] + [(400, "a----y", False), (401, "b----x", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t boolean")
    got = {r["doc_id"]: r["score"] for r in ctw.scores(df, ~F.col("t")).collect()}
    assert got[0] > got[400] + 1 and got[1] > got[401] + 1


def test_context_tree_is_a_distribution():
    """Probabilities of all symbols after a context add up to one, and weights equal those of the recursion by hand."""
    rnd = np.random.default_rng(1)
    data = rnd.choice(np.frombuffer(b"abc", np.uint8), 300)
    g, _ = ctw.grams(data, np.array([0, 300]), 3)
    k, n = ctw._counted(g, np.ones(len(g)))
    every = np.unique(np.concatenate([(k[:5] >> np.uint64(8) << np.uint64(8)) | np.uint64(s) for s in range(256)]))
    keys = np.union1d(k, every)
    counts = np.zeros(len(keys), np.int64)
    counts[np.searchsorted(keys, k)] = n
    of = np.searchsorted(keys, every)
    p = np.exp(ctw.mixed(keys, counts, 3, 0)[of])
    assert all(abs(p[(every >> np.uint64(8)) == c].sum() - 1) < 1e-9 for c in np.unique(every >> np.uint64(8)))
    cut = ctw.by_depth(keys, counts, 3, 2)
    rows = [(int(i) >> (b + 8), 1 << b | int(i) & ((1 << b) - 1), z, o, w) for b in range(8) for v in [ctw.bit_levels(cut, b)[2]] for i, z, o, w in zip(v.ids, v.zeros, v.ones, v.weighted)]
    sums = collections.defaultdict(lambda: [0, 0, 0.0])
    for c, node, z, o, w in rows:
        sums[c, node] = [sums[c, node][0] + z, sums[c, node][1] + o, sums[c, node][2] + w]
    above = ctw.top_tables([(c, node, *v) for (c, node), v in sums.items()])
    assert np.allclose(ctw.mixed(keys, counts, 3, 2, above)[of], np.log(p))
    found = ctw.top_nodes(keys, counts, 3)
    assert {(c, n): [z, o, w] for c, n, z, o, w in zip(*(found[x].tolist() for x in ("c", "node", "zeros", "ones", "weighted")))} == {k: pytest.approx(v) for k, v in sums.items()}


def test_jaccard(docs, empty, by_id, monkeypatch):
    def brute():
        sets = {}
        for i, x in by_id:
            w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x))
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        of = {i: i for i in sets}
        for _ in sets:
            for i in sets:
                for j in sets:
                    if None not in (i, j) and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        of[i] = of[j] = min(of[i], of[j])
        return {i: (len(sets[i]), of[i]) for i in sets}

    want = brute()
    for rare, most in ((8, 64), (2, 2)):
        monkeypatch.setattr(jaccard, "RARE", rare)
        monkeypatch.setattr(jaccard, "LIST", most)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(docs).collect()} == want
    assert jaccard.link_components(empty).count() == 0


def test_jaccard_large_group(spark, monkeypatch):
    """Many texts share a common passage and do not link; links hidden among them are found, in several blocks and bands."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "LIST", 4)
    rnd = random.Random(6)
    fresh = lambda n: ["".join(rnd.choices("abcdefgh", k=7)) for _ in range(n)]
    passage, rows = fresh(100), []
    for n in [40] * 30 + [50] * 25 + [64] * 30 + [100] * 20:
        rows.append(passage[:n] + fresh(n // 6))  # most shingles of each are common, too few for a link
    for k in range(0, 100, 9):
        rows.append([*rows[k][:-1], *fresh(1)])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(2)
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[i] = min(root[i], root[j])
    compared, plain = [], jaccard._group_links
    monkeypatch.setattr(jaccard, "_group_links", lambda *a: compared.append(plain(*a)) or compared[-1])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_components(df).collect()}
    assert compared[0] is not None and got == dict(enumerate(root)) and len(set(root)) < len(rows)


@pytest.mark.parametrize("hub, parts", [(1024, 2), (4, 0.1)])
def test_jaccard_near_copies_travel_once(spark, monkeypatch, hub, parts):
    """Sets sent for verification grow with a group of near copies, not with its pairs; hot hubs and later parts lose no link."""
    monkeypatch.setattr(jaccard, "HUB", hub)
    monkeypatch.setattr(jaccard, "RARE", 1 << 20)  # no shingle counts as common: lists give all pairs of a group
    monkeypatch.setattr(jaccard, "PARTS", parts)
    rnd = random.Random(8)
    fresh = lambda n: ["".join(rnd.choices("abcdefgh", k=7)) for _ in range(n)]
    rows = []
    for _ in range(3):
        base = fresh(200)
        rows += [[*base[:k], *fresh(1), *base[k + 1 :]] for k in rnd.sample(range(200), 30)]
    rows.append(fresh(200))
    for _ in range(9):  # a chain: only neighbours link
        rows.append(rows[-1][12:] + fresh(12))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(9)
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in rows]
    root = list(range(len(rows)))
    for _ in root:
        for i in root.copy():
            for j in range(len(rows)):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    sent, plain = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *a: sent.append(pairs.count()) or plain(pairs, *a))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_components(df).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) == 4
    assert sum(sent) <= 2 * len(rows)


def test_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 49), (7, 7), (None, 3), (60, 50)], "a long, b long")
    got = dict(map(tuple, components(df).collect()))
    assert got == {**{i: 0 for i in range(21)}, 49: 49, 50: 49, 60: 49}


def test_licenses(docs, empty, by_id):
    got = {r["doc_id"]: r for r in licenses.scan_report(docs).collect()}
    assert (got[14]["n_base"], got[14]["first_word"], got[14]["labels"], got[14]["score"]) == (1, 3, "mit", 1.0)
    assert (got[15]["n_base"], got[15]["first_word"], got[15]["last_word"], got[15]["base_labels"]) == (3, 0, 4, "cc-by")
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    assert all(got[i]["n_words"] == len(word.findall(x)) for i, x in by_id)
    assert (got[0]["n_words"], got[0]["first_word"], got[0]["labels"], got[0]["score"]) == (0, None, "", 0.0)
    assert licenses.scan(empty).count() == 0


def test_license_containment(spark):
    lines = ["x\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files", "permission granted to any person", "licensed under the apache license version"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: sorted(r["matched"]) for r in licenses.scan(df).collect()}
    want = {}
    for i, text in enumerate(lines):
        found = set()
        for block in text.split("\n"):
            have = set(re.findall("[a-z0-9]+", block.lower()))
            for label, notice in licenses.NOTICES:
                words = set(notice.split())
                if len(words & have) >= licenses.THRESHOLD * len(words):
                    found.add(label)
        want[i] = sorted(found)
    assert got == want and want[0] == ["mit"]


def test_license_wrapped_over_lines(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files".split()
    wrapped = ["\n".join(" ".join(notice[k : k + n]) for k in range(0, len(notice), n)) for n in (1, 2, 5, 11)]
    bsd = "/*\n * Some title. Redistribution and use in source and binary forms,\n *\n * with or without modification, are permitted provided\n * that the following conditions\n * are met:\n */\nint x;"
    far = "\n".join(notice[:10] + ["other words stand here and more of them"] * 6 + notice[10:])
    lines = [*wrapped, "head\n" * 40 + wrapped[2] + "\ntail" * 40, bsd, far, "\n\n", "word\n" * 3000]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: (sorted(r["matched"]), r["containment"]) for r in licenses.scan(df).collect()}
    assert got == {**{i: (["mit"], 1.0) for i in range(5)}, 5: (["bsd"], 1.0), 6: ([], None), 7: ([], None), 8: ([], None)}


@pytest.mark.parametrize("group", [256, 3, 1])
def test_repeats(docs, empty, by_id, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    least, data = 60, [(i, x.encode()) for i, x in by_id]
    seen = collections.Counter(b[k : k + least] for _, b in data for k in range(len(b) - least + 1))
    want = collections.Counter()
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - least + 1):
            if seen[b[k : k + least]] > 1:
                gone[k : k + least] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        want[i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = repeats.remove_repeats(docs, least).select("doc_id", "repeats.*").collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    assert repeats.remove_repeats(empty, least).count() == 0


def test_short_passages_are_counted_not_removed(spark, tmp_path):
    """A shared run of 51 words under 400 bytes is counted whatever parts its words; 50 words are not; 400 bytes decide what goes."""
    from leakscan.llm import queries

    rnd = random.Random(9)
    words = lambda n: ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(n)]
    passage, short = words(51), words(50)
    rows = [[*words(20), *passage, *words(9)], [*passage, *words(30)], [*words(4), *short, *words(8)], [*words(7), *short], words(90), [], words(3)]
    rows = [" ".join(r) for r in rows]
    rows[1] = rows[1].replace(" ", "\t\n", 20)
    rows += [long := " ".join(words(100)), "x " + long, None]
    spark.createDataFrame([*enumerate(rows)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert len(" ".join(passage)) < 400 and [got[i]["n_removed"] for i in range(10)] == [0] * 7 + [len(long)] * 2 + [0]
    assert [got[i]["n_passages"] for i in range(10)] == [1, 1, 0, 0, 0, 0, 0, 1, 1, 0]
    assert [got[i]["n_passage_bytes"] for i in (0, 1, 7, 8)] == [len(" ".join(passage)), len(" ".join(passage)) + 20, len(long), len(long)]
    assert all(got[i]["kept_sha256"] == hashlib.sha256((rows[i] or "").encode()).hexdigest() for i in (0, 1, 2, 3, 4, 5, 6, 9))


def test_repeats_leave_no_shuffle_files(spark, monkeypatch):
    """The shuffle files of each stored table go when it is written, without a collection of the driver's garbage; the session's setting stays as it was."""
    from leakscan.llm import _common

    folders = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in Path(d).glob("*/shuffle_*.data")}
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choices("abcdefghij ", k=n))
    passage = text(200)
    docs = spark.createDataFrame([(i, text(50) + passage + text(50)) for i in range(20)], "doc_id long, text string").repartition(3)
    stored, durable, made = [], _common.durable, files()

    def watched(df, name, *args, **kw):
        stored.append((name, durable(df, name, *args, **kw)))
        for _ in range(50):  # executors delete on their own time
            if not (left := files() - made):
                break
            time.sleep(0.1)
        assert not left, f"{name} leaves {len(left)} files"
        return stored[-1][1]

    monkeypatch.setattr(repeats, "durable", watched)
    monkeypatch.setattr(repeats, "GROUP", 3)
    for had in (None, "false"):
        if had:
            spark.conf.set(_common.SWEEP, had)
        try:
            found = repeats.remove_repeats(docs, 60, words=5)
            assert spark.conf.get(_common.SWEEP, None) == had
        finally:
            spark.conf.unset(_common.SWEEP)
    assert {name for name, _ in stored} == {"kinds", "sizes", "words", "bytes", "blocks"}
    assert all(r["n_removed"] >= len(passage) for r in found.select("repeats.*").collect())


def test_maximal_repeats():
    t = [b"xabcabcy", b"zabcabcw"]
    found = {(n, tuple(sorted(at))) for n, at in repeats.maximal_repeats(t, [6, 6], 3)}
    assert (6, ((0, 1), (1, 1))) in found and (3, ((0, 1), (0, 4), (1, 1), (1, 4))) in found and len(found) == 2


def test_groups_of_segments_sort_two_strings_a_segment(monkeypatch):
    """Windows met once in groups of segments are those of brute force, wherever batches end and rows recur; suffix arrays have two entries a segment, not one a window."""
    import pyarrow as pa

    arrays, sizes = repeats.prefix_array, []
    monkeypatch.setattr(repeats, "prefix_array", lambda texts, group: sizes.append(len(texts)) or arrays(texts, group))
    rnd, least, rows = random.Random(6), 100, []
    for group, kinds in enumerate((2, 1, 3, 150, 2, 40)):
        core = bytes(rnd.choices(b"abcd", k=2 * least))
        for _ in range(kinds):
            at, z, text = rnd.randint(40, least - 16), rnd.randint(70, least), bytearray(core)
            for place in rnd.choices([*range(100), *range(116, 200)], k=rnd.choice([0, 1, 4])):
                text[place] = rnd.choice(b"efgh")
            rows.append((group, len(rows), rnd.choice([1, 1, 2]), len(rows), rnd.randrange(9), at, bytes(text[100 - at : 100 + z])))
    rows = sorted([*rows, rows[1], rows[3], rows[-1]])
    seen = {(g, at - j, x[j : j + least]): set() for g, _, _, _, _, at, x in rows for j in range(len(x) - least + 1)}
    for g, s, _, _, _, at, x in rows:
        for j in range(len(x) - least + 1):
            seen[g, at - j, x[j : j + least]].add(s)
    want = {(k, first + j) for g, _, n, k, first, at, x in rows if n == 1 for j in range(len(x) - least + 1) if len(seen[g, at - j, x[j : j + least]]) == 1}
    names = ["anchor", "segment", "n", "k", "first", "at", "bytes"]
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], names) for i in range(0, len(rows), size)]
        sizes.clear()
        got = [r for b in repeats._group_unique(least)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert sum(sizes) == 2 * len(set(rows))
        windows = [(k, j) for k, a, z in got for j in range(a, z)]
        assert len(windows) == len(set(windows)) and set(windows) == want


def test_quality(docs, empty, by_id, spark):
    rules = quality.DecisionList(((quality.Test("symbols_per_word", True, 0.2),), (quality.Test("n_words", False, 20), quality.Test("mean_word", True, 8))))
    got = {r["doc_id"]: r for r in quality.judge(docs, rules).select("doc_id", "quality.*").collect()}
    for i, x in by_id:
        w, windows = SPACE.findall(x), collections.Counter()
        windows.update(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [y for y in x.split("\n") if SPACE.search(y)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered))
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        row = {"symbols_per_word": r["n_symbols"] / max(len(w), 1), "n_words": len(w), "mean_word": r["word_chars"] / max(len(w), 1)}
        assert (r["base_failed"], r["kept"]) == (failed, not failed and rules.keeps(row))
    assert quality.judge(empty, rules).count() == 0
    rnd = random.Random(2)
    rows = [({f: rnd.random() for f in quality.FEATURES}, False) for _ in range(300)]
    rows = [(r, r["symbols_per_word"] > 0.7 and r["mean_word"] <= 0.5) for r, _ in rows]
    learned = quality.learn_rules(rows)
    assert np.mean([learned.keeps(r) != bad for r, bad in rows]) > 0.95 and quality.learn_rules([]).rules == ()


def test_pieces(docs, empty, by_id):
    m = pieces.from_model(PIECE_FILE)
    for _, x in by_id:
        ids, _ = m.encode(x)
        assert m.decode(ids) == x.replace("▁", " ")
    rows = pieces.round_trip(docs, PIECE_FILE).collect()
    assert collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in rows) == collections.Counter((i, hashlib.sha256(x.replace("▁", " ").encode()).hexdigest()) for i, x in by_id)
    assert pieces.round_trip(empty, PIECE_FILE).count() == 0 and pieces.encode_documents(docs, PIECE_FILE).where(F.size("ids") == 0).count() == 2


def test_viterbi_is_best():
    m = pieces.UnigramPieces(["▁", "a", "b", "ab", "▁ab", "aba", "<0xC3>", "<0xA9>"], [-3, -2.5, -2.6, -2.0, -2.2, -3.0, 0, 0], ["piece"] * 6 + ["byte"] * 2)

    def brute(s):
        if not s:
            return 0.0
        fits = [(len(p), m.scores[i]) for i, p in enumerate(m.pieces) if m.kinds[i] == "piece" and s.startswith(p)]
        if not any(n == 1 for n, _ in fits):
            fits.append((1, m.unknown))
        return max(x + brute(s[n:]) for n, x in fits)

    for s in ("ababab", "abaaba", "éab", "bbb", "aé"):
        ids, score = m.encode(s)
        assert abs(score - brute("▁" + s)) < 1e-9 and m.decode(ids) == s


def test_parts_are_looked_up_once():
    """One look-up gives a part's ids and score, and encodes it if need be; zero bytes lead nowhere in the trie."""
    m = pieces.UnigramPieces(["▁", "a", "ab", "b", "▁a"], [-1.0, -1.5, -2.0, -1.75, -2.25], ["piece"] * 5)
    asked, plain = collections.Counter(), m.best
    m.known.best = lambda part: asked.update([part]) or plain(part)
    assert m.encode("ab a ab b") == ([0, 2, 4, 0, 2, 0, 3], -3.0 - 2.25 - 3.0 - 2.75)
    assert asked == {"▁ab": 1, "▁a": 1, "▁b": 1} and m.known["▁a"][1] == -2.25
    for text, rest in (("\0", -1.0), ("\0a", -2.5), ("a\0b", -4.0), ("\0\0", m.unknown - 1.0)):
        assert m.encode(text)[1] == m.unknown + rest


def test_join_leaves_no_lists_and_pairs(spark):
    """What op6 has done with is deleted while it runs: lists, pairs, and the labels of former rounds."""
    from pathlib import Path

    from leakscan.llm import jaccard

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    kept = lambda: {p.name for p in shared.glob("leakscan-*") if p.name.split("-")[1] in ("lists", "pairs", "candidates", "oriented", "edges", "low")}
    before = kept()
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join([*words[:i], f"e{i}", *words[i:]])) for i in range(12)], "doc_id long, text string")
    out = jaccard.link_components(df)
    assert kept() == before
    assert {r["component_id"] for r in out.collect()} == {0}
