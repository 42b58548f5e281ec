"""The pipeline's stages, one by one and as a whole, against brute force on a small table."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from leakscan.llm import quality, stages, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["an", "er", "th", "ou", "ing", "st", "le"]) for _ in range(rnd.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = prose(120)
    texts = [prose(rnd.randint(40, 90)) for _ in range(150)]
    texts += [t + " vile nasty " + prose(5) for t in texts[:40]]
    texts += [" ".join(w + "###" for w in prose(50).split()) for _ in range(30)]
    base = prose(100)
    texts += [base, base, base.upper(), base + " end", prose(60) + "\n" + passage + "\n" + prose(30), prose(50) + " " + passage, "x " * 300, None, "", "one two"]
    out = [(i, t, "en" if i % 3 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*out, (None, prose(70), None, None, None), out[150 + 40 + 30], out[3]]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    where, table = str(tmp_path_factory.mktemp("sf")), rows()
    more = [(*r, 0.5, True, "q", "r") for r in table]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, quality string, repeats string"
    spark.createDataFrame(more, kind).repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = [(i, int("#" not in (t or "#")), int(" vile " in (t or ""))) for i, t, *_ in table if i is not None and i < 220]
    spark.createDataFrame([*labels, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def words(text):
    return WORD.findall(text or "")


def n_repeat_words(text):
    w = words(text)
    seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    return len({k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)})


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def first_of_each(table):
    sets = {r[0]: shingles(r[1]) for r in table if r[0] is not None}
    root = {i: i for i in sets}
    for _ in sets:
        before = dict(root)
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    return [r for r in table if r[0] is None or root[r[0]] == r[0]]


def without_repeats(table, least=400):
    data = [(r[1] or "").encode() for r in table]
    seen = collections.Counter(b[k : k + least] for b in data for k in range(len(b) - least + 1))
    out = []
    for r, b in zip(table, data):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - least + 1):
            if seen[b[k : k + least]] > 1:
                gone[k : k + least] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore") if gone.any() else r[1]
        out.append((*r[:1], kept, *r[2:4], None if kept is None else len(kept)))
    return out


def test_whole(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    table = sorted(rows(), key=repr)
    model = toxicity.train(toxicity.labelled_sample(docs.select(*stages.COLUMNS), labels))

    def score(text):
        import pyarrow as pa

        return float(np.concatenate([model.scores(t, first) for t, first in toxicity.token_rows(pa.array([text], pa.string()))])[0])

    now, want = stages.toxicity_stage(spark, docs, data), [r for r in table if score(r[1]) < model.bounds.get(r[2], toxicity.BOUND)]
    assert plain(now) == want and 150 < len(want) < len(table) - 30 and now.columns == stages.COLUMNS
    rules = quality.learn_rules(quality.labelled_stats(now, labels))
    ratio = lambda t: {"symbols_per_word": len(re.findall(r"[#*$%&|<>]", t or "")) / max(len(words(t)), 1), "mean_word": len("".join(words(t))) / max(len(words(t)), 1)}
    assert rules.rules and {t.feature for r in rules.rules for t in r} <= {"symbols_per_word", "mean_word"}
    now, want = stages.quality_stage(spark, now, data), [r for r in want if len(words(r[1])) >= 10 and 100 * n_repeat_words(r[1]) <= 20 * len(words(r[1])) and rules.keeps(ratio(r[1]))]
    assert plain(now) == want and not any("#" in r[1] for r in want)
    now, want = stages.jaccard_stage(spark, now, data), first_of_each(want)
    assert plain(now) == want
    now, want = stages.repeats_stage(spark, now, data), sorted(without_repeats(want), key=repr)
    assert plain(now) == want and any(a[1] != b[1] for a, b in zip(want, sorted(rows(), key=repr)))
    got = corpus_pipeline.run(spark, data).collect()
    from tokenizers import Tokenizer

    t, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), collections.Counter()
    for r in want:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        pieces.update((r[0], p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes())) for p in range(0, len(ids), 2048))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    held = collections.Counter()
    for r in got:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 2048


def test_without_rows_or_labels(spark, data, tmp_path):
    """An empty table goes through all stages; without labels nothing is learned and clean documents stay."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    spark.read.parquet(f"{data}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in stages.STAGES:
        none = stage(spark, docs.where("false"), data)
        assert none.count() == 0
    assert stages.toxicity_stage(spark, docs, str(tmp_path)).count() == docs.count()
    kept = stages.quality_stage(spark, docs, str(tmp_path))
    assert kept.columns == stages.COLUMNS and any("#" in r["text"] for r in kept.collect())


def without_passages(table, least, words):
    """Brute force: bytes under a string of ``least`` bytes, or from the first to the last of so many ``words``, that stand elsewhere."""
    data = [(r[1] or "").encode() for r in table]
    seen = collections.Counter(b[k : k + least] for b in data for k in range(len(b) - least + 1))
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in data]
    runs = [[tuple(b[x:y] for x, y in s[k : k + words]) for k in range(len(s) - words + 1)] for b, s in zip(data, spans)]
    met = collections.Counter(x for r in runs for x in r)
    out = []
    for r, b, s, w in zip(table, data, spans, runs):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - least + 1):
            if seen[b[k : k + least]] > 1:
                gone[k : k + least] = True
        for k, x in enumerate(w):
            if met[x] > 1:
                gone[s[k][0] : s[k + words - 1][1]] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore") if gone.any() else r[1]
        out.append((*r[:1], kept, *r[2:4], None if kept is None else len(kept)))
    return out


def test_short_passages(spark):
    """Passages of over 50 words go whatever their bytes; 50 words don't, nor does what stands once."""
    rnd = random.Random(4)
    prose = lambda n: " ".join(rnd.choice("an er th ou ing st le de ó né".split()) + rnd.choice("abcdefg") for _ in range(n))
    long, short, edge = prose(55), prose(50), prose(51)
    texts = [prose(40) + "\n" + long + "\n" + prose(30), prose(35) + " " + long.replace(" ", "\n", 7) + "  " + prose(9), long, prose(20) + " " + short + " " + prose(20), short + " " + prose(60)]
    texts += [edge, prose(30) + "\t" + edge, prose(300), prose(25) + " " + long[: len(long) // 2], None, "", "one two", " \n "]
    texts += [prose(10) + " " + long + " " + prose(k) for k in range(20, 26)]  # kinds of one anchor
    texts += [prose(4) + " " + long + "   " + edge + " " + prose(4)]  # two passages side by side: the space between them stays
    twice = prose(52) + "."
    texts += [prose(5) + " " + twice + " " + prose(12) + " " + twice]  # in one document
    table = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    table += [(7, texts[7], "en", "s", len(texts[7])), (None, edge + " end", None, None, None)]
    assert max(map(len, (long.encode(), twice.encode()))) < 400
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(map(tuple, stages.repeats_stage(spark, df, "").collect()), key=repr)
    want = without_passages(table, 400, 51)
    assert got == sorted(want, key=repr)
    assert want[2][1] == want[5][1] == want[7][1] == "" and [want[i][1] for i in (3, 4, 8)] == [texts[i] for i in (3, 4, 8)]
    assert not any(long[5:-5] in (r[1] or "") for r in got) and all(len(without_repeats(table)[i][1]) == len(texts[i]) for i in (0, 1, 2, 5, 6))
