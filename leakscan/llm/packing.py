"""Best-fit packing of token sequences.

Documents become token ids, an end id each, and pieces of at most ``capacity`` ids. The bins are planned on the exact
histogram of piece lengths over all documents (at most ``capacity`` numbers, whatever the input): pieces above a third
of a bin go at most two to a bin, matched greedily from the longest down; shorter ones, longest first, go to the
tightest gap left. The plan is a list of runs ("the k-th to the m-th piece of length L go to bins b, b+1, ... at offset
o"), so its size too depends on the capacity alone, and each task places its own pieces.

Defined results: a null or empty text is one piece that holds the end id only; a null id is carried through; repeated
rows are packed one by one; other columns of the input are not looked at; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable, id_and, slices, text_buffers, tidy

END = b"\0\0\0\0"
#: Encoded words a worker keeps in each of two generations: what the older one has and is met again moves to the newer.
WORDS_KEPT = 150_000
#: Bytes of text split at once.
PART = 4 << 20
#: Lower-case Latin letters without marks that could combine, and ASCII punctuation that starts no contraction.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f\xa0-\xb6\xb8-\xbf])+").fullmatch
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: How byte-level vocabularies write bytes as characters: printable ones as themselves, the others from 256 up.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
AS_CHARACTER = {b: b if b in PRINTABLE else 256 + sum(x not in PRINTABLE for x in range(b)) for b in range(256)}


class WordEncoder:
    """Exact ids of whole texts by way of their words.

    The tokenizer drops white space, lower-cases, and never joins letters with punctuation nor what stands on two sides
    of white space. So a text's ids are those of its parts between ASCII white space, one after the other, and those of
    a word of plain letters before punctuation are the word's and the punctuation's. Each distinct part is encoded once
    by the tokenizer; a word of plain letters, which normalising and splitting leave alone, by its BPE model directly.
    Texts that may hold a special token's name are not lower-cased first."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}

    def _learn(self, words: list[bytes]) -> None:
        if len(self.known) > WORDS_KEPT:
            self.known, self.older = {}, self.known
        known, older, ends = self.known, self.older, {}

        def new(some) -> list[bytes]:
            some = [w for w in some if w not in known]
            known.update((w, older[w]) for w in some if w in older)
            return [w for w in some if w not in older]

        plain, other = [], []
        for w in new(words):
            (plain if LETTERS(w) else other).append(w)
        for w in other:
            core = w.rstrip(PUNCTUATION)
            if len(core) < len(w) and LETTERS(core):
                ends[w] = core, w[len(core) :]
        plain = {*plain, *new({core for core, _ in ends.values()})}
        whole = {w for w in other if w not in ends}.union(new({end for _, end in ends.values()}))
        merge = self.tokenizer.model.tokenize
        known.update((w, array("I", [t.id for t in merge(w.decode("latin-1").translate(AS_CHARACTER))]).tobytes()) for w in plain)
        rest = list(whole)
        for k in range(0, len(rest), 10_000):
            part = rest[k : k + 10_000]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, found))
        known.update((w, known[a] + known[b]) for w, (a, b) in ends.items())

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a string column as little-endian unsigned 32-bit numbers; a null counts as empty.

        Arrow splits the texts and numbers their distinct words, so only those are looked up one by one."""
        text, offsets = text_buffers(column)
        for a, b in slices(offsets, PART):  # arrays of their own: ascii_lower misreads one whose first offset isn't 0
            texts = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(offsets[a : b + 1] - offsets[a]), pa.py_buffer(text[offsets[a] : offsets[b]]))
            words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
            coded, first = words.flatten().dictionary_encode(), words.offsets.to_numpy()
            distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
            self._learn(distinct)
            ids = pa.array(list(map(self.known.__getitem__, distinct)), pa.large_binary()).take(coded.indices)
            at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[first].tolist()
            data = memoryview(ids.buffers()[2] or b"")
            yield from (bytes(data[i:j]) for i, j in zip(at, at[1:]))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of that file, kept for its next tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): rank counts the earlier pieces of that length in the task."""
    schema = id_and(docs, "piece int, start long, length long, ids_crc32 long, part int, rank long")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = encoder(tokenizer_path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for k, ids in enumerate(words.encode(batch.column(1))):
                ids += END
                for p in range(0, len(ids) // 4, capacity):
                    chunk = ids[4 * p : 4 * (p + capacity)]
                    n = len(chunk) // 4
                    rows.append((k, p // capacity, p, n, zlib.crc32(chunk), seen[n]))
                    seen[n] += 1
            k, *cols = zip(*rows) if rows else [()] * 6
            names = ("int32", "int64", "int64", "int64")
            out = [batch.column(0).take(pa.array(k, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, names)), pa.array([part] * len(rows), pa.int32()), pa.array(cols[-1], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(pieces), schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, pieces in a bin, offset in the bin) for ``counts`` pieces of each length."""
    runs, used, left = [], 0, {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int, int]]] = {}  # gap -> (first bin, bins, filled)

    def put(n: int, first: int, bins: int, each: int, offset: int) -> None:
        runs.append((n, rank[n], first, each, offset))
        rank[n] += bins * each
        left[n] -= bins * each

    def keep(first: int, bins: int, filled: int) -> None:
        if bins and filled < capacity:
            gaps.setdefault(capacity - filled, []).append((first, bins, filled))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else 0
        if b == a and left[a] < 2:
            at -= 1
            b = large[at] if at >= 0 else 0
        bins = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        if a == b:
            put(a, used, bins, 2, 0)
        else:
            put(a, used, bins, 1, 0)
            if b:
                put(b, used, bins, 1, a)
        keep(used, bins, a + b)
        used += bins
        large = [n for n in large if left[n]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            fits = [g for g in gaps if g >= n]
            if not fits:
                each = capacity // n
                bins = -(-left[n] // each)
                gaps[capacity] = [(used, bins, 0)]
                used += bins
                continue
            gap = min(fits)
            first, bins, filled = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            each = min(gap // n, left[n])
            take = min(bins, left[n] // each)
            put(n, first, take, each, filled)
            keep(first, take, filled + each * n)
            keep(first + take, bins - take, filled)
    return runs


def place(pieces: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """``pieces`` (with length and global ``rank``) with sequence_id and offset."""
    runs = sorted(runs)
    keys = np.array([(n << 40) + r for n, r, *_ in runs], np.int64)
    first, each, offset, start = (np.array([x[i] for x in runs], np.int64) for i in (2, 3, 4, 1))
    names = [c for c in pieces.columns if c != "rank"]
    schema = id_and(pieces, "sequence_id long, offset long", *names)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(keys, (n << 40) + r, "right") - 1
            inside = r - start[k]
            out = [first[k] + inside // each[k], offset[k] + inside % each[k] * n]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *map(pa.array, out)], schema.names)

    return pieces.mapInArrow(tidy(placed), schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Each piece of each document with its sequence and place there."""
    pieces = durable(token_pieces(docs, tokenizer_path, capacity), "pieces")
    counts = durable(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = counts.select("part", "length", before.alias("before")).hint("merge")  # a row for each task and length: it grows with the input
    ranked = pieces.join(earlier, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return place(ranked, plan(histogram, capacity))
