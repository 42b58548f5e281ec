"""Suffix-array dedup: every byte covered by a string of ``least`` bytes that also starts elsewhere.

Each window of ``least`` bytes is dealt to an anchor: of the 16-byte grams in it, the one with the least hash (the last of
equals). Equal windows have equal anchors, so all windows of an anchor form one segment of text and only segments with
equal anchors need comparing. Segments that are equal as a whole (most of what copies and shared passages give) are
settled by an aggregate. Of the others one of each kind goes to its anchor's group. Equal windows have their anchor at one
distance, so a group needs no array of all its windows: one enhanced suffix array has what follows the anchors, another what
stands before them, read backwards, and the least common prefixes between two segments' places in both give the run of
windows that the two share. A group with more than ``GROUP`` different segments (ends of a passage that very many documents share) is dealt again: its segments are cut into blocks of
neighbouring windows, and the bytes that all windows of a block share, together with the anchor, are the key of the next
groups, which go the same way; blocks get smaller until one is a single window, so each window is in a group that fits.
A segment gives a bounded number of blocks, whatever the size of its group. What goes back to the documents is the
complement: the runs of windows met once.

Where runs of ``words`` words are asked for too, every byte from the first to the last word of a run of so many words that
also starts elsewhere is covered, whatever white space parts the words and however few bytes they have. Windows of words are
anchored and cut into segments like windows of bytes; where an anchor has different segments, their windows are counted by
hash, which needs no groups.

Anchors and segments are compared by 64-bit hashes, as are windows of words; windows in suffix arrays by their bytes.

Defined results: null and empty texts have no bytes and nothing is removed; texts shorter than ``least`` lose nothing; a
null id is carried through; repeated rows are copies of each other, and copies of ``least`` bytes or more go wholly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BYTE_CODE, discard, durable, id_and, mix64, partitions_for, powers, slices, text_buffers, tidy, word_hashes, word_spans

LEAST = 400
#: Words from which a passage that stands elsewhere is a repeat.
PASSAGE = 51
GRAM = 16
#: Words of a gram that anchors windows of words.
WORD_GRAM = 8
#: Different segments of a group up to which its suffix arrays are built and its pairs compared in one task.
GROUP = 1024
#: Windows of a block when a larger group is dealt again, then again.
BLOCKS = (32, 8, 1)
STEP = 0x9E3779B97F4A7C15 | 1
STEP_INV = pow(STEP, -1, 1 << 64)
#: Low bits of a sort key that hold a place; the rest of the key is the hash's high part. Spark's strings are shorter than 2**31.
PLACE_BITS = 31


def code_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the codes (of bytes or words) before each place, each times its place's power, and the powers' inverses."""
    size = len(codes)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(codes * powers(STEP, size + 1)[:size], out=total[1:])
    return total, powers(STEP_INV, size + 1)


def window_hashes(codes: np.ndarray, n: int, sums: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The hash of the ``n`` codes (of bytes or words) from each place that has as many."""
    size = len(codes)
    if size < n:
        return np.zeros(0, np.uint64)
    total, inverse = sums or code_sums(codes)
    return mix64((total[n:] - total[:-n]) * inverse[: size - n + 1])


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Place of the least high part of each ``n`` neighbours, the last of equals, from running minima of blocks."""
    size, low = len(x), np.uint64((1 << PLACE_BITS) - 1)
    if size > int(low):
        raise ValueError(f"a text of more than {int(low)} bytes")
    blocks = -(-size // n)
    keys = np.full(blocks * n, np.uint64(0xFFFFFFFFFFFFFFFF))
    keys[:size] = (x & ~low) | (low - np.arange(size, dtype=np.uint64))
    ahead = np.minimum.accumulate(keys.reshape(blocks, n), axis=1).ravel()
    back = np.minimum.accumulate(keys.reshape(blocks, n)[:, ::-1], axis=1)[:, ::-1].ravel()
    return (low - (np.minimum(back[: size - n + 1], ahead[n - 1 : size]) & low)).astype(np.int64)


def segments(codes: np.ndarray, least: int, gram: int = GRAM):
    """For a text's codes: each anchor's hash, its segment's first window, number of windows, place of the anchor in it, and the segment's hash."""
    total, inverse = sums = code_sums(codes)
    grams = window_hashes(codes, gram, sums)
    place = sliding_least(grams, least - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(first, len(place)))
    whole = mix64((total[first + count + least - 1] - total[first]) * inverse[first] ^ mix64(count.astype(np.uint64)))
    offset = place[first] - first
    return grams[place[first]], first, count, offset, mix64(whole ^ (offset.astype(np.uint64) * np.uint64(STEP)))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__k``, a hash of id and text: rows with equal keys are equal rows and get equal results."""
    return docs.withColumn("__k", F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")))


def text_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: its words' codes, and where in its bytes they begin and end."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets, 1 << 20):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        begin, end, first = word_spans(part, at)
        codes = word_hashes(part, begin, end)
        for k in range(b - a):
            own = slice(first[k], first[k + 1])
            yield codes[own], begin[own] - at[k], end[own] - at[k]


def _text_codes(column: pa.Array, words: bool) -> Iterator[np.ndarray]:
    if words:
        yield from (codes for codes, _, _ in text_words(column))
    else:
        data, offsets = text_buffers(column)
        yield from (BYTE_CODE[data[offsets[k] : offsets[k + 1]]] for k in range(len(column)))


def text_segments(docs: DataFrame, least: int, words: bool = False) -> DataFrame:
    """(anchor, segment, n, k, first, windows, at): the different segments of a batch of keyed texts, how often the batch has
    each, and where one of them is; ``at`` is the anchor's place in the segment. Places are those of bytes or of ``words``."""
    gram = min(WORD_GRAM if words else GRAM, least)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = b.column(0).to_numpy(), []
            for k, codes in enumerate(_text_codes(b.column(1), words)):
                if len(codes) >= least:
                    anchor, first, count, at, whole = segments(codes, least, gram)
                    out.append((anchor.view(np.int64), whole.view(np.int64), np.full(len(first), keys[k]), first, count, at))
            if out:
                anchor, whole, key, first, count, at = (np.concatenate(c) for c in zip(*out))
                whole, one, n = np.unique(whole, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor[one], whole, n, key[one], first[one], count[one], at[one])], ["anchor", "segment", "n", "k", "first", "windows", "at"])

    return docs.select("__k", F.col("text").cast("string")).mapInArrow(tidy(rows), "anchor long, segment long, n long, k long, first long, windows long, at long")


def suffix_array(texts: list[bytes], starts: list[int]) -> list[tuple[int, int]]:
    """(text, place) of all suffixes from places below ``starts[text]``, in order."""
    every = [(t, i) for t, n in enumerate(starts) for i in range(n)]
    return sorted(every, key=lambda s: texts[s[0]][s[1] :])


def common_prefixes(texts: list[bytes], order: list[tuple[int, int]], least: int) -> list[int]:
    """Of each suffix and the one before: the length of what both start with (0 if below ``least``)."""
    out = [0]
    for (a, i), (b, j) in zip(order, order[1:]):
        x, y = texts[a], texts[b]
        if x[i : i + least] != y[j : j + least]:
            out.append(0)
            continue
        low, high = least, min(len(x) - i, len(y) - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if x[i + low : i + mid] == y[j + low : j + mid] else (low, mid - 1)
        out.append(low)
    return out


def maximal_repeats(texts: list[bytes], starts: list[int], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences) of each maximal repeat of ``least`` bytes or more among the texts' suffixes, for texts without anchors.

    A stack scan finds the intervals of the common-prefix tree; an interval counts if the bytes on the left of its
    suffixes are not all the same (a suffix at a text's start differs from all others)."""
    order = suffix_array(texts, starts)
    lcp = [*common_prefixes(texts, order, least), 0]
    left = [texts[t][i - 1] if i else -1 - k for k, (t, i) in enumerate(order)]
    found, stack = [], []  # stack: (length, first suffix, left bytes met)
    for k in range(1, len(lcp)):
        first, met = k - 1, {left[k - 1]}
        while stack and stack[-1][0] > lcp[k]:
            length, first, seen = stack.pop()
            seen |= met
            if len(seen) > 1:
                found.append((length, order[first:k]))
            met = seen
        if lcp[k]:
            if stack and stack[-1][0] == lcp[k]:
                stack[-1][2].update(met)
            else:
                stack.append((lcp[k], first, met))
    return found


def prefix_array(texts: list[bytes], group: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The texts of each group in order, and how many bytes each has in common with the one before (-1: it is its group's first)."""
    order = sorted(range(len(texts)), key=lambda i: (group[i], texts[i]))
    lcp = np.full(len(order), -1)
    for k, (a, b) in enumerate(zip(order, order[1:]), 1):
        if group[a] == group[b]:
            n = min(len(texts[a]), len(texts[b]))
            differ = int.from_bytes(texts[a][:n], "big") ^ int.from_bytes(texts[b][:n], "big")
            lcp[k] = n - (differ.bit_length() + 7) // 8
    return np.array(order), lcp


def anchored_repeats(texts: list[bytes], at: np.ndarray, group: np.ndarray, least: int) -> np.ndarray:
    """For each text and distance: does the window that begins so far before the text's anchor (its byte ``at``) stand in
    another text of its group, as far before the anchor there? Windows of equal bytes always do. Groups are numbered upwards.

    What follows the anchors makes one suffix array for each group, what stands before them, read backwards, another. The
    least common prefix between two places of an array is what the texts there have in common on that side, so the two
    give the run of distances at which a pair shares its windows."""
    numbers, most = group.tolist(), int(np.bincount(group - group[0]).max())
    ahead, right = prefix_array([t[a:] for t, a in zip(texts, at.tolist())], numbers)
    back, left = prefix_array([t[:a][::-1] for t, a in zip(texts, at.tolist())], numbers)
    rank = np.empty_like(back)
    rank[back] = np.arange(len(back))
    least_left, log = [left], np.zeros(most + 1, np.int64)  # row r: the least of 2**r neighbours
    while 2 ** len(least_left) < most:
        half, low = 2 ** (len(least_left) - 1), least_left[-1].copy()
        low[:-half] = np.minimum(low[:-half], least_left[-1][half:])
        least_left.append(low)
        log[2 * half :] += 1
    least_left, right = np.stack(least_left), np.append(right, -1)
    width = int(at.max()) + 2
    change = np.zeros(len(texts) * width, np.int32)
    place, low, wanted = np.arange(len(texts)), np.full(len(texts), least), least - at[ahead]
    for step in range(1, most):
        low = np.minimum(low, right[np.minimum(place + step, len(texts))])
        near = low >= wanted[place]
        place, low = place[near], low[near]
        if not len(place):
            break
        one, other = ahead[place], ahead[place + step]
        a, z = np.minimum(rank[one], rank[other]) + 1, np.maximum(rank[one], rank[other])
        r = log[z - a + 1]
        common = np.minimum(least_left[r, a], least_left[r, z - (1 << r) + 1])
        found = np.flatnonzero(common >= least - low)
        for t in (one[found], other[found]):
            np.add.at(change, t * width + (least - low[found]), 1)
            np.add.at(change, t * width + common[found] + 1, -1)
    return np.cumsum(change.reshape(-1, width), axis=1)[:, :-1] > 0


def _group_unique(least: int):
    """For rows (anchor, segment, n, k, first, at, bytes) sorted by anchor: runs (k, begin, end) of windows that no other
    segment of the anchor has. No window is twice in a segment: both would have its anchor at one distance."""

    def settle(b: pa.RecordBatch) -> pa.RecordBatch:
        anchor, _, n, k, first, at = (c.to_numpy() for c in b.columns[:6])
        texts = b.column(6).to_pylist()
        shared = anchored_repeats(texts, at, np.cumsum(np.diff(anchor, prepend=anchor[:1]) != 0), least)
        windows = np.array([len(t) for t in texts]) - (least - 1)
        far = np.arange(shared.shape[1])
        alone = ~shared & (far <= at[:, None]) & (far > (at - windows)[:, None]) & (n == 1)[:, None]
        edge = np.diff(np.pad(alone.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, near = np.nonzero(edge == 1)
        far = np.nonzero(edge == -1)[1] - 1
        anchors = first[row] + at[row]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k[row], anchors - far, anchors - near + 1)], ["k", "begin", "end"])

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_groups(batches):
            anchor = b.column(0).to_numpy()
            starts = np.append(np.flatnonzero(np.diff(anchor, prepend=anchor[:1]) != 0), len(anchor))
            starts = np.concatenate([[0], starts])
            for i, j in slices(starts, GROUP):
                yield settle(b.slice(starts[i], starts[j] - starts[i]))

    return unique


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, cut anew so that rows with equal values are in one; of rows that are also equal in
    the second, one is left (a repeated row of the input gives its segments twice)."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.concat_batches([held, b])
        anchor, segment = (c.to_numpy() for c in b.columns[:2])
        order = np.lexsort((segment, anchor))
        new = np.append(True, (np.diff(anchor[order]) != 0) | (np.diff(segment[order]) != 0))
        if not new.all():
            b = b.take(pa.array(np.sort(order[new])))
            anchor = b.column(0).to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut:
            yield b.slice(0, cut)
        held = b.slice(cut)
    if held is not None:
        yield held


def covered_bytes(size: int, alone: list[tuple[int, int]], least: int) -> tuple[list[int], list[int]]:
    """Maximal runs of bytes under windows outside the sorted runs ``alone``; runs that touch are one."""
    begin, end, at, last = [], [], 0, size - least + 1
    for a, z in [*alone, (last, last)]:
        if a > at:
            if end and at <= end[-1]:
                end[-1] = a - 1 + least
            else:
                begin.append(at)
                end.append(a - 1 + least)
        at = max(at, z)
    return begin, end


def _span_bytes(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``wanted`` (anchor, segment, n, kinds, k, first, windows, at) with the bytes of its segments in place of windows."""
    fields = ("anchor", "segment", "n", "kinds", "k", "first", "at")
    end = (F.col("first") + F.col("windows") + (least - 1)).alias("end")
    each = wanted.groupBy(F.col("k").alias("__k")).agg(F.collect_set(F.struct(*fields, end)).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column(0))
            for i in range(0, b.num_rows, 512):
                rows = []
                for k, spans in enumerate(b.column(1).slice(i, 512).to_pylist(), i):
                    text = data[offsets[k] : offsets[k + 1]].tobytes()
                    rows += [(*(s[f] for f in fields), text[s["first"] : s["end"]]) for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * len(fields) + [pa.binary()])], [*fields, "bytes"])

    return docs.select("__k", "text").join(each, "__k").select(F.col("text").cast("string"), "spans").mapInArrow(tidy(cut), ", ".join(f"{f} long" for f in fields) + ", bytes binary")


def _blocks(rows: DataFrame, size: int, least: int) -> DataFrame:
    """Segments cut into blocks of ``size`` windows, counted from the anchor back: (anchor, segment, n, k, first, at, bytes).

    The new ``anchor`` is a hash of the old one, the block's number and the bytes that all windows of such a block share
    (a segment that ends inside a block has them too): equal windows meet again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                out: list[tuple] = []
                for anchor, n, k, first, at, text in zip(*(c.to_pylist() for c in b.slice(i, 1024).columns)):
                    windows, j = len(text) - least + 1, 0
                    while j < windows:
                        number = (at - j) // size  # windows of a block start at most size * number + size - 1 before the anchor
                        stop = min(at - number * size + 1, windows)
                        core = text[at - number * size : at - number * size - size + 1 + least]
                        part = text[j : stop - 1 + least]
                        out.append((_digest(core, anchor, number), _digest(part, at - j, 0), n, k, first + j, at - j, part))
                        j = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 6 + [pa.binary()])], ["anchor", "segment", "n", "k", "first", "at", "bytes"])

    found = rows.select("anchor", "n", "k", "first", "at", "bytes").mapInArrow(tidy(cut), "anchor long, segment long, n long, k long, first long, at long, bytes binary")
    return found.groupBy("anchor", "segment").agg(F.sum("n").alias("n"), F.min(F.struct("k", "first", "at", "bytes")).alias("one")).select("anchor", "segment", "n", "one.*")


def _digest(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)


def _with_kinds(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (a stored table) with ``kinds``: how many there are of each anchor, null for one."""
    sizes = durable(rows.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), name, swept=True)
    return rows.join(sizes, "anchor", "left")


def segment_kinds(docs: DataFrame, least: int, words: bool = False) -> DataFrame:
    """The different segments of the keyed ``docs``: (anchor, segment, n, k, first, windows, at, kinds)."""
    cuts = text_segments(docs, least, words).groupBy("anchor", "segment").agg(F.sum("n").alias("n"), F.min(F.struct("k", "first", "windows", "at")).alias("one"))
    return _with_kinds(durable(cuts.select("anchor", "segment", "n", "one.*"), "kinds", swept=True), "sizes")


def array_groups(docs: DataFrame, kinds: DataFrame, least: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Round by round: the rows that are alone in their group, and those of groups that fit one suffix array, in order."""
    alone = kinds.where("kinds is null").select("anchor", "segment", "n", "k", "first", "windows")
    rows = durable(_span_bytes(docs, kinds.where("kinds > 1"), least), "bytes", swept=True)
    for size in (*BLOCKS, 0):
        small = rows.where(F.col("kinds") <= GROUP).select("anchor", "segment", "n", "k", "first", "at", "bytes")
        yield alone, small.repartition(partitions_for(docs), "anchor").sortWithinPartitions("anchor")
        large = rows.where(F.col("kinds") > GROUP)
        if not size or not large.take(1):
            return
        counted = _with_kinds(durable(_blocks(large, size, least), "blocks", swept=True), "sizes")
        alone = counted.where("kinds is null").select("anchor", "segment", "n", "k", "first", (F.length("bytes") - (least - 1)).alias("windows"))
        rows = durable(counted.where("kinds > 1"), "bytes", swept=True)


def unique_windows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(k, begin, end): runs of windows of the keyed ``docs`` that stand nowhere else. All other windows are repeated."""
    found = []
    for alone, grouped in array_groups(docs, segment_kinds(docs, least), least):
        found.append(alone.where("n = 1").select("k", F.col("first").alias("begin"), (F.col("first") + F.col("windows")).alias("end")))
        found.append(grouped.mapInArrow(tidy(_group_unique(least)), "k long, begin long, end long"))
    return reduce(DataFrame.unionByName, found)


def unique_word_windows(docs: DataFrame, least: int) -> DataFrame:
    """(k, runs), stored: runs of windows of ``least`` words of the keyed ``docs`` that stand nowhere else, places in words.

    A segment whose anchor has no other kind is settled whole; of the others each window is counted. Runs that touch are one,
    so a text that shares nothing has one run."""
    kinds = segment_kinds(docs, least, words=True)
    each = kinds.where("kinds > 1").groupBy(F.col("k").alias("__k")).agg(F.collect_list(F.struct("n", "first", "windows")).alias("spans"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part, out = b.slice(a, 512), []
                for key, spans, (codes, _, _) in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), text_words(part.column(1))):
                    found = window_hashes(codes, least).view(np.int64)
                    for s in spans:
                        place = np.arange(s["first"], s["first"] + s["windows"])
                        out.append((found[place], np.full(len(place), s["n"]), np.full(len(place), key), place))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["window", "n", "k", "begin"])

    counted = docs.select("__k", F.col("text").cast("string")).join(each, "__k").mapInArrow(tidy(windows), "window long, n long, k long, begin long")
    once = counted.groupBy("window").agg(F.sum("n").alias("n"), F.min(F.struct("k", "begin")).alias("one")).where("n = 1").select("one.*")
    whole = kinds.where("kinds is null and n = 1").select("k", F.col("first").alias("begin"), (F.col("first") + F.col("windows")).alias("end"))
    each = whole.unionByName(once.withColumn("end", F.col("begin") + 1)).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, runs = b.column(1).offsets.to_numpy(), b.column(1).flatten()
            begin, end = (runs.field(i).to_numpy() for i in (0, 1))
            if len(begin):
                new = np.concatenate([[True], begin[1:] != end[:-1]])
                new[offsets[:-1] - offsets[0]] = True
                at = np.flatnonzero(new)
                lists = pa.StructArray.from_arrays([begin[at], end[np.append(at[1:], len(end)) - 1]], ["begin", "end"])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.searchsorted(at, offsets - offsets[0]).astype(np.int32), lists)], ["k", "runs"])

    stored = durable(each.mapInArrow(tidy(merged), "k long, runs array<struct<begin: long, end: long>>"), "words", swept=True)
    discard(kinds)
    return stored


def repeated_windows(count: int, alone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of ``count`` windows outside the sorted runs ``alone``."""
    edges = [0, *(x for run in alone for x in run), max(count, 0)]
    return [(a, z) for a, z in zip(edges[::2], edges[1::2]) if a < z]


def joined_runs(runs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs that the given ones make; runs that touch are one."""
    begin, end = [], []
    for a, z in sorted(runs):
        if end and a <= end[-1]:
            end[-1] = max(end[-1], z)
        else:
            begin.append(a)
            end.append(z)
    return begin, end


def remove_repeats(docs: DataFrame, least: int = LEAST, into: str = "repeats", with_text: bool = True, words: int = 0, cut_words: bool = True) -> DataFrame:
    """``docs`` with a struct ``into``: n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``, the kept text.

    With ``words``, runs of so many words that stand elsewhere go too; without ``cut_words`` they stay and are counted as
    n_passages (maximal runs) and n_passage_bytes."""
    names, source = docs.columns, keyed(docs)
    found = None
    if words:
        found = unique_word_windows(source, words).select(F.col("k").alias("__k"), F.col("runs").alias("__words"))
    alone = unique_windows(source, least).groupBy(F.col("k").alias("__k")).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("__alone"))
    counts = ("n_bytes", "n_removed", "n_spans", *(("n_passages", "n_passage_bytes") if words and not cut_words else ()))
    schema = id_and(docs, f"`{into}` struct<{', '.join(f'{c}: long' for c in counts)}, kept_sha256: string, kept_text: string>", *names)
    kind = pa.struct([*((c, pa.int64()) for c in counts), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                data, offsets = text_buffers(b.column(0))
                data, out = data.tobytes(), []
                parted = zip(b.column(2).to_pylist(), text_words(b.column(0))) if words else repeat(None)
                for k, (found, by_words) in enumerate(zip(b.column(1).to_pylist(), parted)):
                    text = data[int(offsets[k]) : int(offsets[k + 1])]
                    begin, end = covered_bytes(len(text), [(s["begin"], s["end"]) for s in found or ()], least)
                    passages = [], []
                    if words:
                        alone, (codes, start, stop) = by_words
                        runs = repeated_windows(len(codes) - words + 1, [(s["begin"], s["end"]) for s in alone or ()])
                        passages = joined_runs([(int(start[i]), int(stop[j + words - 2])) for i, j in runs])
                        if cut_words:
                            begin, end = joined_runs([*zip(begin, end), *zip(*passages)])
                    kept = b"".join(text[i:j] for i, j in zip([0, *end], [*begin, len(text)]))
                    out.append({"n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(begin), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept_text": kept.decode("utf-8", "ignore") if with_text else None, "n_passages": len(passages[0]), "n_passage_bytes": sum(passages[1]) - sum(passages[0])})
                yield pa.RecordBatch.from_arrays([*b.columns[3 if words else 2 :], pa.array(out, kind)], schema.names)

    joined, lists = source.join(alone, "__k", "left"), ["__alone"]
    if words:
        joined, lists = joined.join(found, "__k", "left"), ["__alone", "__words"]
    joined = joined.select(F.col("text").cast("string").alias("__text"), *lists, *(F.col(f"`{n}`") for n in names))
    return joined.mapInArrow(tidy(cut), schema)
