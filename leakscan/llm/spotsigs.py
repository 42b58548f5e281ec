"""Document fingerprints by spot signatures.

At each word (anchor) starts a chain: the anchor and the next content words after it, common words skipped. The set of a
text's chains is its fingerprint. Every word is an anchor at every length of text, so that texts with few or no common
words have spots too and near-equal texts have near-equal sets; a text without any chain falls back on its bytes. Sets
fall into
partitions by length, wide enough that sets in partitions that don't touch can't reach the threshold; within reach they
are compared by a Jaccard that stops as soon as the threshold is out of reach.

Defined results: a null text counts as empty, and the empty text's fingerprint is the empty set, which is like itself
only; rows without id come first in the order of documents; rows with equal ids follow each other by text; other columns
of the input are not looked at; the only row of a table is followed by itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, id_and, mix64, partitions_for, slices, text_buffers, tidy, word_hashes, word_spans
from .toxicity import BETWEEN

#: Common words of the four languages of the corpus: chains skip them.
COMMON = (
    "the a an of and to in is that it for on was as with be by are this at from "
    "der die das und den von zu mit ein eine ist des dem nicht auf für "
    "de la le les et que du un une en pour est dans qui au sur par "
    "el los las y del se por con una para es lo como su"
).split()
#: Content words of a chain.
CHAIN = 2
#: Likeness from which two fingerprints match.
THRESHOLD = 0.8
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _hash_of(words: list[str]) -> np.ndarray:
    data, offsets = text_buffers(pa.array(words))
    return np.sort(word_hashes(data, offsets[:-1], offsets[1:]))


def signatures(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct spot signatures of each text."""
    out, listed = [], _hash_of(sorted(set(COMMON)))
    data, offsets = text_buffers(pa.array(texts, pa.large_string()))
    for a, b in slices(offsets, 1 << 20):
        raw = data[offsets[a] : offsets[b]]
        part = LOWER[raw]
        starts, ends, first = word_spans(part, offsets[a : b + 1] - offsets[a], BETWEEN)
        h = word_hashes(part, starts, ends)
        at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
        common = listed[at] == h if len(h) else np.zeros(0, bool)
        spots, content = np.arange(len(h)), np.flatnonzero(~common)
        next_ = np.searchsorted(content, spots, "right")
        stop = first[np.searchsorted(first, spots, "right")] if len(spots) else spots
        full = next_ + CHAIN <= len(content)
        full[full] &= content[next_[full] + CHAIN - 1] < stop[full]
        spots, next_ = spots[full], next_[full]
        chain = h[spots] * _K[0]
        for i in range(CHAIN):
            chain = (chain ^ h[content[next_ + i]]) * _K[1 + i % 2]
        chain, bounds = mix64(chain), np.searchsorted(spots, first)
        for k in range(b - a):
            own = chain[bounds[k] : bounds[k + 1]]
            if not len(own):
                if offsets[a + k + 1] > offsets[a + k]:
                    whole = hashlib.sha256(raw[offsets[a + k] - offsets[a] : offsets[a + k + 1] - offsets[a]].tobytes()).digest()
                    own = np.frombuffer(whole[:8], np.uint64)
            out.append(np.unique(own))
    return out


def fingerprint(signature: np.ndarray) -> str:
    """The set as text: its length, and its members' high halves in hexadecimal, in order."""
    return f"{len(signature)}:{(signature >> np.uint64(32)).astype('>u4').tobytes().hex()}"


def length_partition(n: int, threshold: float = THRESHOLD) -> int:
    """Sets that reach the threshold are in the same partition or in neighbouring ones; the empty set has one of its own."""
    return int(math.log(n) / -math.log(threshold) + 1e-9) if n else -2


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 as soon as ``threshold`` is out of reach."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if threshold and abs(length_partition(len(a), threshold) - length_partition(len(b), threshold)) > 1:
        return 0.0
    need, common, step = threshold / (1 + threshold) * (len(a) + len(b)) - 1e-9, 0, 256
    for i in range(0, len(a), step):
        part = a[i : i + step]
        common += int((b[np.minimum(np.searchsorted(b, part), len(b) - 1)] == part).sum())
        if common + max(len(a) - i - step, 0) < need:
            return 0.0
    score = common / (len(a) + len(b) - common)
    return score if score >= threshold else 0.0


def matches(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether two sets reach the threshold, told by their length partitions or by a Jaccard that stops early."""
    return likeness(a, b, threshold) > 0


def _in_order(docs: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, text): each bucket holds neighbours in the order of ids, and the next bucket's first as a guest.

    Buckets go to partitions of their own: dealt by hash several meet in one, whose task sorts and holds them all."""
    n = partitions_for(docs)
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), at.alias("at"))
    bounds = sorted(set(docs.select("at").stat.approxQuantile("at", [i / n for i in range(1, n)], 0.5 / n))) if n > 1 else []
    docs = docs.withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("at"))) if bounds else F.lit(0))
    firsts = {r["bucket"]: r["at"] for r in docs.groupBy("bucket").agg(F.min("at").alias("at")).collect()}  # a row for each bucket
    order = sorted(firsts)
    rows = [(firsts[b], order[k - 1]) for k, b in enumerate(order)]
    guests = F.broadcast(docs.sparkSession.createDataFrame(rows, "at long, before int"))
    own, guest = F.struct("bucket", F.lit(0).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guest"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guest))
    both = docs.join(guests, "at", "left").select(F.inline(places), "at", "doc_id", "text")  # texts are read once
    return both.repartitionById(n, "bucket").sortWithinPartitions("bucket", "guest", "at", "text")


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """For each row its fingerprint, that of its edited text, the likeness to that and to the next row's, the partition of
    the fingerprint's length, and whether the two others match it (at ``THRESHOLD``, by the pruned comparison).

    The edited text has its last quarter replaced by as much of the next document's beginning, or all of it."""
    ordered = _in_order(docs.select("doc_id", "text"))
    schema = id_and(ordered, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, length_partition int, edited_matches boolean, next_matches boolean")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_()]

    def rows_of(held: list[tuple]) -> pa.RecordBatch | None:
        """``held``: (bucket, guest, id, text, signature); of each home row the next one is its neighbour."""
        pairs = [(x, y) for x, y in zip(held, held[1:]) if not x[1] and x[0] == y[0]]
        if not pairs:
            return None
        edited = [x[3][: len(x[3]) - len(x[3]) // 4] + y[3][: len(x[3]) // 4] for x, y in pairs]
        rows = [
            (len(x[3]), hashlib.sha256(e.encode()).hexdigest(), fingerprint(x[4]), fingerprint(s), likeness(x[4], s), likeness(x[4], y[4]), length_partition(len(x[4])), matches(x[4], s), matches(x[4], y[4]))
            for (x, y), e, s in zip(pairs, edited, signatures(edited))
        ]
        return pa.RecordBatch.from_arrays([pa.array([x[2] for x, _ in pairs], schema_id), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], schema.names)

    def with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                texts = part.column("text").to_pylist()
                held = [*last, *zip(*(part.column(c).to_pylist() for c in ("bucket", "guest", "doc_id")), texts, signatures(texts))]
                if (out := rows_of(held)) is not None:
                    yield out
                last = held[-1:]

    from pyspark.sql.pandas.types import to_arrow_type

    schema_id = to_arrow_type(ordered.schema["doc_id"].dataType)
    return ordered.select("bucket", "guest", "doc_id", "text").mapInArrow(tidy(with_next), schema)
