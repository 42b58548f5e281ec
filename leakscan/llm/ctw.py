"""Language-model scores by context-tree weighting over bytes.

A text's bytes, and an end byte 0, are coded as eight binary decisions each, in the context of the ``DEPTH`` bytes before.
Every node (context of up to DEPTH bytes, bits so far) has a Krichevsky-Trofimov estimate from the training counts, and
the weighted probability of a node is half its own estimate and half the product of its children's. A decision's
probability mixes the estimates of all depths by these weights; contexts never met in training don't take part.

Everything is counted in the corpus and stays distributed. One pass over the texts cuts them into blocks of about ``BLOCK``
bytes and writes the texts with their block's number, and of each block its distinct grams and words with training counts,
sorted and packed, in ``BUCKETS`` buckets by the two newest bytes of context (words: by hash). Counts of a bucket are added up
over groups of blocks, then over groups of groups; each bucket's subtrees of two bytes of context are weighted in one task
(their size depends on DEPTH, not on the corpus), the two top levels (256 contexts at most) on the driver; then each bucket's
probabilities go back to the groups of blocks, and so to the texts. A word is known by a 64-bit hash.

Defined results: a null or empty text is coded as its end alone; a null id never trains ("not held out" needs an id); a
table without training rows gives each decision one half; repeated rows count each time; other columns of the input are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import LOWER, durable, id_and, mix64, shared_path, slices, text_buffers, tidy, word_hashes, word_spans

DEPTH = 5
#: Bytes of text of a block, about (a longer text stands alone), and of what is sorted at once.
BLOCK = 12 << 20
SLICE = 1 << 22
#: Bytes of text that are packed together, about.
RUN = 1 << 19
#: Buckets of grams, by the two newest bytes of context, and of words.
BUCKETS, WORDS = 256, 16
#: Blocks whose counts are added up at once, about.
FAN = 48


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2) - log gamma(1/2) by Stirling's series (exact sums for small n)."""
    n = n.astype(np.float64)
    x = n + 0.5
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(64) + 0.5))])
    big = np.maximum(x, 32)
    series = (big - 0.5) * np.log(big) - big + 0.5 * np.log(2 * np.pi) + 1 / (12 * big) - 1 / (360 * big**3)
    return np.where(n < 64, small[np.minimum(n, 64).astype(np.int64)], series - 0.5 * np.log(np.pi))


def log_factorial(n: np.ndarray) -> np.ndarray:
    n = n.astype(np.float64)
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 64)))])
    x = np.maximum(n + 1, 32)
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 64, small[np.minimum(n, 63).astype(np.int64)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov estimate of a sequence with these counts."""
    return log_gamma_half(zeros) + log_gamma_half(ones) - log_factorial(zeros + ones)


class Level:
    """The binary nodes of one depth and bit position: sorted ids (context bits, then bits so far) and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bit: int):
        of = keys >> np.uint64(8 - bit)
        new = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        self.ids, self.at = of[begin], np.cumsum(new) - 1
        one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
        add = lambda x: np.add.reduceat(x, begin) if len(begin) else x
        self.ones, self.zeros = add(counts * one), add(counts * (1 - one))
        self.kt = log_kt(self.zeros, self.ones)
        self.weighted = self.kt.copy()

    @property
    def own(self) -> np.ndarray:
        """The weight of the node's own estimate."""
        return np.exp(np.log(0.5) + self.kt - self.weighted)


def by_depth(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For depths ``depth`` down to ``top``: the sorted keys (newest context byte first, then the symbol) of sorted ``keys``
    cut to it, their counts, and the place of each of ``keys`` among them."""
    out = {}
    for d in range(depth, top - 1, -1):
        cut = np.uint64(8 * (depth - d + 1))
        k, back = np.unique((keys >> cut << np.uint64(8)) | (keys & np.uint64(255)), return_inverse=True)
        out[d] = k, np.bincount(back.ravel(), weights=counts, minlength=len(k)).astype(np.int64), back.ravel()
    return out


def bit_levels(cut: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], bit: int) -> dict[int, Level]:
    """The weighted nodes of one bit position, whose context tree is one of its own, at each depth of ``cut``."""
    out: dict[int, Level] = {}
    for d in sorted(cut, reverse=True):
        mine = out[d] = Level(*cut[d][:2], bit)
        if d + 1 in out:
            child, bits = out[d + 1], np.uint64(bit)
            parent = (child.ids >> bits >> np.uint64(8) << bits) | (child.ids & np.uint64((1 << bit) - 1))
            below = np.bincount(np.searchsorted(mine.ids, parent), weights=child.weighted, minlength=len(mine.ids))
            mine.weighted = np.logaddexp(np.log(0.5) + mine.kt, np.log(0.5) + below)
    return out


def mixed(keys: np.ndarray, counts: np.ndarray, depth: int, top: int, above: list[np.ndarray] | None = None) -> np.ndarray:
    """Natural log of the probability of each of the sorted ``keys``' symbols. ``above``: for each bit, the two upper depths'
    (zeros, ones, own weight) by context byte and bits so far, as made by ``top_tables``."""
    cut, total = by_depth(keys, counts, depth, top), np.zeros(len(keys))
    for b in range(8):
        nodes = bit_levels(cut, b)
        bit = ((keys >> np.uint64(7 - b)) & np.uint64(1)).astype(np.int64)
        p, met = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
        for d in range(depth, top - 1, -1):
            at = nodes[d].at[cut[d][2]]
            p, met = _step(p, met, nodes[d].zeros[at], nodes[d].ones[at], nodes[d].own[at], bit)
        if above is not None:
            so_far = ((keys & np.uint64(255)) >> np.uint64(8 - b)).astype(np.int64) | (1 << b)
            newest = (keys >> np.uint64(8 * depth)).astype(np.int64)
            for table, row in ((above[1], newest), (above[0], np.zeros(len(keys), np.int64))):
                n0, n1, own = (table[i][row, so_far] for i in range(3))
                p, met = _step(p, met, n0, n1, own, bit)
        total += np.log(p)
    return total


def top_nodes(keys: np.ndarray, counts: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    """Sums of the depth-2 nodes over the older context byte: c (the newest), node (bits so far, a one before), zeros, ones, weighted."""
    cut, out = by_depth(keys, counts, depth, 2), []
    for b in range(8):
        v = bit_levels(cut, b)[2]
        cell = (v.ids >> np.uint64(b + 8) << np.uint64(8)) | np.uint64(1 << b) | (v.ids & np.uint64((1 << b) - 1))
        at, back = np.unique(cell, return_inverse=True)
        sums = [np.bincount(back.ravel(), weights=x, minlength=len(at)) for x in (v.zeros, v.ones, v.weighted)]
        out.append(((at >> np.uint64(8)).astype(np.int64), (at & np.uint64(255)).astype(np.int64), sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2]))
    return dict(zip(("c", "node", "zeros", "ones", "weighted"), map(np.concatenate, zip(*out))))


def _step(p, met, n0, n1, own, bit):
    kt = (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1.0)
    here = n0 + n1 > 0
    return np.where(here, np.where(met, own * kt + (1 - own) * p, kt), p), met | here


def top_tables(rows: list[tuple[int, int, int, int, float]]) -> list[list[np.ndarray]]:
    """Depths 0 and 1 as (zeros, ones, own weight) by (context byte, bits so far with a leading one), from the sums
    (context byte, node, zeros, ones, summed log weight of the depth-2 nodes below)."""
    n0, n1, below = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64), np.zeros((256, 256))
    for c, node, a, b, w in rows:
        n0[c, node], n1[c, node], below[c, node] = a, b, w
    out = []
    for _ in range(2):
        kt = log_kt(n0, n1)
        weighted = np.logaddexp(np.log(0.5) + kt, np.log(0.5) + below)
        out.insert(0, [n0, n1, np.exp(np.log(0.5) + kt - weighted)])
        n0, n1, below = (x.sum(0, keepdims=True) for x in (n0, n1, weighted))
    return out


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's grams: the ``depth`` bytes before (zeros before its start), newest first, then the byte; one for the end byte 0.

    Returns them and where each text's begin."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(sizes + depth + 1)])
    padded = np.zeros(first[-1], np.uint8)
    to = np.arange(len(data)) + np.repeat(first[:-1] + depth - offsets[:-1], sizes)
    padded[to] = data
    wide = padded.astype(np.uint64)
    out = wide.copy()
    for d in range(1, depth + 1):
        out[d:] |= wide[:-d] << np.uint64(8 * (depth - d + 1))
    keep = np.ones(len(out), bool)
    keep[(first[:-1, None] + np.arange(depth)).ravel()] = False
    return out[keep], offsets + np.arange(n + 1)


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each stands where ``train`` holds."""
    train = train.astype(bool)
    seen, other = np.sort(keys[train]), np.sort(keys[~train])
    begin, alone = (np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64) for x in (seen, other))
    return _added([(seen[begin], np.diff(np.append(begin, len(seen)))), (other[alone], np.zeros(len(alone), np.int64))])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of sorted parts, with their counts added up."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(n, begin)


def pack(values: np.ndarray) -> bytes:
    """An array as bytes: planes of equally significant bytes, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _needs(data: np.ndarray, offsets: np.ndarray, trains: np.ndarray, depth: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, keys, counts) of the distinct grams and words of the texts, counts from those that train."""
    found: list[list] = [[], []]
    for i, j in slices(offsets, SLICE):
        raw, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        part = LOWER[raw]
        starts, ends, first = word_spans(part, offs)
        found[1].append(_counted(word_hashes(part, starts, ends), np.repeat(trains[i:j], np.diff(first))))
        g, at = grams(raw, offs, depth)
        found[0].append(_counted(g, np.repeat(trains[i:j], np.diff(at))))
    for kind, parts in enumerate(found):
        keys, n = _added(parts)
        bucket = keys % np.uint64(WORDS) + np.uint64(BUCKETS) if kind else mix64(keys >> np.uint64(8 * (depth - 1))) % np.uint64(BUCKETS)
        order = np.argsort(bucket, kind="stable")
        keys, n, bucket = keys[order], n[order], bucket[order]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
        for a, z in zip(edge[:-1], edge[1:]):
            yield int(bucket[a]), pack_sorted(keys[a:z]), pack(n[a:z])


def blocks(docs: DataFrame, depth: int) -> DataFrame:
    """The texts (kind T: ids, held_out, sizes, texts of a run of documents, packed) and the needs (kind N: bucket, keys,
    counts) of each block, as one table."""
    ids = T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType))
    schema = T.StructType([ids, *T.StructType.fromDDL("kind string, block long, held_out array<boolean>, sizes binary, texts binary, bucket int, keys binary, counts binary").fields])
    types = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block, held, size = (context.partitionId() << 32) if context else 0, [], 0

        def rows(n: int, kind: str, **columns) -> pa.RecordBatch:
            given = {"kind": [kind] * n, "block": [block] * n, **columns}
            return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in types], schema.names)

        def done() -> Iterator[pa.RecordBatch]:
            data, offsets = text_buffers(pa.concat_arrays([b.column(2) for b in held]))
            own, out = pa.concat_arrays([b.column(0) for b in held]), np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held]).astype(bool)
            for i, j in slices(offsets, RUN):
                texts = pa.compress(data[offsets[i] : offsets[j]].tobytes(), codec="zstd", asbytes=True)
                yield rows(1, "T", ids=[own[i:j].to_pylist()], held_out=[out[i:j].tolist()], sizes=[pack(np.diff(offsets[i : j + 1]))], texts=[texts])
            bucket, keys, counts = zip(*_needs(data, offsets, ~out, depth))
            yield rows(len(bucket), "N", bucket=bucket, keys=keys, counts=counts)

        for b in batches:
            _, offsets = text_buffers(b.column(2))
            a = 0
            while a < b.num_rows:
                z = max(int(np.searchsorted(offsets, offsets[a] + BLOCK - size, "right")) - 1, a if held else a + 1)
                if z > a:
                    held.append(b.slice(a, z - a))
                    size += int(offsets[z] - offsets[a])
                if z < b.num_rows:
                    yield from done()
                    block, held, size = block + 1, [], 0
                a = z
        if held:
            yield from done()

    made = docs.select("doc_id", "held_out", "text").mapInArrow(tidy(cut), schema)
    path = shared_path(docs.sparkSession, "blocks")
    made.write.partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _rows(columns: dict) -> pa.Table:
    return pa.table({k: pa.array(v, pa.binary() if k in ("keys", "counts", "values") else pa.int64()) for k, v in columns.items()})


def added_counts(needs: DataFrame) -> DataFrame:
    """(bucket, keys, counts): one row for each bucket, counts of all blocks added up by groups of groups of blocks."""

    def add(table):
        parts = [(unpack_sorted(k), unpack(c, np.int64)) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist())]
        keys, n = _added(parts)
        return _rows({"bucket": [table.column("bucket")[0].as_py()], "part": [table.column("part")[0].as_py()], "keys": [pack_sorted(keys)], "counts": [pack(n)]})

    rows, parts = needs.select("bucket", F.col("block").alias("part"), "keys", "counts"), needs.select("block").distinct().count()
    while True:
        parts = -(-parts // FAN)
        put = F.pmod(F.xxhash64("part"), F.lit(max(parts, 1)))
        rows = durable(rows.withColumn("part", put).groupBy("bucket", "part").applyInArrow(add, "bucket long, part long, keys binary, counts binary"), "counts")
        if parts <= 1:
            return rows.select("bucket", "keys", "counts")


def _by_key(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return unpack_sorted(keys), unpack(counts, np.int64)


def bucket_values(counts: DataFrame, depth: int) -> DataFrame:
    """(bucket, keys, values): of each gram the natural log of its probability, of each word its count."""

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict(top_nodes(*_by_key(k, c), depth))

    of_grams = counts.where(F.col("bucket") < BUCKETS).select("keys", "counts")
    tops = of_grams.mapInArrow(tidy(upper), "c long, node long, zeros long, ones long, weighted double").groupBy("c", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).collect()  # 256 * 255 rows at most
    above = counts.sparkSession.sparkContext.broadcast(top_tables([tuple(r) for r in tops]))

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, k, c in zip(*(x.to_pylist() for x in b.columns)):
                keys, n = _by_key(k, c)
                values = mixed(keys, n, depth, 2, above.value) if bucket < BUCKETS else n
                yield _rows({"bucket": [bucket], "keys": [k], "values": [pack(values.astype(np.float32))]}).to_batches()[0]

    return counts.select("bucket", "keys", "counts").mapInArrow(tidy(value), "bucket long, keys binary, values binary")


def served(needs: DataFrame, values: DataFrame) -> DataFrame:
    """(block, words, keys, values): to each block the values of its own keys. ``words``: whether they are words."""
    groups = max(-(-needs.select("block").distinct().count() // FAN), 1)
    left = needs.select("block", "bucket", "keys", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("part"))
    right = values.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def serve(wanted, known):
        out: dict[str, list] = {"block": [], "words": [], "keys": [], "values": []}
        if wanted.num_rows:
            keys, value = unpack_sorted(known.column("keys")[0].as_py()), unpack(known.column("values")[0].as_py(), np.float32)
            for block, bucket, own in zip(*(wanted.column(c).to_pylist() for c in ("block", "bucket", "keys"))):
                at = np.searchsorted(keys, mine := unpack_sorted(own))
                if len(mine) and (at[-1] >= len(keys) or (keys[at] != mine).any()):
                    raise ValueError("a block has keys that were not counted")
                for c, v in zip(out.values(), (block, int(bucket >= BUCKETS), own, pack(value[at]))):
                    c.append(v)
        return _rows(out)

    return left.groupBy("bucket", "part").cogroup(right.groupBy(F.col("bucket").cast("int"), "part")).applyInArrow(serve, "block long, words long, keys binary, values binary")


def _lookup(rows: list[tuple[bytes, bytes]]):
    """A function from keys to their values; all keys must be there."""
    keys = pd.Index(np.concatenate([unpack_sorted(k) for k, _ in rows]) if rows else np.zeros(0, np.uint64))
    values = np.concatenate([unpack(v, np.float32) for _, v in rows]) if rows else np.zeros(0, np.float32)

    def of(wanted: np.ndarray) -> np.ndarray:
        at = keys.get_indexer(wanted)
        if (at < 0).any():
            raise ValueError("a text has grams or words that its block did not report")
        return values[at].astype(np.float64)

    return of


def scores(docs: DataFrame, held_out, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row. ``held_out``: a column."""
    docs = docs.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    every = blocks(docs, depth)
    texts, needs = every.where("kind = 'T'").select("block", "ids", "held_out", "sizes", "texts"), every.where("kind = 'N'").select("block", "bucket", "keys", "counts")
    counts = added_counts(needs)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [unpack(c, np.int64) for c in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"v": [int((x > 0).sum()) for x in n], "n": [int(x.sum()) for x in n]})

    words = counts.where(F.col("bucket") >= BUCKETS).select("counts").mapInArrow(tidy(met), "v long, n long").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = int(texts.agg(F.coalesce(F.sum(F.size(F.filter("held_out", lambda x: ~x))), F.lit(0))).first()[0])
    total, distinct = int(words["n"]) + ends, int(words["v"]) + (ends > 0)
    known = served(needs, durable(bucket_values(counts, depth), "values"))
    schema = id_and(docs, "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    logs = lambda c: np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))

    flat = lambda lists: pa.chunked_array([x.flatten() for x in lists.chunks], lists.type.value_type)

    def score(own, found):
        rows = list(zip(*(found.column(c).to_pylist() for c in ("words", "keys", "values"))))
        gram, word = (_lookup([(k, v) for w, k, v in rows if w == kind]) for kind in (0, 1))
        cols: list[list[np.ndarray]] = [[np.zeros(0)] for _ in range(5)]
        for sizes, packed in zip(own.column("sizes").to_pylist(), own.column("texts").to_pylist()):
            offs = np.concatenate([[0], np.cumsum(unpack(sizes, np.int64))])
            raw = np.frombuffer(pa.decompress(packed, decompressed_size=int(offs[-1]), codec="zstd", asbytes=True), np.uint8)
            part = LOWER[raw]
            starts, ends_, first = word_spans(part, offs)
            c = word(word_hashes(part, starts, ends_))
            sums = lambda x, at: np.diff(np.concatenate([[0.0], np.cumsum(x)])[at])
            g, at = grams(raw, offs, depth)
            for col, v in zip(cols, (np.diff(first) + 1, sums(c > 0, first) + (ends > 0), sums(logs(c), first) + logs(float(ends)), sums(gram(g), at) / np.log(10), np.diff(offs) + 1)):
                col.append(v)
        n_tokens, n_known, base, total_log, n_bytes = map(np.concatenate, cols)
        bits = -total_log * np.log2(10) / n_bytes
        return pa.Table.from_arrays([*(flat(own.column(c)) for c in ("ids", "held_out")), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(base), total)), pa.array(base), pa.array(total_log), pa.array(bits)], schema.names)

    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, schema)
