"""Toxicity: a convolutional text classifier trained in numpy.

Words (lower-cased A-Z, runs of letters) and their beginnings of ``HEADS`` bytes are hashed to rows of an embedding table,
a word's vector being the sum of these rows; filters of several widths slide over the word sequence, each takes its maximum
over the text, and a logistic output follows. The model learns from a bounded, documented sample of labelled rows, whole
texts, on the driver (10,000 token lists at most) and scores all rows on the executors. Its output is calibrated, on rows
that did not train the net, so that 0.3 is the decision bound overall; a bound for each language is calibrated beside it on
such rows, and is only ever compared with the score: language, source, id and labels are no inputs of a score.

Defined results: a null or empty text scores as a text without words; a null id is carried through; repeated rows get
equal scores; without labelled rows of both classes all texts score 0; other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER, id_and, slices, text_buffers, tidy, word_hashes, word_spans

#: Labelled rows to learn from, at most (the first by a hash of their id); of each its whole text.
SAMPLE_ROWS = 10_000
#: Bytes of text that are cut into words at once, about (a longer text stands alone).
SLICE = 1 << 18
#: Words that calibration scores at once, about (a longer text stands alone).
CHUNK = 1 << 18
BUCKETS = 1 << 16
WIDTH = 8
#: Lengths of the beginnings of a word that have rows of their own.
HEADS = (4, 6)
BITS = np.uint64(16)
FILTERS = {1: 8, 2: 4, 3: 4}
BOUND = 0.3
#: Share of words that a training step doesn't hear, so that no text is learned by one word alone.
MUTED = 0.3
#: Everything but letters stands between words (bytes above 127 are parts of letters).
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def token_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows of a text column: all words, each the numbers of its embedding rows in one number, and where each text's words start."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets, SLICE):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = word_spans(part, offsets[a : b + 1] - offsets[a], BETWEEN)
        low = LOWER[part]
        token = np.zeros(len(starts), np.uint64)
        for k, e in enumerate([ends, *(np.minimum(ends, starts + n) for n in HEADS)]):
            token = token << BITS | ((word_hashes(low, starts, e) >> np.uint64(20)) + np.uint64(12_345 * k)) % np.uint64(BUCKETS)
        yield token.view(np.int64), first


def embedding_rows(tokens: np.ndarray) -> list[np.ndarray]:
    """The rows packed into each token by ``token_rows``."""
    return [(tokens >> (16 * k)) % BUCKETS for k in range(len(HEADS) + 1)]


class ConvNet:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.01, (BUCKETS, WIDTH)).astype(np.float32)  # small, so that a word not learned answers nothing
        self.seen = np.full(BUCKETS, 1e-4, np.float32)
        self.w = {k: rng.normal(0, 0.5 / np.sqrt(k), (k * WIDTH, n)).astype(np.float32) for k, n in FILTERS.items()}
        self.b = {k: np.zeros(n, np.float32) for k, n in FILTERS.items()}
        self.out = rng.normal(0, 0.3, sum(FILTERS.values())).astype(np.float32)
        self.bias = np.float32(-1.0)

    def _maxima(self, x: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each text and filter of width ``k``: the largest response (0 at least) and where it is (-1: nowhere)."""
        n, texts = len(x), len(first) - 1
        best, at = np.zeros((texts, FILTERS[k]), np.float32), np.full((texts, FILTERS[k]), -1)
        size = np.diff(first)
        full = np.flatnonzero(size >= k)
        if not len(full):
            return best, at
        r = self.b[k] + sum(x[i : n - k + 1 + i] @ self.w[k][i * WIDTH : (i + 1) * WIDTH] for i in range(k))
        bounds = np.stack([first[full], first[full] + size[full] - k + 1], 1).ravel()
        padded = np.vstack([r, np.full((1, r.shape[1]), -1e9, np.float32)])
        top = np.maximum.reduceat(padded, np.minimum(bounds, len(r)), axis=0)[::2]
        best[full] = np.maximum(top, 0)
        if self.where:
            for t, row in zip(full, top):
                at[t] = first[t] + r[first[t] : first[t] + size[t] - k + 1].argmax(0)
                at[t][row <= 0] = -1
        return best, at

    where = False

    def logits(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = sum(self.e[r] for r in embedding_rows(tokens))
        return np.hstack([self._maxima(x, first, k)[0] for k in FILTERS]) @ self.out + self.bias

    def fit(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 8, rate: float = 0.05, batch: int = 64, seed: int = 11, steps: int = 400) -> ConvNet:
        """Adam on the logistic loss, ``steps`` of them at least; both classes weigh the same."""
        epochs = max(epochs, -(-steps * batch // max(len(texts), 1)))
        rng, slots, step = np.random.default_rng(seed), {}, 0
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        self.where = True

        def adam(name, param, grad):
            m, v = slots.setdefault(name, (np.zeros_like(param), np.zeros_like(param)))
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= rate_now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

        for epoch in range(epochs):
            rate_now = rate * (1 - epoch / epochs)
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                ids = order[a : a + batch]
                tokens = np.concatenate([texts[i] for i in ids])
                first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in ids])])
                of, step = embedding_rows(tokens), step + 1
                heard = (rng.random(len(tokens)) >= MUTED).astype(np.float32)[:, None]
                x = sum(self.e[r] for r in of) * heard
                found = {k: self._maxima(x, first, k) for k in FILTERS}
                h = np.hstack([f[0] for f in found.values()])
                p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.bias, -30, 30)))
                d = (p - y[ids]) * weight[ids] / len(ids)
                dh, col, rows, grads = np.outer(d, self.out), 0, [], []
                for k, (_, at) in found.items():
                    dk = dh[:, col : col + FILTERS[k]]
                    col += FILTERS[k]
                    t, f = np.nonzero(at >= 0)
                    gw, gb = np.zeros_like(self.w[k]), np.zeros_like(self.b[k])
                    if len(t):
                        g, pos = dk[t, f].astype(np.float32), at[t, f]
                        np.add.at(gb, f, g)
                        for i in range(k):
                            part = self.w[k][i * WIDTH : (i + 1) * WIDTH]
                            np.add.at(gw[i * WIDTH : (i + 1) * WIDTH].T, f, g[:, None] * x[pos + i])
                            for r in of:
                                rows.append(r[pos + i])
                                grads.append(g[:, None] * heard[pos + i] * part[:, f].T)
                    adam(("w", k), self.w[k], gw + 1e-5 * self.w[k])
                    adam(("b", k), self.b[k], gb)
                adam("out", self.out, (h.T @ d).astype(np.float32) + 1e-4 * self.out)
                self.bias -= np.float32(rate_now * d.sum())
                if rows:
                    touched, to = np.unique(np.concatenate(rows), return_inverse=True)
                    grad = np.zeros((len(touched), WIDTH), np.float32)
                    np.add.at(grad, to.ravel(), np.vstack(grads))
                    self.seen[touched] += (grad * grad).sum(1)
                    self.e[touched] -= 4 * rate_now * grad / np.sqrt(self.seen[touched])[:, None]
        self.where = False
        return self


class Calibrated:
    """A net with its score scale (logistic in the logit, 0.3 at the chosen cut) and bounds by language."""

    def __init__(self, net: ConvNet | None, scale: float = 1.0, cut: float = 0.0, bounds: dict[str, float] | None = None):
        self.net, self.scale, self.cut, self.bounds = net, scale, cut, bounds or {}

    def scores(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(first) - 1)
        z = self.scale * (self.net.logits(tokens, first).astype(np.float64) - self.cut) + np.log(BOUND / (1 - BOUND))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the largest F1, in the middle of the widest gap that has it."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    right = y[::-1].cumsum()[::-1]
    f1 = 2 * right / (np.arange(len(y), 0, -1) + y.sum())
    low = np.concatenate([[z[0] - 1], z[:-1]])
    f1[low == z] = -1
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = top[np.argmax((z - low)[top])]
    return float((z[k] + low[k]) / 2)


def train(rows: list[tuple[np.ndarray, int, str]], seed: int = 7) -> Calibrated:
    """``rows``: (tokens, label, language). Every fourth row calibrates, the others train."""
    y = np.array([r[1] for r in rows], np.float32)
    held = np.arange(len(rows)) % 4 == 3
    if len(rows) < 8 or not 0 < y[~held].sum() < (~held).sum():
        return Calibrated(None)
    net = ConvNet(seed).fit([r[0] for r, h in zip(rows, held) if not h], y[~held])
    first = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    z = np.concatenate([net.logits(np.concatenate([r[0] for r in rows[a:b]]), first[a : b + 1] - first[a]) for a, b in slices(first, CHUNK)]).astype(np.float64)
    use = held if 0 < y[held].sum() < held.sum() else np.ones(len(y), bool)
    cut = best_cut(z[use], y[use])
    model = Calibrated(net, scale=4.0 / max(float(np.std(z)), 1e-6), cut=cut)
    score = 1 / (1 + np.exp(-np.clip(model.scale * (z - cut) + np.log(BOUND / (1 - BOUND)), -40, 40)))
    for lang in sorted({r[2] for r in rows if r[2]}):
        own = np.array([r[2] == lang for r in rows])
        own &= use
        model.bounds[lang] = best_cut(score[own], y[own]) if 20 <= own.sum() and 5 <= y[own].sum() < own.sum() else BOUND
    return model


def remainder(mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[np.ndarray, int, str]]:
    """Tokens, label and language of at most ``sample_rows`` labelled rows that are not held out."""
    usable = labels.where("doc_id is not null and toxic is not null").where(remainder(4) != 2)
    chosen = usable.select("doc_id", "toxic", F.xxhash64("doc_id").alias("at")).orderBy("at", "doc_id").limit(sample_rows)
    have = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string") if "lang" in docs.columns else F.lit("").alias("lang"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [t[f:g] for t, first in token_rows(b.column(0)) for f, g in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), *b.columns[1:]], ["tokens", "label", "lang", "at"])

    joined = have.join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int"), "lang", "at")
    got = joined.mapInArrow(tidy(tokens), "tokens array<long>, label int, lang string, at long").toArrow()
    texts = [t.values.to_numpy() for t in got.column("tokens")]  # views: no number of them becomes an object
    rows = sorted(zip(got.column("at").to_pylist(), texts, got.column("label").to_pylist(), got.column("lang").to_pylist()), key=lambda r: (r[0], len(r[1])))
    return [(t, int(y == 1), lang or "") for _, t, y, lang in rows]


def bound_of(model: Calibrated, lang):
    """The column of the bound of the language in the column ``lang``: the calibrated one, or ``BOUND`` where there is none."""
    bounds = F.create_map(*(F.lit(x) for kv in model.bounds.items() for x in kv)) if model.bounds else F.create_map(F.lit(""), F.lit(BOUND))
    return F.coalesce(bounds[lang], F.lit(BOUND))


def score(docs: DataFrame, model: Calibrated, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (its id alone by default) with ``score``."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: the embedding table and a few filters
    schema = id_and(docs, "score double", *keep)
    text = keep.index("text") if "text" in keep and docs.schema["text"].dataType == T.StringType() else len(keep)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                b = whole.slice(a, 2048)
                parts = [m.scores(t, first) for t, first in token_rows(b.column(text))]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.concatenate(parts))], schema.names)

    more = [] if text < len(keep) else [F.col("text").cast("string").alias("__text")]
    return docs.select(*keep, *more).mapInArrow(tidy(scored), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, the bound of the document's language and whether the score reaches it."""
    model = train(labelled_sample(docs, labels))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    scored = score(docs.select("doc_id", "text", lang.alias("lang")), model, ["doc_id", "lang"])
    bound = bound_of(model, F.col("lang"))
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= BOUND).cast("int").alias("predicted"), bound.alias("language_bound"), (F.col("score") >= bound).alias("toxic_for_language"))
