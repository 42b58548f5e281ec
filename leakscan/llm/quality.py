"""Quality rules: a learned decision list over native text statistics.

Sequential covering on labelled statistics of the rows that the base rule keeps: a rule (conjunction of thresholds) is
grown by information gain on two thirds of the sample, pruned on the last third, and kept while it is precise; the rows it
covers leave the sample.
The list comes out as one ordered Spark conditional expression. Only DataFrame functions run on the executors.

Defined results: a null or empty text has no words (all counts 0, ``base_failed``); a null id is carried through;
repeated rows are judged one by one; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_or_empty

WS = r"[\x20\x09-\x0D]"
#: Labelled rows to learn from, at most (the first by a hash of their id).
SAMPLE_ROWS = 8_000
#: Statistics the rules may test.
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "words_per_line")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 5-word windows that the text has twice or more; windows are compared by 64-bit hash."""

    low = (1 << 20) - 1  # places below this stand in the low bits of a sort key; the rest of the key is the hash's high bits

    def covered(hashes: Column) -> Column:
        key = lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))
        place = lambda k: k.bitwiseAND(F.lit(low)).cast("int")

        def of(ranked: Column) -> Column:
            def twice(k: Column, i: Column) -> Column:
                same = lambda o: F.coalesce((k.bitwiseXOR(o) <= low) & (k.bitwiseXOR(o) >= 0) & (F.get(hashes, place(k)) == F.get(hashes, place(o))), F.lit(False))
                return same(F.get(ranked, i - 1)) | same(F.get(ranked, i + 1))

            return covers(F.transform(F.filter(ranked, twice), place))

        def of_long(ranked: Column) -> Column:
            same = lambda x, i: F.coalesce(x["h"] == F.get(ranked, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ranked, i + 1)["h"], F.lit(False))
            return covers(F.transform(F.filter(ranked, same), lambda x: x["i"]))

        def covers(places: Column) -> Column:
            start = F.struct(F.lit(0).alias("sum"), F.lit(-5).alias("last"))
            step = lambda a, p: F.struct((a["sum"] + F.least(F.lit(5), p - a["last"])).alias("sum"), p.alias("last"))
            return F.aggregate(F.sort_array(places), start, step, lambda a: a["sum"])

        short = let(F.sort_array(F.transform(hashes, key)), of)
        long = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_long)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).when(n <= low, short).otherwise(long)

    both = lambda x, y, gap: F.zip_with(F.slice(x, 1, F.size(x) - gap), F.slice(y, gap + 1, F.size(y) - gap), lambda p, q: F.xxhash64(p, q))
    fives = lambda fours: F.zip_with(F.slice(fours, 1, n - 4), F.slice(words, 5, n - 4), lambda p, q: F.xxhash64(p, q))
    windows = let(both(words, words, 1), lambda pairs: let(both(pairs, pairs, 2), lambda fours: let(fives(fours), covered)))
    return F.when(n < 6, F.lit(0)).otherwise(windows).cast("long")


def quality_stats(docs: DataFrame, text_col: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into`` of statistics, taken from the whole text."""
    t = F.col("__t")
    words = F.filter(F.split(t, WS + "+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.withColumn("__t", text_or_empty(f"`{text_col}`")).withColumn("__w", words).withColumn("__l", lines)
    n = F.size("__w")
    stats = F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__w"), F.size("__w")).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("[0-9]")).cast("long").alias("n_digits"),
    )
    return base.withColumn(into, stats).drop("__t", "__w", "__l")


def features(s: str = "quality") -> dict[str, Column]:
    """The statistics the rules test, from the struct column ``s``."""
    share = lambda a, b: (F.col(f"{s}.{a}") / F.greatest(F.col(f"{s}.{b}"), F.lit(1))).cast("double")
    return {
        "n_words": F.col(f"{s}.n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "words_per_line": share("n_words", "n_lines"),
    }


def base_failed(s: str = "quality") -> Column:
    return (F.col(f"{s}.n_words") < 10) | (100 * F.col(f"{s}.n_repeat_words") > 20 * F.col(f"{s}.n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rejecting rules; what none covers is kept."""

    rules: tuple[tuple[Test, ...], ...] = ()

    def verdict(self, of: dict[str, Column] | None = None) -> Column:
        """True where the list keeps the row: one CASE WHEN with a branch for each rule, in order."""
        of = of or features()
        out = None
        for rule in self.rules:
            test = reduce(Column.__and__, (t.column(of) for t in rule))
            out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def keeps(self, row: dict) -> bool:
        return not any(all(t.holds(row) for t in rule) for rule in self.rules)

    def __str__(self) -> str:
        return "\n".join([*("reject if " + " and ".join(map(str, r)) for r in self.rules), "else keep"])


def _cuts(rows: list[tuple[dict, bool]], feature: str) -> list[tuple[float, int, int]]:
    """(threshold midway between two values, bad at or below it, good at or below it) where the value changes."""
    ranked = sorted((r[feature], bad) for r, bad in rows)
    out, p, n = [], 0, 0
    for (v, bad), (w, _) in zip(ranked, ranked[1:]):
        p, n = p + bad, n + (not bad)
        if w > v:
            out.append(((v + w) / 2, p, n))
    return out


def _grow(rows: list[tuple[dict, bool]], cost: float, most: int = 4) -> tuple[Test, ...]:
    """Tests added one by one by information gain; a good row weighs ``cost`` times a bad one."""
    rule: list[Test] = []
    while len(rule) < most:
        pos, neg = sum(b for _, b in rows), sum(not b for _, b in rows)
        if not neg or not pos:
            break
        now, best = math.log2(pos / (pos + cost * neg)), (0.0, None)
        for f in FEATURES:
            for cut, p, n in _cuts(rows, f):
                for above, a, b in ((True, pos - p, neg - n), (False, p, n)):
                    if a:
                        gain = a * (math.log2(a / (a + cost * b)) - now)
                        if gain > best[0] + 1e-12:
                            best = (gain, Test(f, above, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [x for x in rows if best[1].holds(x[0])]
    return tuple(rule)


def _covered(rule: tuple[Test, ...], rows: list[tuple[dict, bool]]) -> tuple[int, int]:
    hit = [bad for r, bad in rows if all(t.holds(r) for t in rule)]
    return sum(hit), len(hit) - sum(hit)


def learn_rules(rows: list[tuple[dict, bool]], precision: float = 0.98, cost: float = 10.0, least: int = 3, most_rules: int = 12) -> DecisionList:
    """A decision list from (statistics, is bad) rows. Every third row is for pruning; without both classes: no rule."""
    grow, prune, rules = [r for i, r in enumerate(rows) if i % 3], rows[::3], []
    while len(rules) < most_rules and any(b for _, b in grow):
        rule = _grow(grow, cost)
        if not rule:
            break
        value = lambda r: (lambda p, n: (p - cost * n) / (p + n) if p + n else -cost)(*_covered(r, prune))
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(shorter, key=lambda r: (value(r), -len(r)))
        p, n = (a + b for a, b in zip(_covered(rule, grow), _covered(rule, prune)))
        if p < least or p < precision * (p + n):
            break
        rules.append(rule)
        out = lambda part: [x for x in part if not all(t.holds(x[0]) for t in rule)]
        grow, prune = out(grow), out(prune)
    return DecisionList(tuple(rules))


def labelled_stats(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[dict, bool]]:
    """Statistics of at most ``sample_rows`` labelled documents, in the order of a hash of their ids; those that the base
    rule rejects anyway teach nothing and are left out."""
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").alias("label"), F.xxhash64("doc_id").alias("at")).orderBy("at", "doc_id").limit(sample_rows)
    rows = quality_stats(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    out = rows.select("at", "doc_id", "label", base_failed().alias("failed"), *(c.alias(k) for k, c in features().items())).collect()
    return [({k: r[k] for k in FEATURES}, r["label"] == 0) for r in sorted(out, key=lambda r: (r["at"], r["doc_id"])) if not r["failed"]]


def judge(docs: DataFrame, rules: DecisionList, into: str = "quality") -> DataFrame:
    """``docs`` with struct ``into``: the statistics, ``base_failed`` and ``kept``."""
    s = quality_stats(docs, into=into)
    verdict = F.when(base_failed(into), F.lit(False)).otherwise(rules.verdict(features(into)))
    return s.withColumn(into, F.struct(f"{into}.*", base_failed(into).alias("base_failed"), verdict.alias("kept")))
