"""Detection: lines, keyword gate, rules, suppression, findings.

The plan is narrow but for one small window: an Arrow function over whole column batches names the rules whose keywords a
line holds, and only such lines and the marker lines of public key blocks go on. Rules come by a broadcast join (one row
each)."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..config import ScanContext
from ..functions import predicates as P
from ..functions.scalars import MIN_ENTROPY_LENGTH, is_strong_password, shannon_entropy
from ..rules import CompiledRules

CREDENTIAL_ENTROPY = 3.5
DOC_BONUS = 1.0
ORDER = ["path", "line_no", "rule_ord", "match_ord"]


def keyword_gate(rules: CompiledRules):
    """An Arrow function: the numbers of the rules one of whose keywords stands in the line, ASCII case aside.

    One linear-time pass of all keywords picks the lines that have any; each keyword that stands in the bytes of these is then
    looked for line by line."""
    index = {k: np.array(v, np.int32) for k, v in rules.keywords.items()}
    special = b"\\.+*?()|[]{}^$#&-~"
    pattern = b"|".join(b"".join(b"\\" + bytes([c]) if c in special else bytes([c]) for c in k.encode()) for k in index).decode()

    def rules_of(low: pa.Array) -> pa.Array:
        n = len(low)
        at = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(low, pattern), False)).to_numpy() if index else np.zeros(0, np.int64)
        some, found = low.take(pa.array(at)), []
        data = b"".join(bytes(x) for x in some.buffers()[2:] if x is not None)  # a keyword that isn't in all of it is in no line
        for k, of in index.items() if len(at) else ():
            if data.find(k.encode()) < 0:
                continue
            line = at[pc.indices_nonzero(pc.match_substring(some, k)).to_numpy()].astype(np.int64)
            if len(line):
                found.append((np.repeat(line, len(of)) << 32 | np.tile(of, len(line))))
        each = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        counts = np.bincount(each >> 32, minlength=n)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((each & 0xFFFFFFFF).astype(np.int32)), mask=pa.array(counts == 0))

    @arrow_udf("array<int>")
    def candidates(lines: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in lines:
            yield rules_of(pc.ascii_lower(batch))

    return candidates


def keyword_candidates(line: Column, rules: CompiledRules) -> Column:
    """The same as an expression of built-in functions, for streams and comparison.

    The line is lower-cased once and meets one constant table of keywords; a branch for each keyword would make an expression
    too large to be compiled, which lower-cases the line anew in every branch."""
    if not rules.keywords:
        return F.lit(None).cast("array<int>")
    low = F.translate(line, string.ascii_uppercase, string.ascii_lowercase)
    index = F.array(*(F.struct(F.lit(k).alias("keyword"), F.array(*map(F.lit, v)).alias("rules")) for k, v in rules.keywords.items()))

    def rules_of(low: Column) -> Column:
        held = F.filter(index, lambda e: F.contains(low, e["keyword"]))
        return F.array_sort(F.array_distinct(F.flatten(F.transform(held, lambda e: e["rules"]))))

    found = F.transform(F.array(low), rules_of)  # of one element: lambdas bind what is used more than once
    return F.get(F.filter(found, lambda r: F.size(r) > 0), F.lit(0))


def in_public_key_block(file_key: list[str]) -> Column:
    """Whether a line is inside a block, its begin and end lines included; needs a ``marker`` column."""
    w = Window.partitionBy(*file_key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last("marker", ignorenulls=True).over(w) == "B", F.lit(False)) | F.coalesce(F.col("marker") == "B", F.lit(False))


def matches(candidates: DataFrame, ctx: ScanContext) -> DataFrame:
    """A row for each match of each candidate rule: its fields and ``match_ord``, ``secret``."""
    rules = F.broadcast(ctx.rules.table(candidates.sparkSession))
    each = candidates.withColumn("rule_ord", F.explode("candidates")).drop("candidates").join(rules, "rule_ord")
    whole, part = (F.regexp_extract_all("line", F.col("pattern"), g) for g in (F.lit(0), F.col("secret_group")))
    found = F.zip_with(whole, part, lambda w, p: F.coalesce(F.nullif(p, F.lit("")), w))
    return each.select("*", F.posexplode(found).alias("match_ord", "secret")).where("secret <> ''")


def allowed_by_rule(ctx: ScanContext) -> Column:
    """Whether the rule's own list has the secret or the path."""
    return P.any_of((F.col("rule_id") == a.id) & (P.matches_any(F.col("secret"), a.regexes) | P.matches_any(F.col("path"), a.paths, anchored=True)) for a in ctx.rule_allow)


def survives(ctx: ScanContext) -> Column:
    """All suppressions of a match as one conjunction, the cheap ones first."""
    secret, line, own = F.col("secret"), F.col("line"), F.col("entropy_threshold")
    special = F.col("is_password") | F.col("is_credential")
    context, full_stopwords = F.col("context_dependent") | special, own.isNotNull() | special
    floor = F.lit(ctx.entropy_threshold) if ctx.entropy_threshold is not None else own
    threshold = F.greatest(own, floor) + F.when(P.is_documentation(F.col("path")), DOC_BONUS).otherwise(0.0)
    keep = ~allowed_by_rule(ctx) & ~(context & P.is_template_line(line)) & ~F.when(full_stopwords, P.has_stopword(secret, ctx.stopwords)).otherwise(P.is_placeholder(secret))
    keep &= ~P.is_variable_reference(secret) & ~P.is_hash_in_context(secret, line)
    if not ctx.detect_public_keys:
        keep &= ~P.is_openssh_public_key(line)

    def strong_enough(h: Column) -> Column:
        strong = is_strong_password(secret, h)
        dense = (F.octet_length(secret) < MIN_ENTROPY_LENGTH) | (h >= threshold)
        return (
            (~F.col("is_password") | strong)
            & (~F.col("is_credential") | strong | (h >= F.coalesce(own, F.lit(CREDENTIAL_ENTROPY))))
            & (own.isNull() | F.col("is_password") | dense)
        )

    measured = F.transform(F.array(shannon_entropy(secret)), strong_enough)[0]  # the entropy is taken once, and only of what is left
    return F.when(~keep, F.lit(False)).when(own.isNull() & ~special, F.lit(True)).otherwise(measured)


def detect(lines: DataFrame, ctx: ScanContext, file_key: list[str] | None = None, ordered: bool = False, native_gate: bool = False) -> DataFrame:
    """Findings (file_key columns, path, line_no, rule_ord, rule_id, match_ord, secret, *other columns of ``lines``).

    ``file_key`` names what makes a file of ``lines`` (path, line_no, line): the state of public key blocks is kept by it.
    ``ordered``: in the order of reports; a global sort runs its input's last stage twice, so it is for small results."""
    key = file_key or ["path"]
    scanned = lines.where(~P.is_path_skipped(F.col("path"), ctx.paths))
    gate = keyword_candidates(F.col("line"), ctx.rules) if native_gate else keyword_gate(ctx.rules)("line")
    marked = scanned.withColumn("candidates", gate)
    if not ctx.detect_public_keys:
        marked = marked.withColumn("marker", P.public_key_marker(F.col("line"))).where("candidates is not null or marker is not null")
        marked = marked.withColumn("in_block", in_public_key_block(key)).where("not in_block").drop("marker", "in_block")
    found = matches(marked.where("candidates is not null"), ctx).where(survives(ctx))
    extra = [c for c in lines.columns if c not in ("path", "line_no", "line")]
    out = found.select(*extra, "path", "line_no", "rule_ord", "rule_id", "match_ord", "secret")
    return out.orderBy(*extra, *ORDER) if ordered else out
