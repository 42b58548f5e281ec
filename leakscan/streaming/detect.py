"""The same detection over streams of lines, and earliest-commit dedup as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import ScanContext
from ..functions import predicates as P
from ..operators.detect import keyword_gate, matches, survives
from ..operators.history import FINDING_KEY


def detect_stream(lines: DataFrame, ctx: ScanContext) -> DataFrame:
    """Findings of a streaming (path, line_no, line, *more). Lines are judged one by one: a stream has no end of file, so
    the state of public key blocks, which needs a file's earlier lines, is left to the batch operator."""
    scanned = lines.where(~P.is_path_skipped(F.col("path"), ctx.paths)).withColumn("candidates", keyword_gate(ctx.rules)("line"))
    found = matches(scanned.where("candidates is not null"), ctx).where(survives(ctx))
    more = [c for c in lines.columns if c not in ("path", "line_no", "line")]
    return found.select(*more, "path", "line_no", "rule_ord", "rule_id", "match_ord", "secret")


def earliest_stream(findings: DataFrame) -> DataFrame:
    """(path, rule_id, secret, timestamp, hash) whenever an earlier commit of a finding arrives (update mode)."""

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        new = best
        for p in parts:
            low = min(zip(p["timestamp"].tolist(), p["hash"].tolist()))
            new = low if new is None else min(new, low)
        if new != best:
            state.update(new)
            yield pd.DataFrame([(*key, *new)], columns=[*FINDING_KEY, "timestamp", "hash"])

    return findings.groupBy(*FINDING_KEY).applyInPandasWithState(
        keep, "path string, rule_id string, secret string, timestamp long, hash string", "timestamp long, hash string", "update", GroupStateTimeout.NoTimeout
    )
