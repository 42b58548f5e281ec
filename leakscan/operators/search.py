"""User search: literal and regular patterns over lines, one row for each (line, pattern); nothing is suppressed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import RuleError, compile_pattern


def search(lines: DataFrame, literals: list[str] = (), regexes: list[str] = ()) -> DataFrame:
    """``lines`` with ``pattern_ord`` and ``pattern`` of each pattern found; patterns must not be empty."""
    if any(not p for p in (*literals, *regexes)):
        raise RuleError("a search pattern is empty")
    spark = lines.sparkSession
    tests = [(p, F.contains("line", F.lit(p))) for p in literals] + [(p, F.col("line").rlike(compile_pattern(spark, p))) for p in regexes]
    if not tests:
        return lines.withColumn("pattern_ord", F.lit(0)).withColumn("pattern", F.lit("")).where("false")
    hits = F.array_compact(F.array(*(F.when(t, F.struct(F.lit(i).alias("pattern_ord"), F.lit(p).alias("pattern"))) for i, (p, t) in enumerate(tests))))
    return lines.withColumn("hit", F.explode(hits)).select(*lines.columns, "hit.*")
