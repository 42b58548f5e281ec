"""Relational operators over findings: earliest-commit dedup, branches, reports and exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_blocked_env
from ..functions.scalars import mask, sanitize, snippet

FINDING_KEY = ["path", "rule_id", "secret"]
SEARCH_KEY = ["path", "line_no", "pattern", "line"]


def keep_earliest(rows: DataFrame, key: list[str], ties: list[str]) -> DataFrame:
    """The row with the least (timestamp, *ties) of each key: an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("timestamp", *ties)).alias("r"))
    return best.select(*key, "r.*").select(*rows.columns)


def dedup_findings(rows: DataFrame) -> DataFrame:
    return keep_earliest(rows, FINDING_KEY, ["commit_ord", "line_no", "match_ord"]).orderBy("timestamp", "hash", "path", "line_no", "rule_id", "secret")


def dedup_search(rows: DataFrame) -> DataFrame:
    return keep_earliest(rows, SEARCH_KEY, ["commit_ord"]).orderBy("timestamp", "hash", "path", "line_no", "pattern")


def with_branches(rows: DataFrame, branches: DataFrame) -> DataFrame:
    """Branch names of each row's commit, empty where there are none."""
    return rows.join(branches, "hash", "left").withColumn("branches", F.coalesce("branches", F.array().cast("array<string>")))


def without_blocked(lines: DataFrame) -> DataFrame:
    """Lines of files that the .env policy blocks go; the policy is a predicate of the path, so no join is needed."""
    return lines.where(~is_blocked_env(F.col("path")))


def blocked_files(files: DataFrame) -> DataFrame:
    return files.where(~F.coalesce("is_deleted", F.lit(False)) & is_blocked_env(F.col("path"))).select("path")


def union_ignored(tracked: DataFrame, ignored: DataFrame) -> DataFrame:
    return tracked.unionByName(ignored.join(tracked, "path", "left_anti"))


def report_rows(findings: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(path, line, rule_id, shown): blocked files first, then masked findings."""
    rows = findings.select("path", F.col("line_no").cast("string").alias("line"), "rule_id", mask(F.col("secret")).alias("shown"))
    if blocked is None:
        return rows
    return blocked.select("path", F.lit("-").alias("line"), F.lit("env-file-blocked").alias("rule_id"), F.lit("").alias("shown")).unionByName(rows)


def by_commit(rows: DataFrame, each: Column) -> DataFrame:
    """One row for each commit, in the order of commits: short hash, sanitised author, email, date and branches (where
    there are any), and ``each`` of its rows, in order, as ``found``."""
    names = [F.array_join(F.transform(F.first("branches"), sanitize), ", ").alias("branches")] if "branches" in rows.columns else []
    return rows.groupBy("timestamp", "hash").agg(
        F.substring(F.col("hash"), 1, 8).alias("short"), *(sanitize(F.first(c)).alias(c) for c in ("author", "email", "date")), *names, F.array_sort(F.collect_list(each)).alias("found")
    ).orderBy("timestamp", "hash")


def report_by_commit(findings: DataFrame) -> DataFrame:
    """``by_commit`` with masked findings."""
    return by_commit(findings, F.struct(sanitize(F.col("path")).alias("path"), "line_no", "rule_id", sanitize(mask(F.col("secret"))).alias("shown")))


def search_by_commit(matches: DataFrame) -> DataFrame:
    """``by_commit`` with snippets of search matches."""
    return by_commit(matches, F.struct(sanitize(F.col("path")).alias("path"), "line_no", sanitize(F.col("pattern")).alias("pattern"), snippet(F.col("line")).alias("shown")))


def search_report(found: DataFrame) -> DataFrame:
    return found.select("path", "line_no", "pattern", snippet(F.col("line")).alias("shown"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("n_findings"), F.countDistinct("path").alias("n_files"))


def counters(files: DataFrame) -> DataFrame:
    """How many files were scanned, were binary, and could not be read."""
    count = lambda status: F.coalesce(F.sum(F.when(F.col("status") == status, 1).otherwise(0)), F.lit(0))
    return files.agg(count("ok").alias("n_scanned"), count("binary").alias("n_binary"), count("error").alias("n_errors"))


def has_issues(status: Column) -> Column:
    """Over rows of a doctor's report: whether any is a warning or an error."""
    return F.bool_or(status.isin("warn", "error"))


def scan_exit(n_findings: Column) -> Column:
    return F.when(n_findings > 0, 1).otherwise(0)


def audit_exit(n_findings: Column, n_matches: Column, n_errors: Column) -> Column:
    """1 with any finding or match, else 2 with any error, else 0."""
    return F.when(n_findings + n_matches > 0, 1).when(n_errors > 0, 2).otherwise(0)
