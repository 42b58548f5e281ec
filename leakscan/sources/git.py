"""Git adapters: staged diff, tracked and ignored files, commits, commit diffs and branches.

Listings run on the driver (one process each); per-commit work runs on the executors, which need the repository's path."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Characters of diffs that a worker hands on together, about.
BATCH = 16 << 20


class GitError(RuntimeError):
    """Git is missing, this is no repository, or a command failed."""


def git(root: str, *args: str, check: bool = True) -> bytes:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    except FileNotFoundError as e:
        raise GitError("git was not found") from e
    if check and done.returncode:
        raise GitError(done.stderr.decode(errors="replace").strip())
    return done.stdout


def repo_root(path: str = ".") -> str:
    return git(path, "rev-parse", "--show-toplevel").decode().strip()


def staged_diff(spark: SparkSession, root: str) -> DataFrame:
    """(diff_id, diff): one row, or none if nothing is staged."""
    git(root, "rev-parse", "--is-inside-work-tree")
    out = git(root, "diff", "--cached", "--unified=0", "--diff-filter=d", "--no-ext-diff", "--no-textconv", "--no-color")
    return spark.createDataFrame([(0, out.decode("utf-8", "replace"))] if out else [], "diff_id long, diff string")


def _listing(out: bytes) -> tuple[list[str], int]:
    names, skipped = [], 0
    for raw in filter(None, out.split(b"\0")):
        try:
            names.append(raw.decode())
        except UnicodeDecodeError:
            skipped += 1
    return names, skipped


def tracked_files(root: str) -> tuple[list[str], int]:
    """Names, and how many were skipped as not UTF-8."""
    return _listing(git(root, "ls-files", "-z"))


def ignored_files(root: str) -> tuple[list[str], int]:
    return _listing(git(root, "ls-files", "-z", "--others", "--ignored", "--exclude-standard"))


def validate_branch(branch: str, root: str) -> None:
    if not branch or ".." in branch or branch[0] in "/-":
        raise GitError(f"invalid branch name {branch!r}")
    git(root, "show-ref", "--verify", "--quiet", f"refs/heads/{branch}")


def validate_date(text: str) -> None:
    if not text or re.search(r"[\x00-\x1f\x7f]", text):
        raise GitError(f"invalid date {text!r}")


def commits(spark: SparkSession, root: str, branch: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """(hash, author, email, date, timestamp, commit_ord, is_root); branch and dates are pushed to git."""
    if branch:
        validate_branch(branch, root)
    for d in filter(None, (since, until)):
        validate_date(d)
    args = [f"refs/heads/{branch}" if branch else "--all", *([f"--since={since}"] if since else []), *([f"--until={until}"] if until else [])]
    lines = [x for x in git(root, "rev-list", *args, "--format=%H%n%an%n%ae%n%aI%n%at").decode("utf-8", "replace").split("\n") if not re.fullmatch(r"commit [0-9a-f]{40,64}", x)]
    roots = set(git(root, "rev-list", "--max-parents=0", "--all").decode().split())
    rows = [(*lines[i : i + 4], int(lines[i + 4]) if lines[i + 4].lstrip("-").isdigit() else 0, i // 5, lines[i] in roots) for i in range(0, len(lines) - 4, 5)]
    return spark.createDataFrame(rows, "hash string, author string, email string, date string, timestamp long, commit_ord int, is_root boolean")


#: How git is asked for what a commit adds.
DIFF_TREE = ("diff-tree", "-p", "--no-commit-id", "-r", "--unified=0", "--diff-filter=d", "-m")


def commit_diffs(found: DataFrame, root: str) -> DataFrame:
    """``found`` (commits) with ``diff``: what each commit adds, against every parent; ``failed`` where git gives none."""
    names = found.columns

    def diffs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            held, size = [], 0
            for row in p.itertuples(index=False):
                try:
                    text, failed = git(root, *DIFF_TREE, *(["--root"] if row.is_root else []), row.hash).decode("utf-8", "replace"), False
                except GitError:
                    text, failed = "", True
                held.append((*row, text, failed))
                size += len(text)
                if size >= BATCH:
                    yield pd.DataFrame(held, columns=[*names, "diff", "failed"])
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=[*names, "diff", "failed"])

    spread = found.repartition(found.sparkSession.sparkContext.defaultParallelism, "hash")
    return spread.mapInPandas(diffs, found.withColumn("diff", F.lit("")).withColumn("failed", F.lit(False)).schema)


def commit_branches(hashes: DataFrame, root: str) -> DataFrame:
    """(hash, branches): sorted names of branches that contain each distinct hash; empty where git fails."""

    def branches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            names = [sorted(filter(None, git(root, "branch", "--contains", h, "--format=%(refname:short)", check=False).decode().split("\n"))) if re.fullmatch("[0-9a-fA-F]+", h) else [] for h in p["hash"]]
            yield pd.DataFrame({"hash": p["hash"], "branches": names})

    return hashes.select("hash").distinct().mapInPandas(branches, "hash string, branches array<string>")
