"""Command line: scan staged changes, audit a tree or history, check one file, install hooks, check the installation."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hooks
from .config import ConfigError, ScanContext, build_context, discover, discover_and_load, load_strict
from .functions.predicates import audit_keeps, is_blocked_env, is_path_skipped
from .operators import history as H
from .operators.detect import detect
from .operators.search import search
from .rules import RuleError
from .sources import git as G
from .sources.diff import added_lines, diff_files
from .sources.text import lines_from_files, lines_of, read_files

MAX_STDIN = 1 << 20


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("leakscan")
    p.add_argument("--root", default=".")
    p.add_argument("--config", action="append", default=[])
    p.add_argument("--no-defaults", action="store_true")
    p.add_argument("--entropy-threshold", type=float)
    p.add_argument("--detect-public-keys", action="store_true", default=None)
    p.add_argument("--allow-path", action="append", default=[])
    p.add_argument("--stopword", action="append", default=[])
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("scan")
    a = sub.add_parser("audit")
    for flag in ("--history", "--include-ignored"):
        a.add_argument(flag, action="store_true")
    for flag in ("--branch", "--since", "--until"):
        a.add_argument(flag)
    for flag in ("--search", "--search-regex", "--exclude", "--include"):
        a.add_argument(flag, action="append", default=[])
    c = sub.add_parser("check-file")
    c.add_argument("path", nargs="?")
    i = sub.add_parser("install")
    i.add_argument("target", choices=["pre-commit", "agent-hook", "all"])
    i.add_argument("--global", dest="shared", action="store_true")
    sub.add_parser("doctor")
    return p


def context(spark: SparkSession, o: argparse.Namespace, root: str) -> ScanContext:
    """Explicit configurations replace discovery; flags stand above both."""
    config = load_strict(o.config) if o.config else discover_and_load(Path(root))
    more = {"exclude_patterns": tuple(getattr(o, "exclude", ())), "include_patterns": tuple(getattr(o, "include", ()))}
    return build_context(spark, config, o.no_defaults, entropy_threshold=o.entropy_threshold, detect_public_keys=o.detect_public_keys, paths=tuple(o.allow_path), stopwords=tuple(o.stopword), **more)


def show(rows: DataFrame, *columns: str) -> int:
    n = 0
    for r in rows.select(*columns).toLocalIterator():
        print("  ".join(str(x) for x in r), file=sys.stderr)
        n += 1
    return n


def scan(spark: SparkSession, o: argparse.Namespace) -> int:
    diffs = G.staged_diff(spark, o.root)
    if not diffs.take(1):
        return 0
    ctx = context(spark, o, G.repo_root(o.root))
    blocked = H.blocked_files(diff_files(diffs))
    lines = H.without_blocked(added_lines(diffs))
    return int(show(H.report_rows(detect(lines, ctx, ["diff_id", "file_ord"], ordered=True), blocked), "path", "line", "rule_id", "shown") > 0)


def say(text: str) -> None:
    print(text, file=sys.stderr)


def show_commits(rows: DataFrame) -> int:
    """A paragraph for each commit, a line for each of its rows."""
    n = 0
    for r in rows.toLocalIterator():
        say(f"commit {r['short']} ({r['author']} <{r['email']}>, {r['date']})" + (f" in {r['branches']}" if "branches" in r and r["branches"] else ""))
        for x in r["found"]:
            say("  " + "  ".join(map(str, x)))
            n += 1
    return n


def audit_history(spark: SparkSession, o: argparse.Namespace, ctx: ScanContext, keeps) -> int:
    found = G.commits(spark, o.root, o.branch, o.since, o.until)
    diffs = G.commit_diffs(found, o.root).withColumnRenamed("commit_ord", "diff_id").persist(StorageLevel.DISK_ONLY)  # git runs once a commit
    try:
        total, errors = diffs.agg(F.count("*"), F.coalesce(F.sum(F.col("failed").cast("int")), F.lit(0))).first()
        say(f"{total} commits" + (f", {errors} could not be read" if errors else ""))
        meta = found.drop("is_root")
        lines = added_lines(diffs).withColumnRenamed("diff_id", "commit_ord").where(keeps)
        rows = H.dedup_findings(detect(lines, ctx, ["commit_ord", "file_ord"]).join(meta, "commit_ord")).persist(StorageLevel.DISK_ONLY)
        n = show_commits(H.report_by_commit(H.with_branches(rows, G.commit_branches(rows, o.root))))
        say(f"{n} secrets in {total} commits")
        rows.unpersist()
        if o.search or o.search_regex:
            hits = H.dedup_search(search(lines.join(meta, "commit_ord"), o.search, o.search_regex)).persist(StorageLevel.DISK_ONLY)
            m = show_commits(H.search_by_commit(H.with_branches(hits, G.commit_branches(hits, o.root))))
            say(f"{m} matches in {total} commits")
            hits.unpersist()
            n += m
    finally:
        diffs.unpersist()
    return 1 if n else 2 if errors else 0


def audit(spark: SparkSession, o: argparse.Namespace) -> int:
    if not o.history and (o.branch or o.since or o.until):
        raise ConfigError("--branch, --since and --until need --history")
    ctx = context(spark, o, o.root)
    keeps = audit_keeps(F.col("path"), ctx.config.exclude_patterns, ctx.config.include_patterns)
    if o.history:
        return audit_history(spark, o, ctx, keeps)
    names, errors = G.tracked_files(o.root)
    if o.include_ignored or ctx.config.include_ignored:
        more, skipped = G.ignored_files(o.root)
        names, errors = list(dict.fromkeys([*names, *more])), errors + skipped
    paths = [r["path"] for r in spark.createDataFrame([(x,) for x in names], "path string").where(keeps).collect()]
    there = [x for x in paths if not (Path(o.root) / x).is_symlink() and not (Path(o.root) / x).is_dir()]
    files = read_files(spark, there, str(Path(o.root).resolve())).persist(StorageLevel.DISK_ONLY)
    try:
        counts = H.counters(files).first()
        errors += counts["n_errors"]
        lines = lines_of(files)
        findings = detect(lines, ctx, ordered=True)
        n = show(H.report_rows(findings), "path", "line", "rule_id", "shown")
        of = H.summary(findings).first()["n_files"] if n else 0
        say(f"{counts['n_scanned']} files scanned, {n} secrets in {of} files" + (f", {errors} files could not be read" if errors else ""))
        if o.search or o.search_regex:
            n += show(H.search_report(search(lines, o.search, o.search_regex).orderBy("path", "line_no", "pattern_ord")), "path", "line_no", "pattern", "shown")
    finally:
        files.unpersist()
    return 1 if n else 2 if errors else 0


def check_file(spark: SparkSession, o: argparse.Namespace) -> int:
    """0 if clean or skipped, 2 if it must not be read. The path comes as an argument or as a hook's JSON."""
    name, base = o.path, Path(o.root)
    if name is None:
        payload = json.loads(sys.stdin.read(MAX_STDIN))
        own = payload.get("tool_input") if isinstance(payload, dict) else None
        name = own.get("file_path") if isinstance(own, dict) else None
        if not isinstance(name, str) or not name:
            raise ConfigError("the hook's JSON names no file")
        base = Path(payload["cwd"]) if isinstance(payload.get("cwd"), str) and payload["cwd"] else base
    path, base = Path(name or ""), base.resolve()
    if not name or not base.is_dir():
        return 2
    path = path if path.is_absolute() else (base / path).resolve()
    if not Path(name).is_absolute() and base not in path.parents:
        return 2
    rel, root = (str(path.relative_to(base)), str(base)) if base in path.parents else (path.name, str(path.parent))
    ctx = context(spark, o, root)
    p = F.lit(rel)
    env, skip = spark.range(1).select(is_blocked_env(p), is_path_skipped(p, ctx.paths) | ~audit_keeps(p, ctx.config.exclude_patterns)).first()
    if env:
        return 2
    if skip:
        return 0
    if not path.is_file():
        return 2
    if read_files(spark, [rel], root).where("status = 'binary'").take(1):
        return 0
    return 2 if show(H.report_rows(detect(lines_from_files(spark, [rel], root), ctx, ordered=True)), "path", "line", "rule_id", "shown") else 0


def install(spark: SparkSession, o: argparse.Namespace) -> int:
    """0 if all that was asked for is there now."""
    home = Path.home()
    if o.target in ("pre-commit", "all"):
        folder = hooks.hooks_dir(o.root, o.shared, home)
        say(f"pre-commit hook in {folder}: {hooks.install_pre_commit(folder)}")
        if o.shared:
            G.git(o.root, "config", "--global", "core.hooksPath", str(folder))
    if o.target in ("agent-hook", "all"):
        settings = (home if o.shared else Path(o.root)) / ".claude" / "settings.json"
        say(f"agent hook in {settings}: {hooks.install_agent_hook(settings)}")
    return 0


def doctor_rows(spark: SparkSession, o: argparse.Namespace) -> list[tuple[str, str, str]]:
    """(section, status, message); status is ok, warn, error or not installed."""
    try:
        root = G.repo_root(o.root)
    except G.GitError:
        root = None
    rows = [("git hook", *hooks.hook_status(hooks.hooks_dir(root) if root else None)), ("global git hook", *hooks.hook_status(hooks.hooks_dir(".", True)))]
    rows += [("agent hook", *hooks.agent_status(base / ".claude" / "settings.json")) for base in (Path(root or o.root), Path.home())]
    there = [Path(x) for x in o.config] or [p for p in discover(Path(root or o.root)) if p.exists()]
    rows += [("configuration", "ok", str(p)) for p in there] or [("configuration", "ok", "no file, the defaults hold")]
    for p in there:
        try:
            load_strict([p])
        except ConfigError as e:
            rows.append(("configuration", "error", f"{p}: {e}"))
    try:
        rows.append(("configuration", "ok", f"{len(context(spark, o, root or o.root).rules.rules)} rules loaded and compiled"))
    except (ConfigError, RuleError) as e:
        rows.append(("configuration", "error", str(e)))
    return rows


def doctor(spark: SparkSession, o: argparse.Namespace) -> int:
    """1 if any row is a warning or an error."""
    rows = spark.createDataFrame(doctor_rows(spark, o), "section string, status string, message string")
    for r in rows.collect():
        say(f"{r['section']}: {r['status']}: {r['message']}")
    return int(rows.agg(H.has_issues(F.col("status"))).first()[0])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("leakscan").getOrCreate()
    try:
        return {"scan": scan, "audit": audit, "check-file": check_file, "install": install, "doctor": doctor}[o.command](spark, o)
    except (ConfigError, RuleError, G.GitError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
