"""Project configuration: discovery, loading, merging, and the scan context built from it (control plane, no jobs)."""

from __future__ import annotations

import os
import tomllib
import warnings
from dataclasses import dataclass, field, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.predicates import CONFIG_FILE
from .rules import PUBLIC_KEY_RULES, CompiledRules, Rule, compile_pattern, compile_rules, default_rules, merge_rules, rules_from_dicts


class ConfigError(ValueError):
    """A configuration that was named explicitly can't be used."""


@dataclass(frozen=True)
class RuleAllow:
    id: str
    regexes: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class ProjectConfig:
    paths: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()
    rule_allow: tuple[RuleAllow, ...] = ()
    entropy_threshold: float | None = None
    detect_public_keys: bool | None = None
    rules: tuple[Rule, ...] = ()
    include_ignored: bool | None = None
    exclude_patterns: tuple[str, ...] = ()
    include_patterns: tuple[str, ...] = ()


def from_toml(text: str) -> ProjectConfig:
    """Unknown keys are let be; missing ones have defaults."""
    t = tomllib.loads(text)
    allow, settings, audit = t.get("allowlist", {}), t.get("settings", {}), t.get("audit", {})
    threshold = settings.get("entropy_threshold")
    return ProjectConfig(
        tuple(allow.get("paths", ())), tuple(allow.get("stopwords", ())),
        tuple(RuleAllow(r["id"], tuple(r.get("regexes", ())), tuple(r.get("paths", ()))) for r in allow.get("rules", ())),
        None if threshold is None else float(threshold), settings.get("detect_public_keys"), rules_from_dicts(t.get("rules", [])),
        audit.get("include_ignored"), tuple(audit.get("exclude_patterns", ())), tuple(audit.get("include_patterns", ())),
    )


def load_lenient(path: Path) -> ProjectConfig | None:
    """None if missing or blank; a broken file is skipped with a warning."""
    try:
        text = path.read_text()
        return from_toml(text) if text.strip() else None
    except FileNotFoundError:
        return None
    except (OSError, ValueError, KeyError, TypeError) as e:
        warnings.warn(f"{path} is skipped: {e}", stacklevel=2)
        return None


def load_strict(paths: list[Path]) -> ProjectConfig:
    """Files named explicitly, later ones on top; each must be there and valid."""
    try:
        return merge_all([from_toml(Path(p).read_text()) for p in paths])
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise ConfigError(str(e)) from e


def union(a: tuple, b: tuple) -> tuple:
    """``a``, then what ``b`` has besides, in order; repeats inside ``a`` stay."""
    out = list(a)
    for x in b:
        if x not in out:
            out.append(x)
    return tuple(out)


def merge_rule_allow(a: tuple[RuleAllow, ...], b: tuple[RuleAllow, ...]) -> tuple[RuleAllow, ...]:
    out = {r.id: r for r in a}
    for r in b:
        o = out.get(r.id)
        out[r.id] = r if o is None else RuleAllow(r.id, union(o.regexes, r.regexes), union(o.paths, r.paths))
    return tuple(out.values())


def merge_two(base: ProjectConfig, over: ProjectConfig) -> ProjectConfig:
    """Scalars of ``over`` win where set, lists are united, rules are merged by id."""
    pick = lambda k: getattr(base, k) if getattr(over, k) is None else getattr(over, k)
    lists = {k: union(getattr(base, k), getattr(over, k)) for k in ("paths", "stopwords", "exclude_patterns", "include_patterns")}
    scalars = {k: pick(k) for k in ("entropy_threshold", "detect_public_keys", "include_ignored")}
    return ProjectConfig(**lists, **scalars, rule_allow=merge_rule_allow(base.rule_allow, over.rule_allow), rules=merge_rules(base.rules, over.rules))


def merge_all(configs: list[ProjectConfig]) -> ProjectConfig:
    return reduce(merge_two, configs, ProjectConfig())


def discover(start: Path, home: Path | None = None, system: Path = Path("/etc"), xdg: Path | None = None) -> list[Path]:
    """Candidate files from lowest to highest priority: system, XDG, then home down to ``start``.

    A start outside home has only its own file."""
    start, home = Path(start).resolve(), Path(home or Path.home()).resolve()
    xdg = xdg or Path(os.environ.get("XDG_CONFIG_HOME") or home / ".config")
    chain = [p for p in (start, *start.parents) if p == home or home in p.parents] if start == home or home in start.parents else [start]
    return [system / CONFIG_FILE.lstrip("."), xdg / "leakscan" / CONFIG_FILE.lstrip("."), *(p / CONFIG_FILE for p in reversed(chain))]


def discover_and_load(start: Path, home: Path | None = None, **where) -> ProjectConfig:
    return merge_all([c for p in discover(start, home, **where) if (c := load_lenient(p)) is not None])


@dataclass(frozen=True)
class ScanContext:
    """Compiled rules and everything that suppresses findings."""

    rules: CompiledRules
    paths: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()
    rule_allow: tuple[RuleAllow, ...] = ()
    entropy_threshold: float | None = None
    detect_public_keys: bool = False
    config: ProjectConfig = field(default_factory=ProjectConfig)


def build_context(spark: SparkSession, config: ProjectConfig | None = None, no_defaults: bool = False, **overrides) -> ScanContext:
    """A context from the built-in rules, the configuration and, above both, ``overrides`` (fields of ProjectConfig)."""
    config = merge_two(config or ProjectConfig(), replace(ProjectConfig(), **overrides))
    rules = merge_rules(() if no_defaults else default_rules(), config.rules)
    if not rules:
        warnings.warn("no rules are left", stacklevel=2)
    own = tuple(RuleAllow(r.id, r.allowed_values, r.allowed_paths) for r in rules if r.allowed_values or r.allowed_paths)
    compiled = compile_rules(spark, rules)
    for p in (*config.paths, *config.exclude_patterns, *config.include_patterns, *(x for a in (*own, *config.rule_allow) for x in (*a.regexes, *a.paths))):
        compile_pattern(spark, p)  # a bad pattern is named here, before any job
    keys = bool(config.detect_public_keys)
    return ScanContext(compiled if keys else compiled.without(PUBLIC_KEY_RULES), config.paths, config.stopwords, merge_rule_allow(own, config.rule_allow), config.entropy_threshold, keys, config)
