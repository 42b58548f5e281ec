"""Predicates on paths, secrets and lines as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import translate
from .scalars import unicode_trim

CONFIG_FILE = ".leakscan.toml"
# Fixed values of the predicates below.
BINARY_EXTENSIONS = "png jpg jpeg gif bmp ico svg woff woff2 ttf eot otf pdf exe dll so dylib zip gz tar bz2 xz 7z rar mp3 mp4 avi mov wav ogg webp webm".split()
GENERATED_FILES = "package-lock.json yarn.lock Cargo.lock go.sum pnpm-lock.yaml composer.lock Gemfile.lock poetry.lock Pipfile.lock".split()
GENERATED_EXTENSIONS = "min.js min.css js.map css.map".split()
VENDOR_DIRS = "node_modules/ vendor/ .bundle/ bower_components/ __pycache__/ .git/".split()
DOC_EXTENSIONS, DOC_PREFIXES, DOC_DIRS = "md rst adoc".split(), "readme changelog contributing license".split(), "docs/ doc/ documentation/ wiki/".split()
STOPWORDS = "example test sample placeholder dummy changeme fake mock todo fixme xxx lorem default replace_me insert_here your_ my_ <your".split()
HASH_WORDS = "commit merge cherry-pick revert sha sha1 sha256 md5 digest checksum hash integrity".split()
OPENSSH_PREFIXES = "ssh-rsa ssh-ed25519 ssh-dss ecdsa-sha2-nistp256 ecdsa-sha2-nistp384 ecdsa-sha2-nistp521 sk-ssh-ed25519@openssh.com sk-ecdsa-sha2-nistp256@openssh.com".split()
ENV_ALLOWED_SUFFIXES = "example sample template".split()
VARIABLE_PATTERNS = [
    r"^\$\{[A-Za-z_][A-Za-z0-9_]*\}$", r"^\$[A-Za-z_][A-Za-z0-9_]*$", r"^%[A-Za-z_][A-Za-z0-9_]*%$", r"^\{\{-?\s*[A-Za-z_.][^}]*\}\}$", r"^\{\{\{\s*[\w.]+\s*\}\}\}$",
    r"^\$\{\{\s*[A-Za-z_.][^}]*\}\}$", r"^<%[=-]?\s*[A-Za-z_$@][^%]*-?%>$", r"^<\?=\s*\$\w[^?]*\?>$", r"^\$\{(?:var|data|local|module)\.\w[\w.]*\}$", r"^\$\{[A-Za-z_]\w*[:][+\-=?][^}]*\}$",
    r"^<[A-Za-z][\w-]*>$", r"^\{[A-Za-z_][\w]{0,30}\}$", r"^#\{[\w.]+\}$", r"^\$!\{?[\w.]+\}?$", r"^%\{.+\}$", r"^\{[0-9]+\}$", r"^process\.env\.[A-Za-z_][A-Za-z0-9_]*$",
    r"""^os\.environ\[['"][A-Za-z_][A-Za-z0-9_]*['"]\]$""", r"""^os\.environ\.get\(['"][A-Za-z_][A-Za-z0-9_]*['"]\)$""", r"""^os\.getenv\(['"][A-Za-z_][A-Za-z0-9_]*['"]\)$""",
    r"""^System\.getenv\(['"][A-Za-z_][A-Za-z0-9_]*['"]\)$""", r"""^(?:std::)?env::var\(['"][A-Za-z_][A-Za-z0-9_]*['"]\)$""", r"""^os\.Getenv\(['"][A-Za-z_][A-Za-z0-9_]*['"]\)$""",
]


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def matches_any(value: Column, patterns: Iterable[str], anchored: bool = False) -> Column:
    """Whether one of the users' patterns is found in ``value``; ``anchored`` ones start at its beginning."""
    return any_of(value.rlike(translate(p if not anchored or p.startswith("^") else f"^{p}")) for p in patterns)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _in_dir(path: Column, dirs: list[str]) -> Column:
    """At the path's start, or first met right after a slash."""
    at = lambda d: F.instr(path, d)
    return any_of((at(d) == 1) | ((at(d) > 1) & (F.substring(path, at(d) - 1, F.lit(1)) == "/")) for d in dirs)


def is_path_skipped(path: Column, user_patterns: Iterable[str] = ()) -> Column:
    """Config file, binary extension, generated file, vendored directory, or a user's path pattern."""
    low = F.lower(path)
    has_dot = F.contains(low, F.lit("."))
    extension = has_dot & F.substring_index(low, ".", -1).isin(BINARY_EXTENSIONS)
    generated = any_of(F.endswith(low, F.lit("." + e)) for e in GENERATED_EXTENSIONS)
    lock = F.lower(basename(path)).isin([f.lower() for f in GENERATED_FILES])
    return (basename(path) == CONFIG_FILE) | extension | generated | lock | _in_dir(low, VENDOR_DIRS) | matches_any(path, user_patterns, anchored=True)


def is_documentation(path: Column) -> Column:
    low = F.lower(path)
    base = basename(low)
    return F.substring_index(base, ".", -1).isin(DOC_EXTENSIONS) | any_of(F.startswith(base, F.lit(p)) for p in DOC_PREFIXES) | _in_dir(low, DOC_DIRS)


def is_blocked_env(path: Column) -> Column:
    base = F.regexp_extract(F.lower(path), r"([^/\\]*)\z", 1)
    return (base == ".env") | (F.startswith(base, F.lit(".env.")) & ~F.substring(base, 6, 1 << 20).isin(ENV_ALLOWED_SUFFIXES))


def audit_keeps(path: Column, exclude: Iterable[str] = (), include: Iterable[str] = ()) -> Column:
    """Not excluded, or excluded and included."""
    return ~matches_any(path, exclude) | matches_any(path, include)


def is_variable_reference(secret: Column) -> Column:
    """One alternation of all patterns, tried only where the trimmed secret starts as one of them can."""
    text = unicode_trim(secret)
    return text.rlike(r"^[$%{<#posSe]") & text.rlike(translate("^(?:" + "|".join(p[1:-1] for p in VARIABLE_PATTERNS) + ")$"))


def is_template_line(line: Column) -> Column:
    pairs = [("{{", "}}"), ("{%", "%}"), ("{#", "#}"), ("<%", "%>"), ("<?=", "?>")]
    return any_of(F.contains(line, F.lit(a)) & F.contains(line, F.lit(b)) for a, b in pairs)


def is_placeholder(secret: Column) -> Column:
    return F.contains(F.lower(secret), F.lit("xxx"))


def has_stopword(secret: Column, more: Iterable[str] = ()) -> Column:
    """A stopword between non-letters in the lower-cased secret; ``xxx`` anywhere."""
    words = [w for w in (*STOPWORDS, *(w.lower() for w in more)) if w != "xxx" and w]
    pattern = "(?<![A-Za-z])(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words) + ")(?![A-Za-z])"
    return F.lower(secret).rlike(pattern) | is_placeholder(secret)


def is_hash_in_context(secret: Column, line: Column) -> Column:
    n = F.octet_length(secret)
    words = "|".join(w.replace("-", "\\-") for w in HASH_WORDS)
    return secret.rlike(r"^[0-9a-fA-F]+\z") & (n.isin(32, 40, 64) | n.between(7, 12)) & line.rlike(f"(?i)(?<![A-Za-z0-9])(?:{words})(?![A-Za-z0-9])")


def ascii_trim(s: Column) -> Column:
    return F.btrim(s, F.lit(" \t\n\r\f"))


def is_openssh_public_key(line: Column) -> Column:
    return any_of(F.startswith(ascii_trim(line), F.lit(p + " AAAA")) for p in OPENSSH_PREFIXES)


def public_key_marker(line: Column) -> Column:
    """'B' at the header of a PEM or PGP public key block, 'E' at its end, else null."""
    t = ascii_trim(line)
    pem = lambda word: t.rlike(rf"(?is)^-----{word} (?=.*PUBLIC KEY)(?!.*PRIVATE).*----\z")
    pgp = lambda word: F.startswith(F.upper(t), F.lit(f"-----{word} PGP PUBLIC KEY BLOCK-----"))
    return F.when(F.startswith(t, F.lit("-----")), F.when(pem("BEGIN") | pgp("BEGIN"), "B").when(pem("END") | pgp("END"), "E"))
