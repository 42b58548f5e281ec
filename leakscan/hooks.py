"""Workstation hooks: a git pre-commit hook and an agent's read hook that run this engine (control plane, no jobs)."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
from pathlib import Path

MARKER = "# leakscan pre-commit check"
SCRIPT = f"""{MARKER}
python -m leakscan.cli --root "$(git rev-parse --show-toplevel)" scan
status=$?
if [ "$status" -ne 0 ]; then
    [ "$status" -eq 1 ] || echo "leakscan ended with status $status" >&2
    exit "$status"
fi
"""
AGENT_COMMAND = "python -m leakscan.cli check-file"
#: How an agent's settings name a hook before a file is read.
EVENT, TOOL = "PreToolUse", "Read"


class HookError(ValueError):
    """A hook that can't be installed."""


def expand_tilde(path: str, home: Path | None = None) -> Path:
    """``~`` and ``~/...`` in the home folder; all else as it is (other users' homes are not looked up)."""
    home = home or Path.home()
    return home if path == "~" else home / path[2:] if path.startswith("~/") else Path(path)


def insert_before_exit(text: str, script: str) -> str:
    """``script`` before the last line if that is an exit, else at the end."""
    lines = text.rstrip().splitlines(keepends=True)
    if lines and (lines[-1].split() or [""])[0] == "exit":
        kept = len("".join(lines[:-1]))
        return text[:kept] + script + "\n" + text[kept:]
    return text + ("" if text.endswith("\n") or not text else "\n") + script


def write_json(path: Path, value) -> None:
    """Whole or not at all: a new file in the same folder, synced, then renamed over the old one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    at, name = tempfile.mkstemp(dir=path.parent, prefix=path.name)  # created exclusively
    try:
        with os.fdopen(at, "w") as f:
            json.dump(value, f, indent=2)
            f.write("\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def _git(*args: str, root: str = ".") -> str | None:
    """What git says, or None if it fails."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    except FileNotFoundError as e:
        raise HookError("git was not found") from e
    return done.stdout.strip() if not done.returncode else None


def hooks_dir(root: str, shared: bool = False, home: Path | None = None) -> Path:
    """The folder of a repository's hooks, or of all repositories' (the configured one, else below the home folder)."""
    if shared:
        named = _git("config", "--global", "core.hooksPath")
        return expand_tilde(named, home) if named else (home or Path.home()) / ".config/git/hooks"
    found = _git("rev-parse", "--git-path", "hooks", root=root)
    if found is None:
        raise HookError(f"{root} is not in a git repository")
    return Path(root) / found


def install_pre_commit(folder: Path) -> str:
    """'created', 'added' to a hook that was there, or 'present'."""
    hook = Path(folder) / "pre-commit"
    old = hook.read_text() if hook.exists() else None
    if old is not None and MARKER in old:
        return "present"
    hook.parent.mkdir(parents=True, exist_ok=True)
    hook.write_text("#!/bin/sh\n" + SCRIPT if old is None else insert_before_exit(old, SCRIPT))
    mode = hook.stat().st_mode
    hook.chmod(mode | (mode & 0o444) >> 2)
    return "created" if old is None else "added"


def _child(parent: dict, key: str, kind: type, where: Path):
    found = parent.setdefault(key, kind())
    if not isinstance(found, kind):
        raise HookError(f"{where}: {key} is not {'a table' if kind is dict else 'a list'}")
    return found


def install_agent_hook(settings: Path) -> str:
    """'created', 'updated' (an older command of ours) or 'present'; all else in the settings stays."""
    try:
        value = json.loads(settings.read_text()) if settings.exists() and settings.read_text().strip() else {}
    except ValueError as e:
        raise HookError(f"{settings}: {e}") from e
    if not isinstance(value, dict):
        raise HookError(f"{settings} is not a table")
    entry = {"type": "command", "command": AGENT_COMMAND, "timeout": 60}
    events = _child(_child(value, "hooks", dict, settings), EVENT, list, settings)
    readers = [x for x in events if isinstance(x, dict) and x.get("matcher") == TOOL]
    own = [(_child(x, "hooks", list, settings), i) for x in readers for i, h in enumerate(_child(x, "hooks", list, settings)) if isinstance(h, dict) and "leakscan" in str(h.get("command", ""))]
    if any(hooks[i]["command"] == AGENT_COMMAND for hooks, i in own):
        return "present"
    if own:
        hooks, i = own[0]
        hooks[i] = entry
    elif readers:
        readers[0]["hooks"].append(entry)
    else:
        events.append({"matcher": TOOL, "hooks": [entry]})
    write_json(settings, value)
    return "updated" if own else "created"


def hook_status(folder: Path | None) -> tuple[str, str]:
    """(status, message) of a folder's pre-commit hook; one that isn't installed is no issue."""
    hook = folder / "pre-commit" if folder else None
    if hook is None or not hook.exists() or MARKER not in hook.read_text(errors="replace"):
        return "not installed", f"no hook in {folder}" if folder else "not in a git repository"
    return ("ok", f"{hook}") if os.access(hook, os.X_OK) else ("warn", f"{hook} can't be executed")


def agent_status(settings: Path) -> tuple[str, str]:
    try:
        text = settings.read_text()
        json.loads(text)
    except FileNotFoundError:
        return "not installed", f"no {settings}"
    except (OSError, ValueError) as e:
        return "error", f"{settings}: {e}"
    return ("ok", str(settings)) if AGENT_COMMAND in text else ("not installed", f"no hook in {settings}")
