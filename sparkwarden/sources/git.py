"""What a git checkout says about its files; all calls run on the driver."""

from __future__ import annotations

import subprocess
from pathlib import Path

from ..errors import TargetError


def _git(root: str | Path, *args: str, stdin: str | None = None) -> subprocess.CompletedProcess[str] | None:
    try:
        return subprocess.run(["git", "-C", str(root), *args], input=stdin, capture_output=True, text=True, timeout=120, encoding="utf-8", errors="surrogateescape")
    except (OSError, subprocess.TimeoutExpired):
        return None


def toplevel(root: str | Path) -> Path | None:
    at = Path(root) if Path(root).is_dir() else Path(root).parent
    got = _git(at, "rev-parse", "--show-toplevel")
    return Path(got.stdout.strip()) if got and got.returncode == 0 and got.stdout.strip() else None


def listed(root: str | Path) -> list[str] | None:
    """Tracked files and untracked ones that are not ignored, relative to ``root``; None outside a checkout."""
    got = _git(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z")
    if got is None or got.returncode:
        return None
    return sorted({x for x in got.stdout.split("\0") if x and (Path(root) / x).is_file() and not (Path(root) / x).is_symlink()})


def ignored(root: str | Path, names: list[str]) -> set[str]:
    got = _git(root, "check-ignore", "-z", "--stdin", stdin="\0".join(names))
    return {x for x in got.stdout.split("\0") if x} if got and got.returncode in (0, 1) else set()


def changed(root: str | Path, ref: str | None = None, staged: bool = False) -> list[str]:
    """Files that differ from ``ref`` (or the index), deletions left out, relative to ``root``."""
    top = toplevel(root)
    if top is None:
        raise TargetError(f"{root} is not in a git checkout")
    got = _git(top, "diff", "--name-only", "--diff-filter=d", "-z", *(["--cached"] if staged else []), *([ref] if ref else []))
    if got is None or got.returncode:
        raise TargetError(f"git diff failed: {got.stderr.strip() if got else 'git did not run'}")
    here = Path(root).resolve()
    every = [(top.resolve() / x) for x in got.stdout.split("\0") if x]
    return sorted(str(p.relative_to(here)) for p in every if p.is_relative_to(here) and p.is_file())
