"""Scan options: defaults, a file, then the caller's; every problem is reported at once."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from ..errors import ConfigError
from ..functions.severity import CONFIDENCES, SEVERITIES

NAMES = (".sparkwarden.yml", ".sparkwarden.yaml")

# Folders and files that are generated or foreign.
DEFAULT_EXCLUDES = (
    "**/.git/**",
    "**/node_modules/**",
    "**/vendor/**",
    "**/bower_components/**",
    "**/dist/**",
    "**/build/**",
    "**/out/**",
    "**/target/**",
    "**/.next/**",
    "**/__pycache__/**",
    "**/.venv/**",
    "**/venv/**",
    "**/.tox/**",
    "**/.mypy_cache/**",
    "**/.pytest_cache/**",
    "**/.ruff_cache/**",
    "**/coverage/**",
    "**/htmlcov/**",
    "**/.idea/**",
    "**/.vscode/**",
    "**/*.min.js",
    "**/*.min.css",
    "**/*.map",
    "**/*.lock",
    "**/package-lock.json",
    "**/yarn.lock",
    "**/poetry.lock",
    "**/Cargo.lock",
    "**/composer.lock",
    "**/.sparkwarden/**",
    "**/.sparkwarden-baseline.json",
)

_LISTS = ("exclude", "include", "rule_dirs", "select", "ignore_rules", "categories")


@dataclass(frozen=True)
class ScanConfig:
    root: str = "."
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    no_default_excludes: bool = False
    rule_dirs: tuple[str, ...] = ()
    no_default_rules: bool = False
    select: tuple[str, ...] = ()
    ignore_rules: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    severity_overrides: dict[str, str] = field(default_factory=dict)
    min_severity: str = "info"
    fail_on: str = "high"
    min_confidence: str = "low"
    entropy: bool = True
    entropy_threshold: float = 4.0
    suppressions: bool = True
    respect_gitignore: bool = True
    max_file_bytes: int = 2_000_000
    max_findings: int = 0
    baseline: str | None = None
    state_dir: str = ".sparkwarden"
    match_engine: str = "python"
    number_by_line: bool = False  # occurrences count findings, one a line, not all matches
    source: str | None = None

    @property
    def excludes(self) -> tuple[str, ...]:
        return self.exclude if self.no_default_excludes else (*DEFAULT_EXCLUDES, *self.exclude)

    def merge(self, **given: object) -> ScanConfig:
        """Lists add up, None means not given, the rest replaces."""
        given = {k: v for k, v in given.items() if v is not None}
        if unknown := set(given) - {f.name for f in fields(self)}:
            raise ConfigError(f"unknown options: {', '.join(sorted(unknown))}")
        for k in _LISTS:
            if k in given:
                given[k] = (*getattr(self, k), *map(str, given[k]))
        if "severity_overrides" in given:
            given["severity_overrides"] = self.severity_overrides | given["severity_overrides"]
        return replace(self, **given)

    def problems(self) -> list[str]:
        out = [f"the path to scan is not there: {self.root}"] if not Path(self.root).exists() else []
        if self.min_severity not in SEVERITIES:
            out.append(f"min_severity must be one of {', '.join(SEVERITIES)}, not {self.min_severity!r}")
        if self.fail_on not in (*SEVERITIES, "never"):
            out.append(f"fail_on must be 'never' or one of {', '.join(SEVERITIES)}, not {self.fail_on!r}")
        if self.min_confidence not in CONFIDENCES:
            out.append(f"min_confidence must be one of {', '.join(CONFIDENCES)}, not {self.min_confidence!r}")
        out += [f"severity_overrides: {k} must not be {v!r}" for k, v in self.severity_overrides.items() if v not in SEVERITIES]
        if not 0 < self.entropy_threshold <= 8:
            out.append("entropy_threshold must lie between 0 and 8 bits a character")
        if self.max_file_bytes < 1:
            out.append("max_file_bytes must be 1 or more")
        if self.max_findings < 0:
            out.append("max_findings must not be negative")
        if self.match_engine not in ("python", "native"):
            out.append("match_engine must be 'python' or 'native'")
        out += [f"the rule folder is not there: {d}" for d in self.rule_dirs if not Path(d).exists()]
        if self.baseline is not None and not Path(self.baseline).exists():
            out.append(f"the baseline is not there: {self.baseline}")
        if self.no_default_rules and not self.rule_dirs:
            out.append("no_default_rules without rule_dirs leaves no rule")
        return out

    def check(self) -> ScanConfig:
        if problems := self.problems():
            raise ConfigError("\n".join(["invalid configuration:", *(f"  - {p}" for p in problems)]))
        return self


def find(start: str | Path) -> Path | None:
    """The next configuration file upwards, not beyond a checkout's root."""
    at = Path(start).resolve()
    for folder in [at, *at.parents] if at.is_dir() else at.parents:
        for name in NAMES:
            if (folder / name).is_file():
                return folder / name
        if (folder / ".git").exists():
            return None
    return None


_WORDS = {"true": True, "yes": True, "on": True, "1": True, "false": False, "no": False, "off": False, "0": False}


def _coerce(name: str, value: object, default: object) -> object:
    if isinstance(default, bool):
        if isinstance(value, bool):
            return value
        if str(value).strip().lower() in _WORDS:
            return _WORDS[str(value).strip().lower()]
        raise ConfigError(f"{name} must be true or false, not {value!r}")
    if isinstance(default, (int, float)):
        try:
            return type(default)(value)
        except (TypeError, ValueError):
            raise ConfigError(f"{name} must be a number, not {value!r}") from None
    if isinstance(default, tuple):
        return (str(value),) if isinstance(value, str) else tuple(map(str, value or ()))
    return value


def load(root: str | Path = ".", path: str | Path | None = None) -> ScanConfig:
    """From the given file, else from the next one upwards, else the defaults."""
    base = ScanConfig(root=str(root))
    found = Path(path) if path else find(root)
    if found is None:
        return base
    if not found.is_file():
        raise ConfigError(f"the configuration file is not there: {found}")
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("a configuration file needs the yaml package") from e
    try:
        data = yaml.safe_load(found.read_text("utf-8")) or {}
    except yaml.YAMLError as e:
        raise ConfigError(f"{found}: {e}") from e
    known = {f.name for f in fields(ScanConfig)} - {"root", "source"}
    if not isinstance(data, dict) or set(data) - known:
        raise ConfigError(f"{found}: unknown keys: {', '.join(sorted(map(str, set(data) - known)))}" if isinstance(data, dict) else f"{found}: a mapping is expected")
    values = {k: _coerce(k, v, getattr(base, k)) for k, v in data.items() if v is not None}
    beside = lambda p: str(found.parent / p)
    if "rule_dirs" in values:
        values["rule_dirs"] = tuple(map(beside, values["rule_dirs"]))
    if "baseline" in values:
        values["baseline"] = beside(values["baseline"])
    return replace(base, **values, source=str(found))
