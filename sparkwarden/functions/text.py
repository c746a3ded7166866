"""Text expressions: lines, positions, snippets, masks, entropy, fingerprints, languages."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u241f"  # fixed value: stands between the parts of a fingerprint
HIDDEN = "………"  # fixed value: stands for a secret of at most eight characters
MAX_MATCH = 240
CONTEXT = 2
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
BLANK = "[\\s\\x1c-\\x1f]"  # with (?U): the characters that str.strip() drops

# ---- as columns ----------------------------------------------------------


def lines(text: Column) -> Column:
    """As ``str.splitlines``."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)\\A{BLANK}+|{BLANK}+\\z", "")


def lead(match: Column) -> Column:
    """Length of the leading white space."""
    return F.length(F.regexp_extract(match, f"(?U)\\A{BLANK}*", 0))


def line_of(text: Column, start: Column) -> Column:
    before = F.substring(text, F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, start: Column) -> Column:
    """Code points since the last line feed."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), start), "\n", -1))


def flat(match: Column) -> Column:
    """White space collapsed."""
    return strip(F.regexp_replace(match, f"(?U){BLANK}+", " "))


def snippet(all_lines: Column, line: Column) -> Column:
    return strip(F.coalesce(F.get(all_lines, line - 1), F.lit("")))


def context(all_lines: Column, line: Column) -> Column:
    """Up to two lines either side, numbered."""
    first = F.greatest(line - CONTEXT, F.lit(1))
    some = F.slice(all_lines, first, line + CONTEXT - first + 1)
    number = lambda i: (first + i).cast("string")
    return F.transform(some, lambda x, i: F.concat(F.when(F.length(number(i)) < 5, F.lpad(number(i), 5, " ")).otherwise(number(i)), F.lit(" | "), x))


def mask(value: Column) -> Column:
    return F.when(F.length(value) <= 8, F.lit(HIDDEN)).otherwise(F.concat(F.substring(value, 1, 4), F.lit("…[redacted, "), F.length(value).cast("string"), F.lit(" chars]")))


def secret_span(match: Column) -> Column:
    """The value of an assignment if it is long enough and the match is no address, else the whole match."""
    value = F.regexp_replace(strip(F.substring(match, F.locate("=", match) + 1, F.length(match))), "\\A[\"']+|[\"']+\\z", "")
    plain = match.contains("=") & ~match.contains("@") & ~match.contains("//")
    return F.when(plain & (F.length(value) >= 8), value).otherwise(match)


def mask_all(text: Column, secrets: Column) -> Column:
    """Replace every secret, longest first, also in its collapsed form."""
    forms = F.array_distinct(F.flatten(F.transform(secrets, lambda s: F.array(F.struct(s.alias("raw"), mask(s).alias("to")), F.struct(flat(s).alias("raw"), mask(s).alias("to"))))))
    order = F.array_sort(forms, lambda a, b: F.when(F.length(a["raw"]) != F.length(b["raw"]), F.length(b["raw"]) - F.length(a["raw"])).when(a["raw"] < b["raw"], -1).when(a["raw"] > b["raw"], 1).otherwise(0))
    return F.aggregate(order, text, lambda t, f: F.when(f["raw"] == "", t).otherwise(F.replace(t, f["raw"], f["to"])))


def fingerprint(rule_id: Column, path: Column, match: Column, occurrence: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, rule_id, path, flat(match), occurrence.cast("string")), 256), 1, 16)


def cache_id(fp: Column) -> Column:
    """First 32 bits as an unsigned number."""
    return F.conv(F.substring(fp, 1, 8), 16, 10).cast("long")


def char_counts(value: Column) -> Column:
    chars = F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")
    return F.transform(chars, lambda c: F.length(value) - F.length(F.replace(value, c, F.lit(""))))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character."""
    share = F.transform(char_counts(value), lambda n: n / F.length(value))
    return F.when(value == "", 0.0).otherwise(-F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p)))


def repeat_share(value: Column) -> Column:
    return F.array_max(char_counts(value)) / F.length(value)


# ---- as Python values, for the per-file pass ------------------------------


def mask_text(value: str) -> str:
    return HIDDEN if len(value) <= 8 else f"{value[:4]}…[redacted, {len(value)} chars]"


def secret_span_text(match: str) -> str:
    if "=" in match and "@" not in match and "//" not in match:
        value = match.partition("=")[2].strip().strip("\"'")
        if len(value) >= 8:
            return value
    return match


def collapse(text: str) -> str:
    return " ".join(text.split())


def fingerprint_text(rule_id: str, path: str, match: str, occurrence: int) -> str:
    return hashlib.sha256(SEPARATOR.join((rule_id, path, collapse(match), str(occurrence))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def entropy_text(value: str) -> float:
    n = len(value)
    return -sum(p * math.log2(p) for p in (value.count(c) / n for c in dict.fromkeys(value))) if n else 0.0


# ---- languages -------------------------------------------------------------

# Which suffix or file name has which language, and which lexer shows it.
BY_SUFFIX = {
    ".py": "python",
    ".pyi": "python",
    ".pyw": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".php": "php",
    ".phtml": "php",
    ".php5": "php",
    ".php7": "php",
    ".inc": "php",
    ".rb": "ruby",
    ".erb": "ruby",
    ".rake": "ruby",
    ".go": "go",
    ".java": "java",
    ".jsp": "java",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".cs": "csharp",
    ".cshtml": "csharp",
    ".razor": "csharp",
    ".rs": "rust",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
    ".swift": "swift",
    ".scala": "scala",
    ".ex": "elixir",
    ".exs": "elixir",
    ".pl": "perl",
    ".pm": "perl",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".ksh": "shell",
    ".ps1": "powershell",
    ".psm1": "powershell",
    ".sql": "sql",
    ".html": "html",
    ".htm": "html",
    ".vue": "html",
    ".svelte": "html",
    ".twig": "html",
    ".blade": "html",
    ".jinja": "html",
    ".j2": "html",
    ".hbs": "html",
    ".css": "css",
    ".scss": "css",
    ".sass": "css",
    ".less": "css",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".json": "json",
    ".toml": "toml",
    ".xml": "xml",
    ".plist": "xml",
    ".tf": "terraform",
    ".tfvars": "terraform",
    ".hcl": "hcl",
    ".env": "env",
    ".ini": "ini",
    ".cfg": "ini",
    ".conf": "ini",
    ".properties": "ini",
    ".gradle": "gradle",
    ".md": "markdown",
    ".mdx": "markdown",
    ".rst": "markdown",
    ".txt": "text",
    ".tpl": "text",
    ".tmpl": "text",
    ".pem": "pem",
    ".key": "pem",
    ".crt": "pem",
    ".p12": "pem",
    ".pfx": "pem",
}
BY_NAME = {
    "dockerfile": "dockerfile",
    "containerfile": "dockerfile",
    "makefile": "make",
    "jenkinsfile": "groovy",
    "gemfile": "ruby",
    "rakefile": "ruby",
    "procfile": "text",
    ".env": "env",
    ".npmrc": "ini",
    ".netrc": "ini",
    ".htaccess": "apache",
    "nginx.conf": "nginx",
    "id_rsa": "pem",
    "id_dsa": "pem",
    "id_ecdsa": "pem",
    "id_ed25519": "pem",
}
LEXERS = {
    "javascript": "javascript",
    "typescript": "typescript",
    "python": "python",
    "php": "php",
    "ruby": "ruby",
    "go": "go",
    "java": "java",
    "csharp": "csharp",
    "rust": "rust",
    "shell": "bash",
    "sql": "sql",
    "yaml": "yaml",
    "json": "json",
    "html": "html",
    "terraform": "terraform",
    "dockerfile": "docker",
}


def language_of(path: str) -> str:
    """By name, by name and a dot, by last suffix, by any suffix from the right; else empty."""
    name = re.split(r"[/\\]", path)[-1].lower()
    if name in BY_NAME:
        return BY_NAME[name]
    for stem, language in BY_NAME.items():
        if name.startswith(stem + "."):
            return language
    parts = name.lstrip(".").split(".") if not name.startswith(".") else name[1:].split(".")
    for part in reversed(parts[1:]):
        if (language := BY_SUFFIX.get("." + part)) is not None:
            return language
    return ""


def language(path: Column) -> Column:
    """``language_of`` as a column."""
    name = F.lower(F.regexp_extract(path, r"[^/\\]*\z", 0))
    names = F.create_map(*[F.lit(x) for kv in BY_NAME.items() for x in kv])
    suffixes = F.create_map(*[F.lit(x) for kv in BY_SUFFIX.items() for x in kv])
    parts = F.slice(F.split(F.regexp_replace(name, r"\A\.", ""), r"\.", -1), 2, 1_000)
    known = F.filter(F.reverse(F.transform(parts, lambda p: F.try_element_at(suffixes, F.concat(F.lit("."), p)))), lambda x: x.isNotNull())
    by_stem = [F.when(name.startswith(stem + "."), F.lit(lang)) for stem, lang in BY_NAME.items()]
    return F.coalesce(F.try_element_at(names, name), *by_stem, F.get(known, F.lit(0)), F.lit(""))
