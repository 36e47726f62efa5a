"""Per-entry classification expressions (B18-B23): language, category, size, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Extension -> Markdown fence language; the lookup is case-SENSITIVE.
LANGUAGE_BY_EXT = {
    "rs": "rust", "js": "javascript", "ts": "typescript", "py": "python", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "cs": "csharp", "go": "go", "rb": "ruby", "php": "php", "swift": "swift",
    "kt": "kotlin", "scala": "scala", "r": "r", "m": "objective-c", "pl": "perl",
    "lua": "lua", "sh": "bash", "bash": "bash", "sql": "sql", "html": "html", "htm": "html",
    "css": "css", "xml": "xml", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "md": "markdown",
}
# Extension -> file category; the lookup is case-INSENSITIVE.
CATEGORY_EXTS = [
    ("Code", ["rs", "py", "js", "ts", "jsx", "tsx", "go", "cpp", "c", "h", "java", "kt", "swift"]),
    ("Config", ["toml", "json", "yaml", "yml", "xml", "ini", "cfg", "conf"]),
    ("Document", ["md", "txt", "rst", "adoc"]),
    ("Image", ["png", "jpg", "jpeg", "gif", "svg", "webp"]),
    ("Archive", ["zip", "tar", "gz", "rar", "7z"]),
]
DEFAULT_CATEGORY = "File"
# Read-strategy threshold: sizes below are "small", at or above "large".
SIZE_CLASS_THRESHOLD = 256 * 1024
# Token-level bucket bounds (Low below the first, Medium below the second, else High).
TOKEN_LEVEL_BOUNDS = {
    "type": (1000, 10000),      # token-count type
    "footer": (10000, 50000),   # status-bar indicator
    "docs": (8000, 32000),      # documentation
}
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Built once as SQL text: one JVM call per use instead of one per literal.
_LANG_MAP_SQL = "map(" + ", ".join(f"{_q(k)}, {_q(v)}" for k, v in LANGUAGE_BY_EXT.items()) + ")"


def language_of(ext) -> Column:
    """Fence language for an extension; '' when unknown (case-sensitive)."""
    return F.coalesce(F.try_element_at(F.expr(_LANG_MAP_SQL), _c(ext)), F.lit(""))


def file_category(ext) -> Column:
    """Code/Config/Document/Image/Archive/File from a lower-cased extension."""
    e = F.lower(_c(ext))
    out = None
    for cat, exts in CATEGORY_EXTS:
        cond = e.isin(exts)
        out = F.when(cond, F.lit(cat)) if out is None else out.when(cond, F.lit(cat))
    return out.otherwise(F.lit(DEFAULT_CATEGORY))


def size_class(size) -> Column:
    return F.when(_c(size) < SIZE_CLASS_THRESHOLD, F.lit("small")).otherwise(F.lit("large"))


def tokens_from_chars(text) -> Column:
    """ceil(chars / 4) in Unicode code points."""
    return tokens_from_char_count(F.length(_c(text)))


def tokens_from_char_count(n) -> Column:
    return F.floor((_c(n).cast("bigint") + 3) / 4).cast("bigint")


def tokens_from_bytes(size) -> Column:
    """floor(bytes / 4) per file."""
    return F.floor(_c(size).cast("bigint") / 4).cast("bigint")


def token_level(tokens, scale: str = "type") -> Column:
    lo, hi = TOKEN_LEVEL_BOUNDS[scale]
    t = _c(tokens)
    return F.when(t < lo, F.lit("Low")).when(t < hi, F.lit("Medium")).otherwise(F.lit("High"))
