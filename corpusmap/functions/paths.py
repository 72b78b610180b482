"""Path parts and language tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmap.functions.binding import let

# File extension -> language tag.
LANG_BY_EXT = {
    ".ts": "ts", ".tsx": "tsx", ".mts": "ts", ".cts": "ts",
    ".js": "js", ".jsx": "jsx", ".mjs": "js", ".cjs": "js",
    ".py": "py", ".pyw": "py",
    ".go": "go",
    ".rs": "rs",
    ".java": "java", ".kt": "kt", ".kts": "kt",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".cs": "cs",
    ".rb": "rb", ".php": "php", ".swift": "swift", ".zig": "zig",
    ".sh": "sh", ".bash": "sh", ".zsh": "sh", ".ps1": "ps1", ".bat": "bat", ".cmd": "bat",
    ".sql": "sql", ".md": "md", ".markdown": "md", ".txt": "text", ".json": "json",
    ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml", ".html": "html", ".css": "css",
}


def to_posix(path: Column) -> Column:
    """Backslashes become slashes."""
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    """The last part of a path."""
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """The directory of a path, '' at the top."""
    keep = F.length(path) - F.length(base_name(path)) - 1
    return F.when(keep > 0, F.substr(path, F.lit(1), keep)).otherwise(F.lit(""))


def prefixes(path: Column) -> Column:
    """A path and every directory above it, outermost first, without ''."""
    return let(
        F.split(path, "/"),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
        ),
    )


def dir_chain(directory: Column) -> Column:
    """A directory and every directory above it, '' included."""
    return F.when(directory == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), prefixes(directory))
    )


def ancestors(path: Column) -> Column:
    """Every directory that holds a file, '' included."""
    return dir_chain(parent_dir(path))


def detect_lang(path: Column) -> Column:
    """Language tag by extension, 'text' when the extension is unknown."""
    ext = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in LANG_BY_EXT.items() for x in pair])
    return F.coalesce(table[ext], F.lit("text"))
