"""Measures and cuts of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmap.functions.binding import let

# Characters per token by kind of text.
CHARS_PER_TOKEN = {"code": 3.8, "prose": 4.2, "mixed": 4.0}

# Starts of lines that are comments, and starts of lines that are imports (lower case).
COMMENT_PREFIXES = ("#", "//", "/*", "*", "--", "<!--", ";", "%", '"""', "'''")
IMPORT_PREFIXES = (
    "import ", "from ", "require(", "package ", "using ", "#include", "#define", "#pragma", "module ", "use ",
)

SPACES = " \t\n\r\f\x0b"


def trim_space(text: Column) -> Column:
    """Trim blanks, tabs and line ends on both sides."""
    return F.btrim(text, F.lit(SPACES))


def split_lines(text: Column) -> Column:
    """The lines of a text; a final line end gives a last empty line."""
    return F.split(text, r"\r?\n")


def line_count(text: Column) -> Column:
    """Number of line ends."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


def estimate_tokens(text: Column, kind: str = "mixed") -> Column:
    """Token estimate from the length of a text, at least 1."""
    return tokens_of_length(F.length(text), CHARS_PER_TOKEN[kind])


def tokens_of_length(n: Column, per_token: float = 4.0) -> Column:
    """Token estimate of a number of characters or bytes, at least 1."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(n / F.lit(float(per_token))).cast("bigint"))


def _quoted(prefixes: tuple[str, ...]) -> str:
    return "|".join(rf"\Q{p}\E" for p in prefixes)


# One search over the whole text that stops at the first line which is neither blank nor noise.
# Flags: m = ^ at each line, d = only \n ends a line. The possessive blank run cannot be given back.
_MEANINGFUL = (
    r"(?md)^[ \t\f\x0B\r]*+(?!(?i:" + _quoted(COMMENT_PREFIXES + IMPORT_PREFIXES) + r"))([^\s][^\n]*)"
)


def first_meaningful_line(text: Column, n: int) -> Column:
    """First line that is not blank, a comment or an import; cut to n characters plus an ellipsis."""
    return let(
        trim_space(F.regexp_extract(text, _MEANINGFUL, 1)),
        lambda line: F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("…"))).otherwise(line),
    )


def ellipsize(text: Column, n: int, mark: str = "…") -> Column:
    """At most n characters; a longer text ends in the mark."""
    return let(
        text,
        lambda t: F.when(
            F.length(t) > n, F.concat(F.substring(t, 1, n - len(mark)), F.lit(mark))
        ).otherwise(t),
    )


def preview_length(n: int, max_file_bytes: int | None) -> int:
    """Length of a preview: at least 256, at most the file limit."""
    return max(256, n if max_file_bytes is None else min(n, max_file_bytes))


def preview(text: Column, n: int = 4096, max_file_bytes: int | None = None) -> Column:
    """Head of a text."""
    return F.substring(text, 1, preview_length(n, max_file_bytes))


def preview_truncated(text: Column, n: int = 4096, max_file_bytes: int | None = None) -> Column:
    """Whether the preview leaves something out."""
    return F.length(text) > preview_length(n, max_file_bytes)


def content_hash(text: Column) -> Column:
    """SHA-256 in hexadecimal."""
    return F.sha2(text, 256)


def normalize_entry(line: Column) -> Column:
    """Comparable form of a list entry: no bullet, no date tag, single blanks, lower case."""
    s = trim_space(line)
    s = F.regexp_replace(s, r"^[-*]\s+", "")
    s = F.regexp_replace(s, r"^\[\d{4}-\d{2}-\d{2}\]\s*", "")
    s = F.regexp_replace(s, r"\s+", " ")
    return F.lower(F.trim(s))


def usage_total(
    input_tokens: Column, output_tokens: Column, cache_read: Column, cache_write: Column, meter: Column
) -> Column:
    """Tokens billed for one message; the meter value stands in when nothing was reported."""
    zero = F.lit(0).cast("bigint")
    total = sum((F.coalesce(c, zero) for c in (input_tokens, output_tokens, cache_read, cache_write)), zero)
    return F.when(total == 0, F.coalesce(meter, zero)).otherwise(total)


def bug_key(error: Column, file: Column) -> Column:
    """Identity of a bug record."""
    return F.concat_ws(
        "|", F.lower(trim_space(error)), F.lower(trim_space(F.coalesce(file, F.lit(""))))
    )


def one_line(text: Column) -> Column:
    """Line ends become blanks."""
    return F.regexp_replace(text, r"\r?\n", " ")
