"""One-line descriptions of files, by language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmap.functions.binding import let
from corpusmap.functions.paths import base_name, detect_lang
from corpusmap.functions.text import ellipsize, first_meaningful_line, trim_space

# Patterns that find what a file declares.
EXPORT = r"export\s+(?:async\s+)?(?:default\s+)?(?:function|class|const|let|var|interface|type|enum)\s+(\w+)"
DEFAULT_EXPORT = r"export\s+default\s+([A-Za-z_$][\w$]*)"
ROUTE = (
    r"(?i)(?:router|app|server|this)\.(get|post|put|patch|delete|all|head|options)"
    r"""\(\s*['"`]([^'"`]+)['"`]"""
)
ZOD_SCHEMA = r"z\.object\("
CLASS = r"class\s+(\w+)"
PY_DOCSTRING = r'(?m)^\s*(?:"""|' + r"''')([\s\S]*?)(?:" + r'"""|' + r"''')"
PY_CLASS = r"(?m)^\s*class\s+(\w+)"
PY_DEF = r"(?m)^\s*(?:async\s+)?def\s+(\w+)"
GO_PACKAGE = r"(?m)^package\s+(\w+)"
GO_FUNC = r"(?m)^\s*func\s+"
GO_HANDLER = r"http\.(?:Handler|ResponseWriter)"
RS_PUBLIC = r"(?m)^\s*pub(?:\s*\([^)]*\))?\s+(?:fn|struct|enum|trait)\s+(\w+)"
RS_MOD = r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)"

SCRIPT_LANGS = ("ts", "tsx", "js", "jsx")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _some(n: Column, *parts: Column | str) -> Column:
    """The joined parts when n > 0, else null, so that concat_ws skips them."""
    return F.when(n > 0, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _number(pattern: str, text: Column, one: str, many: str) -> Column:
    """`N <noun>` for the hits of a pattern, null without hits."""
    return let(
        _count(text, pattern),
        lambda n: _some(n, n.cast("string"), F.when(n > 1, many).otherwise(one)),
    )


def _blank_to_null(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


def _list(items: Column, shown: int) -> Column:
    """The first items, and how many more there are."""
    n = F.size(items)
    return F.concat(
        F.array_join(F.slice(items, 1, shown), ", "),
        F.when(n > shown, F.concat(F.lit(" +"), (n - shown).cast("string"), F.lit(" more"))).otherwise(""),
    )


def describe_exports(text: Column) -> Column:
    """`Exports a, b, … +N more, default X`, null without exports."""
    default = let(
        F.regexp_extract(text, DEFAULT_EXPORT, 1),
        lambda d: F.when(d != "", F.concat(F.lit(", default "), d)).otherwise(""),
    )
    return let(
        F.regexp_extract_all(text, F.lit(EXPORT), F.lit(1)),
        lambda names: F.when(F.size(names) > 0, F.concat(F.lit("Exports "), _list(names, 5), default)),
    )


def describe_routes(text: Column) -> Column:
    """`Defines GET /x, …` for HTTP routes, null without routes; four are shown and all others counted."""
    verbs = F.regexp_extract_all(text, F.lit(ROUTE), F.lit(1))
    targets = F.regexp_extract_all(text, F.lit(ROUTE), F.lit(2))
    return let(
        F.array_distinct(F.zip_with(verbs, targets, lambda v, t: F.concat(F.upper(v), F.lit(" "), t))),
        lambda routes: F.when(F.size(routes) > 0, F.concat(F.lit("Defines "), _list(routes, 4))),
    )


def describe_schema(text: Column, base: Column) -> Column:
    """Marks a file that holds a validation schema."""
    return F.when(text.rlike(ZOD_SCHEMA), F.concat(F.lit("Defines a zod schema in "), base))


def describe_class(text: Column) -> Column:
    """`Class X` for the first class."""
    return let(
        F.regexp_extract(text, CLASS, 1), lambda name: F.when(name != "", F.concat(F.lit("Class "), name))
    )


def describe_schema_or_class(text: Column, base: Column) -> Column:
    """Schema marker, else the first class."""
    return F.coalesce(describe_schema(text, base), describe_class(text))


def describe_python(text: Column) -> Column:
    """First line of the docstring, else counts of classes and functions."""
    counts = F.concat_ws(
        ", ", _number(PY_CLASS, text, " class", " classes"), _number(PY_DEF, text, " functions", " functions")
    )
    return let(
        trim_space(F.regexp_extract(text, PY_DOCSTRING, 1)),
        lambda doc: F.when(doc != "", F.substring_index(doc, "\n", 1)).otherwise(_blank_to_null(counts)),
    )


def describe_go(text: Column) -> Column:
    """Package, handlers and functions."""
    package = let(
        F.regexp_extract(text, GO_PACKAGE, 1), lambda p: F.when(p != "", F.concat(F.lit("package "), p))
    )
    return _blank_to_null(
        F.concat_ws(
            " · ", package, _number(GO_HANDLER, text, " HTTP handler", " HTTP handlers"),
            _number(GO_FUNC, text, " funcs", " funcs"),
        )
    )


def describe_rust(text: Column) -> Column:
    """Public items and modules."""
    return _blank_to_null(
        F.concat_ws(
            ", ", _number(RS_PUBLIC, text, " public items", " public items"),
            _number(RS_MOD, text, " modules", " modules"),
        )
    )


def describe_json(text: Column) -> Column:
    """The description of a JSON document, else its name; only string values count."""

    def string_at(doc: Column, key: str) -> Column:
        value = F.try_variant_get(doc, f"$.{key}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(doc, f"$.{key}", "string"))

    return let(
        F.try_parse_json(text), lambda doc: F.coalesce(string_at(doc, "description"), string_at(doc, "name"))
    )


def describe_language(text: Column, path: Column, n: int = 140) -> Column:
    """Description by language, null when the file tells nothing special."""

    def by_lang(lang: Column) -> Column:
        return (
            F.when(
                lang.isin(*SCRIPT_LANGS),
                F.coalesce(
                    describe_routes(text), describe_schema(text, base_name(path)), describe_exports(text),
                    describe_class(text),
                ),
            )
            .when(lang == "py", describe_python(text))
            .when(lang == "go", describe_go(text))
            .when(lang == "rs", describe_rust(text))
            .when(lang == "json", describe_json(text))
        )

    return ellipsize(let(detect_lang(path), by_lang), n)


def describe(text: Column, path: Column, n: int = 140) -> Column:
    """Description by language, else the first meaningful line."""
    return F.coalesce(describe_language(text, path, n), first_meaningful_line(text, n))
