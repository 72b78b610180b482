"""Ignore rules in gitignore style.

A file is dropped when the last matching rule of any candidate, itself or a directory above it, is not a
negation: nothing under an ignored directory comes back.

Most rules name something: a file or directory by its name or path, an ending, or what lies in a directory. These
have a `kind` and a `key` and meet the candidates by equality, so a repository may have very many of them. Only the
others, of kind `glob`, are matched as regular expressions; neighbouring ones of the same sign merge into one. `re`
tells whether a rule hits one candidate, in which a directory ends in a line end. `whole` tells from the path alone
whether it hits any candidate; it decides where rules common to all repositories have no negations.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmap.functions.binding import let
from corpusmap.functions.paths import prefixes

# Signs a rule must not pass on as regular expression signs.
REGEX_SIGNS = r"([.+^${}()|\[\]\\])"


class Rule(NamedTuple):
    keep: Column
    negate: Column
    dir_only: Column
    anchored: Column
    kind: Column
    key: Column
    re: Column
    whole: Column


def parse_rule(raw: Column) -> Rule:
    """The parts of one rule line; `keep` is false for blank lines and comments."""
    line = F.regexp_replace(raw, r"[ \t]+$", "")
    negate = line.startswith("!")
    bare = F.when(negate | line.startswith(r"\!"), F.substring(line, 2, 1 << 30)).otherwise(line)
    dir_only = bare.endswith("/")
    glob = F.regexp_replace(bare, "/$", "")
    anchored = glob.contains("/")
    glob = F.regexp_replace(glob, "^/", "")
    keep = (line != "") & ~line.startswith("#") & (glob != "")

    held = F.regexp_extract(glob, r"^([^*?]+)/\*\*?$", 1)
    ending = F.regexp_extract(glob, r"^\*\.([^.*?]+)$", 1)
    plain = ~glob.rlike("[*?]")
    kind = (
        F.when(plain & anchored, "path").when(plain, "name").when(~anchored & (ending != ""), "ending")
        .when(anchored & (held != "") & glob.endswith("/**"), "below").when(anchored & (held != ""), "child")
        .otherwise("glob")
    )
    key = F.when(kind == "ending", ending).when(kind.isin("below", "child"), held).when(kind != "glob", glob)

    body = F.regexp_replace(glob, REGEX_SIGNS, r"\\$1")
    body = F.replace(body, F.lit("**"), F.lit("\x01"))
    body = F.replace(body, F.lit("*"), F.lit(r"[^/\n]*"))
    body = F.replace(body, F.lit("?"), F.lit(r"[^/\n]"))
    body = F.replace(body, F.lit("\x01"), F.when(anchored, F.lit(".*")).otherwise(F.lit(r"[^/\n]*")))
    head = F.when(anchored, F.lit("^")).otherwise(F.lit("(?:^|/)"))
    tail = F.when(dir_only, F.lit(r"[/\n]")).otherwise(F.lit(r"\n?\z"))
    any_tail = F.when(dir_only, F.lit("/")).otherwise(F.lit(r"(?:/|\z)"))
    return Rule(
        keep, negate, dir_only, anchored, kind, key, F.concat(head, body, tail), F.concat(head, body, any_tail)
    )


def compile_rules(rule_lines: DataFrame) -> DataFrame:
    """Rule lines (repo, source, rule_no, line) -> rule rows with the parsed parts."""
    rule = parse_rule(F.col("line"))
    return rule_lines.filter(rule.keep).select(
        "repo", "source", "rule_no",
        rule.negate.alias("negate"), rule.dir_only.alias("dir_only"),
        rule.anchored.alias("anchored"), rule.kind.alias("kind"), rule.key.alias("key"), rule.re.alias("re"),
    )


def gitignore_lines(files: DataFrame) -> DataFrame:
    """The rule lines (repo, source, rule_no, line) of the `.gitignore` at the root of each repository.

    `files` has repo, path and text. Only the file at the root counts.
    """
    rules = files.filter(F.col("path") == ".gitignore").select(
        "repo", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("at", "line"))
    return rules.select("repo", F.lit("gitignore").alias("source"), (F.col("at") + 1).alias("rule_no"), "line")


def _in_runs(rules: DataFrame) -> DataFrame:
    """The rules with the number of their run: neighbouring rules of one sign within a source."""
    order = Window.partitionBy("repo", "source").orderBy("rule_no", "negate", "re")
    turn = F.coalesce(F.lag("negate").over(order) != F.col("negate"), F.lit(True)).cast("int")
    return rules.withColumn("_turn", turn).withColumn("run", F.sum("_turn").over(order)).drop("_turn")


def _globs(runs: DataFrame) -> DataFrame:
    """One row per repository and source that has globs: those of each run as one expression."""
    merged = runs.filter(F.col("kind") == "glob").groupBy("repo", "source", "run", "negate").agg(
        F.concat_ws("|", F.collect_set("re")).alias("re"))
    return merged.groupBy("repo", "source").agg(F.collect_list(F.struct("run", "negate", "re")).alias("globs"))


def _named(path: Column, is_dir: Column) -> Column:
    """What rules can name in a path: (kind, key, level, is_dir) for the path and each directory above it."""

    def keys(level: Column, part: Column, depth: Column) -> Column:
        name, above = F.substring_index(part, "/", -1), F.regexp_extract(part, "^(.*)/[^/]*$", 1)
        at = (level.alias("level"), ((level < depth) | is_dir).alias("cand_dir"))
        ending = F.when(name.contains("."), F.substring_index(name, ".", -1))
        found = (("path", part), ("name", name), ("ending", ending), ("child", above), ("below", above))
        return F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key"), *at) for kind, key in found])

    return let(prefixes(path), lambda parts: F.flatten(
        F.transform(parts, lambda part, i: keys(i + 1, part, F.size(parts)))))


def candidates(path: Column, is_dir: Column | None = None) -> Column:
    """The path and the directories above it, each directory ending in a line end."""
    own = F.when(is_dir, F.lit("\n")).otherwise(F.lit("")) if is_dir is not None else F.lit("")
    last = F.concat(path, own)
    return F.transform(prefixes(path), lambda c: F.when(c == path, last).otherwise(F.concat(c, F.lit("\n"))))


def _with_slash(path: Column, is_dir: Column | None) -> Column:
    return path if is_dir is None else F.when(is_dir, F.concat(path, F.lit("/"))).otherwise(path)


def _any_ignored(cands: Column, blocks: Sequence[tuple[Column, Column]]) -> Column:
    """Whether some candidate's last matching block is not a negation."""
    verdicts = F.transform(cands, lambda c: F.lit(False))
    for negate, re in blocks:
        verdicts = F.zip_with(
            verdicts, cands, lambda v, c: F.when(F.regexp_instr(c, re) > 0, ~negate).otherwise(v)  # noqa: B023
        )
    return F.exists(verdicts, lambda v: v)


def ignored_by(path: Column, patterns: Sequence[str], is_dir: Column | None = None) -> Column:
    """Whether a path is dropped by rules common to all repositories.

    The patterns are literals, so Spark folds each run of them into one constant expression.
    """
    runs: list[tuple[bool, list[Rule]]] = []
    for raw in patterns:
        line = raw.rstrip(" \t")
        if line.strip("/!\\") == "" or line.startswith("#"):
            continue
        negate = line.startswith("!")
        if not runs or runs[-1][0] != negate:
            runs.append((negate, []))
        runs[-1][1].append(parse_rule(F.lit(line)))
    if not runs:
        return F.lit(False)
    if len(runs) == 1 and not runs[0][0]:
        return F.rlike(_with_slash(path, is_dir), F.concat_ws("|", *[r.whole for r in runs[0][1]]))
    return let(candidates(path, is_dir), lambda cands: _any_ignored(cands, [(F.lit(negate), F.concat_ws("|", *[r.re for r in rules])) for negate, rules in runs]))


def ignored_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The (repo, path, is_dir) that the compiled rules of their own repository ignore, each once.

    Only keys travel. Rules that name something meet the names of each path by equality of (repo, kind, key), so a
    repository with very many rules or files is spread by what they name. Globs are one row per repository and source.
    What hits a path is gathered; of each source, the last run that hits a candidate decides about it. Paths of a
    null repository and null paths meet no rule.
    """
    is_dir = F.coalesce("is_dir", F.lit(False)) if "is_dir" in files.columns else F.lit(False)
    paths = files.select("repo", "path", is_dir.alias("is_dir"))
    runs = _in_runs(rules)
    key = ["repo", "path", "is_dir"]

    names = runs.filter(F.col("kind") != "glob").select(
        "repo", "kind", "key", "source", "run", "negate", "dir_only")
    by_name = (
        paths.select(*key, F.inline(_named(F.col("path"), F.col("is_dir"))))
        .join(names, ["repo", "kind", "key"])
        .filter(F.col("cand_dir") | ~F.col("dir_only"))
        # A rule for directories, or for all below one, holds for what lies deeper too.
        .select(*key, "source", "level", (F.col("dir_only") | (F.col("kind") == "below")).alias("deep"), "run", "negate")
    )

    def levels(cands: Column, re: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(cands)), lambda i: F.regexp_instr(F.get(cands, i - 1), re) > 0)

    matched = let(candidates(F.col("path"), F.col("is_dir")), lambda cands: F.transform("globs", lambda g: F.struct(
        levels(cands, g["re"]).alias("levels"), F.lit(False).alias("deep"),
        g["run"].alias("run"), g["negate"].alias("negate"))))
    by_glob = (
        paths.join(_globs(runs), "repo").select(*key, "source", F.inline(matched))
        .select(*key, "source", F.explode("levels").alias("level"), "deep", "run", "negate")
    )

    hits = by_name.unionByName(by_glob).groupBy(*key).agg(
        F.collect_set(F.struct("source", "level", "deep", "run", "negate")).alias("hits"))

    def dropped(source: Column, level: Column) -> Column:
        here = F.filter("hits", lambda h: (h["source"] == source) & (
            (h["level"] == level) | (h["deep"] & (h["level"] < level))))
        last = F.array_max(F.transform(here, lambda h: F.struct(h["run"].alias("run"), h["negate"].alias("negate"))))
        return F.coalesce(~last["negate"], F.lit(False))

    depth = F.size(F.split("path", "/"))
    sources = F.array_distinct(F.transform("hits", lambda h: h["source"]))
    ignored = F.exists(sources, lambda s: F.exists(F.sequence(F.lit(1), depth), lambda level: dropped(s, level)))
    return hits.filter(ignored).select(*key)


def apply_ignore(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop the paths ignored by the compiled rules of their own repository.

    `files` needs repo and path, and may have is_dir. Other columns meet the ignored paths only in the last join,
    whose form Spark chooses by their number.
    """
    gone = ignored_paths(files, rules).select(
        F.col("repo").alias("_repo"), F.col("path").alias("_path"), F.col("is_dir").alias("_dir"))
    same = (files["repo"] == gone["_repo"]) & (files["path"] == gone["_path"])
    if "is_dir" in files.columns:
        same &= F.coalesce(files["is_dir"], F.lit(False)) == gone["_dir"]
    return files.join(gone, same, "left_anti")
