"""Scanning lines against audit rules."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.binding import let
from corpusmap.functions.paths import base_name
from corpusmap.functions.text import split_lines, trim_space
from corpusmap.operators.merge import fresh_bugs
from corpusmap.operators.knowledge import number_bugs
from corpusmap.operators.symbols import with_rules

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


class AuditRule(NamedTuple):
    """A check of lines, or of base names when `on_path` is set. Patterns avoid lookaround.

    `needs` are lower-case ASCII texts; every match of the pattern in a line holds one of them, in any case. Without
    them nothing but the pattern tells which texts it may hit.
    """

    name: str
    layer: str
    severity: str
    pattern: str
    on_path: bool = False
    needs: tuple[str, ...] = ()


# The checks named by the audit: manifests and install scripts, secrets, and places where input can be injected.
AUDIT_RULES = (
    AuditRule("dependency manifest", "dependencies", "LOW",
              r"^(package\.json|requirements\.txt|go\.mod|Cargo\.toml|Gemfile|pom\.xml|setup\.py|build\.rs)$", True),
    AuditRule("install script", "dependencies", "MEDIUM", r'"(pre|post)?install"\s*:|"prepare"\s*:',
              needs=('install"', '"prepare"')),
    AuditRule("private key", "secrets", "CRITICAL", r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
              needs=("private key-----",)),
    AuditRule("hardcoded password", "secrets", "HIGH",
              r"""(?i)(password|passwd|pwd)["']?\s*[:=]\s*["']?[^\s"']{4,}""",
              needs=("password", "passwd", "pwd")),
    AuditRule("api key", "secrets", "HIGH",
              r"""(?i)(api[_-]?key|secret|access[_-]?token)["']?\s*[:=]\s*["']?[A-Za-z0-9_\-]{8,}""",
              needs=("apikey", "api_key", "api-key", "secret", "accesstoken", "access_token", "access-token")),
    AuditRule("bearer token", "secrets", "HIGH", r"(?i)bearer\s+[A-Za-z0-9._\-]{8,}",
              needs=("bearer",)),
    AuditRule("connection string", "secrets", "HIGH", r"(?i)[a-z][a-z0-9+]*://[^\s:/@]+:[^\s/@]+@",
              needs=("://",)),
    AuditRule("eval call", "injection", "HIGH", r"\b(eval|exec)\s*\(",
              needs=("eval", "exec")),
    AuditRule("shell command", "injection", "HIGH",
              r"child_process|os\.system\s*\(|shell\s*=\s*True|subprocess\.call\s*\(",
              needs=("child_process", "os.system", "shell", "subprocess.call")),
    AuditRule("raw sql", "injection", "MEDIUM",
              r"""(?i)["'`](select|insert|update|delete)\s[^"'`]*["'`]\s*(\+|%|\.format)""",
              needs=("select", "insert", "update", "delete")),
    AuditRule("unsafe html", "injection", "MEDIUM", r"dangerouslySetInnerHTML|innerHTML\s*=",
              needs=("innerhtml",)),
    AuditRule("wide cors", "authorization", "MEDIUM", r"(?i)access-control-allow-origin['\"]?\s*[:,]\s*['\"]?\*",
              needs=("access-control-allow-origin",)),
)


def audit_lines(files: DataFrame, rules: Sequence[AuditRule] = AUDIT_RULES) -> DataFrame:
    """Findings: (repo, path, line_no, rule, layer, severity, line); line 0 stands for the file itself.

    A file is cut into lines only if some rule hits its text, and only lines with a hit meet the single rules. Where all
    rules say what they need, texts are searched for that alone, and only lines that hold it meet a pattern.
    """
    on_lines = [r for r in rules if not r.on_path]
    on_paths = [r for r in rules if r.on_path]
    any_rule = "|".join(f"(?:{r.pattern})" for r in on_lines)

    def finding(rule: AuditRule, line_no, line):
        return F.struct(
            line_no.cast("int").alias("line_no"), F.lit(rule.name).alias("rule"), F.lit(rule.layer).alias("layer"),
            F.lit(rule.severity).alias("severity"), line.alias("line"),
        )

    def numbered(text):
        return F.transform(split_lines(text), lambda line, i: F.struct(line.alias("text"), (i + 1).alias("line_no")))

    def holding(line, needs):
        return let(F.lower(line), lambda low: F.exists(needs, lambda need: low.contains(need)))

    if on_lines and all(r.needs for r in on_lines):
        needs = F.array(*[F.lit(need) for need in dict.fromkeys(need for r in on_lines for need in r.needs)])
        hits = let(
            let(F.lower("text"), lambda low: F.filter(needs, lambda need: low.contains(need))),
            lambda found: F.when(F.size(found) > 0, F.filter(
                numbered(F.col("text")), lambda r: holding(r["text"], found) & r["text"].rlike(any_rule))),
        )
    else:
        hits = F.when(
            F.col("text").rlike(f"(?m){any_rule}") if on_lines else F.lit(False),
            F.filter(numbered(F.col("text")), lambda r: r["text"].rlike(any_rule or "$^")),
        )
    suspect = files.withColumn("hits", hits)

    def hits_of(rule: AuditRule):
        return F.transform(
            F.filter("hits", lambda r: r["text"].rlike(rule.pattern)),
            lambda r: finding(rule, r["line_no"], trim_space(r["text"])),
        )

    found = [hits_of(rule) for rule in on_lines]
    named = [
        F.when(
            base_name(F.col("path")).rlike(rule.pattern), F.array(finding(rule, F.lit(0), base_name(F.col("path"))))
        )
        for rule in on_paths
    ]
    kind = "array<struct<line_no:int,rule:string,layer:string,severity:string,line:string>>"
    none = F.array().cast(kind)
    all_found = F.concat(*[F.coalesce(f.cast(kind), none) for f in [*found, *named]])
    # The outer form keeps Spark from testing for empty arrays first, which would scan each text twice.
    return (
        suspect.select("repo", "path", F.explode_outer(all_found).alias("f")).filter(F.col("f").isNotNull())
        .select("repo", "path", "f.line_no", "f.rule", "f.layer", "f.severity", "f.line")
    )


def severity_rank(severity):
    """1 for CRITICAL to 4 for LOW."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int")


def audit_listing(findings: DataFrame) -> DataFrame:
    """The findings in order of severity, each with its report line."""
    report = F.concat(
        F.lit("- "), F.col("severity"), F.lit(": "), F.col("rule"), F.lit(" ("), F.col("path"), F.lit(":"),
        F.col("line_no").cast("string"), F.lit(")"),
    )
    return (
        findings.withColumn("severity_rank", severity_rank(F.col("severity"))).withColumn("report", report)
        .orderBy("repo", "severity_rank", "path", "line_no", "rule")
    )


def audit_by_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of rules given as a table (extension, rule, layer, severity, pattern), as `audit_lines` gives them.

    The rules of an extension are one array, folded over the lines inside the row of each file of that extension. Rules
    without extension or pattern are left out, files without text have no findings, equal rules count once.
    """
    table = rules.select("extension", "rule", "layer", "severity", "pattern")
    ruled = with_rules(files.select("repo", "path", "text"), table, "rules").filter(F.col("rules").isNotNull())
    hits = let(split_lines(F.col("text")), lambda lines: F.flatten(F.transform("rules", lambda r: F.filter(
        F.transform(lines, lambda line, i: F.struct(
            (i + 1).cast("int").alias("line_no"), r["rule"].alias("rule"), r["layer"].alias("layer"),
            r["severity"].alias("severity"), F.when(F.regexp_instr(line, r["pattern"]) > 0, line).alias("line"))),
        lambda h: h["line"].isNotNull()))))
    found = ruled.select("repo", "path", F.explode_outer(hits).alias("h")).filter(F.col("h").isNotNull())
    return found.select("repo", "path", "h.line_no", "h.rule", "h.layer", "h.severity", trim_space(F.col("h.line")).alias("line"))


def audit_report(findings: DataFrame, repos: DataFrame, rules: Sequence[AuditRule] = AUDIT_RULES) -> DataFrame:
    """Per repository and check: number of findings, and passed when there are none."""
    checks = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.layer).alias("layer"), F.lit(r.severity).alias("severity"))
        for r in rules
    ])
    counts = findings.groupBy("repo", "rule").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("n_files")
    )
    zero = F.lit(0).cast("bigint")
    return (
        repos.select("repo").distinct().select("repo", F.explode(checks).alias("c")).select("repo", "c.*")
        .join(counts, ["repo", "rule"], "left")
        .select(
            "repo", "rule", "layer", "severity", severity_rank(F.col("severity")).alias("severity_rank"),
            F.coalesce("n", zero).alias("findings"), F.coalesce("n_files", zero).alias("files"),
            F.col("n").isNull().alias("passed"),
        )
    )


def findings_to_bugs(findings: DataFrame, bugs: DataFrame, at) -> DataFrame:
    """New bug records for the findings of the two highest severities, each once per check and file."""
    grave = findings.filter(F.col("severity").isin("CRITICAL", "HIGH")).select(
        "repo", F.struct("line_no", "rule").alias("seq"),
        F.concat(F.col("severity"), F.lit(": "), F.col("rule")).alias("error_message"),
        F.lit("").alias("fix"), F.col("path").alias("file"), at.alias("at"),
    )
    return number_bugs(bugs, fresh_bugs(bugs, grave).drop("seq"))
