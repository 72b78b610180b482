"""Filters on paths, files and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.paths import base_name, to_posix
from corpusmap.operators.ranking import top_n

# What marks a file as secret.
SENSITIVE_EXTENSIONS = (
    ".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".asc", ".gpg",
    ".pwd", ".secret", ".token", ".credentials",
)
SENSITIVE_BASENAMES = (
    ".npmrc", ".netrc", ".htpasswd", ".pgpass", "id_rsa", "id_ed25519",
    "credentials.json", "service-account.json", "secrets.yaml", "secrets.yml",
)
ENV_FILE = r"^\.env(\.[A-Za-z0-9_-]+)?$"
ENV_TEMPLATE_SUFFIXES = ("example", "sample", "template", "dist", "default")

# The notes for files not analysed.
TOO_LARGE, UNREADABLE, BINARY = "[file too large]", "[unreadable]", "[binary]"

STATE_DIR = ".corpusmap"


def is_hidden(path: Column, hidden: bool = False) -> Column:
    """Whether a path lies in `.git` or, unless hidden files are wanted, has a part that starts with a dot."""
    return path.rlike(r"(^|/)\.git(/|$)") if hidden else path.rlike(r"(^|/)\.")


def drop_hidden(df: DataFrame, hidden: bool = False) -> DataFrame:
    return df.filter(~is_hidden(F.col("path"), hidden))


def is_sensitive(path: Column) -> Column:
    """Whether the base name is on the list of secret files."""
    name = base_name(path)
    env_suffix = F.lower(F.regexp_extract(name, ENV_FILE, 1))
    extension = F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    templates = [f".{s}" for s in ENV_TEMPLATE_SUFFIXES]
    return (
        name.isin(*SENSITIVE_BASENAMES)
        | (name.rlike(ENV_FILE) & ~env_suffix.isin(*templates))
        | (name.contains(".") & extension.isin(*SENSITIVE_EXTENSIONS))
    )


def drop_sensitive(df: DataFrame) -> DataFrame:
    return df.filter(~is_sensitive(F.col("path")))


def is_valid_path(path: Column) -> Column:
    """Whether a path is relative and never climbs out of its root, with either separator."""
    return ~(path.startswith("/") | path.rlike(r"^[A-Za-z]:[\\/]") | path.rlike(r"(^|[\\/])\.\.($|[\\/])"))


def valid_paths(df: DataFrame) -> DataFrame:
    return df.filter(is_valid_path(F.col("path")))


def has_nul(text: Column) -> Column:
    """Whether a decoded text has a NUL anywhere."""
    return F.instr(text, F.lit("\x00")) > 0


def skip_reason(size_bytes: Column, text: Column, max_file_bytes: int | None = None) -> Column:
    """Why a file is listed without analysis, null when it is analysed."""
    too_large = F.lit(False) if max_file_bytes is None else size_bytes > max_file_bytes
    return (
        F.when(too_large, F.lit(TOO_LARGE))
        .when(text.isNull(), F.lit(UNREADABLE))
        .when(has_nul(text), F.lit(BINARY))
    )


def classify_skipped(df: DataFrame, max_file_bytes: int | None = None) -> DataFrame:
    """Adds `skip_reason` and `skipped`; the file stays in the listing."""
    reason = skip_reason(F.col("size_bytes"), F.col("text"), max_file_bytes)
    if "skip_reason" in df.columns:
        reason = F.coalesce("skip_reason", reason)
    df = df.withColumn("skip_reason", reason)
    return df.withColumn("skipped", F.col("skip_reason").isNotNull())


def cap_files(df: DataFrame, max_files: int) -> DataFrame:
    """The first files of each repository by path, each row with the number of files `left_out` of its repository."""
    report = cap_report(df, max_files).select("repo", F.col("skipped_files").alias("left_out"))
    return top_n(df, ["repo"], [F.col("path")], max_files, salt_by=["path"]).join(report, "repo")


def cap_report(df: DataFrame, max_files: int) -> DataFrame:
    """Per repository: files kept, files skipped by the cap, and whether the cap cut anything."""
    n = F.count(F.lit(1))
    return df.groupBy("repo").agg(
        F.least(n, F.lit(max_files).cast("bigint")).alias("kept_files"),
        F.greatest(n - max_files, F.lit(0).cast("bigint")).alias("skipped_files"),
        (n > max_files).alias("truncated"),
    )


def loggable_events(access_log: DataFrame, state_dir: str = STATE_DIR) -> DataFrame:
    """Events about a real path: not empty, not secret, not in the state directory."""
    path = to_posix(F.col("path"))
    return access_log.filter(
        path.isNotNull() & (path != "") & ~is_sensitive(path) & ~path.startswith(f"{state_dir}/")
    )
