"""Source files as rows: scan, filters with reasons, language and category."""

from __future__ import annotations

import fnmatch
import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders never read, and the language of each suffix.
IGNORED_FOLDERS = (".git", ".venv", "venv", "node_modules", "__pycache__", "dist", "build", ".mypy_cache", ".pytest_cache")
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".sql": "sql", ".prisma": "prisma", ".html": "html",
    ".htm": "html", ".jinja": "html", ".jinja2": "html", ".njk": "html", ".ejs": "html", ".lua": "luau", ".luau": "luau",
}
SENSITIVE = r"(?i)(^|/)(\.env(\..*)?|id_rsa|id_ed25519|.*\.(pem|key|p12|pfx)|credentials(\.json)?|\.npmrc|\.netrc|secrets?\.(ya?ml|json|toml))$"


def glob_regex(patterns: list[str]) -> str:
    """One expression for ignore globs; a bare name matches at any depth, a trailing slash a folder."""
    out = []
    for p in (x.strip() for x in patterns):
        if not p or p.startswith("#"):
            continue
        body = fnmatch.translate(p.strip("/")).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")
        out.append(f"(^|/){body}(/|$)" if "/" not in p.strip("/") else f"^{body}(/|$)")
    return "|".join(out) or r"$^"


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(table, suffix)


def is_binary(content: Column) -> Column:
    """A zero byte in the first 8192."""
    return F.hex(F.substring(content, 1, 8192)).rlike("^(..)*?00")


def category(path: Column, text: Column) -> Column:
    """First match decides."""
    name = F.lower(path)
    long_line = F.length(text) / F.greatest(F.size(F.split(text, "\n")), F.lit(1)) > 400
    return (
        F.when(name.rlike(r"(^|/)(vendor|third_party|site-packages|bower_components)/"), "VENDOR")
        .when(name.rlike(r"\.min\.(js|css)$"), "MINIFIED")
        .when(name.rlike(r"(^|/)[^/]*(bundle|chunk)[^/]*\.js$"), "BUNDLE")
        .when(name.rlike(r"(^|/)(out|target|\.next|coverage)/"), "BUILD_ARTIFACT")
        .when(F.substring(text, 1, 2000).rlike("(?i)(do not edit|@generated|auto-?generated)"), "GENERATED")
        .when(name.rlike(r"(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*\.py$|_test\.(py|js|ts)$|\.(test|spec)\.[jt]sx?$"), "TEST")
        .when(name.rlike(r"\.(toml|ya?ml|ini|cfg|json)$|(^|/)(dockerfile|makefile)$"), "CONFIG")
        .when(long_line, "MINIFIED").when(language(path).isNotNull(), "SOURCE").otherwise("UNKNOWN")
    )


def listed(spark: SparkSession, folder: str, most_bytes: int) -> DataFrame:
    """Files of a folder that all executors have mounted: names are listed here, contents read there."""
    names = [os.path.relpath(os.path.join(d, f), folder) for d, _, found in os.walk(folder) for f in found]

    def load(batches):
        for pdf in batches:
            sizes, data = [], []
            for name in pdf["path"]:
                full = os.path.join(folder, name)
                inside = os.path.realpath(full).startswith(os.path.realpath(folder) + os.sep)  # links may lead out
                sizes.append(os.path.getsize(full) if inside else -1)
                with open(full, "rb") as f:
                    data.append(f.read() if inside and sizes[-1] <= most_bytes else b"")
            yield pd.DataFrame({"path": pdf["path"], "content": data, "length": sizes})

    rows = spark.createDataFrame([(n,) for n in sorted(names)], "path string").repartition(max(1, len(names) // 500))
    return rows.mapInPandas(load, "path string, content binary, length long")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Files of any store; Spark leaves out names that begin with a dot or an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = re.escape(re.sub("^[a-z0-9]+:/+", "", folder.rstrip("/")))
    return files.select(F.regexp_replace("path", f"^[a-z0-9]+:/+{root}/", "").alias("path"), "content", "length")


def scan(spark: SparkSession, folder: str, most_bytes: int = 1_000_000, ignore: list[str] | None = None) -> DataFrame:
    """path (relative), content, text, hash, language, category, skipped (reason or null)."""
    return judged(listed(spark, folder, most_bytes) if "://" not in folder else stored(spark, folder), most_bytes, ignore)


def judged(rows: DataFrame, most_bytes: int, ignore: list[str] | None = None) -> DataFrame:
    """Files (path, content, length) with what ``scan`` says of them."""
    inside = r"(^|/)(" + "|".join(d.replace(".", r"\.") for d in IGNORED_FOLDERS) + ")/"
    reason = (
        F.when(F.col("path").rlike(inside), "ignored_folder").when(F.col("path").rlike(glob_regex(ignore or [])), "ignored_pattern").when(F.col("path").rlike(SENSITIVE), "sensitive")
        .when(F.col("length") < 0, "link_outside").when(F.col("length") > most_bytes, "too_large").when(is_binary(F.col("content")), "binary").when(language(F.col("path")).isNull(), "unknown_language")
    )
    text = F.when(reason.isNull(), F.col("content").cast("string"))
    return rows.select("path", "content", text.alias("text"), F.sha2("content", 256).alias("hash"), language(F.col("path")).alias("language"), reason.alias("skipped")).withColumn("category", category(F.col("path"), F.coalesce("text", F.lit(""))))


def skip_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("skipped", F.lit("read")).alias("reason")).agg(F.count("*").alias("n"))
