"""Rules for names, paths, URLs and payloads that may hold secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENSITIVE_PATH = r"(?i)(^|/)(\.env(\.[^/]*)?|id_rsa|id_ed25519|[^/]*\.(pem|key|p12|pfx)|credentials(\.json)?|\.npmrc|\.netrc|secrets?\.(ya?ml|json|toml))$"
SECRET_NAME = r"(?i)(^|_|-|\.)(password|passwd|secret|token|api_?key|private_?key|credential)s?($|_|-|\.)"
TRAVERSAL = r"(^|/)\.\.(/|$)|^/"
DEFAULT_PORTS = {"postgres": 5432, "mysql": 3306, "redis": 6379, "mongodb": 27017}


def is_sensitive_path(path: Column) -> Column:
    """Files that are never read, and paths that leave their root."""
    return path.rlike(SENSITIVE_PATH) | path.rlike(TRAVERSAL)


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    chars = F.split(text, "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def is_secret(name: Column, value: Column) -> Column:
    """By name, or by a long value of high entropy that is no path or dotted name."""
    random = (F.length(value) >= 24) & ~value.rlike(r"[/.]") & (entropy(value) >= 4.2)
    return name.rlike(SECRET_NAME) | random


def connection(url: Column) -> Column:
    """provider, host, port, database of a connection URL; credentials never leave it."""
    part = lambda i: F.regexp_extract(url, r"^([a-z]+)(?:\+[a-z0-9]+)?://(?:[^@/]*@)?([^:/?]*)(?::([0-9]+))?(?:/([^?]*))?", i)
    provider = F.when(part(1).isin("postgresql", "postgres"), "postgres").otherwise(part(1))
    ports = F.create_map(*(F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv))
    return F.struct(provider.alias("provider"), part(2).alias("host"), F.coalesce(part(3).try_cast("int"), F.try_element_at(ports, provider)).alias("port"), part(4).alias("database"))


def clean_payload(payload: Column, most: int = 256) -> Column:
    """A map without sensitive keys, long values cut."""
    kept = F.map_filter(payload, lambda k, v: ~k.rlike(SECRET_NAME))
    return F.transform_values(kept, lambda k, v: F.substring(v, 1, most))
