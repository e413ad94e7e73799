"""Column functions on text: terms, lines, snippets, routes, SQL statements, redaction, identifiers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Words of two or more of [A-Za-z0-9_], boolean operators dropped, first occurrence only."""
    words = F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda w: (F.length(w) >= 2) & ~w.isin("AND", "OR", "NOT"))
    return F.array_distinct(words)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def snippet(text: Column, most_lines: int = 35, most_chars: int = 800) -> Column:
    return F.substring(F.array_join(F.slice(lines(text), 1, most_lines), "\n"), 1, most_chars)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


PARAMETER = r"^(\{.*\}|:.+|<.*>|\[.*\]|\$\{.*\}|\*+|[0-9]+|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"


def route_segments(url: Column) -> Column:
    """Path segments of a URL or path: literals in lower case, parameters and numbers as {*}."""
    path = F.regexp_replace(F.regexp_replace(url, "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(PARAMETER), "{*}").otherwise(F.lower(s)))


def strip_proxy(segments: Column) -> Column:
    """Without the first of the prefixes api/v1, api/v2, api, v1, v2 that leaves something."""
    first, second, n = F.get(segments, F.lit(0)), F.get(segments, F.lit(1)), F.size(segments)
    drop = F.when((first == "api") & second.isin("v1", "v2") & (n > 2), 2).when(first.isin("api", "v1", "v2") & (n > 1), 1).otherwise(0)
    return F.slice(segments, drop + 1, F.greatest(n, F.lit(1)))


def join_route(segments: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def routes_match(a: Column, b: Column) -> Column:
    """EXACT, PROXY_PREFIX or TOPOLOGICAL_PARAM_MATCH of two segment arrays, else null."""
    x, y = strip_proxy(a), strip_proxy(b)
    same = F.size(a) == F.size(b)
    fits = F.forall(F.zip_with(a, b, lambda p, q: (p == q) | (p == "{*}") | (q == "{*}")), lambda ok: ok)
    return F.when(a == b, "EXACT").when((x == y) & (F.size(x) > 0), "PROXY_PREFIX").when(same & fits, "TOPOLOGICAL_PARAM_MATCH")


def normalize_sql(sql: Column) -> Column:
    """Comments dropped, literals as ?, lists of them as one, white space collapsed."""
    out = F.regexp_replace(sql, r"--[^\n]*", " ")
    out = F.regexp_replace(out, r"'[^']*'", "?")
    out = F.regexp_replace(out, r"\b[0-9]+(\.[0-9]+)?\b", "?")
    out = F.regexp_replace(out, r"\(\s*\?(\s*,\s*\?)*\s*\)", "(?)")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def sql_operation(sql: Column) -> Column:
    return F.upper(F.regexp_extract(sql, r"^\s*([A-Za-z]+)", 1))


def sql_table(sql: Column) -> Column:
    """Last component of the first table named, in lower case; UNKNOWN if none is."""
    found = F.regexp_extract(sql, r"(?i)\b(?:from|into|update|table)\s+(?:if\s+(?:not\s+)?exists\s+)?([A-Za-z_][A-Za-z0-9_.]*)", 1)
    return F.when(found == "", "UNKNOWN").otherwise(F.lower(F.element_at(F.split(found, r"\."), -1)))


def sql_relationship(sql: Column) -> Column:
    op = sql_operation(sql)
    return (
        F.when(op.isin("SELECT", "WITH"), "READS_TABLE").when(op.isin("INSERT", "UPDATE", "DELETE", "MERGE"), "WRITES_TABLE")
        .when(op.isin("CREATE", "ALTER", "DROP"), "DEFINES_TABLE").otherwise("UNKNOWN")
    )


# The marks, and the public formats of keys and tokens.
KEY_BLOCK = r"-----BEGIN [A-Z0-9 _-]*PRIVATE KEY(?:\s+BLOCK)?-----(?s:.*?)-----END [A-Z0-9 _-]*PRIVATE KEY(?:\s+BLOCK)?-----"
TOKENS = (
    r"sk-(?:test-|live-|proj-|ant-)?[A-Za-z0-9_-]{4,}", r"rk_(?:test|live)_[A-Za-z0-9]{4,}", r"AIza[0-9A-Za-z_-]{16,}", r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{16,}",
    r"github_pat_[A-Za-z0-9_]{16,}", r"glpat-[A-Za-z0-9_-]{10,}", r"hf_[A-Za-z0-9]{10,}", r"xox[baprs]-[A-Za-z0-9-]{10,}", r"eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}",
)
TOKEN = r"\b(?:" + "|".join(TOKENS) + r")\b"
BEARER = r"(?i)\b(Authorization\s*[:=]\s*[\"']?(?:Bearer|Basic|Token)\s+)[^\s\"'`,;]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CREDENTIALS = r"://[^/\s:@]+:[^/\s@]+@"
#: an assignment to a name that denotes a secret; values that are code or were replaced already are marked before
ASSIGNED = r"\b([A-Za-z0-9_]*(?i:password|passwd|secret|token|api_?key|private_?key|credential)s?)\b(\s*\"?\s*[:=]\s*[\"']?)"
CODE = ASSIGNED + r"(os\.|settings\.|config\.|env\.|None\b|null\b|\[REDACTED|\$)"
SECRET = ASSIGNED + "[^\\s\"'#,;}\\]\x01]+"
#: each pass with what a text must hold for it to be worth a try
PASSES = (
    (KEY_BLOCK, "[REDACTED_PRIVATE_KEY]", ("PRIVATE KEY",)), (EMAIL, "[EMAIL]", ("@",)), (CREDENTIALS, "://[REDACTED]@", ("://",)),
    (TOKEN, "[REDACTED_SECRET]", ("sk-", "rk_", "AIza", "AKIA", "ASIA", "gh", "glpat-", "hf_", "xox", "eyJ")), (BEARER, "$1[REDACTED]", ("uthorization", "UTHORIZATION")),
    (CODE, "$1$2\x01$3", ("=", ":")), (SECRET, "$1$2[REDACTED]", ("=", ":")), ("\x01", "", ("\x01",)),
)


def redact(text: Column) -> Column:
    """Key blocks, addresses, URL credentials, tokens of known formats, authorization headers and assigned secrets replaced.

    A pass over a text is made only if the text holds what the pass looks for.
    """
    def passed(pattern, mark, signs):
        return lambda x: F.when(reduce(or_, (x.contains(s) for s in signs)), F.regexp_replace(x, pattern, mark)).otherwise(x)

    out = F.array(text)  # as an array, so that the text of one pass is computed once for the next
    for pattern, mark, signs in PASSES:
        out = F.transform(out, passed(pattern, mark, signs))
    return F.get(out, F.lit(0))


def hash_sample(key: Column, rate: float) -> Column:
    """True for a share ``rate`` of keys, the same ones on every run."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967295.0 <= rate


def correlation_id(raw: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), raw), 256), 1, 16)


def module_of(path: Column) -> Column:
    """Dotted module of a source path; index files stand for their folder."""
    out = F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")
    out = F.regexp_replace(out, r"(^|/)(__init__|index|init)$", "")
    return F.when(out == "", "root").otherwise(F.regexp_replace(out, "/", "."))


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def percentile_index(values: Column, p: float, linear: bool = False) -> Column:
    """Element of a sorted array by half-even rounding: of p * n - 0.5, or of (n - 1) * p."""
    n = F.size(values)
    at = F.rint((n - 1) * F.lit(p)) if linear else F.rint(n * F.lit(p) - 0.5)
    return F.get(values, F.greatest(F.lit(0), F.least(at, n - 1)).cast("int"))
