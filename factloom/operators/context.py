"""Task-aware retrieval: from a question to a packet of evidence under a token budget."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import settle
from . import facts as O
from . import search as S

#: intent: (weights in thousandths of target, caller, callee, test, entry), relationships allowed, depth
INTENTS = {
    "DEBUG": ((300, 200, 150, 100, 50), ("CALLS", "READS_TABLE", "WRITES_TABLE", "HANDLED_BY", "TESTS"), 2),
    "REFACTOR": ((300, 250, 100, 150, 50), ("CALLS", "EXTENDS", "IMPORTS", "TESTS"), 2),
    "IMPLEMENT": ((250, 100, 200, 50, 100), ("CALLS", "EXTENDS", "IMPORTS", "HANDLED_BY"), 1),
    "REVIEW": ((250, 150, 150, 150, 50), ("CALLS", "TESTS", "IMPORTS"), 1),
    "UNDERSTAND": ((250, 150, 150, 50, 100), ("CALLS", "IMPORTS", "HANDLED_BY", "EXTENDS"), 2),
}
SIGNS = (("DEBUG", r"\b(bug|fix|error|fail\w*|crash\w*|wrong)\b"), ("REFACTOR", r"\b(refactor|rename|extract|move|clean ?up)\b"), ("REVIEW", r"\breview\b"), ("IMPLEMENT", r"\b(add|implement|create|build|support)\b"))


@dataclass
class Plan:
    """What a prompt asks for, as data: the same prompt always makes the same plan and digest."""

    prompt: str
    intent: str
    names: list[str]
    routes: list[str]
    paths: list[str]
    relationships: list[str] = field(default_factory=list)
    depth: int = 1
    budget: int = 2000

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def build_plan(prompt: str, budget: int = 2000) -> Plan:
    """Paths, routes and identifiers of a prompt, and the intent that its words show."""
    intent = next((name for name, p in SIGNS if re.search(p, prompt, re.I)), "UNDERSTAND")
    paths = re.findall(r"[\w./-]+\.(?:py|[jt]sx?|sql|html)\b", prompt)
    routes = [r for r in re.findall(r"(?<![\w.])/[\w{}/:-]+", prompt) if not any(r.strip("/") in p for p in paths)]
    names = [n for n in re.findall(r"\b[A-Za-z_]\w*(?:\.\w+)+|\b\w*_\w+\b|\b[A-Z][a-z]+[A-Z]\w*\b|`(\w+)`", prompt) if n]
    named = re.findall(r"\b[A-Za-z_]\w*(?:\.\w+)+\b|\b[a-z]+(?:_[a-z0-9]+)+\b|\b[A-Z][a-z]+(?:[A-Z]\w*)+\b", prompt) + names
    keep = list(dict.fromkeys(n for n in named if n not in paths and not any(n in p for p in paths)))
    _, relationships, depth = INTENTS[intent]
    return Plan(prompt, intent, keep, routes, paths, list(relationships), depth, budget)


def task_or_query(task=None, query=None):
    """The one of two inputs that is given (a text, a plan or a mapping); both only if they say the same.

    A mapping says its raw_prompt, goal, task or query; one that says nothing takes a text given beside it.
    """
    def said(x) -> str:
        if isinstance(x, dict):
            x = next((x[k] for k in ("raw_prompt", "goal", "task", "query") if x.get(k)), "")
        return str(x.prompt if isinstance(x, Plan) else x or "").strip()

    both = [x.strip() if isinstance(x, str) else x for x in (query, task) if (x.strip() if isinstance(x, str) else x)]
    if not both:
        raise ValueError("a task or a query must be given")
    texts = [t for t in map(said, both) if t]
    if len(set(texts)) > 1:
        raise ValueError(f"task and query differ: {texts}")
    rich = next((x for x in both if not isinstance(x, str)), both[0])  # structure says more than a text
    return {**rich, "raw_prompt": texts[0]} if isinstance(rich, dict) and texts and not said(rich) else rich


def candidates(plan: Plan, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol, path, layer, score (thousandths): targets and their neighbours by the intent's weights.

    A symbol keeps its best layer. symbols: canonical_id, name, path, category. Vendor and generated files go.
    """
    spark = symbols.sparkSession
    weights, allowed, _ = INTENTS[plan.intent]
    wanted = spark.createDataFrame([(n.split(".")[-1].lower(),) for n in plan.names] or [("",)], "wanted string").distinct()
    usable = symbols.where(~F.col("category").isin("VENDOR", "GENERATED", "MINIFIED", "BUNDLE", "BUILD_ARTIFACT"))
    target = usable.join(F.broadcast(wanted), F.lower("name") == F.col("wanted"), "left_semi").select(F.col("canonical_id").alias("symbol"))
    near = edges.where(F.col("relationship").isin(*allowed) & F.col("confidence").isin("HIGH", "MEDIUM"))
    into = near.join(target.withColumnRenamed("symbol", "target"), "target", "left_semi")
    out = near.join(target.withColumnRenamed("symbol", "source"), "source", "left_semi")
    layer = lambda df, column, name, weight: df.select(F.col(column).alias("symbol"), F.lit(name).alias("layer"), F.lit(400 + weight).alias("score"))
    every = O.union([
        layer(target, "symbol", "TARGET", weights[0]), layer(into.where("relationship = 'CALLS'"), "source", "CALLER", weights[1]), layer(out.where("relationship = 'CALLS'"), "target", "CALLEE", weights[2]),
        layer(into.where("relationship = 'TESTS'"), "source", "TEST", weights[3]), layer(into.where("relationship = 'HANDLED_BY'"), "source", "ENTRY", weights[4]),
    ])
    best = every.groupBy("symbol").agg(F.max(F.struct("score", "layer")).alias("b")).select("symbol", "b.layer", "b.score")
    return best.join(usable.select(F.col("canonical_id").alias("symbol"), "path"), "symbol", "left").withColumn("path", F.coalesce("path", F.lit("")))


def get_context(plan: Plan, symbols: DataFrame, edges: DataFrame, chunks: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The packet: symbol, path, layer, score, tokens, accepted, reason.

    chunks: symbol, content; or a function that makes them for the candidates (symbol), which are few.
    """
    found = settle(candidates(plan, symbols, edges))
    chunks = chunks(found) if callable(chunks) else chunks
    sized = found.join(chunks.select("symbol", T.estimated_tokens(T.snippet(F.col("content"))).alias("tokens")), "symbol", "left").withColumn("tokens", F.coalesce("tokens", F.lit(1).cast("long")))
    ranked = S.penalized(sized, "symbol", "score", {"path": 100}).drop("score").withColumnRenamed("final", "score").withColumn("task", F.lit(plan.digest))
    chosen = S.budget_select(ranked, "task", "symbol", "tokens", "score", "layer", plan.budget, 350)
    return ranked.join(chosen.drop("task"), "symbol").select("symbol", "path", "layer", "score", "tokens", "accepted", "reason")


def trust(packet: DataFrame, edges: DataFrame, excluded: list[str]) -> DataFrame:
    """supported, unsupported, excluded: what of a packet has evidence, and what should not be there."""
    chosen = settle(packet.where("accepted"))  # few, so the ends of all edges need not be made distinct
    known = edges.where("confidence <> 'UNKNOWN'").select(F.col("source").alias("symbol")).unionAll(edges.select("target"))
    known = known.join(chosen.select("symbol"), "symbol", "left_semi").distinct().withColumn("_k", F.lit(1))
    x = chosen.join(known, "symbol", "left")
    bad = F.col("symbol").isin(*excluded) if excluded else F.lit(False)
    return x.agg(F.count(F.when(F.col("_k") == 1, 1)).alias("supported"), F.count(F.when(F.col("_k").isNull(), 1)).alias("unsupported"), F.count(F.when(bad, 1)).alias("excluded"))


def session_summary(queries: DataFrame) -> DataFrame:
    """Per class of query (class, latency_ms, cached): totals, hits, cold and warm averages in microseconds."""
    micro = lambda cached: F.avg(F.when(F.col("cached") == cached, F.col("latency_ms") * 1000))
    return queries.groupBy("class").agg(F.count("*").alias("total"), F.count(F.when(F.col("cached"), 1)).alias("hits"), F.round(micro(False)).cast("long").alias("cold_us"), F.round(micro(True)).cast("long").alias("warm_us"))


def audit_secrets(tables: dict[str, DataFrame], seeded: list[str]) -> DataFrame:
    """table, n of rows that hold a seeded secret, a key block or URL credentials in any text column."""
    parts = []
    for name, df in tables.items():
        row = F.concat_ws("\x1f", *(F.col(c).cast("string") for c, k in df.dtypes if k in ("string", "binary")))
        hit = row.rlike(r"-----BEGIN [A-Z ]*PRIVATE KEY-----|://[^/\s:@]+:[^/\s@]+@")
        for s in seeded:
            hit = hit | row.contains(s)
        parts.append(df.where(hit).agg(F.lit(name).alias("table"), F.count("*").alias("n")).select("table", "n"))
    return O.union(parts)


def trace_of(observations: DataFrame, route: str | None = None, symbol: str | None = None, table: str | None = None) -> DataFrame:
    """All observations of traces in which a route, symbol or table occurs."""
    hit = F.lit(True)
    for column, value in (("route", route), ("handler", symbol), ("table", table)):
        hit = hit if value is None else hit & (F.lower(column) == value.lower())
    return observations.join(observations.where(hit).select("trace_id").distinct(), "trace_id", "left_semi")


def memory_search(memory: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Stored notes (key, value) that hold the query in any case."""
    q = query.lower()
    return memory.where(F.lower("key").contains(q) | F.lower("value").contains(q)).orderBy("key").limit(limit)


def exists_anywhere(name: str, *tables: tuple[DataFrame, str]) -> bool:
    """Is there a row of that name in any of the tables (frame, column)?"""
    return bool(O.union([df.where(F.col(c) == name).select(F.lit(1).alias("x")).limit(1) for df, c in tables]).take(1))


def relationships(edges: DataFrame, kind: str | None = None, part: str | None = None) -> DataFrame:
    """Edges of the database kinds with their status."""
    kinds = ("READS_TABLE", "WRITES_TABLE", "DEFINES_TABLE", "FOREIGN_KEY_TO", "READS_ENV")
    x = edges.where(F.col("relationship").isin(*kinds) if kind is None else F.col("relationship") == kind)
    x = x if part is None else x.where(F.lower("target").contains(part.lower()))
    return x.withColumn("status", F.when(F.col("confidence") == "HIGH", "VERIFIED").when(F.col("confidence") == "UNKNOWN", "UNKNOWN").otherwise("POSSIBLE"))


def git_log(spark: SparkSession, repository: str, most: int = 200) -> DataFrame:
    """commit, author, at, subject, paths of the newest commits; git runs on the driver."""
    import subprocess

    out = subprocess.run(["git", "-C", repository, "log", f"-n{int(most)}", "--name-only", "--format=%x1e%H%x1f%an%x1f%at%x1f%s"], capture_output=True, text=True, check=True).stdout
    rows = []
    for block in out.split("\x1e")[1:]:
        head, *paths = block.strip("\n").split("\n")
        commit, author, at, subject = head.split("\x1f")
        rows.append((commit, author, int(at), subject, [p for p in paths if p]))
    return spark.createDataFrame(rows, "commit string, author string, at long, subject string, paths array<string>")


def git_state(repository: str, indexed_commit: str | None) -> str:
    """CLEAN, DIRTY, STALE or ERROR of a working copy against the commit that was indexed."""
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", repository, *a], capture_output=True, text=True, check=False)
    head = run("rev-parse", "HEAD")
    if head.returncode:
        return "ERROR"
    if run("status", "--porcelain").stdout.strip():
        return "DIRTY"
    return "CLEAN" if indexed_commit == head.stdout.strip() else "STALE"


def git_head(repository: str) -> tuple[str | None, str | None]:
    """Commit and branch of a working copy, from its files alone: (None, None) if it is none."""
    root = Path(repository)
    folder = root / ".git"
    try:
        if folder.is_file():  # a worktree names its folder
            folder = (root / folder.read_text().partition("gitdir:")[2].strip()).resolve()
        head = (folder / "HEAD").read_text().strip()
        if not head.startswith("ref:"):
            return (head, None) if re.fullmatch("[0-9a-fA-F]{40}", head) else (None, None)
        ref = head[4:].strip()
        branch = ref.removeprefix("refs/heads/")
        shared = folder / "commondir"
        places = [folder, (folder / shared.read_text().strip()).resolve()] if shared.exists() else [folder]
        for place in places:
            if (place / ref).exists():
                return (place / ref).read_text().strip(), branch
            if (place / "packed-refs").exists():
                for line in (place / "packed-refs").read_text().splitlines():
                    if line[:1] not in "#^" and line.split()[1:] == [ref]:
                        return line.split()[0], branch
        return None, branch
    except OSError:
        return None, None
