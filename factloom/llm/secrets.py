"""Secret scans with SQL functions only: fixed patterns, and Shannon entropy over sliding windows.

Three patterns give the base spans, leftmost and without overlap for each kind. Besides them, runs of
at least ``WINDOW`` key-like characters that no base span covers are candidates: base spans are
blanked first, so what stands beside one is judged by itself. Over each candidate slides a window of
``WINDOW`` characters; the counts of its characters change by one in and one out, and with them the
sum of c * log2(c) from which the entropy follows. A candidate becomes a span if some window reaches
the threshold of its character class (hexadecimal or mixed), unless the allow-list suppresses it: no
digit or no letter in it, or the whole of it has a known harmless form.

Spark's functions give matches but not their places; a match's place is the length of all pieces and
matches before it, and the pieces are what ``split`` leaves by the same pattern. Sums over arrays are
taken in a logarithmic number of rounds, and texts are cut in blocks of spans, so a text with many
matches costs little more than as many texts with one. Only texts in which a pattern occurs take that
path.

Defined results: null texts are empty; a null doc_id stays null; rows that repeat are reported as
often; an empty table gives an empty result. Places count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_prefix, read

#: kind, pattern, group that must be long, its least length
KINDS = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # the greedy run reaches 18 characters or fails as a whole
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
THRESHOLDS = {"hex": 3.0, "mixed": 3.6}
#: forms that are no secrets: identifiers in words, dates and versions, placeholders, rulers
#: of the whole value, as a key may begin with any of them
ALLOWED = (
    r"^([A-Za-z]+[_/-])*[A-Za-z]+[_-]?[0-9]{0,4}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}[T_/-]?[0-9-]*Z?$|^[=_-]+$"
    r"|^(?i:([=+/_-]|example|placeholder|your|my|api|access|secret|token|key|password|value|here|x)+[0-9]{0,4})$"
)
MASK = "[SECRET]"


def let(value, use):
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values, fold, start):
    """For each place of an array, fold over the values up to it, in rounds that double their reach."""
    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(acc, k):
        return F.transform(acc, lambda x, i: fold(x, F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(start))))

    return F.aggregate(rounds, values, step)


def places(text, pattern: str, group: int, least: int):
    """Array of (start, end, found) of the matches whose group is long enough."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    matches = F.struct(found.alias("found"), inner.alias("inner"), F.split(text, pattern, -1).alias("pieces"))

    def placed(m):
        lengths = F.zip_with(m["found"], F.slice(m["pieces"], 1, F.size(m["found"])), lambda f, p: F.length(f) + F.length(p))
        every = F.arrays_zip(running(lengths, lambda x, y: x + y, 0).alias("end"), m["found"].alias("found"), m["inner"].alias("inner"))
        return F.transform(
            F.filter(every, lambda x: F.length(x["inner"]) >= least),
            lambda x: F.struct((x["end"] - F.length(x["found"])).alias("start"), x["end"].alias("end"), x["found"].alias("found")),
        )

    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(text.rlike(pattern), let(matches, placed)).otherwise(none)


def merged(spans):
    """(start, end) of spans sorted by start, those that overlap as one."""
    def heads(reach):
        one = F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), i.alias("at"), (x["start"] >= F.coalesce(F.get(reach, i - 1), F.lit(0))).alias("head")))
        ends = lambda h: F.transform(h, lambda x, i: F.struct(x["start"].alias("start"), F.get(reach, F.coalesce(F.get(h, i + 1)["at"], F.size(reach)) - 1).alias("end")))
        return let(F.filter(one, lambda x: x["head"]), ends)

    return let(running(F.transform(spans, lambda x: x["end"]), F.greatest, 0), heads)


def between(text, cuts):
    """The pieces of text before, between and after its cuts, of which there is at least one.

    A place in a string is found by counting from its start, so the text is cut at every so many cuts
    first, and then each block at each cut.
    """
    def by(wide):
        def block(k):
            some = F.slice(cuts, k * wide + 1, wide)
            base = F.coalesce(F.get(cuts, k * wide - 1)["end"], F.lit(0))

            def pieces(x):
                before = lambda i: F.coalesce(F.get(x["some"], i - 1)["end"], x["base"])
                return F.transform(x["some"], lambda c, i: F.substring(x["text"], before(i) - x["base"] + 1, c["start"] - before(i)))

            part = F.substring(text, base + 1, F.element_at(some, -1)["end"] - base)
            return let(F.struct(some.alias("some"), base.alias("base"), part.alias("text")), pieces)

        blocks = F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / wide).cast("int"))
        tail = F.substring(text, F.element_at(cuts, -1)["end"] + 1, F.length(text))
        return F.concat(F.flatten(F.transform(blocks, block)), F.array(tail))

    return let(F.ceil(F.sqrt(F.size(cuts))).cast("int"), by)


def blanked(text, spans):
    """text with spaces in place of sorted spans."""
    def blank(cuts):
        gaps = F.transform(cuts, lambda c: F.repeat(F.lit(" "), c["end"] - c["start"]))
        return F.array_join(F.zip_with(between(text, cuts), gaps, lambda p, g: F.concat(p, F.coalesce(g, F.lit("")))), "")

    return F.when(F.size(spans) > 0, let(merged(spans), blank)).otherwise(text)


def entropy(found):
    """Largest entropy in bits of a window of the string, by incremental counts."""
    weigh = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)))
    chars = F.transform(F.split(found, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    moves = let(chars, lambda c: F.transform(c, lambda x, i: F.struct(x.alias("into"), F.coalesce(F.get(c, i - WINDOW), F.lit(0)).alias("out"), (i + 1).alias("n"))))
    bits = lambda s: F.lit(math.log2(WINDOW)) - s / WINDOW

    def step(acc, x):
        count = lambda k: F.get(acc["counts"], k - 1)
        at = lambda c: F.get(weigh, c)
        change = at(count(x["into"]) + 1) - at(count(x["into"])) + F.when(x["out"] > 0, at(count(x["out"]) - 1) - at(count(x["out"]))).otherwise(0.0)
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == x["into"] - 1, 1).otherwise(0) - F.when(k == x["out"] - 1, 1).otherwise(0))
        return F.struct(
            counts.alias("counts"),
            (acc["sum"] + F.when(x["into"] == x["out"], 0.0).otherwise(change)).alias("sum"),
            F.greatest(acc["best"], F.when(x["n"] > WINDOW, bits(acc["sum"])).otherwise(0.0)).alias("best"),
        )

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    return F.aggregate(moves, start, step, lambda acc: F.greatest(acc["best"], bits(acc["sum"])))


def suspicious(found):
    mixed = found.rlike("[0-9]") & found.rlike("[A-Za-z]") & ~found.rlike(ALLOWED)
    least = F.when(found.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"]).otherwise(THRESHOLDS["mixed"])
    return F.when(mixed, entropy(found) >= least).otherwise(False)


def scan(docs: DataFrame, text_col: str = "text", prefix: str = "secret_") -> DataFrame:
    """docs with two more columns: <prefix>base and <prefix>entropy, arrays of (start, kind number, end)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    def marked(found, kind: int):  # functions that transform() calls have one argument
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    base = F.concat(*(marked(places(text, p, g, n), k) for k, (_, p, g, n) in enumerate(KINDS)))
    out = docs.withColumn(f"{prefix}base", F.sort_array(base)).withColumn(f"{prefix}rest", blanked(text, F.col(f"{prefix}base")))
    runs = places(F.col(f"{prefix}rest"), CANDIDATE, 0, WINDOW)
    return out.withColumn(f"{prefix}entropy", marked(F.filter(runs, lambda x: suspicious(x["found"])), len(KINDS))).drop(f"{prefix}rest")


def listed(spans):
    names = F.array(*(F.lit(k) for k in [k for k, *_ in KINDS] + ["entropy"]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    number = lambda k: F.size(F.filter("secret_base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)),
        F.sha2(listed(F.col("secret_base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("secret_base", "secret_entropy"))).alias("spans"),
    )


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every span, base or entropy, is replaced by a mark, spans that overlap by one.

    All documents stay. Null texts stay null and empty ones empty; a null doc_id, ties and rows that
    repeat are of no concern, as each row is judged alone; an empty table stays empty; other columns
    pass unread, but n_chars, if it is there, follows a text that changed.
    """
    prefix = free_prefix(docs, "secret_")
    found = scan(docs, "text", prefix).withColumn(f"{prefix}all", F.sort_array(F.concat(f"{prefix}base", f"{prefix}entropy")))
    spans, text = F.col(f"{prefix}all"), F.col("text")
    out = found.withColumn("text", F.when(F.size(spans) > 0, let(merged(spans), lambda cuts: F.array_join(between(text, cuts), MASK))).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
