"""SimHash near-duplicates: exact tiled comparison by exclusive-or and bit counts.

Fingerprints
    Each text gets 64 bits: bit k is set if it is set in over half of the XXH64 values of the
    text's word shingles. Equal fingerprints are one node from then on, so copies cost nothing.

Comparison
    Two fingerprints that differ in at most r bits agree wholly on one of r + 1 bit fields. So
    distinct fingerprints meet in groups keyed by (field, its value), never all with all. (In the
    pipeline's stage they meet by MinHash bands, and the texts decide; see ``keep_first``.) Every
    group is sorted by population count and cut into tiles of ``INNER``; pairs of tiles whose counts
    differ by more than r are skipped, the others compared as a numpy matrix of exclusive-ors and bit
    counts. A group of over ``TILE`` is dealt to several tasks by the same rule: its work units are
    pairs of blocks of one population count. A unit returns a spanning forest of the pairs within r,
    never the pairs themselves.

Defined results: a null or empty text has fingerprint zero and links like any other; a null doc_id
is reported with its fingerprint and the smallest doc_id of its group (null if none has an id);
repeated rows are reported as often as they occur; an empty table gives an empty result. Other
columns are never read, so names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, forest, free_prefix, numbered, partitions, read, rows

WORDS, SEED, RADIUS, TILE = 4, 42, 4, 4096
INNER = 256  # fingerprints in a tile of a comparison
SETS, SHINGLES = 1024, 2048  # weight of a block of sets: one for each set, and one for so many shingles
#: of the pipeline's stage: MinHash bands and hashes in each, and the least Jaccard similarity as a fraction
BANDS, BAND, LEAST = 20, 4, (4, 5)
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
FACTORS, SHIFTS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * BAND, 1), dtype=np.uint64)


def spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 further bits of each hash; its own bits for k = 0."""
    if k:
        h = (h + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(32))
    return h


def shingles(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of the word shingles. bytes.lower and bytes.split treat just A-Z and the six ASCII white-space bytes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    ends = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends)], dtype=np.uint64)


def majority(h: np.ndarray, longs: int = 1) -> list[int]:
    """64 bits for each of longs."""
    out = []
    for k in range(longs):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 4096):
            part = spread(h[at : at + 4096], k)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(((ones * 2 > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum()))
    return out


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED, longs: int = 1) -> list[int]:
    return majority(shingles(text, words, seed), longs)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, longs: int = 1) -> DataFrame:
    """(doc_id, f0, f1, ...): the fingerprint as signed longs."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"f{k}", pa.int64()) for k in range(longs))])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words, longs=longs) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64).reshape(-1, longs)
            yield rows(schema, doc_id=b.column(0).cast(pa.int64()), **{f"f{k}": fp[:, k] for k in range(longs)})

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"f{k} long" for k in range(longs)))


def fields(n: int, longs: int = 1) -> list[tuple[int, int, int]]:
    """(long, shift, mask) of n bit fields for each long; each long's fields cover its 64 bits."""
    at = [64 * k // n for k in range(n + 1)]
    return [(w, a, (1 << (b - a)) - 1) for w in range(longs) for a, b in zip(at, at[1:])]


def tile_pairs(left: np.ndarray, right: np.ndarray, radius: int, tile: int = INNER):
    """Slices (of left, of right) to compare, given sorted population counts of both, in tiles.

    A pair of tiles whose counts are farther apart than the radius holds no link and is skipped.
    """
    for a in range(0, len(left), tile):
        low, high = left[a], left[min(a + tile, len(left)) - 1]
        for b in range(0, len(right), tile):
            if right[b] - high <= radius and low - right[min(b + tile, len(right)) - 1] <= radius:
                yield slice(a, a + tile), slice(b, b + tile)


def tiles_within(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two fingerprint arrays (rows of longs) that differ in at most radius bits."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    ones = [np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (left, right)]
    order = [np.argsort(x, kind="stable") for x in ones]
    one, two = left[order[0]], right[order[1]]
    for x, y in tile_pairs(ones[0][order[0]], ones[1][order[1]], radius):
        diff = sum(np.bitwise_count(one[x, k, None] ^ two[None, y, k]).astype(np.uint16) for k in range(left.shape[1]))
        i, j = np.nonzero(diff <= radius)
        found.append((order[0][i + x.start], order[1][j + y.start]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def joined(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.Table:
    """A spanning forest (a, b) of the links between node[i] and node[j]."""
    order = np.argsort(node, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    root = forest(rank[i], rank[j], len(node))
    far = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": node[order][far], "b": node[order][root[far]]}, schema=PAIR)


def tiled(scratch: Scratch, keyed: DataFrame, near: int, tile: int, compare) -> DataFrame:
    """Edges (a, b) that connect just what compare connects of the nodes that share (field, value).

    keyed: field, value, rank, weight, node and what compare reads. A group of at most ``tile`` in weight
    is one work unit. A larger one is dealt to blocks, each of one rank and of about ``tile``; its units
    are the pairs of blocks whose ranks are at most ``near`` apart, as no others hold a link. compare
    gets a unit's rows with the columns tile, lo and hi, which say of which blocks they are.
    """
    columns = [c for c in keyed.columns if c not in ("field", "value")]
    counts = keyed.groupBy("field", "value", F.col("rank").alias("ones")).agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    sizes = counts.groupBy("field", "value").agg(F.sum("n").alias("total"), F.sum("w").alias("most")).where("total > 1")
    single = sizes.where(F.col("most") <= tile).select("field", "value", F.lit(None).cast("array<struct<ones:int,parts:int>>").alias("cuts"))
    big = (
        counts.join(sizes.where(F.col("most") > tile), ["field", "value"])
        .groupBy("field", "value")
        .agg(F.sort_array(F.collect_list(F.struct("ones", F.ceil(F.col("w") / F.lit(tile)).cast("int").alias("parts")))).alias("cuts"))
    )
    plan = scratch.cut(single.unionAll(big))
    met = keyed.join(plan, ["field", "value"]).withColumn("part", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(
        F.expr("cast(pmod(xxhash64(node, 7), element_at(filter(cuts, c -> c.ones = rank), 1).parts) as int)")))
    tile_id = "rank * 1000000L + part"
    others = f"""case when cuts is null then array(struct(-1L as lo, -1L as hi)) else
        transform(flatten(transform(filter(cuts, c -> abs(c.ones - rank) <= {near}), c -> transform(sequence(0, c.parts - 1), p -> c.ones * 1000000L + p))),
                  t -> struct(least(t, {tile_id}) as lo, greatest(t, {tile_id}) as hi)) end"""
    units = met.select("field", "value", *columns, F.expr(f"case when cuts is null then -1L else {tile_id} end").alias("tile"), F.explode(F.expr(others)).alias("u")).select("field", "value", "u.lo", "u.hi", "tile", *columns)

    def grouped(batches):
        """Units arrive in order within a partition; one unit is held at a time."""
        keep: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy() for k in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:]):
                now = tuple(key[s])
                if now != last and keep:
                    yield from compare(pa.Table.from_batches(keep)).to_batches()
                    keep = []
                keep.append(b.slice(s, e - s))
                last = now
        if keep:
            yield from compare(pa.Table.from_batches(keep)).to_batches()

    keys = ["field", "value", "lo", "hi"]
    dealt = units.repartition(partitions(keyed.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(grouped, "a long, b long").distinct()


def sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of a unit's two blocks, which may be one."""
    tile = t["tile"].to_numpy()
    return np.flatnonzero(tile == t["lo"][0].as_py()), np.flatnonzero(tile == t["hi"][0].as_py())


def links(scratch: Scratch, nodes: DataFrame, at: list[tuple[int, int, int]] | None, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect just what the pairs of nodes (node, f0, ...) connect that agree on a
    field of ``at`` and differ in at most radius bits. Fingerprints in nodes are distinct.

    Without ``at``, nodes agree on a place of their array ``bands``.
    """
    longs = [c for c in nodes.columns if c not in ("node", "bands")]
    if at is None:
        values = F.transform("bands", lambda v, k: F.struct(k.alias("field"), v.alias("value")))
    else:
        values = F.array(*(F.struct(F.lit(k).alias("field"), F.shiftrightunsigned(f"f{w}", s).bitwiseAND(F.lit(m)).alias("value")) for k, (w, s, m) in enumerate(at)))
    ones = sum((F.bit_count(c) for c in longs), F.lit(0)).cast("int")
    keyed = nodes.select("node", *longs, ones.alias("rank"), F.lit(1).alias("weight"), F.explode(values).alias("g")).select("g.field", "g.value", "rank", "weight", "node", *longs)

    def compare(t: pa.Table) -> pa.Table:
        fp = np.stack([t[c].to_numpy().view(np.uint64) for c in longs], axis=1)
        first, second = sides(t)
        i, j = tiles_within(fp[first], fp[second], radius)
        return joined(t["node"].to_numpy(), first[i], second[j])

    return tiled(scratch, keyed, radius, tile, compare)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, for every row of docs."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.cut(fingerprints(docs, id_col, text_col, words))
    first = scratch.cut(prints.groupBy("f0").agg(F.min("doc_id").alias("low")))
    # a node is a fingerprint, so that documents without an id still connect others
    edges = links(scratch, first.select("f0", F.col("f0").alias("node")), fields(radius + 1), radius, tile)
    comp = scratch.cut(components(scratch, edges).withColumnRenamed("node", "f0"))
    lowest = scratch.cut(comp.join(first, "f0").groupBy("component").agg(F.min("low").alias("root")))
    named = scratch.cut(
        first.join(comp, "f0", "left").join(lowest, "component", "left").select("f0", F.coalesce("root", "low").alias("component_id"))
    )
    return prints.join(named, "f0").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def sketches(docs: DataFrame, longs: int) -> DataFrame:
    """(doc_id, row, same, f0, f1, ..., bands) of the set of each text's five-word shingles; same names the set."""
    names = ("doc_id", "row", *(f"f{k}" for k in range(longs)))
    schema = pa.schema([*((c, pa.int64()) for c in names), ("same", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            same, prints, bands = [], [], []
            for t in b.column(2).to_pylist():
                h = np.unique(shingles(t, 5))
                same.append(xxhash.xxh3_128_digest(h.tobytes()))
                prints.append(majority(h, longs))
                least = np.full(BANDS * BAND, 2**64 - 1, dtype=np.uint64)
                for at in range(0, len(h), 4096):
                    np.minimum(least, (h[None, at : at + 4096] * (FACTORS | np.uint64(1)) + SHIFTS).min(axis=1), out=least)
                keys = least.reshape(BANDS, BAND)
                bands.append([xxhash.xxh3_64_intdigest(k.tobytes()) for k in keys] if len(h) else [])
            fp = np.array(prints, dtype=np.uint64).view(np.int64).reshape(-1, longs)
            bands = [np.array(x, dtype=np.uint64).view(np.int64) for x in bands]
            yield rows(schema, doc_id=b.column(0).cast(pa.int64()), row=b.column(1), same=same, bands=bands, **{f"f{k}": fp[:, k] for k in range(longs)})

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", same binary, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, component, n, shingles) of texts (node, component, text): the set of five-word shingles as sorted hashes."""
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                sets = [np.unique(shingles(t, 5)) for t in b.column(2).slice(at, 500).to_pylist()]
                yield rows(schema, node=b.column(0).slice(at, 500), component=b.column(1).slice(at, 500), n=[len(x) for x in sets], shingles=[x.tobytes() for x in sets])

    return texts.select("node", "component", "text").mapInArrow(run, "node long, component long, n long, shingles binary")


def alike(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets whose Jaccard similarity is at least LEAST; which of right hold a shingle is looked up once."""
    every = np.concatenate([np.zeros(0, np.uint64), *right])
    owner = np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])[: len(every)])
    names, count = every[first], np.diff(np.append(first, len(every)))
    size = np.array([len(x) for x in right], dtype=np.int64)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k, own in enumerate(left):
        at = np.searchsorted(names, own)
        own_in = at < len(names)
        hit = at[own_in][names[at[own_in]] == own[own_in]]
        n = count[hit]
        places = np.repeat(first[hit] - np.cumsum(np.append(0, n))[:-1], n) + np.arange(n.sum())
        both = np.bincount(owner[places], minlength=len(right))
        j = np.flatnonzero(both * LEAST[1] >= (len(own) + size - both) * LEAST[0])
        found.append((np.full(len(j), k), j))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def alike_in(scratch: Scratch, sets: DataFrame, tile: int = SETS) -> DataFrame:
    """Edges (a, b) that connect what the pairs of sets of one component connect that are alike.

    Sets whose sizes differ by more than a fifth are not, so blocks have sizes of one power of 5/4.
    """
    power = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.log(F.lit(LEAST[1] / LEAST[0]))).cast("int")
    keyed = sets.select(F.lit(0).alias("field"), F.col("component").alias("value"), power.alias("rank"), (1 + F.floor(F.col("n") / SHINGLES)).alias("weight"), "node", "shingles")

    def compare(t: pa.Table) -> pa.Table:
        each = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        first, second = sides(t)
        i, j = alike([each[k] for k in first.tolist()], [each[k] for k in second.tolist()])
        return joined(t["node"].to_numpy(), first[i], second[j])

    return tiled(scratch, keyed, 1, tile, compare)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str, longs: int = 4, radius: int = 72, tile: int = TILE, block: int = SETS) -> DataFrame:
    """Pipeline stage: the row with the smallest doc_id of each group of near-duplicates stays.

    Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of at least
    0.8, and what such links connect. Sketches find where to look: texts are candidates of each other
    if they agree on one of 20 bands of four MinHash values, which a pair of similarity 0.8 misses with
    probability 0.5904 ** 20 = 2.7e-5, and differ in at most 72 of 256 bits, where such a pair differs
    in 39 on average, with deviation 6 (48 if one text has four shingles, the other five). What
    candidates connect is a component; in it all sets of shingles are compared, in blocks, whose
    tasks return spanning forests. So no pairs are written, however many texts are nearly alike, and
    a text goes only by links that its shingles have.

    Null and empty texts have no shingles and are copies of each other. Rows without a doc_id cannot
    be named as anyone's copy and stay. Of rows that repeat a doc_id, the one whose text has the
    smallest hash stands for the id, and the others go; of rows that repeat it with one text, any one
    stays. An empty table stays empty. Other columns pass unread; the texts are shuffled to meet their
    candidates, and to meet the ids that stay.
    """
    scratch, name = Scratch(spark), f"{free_prefix(docs, 'near_')}row"
    docs = numbered(scratch, docs, name)
    named = docs.where("doc_id is not null")
    prints = [f"f{k}" for k in range(longs)]
    texts = named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("row"), "text")
    repeated = F.min(F.struct(F.xxhash64("text").alias("h"), "row"))["row"]
    chosen = scratch.cut(texts.groupBy("doc_id").agg(repeated.alias("row"), F.count("*").alias("n")))
    own = chosen.where("n > 1").select("doc_id", F.col("row").alias("only"))
    known = sketches(texts, longs).join(own, "doc_id", "left").where("only is null or row = only")
    found = known.groupBy("same").agg(F.min(F.struct("doc_id", "row")).alias("id"), *(F.first(c).alias(c) for c in (*prints, "bands")))
    first = scratch.cut(found.select(F.col("id.doc_id").alias("node"), "id.row", *prints, "bands"))
    near = scratch.cut(components(scratch, links(scratch, first.drop("row"), None, radius, tile)))
    seen = first.join(near, "node").select(F.col("node").alias("doc_id"), "row", "component")
    sets = scratch.cut(shingle_sets(texts.join(seen, ["doc_id", "row"]).withColumnRenamed("doc_id", "node")))
    comp = components(scratch, alike_in(scratch, sets, block))
    keep = scratch.cut(first.join(comp.where("node <> component").select("node"), "node", "left_anti").select(F.col("node").alias("doc_id"), F.col("row").alias(name)))
    scratch.drop(sets)
    kept = named.join(keep, ["doc_id", name], "left_semi")
    return kept.unionByName(docs.where("doc_id is null")).select(*(F.col(f"`{c}`") for c in docs.columns if c != name))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
