"""SimHash near-duplicates (operator 2): fingerprints, tiled exact comparison, components.

Fingerprints are computed in Arrow batches. Distinct fingerprints go into cells by the population
counts of their two halves (33 x 33 at most); a cell is cut into tiles of bounded size. Two tiles
are compared bit by bit (numpy exclusive-or and bit counts) unless their population counts already
differ beyond the radius. A task merges what it finds and passes on a spanning forest only, never
all pairs; up to LOCAL_EDGES of their edges are joined on the driver, more by stars made in turn, with
equal components. Every fingerprint pair within the radius is compared, so no link is lost, and equal texts share one fingerprint from the start.

Defined cases: a null or wordless text has fingerprint zero and links like any other; fewer words
than a shingle make one shingle; a bit set in exactly half the shingles is not set; repeated rows are
equal members; a null id is a member that never names its component (null only if all ids of the
component are); a text is fingerprinted whole, with its words in memory; columns of any other name stay
as they are, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mapped, materialise, raw

#: Most fingerprints in a tile.
TILE = 8192
#: Keys that hold more than one row in so many are joined by broadcast.
HOT_KEYS = 1000
#: Rows and columns of one exclusive-or block.
BLOCK = (256, 4096)
#: Most forest edges, of 16 bytes, that are joined on the driver.
LOCAL_EDGES = 1 << 18


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    words = text.lower().split()
    if not words:
        return 0
    grams = list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))) if len(words) > size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(grams)
    for lo in range(0, n, 1 << 16):
        h = np.fromiter((digest(g, seed) for g in grams[lo : lo + (1 << 16)]), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep_digest: bool = False) -> DataFrame:
    """id, fp (the fingerprint as a signed long) and, if asked for, digest (of id and text) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.xxhash64(id_col, text_col).alias("digest")] if keep_digest else []))
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = raw(b.column(1))
            whole = memoryview(data)
            fp = np.fromiter((fingerprint(bytes(whole[lo:hi]), size, seed) for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)), np.uint64, len(offs) - 1)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(fp.view(np.int64))], names=[*kept, "fp"])

    types = dict(rows.dtypes)
    return mapped(rows, run, ", ".join(f"{c} {types[c]}" for c in kept) + ", fp long")


# ---------------------------------------------------------------- tiles
class Forest:
    """Union-find over the values it has been given; parents are smaller values."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while (y := p.get(x, x)) != x:
            p[x] = p.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = list(self.parent)
        return nodes, [self.root(x) for x in nodes]


def _link(a: np.ndarray, b: np.ndarray, hit: np.ndarray, forest: Forest) -> None:
    """Join what hit (rows a, columns b) marks. Dense blocks are first shrunk to label classes."""
    i, j = np.nonzero(hit)
    if len(i) > 4096:  # labels flow over the hits until they stay; then one join per row and column
        la, lb = np.arange(len(a)), np.full(len(b), len(a))
        while True:
            before = (la.copy(), lb.copy())
            np.minimum.at(lb, j, la[i])
            np.minimum.at(la, i, lb[j])
            if (la == before[0]).all() and (lb == before[1]).all():
                break
        rows, cols = np.unique(i), np.unique(j)
        for r in rows[la[rows] != rows].tolist():
            forest.join(int(a[r]), int(a[la[r]]))
        for c in cols.tolist():
            forest.join(int(b[c]), int(a[lb[c]]))
        return
    for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True):
        forest.join(x, y)


def compare(a: np.ndarray, b: np.ndarray, same: bool, radius: int, forest: Forest) -> None:
    """Join all pairs of signed fingerprints of a and b that differ in at most radius bits."""
    ua, ub = a.view(np.uint64), b.view(np.uint64)
    for lo in range(0, len(a), BLOCK[0]):
        x = ua[lo : lo + BLOCK[0], None]
        for at in range(lo // BLOCK[1] * BLOCK[1] if same else 0, len(b), BLOCK[1]):
            hit = np.bitwise_count(x ^ ub[None, at : at + BLOCK[1]]) <= radius
            if same:  # each pair once, none with itself
                hit &= np.arange(lo, lo + len(x))[:, None] < np.arange(at, at + hit.shape[1])[None, :]
            if hit.any():
                _link(a[lo : lo + BLOCK[0]], b[at : at + BLOCK[1]], hit, forest)


def links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Forest edges (u > v) over the distinct values of column fp, whose components are the groups."""
    spark = fps.sparkSession
    half = lambda at: F.bit_count(F.shiftrightunsigned(F.col("fp"), at).bitwiseAND(F.lit(0xFFFFFFFF)))
    cells = fps.withColumn("cell", (half(32) * 33 + half(0)).cast("int"))
    # 33 x 33 rows at most
    size = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}
    if not size:
        return spark.createDataFrame([], "u long, v long")
    cut = {c: -(-n // tile) for c, n in size.items()}
    near = [(x, y, cut[x], cut[y]) for x in cut for y in cut if x <= y and abs(x // 33 - y // 33) + abs(x % 33 - y % 33) <= radius]
    cuts = F.broadcast(spark.createDataFrame(list(cut.items()), "c int, cuts int"))
    tiles = cells.join(cuts, F.col("cell") == F.col("c")).withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    tiles = materialise(tiles.groupBy("cell", "sub").agg(F.sort_array(F.collect_list("fp")).alias("fps")), "simhash-tiles")
    pairs = spark.createDataFrame(near, "ca int, cb int, na int, nb int")
    pairs = pairs.withColumn("sa", F.explode(F.expr("sequence(0, na - 1)"))).withColumn("sb", F.explode(F.expr("sequence(if(ca = cb, sa, 0), nb - 1)")))
    one = tiles.select(F.col("cell").alias("ca"), F.col("sub").alias("sa"), F.col("fps").alias("a"))
    two = tiles.select(F.col("cell").alias("cb"), F.col("sub").alias("sb"), F.col("fps").alias("b"))
    work = pairs.select("ca", "sa", "cb", "sb").join(one, ["ca", "sa"]).join(two, ["cb", "sb"])
    work = work.select(F.expr("ca = cb and sa = sb").alias("same"), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for x in batches:
            same = x.column(0).to_pylist()
            a, b = x.column(1), x.column(2)
            for k in range(x.num_rows):
                compare(a[k].values.to_numpy(), b[k].values.to_numpy(), same[k], radius, forest)
        u, v = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64")  # a row holds up to two tiles
    try:
        return materialise(mapped(work, run, "u long, v long"), "simhash-links")
    finally:
        spark.conf.set(key, before)
        discard(tiles)


# ---------------------------------------------------------------- components
def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def smallest_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes that are no root, their roots) of edges: roots hook on to smaller neighbours until none can."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            rest = root != np.arange(len(nodes))
            return nodes[rest], nodes[root[rest]]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up


def components(edges: DataFrame, most_rounds: int = 50, most_local: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for every node of edges (u, v) that is no root; root is the smallest node it reaches.

    Up to most_local edges come to the driver: a round of stars is over ten exchanges, whose plans, threads
    and task metrics cost its JVM far more. Beyond, large and small stars in turn: each node's neighbours
    move to the smallest of them. Minima are aggregated before they are joined, so that a hub is never
    gathered in one task.
    """
    if edges.count() <= most_local:
        found = edges.toArrow()
        node, root = smallest_reached(found.column("u").to_numpy(), found.column("v").to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"node": node, "root": root}), "node long, root long")
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("members")).select("u", F.least("u", "m").alias("m"), "members")
        large = _joined(both.where("v > u"), least, "u", 2 * (seen[0] if seen else edges.count())).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, edges = edges, materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        discard(before)
        now = _state(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, root (smallest fingerprint of the group) and component (smallest id) of every row."""
    return _grouped(fingerprints(docs, size, seed, id_col, text_col), radius).select(F.col("id").alias(id_col), "fp", "root", "component")


def _grouped(rows: DataFrame, radius: int) -> DataFrame:
    """rows (id, fp, ...) with root and component."""
    rows = materialise(rows, "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("copies")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), radius))
    rooted = materialise(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", "copies", F.coalesce("root", "fp").alias("root")), "rooted-fingerprints")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component"), F.count("*").alias("members"))
    n = rooted.agg(F.count("*"), F.sum("copies")).first()
    fps = _joined(rooted, named, "root", n[0]).select("fp", "root", "component", F.col("copies").alias("members"))
    return _joined(rows, fps, "fp", n[1] or 0)


def _joined(rows: DataFrame, found: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the columns of found, which has one row a key and how many rows have it (members). Keys
    of over n / HOT_KEYS rows, HOT_KEYS at most, are broadcast: no group is gathered in one task."""
    hot, cold = found.where(F.col("members") * HOT_KEYS > n).drop("members"), found.where(F.col("members") * HOT_KEYS <= n).drop("members")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def deduplicated(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row of each group of near-duplicates, as it came: the one with the smallest id.

    Among rows with that id the one whose digest of id and text is smallest stays; of rows that
    agree in both, one. The texts are shuffled once, by that digest.
    """
    rows = fingerprints(docs, keep_digest=True)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("best")  # of a fingerprint, then of a group
    fps = materialise(rows.groupBy("fp").agg(best), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), radius))
    best = fps.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp")).agg(F.min("best").alias("best"))
    best = best.select(F.col("best.id").alias("b_id"), F.col("best.digest").alias("b_digest"))
    # one struct column: whatever the columns of docs are called, they meet no others
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("digest"))
    kept = packed.join(best, (F.col("digest") == F.col("b_digest")) & F.col("row.doc_id").eqNullSafe(F.col("b_id")))
    others = F.to_json(F.struct(*[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"]))
    one = kept.groupBy("b_digest", "b_id").agg(F.min_by("row", others).alias("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
