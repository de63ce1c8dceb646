"""Context-tree weighting over bytes (operator 1).

The model is a context tree over the bytes in front of a byte, up to DEPTH of them; the byte itself
is decomposed into eight binary choices. Each node of each choice has a Krichevsky-Trofimov estimate
from all training texts, and a node's probability is the even mixture of its own estimate and the
product of its children's. A choice is then predicted by mixing the estimates on its path, at all depths,
each by its posterior weight; a context that training has not seen under a choice says 1/2.

A text is modelled as its lower-cased words, a space between two and a line feed as its end; the
bytes in front of a text count as line feeds. code length per byte = -score * log2(10) / n_bytes.

Spark counts (context, byte) grams of all texts, pre-aggregated in every task; the tree is built from
the distinct grams (not occurrences: a frequent context is no larger than a rare one) in blocks, each
the whole subtrees of some contexts. A context that would make a block too large is an inner one: its
subtree is dealt by one context byte more, and its own node is put together in the driver, as are those
of the root and of the contexts of one byte. There are MOST_BLOCKS inner contexts of a depth at most. The
gram and word tables grow with the corpus. Only their most frequent keys, as many as HOT_BYTES hold by a
count of them, are broadcast; for the others each text passes on what it holds, once a key, to be joined
with the tables and added up. Both ways use the same values.

Defined cases: a null or empty text is the end alone, and so is one of white space; a null id counts
as the empty text when the fold is drawn; repeated rows count each time and score alike; without any
training text every choice is even and base_score is that of unseen tokens; a text of any length is
scored whole, in memory of some 15 bytes for each of its own; only id and text are read, so columns
of any other name do not matter; there are no ties; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashTable, crc_mod, discard, hashed_spans, mapped, materialise, slices

#: Context bytes.
DEPTH = 6
#: Most bytes that the hash table of the frequent grams takes in a worker; that of the words takes half of it.
HOT_BYTES = 64 << 20
#: Distinct keys that a task gathers before it passes them on.
GATHER = 1_000_000
#: Rows of a batch that goes back to Spark, which holds it outside its heap.
ROWS = 1 << 16
#: Grams that a block of the tree holds, about; larger ones where there would be over MOST_BLOCKS of them.
BLOCK, MOST_BLOCKS = 250_000, 1_000

SLICE_BYTES = 1 << 20

GRAM, WORD, END = 0, 1, 2
_LOG2 = math.log(2)


# ---------------------------------------------------------------- streams
def stream(data: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, each behind `depth` line feeds; start and end of each, the end mark included)."""
    whole, pad = data.tobytes(), b"\n" * depth
    parts = [b" ".join(whole[lo:hi].lower().split()) for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    joined = pad + (b"\n" + pad).join(parts) + b"\n"
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    starts = np.cumsum(size + depth) - size
    return np.frombuffer(joined, np.uint8), starts, starts + size


def grams(s: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, texts they are of) of all positions of the texts, `step` bytes of the stream at a time. In a gram
    the byte is lowest, and the nearest context byte next."""
    for lo in range(depth, len(s), step):
        hi = min(lo + step, len(s))
        part = s[lo - depth : hi].astype(np.uint64)
        out = part[depth:].copy()
        for k in range(1, depth + 1):
            out |= part[depth - k : len(part) - k] << np.uint64(8 * k)
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
        begin, end = np.maximum(starts[first:last], lo) - lo, np.minimum(ends[first:last], hi) - lo
        inside = np.zeros(hi - lo + 1, np.int8)
        inside[begin] = 1
        inside[end] -= 1  # a text never begins where another ends: line feeds are between
        yield out[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)], np.repeat(np.arange(first, last), end - begin)


def words(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the first word of each text and one more."""
    letter = s > 0x20  # the stream holds no other white space
    letter |= (s < 0x20) & (s != 0x0A)
    prev = np.zeros(len(s), bool)
    prev[1:] = letter[:-1]
    lo = np.flatnonzero(letter & ~prev)
    hi = np.flatnonzero(~letter & prev)
    return hashed_spans(s, lo, hi), np.searchsorted(lo, np.append(starts, len(s)))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.diff(np.append(at, len(keys)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    n = np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def corpus_counts(rows: DataFrame, depth: int) -> DataFrame:
    """kind, key, n: training counts of all grams (those of held-out texts too: 0), words and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {GRAM: [], WORD: []}
        ends = 0

        def flush(kind: int, least: int) -> Iterator[pa.RecordBatch]:
            if parts[kind] and sum(len(k) for k, _ in parts[kind]) > least:
                parts[kind] = [_merged(parts[kind])]
                if len(parts[kind][0][0]) > least // 2:
                    keys, n = parts[kind].pop()
                    for lo in range(0, len(keys), ROWS):
                        k = keys[lo : lo + ROWS]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n[lo : lo + ROWS].astype(np.int64))], names=["kind", "key", "n"])

        for b in batches:
            train = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in slices(b.column(0), SLICE_BYTES):
                s, starts, stops = stream(data, offs, depth)
                for g, own in grams(s, starts, stops, depth):
                    fold = train[lo + own]
                    parts[GRAM].append(_counted(g[fold]))
                    if not fold.all():
                        keys, _ = _counted(g[~fold])
                        parts[GRAM].append((keys, np.zeros(len(keys), np.int64)))
                    yield from flush(GRAM, GATHER)
                w, first = words(s, starts, stops)
                parts[WORD].append(_counted(w[np.repeat(train[lo:hi], np.diff(first))]))
                ends += int(train[lo:hi].sum())
                yield from flush(WORD, GATHER)
        for kind in (GRAM, WORD):
            yield from flush(kind, 0)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.int8()), pa.array([0], pa.int64()), pa.array([ends], pa.int64())], names=["kind", "key", "n"])

    found = mapped(rows.select("text", "train"), run, "kind byte, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- the tree
def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2: Stirling's series behind an upward shift."""
    out = np.zeros_like(x)
    small = x < 8
    y = np.where(small, x + 8, x)
    p = x[small]
    prod = np.ones_like(p)
    for k in range(8):
        prod *= p + k
    out[small] = -np.log(prod)
    z = 1 / (y * y)
    return out + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the block probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1.0)


class Level:
    """The nodes of one depth and one choice."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, j: int):
        sym = (keys & np.uint64(255)).astype(np.int64)
        node = keys & ~np.uint64(255) | ((1 << j) | (sym >> (8 - j))).astype(np.uint64)
        new = np.append(True, node[1:] != node[:-1])[: len(node)]
        self.at = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        self.bit = (sym >> (7 - j)) & 1
        self.key = node[self.at]
        self.n1 = np.add.reduceat(n * self.bit, self.at)
        self.n0 = np.add.reduceat(n, self.at) - self.n1
        self.pe = self.weight = log_kt(self.n0, self.n1)

    def mix(self, children: np.ndarray) -> None:
        self.weight = np.logaddexp(self.pe, children) - _LOG2

    def predict(self, rows: np.ndarray, below: np.ndarray | None) -> np.ndarray:
        """Of the choice that rows make; negative where the node has not been seen."""
        k = self.of[rows]
        n = np.where(self.bit[rows] == 1, self.n1[k], self.n0[k])
        total = self.n0[k] + self.n1[k]
        p = (n + 0.5) / (total + 1.0)
        if below is not None:
            stop = np.exp(self.pe[k] - _LOG2 - self.weight[k])
            p = stop * p + (1 - stop) * np.where(below < 0, 0.5, below)  # what has seen nothing says 1/2
        return np.where(total > 0, p, -1.0)


def subtree(keys: np.ndarray, n: np.ndarray, depth: int, top: int = 2) -> tuple[np.ndarray, list[Level]]:
    """For grams that are sorted and hold whole subtrees from depth `top` on: the predictions (8 of
    each gram), and the levels at depth `top`."""
    mask = lambda d: np.uint64((1 << 8 * (d + 1)) - 1)
    keys_of, n_of, up = {depth: keys}, {depth: n.astype(np.float64)}, {}
    for d in range(depth - 1, top - 1, -1):
        keys_of[d], up[d] = np.unique(keys_of[d + 1] & mask(d), return_inverse=True)
        n_of[d] = np.bincount(up[d], weights=n_of[d + 1], minlength=len(keys_of[d]))
    out, tops = np.zeros((len(keys), 8), np.float32), []
    for j in range(8):
        levels = {d: Level(keys_of[d], n_of[d], j) for d in range(depth, top - 1, -1)}
        for d in range(depth - 1, top - 1, -1):
            child = levels[d + 1]
            parent = levels[d].of[up[d][child.at]]
            levels[d].mix(np.bincount(parent, weights=child.weight, minlength=len(levels[d].key)))
        rows = np.arange(len(keys))
        chain = [rows]
        for d in range(depth - 1, top - 1, -1):
            chain.append(up[d][chain[-1]])
        p = None
        for d, r in zip(range(depth, top - 1, -1), chain, strict=True):
            p = levels[d].predict(r, p)
        out[:, j] = p
        tops.append(levels[top])
    return out, tops


class Top:
    """The nodes over the blocks: of the inner contexts, which the driver puts together."""

    def __init__(self, inner: list[np.ndarray], at: np.ndarray, key: np.ndarray, sums: list[np.ndarray]):
        """inner: sorted contexts by depth; at, key: depth and context * 256 + node of the rows; sums: zeros,
        ones and weights of what stands below them and is no inner context itself."""
        self.inner, self.n, self.stop = inner, [], []
        child: tuple[np.ndarray, ...] | None = None
        for d in range(len(inner) - 1, -1, -1):
            dense = np.zeros((3, len(inner[d]), 256))
            rows = at == d
            where = np.searchsorted(inner[d], key[rows] >> np.uint64(8)), (key[rows] & np.uint64(255)).astype(np.int64)
            for x, part in zip(dense, sums, strict=True):
                x[where] = part[rows]
            if child is not None:
                parent = np.searchsorted(inner[d], inner[d + 1] & _mask(d))
                for x, part in zip(dense, child, strict=True):
                    np.add.at(x, parent, part)
            pe = log_kt(dense[0], dense[1])
            weight = np.logaddexp(pe, dense[2]) - _LOG2
            child = (dense[0], dense[1], weight)
            self.n.insert(0, np.stack([dense[0], dense[1]], axis=-1))
            self.stop.insert(0, np.exp(pe - _LOG2 - weight))

    def log_p(self, keys: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log probability of the bytes of grams, from what their blocks predict for their choices."""
        sym = (keys & np.uint64(255)).astype(np.int64)
        above = []
        for d in range(len(self.inner) - 1, -1, -1):
            context = keys >> np.uint64(8) & _mask(d)
            k = np.minimum(np.searchsorted(self.inner[d], context), len(self.inner[d]) - 1)
            above.append((self.n[d], self.stop[d], k, self.inner[d][k] == context))
        out = np.zeros(len(keys))
        for j in range(8):
            bit, z = (sym >> (7 - j)) & 1, (1 << j) | (sym >> (8 - j))
            q = p[:, j].astype(np.float64)
            for n, stop, k, there in above:
                total = n[k, z].sum(axis=1)
                kt = (n[k, z, bit] + 0.5) / (total + 1.0)
                q = np.where(there, np.where(total > 0, stop[k, z] * kt + (1 - stop[k, z]) * np.where(q < 0, 0.5, q), -1.0), q)
            out += np.log(np.where(q < 0, 0.5, q))
        return out


def _mask(d: int) -> np.uint64:
    return np.uint64((1 << 8 * d) - 1)


def _context(d: int) -> Column:
    return F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * d) - 1))


def inner_contexts(found: DataFrame, depth: int, block: int) -> list[np.ndarray]:
    """By depth, the contexts whose subtree is no block but is put together from those of the contexts that
    are longer by a byte: the empty one, those of one byte, and all that more than `block` grams end in. Of a
    depth there are no more than grams / block, or 256."""
    inner = [np.zeros(1, np.uint64), np.arange(256, dtype=np.uint64)]
    rows = found
    for d in range(2, depth):
        many = rows.groupBy(_context(d).alias("c")).count().where(F.col("count") > block).select("c").toArrow().column(0).to_numpy()
        if not len(many):
            break
        inner.append(np.sort(many.astype(np.uint64)))
        rows = found.where(_among(d, inner))
    return inner


def _among(d: int, inner: list[np.ndarray]) -> Column:
    return F.expr(f"(shiftrightunsigned(key, 8) & {(1 << 8 * d) - 1}L) IN ({', '.join(f'{c}L' for c in inner[d].tolist())})")


def gram_table(counts: DataFrame, depth: int, block: int) -> tuple[DataFrame, Callable[[], None]]:
    """(kind, key, n, value (log probability of the byte, as a float holds it) of every gram; what to call when
    the table has been read)."""
    found = counts.where(F.col("kind") == GRAM)
    inner = inner_contexts(found, depth, block)
    cut = F.lit(len(inner))
    for d in range(len(inner) - 1, 1, -1):
        cut = F.when(_among(d, inner), cut).otherwise(d)
    context = F.lit(0).cast("long")
    for d in range(2, len(inner) + 1):
        context = F.when(F.col("cut") == d, _context(d)).otherwise(context)
    fields = [("key", pa.int64()), ("above", pa.int8()), ("n", pa.int64()), ("n0", pa.float64()), ("n1", pa.float64()), ("weight", pa.float64()), ("p", pa.list_(pa.float32()))]
    schema = pa.schema(fields)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth of the block's contexts, grams, counts), cut between contexts."""
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            part = [b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()]
            held.append(part)
            size += b.num_rows
            if size > block:
                last = part[3] == part[3][-1]
                last &= part[2] == part[2][-1]
                at = int(np.flatnonzero(last)[0])
                if at:
                    held[-1] = [x[:at] for x in part]
                    yield from parted(held)
                    held, size = [[x[at:] for x in part]], len(part[0]) - at
        if size:
            yield from parted(held)

    def parted(held: list[list[np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        keys, n, cuts, _ = (np.concatenate(x) for x in zip(*held, strict=True))
        for d in np.unique(cuts).tolist():
            yield d, keys[cuts == d], n[cuts == d]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, keys, n in blocks(batches):
            yield from built(d, keys, n)

    def built(d: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        p, tops = subtree(keys, n, depth, d)
        for lo in range(0, len(keys), 1 << 16):
            k = keys[lo : lo + (1 << 16)].view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * len(k) + 1, 8, dtype=np.int32)), pa.array(p[lo : lo + (1 << 16)].ravel()))
            nul = pa.nulls(len(k), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), -1, np.int8)), pa.array(n[lo : lo + (1 << 16)]), nul, nul, nul, flat], schema=schema)
        for x in tops:  # summed up for the contexts that are shorter by a byte
            above, at = np.unique(x.key & np.uint64(255) | x.key & ~np.uint64(255) & (_mask(d - 1) << np.uint64(8)), return_inverse=True)
            sums = [pa.array(np.bincount(at, weights=w, minlength=len(above))) for w in (x.n0, x.n1, x.weight)]
            nul = pa.nulls(len(above), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(above.view(np.int64)), pa.array(np.full(len(above), d - 1, np.int8)), pa.nulls(len(above), pa.int64()), *sums, nul], schema=schema)

    dealt = found.select("key", "n", cut.cast("byte").alias("cut")).withColumn("context", context)
    dealt = dealt.repartition("cut", "context").sortWithinPartitions("cut", "context")
    tree = materialise(mapped(dealt, run, "key long, above byte, n long, n0 double, n1 double, weight double, p array<float>"), "ctw-tree")
    # 255 rows at most for each of the inner contexts
    rows = tree.where("above >= 0").groupBy("above", "key").agg(F.sum("n0"), F.sum("n1"), F.sum("weight")).toArrow()
    at, key, *sums = (rows.column(k).to_numpy() for k in range(5))
    shared = counts.sparkSession.sparkContext.broadcast(Top(inner, at, key.view(np.uint64), sums))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(2).flatten().to_numpy().reshape(-1, 8)
            log_p = shared.value.log_p(b.column(0).to_numpy().view(np.uint64), p)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), GRAM, np.int8)), b.column(0), b.column(1), pa.array(log_p.astype(np.float32).astype(np.float64))], names=["kind", "key", "n", "value"])

    def done() -> None:
        shared.destroy()
        discard(tree)

    return mapped(tree.where("above < 0").select("key", "n", "p"), finish, "kind byte, key long, n long, value double"), done


# ---------------------------------------------------------------- scoring
def _least(counts: DataFrame, kind: int, most: int) -> int:
    """The smallest n (0 or a power of two) such that at most `most` keys of the kind have n or more."""
    size = F.when(F.col("n") > 0, F.floor(F.log2("n"))).otherwise(-1).alias("size")
    rows = counts.where(F.col("kind") == kind).groupBy(size).count().collect()  # 65 rows at most
    have = {r["size"]: r["count"] for r in rows}
    total, least = 0, 64
    while least >= 0 and total + have.get(least - 1, 0) <= most:
        least -= 1
        total += have.get(least, 0)
    return 0 if least < 0 else 1 << least


#: Bytes a hot key takes in its hash table, at most.
SLOT_BYTES = {GRAM: 42, WORD: 55}


class Hot:
    """Keys and values; plain arrays where it is made and sent, a hash table where it is asked."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.pairs, self.table = (keys, values), None

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table is None:
            self.table, self.pairs = HashTable(*self.pairs), None
        return self.table.find(keys)


def _hot(table: DataFrame, kind: int, least: int) -> Hot:
    value = F.col("value").cast("float") if kind == GRAM else F.col("n")
    got = table.where((F.col("kind") == kind) & (F.col("n") >= least)).select("key", value).toArrow()
    return Hot(got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy())


def score(docs: DataFrame, train: Column, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", hot_bytes: int = HOT_BYTES, block: int = BLOCK) -> DataFrame:
    """id, train, n_tokens, n_known, train_tokens, base_score, score (log10 of the text), n_bytes."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), train.alias("train"))
    counts = materialise(corpus_counts(rows, depth), "ctw-counts")
    stats = {r["kind"]: r for r in counts.groupBy("kind").agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 0).alias("v"), F.sum("n").alias("n")).collect()}
    value = lambda kind, name: stats[kind][name] if kind in stats else 0
    ends, distinct = value(END, "n"), value(WORD, "v")
    total = value(WORD, "n") + ends
    floor = math.log10(total + 0.5 * (distinct + (ends > 0) + 1))
    grams_, done = gram_table(counts, depth, max(block, value(GRAM, "rows") // MOST_BLOCKS))
    words_ = counts.where(F.col("kind") == WORD).select("kind", "key", "n", F.log10(F.col("n") + 0.5).alias("value"))
    table = materialise(grams_.unionByName(words_), "ctw-table")
    done()
    discard(counts)
    least = {kind: _least(table, kind, hot_bytes // (kind + 1) // SLOT_BYTES[kind]) for kind in (GRAM, WORD)}
    shared = spark.sparkContext.broadcast([_hot(table, kind, least[kind]) for kind in (GRAM, WORD)])
    kind_of_id = dict(rows.dtypes)["id"]
    names = ["rid", "id", "train", "n_tokens", "n_known", "base", "score", "n_bytes", "kind", "key", "times"]
    schema = f"rid long, id {kind_of_id}, train boolean, n_tokens long, n_known long, base double, score double, n_bytes long, kind byte, key long, times long"

    def cold(row: np.ndarray, key: np.ndarray, kind: int, rid: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))[: len(row)])
        times = np.diff(np.append(at, len(row)))
        for lo in range(0, len(at), ROWS):
            a, t = at[lo : lo + ROWS], times[lo : lo + ROWS]
            nul = [pa.nulls(len(a), x) for x in (id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(row[a] + rid), *nul, pa.array(np.full(len(a), kind, np.int8)), pa.array(key[a].view(np.int64)), pa.array(t)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_grams, known_words = shared.value
        rid = TaskContext.get().partitionId() << 36  # the table is written once, so a repeated task can't mix numbers
        for b in batches:
            for lo, hi, data, offs in slices(b.column(1), SLICE_BYTES):
                n = hi - lo
                s, starts, stops = stream(data, offs, depth)
                size = stops - starts
                total_log = np.zeros(n)
                for g, own in grams(s, starts, stops, depth):
                    found, log_p = known_grams.find(g)
                    total_log += np.bincount(own, weights=log_p, minlength=n)
                    if not found.all():
                        yield from cold(own[~found], g[~found], GRAM, rid, b.schema.field(0).type)
                w, first = words(s, starts, stops)
                found, seen = known_words.find(w)
                own = np.repeat(np.arange(n), np.diff(first))
                base = np.bincount(own, weights=np.where(found, np.log10(seen + 0.5) - floor, 0.0), minlength=n)
                n_known = np.bincount(own, weights=found & (seen > 0), minlength=n).astype(np.int64)
                if not found.all():
                    yield from cold(own[~found], w[~found], WORD, rid, b.schema.field(0).type)
                part = b.slice(lo, n)
                columns = [np.arange(n) + rid, part.column(0), part.column(2), np.diff(first) + 1, n_known + int(ends > 0), base + math.log10(ends + 0.5) - floor, total_log, size]
                nul = [pa.nulls(n, t) for t in (pa.int8(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c) for c in columns), *nul], names=names)
                rid += n

    seen = materialise(mapped(rows, run, schema), "ctw-scan")
    shared.destroy()  # nothing reads it again
    rest = table.where(((F.col("kind") == GRAM) & (F.col("n") < least[GRAM])) | ((F.col("kind") == WORD) & (F.col("n") < least[WORD])))
    rest = rest.select(F.col("kind").alias("k"), F.col("key").alias("c_key"), "n", "value")
    pairs = seen.where(F.col("kind").isNotNull()).select("rid", "kind", "key", "times")
    pairs = pairs.join(rest, (F.col("kind") == F.col("k")) & (F.col("key") == F.col("c_key")), "left")
    word, times = F.col("kind") == WORD, F.col("times")
    more = pairs.groupBy(F.col("rid").alias("r")).agg(
        F.sum(F.when(word, times * (F.coalesce("value", F.lit(math.log10(0.5))) - floor)).otherwise(0.0)).alias("base_more"),
        F.sum(F.when(word & (F.col("n") > 0), times).otherwise(0)).alias("known_more"),
        F.sum(F.when(word, 0.0).otherwise(times * F.col("value"))).alias("score_more"),
    )
    out = seen.where(F.col("kind").isNull()).join(more, F.col("rid") == F.col("r"), "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "train", "n_tokens", add("n_known", "known_more").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        add("base", "base_more").alias("base_score"), (add("score", "score_more") / math.log(10)).alias("score"), "n_bytes",
    )


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, crc_mod("doc_id", 5) != 1)
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))
