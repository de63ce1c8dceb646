"""Benchmark decontamination (operator 6): broadcast hash set of normalised test n-grams.

Words are runs of digits, lower-cased letters and non-ASCII characters. A window is ten consecutive
words of an item, or the whole item if it is shorter. Each task looks the window hashes of its
documents up in the broadcast set and verifies every hit against the window's words. A benchmark of
more than BLOCK_BYTES is broadcast in blocks, one scan each that writes its hits only; the hits of all
blocks are joined to the rows and judged together.

Defined cases: a null or empty text has no words and no hits; an item without words has no window;
repeated items and rows behave like single ones; an item with a null id marks words but is not
named; an empty benchmark leaves everything clean; an empty table gives no rows; a row at most_share
exactly goes; texts of any length are scanned whole, in memory of some 30 bytes for each of theirs;
columns of any other name stay as they are, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import LOWER, hashed_spans, mapped, materialise, slices, spans

#: Most benchmark text in one broadcast; its index takes ten times as much at most (words of one letter).
BLOCK_BYTES = 16 << 20

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
RUNS_TYPE = ArrayType(StructType([StructField("lo", IntegerType()), StructField("hi", IntegerType())]))


class Words:
    """Word boundaries and hashes of the texts of a slice."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        low = LOWER[data]
        self.text = low.tobytes()
        self.starts, self.ends, self.first = spans(_WORD[low], offs)
        self.hashes = hashed_spans(low, self.starts, self.ends)

    def windows(self, size: int) -> np.ndarray:
        at = np.arange(max(0, len(self.starts) - size + 1))
        return hashed_spans(self.hashes, at, at + size)

    def join(self, lo: int, hi: int) -> bytes:
        return b" ".join([self.text[s:e] for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist(), strict=True)])


class Windows:
    """The windows of one length: sorted hashes with the first word of each, and a bit filter in front."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.words = hashes[order], words[order]
        bits = max(6, int(np.ceil(np.log2(8 * len(hashes)))))
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[hashes >> self.shift] = True
        self.filter = np.packbits(self.filter, bitorder="little")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in hashes that are known; from where to where they stand here)."""
        at = hashes >> self.shift
        maybe = np.flatnonzero(self.filter[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
        lo = np.searchsorted(self.hashes, hashes[maybe], "left")
        hi = np.searchsorted(self.hashes, hashes[maybe], "right")
        return maybe[hi > lo], lo[hi > lo], hi[hi > lo]


class Index:
    """The windows of some benchmark items in flat arrays: their words one after the other in one buffer, with
    a space behind each, and the hash and first word of every window, by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = 10):
        self.names: list[str | None] = []
        text, starts, firsts, found = [], [], [], {}
        n_bytes = n_words = 0
        for name, item in items:
            raw = np.frombuffer((item or "").encode(), np.uint8)
            w = Words(raw, np.array([0, len(raw)]))
            n = min(size, len(w.starts))
            if not n:
                continue
            length = w.ends - w.starts + 1
            text.append(w.join(0, len(w.starts)) + b" ")
            starts.append((n_bytes + np.cumsum(length) - length).astype(np.int64))
            hashes = w.windows(n)
            found.setdefault(n, []).append((hashes, np.arange(n_words, n_words + len(hashes), dtype=np.uint32)))
            firsts.append(n_words)
            self.names.append(name)
            n_bytes, n_words = n_bytes + len(text[-1]), n_words + len(w.starts)
        self.text = b"".join(text)
        starts = np.concatenate([*starts, [n_bytes]]).astype(np.int64)
        self.starts = starts.astype(np.uint32) if n_bytes < 1 << 32 else starts
        self.firsts = np.array(firsts, np.int64)
        self.windows = {n: Windows(np.concatenate([h for h, _ in x]), np.concatenate([w for _, w in x])) for n, x in found.items()}

    def nbytes(self) -> int:
        arrays = [self.starts, self.firsts, *(x for w in self.windows.values() for x in (w.hashes, w.words, w.filter))]
        return len(self.text) + sum(x.nbytes for x in arrays) + sum(map(len, filter(None, self.names)))

    def _same(self, known: Windows, k: int, n: int, asked: bytes) -> bool:
        w = int(known.words[k])
        return self.text[int(self.starts[w]) : int(self.starts[w + n]) - 1] == asked

    def hits(self, w: Words) -> Iterator[tuple[int, int, int, set[str]]]:
        """(row, first word, last word + 1, items) of every verified window; words count in the slice."""
        for n, known in self.windows.items():
            at, lo, hi = known.find(w.windows(n))
            row = np.searchsorted(w.first, at, "right") - 1
            inside = at + n <= w.first[row + 1]
            told: dict[int, tuple[bytes, frozenset[str]]] = {}
            for k, r, x, y in zip(at[inside].tolist(), row[inside].tolist(), lo[inside].tolist(), hi[inside].tolist(), strict=True):
                asked = w.join(k, k + n)
                if x not in told or told[x][0] != asked:
                    same = [j for j in range(x, y) if self._same(known, j, n, asked)]
                    if not same:
                        continue
                    of = np.unique(np.searchsorted(self.firsts, known.words[same], "right") - 1).tolist()
                    told[x] = asked, frozenset(self.names[j] for j in of if self.names[j] is not None)
                yield r, k, k + n, told[x][1]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in blocks of about `limit` bytes; the driver holds one at a time. An item is never cut."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // limit))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in part.distinct().toLocalIterator()]


def _found(index: Index, col: pa.Array) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """(words of every row, merged hit runs and items of the rows that have any) of a text column."""
    n_words, runs, items = np.zeros(len(col), np.int64), {}, {}
    for lo, hi, data, offs in slices(col):
        w = Words(data, offs)
        n_words[lo:hi] = np.diff(w.first)
        for r, s, e, names in index.hits(w):
            runs.setdefault(lo + r, []).append((s - int(w.first[r]), e - int(w.first[r])))
            items.setdefault(lo + r, set()).update(names)
    return n_words, {r: merged(x) for r, x in runs.items()}, items


def _runs_array(runs: dict[int, list[tuple[int, int]]], n: int) -> pa.Array:
    return pa.array([[{"lo": x, "hi": y} for x, y in runs.get(r, ())] for r in range(n)], RUNS)


def _hits_by_row(rows: DataFrame, benchmark: DataFrame, size: int, item_col: str, item_text_col: str, block_bytes: int) -> DataFrame:
    """rid, runs, items of the rows (rid, text) that any block of the benchmark hits. A block is one scan of its
    own, which writes hits only; one block's index is alive at a time."""
    found = []
    for block in blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = rows.sparkSession.sparkContext.broadcast(Index(block, size))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, runs, items = _found(shared.value, b.column(1))
                if at := sorted(runs):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), _runs_array({k: runs[r] for k, r in enumerate(at)}, len(at)), pa.array([sorted(items[r]) for r in at], pa.list_(pa.string()))], names=["rid", "runs", "items"])

        found.append(materialise(mapped(rows, run, f"rid long, runs {RUNS_TYPE.simpleString()}, items array<string>"), "benchmark-hits"))
        shared.destroy()
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row, written: a repeated task can't number them anew."""
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Column names like those asked for that docs does not have."""
    used = {c.lower() for c in docs.columns}
    return [next(c for k in range(len(used) + 1) if (c := f"{x}_{k}") not in used) for x in names]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, text, n_words, runs (hit words, as merged [lo, hi) word spans), items (sorted names) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, text string, n_words long, runs {RUNS_TYPE.simpleString()}, items array<string>"
    names = ["id", "text", "n_words", "runs", "items"]
    if (benchmark.agg(F.sum(F.octet_length(item_text_col))).first()[0] or 0) <= block_bytes:
        shared = docs.sparkSession.sparkContext.broadcast(Index(next(blocks(benchmark, item_col, item_text_col, block_bytes)), size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n_words, runs, items = _found(shared.value, b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words), _runs_array(runs, b.num_rows), pa.array([sorted(items.get(r, ())) for r in range(b.num_rows)], pa.list_(pa.string()))], names=names)

        return mapped(rows, run, schema)
    rows = _numbered(rows, "rid")
    hits = _hits_by_row(rows.select("rid", "text"), benchmark, size, item_col, item_text_col, block_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = Index([])
        for b in batches:
            n_words, _, _ = _found(nothing, b.column(1))
            runs = {r: merged([(y["lo"], y["hi"]) for y in x]) for r, x in enumerate(b.column(2).to_pylist()) if x}
            items = [x or [] for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words), _runs_array(runs, b.num_rows), pa.array(items, pa.list_(pa.string()))], names=names)

    return mapped(rows.join(hits, "rid", "left").select("id", "text", "runs", "items"), count, schema)


def clean_text(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the words of the runs; what stood between two hit words goes with them."""
    raw = np.frombuffer(text, np.uint8)
    w = Words(raw, np.array([0, len(raw)]))
    out, at = [], 0
    for lo, hi in runs:
        out.append(text[at : int(w.starts[lo])])
        at = int(w.ends[hi - 1])
    return b"".join([*out, text[at:]])


def rewritten(b: pa.RecordBatch, at: int, found: dict[int, list[tuple[int, int]]], n_words: np.ndarray | None, most_share: float, again: Index | None = None) -> tuple[list[pa.Array], np.ndarray]:
    """(columns with the runs found by row taken out, rows that stay). With n_words a row goes if most_share
    of its words or more are hit; what `again` finds in a text so made goes too. Column `at` is the text."""
    arrays, keep = list(b.columns), np.ones(b.num_rows, bool)
    if not found:
        return arrays, keep
    old = b.column(at)
    before = old.to_pylist()
    texts = list(before)
    for r, runs in found.items():
        if n_words is not None and sum(y - x for x, y in runs) >= most_share * n_words[r]:
            keep[r] = False
            continue
        text = clean_text(texts[r].encode(), runs)
        while again is not None:
            one = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            if not (more := merged([(s, e) for _, s, e, _ in again.hits(one)])):
                break
            text = clean_text(text, more)
        keep[r] = bool(text.strip())
        texts[r] = text.decode()
    arrays[at] = pa.array(texts, old.type)
    if (n := b.schema.get_field_index("n_chars")) >= 0:
        new = [c if t == o or o is None else len(t) for c, t, o in zip(b.column(n).to_pylist(), texts, before, strict=True)]
        arrays[n] = pa.array(new, b.column(n).type)
    return arrays, keep


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_share: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents rows without the hit spans; a row goes if most_share of its words or more are hit.

    Where taking a span out brings a new window about, that goes too: nothing of the benchmark is
    left. n_chars, if there, follows the text; other columns stay as they are. Hits of all blocks of
    the benchmark count together: the result does not depend on block_bytes.
    """
    if (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= block_bytes:
        shared = docs.sparkSession.sparkContext.broadcast(Index(next(blocks(benchmark, "item_id", "text", block_bytes)), size))
        out = _in_one_scan(docs, shared, most_share)
    else:
        out = _in_rounds(docs, benchmark, size, most_share, block_bytes)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    return out


def _in_one_scan(docs: DataFrame, shared, most_share: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            n_words, found, _ = _found(shared.value, b.column(at))
            arrays, keep = rewritten(b, at, found, n_words, most_share, shared.value)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema).filter(pa.array(keep))

    return mapped(docs, run, docs.schema)


def _in_rounds(docs: DataFrame, benchmark: DataFrame, size: int, most_share: float, block_bytes: int) -> DataFrame:
    """Each round finds the hits of every block in the texts as they are, then takes all of them out at once.
    Rows that a round changed are scanned again in the next, until none changes."""
    rid, runs_col = _free(docs, "rid", "runs")
    schema = StructType([*docs.schema.fields, StructField(runs_col, RUNS_TYPE)])

    def taken_out(rows: DataFrame, judge: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nothing = Index([])
            for b in batches:
                at = b.schema.get_field_index("text")
                found = {r: merged([(y["lo"], y["hi"]) for y in x]) for r, x in enumerate(b.column(b.num_columns - 1).to_pylist()) if x}
                n_words = _found(nothing, b.column(at))[0] if judge else None
                arrays, keep = rewritten(b, at, found, n_words, most_share)
                yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names).filter(pa.array(keep))

        return mapped(rows, run, schema)

    done, todo, judge = [], docs, True
    while True:
        rows = _numbered(todo, rid)
        hits = _hits_by_row(rows.select(F.col(rid).alias("rid"), "text"), benchmark, size, "item_id", "text", block_bytes)
        hits = hits.select(F.col("rid").alias(rid), F.col("runs").alias(runs_col))
        rows = rows.join(hits, rid, "left").select(*[F.col(f"`{c}`") for c in docs.columns], runs_col)
        rows = materialise(taken_out(rows, judge), "decontaminated")
        changed = F.coalesce(F.size(runs_col), F.lit(0)) > 0
        done.append(rows.where(~changed).drop(runs_col))
        todo, judge = rows.where(changed).drop(runs_col), False
        if todo.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def op6(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, benchmark)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + (r["hi"] - r["lo"]))
    out = found.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def brute_force(text: str | None, items: list[tuple[str, str | None]], size: int = 10) -> tuple[int, int, int, str]:
    """What op6 returns for one text, by plain loops; for tests."""
    import re

    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = words_of(text)
    hit, names = [False] * len(words), set()
    for name, item in items:
        w = words_of(item)
        n = min(size, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit[k : k + n] = [True] * n
                names.add(str(name))
    return len(words), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
