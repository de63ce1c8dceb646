"""Language identification (operator 10): segmentation-marginalised unigrams over a public vocabulary.

Each language has a probability for every piece of a fixed SentencePiece vocabulary, from piece counts
of labelled texts. A word's probability in a language is the sum over all its segmentations into
pieces, by a forward pass over its code points; a text's is the product over its words. Pieces never
cross a word's end, so that equals the sum over all segmentations of the text. Workers remember words.
All new words of an Arrow slice go through the forward pass together.

Fitting takes every usable labelled row; operator 10 asks for at most FIT_ROWS of them (a seeded Bernoulli
draw on the id's digest, set to give about that many; all rows if there are fewer). Prediction covers every row.
The bounds of a fit come from every labelled row out of it, as exact quantiles.

Defined cases: null text, or no letter: `und`, score 0; words are split at white space and
lower-cased; code points that are no piece count as their bytes; without labelled rows all is `und`;
repeated rows give equal rows; ties go to the language that sorts first; rows with a null id are drawn for
a fit or not as the digest of the text says; a text of any length is judged whole, with its words in memory;
columns of any other name stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashTable, claim, crc_mod, discard, mapped, materialise, prefix_sums, slices, span_hashes, texts_of, tokenizer_path
from .piece_bpe import MARK, MODEL, model

#: Labelled rows that the fit of operator 10 takes, about.
FIT_ROWS = 20_000
#: Added to each piece's count.
SMOOTHING = 0.05
#: Words a worker remembers.
MEMO = 200_000
#: Bytes of text, and new words, that one step works on.
SLICE_BYTES, STEP = 1 << 20, 8_000
#: Code points up to which words are summed in plain probabilities; longer ones in logarithms.
PLAIN = 24
#: Fewest labelled rows out of a fit that a language needs to have bounds.
LEAST_ROWS = 20
#: Bins a unit that values are counted in to find where a quantile lies.
BINS = 4096
#: Characters from which on a text is long: shorter ones get a wider bound.
LONG = 200
#: Words whose plain sum is under this, near the end of what a float holds, are summed in logarithms too.
TINY = 1e-280



def piece_counts(rows: DataFrame, path: str) -> dict[str, np.ndarray]:
    """Counts of pieces per language; languages x vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        size = bpe.library.vocab_size()
        got: dict[str, np.ndarray] = {}
        for b in batches:
            texts = texts_of(b.column(0))
            for lo, hi, _, _ in slices(texts, SLICE_BYTES):
                ids = bpe.library.encode([" ".join(t.lower().split()) for t in texts.slice(lo, hi - lo).to_pylist()], num_threads=1)
                for lang, x in zip(b.column(1).slice(lo, hi - lo).to_pylist(), ids, strict=True):
                    n = np.bincount(np.array(x, np.int64), minlength=size)
                    got[lang] = got[lang] + n if lang in got else n
        for lang, n in got.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "piece", "n"])

    size = model(path).library.vocab_size()
    found = mapped(rows, run, "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    out: dict[str, np.ndarray] = {}
    for lang in sorted(set(found.column("lang").to_pylist())):
        part = found.filter(pa.compute.equal(found.column("lang"), lang))
        out[lang] = np.zeros(size)
        out[lang][part.column("piece").to_numpy()] = part.column("n").to_numpy()
    return out


class Unigrams:
    """Log probabilities of words in every language."""

    def __init__(self, counts: dict[str, np.ndarray], path: str):
        self.langs, self.path = list(counts), path
        bpe = model(path)
        size = bpe.library.vocab_size()
        rows = [np.log(n + SMOOTHING) - np.log((n + SMOOTHING).sum()) for n in counts.values()]
        log_p = np.array(rows).reshape(len(rows), size).T
        in_bytes = log_p[bpe.bytes].mean(axis=0)
        self.log_p = np.concatenate([log_p, np.outer(np.arange(5), in_bytes)])  # slot size + k: a code point of k bytes
        self.p = np.exp(self.log_p)
        self.clear()

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "path": self.path, "log_p": self.log_p, "p": self.p}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.clear()

    def clear(self) -> None:
        self.begin()
        self.older: tuple = (self.memo, self.rows, self.points)

    def begin(self) -> None:
        self.memo: dict[str, int] = {}
        self.rows, self.points = np.zeros((1024, len(self.langs))), np.zeros(1024, np.int32)

    def compile(self) -> None:
        bpe = model(self.path)
        keys, ids, self.longest = [], [], 1
        for p, (_, i) in bpe.pieces.items():
            points = np.frombuffer(p.encode("utf-32-le"), np.uint32)
            keys.append(span_hashes(prefix_sums(points), np.array([0]), np.array([len(points)]))[0])
            ids.append(i)
            self.longest = max(self.longest, len(points))
        self.table = HashTable(np.array(keys, np.uint64), np.array(ids, np.int64) + 1)

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, start, end, slot) of every piece in every word, each word behind a mark."""
        points = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(points)) - begin[word]
        left = size[word] - at
        sums, pos = prefix_sums(points), np.arange(len(points))
        got = []
        for n in range(1, self.longest + 1):
            here = pos[left >= n]
            if not len(here):
                break
            found, slot = self.table.find(span_hashes(sums, here, here + n))
            if n == 1:  # what is no piece stands for its bytes
                bytes_ = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
                got.append((word[here], at[here], at[here] + 1, np.where(found, slot - 1, len(self.log_p) - 5 + bytes_)))
            else:
                k = here[found]
                got.append((word[k], at[k], at[k] + n, slot[found] - 1))
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of every word in every language, all segmentations summed."""
        out = np.zeros((len(words), len(self.langs)))
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        logs = size > PLAIN
        for plain in (True, False):
            rows = np.flatnonzero(logs != plain)
            if not len(rows):
                continue
            width = int(size[rows].max()) + 1
            word, start, end, slot = self.edges([words[k] for k in rows])
            alpha = np.full((len(rows), width, len(self.langs)), 0.0 if plain else -np.inf)
            alpha[:, 0] = 1.0 if plain else 0.0
            order = np.lexsort((word, end))
            word, start, end, slot = word[order], start[order], end[order], slot[order]
            cuts = np.searchsorted(end, np.arange(width + 1))
            for e in range(1, width):
                lo, hi = cuts[e], cuts[e + 1]
                if lo == hi:
                    continue
                w = word[lo:hi]
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                if plain:
                    alpha[w[first], e] = np.add.reduceat(alpha[w, start[lo:hi]] * self.p[slot[lo:hi]], first)
                else:
                    alpha[w[first], e] = np.logaddexp.reduceat(alpha[w, start[lo:hi]] + self.log_p[slot[lo:hi]], first)
            last = alpha[np.arange(len(rows)), size[rows]]
            if plain:
                logs[rows] = (last < TINY).any(axis=1)
                last = np.log(np.maximum(last, TINY))
            out[rows] = last
        return out

    def texts(self, texts: list[str]) -> np.ndarray:
        """Log probability of every text in every language."""
        return self.told(texts)[0]

    def told(self, texts: list[str], fits: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Log probability of every text in every language; with fits, also that of its words of letters (three
        characters of four at least) alone, and how many characters these have, with one for each word's mark."""
        claim(self, self.clear)
        split = [t.lower().split() for t in texts]
        used = set(chain.from_iterable(split))
        if len(self.memo) > MEMO // 2:  # begins anew; what is met again moves over, the rest goes the next time
            self.older = (self.memo, self.rows, self.points)
            self.begin()
        new = used.difference(self.memo)
        known = list(new.intersection(self.older[0]))
        new = list(new.difference(known))
        base = len(self.memo)
        while base + len(known) + len(new) > len(self.rows):
            self.rows, self.points = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.points))
        if known:
            at = [self.older[0][w] for w in known]
            self.rows[base : base + len(known)], self.points[base : base + len(known)] = self.older[1][at], self.older[2][at]
            self.memo.update(zip(known, range(base, base + len(known)), strict=True))
            base += len(known)
        short = [k for k, w in enumerate(new) if len(w) < 4 * PLAIN]
        for lo in range(0, len(short), STEP):
            part = short[lo : lo + STEP]
            self.rows[base + np.array(part)] = self.forward([new[k] for k in part])
        for k, w in enumerate(new):
            if len(w) >= 4 * PLAIN:
                self.rows[base + k] = self.forward([w])[0]
        for k, w in enumerate(new):
            self.points[base + k] = len(w) + 1 if w.isalpha() or 4 * sum(map(str.isalpha, w)) >= 3 * len(w) else 0
        self.memo.update(zip(new, range(base, base + len(new)), strict=True))
        n = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        some = np.flatnonzero(n)
        first = (np.cumsum(n) - n)[some]

        def summed(values: np.ndarray) -> np.ndarray:
            out = np.zeros((len(split), *values.shape[1:]), values.dtype)
            if len(some):
                out[some] = np.add.reduceat(values, first, axis=0)
            return out

        rows = self.rows[at]
        total = summed(rows)
        if not fits:
            return total, None, None
        points = self.points[at].astype(np.int64)
        rows[points == 0] = 0.0
        return total, summed(rows), summed(points)




def fit(docs: DataFrame, usable: Column, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int | None = None, seed: int = 10) -> Unigrams:
    """Learned from all usable labelled rows, or from a draw of about most_rows of them."""
    path = path or tokenizer_path(MODEL)
    rows = docs.where(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    if most_rows is not None and (n := rows.count()) > most_rows:  # a draw on the digest of the id
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.col(text_col))), F.lit(1 << 20)) < int(most_rows / n * (1 << 20)))
    return Unigrams(piece_counts(rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), path), path)


def quantiles(rows: DataFrame, shares: list[float]) -> dict[str, tuple[int, list[float]]]:
    """(number of values, their quantiles at `shares`, as numpy.quantile has them) of each lang of the rows (lang, value).

    Exact, by counts: those of the bins tell where the values around a quantile lie, and only the distinct values of
    these bins come to the driver. The rows are read twice.
    """
    rows = rows.withColumn("bin", F.floor(F.col("value") * BINS))
    bins: dict[str, list[tuple[int, int]]] = {}
    for r in rows.groupBy("lang", "bin").count().toArrow().to_pylist():
        bins.setdefault(r["lang"], []).append((r["bin"], r["count"]))
    ranks, wanted, before = {}, set(), {}
    for lang, found in bins.items():
        at, n = np.array(sorted(found), np.int64).T
        upto = np.cumsum(n)
        ranks[lang] = [(int(x), min(int(x) + 1, int(upto[-1]) - 1), x % 1) for x in (float((upto[-1] - 1) * q) for q in shares)]
        for rank in {k for lo, hi, _ in ranks[lang] for k in (lo, hi)}:
            k = int(np.searchsorted(upto, rank, "right"))
            wanted.add((lang, int(at[k])))
            before[lang, int(at[k])] = int(upto[k] - n[k])
    if not wanted:
        return {}
    few = rows.join(F.broadcast(rows.sparkSession.createDataFrame(sorted(wanted), "lang string, bin long")), ["lang", "bin"], "left_semi")
    inside: dict[tuple[str, int], list[tuple[float, int]]] = {}
    for r in few.groupBy("lang", "bin", "value").count().toArrow().to_pylist():
        inside.setdefault((r["lang"], r["bin"]), []).append((r["value"], r["count"]))
    parts: dict[str, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for (lang, k), found in inside.items():
        values, n = zip(*sorted(found), strict=True)
        parts.setdefault(lang, []).append((before[lang, k], np.array(values), np.cumsum(n)))

    def value(lang: str, rank: int) -> float:
        first, values, upto = max((x for x in parts[lang] if x[0] <= rank), key=lambda x: x[0])
        return float(values[np.searchsorted(upto, rank - first, "right")])

    return {x: (sum(n for _, n in bins[x]), [float(np.quantile([value(x, lo), value(x, hi)], t)) for lo, hi, t in ranks[x]]) for x in bins}


def bounds(docs: DataFrame, unigrams: Unigrams, usable: Column, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[float, float]]:
    """(usual log probability a character, most that a long text stays under it) per language.

    From all usable labelled rows, best ones that the fit has not seen: their median, and twice its distance to
    their hundredth part, so that rare clean texts stay. A language with under LEAST_ROWS rows has no bound.
    """
    if not unigrams.langs:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(unigrams)
    rows = docs.where(usable & F.col(text_col).isNotNull() & F.col(lang_col).isin(unigrams.langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = shared.value
        if not hasattr(u, "table"):
            u.compile()
        for b in batches:
            texts = texts_of(b.column(0))
            for lo, hi, _, _ in slices(texts, SLICE_BYTES):
                _, part, points = u.told(texts.slice(lo, hi - lo).to_pylist(), True)
                lang = b.column(1).slice(lo, hi - lo)
                own = part[np.arange(hi - lo), [u.langs.index(x) for x in lang.to_pylist()]]
                some = points > 0
                yield pa.RecordBatch.from_arrays([lang.filter(pa.array(some)), pa.array(own[some] / points[some])], names=["lang", "value"])

    found = materialise(mapped(rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), run, "lang string, value double", keeps=True), "bounds")
    told = quantiles(found, [0.5, 0.01])
    discard(found)
    return {x: (told[x][1][0], 2 * (told[x][1][0] - told[x][1][1])) for x in unigrams.langs if x in told and told[x][0] >= LEAST_ROWS}


def _fits(u: Unigrams, best: np.ndarray, part: np.ndarray, points: np.ndarray, within: dict[str, tuple[float, float]]) -> np.ndarray:
    """Whether texts fit their best language; those without a word of letters can't be told and do."""
    usual, under = np.array([within.get(x, (0.0, np.inf)) for x in u.langs]).T
    n = np.maximum(points, 1)
    own = part[np.arange(len(best)), best] / n
    return (points == 0) | (own >= usual[best] - under[best] * np.sqrt(np.maximum(1, LONG / n)))


def _judge(u: Unigrams, texts: list[str], within: dict[str, tuple[float, float]] | None = None) -> tuple[list[str], np.ndarray]:
    """Language and score of texts; `und` with score 0 too, where `within` is given, if they don't fit."""
    if not hasattr(u, "table"):
        u.compile()
    if not u.langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    total, part, points = u.told(texts, within is not None)
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    letters = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
    if within is not None:
        letters &= _fits(u, best, part, points, within)
    return [u.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, score, 0.0)


def predict(docs: DataFrame, unigrams: Unigrams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (posterior of that language, even priors) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(unigrams)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi, _, _ in slices(texts, SLICE_BYTES):
                lang, score = _judge(shared.value, texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    out = mapped(rows, run, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double", keeps=True)
    return out.withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, unigrams: Unigrams, least: float = 0.5, text_col: str = "text", within: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The rows of docs, as they came, whose text has a language with a score of `least` or more, and fits
    that language by the bounds `within`: the score only tells the learned languages from one another."""
    shared = docs.sparkSession.sparkContext.broadcast(unigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(b.schema.get_field_index(text_col)))
            for lo, hi, _, _ in slices(texts, SLICE_BYTES):
                lang, score = _judge(shared.value, texts.slice(lo, hi - lo).to_pylist(), within)
                yield b.slice(lo, hi - lo).filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score.tolist(), strict=True)], pa.bool_()))

    return mapped(docs, run, docs.schema, keeps=True)


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 3) == 1


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs, fit(docs, ~held_out(), most_rows=FIT_ROWS))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
