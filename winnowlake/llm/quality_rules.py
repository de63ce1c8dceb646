"""Quality rules (operator 5): counting rules, and a hashed word and character n-gram logistic
regression trained on labelled rows, calibrated, with fixed thresholds, scored in Arrow slices.

The regression is fitted on nine tenths of the labelled rows taken (about FIT_ROWS and FIT_BYTES of text
at most, see quality_ftrl.labelled) and calibrated by Platt's method on the rest. Rules and scoring
cover every whole text.

Defined cases: a null or empty text has no words and fails the base rule; lines are split at \\n only
and compared as they stand; 5-word windows are compared by 64-bit hashes within one text; without
labels every probability is 1/2 and passes, as a probability that equals the threshold does; repeated
rows give equal rows; a text of any length is judged whole; columns of any other name stay as they are;
an empty table gives no rows.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, crc_mod, hashed_spans, mapped, mix, slices, spans, trim
from .quality_features import SLICE_BYTES, dots, sigmoid
from .quality_ftrl import fit_ftrl, labelled

#: Labelled rows, and bytes of their texts, that a fit takes, about: character n-grams are up to two
#: features a byte.
FIT_ROWS, FIT_BYTES = 3000, 8 << 20
#: A text passes whose calibrated probability is at least this.
THRESHOLD = 0.5
WINDOW = 5

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_BLANK = b" \t\n\r\x0b\x0c"


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text of a slice."""
    per_row = lambda x: np.diff(np.append(0, np.cumsum(x))[offs])
    solid = ~SPACE[data]
    starts, ends, first = spans(solid, offs)
    n_rows, n_words = len(offs) - 1, np.diff(first)
    h = hashed_spans(data, starts, ends)
    row = np.repeat(np.arange(n_rows), n_words)
    at = np.arange(max(0, len(h) - WINDOW + 1))
    at = at[row[at] == row[at + WINDOW - 1]]
    key = hashed_spans(h, at, at + WINDOW) ^ mix(row[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    key = key[order]
    twin = np.zeros(len(key), bool)
    if len(key) > 1:
        same = key[1:] == key[:-1]
        twin[1:] |= same
        twin[:-1] |= same
    cover = np.zeros(len(h) + 1, np.int64)
    hit = at[order[twin]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    whole = data.tobytes()
    dup = np.zeros(n_rows, np.int64)
    for k, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        lines = whole[lo:hi].split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x.strip(_BLANK)]
            dup[k] = len(lines) - len(set(lines))
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": per_row(solid & ((data & 0xC0) != 0x80)),
        "n_symbols": per_row(_SYMBOL[data]),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(row[covered], minlength=n_rows).astype(np.int64),
    }


class Rules:
    """A fitted regression with its calibration."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]]):
        held = [r for r in rows if r[0] % 10 == 0]
        self.weights, self.intercept = fit_ftrl([r for r in rows if r[0] % 10])
        x = np.array([self.weights[k] @ v + self.intercept for _, _, k, v in held])
        y = np.array([r[1] for r in held], float)
        self.slope, self.shift = platt(x, y)
        self.weights = self.weights.astype(np.float32)

    def probability(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (dots(data, offs, self.weights, chars=True) + self.intercept) + self.shift)


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that calibrate the margins x; 1 and 0 unless both labels are there."""
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * x + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - goal) * x).sum() + 1e-3 * (a - 1), (p - goal).sum() + 1e-3 * b])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        scale = min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Rules:
    try:
        return Rules(labelled(docs, labels, crc_mod("doc_id", 4) != 2, most_rows, most_bytes, chars=True, seed=5))
    finally:
        gc.collect()
        trim()


def judged(docs: DataFrame, rules: Rules, keep_columns: bool = False, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The base counts, probability, base_failed and kept of every row, behind its id; with
    keep_columns, instead the rows that are kept, as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def judge(data: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        base = base_counts(data, offs)
        p = shared.value.probability(data, offs)
        failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
        return base, p, failed, ~failed & (p >= threshold)

    if keep_columns:

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi, data, offs in slices(b.column(b.schema.get_field_index(text_col)), SLICE_BYTES):
                    yield b.slice(lo, hi - lo).filter(pa.array(judge(data, offs)[3]))

        return mapped(docs, keep, docs.schema)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in slices(b.column(1), SLICE_BYTES):
                base, p, failed, kept = judge(data, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *map(pa.array, base.values()), pa.array(p), pa.array(failed), pa.array(kept)], names=["id", *base, "probability", "base_failed", "kept"])

    schema = f"id {dict(rows.dtypes)['id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double, base_failed boolean, kept boolean"
    return mapped(rows, run, schema).withColumnRenamed("id", id_col)


def op5(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = judged(docs, fit(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
