"""Quality classifier (operator 4): hashed word n-gram logistic regression, trained with
follow-the-regularised-leader (proximal) updates, scored as sparse dot products.

Fitting takes at most FIT_ROWS labelled rows and FIT_BYTES of their texts (a seeded Bernoulli draw on the
id's digest, set to give about that much; all rows if there are fewer); the weights are 2**BITS numbers
whatever the input. Scoring covers every whole text in Arrow slices.

Defined cases: a null or empty text has no features and gets the intercept's probability; a row
without a label is scored all the same; labels that contradict each other for an id are all used;
without labels every score is 1/2; a score that equals a threshold is over it; repeated rows score alike; a
text of any length is scored whole, in memory of some 25 bytes for each of its own; only id and text
are read, so columns of any other name do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, mapped, materialise, slices
from .quality_features import BITS, SLICE_BYTES, dots, sigmoid, sparse

#: Labelled rows, and bytes of their texts, that a fit takes, about; the driver holds their features.
FIT_ROWS, FIT_BYTES = 4000, 16 << 20
EPOCHS = 12
#: Of the updates: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.6, 0.01, 1e-4, 1e-3


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, most_rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES, chars: bool = False, seed: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(fold 0..999, label, buckets, values) of the rows to fit on, in an order that does not depend on Spark."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y"))
    rows = docs.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n, size = rows.select("id", F.octet_length("text").alias("size")).join(marks, F.col("id") == F.col("l_id")).agg(F.count("*"), F.sum("size")).first()
    digest = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
    share = min(most_rows / max(1, n), most_bytes / max(1, size or 0))
    if share < 1:
        rows = rows.where(F.pmod(digest, F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = rows.join(marks, F.col("id") == F.col("l_id")).select(digest.alias("d"), "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in slices(b.column(2), SLICE_BYTES // 2):  # of all features at once
                got = sparse(data, offs, chars)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.astype(np.int32).tobytes() for x, _ in got], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())], names=["d", "y", "k", "v"])

    # bytes, one partition at a time: the driver never holds the rows twice
    found = materialise(mapped(rows, run, "d long, y int, k binary, v binary"), "labelled")
    out = [(r["d"], r["y"], np.frombuffer(r["k"], np.int32), np.frombuffer(r["v"], np.float32)) for r in found.toLocalIterator()]
    discard(found)
    out.sort(key=lambda r: (r[0], r[1], len(r[2]), xxhash.xxh64_intdigest(r[2].tobytes()), xxhash.xxh64_intdigest(r[3].tobytes())))
    return [(d % 1000, y, k, v) for d, y, k, v in out]


def fit_ftrl(rows: list[tuple[int, int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and intercept."""
    size = (1 << BITS) + 1  # the last coordinate is the intercept
    z, n = np.zeros(size), np.zeros(size)

    def weight(k: np.ndarray) -> np.ndarray:
        w = -(z[k] - np.sign(z[k]) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2)
        return np.where(np.abs(z[k]) <= l1, 0.0, w)

    rng = np.random.default_rng(4)
    for _ in range(epochs if rows else 0):
        for i in rng.permutation(len(rows)):
            _, y, k, v = rows[i]
            k, v = np.append(k, size - 1), np.append(v, 1.0)
            w = weight(k)
            g = (sigmoid(w @ v) - y) * v
            s = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha
            z[k] += g - s * w
            n[k] += g * g
    w = weight(np.arange(size))
    return w[:-1], float(w[-1])


def scored(docs: DataFrame, weights: np.ndarray, intercept: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (probability of label 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in slices(b.column(1), SLICE_BYTES):
                p = sigmoid(dots(data, offs, shared.value) + intercept)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p)], names=["id", "score"])

    return mapped(rows, run, f"id {dict(rows.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def op4(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = crc_mod("doc_id", 4)
    weights, intercept = fit_ftrl(labelled(docs, labels, fold != 2))
    out = scored(docs, weights, intercept)
    return out.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
