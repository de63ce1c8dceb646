"""Proportional stratified interleaving (operator 7), DataFrame functions only.

Rows are shuffled within their source by a seeded digest of the id, get the fractional rank
(2 r + 1) / (2 n) inside the source, and are ordered by it over all sources; cutting that order
into equal runs gives shards whose row counts differ by one at most and which all have the mixture
of the whole.

No window sees a whole source: ranks are local to (source, digest bucket) and to buckets of the
fractional rank (one for CELL_ROWS rows, LEAST_CELLS at least), and bucket counts, summed up beforehand,
give the offsets. Groups of equal texts are not kept together nor apart: the law is on counts of rows,
and each copy is a row like any other.

Defined cases: a null source is a source of its own; a null text has no bytes and CRC 0; a null id
shuffles by the CRC of its text; rows with the same id are ordered by text CRC and size, and what then
still ties is equal in all that is returned; texts are read by two functions of the engine, whatever
their length; columns of any other name do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Digest buckets of a source: three hexadecimal digits.
DIGITS = 3
#: Buckets of the fractional rank: fewest, and rows of each, about.
LEAST_CELLS, CELL_ROWS = 4096, 250_000


def stratified_shards(docs: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size (UTF-8 bytes + 16), text_crc32, source, fraction, shard, slot for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("src"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.crc32(text.cast("binary")).cast("string")))).cast("binary")).alias("dig"),
    ).withColumn("bkt", F.substring("dig", 1, DIGITS))
    by_source = Window.partitionBy("src")
    counts = rows.groupBy("src", "bkt").count()
    counts = counts.select(
        F.col("src").alias("c_src"),
        F.col("bkt").alias("c_bkt"),
        F.coalesce(F.sum("count").over(by_source.orderBy("bkt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("count").over(by_source).alias("n_src"),
    )
    local = F.row_number().over(Window.partitionBy("src", "bkt").orderBy("dig", "id", "crc", "size"))
    ranked = rows.withColumn("local", local).join(counts, F.col("src").eqNullSafe(F.col("c_src")) & (F.col("bkt") == F.col("c_bkt")))
    frac = (2 * (F.col("before") + F.col("local") - 1) + 1).cast("double") / (2 * F.col("n_src")).cast("double")
    ranked = ranked.select("id", "src", "size", "crc", "dig", frac.alias("frac"))
    n_cells = max(LEAST_CELLS, docs.count() // CELL_ROWS)
    ranked = materialise(ranked.withColumn("cell", F.floor(F.col("frac") * n_cells).cast("int")), "shard-ranks")
    # n_cells rows at most
    cells = ranked.groupBy("cell").count()
    cells = cells.select(
        F.col("cell").alias("c_cell"),
        F.coalesce(F.sum("count").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("count").over(Window.partitionBy()).alias("n"),
    )
    local = F.row_number().over(Window.partitionBy("cell").orderBy("frac", "src", "dig", "id", "crc", "size"))
    out = ranked.withColumn("local", local).join(F.broadcast(cells), F.col("cell") == F.col("c_cell"))
    rank = F.col("before") + F.col("local") - 1
    out = out.withColumn("rank", rank).withColumn("shard", F.expr(f"(rank * {shards}) div n"))
    out = out.withColumn("slot", F.expr(f"rank - ((shard * n + {shards} - 1) div {shards})"))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("src").alias(source_col), F.col("frac").alias("fraction"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op7(spark, sf_dir: str) -> DataFrame:
    out = stratified_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
