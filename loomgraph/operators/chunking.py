"""Documents, parts and chunks: ids, order, fixed-width slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import collapsed
from loomgraph.sources.tables import filled


def normalised_documents(items: DataFrame) -> DataFrame:
    """``doc_id, raw_doc_id, content_key, title, subtitle, content`` of raw items, each once; without content none.

    The id is the item's own, or else a digest of its content; the raw id leaves
    out a segment's number.
    """
    key = F.substring(F.sha1("content"), 1, 16)
    rows = items.where(F.trim("content") != "").select(F.coalesce(filled("id"), key).alias("doc_id"), key.alias("content_key"), filled("title").alias("title"), filled("subtitle").alias("subtitle"), "content").distinct()
    return rows.withColumn("raw_doc_id", F.regexp_replace("doc_id", r"_seg_\d+$", ""))


def fixed_chunks(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, chunk_index, content, total``: slices of ``size`` characters, blanks collapsed before."""
    flat = docs.select("doc_id", collapsed(F.col("text")).alias("t")).where("t <> ''")
    n = F.ceil(F.length("t") / size).cast("int")
    rows = flat.select("doc_id", "t", n.cast("bigint").alias("total"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return rows.select("doc_id", F.col("i").cast("bigint").alias("chunk_index"), F.expr(f"substring(t, i * {size} + 1, {size})").alias("content"), "total")


def parts(chunks: DataFrame) -> DataFrame:
    """``id, document, position, total, part`` of ``id, document, i``: up to two chunks are one part; of an odd number the first is alone, then pairs."""
    w = Window.partitionBy("document")
    rows = chunks.withColumn("position", F.row_number().over(w.orderBy("i", "id")).cast("bigint")).withColumn("total", F.count(F.lit(1)).over(w))
    odd = F.when(F.col("position") == 1, 1).otherwise(F.floor(F.col("position") / 2) + 1)
    part = F.when(F.col("total") <= 2, 1).when(F.col("total") % 2 == 1, odd).otherwise(F.floor((F.col("position") + 1) / 2))
    return rows.select("id", "document", "position", "total", part.cast("bigint").alias("part"))
