"""Referential integrity over time: references to records that do not exist.

A *direct* orphan is a reference whose key was never delivered (``missing``),
was first delivered after the referring row (``late``), or had been removed
when the referring row was made (``deleted``).  Orphans are *inherited* by the
rows that refer to an orphaned record; the cascade repeats a semi-join down the
foreign-key graph until no new record is orphaned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage

FOUND = ["table_name", "row_key", "field_name", "ref_key", "reason", "period"]


@dataclass(frozen=True)
class ForeignKey:
    """``table.field`` (a string or an array of strings) refers to ``target``.

    ``row_key`` names the column that identifies a row of ``table`` in reports,
    ``record_key`` the column by which other tables refer to ``table``.
    """

    table: str
    field: str
    target: str
    row_key: str
    record_key: str = "id"


def norm_key(c: Column) -> Column:
    """Keys are compared trimmed and in lower case; a blank key is none."""
    k = F.lower(F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", ""))
    return F.when(k != "", k)


def references(tables: dict[str, DataFrame], fks: list[ForeignKey], created: str) -> DataFrame:
    """One row for each non-blank reference of every foreign key."""

    def of(fk: ForeignKey) -> DataFrame:
        df = tables[fk.table]
        is_array = df.schema[fk.field].dataType.typeName() == "array"
        ref = F.explode(F.array_distinct(fk.field)) if is_array else F.col(fk.field)
        return df.select(
            F.lit(fk.table).alias("table_name"),
            F.col(fk.row_key).cast("string").alias("row_key"),
            norm_key(F.col(fk.record_key)).alias("record_key"),
            F.lit(fk.field).alias("field_name"),
            F.lit(fk.target).alias("target"),
            F.col(created).alias("at"),
            ref.alias("ref"),
        ).select("*", norm_key(F.col("ref")).alias("ref_key")).drop("ref").where("ref_key is not null")

    return reduce(DataFrame.unionByName, [of(fk) for fk in fks])


def key_lifetimes(tables: dict[str, DataFrame], removals: DataFrame, targets: list[str], created: str) -> DataFrame:
    """A row for each key of each referred table and each of its removals (nulls: never removed)."""
    keys = reduce(
        DataFrame.unionByName,
        [tables[t].select(F.lit(t).alias("target"), norm_key(F.col("id")).alias("ref_key"), F.col(created).alias("at")) for t in targets],
    )
    keys = keys.where("ref_key is not null").groupBy("target", "ref_key").agg(F.min("at").alias("first_at"))
    gone = removals.select(F.col("table_name").alias("target"), norm_key(F.col("removed_id")).alias("ref_key"), "removed_at", "restored_at")
    gone = gone.where("ref_key is not null and removed_at is not null").distinct()
    return keys.join(gone, ["target", "ref_key"], "left").withColumn("known", F.lit(True))


def direct_orphans(refs: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """The references of ``refs`` that are orphans, each once, with ``reason`` and ``period``.

    One equi-join; the (unique but for removals) key side never skews, and a
    hot key on the reference side is split by the adaptive skew join.
    """
    reason = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("first_at") > F.col("at"), "late")
        .when((F.col("removed_at") <= F.col("at")) & (F.col("restored_at").isNull() | (F.col("restored_at") > F.col("at"))), "deleted")
    )
    return (
        refs.join(lifetimes, ["target", "ref_key"], "left")
        .withColumn("reason", reason)
        .where("reason is not null")
        .select("table_name", "row_key", "record_key", "field_name", "target", "ref_key", "reason", F.date_format("at", "yyyy-MM").alias("period"))
        .distinct()
    )


def orphan_cascade(
    tables: dict[str, DataFrame],
    removals: DataFrame,
    fks: list[ForeignKey],
    created: str = "created_at",
) -> DataFrame:
    """Direct and inherited orphan references of all ``fks``.

    Columns: ``table_name, row_key, field_name, ref_key, reason, period, kind,
    depth``; ``kind`` is ``direct`` (depth 0) or ``inherited`` (reason
    ``orphaned_parent``, depth = number of steps to the direct orphan).  A
    reference that is directly orphaned is never reported as inherited too.

    Rounds are semi-joins of the references with the record keys orphaned in
    the round before; a record is orphaned if one of its rows holds an orphan.
    Only tables that are themselves referred to can hand orphans on, so the
    loop ends at the depth of the foreign-key graph, or, in a cyclic graph,
    when a round adds no record.  Null and blank references are no references;
    rows with a null time can only be ``missing`` and have a null ``period``;
    empty tables give no row (or, as targets, only ``missing``); repeated rows
    count once; columns not named in ``fks`` are ignored.
    """
    targets = sorted({fk.target for fk in fks})
    refs = references(tables, fks, created)
    lifetimes = key_lifetimes(tables, removals, targets, created)
    direct = cut_lineage(direct_orphans(refs, lifetimes), "orphans")
    found = [direct.withColumn("kind", F.lit("direct")).withColumn("depth", F.lit(0))]
    inner = [fk for fk in fks if fk.table in targets]

    def records(df: DataFrame) -> DataFrame:
        """The orphaned records that other tables refer to."""
        known = df.where(F.col("table_name").isin([fk.table for fk in inner]) & F.col("record_key").isNotNull())
        return known.select(F.col("table_name").alias("target"), F.col("record_key").alias("ref_key")).distinct()

    seen = fresh = records(direct) if inner else None
    depth = 0
    while inner and not fresh.isEmpty():
        depth += 1
        heirs = refs.join(fresh, ["target", "ref_key"], "left_semi").withColumn("reason", F.lit("orphaned_parent"))
        heirs = heirs.withColumn("period", F.date_format("at", "yyyy-MM")).drop("at").distinct()
        heirs = heirs.join(direct.select("table_name", "row_key", "field_name", "ref_key"), ["table_name", "row_key", "field_name", "ref_key"], "left_anti")
        heirs = cut_lineage(heirs.select(direct.columns), f"heirs{depth}")
        found.append(heirs.withColumn("kind", F.lit("inherited")).withColumn("depth", F.lit(depth)))
        fresh = cut_lineage(records(heirs).join(seen, ["target", "ref_key"], "left_anti"), f"fresh{depth}")
        seen = seen.unionByName(fresh)
    out = reduce(DataFrame.unionByName, found)
    return out.select(*FOUND, "kind", "depth")


#: The references of the narrative tables.
NARRATIVE_FKS = [
    ForeignKey("relations", "subject_id", "entities", "id"),
    ForeignKey("relations", "object_id", "entities", "id"),
    ForeignKey("entities", "source_documents", "source_docs", "record_id"),
]


def narrative_orphans(tables: dict[str, DataFrame], removals: DataFrame) -> DataFrame:
    return orphan_cascade(tables, removals, NARRATIVE_FKS)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, period, reason and kind."""
    return orphans.groupBy("table_name", "period", "reason", "kind").agg(
        F.count(F.lit(1)).alias("orphans"), F.count_distinct("ref_key").alias("keys")
    )
