"""One surviving record for each group of duplicates, by skylines.

A record is the vector (completeness, trust, recency).  Of the records of an id
those that no other one dominates form the first layer, those undominated
without them the second, and so on.  A field takes its value from the first
layer in which it is not null, by the policy trust, recency, smallest record id;
a deeper layer is looked into as long as it may hold a record that the policy
prefers to the one found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stand-ins for "not known", in lower case and without blanks around them.
STAND_INS = [
    "unknown", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "tbd", "tba", "not mentioned", "not known",
    "not specified", "unspecified", "not available", "to be added", "to be determined", "missing", "undefined",
]

_BLANKS = r"[\s 　​﻿]+"


def says_something(c: Column) -> Column:
    """True for a text that is not null, blank, only signs, or a stand-in, perhaps in brackets."""
    stand_in = "|".join(re.escape(s) for s in STAND_INS)
    nothing = rf"(?i)^{_BLANKS[:-1]}*[(\[<{{]*(?:{stand_in})[)\]>}}.!?]*{_BLANKS[:-1]}*$"
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]") & ~c.rlike(nothing), F.lit(False))


def is_finished(c: Column) -> Column:
    """True for a description that ends as a sentence does, not cut off or with dots."""
    bare = F.regexp_replace(c, f"{_BLANKS}$", "")
    ends = bare.rlike("[.!?。！？][\"'”’»)\\]」』]*$")
    dots = bare.rlike("(\\.\\.|…)[\"'”’»)\\]」』]*$")
    return F.coalesce(ends & ~dots, F.lit(False))


def field_values(entities: DataFrame) -> DataFrame:
    """A row for each field with a value that counts: ``id, record_id, origin, updated_at, field, value``.

    ``value`` is the value as a list of strings; aliases keep all their entries.
    """
    description = F.when(says_something(F.col("description")) & is_finished(F.col("description")), F.array("description"))
    aliases = F.when(F.exists("aliases", says_something), F.col("aliases"))
    fixed = F.array(
        F.struct(F.lit("description").alias("field"), description.alias("value")),
        F.struct(F.lit("aliases").alias("field"), aliases.alias("value")),
    )
    props = F.transform(
        F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(F.concat(F.lit("properties."), e["key"]).alias("field"), F.when(says_something(e["value"]), F.array(e["value"])).alias("value")),
    )
    rows = entities.select("id", "record_id", "origin", "updated_at", F.explode(F.filter(F.concat(fixed, props), lambda x: x["value"].isNotNull())).alias("f"))
    return rows.select("id", "record_id", "origin", "updated_at", "f.field", "f.value")


def duplicated_ids(entities: DataFrame) -> DataFrame:
    """Ids with at least two different records (a repeated row counts once)."""
    n = entities.where("id is not null").groupBy("id").agg(F.min("record_id").alias("a"), F.max("record_id").alias("b"))
    return n.where("a < b").select("id")


def candidates(entities: DataFrame, origins: DataFrame) -> DataFrame:
    """The records that may give an id a field: ``id, records: array<struct<record_id, trust, recency, completeness, fields>>``.

    Of the records of one id and trust that have a field only the latest (then
    the smallest record id) can give it, whatever the layers, so the others go
    before the first shuffle of groups; an id keeps as many records as fields
    times origins at most, and a hot id never gathers in one task.  Only
    duplicated ids are looked at, and no value is carried, only which fields
    have one.
    """
    trust = origins.where("origin is not null").groupBy("origin").agg(F.max("trust").cast("int").alias("trust"))
    fields = F.array_distinct(F.transform(present_fields(), lambda f: f))
    recency = F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**63)))
    rows = entities.where("id is not null").select("id", "record_id", "origin", recency.alias("recency"), fields.alias("fields"))
    rows = rows.join(duplicated_ids(entities), "id", "left_semi").join(trust, "origin", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))
    each = rows.select("id", "trust", "recency", "record_id", F.size("fields").alias("completeness"), F.explode("fields").alias("field"))
    best = each.groupBy("id", "field", "trust").agg(F.max(F.struct("recency", (-F.col("record_id")).alias("r"), "completeness")).alias("b"))
    one = best.groupBy("id", (-F.col("b.r")).alias("record_id"), "trust", F.col("b.recency").alias("recency"), F.col("b.completeness").alias("completeness")).agg(F.collect_list("field").alias("fields"))
    return one.groupBy("id").agg(F.collect_list(F.struct("record_id", "trust", "recency", "completeness", "fields")).alias("records"))


def present_fields() -> Column:
    """The names of a record's fields with a value that counts."""
    description = F.when(says_something(F.col("description")) & is_finished(F.col("description")), F.lit("description"))
    aliases = F.when(F.exists("aliases", says_something), F.lit("aliases"))
    entries = F.filter(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>"))), lambda e: says_something(e["value"]))
    return F.filter(F.concat(F.array(description, aliases), F.transform(entries, lambda e: F.concat(F.lit("properties."), e["key"]))), lambda x: x.isNotNull())


def dominance_layers(records: list[dict]) -> list[list[dict]]:
    """Records by layer: each is dominated by one of the layer before, and by none of its own."""

    def dominates(a: dict, b: dict) -> bool:
        x, y = ((r["completeness"], r["trust"], r["recency"]) for r in (a, b))
        return x != y and all(p >= q for p, q in zip(x, y))

    layers, left = [], records
    while left:
        top = [r for r in left if not any(dominates(o, r) for o in left)]
        layers.append(top)
        left = [r for r in left if not any(r is t for t in top)]
    return layers


def fill_fields(records: list[dict]) -> dict[str, tuple[int, int]]:
    """The record that gives each field, and its layer (from 1)."""
    order = lambda r: (-r["trust"], -r["recency"], r["record_id"])
    layers = dominance_layers(records)
    out: dict[str, tuple[tuple, int, int]] = {}
    for depth, layer in enumerate(layers, 1):
        best_here = min(order(r) for r in layer)
        if depth > 1 and out and len(out) == n_fields and all(v[0] < best_here for v in out.values()):
            break  # what is deeper is dominated by this layer, and the policy prefers what has been found
        if depth == 1:
            n_fields = len({f for r in records for f in r["fields"]})
        for r in layer:
            for f in r["fields"]:
                if f not in out or order(r) < out[f][0]:
                    out[f] = (order(r), r["record_id"], depth)
    return {f: (i, d) for f, (_, i, d) in out.items()}


def surviving_fields(entities: DataFrame, origins: DataFrame) -> DataFrame:
    """``id, field, record_id, layer``: for each duplicated id and field, the record whose value survives, and its dominance layer.

    Null or empty fields everywhere give no row; ids with one record (or one
    repeated) give none; ties go to the smallest record id; null ids belong to
    no group; unknown and null origins have trust 0; a null time is older than
    any; an empty table gives an empty result; other columns are ignored.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, f, r, d) for i, records in zip(pdf["id"], pdf["records"]) for f, (r, d) in fill_fields(list(records)).items()]
            yield pd.DataFrame(rows, columns=["id", "field", "record_id", "layer"])

    return candidates(entities, origins).mapInPandas(fill, "id string, field string, record_id bigint, layer int")


def surviving_values(entities: DataFrame, origins: DataFrame) -> DataFrame:
    """``surviving_fields`` with each ``value``, fetched from its record at the end."""
    kept = surviving_fields(entities, origins)
    values = field_values(entities).select("id", "record_id", "field", "value")
    return kept.join(values.dropDuplicates(["id", "record_id", "field"]), ["id", "record_id", "field"])


def surviving_records(entities: DataFrame, origins: DataFrame) -> DataFrame:
    """The merged record of each duplicated id: ``id, description, aliases, properties, sources`` (field -> record id)."""
    v = surviving_values(entities, origins)
    one = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    is_prop = F.col("field").startswith("properties.")
    props = F.collect_list(F.when(is_prop, F.struct(F.expr("substring(field, 12)").alias("key"), F.col("value")[0].alias("v"))))
    return v.groupBy("id").agg(
        one("description")[0].alias("description"),
        one("aliases").alias("aliases"),
        F.map_from_entries(F.array_sort(props)).alias("properties"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "record_id")))).alias("sources"),
    )


def best_by_window(entities: DataFrame, origins: DataFrame) -> DataFrame:
    """The rule stated plainly, for tests: the first row of a sort per id and field."""
    trust = origins.groupBy("origin").agg(F.max("trust").alias("trust"))
    rows = field_values(entities).join(trust, "origin", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))
    w = Window.partitionBy("id", "field").orderBy(F.desc("trust"), F.desc_nulls_last("updated_at"), "record_id")
    rows = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return rows.join(duplicated_ids(entities), "id", "left_semi").select("id", "field", "record_id")
