"""The narrative tables as a property graph: nodes, edges and sections, each record once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import read_table

SUPER_LABEL = "Entity"


def filled(c: Column | str) -> Column:
    """A text trimmed, null where it is blank."""
    t = F.trim(c)
    return F.when(t != "", t)


def distinct_sorted(c: Column) -> Column:
    """The distinct members of an array that are no nulls or blanks, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")))


def merge_nodes(records: DataFrame, seq: str = "record_id") -> DataFrame:
    """One node an id: lists are united, of texts the last that is not empty (by ``seq``) stays, properties of later records win.

    Empty values never overwrite; ids are compared trimmed and in lower case;
    the super-label is no type, and a node without any other is a Concept.
    """
    last = lambda c: F.max_by(filled(c), F.when(filled(c).isNotNull(), F.col(seq)))
    united = lambda c: distinct_sorted(F.flatten(F.collect_set(F.coalesce(F.col(c), F.array().cast("array<string>")))))
    types = F.filter(united("entity_type"), lambda t: t != SUPER_LABEL)
    merged = records.withColumn("id", F.lower(filled("id"))).where("id is not null").groupBy("id").agg(
        last("name").alias("name"),
        last("description").alias("description"),
        F.lower(last("scope_level")).alias("scope"),
        types.alias("types"),
        united("aliases").alias("aliases"),
        united("source_documents").alias("source_documents"),
        last("base_document").alias("base_document"),
        F.count(F.lit(1)).alias("records"),
    )
    return merged.withColumn("types", F.when(F.size("types") > 0, F.col("types")).otherwise(F.array(F.lit("Concept"))))


def merge_edges(relations: DataFrame) -> DataFrame:
    """One edge a relation id: endpoints normalised, a confidence of null or zero is 1, redelivered rows dropped.

    Rows without an id or an endpoint are left out.
    """
    low = lambda c: F.lower(filled(c))
    rows = relations.select(
        low("id").alias("id"), low("subject_id").alias("src"), low("object_id").alias("dst"),
        F.coalesce(low("predicate"), low("relation_name"), F.lit("related_to")).alias("predicate"),
        filled("relation_name").alias("relation_name"), F.coalesce(low("persistence"), F.lit("momentary")).alias("persistence"),
        filled("description").alias("description"), F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(F.lit(1.0)).alias("confidence"),
        filled("base_document").alias("base_document"), "created_at",
    )
    return rows.where("id is not null and src is not null and dst is not null").dropDuplicates(["id"])


def sections_of(source_docs: DataFrame) -> DataFrame:
    """One section a source document: ``id, raw_id, title, position, doc_type, content``."""
    m = F.col("metadata")
    rows = source_docs.select(filled("id").alias("id"), filled(m["raw_doc_id"]).alias("raw_id"), filled(m["title"]).alias("title"), F.expr("try_cast(metadata['order'] as bigint)").alias("position"), filled(m["doc_type"]).alias("doc_type"), "content")
    return rows.where("id is not null").dropDuplicates(["id"])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_nodes(read_table(spark, sf_dir, "entities"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_edges(read_table(spark, sf_dir, "relations"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections_of(read_table(spark, sf_dir, "source_docs"))


#: The same views for the SQL twins.
NODES_SQL = """nodes AS (
  SELECT lower(trim(id)) id,
    arg_max(trim(name), record_id) FILTER (WHERE trim(name) <> '') name,
    arg_max(trim(description), record_id) FILTER (WHERE trim(description) <> '') description,
    lower(arg_max(trim(scope_level), record_id) FILTER (WHERE trim(scope_level) <> '')) AS scope,
    CASE WHEN len(list_filter(flatten(list(coalesce(entity_type, []))), lambda x: trim(x) <> '' AND x <> 'Entity')) = 0 THEN ['Concept']
      ELSE list_sort(list_distinct(list_filter(flatten(list(coalesce(entity_type, []))), lambda x: trim(x) <> '' AND x <> 'Entity'))) END types,
    list_sort(list_distinct(list_filter(flatten(list(coalesce(aliases, []))), lambda x: trim(x) <> ''))) aliases,
    list_sort(list_distinct(list_filter(flatten(list(coalesce(source_documents, []))), lambda x: trim(x) <> ''))) source_documents,
    arg_max(trim(base_document), record_id) FILTER (WHERE trim(base_document) <> '') base_document,
    count(*) records
  FROM entities WHERE trim(id) <> '' GROUP BY 1)"""
EDGES_SQL = """edges AS (
  SELECT * FROM (SELECT DISTINCT lower(trim(id)) id, lower(trim(subject_id)) src, lower(trim(object_id)) dst,
    coalesce(nullif(lower(trim(predicate)), ''), nullif(lower(trim(relation_name)), ''), 'related_to') predicate,
    nullif(trim(relation_name), '') relation_name, coalesce(nullif(lower(trim(persistence)), ''), 'momentary') persistence,
    nullif(trim(description), '') description, CASE WHEN confidence > 0 THEN confidence ELSE 1.0::DOUBLE END confidence,
    nullif(trim(base_document), '') base_document, created_at FROM relations
  WHERE trim(id) <> '' AND trim(subject_id) <> '' AND trim(object_id) <> ''))"""
SECTIONS_SQL = """sections AS (
  SELECT DISTINCT trim(id) id, nullif(trim(metadata['raw_doc_id']), '') raw_id, nullif(trim(metadata['title']), '') title,
    try_cast(metadata['order'] AS BIGINT) AS position, nullif(trim(metadata['doc_type']), '') doc_type, content
  FROM source_docs WHERE trim(id) <> '')"""
GRAPH_SQL = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, {SECTIONS_SQL}"
