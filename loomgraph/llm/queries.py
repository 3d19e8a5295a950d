"""Queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import mixing, pairs, scans, splitting, subjects, survivors, tokenizer, variants
from loomgraph.plans.registry import Registry
from loomgraph.session import read_table

llm = Registry()
query = llm.query


# 1: splitting oversized items


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = splitting.with_limits(*(read_table(spark, sf_dir, t) for t in ("source_docs", "chunks", "size_limits")))
    return splitting.split_oversized(items, "content", "max_words", "overlap_words")


_P1_SQL = """
WITH items AS (
  SELECT 'document' item_kind, id item_id, content, metadata['doc_type'] doc_type FROM source_docs
  UNION ALL SELECT 'chunk', id, content, metadata['doc_type'] FROM chunks)
SELECT DISTINCT item_kind, item_id FROM items JOIN size_limits USING (item_kind, doc_type)
WHERE len(regexp_extract_all(content, '[A-Za-z0-9]+|[\\x{4e00}-\\x{9fff}]')) > max_words
"""


@query("p1_found", _P1_SQL)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("item_kind", "item_id").distinct()


@query("p1_pieces")
def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = _split(spark, sf_dir).dropDuplicates(["item_kind", "item_id"])
    return splitting.explode_pieces(once, "content", ["item_kind", "item_id", "source_doc_id"])


# 6: surviving records

# written out, so that the twin doesn't depend on the operator's list
_STAND_INS = """'unknown', 'n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'nan', 'tbd', 'tba', 'not mentioned', 'not known',
  'not specified', 'unspecified', 'not available', 'to be added', 'to be determined', 'missing', 'undefined'"""
_SAYS = lambda c: f"""(regexp_matches({c}, '[\\p{{L}}\\p{{N}}]') AND trim(lower({c}), ' \t\r\n') NOT IN ({_STAND_INS})
  AND regexp_replace(trim(lower({c}), ' \t\r\n'), '^[(\\[<{{]+|[)\\]>}}.!?]+$', '', 'g') NOT IN ({_STAND_INS}))"""  # noqa: E731
_P6_SQL = f"""
WITH vals AS (
  SELECT id, record_id, origin, updated_at, 'description' field FROM entities
  WHERE {_SAYS('description')} AND regexp_matches(trim(description), '[.!?。！？]["''”’»)\\]」』]*$')
    AND NOT regexp_matches(trim(description), '(\\.\\.|…)["''”’»)\\]」』]*$')
  UNION ALL SELECT DISTINCT id, record_id, origin, updated_at, 'aliases' FROM entities, unnest(aliases) AS u(a) WHERE {_SAYS('u.a')}
  UNION ALL SELECT id, record_id, origin, updated_at, 'properties.' || u.p.key FROM entities, unnest(map_entries(properties)) AS u(p) WHERE {_SAYS('u.p.value')}),
dup AS (SELECT id FROM entities WHERE id IS NOT NULL GROUP BY id HAVING count(DISTINCT record_id) > 1),
ranked AS (
  SELECT id, field, record_id, row_number() OVER (PARTITION BY id, field ORDER BY coalesce(trust, 0) DESC, updated_at DESC NULLS LAST, record_id) rn
  FROM vals LEFT JOIN origins USING (origin) WHERE id IN (SELECT id FROM dup))
SELECT id, field, record_id FROM ranked WHERE rn = 1
"""


@query("p6_found", _P6_SQL)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = survivors.surviving_fields(read_table(spark, sf_dir, "entities"), read_table(spark, sf_dir, "origins"))
    return v.select("id", "field", "record_id")


@query("p6_survivors")
def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.surviving_records(read_table(spark, sf_dir, "entities"), read_table(spark, sf_dir, "origins"))


@query("p6_layers")
def p6_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From which dominance layer values come."""
    v = survivors.surviving_fields(read_table(spark, sf_dir, "entities"), read_table(spark, sf_dir, "origins"))
    return v.groupBy("field", "layer").agg(F.count(F.lit(1)).alias("values"))


# 7: encoding


@query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("p7_round_trip")
def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = tokenizer.round_trip(read_table(spark, sf_dir, "documents").select("lang", "text"))
    return same.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.count_if("same").alias("same"))


# 8: mixing


@query("p8_mix")
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


@query("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_shares(p8_mix(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


# 5: defective pairs


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.find_defects(read_table(spark, sf_dir, "candidates"), "candidate_id", "query_abstract", "answer")


# 9: subject areas


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (read_table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas"))
    return subjects.assign_subjects(*tables).select("doc_id", "subject_area")


@query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "documents").agg(F.count_distinct("doc_id")).first()[0]
    return subjects.subject_shares(p9_found(spark, sf_dir), n)


# 2: noise of scanned pages


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_noise(read_table(spark, sf_dir, "articles"), read_table(spark, sf_dir, "source_docs"))


@query("p2_repaired")
def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(read_table(spark, sf_dir, "articles"), read_table(spark, sf_dir, "source_docs"))


# 4: variant spellings of names


def _name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.name_groups(read_table(spark, sf_dir, "entities"))


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.linked_pairs(_name_groups(spark, sf_dir))


@query("p4_groups")
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_groups(spark, sf_dir).groupBy("id").agg(F.min("cluster").alias("cluster"))
