"""Queries of communities, roll-ups, statistics of the extraction and context texts."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import hierarchy as H
from loomgraph.operators import refine as M
from loomgraph.operators import retrieval as R
from loomgraph.plans.graph_queries import CENTERS_SQL, LINKS_SQL, centers
from loomgraph.plans.registry import query
from loomgraph.plans.retrieval_queries import _BM25_SQL, _asked, _bm25
from loomgraph.session import read_table
from loomgraph.sources.tables import EDGES_SQL, GRAPH_SQL, edges, nodes, sections

_REACH = LINKS_SQL + ", reach AS (SELECT node, node seen FROM links UNION SELECT r.node, l.other FROM reach r JOIN links l ON l.node = r.seen), comp AS (SELECT node, min(seen) component FROM reach GROUP BY 1)"


@query("community_cards", GRAPH_SQL + _REACH + """, s AS (SELECT component, count(*) members FROM comp GROUP BY 1 HAVING count(*) >= 2),
  i AS (SELECT component, count(*) n FROM edges JOIN comp ON node = src WHERE src <> dst GROUP BY 1), t AS (SELECT component, count(DISTINCT u.t) n FROM comp JOIN nodes ON id = node, unnest(types) AS u(t) GROUP BY 1)
  SELECT 'com_' || substr(md5(s.component), 1, 12) community, s.members, coalesce(t.n, 0) types, coalesce(i.n, 0) internal_edges FROM s LEFT JOIN i USING (component) LEFT JOIN t USING (component)""")
def community_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.community_cards(edges(spark, sf_dir), nodes(spark, sf_dir))


@query("extraction_stats", f"""WITH {EDGES_SQL}, e AS (SELECT list_filter(coalesce(entity_type, []), lambda t: trim(t) <> '' AND t <> 'Entity') ts, scope_level FROM entities)
  SELECT 'type' AS what, CASE {' '.join(f"WHEN list_contains(ts, '{t}') THEN '{t}'" for t in M.TYPE_ORDER)} ELSE coalesce(list_min(ts), 'Concept') END AS key, count(*) n FROM e GROUP BY 1, 2
  UNION ALL SELECT 'scope', coalesce(nullif(lower(trim(scope_level)), ''), 'none'), count(*) FROM entities GROUP BY 1, 2 UNION ALL SELECT 'predicate', predicate, count(*) FROM edges GROUP BY 1, 2""")
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by type and scope, relations by predicate."""
    e = read_table(spark, sf_dir, "entities")
    scope = F.lower(F.trim("scope_level"))
    kinds = e.select(F.explode(F.array(
        F.struct(F.lit("type").alias("what"), M.primary_type(F.coalesce("entity_type", F.array().cast("array<string>"))).alias("key")),
        F.struct(F.lit("scope").alias("what"), F.when(scope != "", scope).otherwise("none").alias("key")),
    )).alias("k")).select("k.what", "k.key")
    rel = edges(spark, sf_dir).select(F.lit("predicate").alias("what"), F.col("predicate").alias("key"))
    return kinds.unionByName(rel).groupBy("what", "key").agg(F.count(F.lit(1)).alias("n"))


_ROLL = """, story AS (SELECT raw_id id, count(*)::DOUBLE score FROM sections WHERE raw_id IS NOT NULL GROUP BY 1),
  sec AS (SELECT s.id, max(t.score * 0.95::DOUBLE) score FROM sections s JOIN story t ON t.id = s.raw_id GROUP BY 1),
  placed AS (SELECT id, u.document FROM nodes, unnest(source_documents) AS u(document)), ent AS (SELECT p.id, max(s.score * 0.8::DOUBLE) score FROM placed p JOIN sec s ON s.id = p.document GROUP BY 1)"""


@query("score_roll_down", GRAPH_SQL + _ROLL + " SELECT id, round(score, 6) score FROM ent")
def score_roll_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of stories handed down to sections (.95) and on to entities (.8)."""
    s = sections(spark, sf_dir).where("raw_id is not null")
    story = s.groupBy(F.col("raw_id").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    sec = H.rolled_down(story, s.select(F.col("raw_id").alias("parent"), F.col("id").alias("child")), 0.95)
    placed = nodes(spark, sf_dir).select(F.col("id").alias("child"), F.explode("source_documents").alias("parent"))
    return H.rolled_down(sec, placed, 0.8).withColumn("score", F.round("score", 6))


@query("story_members", GRAPH_SQL + ", placed AS (SELECT id, u.document FROM nodes, unnest(source_documents) AS u(document)) SELECT s.raw_id story, count(DISTINCT s.id) sections, count(DISTINCT p.id) entities, string_agg(DISTINCT p.id, '|' ORDER BY p.id) members FROM sections s JOIN placed p ON p.document = s.id WHERE s.raw_id IS NOT NULL GROUP BY 1")
def story_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = nodes(spark, sf_dir).select(F.col("id").alias("entity"), F.explode("source_documents").alias("id"))
    rows = sections(spark, sf_dir).where("raw_id is not null").select("id", F.col("raw_id").alias("story")).join(placed, "id")
    return rows.groupBy("story").agg(F.count_distinct("id").alias("sections"), F.count_distinct("entity").alias("entities"), F.array_join(F.array_sort(F.collect_set("entity")), "|").alias("members"))


@query("property_context", CENTERS_SQL + """, d AS (SELECT src node, id, description FROM edges WHERE description IS NOT NULL UNION ALL SELECT dst, id, description FROM edges WHERE description IS NOT NULL AND dst <> src)
  SELECT c.center, md5(coalesce(any_value(n.description), '') || chr(10) || coalesce(string_agg(d.description, chr(10) ORDER BY d.id, d.description), '')) context_key, count(d.id) descriptions FROM centers c JOIN nodes n ON n.id = c.center LEFT JOIN d ON d.node = c.center GROUP BY 1""")
def property_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A centre's own description and those of its edges, as one text (its digest)."""
    e = edges(spark, sf_dir).where("description is not null").select("id", "src", "dst", "description")
    d = e.select(F.col("src").alias("center"), "id", "description").unionByName(e.where("dst <> src").select(F.col("dst").alias("center"), "id", "description"))
    c = centers(spark, sf_dir).join(nodes(spark, sf_dir).select(F.col("id").alias("center"), F.col("description").alias("own")), "center")
    rows = c.join(d, "center", "left").groupBy("center", "own").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "description")))).alias("x"))
    text = F.concat(F.coalesce("own", F.lit("")), F.lit("\n"), F.array_join(F.transform("x", lambda v: v["description"]), "\n"))
    return rows.select("center", F.md5(text).alias("context_key"), F.size("x").cast("bigint").alias("descriptions"))


@query("relevance_filter", _BM25_SQL + """, n AS (SELECT query_id, count(*)::DOUBLE asked FROM terms GROUP BY 1), r AS (SELECT b.query_id, b.id, b.terms / n.asked p, round(b.score, 9) score FROM bm_ranked b JOIN n USING (query_id) WHERE b.rank <= 20),
  m AS (SELECT *, round(0.55::DOUBLE * p + 0.45::DOUBLE * score, 6) final, max(p) OVER (PARTITION BY query_id) top_p FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) AS rank FROM m)
  SELECT query_id, id, round(p, 6) p, final, rank FROM k WHERE p >= 0.9 OR (top_p < 0.9 AND rank = 1)""")
def relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that meet nearly all of the query, or else its best one."""
    rows = _bm25(spark, sf_dir, 20).drop("rank")
    out = H.relevant_or_best(rows, "query_id", F.col("terms") / F.col("asked"), F.col("score"), 0.9)
    return out.select("query_id", "id", F.round("p", 6).alias("p"), "final", "rank")


@query("section_budget", "WITH c AS (SELECT DISTINCT id, source_doc_id d, try_cast(metadata['chunk_index'] AS BIGINT) i, content FROM chunks WHERE source_doc_id IS NOT NULL AND content IS NOT NULL), u AS (SELECT *, sum(length(content)) OVER (PARTITION BY d ORDER BY i NULLS FIRST, id ROWS UNBOUNDED PRECEDING)::BIGINT used FROM c) SELECT d AS document, id, used FROM u WHERE used <= 2000")
def section_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a document, in order, that fit into 2,000 characters."""
    c = read_table(spark, sf_dir, "chunks").where("source_doc_id is not null and content is not null").selectExpr("id", "source_doc_id document", "try_cast(metadata['chunk_index'] as bigint) i", "content").distinct()
    return H.within_budget(c, "document", ["i", "id"], "content", 2000).select("document", "id", "used")


@query("ego_networks", CENTERS_SQL + ", b AS (SELECT src node, dst other, predicate FROM edges UNION ALL SELECT dst, src, predicate FROM edges) SELECT c.center, count(*) edges, count(DISTINCT b.other) neighbours, string_agg(DISTINCT b.predicate, '|' ORDER BY b.predicate) predicates FROM centers c JOIN b ON b.node = c.center GROUP BY 1")
def ego_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = centers(spark, sf_dir).join(G.either_way(edges(spark, sf_dir)).withColumnRenamed("node", "center"), "center")
    return links.groupBy("center").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("other").alias("neighbours"), F.array_join(F.array_sort(F.collect_set("predicate")), "|").alias("predicates"))


@query("dag_edges_kept", GRAPH_SQL + " SELECT id, src, dst, confidence FROM edges WHERE confidence >= 0.7 AND predicate IN ('initiates', 'performs', 'undergoes') AND src <> dst")
def dag_edges_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.col("predicate").isin("initiates", "performs", "undergoes") & (F.col("confidence") >= 0.7) & (F.col("src") != F.col("dst"))
    return edges(spark, sf_dir).where(kept).select("id", "src", "dst", "confidence")


@query("episode_context", GRAPH_SQL + """, ev AS (SELECT id FROM nodes WHERE list_contains(types, 'Event')), b AS (SELECT src node, dst other FROM edges UNION SELECT dst, src FROM edges)
  SELECT ev.id, u.type, string_agg(DISTINCT n.id, '|' ORDER BY n.id) context FROM ev JOIN b ON b.node = ev.id JOIN nodes n ON n.id = b.other, unnest(n.types) AS u(type) WHERE u.type IN ('Character', 'Location', 'TimePoint', 'Occasion') AND n.id <> ev.id GROUP BY 1, 2""")
def episode_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters, places, times and occasions next to each event."""
    n = nodes(spark, sf_dir)
    events = G.with_label(n, ["Event"]).select("id")
    near = events.join(G.either_way(edges(spark, sf_dir)).select(F.col("node").alias("id"), "other").distinct(), "id").where("id <> other")
    typed = n.select(F.col("id").alias("other"), F.explode("types").alias("type")).where(F.col("type").isin("Character", "Location", "TimePoint", "Occasion"))
    return near.join(typed, "other").groupBy("id", "type").agg(F.array_join(F.array_sort(F.collect_set("other")), "|").alias("context"))


@query("embedding_texts", GRAPH_SQL + " SELECT id, md5(concat_ws('. ', name, description, nullif(array_to_string(types, ', '), ''))) text_key FROM nodes")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text a node would be embedded by (its digest)."""
    return nodes(spark, sf_dir).select("id", F.md5(F.concat_ws(". ", "name", "description", F.array_join("types", ", "))).alias("text_key"))


@query("vectors_by_ids", "WITH w(id, pos) AS (SELECT unnest([7, 3, 7, 100000000, 0]::BIGINT[]), generate_subscripts([7, 3, 7, 100000000, 0]::BIGINT[], 1)) SELECT id, (min(pos) - 1)::BIGINT AS pos, any_value(label) AS label FROM w JOIN embeddings ON vec_id = id GROUP BY 1")
def vectors_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a list of ids, each once, at the place it was first asked for."""
    ids = [7, 3, 7, 100_000_000, 0]
    asked = spark.createDataFrame([(i, p) for p, i in enumerate(ids)], "id bigint, pos bigint").groupBy("id").agg(F.min("pos").alias("pos"))
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return e.join(F.broadcast(asked), "id").select("id", "pos", "label")


@query("collection_stats", "SELECT count(*) vectors, count(DISTINCT label) labels, min(len(embedding))::BIGINT least_length, max(len(embedding))::BIGINT most_length FROM embeddings WHERE vec_id IS NOT NULL")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings").where("vec_id is not null")
    return e.agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("label").alias("labels"), F.min(F.size("embedding")).cast("bigint").alias("least_length"), F.max(F.size("embedding")).cast("bigint").alias("most_length"))


@query("dataset_scan", "WITH a AS (SELECT DISTINCT id, title, content FROM articles WHERE content IS NOT NULL), s AS (SELECT metadata['raw_doc_id'] id, count(DISTINCT id) segments FROM source_docs GROUP BY 1) SELECT a.id, len(regexp_extract_all(a.content, '[A-Za-z0-9]+'))::BIGINT words, s.segments FROM a JOIN s ON s.id = a.id")
def dataset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that have segments, with their words and the number of segments."""
    a = read_table(spark, sf_dir, "articles").where("content is not null").select("id", "title", "content").distinct()
    s = read_table(spark, sf_dir, "source_docs").groupBy(F.col("metadata")["raw_doc_id"].alias("id")).agg(F.count_distinct("id").alias("segments"))
    return a.join(s, "id").select("id", F.regexp_count("content", F.lit("[A-Za-z0-9]+")).cast("bigint").alias("words"), "segments")


@query("interactions_by_document", "SELECT DISTINCT id, base_document, lower(trim(predicate)) predicate FROM relations WHERE base_document IN (SELECT id FROM (SELECT DISTINCT id FROM articles ORDER BY id LIMIT 20)) AND lower(trim(predicate)) = 'knows'")
def interactions_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of one kind in a list of documents (the first twenty by id)."""
    asked = read_table(spark, sf_dir, "articles").select("id").distinct().orderBy("id").limit(20).withColumnRenamed("id", "base_document")
    r = read_table(spark, sf_dir, "relations").select("id", "base_document", F.lower(F.trim("predicate")).alias("predicate")).where("predicate = 'knows'")
    return r.join(F.broadcast(asked), "base_document", "left_semi").distinct()


@query("part_entities", GRAPH_SQL + ", placed AS (SELECT id, u.document FROM nodes, unnest(source_documents) AS u(document)) SELECT document, count(*) entities, min(id) first_id FROM placed GROUP BY 1")
def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = nodes(spark, sf_dir).select("id", F.explode("source_documents").alias("document"))
    return placed.groupBy("document").agg(F.count(F.lit(1)).alias("entities"), F.min("id").alias("first_id"))


@query("answer_choices", "SELECT DISTINCT candidate_id, regexp_extract(trim(answer), '^\\(?([A-D])\\)', 1) AS choice FROM candidates WHERE regexp_matches(trim(answer), '^\\(?[A-D]\\)')")
def answer_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "candidates").withColumn("a", F.trim("answer")).where(F.col("a").rlike(r"^\(?[A-D]\)"))
    return c.select("candidate_id", F.regexp_extract("a", r"^\(?([A-D])\)", 1).alias("choice")).distinct()


@query("option_order", """WITH q AS (SELECT DISTINCT query_abstract q FROM candidates WHERE regexp_matches(query_abstract, '\\(A\\).*\\(B\\)')), o AS (SELECT q, unnest(regexp_extract_all(q, '\\(([A-D])\\)\\s*([^(]+)', 1)) AS label, trim(unnest(regexp_extract_all(q, '\\(([A-D])\\)\\s*([^(]+)', 2))) AS option FROM q),
  s AS (SELECT o.q, o.label, o.option, count(c.answer) support FROM o LEFT JOIN (SELECT DISTINCT candidate_id, query_abstract, lower(answer) answer FROM candidates) c ON c.query_abstract = o.q AND contains(c.answer, lower(o.option)) GROUP BY 1, 2, 3)
  SELECT q AS question, label, option, support, row_number() OVER (PARTITION BY q ORDER BY support DESC, label) AS rank FROM s""")
def option_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of a question by the number of answers that name them."""
    from loomgraph.functions.text import choices, is_choice_question

    c = read_table(spark, sf_dir, "candidates").where(is_choice_question(F.col("query_abstract")))
    o = c.select(F.col("query_abstract").alias("question")).distinct().select("question", F.explode(choices(F.col("question"))).alias("c")).select("question", "c.label", "c.option")
    a = c.select("candidate_id", F.col("query_abstract").alias("question"), F.lower("answer").alias("answer")).distinct()
    met = o.join(a, "question").where(F.contains("answer", F.lower("option"))).groupBy("question", "label").agg(F.count(F.lit(1)).alias("support"))
    rows = o.join(met, ["question", "label"], "left").withColumn("support", F.coalesce("support", F.lit(0).cast("bigint")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("support"), "label")).cast("bigint"))


@query("metadata_without_chunk_keys", "SELECT DISTINCT id, array_to_string(list_sort(list_filter(map_keys(metadata), lambda k: k NOT IN ('chunk_index', 'total_doc_chunks'))), '|') AS keys FROM chunks WHERE metadata IS NOT NULL")
def metadata_without_chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.map_filter("metadata", lambda k, v: ~k.isin("chunk_index", "total_doc_chunks"))
    return read_table(spark, sf_dir, "chunks").where("metadata is not null").select("id", F.array_join(F.array_sort(F.map_keys(kept)), "|").alias("keys")).distinct()


@query("chapter_numbers", "SELECT DISTINCT id, try_cast(regexp_extract(id, '_seg_(\\d+)$', 1) AS BIGINT) segment FROM source_docs")
def chapter_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment's number out of its id, null for whole stories."""
    n = F.regexp_extract("id", r"_seg_(\d+)$", 1)
    return read_table(spark, sf_dir, "source_docs").select("id", F.when(n != "", n.cast("bigint")).alias("segment")).distinct()


@query("micro_batches", "SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 100 AS batch, event_type FROM events")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return read_table(spark, sf_dir, "events").select("event_id", F.floor((F.row_number().over(w) - 1) / 100).alias("batch"), "event_type")
