"""Queries of text functions, documents, chunks and parts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import chunking as K
from loomgraph.plans.registry import query
from loomgraph.session import read_table

_HAN = "[\\x{4e00}-\\x{9fff}]"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


@query("text_lengths", f"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::BIGINT latin, len(regexp_extract_all(text, '{_HAN}'))::BIGINT han,
  greatest(len(regexp_extract_all(text, '[A-Za-z0-9]+')), len(regexp_extract_all(text, '{_HAN}')))::BIGINT words,
  CASE WHEN len(regexp_extract_all(text, '{_HAN}')) > len(regexp_extract_all(text, '[A-Za-z]')) THEN 'zh' ELSE 'en' END lang FROM documents WHERE text IS NOT NULL""")
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", T.latin_words(c).alias("latin"), T.cjk_chars(c).alias("han"), T.word_length(c).alias("words"), T.language(c).alias("lang"))


@query("token_counts", f"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+|{_HAN}'))::BIGINT tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+|{_HAN}')))::BIGINT distinct_tokens, len(regexp_extract_all(text, '[A-Za-z0-9_-]+|{_HAN}'))::BIGINT mixed FROM documents WHERE text IS NOT NULL")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", F.size(t).cast("bigint").alias("tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("distinct_tokens"), F.size(T.mixed_tokens(F.col("text"))).cast("bigint").alias("mixed"))


@query("title_keywords", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(title), '[a-z]{3,}'))), '|') keywords FROM documents WHERE title IS NOT NULL")
def title_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("title is not null").select("doc_id", F.array_join(F.array_sort(T.keywords(F.col("title"))), "|").alias("keywords"))


@query("vocabulary", f"SELECT term, count(*) documents FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+|{_HAN}'))) term FROM documents) GROUP BY 1")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


@query("sentence_counts", "SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))::BIGINT sentences FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("sentences"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_STEM = "CASE WHEN suffix(w, 'ing') AND length(w) > 5 THEN left(w, length(w) - 3) WHEN suffix(w, 'ed') AND length(w) > 4 THEN left(w, length(w) - 2) WHEN suffix(w, 'es') AND length(w) > 4 THEN left(w, length(w) - 2) WHEN suffix(w, 's') AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END"
_GROUND = f"list_distinct(list_transform(list_filter(regexp_extract_all(lower(COLUMN), '[a-z0-9_]+|{_HAN}'), lambda w: w NOT IN ({_STOP})), lambda w: {_STEM}))"


@query("answer_grounding", f"""WITH c AS (SELECT DISTINCT candidate_id, {_GROUND.replace('COLUMN', 'query_abstract')} q, {_GROUND.replace('COLUMN', 'answer')} a FROM candidates WHERE query_abstract IS NOT NULL AND answer IS NOT NULL)
  SELECT candidate_id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, a)) / len(q)::DOUBLE ELSE 0 END, 6) ratio,
    round(CASE WHEN len(list_distinct(list_concat(q, a))) > 0 THEN len(list_intersect(q, a)) / len(list_distinct(list_concat(q, a)))::DOUBLE ELSE 0 END, 6) jaccard FROM c""")
def answer_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a question's words its answer has."""
    c = read_table(spark, sf_dir, "candidates").where("query_abstract is not null and answer is not null")
    rows = c.select("candidate_id", T.grounding_tokens(F.col("query_abstract")).alias("q"), T.grounding_tokens(F.col("answer")).alias("a")).distinct()
    return rows.select("candidate_id", F.round(T.overlap_ratio(F.col("q"), F.col("a")), 6).alias("ratio"), F.round(T.jaccard(F.col("q"), F.col("a")), 6).alias("jaccard"))


@query("query_abstraction", """SELECT DISTINCT candidate_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer, 'https?://\\S+', '[URL]', 'g'), '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\\.[A-Za-z.]+', '[EMAIL]', 'g'), '[0-9]{1,2}:[0-9]{2}', '[TIME]', 'g'), '[0-9]+', '[NUMBER]', 'g') abstract
  FROM candidates WHERE answer IS NOT NULL""")
def query_abstraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "candidates").where("answer is not null").select("candidate_id", T.abstracted(F.col("answer")).alias("abstract")).distinct()


_W = "lower(regexp_extract(query_abstract, '^\\s*([A-Za-z]+)', 1))"


@query("query_classification", f"""SELECT kind, count(*) candidates, count(DISTINCT query_abstract) queries FROM (SELECT query_abstract, CASE WHEN regexp_matches(query_abstract, '\\(A\\).*\\(B\\)') THEN 'choice' WHEN {_W} = 'who' THEN 'person' WHEN {_W} = 'where' THEN 'place'
  WHEN {_W} = 'when' THEN 'time' WHEN {_W} = 'why' THEN 'cause' WHEN {_W} IN ('how', 'explain', 'describe') THEN 'process' WHEN {_W} IN ('compare', 'list', 'summarise') THEN {_W} WHEN {_W} = 'what' THEN 'event' ELSE 'other' END kind
  FROM candidates WHERE query_abstract IS NOT NULL) GROUP BY 1""")
def query_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "candidates").where("query_abstract is not null").select("query_abstract", T.question_kind(F.col("query_abstract")).alias("kind"))
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("query_abstract").alias("queries"))


@query("mcq_choices", """WITH q AS (SELECT DISTINCT query_abstract q FROM candidates WHERE regexp_matches(query_abstract, '\\(A\\).*\\(B\\)'))
  SELECT q AS question, unnest(regexp_extract_all(q, '\\(([A-D])\\)\\s*([^(]+)', 1)) AS label, trim(unnest(regexp_extract_all(q, '\\(([A-D])\\)\\s*([^(]+)', 2))) AS option FROM q""")
def mcq_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read_table(spark, sf_dir, "candidates").where(T.is_choice_question(F.col("query_abstract"))).select(F.col("query_abstract").alias("question")).distinct()
    return q.select("question", F.explode(T.choices(F.col("question"))).alias("c")).select("question", "c.label", "c.option")


@query("name_variants", """WITH n AS (SELECT DISTINCT lower(trim(id)) id, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) x, trim(regexp_replace(regexp_replace(lower(u.a), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) y FROM entities, unnest(aliases) AS u(a) WHERE trim(id) <> '')
  SELECT id, x AS name_form, y AS alias_form, CASE WHEN x = y THEN 1.0::DOUBLE WHEN starts_with(x, y) OR starts_with(y, x) THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END score FROM n WHERE x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x))""")
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and aliases of one id by how far one is the other's beginning or part."""
    e = read_table(spark, sf_dir, "entities").select(F.lower(F.trim("id")).alias("id"), "name", F.explode("aliases").alias("a")).where("id <> ''")
    rows = e.select("id", T.surface(F.col("name")).alias("name_form"), T.surface(F.col("a")).alias("alias_form"), T.variant_score(F.col("name"), F.col("a")).alias("score"))
    return rows.where("score > 0").distinct()


@query("event_properties", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) k FROM events WHERE json_valid(props)")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties held as JSON; rows that are no JSON are left out."""
    return read_table(spark, sf_dir, "events").where(F.expr("try_parse_json(props) is not null")).select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"))


@query("documents_normalised", """WITH r AS (SELECT DISTINCT coalesce(nullif(trim(id), ''), substr(sha1(content), 1, 16)) doc_id, substr(sha1(content), 1, 16) content_key, nullif(trim(title), '') title, nullif(trim(subtitle), '') subtitle FROM articles WHERE trim(content) <> '')
  SELECT doc_id, regexp_replace(doc_id, '_seg_\\d+$', '') raw_doc_id, content_key, title, subtitle FROM r""")
def documents_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.normalised_documents(read_table(spark, sf_dir, "articles")).select("doc_id", "raw_doc_id", "content_key", "title", "subtitle")


@query("fixed_chunks", """WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), '^ | $', '', 'g') t FROM documents), g AS (SELECT *, ceil(length(t) / 600.0)::BIGINT total FROM f WHERE t <> '')
  SELECT doc_id, i AS chunk_index, md5(substr(t, (i * 600 + 1)::BIGINT, 600)) content_key, total FROM g, range(0, 1000) r(i) WHERE i < total""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = K.fixed_chunks(_documents(spark, sf_dir), 600)
    return c.select("doc_id", "chunk_index", F.md5("content").alias("content_key"), "total")


_PARTS_SQL = """WITH c AS (SELECT DISTINCT id, source_doc_id AS document, try_cast(metadata['chunk_index'] AS BIGINT) i FROM chunks WHERE source_doc_id IS NOT NULL),
  o AS (SELECT id, document, row_number() OVER (PARTITION BY document ORDER BY i NULLS FIRST, id) AS position, count(*) OVER (PARTITION BY document) total FROM c)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "chunks").where("source_doc_id is not null").selectExpr("id", "source_doc_id document", "try_cast(metadata['chunk_index'] as bigint) i").distinct()


@query("chunk_parts", _PARTS_SQL + " SELECT id, document, position, total, CASE WHEN total <= 2 THEN 1 WHEN total % 2 = 1 THEN CASE WHEN position = 1 THEN 1 ELSE position // 2 + 1 END ELSE (position + 1) // 2 END::BIGINT part FROM o")
def chunk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.parts(_chunks(spark, sf_dir))


@query("document_texts", "WITH c AS (SELECT DISTINCT id, source_doc_id d, try_cast(metadata['chunk_index'] AS BIGINT) i, content FROM chunks WHERE source_doc_id IS NOT NULL AND content IS NOT NULL) SELECT d AS document, count(*) chunks, md5(string_agg(content, ' ' ORDER BY i NULLS FIRST, id)) text_key FROM c GROUP BY 1")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's chunks put together again in order."""
    c = read_table(spark, sf_dir, "chunks").where("source_doc_id is not null and content is not null").selectExpr("id", "source_doc_id document", "try_cast(metadata['chunk_index'] as bigint) i", "content").distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "id", "content"))), lambda x: x["content"]), " ")
    return c.groupBy("document").agg(F.count(F.lit(1)).alias("chunks"), F.md5(text).alias("text_key"))


@query("title_index", "SELECT trim(metadata['title']) title, count(DISTINCT id) documents, string_agg(DISTINCT id, '|' ORDER BY id) ids FROM source_docs WHERE trim(metadata['title']) <> '' GROUP BY 1")
def title_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "source_docs").select(F.trim(F.col("metadata")["title"]).alias("title"), "id").where("title <> ''")
    return d.groupBy("title").agg(F.count_distinct("id").alias("documents"), F.array_join(F.array_sort(F.collect_set("id")), "|").alias("ids"))


@query("unique_base_keys", "SELECT record_id, CASE WHEN n > 1 THEN k || '_dup_' || (n - 1) ELSE k END AS unique_key FROM (SELECT record_id, k, row_number() OVER (PARTITION BY k ORDER BY record_id) n FROM (SELECT record_id, lower(trim(name)) k FROM entities WHERE trim(name) <> ''))")
def unique_base_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys made unique by a suffix, in order of arrival."""
    from pyspark.sql import Window

    e = read_table(spark, sf_dir, "entities").select("record_id", F.lower(F.trim("name")).alias("k")).where("k <> ''")
    n = F.row_number().over(Window.partitionBy("k").orderBy("record_id"))
    return e.withColumn("n", n).select("record_id", F.when(F.col("n") > 1, F.concat("k", F.lit("_dup_"), (F.col("n") - 1).cast("string"))).otherwise(F.col("k")).alias("unique_key"))
