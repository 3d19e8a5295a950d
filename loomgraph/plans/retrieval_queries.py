"""Retrieval queries: the titles of documents whose id is divisible by 100 against all documents, every hundredth vector against all vectors."""

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import sentences
from loomgraph.functions.vectors import cosine
from loomgraph.operators import retrieval as R
from loomgraph.plans.registry import query
from loomgraph.session import read_table
from loomgraph.sources.tables import GRAPH_SQL, nodes

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+|[\\x{4e00}-\\x{9fff}]')"
_BM25_SQL = f"""WITH asked AS (SELECT doc_id query_id, title AS text FROM documents WHERE doc_id % 100 = 0),
  terms AS (SELECT DISTINCT query_id, unnest({_TOK}) term FROM asked),
  toks AS (SELECT doc_id id, {_TOK} t FROM documents WHERE len({_TOK}) > 0),
  sizes AS (SELECT count(*)::DOUBLE n, avg(len(t)) mean_length FROM toks),
  d AS (SELECT term, count(*)::DOUBLE df FROM (SELECT unnest(list_distinct(t)) term FROM toks) GROUP BY 1),
  raw AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) raw FROM d, sizes),
  idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END idf FROM raw WHERE term IN (SELECT term FROM terms)),
  counts AS (SELECT id, len, term, count(*)::DOUBLE tf FROM (SELECT id, len(t) len, unnest(t) term FROM toks) WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2, 3),
  bm AS (SELECT query_id, id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_length))) score, count(*) terms
    FROM counts JOIN idf USING (term) JOIN terms USING (term), sizes GROUP BY 1, 2),
  bm_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return R.bm25(_asked(spark, sf_dir), _docs(spark, sf_dir), k)


@query("bm25_topk", _BM25_SQL + " SELECT query_id, id, round(score, 6) score, rank FROM bm_ranked WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 10).select("query_id", "id", F.round("whole", 6).alias("score"), "rank")


@query("bm25_candidates", _BM25_SQL.replace("FROM documents WHERE len(", "FROM documents WHERE lower(source) = 'novel' AND len(") + " SELECT query_id, id, round(score, 6) score, rank FROM bm_ranked WHERE rank <= 10")
def bm25_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted to candidates, with the statistics of these."""
    docs = read_table(spark, sf_dir, "documents").where("lower(source) = 'novel'").select(F.col("doc_id").alias("id"), "text")
    return R.bm25(_asked(spark, sf_dir), docs, 10).select("query_id", "id", F.round("whole", 6).alias("score"), "rank")


_SENT_SQL = f""", sent AS (SELECT id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS text, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) pos FROM (SELECT doc_id id, text FROM documents)),
  sent_terms AS (SELECT id, pos, unnest(list_distinct({_TOK})) term FROM sent),
  hits AS (SELECT query_id, id, max(n)::DOUBLE score FROM (SELECT query_id, id, pos, count(*) n FROM sent_terms JOIN terms USING (term) GROUP BY 1, 2, 3) GROUP BY 1, 2),
  hits_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hits)"""
_VEC_SQL = """, vq AS (SELECT vec_id query_id, embedding e FROM embeddings WHERE vec_id % 100 = 0),
  vec AS (SELECT query_id, vec_id id, list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) score FROM vq, embeddings),
  vec_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vec)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read_table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), e


@query("sentence_topk", _BM25_SQL + _SENT_SQL + " SELECT query_id, id, score, rank FROM hits_ranked WHERE rank <= 10")
def sentence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sentence_hits(_asked(spark, sf_dir), _docs(spark, sf_dir), 10).select("query_id", "id", "score", "rank")


@query("vector_cosine_topk", "WITH " + _VEC_SQL[1:] + " SELECT query_id, id, round(score, 6) score, rank FROM vec_ranked WHERE rank <= 10")
def vector_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_top_k(*_vectors(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query("vector_l2_topk", """WITH vq AS (SELECT vec_id query_id, embedding e FROM embeddings WHERE vec_id % 100 = 0),
  v AS (SELECT query_id, vec_id id, 1 - pow(list_distance(e::DOUBLE[], embedding::DOUBLE[]), 2) score FROM vq, embeddings)
  SELECT query_id, id, round(score, 6) score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v) WHERE rank <= 10""")
def vector_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_top_k(*_vectors(spark, sf_dir), 10, "l2").withColumn("score", F.round("score", 6))


@query("vector_label_filter_topk", "WITH " + _VEC_SQL[1:].replace("FROM vq, embeddings)", "FROM vq, embeddings WHERE label = 3)") + " SELECT query_id, id, round(score, 6) score, rank FROM vec_ranked WHERE rank <= 10")
def vector_label_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = _vectors(spark, sf_dir)
    return R.vector_top_k(q, e.where("label = 3"), 10).withColumn("score", F.round("score", 6))


_FUSED_SQL = _BM25_SQL + _SENT_SQL + _VEC_SQL + """, votes AS (
  SELECT query_id, id, 1.1::DOUBLE / (60 + rank) w FROM bm_ranked WHERE rank <= 20 UNION ALL SELECT query_id, id, 0.9::DOUBLE / (60 + rank) FROM hits_ranked WHERE rank <= 20
  UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM vec_ranked WHERE rank <= 20),
  fused AS (SELECT query_id, id, sum(w) score, count(*) channels FROM votes GROUP BY 1, 2)
  SELECT query_id, id, round(score, 6) score, channels, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM fused) WHERE rank <= 8"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, docs = _asked(spark, sf_dir), _docs(spark, sf_dir)
    channels = [(_bm25(spark, sf_dir, 20), 1.1), (R.sentence_hits(asked, docs, 20), 0.9), (R.vector_top_k(*_vectors(spark, sf_dir), 20), 1.0)]
    return R.fused(channels, 10**6).withColumn("score", F.round("score", 12))


@query("hybrid_evidence", _FUSED_SQL)
def hybrid_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lexical, sentence and vector channels fused by rank (a document's vector is that of its number)."""
    best = R.top_k(_evidence(spark, sf_dir).drop("rank"), 8)
    return best.select("query_id", "id", F.round("score", 6).alias("score"), "channels", "rank")


@query("hybrid_linear_score", _BM25_SQL + _VEC_SQL + """, n AS (SELECT query_id, count(*)::DOUBLE asked FROM terms GROUP BY 1), top AS (SELECT query_id, max(round(score, 9)) most FROM bm GROUP BY 1),
  lin AS (SELECT b.query_id, b.id, 0.52::DOUBLE * (CASE WHEN t.most > 0 THEN round(b.score, 9) / t.most ELSE 0 END) + 0.13::DOUBLE * b.terms / n.asked + 0.35::DOUBLE * coalesce(v.score, 0) score
    FROM bm b JOIN n USING (query_id) JOIN top t USING (query_id) LEFT JOIN vec v ON v.query_id = b.query_id AND v.id = b.id)
  SELECT query_id, id, round(score, 6) score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM lin) WHERE rank <= 10""")
def hybrid_linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """.52 of the lexical score (over the best), .13 of the terms met, .35 of the cosine."""
    lex = R.lexicon(_asked(spark, sf_dir), _docs(spark, sf_dir))
    best = dict(R.bm25_by_set(lex, 1).select("set", "score").collect())
    most = [best.get(j, 0.0) for j in range(len(lex.asked.sets))]
    q, e = _vectors(spark, sf_dir)
    # only a query with a vector and a document with one have a cosine; else the score is the same for all queries of a set
    seen = e.select("id")
    near, far = (replace(lex, rows=lex.rows.join(seen, "id", how)) for how in ("left_semi", "left_anti"))
    asked = lex.asked.queries
    vectors = q.select("query_id", F.col("embedding").alias("of_query"))
    words = R.bm25_by_set(far, 10, most).join(asked, "set").unionByName(R.bm25_by_set(near, 10, most).join(asked.join(vectors, "query_id", "left_anti"), "set"))
    words = words.select("query_id", "id", "score", "whole")
    met = R.bm25_by_set(near, None).join(asked.join(vectors, "query_id"), "set").join(e.select("id", "embedding"), "id")
    met = met.join(spark.createDataFrame(list(enumerate(most)), "set int, most double"), "set").withColumn("cosine", cosine("of_query", "embedding"))
    score = 0.52 * F.when(F.col("most") > 0, F.col("score") / F.col("most")).otherwise(0.0) + 0.13 * F.col("terms") / F.col("asked") + 0.35 * F.coalesce("cosine", F.lit(0.0))
    rows = words.unionByName(met.select("query_id", "id", F.round(score, 9).alias("score"), score.alias("whole")))
    return R.top_k(rows, 10).select("query_id", "id", F.round("whole", 6).alias("score"), "rank")


_KW = ("william", "guild", "lantern")
_PTS = " + ".join("(CASE WHEN {0} THEN {1} ELSE 0 END)".format(c, p) for c, p in (("lower(name) = k", 10), ("list_contains(al, k)", 9), ("contains(lower(name), k)", 6), ("len(list_filter(al, lambda a: contains(a, k))) > 0", 5), ("contains(lower(name), k)", 3), ("contains(lower(coalesce(description, '')), k)", 2)))


@query("keyword_ranked_search", GRAPH_SQL + f""", ks AS (SELECT unnest({list(_KW)}) k), n AS (SELECT id, name, description, list_transform(aliases, lambda a: lower(a)) al FROM nodes),
  p AS (SELECT id, name, {_PTS} pts FROM n, ks) SELECT id, name, count(*) FILTER (WHERE pts > 0) matched, sum(pts)::BIGINT score FROM p GROUP BY 1, 2 HAVING sum(pts) > 0""")
def keyword_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked_keywords(nodes(spark, sf_dir), list(_KW))


@query("sentence_windows", """WITH s AS (SELECT doc_id, generate_subscripts(p, 1)::BIGINT pos, unnest(p) s FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) p FROM documents)),
  hit AS (SELECT doc_id, pos FROM s WHERE contains(lower(s), 'telescope'))
  SELECT h.doc_id, h.pos, string_agg(s.s, ' ' ORDER BY s.pos) window_text FROM hit h JOIN s ON s.doc_id = h.doc_id AND s.pos BETWEEN h.pos - 1 AND h.pos + 1 GROUP BY 1, 2""")
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with a keyword and their neighbours on either side, cut from the text's own list of sentences."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", sentences(F.col("text")).alias("p"))
    hits = rows.select("doc_id", "p", F.posexplode("p").alias("i", "s")).where(F.contains(F.lower("s"), F.lit("telescope")))
    first = F.greatest(F.col("i"), F.lit(1))
    return hits.select("doc_id", (F.col("i") + 1).cast("bigint").alias("pos"), F.array_join(F.slice("p", first, F.col("i") + 3 - first), " ").alias("window_text"))


@query("sentence_document_score", _BM25_SQL + _SENT_SQL + """, each AS (SELECT query_id, id, pos, count(*) n FROM sent_terms JOIN terms USING (term) GROUP BY 1, 2, 3)
  SELECT query_id, id, round(sum(n) / sqrt(count(*) + 1.0::DOUBLE), 6) score, max(n) best FROM each GROUP BY 1, 2""")
def sentence_document_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document by its sentences: the sum of their hits over the root of their number plus one, and the best."""
    by_set, asked = R.sentence_hits_by_set(_asked(spark, sf_dir), _docs(spark, sf_dir))
    rows = by_set.select("set", "id", F.round(F.col("hits") / F.sqrt(F.col("sentences") + 1.0), 6).alias("score"), F.col("score").cast("bigint").alias("best"))
    return R.to_queries(rows, asked, whole=True).select("query_id", "id", "score", "best")


@query("chunks_by_document_ids", """WITH c AS (SELECT DISTINCT id, source_doc_id, try_cast(metadata['chunk_index'] AS BIGINT) i FROM chunks WHERE source_doc_id IS NOT NULL)
  SELECT source_doc_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_doc_id ORDER BY i, id) AS rank FROM c) WHERE rank <= 3""")
def chunks_by_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three chunks of each source document."""
    c = read_table(spark, sf_dir, "chunks").where("source_doc_id is not null").selectExpr("id", "source_doc_id", "try_cast(metadata['chunk_index'] as bigint) i").distinct()
    w = Window.partitionBy("source_doc_id").orderBy("i", "id")
    return c.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3").select("source_doc_id", "id", "rank")


@query("chunks_by_metadata", "SELECT DISTINCT id, source_doc_id FROM chunks WHERE metadata['doc_type'] = 'novel' AND metadata['chunk_index'] IN ('0', '1')")
def chunks_by_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "chunks")
    return c.where((c["metadata"]["doc_type"] == "novel") & c["metadata"]["chunk_index"].isin("0", "1")).select("id", "source_doc_id").distinct()
