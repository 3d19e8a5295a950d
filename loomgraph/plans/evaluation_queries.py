"""Queries of evaluation aggregates, strategy statistics, event windows and incremental steps.

Attempts are events: the user stands for the question, the kind of event for the
setting, the user's last digit for the article.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import evaluation as V
from loomgraph.plans.registry import query
from loomgraph.session import read_table
from loomgraph.streaming import windows as W

_ATTEMPTS_SQL = "WITH t AS (SELECT event_type setting, user_id % 10 article, user_id question_id, value > 10 is_correct, floor(value * 10)::BIGINT latency_ms FROM events), q AS (SELECT {0}, question_id, count(*) n, count(*) FILTER (WHERE is_correct) ok, sum(latency_ms) ms FROM t GROUP BY ALL)"
_SUMMARY = "sum(n)::BIGINT attempts, sum(ok)::BIGINT correct, count(*) questions, count(*) FILTER (WHERE ok > 0) passed, round(sum(ok) / sum(n), 4) overall_accuracy, round(count(*) FILTER (WHERE ok > 0) / count(*), 4) pass_accuracy, floor(sum(ms) / sum(n))::BIGINT avg_latency_ms"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("setting"), (F.col("user_id") % 10).alias("article"), F.col("user_id").alias("question_id"), (F.col("value") > 10).alias("is_correct"), F.floor(F.col("value") * 10).alias("latency_ms"))


@query("eval_setting_summary", _ATTEMPTS_SQL.format("setting") + f" SELECT setting, {_SUMMARY} FROM q GROUP BY 1")
def eval_setting_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary(attempts(spark, sf_dir), ["setting"])


@query("eval_article_summary", _ATTEMPTS_SQL.format("article, setting") + f" SELECT article, setting, {_SUMMARY} FROM q GROUP BY 1, 2")
def eval_article_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary(attempts(spark, sf_dir), ["article", "setting"])


_SETTINGS = ["click", "error", "purchase", "signup", "view"]


@query("eval_question_pivot", "SELECT user_id question_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{s}' AND value > 10) {s}_correct, coalesce(bool_or(value > 10) FILTER (WHERE event_type = '{s}'), false) {s}_pass" for s in _SETTINGS) + " FROM events GROUP BY 1")
def eval_question_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir)
    cols = []
    for s in _SETTINGS:
        here = F.col("is_correct") & (F.col("setting") == s)
        cols += [F.count_if(here).alias(f"{s}_correct"), F.max(here).alias(f"{s}_pass")]
    return a.groupBy("question_id").agg(*cols)


@query("eval_deltas", _ATTEMPTS_SQL.format("article, setting") + """, s AS (SELECT article, setting, sum(ok) / sum(n) acc FROM q GROUP BY 1, 2)
  SELECT v.article, round(v.acc, 6) base, round(c.acc, 6) other, round(c.acc - v.acc, 6) delta FROM s v JOIN s c ON c.article = v.article WHERE v.setting = 'view' AND c.setting = 'click'""")
def eval_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two settings compared article by article."""
    s = attempts(spark, sf_dir).groupBy("article", "setting").agg((F.count_if("is_correct") / F.count(F.lit(1))).alias("acc"))
    v, c = (s.where(F.col("setting") == k).select("article", F.col("acc").alias(k)) for k in ("view", "click"))
    return v.join(c, "article").select("article", F.round("view", 6).alias("base"), F.round("click", 6).alias("other"), F.round(F.col("click") - F.col("view"), 6).alias("delta"))


_CAND = "WITH c AS (SELECT DISTINCT candidate_id, template_id, pattern_name, similarity, query_abstract, routing_hint, answer, array_to_string(recommended_chain, '>') AS chain, recommended_chain FROM candidates)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "candidates")
    return c.select("candidate_id", "template_id", "pattern_name", "similarity", "query_abstract", "routing_hint", "answer", F.array_join("recommended_chain", ">").alias("chain"), "recommended_chain").distinct()


@query("cluster_statistics", _CAND + " SELECT template_id, pattern_name, count(*) support, round(avg(similarity), 6) mean_similarity, count(DISTINCT chain) chains FROM c WHERE template_id IS NOT NULL GROUP BY 1, 2")
def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir).where("template_id is not null")
    return c.groupBy("template_id", "pattern_name").agg(F.count(F.lit(1)).alias("support"), F.round(F.avg("similarity"), 6).alias("mean_similarity"), F.count_distinct("chain").alias("chains"))


@query("chain_variants", _CAND + """, w AS (SELECT template_id, chain, sum(similarity) weight, sum(similarity * len(recommended_chain)) wl FROM c WHERE template_id IS NOT NULL AND similarity IS NOT NULL AND chain <> '' GROUP BY 1, 2)
  SELECT template_id, chain, round(weight, 6) weight, round(CASE WHEN weight > 0 THEN wl / weight END, 6) mean_steps, row_number() OVER (PARTITION BY template_id ORDER BY round(weight, 6) DESC, chain) AS rank FROM w""")
def chain_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of a template by weight, the representative first."""
    from pyspark.sql import Window

    c = _candidates(spark, sf_dir).where("template_id is not null and similarity is not null and chain <> ''")
    w = c.groupBy("template_id", "chain").agg(F.sum("similarity").alias("weight"), F.sum(F.col("similarity") * F.size("recommended_chain")).alias("wl"))
    rank = F.row_number().over(Window.partitionBy("template_id").orderBy(F.desc(F.round("weight", 6)), "chain")).cast("bigint")
    return w.select("template_id", "chain", F.round("weight", 6).alias("weight"), F.round(F.when(F.col("weight") > 0, F.col("wl") / F.col("weight")), 6).alias("mean_steps"), rank.alias("rank"))


@query("tool_description_vote", _CAND + """, v AS (SELECT u.tool, routing_hint, count(*) n FROM c, unnest(recommended_chain) AS u(tool) WHERE routing_hint IS NOT NULL GROUP BY 1, 2)
  SELECT tool, routing_hint, n votes, total AS "of" FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY n DESC, routing_hint) rn, sum(n) OVER (PARTITION BY tool)::BIGINT total FROM v) WHERE rn = 1""")
def tool_description_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hint given most often with each tool."""
    c = _candidates(spark, sf_dir).select(F.explode("recommended_chain").alias("tool"), "routing_hint")
    return V.most_common(c, ["tool"], "routing_hint")


@query("answer_consensus", _CAND + """, g AS (SELECT query_abstract, lower(regexp_replace(regexp_replace(answer, '[ \\t\\r\\n]+', ' ', 'g'), '^ | $', '', 'g')) answer_key, count(*) size, max(similarity) best, round(avg(similarity), 9) mean FROM c WHERE regexp_replace(regexp_replace(answer, '[ \\t\\r\\n]+', ' ', 'g'), '^ | $', '', 'g') <> '' AND query_abstract IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT *, sum(size) OVER (PARTITION BY query_abstract)::BIGINT total, row_number() OVER (PARTITION BY query_abstract ORDER BY size DESC, best DESC NULLS LAST, mean DESC NULLS LAST, answer_key) AS rank FROM g)
  SELECT query_abstract, md5(answer_key) answer_key, size, total, rank, coalesce(rank = 1 AND size > 0.5 * total AND best >= 0.5, false) accepted FROM r""")
def answer_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal answers to a question counted, the first accepted if most agree and one is good."""
    c = _candidates(spark, sf_dir).where("query_abstract is not null")
    out = V.consensus(c, "query_abstract", "answer", "similarity", 0.5, 0.5)
    return out.select("query_abstract", F.md5("answer_key").alias("answer_key"), "size", "total", "rank", F.coalesce("accepted", F.lit(False)).alias("accepted"))


@query("library_candidates", _CAND + """, k AS (SELECT *, count(*) OVER (PARTITION BY pattern_name, lower(trim(regexp_replace(query_abstract, '\\s+', ' ', 'g')))) n FROM c WHERE query_abstract IS NOT NULL)
  SELECT candidate_id, n AS occurrences FROM k WHERE n >= 2 OR similarity >= 0.9 OR template_id IS NULL""")
def library_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose pattern recurs, that are very similar or match no template."""
    c = _candidates(spark, sf_dir).where("query_abstract is not null").withColumn("key", V.pattern_key(F.col("query_abstract")))
    n = c.groupBy("pattern_name", "key").agg(F.count(F.lit(1)).alias("occurrences"))
    rows = c.join(n, c["pattern_name"].eqNullSafe(n["pattern_name"]) & (c["key"] == n["key"]))
    return rows.where("occurrences >= 2 or similarity >= 0.9 or template_id is null").select("candidate_id", "occurrences")


@query("chain_similarity", _CAND + """, a AS (SELECT DISTINCT pattern_name, list_sort(list_distinct(recommended_chain)) s FROM c WHERE pattern_name IS NOT NULL AND len(recommended_chain) > 0),
  m AS (SELECT DISTINCT s FROM a), p AS (SELECT x.s a, y.s b FROM m x JOIN m y ON x.s < y.s AND len(list_intersect(x.s, y.s)) > 0)
  SELECT array_to_string(a, '|') a, array_to_string(b, '|') b, round(len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE, 6) overlap, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) jaccard FROM p""")
def chain_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tool sets that share a tool, with the overlap of the smaller and the Jaccard share.

    Tools are few, so their distinct sets are a table of bounded size.
    """
    s = _candidates(spark, sf_dir).where((F.size("recommended_chain") > 0) & F.col("pattern_name").isNotNull()).select(F.array_sort(F.array_distinct("recommended_chain")).alias("s")).distinct()
    each = s.select("s", F.explode("s").alias("tool"))
    met = each.withColumnRenamed("s", "a").join(each.withColumnRenamed("s", "b"), "tool").where("a < b").select("a", "b").distinct()
    return met.select(F.array_join("a", "|").alias("a"), F.array_join("b", "|").alias("b"), F.round(T.overlap_of_smaller(F.col("a"), F.col("b")), 6).alias("overlap"), F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("memory_ranking", _CAND + """, e AS (SELECT template_id, query_abstract, max(similarity) confidence, count(*) hits FROM c WHERE template_id IS NOT NULL AND query_abstract IS NOT NULL AND similarity IS NOT NULL GROUP BY 1, 2)
  SELECT template_id, query_abstract, hits, round(confidence * (1 + 0.35::DOUBLE * ln(1 + hits)), 6) score, row_number() OVER (PARTITION BY template_id ORDER BY round(confidence * (1 + 0.35::DOUBLE * ln(1 + hits)), 6) DESC, query_abstract) AS rank FROM e""")
def memory_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory entries by confidence, raised by the logarithm of their hits."""
    from pyspark.sql import Window

    e = _candidates(spark, sf_dir).where("template_id is not null and query_abstract is not null and similarity is not null").groupBy("template_id", "query_abstract").agg(F.max("similarity").alias("confidence"), F.count(F.lit(1)).alias("hits"))
    e = e.withColumn("score", F.round(F.col("confidence") * (1 + 0.35 * F.log1p("hits")), 6))
    return e.select("template_id", "query_abstract", "hits", "score", F.row_number().over(Window.partitionBy("template_id").orderBy(F.desc("score"), "query_abstract")).cast("bigint").alias("rank"))


@query("template_quality", _CAND + " SELECT template_id, round(0.65::DOUBLE * (count(*) FILTER (WHERE similarity >= 0.5) / count(*)) + 0.35::DOUBLE * least(count(*) / 5.0::DOUBLE, 1), 6) quality FROM c WHERE template_id IS NOT NULL GROUP BY 1")
def template_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """.65 of the success rate and .35 of the support, full at five."""
    c = _candidates(spark, sf_dir).where("template_id is not null").groupBy("template_id").agg(F.count_if(F.coalesce(F.col("similarity") >= 0.5, F.lit(False))).alias("ok"), F.count(F.lit(1)).alias("n"))
    return c.select("template_id", F.round(0.65 * F.col("ok") / F.col("n") + 0.35 * F.least(F.col("n") / 5.0, F.lit(1.0)), 6).alias("quality"))


@query("dialogue_search", """SELECT DISTINCT candidate_id, template_id, answer FROM candidates WHERE answer ILIKE '%telescope%' AND query_abstract ILIKE '%[CHARACTER]%' AND similarity > 0.3 ORDER BY candidate_id LIMIT 50""")
def dialogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional conditions put together, ordered by id, at most fifty (a search's limit)."""
    c = read_table(spark, sf_dir, "candidates")
    asked = {"answer": "telescope", "query_abstract": "[CHARACTER]"}
    hit = F.col("similarity") > 0.3
    for name, q in asked.items():
        hit &= F.col(name).ilike(f"%{q}%")
    return c.where(hit).select("candidate_id", "template_id", "answer").distinct().orderBy("candidate_id").limit(50)


@query("event_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) window_start, event_type, count(*) events, round(sum(value), 6) total FROM events GROUP BY 1, 2")
def event_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.counts(read_table(spark, sf_dir, "events"), "1 day").withColumn("total", F.round("total", 6))


@query("event_sliding_windows", "SELECT s.b - o.k * INTERVAL 6 HOUR AS window_start, event_type, count(*) events, round(sum(value), 6) total FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) b FROM events) s, range(0, 4) o(k) GROUP BY 1, 2")
def event_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.counts(read_table(spark, sf_dir, "events"), "1 day", "6 hours").withColumn("total", F.round("total", 6))


@query("event_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) n FROM g)
  SELECT min(ts) session_start, max(ts) + INTERVAL 2 HOUR AS session_end, user_id, count(*) events FROM s GROUP BY user_id, n""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sessions(read_table(spark, sf_dir, "events"), "2 hours")


@query("resume_unseen", "SELECT DISTINCT id FROM source_docs WHERE id NOT IN (SELECT source_doc_id FROM chunks WHERE source_doc_id IS NOT NULL)")
def resume_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source documents that no chunk has been made of yet."""
    done = read_table(spark, sf_dir, "chunks").where("source_doc_id is not null").select(F.col("source_doc_id").alias("id"))
    return W.unseen(read_table(spark, sf_dir, "source_docs").select("id").distinct(), done, "id")
