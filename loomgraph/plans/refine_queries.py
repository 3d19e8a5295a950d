"""Queries that merge and refine what extraction gave."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import chains as C
from loomgraph.operators import graph as G
from loomgraph.operators import refine as M
from loomgraph.plans.graph_queries import CENTERS_SQL, LINKS_SQL, centers
from loomgraph.plans.registry import query
from loomgraph.session import read_table
from loomgraph.sources.tables import GRAPH_SQL, edges, nodes

_TYPES = "list_filter(coalesce(entity_type, []), lambda t: trim(t) <> '' AND t <> 'Entity')"
_PRIMARY = "CASE " + " ".join(f"WHEN list_contains({_TYPES}, '{t}') THEN '{t}'" for t in M.TYPE_ORDER) + f" ELSE coalesce(list_min({_TYPES}), 'Concept') END"
_LIST = "list_sort(list_distinct(list_filter(flatten(list(coalesce({0}, []))), lambda x: trim(x) <> '')))"


@query("entity_bucket_merge", f"""WITH r AS (SELECT CASE WHEN lower(trim(scope_level)) = 'global' THEN 'global' ELSE 'local' END AS scope,
    CASE WHEN lower(trim(scope_level)) = 'global' THEN '' ELSE coalesce(nullif(trim(base_document), ''), '') END base_document, {_PRIMARY} AS type, trim(name) AS name, aliases, source_documents FROM entities WHERE trim(name) <> '')
  SELECT 'ent_' || substr(md5(scope || '||' || base_document || '||' || type || '||' || name), 1, 12) id, scope, base_document, type, name,
    array_to_string({_LIST.format('aliases')}, '|') aliases, array_to_string({_LIST.format('source_documents')}, '|') source_documents, count(*) records FROM r GROUP BY scope, base_document, type, name""")
def entity_bucket_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = M.bucket_merge(read_table(spark, sf_dir, "entities"))
    return b.select("id", "scope", "base_document", "type", "name", F.array_join("aliases", "|").alias("aliases"), F.array_join("source_documents", "|").alias("source_documents"), "records")


@query("relation_merge", GRAPH_SQL + """ SELECT predicate, src, dst, min(id) id, count(*) merged, arg_max(description, (length(description), id)) FILTER (WHERE description IS NOT NULL) description,
  arg_min(base_document, id) FILTER (WHERE base_document IS NOT NULL) base_document, max(confidence) confidence FROM edges GROUP BY predicate, src, dst, CASE WHEN persistence = 'momentary' THEN id ELSE '' END""")
def relation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return M.merge_relations(e)


@query("multi_type_names", f"""WITH r AS (SELECT DISTINCT trim(name) AS name, {_PRIMARY} AS type, base_document FROM entities WHERE trim(name) <> '')
  SELECT name, count(DISTINCT type) types, string_agg(DISTINCT type, '|' ORDER BY type) names, count(DISTINCT base_document) documents FROM r GROUP BY 1 HAVING count(DISTINCT type) >= 2""")
def multi_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "entities").select(F.trim("name").alias("name"), M.primary_type(F.coalesce("entity_type", F.array().cast("array<string>"))).alias("type"), "base_document").where("name <> ''").distinct()
    out = e.groupBy("name").agg(F.count_distinct("type").alias("types"), F.array_join(F.array_sort(F.collect_set("type")), "|").alias("names"), F.count_distinct("base_document").alias("documents"))
    return out.where("types >= 2")


@query("scope_majority_vote", f"""WITH r AS (SELECT trim(name) AS name, lower(trim(scope_level)) s, {_PRIMARY} AS type FROM entities WHERE trim(name) <> ''),
  v AS (SELECT name, count(*) FILTER (WHERE s = 'global') n_global, count(*) FILTER (WHERE s = 'local') n_local, bool_or(type IN ('Event', 'Occasion', 'TimePoint')) induced FROM r GROUP BY 1)
  SELECT name, n_global, n_local, CASE WHEN induced THEN 'local' WHEN n_global > n_local THEN 'global' WHEN n_local > n_global THEN 'local' ELSE 'global' END AS scope FROM v""")
def scope_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scope_votes(read_table(spark, sf_dir, "entities"))


@query("type_ranking", f"""WITH r AS (SELECT lower(trim(id)) id, {_PRIMARY} AS type, base_document FROM entities WHERE trim(id) <> ''), c AS (SELECT id, type, count(*) n FROM r GROUP BY 1, 2)
  SELECT id, type, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, type) AS rank FROM c""")
def type_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types an id was given, the most frequent first."""
    from pyspark.sql import Window

    e = read_table(spark, sf_dir, "entities").select(F.lower(F.trim("id")).alias("id"), M.primary_type(F.coalesce("entity_type", F.array().cast("array<string>"))).alias("type")).where("id <> ''")
    c = e.groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "type")).cast("bigint"))


_TYPED = ", t AS (SELECT id, unnest(types) AS type FROM nodes)"


@query("typepair_relation_index", GRAPH_SQL + _TYPED + " SELECT least(s.type, o.type) type_a, greatest(s.type, o.type) type_b, string_agg(DISTINCT predicate, '|' ORDER BY predicate) predicates, count(*) edges FROM edges e JOIN t s ON s.id = e.src JOIN t o ON o.id = e.dst GROUP BY 1, 2")
def typepair_relation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.type_pairs(edges(spark, sf_dir), nodes(spark, sf_dir))


_DOMAINS = [("knows", "Character", "Character"), ("opposes", "Character", "Character"), ("kinship_with", "Character", "Character"), ("located_at", "Character", "Location"), ("located_at", "Event", "Location"), ("performs", "Character", "Event"), ("possesses", "Character", "Object"), ("member_of", "Character", "Concept"), ("occurs_on", "Event", "TimePoint")]
_DOMAINS_SQL = ", dom(predicate, pair) AS (VALUES " + ", ".join(f"('{p}', '{a}>{b}')" for p, a, b in _DOMAINS) + ")"


@query("relation_validation", GRAPH_SQL + _TYPED + _DOMAINS_SQL + """, f AS (SELECT DISTINCT e.id FROM edges e JOIN t s ON s.id = e.src JOIN t o ON o.id = e.dst JOIN dom d ON d.predicate = e.predicate AND d.pair = s.type || '>' || o.type),
  b AS (SELECT DISTINCT e.id FROM edges e JOIN t s ON s.id = e.src JOIN t o ON o.id = e.dst JOIN dom d ON d.predicate = e.predicate AND d.pair = o.type || '>' || s.type),
  v AS (SELECT id, src, dst, CASE WHEN src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes) THEN 'missing_end' WHEN src = dst THEN 'self_loop' WHEN predicate NOT IN (SELECT predicate FROM dom) THEN 'unknown_type'
    WHEN id IN (SELECT id FROM f) THEN 'ok' WHEN id IN (SELECT id FROM b) THEN 'swapped' ELSE 'bad_types' END verdict FROM edges)
  SELECT id, verdict, CASE WHEN verdict = 'swapped' THEN dst ELSE src END src, CASE WHEN verdict = 'swapped' THEN src ELSE dst END dst FROM v""")
def relation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = spark.createDataFrame(_DOMAINS, "predicate string, from_type string, to_type string")
    return M.validated(edges(spark, sf_dir), nodes(spark, sf_dir), domains)


@query("relation_conflicts", GRAPH_SQL + """, k AS (SELECT DISTINCT least(src, dst) a, greatest(src, dst) b, predicate FROM edges WHERE persistence <> 'momentary')
  SELECT x.a, x.b, string_agg(DISTINCT x.predicate, '|' ORDER BY x.predicate) predicates FROM k x JOIN k y ON y.a = x.a AND y.b = x.b AND (x.predicate, y.predicate) IN (('opposes', 'kinship_with'), ('kinship_with', 'opposes'), ('knows', 'opposes'), ('opposes', 'knows')) GROUP BY 1, 2""")
def relation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    opposites = spark.createDataFrame([("opposes", "kinship_with"), ("knows", "opposes")], "x string, y string")
    return M.conflicts(edges(spark, sf_dir), opposites)


@query("none_relations_dropped", "SELECT DISTINCT id FROM relations WHERE upper(trim(coalesce(predicate, 'NONE'))) NOT IN ('NONE', 'NO_RELATION', 'NULL', 'N/A', 'NA', '')")
def none_relations_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.upper(F.trim(F.coalesce("predicate", F.lit("NONE"))))
    return read_table(spark, sf_dir, "relations").where(~p.isin("NONE", "NO_RELATION", "NULL", "N/A", "NA", "")).select("id").distinct()


@query("first_relation_per_type", GRAPH_SQL + " SELECT src, dst, predicate, arg_min(id, (created_at, id)) id FROM edges GROUP BY 1, 2, 3")
def first_relation_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_per(edges(spark, sf_dir).select("src", "dst", "predicate", "id", "created_at"), ["src", "dst", "predicate"], ["created_at", "id"]).select("src", "dst", "predicate", "id")


@query("last_write_wins", "SELECT id, record_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, record_id DESC) rn FROM entities WHERE id IS NOT NULL) WHERE rn = 1")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latest_by(read_table(spark, sf_dir, "entities").where("id is not null"), "id", ["created_at", "record_id"]).select("id", "record_id", "origin")


@query("name_resolution", GRAPH_SQL + """, loc AS (SELECT base_document d, lower(trim(name)) k, min(lower(trim(id))) id FROM entities WHERE trim(name) <> '' AND trim(id) <> '' GROUP BY 1, 2),
  glo AS (SELECT lower(trim(name)) k, min(lower(trim(id))) id FROM entities WHERE trim(name) <> '' AND trim(id) <> '' GROUP BY 1),
  m AS (SELECT DISTINCT base_document d, lower(trim(u.a)) k FROM entities, unnest(aliases) AS u(a) WHERE trim(u.a) <> '')
  SELECT m.d AS document, m.k AS mention, coalesce(l.id, g.id) id, CASE WHEN l.id IS NOT NULL THEN 'local' WHEN g.id IS NOT NULL THEN 'global' ELSE 'none' END how FROM m LEFT JOIN loc l ON l.d = m.d AND l.k = m.k LEFT JOIN glo g ON g.k = m.k""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions resolved to ids, in the same story first, then anywhere; the smallest id wins."""
    e = read_table(spark, sf_dir, "entities")
    named = e.select(F.col("base_document").alias("document"), F.lower(F.trim("name")).alias("mention"), F.lower(F.trim("id")).alias("id")).where("mention <> '' and id <> ''")
    near = named.groupBy("document", "mention").agg(F.min("id").alias("near"))
    far = named.groupBy("mention").agg(F.min("id").alias("far"))
    m = e.select(F.col("base_document").alias("document"), F.explode("aliases").alias("a")).select("document", F.lower(F.trim("a")).alias("mention")).where("mention <> ''").distinct()
    rows = m.join(near, ["document", "mention"], "left").join(far, "mention", "left")
    how = F.when(F.col("near").isNotNull(), "local").when(F.col("far").isNotNull(), "global").otherwise("none")
    return rows.select("document", "mention", F.coalesce("near", "far").alias("id"), how.alias("how"))


_SURFACE = "trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("lexical_blocks", GRAPH_SQL + f""", s AS (SELECT id, {_SURFACE} s FROM nodes WHERE name IS NOT NULL),
  k AS (SELECT id, 'n:' || s block FROM s WHERE s <> '' UNION SELECT id, 'w:' || w FROM (SELECT id, unnest(string_split(s, ' ')) w FROM s) WHERE length(w) >= 5)
  SELECT block, id, size FROM k JOIN (SELECT block, count(*) size FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 32) USING (block)""")
def lexical_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.lexical_blocks(nodes(spark, sf_dir))


@query("shared_neighbor_pairs", CENTERS_SQL + LINKS_SQL + " SELECT c.center a, y.node b, count(*) shared FROM centers c JOIN links x ON x.node = c.center JOIN links y ON y.other = x.other AND y.node <> c.center GROUP BY 1, 2 HAVING count(*) >= 2")
def shared_neighbor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with two or more neighbours in common with a centre."""
    links = G.either_way(edges(spark, sf_dir)).select("node", "other").where("node <> other").distinct()
    x = centers(spark, sf_dir).join(links.withColumnRenamed("node", "center"), "center")
    met = x.join(links.withColumnRenamed("node", "b"), "other").where("b <> center")
    return met.groupBy(F.col("center").alias("a"), "b").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2")


_WEIGHTS = {"performs": 1.0, "initiates": 0.9, "undergoes": 0.8, "experiences": 0.8}
_EFF = "CASE predicate " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _WEIGHTS.items()) + " ELSE 0.5::DOUBLE END"


@query("best_edge_per_pair", GRAPH_SQL + f""", w AS (SELECT *, round(confidence * {_EFF}, 9) ew FROM edges), r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ew DESC, id) rn FROM w)
  SELECT src, dst, max(id) FILTER (WHERE rn = 1) id, max(predicate) FILTER (WHERE rn = 1) predicate, max(ew) effective_weight, coalesce(string_agg(id, '|' ORDER BY rn) FILTER (WHERE rn > 1), '') pool FROM r GROUP BY 1, 2""")
def best_edge_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_edges(edges(spark, sf_dir), _WEIGHTS)


@query("triangle_classify", GRAPH_SQL + f""", w AS (SELECT src, dst, max(round(confidence * {_EFF}, 9)) w FROM edges WHERE predicate IN ('performs', 'initiates', 'participates_in', 'knows', 'kinship_with') AND src <> dst GROUP BY 1, 2)
  SELECT x.src a, x.dst b, y.dst c, CASE WHEN z.w >= x.w AND z.w >= y.w THEN 'keep_strong' WHEN z.w < x.w AND z.w < y.w THEN 'redundant' ELSE 'unclear' END kind
  FROM w x JOIN w y ON y.src = x.dst JOIN w z ON z.src = x.src AND z.dst = y.dst WHERE x.src <> y.dst""")
def triangle_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["performs", "initiates", "participates_in", "knows", "kinship_with"]
    best = C.best_edges(edges(spark, sf_dir).where(F.col("predicate").isin(kinds) & (F.col("src") != F.col("dst"))), _WEIGHTS)
    return C.triangles(best.select("src", "dst", F.col("effective_weight").alias("w")))


_CHAINS_SQL = "WITH ch AS (SELECT DISTINCT candidate_id id, recommended_chain AS chain FROM candidates WHERE len(recommended_chain) > 0)"


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "candidates").where(F.size("recommended_chain") > 0).select(F.col("candidate_id").alias("id"), F.col("recommended_chain").alias("chain")).distinct()


@query("frequent_subchains", _CHAINS_SQL + """, sl AS (SELECT DISTINCT id, array_to_string(list_slice(chain, i, j), '>') subchain FROM ch, range(1, 12) a(i), range(1, 12) b(j) WHERE j >= i + 1 AND j <= len(chain))
  SELECT subchain, count(*) chains FROM sl GROUP BY 1 HAVING count(*) >= 5""")
def frequent_subchains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.frequent_subchains(_chains(spark, sf_dir), 2, 5)


@query("path_trie_trunks", """WITH ch AS (SELECT DISTINCT recommended_chain AS chain FROM candidates WHERE len(recommended_chain) > 0),
  px AS (SELECT list_slice(chain, 1, n) prefix, chain[n + 1] nxt FROM ch, range(1, 12) r(n) WHERE n <= len(chain)),
  forks AS (SELECT prefix, count(DISTINCT nxt) children, bool_or(nxt IS NULL) ends, count(*) paths FROM px GROUP BY 1), cut AS (SELECT * FROM forks WHERE children >= 2 OR ends)
  SELECT array_to_string(c.prefix, '>') trunk, c.paths FROM cut c WHERE NOT EXISTS (SELECT 1 FROM cut u WHERE len(u.prefix) < len(c.prefix) AND list_slice(c.prefix, 1, len(u.prefix)) = u.prefix) AND len(c.prefix) >= 1""")
def path_trie_trunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.trie_trunks(_chains(spark, sf_dir), 1)


@query("maximal_chains", """WITH s AS (SELECT DISTINCT list_sort(list_distinct(recommended_chain)) m FROM candidates WHERE len(recommended_chain) > 0)
  SELECT array_to_string(a.m, '|') members FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE len(b.m) > len(a.m) AND list_has_all(b.m, a.m))""")
def maximal_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = read_table(spark, sf_dir, "candidates").where(F.size("recommended_chain") > 0).select(F.col("recommended_chain").alias("members"))
    return C.strict_subsets(sets).select(F.array_join("members", "|").alias("members"))


@query("chain_confidence_split", """WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
  p AS (SELECT *, sum(CASE WHEN value < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) part FROM s) SELECT user_id, part::BIGINT part, count(*) steps, min(event_id) first_event FROM p GROUP BY 1, 2""")
def chain_confidence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events cut into chains wherever a value is low."""
    from pyspark.sql import Window

    e = read_table(spark, sf_dir, "events")
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    parts = C.split_at(e, "user_id", "pos", F.col("value") < 2)
    return parts.groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("steps"), F.min("event_id").alias("first_event"))


@query("causal_chain_edges", "WITH s AS (SELECT user_id, event_id src, event_type, lead(event_id) OVER w dst, lead(event_type) OVER w next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT src, dst, event_type || '>' || next_type AS relation, ((src % 100) / 100.0)::DOUBLE confidence FROM s WHERE dst IS NOT NULL")
def causal_chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event to the user's next one."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("src"), F.lead("event_id").over(w).alias("dst"), "event_type", F.lead("event_type").over(w).alias("next_type")).where("dst is not null")
    return e.select("src", "dst", F.concat_ws(">", "event_type", "next_type").alias("relation"), ((F.col("src") % 100) / 100.0).alias("confidence"))
