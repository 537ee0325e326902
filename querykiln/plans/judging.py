"""Queries on model output, candidate selection, the graph and resuming, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from querykiln.functions import judging as J
from querykiln.functions.text import score_of_hits
from querykiln.operators import context as C
from querykiln.operators import graph as G
from querykiln.operators import selection as S
from querykiln.operators import synthesis as Y
from querykiln.plans.sqltext import alnum, compact, lower_ws
from querykiln.sources import jsonl


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# judge output ------------------------------------------------------------
def _raw(spark, d):
    """Judge answers of several kinds, made from events."""
    k = F.get_json_object("props", "$.k")
    i = F.col("event_id") % 7
    raw = F.when(i == 0, F.concat(F.lit('Sure: {"connectivity_score": '), k, F.lit(', "confidence": 0.25, "label": "ok", "reason": "r"} done')))
    raw = raw.when(i == 1, F.concat(F.lit('{"connectivity_score": "'), k, F.lit('.5", "confidence": "0.75", "reason": ""}')))
    raw = raw.when(i == 2, F.lit('{"connectivity_score": 0, "reason": " "}')).when(i == 3, F.lit("no json here")).when(i == 4, F.lit('{"connectivity_score": true, "confidence": 7}'))
    raw = raw.when(i == 5, F.concat(F.lit('{"connectivity_score": '), k, F.lit('.5, "confidence": null, "reason": "x"}'))).otherwise('{"label": "low"}')
    return _t(spark, d, "events").select("event_id", raw.alias("raw"))


def judge_parse(spark, d):
    v = _raw(spark, d).withColumn("v", J.parse_judgement("raw"))
    return v.select("event_id", F.col("v").isNotNull().alias("parsed"), J.is_failure("v").alias("failed"), J.coerce_int("v").cast("long").alias("score"), J.coerce_float("v").alias("confidence"))


JUDGE_SQL = """
WITH e AS (SELECT event_id, event_id % 7 AS i, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, i <> 3 AS parsed, i IN (2, 3) AS failed,
 CAST(CASE i WHEN 0 THEN least(k, 100) WHEN 1 THEN least(round_even(k + 0.5, 0), 100) WHEN 5 THEN least(round_even(k + 0.5, 0), 100) ELSE 0 END AS BIGINT) AS score,
 CASE i WHEN 0 THEN 0.25 WHEN 1 THEN 0.75 WHEN 4 THEN 1.0 ELSE 0.5 END :: DOUBLE AS confidence FROM e
"""


def _answers(spark, d):
    """Generated answers of several kinds, made from events."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('[{"query": "What is the value of item '), k, F.lit(' in the list?", "type": "causal"}, "junk", {"query": "What is the value of item '), k, F.lit(' in the list?"}, {"query": "Too short"}, {"query": "Explain nothing"}, {"query": "How does the system react when load grows?", "type": "DEDUCTIVE", "used_edges": ["1", 1, 9, "x"]}]'))
    i = F.col("event_id") % 5
    raw = F.when(i == 0, body).when(i == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i == 2, F.concat(F.lit('Here: {"queries": '), body, F.lit("} ok"))).when(i == 3, F.concat(F.lit('{"candidates": '), body, F.lit("}"))).otherwise("nothing")
    # dealt anew: reading them takes far longer than shuffling the small rows, and a file of few row groups gives few tasks
    events = _t(spark, d, "events").select("event_id", "user_id", "props").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "event_id")
    return events.select("event_id", "user_id", raw.alias("raw"))


def output_parse(spark, d):
    items = J.parse_output("raw")
    return _answers(spark, d).select("event_id", F.size(items).cast("long").alias("n_items"), F.array_join(F.transform(items, lambda v: F.concat(F.coalesce(F.try_variant_get(v, "$.query", "string"), F.lit("")), F.lit("/"), J.reasoning_type(v), F.lit("/"), F.array_join(J.edge_ids(v, 3).cast("array<string>"), ","))), "|").alias("items"))


OUTPUT_SQL = """
WITH e AS (SELECT event_id, event_id % 5 AS i, 'What is the value of item ' || json_extract_string(props, '$.k') || ' in the list?' AS q FROM events)
SELECT event_id, CAST(CASE WHEN i = 4 THEN 0 ELSE 5 END AS BIGINT) AS n_items, CASE WHEN i = 4 THEN '' ELSE q || '/causal/|' || q || '/analytical/|Too short/analytical/|Explain nothing/analytical/|How does the system react when load grows?/deductive/1' END AS items FROM e
"""


def collect_queries(spark, d):
    a = _answers(spark, d).withColumn("ok", Y.accept(J.parse_output("raw"), F.array(F.lit("system-level view"))))
    return a.select("event_id", F.size("ok").cast("long").alias("n"), F.array_join(F.transform("ok", lambda q: F.concat(q["query"], F.lit("/"), q["reasoning_type"])), "|").alias("accepted"))


COLLECT_SQL = """
WITH e AS (SELECT event_id, event_id % 5 AS i, 'What is the value of item ' || json_extract_string(props, '$.k') || ' in the list?' AS q FROM events)
SELECT event_id, CAST(CASE WHEN i = 4 THEN 0 ELSE 2 END AS BIGINT) AS n, CASE WHEN i = 4 THEN '' ELSE q || '/causal|How does the system react when load grows?/deductive' END AS accepted FROM e
"""


# candidates and selection ------------------------------------------------
def candidate_dedup(spark, d):
    c = _t(spark, d, "conversations").groupBy(F.col("conv_id").alias("row_uid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("queries"))
    c = c.withColumn("queries", F.concat(F.array(F.lit(" ")), F.slice("queries", 1, 2), F.transform(F.slice("queries", 1, 1), lambda q: F.concat(F.lit("  "), q, F.lit(" "))), F.slice("queries", 3, 100)))
    return S.candidates(c, 5).select("row_uid", F.col("candidate_id").cast("long").alias("candidate_id"), F.md5("query").alias("query_md5"))


CAND_SQL = f"""
WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS q FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, list_concat([' '], q[1:2], ['  ' || q[1] || ' '], q[3:])[1:5] AS q FROM c),
u AS (SELECT conv_id, unnest(range(len(q))) AS i, unnest(q) AS t FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, {lower_ws('t')} ORDER BY i) AS r FROM u WHERE trim(t) <> '')
SELECT conv_id AS row_uid, i AS candidate_id, md5(trim(t)) AS query_md5 FROM n WHERE r = 1
"""


def _evals(spark, d):
    """Line items as judged candidates of their order."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    e = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_uid"), (F.row_number().over(w) - 1).alias("candidate_id"), F.concat(F.lit("query "), F.col("l_partkey").cast("string")).alias("query"), (F.col("l_quantity") * 2).cast("int").alias("connectivity_score"), (F.col("l_suppkey") % 4).cast("int").alias("n_hits"), (F.col("l_partkey") % 17 == 0).alias("judge_failed"))
    e = e.withColumns({"keyword_score": score_of_hits("n_hits"), "clean": F.col("n_hits") == 0, "confidence": F.lit(0.5)})
    return S.flags(e)


EVALS = """e AS (
  SELECT *, CASE n_hits WHEN 0 THEN 100 WHEN 1 THEN 70 WHEN 2 THEN 40 ELSE 10 END AS keyword_score, n_hits = 0 AS clean,
   CASE n_hits WHEN 0 THEN 100 WHEN 1 THEN 70 WHEN 2 THEN 40 ELSE 10 END * 0.2::DOUBLE + connectivity_score * 0.8::DOUBLE AS final_score FROM (
    SELECT l_orderkey AS row_uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS candidate_id,
     'query ' || l_partkey AS query, CAST(l_quantity * 2 AS INT) AS connectivity_score, l_suppkey % 4 AS n_hits, l_partkey % 17 = 0 AS judge_failed FROM lineitem)),
bc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_uid ORDER BY connectivity_score DESC, final_score DESC, n_hits, candidate_id) AS r FROM e WHERE NOT judge_failed AND clean) WHERE r = 1),
bu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_uid ORDER BY connectivity_score DESC, clean DESC, final_score DESC, n_hits, candidate_id) AS r FROM e WHERE NOT judge_failed) WHERE r = 1),
sel AS (SELECT x.row_uid, bc.candidate_id AS c_id, bu.candidate_id AS u_id, bc.query AS c_q, bu.query AS u_q,
  CASE WHEN bu.row_uid IS NULL THEN 'no_candidates' WHEN bu.connectivity_score < 45 THEN 'all_candidates_weak' WHEN bc.connectivity_score >= 65 AND bc.connectivity_score >= bu.connectivity_score - 10 THEN 'clean' ELSE 'usable' END AS note
  FROM (SELECT DISTINCT row_uid FROM e) x LEFT JOIN bc ON bc.row_uid = x.row_uid LEFT JOIN bu ON bu.row_uid = x.row_uid),
good AS (SELECT row_uid, candidate_id, query, row_number() OVER (PARTITION BY row_uid ORDER BY connectivity_score DESC, candidate_id) AS rank FROM e WHERE clean AND NOT judge_failed AND connectivity_score >= 65)"""


def keyword_score(spark, d):
    return _evals(spark, d).select("row_uid", F.col("candidate_id").cast("long").alias("candidate_id"), F.col("keyword_score").cast("long").alias("keyword_score"), F.round("final_score", 6).alias("final_score"), "is_good", "is_ok", "meets_min", "meets_clean")


def best(clean):
    return lambda spark, d: S.best(_evals(spark, d), clean).select("row_uid", F.col("candidate_id").cast("long").alias("candidate_id"), F.col("connectivity_score").cast("long").alias("connectivity_score"), F.round("final_score", 6).alias("final_score"))


def _best_sql(t):
    return f"WITH {EVALS} SELECT row_uid, candidate_id, CAST(connectivity_score AS BIGINT) AS connectivity_score, round(final_score, 6) AS final_score FROM {t}"


def select_decision(spark, d):
    e = _evals(spark, d)
    return S.select(e, e).select("row_uid", F.col("selected_candidate_id").cast("long").alias("selected_candidate_id"), "selected_query", "note", F.col("diagnostics.connectivity_gap").cast("long").alias("gap"))


SELECT_SQL = f"""WITH {EVALS} SELECT sel.row_uid, CASE note WHEN 'clean' THEN c_id WHEN 'usable' THEN u_id END AS selected_candidate_id, CASE note WHEN 'clean' THEN c_q WHEN 'usable' THEN u_q END AS selected_query, note,
 CAST(bu.connectivity_score - bc.connectivity_score AS BIGINT) AS gap FROM sel LEFT JOIN bc USING (row_uid) LEFT JOIN bu USING (row_uid)"""


def all_good(spark, d):
    return S.good_queries(_evals(spark, d)).select("row_uid", F.col("rank").cast("long").alias("rank"), F.col("candidate_id").cast("long").alias("candidate_id"), "query")


def finalize(spark, d):
    e = _evals(spark, d)
    f = S.finalize(e, e)
    return f.select("row_uid", "note", F.size("candidate_evaluations").cast("long").alias("n_evaluations"), F.col("candidate_evaluations")[0]["candidate_id"].cast("long").alias("top_id"), F.greatest(F.size("all_good_queries"), F.lit(0)).cast("long").alias("n_good"))


FINAL_SQL = f"""WITH {EVALS} SELECT sel.row_uid, note, n_evaluations, top_id, coalesce(n_good, 0) AS n_good FROM sel
 JOIN (SELECT row_uid, count(*) AS n_evaluations, first(candidate_id ORDER BY final_score DESC, connectivity_score DESC, clean DESC, candidate_id) AS top_id FROM e GROUP BY row_uid) USING (row_uid)
 LEFT JOIN (SELECT row_uid, count(*) AS n_good FROM good GROUP BY row_uid) USING (row_uid)"""


def mining_bridge(spark, d):
    e = _evals(spark, d)
    rows = e.select("row_uid", F.concat(F.lit("pos "), F.col("row_uid").cast("string")).alias("pos")).distinct()
    return S.mining_bridge(S.finalize(e, e), rows)


BRIDGE_SQL = f"""WITH {EVALS} SELECT row_uid, query, 'pos ' || row_uid AS pos FROM good
 UNION ALL SELECT row_uid, CASE note WHEN 'clean' THEN c_q ELSE u_q END, 'pos ' || row_uid FROM sel WHERE note IN ('clean', 'usable') AND row_uid NOT IN (SELECT row_uid FROM good)"""


def resume_anti(spark, d):
    o = _t(spark, d, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("_row_uid"), F.col("o_orderkey").alias("row_ord"), "o_orderstatus")
    done = o.where("o_orderkey % 5 = 0").select(F.col("o_custkey").cast("string").alias("_row_uid"))
    return jsonl.unprocessed(rows, done).select("_row_uid", "row_ord", "o_orderstatus")


RESUME_SQL = """
SELECT _row_uid, row_ord, o_orderstatus FROM (SELECT CAST(o_custkey AS VARCHAR) AS _row_uid, o_orderkey AS row_ord, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders
 WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)) WHERE r = 1
"""


# graph -------------------------------------------------------------------
def _graph(spark, d):
    """Driver tables as a knowledge graph; part names are two-word entities within regions."""
    r, n, s, c, p = (_t(spark, d, t) for t in ("region", "nation", "supplier", "customer", "part"))
    ent = lambda df, key, name: df.select(F.concat(F.lit(key[0].upper()), F.col(f"{key}").cast("string")).alias("qid"), F.col(name).alias("label"))
    names = p.select("p_name").distinct()
    entity = ent(r, "r_regionkey", "r_name").unionByName(ent(n, "n_nationkey", "n_name")).unionByName(ent(s, "s_suppkey", "s_name")).unionByName(ent(c, "c_custkey", "c_name")).unionByName(names.select(F.concat(F.lit("W"), "p_name").alias("qid"), F.col("p_name").alias("label")))
    entity = entity.withColumns({"description": F.lit(""), "aliases": F.array().cast("array<string>"), "missing": F.col("qid") == "N7"})
    search = entity.select(F.lower("label").alias("text_norm"), "qid", F.lit("label").alias("match_type"), F.lit(1).alias("rank"))
    edge = lambda df, a, p_, b, o: df.select(F.concat(F.lit(a[0].upper()), F.col(a).cast("string")).alias("src"), F.lit(p_).alias("prop"), F.col(o).cast("long").alias("claim_ord"), F.lit("item").alias("value_type"), b.alias("dst"))
    key = lambda k, col: F.concat(F.lit(k), F.col(col).cast("string"))
    claim = edge(n, "n_nationkey", "P361", key("R", "n_regionkey"), "n_regionkey")
    claim = claim.unionByName(n.select(key("R", "n_regionkey").alias("src"), F.lit("P527").alias("prop"), F.col("n_nationkey").cast("long").alias("claim_ord"), F.lit("item").alias("value_type"), key("N", "n_nationkey").alias("dst")))
    claim = claim.unionByName(edge(s, "s_suppkey", "P1269", key("N", "s_nationkey"), "s_nationkey")).unionByName(edge(c, "c_custkey", "P1269", key("N", "c_nationkey"), "c_nationkey"))
    claim = claim.unionByName(names.select(F.concat(F.lit("W"), "p_name").alias("src"), F.lit("P31").alias("prop"), F.lit(0).cast("long").alias("claim_ord"), F.lit("item").alias("value_type"), F.concat(F.lit("R"), (F.length("p_name") % 5).cast("string")).alias("dst")))
    return entity, search, claim


GRAPH = """entity AS (
  SELECT 'R' || r_regionkey AS qid, r_name AS label FROM region UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'C' || c_custkey, c_name FROM customer
  UNION ALL SELECT DISTINCT 'W' || p_name, p_name FROM part),
present AS (SELECT * FROM entity WHERE qid <> 'N7'),
claim AS (
  SELECT 'N' || n_nationkey AS src, 'P361' AS prop, n_regionkey AS o, 'R' || n_regionkey AS dst FROM nation UNION ALL SELECT 'R' || n_regionkey, 'P527', n_nationkey, 'N' || n_nationkey FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'P1269', s_nationkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'C' || c_custkey, 'P1269', c_nationkey, 'N' || c_nationkey FROM customer
  UNION ALL SELECT DISTINCT 'W' || p_name, 'P31', 0, 'R' || (length(p_name) % 5) FROM part),
outgoing AS (SELECT src AS seed, src, prop, dst FROM claim WHERE dst IN (SELECT qid FROM present)),
incoming AS (SELECT DISTINCT b.dst AS seed, b.src, b.prop, b.dst FROM claim b JOIN outgoing o ON o.seed = b.dst AND o.dst = b.src),
edges AS (SELECT *, 'outgoing' AS direction FROM outgoing UNION ALL SELECT *, 'incoming' FROM incoming),
nodes AS (SELECT qid AS seed, qid FROM present UNION SELECT seed, dst FROM outgoing),
stat AS (SELECT e.qid AS seed, (SELECT count(*) FROM nodes n WHERE n.seed = e.qid) AS num_nodes, (SELECT count(*) FROM edges x WHERE x.seed = e.qid) AS num_edges, e.qid IN (SELECT qid FROM present) AS ok FROM entity e)"""


def _seeded(spark, d):
    """The graph with all its entities as seeds."""
    entity, search, claim = _graph(spark, d)
    seed = entity.select("qid")
    return entity, search, claim, seed


def kg_seed(spark, d):
    _, search, _ = _graph(spark, d)
    texts = _t(spark, d, "supplier").select(F.concat(F.lit(" "), F.upper("s_name")).alias("text")).unionByName(_t(spark, d, "part").select(F.col("p_name").alias("text")))
    return G.seeds(texts, search)


def kg_outgoing(spark, d):
    _, _, claim, seed = _seeded(spark, d)
    return G.neighbours(seed, claim).select("seed", "prop", "dst", F.col("pair_ord").cast("long").alias("pair_ord"))


def kg_incoming(spark, d):
    entity, _, claim, seed = _seeded(spark, d)
    near = G.neighbours(seed, claim)
    return G.edges(seed, near, G.nodes(seed, near, entity), claim).select("seed", "src", "prop", "dst", "direction")


def _topics(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("row_uid"), F.lit(0).alias("topic_ord"), F.when(F.col("p_size") % 4 == 0, F.lit("")).when(F.col("p_size") % 4 == 1, F.concat("p_name", F.lit(" of "), "p_brand")).when(F.col("p_size") % 4 == 2, F.concat("p_type", F.lit(" goods"))).otherwise(F.concat(F.lit("NATION_"), (F.col("p_partkey") % 10).cast("string"))).alias("topic"))
    return p


def kg_fallback(spark, d):
    entity, search, claim = _graph(spark, d)
    return G.subgraphs(_topics(spark, d), entity, search, claim).select("row_uid", "topic", "status", "seed", "refined", "num_nodes", "num_edges")


FALLBACK_SQL = f"""
WITH {GRAPH}, t AS (SELECT p_partkey AS row_uid, p_size % 4 AS m, p_name, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN p_name || ' of ' || p_brand WHEN 2 THEN p_type || ' goods' ELSE 'NATION_' || (p_partkey % 10) END AS topic FROM part),
f AS (SELECT *, CASE m WHEN 1 THEN 'W' || p_name WHEN 3 THEN 'N' || (row_uid % 10) END AS found FROM t)
SELECT row_uid, topic, CASE WHEN m = 0 THEN 'no_topic' WHEN found IS NULL THEN 'no_candidate' WHEN NOT stat.ok THEN 'seed_missing' WHEN num_edges < 1 THEN 'too_few_edges' ELSE 'ok' END AS status,
 CASE WHEN stat.ok AND num_edges >= 1 THEN found END AS seed, coalesce(m = 1 AND stat.ok AND num_edges >= 1, false) AS refined,
 CASE WHEN stat.ok AND num_edges >= 1 THEN num_nodes ELSE 0 END AS num_nodes, CASE WHEN stat.ok AND num_edges >= 1 THEN num_edges ELSE 0 END AS num_edges FROM f LEFT JOIN stat ON stat.seed = f.found
"""


def neighbor_relations(spark, d):
    entity, _, claim, seed = _seeded(spark, d)
    near = G.neighbours(seed, claim)
    node = G.nodes(seed, near, entity)
    return G.relations(node, G.edges(seed, near, node, claim))


RELATION_SQL = f"""WITH {GRAPH} SELECT o.seed, o.dst AS qid, label, CASE o.prop WHEN 'P361' THEN 'is part of' WHEN 'P527' THEN 'has part' WHEN 'P31' THEN 'is an instance of' WHEN 'P1269' THEN 'is a facet of' END AS relation, '→' AS arrow
 FROM outgoing o JOIN entity e ON e.qid = o.dst"""


def neighbor_sample(spark, d):
    return G.sample_neighbours(neighbor_relations(spark, d), 2, 7)


def graph_context(spark, d):
    """Prompt lines of every entity with a text of its own, from its packed neighbourhood."""
    entity, _, claim, seed = _seeded(spark, d)
    near = G.neighbours(seed, claim)
    node = G.nodes(seed, near, entity)
    nodes, edges = G.packed(node, G.edges(seed, near, node, claim))
    whole = nodes.join(edges, "seed", "left").select("seed", F.array(F.struct(F.lit("place").alias("topic"), "seed", "nodes", "edges")).alias("subgraphs"), F.lit("small red nation").alias("pos"))
    got = C.with_context(whole, extra=2, seed=7)
    return got.select("seed", F.array_join("graph_lines", "; ").alias("lines"), F.array_join("labels", "; ").alias("labels"))


CONTEXT_SQL = f"""
WITH own AS (WITH {GRAPH} SELECT p.qid AS seed, p.label FROM present p),
rel AS ({RELATION_SQL}),
pick AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5('7|' || seed || '|' || qid), qid) AS r FROM rel WHERE seed IN (SELECT seed FROM own)),
l AS (SELECT seed, string_agg('  - hidden ' || arrow || ' ' || relation || ' ' || label, '; ' ORDER BY r) AS near, string_agg(label, '; ' ORDER BY r) AS labels FROM pick WHERE r <= 2 GROUP BY seed)
SELECT own.seed, coalesce('- place, hidden (never name it): ' || own.label || '; ' || near, '') AS lines, coalesce(labels, '') AS labels FROM own LEFT JOIN l USING (seed)
UNION ALL SELECT 'N7', '- N7 → part of → ' || r_name || '; - ' || r_name || ' → has part → N7', '' FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 7
"""


def select_edges(spark, d):
    entity, _, claim, seed = _seeded(spark, d)
    docs = _t(spark, d, "region").select(F.col("r_regionkey").alias("row_uid"), F.concat(F.lit("small red big ring widget gear "), F.lower("r_name"), F.lit(" nation")).alias("pos"))
    edge = claim.where(F.col("src").rlike("^[NW]")).withColumn("row_uid", F.substring("dst", 2, 9).cast("int")).join(docs, "row_uid")
    edge = edge.withColumn("edge_ord", F.struct("prop", "src"))
    return G.useful_edges(edge, entity.select("qid", "label"), 8).select("row_uid", F.col("rank").cast("long").alias("rank"), "prop", "src", "dst", "label", F.col("overlap").cast("long").alias("overlap"))


EDGE_SQL = f"""
WITH {GRAPH}, p AS (SELECT r_regionkey AS row_uid, {alnum("'small red big ring widget gear ' || lower(r_name) || ' nation'")} AS k FROM region),
x AS (SELECT p.row_uid, c.prop, c.src AS sq, s.label AS src, d.label AS dst, k, {alnum('s.label')} AS st, {alnum('d.label')} AS dt FROM claim c JOIN p ON c.dst = 'R' || p.row_uid JOIN entity s ON s.qid = c.src JOIN entity d ON d.qid = c.dst WHERE regexp_matches(c.src, '^[NW]')),
o AS (SELECT *, len(list_intersect(list_distinct(list_concat(st, dt)), k)) AS overlap FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY row_uid, {compact('src')}, {compact('dst')} ORDER BY overlap DESC, prop, sq) AS a FROM o WHERE NOT (prop IN ('P31', 'P279') AND overlap < 2)),
g AS (SELECT *, row_number() OVER (PARTITION BY row_uid ORDER BY overlap DESC, prop, sq) AS rank FROM f WHERE a = 1)
SELECT row_uid, rank, prop, src, dst, CASE prop WHEN 'P361' THEN 'part of' WHEN 'P31' THEN 'instance of' END AS label, CAST(overlap AS BIGINT) AS overlap FROM g WHERE rank <= 8
"""

QUERIES = {
    "judge_parse": judge_parse,
    "output_parse": output_parse,
    "collect_queries": collect_queries,
    "candidate_dedup": candidate_dedup,
    "keyword_score": keyword_score,
    "best_clean": best(True),
    "best_usable": best(False),
    "select_decision": select_decision,
    "all_good": all_good,
    "finalize": finalize,
    "mining_bridge": mining_bridge,
    "resume_anti": resume_anti,
    "kg_seed": kg_seed,
    "kg_outgoing": kg_outgoing,
    "kg_incoming": kg_incoming,
    "kg_fallback": kg_fallback,
    "neighbor_relations": neighbor_relations,
    "neighbor_sample": neighbor_sample,
    "select_edges": select_edges,
    "graph_context": graph_context,
}
ORACLE = {
    "judge_parse": JUDGE_SQL,
    "output_parse": OUTPUT_SQL,
    "collect_queries": COLLECT_SQL,
    "candidate_dedup": CAND_SQL,
    "keyword_score": f"WITH {EVALS} SELECT row_uid, candidate_id, CAST(keyword_score AS BIGINT) AS keyword_score, round(final_score, 6) AS final_score, connectivity_score >= 70 AS is_good, connectivity_score >= 60 AS is_ok, connectivity_score >= 45 AS meets_min, connectivity_score >= 65 AS meets_clean FROM e",
    "best_clean": _best_sql("bc"),
    "best_usable": _best_sql("bu"),
    "select_decision": SELECT_SQL,
    "all_good": f"WITH {EVALS} SELECT row_uid, rank, candidate_id, query FROM good",
    "finalize": FINAL_SQL,
    "mining_bridge": BRIDGE_SQL,
    "resume_anti": RESUME_SQL,
    "kg_seed": f"WITH {GRAPH}, t AS (SELECT DISTINCT ' ' || upper(s_name) AS text FROM supplier UNION SELECT DISTINCT p_name FROM part) SELECT text, qid FROM t JOIN entity ON lower(label) = lower(trim(text))",
    "kg_outgoing": f"WITH {GRAPH} SELECT src AS seed, prop, dst, row_number() OVER (PARTITION BY src ORDER BY CASE prop WHEN 'P31' THEN 0 WHEN 'P361' THEN 2 WHEN 'P527' THEN 3 ELSE 4 END, o, dst) AS pair_ord FROM claim",
    "kg_incoming": f"WITH {GRAPH} SELECT seed, src, prop, dst, direction FROM edges WHERE seed IN (SELECT qid FROM entity)",
    "kg_fallback": FALLBACK_SQL,
    "neighbor_relations": RELATION_SQL,
    "neighbor_sample": f"SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5('7|' || seed || '|' || qid), qid) AS r FROM ({RELATION_SQL})) WHERE r <= 2",
    "select_edges": EDGE_SQL,
    "graph_context": CONTEXT_SQL,
}
