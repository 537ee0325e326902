"""Queries on text scalars, corpus statistics and retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.functions import text as T
from querykiln.operators import bm25
from querykiln.plans.sqltext import OPENERS, STOP_TOPIC, alnum, compact, lower_ws, tok_bm25, tok_topic, ws


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _joined(c) -> Column:
    return F.array_join(c, " ")


def tokenize(fn):
    def run(spark, d):
        k = fn("text")
        return _t(spark, d, "documents").select("doc_id", F.size(k).cast("long").alias("n_tokens"), F.md5(_joined(F.sort_array(k))).alias("tokens_md5"))

    return run


def _tokenize_sql(expr: str) -> str:
    return f"SELECT doc_id, CAST(len({expr}) AS BIGINT) AS n_tokens, md5(array_to_string(list_sort({expr}), ' ')) AS tokens_md5 FROM documents"


def normal(fn, table, key, col):
    return lambda spark, d: _t(spark, d, table).select(key, F.md5(fn(col)).alias("md5"), F.length(fn(col)).cast("long").alias("n"))


def _normal_sql(expr, table, key):
    return f"SELECT {key}, md5({expr}) AS md5, CAST(length({expr}) AS BIGINT) AS n FROM {table}"


def truncate_sentence(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.truncate_sentence("text", 800).alias("short"))


_W = ws("text")
TRUNCATE_SQL = f"""
WITH w AS (SELECT doc_id, {_W} AS t FROM documents), c AS (SELECT doc_id, t, t[:800] AS cut FROM w),
l AS (SELECT *, greatest(CASE WHEN strpos(reverse(cut), '.') > 0 THEN length(cut) - strpos(reverse(cut), '.') ELSE -1 END, CASE WHEN strpos(reverse(cut), '?') > 0 THEN length(cut) - strpos(reverse(cut), '?') ELSE -1 END, CASE WHEN strpos(reverse(cut), '!') > 0 THEN length(cut) - strpos(reverse(cut), '!') ELSE -1 END) AS last FROM c)
SELECT doc_id, CASE WHEN length(t) <= 800 THEN t WHEN last > 480 THEN cut[:last + 1] || ' …' ELSE rtrim(cut) || ' …' END AS short FROM l
"""


def _parts(spark, d):
    """Parts with a labelled keyword line and a templated question."""
    p = _t(spark, d, "part")
    line = F.concat(F.lit('"Document Key Topics": '), "p_name", F.lit(", "), "p_brand", F.lit(" , "), "p_type", F.lit(", "), "p_name")
    question = F.concat(F.lit("Question: what is  the "), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")), F.lit(" of size "), F.col("p_size").cast("string"), F.lit(" in stock? Yes."))
    return p.withColumns({"line": line, "question": question})


_PARTS = """(SELECT *, '"Document Key Topics": ' || p_name || ', ' || p_brand || ' , ' || p_type || ', ' || p_name AS line,
 'Question: what is  the ' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END || ' of size ' || CAST(p_size AS VARCHAR) || ' in stock? Yes.' AS question FROM part)"""


def topics(spark, d):
    return _parts(spark, d).select("p_partkey", F.array_join(T.topics_from_keywords("line"), "|").alias("topics"))


_THREE = "CASE WHEN lower(p_brand) = lower(p_name) THEN [p_name] ELSE [p_name, p_brand, p_type] END"


def leakage_terms(spark, d):
    return _parts(spark, d).select("p_partkey", F.array_join(T.leakage_terms("line", F.array("p_brand", F.lit("Extra Topic"))), "|").alias("terms"))


def keyword_phrases(spark, d):
    return _parts(spark, d).select("p_partkey", F.array_join(T.keyword_phrases("line"), "|").alias("phrases"))


def leak_generation(spark, d):
    p = _parts(spark, d)
    return p.select("p_partkey", T.has_leakage("question", F.array("p_name", "p_type", "p_brand")).alias("leaks"))


LEAK_SQL = f"""
SELECT p_partkey, list_contains(list_transform([p_name, p_type, p_brand], lambda t: CASE WHEN regexp_matches(t, '[ -]')
  THEN contains({compact('question')}, {compact('t')}) ELSE length({compact('t')}) >= 6 AND list_contains(regexp_extract_all(lower(question), '[a-z0-9]+'), lower(t)) END), true) AS leaks FROM {_PARTS}
"""


def leak_verify_hits(spark, d):
    p = _parts(spark, d)
    hits = T.phrase_hits("question", T.keyword_phrases("line"))
    return p.select("p_partkey", F.array_join(hits, "|").alias("hits"), F.size(hits).cast("long").alias("n_hits"), T.score_of_hits(F.size(hits)).cast("long").alias("keyword_score"))


HITS_SQL = f"""
WITH p AS (SELECT p_partkey, {lower_ws('question')} AS q, list_transform([p_name, p_brand, p_type], lambda x: lower(trim(x))) AS ks FROM {_PARTS}),
h AS (SELECT p_partkey, list_filter(ks, lambda k: CASE WHEN contains(k, ' ') THEN contains(q, k) ELSE regexp_matches(q, '\\b' || regexp_escape(k) || '\\b') END) AS hits FROM p)
SELECT p_partkey, array_to_string(hits, '|') AS hits, CAST(len(hits) AS BIGINT) AS n_hits, CAST(CASE len(hits) WHEN 0 THEN 100 WHEN 1 THEN 70 WHEN 2 THEN 40 ELSE 10 END AS BIGINT) AS keyword_score FROM h
"""


def split_candidates(spark, d):
    b = _t(spark, d, "benchmark").select("item_id", T.normalize_ws("text").alias("topic"))
    return b.select("item_id", "topic", F.array_join(T.split_candidates("topic"), "|").alias("candidates"))


SPLIT_SQL = f"""
WITH b AS (SELECT item_id, {ws('text')} AS topic FROM benchmark),
c AS (SELECT item_id, topic, list_filter({tok_topic('topic')}, lambda t: NOT list_contains({STOP_TOPIC}, t)) AS c FROM b),
g AS (SELECT *, list_concat(list_filter([CASE WHEN len(c) >= 2 THEN array_to_string(c[1:2], ' ') END, CASE WHEN len(c) >= 3 THEN array_to_string(c[1:3], ' ') END, CASE WHEN len(c) >= 4 THEN array_to_string(c[1:4], ' ') END], lambda x: x IS NOT NULL),
  list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1])) AS raw FROM c),
u AS (SELECT item_id, topic, c, list_filter(list_transform(range(1, len(raw) + 1), lambda i: struct_pack(i := i, t := raw[i])), lambda x: list_position(raw, x.t) = x.i) AS raw FROM g)
SELECT item_id, topic, array_to_string(list_transform(list_filter(raw, lambda x: x.t <> {lower_ws('topic')} AND len(list_filter(string_split(x.t, ' '), lambda w: length(w) < 2)) = 0), lambda x: x.t)[1:8], '|') AS candidates FROM u
"""


def clean_query(spark, d):
    p = _parts(spark, d)
    made = F.when(F.col("p_size") % 3 == 0, F.col("question")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Find the "), "p_name", F.lit(" of the "), "p_type", F.lit(" range."))).otherwise(F.concat("p_name", F.lit(" and "), "p_type", F.lit(" are here")))
    return p.select("p_partkey", T.clean_query(made).alias("clean"), T.abstract_structure(made).alias("shape"))


CLEAN_SQL = f"""
WITH m AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN question WHEN p_size % 3 = 1 THEN 'Find the ' || p_name || ' of the ' || p_type || ' range.' ELSE p_name || ' and ' || p_type || ' are here' END AS q FROM {_PARTS}),
a AS (SELECT p_partkey, q AS raw, regexp_replace({ws('q')}, '^(query|question|answer)\\s*:\\s*', '', 'i') AS q FROM m),
b AS (SELECT p_partkey, raw, CASE WHEN contains(q, '?') THEN trim(split_part(q, '?', 1)) || '?' ELSE q END AS q FROM a)
SELECT p_partkey, CASE WHEN len(string_split(q, ' ')) < 5 THEN NULL WHEN q LIKE '%?' THEN q WHEN regexp_matches(q, '(?i)^({OPENERS})\\b') THEN rtrim(q, '.,;:') || '?' END AS clean,
  {ws("regexp_replace(regexp_replace(lower(raw), '\\b[0-9]+[.]?[0-9]*\\b', 'NUM', 'g'), '\\b[a-z]{1,2}\\b', 'V', 'g')")} AS shape FROM b
"""


def corpus(spark, d) -> DataFrame:
    """documents as a numbered corpus: doc_idx, first_ord, text."""
    return bm25.number_corpus(bm25.dedup_corpus(_t(spark, d, "documents"), "text", "doc_id"))


CORPUS = f"""corpus AS (
  SELECT row_number() OVER (ORDER BY first_ord) - 1 AS doc_idx, key, first_ord, t AS text FROM (
    SELECT {ws('text')}[:500] AS key, min(doc_id) AS first_ord, arg_min(text, doc_id) AS t FROM documents WHERE trim({ws('text')}) <> '' GROUP BY 1))"""
POSTINGS = f"""toks AS (SELECT doc_idx, {tok_bm25('text')} AS k FROM corpus),
tf AS (SELECT doc_idx, term, count(*) AS tf FROM (SELECT doc_idx, unnest(k) AS term FROM toks) GROUP BY ALL),
dl AS (SELECT doc_idx, len(k) AS dl FROM toks),
st AS (SELECT count(*) AS n, coalesce(sum(dl), 0) / greatest(count(*), 1) AS avgdl FROM dl),
ts AS (SELECT term, count(*) AS df, ln(((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf GROUP BY term)"""


def corpus_dedup(spark, d):
    return corpus(spark, d).select("doc_idx", F.col("first_ord").alias("doc_id"), F.md5("text").alias("text_md5"))


def term_frequency(spark, d):
    return bm25.term_frequency(corpus(spark, d)).select("doc_idx", "term", "tf", F.col("dl").cast("long").alias("dl"))


def corpus_stats(spark, d):
    return bm25.corpus_stats(corpus(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


def idf(spark, d):
    return bm25.Index(corpus(spark, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _queries(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _ranked(df):
    return df.select("qid", "doc_idx", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_topk(spark, d):
    return _ranked(bm25.top_k(bm25.Index(corpus(spark, d)), _queries(spark, d), 10))


def bm25_cap(spark, d):
    return _ranked(bm25.top_k(bm25.Index(corpus(spark, d)), _queries(spark, d), 10, max_candidates=200))


def _scored(source: str, cap: int | None) -> str:
    out = f"""q AS ({source}), qt AS (SELECT qid, term, count(*) AS qtf, min(pos) AS pos FROM (SELECT qid, unnest(k) AS term, unnest(range(len(k))) AS pos FROM (SELECT qid, {tok_bm25('query')} AS k FROM q)) GROUP BY ALL),
s0 AS (SELECT qid, tf.doc_idx, sum(qtf * idf * tf * 2.5 / greatest(tf + 1.5 * (1 - 0.75 + 0.75 * dl / greatest((SELECT avgdl FROM st), 1)), 1e-9)) AS score, min(pos) AS entry
  FROM qt JOIN ts USING (term) JOIN tf USING (term) JOIN dl USING (doc_idx) GROUP BY qid, tf.doc_idx)"""
    if cap is None:
        return out + ", s AS (SELECT * FROM s0)"
    return out + f""", e AS (SELECT qid, entry, coalesce(sum(count(*)) OVER (PARTITION BY qid ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s0 GROUP BY qid, entry),
s AS (SELECT s0.* FROM s0 JOIN e USING (qid, entry) WHERE before < {cap})"""


_Q = "SELECT item_id AS qid, text AS query FROM benchmark"
_RANK = "SELECT qid, doc_idx, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_idx) AS rank FROM s"


def _topk_sql(cap):
    return f"WITH {CORPUS}, {POSTINGS}, {_scored(_Q, cap)} SELECT qid, doc_idx, round(score, 6) AS score, rank FROM ({_RANK}) WHERE rank <= 10"


def hard_negatives(spark, d):
    """The stated query set: whole texts of documents with an id divisible by 20, against all documents."""
    docs = _t(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("text").alias("query"), F.col("text").alias("pos"))
    return _ranked(bm25.hard_negatives(bm25.Index(corpus(spark, d)), docs, top=50, n_neg=12))


_NQ = f"SELECT doc_id AS qid, text AS query, text AS pos FROM documents WHERE doc_id % 20 = 0 AND trim({ws('text')}) <> ''"
NEG_SQL = f"""WITH {CORPUS}, {POSTINGS}, {_scored(_NQ, 50000)}, r AS ({_RANK}),
own AS (SELECT q.qid, c.doc_idx AS own_idx FROM q LEFT JOIN corpus c ON c.key = {ws('q.pos')}[:500]),
f AS (SELECT r.*, row_number() OVER (PARTITION BY r.qid ORDER BY rank) AS k FROM r JOIN own USING (qid) WHERE rank <= 50 AND doc_idx IS DISTINCT FROM own_idx AND score >= 0)
SELECT qid, doc_idx, round(score, 6) AS score, k AS rank FROM f WHERE k <= 12"""

QUERIES = {
    "tokenize_bm25": tokenize(T.tokens_bm25),
    "tokenize_topics": tokenize(T.tokens_topic),
    "tokenize_alnum": tokenize(T.tokens_alnum),
    "normalize_ws": normal(T.normalize_ws, "pages", "page_id", "html"),
    "normalize_compact": normal(T.normalize_compact, "documents", "doc_id", "text"),
    "norm_lower": normal(T.norm_lower, "documents", "doc_id", "text"),
    "truncate_sentence": truncate_sentence,
    "topics_from_keywords": topics,
    "leakage_terms": leakage_terms,
    "keyword_phrases": keyword_phrases,
    "split_candidates": split_candidates,
    "leak_generation": leak_generation,
    "leak_verify_hits": leak_verify_hits,
    "clean_query": clean_query,
    "corpus_dedup": corpus_dedup,
    "term_frequency": term_frequency,
    "corpus_stats": corpus_stats,
    "idf": idf,
    "bm25_topk": bm25_topk,
    "bm25_candidate_cap": bm25_cap,
    "hard_negatives": hard_negatives,
}
ORACLE = {
    "tokenize_bm25": _tokenize_sql(tok_bm25("text")),
    "tokenize_topics": _tokenize_sql(tok_topic("text")),
    "tokenize_alnum": _tokenize_sql(alnum("text")),
    "normalize_ws": _normal_sql(ws("html"), "pages", "page_id"),
    "normalize_compact": _normal_sql(compact("text"), "documents", "doc_id"),
    "norm_lower": _normal_sql(lower_ws("text"), "documents", "doc_id"),
    "truncate_sentence": TRUNCATE_SQL,
    "topics_from_keywords": f"SELECT p_partkey, array_to_string({_THREE}, '|') AS topics FROM part",
    "leakage_terms": f"SELECT p_partkey, array_to_string(list_concat({_THREE}, ['Extra Topic']), '|') AS terms FROM part",
    "keyword_phrases": "SELECT p_partkey, lower(p_name || '|' || p_brand || '|' || p_type) AS phrases FROM part",
    "split_candidates": SPLIT_SQL,
    "leak_generation": LEAK_SQL,
    "leak_verify_hits": HITS_SQL,
    "clean_query": CLEAN_SQL,
    "corpus_dedup": f"WITH {CORPUS} SELECT doc_idx, first_ord AS doc_id, md5(text) AS text_md5 FROM corpus",
    "term_frequency": f"WITH {CORPUS}, {POSTINGS} SELECT doc_idx, term, tf, CAST(dl AS BIGINT) AS dl FROM tf JOIN dl USING (doc_idx)",
    "corpus_stats": f"WITH {CORPUS}, {POSTINGS} SELECT n, round(avgdl, 6) AS avgdl FROM st",
    "idf": f"WITH {CORPUS}, {POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM ts",
    "bm25_topk": _topk_sql(50000),
    "bm25_candidate_cap": _topk_sql(200),
    "hard_negatives": NEG_SQL,
}
