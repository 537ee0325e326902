"""One-hop neighbourhoods over knowledge-graph tables.

entity (qid, label, description, aliases, missing), search (text_norm, qid,
match_type, rank) and claim (src, prop, claim_ord, value_type, dst) stand for a
remote graph; every lookup is a join, distinct topics are resolved once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querykiln.functions.text import norm_lower, normalize_compact, split_candidates, tokens_alnum

# Property codes, names and phrases (outgoing, incoming).
FORWARD = ("P31", "P279", "P361", "P527", "P1269", "P460", "P2579")
REVERSE = ("P279", "P31", "P361", "P527", "P1269", "P2579")
PROPERTY_NAMES = {"P31": "instance of", "P279": "subclass of", "P361": "part of", "P1269": "facet of", "P366": "has use", "P527": "has part", "P1542": "has effect", "P828": "has cause", "P2283": "uses"}
PHRASES = {
    "P31": ("is an instance of", "has instance"),
    "P279": ("is a subclass of", "has subclass"),
    "P361": ("is part of", "includes"),
    "P1269": ("is a facet of", "has facet"),
    "P366": ("is used for", "uses"),
    "P527": ("has part", "is part of"),
    "P1542": ("has effect", "is an effect of"),
    "P828": ("has cause", "causes"),
    "P2283": ("uses", "is used by"),
}
TAXONOMY, NOISY = ("P31", "P279"), ("P366",)


def _lookup(code, table: dict, default) -> Column:
    out = default
    for k, v in table.items():
        out = F.when(F.col(code) == k, v).otherwise(out)
    return out


def seeds(texts: DataFrame, search: DataFrame, limit: int = 8) -> DataFrame:
    """texts (text) to (text, qid): the first label or alias hit among the best ``limit``."""
    limit = min(50, max(1, limit))
    hits = search.where((F.col("rank") <= limit) & F.col("match_type").isin("label", "alias")).groupBy("text_norm").agg(F.min(F.struct("rank", "qid")).alias("b")).select("text_norm", F.col("b.qid").alias("qid"))
    asked = texts.select("text").distinct().withColumn("text_norm", norm_lower("text"))
    return asked.where("text_norm <> ''").join(hits, "text_norm").select("text", "qid")


def _props(spark, props) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(p, i) for i, p in enumerate(props)], "prop string, prop_ord int"))


def neighbours(seed: DataFrame, claim: DataFrame, props=FORWARD, most: int = 80) -> DataFrame:
    """(seed, prop, dst, pair_ord): distinct pairs in order of property, then claim, at most ``most``."""
    c = claim.where((F.col("value_type") == "item") & (F.coalesce("dst", F.lit("")) != "")).join(_props(claim.sparkSession, props), "prop")
    pairs = c.join(seed.select(F.col("qid").alias("seed")).distinct(), F.col("src") == F.col("seed")).groupBy("seed", "prop", "dst").agg(F.min(F.struct("prop_ord", "claim_ord")).alias("o"))
    w = W.partitionBy("seed").orderBy("o", "dst")
    return pairs.withColumn("pair_ord", F.row_number().over(w)).where(F.col("pair_ord") <= most).select("seed", "prop", "dst", "pair_ord")


def _present(entity: DataFrame) -> DataFrame:
    return entity.where("qid is not null and not coalesce(missing, false)")


def nodes(seed: DataFrame, near: DataFrame, entity: DataFrame) -> DataFrame:
    """(seed, qid, label, description, aliases, node_ord): the seed first, then its neighbours once each."""
    ids = near.groupBy("seed", F.col("dst").alias("qid")).agg(F.min("pair_ord").alias("node_ord"))
    own = seed.select(F.col("qid").alias("seed"), "qid", F.lit(0).alias("node_ord")).distinct()
    both = own.unionByName(ids.where("seed <> qid"))
    return both.join(_present(entity).select("qid", "label", "description", "aliases"), "qid")


def edges(seed: DataFrame, near: DataFrame, node: DataFrame, claim: DataFrame, reverse=REVERSE) -> DataFrame:
    """(seed, src, prop, dst, direction, edge_ord): out to fetched nodes, then in from fetched neighbours."""
    known = node.select("seed", F.col("qid").alias("dst"))
    out = near.join(known, ["seed", "dst"], "left_semi").select("seed", F.col("seed").alias("src"), "prop", "dst", F.lit("outgoing").alias("direction"), F.struct(F.lit(0).alias("a"), F.col("pair_ord").alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d")).alias("edge_ord"))
    back = claim.where("value_type = 'item'").join(_props(claim.sparkSession, reverse), "prop")
    inc = node.where("node_ord > 0").select("seed", F.col("qid").alias("src"), "node_ord").join(back, "src").where(F.col("dst") == F.col("seed"))
    inc = inc.select("seed", "src", "prop", "dst", F.lit("incoming").alias("direction"), F.struct(F.lit(1).alias("a"), F.col("node_ord").alias("b"), F.col("prop_ord").alias("c"), F.col("claim_ord").cast("int").alias("d")).alias("edge_ord"))
    return out.unionByName(inc)


def packed(node: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seed, nodes) and (seed, edges): per seed its nodes and edges as arrays, in order."""
    nodes_ = node.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_ord", "qid", "label", "description", "aliases"))), lambda n: n.dropFields("node_ord")).alias("nodes"))
    edges_ = edge.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_ord", "src", "prop", "dst", "direction"))), lambda e: e.dropFields("edge_ord")).alias("edges"))
    return nodes_, edges_


def attempts(topics: DataFrame, budget: int = 8) -> DataFrame:
    """topics (row_uid, topic_ord, topic) to search texts: the topic, then its split candidates."""
    texts = F.concat(F.array("topic"), split_candidates("topic", budget))
    return topics.select("row_uid", "topic_ord", "topic", F.posexplode(texts).alias("attempt_ord", "text"))


def subgraphs(topics: DataFrame, entity: DataFrame, search: DataFrame, claim: DataFrame, min_edges: int = 1, budget: int = 8, most: int = 80, props=FORWARD, reverse=REVERSE) -> DataFrame:
    """(row_uid, topic_ord, topic, status, seed, refined, chosen_text, n_attempts, num_nodes, num_edges).

    Each topic takes its first attempt that is ok; if none is, the first attempt's
    status stands. A blank topic has the status no_topic.
    """
    tries = attempts(topics.where("trim(topic) <> ''"), budget)
    found = seeds(tries, search)
    seed = found.select("qid").distinct()
    near = neighbours(seed, claim, props, most)
    node = nodes(seed, near, entity)
    n_nodes = node.groupBy("seed").agg(F.count(F.lit(1)).alias("num_nodes"), F.max((F.col("node_ord") == 0).cast("int")).alias("has_seed"))
    n_edges = edges(seed, near, node, claim, reverse).groupBy("seed").agg(F.count(F.lit(1)).alias("num_edges"))
    known = seed.withColumnRenamed("qid", "seed").join(n_nodes, "seed", "left").join(n_edges, "seed", "left")
    joined = tries.join(found.withColumnRenamed("qid", "seed"), "text", "left").join(known, "seed", "left")
    edges_n = F.coalesce("num_edges", F.lit(0))
    status = F.when(F.col("seed").isNull(), "no_candidate").when(F.coalesce("has_seed", F.lit(0)) == 0, "seed_missing").when(edges_n < min_edges, "too_few_edges").otherwise("ok")
    one = F.struct("attempt_ord", "text", status.alias("status"), "seed", F.coalesce("num_nodes", F.lit(0)).alias("num_nodes"), edges_n.alias("num_edges"))
    best = joined.select("row_uid", "topic_ord", "topic", one.alias("t")).groupBy("row_uid", "topic_ord", "topic").agg(F.min(F.when(F.col("t.status") == "ok", F.col("t"))).alias("won"), F.min("t").alias("first"), F.count(F.lit(1)).alias("all"))
    t = F.coalesce("won", "first")
    out = best.select("row_uid", "topic_ord", "topic", t["status"].alias("status"), F.when(F.col("won").isNotNull(), F.col("won.seed")).alias("seed"), (F.coalesce(F.col("won.attempt_ord"), F.lit(0)) > 0).alias("refined"), F.col("won.text").alias("chosen_text"), F.coalesce(F.col("won.attempt_ord") + 1, F.col("all")).cast("long").alias("n_attempts"), F.coalesce(F.col("won.num_nodes"), F.lit(0)).cast("long").alias("num_nodes"), F.coalesce(F.col("won.num_edges"), F.lit(0)).cast("long").alias("num_edges"))
    none = topics.where("trim(topic) = ''").select("row_uid", "topic_ord", "topic", F.lit("no_topic").alias("status"), F.lit(None).cast("string").alias("seed"), F.lit(False).alias("refined"), F.lit(None).cast("string").alias("chosen_text"), F.lit(0).cast("long").alias("n_attempts"), F.lit(0).cast("long").alias("num_nodes"), F.lit(0).cast("long").alias("num_edges"))
    return out.unionByName(none)


def relations(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(seed, qid, label, relation, arrow) of every labelled neighbour, by its first edge with the seed."""
    code = F.col("prop")
    named = _lookup("prop", PROPERTY_NAMES, code)
    e = edge.withColumn("qid", F.when(F.col("src") == F.col("seed"), F.col("dst")).otherwise(F.col("src")))
    e = e.withColumn("relation", F.when(F.col("src") == F.col("seed"), _lookup("prop", {k: v[0] for k, v in PHRASES.items()}, named)).otherwise(_lookup("prop", {k: v[1] for k, v in PHRASES.items()}, named)))
    e = e.withColumn("arrow", F.when(F.col("src") == F.col("seed"), "→").otherwise("←"))
    first = e.groupBy("seed", "qid").agg(F.min(F.struct("edge_ord", "relation", "arrow")).alias("r"))
    return node.where("node_ord > 0 and trim(coalesce(label, '')) <> ''").join(first, ["seed", "qid"], "left").select("seed", "qid", F.trim("label").alias("label"), F.coalesce("r.relation", F.lit("related to")).alias("relation"), F.coalesce("r.arrow", F.lit("↔")).alias("arrow"))


def sample_neighbours(rel: DataFrame, k: int = 2, seed: int = 0) -> DataFrame:
    """``k`` neighbours of each seed, picked by a hash (md5) of the ids: the same ones in every run, order and engine."""
    w = W.partitionBy("seed").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "seed", "qid")), "qid")
    return rel.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def useful_edges(edge: DataFrame, label: DataFrame, most: int = 8) -> DataFrame:
    """edge (row_uid, edge_ord, src, prop, dst, pos) to the edges worth showing, by overlap with the text.

    Taxonomic edges need two shared words, noisy ones a shared word of the target.
    Pairs of equal compact labels are one; at most ``most`` a row.
    """
    names = lambda c: label.select(F.col("qid").alias(c), F.col("label").alias(f"{c}_label"))
    e = edge.join(names("src"), "src", "left").join(names("dst"), "dst", "left").withColumns({"src_label": F.coalesce("src_label", "src"), "dst_label": F.coalesce("dst_label", "dst")})
    pos = tokens_alnum("pos")
    e = e.withColumns({"overlap": F.size(F.array_intersect(F.array_union(tokens_alnum("src_label"), tokens_alnum("dst_label")), pos)), "dst_overlap": F.size(F.array_intersect(tokens_alnum("dst_label"), pos))})
    e = e.where(~(F.col("prop").isin(*TAXONOMY) & (F.col("overlap") < 2)) & ~(F.col("prop").isin(*NOISY) & (F.col("dst_overlap") < 1)))
    pair = W.partitionBy("row_uid", normalize_compact("src_label"), normalize_compact("dst_label")).orderBy(F.desc("overlap"), "edge_ord")
    row = W.partitionBy("row_uid").orderBy(F.desc("overlap"), "edge_ord")
    once = e.withColumn("_p", F.row_number().over(pair)).where("_p = 1")
    return once.withColumn("rank", F.row_number().over(row)).where(F.col("rank") <= most).select("row_uid", "rank", "prop", F.col("src_label").alias("src"), F.col("dst_label").alias("dst"), _lookup("prop", PROPERTY_NAMES, F.col("prop")).alias("label"), "overlap")


def entity_text(entity: DataFrame, lang: str = "en") -> DataFrame:
    """Label, description and aliases of one language; aliases normalised, distinct, without blanks."""
    from querykiln.functions.text import normalize_ws

    own = entity.where(F.col("lang") == lang) if "lang" in entity.columns else entity
    clean = F.array_distinct(F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), normalize_ws), lambda a: a != ""))
    return own.withColumn("aliases", clean)
