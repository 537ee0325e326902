"""Stages on the command line: python -m querykiln {keys,subgraph,synth,verify,mine} ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from querykiln.functions import text as T
from querykiln.operators import graph, selection, stages
from querykiln.sources import jsonl
from querykiln.sources.providers import TableProvider


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="querykiln")
    sub = p.add_subparsers(dest="stage", required=True)

    def stage(name: str, *needs: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for n in ("input", "output", *needs):
            s.add_argument(f"--{n}", required=True)
        s.add_argument("--max-rows", type=int, default=0)
        return s

    s = stage("keys", "responses")
    s.add_argument("--source", choices=("math", "bright"), default="math")
    s = stage("subgraph", "entity", "search", "claim")
    s.add_argument("--max-topics", type=int, default=5)
    s.add_argument("--max-neighbors", type=int, default=80)
    s.add_argument("--min-edges", type=int, default=1)
    s.add_argument("--split-budget", type=int, default=8)
    s.add_argument("--props", default=",".join(graph.FORWARD), help="codes of outgoing properties, by comma")
    s.add_argument("--rev-props", default=",".join(graph.REVERSE))
    s.add_argument("--lang", help="of labels, where the entity table has a lang column")
    s.add_argument("--attach-mode", choices=("augment", "subgraph_only"), default="augment")
    s = stage("synth", "responses")
    s.add_argument("--max-retries", type=int, default=2)
    s.add_argument("--extra-nodes", type=int, default=2, help="sampled neighbours a subgraph")
    s.add_argument("--node-sample-seed", type=int, default=0)
    s.add_argument("--max-edges", type=int, default=8)
    s = stage("verify", "responses")
    s.add_argument("--max-candidates", type=int, default=5)
    s.add_argument("--kw-weight", type=float, default=0.2)
    s.add_argument("--conn-weight", type=float, default=0.8)
    for k, v in selection.POLICY.items():
        s.add_argument(f"--{k.replace('_', '-')}", type=int, default=v)
    s = stage("mine")
    s.add_argument("--corpus")
    s.add_argument("--top-k", type=int, default=50)
    s.add_argument("--n-neg", type=int, default=12)
    s.add_argument("--min-neg-score", type=float, default=0.0)
    s.add_argument("--max-candidates", type=int, default=50_000)
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    def rows(path: str):
        mode = "FAILFAST" if args.stage == "verify" else "DROPMALFORMED"  # a judged run must not skip rows in silence
        return jsonl.head(jsonl.numbered(jsonl.placed(spark.read.json(path, mode=mode))), args.max_rows)

    table = lambda path: spark.read.parquet(path)
    mode = "overwrite"
    if args.stage == "keys":
        made = jsonl.records(jsonl.head(jsonl.read_jsonl(spark, args.input), args.max_rows), args.source)
        out = stages.keys(made.where("error is null").drop("error"), TableProvider(table(args.responses)))
    elif args.stage == "subgraph":
        entity = graph.entity_text(table(args.entity), args.lang) if args.lang else table(args.entity)
        codes = lambda given: tuple(dict.fromkeys(p for p in (T.property_code(x) for x in given.split(",")) if p))
        got = stages.subgraphs(rows(args.input), entity, table(args.search), table(args.claim), args.max_topics, min_edges=args.min_edges, budget=args.split_budget, most=args.max_neighbors, props=codes(args.props), reverse=codes(args.rev_props))
        out = got if args.attach_mode == "augment" else jsonl.attach(got, args.attach_mode).withColumn("row_ord", F.monotonically_increasing_id())
    elif args.stage == "synth":
        out = stages.synthesize(rows(args.input), TableProvider(table(args.responses)), retries=args.max_retries, extra=args.extra_nodes, seed=args.node_sample_seed, most=args.max_edges)
    elif args.stage == "verify":
        mode, todo = "append", jsonl.with_uid(rows(args.input))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(args.output)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            todo = jsonl.unprocessed(todo, jsonl.processed_uids(spark, args.output))
        policy = {k: getattr(args, k) for k in selection.POLICY}
        out = stages.verify(todo, TableProvider(table(args.responses)), args.max_candidates, policy, kw_weight=args.kw_weight, conn_weight=args.conn_weight)
    else:
        corpus = rows(args.corpus) if args.corpus else None
        out = stages.mine(rows(args.input), corpus, top=args.top_k, n_neg=args.n_neg, min_score=args.min_neg_score, max_candidates=args.max_candidates)
    jsonl.write_jsonl(out, args.output, mode=mode)


if __name__ == "__main__":
    made = parser().parse_args()
    run(SparkSession.builder.appName("querykiln").getOrCreate(), made)
