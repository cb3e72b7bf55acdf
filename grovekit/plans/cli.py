"""spark-submit entry points: ``cluster POINTS TREE`` and ``score TREE``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from grovekit.operators import evaluate, online, tree
from grovekit.sources import files


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="grovekit")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("cluster", help="insert points in file order and write the tree")
    c.add_argument("points")
    c.add_argument("tree")
    c.add_argument("--results", help="folder for the running time and comparison counts")
    c.add_argument("--algorithm", default="online")
    c.add_argument("--dataset", default="None")
    c.add_argument("--linkage", choices=["cosine", "average"], default="cosine")
    for name in ("k", "rotate-cap", "graft-cap", "restructure-cap", "max-leaves", "max-grafts", "batch"):
        c.add_argument(f"--{name}", type=int)
    for name in ("rotate", "graft", "restructure", "single-search", "single-elimination"):
        c.add_argument(f"--{name}", action=argparse.BooleanOptionalAction)
    s = sub.add_parser("score", help="dendrogram purity of a tree")
    s.add_argument("tree")
    s.add_argument("--ids", help="file of the leaves whose pairs count")
    s.add_argument("--strict", action="store_true")
    s.add_argument("--algorithm", default="online")
    s.add_argument("--dataset", default="None")
    return top


def main(args: list[str], spark: SparkSession | None = None) -> float | None:
    """Runs a command; ``score`` also returns the purity."""
    o = _parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("grovekit").getOrCreate()
    if o.command == "cluster":
        given = {n: getattr(o, n) for n in ("k", "rotate_cap", "graft_cap", "restructure_cap", "max_leaves", "max_grafts", "batch", "rotate", "graft", "restructure", "single_search", "single_elimination")}
        config = online.ClusterConfig(linkage=o.linkage, **{n: v for n, v in given.items() if v is not None})
        points = files.read_points(spark, o.points)
        began = time.time()
        built = online.build(points, config).select(F.coalesce("pid", F.concat(F.lit("node-"), F.col("node").cast("string"))).alias("name"), "node", "parent", "label").persist()
        names = built.select(F.col("node").alias("parent"), F.col("name").alias("above"))
        files.write_tree(built.join(names, "parent", "left").select(F.col("name").alias("node"), F.col("above").alias("parent"), "label"), o.tree)
        built.unpersist()
        if o.results:
            files.write_result(spark, f"{o.results}/running_time", o.algorithm, o.dataset, round(time.time() - began, 3))
            made = online.run_statistics(points, config).where("name = 'comparisons'").agg(F.sum("value")).first()[0]
            files.write_result(spark, f"{o.results}/comparisons", o.algorithm, o.dataset, float(made or 0))
        return None
    nodes = files.read_tree(spark, o.tree)
    only = files.read_ids(spark, o.ids).withColumnRenamed("pid", "node") if o.ids else None
    purity = evaluate.dendrogram_purity(nodes, tree.closure(nodes), tree.leaves(nodes), o.strict, only).first()[0]
    print(f"{o.algorithm}\t{o.dataset}\t{purity}")
    return purity


if __name__ == "__main__":
    main(sys.argv[1:])
