"""Command line: python -m chronoweave etl ... | train ... | evaluate ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronoweave.config import PRESETS, settings
from chronoweave.operators import etl, models, training
from chronoweave.session import scratch
from chronoweave.sources import edges as sources
from chronoweave.sources import sinks


def build(spark: SparkSession, text: str, out: str, header: bool = True, add_reverse: bool = False) -> None:
    """Raw text to edges with dense ids, times from 0, order of time and split: eid, src, dst, time, ext_roll."""
    raw = sources.text_edges(spark, text, header).withColumns({"eid": F.monotonically_increasing_id(), "ext_roll": F.lit(None).cast("int")})
    ordered = etl.positional_split(etl.time_sorted(etl.rebased(etl.reindexed(etl.clean_edges(raw)))))
    named = ordered.withColumn("eid", F.col("row_id")).drop("row_id")
    if add_reverse:
        named = etl.with_reverse(named)
    sinks.write_edges(named.select("eid", "src", "dst", F.col("t").alias("time"), F.col("split").alias("ext_roll")), out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = argparse.ArgumentParser(prog="chronoweave")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("etl", help=build.__doc__)
    p.add_argument("--txt", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--no_header", action="store_true")
    p.add_argument("--add_reverse", action="store_true")
    for name, told in (("train", "weights of an attention model without memory, by the best precision on the validation split"), ("evaluate", "link prediction of a split: ap, auc, mrr, loss")):
        p = sub.add_parser(name, help=told)
        p.add_argument("--edges", required=True)
        p.add_argument("--node_features", help="Parquet of id and f; made from the ids if left out")
        p.add_argument("--edge_features", help="Parquet of eid and f; none if left out")
        p.add_argument("--model_name", choices=sorted(PRESETS), default="TGAT")
        p.add_argument("--neighbor_num", default="10,10", help="per hop, not read by models that sample nothing")
        p.add_argument("--batch_size", type=int, default=2000)
        p.add_argument("--rand_node_features", type=int, default=16)
        p.add_argument("--time_width", type=int, default=100)
        p.add_argument("--out_width", type=int, default=100)
        if name == "train":
            p.add_argument("--out", required=True, help="where the weights go")
            p.add_argument("--epochs", type=int, default=10)
            p.add_argument("--steps", type=int, default=1, help="steps an epoch")
            p.add_argument("--rate", type=float, default=0.0001)
            p.add_argument("--dropout", type=float, default=0.1)
        else:
            p.add_argument("--weights", help="as train wrote them; the initial ones if left out")
            p.add_argument("--use_inductive", action="store_true")
            p.add_argument("--eval_neg_samples", type=int, default=1)
            p.add_argument("--split", type=int, default=1)
    a = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("chronoweave").getOrCreate()
    if a.command == "etl":
        build(spark, a.txt, a.out, not a.no_header, a.add_reverse)
        return
    with scratch(spark):
        edges = etl.clean_edges(sources.parquet_edges(spark, a.edges))
        if a.node_features:
            nodes = sources.features(spark, a.node_features, "id")
        else:
            made = etl.synthetic_features(etl.nodes_of(edges), "node", a.rand_node_features, 42)
            nodes = made.groupBy(F.col("node").alias("id")).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_f")).select("id", F.transform("_f", lambda x: x["value"]).alias("f"))
        near = sources.features(spark, a.edge_features, "eid") if a.edge_features else spark.createDataFrame([], "eid long, f array<float>")
        width = lambda df: (df.select(F.size("f").alias("n")).first() or [0])[0]
        hops = tuple(int(x) for x in a.neighbor_num.split(",")) if PRESETS[a.model_name].fanout else ()
        common = dict(neighbors=hops, widths=(a.time_width, a.out_width), batch_rows=a.batch_size)
        if a.command == "train":
            run, timers = settings(a.model_name, **common, epochs=a.epochs, rate=a.rate, dropout=a.dropout), training.StageTimers()
            weights, told = training.train(edges, nodes, near, run, width(nodes), width(near), steps=a.steps, timers=timers)
            sinks.write_weights(spark, {f"{m}/{k}": x for m, v in weights.items() for k, x in v.items()}, a.out)
            training.metrics_table(spark, told, timers).orderBy("epoch", "name").show(1000, truncate=False)
            return
        run = settings(a.model_name, **common, inductive=a.use_inductive, eval_negatives=a.eval_neg_samples)
        weights: models.Models | None = None
        if a.weights:
            weights = {}
            for name, x in sinks.read_weights(spark, a.weights).items():
                weights.setdefault(name.split("/")[0], {})[name.split("/")[1]] = x
        models.evaluate(edges, a.split, nodes, near, run, width(nodes), width(near), weights=weights).show()


if __name__ == "__main__":
    main()
