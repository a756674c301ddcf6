"""Ranking metrics of link prediction per batch. scored: batch, edge_pos, label (1 true, 0 negative), score, without nulls and NaN."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators import nn


def _by_score(scored: DataFrame) -> DataFrame:
    """Per batch and distinct score the numbers of positives and negatives; ties so fall together."""
    pos = F.sum((F.col("label") == 1).cast("long"))
    return scored.groupBy("batch", "score").agg(pos.alias("p"), (F.count(F.lit(1)) - pos).alias("n"))


def average_precision(scored: DataFrame) -> DataFrame:
    """batch, ap: sum of precision times gain of recall over the distinct scores, best first. Null without positives."""
    w = Window.partitionBy("batch").orderBy(F.col("score").desc())
    every = Window.partitionBy("batch")
    s = _by_score(scored).withColumns({"tp": F.sum("p").over(w), "all": F.sum(F.col("p") + F.col("n")).over(w), "_p": F.sum("p").over(every)})
    return s.groupBy("batch").agg(F.sum(F.when(F.col("_p") > 0, F.col("p") / F.col("_p") * (F.col("tp") / F.col("all")))).alias("ap"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """batch, auc: the share of pairs of a positive and a negative in right order, ties half. Null without either."""
    w = Window.partitionBy("batch").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    s = _by_score(scored).withColumn("_below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    good = F.sum(F.col("p") * (F.col("_below") + F.col("n") / 2.0))
    both = F.sum("p") * F.sum("n")
    return s.groupBy("batch").agg(F.when(both > 0, good / F.nullif(both, F.lit(0))).alias("auc"))


def reciprocal_ranks(scored: DataFrame) -> DataFrame:
    """batch, edge_pos, rr = 1 / (1 + negatives of the edge that score strictly higher); the best score of several positives counts."""
    top = scored.filter("label = 1").groupBy("batch", "edge_pos").agg(F.max("score").alias("_s"))
    above = top.join(scored.filter("label = 0"), ["batch", "edge_pos"], "left").groupBy("batch", "edge_pos").agg(F.sum(F.when(F.col("score") > F.col("_s"), 1).otherwise(0)).alias("_n"))
    return above.select("batch", "edge_pos", (1.0 / (1 + F.col("_n"))).alias("rr"))


def losses(scored: DataFrame) -> DataFrame:
    """batch, loss: mean over positives plus mean over negatives of the logistic loss."""
    loss = nn.bce_with_logits(F.col("label"), F.col("score"))
    one = lambda y: F.avg(F.when(F.col("label") == y, loss))
    return scored.groupBy("batch").agg((one(1) + one(0)).alias("loss"))


def summary(scored: DataFrame) -> DataFrame:
    """One row: means over batches of ap and auc, over edges of rr, the sum of losses."""
    per = average_precision(scored).join(roc_auc(scored), "batch").join(losses(scored), "batch").agg(F.avg("ap").alias("ap"), F.avg("auc").alias("auc"), F.sum("loss").alias("loss"))
    return per.withColumn("mrr", reciprocal_ranks(scored).agg(F.avg("rr")).scalar())


def best_epoch(per_epoch: DataFrame, first: int = 3) -> DataFrame:
    """The epoch (from `first` on) with the greatest ap, the earliest of equals: epoch, ap."""
    return per_epoch.filter(F.col("epoch") >= first).orderBy(F.col("ap").desc(), "epoch").limit(1).select("epoch", "ap")


def footprint(n_rows: int, width: int) -> int:
    """Bytes of a feature matrix of float32."""
    return n_rows * width * 4
