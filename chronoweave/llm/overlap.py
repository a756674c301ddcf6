"""Same or near-same records across splits: a weighted cosine join between training and evaluation rows.

A row of the edge table is a sparse unit vector over four terms: its two nodes, and its node pair at the two time anchors around its time
(anchors lie `width` apart; the row's place between them parts the weight as cosine and sine). A term weighs the more bits the rarer it is:
log2(1 + rows / rows with the term), counted over all rows by sketches of bounded memory. A pair is never more frequent than its nodes, so
its anchors outweigh them. Rows of one pair have vectors of one shape; those at most `within` apart have a cosine of at least
nodes + (1 - nodes) * cos(pi * within / (2 * width)), where nodes is the nodes' share of the squared norm: the threshold of the pair.

- Residual-norm pruning: terms are taken from the rarest on, and a training row is entered in the inverted lists of so many of them that what
  is left over has a norm below the threshold and can't reach it alone. That is one anchor, or both where `within` is large, and never
  a node (the nodes' share is at most 2/3, the threshold at least 0.9), so the lists of hot nodes, a tenth of all rows, aren't made.
- Maximum-weight pruning: a term of an evaluation row is looked up only if with some weight a list of its pair can hold, and rests that
  agree entirely, the threshold could be reached; and each list, knowing its least and greatest weight, turns away what can't reach it with those.
- Exact dot products of the candidates are held against the threshold; a last check compares the times themselves, as the place of two rows
  between their anchors moves the cosine a little.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.session import written

SPLITS = {0: "train", 1: "val", 2: "test"}
SHARE = 0.001  # lists with at least this share of a side's rows are split; there can't be more than 1 / SHARE of them
LEAST_ROWS = 1000
SALTS = 32
TRACKED = 20_000
_MARGIN = 1e-9
_LIST = ["lo", "hi", "anchor", "_i", "_j"]


def _records(edges: DataFrame, width: int) -> DataFrame:
    """Rows without nulls in pair, time or split, with the pair in order and the place in time as cell and rest."""
    e = edges.select(F.col("eid").cast("long").alias("eid"), F.col("src").cast("long").alias("_s"), F.col("dst").cast("long").alias("_d"), F.col("time").cast("long").alias("t"), F.col("ext_roll").cast("int").alias("split"), F.col("source").cast("string").alias("source"))
    e = e.filter("_s is not null and _d is not null and t is not null and split in (0, 1, 2)")
    return _placed(e.select("eid", F.least("_s", "_d").alias("lo"), F.greatest("_s", "_d").alias("hi"), "t", "split", "source"), width)


def _placed(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumns({"cell": F.expr(f"t div {width} - if(t % {width} < 0, 1, 0)"), "rest": F.expr(f"pmod(t, {width})").cast("int")})


def _statistics(rec: DataFrame, width: int, least_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, int, int, int]:
    """Weights' counts of nodes (node, _c) and pairs (_pair, _c) and the long lists (_term, _train, _other), with the number of rows and the
    counts of terms outside: one pass over all rows. What comes to the driver is bounded by the sketches, 1 / SHARE entries each.
    """
    most = round(1 / SHARE)
    term = lambda at: f"xxhash64(lo, hi, cell + {at})"
    asked = {"lo": "lo", "hi": "hi", "pair": "xxhash64(lo, hi)", "train": f"if(split = 0, {term(f'if(rest * 2 > {width}, 1, 0)')}, null)", "other_0": f"if(split > 0, {term(0)}, null)", "other_1": f"if(split > 0, {term(1)}, null)"}
    got = rec.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == 0).alias("n_train"), *(F.expr(f"approx_top_k({x}, {most}, {TRACKED})").alias(k) for k, x in asked.items())).first()
    top = {k: {x["item"]: x["count"] for x in got[k] or [] if x["item"] is not None} for k in asked}
    floor = lambda d: min(d.values()) if len(d) >= most else 1
    nodes = {k: top["lo"].get(k, 0) + top["hi"].get(k, 0) for k in {*top["lo"], *top["hi"]}}
    long = {"_train": {k for k, c in top["train"].items() if c >= max(SHARE * got["n_train"], least_rows)}}
    long["_other"] = {k for d in ("other_0", "other_1") for k, c in top[d].items() if c >= max(SHARE * (got["n"] - got["n_train"]), least_rows)}
    make = rec.sparkSession.createDataFrame
    lists = make([(k, k in long["_train"], k in long["_other"]) for k in long["_train"] | long["_other"]], "_term long, _train boolean, _other boolean")
    return make(list(nodes.items()), "node long, _c long"), make(list(top["pair"].items()), "_pair long, _c long"), lists, got["n"], max(floor(top["lo"]), floor(top["hi"])), floor(top["pair"])


def _weighted(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, other_node: int, other_pair: int) -> DataFrame:
    """Add nodes, the share of a row's two node terms in its squared norm; the rest is that of its anchors."""
    of = lambda c, name: F.broadcast(nodes.select(F.col("node").alias(c), F.col("_c").alias(name)))
    j = rows.join(of("lo", "_l"), "lo", "left").join(of("hi", "_h"), "hi", "left").withColumn("_pair", F.xxhash64("lo", "hi")).join(F.broadcast(pairs), "_pair", "left")
    low, high = F.coalesce("_l", F.lit(other_node)), F.coalesce("_h", F.lit(other_node))
    bits = lambda c: F.log2(1 + F.lit(float(n)) / c)
    square = lambda x: x * x
    ends = square(bits(low)) + square(bits(high))
    return j.withColumn("nodes", ends / (ends + square(bits(F.least(F.coalesce("_c", F.lit(other_pair)), low, high))))).drop("_l", "_h", "_c", "_pair")


def _threshold(width: int, within: int) -> Column:
    return F.col("nodes") + (1 - F.col("nodes")) * math.cos(math.pi * within / (2 * width)) - _MARGIN


def _terms(width: int) -> tuple[Column, Column]:
    """The heavier and the lighter anchor of a row (anchor, w)."""
    turn = F.col("rest") * (math.pi / (2 * width))
    size = F.sqrt(1 - F.col("nodes"))
    low, high = F.struct(F.col("cell").alias("anchor"), (size * F.cos(turn)).alias("w")), F.struct((F.col("cell") + 1).alias("anchor"), (size * F.sin(turn)).alias("w"))
    later = F.col("rest") * 2 > width
    return F.when(later, high).otherwise(low), F.when(later, low).otherwise(high)


def _entered(train: DataFrame, width: int, within: int) -> DataFrame:
    """Entries of the inverted lists (anchor, w) with first, the row's heaviest anchor: as many terms as the residual norm asks for."""
    heavy, light = _terms(width)
    left_over = 1 - heavy["w"] * heavy["w"]
    need = F.when(left_over < _threshold(width, within) * _threshold(width, within), F.array(heavy)).otherwise(F.array(heavy, light))
    return train.withColumn("first", heavy["anchor"]).withColumn("_e", F.explode(need)).select("*", "_e.anchor", "_e.w").drop("_e")


def _bound(w: Column, least: Column, most: Column) -> Column:
    """The greatest dot product of unit vectors that share a term of weight w here and from least to most there."""
    at = F.greatest(least, F.least(most, w))
    rest = lambda x: F.sqrt(F.greatest(1 - x * x, F.lit(0.0)))
    return w * at + rest(w) * rest(at)


def _looked_up(rows: DataFrame, width: int, within: int) -> DataFrame:
    """The terms of evaluation rows (anchor, w) that can reach the threshold with a weight that lists of their pair can hold."""
    size = F.sqrt(1 - F.col("nodes"))
    most_lists = 1 - (1 - F.col("nodes")) / 2  # what a heaviest anchor leaves over at most
    least = F.when(most_lists < _threshold(width, within) * _threshold(width, within), size / math.sqrt(2)).otherwise(F.lit(0.0))
    can = F.filter(F.array(*_terms(width)), lambda x: _bound(x["w"], least, size) >= _threshold(width, within))
    return rows.withColumn("_e", F.explode(can)).select("*", "_e.anchor", "_e.w").drop("_e")


def _cosine(width: int) -> Column:
    """Dot product of two rows of one pair, from their cells and rests."""
    half = math.pi / (2 * width)
    a, b, d = F.col("a.rest") * half, F.col("b.rest") * half, F.col("b.cell") - F.col("a.cell")
    anchors = F.when(d == 0, F.cos(a) * F.cos(b) + F.sin(a) * F.sin(b)).when(d == 1, F.sin(a) * F.cos(b)).when(d == -1, F.cos(a) * F.sin(b)).otherwise(0.0)
    return F.col("a.nodes") + (1 - F.col("a.nodes")) * anchors


def candidates(rec: DataFrame, train: DataFrame, other: DataFrame, within: int, width: int, by: str, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Pairs (a of train, b of other) that pruning leaves over, each once, with dot, their exact dot product, and least, the threshold.

    A list that is long on the training side is split by a hash of column `by` of its rows, one that is asked for by many evaluation rows by
    a hash of theirs; the other side is repeated per part. Long lists are those of the sketches, so they may be broadcast.
    """
    nodes, pairs, long, *counts = _statistics(rec, width, least_rows)

    def parted(rows: DataFrame, mine: str, my_part: str, theirs: str, their_part: str) -> DataFrame:
        every = F.sequence(F.lit(0), F.lit(SALTS - 1))
        j = rows.withColumn("_term", F.xxhash64("lo", "hi", "anchor")).join(F.broadcast(long), "_term", "left")
        part = F.when(F.col(mine), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")
        return j.withColumn(my_part, part).withColumn(their_part, F.explode(F.when(F.col(theirs), every).otherwise(F.array(F.lit(0))))).drop("_term", "_train", "_other")

    of_list = Window.partitionBy(*_LIST)
    lists = parted(_entered(_weighted(train, nodes, pairs, *counts), width, within), "_train", "_i", "_other", "_j").withColumns({"least_w": F.min("w").over(of_list), "most_w": F.max("w").over(of_list)})
    asked = parted(_looked_up(_weighted(other, nodes, pairs, *counts).withColumn("least", _threshold(width, within)), width, within), "_other", "_j", "_train", "_i")
    a, b = lists.alias("a"), asked.alias("b")
    can = _bound(F.col("b.w"), F.col("a.least_w"), F.col("a.most_w")) >= F.col("b.least")
    once = (F.col("a.anchor") == F.col("a.first")) | ~(F.col("a.first") - F.col("b.cell")).isin(0, 1)
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in _LIST]).filter(can & once)
    return met.withColumn("dot", _cosine(width))


def _join(rec: DataFrame, train: DataFrame, other: DataFrame, within: int, width: int, by: str, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The candidates whose dot product reaches the threshold and whose times are at most `within` apart."""
    met = candidates(rec, train, other, within, width, by, least_rows)
    return met.filter(F.col("dot") >= F.col("b.least")).filter(F.abs(F.col("a.t") - F.col("b.t")) <= within)


def cross_split_pairs(edges: DataFrame, within: int = 3, least_rows: int = LEAST_ROWS) -> DataFrame:
    """All pairs of one training row and one evaluation row that join the same two nodes at most `within` time units apart.

    Columns: train_eid, eval_eid, split (of the evaluation row), train_source, source, gap (time of the evaluation row less that
    of the training row), score (exact dot product). Direction of the edge plays no part; loops join a node with itself.
    Rows with a null in src, dst, time or ext_roll, or another ext_roll than 0, 1, 2, are left out; a null source stays null.
    Repeated rows under eids of their own are rows of their own. Extra columns are ignored; empty input gives no pairs. Lists of fewer
    than least_rows rows aren't split.
    """
    width = 2 * (within + 1)
    rec = _records(edges, width)
    pairs = _join(rec, rec.filter("split = 0").drop("split"), rec.filter("split > 0"), within, width, "eid", least_rows)
    return pairs.select(F.col("a.eid").alias("train_eid"), F.col("b.eid").alias("eval_eid"), F.col("b.split").alias("split"), F.col("a.source").alias("train_source"), F.col("b.source").alias("source"), (F.col("b.t") - F.col("a.t")).alias("gap"), F.col("dot").alias("score"))


def found_pairs(edges: DataFrame, within: int = 3) -> DataFrame:
    """The pairs by eid alone, the smaller first: all of them, as the list of cases asks; overlap_rows keeps groups of copies together."""
    width = 2 * (within + 1)
    rec = _records(edges, width).drop("source")
    pairs = _join(rec, rec.filter("split = 0").drop("split"), rec.filter("split > 0").drop("split"), within, width, "eid")
    return pairs.select(F.least("a.eid", "b.eid").alias("eid_a"), F.greatest("a.eid", "b.eid").alias("eid_b"))


_CLASS = ["lo", "hi", "t"]


def overlap_rows(edges: DataFrame, within: int = 3) -> DataFrame:
    """One row per linked row: eid, split, class_id, n_links.

    Rows of one pair and time are a class, named by its least eid over all splits, and are joined as one vector a side, however many they
    are; n_links is the number of rows of the other side (training, evaluation) at most `within` away. Rows without links don't come out, nor
    rows with nulls as in cross_split_pairs. The classes are written once, as both sides are made of them.
    """
    width = 2 * (within + 1)
    rec = _records(edges, width)
    counted = rec.groupBy(*_CLASS).agg(F.min("eid").alias("class_id"), F.count_if(F.col("split") == 0).alias("n"), F.count_if(F.col("split") > 0).alias("m"))
    classes = _placed(written(counted, "overlap-classes"), width)
    train, other = classes.filter("n > 0").drop("m"), classes.filter("m > 0").drop("n")
    pairs = _join(rec, train, other, within, width, "t")
    side = lambda no, of, far: F.struct(F.lit(no).alias("side"), F.col(f"{of}.t").alias("t"), F.col(f"{of}.class_id").alias("class_id"), F.col(far).alias("k"))
    links = pairs.select("a.lo", "a.hi", F.explode(F.array(side(0, "a", "b.m"), side(1, "b", "a.n"))).alias("_x"))
    links = links.groupBy("lo", "hi", "_x.t", "_x.side", "_x.class_id").agg(F.sum("_x.k").alias("n_links"))
    rows = rec.select("eid", "split", "lo", "hi", "t", (F.col("split") > 0).cast("int").alias("side"))
    return rows.join(links, [*_CLASS, "side"]).select("eid", "split", "class_id", "n_links")


def overlap_report(edges: DataFrame, within: int = 3) -> DataFrame:
    """Per split (val, test) and source: n_rows, n_overlap (with a training row at most `within` away), n_exact (at the same time).

    Copies count as rows but are joined once: rows are first merged per pair, time, split and source, so a group of copies of any
    size is one vector. Rows with nulls in src, dst, time or ext_roll are left out of all three counts; a null source is a group.
    """
    width = 2 * (within + 1)
    rec = _records(edges, width)
    train = _placed(rec.filter("split = 0").select(*_CLASS).distinct(), width)
    other = _placed(rec.filter("split > 0").groupBy(*_CLASS, "split", "source").agg(F.count(F.lit(1)).alias("n")), width)
    pairs = _join(rec, train, other, within, width, "t")
    near = pairs.groupBy("b.lo", "b.hi", "b.t", "b.split", "b.source").agg(F.max("b.n").alias("n"), F.min(F.abs(F.col("a.t") - F.col("b.t"))).alias("_gap"))
    counted = near.groupBy("split", "source").agg(F.sum("n").alias("n_overlap"), F.sum(F.when(F.col("_gap") == 0, F.col("n")).otherwise(0)).alias("n_exact"))
    total = rec.filter("split > 0").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_rows"))
    joined = total.alias("x").join(counted.alias("y"), (F.col("x.split") == F.col("y.split")) & F.col("x.source").eqNullSafe(F.col("y.source")), "left")
    name = F.when(F.col("x.split") == 1, SPLITS[1]).otherwise(SPLITS[2])
    zero = F.lit(0).cast("long")
    return joined.select(name.alias("split"), F.col("x.source").alias("source"), "n_rows", F.coalesce("n_overlap", zero).alias("n_overlap"), F.coalesce("n_exact", zero).alias("n_exact"))
