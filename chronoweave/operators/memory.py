"""Memory and mailbox of nodes over batches: last write wins within a batch, ring buffers over batches, delivery to neighbours.

A batch is seen as one instant: what it writes is read from the next batch on. All operators take the batch as a column, so any
number of batches is one job; only models whose mails hold the memory itself need batch after batch (see history).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.config import MemorySettings
from chronoweave.operators import layers as L
from chronoweave.session import dropped, written


def build_mails(edges: DataFrame, memory: DataFrame, edge_features: DataFrame, width: int, edge_width: int) -> DataFrame:
    """Two mails an edge: batch, pos (2 * edge_pos for src, + 1 for dst), node, t, mail = own memory, other memory, edge features.

    edges: batch, edge_pos, eid, src, dst, t. Nodes and edges without vectors have zeros. A mail has its own edge's time.
    """
    m = memory.select("node", "f")
    with_src = edges.join(m.select(F.col("node").alias("src"), F.col("f").alias("_fs")), "src", "left")
    with_dst = with_src.join(m.select(F.col("node").alias("dst"), F.col("f").alias("_fd")), "dst", "left")
    full = with_dst.join(edge_features.select("eid", F.col("f").alias("_fe")), "eid", "left")
    part = lambda c, w: F.coalesce(F.transform(F.col(c), lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), w))
    s, d, e = part("_fs", width), part("_fd", width), part("_fe", edge_width)
    both = F.array(F.struct(F.lit(0).alias("o"), F.col("src").alias("node"), F.concat(s, d, e).alias("mail")), F.struct(F.lit(1).alias("o"), F.col("dst").alias("node"), F.concat(d, s, e).alias("mail")))
    return full.select("batch", "edge_pos", "t", F.explode(both).alias("_m")).select("batch", (F.col("edge_pos") * 2 + F.col("_m.o")).alias("pos"), "_m.node", "t", "_m.mail")


def mail_rows(edges: DataFrame) -> DataFrame:
    """The mails of build_mails without their vectors: batch, pos, node, t, other, eid. What is kept of them can be filled by with_mails."""
    both = F.array(F.struct(F.lit(0).alias("o"), F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.lit(1).alias("o"), F.col("dst").alias("node"), F.col("src").alias("other")))
    return edges.select("batch", "edge_pos", "t", "eid", F.explode(both).alias("_m")).select("batch", (F.col("edge_pos") * 2 + F.col("_m.o")).alias("pos"), "_m.node", "t", "_m.other", "eid")


def with_mails(rows: DataFrame, memory: DataFrame, edge_features: DataFrame, width: int, edge_width: int) -> DataFrame:
    """rows of mail_rows with mail in place of other and eid: vectors are moved for the mails that were kept only."""
    part = lambda c, w: F.coalesce(F.transform(F.col(c), lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), w))
    own = rows.join(memory.select("node", F.col("f").alias("_own")), "node", "left")
    both = own.join(memory.select(F.col("node").alias("other"), F.col("f").alias("_far")), "other", "left")
    full = both.join(edge_features.select("eid", F.col("f").alias("_edge")), "eid", "left")
    return full.withColumn("mail", F.concat(part("_own", width), part("_far", width), part("_edge", edge_width))).drop("_own", "_far", "_edge", "other", "eid")


def state_of(nodes: DataFrame, written_state: DataFrame, fields: dict[str, str]) -> DataFrame:
    """nodes with the fields (name: default as SQL) of their state, the defaults where nothing was written: an empty state reads as zeros."""
    return nodes.join(written_state.select("node", *fields), "node", "left").select("node", *(F.coalesce(F.col(n), F.expr(d)).alias(n) for n, d in fields.items()))


def last_per_batch(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """The last row per (batch, node) by pos; combined map-side, so a hot node is one row a task and batch."""
    rest = [c for c in rows.columns if c not in ("batch", "node")]
    best = rows.groupBy("batch", "node").agg(F.max_by(F.struct(*rest), F.col(pos)).alias("_b"))
    return best.select("batch", "node", "_b.*")


def state_before(writes: DataFrame, reads: DataFrame, key: list[str], fields: list[str], span: int = 1000) -> DataFrame:
    """For each read (key, batch, node) the fields of the node's last write in an earlier batch, null before the first.

    writes: at most one row per (batch, node). Batches are taken in stretches of `span`: the last write is looked for within the
    stretch, else in the one carried over from the stretches before, so a node of very many batches isn't one task.
    """
    w = writes.select("node", "batch", F.lit(1).alias("_o"), F.struct(*fields).alias("_w"))
    r = reads.select("node", "batch", F.lit(0).alias("_o"), F.struct(*key).alias("_r"))
    both = w.unionByName(r, allowMissingColumns=True).withColumn("_s", F.floor(F.col("batch") / span))
    inside = F.last("_w", ignorenulls=True).over(Window.partitionBy("node", "_s").orderBy("batch", "_o").rowsBetween(Window.unboundedPreceding, 0))
    per = both.groupBy("node", "_s").agg(F.max_by("_w", F.when(F.col("_o") == 1, F.col("batch"))).alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(Window.partitionBy("node").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    before = per.select("node", "_s", carried.alias("_c"))
    seen = both.withColumn("_l", inside).filter("_o = 0").join(before, ["node", "_s"]).withColumn("_l", F.coalesce("_l", "_c"))
    return seen.select("_r.*", "batch", "node", *(F.col(f"_l.{f}").alias(f) for f in fields))


def state_before_distinct(writes: DataFrame, reads: DataFrame, fields: list[str], span: int = 1000) -> DataFrame:
    """reads (with batch and node, any further columns) with the fields as state_before gives them, each distinct (batch, node) read once."""
    once = state_before(writes, reads.select("batch", "node").distinct().withColumn("_k", F.lit(1)), ["_k"], fields, span).drop("_k")
    return reads.join(once, ["batch", "node"])


def two_phase(mails: DataFrame, slots: int) -> tuple[DataFrame, DataFrame]:
    """Writing in two phases: what each batch leaves behind (batch, node, its last mail, turn), then the places it takes: node, slot, and for how long, from
    batch `since` to before batch `until` (null: still). One state of all batches, of which a reader takes the rows valid at its batch.
    """
    staged = last_per_batch(mails).withColumn("turn", F.dense_rank().over(Window.partitionBy("node").orderBy("batch")) - 1)
    next_in_slot = F.lead("batch").over(Window.partitionBy("node", F.pmod("turn", F.lit(slots))).orderBy("batch"))
    placed = staged.withColumns({"slot": F.pmod("turn", F.lit(slots)).cast("int"), "until": next_in_slot}).withColumnRenamed("batch", "since").drop("turn")
    return staged, placed


def ring_slots(mails: DataFrame, slots: int) -> DataFrame:
    """Slot of each mail: one slot a node and batch, in turn. mails: at most one row per (batch, node)."""
    turn = F.dense_rank().over(Window.partitionBy("node").orderBy("batch")) - 1
    return mails.withColumn("slot", F.pmod(turn, F.lit(slots)))


def mailbox(mails: DataFrame, slots: int) -> DataFrame:
    """Content after all batches: the last mail of every slot of a node. mails: at most one row per (batch, node).

    Only the newest `slots` mails of a node pass the limit before the shuffle, and slots follow from the node's number of mails.
    """
    age = F.row_number().over(Window.partitionBy("node").orderBy(F.col("batch").desc()))
    newest = mails.withColumn("_age", age).filter(F.col("_age") <= slots)
    turns = mails.groupBy("node").agg(F.count(F.lit(1)).alias("_turns"))
    return newest.join(turns, "node").withColumn("slot", F.pmod(F.col("_turns") - F.col("_age"), F.lit(slots)).cast("int")).drop("_turns", "_age")


def next_slots(mails: DataFrame, slots: int) -> DataFrame:
    """node, next_pos: the slot that the node's next mail will take."""
    return mails.groupBy("node").agg(F.pmod(F.countDistinct("batch"), F.lit(slots)).alias("next_pos"))


def delivered(mails: DataFrame, block: DataFrame) -> DataFrame:
    """Mails of roots copied to their sampled neighbours as well: batch, node, pos, t, mail, and via (0 own, 1 neighbour).

    block: batch, root_pos, nbr_pos, node. A root_pos is the pos of the mail it sends.
    """
    own = mails.select("batch", "node", "pos", "t", "mail", F.lit(0).alias("via"), F.lit(-1).alias("nbr_pos"))
    m = mails.select("batch", F.col("pos").alias("root_pos"), "pos", "t", "mail")
    far = block.select("batch", "root_pos", "nbr_pos", "node").join(m, ["batch", "root_pos"]).select("batch", "node", "pos", "t", "mail", F.lit(1).alias("via"), "nbr_pos")
    return own.unionByName(far)


def last_delivered(sent: DataFrame) -> DataFrame:
    """Per (batch, node) the last mail: by pos, deliveries to neighbours after the root's own, then by nbr_pos."""
    best = sent.groupBy("batch", "node").agg(F.max_by(F.struct("pos", "via", "nbr_pos", "t", "mail"), F.struct("pos", "via", "nbr_pos")).alias("_b"))
    return best.select("batch", "node", "_b.*")


def mean_delivered(sent: DataFrame, width: int, deliver_to: str = "neighbors") -> DataFrame:
    """Per (batch, node) the mean of its mails, per position: batch, node, pos, value. Only for delivery to neighbours."""
    if deliver_to == "self":
        raise ValueError("the mean of mails is defined for delivery to neighbours only")
    means = sent.groupBy("batch", "node").agg(*(F.avg(F.col("mail")[i]).alias(f"_m{i}") for i in range(width)))
    return means.select("batch", "node", F.posexplode(F.array(*(f"_m{i}" for i in range(width)))).alias("pos", "value"))


# ---- updaters -------------------------------------------------------------------------------------------------------
CELLS = ("gru", "rnn", "transformer")
STATE = "node long, batch long, mem array<double>, mem_t long, mails array<array<double>>, mail_t array<long>, next_pos int"
_FIELDS = ["mem", "mem_t", "mails", "mail_t"]


def _boxes(mails: pa.Array, times: pa.Array, slots: int, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """Mailboxes (n, slots, deep) and their times (n, slots) of list columns; slots that aren't there are zeros."""
    box, at = np.zeros((len(mails), slots, deep)), np.zeros((len(mails), slots))
    sizes = pc.fill_null(pc.list_value_length(mails), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(mails)), sizes)
    if len(row):
        col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        box[row, col] = L.from_lists(mails.flatten(), deep)
        at[row, col] = pc.cast(times.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    return box, at


def updated(reads: DataFrame, settings: MemorySettings, width: int, deep: int, time_width: int) -> DataFrame:
    """reads (any columns, t, and mem, mem_t, mails, mail_t as state_before gives them) with mem replaced by the new memory at t.

    Nulls are zeros, as of a node to which nothing was ever written. deep is the length of a mail. Vectorised over Arrow batches; a row
    depends on nothing but itself. mails and mail_t don't come out, mem_t stays.
    """
    if settings.updater not in CELLS:
        raise ValueError(f"updater must be one of {CELLS}")
    kept = [c for c in reads.columns if c not in ("mem", "mails", "mail_t")]
    out = ", ".join([f"`{c}` {reads.schema[c].dataType.simpleString()}" for c in kept] + ["mem array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                times = lambda c: pc.fill_null(pc.cast(b.column(c), pa.float64()), 0.0).to_numpy(zero_copy_only=False)
                box, box_t = _boxes(b.column("mails"), b.column("mail_t"), settings.slots, deep)
                new = L.updated_memory(settings.updater, L.from_lists(b.column("mem"), width), times("mem_t"), box, box_t, times("t"), time_width)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), L.to_lists(new)], names=[*kept, "mem"])

    return reads.mapInArrow(run, out)


class _Fold:
    """State of the nodes of a stretch while its batches are taken in turn."""

    def __init__(self, nodes: np.ndarray, state: pa.Table, settings: MemorySettings, width: int, deep: int, time_width: int) -> None:
        self.nodes, self.settings, self.time_width, n = nodes, settings, time_width, len(nodes)
        self.mem, self.mem_t, self.next = np.zeros((n, width)), np.zeros(n), np.zeros(n, np.int64)
        self.box, self.box_t = np.zeros((n, settings.slots, deep)), np.zeros((n, settings.slots))
        self.batch, self.changed = np.zeros(n, np.int64), np.zeros(n, bool)
        if state.num_rows:
            node, batch = state["node"].to_numpy(), state["batch"].to_numpy()
            order = np.lexsort((batch, node))  # of several states of a node the last written
            state = state.take(pa.array(order[np.r_[np.flatnonzero(np.diff(node[order])), len(order) - 1]]))
            of = lambda c: state[c].combine_chunks()
            at = np.searchsorted(nodes, of("node").to_numpy())
            self.mem[at], self.mem_t[at], self.next[at] = L.from_lists(of("mem"), width), of("mem_t").to_numpy(), of("next_pos").to_numpy()
            self.box[at], self.box_t[at] = _boxes(of("mails"), of("mail_t"), settings.slots, deep)

    def read(self, at: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The new memories of nodes (places) at t."""
        return L.updated_memory(self.settings.updater, self.mem[at], self.mem_t[at], self.box[at], self.box_t[at], t, self.time_width)

    def take(self, batch: int, ends: np.ndarray, t: np.ndarray, f: np.ndarray, to: np.ndarray, sent: np.ndarray) -> np.ndarray:
        """One batch: memories of both ends of every edge at its time, their last written; mails of those memories, the last (or mean) of a node kept.

        ends: the nodes in order of pos (src and dst of each edge), t and f of each; to, sent: receivers in order and the pos of the mail that each gets.
        The nodes (places) that it changed come out.
        """
        new = self.read(ends, t)
        far = new.reshape(len(new) // 2, 2, -1)[:, ::-1].reshape(len(new), -1)
        mail = np.concatenate([new, far, f], 1)
        wrote, last = np.unique(ends[::-1], return_index=True)
        last = len(ends) - 1 - last
        self.mem[wrote], self.mem_t[wrote] = new[last], t[last]
        if self.settings.deliver_to == "self":  # the receivers are the ends, so the last mail of each is that of its last memory
            got, kept, kept_t = wrote, mail[last], t[last]
        elif self.settings.combine == "mean":
            got = np.unique(to)
            which = np.searchsorted(got, to)
            count = np.bincount(which)[:, None]
            kept, kept_t = np.zeros((len(got), mail.shape[1])), np.bincount(which, t[sent]) / count[:, 0]
            np.add.at(kept, which, mail[sent])
            kept /= count
        else:
            got, last = np.unique(to[::-1], return_index=True)
            pick = sent[len(to) - 1 - last]
            kept, kept_t = mail[pick], t[pick]
        slot = self.next[got]
        self.box[got, slot], self.box_t[got, slot], self.next[got] = kept, kept_t, (slot + 1) % self.settings.slots
        changed = got if got is wrote else np.union1d(wrote, got)
        self.batch[changed], self.changed[changed] = batch, True
        return changed

    def state(self, at: np.ndarray) -> tuple:
        return self.nodes[at], self.batch[at], self.mem[at], self.mem_t[at], self.box[at], self.box_t[at], self.next[at]


HISTORY, AFTER, READ = 0, 1, 2  # rows of a stretch: what a batch left, what the stretch left, the answer to a read
_ROWS = f"{STATE}, _kind int, _t long"


def _table(rows: tuple, kind: int, read_t: np.ndarray | None = None) -> pa.Table:
    node, at, mem, mem_t, box, box_t, turn = rows
    n, whole = len(node), lambda x: pa.array(x.astype(np.int64))
    if box is None:
        mails, mail_t, turn = (pa.nulls(n, x) for x in (pa.list_(pa.list_(pa.float64())), pa.list_(pa.int64()), pa.int32()))
    else:
        slots = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * box.shape[1], pa.int32()), values)
        mails, mail_t, turn = slots(L.to_lists(box.reshape(-1, box.shape[2]))), slots(whole(box_t.ravel())), pa.array(turn.astype(np.int32))
    columns = [pa.array(node), pa.array(at), L.to_lists(mem), whole(mem_t), mails, mail_t, turn, pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.int64()) if read_t is None else whole(read_t)]
    return pa.table(columns, names=[c.split()[0] for c in _ROWS.split(", ")])


def _folded(rows: pa.Table, state: pa.Table, settings: MemorySettings, width: int, edge_width: int, time_width: int, whole: bool) -> pa.Table:
    """rows: edges and, with null eid, reads (batch, src the node, t). Out come what every batch left (whole), or what is left at the end and the answers to the reads."""
    is_read = pc.is_null(rows["edge_pos"])
    asked, edges = rows.filter(is_read), rows.filter(pc.invert(is_read))
    edges = edges.sort_by([("batch", "ascending"), ("edge_pos", "ascending")]).combine_chunks()
    asked = asked.sort_by([("batch", "ascending")]).combine_chunks()
    of = lambda c: edges[c].combine_chunks()
    pairs = np.stack([of("src").to_numpy(), of("dst").to_numpy()], 1).ravel()
    pos = np.arange(len(pairs))
    to, sent = pairs, pos
    if settings.deliver_to == "neighbors":
        far = [of(c) for c in ("to_src", "to_dst")]
        sizes = np.stack([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in far], 1).ravel().astype(np.int64)
        per_end = [np.repeat(pos[e::2], sizes[e::2]) for e in (0, 1)]
        who, whose = np.concatenate([pairs, *(x.flatten().to_numpy(zero_copy_only=False) for x in far)]), np.concatenate([pos, *per_end])
        order = np.argsort(whose, kind="stable")  # each end itself, then its neighbours
        to, sent = who[order], whose[order]
    ask_node, ask_batch, ask_t = (asked[c].to_numpy() for c in ("src", "batch", "t"))
    nodes = np.unique(np.concatenate([to, ask_node]))
    fold = _Fold(nodes, state, settings, width, 2 * width + edge_width, time_width)
    f, t, batch = np.repeat(L.from_lists(of("f"), edge_width), 2, 0), np.repeat(of("t").to_numpy().astype(float), 2), of("batch").to_numpy()
    ends, to, ask = np.searchsorted(nodes, pairs), np.searchsorted(nodes, to), np.searchsorted(nodes, ask_node)
    parts, answers = [], []
    for b in np.union1d(batch, ask_batch):
        x, y = np.searchsorted(ask_batch, b), np.searchsorted(ask_batch, b, "right")
        for i in range(x, y, 20_000):
            at = ask[i : min(i + 20_000, y)]
            answers.append((fold.read(at, ask_t[i : i + len(at)].astype(float)), fold.mem_t[at]))
        a, z = 2 * np.searchsorted(batch, b), 2 * np.searchsorted(batch, b, "right")
        if z > a:
            c, d = np.searchsorted(sent, [a, z])
            changed = fold.take(int(b), ends[a:z], t[a:z], f[a:z], to[c:d], sent[c:d] - a)
            if whole:
                parts.append(fold.state(changed))
    if whole:
        return _table(tuple(np.concatenate(x) for x in zip(*(parts or [fold.state(np.zeros(0, np.int64))]))), HISTORY)
    left = _table(fold.state(np.flatnonzero(fold.changed)), AFTER)
    if not answers:
        return left
    mem, mem_t = (np.concatenate(x) for x in zip(*answers))
    return pa.concat_tables([left, _table((ask_node, ask_batch, mem, mem_t, None, None, None), READ, ask_t)])


def _stored(edges: DataFrame, edge_features: DataFrame, settings: MemorySettings, routes: DataFrame | None, reads: DataFrame | None) -> DataFrame:
    """Edges with features and receivers, and reads with the node as src and no eid, in order of batch, so that a stretch is found by its files' bounds."""
    named = edges.filter("batch is not null and src is not null and dst is not null").select("batch", "edge_pos", "eid", "src", "dst", "t")
    full = named.join(edge_features.select("eid", "f"), "eid", "left")
    if settings.deliver_to == "neighbors":
        if "to" not in routes.columns:
            routes = routes.groupBy("batch", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("nbr_pos", "node"))), lambda x: x["node"]).alias("to"))
        end = lambda i: F.first(F.when(F.col("pos") % 2 == i, F.col("to")), ignorenulls=True)
        both = routes.groupBy("batch", F.expr("pos div 2").alias("edge_pos")).agg(end(0).alias("to_src"), end(1).alias("to_dst"))
        full = full.join(both, ["batch", "edge_pos"], "left")
    if reads is not None:
        full = full.unionByName(reads.filter("batch is not null").select("batch", F.col("node").alias("src"), "t").distinct(), allowMissingColumns=True)
    return written(full.repartitionByRange("batch", "edge_pos").sortWithinPartitions("batch", "edge_pos"), "memory-edges")


def _fold(edges: DataFrame, edge_features: DataFrame, settings: MemorySettings, width: int, edge_width: int, time_width: int, routes: DataFrame | None, most_edges: int | None, compact: int, whole: bool, reads: DataFrame | None) -> tuple[list[DataFrame], list[DataFrame]]:
    """The stretches' rows (what every batch left, or the answers to reads), and the last states: of a node the greatest batch holds."""
    spark = edges.sparkSession
    most = most_edges or max(50_000, 1_000_000 // (1 + settings.slots))
    full = _stored(edges, edge_features, settings, routes, reads)
    stretches: list[list[int]] = []
    size = most
    weight = F.sum(F.when(F.col("edge_pos").isNull(), 0.25).otherwise(1.0))
    for r in full.groupBy("batch").agg(weight.alias("n")).orderBy("batch").collect():
        if size + r["n"] > most:
            stretches.append([r["batch"], r["batch"]])
            size = 0
        stretches[-1][1] = r["batch"]
        size += r["n"]
    every, held = [], []
    none = F.array().cast("array<long>")
    run = lambda e, s: _folded(e, s, settings, width, edge_width, time_width, whole)
    lists = settings.deliver_to == "neighbors"
    for first, last in stretches:
        now = full.filter(F.col("batch").between(first, last))
        ends = F.concat(F.array("src"), F.when(F.col("dst").isNull(), none).otherwise(F.array("dst")), *(F.coalesce(c, none) for c in ("to_src", "to_dst") if lists))
        nodes = now.select(F.explode(ends).alias("node")).distinct()
        known = _union(held).join(F.broadcast(nodes), "node", "left_semi") if held else spark.createDataFrame([], STATE)
        new = written(now.groupBy(F.lit(0).alias("all")).cogroup(known.groupBy(F.lit(0).alias("all"))).applyInArrow(run, _ROWS), "memory-history")
        if whole:
            every.append(new.drop("_kind", "_t"))
            held.append(every[-1])
        else:
            held.append(new.filter(F.col("_kind") == AFTER).drop("_kind", "_t"))
            if reads is not None:
                every.append(written(new.filter(F.col("_kind") == READ).select("batch", "node", F.col("_t").alias("t"), "mem", "mem_t"), "memory-reads"))
        if len(held) > compact:
            old, held = held, [written(state_after(_union(held)), "memory-state")]
            for x in old if not whole else []:
                dropped(x)
    dropped(full)
    return every, held


def history(edges: DataFrame, edge_features: DataFrame, settings: MemorySettings, width: int, edge_width: int, time_width: int = 4, routes: DataFrame | None = None, most_edges: int | None = None, compact: int = 8) -> DataFrame:
    """What every batch leaves behind: node, batch, mem, mem_t, mails, mail_t, next_pos of the nodes it changed (see STATE). state_before reads it.

    edges: batch, edge_pos, eid, src, dst, t. In a batch both ends of an edge take their mailbox into their memory at the edge's time, as it was before the
    batch; the last memory of a node is kept, and mails of the new memories and the edge's features go to both ends and, for delivery to
    neighbours, along routes (batch, pos, node, nbr_pos: the sampled neighbours of the root that sends mail pos; or batch, pos, to: their list). Last means by
    pos, neighbours after the end itself, then by nbr_pos. Unwritten state is zeros.

    Batch b reads what the one before wrote, so batches can't run side by side: a stretch, as many whole batches as have `most_edges` edges
    together (by default fewer the more slots a mailbox has) and at least one, is one task, which sees the state of its own nodes only.
    After a stretch only the nodes it changed are written; every `compact` stretches those are put together. The numbers of edges
    per batch come to the driver. Edges without src, dst or batch aren't taken; no edges give no rows.

    Where only some states are asked for, state_at_end and answers take them out of the same fold and no history is stored.
    """
    every, _ = _fold(edges, edge_features, settings, width, edge_width, time_width, routes, most_edges, compact, True, None)
    return _union(every) if every else edges.sparkSession.createDataFrame([], STATE)


def state_at_end(edges: DataFrame, edge_features: DataFrame, settings: MemorySettings, width: int, edge_width: int, time_width: int = 4, routes: DataFrame | None = None, most_edges: int | None = None, compact: int = 8) -> DataFrame:
    """The state of every node after all batches, as state_after(history) gives it."""
    _, held = _fold(edges, edge_features, settings, width, edge_width, time_width, routes, most_edges, compact, False, None)
    return state_after(_union(held)) if held else edges.sparkSession.createDataFrame([], STATE)


def answers(reads: DataFrame, edges: DataFrame, edge_features: DataFrame, settings: MemorySettings, width: int, edge_width: int, time_width: int = 4, routes: DataFrame | None = None, most_edges: int | None = None, compact: int = 8) -> DataFrame:
    """batch, node, t of the distinct reads with mem and mem_t as inputs(reads, history) gives them, 0 where mem_t is null there: the fold answers a batch's reads
    before it takes the batch. A read of a batch without edges sees all that was left before it.
    """
    every, _ = _fold(edges, edge_features, settings, width, edge_width, time_width, routes, most_edges, compact, False, reads)
    return _union(every) if every else edges.sparkSession.createDataFrame([], "batch long, node long, t long, mem array<double>, mem_t long")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def state_after(past: DataFrame) -> DataFrame:
    """The state of every node after all batches of a history."""
    best = past.groupBy("node").agg(F.max_by(F.struct("batch", *_FIELDS, "next_pos"), "batch").alias("_s"))
    return best.select("node", "_s.*")


def inputs(occurrences: DataFrame, past: DataFrame, settings: MemorySettings, width: int, edge_width: int, time_width: int = 4) -> DataFrame:
    """batch, node, t of the distinct occurrences with mem, their new memory at t from what earlier batches left, and mem_t, when it was last written."""
    once = occurrences.select("batch", "node", "t").distinct()
    seen = state_before_distinct(past, once, _FIELDS)
    return updated(seen, settings, width, 2 * width + edge_width, time_width)
