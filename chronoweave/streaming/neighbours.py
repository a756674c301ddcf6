"""Recent neighbours and mailboxes over streams: keyed state that equals the batch operators on data in order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoweave.operators import sampler

FOUND = "query long, root long, root_t long, nbr_pos int, node long, eid long, t long"
_HELD = "node array<long>, part array<long>, t array<long>, eid array<long>, dst array<long>, gone_node array<long>, gone_part array<long>, gone_t array<long>, gone_eid array<long>"


def _codes(nodes: list[np.ndarray], parts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Numbers of (node, part), alike over all arrays, and the node and part of each number."""
    both = pd.DataFrame({"n": np.concatenate(nodes), "p": np.concatenate(parts)})
    code = both.groupby(["n", "p"]).ngroup().to_numpy(np.int64)
    first = np.unique(code, return_index=True)[1]
    return np.split(code, np.cumsum([len(x) for x in nodes])[:-1]), both["n"].to_numpy()[first], both["p"].to_numpy()[first]


def recent_stream(events: DataFrame, k: int, late: str | None = None, heavy: Sequence[int] = (), parts: int = 16, buckets: int = 64) -> DataFrame:
    """For each query of a stream its node's k newest edges strictly before its time, as rows of FOUND.

    events: node, t (whole seconds), eid, dst for an edge of node; node, t, query for a query; the fields of the other kind are null.
    A query sees the edges of its own and earlier micro-batches. Without `late` the state holds all edges. With it, a watermark that far
    behind the greatest t lets go of edges before it, but for the k newest of those, so that a query not older than the watermark still has its whole
    answer. An older one that may lack edges gets one more row with nbr_pos -1 and null node, eid and t, the sign to answer
    it from the table (see settled). The edges of `heavy` nodes are held in `parts` pieces, each of which answers; settled merges them.
    Rows with null node or t are left out. Nodes (and pieces) share `buckets` states by a hash, each worked through as arrays; more of them
    make smaller tasks. As for any stateful stream their number is fixed once the stream has run.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        node, part, t, eid, dst, gone_node, gone_part, gone_t, gone_eid = (np.array(x, np.int64) for x in (state.get if state.exists else ((),) * 9))
        rows = pd.concat(list(batches))
        new, asked = (rows[x] for x in (rows["query"].isna(), rows["query"].notna()))
        of = lambda x, c: x[c].to_numpy(np.int64)
        node, part = np.concatenate([node, of(new, "node")]), np.concatenate([part, of(new, "_part")])
        t, eid, dst = (np.concatenate([x, of(new, c)]) for x, c in ((t, "t"), (eid, "eid"), (dst, "dst")))
        (code, gone, ask), node_of, part_of = _codes([node, gone_node, of(asked, "node")], [part, gone_part, of(asked, "_part")])
        n_codes, seen = len(node_of), np.zeros(len(node_of), bool)
        seen[code[len(code) - len(new) :]] = seen[ask] = True
        had, last_t, last_eid = np.zeros(n_codes, bool), np.zeros(n_codes, np.int64), np.zeros(n_codes, np.int64)
        had[gone], last_t[gone], last_eid[gone] = True, gone_t, gone_eid
        # an edge older than one let go of can't be told from those any more
        kept = ~had[code] | (t > last_t[code]) | ((t == last_t[code]) & (eid > last_eid[code]))
        order = np.flatnonzero(kept)
        order = order[np.lexsort((eid[order], t[order], code[order]))]
        code, t, eid, dst = code[order], t[order], eid[order], dst[order]
        starts = np.searchsorted(code, np.arange(n_codes))
        query, at = of(asked, "query"), of(asked, "t")
        both = np.lexsort((np.r_[np.ones(len(t), np.int8), np.zeros(len(at), np.int8)], np.r_[t, at], np.r_[code, ask]))  # a query before the edges of its time
        is_edge = both < len(t)
        upto = np.zeros(len(at), np.int64)
        upto[both[~is_edge] - len(t)] = np.cumsum(is_edge)[~is_edge]
        n = np.minimum(upto - starts[ask], k)
        which = np.repeat(np.arange(len(at)), n)
        pos = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        take = np.repeat(upto, n) - 1 - pos
        out = pd.DataFrame({"query": query[which], "root": node_of[ask][which], "root_t": at[which], "nbr_pos": pos, "node": dst[take], "eid": eid[take], "t": t[take]}).astype("Int64")
        short = (n < k) & had[ask]
        marks = pd.DataFrame({"query": query[short], "root": node_of[ask][short], "root_t": at[short], "nbr_pos": -1, "node": None, "eid": None, "t": None}).astype("Int64")
        if late is not None:
            before = np.bincount(code[t < state.getCurrentWatermarkMs() // 1000], minlength=n_codes)
            first = np.where(seen, np.maximum(before - k, 0), 0)
            cut = np.flatnonzero(first)
            newest = starts[cut] + first[cut] - 1
            had[cut], last_t[cut], last_eid[cut] = True, t[newest], eid[newest]
            left = np.arange(len(code)) - starts[code] >= first[code]
            code, t, eid, dst = code[left], t[left], eid[left], dst[left]
        gone = np.flatnonzero(had)
        state.update(tuple(x.tolist() for x in (node_of[code], part_of[code], t, eid, dst, node_of[gone], part_of[gone], last_t[gone], last_eid[gone])))
        yield pd.concat([out, marks])

    rows = events.filter("node is not null and t is not null").select("node", "t", "eid", "dst", "query")
    if late is not None:
        rows = rows.withColumn("_at", F.timestamp_seconds("t")).withWatermark("_at", late)
    split = F.col("node").isin(list(heavy)) if heavy else F.lit(False)
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    part = F.when(~split, F.array(F.lit(0))).when(F.col("query").isNotNull(), every).otherwise(F.array(F.pmod(F.xxhash64("eid"), F.lit(parts)).cast("int")))
    bucketed = rows.withColumn("_part", F.explode(part)).withColumn("_bucket", F.pmod(F.xxhash64("node", "_part"), F.lit(buckets)).cast("int"))
    return bucketed.groupBy("_bucket").applyInPandasWithState(run, FOUND, _HELD, "append", GroupStateTimeout.NoTimeout)


def settled(found: DataFrame, k: int, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """The stored rows of recent_stream as one whole answer a query: partial answers merged, marked queries answered from the edges.

    edges: eid, src, dst, t, with all that the stream has seen. queries: query, node, t.
    """
    marked = found.filter("nbr_pos < 0").select("query").distinct()
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.col("t").desc(), F.col("eid").desc())) - 1
    whole = found.join(marked, "query", "left_anti").withColumn("nbr_pos", best).filter(F.col("nbr_pos") < k)
    again = sampler.recent(edges, queries.join(marked, "query", "left_semi"), ["query"], k)
    names = [c.split()[0] for c in FOUND.split(", ")]
    return whole.select(*names).unionByName(again.select(*names))


BOX = "node long, slot int, batch long, t long, mail array<double>"


def mailbox_stream(mails: DataFrame, slots: int) -> DataFrame:
    """Slot of each (node, batch)'s last mail as it arrives, as ring_slots gives it; the state is the node's next slot and last batch.

    mails: batch, pos, node, t, mail; batches come in order and one batch in one micro-batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (turn,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(["batch", "pos"]).groupby("batch", sort=True).tail(1)
        out = []
        for r in rows.itertuples():
            out.append((key[0], turn % slots, r.batch, r.t, r.mail))
            turn += 1
        state.update((turn,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BOX.split(", ")])

    return mails.groupBy("node").applyInPandasWithState(run, BOX, "turn long", "append", GroupStateTimeout.NoTimeout)
