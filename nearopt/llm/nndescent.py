"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Equal vectors are one node, so copies cannot crowd the lists.  First lists come from blocks of nodes with similar
random projections.  Then rounds of NN-descent: every node meets a bounded sample of the nodes it lists and of those
that list it, new entries apart from old ones; among these neighbours' neighbours, pairs closer than the last entry
of either list are proposed to it, and lists keep their best.  Rounds end when few entries are new.

A query starts from its own node, if it has one, and a fixed set of entry nodes; each hop expands the best unexpanded
nodes of its pool, by joins with the graph and the vectors, until its pool has none.  In rounds and hops vectors
travel as bytes with a scale of their own; the last step ranks the pool by exact distances of the original vectors.

How large a pool must be depends on the data and grows with the table, so it is measured: a sample of the queries is
also compared with all nodes, and the search is widened until it finds GOAL of the sample's true neighbours: pool, entry
nodes and the nodes ranked exactly are doubled.  Where bytes tell the neighbours apart too coarsely, which the sample
shows too, the graph is built anew over components of four bytes.  Every query is answered by the graph search, at every
size; at its widest that reaches all nodes.

All groups are streamed in sorted order with bounded samples, so no group is held that grows with the data.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearopt.llm import textvec as tv
from nearopt.llm.util import dropped, scratch, written
from nearopt.llm.vectors import keys, usable
from nearopt.llm.vectors import rows as rows_of

#: Entries of a list; those of each of the four kinds (listed, listing; new, old) that a node meets in a round;
#: proposals to a node from one meeting; rounds at most; share of new entries at which rounds end.
LIST, MEET, PROPOSALS, ROUNDS, SETTLED = 20, 8, 6, 14, 0.3
#: Nodes of a starting block, how many times nodes are dealt into such blocks, and what a node gets from each.
BLOCK, DEALS, FIRST = 1024, 16, 8
#: First pool of a query, nodes expanded in a hop at that pool, entry nodes, least nodes that are ranked exactly.
POOL, WIDTH, ENTRIES, EXACT = 160, 80, 16, 64
#: Share of the pools' entries that may be left unexpanded.
REST = 0.002
#: Share of the true neighbours of the sample that a search must find, and queries of the sample at most.  The margin
#: over the 0.9 required is several standard errors of a sample.
GOAL, SAMPLE = 0.92, 1024
#: Nodes that the sample is compared with at once; entry nodes up to which they are broadcast; largest size of a
#: component in a code.
STEP, SENT, CODED = 2048, 65_536, 1e18

_LISTS = "ids array<long>, dists array<float>, fresh array<boolean>"
#: Proposals to a node: others and their squared distances.
PROPOSED = "node long, others array<long>, dists array<float>"


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, key (k1, k2), length and doubles as bytes, without rows that take no part."""

    def of(batches):
        for batch in batches:
            ok, size, values = usable(batch.column(1))
            halves = keys(values)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(size.astype(np.int32)), values], ["vec_id", "k1", "k2", "length", "vector"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where("vec_id is not null")
    return rows.mapInArrow(of, "vec_id long, k1 long, k2 long, length int, vector binary")


def _doubles(values) -> np.ndarray:
    return rows_of(values, np.float64)


def _coded(x: np.ndarray, precise: bool = False) -> list[bytes]:
    """A float32 scale and a signed byte for each component; precise: 0, and a float32 for each.  Components are held
    within CODED, so that their squared distances are finite."""
    x = np.clip(x, -CODED, CODED)
    if precise:
        return [bytes(4) + r.tobytes() for r in x.astype(np.float32)]
    scale = np.maximum(np.abs(x).max(1) / 127, 1e-37)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return [s.tobytes() + r.tobytes() for s, r in zip(scale.astype(np.float32), q)]


def _decoded(codes) -> np.ndarray:
    raw = rows_of(codes, np.uint8)
    scale = raw[:, :4].copy().view(np.float32)
    if len(raw) and not scale[0, 0]:
        return np.ascontiguousarray(raw[:, 4:]).view(np.float32)
    return raw[:, 4:].view(np.int8).astype(np.float32) * scale


def _recoded(rows: DataFrame) -> DataFrame:
    """rows with precise codes of their vectors."""

    def of(batches):
        for batch in batches:
            at = batch.schema.get_field_index("code")
            new = pa.array(_coded(_doubles(batch.column(batch.schema.get_field_index("vector"))), True) if batch.num_rows else [], pa.binary())
            yield batch.set_column(at, "code", new)

    return written(rows.mapInArrow(of, rows.schema), "precise")


def _groups(batches, column: str = "node"):
    """Tables of whole groups from sorted batches: rows with equal values of column stay together."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held.column(column).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and len(held):
        yield held.combine_chunks()


def _rank_in(sorted_keys: np.ndarray) -> np.ndarray:
    """Position of each row within its group."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])
    return np.arange(len(sorted_keys)) - np.repeat(first, np.diff(np.append(first, len(sorted_keys))))


def _priority(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    return tv.splitmix(a.astype(np.uint64) * tv._MIX[0] ^ b.astype(np.uint64) * tv._MIX[1] ^ tv.splitmix(np.array([turn + 1])))


def _flat(table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each) of a list column."""
    lists = table.column(column).combine_chunks() if isinstance(table.column(column), pa.ChunkedArray) else table.column(column)
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), size)


def _lists(owner: np.ndarray, n: int, *columns: np.ndarray) -> list[pa.Array]:
    bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32))
    return [pa.ListArray.from_arrays(bounds, pa.array(c)) for c in columns]


def _square(x: np.ndarray) -> np.ndarray:
    """Squared distances within each set of a stack of sets."""
    s = (x * x).sum(-1)
    return np.maximum(s[..., :, None] + s[..., None, :] - 2 * x @ x.swapaxes(-1, -2), 0)


def _starting(nodes: DataFrame, n: int, width: int) -> DataFrame:
    """What nodes propose to each other (PROPOSED) in blocks of those that are neighbours in the order of random-projection
    codes."""
    planes = np.random.default_rng(7).normal(size=(DEALS, width, 32)).astype(np.float32)
    salts = max(1, n >> 20)
    bits = max(0, min(31, int(n // (4096 * salts)).bit_length() - 1))

    def projected(batches):
        for batch in batches:
            x = _decoded(batch.column(1))
            for deal in range(DEALS):
                code = ((x @ planes[deal] > 0) * (np.int64(1) << np.arange(31, -1, -1))).sum(1) if len(x) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), deal, np.int32)), pa.array(code.astype(np.int64))], ["node", "code", "deal", "place"])

    rows = nodes.select("node", "code").mapInArrow(projected, "node long, code binary, deal int, place long")
    rows = rows.withColumn("part", F.struct("deal", F.shiftright("place", 32 - bits).alias("p"), F.pmod(F.xxhash64("node"), F.lit(salts)).alias("s")))
    rows = rows.repartition("part").sortWithinPartitions("part", "place", "node").select("node", "code")

    def paired(batches):
        def near(table):
            ids, x = table.column("node").to_numpy(), _decoded(table.column("code"))
            for a in range(0, len(ids), BLOCK):
                own, d = ids[a : a + BLOCK], _square(x[a : a + BLOCK])
                np.fill_diagonal(d, np.inf)
                k = min(FIRST, len(own) - 1)
                if k:
                    best = np.argpartition(d, k - 1, 1)[:, :k]
                    dist = np.take_along_axis(d, best, 1).astype(np.float32)
                    rows = np.repeat(np.arange(len(own)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(own), *_lists(rows, len(own), own[best].ravel(), dist.ravel())], ["node", "others", "dists"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cut = len(held) // BLOCK * BLOCK
            if cut:
                yield from near(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield from near(held)

    return rows.mapInArrow(paired, PROPOSED)


def _sampled(table, turn: int):
    """The entries of each list that meet in this round: (row, entry's place, is fresh), MEET fresh and MEET old."""
    ids, row = _flat(table, "ids")
    fresh, _ = _flat(table, "fresh")
    fresh = fresh.astype(bool)
    order = np.lexsort((_priority(table.column("node").to_numpy()[row], ids, turn), ~fresh, row))
    rank = _rank_in(row[order] * 2 + ~fresh[order])
    return order[rank < MEET], ids, row, fresh


def _merged(state: DataFrame | None, nodes: DataFrame, proposals: DataFrame, turn: int) -> DataFrame:
    """Lists after the proposals (PROPOSED): the nearest LIST of both; entries that have met are old."""
    empty = {"ids": F.array().cast("array<long>"), "dists": F.array().cast("array<float>"), "fresh": F.array().cast("array<boolean>")}
    own = (nodes.select("node", "code").withColumns(empty) if state is None else state).withColumn("kind", F.lit(0))
    more = proposals.select("node", F.lit(None).cast("binary").alias("code"), F.col("others").alias("ids"), "dists", F.lit(None).cast("array<boolean>").alias("fresh"), F.lit(1).alias("kind"))
    rows = own.unionByName(more).repartition("node").sortWithinPartitions("node", "kind")

    def merge(batches):
        for table in _groups(batches):
            kind = table.column("kind").to_numpy()
            mine, theirs = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))
            n, node = len(mine), mine.column("node").to_numpy()
            met, ids, row, fresh = _sampled(mine, turn)
            fresh = fresh.copy()
            fresh[met] = False
            dists, _ = _flat(mine, "dists")
            others, giver = _flat(theirs, "ids")
            theirs_dist, _ = _flat(theirs, "dists")
            at = np.searchsorted(node, theirs.column("node").to_numpy())[giver]
            owner = np.concatenate([row, at])
            other = np.concatenate([ids, others]).astype(np.int64)
            dist = np.concatenate([dists, theirs_dist]).astype(np.float32)
            flag = np.concatenate([fresh, np.ones(len(at), bool)])
            order = np.lexsort((flag, other, owner))
            owner, other, dist, flag = owner[order], other[order], dist[order], flag[order]
            keep = np.ones(len(owner), bool)
            keep[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
            owner, other, dist, flag = owner[keep], other[keep], dist[keep], flag[keep]
            order = np.lexsort((other, dist, owner))
            owner, other, dist, flag = owner[order], other[order], dist[order], flag[order]
            keep = _rank_in(owner) < LIST
            lists = _lists(owner[keep], n, other[keep], dist[keep], flag[keep])
            yield pa.RecordBatch.from_arrays([pa.array(node), mine.column("code").combine_chunks(), *lists], ["node", "code", "ids", "dists", "fresh"])

    return rows.mapInArrow(merge, f"node long, code binary, {_LISTS}")


def _proposals(state: DataFrame, turn: int) -> DataFrame:
    """What the meetings at all nodes propose (PROPOSED)."""
    last = F.when(F.size("dists") >= LIST, F.element_at("dists", -1)).otherwise(F.lit(float("inf")).cast("float"))
    state = state.withColumn("last", last)

    def sent(batches):
        for batch in batches:
            met, ids, row, fresh = _sampled(batch, turn)
            node = batch.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[row[met]]), pa.array(ids[met].astype(np.int64)), pa.array(fresh[met])], ["node", "other", "fresh"])

    edges = written(state.select("node", "ids", "fresh").mapInArrow(sent, "node long, other long, fresh boolean"), "edges")
    member = state.select(F.col("node").alias("member"), "code", "last")
    priority = F.xxhash64("node", "member", F.lit(turn))
    # kind: 0 and 2 are those that the node lists, 1 and 3 those that list it; 0 and 1 are fresh
    kind = lambda listed: (F.when(F.col("fresh"), 0).otherwise(2) + (0 if listed else 1)).cast("int")
    listed = edges.select("node", F.col("other").alias("member"), "fresh").join(member, "member").withColumn("kind", kind(True))
    # A node that many list would get them all: thin them out by its share first.
    counts = written(edges.groupBy("other", "fresh").agg(F.count("*").alias("n")).where(F.col("n") > 4 * MEET), "counts")
    thin = edges.select(F.col("other"), "fresh", F.col("node").alias("member")).join(counts, ["other", "fresh"], "left").withColumnRenamed("other", "node")
    thin = thin.where(F.col("n").isNull() | (F.pmod(priority, F.lit(1 << 30)) < F.lit(3.0 * MEET * (1 << 30)) / F.col("n"))).drop("n")
    listing = thin.join(member, "member").withColumn("kind", kind(False))
    names = ["node", "member", "code", "last", "kind"]
    meetings = listed.select(*names).unionByName(listing.select(*names)).withColumn("priority", priority)
    meetings = meetings.repartition("node").sortWithinPartitions("node", "kind", "priority").select(*names)

    def meet(batches):
        for table in _groups(batches):
            node, kind = table.column("node").to_numpy(), table.column("kind").to_numpy()
            rank = _rank_in(node * 4 + kind)
            keep = rank < MEET
            table = table.filter(pa.array(keep))
            node, slot = node[keep], kind[keep] * MEET + rank[keep]
            members, last, x = table.column("member").to_numpy(), table.column("last").to_numpy(), _decoded(table.column("code"))
            starts = np.concatenate([[True], node[1:] != node[:-1]])
            group = np.cumsum(starts) - 1
            first = np.append(np.flatnonzero(starts), len(node))
            for g in range(0, group[-1] + 1, 512):
                a, b = first[g], first[min(g + 512, len(first) - 1)]
                at, own, m = group[a:b] - g, slot[a:b], int(group[b - 1] - g + 1)
                who = np.full((m, 4 * MEET), -1, np.int64)
                who[at, own] = members[a:b]
                limit = np.full((m, 4 * MEET), -np.inf, np.float32)
                limit[at, own] = last[a:b]
                v = np.zeros((m, 4 * MEET, x.shape[1]), np.float32)
                v[at, own] = x[a:b]
                d = _square(v)
                d[:, 2 * MEET :, 2 * MEET :] = np.inf  # old ones have met
                d[(who[:, :, None] == who[:, None, :]) | (who < 0)[:, :, None] | (who < 0)[:, None, :]] = np.inf
                d[d >= limit[:, :, None]] = np.inf
                best = np.argpartition(d, PROPOSALS, 2)[:, :, :PROPOSALS]
                dist = np.take_along_axis(d, best, 2)
                other = np.take_along_axis(np.broadcast_to(who[:, None, :], d.shape), best, 2)
                some = np.isfinite(dist)
                count = some.sum(2).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(who.ravel()[count > 0]), *_lists(np.repeat(np.arange((count > 0).sum()), count[count > 0]), int((count > 0).sum()), other[some], dist[some].astype(np.float32))], ["node", "others", "dists"])

    return meetings.mapInArrow(meet, PROPOSED)


def _clear(spark) -> None:
    """Lets Spark delete the shuffle files of finished rounds, which it does when the driver's garbage goes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def build(nodes: DataFrame, n: int, width: int) -> DataFrame:
    """The graph over nodes (node, code): a row per node with its list, nearest first."""
    state = written(_merged(None, nodes, _starting(nodes, n, width), 0), "lists")
    for turn in range(1, ROUNDS + 1):
        new = written(_merged(state, nodes, _proposals(state, turn), turn), "lists")
        dropped(state)
        _clear(nodes.sparkSession)
        state = new
        fresh, entries = state.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum(F.size("ids"))).first()
        if fresh <= SETTLED * entries:
            break
    return state


def _adjacent(graph: DataFrame) -> DataFrame:
    """(node, next): the list of each node and up to LIST of the nearest nodes that list it."""
    out = graph.select("node", F.explode(F.arrays_zip("ids", "dists")).alias("e")).select("node", F.col("e.ids").alias("other"), F.col("e.dists").alias("dist"))
    rows = out.withColumn("back", F.lit(False)).unionByName(out.select(F.col("other").alias("node"), F.col("node").alias("other"), "dist", F.lit(True).alias("back")))
    rows = rows.repartition("node").sortWithinPartitions("node", "back", "dist", "other")

    def taken(batches):
        """The first LIST of either side of each node, once each; a node's rows may reach over batches."""
        node, back, count, held = None, None, 0, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([list(dict.fromkeys(held))], pa.list_(pa.int64()))], ["node", "next"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, others, backs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            rank = _rank_in(ids * 2 + backs)
            same = (ids == node) & (backs == back) if node is not None else np.zeros(len(ids), bool)
            rank[same] += count
            node_of, other_of = ids[rank < LIST], others[rank < LIST]
            if node is not None:
                mine = node_of == node
                held += other_of[mine].tolist()
                node_of, other_of = node_of[~mine], other_of[~mine]
                if ids[-1] != node:
                    yield done()
                    held = []
            last = ids[-1]
            whole = node_of != last
            if ids[-1] != node:
                held = other_of[~whole].tolist()
            if whole.any():
                own, at = np.unique(node_of[whole], return_inverse=True)
                order = np.lexsort((other_of[whole], at))
                at, other = at[order], other_of[whole][order]
                keep = np.append(True, (at[1:] != at[:-1]) | (other[1:] != other[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(own), *_lists(at[keep], len(own), other[keep])], ["node", "next"])
            node, back, count = last, backs[-1], int(rank[-1]) + 1
        if node is not None:
            yield done()

    return rows.select("node", "other", "dist", "back").mapInArrow(taken, "node long, next array<long>")


def _hop(state: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """Pools of a size after the nodes (query, cand, near) that the last expansion found."""
    width = max(WIDTH, size * WIDTH // POOL)
    own = state.withColumns({"kind": F.lit(0), "cand": F.lit(None).cast("long"), "near": F.lit(None).cast("float")})
    more = found.select("query", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "binary"), ("pool", "array<long>"), ("dist", "array<float>"), ("done", "array<boolean>"), ("front", "array<long>"))], F.lit(1).alias("kind"), "cand", "near")
    rows = own.unionByName(more).repartition("query").sortWithinPartitions("query", "kind", "cand")

    def merge(batches):
        for table in _groups(batches, "query"):
            query, kind = table.column("query").to_numpy(), table.column("kind").to_numpy()
            cands, nears = table.column("cand").fill_null(0).to_numpy(), table.column("near").fill_null(0).to_numpy()
            bounds = np.append(np.flatnonzero(kind == 0), len(query))
            out = []
            for a, b in zip(bounds, bounds[1:]):
                code = table.column("code")[a].as_py()
                pool, dist, done = (np.array(table.column(c)[a].as_py()) for c in ("pool", "dist", "done"))
                done = done.astype(bool) | np.isin(pool, np.array(table.column("front")[a].as_py(), np.int64))
                if b - a > 1:
                    cand, near = cands[a + 1 : b], nears[a + 1 : b]
                    new = np.append(True, cand[1:] != cand[:-1]) & ~np.isin(cand, pool)
                    pool, dist, done = np.concatenate([pool, cand[new]]).astype(np.int64), np.concatenate([dist, near[new]]), np.concatenate([done, np.zeros(int(new.sum()), bool)])
                order = np.lexsort((pool, dist))[:size]
                pool, dist, done = pool[order], dist[order], done[order]
                out.append((int(query[a]), code, pool.astype(np.int64), dist.astype(np.float32), done, pool[~done][:width].astype(np.int64)))
            columns = list(zip(*out))
            types = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["query", "code", "pool", "dist", "done", "front"])

    return rows.mapInArrow(merge, "query long, code binary, pool array<long>, dist array<float>, done array<boolean>, front array<long>")


def _measured(cands: DataFrame) -> DataFrame:
    """(query, cand, near) of rows (query, cand, asked, bound, code): squared distances below the bound."""

    def of(batches):
        for batch in batches:
            # Several nodes of a front list the same one; rows come sorted by it, so most repeats are in a batch.
            order = np.lexsort((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            pair = np.stack([batch.column(c).to_numpy()[order] for c in (0, 1)])
            some = order[np.append(True, (pair[:, 1:] != pair[:, :-1]).any(0))] if len(order) else order
            if len(some):
                part = batch.take(pa.array(np.sort(some)))
                near = ((_decoded(part.column(2)) - _decoded(part.column(4))) ** 2).sum(1)
                keep = near < part.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays([*(part.column(c).filter(pa.array(keep)) for c in (0, 1)), pa.array(near[keep].astype(np.float32))], ["query", "cand", "near"])

    return cands.select("query", "cand", "asked", "bound", "code").mapInArrow(of, "query long, cand long, near float")


def search(graph: DataFrame, adjacent: DataFrame, queries: DataFrame, size: int, exact: int, enter: int = ENTRIES) -> DataFrame:
    """(query, node): the exact best nodes found for each query (query, code, own node or null) by greedy search.

    A hop expands nodes of the pools that weren't before: they are joined with the graph, and their neighbours with
    the codes, where distances are taken; only what is nearer than the last of a full pool comes back.  What a pool
    drops is farther than all it keeps from then on; so hops end, and they are as many as the pools need.  The last hops
    expand a few nodes of a few queries each; they are left out once all that is left to expand is REST of the pools.
    """
    codes = graph.select(F.col("node").alias("cand"), "code")
    entries = codes.orderBy(F.xxhash64("cand"), "cand").limit(enter)
    entries = F.broadcast(entries) if enter <= SENT else written(entries, "entries")
    empty = {"pool": F.array().cast("array<long>"), "dist": F.array().cast("array<float>"), "done": F.array().cast("array<boolean>"), "front": F.array().cast("array<long>")}
    far = F.lit(float("inf")).cast("float")
    asked = queries.select("query", F.col("code").alias("asked"), far.alias("bound"))
    starts = asked.crossJoin(entries).unionByName(queries.where("own is not null").select("query", F.col("code").alias("asked"), far.alias("bound"), F.col("own").alias("cand"), "code"))
    state = written(_hop(queries.select("query", "code").withColumns(empty), _measured(starts), size), "pools")
    while True:
        left, held = state.agg(F.sum(F.size("front")), F.sum(F.size("pool"))).first()
        if left <= REST * held:
            break
        last = F.when(F.size("pool") >= size, F.element_at("dist", -1)).otherwise(far)
        front = state.select("query", F.col("code").alias("asked"), last.alias("bound"), F.explode("front").alias("node"))
        cands = front.join(adjacent, "node").select("query", "asked", "bound", F.explode("next").alias("cand"))
        new = written(_hop(state, _measured(cands.join(codes, "cand")), size), "pools")
        dropped(state)
        state = new
    return state.select("query", F.explode(F.slice("pool", 1, exact)).alias("node"))


def _compared(nodes: DataFrame, queries: list, most: int, coded: bool = False) -> DataFrame:
    """(query, node, r): the nearest nodes and their ranks, most at most, of the sample (query, vector), by all nodes
    (node, vector); coded: vectors are codes."""
    read = _decoded if coded else _doubles
    ids, asked = np.array([q for q, _ in queries], np.int64), read([bytes(v) for _, v in queries])

    def of(batches):
        best, near = np.full((len(ids), 0), -1, np.int64), np.full((len(ids), 0), np.inf)
        norm = (asked * asked).sum(1)
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                own = batch.slice(a, STEP)
                x = read(own.column(1))
                near = np.concatenate([near, norm[:, None] + (x * x).sum(1) - 2 * asked @ x.T], 1)
                best = np.concatenate([best, np.broadcast_to(own.column(0).to_numpy(), (len(ids), len(x)))], 1)
                if near.shape[1] > most:
                    keep = np.argpartition(near, most - 1, 1)[:, :most]
                    near, best = np.take_along_axis(near, keep, 1), np.take_along_axis(best, keep, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(best.ravel()), pa.array(near.ravel())], ["query", "node", "dist"])

    rows = nodes.select("node", "vector").mapInArrow(of, "query long, node long, dist double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("dist", "node"))
    return rows.withColumn("r", place).where(F.col("r") <= most)


def _found(nodes: DataFrame, n: int, asked: DataFrame, width: int, k: int) -> DataFrame:
    """(query, node): nodes among which are GOAL of the k nearest other nodes of the queries, by a sample of them."""
    exact = max(EXACT, 4 * k)
    total = asked.count()
    few = total <= SAMPLE
    sample = asked if few else written(asked.orderBy(F.xxhash64("query"), "query").limit(SAMPLE), "sample")
    held = sample.select("query", "vector", "own", "code").collect()
    own = {q: o for q, _, o, _ in held}
    true: dict[int, set[int]] = {q: set() for q in own}
    for q, node, _ in sorted(_compared(nodes, [(q, v) for q, v, _, _ in held], k + 1).select("query", "node", "r").collect(), key=lambda r: r[2]):
        if node != own[q] and len(true[q]) < k:
            true[q].add(node)
    wanted = GOAL * sum(map(len, true.values()))
    hits = lambda found: sum(node in true[q] for q, node in found.select("query", "node").toLocalIterator())
    graph = build(nodes.select("node", "code"), n, width)
    adjacent = written(_adjacent(graph), "adjacent")
    size, enter, precise = max(POOL, exact), ENTRIES, False
    while True:
        found = written(search(graph, adjacent, sample.select("query", "own", "code"), size, exact, enter), "found")
        if hits(found) >= wanted or min(size, enter, exact) >= n:
            return found if few else search(graph, adjacent, asked.select("query", "own", "code"), size, exact, enter)
        dropped(found)
        if not precise and hits(_compared(nodes.select("node", F.col("code").alias("vector")), [(q, c) for q, _, _, c in held], exact, True)) < wanted:
            precise = True
            nodes, asked = _recoded(nodes), _recoded(asked)
            sample = asked if few else asked.join(F.broadcast(sample.select("query")), "query", "left_semi")  # SAMPLE ids
            for table in (graph, adjacent):
                dropped(table)
            graph = build(nodes.select("node", "code"), n, width)
            adjacent = written(_adjacent(graph), "adjacent")
            continue
        size, enter, exact = 2 * size, 2 * enter, 2 * exact


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows found to each query: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows but those of the query's own id;
    scores are exact distances in double precision, ties go to the smaller vec_id.  Vectors that are null, empty,
    zero or hold null or non-finite components take no part, nor do null ids.  Vectors of each length are searched among
    their own, one length after another.  Rows that share an id count once, by their smallest distance.  With fewer
    than k candidates all found are returned; an empty table gives no rows; other columns are not read.
    """
    with scratch() as keep:
        return keep(written(_nearest(vectors, every, k, id_col, vector_col), "nearest"))


def _nearest(vectors: DataFrame, every: int, k: int, id_col: str, vector_col: str) -> DataFrame:
    rows = written(_clean(vectors, id_col, vector_col), "vectors")
    lengths = [r.length for r in rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("length").distinct().orderBy("length").collect()]  # lengths of queries
    out = rows.select(F.col("vec_id").alias("query"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    for width in lengths:
        out = out.unionByName(_of_length(rows.where(F.col("length") == width), every, k, width))
    best = out.groupBy("query", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def _of_length(rows: DataFrame, every: int, k: int, width: int) -> DataFrame:
    """(query, vec_id, score): for each query among rows, at least its k nearest found and no row of its own."""
    # The k + 1 smallest ids of each class of equal vectors, first by salt: a class may hold a third of all rows.
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    few = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2", *by).orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    copies = few(few(rows.select("vec_id", "k1", "k2").distinct().withColumn("salt", salt), "salt"))
    classes = copies.groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    unique = rows.groupBy("k1", "k2").agg(F.first("vector").alias("vector"))

    def coded(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_coded(_doubles(batch.column(4))) if batch.num_rows else [], pa.binary())], ["node", "members", "k1", "k2", "vector", "code"])

    joined = classes.join(unique, ["k1", "k2"]).select("node", "members", "k1", "k2", "vector")
    nodes = written(joined.mapInArrow(coded, "node long, members array<long>, k1 long, k2 long, vector binary, code binary"), "nodes")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query"), "k1", "k2").join(nodes.select("k1", "k2", "node", "code", "vector"), ["k1", "k2"])
    asked = written(asked.dropDuplicates(["query"]).select("query", F.col("node").alias("own"), "code", "vector"), "queries")
    found = _found(nodes, nodes.count(), asked, width, k)
    ranked = found.join(nodes.select("node", "members", "vector"), "node").join(asked.select("query", F.col("vector").alias("asked")), "query")

    def scored(batches):
        for batch in batches:
            x, y = _doubles(batch.column(2)), _doubles(batch.column(3))
            score = np.sqrt(((x - y) ** 2).sum(1)) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query", "members", "score"])

    out = ranked.select("query", "members", "vector", "asked").mapInArrow(scored, "query long, members array<long>, score double")
    return out.select("query", "score", F.explode("members").alias("vec_id")).where("vec_id <> query").select("query", "vec_id", "score")
