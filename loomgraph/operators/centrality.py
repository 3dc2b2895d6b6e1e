"""Core numbers, betweenness, importance and communities.

Core numbers: repeated h-index of the neighbours' values, from counts by value, so a hub's
neighbours are never gathered.  Betweenness: exact; while the edges are few enough to be
sent to executors (checked), trees are folded into the nodes where they hang and sources
are spread over tasks that each hold the adjacency of the rest; beyond that, blocks of sources advance level by level as joins; a sampled estimate with its
error stands beside it.  Communities: local moving by modularity in turns, then contraction,
repeated until nothing gains; graphs of a checked size on arrays in one task, larger ones as
joins, by one rule and with one result.

Defined results: self loops and repeated pairs are ignored, isolated nodes have core 0,
betweenness 0 and their own community; equal gains go to the least community id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import cut, shuffle_partitions
from .graph import both_ways

#: Most directed edges of an adjacency that is sent to executors (8 bytes each).
SEND_EDGES = 4_000_000


def core_numbers(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``id, core``: rounds go on until nothing changes (values only fall); ``max_rounds`` used up before is an error."""
    adj = cut(both_ways(edges))
    cur = cut(adj.groupBy("src").agg(F.count("*").alias("core")).withColumnRenamed("src", "id"))
    changed, rounds = 1, 0
    while changed:
        if rounds == max_rounds:
            raise RuntimeError("core numbers did not settle")
        seen = adj.join(cur.select(F.col("id").alias("dst"), F.col("core").alias("c")), "dst").join(cur.select(F.col("id").alias("src"), "core"), "src")
        tally = seen.groupBy("src", F.least("c", "core").alias("value")).agg(F.count("*").alias("n"))
        at_least = F.sum("n").over(W.partitionBy("src").orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, 0))
        h = tally.withColumn("m", F.least("value", at_least)).groupBy("src").agg(F.max("m").alias("core"))
        new = cut(h.withColumnRenamed("src", "id"), fresh=True)
        changed = new.join(cur.withColumnRenamed("core", "old"), "id").where("core != old").limit(1).count()
        cur, rounds = new, rounds + 1
    return nodes.select("id").join(cur, "id", "left").na.fill(0, ["core"])


def _levels(start: np.ndarray, to: np.ndarray, sources: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Distances, a row for each bit, from the nearest of its sources (-1: none); up to 64 searches go in the bits of a word."""
    n, width = len(start) - 1, int(bit.max()) + 1
    out, degree = np.full((n, width), -1, np.int16), np.diff(start)
    new = np.zeros(n, np.uint64)
    np.bitwise_or.at(new, sources, np.uint64(1) << bit.astype(np.uint64))
    seen, level = new.copy(), 0
    while len(at := np.flatnonzero(new)):
        if level > np.iinfo(out.dtype).max:
            out = out.astype(np.int32)
        reached = np.unpackbits(new[at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        rows = out[at]
        rows[reached.view(bool)] = level
        out[at] = rows
        size = degree[at]
        if 8 * size.sum() < len(to):
            got, first = np.zeros(n, np.uint64), np.cumsum(size) - size
            np.bitwise_or.at(got, to[np.arange(size.sum()) + np.repeat(start[at] - first, size)], np.repeat(new[at], size))
        else:
            got = np.bitwise_or.reduceat(new[to], start[:-1])
        new, level = got & ~seen, level + 1
        seen |= new
    return np.ascontiguousarray(out.T)


def _dependencies(s: int, dist: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Brandes' dependencies of a source on all nodes, level by level; a node stands for ``weight`` ends of paths."""
    n, from_ = len(weight), dist[src]
    down = np.flatnonzero(from_ < dist[dst])
    level = from_[down]
    down = down[np.argsort(level, kind="stable")]
    tail, head = src[down], dst[down]
    ends = np.r_[0, np.cumsum(np.bincount(level))]
    sigma, delta = np.zeros(n), np.zeros(n)
    sigma[s] = 1

    def add(into: np.ndarray, at: np.ndarray, what: np.ndarray) -> None:
        if 16 * len(at) < n:
            np.add.at(into, at, what)
        else:
            into += np.bincount(at, what, n)

    for i, j in zip(ends, ends[1:]):
        add(sigma, head[i:j], sigma[tail[i:j]])
    for i, j in zip(ends[-2::-1], ends[:0:-1]):
        h, t = head[i:j], tail[i:j]
        add(delta, t, (weight[h] + delta[h]) / sigma[h] * sigma[t])
    delta[s] = 0
    return delta


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(n)
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    return label


def _folded(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees folded into where they hang: which edges stay, how many nodes each node stands for, and ordered pairs whose paths trees send through it."""
    degree = np.bincount(np.r_[a, b], minlength=n)
    near, weight, square = np.zeros(n, np.int64), np.ones(n), np.zeros(n)
    np.bitwise_xor.at(near, a, b)
    np.bitwise_xor.at(near, b, a)
    gone, leaves = np.zeros(n, bool), np.flatnonzero(degree == 1)
    while len(leaves):
        # of two leaves that are only linked to each other the lesser stays
        leaves = leaves[(degree[near[leaves]] > 1) | (near[leaves] < leaves)]
        to = near[leaves]
        gone[leaves] = True
        degree[leaves] = 0
        np.subtract.at(degree, to, 1)
        np.bitwise_xor.at(near, to, leaves)
        np.add.at(weight, to, weight[leaves])
        np.add.at(square, to, weight[leaves] ** 2)
        leaves = np.unique(to[degree[to] == 1])
    label = _components(n, a, b)
    whole = np.bincount(label, minlength=n)[label].astype(float)
    return ~(gone[a] | gone[b]), weight, (whole - 1) ** 2 - square - (whole - weight) ** 2


def betweenness(nodes: DataFrame, edges: DataFrame, normalised: bool = True) -> DataFrame:
    """``id, betweenness`` of the undirected, unweighted graph; raw values count unordered pairs."""
    spark = nodes.sparkSession
    adj = cut(both_ways(edges))
    m = adj.count()
    n = nodes.count()
    raw = _betweenness_sent(spark, adj) if m <= SEND_EDGES else _betweenness_joined(adj)
    scale = 2.0 / ((n - 1) * (n - 2)) if normalised and n > 2 else 1.0
    return nodes.select("id").join(raw, "id", "left").select("id", (F.coalesce("raw", F.lit(0.0)) / 2 * scale).alias("betweenness"))


def betweenness_sampled(nodes: DataFrame, edges: DataFrame, most_sources: int = 1_000, normalised: bool = True) -> DataFrame:
    """``id, betweenness, error``: estimated from about ``most_sources`` sources chosen by hash.

    ``error`` is the standard error of the mean of a source's part, so small samples say so;
    with as many sources as nodes the value is exact and the error 0.
    """
    adj = cut(both_ways(edges))
    n = nodes.count()
    ids = adj.select(F.col("src").alias("id")).distinct()
    total = ids.count()
    share = min(1.0, most_sources / total) if total else 1.0
    picked = cut(ids.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1_000_000)) < int(share * 1_000_000))) if share < 1 else cut(ids)
    s = picked.count()
    if not s:
        return nodes.select("id", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("error"))
    raw = _betweenness_sent(nodes.sparkSession, adj, picked) if adj.count() <= SEND_EDGES else _betweenness_joined(adj, sources=picked)
    scale = (2.0 / ((n - 1) * (n - 2)) if normalised and n > 2 else 1.0) / 2 * total / s
    mean = F.col("raw") / s
    spread = F.sqrt(F.greatest(F.col("square") / s - mean * mean, F.lit(0.0)) * (1 - s / total) / s) * total
    out = nodes.select("id").join(raw, "id", "left").na.fill(0.0, ["raw", "square"])
    return out.select("id", (F.col("raw") * scale).alias("betweenness"), (spread * scale * s / total).alias("error"))


def _betweenness_sent(spark, adj: DataFrame, chosen: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """``id, raw, square`` from all sources, or from the ``chosen`` ones; without these trees are folded first (and ``square`` is of what is left)."""
    names, pairs = _numbered(adj)
    got = pairs.toArrow()
    ids, at = np.unique(np.concatenate([got.column(c).to_numpy() for c in "ab"]), return_inverse=True)
    a, b, n = at[: len(at) // 2], at[len(at) // 2 :], len(ids)
    every = chosen is None
    stays, weight, base = _folded(n, a, b) if every else (np.ones(len(a), bool), np.ones(n), np.zeros(n))
    # the nodes left by component, and in it from its hub outwards, so that what is near lies near
    left, at = np.unique(np.r_[a[stays], b[stays]], return_inverse=True)
    src, dst = at, np.r_[at[len(at) // 2 :], at[: len(at) // 2]]
    start = np.searchsorted(np.sort(src), np.arange(len(left) + 1))
    order = np.arange(len(left))
    if len(left):
        label = _components(len(left), src, dst)
        hubs = np.lexsort((-np.diff(start), label))
        hubs = hubs[np.r_[True, np.diff(label[hubs]) > 0]]
        far = _levels(start, dst[np.argsort(src, kind="stable")], hubs, np.zeros(len(hubs), np.int64))[0]
        order = np.lexsort((far, label))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        src, dst = place[src], place[dst]
        by = np.lexsort((dst, src))
        src, dst, left, label = src[by], dst[by], left[order], label[order]
        start = np.searchsorted(src, np.arange(len(left) + 1))
        bounds = np.flatnonzero(np.r_[True, np.diff(label) != 0, True])
    else:
        bounds = np.zeros(1, np.int64)
    shared = spark.sparkContext.broadcast((ids[left], weight[left], start, src.astype(np.int32), dst.astype(np.int32), bounds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, weight, start, src, dst, bounds = shared.value
        out, square, by_id = np.zeros(len(nodes)), np.zeros(len(nodes)), np.argsort(nodes)
        for batch in batches:
            s = np.sort(batch["id"].to_numpy() if every else by_id[np.searchsorted(nodes, batch["id"], sorter=by_id)])
            part = np.searchsorted(bounds, s, "right") - 1
            for p in np.unique(part):
                lo, hi = bounds[p], bounds[p + 1]
                x, y = (e[start[lo] : start[hi]].astype(np.int64) - lo for e in (src, dst))
                own, first, w = s[part == p] - lo, start[lo : hi + 1] - start[lo], weight[lo:hi]
                for i in range(0, len(own), 64):
                    some = own[i : i + 64]
                    for k, dist in zip(some, _levels(first, y, some, np.arange(len(some)))):
                        d = _dependencies(k, dist, x, y, w) * w[k]
                        out[lo:hi] += d
                        if not every:
                            square[lo:hi] += d * d
        hit = np.flatnonzero(out)
        yield pd.DataFrame({"node": nodes[hit], "part": out[hit], "square": square[hit]})

    if every:
        sources = spark.range(0, len(left), 1, max(1, min(len(left), 4 * shuffle_partitions(spark))))
    else:
        sources = names.join(chosen, "id").select(F.col("node").alias("id")).repartition(max(1, min(n, 4 * shuffle_partitions(spark))))
    parts = sources.mapInPandas(run, "node bigint, part double, square double")
    hung = np.flatnonzero(base)
    parts = parts.unionByName(spark.createDataFrame(pa.table({"node": ids[hung], "part": base[hung], "square": np.zeros(len(hung))}), "node bigint, part double, square double"))
    parts = parts.groupBy("node").agg(F.sum("part").alias("raw"), F.sum("square").alias("square"))
    return parts.join(names, "node").select("id", "raw", "square")


def _betweenness_joined(adj: DataFrame, block: int = 64, sources: DataFrame | None = None) -> DataFrame:
    """Level-synchronous: forward counts of shortest paths, then dependencies backwards, for blocks of sources."""
    every = adj.select(F.col("src").alias("id")).distinct() if sources is None else sources
    ids = cut(every.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(block))))
    total = None
    for k in range(block):
        seen = cut(ids.where(F.col("b") == k).select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))
        level, front = 0, seen
        while front.limit(1).count():
            nxt = front.join(adj, front["v"] == adj["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
            front = cut(nxt.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(level + 1).alias("d"), "sigma"))
            seen = seen.unionByName(front)
            level += 1
        seen = cut(seen)
        delta = cut(seen.where(F.col("d") == level - 1).select("s", "v", F.lit(0.0).alias("delta")))
        done = delta
        for d in range(level - 1, 0, -1):
            below = seen.where(F.col("d") == d).join(delta, ["s", "v"], "left").select("s", "v", ((1 + F.coalesce("delta", F.lit(0.0))) / F.col("sigma")).alias("f"))
            up = below.join(adj, below["v"] == adj["src"]).select("s", F.col("dst").alias("v"), "f").groupBy("s", "v").agg(F.sum("f").alias("f"))
            delta = cut(seen.where(F.col("d") == d - 1).join(up, ["s", "v"]).select("s", "v", (F.col("sigma") * F.col("f")).alias("delta")))
            done = done.unionByName(delta)
        part = done.where("s != v").groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("raw"), F.sum(F.col("delta") * F.col("delta")).alias("square"))
        total = cut(part if total is None else total.unionByName(part).groupBy("id").agg(F.sum("raw").alias("raw"), F.sum("square").alias("square")))
    return total


def importance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, importance``: mean of betweenness and core number, each over its maximum (a zero maximum counts as 1)."""
    both = betweenness(nodes, edges).join(core_numbers(nodes, edges), "id")
    both = cut(both)
    top = both.agg(F.max("betweenness").alias("b"), F.max("core").alias("c"))
    one = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, F.lit(1.0)).otherwise(c)
    score = (F.col("betweenness") / one(F.col("b")) + F.col("core") / one(F.col("c"))) / 2
    return both.join(F.broadcast(top), F.lit(True)).select("id", score.alias("importance"))


def important_entities(nodes: DataFrame, scores: DataFrame, fraction: float = 0.2) -> DataFrame:
    """The top share of entities by score, at least one; equal scores in order of arrival."""
    e = nodes.where("type = 'N'").join(scores, "id")
    n = e.count()
    return e.orderBy(F.desc("importance"), "seq", "id").limit(max(1, int(n * fraction)) if n else 0)


def _parts(r: int) -> int:
    """In how many turns the nodes of a pass move: two at first, more while a level does not settle."""
    return 2 << min(r // 8, 28)


#: Turns are drawn anew each pass from a node's number and a power of a primitive root (fixed values).
PRIME, ROOT = 2**31 - 1, 48_271


def _factor(r: int) -> int:
    return pow(ROOT, r + 1, PRIME)


def _best(own: np.ndarray, com: np.ndarray, k: np.ndarray, total: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float, two_m: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the nodes ``own``, whose edges are given, that gain by moving, ascending, and where to."""
    n = len(com)
    pair, at = np.unique(np.r_[src, own] * n + np.r_[com[dst], com[own]], return_inverse=True)
    kin = np.bincount(at, np.r_[w, np.zeros(len(own))])
    v, c = pair // n, pair % n
    rest = total[c] - np.where(c == com[v], k[v], 0.0)
    gain = np.floor((kin - resolution * k[v] * rest / two_m) * 1e9 + 0.5)
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    best = np.maximum.reduceat(gain, first)
    top = np.flatnonzero(gain == np.repeat(best, np.diff(np.r_[first, len(v)])))
    # communities ascend within a node, so the first of the best is the least
    x, i = np.unique(v[top], return_index=True)
    go = best > gain[c == com[v]]
    return x[go], c[top[i]][go]


def _local_moving(ids: np.ndarray, mark: np.ndarray, src: np.ndarray, dst: np.ndarray, resolution: float, most_passes: int | None) -> np.ndarray:
    """The least member of each node's community. The rule of ``communities`` on arrays; ``ids`` are sorted, ends are their numbers.

    Only nodes whose turn it is are looked at. Several turns are looked at together, as many
    as are likely to have one move between them: up to the first that has moves they see the
    same state.
    """
    w = np.ones(len(src))
    two_m, member = float(len(src)), np.arange(len(ids))
    while True:
        k = np.bincount(src, w, len(ids))
        here = np.unique(src)
        com, total = np.arange(len(ids)), k.copy()
        off = src != dst
        s, d, f = src[off], dst[off], w[off]
        r, last = 0, len(here)
        while r != most_passes:
            parts, moved, part = _parts(r), 0, 0
            turn = mark * _factor(r) % PRIME // 8 % parts
            edges, nodes = np.argsort(turn[s], kind="stable"), here[np.argsort(turn[here], kind="stable")]
            edge_turn, node_turn = turn[s][edges], turn[nodes]
            while part < parts:
                to = min(parts, part + max(1, parts // (last + 1)))
                at = edges[slice(*np.searchsorted(edge_turn, (part, to)))]
                own = nodes[slice(*np.searchsorted(node_turn, (part, to)))]
                x, c = _best(own, com, k, total, s[at], d[at], f[at], resolution, two_m) if len(own) else (own, own)
                if len(x):
                    to = int(turn[x].min()) + 1
                    x, c = x[turn[x] < to], c[turn[x] < to]
                    np.subtract.at(total, com[x], k[x])
                    np.add.at(total, c, k[x])
                    com[x] = c
                    moved += len(x)
                part = to
            if not moved:
                break
            r, last = r + 1, moved
        else:
            raise RuntimeError("communities did not settle")
        least = np.full(len(ids), len(ids))
        np.minimum.at(least, com[here], here)
        label = np.arange(len(ids))
        label[here] = least[com[here]]
        if (label == np.arange(len(ids))).all():
            return member
        member = label[member]
        pair, at = np.unique(label[src] * len(ids) + label[dst], return_inverse=True)
        w, src, dst = np.bincount(at, w), pair // len(ids), pair % len(ids)


def _numbered(adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, node``, numbers in the order of the ids, and the edges ``a, b`` as numbers, each once with a < b."""
    ids = adj.select(F.col("src").alias("id")).distinct().repartitionByRange(shuffle_partitions(adj.sparkSession), "id").sortWithinPartitions("id")
    names = cut(ids.select("id", F.monotonically_increasing_id().alias("node")))
    one = adj.where("src < dst").join(names.select(F.col("id").alias("src"), F.col("node").alias("a")), "src")
    return names, cut(one.join(names.select(F.col("id").alias("dst"), F.col("node").alias("b")), "dst").select("a", "b"))


def _communities_in_task(graph: DataFrame, resolution: float, most_passes: int | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = pd.concat(list(batches), ignore_index=True)
        if e.empty:
            return
        ends = e[["a", "b"]].to_numpy().T.ravel()
        ids, first, at = np.unique(ends, return_index=True, return_inverse=True)
        mark = e[["ma", "mb"]].to_numpy().T.ravel()[first]
        a, b = at[: len(e)], at[len(e) :]
        label = _local_moving(ids, mark, np.r_[a, b], np.r_[b, a], resolution, most_passes)
        yield pd.DataFrame({"node": ids, "to": ids[label]})

    names, pairs = _numbered(graph)
    marked = names.select("node", _mark("id").alias("m"))
    sent = pairs.join(marked.toDF("a", "ma"), "a").join(marked.toDF("b", "mb"), "b")
    got = cut(cut(sent).coalesce(1).mapInPandas(run, "node bigint, to bigint"))
    return got.join(names, "node").join(names.select(F.col("node").alias("to"), F.col("id").alias("c2")), "to").select("id", "c2")


def _mark(c: str) -> Column:
    """A number that gives a node its turn, at every level that of its label."""
    return F.pmod(F.xxhash64(c), F.lit(PRIME))


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, send_edges: int = SEND_EDGES, most_passes: int | None = None) -> DataFrame:
    """``id, community``: modularity communities; the label is the least node id inside.

    Nodes move in turns to the neighbouring community of largest gain (ties: least label)
    until no node of any level gains; parts of a pass become smaller while a level does
    not settle, down to single nodes, whose moves only gain; ``most_passes`` used up before is an error.  Graphs of at most ``send_edges`` directed edges do this on arrays in one
    task, larger ones as joins: the rule and so the result is the same.
    """
    graph = cut(both_ways(edges).select("src", "dst", F.lit(1.0).alias("w")))
    m = graph.count()
    if 0 < m <= send_edges:
        small = _communities_in_task(graph, resolution, most_passes)
        return nodes.select("id").join(small, "id", "left").select("id", F.coalesce("c2", "id").alias("community"))
    member = nodes.select("id", F.col("id").alias("c"))
    if not m:
        return member.withColumnRenamed("c", "community")
    two_m = float(m)
    while True:
        strength = graph.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("k"))
        own = cut(strength.select("v", F.col("v").alias("c"), "k"), fresh=True)
        r = 0
        while r != most_passes:
            parts, n_moved, part = _parts(r), 0, 0
            turn = F.expr(f"pmod(xxhash64(v), {PRIME}) * {_factor(r)} % {PRIME} div 8 % {parts}")
            while part < parts:
                # all turns left are looked at together: up to the first that has moves they see the same state
                total = own.groupBy("c").agg(F.sum("k").alias("tot"))
                ends = graph.where("src != dst").select(F.col("src").alias("v"), "dst", "w").where(turn >= part)
                link = ends.join(own.select(F.col("v").alias("dst"), "c"), "dst").groupBy("v", "c").agg(F.sum("w").alias("kin"))
                here = own.where(turn >= part).select("v", F.col("c").alias("old"), "k")
                cand = link.unionByName(here.select("v", F.col("old").alias("c"), F.lit(0.0).alias("kin"))).groupBy("v", "c").agg(F.sum("kin").alias("kin"))
                cand = cand.join(here, "v").join(total, "c")
                stays = F.col("c") == F.col("old")
                rest = F.col("tot") - F.when(stays, F.col("k")).otherwise(F.lit(0.0))
                gain = F.floor((F.col("kin") - F.lit(resolution) * F.col("k") * rest / F.lit(two_m)) * F.lit(1e9) + F.lit(0.5))
                # the best is a maximum of pairs of gain and place from the end, so nothing is sorted
                best = cand.withColumn("g", gain).groupBy("v").agg(F.min(F.struct((-F.col("g")).alias("g"), "c")).alias("top"), F.max(F.when(stays, F.col("g"))).alias("now"))
                goes = cut(best.where(-F.col("top.g") > F.col("now")).select("v", F.col("top.c").alias("to"), turn.alias("turn")), fresh=True)
                first = goes.agg(F.min("turn")).first()[0]
                if first is None:
                    break
                goes = goes.where(F.col("turn") == first)
                n_moved += goes.count()
                own = cut(own.join(goes.select("v", "to"), "v", "left").select("v", F.coalesce("to", "c").alias("c"), "k"), fresh=True)
                part = first + 1
            if not n_moved:
                break
            r += 1
        else:
            raise RuntimeError("communities did not settle")
        label = own.select("v", "c")
        least = label.groupBy("c").agg(F.min("v").alias("l"))
        label = cut(label.join(least, "c").select("v", F.col("l").alias("c2")), fresh=True)
        if not label.where("v != c2").limit(1).count():
            break
        member = cut(member.join(label.withColumnRenamed("v", "c"), "c", "left").select("id", F.coalesce("c2", "c").alias("c")), fresh=True)
        graph = graph.join(label.select(F.col("v").alias("src"), F.col("c2").alias("s")), "src").join(label.select(F.col("v").alias("dst"), F.col("c2").alias("d")), "dst")
        graph = cut(graph.groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w")), fresh=True)
    return member.withColumnRenamed("c", "community")


def modularity(edges: DataFrame, member: DataFrame, resolution: float = 1.0) -> float:
    e = both_ways(edges)
    a = member.select(F.col("id").alias("src"), F.col("community").alias("cs"))
    b = member.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    j = e.join(a, "src").join(b, "dst")
    total = e.count()
    if not total:
        return 0.0
    inside = j.where("cs = cd").count() / total
    deg = j.groupBy("cs").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside - resolution * deg / total**2
