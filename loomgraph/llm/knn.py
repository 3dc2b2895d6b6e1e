"""Most similar vectors for every vector: a block matrix join on int8 tiles.

Vectors are normalised and placed in cells of two levels: centroids of the first are fitted
on a bounded sample, those of the second, within each cell of the first, in tasks on a
bounded sample of that cell.  A tile is one block of a cell's own vectors against the
vectors that probe the cell.  Inside a tile an int8 product gives every cosine with a proven
error bound; only pairs whose upper bound can still matter are recomputed in double
precision, and a bounded heap per vector keeps its best partners of the tile.  The heaps of
all tiles are merged by rank.

Defined results: null, wrong-width, all-zero or non-finite vectors take no part.  Rows
that repeat a vector exactly form one class, compared once; ties in cosine go to the
smaller node id.  Empty input gives an empty result.  The pair of a node with itself
is never returned, however often the node was delivered.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..runtime import cut

#: Vectors on which first centroids are fitted at most, and Lloyd rounds of either level.
FIT_ROWS, FIT_ROUNDS = 16_384, 4
#: Average vectors of a cell; most cells of the first level and within one of them (together 64 MB of centroids at width 64).
CELL_ROWS, FIRST_CELLS, SECOND_CELLS = 512, 256, 1_024
#: First-level cells within which a vector looks for its nearest cells of the second level.
FIRST_PROBES = 6
#: Vectors a second-level centroid is fitted on, about (so a cell's sample has at most 32,768 rows).
FIT_PER_CELL = 32
#: Most vectors of one block of a tile, and most query vectors that are sent to the executors at once.
BLOCK, SENT_QUERIES = 4_096, 65_536
#: Most vectors that visit one tile, about; more are cut into blocks as well, each a tile with the same own vectors.
VISITORS = 16_384


def usable(df: DataFrame, width: int = 64) -> DataFrame:
    """Rows ``id, node_id, embedding`` whose vector has ``width`` finite values, not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e30)))
    some = F.exists("embedding", lambda x: x != 0)
    return df.select("id", "node_id", "embedding").where(F.col("node_id").isNotNull() & (F.size("embedding") == width) & finite & some)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list<float> column as unit rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    top = np.abs(flat).max(axis=1, keepdims=True)
    flat = flat / top
    return flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def int8_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scales, and the norm of what rounding lost."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-12) / 127.0
    code = np.rint(x / scale[:, None])
    lost = x - code * scale[:, None]
    return code.astype(np.int8), scale.astype(np.float32), np.sqrt(np.einsum("ij,ij->i", lost, lost))


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows.

    A sum of up to 1,040 products of codes stays under 2^24, so single precision holds it
    exactly, and the fast matrix product of floats serves as one of integers.
    """
    if a.shape[1] * 127 * 127 >= 1 << 24:
        return (a.astype(np.int32) @ b.astype(np.int32).T).astype(np.float64)
    return a.astype(np.float32) @ b.astype(np.float32).T


def tile_pairs(xa: np.ndarray, ca: tuple, xb: np.ndarray, cb: tuple, floor: float | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, cosine) with cosine >= floor (one for all, or one a row of ``xa``); ``ca`` and ``cb`` are the codes.

    x.y = xq.yq + dx.yq + x.dy, so the int8 estimate is off by at most
    |dx|(1 + |dy|) + |dy|; pairs under floor by more than that are dropped unseen.
    """
    (qa, sa, ea), (qb, sb, eb) = ca, cb
    est = int8_product(qa, qb)
    bound = ea.max() * (1 + eb.max()) + eb.max() + 1e-5
    est *= sa[:, None]
    est *= sb[None, :]
    low = np.broadcast_to(np.asarray(floor, np.float64), len(xa))
    i, j = np.nonzero(est >= (low - bound)[:, None])
    cosine = np.einsum("ij,ij->i", xa[i], xb[j])
    keep = cosine >= low[i]
    return i[keep], j[keep], cosine[keep]


class Heaps:
    """A bounded heap for each of n rows: the k best partners so far, by cosine, then smaller id; a partner counts once."""

    def __init__(self, n: int, k: int, kind: str = "int64") -> None:
        self.k, self.cosine, self.id = k, np.full((n, k), -np.inf), np.zeros((n, k), kind)

    def push(self, row: np.ndarray, other: np.ndarray, cosine: np.ndarray) -> None:
        if not len(row):
            return
        rows, at = np.unique(row, return_inverse=True)
        held = self.cosine[rows] > -np.inf
        r = np.r_[at, np.nonzero(held)[0]]
        o, c = np.concatenate([other, self.id[rows][held]]), np.r_[cosine, self.cosine[rows][held]]
        order = np.lexsort((-c, o, r))
        r, o, c = r[order], o[order], c[order]
        once = np.r_[True, (r[1:] != r[:-1]) | (o[1:] != o[:-1])]
        r, o, c = r[once], o[once], c[once]
        keep = best(r, o, c, self.k)
        r, o, c = r[keep], o[keep], c[keep]
        order = np.lexsort((o, -c, r))
        r, o, c = r[order], o[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        fresh, ids = np.full((len(rows), self.k), -np.inf), np.zeros((len(rows), self.k), o.dtype)
        fresh[r, place], ids[r, place] = c, o
        if ids.dtype != self.id.dtype:
            self.id = self.id.astype(np.promote_types(ids.dtype, self.id.dtype))
        self.cosine[rows], self.id[rows] = fresh, ids

    def floor(self) -> np.ndarray:
        """What a partner must reach to enter, by row."""
        return self.cosine[:, -1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(self.cosine > -np.inf)
        return row, self.id[row, place], self.cosine[row, place]


def best(of: np.ndarray, other: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """Mask of the pairs that are among the first k of ``of`` by cosine, then smaller ``other``."""
    order = np.lexsort((other, -cosine, of))
    s = of[order]
    first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    mask = np.zeros(len(s), bool)
    mask[order] = np.arange(len(s)) - start < k
    return mask


def nearest_centroid(x: np.ndarray, c: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """The nearest centroid of each row, in blocks of at most ``most`` products."""
    step = max(1, most // max(1, len(c)))
    return np.concatenate([(x[i : i + step] @ c.T).argmax(axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def fit_centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means (single precision) from the first rows of the sample."""
    sample = sample.astype(np.float32)
    c = sample[:cells].copy()
    for _ in range(FIT_ROUNDS):
        near = nearest_centroid(sample, c)
        order = np.argsort(near, kind="stable")
        hit, start = np.unique(near[order], return_index=True)
        total = np.add.reduceat(sample[order], start, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c[hit] = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c[hit])
    return c


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _lists(column: np.ndarray) -> pa.ListArray:
    n, p = column.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * p + 1, p, dtype=np.int32)), pa.array(column.ravel()))


def _first_cells(df: DataFrame, centroids: np.ndarray, probes: int, width: int) -> DataFrame:
    """(cells array<int>, vh, vec): the nearest first-level cells of each vector, its own first."""
    shared = df.sparkSession.sparkContext.broadcast(centroids.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        p = min(probes, len(c))
        for whole in batches:
            for lo in range(0, whole.num_rows, 4_096):
                b = whole.slice(lo, 4_096)
                b = pa.RecordBatch.from_arrays([b.column("vh"), pa.concat_arrays([b.column("embedding")])], ["vh", "embedding"])
                x = matrix(b.column("embedding"), width).astype(np.float32)
                s = x @ c.T
                top = np.argpartition(-s, p - 1, axis=1)[:, :p]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_lists(top), b.column("vh"), pa.array([r.tobytes() for r in x], pa.binary())], ["cells", "vh", "vec"])

    return df.select("vh", "embedding").mapInArrow(run, "cells array<int>, vh bigint, vec binary")


def _second_centroids(placed: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Centroids within each first-level cell, fitted in tasks on a bounded sample of the cell."""
    sizes = {r["cell"]: r["count"] for r in placed.groupBy(F.col("cells")[0].alias("cell")).count().collect()}  # at most FIRST_CELLS rows
    want = {c: int(min(SECOND_CELLS, max(1, n // CELL_ROWS))) for c, n in sizes.items()}
    step = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (int(c), int(max(1, n // (FIT_PER_CELL * want[c]))))])
    own = F.col("cells")[0]
    sample = placed.where(F.pmod(F.xxhash64(F.lit(3), "vh"), F.element_at(step, own)) == 0).select(own.alias("cell"), "vh", "vec")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vh")
        c = fit_centroids(np.frombuffer(b"".join(rows["vec"]), np.float32).reshape(-1, width), want[int(key[0])])
        return pd.DataFrame({"cell": [key[0]], "c": [c.astype(np.float32).tobytes()]})

    got = sample.groupBy("cell").applyInPandas(fit, "cell int, c binary").collect()
    out = {r["cell"]: np.frombuffer(bytes(r["c"]), np.float32).reshape(-1, width) for r in got}
    return {c: out.get(c, np.zeros((1, width), np.float32)) for c in sizes}


def _second_cells(placed: DataFrame, second: dict[int, np.ndarray], probes: int, width: int) -> DataFrame:
    """(cells array<int>, vh, vec): the nearest second-level cells within the first-level ones of each vector, its own first."""
    base, n = {}, 0
    for c in sorted(second):
        base[c], n = n, n + len(second[c])
    shared = placed.sparkSession.sparkContext.broadcast((second, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, base = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b.column("vec"), width)
            first = np.array(b.column("cells").to_pylist())
            score = np.full((len(x), first.shape[1] * probes), -np.inf, np.float32)
            cell = np.full(score.shape, -1, np.int32)
            flat, order = first.ravel(), np.argsort(first.ravel(), kind="stable")
            cuts = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1], True])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                c = int(flat[order[lo]])
                if c not in second:
                    continue
                row, rank = np.divmod(order[lo:hi], first.shape[1])
                for i in range(0, len(row), 2_048):
                    r, k = row[i : i + 2_048], rank[i : i + 2_048]
                    s = x[r] @ second[c].T
                    p = min(probes, s.shape[1])
                    top = np.argpartition(-s, p - 1, axis=1)[:, :p]
                    at = (r[:, None], k[:, None] * probes + np.arange(p))
                    score[at], cell[at] = np.take_along_axis(s, top, 1), base[c] + top
            top = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            cells = np.take_along_axis(cell, top, 1)
            yield pa.RecordBatch.from_arrays([pa.array([[c for c in r if c >= 0] for r in cells.tolist()], pa.list_(pa.int32())), b.column("vh"), b.column("vec")], ["cells", "vh", "vec"])

    return placed.mapInArrow(run, "cells array<int>, vh bigint, vec binary")


def _tiles(rows: DataFrame, k: int, floor: float, width: int) -> DataFrame:
    """Join the blocks of each tile; rows are clustered by tile, a tile's own vectors first."""

    def out(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(c)], ["va", "vb", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, own, ids = None, [], []
        x = code = name = heaps = None

        def meet(xa: np.ndarray, ia: np.ndarray, visiting: bool) -> Iterator[pa.RecordBatch]:
            xa = xa.astype(np.float64)
            i, j, c = tile_pairs(xa, int8_codes(xa), x, code, floor)
            keep = ia[i] != name[j]
            i, j, c = i[keep], j[keep], c[keep]
            heaps.push(j, ia[i], c)
            if visiting and len(i):  # a visitor meets all of the tile at once, so its heap is full after this
                top = best(i, name[j], c, k)
                yield out(ia[i[top]], name[j[top]], c[top])

        def seal() -> Iterator[pa.RecordBatch]:
            nonlocal x, code, name, heaps
            if x is None and own:
                x, name = np.concatenate(own).astype(np.float64), np.concatenate(ids)
                code, heaps = int8_codes(x), Heaps(len(x), k)
                for i in range(0, len(x), 1024):
                    yield from meet(x[i : i + 1024], name[i : i + 1024], False)

        def close() -> Iterator[pa.RecordBatch]:
            yield from seal()
            if heaps is not None:
                row, other, c = heaps.rows()
                if len(row):
                    yield out(name[row], other, c)

        for b in batches:
            tiles, side, vh = (b.column(n).to_numpy() for n in ("tile", "side", "vh"))
            vec = _vectors(b.column("vec"), width)
            cuts = np.flatnonzero(np.r_[True, (tiles[1:] != tiles[:-1]) | (side[1:] != side[:-1]), True]) if len(tiles) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if tiles[lo] != tile:
                    yield from close()
                    tile, own, ids = tiles[lo], [], []
                    x = code = name = heaps = None
                if side[lo] == 0:
                    own.append(vec[lo:hi])
                    ids.append(vh[lo:hi])
                else:
                    yield from seal()
                    if x is not None:
                        for i in range(lo, hi, 1024):
                            yield from meet(vec[i : min(hi, i + 1024)], vh[i : min(hi, i + 1024)], True)
        yield from close()

    return rows.mapInArrow(run, "va bigint, vb bigint, cosine double")


def similar_vectors(df: DataFrame, k: int = 5, min_cosine: float = 0.9, probes: int = 4, width: int = 64) -> DataFrame:
    """``node_id_a, node_id_b, cosine`` (a < b): pairs at ``min_cosine`` or more of which one is among the k best of the other.

    Candidate cells: a pair is compared when one vector's own cell is among the
    ``probes`` nearest cells of the other.  All else is exact.
    """
    spark = df.sparkSession
    raw = usable(df, width).withColumn("vh", F.xxhash64("embedding"))
    # who holds which vector: narrow rows, pre-aggregated before each shuffle
    held = cut(raw.groupBy("vh", "node_id").agg(F.min("id").alias("id")))
    classes = held.groupBy("vh").agg(F.count("*").alias("copies"), F.min("id").alias("id"))
    n = held.count()
    if n == 0:
        return spark.createDataFrame([], "node_id_a string, node_id_b string, cosine double")
    cells = int(min(FIRST_CELLS, max(1, np.sqrt(n / CELL_ROWS))))
    step = max(1, n // FIT_ROWS)
    fit = raw.where(F.pmod("vh", F.lit(step)) == 0).orderBy(F.xxhash64("vh"), "vh").limit(FIT_ROWS).select("embedding").toArrow().column("embedding").combine_chunks()
    fit = fit if len(fit) else raw.limit(1).select("embedding").toArrow().column("embedding").combine_chunks()
    centroids = fit_centroids(matrix(fit, width), min(cells, len(fit)))

    one = raw.join(classes.select("id"), "id", "left_semi")
    first = cut(_first_cells(one, centroids, FIRST_PROBES, width))
    placed = _second_cells(first, _second_centroids(first, width), probes, width)  # placed twice rather than stored with its vectors
    # a cell of more than BLOCK vectors is cut into blocks, each its own tile, and so are many visitors; there are fewer such cells than cells
    blocks = placed.select(F.posexplode("cells").alias("p", "cell")).groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count_if(F.col("p") == 0) / BLOCK)).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.count("*") / VISITORS)).cast("int").alias("vblocks"))
    want = placed.select("vh", "vec", F.posexplode("cells").alias("p", "cell")).join(F.broadcast(blocks.where("blocks > 1 or vblocks > 1")), "cell", "left").na.fill(1, ["blocks", "vblocks"])
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vh"), n).cast("int")
    tile = lambda b, v, side: F.struct(((F.col("cell").cast("bigint") * 1_000_000 + b) * 10_000 + v).alias("tile"), F.lit(side).alias("side"))
    own, visit = part(7, F.col("blocks")), part(8, F.col("vblocks"))
    # own vectors go to all tiles of their block, and visit those of the other blocks; visitors go to one tile of each block
    at_home = F.transform(F.sequence(F.lit(0), F.col("vblocks") - 1), lambda v: tile(own, v, 0))
    others = F.filter(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: tile(b, visit, 1)), lambda t: (F.col("p") > 0) | ~F.array_contains(F.transform(at_home, lambda h: h["tile"]), t["tile"]))
    tiles = F.when(F.col("p") == 0, F.concat(at_home, others)).otherwise(others)
    rows = want.select(F.inline(tiles), "vh", "vec")
    found = _tiles(rows.repartition("tile").sortWithinPartitions("tile", "side"), k, min_cosine, width).groupBy("va", "vb").agg(F.max("cosine").alias("cosine"))
    return _expand(found, held, classes, k)


def _expand(found: DataFrame, held: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """From pairs of vectors to pairs of nodes.

    A class of copies needs only its first k + 1 node ids as partners: every node has k
    better or equal ones among them.  They are ranked in two steps so that no task
    sorts a large class.
    """
    many = classes.where("copies > 1").select("vh", "copies")
    salted = W.partitionBy("vh", "salt").orderBy("node_id")
    inside = (
        held.join(many, "vh")
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        .withColumn("r", F.row_number().over(salted))
    )
    heads = inside.where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(W.partitionBy("vh").orderBy("node_id"))).where(F.col("r") <= k + 1)
    # pairs inside a class: each member and the first k others
    near = heads.select("vh", F.col("node_id").alias("other"), "r")
    within = held.join(near, "vh").where("node_id != other").select(F.col("node_id").alias("x"), F.col("other").alias("y"), F.lit(1.0).alias("cosine"))
    # pairs of different vectors: a member of one class, the first members of the other
    sides = F.array(F.struct(F.col("va").alias("v"), F.col("vb").alias("vy")), F.struct(F.col("vb").alias("v"), F.col("va").alias("vy")))
    both = found.select(F.inline(sides), "cosine")
    pos = W.partitionBy("v").orderBy(F.desc("cosine"), "vy")
    both = both.withColumn("r", F.row_number().over(pos)).where(F.col("r") <= k).drop("r")
    single = held.join(classes.where("copies = 1").select("vh"), "vh", "left_semi").select(F.col("vh").alias("vy"), F.col("node_id").alias("y"))
    partner = single.union(heads.select(F.col("vh").alias("vy"), F.col("node_id").alias("y")))
    # members of a class with more than k copies have their k best inside it
    owner = held.join(classes.where(F.col("copies") <= k).select("vh"), "vh", "left_semi").select(F.col("vh").alias("v"), F.col("node_id").alias("x"))
    across = both.join(owner, "v").join(partner, "vy").where("x != y").select("x", "y", "cosine")
    ranked = within.union(across).groupBy("x", "y").agg(F.max("cosine").alias("cosine"))
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy("x").orderBy(F.desc("cosine"), "y"))).where(F.col("r") <= k)
    return ranked.groupBy(F.least("x", "y").alias("node_id_a"), F.greatest("x", "y").alias("node_id_b")).agg(F.max("cosine").alias("cosine"))


def nearest_of(queries: DataFrame, base: DataFrame, k: int = 5, width: int = 64, most_sent: int = SENT_QUERIES) -> DataFrame:
    """``node_id, neighbour, cosine, rank``: the exact k best of ``base`` for each stated query vector.

    Blocks of query vectors are sent to the executors; the base stays where it is and is
    read once a block.  Each task keeps a bounded heap for every query, whose least value is
    the floor under which the int8 tile drops pairs unseen.  A query node has the vector of
    its smallest id; of several vectors of a neighbour the nearest counts.
    """
    q = cut(usable(queries, width).groupBy("node_id").agg(F.min_by("embedding", "id").alias("embedding")))
    blocks = max(1, -(-q.count() // most_sent))
    found = None
    for n in range(blocks):
        block = q.where(F.pmod(F.xxhash64("node_id"), F.lit(blocks)) == n).orderBy("node_id").toArrow()  # about most_sent rows
        part = _search_base(block, base, k, width)
        part = cut(part) if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("node_id", "neighbour").agg(F.max("cosine").alias("cosine"))
    order = W.partitionBy("node_id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_base(block: pa.Table, base: DataFrame, k: int, width: int) -> DataFrame:
    names = np.array(block.column("node_id").to_pylist(), dtype=str)
    x = matrix(block.column("embedding").combine_chunks(), width).astype(np.float32) if len(names) else np.zeros((0, width), np.float32)
    shared = base.sparkSession.sparkContext.broadcast((names, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, x = shared.value
        if not len(names):
            return
        parts = [slice(i, i + 1024) for i in range(0, len(names), 1024)]
        xs = [x[s].astype(np.float64) for s in parts]
        codes, heaps = [int8_codes(v) for v in xs], [Heaps(len(v), k, "U1") for v in xs]
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                b = whole.slice(lo, BLOCK)
                y, ids = matrix(pa.concat_arrays([b.column("embedding")]), width), np.array(b.column("node_id").to_pylist(), dtype=str)
                code = int8_codes(y)
                for s, v, c, h in zip(parts, xs, codes, heaps):
                    floor = h.floor()
                    if np.isneginf(floor).any() and len(y) > k + 1:
                        # as many are at least as near as the k-th best estimate less its error; one may be the query itself
                        est = int8_product(c[0], code[0]) * c[1][:, None] * code[1][None, :]
                        bound = c[2].max() * (1 + code[2].max()) + code[2].max() + 1e-5
                        kth = np.partition(est, len(y) - k - 1, axis=1)[:, len(y) - k - 1]
                        # repeated neighbours may crowd the estimate, so it only serves where all names differ
                        if len(np.unique(ids)) == len(ids):
                            floor = np.maximum(floor, kth - bound)
                    i, j, cosine = tile_pairs(v, c, y, code, np.maximum(floor, -2.0))
                    keep = names[s][i] != ids[j]
                    h.push(i[keep], ids[j[keep]], cosine[keep])
        for s, h in zip(parts, heaps):
            row, other, cosine = h.rows()
            yield pa.RecordBatch.from_arrays([pa.array(names[s][row].tolist(), pa.string()), pa.array(other.tolist(), pa.string()), pa.array(cosine)], ["node_id", "neighbour", "cosine"])

    return usable(base, width).select("node_id", "embedding").mapInArrow(run, "node_id string, neighbour string, cosine double")
