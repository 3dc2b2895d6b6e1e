"""Exact vector search on a table of embeddings, and its upkeep.

Filters (org, file, type) are plain predicates and reach the scan; the distance is one
generated expression; the k best come from TakeOrderedAndProject, so only k rows a task
travel.  Defined results: vectors of another width, null or zero vectors have no
similarity and never rank; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import vectors as V
from ..runtime import cut, shuffle_partitions


def _filtered(df: DataFrame, org_id: str | None, file_ids: Sequence[str] | None, types: Sequence[str] | None) -> DataFrame:
    for column, value in (("org_id", org_id), ("file_id", file_ids), ("node_type", types)):
        if value is not None:
            df = df.where(F.col(column) == value if isinstance(value, str) else F.col(column).isin(*value))
    return df


def search(df: DataFrame, query: Sequence[float], k: int | None = 10, space: str = "cosine", min_similarity: float | None = None, org_id: str | None = None, file_ids: Sequence[str] | None = None, types: Sequence[str] | None = None, key: str = "node_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows (without k all that are similar enough) with ``distance`` (cosine, squared l2 or ip) and ``similarity`` = 1 - distance."""
    if k is not None and k <= 0:
        raise ValueError("k must be positive")
    d = V.SPACES[space](F.col(vector), V.constant(query))
    out = _filtered(df, org_id, file_ids, types).where(F.size(vector) == len(query)).withColumn("distance", d).where("distance is not null and not isnan(distance)")
    if min_similarity is not None:
        out = out.where(F.lit(1.0) - F.col("distance") >= min_similarity)
    out = out.withColumn("similarity", 1 - F.col("distance"))
    return out if k is None else out.orderBy("distance", key).limit(k)


#: Bits of a sketch (as so many longs), and how many candidates an approximate search looks at least and for each result.
SKETCH_LONGS, LEAST_CANDIDATES, CANDIDATES = 4, 200, 20


def _planes(width: int) -> list[list[float]]:
    """Directions drawn once from a fixed seed, so sketches of all builds agree."""
    import random

    rng = random.Random(width)
    return [[rng.gauss(0, 1) for _ in range(width)] for _ in range(64 * SKETCH_LONGS)]


def sketched(df: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """``df`` with ``_sketch array<bigint>``: on which side of each direction a vector lies. Store it as the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        planes = np.array(_planes(width)).T
        for b in batches:
            column = b.column(vector)
            good = np.array([v is not None and len(v) == width and None not in v for v in column.to_pylist()], bool)
            bits = np.zeros((b.num_rows, planes.shape[1]), np.uint8)
            if good.any():
                bits[good] = np.array([v for v, g in zip(column.to_pylist(), good) if g]) @ planes > 0
            longs = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            sketch = pa.array([row if g else None for row, g in zip(longs.tolist(), good)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, sketch], [*b.schema.names, "_sketch"])

    from pyspark.sql.types import ArrayType, LongType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType().add("_sketch", ArrayType(LongType())).fields]))


def search_approx(index: DataFrame, query: Sequence[float], k: int = 10, candidates: int | None = None, key: str = "node_id", vector: str = "embedding", **filters) -> DataFrame:  # noqa: ANN003
    """As ``search`` by cosine, but only the rows whose sketches differ least from the query's are compared.

    Sketches are compared in generated code on a few bytes a row; ``candidates`` (at least
    200, and 20 for each result) sets recall against work.  A row without a sketch never ranks.
    """
    most = max(LEAST_CANDIDATES, CANDIDATES * k, candidates or 0)
    bits = [sum(a * b for a, b in zip(p, query)) > 0 for p in _planes(len(query))]
    own = [sum(1 << i for i, x in enumerate(bits[64 * n : 64 * n + 64]) if x) for n in range(SKETCH_LONGS)]
    own = [x - (1 << 64) if x >> 63 else x for x in own]
    differ = sum((F.bit_count(F.col("_sketch")[n].bitwiseXOR(F.lit(x))) for n, x in enumerate(own)), F.lit(0))
    rows = _filtered(index, filters.get("org_id"), filters.get("file_ids"), filters.get("types")).where("_sketch is not null")
    near = rows.withColumn("_d", differ).orderBy("_d", key).limit(most)
    return search(near.drop("_d", "_sketch"), query, k, key=key, vector=vector)


def by_id(df: DataFrame, ids: Sequence, key: str = "node_id") -> DataFrame:
    """Rows (metadata and vector) of the given ids; unknown ids give none."""
    return df.where(F.col(key).isin(*ids)) if len(ids) else df.limit(0)


def rebuilt(index: DataFrame, new: DataFrame, width: int, capacity: int = 100_000, key: str = "node_id", vector: str = "embedding") -> DataFrame:
    """An index of the new rows only, with the metadata that the old one has for their ids where the new row has none."""
    fresh = add_vectors(new.limit(0), new, width, capacity, key, vector)
    known = [c for c in index.columns if c in fresh.columns and c not in (key, vector)]
    if not known:
        return fresh
    # of an id that the old index has more than once the least row, nulls last
    parts = [F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(f"m{i}") for i, c in enumerate(known)]
    old = index.select(F.col(key).alias("_key"), F.struct(*parts).alias("_m")).groupBy("_key").agg(F.min("_m").alias("_m"))
    out = fresh.join(old, F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.select(*[F.coalesce(c, f"_m.m{known.index(c)}.v").alias(c) if c in known else F.col(c) for c in fresh.columns])


def search_l2(df: DataFrame, query: Sequence[float], k: int = 10, key: str = "node_id", vector: str = "embedding", **filters) -> DataFrame:  # noqa: ANN003
    """The k nearest by Euclidean distance; the reported score is 1 - distance and may be negative."""
    d = V.l2_distance(F.col(vector), V.constant(query))
    out = _filtered(df, filters.get("org_id"), filters.get("file_ids"), filters.get("types"))
    out = out.where(F.size(vector) == len(query)).withColumn("distance", d).where("distance is not null and not isnan(distance)")
    return out.withColumn("score", 1 - F.col("distance")).orderBy("distance", key).limit(k)


def search_many(queries: DataFrame, base: DataFrame, k: int, query_key: str = "query_id", key: str = "node_id", vector: str = "embedding", most_queries: int = 1_000) -> DataFrame:
    """``query_id, node_id, similarity, rank`` for all query vectors: a pass over the base for each block of ``most_queries``.

    Every task keeps its k best of a query before anything is shuffled.
    """
    n = queries.count()
    if not n:
        return base.select(F.lit(None).cast("string").alias(query_key), key, F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    blocks = -(-n // most_queries)
    sent = queries.select(query_key, F.col(vector).alias("_q"))
    if blocks == 1:
        return _search_block(sent, base, k, query_key, key, vector)
    sent = cut(sent.withColumn("_b", F.pmod(F.xxhash64(query_key), F.lit(blocks))))
    parts = [cut(_search_block(sent.where(F.col("_b") == b).drop("_b"), base, k, query_key, key, vector)) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _search_block(sent: DataFrame, base: DataFrame, k: int, query_key: str, key: str, vector: str) -> DataFrame:
    pairs = base.select(key, vector).join(F.broadcast(sent), F.size(vector) == F.size("_q"))
    s = pairs.select(query_key, key, V.cosine_similarity(F.col(vector), F.col("_q")).alias("similarity")).where("similarity is not null")
    # ranking under a constant is pre-limited in each task (window group limit)
    w = W.partitionBy(query_key).orderBy(F.desc("similarity"), key)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def add_vectors(index: DataFrame, new: DataFrame, width: int, capacity: int = 100_000, key: str = "node_id", vector: str = "embedding") -> DataFrame:
    """The index with new rows: known ids, repeated ids, wrong widths and what exceeds the capacity stay out."""
    room = max(0, capacity - index.count())
    fresh = new.where(F.size(vector) == width).join(index.select(key), key, "left_anti")
    first = fresh.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(*fresh.columns)))).where("_r = 1").drop("_r")
    return index.unionByName(_least_keys(first, room, key), allowMissingColumns=True)


def _least_keys(df: DataFrame, most: int, key: str) -> DataFrame:
    """The ``most`` rows of least key (nulls first, keys are distinct): no task holds more keys than one range of them."""
    keys = df.select(F.col(key).alias("k"))
    n = keys.count() if most else 0
    if n <= most:
        return df if most else df.limit(0)
    ranges = cut(keys.repartitionByRange(shuffle_partitions(df.sparkSession), "k")).withColumn("p", F.spark_partition_id())
    left = most
    for p, size in sorted(map(tuple, ranges.groupBy("p").count().collect())):
        if size >= left:
            break
        left -= size
    last = ranges.where(F.col("p") == p).select("k").orderBy("k").offset(left - 1).limit(1).first()[0]
    return df.where(F.col(key).isNull() if last is None else F.col(key).isNull() | (F.col(key) <= F.lit(last)))


def load_vectors(spark, path: str, width: int, vector: str = "embedding") -> DataFrame | None:  # noqa: ANN001
    """The stored index; one of another width is removed, and None comes back."""
    df = spark.read.parquet(path)
    if not df.where(F.size(vector) != width).limit(1).count():
        return df
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return None


def index_stats(df: DataFrame, width: int, capacity: int = 100_000) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("elements"), (n * width * 4 / F.lit(1048576.0)).alias("memory_mb"), (n / F.lit(capacity) * 100).alias("fill_percent"))


def similarity_graph(df: DataFrame, threshold: float, key: str = "node_id", vector: str = "embedding", blocks: int | None = None) -> DataFrame:
    """``source, target, weight`` (source < target): all pairs at ``threshold`` or more, by a join of blocks.

    Every block pair is one key, so work spreads evenly; each pair is looked at once. The
    work grows with the square of the rows: meant for tables of moderate size.
    """
    unit = df.where(V.norm(F.col(vector)) > 0).select(key, F.transform(vector, lambda x: x.cast("double") / V.norm(F.col(vector))).alias("u"))
    b = blocks or 8
    rows = unit.withColumn("b", F.pmod(F.xxhash64(key), F.lit(b)).cast("int"))
    left = rows.select("b", F.explode(F.sequence(F.col("b"), F.lit(b - 1))).alias("c"), F.col(key).alias("x"), F.col("u").alias("ux"))
    right = rows.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("b"), F.col("b").alias("c"), F.col(key).alias("y"), F.col("u").alias("uy"))
    j = left.join(right, ["b", "c"]).where("b != c or x < y")
    sim = j.select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"), V.dot(F.col("ux"), F.col("uy")).alias("weight"))
    return sim.where(F.col("weight") >= threshold)


def hash_embedding(width: int, kind: str = "document") -> Callable[[list[str]], list[list[float]]]:
    """The default embedder: signed feature hashing of words, deterministic and offline.

    ``kind`` is what a model may tell apart, ``document`` or ``query``; here both give one vector.
    """
    if kind not in ("document", "query"):
        raise ValueError(f"unknown kind {kind!r}")
    import xxhash

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w.encode())
                v[h % width] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return embed


def embed_texts(df: DataFrame, key: str, text: str, width: int = 1024, make: Callable[[], Callable] | None = None, batch: int = 96, most_chars: int = 2048) -> DataFrame:
    """``key, embedding``: texts cut to ``most_chars``, embedded in batches; a failed batch gives zero vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = make() if make else hash_embedding(width)
        for b in batches:
            texts = [(t or "")[:most_chars] for t in b.column(1).to_pylist()]
            out: list[list[float]] = []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    got = embed(part)
                    if len(got) != len(part):
                        raise ValueError("wrong number of vectors")
                except Exception:
                    got = [[0.0] * width] * len(part)
                out += got
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], [key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")


def needs_embedding(nodes: DataFrame, current_file: str | None = None) -> DataFrame:
    """Full mode: types S N R A H O. For one file: no vector yet, of the file or of none, content over ten characters."""
    if current_file is None:
        return nodes.where(F.col("type").isin("S", "N", "R", "A", "H", "O"))
    mine: Column = (F.col("file_id") == current_file) | F.col("file_id").isNull()
    return nodes.where(F.col("embedding").isNull() & mine & (F.length(F.trim("content")) > 10))


def live(df: DataFrame) -> DataFrame:
    """Rows not flagged as deleted."""
    return df.where(~F.coalesce(F.col("deleted"), F.lit(False)))
