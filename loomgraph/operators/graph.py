"""The property graph as two DataFrames: canonical views, lookups, statistics.

``nodes``: id, type, content, metadata, file_ids, seq, one row an id (first arrival).
``edges``: source, target, relationship_type, weight, one row an ordered pair of existing,
different ends.  Defined results: null ids are dropped, types are upper-cased, an empty
graph has zero counts, density 0 and is not connected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import index_key, phrase_pattern, query_key, shorten
from ..runtime import cut
from .components import connected_components
from .extract import fold_edges

TYPES = ("T", "S", "N", "R", "A", "H", "O")


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    n = nodes.where("id is not null").select("id", F.upper(F.trim("type")).alias("type"), "content", "metadata", "file_ids", "seq")
    cols = ["type", "content", "metadata", "file_ids"]
    first = n.groupBy("id").agg(F.min(F.struct("seq", *cols)).alias("m"))
    return first.select("id", *[F.col(f"m.{c}").alias(c) for c in cols], F.col("m.seq").alias("seq"))


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends exist, no self loops, one folded edge a pair (arrival order: names, then metadata)."""
    ids = nodes.select("id")
    e = edges.where("source != target")
    e = e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return fold_edges(e, ["relationship_type", "weight", "metadata"])


def nodes_of_type(nodes: DataFrame, kind: str) -> DataFrame:
    if kind.upper() not in TYPES:
        raise ValueError(f"unknown node type {kind!r}")
    return nodes.where(F.col("type") == kind.upper())


def neighbours(nodes: DataFrame, edges: DataFrame, ids: DataFrame, relation: str | None = None) -> DataFrame:
    """``source, id, type, content, relationship_type``: successors of the given ``id`` rows."""
    e = edges if relation is None else edges.where(F.col("relationship_type") == relation)
    e = e.join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    return e.join(nodes.select(F.col("id").alias("target"), "type", "content"), "target").select("source", F.col("target").alias("id"), "type", "content", "relationship_type")


def entity_lookup(nodes: DataFrame, queries: DataFrame, column: str = "query") -> DataFrame:
    """``query, id``: entities whose stored key equals the trimmed, lower-cased query."""
    q = queries.select(F.col(column).alias("query"), query_key(column).alias("k")).distinct()
    return nodes.where("type = 'N'").select("id", index_key("content").alias("k")).join(q, "k").select("query", "id")


def phrase_match(nodes: DataFrame, queries: DataFrame, column: str = "query", most_queries: int = 200) -> DataFrame:
    """``query, id``: entities whose content holds the phrase, for queries of two words or more without a direct hit.

    Few phrases are sent to every executor and matched in one pass over the entities; more
    meet the entities by an equi-join on their longest word first.
    """
    q = queries.select(F.col(column).alias("query")).where("query is not null").distinct()
    direct = entity_lookup(nodes, q, "query").select("query").distinct()
    q = q.join(direct, "query", "left_anti").withColumn("pattern", phrase_pattern("query")).where("pattern is not null")
    rows = q.limit(most_queries + 1).collect()
    if len(rows) > most_queries:
        return _phrase_join(nodes, q, most_queries)
    if not rows:
        return q.select("query", F.lit(None).cast("string").alias("id")).limit(0)
    return _phrase_pass(nodes, rows)


def _phrase_pass(nodes: DataFrame, rows: list) -> DataFrame:
    """One pass over the entities for the given ``query, pattern`` rows."""
    hits = F.array_compact(F.array(*[F.when(F.lower("content").rlike(r["pattern"]), F.lit(r["query"])) for r in rows]))
    return nodes.where("type = 'N'").select("id", F.explode(hits).alias("query")).select("query", "id")


def _phrase_join(nodes: DataFrame, phrases: DataFrame, block: int) -> DataFrame:
    """The pairs of ``query, pattern`` rows and entities that share the phrase's longest word, then tested by the pattern."""
    # words of ASCII, between which letters of other scripts stand: so a phrase's word is one of the text in either reading of a word's end
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))
    longest = F.array_max(F.transform(runs(F.col("query")), lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    p = cut(phrases.select("query", "pattern", longest.alias("w")))
    e = nodes.where("type = 'N' and content is not null").select("id", F.lower("content").alias("c"))
    met = e.select("id", "c", F.explode(F.array_distinct(runs(F.col("c")))).alias("w")).join(p.where("w is not null"), "w")
    out = met.where(F.rlike(F.col("c"), F.col("pattern"))).select("query", "id")
    other = p.where("w is null").collect()  # stated phrases without such a word take further passes
    for i in range(0, len(other), block):
        out = out.unionByName(_phrase_pass(nodes, other[i : i + block]))
    return out.distinct()


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("node_count"))


def file_distribution(nodes: DataFrame) -> DataFrame:
    """``file_id, type, node_count`` with subtotals by file and overall (null marks a subtotal)."""
    n = nodes.select("type", F.explode("file_ids").alias("file_id"))
    return n.rollup("file_id", "type").agg(F.count("*").alias("node_count"))


def file_references(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.array_sort(F.array_distinct(F.coalesce("file_ids", F.array().cast("array<string>")))).alias("files"))


def file_node_count(nodes: DataFrame, file_id: str) -> DataFrame:
    return nodes.where(F.array_contains("file_ids", file_id)).agg(F.count("*").alias("node_count"))


def shared_stats(nodes: DataFrame) -> DataFrame:
    n = F.size(F.array_distinct(F.coalesce("file_ids", F.array().cast("array<string>"))))
    c = nodes.select(n.alias("n")).agg(F.count_if(F.col("n") == 1).alias("single_file"), F.count_if(F.col("n") > 1).alias("multi_file"), F.coalesce(F.max("n"), F.lit(0)).alias("max_files"))
    return c.withColumn("shared_ratio", F.col("multi_file") / F.greatest(F.lit(1), F.col("single_file") + F.col("multi_file")))


def shared_histogram(nodes: DataFrame) -> DataFrame:
    n = F.size(F.array_distinct(F.coalesce("file_ids", F.array().cast("array<string>"))))
    return nodes.groupBy(n.alias("n_files")).agg(F.count("*").alias("node_count"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, m = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    return n.join(m, F.lit(True)).withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(F.lit(0.0)))


def undirected(edges: DataFrame) -> DataFrame:
    """Each unordered pair once: ``a < b``."""
    return edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a != b").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    u = undirected(edges)
    return u.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.src", "e.dst")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, degree`` counting in and out edges; isolated nodes have 0."""
    d = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(d, "id", "left").na.fill(0, ["degree"])


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree over the largest degree."""
    d = degrees(nodes, edges)
    top = d.agg(F.max("degree").alias("top"))
    return d.join(F.broadcast(top), F.lit(True)).select("id", (F.col("degree") / F.greatest(F.col("top"), F.lit(1))).alias("score"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, coefficient``; 0 under degree 2.

    Triangles are listed from each edge's lesser-degree end, which bounds the work at a hub.
    """
    u = undirected(edges)
    deg = u.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    x = u.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    o = cut(x.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi")))
    wedge = o.select("lo", F.col("hi").alias("p")).join(o.select("lo", F.col("hi").alias("q")), "lo").where("p < q")
    tri = wedge.join(u.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"])
    t = tri.select(F.explode(F.array("lo", "p", "q")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    out = nodes.select("id").join(deg, "id", "left").join(t, "id", "left").na.fill(0, ["d", "t"])
    return out.select("id", F.when(F.col("d") >= 2, 2 * F.col("t") / (F.col("d") * (F.col("d") - 1))).otherwise(F.lit(0.0)).alias("coefficient"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``; an isolated node is its own."""
    c = connected_components(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    return nodes.select("id").join(c, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def graph_stats(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """One row: total_nodes, total_edges, node_type_counts, num_communities, is_connected."""
    kinds = type_counts(nodes).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "node_count")))).alias("node_type_counts"), F.coalesce(F.sum("node_count"), F.lit(0)).alias("total_nodes"))
    comp = components(nodes, edges).agg((F.count_distinct("component") == 1).alias("is_connected"))
    num = communities.agg(F.count_distinct("community").alias("num_communities")) if communities is not None else kinds.select(F.lit(0).cast("bigint").alias("num_communities"))
    return kinds.join(edges.agg(F.count("*").alias("total_edges")), F.lit(True)).join(num, F.lit(True)).join(comp, F.lit(True))


def top_members(communities: DataFrame, most: int = 10) -> DataFrame:
    """``community, size, rank, id`` of the first members by seq (two steps, so a giant community is not sorted in one task)."""
    salted = W.partitionBy("community", "salt").orderBy("seq", "id")
    c = communities.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= most)
    ranked = c.withColumn("rank", F.row_number().over(W.partitionBy("community").orderBy("seq", "id"))).where(F.col("rank") <= most)
    sizes = communities.groupBy("community").agg(F.count("*").alias("size"))
    return ranked.join(sizes, "community").select("community", "size", "rank", "id")


def sample_nodes(nodes: DataFrame, kinds: tuple[str, ...] = ("T", "N", "R", "A", "H"), most: int = 3) -> DataFrame:
    """The first few nodes of each type, with shortened content (a report: the limit is the feature)."""
    parts = None
    for k in kinds:
        p = nodes.where(F.col("type") == k).orderBy("seq", "id").limit(most)
        parts = p if parts is None else parts.unionByName(p)
    return parts.select("id", "type", shorten("content", 100).alias("content"))


def node_detail(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """A node with its successors: ``id, type, content, connected``."""
    one = nodes.where(F.col("id") == node_id).select("id", "type", "content")
    n = neighbours(nodes, edges, one).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("id", "type", shorten("content", 100).alias("content"), "relationship_type"))).alias("connected"))
    return one.join(n.withColumnRenamed("source", "id"), "id", "left")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, communities: DataFrame | None = None) -> None:
    """Parquet tables under ``path``; nodes by org when they have one, so reads of one org prune."""
    w = nodes.write.mode("overwrite")
    (w.partitionBy("org_id") if "org_id" in nodes.columns else w).parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    if communities is not None:
        communities.write.mode("overwrite").parquet(f"{path}/communities")


def load_graph(spark, path: str, org_id: str | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    n = spark.read.parquet(f"{path}/nodes")
    n = n.where(F.col("org_id") == org_id) if org_id is not None else n
    e = spark.read.parquet(f"{path}/edges")
    return n, (induced(n, e) if org_id is not None else e)
