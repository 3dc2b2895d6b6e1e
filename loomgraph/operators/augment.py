"""Adding what a graph says in summary: attribute, high-level and overview nodes.

What describes an entity or sums up a community is an injected Column expression, by rule
unless a model's is given.  Lists that go into it are bounded (first so many by arrival) and
ranked with a limit in every task first, so a hub's neighbours are never gathered.

Defined results: an entity without neighbours still gets its attribute node; a community of
one node is a community; null contents count as empty; node and edge rows come out in the
shape of ``graph.canonical_nodes`` and ``extract.chunk_graph``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import shorten
from ..runtime import cut
from . import centrality as C

#: Contexts and relationships that describe an entity, members that sum up a community, new entities that call for communities (fixed values).
CONTEXTS, RELATIONS, MEMBERS, NEW_ENTITIES = 5, 3, 10, 5


def _first(rows: DataFrame, key: str, most: int, name: str) -> DataFrame:
    """``key, name``: the first contents of each key by arrival, in order."""
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("seq", "id"))).where(F.col("r") <= most)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("content", F.lit("")).alias("t")))), lambda x: x["t"]).alias(name))


def describe_entity(name: Column, contexts: Column, relations: Column) -> Column:
    """The description by rule: the entity, the text it stands in, its relationships."""
    part = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n{title}: "), F.array_join(F.transform(items, lambda x: shorten(x, 200)), " | "))).otherwise("")
    return F.concat(F.lit("Entity: "), F.coalesce(name, F.lit("")), part("Context", contexts), part("Relationships", relations))


def sum_up(contents: Column) -> Column:
    return F.array_join(F.transform(contents, lambda x: shorten(x, 100)), "; ")


def overview_title(summary: Column) -> Column:
    """The first ten words."""
    return F.array_join(F.slice(F.split(F.trim(summary), "\\s+"), 1, 10), " ")


def _suffix(org_id: str | None) -> Column:
    return F.lit(f"_{org_id}" if org_id else "")


def attribute_nodes(entities: DataFrame, nodes: DataFrame, edges: DataFrame, org_id: str | None = None, describe: Callable[[Column, Column, Column], Column] = describe_entity) -> tuple[DataFrame, DataFrame]:
    """(nodes ``id, type, content, metadata``; edges) with an attribute node for each entity, linked by ``describes_entity``.

    Context are the texts and relationships that point at the entity.
    """
    e = entities.select("id", "content").distinct()
    into = edges.select("source", F.col("target").alias("entity")).join(e.select(F.col("id").alias("entity")), "entity", "left_semi").distinct()
    near = into.join(nodes.where("type in ('T', 'R')").select(F.col("id").alias("source"), "type", "content", "seq"), "source").withColumnRenamed("source", "id")
    told = e.join(_first(near.where("type = 'T'"), "entity", CONTEXTS, "contexts").withColumnRenamed("entity", "id"), "id", "left").join(_first(near.where("type = 'R'"), "entity", RELATIONS, "relations").withColumnRenamed("entity", "id"), "id", "left")
    none = F.array().cast("array<string>")
    text = describe(F.col("content"), F.coalesce("contexts", none), F.coalesce("relations", none))
    meta = F.to_json(F.struct(F.col("id").alias("entity_id"), F.col("content").alias("entity_name"), F.lit("attribute").alias("node_type")))
    made = told.select(F.concat(F.lit("A_"), "id", _suffix(org_id)).alias("new"), "id", text.alias("content"), meta.alias("metadata"))
    link = made.select(F.col("new").alias("source"), F.col("id").alias("target"), F.lit("describes_entity").alias("relationship_type"), F.lit(1.0).alias("weight"))
    return made.select(F.col("new").alias("id"), F.lit("A").alias("type"), "content", "metadata"), link


def community_nodes(member: DataFrame, nodes: DataFrame, org_id: str | None = None, known: DataFrame | None = None, summarise: Callable[[Column], Column] = sum_up, title: Callable[[Column], Column] = overview_title) -> tuple[DataFrame, DataFrame]:
    """A high-level and an overview node for each community of ``id, community`` that has none in ``known`` (``community``).

    The overview points at the high-level node (``summarizes``), which points at its first
    members by arrival (``summarizes_content``).
    """
    m = member.join(nodes.select("id", "content", "seq"), "id")
    if known is not None:
        m = m.join(known.select("community").distinct(), "community", "left_anti")
    sizes = m.groupBy("community").agg(F.count("*").alias("node_count"))
    ranked = cut(m.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy("seq", "id"))).where(F.col("r") <= MEMBERS))
    contents = ranked.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("content", F.lit("")).alias("t")))), lambda x: x["t"]).alias("contents"))
    h = contents.join(sizes, "community").select("community", "node_count", summarise(F.col("contents")).alias("content"))
    hid, oid = (F.concat(F.lit(f"{k}_community_"), "community", _suffix(org_id)) for k in "HO")
    high = h.select(hid.alias("id"), F.lit("H").alias("type"), "content", F.to_json(F.struct(F.col("community").alias("community_id"), "node_count", F.lit("high_level").alias("node_type"))).alias("metadata"))
    over = h.select(oid.alias("id"), F.lit("O").alias("type"), title(F.col("content")).alias("content"), F.to_json(F.struct(F.col("community").alias("community_id"), hid.alias("high_level_node"), F.lit("overview").alias("node_type"))).alias("metadata"))
    one = F.lit(1.0).alias("weight")
    up = h.select(oid.alias("source"), hid.alias("target"), F.lit("summarizes").alias("relationship_type"), one)
    down = ranked.select(hid.alias("source"), F.col("id").alias("target"), F.lit("summarizes_content").alias("relationship_type"), one)
    return high.unionByName(over), up.unionByName(down)


def known_communities(nodes: DataFrame) -> DataFrame:
    """``community`` of the high-level nodes that the graph has."""
    return nodes.where("type = 'H'").select(F.get_json_object("metadata", "$.community_id").alias("community")).where("community is not null").distinct()


def current_file_entities(nodes: DataFrame, file_id: str) -> DataFrame:
    """Entities whose first file is the given one; those merged into an older file's node are not new."""
    return nodes.where((F.col("type") == "N") & (F.col("file_id").cast("string") == file_id))


def augment(nodes: DataFrame, edges: DataFrame, fraction: float = 0.2, org_id: str | None = None, scores: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New nodes and edges for the whole graph: attributes of its important entities, and all its communities."""
    scores = cut(C.importance(nodes, edges)) if scores is None else scores
    a, ae = attribute_nodes(C.important_entities(nodes, scores, fraction), nodes, edges, org_id)
    h, he = community_nodes(C.communities(nodes, edges), nodes, org_id)
    return a.unionByName(h), ae.unionByName(he)


def augment_new(nodes: DataFrame, edges: DataFrame, new_entities: DataFrame, org_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """New nodes and edges after a file: attributes of all its new entities, and with more than five of them
    also the communities that have no high-level node yet."""
    a, ae = attribute_nodes(new_entities, nodes, edges, org_id)
    if new_entities.limit(NEW_ENTITIES + 1).count() <= NEW_ENTITIES:
        return a, ae
    h, he = community_nodes(C.communities(nodes, edges), nodes, org_id, known_communities(nodes))
    return a.unionByName(h), ae.unionByName(he)
