"""Tables of a drawn graph, and an optional self-contained HTML page.

Defined results: at most ``max_nodes`` of the best nodes (a view: the limit is the
feature); edges only between drawn nodes; unknown types and communities are grey.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import shorten
from . import graph as G

MAX_NODES, SMALL, LARGE = 2000, 10, 50
#: Colours of node types and of communities (fixed values).
TYPE_COLOURS = {"T": "#FF6B6B", "S": "#4ECDC4", "N": "#45B7D1", "R": "#96CEB4", "A": "#FFEAA7", "H": "#DDA0DD", "O": "#FFB347"}
COMMUNITY_COLOURS = ["#FF6B6B", "#4ECDC4", "#45B7D1", "#96CEB4", "#FFEAA7", "#DDA0DD", "#FFB347", "#98D8C8", "#F7DC6F", "#BB8FCE"]
GREY = "#CCCCCC"


def node_size(score: Column) -> Column:
    return F.greatest(F.lit(float(SMALL)), F.least(F.lit(float(LARGE)), SMALL + score * (LARGE - SMALL)))


def type_colour(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_COLOURS.items() for x in kv]), kind), F.lit(GREY))


def community_colour(number: Column) -> Column:
    return F.when(number.isNull(), F.lit(GREY)).otherwise(F.element_at(F.array(*map(F.lit, COMMUNITY_COLOURS)), (F.pmod(number, F.lit(10)) + 1).cast("int")))


def hover_title() -> Column:
    """Id, type, content of 100 characters and the first three metadata items of 50."""
    meta = F.map_entries(F.from_json("metadata", "map<string,string>"))
    items = F.transform(F.slice(F.coalesce(meta, F.array().cast("array<struct<key:string,value:string>>")), 1, 3), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(shorten(e["value"], 50), F.lit(""))))
    return F.concat_ws("<br>", F.col("id"), F.col("type"), shorten("content", 100), F.array_join(items, "<br>"))


def viz_nodes(nodes: DataFrame, scores: DataFrame, max_nodes: int = MAX_NODES, types: list[str] | None = None) -> DataFrame:
    n = nodes if types is None else nodes.where(F.col("type").isin(*[t.upper() for t in types]))
    j = n.join(scores.select("id", "score"), "id").orderBy(F.desc("score"), "id").limit(max_nodes)
    return j.select("id", "type", "score", node_size(F.col("score")).alias("size"), type_colour(F.col("type")).alias("colour"), hover_title().alias("title"))


def viz_edges(drawn: DataFrame, edges: DataFrame) -> DataFrame:
    return G.induced(drawn, edges).select("source", "target", "relationship_type", "weight")


def viz_stats(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """One row: components, density, average clustering and, with communities, their number, mean and largest size."""
    c = G.components(nodes, edges).agg(F.count_distinct("component").alias("components"))
    out = G.density(nodes, edges).join(c, F.lit(True)).join(G.clustering(nodes, edges).agg(F.avg("coefficient").alias("average_clustering")), F.lit(True))
    if communities is not None:
        s = communities.groupBy("community").count().agg(F.count("*").alias("communities"), F.avg("count").alias("mean_size"), F.max("count").alias("largest"))
        out = out.join(s, F.lit(True))
    return out


def connect(drawn: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES, most_visited: int = 1_000_000) -> list[str]:
    """Ids to add so that minor components reach the largest: nodes on a shortest directed path to it.

    Works on a drawn selection (at most ``max_nodes``) with the edges by one breadth-first
    frontier a step, so only frontiers leave the cluster; a search that would visit more
    than ``most_visited`` nodes is an error, not a cut.
    """
    comp = G.components(drawn, G.induced(drawn, edges)).limit(max_nodes + 1).toPandas()
    if comp.empty:
        return []
    main = comp["component"].value_counts().sort_index().idxmax()
    spark = drawn.sparkSession
    goal = set(comp.loc[comp["component"] == main, "id"])
    added: list[str] = []
    for _, part in comp[comp["component"] != main].groupby("component"):
        before = dict.fromkeys(part["id"], None)
        front = list(before)
        hit = None
        while front and hit is None:
            if len(before) > most_visited:
                raise RuntimeError("no path within the nodes that may be visited; raise most_visited")
            f = spark.createDataFrame([(x,) for x in front], "source string")
            step = edges.select("source", "target").join(F.broadcast(f), "source").orderBy("target", "source").collect()
            front = []
            for s, t in step:
                if t not in before:
                    before[t] = s
                    front.append(t)
                    if t in goal:
                        hit = t
                        break
        while hit is not None and before[hit] is not None:
            if hit not in goal:
                added.append(hit)
            hit = before[hit]
    return sorted(set(added))


def write_html(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A page that lists and draws the (bounded) selection on a circle."""
    n = [r.asDict() for r in nodes.limit(MAX_NODES + 1).collect()]
    e = [r.asDict() for r in edges.limit(50 * MAX_NODES + 1).collect()]
    if len(n) > MAX_NODES or len(e) > 50 * MAX_NODES:
        raise ValueError("too much for one page; draw a selection")
    data = html.escape(json.dumps({"nodes": n, "edges": e}, default=str), quote=False)
    page = f"""<!doctype html><meta charset="utf-8"><title>graph</title><canvas id="c" width="1200" height="1200"></canvas>
<script type="application/json" id="d">{data}</script><script>
const g = JSON.parse(document.getElementById("d").textContent.replace(/&lt;/g, "<").replace(/&gt;/g, ">").replace(/&amp;/g, "&"));
const x = document.getElementById("c").getContext("2d"), at = {{}};
g.nodes.forEach((v, i) => {{ const a = 2 * Math.PI * i / g.nodes.length; at[v.id] = [600 + 550 * Math.cos(a), 600 + 550 * Math.sin(a)]; }});
x.strokeStyle = "#ddd"; g.edges.forEach(v => {{ x.beginPath(); x.moveTo(...at[v.source]); x.lineTo(...at[v.target]); x.stroke(); }});
g.nodes.forEach(v => {{ x.fillStyle = v.colour; x.beginPath(); x.arc(...at[v.id], v.size / 5, 0, 7); x.fill(); }});
</script>"""
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
