"""Retrieval: vector hits, entity matches and random walks fused into one ranked context.

Defined results: without any seed the walk starts everywhere; a hit below the threshold is
no seed; repeated seeds keep the exact match's weight; limits of 0 mean the default.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import REWORDED_PREFIXES, confidence, shorten
from . import graph as G, ppr, vector_search as VS

#: How many of each category a result lists.
QUOTAS = {"N": 10, "R": 30, "HO": 10}


def decompose(query: str) -> list[str]:
    """Default decomposition: all runs of words, longest first, each once (a model may replace it)."""
    w = query.split()
    out = [" ".join(w[i : i + n]) for n in range(len(w), 0, -1) for i in range(len(w) - n + 1)]
    return list(dict.fromkeys(out))


def reformulate(query: str, history: Sequence[dict[str, str]] | None, model: Callable[[str, str], str] | None = None) -> str:
    """The question with what a conversation adds, by ``model(history, query)``; without history, model or success as it is.

    The openings that ``functions.text.REWORDED_PREFIXES`` names are taken off, each once in order.
    """
    if not history or model is None:
        return query
    said = "\n\n".join(f"{m['role'].capitalize()}: {m['content']}" for m in history)
    try:
        out = model(said, query).strip()
    except Exception:
        return query
    for p in REWORDED_PREFIXES:
        if out.startswith(p):
            out = out[len(p) :].strip()
    return out


def first_of_each(rows: DataFrame, key: str, place: str) -> DataFrame:
    """``key`` once each, in order of first place (``place`` holds it)."""
    return rows.groupBy(key).agg(F.min(place).alias(place))


def exact_matches(nodes: DataFrame, phrases: DataFrame) -> DataFrame:
    """``id`` of entities that a phrase names directly, or whose text holds it."""
    return G.entity_lookup(nodes, phrases).select("id").union(G.phrase_match(nodes, phrases).select("id")).distinct()


def personalization(vector_hits: DataFrame, exact: DataFrame, similarity_weight: float = 1.0, accuracy_weight: float = 1.0) -> DataFrame:
    """``id, weight``: exact matches override vector similarity."""
    v = vector_hits.groupBy(F.col("node_id").alias("id")).agg(F.max("similarity").alias("sim"))
    e = exact.select("id").distinct().withColumn("exact", F.lit(accuracy_weight))
    return v.join(e, "id", "full").select("id", F.coalesce("exact", F.col("sim") * similarity_weight).alias("weight"))


def select_nodes(seeds: DataFrame, ranked: DataFrame, nodes: DataFrame, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """``id, type, origin, rank, listed``: all seeds, then walk hits in order until every category is full.

    A hit that is walked over is selected even if its category is full already; quotas
    bound only what a category lists (``listed``) and where the walk stops.
    """
    s = seeds.select("id").distinct().join(nodes.select("id", "type", "seq"), "id").select("id", "type", F.lit("seed").alias("origin"), F.lit(0).alias("rank"), F.lit(True).alias("listed"))
    hits = ranked.join(seeds.select("id").distinct(), "id", "left_anti")
    total = W.orderBy(F.desc("score"), "seq", "id")  # ranked is a bounded top-k
    h = hits.withColumn("rank", F.row_number().over(total))
    cat = F.when(F.col("type") == "N", "N").when(F.col("type") == "R", "R").when(F.col("type").isin("H", "O"), "HO").otherwise("other")
    h = h.withColumn("cat", cat).withColumn("in_cat", F.row_number().over(W.partitionBy("cat").orderBy("rank")))
    full = [F.min(F.when((F.col("cat") == c) & (F.col("in_cat") == q), F.col("rank"))).over(W.partitionBy(F.lit(1))) for c, q in quotas.items()]
    h = h.withColumn("stop", F.when(F.greatest(*[F.coalesce(f, F.lit(2**31 - 1)) for f in full]) < 2**31 - 1, F.greatest(*[F.coalesce(f, F.lit(0)) for f in full])).otherwise(F.lit(2**31 - 1)))
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    listed = F.col("in_cat") <= F.coalesce(F.try_element_at(quota, F.col("cat")), F.lit(2**31 - 1))
    h = h.where("rank <= stop").select("id", "type", F.lit("walk").alias("origin"), "rank", listed.alias("listed"))
    return s.unionByName(h)


def expand_attributes(selected: DataFrame, edges: DataFrame, nodes: DataFrame, strict_direction: bool = False) -> DataFrame:
    """Attribute nodes of selected entities. Edges run from attribute to entity; ``strict_direction`` follows successors only and so finds none there."""
    n = selected.where("type = 'N'").select("id")
    a, b = ("source", "target") if strict_direction else ("target", "source")
    found = edges.join(n.withColumnRenamed("id", a), a, "left_semi").select(F.col(b).alias("id")).distinct()
    return found.join(nodes.where("type = 'A'").select("id", "type"), "id")


def expand_titles(selected: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One high-level node for each selected title (the first by arrival)."""
    o = selected.where("type in ('H', 'O')").select(F.col("id").alias("source"))
    h = edges.join(o, "source", "left_semi").join(nodes.where("type = 'H'").select(F.col("id").alias("target"), "seq"), "target")
    return h.groupBy("source").agg(F.min(F.struct("seq", "target")).alias("m")).select(F.col("m.target").alias("id")).distinct().withColumn("type", F.lit("H"))


def context(selected: DataFrame, nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """One row ``context``: ``[type] content`` blocks, seeds first, then by score and arrival. Bounded by the selection."""
    j = selected.select("id", "origin").join(nodes.select("id", "type", "content", "seq"), "id").join(scores, "id", "left")
    key = F.struct((F.col("origin") != "seed").alias("o"), (-F.coalesce("score", F.lit(0.0))).alias("s"), "seq", "id", F.concat(F.lit("["), "type", F.lit("] "), F.coalesce("content", F.lit(""))).alias("t"))
    return j.agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["t"]), "\n\n").alias("context"))


#: Sections of a grouped context (fixed values).
SECTIONS = {"N": "ENTITIES", "R": "RELATIONSHIPS", "H": "HIGH-LEVEL", "A": "ATTRIBUTES"}


def grouped_context(selected: DataFrame, nodes: DataFrame) -> DataFrame:
    """``section, content``: selected contents by section; all other types in OTHER."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv]), F.col("type")), F.lit("OTHER"))
    j = selected.select("id").join(nodes.select("id", "type", "content", "seq"), "id")
    return j.groupBy(name.alias("section")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "\n").alias("content"))


def sources(selected: DataFrame, nodes: DataFrame) -> DataFrame:
    return selected.select("id").join(nodes.select("id", F.explode("file_ids").alias("file_id")), "id").select("file_id").distinct()


def with_expansions(selected: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The selection and what its entities and titles bring along, each node once."""
    rank = F.lit(2**31 - 1).alias("rank")
    more = expand_attributes(selected, edges, nodes).select("id", "type", F.lit("attribute").alias("origin"), rank, F.lit(True).alias("listed"))
    more = more.unionByName(expand_titles(selected, edges, nodes).select("id", "type", F.lit("high_level").alias("origin"), rank, F.lit(True).alias("listed")))
    return selected.unionByName(more.join(selected.select("id"), "id", "left_anti"))


def respond(embeddings: DataFrame, query_vector: Sequence[float], org_id: str | None = None, k: int = 10, most_results: int = 10, most_contexts: int = 5, fallback: Callable[[], DataFrame] | None = None) -> DataFrame:
    """One row ``total_results, contexts_used, source, confidence, response, sources`` for a question's vector.

    The nearest rows by Euclidean distance give sources; only if there are none, ``fallback``
    (rows ``node_id, content, node_type``, in order of ``rank``) does.  Rows without content
    count for nothing; the first contexts make the response; confidence is the mean of their
    non-zero scores, at most 1.
    """
    found = VS.search_l2(embeddings, query_vector, k, org_id=org_id)
    found = found.select("node_id", "content", "node_type", "score", F.row_number().over(W.orderBy("distance", "node_id")).alias("rank"))
    name = "database"
    if fallback is not None and not found.limit(1).count():
        name = "memory"
        found = fallback().select("node_id", "content", "node_type", F.lit(0.0).alias("score"), "rank")
    first = found.where((F.col("rank") <= most_results) & (F.coalesce("content", F.lit("")) != ""))
    source = F.struct("rank", "node_id", "node_type", shorten("content", 500, "").alias("text"), "content", "score")
    row = first.agg(F.array_sort(F.collect_list(source)).alias("all"))  # at most most_results rows
    used = F.slice("all", 1, most_contexts)
    context = F.array_join(F.transform(used, lambda x: x["content"]), "\n\n")
    return row.select(
        F.size("all").alias("total_results"), F.size(used).alias("contexts_used"), F.lit(name).alias("source"), confidence(F.transform("all", lambda x: x["score"])).alias("confidence"),
        F.when(F.size("all") > 0, context).otherwise("No relevant information found in the knowledge base.").alias("response"), F.transform(used, lambda x: F.struct(x["node_id"], x["node_type"], x["text"], x["score"])).alias("sources"),
    )


@dataclass
class RetrievalResult:
    selected: DataFrame
    scores: DataFrame
    context: DataFrame
    sources: DataFrame
    metrics: DataFrame


def retrieve(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, query_vector: Sequence[float], phrases: Sequence[str], k: int = 10, threshold: float = 0.5, alpha: float = 0.85, max_iter: int = 20, tol: float | None = None, org_id: str | None = None, answer: Callable[[str], str] | None = None, on_error: str = "raise", expand: bool = True) -> RetrievalResult:
    """The whole search: vector hits and entity matches seed a walk whose best nodes make the context.

    With ``expand`` attributes of selected entities and one high-level node of each selected
    title join the selection (origin ``attribute`` and ``high_level``, after the walk).
    """
    spark = nodes.sparkSession
    k = k or 10
    try:
        hits = VS.search(embeddings, query_vector, k, "cosine", threshold, org_id)
    except Exception:
        if on_error != "empty":
            raise
        hits = embeddings.select("node_id").limit(0).withColumn("similarity", F.lit(0.0))
    asked = spark.createDataFrame([(p,) for p in phrases], "query string")
    seeds = personalization(hits, exact_matches(nodes, asked))
    scores = ppr.pagerank(nodes, edges, seeds, alpha, max_iter, tol)
    ranked = ppr.top_nodes(scores, nodes, 2 * k)
    chosen = select_nodes(seeds, ranked, nodes)
    chosen = with_expansions(chosen, edges, nodes) if expand else chosen
    metrics = chosen.groupBy("origin").agg(F.count("*").alias("n"))
    return RetrievalResult(chosen, scores, context(chosen, nodes, scores), sources(chosen, nodes), metrics)


def answer_confidence(scores: DataFrame) -> DataFrame:
    """``query, confidence`` from an array column ``scores``."""
    return scores.select("query", confidence(F.col("scores")).alias("confidence"))
