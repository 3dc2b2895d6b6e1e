"""From chunks to a typed graph: units, entities, relationships, and the rows they become.

The extractor is a set of Column expressions by default (rules, no model); any function
chunks -> (units, entities, triples) columns may replace it.  Ids are
``<kind>_<file>_<chunk>[_<i>]`` so results are the same on every run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import capitalised, index_key, sentence_units

MAX_UNITS, MAX_ENTITIES, MAX_RELATIONS = 10, 35, 25


def rule_extract(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``units, entities, triples``: consecutive distinct entities of a unit are related as FOLLOWED_BY."""
    per_unit = lambda u: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(capitalised(u, None)) - 1, F.lit(1))),
        lambda i: F.struct(F.get(capitalised(u, None), i - 1).alias("source"), F.lit("FOLLOWED_BY").alias("relation"), F.get(capitalised(u, None), i).alias("target")),
    )
    units = sentence_units(content, MAX_UNITS)
    triples = F.filter(F.flatten(F.transform(units, per_unit)), lambda t: t["source"].isNotNull() & t["target"].isNotNull())
    return chunks.withColumns({"units": units, "entities": capitalised(content, MAX_ENTITIES), "triples": F.slice(triples, 1, MAX_RELATIONS)})


def model_extract(chunks: DataFrame, key: str, content: str, make: Callable[[], Callable[[str], tuple[list, list, list]]]) -> DataFrame:
    """``key, units, entities, triples, success, error`` by an injected extractor that runs in Python workers.

    A chunk whose extractor raises keeps no units and reports the error. Triples need two entities.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = make()
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    u, e, r = extract(t or "")
                    rows.append({"key": k, "units": u[:MAX_UNITS], "entities": e[:MAX_ENTITIES], "triples": [dict(zip(("source", "relation", "target"), x)) for x in r[:MAX_RELATIONS]] if len(e) >= 2 else [], "success": True, "error": None})
                except Exception as x:  # the chunk is reported, the job goes on
                    rows.append({"key": k, "units": [], "entities": [], "triples": [], "success": False, "error": str(x)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    triple = pa.list_(pa.struct([("source", pa.string()), ("relation", pa.string()), ("target", pa.string())]))
    schema = pa.schema([("key", pa.string()), ("units", pa.list_(pa.string())), ("entities", pa.list_(pa.string())), ("triples", triple), ("success", pa.bool_()), ("error", pa.string())])
    ddl = "key string, units array<string>, entities array<string>, triples array<struct<source:string,relation:string,target:string>>, success boolean, error string"
    return chunks.select(F.col(key).cast("string"), F.col(content)).mapInArrow(run, ddl)


def chunk_graph(extracted: DataFrame, by_org: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes ``id, type, content, file_id, org_id, seq``; edges ``source, target, relationship_type, weight, seq``).

    Wants ``file_id, org_id, chunk_index, content, units, entities, triples``; ``seq`` orders
    arrivals by file, chunk and item. Entities are one node each mention here; see ``merge_entities``.
    Triples resolve by name, regardless of case, within their chunk; if one end fails they are dropped.
    With ``by_org`` ids carry the organisation, so files of two that share an id stay apart.
    A chunk whose extraction failed (no units, entities, triples) keeps its text node; see ``failed_chunks``.
    """
    org = [F.col("org_id")] if by_org else []
    base = extracted.withColumn("cid", F.concat_ws("_", *org, F.col("file_id").cast("string"), F.col("chunk_index").cast("string")))
    seq = F.concat_ws("|", F.lpad(F.col("file_id").cast("string"), 24, "0"), F.lpad(F.col("chunk_index").cast("string"), 9, "0"))
    keep = ["file_id", "org_id", "cid"]

    def order(kind: str, i: Column) -> Column:
        return F.concat_ws("|", seq, F.lit(kind), F.lpad(i.cast("string"), 6, "0"))

    t = base.select(F.concat(F.lit("T_"), "cid").alias("id"), F.lit("T").alias("type"), "content", *keep[:2], order("0", F.lit(0)).alias("seq"))
    s = base.select(*keep, "chunk_index", F.posexplode("units").alias("i", "content"))
    s = s.select(F.concat_ws("_", F.lit("S"), "cid", "i").alias("id"), F.lit("S").alias("type"), "content", *keep, "chunk_index", "i")
    n = base.select(*keep, "chunk_index", F.posexplode("entities").alias("i", "content"))
    n = n.select(F.concat_ws("_", F.lit("N"), "cid", "i").alias("id"), F.lit("N").alias("type"), "content", *keep, "chunk_index", "i")
    r = base.select(*keep, "chunk_index", "entities", F.posexplode("triples").alias("i", "t"))
    place = lambda x: F.array_position(F.transform("entities", F.lower), F.lower(x)) - 1
    r = r.withColumns({"a": place(F.col("t.source")), "b": place(F.col("t.target"))}).where("a >= 0 and b >= 0")
    r = r.withColumns({"id": F.concat_ws("_", F.lit("R"), "cid", "i"), "sid": F.concat_ws("_", F.lit("N"), "cid", "a"), "tid": F.concat_ws("_", F.lit("N"), "cid", "b")})
    shape = lambda d, kind: d.select("id", "type", "content", *keep[:2], order(kind, F.col("i")).alias("seq"))
    rn = r.select("id", F.lit("R").alias("type"), F.concat_ws(" ", "t.source", "t.relation", "t.target").alias("content"), *keep[:2], order("3", F.col("i")).alias("seq"))
    nodes = t.unionByName(shape(s, "1")).unionByName(shape(n, "2")).unionByName(rn)
    tid = F.concat(F.lit("T_"), "cid")
    one = F.lit(1.0).alias("weight")
    edges = s.select(tid.alias("source"), F.col("id").alias("target"), F.lit("contains_semantic_unit").alias("relationship_type"), one, order("1", F.col("i")).alias("seq"))
    edges = edges.unionByName(n.select(tid.alias("source"), F.col("id").alias("target"), F.lit("mentions_entity").alias("relationship_type"), one, order("2", F.col("i")).alias("seq")))
    inv = r.select("id", "i", "chunk_index", "file_id", F.explode(F.array("sid", "tid")).alias("end"))
    edges = edges.unionByName(inv.select(F.col("id").alias("source"), F.col("end").alias("target"), F.lit("involves_entity").alias("relationship_type"), one, order("3", F.col("i")).alias("seq")))
    edges = edges.unionByName(r.select(F.col("sid").alias("source"), F.col("tid").alias("target"), F.col("t.relation").alias("relationship_type"), one, order("4", F.col("i")).alias("seq")))
    return nodes, edges


def failed_chunks(extracted: DataFrame) -> DataFrame:
    """``file_id, chunk_index, error`` of the chunks whose extraction failed."""
    return extracted.where(~F.coalesce("success", F.lit(True))).select("file_id", "chunk_index", "error")


def canonical_entities(nodes: DataFrame) -> DataFrame:
    """``id, canonical_id`` for entity nodes: the first seen of the same lower-cased content (not trimmed).

    First-seen by pre-aggregated minimum, so a very common name never gathers in one task.
    """
    n = nodes.where("type = 'N' and content is not null").select("id", "seq", index_key("content").alias("k"))
    first = n.groupBy("k").agg(F.min(F.struct("seq", "id")).alias("m")).select("k", F.col("m.id").alias("canonical_id"))
    return n.join(first, "k").select("id", "canonical_id")


def merge_entities(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with one row an entity, with ``file_ids``; edges between the kept nodes, folded."""
    same = canonical_entities(nodes)
    tagged = nodes.join(same, "id", "left").withColumn("keep", F.coalesce("canonical_id", "id"))
    files = tagged.groupBy("keep").agg(F.array_sort(F.collect_set(F.col("file_id").cast("string"))).alias("file_ids"))
    kept = tagged.where(F.col("id") == F.col("keep")).drop("canonical_id", "keep")
    out = kept.join(files.withColumnRenamed("keep", "id"), "id")
    a, b = same.select(F.col("id").alias("source"), F.col("canonical_id").alias("s")), same.select(F.col("id").alias("target"), F.col("canonical_id").alias("t"))
    moved = edges.join(a, "source", "left").join(b, "target", "left")
    moved = moved.select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), "relationship_type", "weight", "seq")
    return out, fold_edges(moved, ["seq", "relationship_type"])


def fold_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge an ordered pair, no self loops: first weight kept (null counts as 1.0), relation names folded.

    Names join by ``; `` in order when they differ from all that was joined so far.
    """
    e = edges.where("source is not null and target is not null and source != target")
    pair, when = ["source", "target"], F.struct(*order)
    # one look at all pairs, aggregated before the shuffle: most have a single name and need no order
    named = F.col("relationship_type").isNotNull()
    one = e.groupBy(*pair).agg(F.min(F.struct(when.alias("o"), "weight")).alias("first"), F.min("relationship_type").alias("lo"), F.max("relationship_type").alias("hi"))
    several = one.where("lo != hi").select(*pair)
    rows = e.where(named).join(several, pair, "left_semi")
    # of several names, a repeat of the one before adds nothing only while it is the first; so all are kept in order
    names = rows.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct(when.alias("o"), "relationship_type"))).alias("l"))
    fold = F.aggregate("l", F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x["relationship_type"]).when(acc == x["relationship_type"], acc).otherwise(F.concat(acc, F.lit("; "), x["relationship_type"])))
    out = one.join(names.select(*pair, fold.alias("many")), pair, "left")
    return out.select(*pair, F.coalesce("first.weight", F.lit(1.0)).alias("weight"), F.coalesce("many", "lo").alias("relationship_type"))
