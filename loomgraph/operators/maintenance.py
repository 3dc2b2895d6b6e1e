"""Keeping graphs and embeddings current: upserts, file removal and merging, change detection.

Every operation returns new DataFrames; a caller writes them to a fresh path and swaps.
Defined results: nodes without files are never removed with a file; a file that is not
there changes nothing; of repeated rows the latest wins (ties by id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import index_key
from .extract import fold_edges
from .graph import induced


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: a pre-aggregated maximum, not a window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    # the order columns lead, so the maximum of the struct is the last row; unorderable columns ride along by max_by
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_m"))
    return picked.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)


def upsert_embeddings(old: DataFrame, new: DataFrame, most_chars: int = 2000, ordinal: bool = False) -> DataFrame:
    """Replace the (org, file) sets of the new rows; then one row a node, new before old; contents cut.

    With ``ordinal`` the ``chunk_index`` of new rows is their place in the file's list (by id).
    """
    cols = old.columns
    if ordinal:
        new = new.withColumn("chunk_index", (F.row_number().over(W.partitionBy("org_id", "file_id").orderBy("id")) - 1).cast("int"))
    touched = new.select("org_id", "file_id").distinct()
    kept = old.join(touched, ["org_id", "file_id"], "left_anti").select(*cols)
    rows = kept.withColumn("_b", F.lit(0)).unionByName(new.select(*cols).withColumn("_b", F.lit(1)))
    out = latest(rows, ["node_id"], ["_b", "id"])
    return out.withColumn("content", F.substring("content", 1, most_chars)).select(*cols)


def clear_file(nodes: DataFrame, edges: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, one row ``removed, preserved, edges_removed``) without the file.

    Nodes of this file only go, shared ones lose it, edges of removed nodes go too.
    """
    files = F.array_distinct(F.coalesce("file_ids", F.array().cast("array<string>")))
    has = F.array_contains(files, file_id)
    only = has & (F.size(files) == 1)
    left = nodes.where(~only).withColumn("file_ids", F.when(has, F.array_remove("file_ids", file_id)).otherwise(F.col("file_ids")))
    counts = nodes.agg(F.count_if(only).alias("removed"), F.count_if(has & ~only).alias("preserved"))
    kept = induced(left, edges)
    gone = edges.agg(F.count("*").alias("a")).join(kept.agg(F.count("*").alias("b")), F.lit(True)).select((F.col("a") - F.col("b")).alias("edges_removed"))
    return left, kept, counts.join(gone, F.lit(True))


def merge_file(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """The graph's nodes with those of a file: other kinds by id, entities by lower-cased content; file lists united."""
    both = nodes.select("id", "type", "content", "file_ids", "seq").withColumn("_old", F.lit(0)).unionByName(new.select("id", "type", "content", "file_ids", "seq").withColumn("_old", F.lit(1)))
    key = F.when(F.col("type") == "N", F.concat(F.lit("N|"), F.lower(F.coalesce("content", "id")))).otherwise(F.concat(F.lit("I|"), "id"))
    both = both.withColumn("_k", key)
    first = both.groupBy("_k").agg(F.min(F.struct("_old", "seq", "id", "type", "content")).alias("m"))
    files = both.select("_k", F.explode("file_ids").alias("f")).groupBy("_k").agg(F.array_sort(F.collect_set("f")).alias("file_ids"))
    return first.join(files, "_k", "left").select("m.id", "m.type", "m.content", "file_ids", "m.seq")


def merge_counts(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """One row ``nodes_added, entities_merged``: what ``merge_file`` does with the new nodes (each entity name once)."""
    known = nodes.where("type = 'N' and content is not null").select(index_key("content").alias("k")).distinct().withColumn("old", F.lit(True))
    n = new.where("type = 'N'").withColumn("k", index_key(F.coalesce("content", "id"))).join(known, "k", "left")
    names = n.agg(F.count("*").alias("all"), F.count_distinct(F.when(F.col("old").isNull(), F.col("k"))).alias("fresh"))
    other = new.where("type != 'N'").select("id").distinct().join(nodes.select("id"), "id", "left_anti").agg(F.count("*").alias("rest"))
    return names.join(other, F.lit(True)).select((F.col("fresh") + F.col("rest")).alias("nodes_added"), (F.col("all") - F.col("fresh")).alias("entities_merged"))


def merge_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stored graph with that of new files: entities of one organisation and lower-cased name become one node.

    The node seen first keeps id, content and file; file lists unite; edges of merged nodes
    move to the node kept and fold into those there, stored before new.
    Wants ``id, type, content, file_ids, seq, org_id, file_id`` and ``source, target, relationship_type, weight``.
    """
    cols = ["id", "type", "content", "seq", "org_id", "file_id"]
    shape = lambda d, k: d.select(*[F.col(c).cast("string").alias(c) for c in cols], "file_ids", F.lit(k).alias("_new"))
    both = shape(nodes, 0).unionByName(shape(new_nodes, 1))
    name = F.concat_ws("|", F.lit("N"), F.coalesce("org_id", F.lit("")), index_key("content"))
    both = both.withColumn("_k", F.when((F.col("type") == "N") & F.col("content").isNotNull(), name).otherwise(F.concat(F.lit("I|"), "id")))
    first = both.groupBy("_k").agg(F.min(F.struct("_new", "seq", "id", "type", "content", "org_id", "file_id")).alias("m"))
    files = both.select("_k", F.explode("file_ids").alias("f")).groupBy("_k").agg(F.array_sort(F.collect_set("f")).alias("file_ids"))
    out = first.join(files, "_k", "left").select(*[F.col(f"m.{c}").alias(c) for c in cols], "file_ids")
    moved = both.join(first.select("_k", F.col("m.id").alias("kept")), "_k").where("id != kept").select("id", "kept").distinct()
    e = edges.select("source", "target", "relationship_type", "weight", F.lit(0).alias("_new"), F.lit("").alias("seq"))
    seq = F.col("seq").cast("string") if "seq" in new_edges.columns else F.lit("")
    e = e.unionByName(new_edges.select("source", "target", "relationship_type", "weight", F.lit(1).alias("_new"), seq.alias("seq")))
    for end in ("source", "target"):
        e = e.join(moved.select(F.col("id").alias(end), "kept"), end, "left").withColumn(end, F.coalesce("kept", end)).drop("kept")
    return out, fold_edges(e, ["_new", "seq", "relationship_type"])


def merged_metadata(rows: DataFrame, key: str, order: str, column: str = "metadata") -> DataFrame:
    """``key, values, lists``: JSON objects of rows that become one; a value met once stays, more become a list with repeats, by ``order``."""
    items = rows.select(key, order, F.explode(F.from_json(column, "map<string,string>")).alias("_name", "_value"))
    lists = items.groupBy(key, "_name").agg(F.array_sort(F.collect_list(F.struct(order, "_value"))).alias("l"))
    values = F.transform("l", lambda x: x["_value"])
    one = lists.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", values.alias("v"))))).alias("m"))
    single, many = F.map_filter("m", lambda k, v: F.size(v) == 1), F.map_filter("m", lambda k, v: F.size(v) > 1)
    return one.select(key, F.transform_values(single, lambda k, v: v[0]).alias("values"), many.alias("lists"))


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with ``type``, ``content`` and ``metadata`` replaced where ``changes`` (one row an id) names them and is not null; unknown ids change nothing."""
    named = [c for c in ("type", "content", "metadata") if c in changes.columns]
    c = changes.select("id", *[F.col(x).alias(f"_{x}") for x in named])
    out = nodes.join(c, "id", "left")
    return out.select(*[F.coalesce(f"_{x}", x).alias(x) if x in named else F.col(x) for x in nodes.columns])


def store_rows(nodes: DataFrame, most_chars: int = 2000) -> DataFrame:
    """Rows for the vector store from graph nodes: those with an embedding, content cut, metadata wrapped with the type."""
    meta = F.to_json(F.struct(F.col("metadata").alias("node_metadata"), F.col("type").alias("node_type_value")))
    return nodes.where("embedding is not null").select(F.col("id").alias("node_id"), F.col("type").alias("node_type"), F.substring("content", 1, most_chars).alias("content"), "embedding", meta.alias("graph_metadata"))


def changed_documents(seen: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """``path, reason`` of what to process: new, failed before, or another hash, size or time."""
    s = seen.select(key, F.col("sha256").alias("h"), F.col("size").alias("z"), F.col("mtime").alias("t"), F.col("success").alias("ok"), F.lit(True).alias("known"))
    j = current.join(s, key, "left")
    reason = F.when(F.col("known").isNull(), "new").when(~F.coalesce("ok", F.lit(False)), "failed").when(~(F.col("sha256").eqNullSafe(F.col("h")) & F.col("size").eqNullSafe(F.col("z")) & F.col("mtime").eqNullSafe(F.col("t"))), "changed")
    return j.select(key, reason.alias("reason")).where("reason is not null")


def drop_vanished(seen: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    return seen.join(current.select(key), key, "left_semi")


def unprocessed(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose (org, file) is not completed yet."""
    done = state.where(F.lower("processing_status") == "completed").select("org_id", "file_id")
    return files.join(done, ["org_id", "file_id"], "left_anti")


def delete_files(rows: DataFrame, org_id: str, file_ids: list[str] | None = None) -> DataFrame:
    """Rows without an org's files, or without the whole org; rows with null keys stay."""
    gone = F.col("org_id") == org_id
    if file_ids is not None:
        gone = gone & F.col("file_id").isin(*file_ids)
    return rows.where(~F.coalesce(gone, F.lit(False)))


def next_version(stats: DataFrame, org_id: str, file_id: str) -> DataFrame:
    """``org_id, version, processed_files`` after one more file: version + 1, or 1 for a new org."""
    old = stats.where(F.col("org_id") == org_id).agg(F.max("version").alias("v"), F.max_by("processed_files", "version").alias("p"))
    files = F.array_union(F.coalesce("p", F.array().cast("array<string>")), F.array(F.lit(file_id)))
    return old.select(F.lit(org_id).alias("org_id"), (F.coalesce("v", F.lit(0)) + 1).alias("version"), files.alias("processed_files"))


def next_versions(stats: DataFrame, files: DataFrame) -> DataFrame:
    """``org_id, version, processed_files`` of every organisation that ``files`` (``org_id, file_id``) names: one version more, files united."""
    old = stats.groupBy("org_id").agg(F.max("version").alias("v"), F.max_by("processed_files", "version").alias("p"))
    new = files.groupBy("org_id").agg(F.array_sort(F.collect_set("file_id")).alias("f"))
    out = new.join(old, "org_id", "left")
    return out.select("org_id", (F.coalesce("v", F.lit(0)) + 1).cast("bigint").alias("version"), F.array_union(F.coalesce("p", F.array().cast("array<string>")), "f").alias("processed_files"))


def processing_stats(state: DataFrame) -> DataFrame:
    """One row: counts by outcome (status in any case), nodes, mean time and success rate."""
    s = F.lower(F.trim("processing_status"))
    return state.agg(
        F.count("*").alias("total"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.count_if(s.isin("pending", "processing")).alias("open"),
        F.coalesce(F.sum("node_count"), F.lit(0)).alias("nodes"), F.avg(F.when(s == "completed", F.col("processing_time"))).alias("mean_time"),
    ).withColumn("success_rate", F.col("completed") / F.greatest(F.lit(1), F.col("total")) * 100)


def embedding_summary(rows: DataFrame, most: int = 50) -> DataFrame:
    """By file, org and type: count, first and last time; the latest groups (a report: the limit is the feature)."""
    g = rows.groupBy("file_id", "org_id", "node_type").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    return g.orderBy(F.desc("last_at"), "file_id", "org_id", "node_type").limit(most)


def file_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("org_id", "file_id").agg(F.count("*").alias("n_rows"), F.count_distinct("node_id").alias("n_nodes"))


def error_log(errors: DataFrame, path: str) -> None:
    """Append ``timestamp, file_path, error_message, phase`` as JSON lines."""
    errors.select("timestamp", "file_path", "error_message", "phase").write.mode("append").json(path)
