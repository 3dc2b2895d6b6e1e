"""Chunk and conversation records handed over as JSON or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import word_count
from ..operators.prefix import sums_before

STATUSES = ("pending", "processing", "completed", "failed", "skipped")


def ingest_chunks(rows: DataFrame, content: str = "content") -> DataFrame:
    """Non-blank chunks with ``start_char`` 0, ``end_char`` the length and a word count."""
    c = F.col(content)
    out = rows.where(c.isNotNull() & (F.regexp_replace(c, "[ \\t\\n\\r\\f]+", "") != ""))
    return out.withColumns({"start_char": F.lit(0), "end_char": F.length(c), "token_count": word_count(c)})


def chunks_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects ``{org_id, file_id, user_id, chunks: [{content|text|chunk_text, metadata}]}`` as chunk rows.

    The first non-empty of the three names is the content; blank contents are dropped,
    and a malformed line gives no rows.
    """
    item = "struct<content:string,text:string,chunk_text:string,metadata:map<string,string>>"
    j = lines.select(F.from_json(column, f"org_id string, file_id string, user_id string, chunks array<{item}>").alias("j")).where("j is not null")
    c = j.select("j.org_id", "j.file_id", "j.user_id", F.posexplode("j.chunks").alias("chunk_index", "c"))
    first = F.coalesce(*[F.when(F.col(f"c.{n}") != "", F.col(f"c.{n}")) for n in ("content", "text", "chunk_text")])
    c = c.select("org_id", "file_id", "user_id", "chunk_index", first.alias("content"), F.col("c.metadata").alias("metadata"))
    return ingest_chunks(c)


def running_chunks(rows: DataFrame, keys: list[str], order: list[str], content: str = "content") -> DataFrame:
    """Empty contents skipped (blank ones stay), with the running ``char_position`` and ``page_number`` (default place + 1).

    Sums run by segments of the first ``order`` column where that is a whole number.
    """
    kept = rows.where(F.col(content).isNotNull() & (F.col(content) != ""))
    whole = rows.schema[order[0]].dataType.typeName() in ("integer", "long", "short", "byte")
    kept = kept.withColumn("_segment", F.floor(F.col(order[0]) / 1024) if whole else F.lit(0))
    page = F.get_json_object("metadata", "$.page").cast("int") if "metadata" in rows.columns else F.lit(None).cast("int")
    out = sums_before(kept, keys, "_segment", order, {"char_position": F.length(content), "_place": F.lit(1)})
    return out.withColumn("page_number", F.coalesce(page, (F.col("_place") + 1).cast("int"))).drop("_segment", "_place")


def parse_conversations(rows: DataFrame, key: str, history: str) -> DataFrame:
    """``key, turn, role, content`` from a JSON list of messages or from ``user:`` / ``assistant:`` lines.

    Roles in any case; other roles are dropped, as is text before the first role; further
    lines belong to the message above. Null and empty histories have no turns.
    """
    h = rows.select(key, F.coalesce(F.col(history), F.lit("")).alias("h"))
    parsed = F.from_json("h", "array<struct<role:string,content:string>>")
    h = h.withColumn("j", F.when(F.trim("h").startswith("["), parsed))
    from_list = h.where("j is not null").select(key, F.posexplode("j").alias("turn", "m")).select(key, "turn", F.lower(F.trim("m.role")).alias("role"), "m.content")
    lines = h.where("j is null").select(key, F.posexplode(F.split("h", "\n")).alias("n", "line"))
    mark = F.regexp_extract("line", r"^\s*([A-Za-z]+)\s*:", 1)
    known = F.lower(mark).isin("user", "assistant", "system", "tool", "human", "bot")
    lines = lines.withColumn("new", (known & (mark != "")).cast("int"))
    lines = lines.withColumn("turn", F.sum("new").over(W.partitionBy(key).orderBy("n")))
    body = F.when(F.col("new") == 1, F.regexp_replace("line", r"^\s*[A-Za-z]+\s*:\s*", "")).otherwise(F.col("line"))
    g = lines.where("turn > 0").groupBy(key, "turn").agg(F.max(F.when(F.col("new") == 1, F.lower(mark))).alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", body.alias("t")))), lambda x: x["t"]), "\n").alias("content"))
    out = from_list.select(key, F.col("turn").cast("bigint").alias("turn"), "role", "content").unionByName(g.select(key, (F.col("turn") - 1).cast("bigint").alias("turn"), "role", F.trim("content").alias("content")))
    return out.where("role in ('user', 'assistant')")


def parse_reply(column: Column) -> Column:
    """A cloud parser's reply as text: ``markdown``, else ``text``, else its list items joined by blank lines."""
    one = F.from_json(column, "struct<markdown:string,text:string>")
    many = F.from_json(column, "array<struct<markdown:string,text:string>>")
    texts = F.array_compact(F.transform(many, lambda x: F.coalesce(x["markdown"], x["text"])))
    return F.coalesce(F.when(F.trim(column).startswith("{"), F.coalesce(one["markdown"], one["text"])), F.when(F.trim(column).startswith("["), F.array_join(texts, "\n\n")))
