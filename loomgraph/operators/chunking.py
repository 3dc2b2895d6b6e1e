"""Cutting texts into overlapping windows.

``chunk_words`` is a pure Column plan: one generate over the window starts, no shuffle.
``chunk_tokens`` takes any tokenizer with ``encode`` and ``decode``.

Defined results: null and blank texts give no chunks; a window never starts in the tail
that the previous one already covers; offsets count joined characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import words


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")


def chunk_words(docs: DataFrame, text: str = "text", size: int = 1536, overlap: int = 75) -> DataFrame:
    """The other columns of ``docs`` plus ``chunk_index, content, start_char, end_char, token_count, total_chunks``."""
    _check(size, overlap)
    step = size - overlap
    keep = [c for c in docs.columns if c != text]
    w = docs.select(*keep, words(text).alias("_w")).withColumn("_n", F.size("_w")).where("_n > 0")
    total = (F.lit(1) + F.ceil(F.greatest(F.lit(0), F.col("_n") - size) / step)).cast("int")
    w = w.withColumn("_total", total)
    # each window with its own words, and the characters that the step before it adds
    window = lambda i: F.struct(
        F.slice("_w", i * step + 1, size).alias("p"),
        F.when(i == 0, F.lit(0)).otherwise(F.length(F.array_join(F.slice("_w", (i - 1) * step + 1, step), " ")) + F.when(i > 1, 1).otherwise(0)).alias("added"),
    )
    w = w.withColumn("_x", F.transform(F.sequence(F.lit(0), F.col("_total") - 1), window)).drop("_w")
    adds = F.transform("_x", lambda x: x["added"])
    starts = F.aggregate(adds, F.array().cast("array<int>"), lambda acc, a: F.concat(acc, F.array(a + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))))
    w = w.select(*keep, "_total", F.posexplode(F.arrays_zip(F.transform("_x", lambda x: x["p"]).alias("p"), starts.alias("s"))).alias("_i", "_p"))
    out = w.select(*keep, F.col("_i").alias("chunk_index"), F.array_join("_p.p", " ").alias("content"), F.col("_p.s").alias("start_char"), F.size("_p.p").alias("token_count"), F.col("_total").alias("total_chunks"))
    return out.withColumn("end_char", (F.col("start_char") + F.length("content")).cast("int"))


def token_windows(tokens: list, size: int, overlap: int) -> list[tuple[int, int]]:
    _check(size, overlap)
    out, s = [], 0
    while True:
        e = min(s + size, len(tokens))
        out.append((s, e))
        if e >= len(tokens):
            return out
        s = e - overlap


def chunk_tokens(docs: DataFrame, key: str, text: str, tokenizer: Callable[[], object], size: int = 512, overlap: int = 50) -> DataFrame:
    """``key, chunk_index, content, start_char, end_char, token_count, total_chunks`` by a pluggable tokenizer.

    ``tokenizer`` makes an object with encode(text) -> list and decode(list) -> text; it runs
    once a worker. A text within the size is one chunk, unstripped; other chunks are stripped.
    """
    _check(size, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer()
        for b in batches:
            rows: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t or not t.strip():
                    continue
                ids = tok.encode(t)
                if len(ids) <= size:
                    rows.append((k, 0, t, 0, len(t), len(ids), 1))
                    continue
                spans = token_windows(ids, size, overlap)
                place, at = 0, 0  # characters before the token: decoded once, in order
                for i, (s, e) in enumerate(spans):
                    place += len(tok.decode(ids[at:s]))
                    at = s
                    piece = tok.decode(ids[s:e])
                    rows.append((k, i, piece.strip(), place, place + len(piece), e - s, len(spans)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "chunk_index", "content", "start_char", "end_char", "token_count", "total_chunks"])

    return docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key string, chunk_index int, content string, start_char int, end_char int, token_count int, total_chunks int")
