"""Splitting oversized items at natural boundaries by structure-tree packing.

The text is parsed into a tree: sections by depth of heading, blocks (blank lines), list or
table rows, lines, sentences, clauses, words.  Packing goes bottom-up: a node that fits is a
piece; only a node that is itself oversized is opened, and the pieces of its children are
merged with their neighbours while they fit, so what remains of an opened node joins the
sibling that follows.  The first piece may fill the limit; later ones begin a fixed number
of tokens before their fresh part.

Defined results: null or blank content and content within the limit give no pieces; a
text without any boundary is cut between tokens; repeated rows are each split under
their own key.  All tokens of a text are covered, in order.  A chunk without file or
chunk_index whose ``start_char`` is missing has pieces without ``start_char``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

#: One character of these scripts is a token of its own (fixed values).
SINGLE = "฀-๿぀-ヿ㐀-鿿"
TOKEN = re.compile(f"[{SINGLE}]|[^\\s{SINGLE}]+")
HEADING = re.compile(r"#{1,6}\s|\d+(\.\d+)*\.?\s+\S[^.!?]*$|<h[1-6]\b")
ITEM = re.compile(r"[-*+•|]\s?|\d{1,3}[.)]\s|\(?[a-z]\)\s|<(li|tr|p|div)\b")
STOP = re.compile(r"[.!?…]+[\"'”’»)\]]*$|[。！？।॥؟]+[”」』）]*$")
#: Boundary levels, weak to strong; a heading of depth n stands at SECTION + 6 - n.
TOKENS, WORD, CLAUSE, SENTENCE, LINE, ROW, BLOCK, SECTION = range(8)
DEPTH = re.compile(r"(#{1,6})\s|<h([1-6])\b|(\d+(?:\.\d+)*)\.?\s")


def boundary_levels(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Level of the gap before each token; the first has none."""
    out = [TOKENS]
    for (a, b), (c, _) in zip(spans, spans[1:]):
        gap = text[b:c]
        if not gap:
            out.append(SENTENCE if text[b - 1] in "。！？।" else CLAUSE if text[b - 1] in "、，；" else TOKENS)
            continue
        if "\n" in gap or "\f" in gap:
            line = text[c : text.find("\n", c) if text.find("\n", c) >= 0 else len(text)]
            blank = gap.count("\n") > 1 or "\f" in gap
            level = SECTION + 6 - heading_depth(line) if HEADING.match(line) and (blank or line.startswith(("#", "<h"))) else BLOCK if blank else ROW if ITEM.match(line) else LINE
            word = text[a:b]
            out.append(SENTENCE if level == LINE and not STOP.search(word) and len(gap) == 1 and line[:1].islower() else level)
        elif STOP.search(text[a:b]):
            out.append(SENTENCE)
        else:
            out.append(CLAUSE if text[b - 1] in ",;:،–—" else WORD)
    return out


def heading_depth(line: str) -> int:
    """1 to 6: of marks, of tags, or of the parts of a number."""
    m = DEPTH.match(line)
    return 6 if m is None else len(m[1]) if m[1] else int(m[2]) if m[2] else min(6, m[3].count(".") + 1)


@dataclass
class Node:
    """A subtree over the tokens [lo, hi); children tile it."""

    lo: int
    hi: int
    children: list["Node"]


def structure(levels: list[int], lo: int, hi: int, limit: int) -> Node:
    """The tree over [lo, hi): each node is cut at its strongest boundaries. Nodes within ``limit`` are leaves, as they are never opened."""
    root = Node(lo, hi, [])
    todo = [root]
    while todo:
        n = todo.pop()
        if n.hi - n.lo <= limit:
            continue
        top = max(levels[n.lo + 1 : n.hi])
        cuts = [n.lo, *(i for i in range(n.lo + 1, n.hi) if levels[i] == top), n.hi] if top > TOKENS else list(range(n.lo, n.hi)) + [n.hi]
        n.children = [Node(a, b, []) for a, b in zip(cuts, cuts[1:])]
        todo += n.children
    return root


def pack(levels: list[int], lo: int, hi: int, limit: int, first: int | None = None) -> list[tuple[int, int]]:
    """Token ranges of at most ``limit`` (the one from ``lo`` of at most ``first``) that tile [lo, hi)."""
    room = lambda a: (first or limit) if a == lo else limit
    root = structure(levels, lo, hi, limit)
    # children before parents, without recursion: depth has no bound
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.children
    pieces: dict[int, list[tuple[int, int]]] = {}
    for n in reversed(order):
        if not n.children:
            pieces[id(n)] = [(n.lo, n.hi)]
            continue
        out: list[tuple[int, int]] = []
        for c in n.children:
            for a, b in pieces.pop(id(c)):
                if out and b - out[-1][0] <= room(out[-1][0]):
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
        pieces[id(n)] = out
    return pieces[id(root)]


def split_text(text: str, limit: int = 512, overlap: int = 50) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece; no pieces if the text is within the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under the limit")
    spans = [m.span() for m in TOKEN.finditer(text)]
    if len(spans) <= limit:
        return []
    out = []
    for lo, hi in pack(boundary_levels(text, spans), 0, len(spans), limit - overlap, limit):
        lo = max(0, lo - overlap)
        out.append((spans[lo][0], spans[hi - 1][1], hi - lo))
    return out


def repaired_starts(chunks: DataFrame, gap: int = 2, segment: int = 1024) -> DataFrame:
    """``chunk_key, start`` where start is the place in the running text of the file.

    A missing or reset ``start_char`` is computed from the lengths of the chunks before
    it (``gap`` characters lie between chunks).  Sums run by segments of chunk_index
    first, so a file with very many chunks is not summed in one task.
    """
    length = F.coalesce(F.length("content"), F.col("end_char") - F.col("start_char"), F.lit(0)).cast("bigint")
    file = [F.coalesce("org_id", F.lit("")).alias("org"), "file_id"] if "org_id" in chunks.columns else [F.lit("").alias("org"), "file_id"]
    one = chunks.where("file_id is not null and chunk_index is not null").groupBy(*file, "chunk_index").agg(F.max(length).alias("n"))
    one = one.withColumn("seg", F.floor(F.col("chunk_index") / segment))
    segs = one.groupBy("org", "file_id", "seg").agg(F.sum(F.col("n") + gap).alias("total"))
    before = W.partitionBy("org", "file_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    segs = segs.select("org", "file_id", "seg", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("org", "file_id", "seg").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)
    at = one.withColumn("off", F.coalesce(F.sum(F.col("n") + gap).over(inside), F.lit(0))).join(segs, ["org", "file_id", "seg"])
    at = at.select("org", "file_id", "chunk_index", (F.col("base") + F.col("off")).alias("computed"))
    known = F.col("start_char").isNotNull() & ((F.col("start_char") > 0) | F.coalesce(F.col("chunk_index") == 0, F.lit(False)))
    rows = chunks.select("chunk_key", *file, "chunk_index", "start_char").join(at, ["org", "file_id", "chunk_index"], "left")
    return rows.select("chunk_key", F.when(known, F.col("start_char").cast("bigint")).otherwise(F.col("computed")).alias("start"))


def split_oversized(chunks: DataFrame, limit: int = 512, overlap: int = 50) -> DataFrame:
    """``chunk_key, piece, content, start_in_chunk, token_count`` for chunks of more than ``limit`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column("chunk_key"), b.column("content").to_pylist()
            row, piece, part, start, count = [], [], [], [], []
            for r, t in enumerate(texts):
                for k, (lo, hi, n) in enumerate(split_text(t, limit, overlap)):
                    row.append(r)
                    piece.append(k)
                    part.append(t[lo:hi])
                    start.append(lo)
                    count.append(n)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(part, pa.string()), pa.array(start, pa.int32()), pa.array(count, pa.int32())],
                ["chunk_key", "piece", "content", "start_in_chunk", "token_count"],
            )

    # a token has a character at least: shorter texts never reach Python
    long = chunks.select(F.col("chunk_key").cast("bigint").alias("chunk_key"), "content").where(F.length("content") > limit)
    return long.mapInArrow(run, "chunk_key bigint, piece int, content string, start_in_chunk int, token_count int")


def split_chunks(chunks: DataFrame, limit: int = 512, overlap: int = 50) -> DataFrame:
    """Pieces with ``start_char`` in the running text of the file."""
    pieces = split_oversized(chunks, limit, overlap)
    starts = repaired_starts(chunks).groupBy("chunk_key").agg(F.min("start").alias("start"))  # once a key, however often delivered
    out = pieces.join(starts, "chunk_key", "left")
    return out.select("chunk_key", "piece", "content", (F.col("start") + F.col("start_in_chunk")).alias("start_char"), "token_count")
