"""Filling fixed-capacity containers: minimum bin slack over the histogram of sizes.

Sizes are tokens of a public tokenizer.  As the capacity is fixed, all that packing
needs is how many items have each size: at most ``capacity`` numbers, whatever the
corpus.  The plan is made from them: the largest size left opens a container, a bitset
subset-sum picks the multiset of remaining sizes that fills it closest to capacity, and
the same pattern is repeated while the counts last.  Items are then laid onto the plan
by their rank among items of their size, which needs one shuffle of narrow rows.

Items longer than a container are cut into full containers and a rest; no other item is
split.  Defined results: null and empty texts hold no tokens and come out with a null
container; equal sizes are taken in the order of a hash of the key; empty tables give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..runtime import cut

#: Items of one size that are ranked together, about; a size of more is cut into parts.
RANKED = 100_000
#: Vocabulary file and word pattern of the tokenizer by default; both are parameters (the pattern is that of the public 50k byte vocabulary).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[tuple[str, str], object] = {}


def encoder(path: str = VOCABULARY, pattern: str = PATTERN):  # noqa: ANN201
    """The tokenizer of a .tiktoken file, made once in a worker."""
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def token_counts(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``key, n_tokens`` of whole texts; 0 for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, pattern)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64())], ["key", "n_tokens"])

    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key bigint, n_tokens bigint")


def fill_one(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The (size, how many) out of ``counts`` whose sum comes closest to ``room`` from below.

    Reachable sums are the bits of an integer; one step adds up to c items of a size by
    doubling.  The bits before each step are kept to walk back from the best sum.
    """
    full, bits, steps = (1 << (room + 1)) - 1, 1, []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        c = min(counts[size], room // size)
        steps.append((size, c, bits))
        left, take = c, 1
        while left:
            take = min(take, left)
            bits |= (bits << (size * take)) & full
            left -= take
            take *= 2
        if bits >> room:
            break
    at, out = bits.bit_length() - 1, []
    for size, c, before in reversed(steps):
        k = 0
        while not before >> at & 1:
            at -= size
            k += 1
        if k:
            out.append((size, k))
        if k > c:
            raise AssertionError("walked back over more items than there are")
    return out


def pack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(pattern, times) so that all items are placed: a pattern is the (size, how many) of one container."""
    counts = {s: n for s, n in histogram.items() if n > 0}
    out = []
    while counts:
        top = max(counts)
        counts[top] -= 1
        rest = fill_one({s: n for s, n in counts.items() if n}, capacity - top) if capacity > top else []
        counts[top] += 1
        pattern = dict(rest)
        pattern[top] = pattern.get(top, 0) + 1
        times = min(counts[s] // k for s, k in pattern.items())
        for s, k in pattern.items():
            counts[s] -= k * times
            if not counts[s]:
                del counts[s]
        out.append((sorted(pattern.items()), times))
    return out


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``key, piece, token_start, n_tokens, container``: one row a document, or a piece of one over capacity."""
    spark = docs.sparkSession
    sized = cut(token_counts(docs, key, text, vocabulary, pattern))
    cap = F.lit(capacity)
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / cap) - 1).cast("int")
    items = sized.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.least(cap, F.col("n_tokens") - i * cap))).alias("piece", "size"))
    items = items.select("key", "piece", (F.col("piece").cast("bigint") * cap).alias("token_start"), F.col("size").cast("int").alias("size"))
    histogram = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}  # at most capacity + 1 rows
    # a size is ranked in as many parts as it needs, so full pieces of long texts are no hot key
    parts = np.ones(capacity + 1, np.int64)
    for size, n in histogram.items():
        parts[size] = -(-n // RANKED)
    of = F.element_at(F.array(*[F.lit(int(x)) for x in parts]), F.col("size") + 1)
    items = items.withColumn("salt", F.pmod(F.xxhash64("key", "piece"), of).cast("int"))
    offset = {size: np.zeros(int(parts[size]), np.int64) for size in histogram}
    for r in items.groupBy("size", "salt").count().collect():  # a row for RANKED items, and one a size
        offset[r["size"]][r["salt"]] = r["count"]
    offset = {size: np.cumsum(n) - n for size, n in offset.items()}
    histogram.pop(0, None)
    first: dict[int, list[tuple[int, int, int]]] = {}  # size -> (first rank, items a container, first container)
    used, container = dict.fromkeys(histogram, 0), 0
    for pattern, times in pack_plan(histogram, capacity):
        for size, k in pattern:
            first.setdefault(size, []).append((used[size], k, container))
            used[size] += k * times
        container += times
    shared = spark.sparkContext.broadcast((offset, {s: np.array(v, np.int64) for s, v in first.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset, first = shared.value
        for b in batches:
            size, salt = b.column("size").to_numpy(), b.column("salt").to_numpy()
            place = b.column("r").to_numpy() - 1
            out = np.full(len(size), -1, np.int64)
            for s in np.unique(size[size > 0]):
                m = size == s
                plan, rank = first[int(s)], place[m] + offset[int(s)][salt[m]]
                at = np.searchsorted(plan[:, 0], rank, "right") - 1
                out[m] = plan[at, 2] + (rank - plan[at, 0]) // plan[at, 1]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("piece"), b.column("token_start"), pa.array(size.astype(np.int32)), pa.array(out, mask=out < 0)], ["key", "piece", "token_start", "n_tokens", "container"]
            )

    ranked = items.withColumn("r", F.row_number().over(W.partitionBy("size", "salt").orderBy(F.xxhash64(F.lit(1), "key"), "key", "piece")).cast("bigint"))
    return ranked.mapInArrow(run, "key bigint, piece int, token_start bigint, n_tokens int, container bigint").withColumnRenamed("key", key)
