"""Near-duplicate records: a size-aware heavy-light set similarity join.

A record is the set of its adjacent word pairs; two records match when
|intersection| / |union| reaches a threshold t.  Records with one and the same set form
a class and are joined once, by a representative.

With one global order of the elements (rare first), matching sets x (larger) and y
(smaller) share at least k elements of their prefixes of length |x| - ceil(t|x|) + k
and |y| - ceil(2t|y| / (1 + t)) + k.  Hence the join, after the size-aware scheme for
overlap joins:

* light (small) sets enumerate the k-subsets of their prefix (k = 2) and meet other
  light sets in an equi-join on the subset;
* heavy (large) sets scan the inverted lists of their prefix elements (k = 1), where
  they meet every other set, light or heavy;
* the boundary is the size at which the estimated cost of both ways together is least.

Either way a meeting is dropped at once if a 128-bit parity sketch proves that the sets
differ too much; survivors are verified exactly.  Lists of frequent elements are cut
into blocks that meet pairwise as separate keys, so no task holds a hot list.
Every step is exact; the frequency table only orders elements.

Defined results: null or short texts (under ``min_words``) match nothing; a repeated
node id counts once per distinct content; ties do not arise as all matches are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.components import connected_components
from ..runtime import cut
from .pairing import BLOCK, class_pairs

#: Slots of the element frequency table that is sent to the executors (4 bytes each).
SLOTS = 1 << 19
#: Postings of one block of a frequent element's list.
LIST_BLOCK = 4_096
#: Cost of one enumerated subset against one scanned posting, measured on 103,078 sets and 8 cores: all sets light,
#: 33.3 million subsets took 28.3 s (850 ns each); all heavy, 277 million scanned postings took 2.7 s (10 ns each).
SUBSET_COST, SCAN_COST = 85.0, 1.0
#: Sets from which the cost of either way is estimated, about.
COST_SETS = 20_000


def record_sets(df: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(key, set_id, items): set_id is a 64-bit hash of the sorted set, without collisions among these sets (see ``_distinct_sets``)."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    got = df.select(F.col(key).alias("key"), words.alias("w")).where(F.col("key").isNotNull() & (F.size("w") >= min_words))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1))))
    return got.select("key", F.array_sort(pairs).alias("items")).select("key", F.xxhash64("items").alias("set_id"), "items")


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def frequency_table(sets: DataFrame) -> np.ndarray:
    """How many sets hold an element of each slot; counted over all sets, SLOTS numbers in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            total += np.bincount(b.column("items").flatten().to_numpy() & (SLOTS - 1), minlength=SLOTS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["slot", "n"])

    rows = sets.select("items").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def _ordered(b: pa.RecordBatch, freq: np.ndarray) -> tuple[np.ndarray, ...]:
    """Elements of each set, rare first: (set row, element, frequency, position, size of each set, sketch)."""
    items = b.column("items")
    size = np.diff(items.offsets.to_numpy())
    values = items.flatten().to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    f = freq[values & (SLOTS - 1)]
    order = np.lexsort((values, f, row))
    values, f = values[order], f[order]
    start = np.cumsum(size) - size
    pos = np.arange(len(values)) - np.repeat(start, size)
    bit = (values.view(np.uint64) >> np.uint64(20)) & np.uint64(127)
    one = np.left_shift(np.uint64(1), bit & np.uint64(63))
    sketch = [np.bitwise_xor.reduceat(np.where((bit >> np.uint64(6)) == h, one, np.uint64(0)), start) for h in (0, 1)]
    return row, values, f, pos, size, sketch[0], sketch[1]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _prefixes(size: np.ndarray, t: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(size, size - _ceil(t * size) + k), np.minimum(size, size - _ceil(2 * t / (1 + t) * size) + k)


def boundary_by_cost(sets: DataFrame, n: int, shared, t: float) -> int:  # noqa: ANN001
    """Sets smaller than the result enumerate subsets; the others scan. Estimated on about COST_SETS sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, _, f, pos, size, _, _ = _ordered(b, shared.value)
                probe, index = _prefixes(size, t, 1)
                scan = np.bincount(row, np.where(pos < probe[row], f, 0), len(size)) * (1 - t)
                p2, i2 = _prefixes(size, t, 2)
                yield pa.RecordBatch.from_arrays([pa.array(size.astype(np.int32)), pa.array(SCAN_COST * scan), pa.array(SUBSET_COST * (p2 * (p2 - 1) / 2))], ["size", "scan", "subset"])

    step = max(1, n // COST_SETS)
    cost = sets.where(F.pmod("set_id", F.lit(step)) == 0).select("items").mapInArrow(run, "size int, scan double, subset double")
    rows = sorted(tuple(r) for r in cost.groupBy("size").agg(F.sum("scan"), F.sum("subset")).collect())  # one row a size
    best, at, total = sum(r[1] for r in rows), 0, sum(r[1] for r in rows)
    for size, scan, subset in rows:
        total += subset - scan
        if total < best:
            best, at = total, size + 1
    return at


def _postings(sets: DataFrame, shared, n: int, t: float, boundary: int, largest: int) -> DataFrame:  # noqa: ANN001
    """Keys of all sets. Light sets enter the inverted lists wherever any set of the input (``largest``) is heavy."""
    schema = "at bigint, set_id bigint, size int, leads boolean, indexed boolean, block int, s0 bigint, s1 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2_000):
                b = whole.slice(lo, 2_000)
                b = pa.RecordBatch.from_arrays([b.column("set_id"), pa.concat_arrays([b.column("items")])], ["set_id", "items"])
                row, value, f, pos, size, s0, s1 = _ordered(b, freq)
                ids = b.column("set_id").to_numpy()
                parts = []  # key, row, leads, indexed, expected list length
                light = size < boundary
                if largest >= boundary:
                    probe, index = _prefixes(size, t, 1)
                    m = pos < np.where(light, index, probe)[row]
                    parts.append((value[m], row[m], ~light[row[m]], pos[m] < index[row[m]], f[m].astype(np.float64)))
                if light.any():
                    probe, index = _prefixes(size, t, 2)
                    start = np.cumsum(size) - size
                    for length in np.unique(probe[light]):
                        of = np.flatnonzero(light & (probe == length))
                        i, j = np.triu_indices(int(length), 1)
                        a, c = start[of][:, None] + i, start[of][:, None] + j
                        r = np.repeat(of, len(i))
                        key = _mix(value[a.ravel()], value[c.ravel()])
                        together = f[a.ravel()].astype(np.float64) * f[c.ravel()] / max(n, 1)
                        parts.append((key, r, np.ones(len(r), bool), np.tile(j, len(of)) < index[r], together))
                key, r, leads, indexed, expect = (np.concatenate(x) for x in zip(*parts))
                blocks = np.maximum(1, np.ceil(expect / LIST_BLOCK)).astype(np.int64) if len(expect) and expect.max() > 2 * LIST_BLOCK else np.ones(len(key), np.int64)
                blocks[expect <= 2 * LIST_BLOCK] = 1
                own = np.zeros(len(key), np.int64)
                if (hot := blocks > 1).any():
                    own[hot] = (_mix(ids[r[hot]], key[hot]).view(np.uint64) % blocks[hot].astype(np.uint64)).astype(np.int64)
                    rep = np.repeat(np.arange(len(key)), blocks)
                    other = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    tile = np.minimum(own[rep], other) * 1_000_003 + np.maximum(own[rep], other) + 1
                    split = blocks[rep] > 1
                    key = np.where(split, _mix(key[rep], tile), key[rep])
                    alone = (own[rep] == other) | ~split  # the pairs inside a block are found in its own tile only
                    r, leads, indexed = r[rep], leads[rep], indexed[rep]
                    block = np.where(alone, -1, own[rep])
                else:
                    block = np.full(len(key), -1, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(ids[r]), pa.array(size[r].astype(np.int32)), pa.array(leads), pa.array(indexed), pa.array(block.astype(np.int32)), pa.array(s0[r].view(np.int64)), pa.array(s1[r].view(np.int64))],
                    ["at", "set_id", "size", "leads", "indexed", "block", "s0", "s1"],
                )

    return sets.select("set_id", "items").mapInArrow(run, schema)


def _meet(rows: DataFrame, t: float) -> DataFrame:
    """Pairs that share a key and may be similar; rows come sorted by key."""
    names = ("at", "set_id", "size", "leads", "indexed", "block", "s0", "s1")

    def pairs(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((-c["size"], c["at"]))
        c = {n: v[order] for n, v in c.items()}
        run = np.cumsum(np.r_[True, c["at"][1:] != c["at"][:-1]]).astype(np.int64) << 32
        at = np.flatnonzero(c["indexed"])
        rank = run[at] - c["size"][at]
        lead = np.flatnonzero(c["leads"])
        lo = np.searchsorted(rank, run[lead] - c["size"][lead], "left")
        hi = np.searchsorted(rank, run[lead] - _ceil(t * c["size"][lead]), "right")
        n = np.maximum(hi - lo, 0)
        some = n > 0
        lead, lo, n = lead[some], lo[some], n[some]
        total = np.cumsum(n)
        s = 0
        while s < len(lead):
            e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + 2_000_000, "right")))
            cnt = n[s:e]
            i = np.repeat(lead[s:e], cnt)
            j = at[np.repeat(lo[s:e] - (np.cumsum(cnt) - cnt), cnt) + np.arange(cnt.sum())]
            differ = sum(np.bitwise_count((c[n][i] ^ c[n][j]).view(np.uint64)) for n in ("s0", "s1"))
            both = c["size"][i] + c["size"][j]
            # |x ^ y| <= (1 - t) / (1 + t) (|x| + |y|) for similar sets; the sketches differ in no more bits
            keep = (differ <= both * ((1 - t) / (1 + t)) + 1e-9) & (c["set_id"][i] != c["set_id"][j])
            i, j = i[keep], j[keep]
            bi, bj = c["block"][i], c["block"][j]
            keep = (bi < 0) | (bi != bj)
            a, b = c["set_id"][i[keep]], c["set_id"][j[keep]]
            if len(a):
                both_ids = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both_ids[0]), pa.array(both_ids[1])], ["a", "b"])
            s = e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        rows_held = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append({n: b.column(n).to_numpy(zero_copy_only=False) for n in names})
            rows_held += b.num_rows
            if rows_held >= 200_000:  # whole keys only; the last may go on
                c = {n: np.concatenate([h[n] for h in held]) for n in names}
                last = int(np.searchsorted(c["at"], c["at"][-1], "left"))
                if last:
                    yield from pairs({n: v[:last] for n, v in c.items()})
                held = [{n: v[last:] for n, v in c.items()}]
                rows_held = len(c["at"]) - last
        if rows_held:
            yield from pairs({n: np.concatenate([h[n] for h in held]) for n in names})

    return rows.repartition("at").sortWithinPartitions("at").mapInArrow(run, "a bigint, b bigint")


def similar_sets(sets: DataFrame, t: float, boundary: int | None = None) -> DataFrame:
    """``a, b, similarity`` (a < b) for all different sets of ``set_id, items`` (distinct) at ``t`` or more."""
    n, largest = sets.agg(F.count("*"), F.coalesce(F.max(F.size("items")), F.lit(0))).first()
    shared = sets.sparkSession.sparkContext.broadcast(frequency_table(sets))
    boundary = boundary_by_cost(sets, n, shared, t) if boundary is None else boundary
    found = _meet(_postings(sets, shared, n, t, boundary, largest), t).distinct()
    left = sets.select(F.col("set_id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    got = found.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity"))
    return got.where(F.col("similarity") >= t)


def near_duplicates(df: DataFrame, key: str, text: str, t: float = 0.6, min_words: int = 32, boundary: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership ``key, set_id``; pairs ``a, b, similarity`` of different sets)."""
    rows = cut(record_sets(df, key, text, min_words))
    rows, sets = _distinct_sets(rows)
    return rows.select("key", "set_id").distinct(), similar_sets(sets, t, boundary)


def _distinct_sets(rows: DataFrame, tries: int = 8) -> tuple[DataFrame, DataFrame]:
    """(rows, ``set_id, items``): each id stands for one set, which is checked; otherwise all ids are drawn anew."""
    for seed in range(1, tries + 1):
        sets = cut(rows.groupBy("set_id").agg(F.min("items").alias("items"), F.max("items").alias("last")))
        if not sets.where("items != last").limit(1).count():
            return rows, sets.drop("last")
        rows = rows.withColumn("set_id", F.xxhash64(F.lit(seed), "items"))
    raise RuntimeError("no hash tells all sets apart")


def node_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``key_a, key_b`` (key_a < key_b): every pair of different keys, copies included.

    Classes of many copies meet by blocks, among themselves and with similar classes.
    """
    members = cut(members)
    same = class_pairs(members, "set_id", "key")
    sizes = members.groupBy("set_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blks")).where("blks > 1")
    side = lambda s: members.join(sizes, "set_id", "left").select(F.col("set_id").alias(s), F.pmod(F.xxhash64(F.lit(5), "key"), F.coalesce("blks", F.lit(1))).cast("int").alias(f"{s}_blk"), F.col("key").alias(f"{s}_key"))
    p = pairs.select("a", "b")
    for s in ("a", "b"):
        p = p.join(sizes.withColumnRenamed("set_id", s), s, "left").withColumn(f"{s}_blk", F.explode(F.sequence(F.lit(0), F.coalesce("blks", F.lit(1)) - 1))).drop("blks")
    across = p.join(side("a"), ["a", "a_blk"]).join(side("b"), ["b", "b_blk"]).where("a_key != b_key")
    return same.union(across.select(F.least("a_key", "b_key"), F.greatest("a_key", "b_key"))).toDF("key_a", "key_b").distinct()


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``key, set_id, group_id, n_links``: one row a record; a group is a connected set of similar records.

    ``n_links`` counts similar sets other than the record's own.
    """
    parts = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    links = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("n_links"))
    out = members.join(parts.select(F.col("id").alias("set_id"), "component"), "set_id", "left").join(links, "set_id", "left")
    return out.select("key", "set_id", F.coalesce("component", "set_id").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def digest(value: Column) -> Column:
    """The 256-bit digest that a file hash denotes, as 64 hex digits; null if it denotes none.

    Hexadecimal in either case (with 0x, sha256: or separators) and base64 in the usual
    or the URL alphabet, padded or not, are read.
    """
    s = F.regexp_replace(F.trim(value), "(?i)^(sha-?256[:=]|urn:sha256:)\\s*", "")
    # base64 may begin with 0x as well, so that is only taken off before hexadecimal digits
    plain = F.lower(F.regexp_replace(F.regexp_replace(s, "(?i)^0x", ""), "[\\s:-]", ""))
    b64 = F.concat(F.translate(F.regexp_replace(s, "=+$", ""), "-_", "+/"), F.lit("="))
    out = F.when(plain.rlike("^[0-9a-f]{64}$"), plain).when(s.rlike("^[A-Za-z0-9+/_-]{43}=?$"), F.lower(F.hex(F.unbase64(b64))))
    return F.when(~out.rlike("^0{64}$") & (F.length(out) == 64), out)


def same_files(df: DataFrame) -> DataFrame:
    """``key_a, key_b``: different file ids whose hash denotes one digest."""
    d = df.select("file_id", digest(F.col("file_hash")).alias("d")).where("file_id is not null and d is not null").distinct()
    return class_pairs(d, "d", "file_id").toDF("key_a", "key_b")
