"""Evaluation passages inside a corpus, by an FM-index of every corpus shard.

A shard is the word sequence of a run of whole documents, in which words that no test item
has are ends of pieces.  Its Burrows-Wheeler transform follows the full order of suffixes,
every end being a symbol of its own; ranks come from a wavelet matrix, places from sampled
suffix positions.  Every ``SEED``-word phrase of every test item is searched.  A passage
that satisfies the rules below must hold at least four such phrases close to one
diagonal, so places without them are dropped; the others are aligned word by word.

A document holds an item if it has at least 18 consecutive words of it, or at least 24
words in order with at most one in seven changed, dropped or added.  Words are runs of
letters or digits without case, accents, punctuation and markup.

Defined results: null or blank texts and items hold nothing; repeated documents and items
each count; an item shorter than 18 words can't be found.  Test items are sent to the
executors in groups of about ``ITEM_CHARS`` characters; the corpus is read and indexed once
for all groups.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words of a searched phrase. 24 words with 3 edits, 28 with 4 and so on always keep 5 in a row.
SEED = 5
#: Rules: consecutive words, words in order, and one edit in so many words.
RUN, ORDERED, ONE_IN = 18, 24, 7
#: Words of a shard, about; distance of sampled suffix positions; characters of a group of items.
SHARD_WORDS, SAMPLE, ITEM_CHARS = 2_000_000, 4, 4_000_000
#: Most different words of all test items (about 100 bytes each in the executors' dictionary).
MOST_WORDS = 2_000_000

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"""</?[A-Za-z][\w:-]*(?:\s+[\w:-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))?)*\s*/?>""")
MARKS = re.compile("[̀-ͯ­​-‍⁠﻿]+")


def normal(text: str) -> str:
    if "<" in text:
        text = TAG.sub(lambda m: " " * len(m.group()), text)
    if text.isascii():
        return text.lower()
    return MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold()


def word_places(text: str) -> list[tuple[int, int]]:
    """(start, end) in the text of each word that ``normal`` yields."""
    if "<" in text:
        text = TAG.sub(lambda m: " " * len(m.group()), text)
    if text.isascii():
        return [m.span() for m in WORD.finditer(text)]
    out, at = [], []
    for i, c in enumerate(text):
        n = MARKS.sub("", unicodedata.normalize("NFKD", c)).casefold()
        out.append(n)
        at += [i] * len(n)
    joined = "".join(out)
    return [(at[a], at[b - 1] + 1) for a, b in (m.span() for m in WORD.finditer(joined))]


class WaveletMatrix:
    """Ranks of symbols in a sequence, for whole arrays of questions at once."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.n, self.bits = len(seq), max(1, int(sigma - 1).bit_length())
        self.word, self.before, self.zeros = [], [], []
        cur = seq
        for level in range(self.bits - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros((len(bit) >> 6) + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.word.append(words)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.zeros.append(int(len(bit) - bit.sum(dtype=np.int64)))
            on = bit.astype(bool)
            cur = np.concatenate([cur[~on], cur[on]])
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k][w] + np.bitwise_count(self.word[k][w] & mask)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            one = self._ones(k, i)
            i = np.where((c >> (self.bits - 1 - k)) & 1, self.zeros[k] + one, i - one)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before place i."""
        return self._down(c, i) - self.start[c]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            bit = (self.word[k][i >> 6] >> (i & 63).astype(np.uint64)).astype(np.int64) & 1
            one = self._ones(k, i)
            i = np.where(bit, self.zeros[k] + one, i - one)
            c = c << 1 | bit
        return c, i - self.start[c]


def suffix_order(seq: np.ndarray, bits: int) -> np.ndarray:
    """Places of ``seq`` in the full order of its suffixes, every 0 being an end of its own (ends by place).

    The words up to the first end are packed into one key and sorted; only what is still
    equal, and so runs over more words than a key holds, goes into further rounds, in which
    the rank of what follows is the key.  A round doubles the words that count.
    """
    n, width = len(seq), max(1, 62 // bits)
    key, live = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(width):
        w = np.r_[seq[k:], np.zeros(min(k, n), np.int64)][:n]
        live &= w > 0
        key = (key << bits) | np.where(live, w, 0)
    order = np.argsort(key, kind="stable")
    # suffixes that meet an end within the key are in order already: equal ones by the place of their end
    s, alive = key[order], live[order]
    tied = np.r_[False, (s[1:] == s[:-1]) & alive[1:]]
    head = np.maximum.accumulate(np.where(tied, 0, np.arange(n)))
    rank = np.empty(n, np.int64)
    rank[order] = head
    at = np.flatnonzero(tied | np.r_[tied[1:], False])
    while len(at):
        place, group = order[at], head[at]
        key = rank[place + width]
        o = np.lexsort((key, group))
        place, group, key = place[o], group[o], key[o]
        order[at] = place
        tied = np.r_[False, (group[1:] == group[:-1]) & (key[1:] == key[:-1])]
        head[at] = np.maximum.accumulate(np.where(tied, 0, at))
        rank[place] = head[at]
        at = at[tied | np.r_[tied[1:], False]]
        width *= 2
    return order


class FMIndex:
    """Phrases of a sequence of symbols 1 .. sigma-1, cut by ends (0); ends are never searched nor crossed."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        seq = np.r_[seq, 0].astype(np.int64)
        sa = suffix_order(seq, max(1, int(sigma - 1).bit_length()))
        self.wavelet = WaveletMatrix(seq[sa - 1], sigma)
        self.before = np.r_[0, np.cumsum(np.bincount(seq, minlength=sigma))]
        # the walk back to a sampled place ends at the first word after an end at the latest
        self.sampled = (sa % SAMPLE == 0) | (seq[sa - 1] == 0)
        self.index = np.cumsum(self.sampled) - 1
        self.places = sa[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of each phrase (rows of one length)."""
        c = phrases[:, -1]
        lo, hi = self.before[c], self.before[c + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            c = phrases[:, k]
            lo, hi = (self.before[c] + self.wavelet.rank(c, x) for x in (lo, hi))
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, at = np.full(len(rows), -1, np.int64), rows.copy()
        for step in range(SAMPLE):
            open_ = out < 0
            known = open_.copy()
            known[open_] = self.sampled[at[open_]]
            out[known] = self.places[self.index[at[known]]] + step
            left = np.flatnonzero(out < 0)
            if not len(left):
                break
            c, r = self.wavelet.symbol_and_rank(at[left])
            at[left] = self.before[c] + r
        return out


class Words:
    """Numbers of all words of the test items, from 1; a shard is written in them once for all groups of items."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}

    def write(self, text: str) -> np.ndarray:
        return np.array([self.number.setdefault(x, len(self.number) + 1) for x in WORD.findall(normal(text))], np.int32)

    def read(self, text: str) -> np.ndarray:
        get = self.number.get
        return np.array([get(x, 0) for x in WORD.findall(normal(text))], np.int32)

    @property
    def sigma(self) -> int:
        return len(self.number) + 1


class Items:
    """A group of test items as arrays: every distinct phrase of SEED words, and the items and places where it stands."""

    def __init__(self, ids: list[int], words: list[np.ndarray]) -> None:
        self.ids, self.words = ids, words
        long = [(k, np.lib.stride_tricks.sliding_window_view(w, SEED)) for k, w in enumerate(words) if len(w) >= SEED]
        every = np.concatenate([v for _, v in long]) if long else np.zeros((0, SEED), np.int32)
        item = np.concatenate([np.full(len(v), k, np.int32) for k, v in long]) if long else np.zeros(0, np.int32)
        pos = np.concatenate([np.arange(len(v), dtype=np.int32) for _, v in long]) if long else np.zeros(0, np.int32)
        self.phrases, which = np.unique(every, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.first = np.r_[0, np.cumsum(np.bincount(which.ravel(), minlength=len(self.phrases)))].astype(np.int64)


def reach(item: list[int], doc: list[int], most: int) -> list[tuple[int, int]]:
    """For 0 .. most edits: how many words of item and doc the furthest alignment from their beginnings covers that ends with a common word."""

    def slide(x: int, d: int) -> int:
        while x < len(item) and x + d < len(doc) and item[x] == doc[x + d]:
            x += 1
        return x

    front = {0: slide(0, 0)}  # by diagonal: item words
    best = (front[0], front[0])
    out = [best]
    for e in range(1, most + 1):
        new = {}
        for d in range(-e, e + 1):
            # one word changed, dropped or added, then all that agrees
            x = max(front.get(d, -2) + 1, front.get(d + 1, -2) + 1, front.get(d - 1, -1))
            x = min(x, len(item), len(doc) - d)
            if x < 0 or x + d < 0:
                continue
            new[d] = y = slide(x, d)
            if y > x and y > best[0]:
                best = (y, y + d)
        front = new
        out.append(best)
    return out


def passages(item: list[int], doc: list[int], seeds: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Word ranges of ``doc`` that hold ``item`` by the rules around phrases in common, given as (place in item, place in doc).

    An alignment by the rules holds a phrase, and so the whole run of common words around
    it; from the run it goes on both ways as far as its edits allow.  Runs are followed to
    their ends: the last words of a text are not taken out of one run to lengthen another.
    """
    most, seen = len(item) // ONE_IN, {}
    for pos, at in seeds:
        if seen.get(at - pos, -1) >= pos:
            continue
        i, j, k = pos, at, pos
        while i and j and item[i - 1] == doc[j - 1]:
            i, j = i - 1, j - 1
        while k < len(item) and k + at - pos < len(doc) and item[k] == doc[k + at - pos]:
            k += 1
        seen[at - pos] = k - SEED
        n, end = k - i, k + at - pos
        got = (j, end) if n >= RUN else None
        if len(item) >= ORDERED:
            right = reach(item[k:], doc[end : end + len(item) + most], most)
            left = reach(item[:i][::-1], doc[max(0, j - len(item) - most) : j][::-1], most)
            for e, (x, y) in enumerate(left):
                for f, (u, v) in enumerate(right):
                    if x + n + u >= max(ORDERED, ONE_IN * (e + f)) and (got is None or end + v - j + y > got[1] - got[0]):
                        got = (j - y, end + v)
        if got:
            yield got


def shard_index(words: list[np.ndarray], sigma: int) -> tuple[FMIndex, np.ndarray, np.ndarray]:
    """The index of a shard, the shard's place of each place of it, and where each document starts."""
    length = np.array([len(w) + 1 for w in words], np.int64)
    start = np.cumsum(length) - length
    seq = np.zeros(int(length.sum()), np.int32)
    for s, w in zip(start, words):
        seq[s : s + len(w)] = w
    # a run of words that no item has is one end
    keep = np.flatnonzero((seq > 0) | (np.r_[1, seq[:-1]] > 0))
    return FMIndex(seq[keep], sigma), np.r_[keep, len(seq)], start


def _search_shard(items: Items, index: tuple[FMIndex, np.ndarray, np.ndarray], words: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
    fm, origin, start = index
    if not len(items.phrases):
        return
    lo, hi = fm.search(items.phrases)
    n = hi - lo
    if not n.sum():
        return
    phrase = np.repeat(np.arange(len(n)), n)
    place = origin[fm.locate(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum()))]
    order = np.argsort(place)
    place, phrase = place[order], phrase[order]
    # four phrases within reach, whatever their item
    reach = 2 * ORDERED
    near = np.zeros(len(place), bool)
    if len(place) >= 4:
        close = place[3:] - place[:-3] <= reach
        for k in range(4):
            near[k : len(place) - 3 + k] |= close
    place, phrase = place[near], phrase[near]
    # now by item and diagonal
    cnt = items.first[phrase + 1] - items.first[phrase]
    rep = np.repeat(np.arange(len(phrase)), cnt)
    occ = np.repeat(items.first[phrase] - (np.cumsum(cnt) - cnt), cnt) + np.arange(cnt.sum())
    place, item, pos = place[rep], items.item[occ], items.pos[occ]
    doc = np.searchsorted(start, place, "right") - 1
    order = np.lexsort((place, item, doc))
    place, item, pos, doc = place[order], item[order], pos[order], doc[order]
    diagonal = place - pos
    group = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]) if len(doc) else doc
    keep = np.zeros(len(doc), bool)
    # a passage drifts by few words, so its phrases lie in one of two overlapping bands of diagonals
    for shift in (0, 8):
        band = (diagonal + shift) // 16
        o = np.lexsort((place, band, group))
        p, g, b = place[o], group[o], band[o]
        ok = (g[3:] == g[:-3]) & (b[3:] == b[:-3]) & (p[3:] - p[:-3] <= reach)
        for k in range(4):
            keep[o[k : len(o) - 3 + k][ok]] = True
    place, pos, doc, item, group = place[keep], pos[keep], doc[keep], item[keep], group[keep]
    if not len(doc):
        return
    cuts = np.r_[0, np.flatnonzero((group[1:] != group[:-1]) | (place[1:] - place[:-1] > reach)) + 1, len(doc)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        d, k = int(doc[a]), int(item[a])
        if len(np.unique(place[a:b])) < 4:
            continue
        base, wd, wi = int(start[d]), words[d], items.words[k].tolist()
        left = max(0, int(place[a]) - base - 2 * len(wi))
        part = wd[left : int(place[b - 1]) - base + 2 * len(wi) + SEED].tolist()
        for lo, hi in set(passages(wi, part, list(zip(pos[a:b].tolist(), (place[a:b] - base - left).tolist())))):
            yield d, k, left + lo, left + hi


def leaked_passages(corpus: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, span_start, span_end``: the places (characters) of documents that hold a test item."""
    spark = corpus.sparkSession
    tests = items.select(F.col(item_key).cast("bigint").alias("item_id"), F.col(text).alias("text")).where("text is not null")
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // ITEM_CHARS))
    words, groups = Words(), []
    for k in range(parts):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()  # about ITEM_CHARS characters
        groups.append(spark.sparkContext.broadcast(Items([r[0] for r in rows], [words.write(r[1]) for r in rows])))
        if words.sigma > MOST_WORDS:
            raise ValueError("the test items have too many different words for one vocabulary; search them in parts")
    shared = spark.sparkContext.broadcast(words)
    schema = "doc_id bigint, item_id bigint, span_start bigint, span_end bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def flush(docs: list, words: list) -> Iterator[pa.RecordBatch]:
            index = shard_index(words, known.sigma)
            for group in groups:
                items, found = group.value, []
                for d, k, a, b in _search_shard(items, index, words):
                    places = word_places(docs[d][1])
                    found.append((docs[d][0], items.ids[k], places[a][0], places[b - 1][1]))
                cols = list(zip(*found)) if found else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "span_start", "span_end"])

        docs, words, held = [], [], 0
        for b in batches:
            for key, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                docs.append((key, t))
                words.append(known.read(t))
                held += len(words[-1])
                if held >= SHARD_WORDS:
                    yield from flush(docs, words)
                    docs, words, held = [], [], 0
        if docs:
            yield from flush(docs, words)

    src = corpus.select(F.col(doc_key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return src.mapInArrow(run, schema).withColumnRenamed("doc_id", doc_key).withColumnRenamed("item_id", item_key)


def removal_spans(leaks: DataFrame) -> DataFrame:
    """``doc_id, span_start, span_end, item_ids``: overlapping places of a document merged, with the items they hold."""
    from pyspark.sql import Window as W

    order = W.partitionBy("doc_id").orderBy("span_start", "span_end", "item_id").rowsBetween(W.unboundedPreceding, -1)
    new = F.coalesce(F.col("span_start") > F.max("span_end").over(order), F.lit(True)).cast("int")
    marked = leaks.withColumn("new", new)
    marked = marked.withColumn("n", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "n").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.array_sort(F.collect_set("item_id")).alias("item_ids")).drop("n")
