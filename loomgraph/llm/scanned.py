"""Repairing text of scanned pages: page furniture, words broken across lines, misread characters.

Furniture is told by page position: a line that stands at the top or bottom of pages and
recurs in the file (apart from page numbers and single misread characters) is a running
head, and where that leaves doubt a perceptron decides, which has learned from the clear
cases how furniture stands on pages; a line of only a page number or mark beside a page end
is a page mark.  Broken words are joined over furniture by a learned join operation, whose
features are how the corpus knows both readings and the letters at the break.  Misread words go to a character editor, an averaged perceptron whose
operations per character are keep, delete and replace by one or two characters (which
covers insertions), trained here on corpus words corrupted by typical shape confusions.
The confusions are a table of usual ones and what the pages
themselves teach: differences from frequent words that rare words of scanned pages show far
oftener than those of other pages.  Its readings are looked up in the word counts of the whole corpus by an equi-join on the
shape, in which all confusable strings coincide: every corpus word that a word can be
misread from is found, whatever its length and the number of misread places, and the
editor only scores.  A reading counts if it is far better attested than what stands there.

All of these learn from everything that the corpus shows, not from a sample.  Editor and
joins go by iterative parameter mixing: shards of words are each passed over from the same
weights, whose changes are then averaged, round by round; a vocabulary that makes one shard
is trained in the driver.  What furniture learns from comes down to a bounded number of
distinct examples with counts.

Defined results: null and blank content gives no rows and null text; chunks without any
sign of a scanned page are left as they are; a chunk delivered twice is repaired under
each key; repeated findings of a chunk come out once.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut

#: Right characters and what a scan makes of them (fixed values).
CONFUSIONS = {
    "i": "1 l", "l": "1 i", "o": "0", "e": "c", "c": "e", "t": "†", "s": "5", "d": "cl", "cl": "d", "u": "ii", "g": "9", "m": "rn",
    "rn": "m", "h": "b", "b": "6", "ti": "ü", "w": "vv", "ll": "11", "fi": "ﬁ", "fl": "ﬂ", "a": "@", "z": "2", "n": "ri", "B": "8", "S": "5", "O": "0", "I": "1 l", "G": "6",
}
#: What these strings have in common: longer forms of a character, then one character for those that look alike.
LONGER = (("m", "rn"), ("n", "ri"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("ü", "ti"), ("ﬁ", "fi"), ("ﬂ", "fl"))
ALIKE = ("l1c06b†59@2", "iieohhtsgaz")
#: Confusions that the pages themselves teach: least number of words that show one, and how much commoner it must be
#: among rare words of scanned pages than among rare words of other pages.
LEARN_LEAST, LEARN_RATIO = 6, 10.0
#: Corruptions of each training word, rounds, readings that ``readings`` gives.
CORRUPTIONS, ROUNDS, READINGS = 3, 3, 12
#: Words of a training shard; the shards hold all words.
SHARD_WORDS = 4_000
#: A reading must occur so many times as often as what stands there, and so often at least.
BETTER, LEAST = 4, 3

LETTERS = set("abcdefghijklmnopqrstuvwxyz'’-")
LINE = re.compile("[\n\f]")
PAGE_MARK = re.compile(r"\[\s*page\s+\d+\s*\]|page\s+\d+(\s+of\s+\d+)?|-\s*\d+\s*-|–\s*\d+\s*–|p\.\s*\d+|\d{1,4}|[ivxlcdm]{1,7}|\d+\s*/\s*\d+|seite\s+\d+|\|\s*\d+\s*\|", re.I)
WEAK_MARK = re.compile(r"p\.\s*\d+|\d{1,4}|[ivxlcdm]{1,7}", re.I)
NUMBER_ENDS = re.compile(r"^\s*\d{1,4}\s*[|·•–-]\s*|\s{2,}\d{1,4}\s*$|\s*[|·•]\s*(?:page\s*)?\d{1,4}\s*$|\s+\d{1,4}\s*$", re.I)
BROKEN = re.compile("([^\\W\\d_][\\w†ﬁﬂ@’-]*?)(-|­|¬|‐) ?$")
FIRST = re.compile("^\\s*([\\w†ﬁﬂ@’]+(?:-[\\w†ﬁﬂ@’]+)*)")
TOKEN = re.compile("[\\w†ﬁﬂ@]+(?:[-’][\\w†ﬁﬂ@]+)*")
SAME = str.maketrans({"1": "i", "l": "i", "0": "o", "5": "s", "9": "g", "6": "b", "†": "t", "8": "b", "|": "i"})


def head_key(line: str) -> str:
    """What copies of a running head have in common."""
    bare = NUMBER_ENDS.sub("", line).strip()
    key = re.sub(r"[^\w]+", " ", bare.casefold().translate(SAME)).strip()
    return key.replace("rn", "m").replace("ci", "d").replace("vv", "w")


def lines_of(text: str) -> list[tuple[str, str]]:
    """(line, what ended it)."""
    out, at = [], 0
    for m in LINE.finditer(text):
        out.append((text[at : m.start()], m.group()))
        at = m.end()
    out.append((text[at:], ""))
    return out


def maybe_head(line: str) -> bool:
    s = line.strip()
    if PAGE_MARK.fullmatch(s):
        return False
    return 4 <= len(s) <= 90 and not s.endswith((".", ",", ";", ":", "?", "!", "-", "¬", "­", "|")) and not s.startswith(("|", "#", "-", "*")) and sum(c.isalpha() for c in s) >= 4 and (s[0].isupper() or s[0].isdigit())


def head_candidates(text: str) -> list[str]:
    return [head_key(x) for x, _ in lines_of(text) if maybe_head(x)] if text else []


def furniture(text: str, heads: set[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """The lines, and of each: '' body, 'header', 'page_no' or 'blank'."""
    lines = lines_of(text)
    kind = ["blank" if not x.strip() else "header" if maybe_head(x) and head_key(x) in heads else "" for x, _ in lines]
    for i, (x, _) in enumerate(lines):
        s = x.strip()
        if kind[i] or not PAGE_MARK.fullmatch(s):
            continue
        edge = i == 0 or i == len(lines) - 1 or "\f" in (lines[i][1], lines[i - 1][1]) or kind[i - 1] == "header" or (i + 1 < len(lines) and kind[i + 1] in ("header", "blank") and any(k == "header" for k in kind[i + 1 : i + 3]))
        if not WEAK_MARK.fullmatch(s) or (edge and ("header" in kind or any(e == "\f" for _, e in lines))):
            kind[i] = "page_no"
    return lines, kind


def breaks(lines: list[tuple[str, str]], kind: list[str]) -> list[tuple[int, int, str, str, str]]:
    """(line, next body line, left, right, mark) of words broken at a line end."""
    out = []
    body = [i for i, k in enumerate(kind) if k == ""]
    for i, j in zip(body, body[1:]):
        m = BROKEN.search(lines[i][0])
        if not m or (r := FIRST.match(lines[j][0])) is None:
            continue
        left = TOKEN.findall(lines[i][0][: m.end(1)])[-1]
        if r.group(1)[0].isalpha() or r.group(1)[0] in "†ﬁﬂ1059":
            out.append((i, j, left, r.group(1), m.group(2)))
    return out


class Confusions:
    """Pairs (right, wrong) of what a scan makes of characters, and the key under which confusable words meet."""

    def __init__(self, learned: list[tuple[str, str]] = ()) -> None:
        known = [(right, wrong) for right, ws in CONFUSIONS.items() for wrong in ws.split()]
        self.pairs = list(dict.fromkeys([*known, *learned]))
        self.longer, alike = list(LONGER), dict(zip(*ALIKE))
        for right, wrong in learned:
            if len(right) == len(wrong) == 1:
                a, b = alike.get(wrong, wrong), alike.get(right, right)
                alike = {c: b if to == a else to for c, to in alike.items()} | {wrong: b, a: b}
            elif (pair := (right, wrong) if len(right) < len(wrong) else (wrong, right)) not in self.longer:
                self.longer.append(pair)
        self.alike = {c: to for c, to in alike.items() if c != to}

    def shape(self, word: Column) -> Column:
        """One key for all lower-case words that known confusions turn into each other."""
        for a, b in self.longer:
            word = F.replace(word, F.lit(a), F.lit(b))
        return F.translate(word, "".join(self.alike), "".join(self.alike.values()))


KNOWN = Confusions()


def learn_confusions(rare: list[str], plain: list[str], frequent: list[str]) -> list[tuple[str, str]]:
    """(right, wrong) of up to two characters in which rare words of scanned pages differ from frequent words, far oftener than rare words elsewhere do."""
    at: dict[tuple[str, str], set[str]] = {}
    for w in frequent:
        for i in range(len(w)):
            for k in (1, 2):
                if i + k <= len(w) and len(w) - k >= 3:
                    at.setdefault((w[:i], w[i + k :]), set()).add(w[i : i + k])

    def shown(words: list[str]) -> Counter:
        out: Counter = Counter()
        for w in words:
            ops = set()
            for i in range(len(w)):
                for k in (1, 2):
                    if i + k <= len(w):
                        wrong = w[i : i + k]
                        # the shortest difference only: no common end in what differs
                        ops |= {(right, wrong) for right in at.get((w[:i], w[i + k :]), ()) if right[0] != wrong[0] and right[-1] != wrong[-1] and (len(right), k) != (2, 2)}
            if len(ops) == 1:
                out.update(ops)
        return out

    scans, others = shown(rare), shown(plain)
    return sorted(op for op, n in scans.items() if _told(n, others[op], len(rare), len(plain)))


def _told(n: int, other: int, rare: int, plain: int) -> bool:
    """Whether ``n`` of ``rare`` words of scanned pages against ``other`` of ``plain`` words elsewhere make a confusion."""
    # one more on either side, so that what is never seen elsewhere has a share as well
    return n >= LEARN_LEAST and n * (plain + 1) >= LEARN_RATIO * (other + 1) * (rare + 1) or n >= 4 * LEARN_LEAST and n * (plain + 1) >= LEARN_RATIO * (other + 0.5) * (rare + 1)


def _gapped(words: DataFrame, part: str) -> DataFrame:
    """Every word of five characters or more with one or two taken out: ``gap``, what is left around them, and ``part``, what they are."""
    at = lambda k: F.expr(f"transform(sequence(1, length(w) - {k - 1}), i -> struct(concat(left(w, i - 1), '_', substr(w, i + {k})) AS gap, substr(w, i, {k}) AS {part}))")
    return words.where("length(w) >= 5").select("*", F.inline(F.concat(at(1), at(2))))


def _learned(few: DataFrame, frequent: DataFrame) -> list[tuple[str, str]]:
    """As ``learn_confusions``, from all rare words (``w, scan``) and all frequent words (``w``) of the corpus."""
    same = lambda f: f(F.col("right")) == f(F.col("wrong"))
    ops = _gapped(few, "wrong").join(_gapped(frequent, "right").drop("w"), "gap").where(~same(lambda c: F.left(c, F.lit(1))) & ~same(lambda c: F.right(c, F.lit(1))) & ((F.length("right") < 2) | (F.length("wrong") < 2)))
    op = F.struct("right", "wrong")
    ops = ops.groupBy("w", "scan").agg(F.min(op).alias("op"), F.max(op).alias("other")).where("op = other")
    ops = ops.groupBy("op.right", "op.wrong").agg(F.count_if("scan").alias("n"), F.count_if(~F.col("scan")).alias("other")).where(F.col("n") >= LEARN_LEAST)
    rare, plain = few.agg(F.count_if("scan"), F.count_if(~F.col("scan"))).first()
    return sorted((r["right"], r["wrong"]) for r in ops.collect() if _told(r["n"], r["other"], rare, plain))


class Editor:
    """Averaged perceptron over characters, decoded with a beam."""

    def __init__(self, weights: dict[str, float], labels: dict[str, list[str]], confusions: Confusions = KNOWN) -> None:
        self.weights, self.labels, self.confusions = weights, labels, confusions

    @staticmethod
    def features(w: str, i: int, before: str) -> tuple[str, ...]:
        p, c, n = (w[i - 1] if i else "^"), w[i], (w[i + 1] if i + 1 < len(w) else "$")
        pp, nn = (w[i - 2] if i > 1 else "^"), (w[i + 2] if i + 2 < len(w) else "$")
        return (f"c{c}", f"p{p}{c}", f"n{c}{n}", f"x{p}{c}{n}", f"q{pp}{p}{c}", f"r{c}{n}{nn}", f"b{before}{c}", f"d{c}{'a' if p.isalpha() else '#'}{'a' if n.isalpha() else '#'}")

    def score(self, feats: tuple[str, ...], label: str) -> float:
        get = self.weights.get
        return sum(get(f + "\t" + label, 0.0) for f in feats)

    def readings(self, w: str, most: int = READINGS) -> list[tuple[str, float]]:
        beam: list[tuple[float, str, str]] = [(0.0, "", "^")]
        for i, c in enumerate(w):
            nxt = []
            for s, out, before in beam:
                feats = self.features(w, i, before)
                for label in self.labels.get(c, ("=",)):
                    got = c if label == "=" else "" if label == "-" else label
                    nxt.append((s + self.score(feats, label), out + got, label))
            nxt.sort(key=lambda x: -x[0])
            beam = nxt[: 4 * most]
        seen: dict[str, float] = {}
        for s, out, _ in beam:
            seen.setdefault(out, s)
        return list(seen.items())[:most]

    def best(self, w: str, reading: str | None = None) -> tuple[float, str] | None:
        """Score and text of the best repair of ``w`` by known confusions; none if there is none.

        It is exact, as features see the label before only.  With ``reading`` the repair gives
        that; otherwise it is of letters, by operations seen in training.
        """
        at: list[dict[tuple[int, str], tuple[float, str]]] = [{} for _ in range(len(w) + 1)]
        at[0][0, "^"] = (0.0, "")
        for i, c in enumerate(w):
            steps = [(c, ["="])] if reading is not None or c in LETTERS else []
            steps += [(right, _operations(right, wrong)) for right, wrong in self.confusions.pairs if w.startswith(wrong, i)]
            for (j, before), (s, out) in at[i].items():
                for got, ops in steps:
                    if reading is not None:
                        if not reading.startswith(got, j):
                            continue
                    elif any(o not in self.labels.get(w[i + k], ("=",)) for k, o in enumerate(ops)):
                        continue
                    total, last = s, before
                    for k, o in enumerate(ops):
                        total += self.score(self.features(w, i + k, last), o)
                        last = o
                    state = (j + len(got) if reading is not None else 0, last)
                    there = at[i + len(ops)]
                    if state not in there or (total, out + got) > there[state]:
                        there[state] = (total, out + got)
        return max((v for (j, _), v in at[-1].items() if reading is None or j == len(reading)), default=None)


def shape(word: Column) -> Column:
    return KNOWN.shape(word)


_SHAPES = KNOWN.pairs


def explained(word: str, reading: str, confusions: Confusions = KNOWN) -> bool:
    """Whether ``reading`` can look like ``word``: confusions turn one into the other."""
    todo, seen = [(0, 0)], set()
    while todo:
        i, j = todo.pop()
        if i == len(word) and j == len(reading):
            return True
        if (i, j) in seen:
            continue
        seen.add((i, j))
        if i < len(word) and j < len(reading) and word[i] == reading[j]:
            todo.append((i + 1, j + 1))
        todo += [(i + len(wrong), j + len(right)) for right, wrong in confusions.pairs if word.startswith(wrong, i) and reading.startswith(right, j)]
    return False


def _operations(right: str, wrong: str) -> list[str]:
    """The operation on each character of ``wrong`` that repairs it."""
    return list(right) if len(right) == len(wrong) == 2 else [right, *["-"] * (len(wrong) - 1)]


def _places(word: str, confusions: Confusions) -> list[tuple[int, str, str]]:
    return [(i, right, wrong) for right, wrong in confusions.pairs for i in range(len(word)) if word.startswith(right, i)]


def _corrupted(word: str, rng: random.Random, confusions: Confusions = KNOWN, places: list[tuple[int, str, str]] | None = None) -> tuple[str, list[str]]:
    """A misread word and the operation that repairs each of its characters."""
    places = _places(word, confusions) if places is None else places
    out, ops, i = [], [], 0
    chosen = dict((p[0], p) for p in rng.sample(places, min(len(places), 1 if rng.random() < 0.7 else 2))) if places else {}
    while i < len(word):
        if i in chosen:
            _, right, wrong = chosen[i]
            out.append(wrong)
            ops += _operations(right, wrong)
            i += len(right)
        else:
            out.append(word[i])
            ops.append("=")
            i += 1
    return "".join(out), ops


def _pairs(words: list[str], rng: random.Random, confusions: Confusions) -> list[tuple[str, list[str]]]:
    """Of every word: as it is, and corrupted."""
    pairs = []
    for w in words:
        places = _places(w, confusions)
        pairs.append((w, ["="] * len(w)))
        pairs += [_corrupted(w, rng, confusions, places) for _ in range(CORRUPTIONS)]
    return pairs


#: Of one pass: change of each weight, sum of that change over all steps, steps.
Passed = tuple[dict[str, int], dict[str, int], int]


class _Changes:
    """Weights that a pass changes, from ``start`` on."""

    def __init__(self, start: dict[str, float]) -> None:
        self.weights, self.change, self.area, self.stamp, self.step = dict(start), {}, {}, {}, 0

    def add(self, key: str, v: int) -> None:
        was = self.change.get(key, 0)
        self.area[key] = self.area.get(key, 0) + (self.step - self.stamp.get(key, 0)) * was
        self.stamp[key], self.change[key] = self.step, was + v
        self.weights[key] = self.weights.get(key, 0.0) + v

    def passed(self) -> Passed:
        return self.change, {k: a + (self.step - self.stamp[k]) * self.change[k] for k, a in self.area.items()}, self.step


def _averaged(one: Callable[[int, dict[str, float]], Passed], rounds: int, shards: int = 1) -> dict[str, float]:
    """Mean weights over all steps of all rounds; ``one`` sums up what the passes over all shards have changed."""
    weights: dict[str, float] = {}
    total: dict[str, float] = {}
    steps = 0
    for r in range(rounds):
        change, area, n = one(r, weights)
        for k, v in weights.items():
            total[k] = total.get(k, 0.0) + v * n
        for k, v in area.items():
            total[k] = total.get(k, 0.0) + v
        for k, v in change.items():
            weights[k] = weights.get(k, 0.0) + v / shards
        steps += n
    return {k: v / max(1, steps) for k, v in total.items()}


def _mixed(rows: DataFrame, n: int, rounds: int, one: Callable[[int, pa.Table, int, dict[str, float]], Passed]) -> dict[str, float]:
    """Mean weights trained on all ``n`` rows (``w``, ...) in shards, each passed over by ``one(shard, rows, round, weights)``."""
    shards = -(-n // SHARD_WORDS)
    # of as many partitions as shards, as small ones would be put into one task
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("w"), F.lit(shards)).cast("int")).repartition(shards, "shard")

    def whole(r: int, weights: dict[str, float]) -> Passed:
        shared = rows.sparkSession.sparkContext.broadcast(weights)

        def run(key: tuple, t: pa.Table) -> pa.Table:
            change, area, steps = one(key[0].as_py(), t.sort_by("w"), r, shared.value)
            return pa.table({"key": ["", *change], "change": [0, *change.values()], "area": [steps, *(area[k] for k in change)]})

        got = rows.groupBy("shard").applyInArrow(run, "key string, change bigint, area bigint").groupBy("key").agg(F.sum("change"), F.sum("area")).toArrow()
        keys, change, area = (c.to_pylist() for c in got.columns)
        shared.destroy()
        area = dict(zip(keys, area))
        steps = area.pop("")
        return {k: v for k, v in zip(keys, change) if k}, area, steps

    return _averaged(whole, rounds, shards)


def _shuffled(rng: random.Random, examples: list, r: int) -> list:
    """In the order of round ``r``."""
    for _ in range(r + 1):
        rng.shuffle(examples)
    return examples


def _edited(pairs: list[tuple[str, list[str]]], labels: dict[str, list[str]], weights: dict[str, float]) -> Passed:
    """One pass of the editor over ``pairs``."""
    at = _Changes(weights)
    ed = Editor(at.weights, labels)
    for w, ops in pairs:
        before = "^"
        for i, c in enumerate(w):
            at.step += 1
            options = labels[c]
            if len(options) > 1:
                feats = ed.features(w, i, before)
                guess = max(options, key=lambda o: ed.score(feats, o))
                if guess != ops[i]:
                    for f in feats:
                        at.add(f + "\t" + ops[i], 1)
                        at.add(f + "\t" + guess, -1)
            before = ops[i]
    return at.passed()


def _editor(weights: dict[str, float], labels: dict[str, list[str]], confusions: Confusions) -> Editor:
    return Editor({k: v for k, v in weights.items() if abs(v) > 1e-4}, labels, confusions)


def train_editor(words: list[str], seed: int = 7, confusions: Confusions = KNOWN) -> Editor:
    rng = random.Random(seed)
    pairs = _pairs(words, rng, confusions)
    labels: dict[str, list[str]] = {}
    for w, ops in pairs:
        for c, o in zip(w, ops):
            known = labels.setdefault(c, ["="])
            if o not in known:
                known.append(o)
    return _editor(_averaged(lambda r, weights: _edited(_shuffled(rng, pairs, 0), labels, weights), ROUNDS), labels, confusions)


def train_editor_on(words: DataFrame, seed: int = 7, confusions: Confusions = KNOWN) -> Editor:
    """The editor trained on all ``words`` (``w``), in shards if there are many."""
    *shown, n = words.agg(*(F.max(F.contains("w", F.lit(right))).alias(f"c{i}") for i, (right, _) in enumerate(confusions.pairs)), F.count("*").alias("n")).first()
    if n <= SHARD_WORDS:
        return train_editor(sorted(r[0] for r in words.collect()), seed, confusions)
    seen = {(c, o) for (right, wrong), there in zip(confusions.pairs, shown) if there for c, o in zip(wrong, _operations(right, wrong))}
    labels = {c: ["=", *sorted(o for x, o in seen if x == c)] for c in sorted(LETTERS | {c for c, _ in seen})}

    def one(shard: int, t: pa.Table, r: int, weights: dict[str, float]) -> Passed:
        rng = random.Random(seed + shard)
        return _edited(_shuffled(rng, _pairs(t.column("w").to_pylist(), rng, confusions), r), labels, weights)

    return _editor(_mixed(words, n, ROUNDS, one), labels, confusions)


#: An example of a two-way perceptron: features, whether it is one, and how many are like it.
Example = tuple[tuple[str, ...], bool, int]


def _sorted_out(examples: list[Example], weights: dict[str, float]) -> Passed:
    """One pass of a two-way perceptron over named features; equal examples stand together."""
    at = _Changes(weights)
    for feats, right, times in examples:
        while times:
            score = sum(at.weights.get(f, 0.0) for f in feats)
            if (score if right else -score) > 1:  # with a margin, so that what is always right has weight as well
                at.step += times
                break
            at.step, times = at.step + 1, times - 1
            for f in feats:
                at.add(f, 1 if right else -1)
    return at.passed()


#: Rounds and seed of two-way perceptrons.
TWO_WAY_ROUNDS, TWO_WAY_SEED = 8, 5


def perceptron(examples: list[Example]) -> dict[str, float]:
    """Averaged weights of a two-way perceptron."""
    rng, examples = random.Random(TWO_WAY_SEED), list(examples)
    return _averaged(lambda r, weights: _sorted_out(_shuffled(rng, examples, 0), weights), TWO_WAY_ROUNDS)


def _bucket(x: float, *limits: float) -> int:
    return sum(x >= v for v in limits)


def position_features(n: int, edge: int, numbered: int, marked: int, words: int, capitals: int) -> tuple[str, ...]:
    """Of the lines of a file that read alike: how many, and how many at a page's edge, with a page number, beside a page mark."""
    share = lambda x: _bucket(x / max(1, n), 0.01, 0.33, 0.6, 0.9)
    some = edge or numbered or marked
    return ("bias", f"n{_bucket(n, 2, 3, 5)}", f"edge{share(edge)}", f"numbered{share(numbered)}", f"marked{share(marked)}", f"any{_bucket(max(edge, numbered, marked) / max(1, n), 0.01, 0.33, 0.6)}", f"n{min(n, 2)}any{bool(some)}", f"words{_bucket(words, 3, 6, 10)}", f"caps{_bucket(capitals / max(1, words), 0.3, 0.7)}")


def _seed_label(n: int, top: int) -> bool | None:
    """What position says beyond doubt: recurring at page ends is furniture, single or always amid text is not."""
    if n >= 3 and top * 2 >= n:
        return True
    return False if n == 1 or not top else None


def _furniture_example(r: tuple) -> tuple[tuple[str, ...], bool] | None:
    """What lines that read alike teach (their numbers in the order of ``GROUP``), if their position leaves no doubt."""
    *of, tops = r
    y = _seed_label(of[0], tops)
    return None if y is None else (position_features(*of), y)


GROUP = ("n", "edge", "numbered", "marked", "words", "capitals", "tops")


def learn_furniture(rows: list) -> dict[str, float]:
    """Weights from groups of lines whose position leaves no doubt; if there are none, position alone decides."""
    return _furniture_weights(Counter(x for r in rows if (x := _furniture_example([r[c] for c in GROUP])) is not None))


def _furniture_weights(told: dict[tuple[tuple[str, ...], bool], int]) -> dict[str, float]:
    told = Counter(told)
    if len({y for _, y in told}) < 2:
        told.update((position_features(n, e, 0, 0, 4, 2), n >= 2 and e > 0) for n in (1, 2, 3, 6) for e in (0, 1, n))
    return perceptron([(*x, n) for x, n in sorted(told.items())])


def _learn_furniture_on(groups: DataFrame) -> dict[str, float]:
    """As ``learn_furniture``, from all ``groups``, of which equal ones are counted first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_furniture_example(r) for r in zip(*(b.column(c).to_pylist() for c in GROUP))]
            yield pa.RecordBatch.from_arrays([pa.array([x and " ".join(x[0]) for x in got], pa.string()), pa.array([x and x[1] for x in got], pa.bool_()), b.column("times")], ["feats", "y", "times"])

    told = groups.groupBy(*GROUP).agg(F.count("*").alias("times")).mapInArrow(run, "feats string, y boolean, times bigint")
    told = told.where("y is not null").groupBy("feats", "y").agg(F.sum("times").alias("times")).collect()
    return _furniture_weights({(tuple(r["feats"].split()), r["y"]): r["times"] for r in told})


def _heads(chunks: DataFrame) -> DataFrame:
    """``chunk_key, heads``: keys of the running heads of its file that a chunk shows, told by a perceptron over page positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cols = [], [[] for _ in range(7)]
            for r, t in enumerate(b.column("content").to_pylist()):
                ls = lines_of(t)
                for n, (x, _) in enumerate(ls):
                    if maybe_head(x):
                        row.append(r)
                        numbered = NUMBER_ENDS.sub("", x) != x
                        marked = any(PAGE_MARK.fullmatch(y.strip()) for y, _ in ls[max(0, n - 2) : n + 2])
                        edge = n == 0 or n == len(ls) - 1 or ls[n - 1][1] == "\f" or ls[n][1] == "\f"
                        words = x.split()
                        for c, v in zip(cols, (head_key(x), n, edge, numbered, marked, len(words), sum(w[:1].isupper() for w in words))):
                            c.append(v)
            take = pa.array(row, pa.int64())
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("chunk_key", "org", "file_id", "chunk_index")), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["chunk_key", "org", "file_id", "chunk_index", "key", "at", "edge", "numbered", "marked", "words", "capitals"])

    org = F.coalesce("org_id", F.lit("")) if "org_id" in chunks.columns else F.lit("")
    src = chunks.select(F.col("chunk_key").cast("bigint").alias("chunk_key"), org.alias("org"), "file_id", F.col("chunk_index").cast("int").alias("chunk_index"), "content")
    schema = "chunk_key bigint, org string, file_id string, chunk_index int, key string, at int, edge boolean, numbered boolean, marked boolean, words int, capitals int"
    cand = cut(src.mapInArrow(run, schema).where("key != ''"))
    # once for each page of the file, however often a chunk was delivered
    seen = cand.groupBy("org", "file_id", "key", "chunk_index", "at").agg(*(F.max(c).alias(c) for c in ("edge", "numbered", "marked", "words", "capitals")))
    count = lambda c: F.count_if(c).alias(c)
    any_ = F.count_if(F.col("edge") | F.col("numbered") | F.col("marked")).alias("tops")
    groups = cut(seen.groupBy("org", "file_id", "key").agg(F.count("*").alias("n"), count("edge"), count("numbered"), count("marked"), any_, F.max("words").alias("words"), F.max("capitals").alias("capitals")))
    shared = chunks.sparkSession.sparkContext.broadcast(_learn_furniture_on(groups))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            yes = []
            for r in zip(*(b.column(c).to_pylist() for c in GROUP)):
                y = _seed_label(r[0], r[6])
                yes.append(sum(w.get(f, 0.0) for f in position_features(*r[:6])) > 0 if y is None else y)
            yield b.select(["org", "file_id", "key"]).filter(pa.array(yes, pa.bool_()))

    heads = groups.mapInArrow(tell, "org string, file_id string, key string")
    # a missing file is one of its own
    same = [F.col(f"c.{x}").eqNullSafe(F.col(f"h.{x}")) for x in ("org", "file_id", "key")]
    return cand.alias("c").join(heads.alias("h"), same, "left_semi").groupBy("chunk_key").agg(F.collect_set("key").alias("heads"))


_FOUND = "chunk_key bigint, words array<struct<w:string,n:int>>, breaks array<struct<joined:string,hyphened:string,tail:string,head:string,mark:string>>, items array<struct<kind:string,item:string>>, scan boolean"


def _findings(chunks: DataFrame, heads: DataFrame) -> DataFrame:
    """One row a chunk: distinct ``words`` in lower case with counts, ``breaks`` of words at line ends, furniture ``items``, and whether it must be a ``scan``."""
    word = pa.list_(pa.struct([("w", pa.string()), ("n", pa.int32())]))
    part = pa.list_(pa.struct([(c, pa.string()) for c in ("joined", "hyphened", "tail", "head", "mark")]))
    item = pa.list_(pa.struct([("kind", pa.string()), ("item", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, parts, items, scan = [], [], [], []
            for t, hs in zip(batch.column("content").to_pylist(), batch.column("heads").to_pylist()):
                lines, kind = furniture(t, set(hs or ()))
                items.append([{"kind": k, "item": x.strip()} for (x, _), k in zip(lines, kind) if k in ("header", "page_no")])
                split = breaks(lines, kind)
                scan.append("\f" in t or "header" in kind or "page_no" in kind or any(m in "¬­" for *_, m in split))
                cut_end, cut_start = {s[0] for s in split}, {s[1] for s in split}
                said: Counter = Counter()
                for i, (x, _) in enumerate(lines):
                    if kind[i] == "":
                        ws = TOKEN.findall(x.lower())
                        said.update(ws[1 if i in cut_start else 0 : len(ws) - 1 if i in cut_end else len(ws)])
                words.append([{"w": w, "n": n} for w, n in said.items()])
                parts.append([{"joined": (a + b).lower(), "hyphened": f"{a}-{b}".lower(), "tail": a.lower(), "head": b.lower(), "mark": m} for _, _, a, b, m in split])
            yield pa.RecordBatch.from_arrays([batch.column("chunk_key"), pa.array(words, word), pa.array(parts, part), pa.array(items, item), pa.array(scan, pa.bool_())], ["chunk_key", "words", "breaks", "items", "scan"])

    src = chunks.select(F.col("chunk_key").cast("bigint").alias("chunk_key"), "content").join(heads, "chunk_key", "left")
    return src.mapInArrow(run, _FOUND)


#: Words and compounds that joining is learned from.
JOINED, COMPOUND = "^[a-z]{5,}$", "^[a-z]{2,}-[a-z]{2,}$"


def join_features(tail: str, head: str, n_joined: int, n_hyphened: int) -> tuple[str, ...]:
    """Of a word broken at a line end: how the corpus knows both readings, and the letters at the break."""
    known = "j" if n_joined > n_hyphened else "h" if n_hyphened > n_joined else "="
    return ("bias", f"known{known}", f"known{known}{bool(n_joined)}{bool(n_hyphened)}", f"tail{tail[-2:]}", f"head{head[:2]}", f"len{min(len(tail), 5)}{min(len(head), 5)}")


def _join_examples(words: list[tuple[str, int]], compounds: list[tuple[str, int]], seed: int = 11) -> list[Example]:
    """Corpus words broken anywhere and compounds broken at their hyphen.

    Each word stands once with its counts and once as if the corpus did not know it; a reading
    the corpus knows better is right there by the way the examples are made.
    """
    rng, told = random.Random(seed), []
    for w, n in words:
        at = rng.randrange(2, len(w) - 1)
        told += [(join_features(w[:at], w[at:], n, 0), False, 1), (join_features(w[:at], w[at:], 0, 0), False, 1)]
    for w, n in compounds:
        tail, _, head = w.partition("-")
        told.append((join_features(tail, head, 0, n), True, 1))
    # what holds whatever the letters: the better known reading, and joined where neither is
    return told + [(join_features("", "", *n), keep, 1) for n, keep in (((9, 0), False), ((9, 1), False), ((0, 0), False), ((0, 9), True), ((1, 9), True))] * max(3, len(told) // 100)


def learn_joins(words: list[tuple[str, int]], compounds: list[tuple[str, int]]) -> dict[str, float]:
    """Weights that say whether a broken word keeps its hyphen."""
    return perceptron(_join_examples(words, compounds))


def _parted(rows: list[tuple[str, int]]) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Words, and compounds."""
    return [r for r in rows if "-" not in r[0]], [r for r in rows if "-" in r[0]]


def _learn_joins_on(counts: DataFrame) -> dict[str, float]:
    """As ``learn_joins``, from all words and compounds of ``counts``, in shards if there are many."""
    told = counts.where((F.col("w").rlike(JOINED) | F.col("w").rlike(COMPOUND)) & (F.col("n") >= 3)).select("w", "n")
    n = told.count()
    if n <= SHARD_WORDS:
        return learn_joins(*_parted(sorted(tuple(r) for r in told.collect())))

    def one(shard: int, t: pa.Table, r: int, weights: dict[str, float]) -> Passed:
        examples = _join_examples(*_parted(list(zip(t.column("w").to_pylist(), t.column("n").to_pylist()))), seed=11 + shard)
        return _sorted_out(_shuffled(random.Random(TWO_WAY_SEED + shard), examples, r), weights)

    return _mixed(told, n, TWO_WAY_ROUNDS, one)


def _corrections(words: DataFrame, counts: DataFrame, editor: Editor) -> DataFrame:
    """``w, right``: of the given distinct words those that are misread, with their best reading."""
    shared = words.sparkSession.sparkContext.broadcast(editor)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ed = shared.value
        for b in batches:
            got = [ed.best(w, r) for w, r in zip(b.column("w").to_pylist(), b.column("reading").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("w"), b.column("reading"), b.column("n_reading"), pa.array([g and g[0] for g in got], pa.float64())], ["w", "reading", "n_reading", "score"])

    def guessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ed = shared.value
        for b in batches:
            got = [ed.best(w) for w in b.column("w").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("w"), pa.array([g and g[1] for g in got], pa.string())], ["w", "right"])

    shape = editor.confusions.shape
    own = counts.select(F.col("w"), F.col("n").alias("n_own"))
    there = counts.select(F.col("w").alias("reading"), F.col("n").alias("n_reading"), shape(F.col("w")).alias("shape")).where("length(reading) >= 3")
    odd = F.col("w").rlike("[0-9†ﬁﬂ@]")
    tried = words.select("w", shape(F.col("w")).alias("shape")).join(own, "w", "left").withColumn("n_own", F.coalesce("n_own", F.lit(0)))
    known = tried.join(there, "shape").where("reading != w")
    known = known.where((F.col("n_reading") >= BETTER * F.col("n_own")) & (F.col("n_reading") >= F.when(odd, 1).otherwise(LEAST)))
    known = known.select("w", "reading", "n_reading").mapInArrow(scored, "w string, reading string, n_reading bigint, score double").where("score is not null")
    best = known.groupBy("w").agg(F.max(F.struct(F.col("score") + F.log("n_reading"), "reading")).alias("m")).select("w", F.col("m.reading").alias("right"))
    best = cut(best)
    # unknown names: a symbol among letters is surely misread, so the editor's best reading without symbols stands
    mixed = F.col("w").rlike("^[a-z]*[a-z]{2}[a-z]*[0159†ﬁﬂ][a-z]+$|^[a-z]+[†ﬁﬂ][a-z]*$|^[a-z]{3,}[15†]$|^[a-z]+[0159†ﬁﬂ][a-z]{2,}$")
    rest = words.select("w").where(mixed & (F.length("w") >= 5)).join(best, "w", "left_anti")
    guess = rest.mapInArrow(guessed, "w string, right string").where("length(right) >= 3")
    return best.unionByName(guess)


def _resolved(br: DataFrame, counts: DataFrame) -> DataFrame:
    """``joined, hyphened, word, n_joined, n_hyphened``: of every broken word the reading that the learned join operation takes."""
    pairs = br.groupBy("joined", "hyphened").agg(F.min("tail").alias("tail"), F.min("head").alias("head"))
    cj, ch = counts.select(F.col("w").alias("joined"), F.col("n").alias("n_joined")), counts.select(F.col("w").alias("hyphened"), F.col("n").alias("n_hyphened"))
    pairs = pairs.join(cj, "joined", "left").join(ch, "hyphened", "left").na.fill(0, ["n_joined", "n_hyphened"])
    shared = br.sparkSession.sparkContext.broadcast(_learn_joins_on(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            keeps = [sum(w.get(f, 0.0) for f in join_features(*r)) > 0 for r in zip(*(b.column(c).to_pylist() for c in ("tail", "head", "n_joined", "n_hyphened")))]
            word = [h if k else j for k, j, h in zip(keeps, b.column("joined").to_pylist(), b.column("hyphened").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("joined"), b.column("hyphened"), pa.array(word, pa.string()), b.column("n_joined"), b.column("n_hyphened")], ["joined", "hyphened", "word", "n_joined", "n_hyphened"])

    return pairs.mapInArrow(run, "joined string, hyphened string, word string, n_joined bigint, n_hyphened bigint")


def findings(chunks: DataFrame) -> tuple[DataFrame, ...]:
    """(``chunk_key, kind, item`` of scanned chunks; word corrections; resolved breaks; heads; what was found in each chunk)."""
    rows = chunks.where("content is not null and trim(content) != ''")
    heads = cut(_heads(rows))
    f = cut(_findings(rows, heads))
    said = f.select("chunk_key", F.inline("words"))
    counts = cut(said.groupBy("w").agg(F.sum("n").alias("n")))
    plain = counts.where(F.col("w").rlike("^[a-z]{4,}$") & (F.col("n") >= 5))
    # broken words: joined, or with their hyphen
    br = f.select("chunk_key", F.inline("breaks"))
    pairs = cut(_resolved(br, counts))
    scans = f.where("scan").select("chunk_key").union(br.join(pairs.where("n_joined > n_hyphened").select("joined", "hyphened"), ["joined", "hyphened"], "left_semi").select("chunk_key")).distinct()
    # from here on only scanned chunks matter: they are picked out once, before words become rows
    f = cut(f.join(scans, "chunk_key", "left_semi"))
    said, br = f.select("chunk_key", F.inline("words")), f.select("chunk_key", F.inline("breaks"))
    read = said.groupBy("w").agg(F.sum("n").alias("n_scan"))
    few = cut(counts.where((F.col("n") <= 2) & F.col("w").rlike("^[a-z0-9†ﬁﬂ@]{5,}$") & F.col("w").rlike("[a-z]")).join(read, "w", "left").select("w", F.col("n_scan").isNotNull().alias("scan")))
    learned = _learned(few, counts.where(F.col("w").rlike("^[a-z]{5,}$") & (F.col("n") >= 20)).select("w"))
    editor = train_editor_on(plain.select("w"), confusions=Confusions([p for p in learned if p not in KNOWN.pairs]))
    suspects = read.select("w").where(F.col("w").rlike("[a-z]")).union(pairs.where("n_joined = 0 and n_hyphened = 0").select("word")).distinct().where("length(w) >= 3")
    fix = cut(_corrections(suspects, counts, editor))
    joined_fix = fix.select(F.col("w").alias("word"), "right")
    resolved = cut(pairs.join(joined_fix, "word", "left").select("joined", "hyphened", "word", F.coalesce("right", "word").alias("item"), F.col("right").isNotNull().alias("misread")))
    at = br.join(resolved, ["joined", "hyphened"])
    out = f.select("chunk_key", F.inline("items"))
    out = out.unionByName(at.select("chunk_key", F.lit("hyphen").alias("kind"), "item"))
    out = out.unionByName(at.where("misread").select("chunk_key", F.lit("misread").alias("kind"), "item"))
    out = out.unionByName(said.join(fix, "w").select("chunk_key", F.lit("misread").alias("kind"), F.col("right").alias("item")))
    return out.distinct(), fix, resolved, heads, f


def repair(chunks: DataFrame) -> DataFrame:
    """``chunk_key, text``: continuous paragraphs; furniture gone, words joined and corrected."""
    rows = chunks.where("content is not null and trim(content) != ''")
    items, fix, resolved, heads, f = findings(chunks)
    scanned = items.select("chunk_key").distinct()
    used = f.select("chunk_key", F.inline("words")).join(fix, "w").groupBy("chunk_key").agg(F.map_from_entries(F.collect_set(F.struct("w", "right"))).alias("fix"))
    br = f.select("chunk_key", F.inline("breaks")).select("chunk_key", "joined", "hyphened").distinct().join(resolved, ["joined", "hyphened"])
    whole = br.groupBy("chunk_key", "joined").agg(F.min("item").alias("item")).groupBy("chunk_key").agg(F.map_from_entries(F.collect_list(F.struct("joined", "item"))).alias("whole"))
    src = rows.select(F.col("chunk_key").cast("bigint").alias("chunk_key"), "content").join(scanned.withColumn("scanned", F.lit(True)), "chunk_key", "left")
    src = src.join(heads, "chunk_key", "left").join(used, "chunk_key", "left").join(whole, "chunk_key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = (b.column(n).to_pylist() for n in ("content", "heads", "fix", "whole", "scanned"))
            text = [repaired(t, set(h or ()), dict(x or ()), dict(w or ())) if s else t for t, h, x, w, s in zip(*cols)]
            yield pa.RecordBatch.from_arrays([b.column("chunk_key"), pa.array(text, pa.string())], ["chunk_key", "text"])

    return src.mapInArrow(run, "chunk_key bigint, text string")


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def repaired(text: str, heads: set[str], fix: dict[str, str], whole: dict[str, str]) -> str:
    lines, kind = furniture(text, heads)
    split = {i: (j, left, right, mark) for i, j, left, right, mark in breaks(lines, kind)}
    correct = lambda s: TOKEN.sub(lambda m: _cased(m.group(), fix[m.group().lower()]) if m.group().lower() in fix else m.group(), s)
    out, carry, paragraph = [], None, []
    after_furniture = False
    for i, (x, _) in enumerate(lines):
        if kind[i] in ("header", "page_no"):
            after_furniture = True
            continue
        if kind[i] == "blank":
            nxt = next((k for k in kind[i + 1 :] if k != "blank"), "")
            if paragraph and carry is None and not after_furniture and nxt not in ("header", "page_no"):
                out.append(" ".join(paragraph))
                paragraph = []
            continue
        after_furniture = False
        s = x.strip()
        if carry is not None:
            word, length = carry
            s = word + correct(s[length:]) if i not in split else word + s[length:]
            carry = None
        elif i not in split:
            s = correct(s)
        if i in split:
            _, left, right, _ = split[i]
            joined = whole.get((left + right).lower(), (left + right).lower())
            at = s.rstrip().rfind(left)
            s, carry = correct(s[:at]) if at >= 0 else s, (_cased(left, joined), len(right))
        if s.strip():
            paragraph.append(s.strip())
    if carry is not None:
        paragraph.append(carry[0])
    if paragraph:
        out.append(" ".join(paragraph))
    return "\n\n".join(out)
