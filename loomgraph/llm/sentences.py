"""Sentence boundaries across languages and scripts, learned without labels.

First pass, over all documents: for each language, how often each word occurs with and
without a period, what follows the period, in which case words occur, and which words
open paragraphs.  From these, log-likelihood ratios find abbreviations (a word and its
period as a collocation), the rate at which an abbreviation also ends a sentence, words
that are capitalised only as openers, and frequent capitalised words that never open a
sentence.  Second pass: each mark of a document is classified with these statistics.

Scripts are told by their characters; languages in Latin script by function words, as
the stored language is often missing or wrong.  Both passes tell them by paragraph, from
all of its text and the document's usual language.  A line of its own of at most 90
characters (numbered: 120) without a final mark is a heading; that is what a heading is
here, not a limit on what is read.

Defined results: null and blank texts give no sentences; a heading or list line is one
unit; a text without any mark is one sentence a paragraph; repeated documents each come out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Function words that tell languages in Latin script apart; none stands in two of them (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to was with is for by that from which it".split(),
    "de": "der die das und den von mit ist nicht hat für wurde dem".split(),
    "fr": "le les et est une dans du pour sur au aux été".split(),
    "es": "el los las del y por una con para se fue ha al".split(),
}
_WHICH = {w: k for k, ws in FUNCTION_WORDS.items() for w in ws}
#: Least score of an abbreviation, and least share of other evidence (see ``learn``).
ABBREVIATION, OTHER_USE = 0.3, 0.1
#: A word that only stands before capitals (a title) must be seen so often.
FEW = 5
#: An abbreviation may end sentences if such a share of its capitalised followers are openers.
ENDS = 0.12
#: Words count as openers or names if they make such a share of all words of their language, whatever the corpus' size;
#: so at most a million words of a language can, and in natural text some ten thousand do.
LEAST_SHARE = 1e-6
#: Counters of a task are handed on when they hold so many entries.
HELD = 1_000_000

SCRIPTS = (("th", re.compile("[฀-๿]")), ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]")), ("ru", re.compile("[Ѐ-ӿ]")), ("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[㐀-鿿]")))
OTHER_SCRIPT = re.compile("[฀-๿ऀ-ॿ؀-ۿЀ-ӿ぀-ヿ㐀-鿿]")
_OF = dict(SCRIPTS)
LATIN = re.compile("[A-Za-z]{3}")
WORD = re.compile(r"[^\W\d_]+(?:[.’'-][^\W\d_]+)*")
OPENING = "“«„「『‹\"([¿¡'*"
CLOSE = "”»“」』›"
OPENER = re.compile(r"(?:\n\s*\n|[!?]\s+|\A\s*)(?:[\"“«„(\[¿¡]\s?)*([^\W\d_]+)")


def script(text: str) -> str | None:
    """The language whose script a quarter of the characters have, if any."""
    # a quarter of such characters, of two bytes or more, makes the bytes a quarter more
    if len(text.encode("utf-8", "surrogatepass")) * 4 >= len(text) * 5 and len(OTHER_SCRIPT.findall(text)) * 4 >= len(text):
        for name, pattern in SCRIPTS:
            if len(pattern.findall(text)) * 4 >= len(text):
                return name
    return None


def votes(text: str) -> dict[str, int]:
    """How many function words of each language in Latin script stand in the text."""
    out: dict[str, int] = {}
    for k in map(_WHICH.get, text.lower().split()):
        if k is not None:
            out[k] = out.get(k, 0) + 1
    return out


def language(text: str, otherwise: str | None = "en") -> str | None:
    """By the whole text; ``otherwise`` if nothing tells."""
    if (name := script(text)) is not None:
        return name
    v = votes(text)
    return max(v, key=v.__getitem__) if v else otherwise


def passages(text: str) -> list[tuple[int, int, bool, str]]:
    """(start, end, whole, language) of each block.

    A block has the language of most of the document unless it says otherwise: by its script,
    or by more than twice as many function words of another language.
    """
    found, size = [], {}
    for lo, hi, whole in blocks(text):
        part = text[lo:hi]
        own = script(part)
        v = votes(part) if own is None else {}
        told = own or (max(v, key=v.__getitem__) if v else None)
        if told is not None:
            size[told] = size.get(told, 0) + hi - lo
        found.append((lo, hi, whole, own, v))
    usual = max(size, key=size.__getitem__) if size else language(text)
    out = []
    for lo, hi, whole, own, v in found:
        lang = own or usual
        if own is None and v:
            most = max(v, key=v.__getitem__)
            if v[most] > 2 * v.get(usual, 0) or (usual not in FUNCTION_WORDS and not _OF[usual].search(text, lo, hi)):
                lang = most
        elif own is None and usual not in FUNCTION_WORDS and not _OF[usual].search(text, lo, hi) and LATIN.search(text, lo, hi):
            lang = "en"
        out.append((lo, hi, whole, lang))
    return out


def kind(word: str) -> str:
    """The type under which statistics of a word before a period are kept."""
    if word[:1].isdigit():
        return "#" if len(word) <= 2 else "##"
    return word.lower()


def looks_upper(word: str) -> bool:
    return word != word.lower()


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``lang, what, a, b, n``: w word | f kind, class of what follows | u kind, capitalised follower | o opener."""

    def told(counts: dict[str, tuple[Counter, Counter, Counter]]) -> pa.RecordBatch:
        rows: Counter = Counter()
        for lang, (words, follow, openers) in counts.items():
            for token, n in words.items():
                for w in WORD.findall(token):
                    rows[lang, "w", w, ""] += n
            for (token, right), n in follow.items():
                mark = token[-1] != "."
                left, right = token[: -2 if mark else -1].lstrip(OPENING), right.strip(OPENING)
                if not left or left[-1] in CLOSE + ").!?…":
                    continue
                k = kind(left)
                if mark:
                    c = "comma"
                elif right[:1].isdigit():
                    c = "number"
                else:
                    c = "upper" if looks_upper(right) else "lower"
                rows[lang, "f", k, c] += n
                if c == "upper":
                    rows[lang, "u", k, (WORD.match(right) or [right])[0]] += n
            for w, n in openers.items():
                rows[lang, "o", w, ""] += n
        keys = list(rows)
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(4)), pa.array([rows[k] for k in keys], pa.int64())], ["lang", "what", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple[Counter, Counter, Counter]] = {}
        for b in batches:
            if sum(len(c) for of in counts.values() for c in of) >= HELD:
                yield told(counts)
                counts = {}
            for t in b.column("text").to_pylist():
                if not t:
                    continue
                runs: list[tuple[str, int]] = []  # stretches of one language
                for lo, _, _, lang in passages(t):
                    if not runs or runs[-1][0] != lang:
                        runs.append((lang, lo))
                for (lang, lo), (_, hi) in zip(runs, [*runs[1:], ("", len(t))]):
                    part = t[lo:hi]
                    words, follow, openers = counts.setdefault(lang, (Counter(), Counter(), Counter()))
                    tokens = part.split()
                    words.update(tokens)
                    if "." in part:
                        follow.update((a, b) for a, b in zip(tokens, tokens[1:]) if a[-1] == "." or a[-1] in ",;:" and a[-2:-1] == ".")
                    openers.update(OPENER.findall(part))
        yield told(counts)

    got = docs.select(F.col(text).alias("text")).mapInArrow(run, "lang string, what string, a string, b string, n bigint")
    return got.groupBy("lang", "what", "a", "b").agg(F.sum("n").alias("n"))


class Model:
    """abbreviations: (lang, kind) -> share of openers among capitalised followers; common, never: (lang, word)."""

    def __init__(self, abbreviations: dict, common: set, never: set) -> None:
        self.abbreviations, self.common, self.never = abbreviations, common, never


def learn(docs: DataFrame, text: str = "text") -> Model:
    from ..runtime import cut

    s = cut(statistics(docs, text))
    words = s.where("what = 'w'").select("lang", F.col("a").alias("w"), "n")
    low = words.where(F.col("w") == F.lower("w")).select("lang", F.col("w").alias("lw"), F.col("n").alias("n_low"))
    cap = words.where(F.col("w") != F.lower("w"))
    both = words.groupBy("lang", F.lower("w").alias("k")).agg(F.sum("n").alias("all"))
    total = words.groupBy("lang").agg(F.sum("n").alias("tokens"))
    # words capitalised as openers only: their small form is usual
    upper = s.where("what = 'u'").select("lang", F.col("a").alias("k"), F.col("b").alias("w"), "n")
    after = upper.select("lang", "w").union(s.where("what = 'o'").select("lang", F.col("a"))).distinct().withColumn("lw", F.lower("w"))
    common = after.join(low, ["lang", "lw"]).join(cap, ["lang", "w"]).join(total, "lang").where((F.col("n_low") >= F.greatest(F.lit(3), F.col("tokens") * LEAST_SHARE)) & (F.col("n_low") * 2 >= F.col("n"))).select("lang", "w")
    opens = s.where("what = 'o'").select("lang", F.col("a").alias("w"), F.col("n").alias("n_open"))
    never = cap.join(total, "lang").where(F.col("n") >= F.greatest(F.lit(50), F.col("tokens") * LEAST_SHARE)).join(opens, ["lang", "w"], "left").where(F.coalesce("n_open", F.lit(0)) * 200 < F.col("n")).select("lang", "w")
    follow = s.where("what = 'f'").groupBy("lang", F.col("a").alias("k")).pivot("b", ["comma", "number", "lower", "upper"]).sum("n").na.fill(0)
    openers = upper.join(common, ["lang", "w"], "left_semi").groupBy("lang", "k").agg(F.sum("n").alias("openers"))
    f = follow.join(openers, ["lang", "k"], "left").join(both, ["lang", "k"], "left").join(total, "lang").na.fill(0, ["openers", "all"])
    f = f.withColumn("dots", F.col("comma") + F.col("number") + F.col("lower") + F.col("upper"))
    periods = follow.groupBy("lang").agg(F.sum(F.col("comma") + F.col("number") + F.col("lower") + F.col("upper")).alias("periods"))
    f = f.join(periods, "lang")
    n = F.greatest("all", "dots").cast("double")
    c = F.col("dots").cast("double")
    p1 = F.least(F.lit(0.5), F.col("periods") / F.greatest("tokens", F.lit(1)))
    like = lambda p: c * F.log(p) + (n - c) * F.log(1 - p)
    ratio = -2 * (like(F.greatest(p1, F.lit(1e-9))) - like(F.lit(0.99)))
    size = F.length(F.regexp_replace("k", r"\.", ""))
    score = ratio * F.exp(-size) * (1 + F.length("k") - size) * F.pow(size.cast("double"), F.greatest(-(n - c), F.lit(-60.0)) / F.greatest(F.lit(1.0), n / 40))
    other = F.col("comma") + F.col("number") + F.col("lower")
    # an abbreviation stands before periods; rarer ones than a share of these prove nothing
    f = f.where(c >= F.col("periods") * LEAST_SHARE)
    f = f.where((F.col("k").isin("#", "##")) | ((score >= ABBREVIATION) & ((other >= OTHER_USE * c) | ((F.col("openers") < OTHER_USE * c) & (c >= FEW)))))
    abbreviations = {(r[0], r[1]): r[2] for r in f.select("lang", "k", F.col("openers") / F.greatest(F.lit(1.0), F.col("upper"))).collect()}
    return Model(abbreviations, {(r[0], r[1]) for r in common.collect()}, {(r[0], r[1]) for r in never.collect()})


PARTNER = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", '"': '"'}
MARK = re.compile("([.!?…。！？।॥؟۔]+)|([“”«»„「」『』\"])")
TAIL = re.compile("[)\\]”»’'」』]*")
NEXT = re.compile(r"(\s*)((?:[\"“«„(\[¿¡「『‹]\s?)*)([^\s]*)")
OPENS = re.compile(r"[\"“”„«»「」(\[¿¡]")
BLANK = re.compile(r"\n(?:[ \t\r\f\v]*\n)+")
BULLET = re.compile(r"\s*[-*•+·]\s+\S")
NUMBERED = re.compile(r"\s*(\d{1,3}|[a-zA-Z])[.)]\s+\S")
THAI_GAP = re.compile("(?<=[฀-๿])[ \t ]+(?=[฀-๿])")
FINAL = re.compile("[.!?…。！？।॥؟۔;:]")


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): paragraphs, and heading and list lines, which are whole units."""
    at_block = 0
    for gap in [*BLANK.finditer(text), None]:
        lines, at = [], at_block
        block = text[at_block : gap.start() if gap else len(text)]
        at_block = gap.end() if gap else len(text)
        for line in block.split("\n"):
            if line.strip():
                lines.append((at, at + len(line), line))
            at += len(line) + 1
        if not lines:
            continue
        numbered = [NUMBERED.match(x[2]) for x in lines]
        is_list = len(lines) > 1 and all(n or BULLET.match(x[2]) for n, x in zip(numbered, lines))
        start = None
        for k, (a, b, line) in enumerate(lines):
            body = line.strip()
            alone = len(lines) == 1 and len(body) <= 90 and not FINAL.search(body[-3:]) and not THAI_GAP.search(body)
            if body.startswith("#") or is_list or BULLET.match(line) or alone or (len(lines) == 1 and numbered[0] and len(body) <= 120):
                if start is not None:
                    yield start, lines[k - 1][1], False
                    start = None
                yield a, b, True
            elif start is None:
                start = a
        if start is not None:
            yield start, lines[-1][1], False


def ends_here(model: Model, lang: str, left: str, mark: str, gap: str, opener: str, word: str, caseless: bool) -> bool:
    """Whether a sentence ends at ``mark`` after ``left``, when ``word`` follows."""
    first = word[:1]
    sure = "¿" in opener or "¡" in opener
    if "。" in mark or "！" in mark or "？" in mark or "।" in mark or "॥" in mark:
        return True
    if first and first in ",;:)]—–-%/»”":
        return False
    plain = (WORD.match(word) or [word])[0]
    up = looks_upper(plain)
    low = first.islower() and not up
    if not gap and not opener:
        if mark == "." or mark[0] in "!?؟…":
            # a missing blank: "weeks.The"
            if mark == ".":
                tail = left[-2:]
                shaped = len(left) > 1 and (tail.isalpha() and tail.islower() or tail[-1:].isdigit()) and plain[1:2].islower() and "/" not in left
                if not shaped or model.abbreviations.get((lang, kind(left)), 1.0) < ENDS or (lang, plain) in model.never:
                    return False
            return first.isupper()
        return False
    if mark[0] == "…" or mark.startswith(".."):
        return (first.isupper() or sure) and bool(gap)
    if mark != "." and "." not in mark:
        return not low or caseless
    # a single period
    k = kind(left)
    one = len(left) == 1 and left.isalpha() or re.fullmatch(r"(?:[^\W\d_]\.-?)+[^\W\d_]", left) is not None
    rate = model.abbreviations.get((lang, k))
    if rate is None and one:
        rate = 0.0
    if rate is None and "." in left and left.replace(".", "").isalpha() and len(left) <= 5:
        rate = 0.0
    number = left[-1:].isdigit()
    if rate is None or (number and k == "##" and lang != "de"):
        if low:
            return caseless and rate is None
        return True
    if sure:
        return True
    if number and (k == "##" or lang != "de"):
        return not low
    if low or first.isdigit():
        return False
    initial = len(plain) == 1 and word[1:2] == "."
    if (lang, plain) in model.common and not initial:
        return not (one and left.isupper()) or rate >= ENDS
    return rate >= ENDS and (lang, plain) not in model.never and not number


def sentences(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence of the text, without white space at the ends."""
    out: list[tuple[int, int]] = []
    lowered = text == text.lower()

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))

    for lo, hi, whole, lang in passages(text):
        if whole:
            add(lo, hi)
            continue
        caseless = lowered and lang in FUNCTION_WORDS or lang in ("hi", "ar", "th", "zh", "ja")
        start, opened, opened_at = lo, "", 0
        skip = lo
        for m in MARK.finditer(text, lo, hi):
            i, j = m.span()
            if i < skip:
                continue
            quote = m.group(2)
            if quote:
                closes = opened and (quote == '"' if opened == '"' else quote in CLOSE and not (quote == "“" and opened != "„"))
                if not closes:
                    # a mark that is never closed in its paragraph quotes nothing
                    if not opened and any(text.find(c, j, hi) >= 0 for c in PARTNER.get(quote, "")):
                        opened, opened_at = quote, i
                    continue
                begins = not text[start:opened_at].strip()
                led = text[start:opened_at].rstrip()[-1:] in (":", "：")
                opened = ""
                inner = text[i - 1] if text[i - 1] != " " and text[i - 1] != "\xa0" else text[i - 2]
                if inner not in ".!?…。！？।؟":
                    continue
                tail = TAIL.match(text, j, hi)
                j = tail.end()
                nxt = NEXT.match(text, j, hi)
                gap, opener, word = nxt.groups()
                if not word and not opener:
                    continue
                if MARK.match(text, j, hi) and not MARK.match(text, j, hi).group(2):
                    continue
                first = word[:1]
                plain = (WORD.match(word) or [word])[0]
                if first and first in ",;:—–-":
                    continue
                if caseless:
                    stop = led
                else:
                    stop = not (first.islower() and not looks_upper(plain))
                    if stop and begins and inner in "!?" and (lang, plain) not in model.common and first.isalpha() and not looks_upper(plain):
                        stop = False
                if stop:
                    add(start, j)
                    start = skip = j
                continue
            if opened:
                continue
            mark = m.group(1)
            c = text[j : j + 1]
            if mark == "." and (c.islower() or c.isdigit() or c in ",;:" and c):
                continue
            end = j if c.isspace() or c.isupper() else TAIL.match(text, j, hi).end()
            gap, opener, word = NEXT.match(text, end, hi).groups()
            if not word and not opener:
                continue
            at = i
            while at > start and not text[at - 1].isspace():
                at -= 1
            left = text[at:i]
            if not left.isalnum():
                left = OPENS.split(left)[-1]
            closed = end > j
            if closed and mark[-1] in ".!?؟…" and word[:1] and not (word[:1].islower() and not looks_upper((WORD.match(word) or [word])[0])) and (gap or opener) and word[:1] not in ",;:—–-":
                # (A whole sentence in brackets.) ends with its bracket; (approx.) does not
                first = text[start:i].lstrip()[:1]
                if first in "([" or (lang, kind(left)) not in model.abbreviations:
                    add(start, end)
                    start = skip = end
                continue
            if closed:
                continue
            if ends_here(model, lang, left, mark, gap, opener, word, caseless):
                add(start, end)
                start = skip = end
        if lang == "th":
            rest = [(start, hi)]
            # blanks between Thai letters, in the stretches that marks left together
            spans = [(a, b) for a, b in out if a >= lo]
            del out[len(out) - len(spans) :]
            for a, b in [*spans, *rest]:
                at = a
                for g in THAI_GAP.finditer(text, a, b):
                    add(at, g.start())
                    at = g.end()
                add(at, b)
        else:
            add(start, hi)
    return out


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, sent_start, sent_end`` for every sentence of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            row, start, end = [], [], []
            for r, t in enumerate(b.column("text").to_pylist()):
                for s, e in sentences(t, model) if t else ():
                    row.append(r)
                    start.append(s)
                    end.append(e)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["key", "sent_start", "sent_end"])

    src = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("text is not null")
    return src.mapInArrow(run, "key bigint, sent_start bigint, sent_end bigint").withColumnRenamed("key", key)
