"""Scalar text functions as Column expressions: they stay in generated code and are pushed with the plan.

Nulls give null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space of the word and sentence rules (ASCII, so that engines agree).
SPACE = "[ \\t\\n\\r\\f]+"


def lit_or_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """Words of a text; null and blank texts have none."""
    t = F.regexp_replace(F.coalesce(lit_or_col(c), F.lit("")), f"^{SPACE}|{SPACE}$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def index_key(c: Column | str) -> Column:
    """Key under which an entity is stored: lower case, not trimmed."""
    return F.lower(lit_or_col(c))


def query_key(c: Column | str) -> Column:
    """Key of a query: lower case and trimmed (the two sides differ on purpose)."""
    return F.trim(F.lower(lit_or_col(c)))


def shorten(c: Column | str, n: int, ellipsis: str = "...") -> Column:
    t = lit_or_col(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(ellipsis))).otherwise(t)


def cost_estimate(size: Column, chunk_size: int = 1536) -> Column:
    """Struct of characters, tokens, chunks, model calls, embeddings and megabytes for a text of ``size`` bytes."""
    tokens = F.floor(size / 4)
    chunks = F.greatest(F.lit(1), F.floor(tokens / chunk_size))
    return F.struct(size.alias("chars"), tokens.alias("tokens"), chunks.alias("chunks"), chunks.alias("llm_calls"), (chunks * 3).alias("embedding_calls"), (size / F.lit(1048576.0)).alias("megabytes"))


def relation_parse(c: Column | str) -> Column:
    """``a, rel, b`` as struct(source, relation, target); inner commas stay in the relation; null under three parts."""
    p = F.transform(F.split(lit_or_col(c), ","), lambda x: F.trim(x))
    middle = F.array_join(F.slice(p, 2, F.size(p) - 2), ", ")
    return F.when(F.size(p) >= 3, F.struct(F.upper(p[0]).alias("source"), middle.alias("relation"), F.upper(F.element_at(p, -1)).alias("target")))


def _bracketed(c: Column) -> Column:
    """From the first ``[`` to the last ``]``; empty if there is none."""
    return F.regexp_extract(c, r"(?s)\[.*\]", 0)


def json_list_parse(c: Column | str) -> Column:
    """Items of the JSON list inside a reply; else its lines without bullets and quotes. Null gives no items."""
    t = F.coalesce(lit_or_col(c), F.lit(""))
    inner = _bracketed(t)
    parsed = F.from_json(F.when(inner != "", inner), "array<string>")
    items = F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), "^[- ]+", ""), '^"+|"+$', ""))
    return F.when((inner != "") & parsed.isNotNull(), items).otherwise(F.filter(lines, lambda x: x != ""))


def json_triples_parse(c: Column | str) -> Column:
    """Lists of three items inside a reply as structs; anything else gives none."""
    inner = _bracketed(F.coalesce(lit_or_col(c), F.lit("")))
    rows = F.from_json(F.when(inner != "", inner), "array<array<string>>")
    three = F.filter(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.size(r) == 3)
    return F.transform(three, lambda r: F.struct(r[0].alias("source"), r[1].alias("relation"), r[2].alias("target")))


def lenient_json(c: Column | str) -> Column:
    """A JSON value found in a reply: the whole, a fenced block, or the widest bracketed part; ``{}`` otherwise (as variant)."""
    t = F.coalesce(lit_or_col(c), F.lit(""))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    wide = F.regexp_extract(t, r"(?s)[\[{].*[\]}]", 0)
    good = [F.when(x != "", F.try_parse_json(x)) for x in (F.trim(t), F.trim(fenced), wide)]
    return F.coalesce(*good, F.parse_json(F.lit("{}")))


#: Openings that a model puts before a reworded question, in the order of their removal (fixed values).
REWORDED_PREFIXES = ("Reformulated Query:", "Reformulated query:", "Query:", "query:", "Output:", "output:")


def strip_reworded_prefix(c: Column | str) -> Column:
    """The question without such openings, each removed once in order (case counts)."""
    out = F.trim(lit_or_col(c))
    for p in REWORDED_PREFIXES:
        out = F.when(out.startswith(p), F.trim(F.substring(out, F.lit(len(p) + 1), F.length(out)))).otherwise(out)
    return out


def fill_template(template: str, **holes: Column) -> Column:
    """A prompt template with ``{name}`` holes; null values fill as empty text."""
    out = F.lit(template)
    for name, value in holes.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def phrase_pattern(c: Column | str) -> Column:
    """Pattern of a phrase of two or more words, white space free; null for single words."""
    w = words(query_key(c))
    escaped = F.transform(w, lambda x: F.regexp_replace(x, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    return F.when(F.size(w) >= 2, F.concat(F.lit("\\b"), F.array_join(escaped, "\\s+"), F.lit("\\b")))


def confidence(scores: Column) -> Column:
    """Mean of the non-zero scores among the first five, at most 1; 0 without any."""
    top = F.filter(F.slice(scores, 1, 5), lambda x: x.isNotNull() & (x != 0))
    mean = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    return F.when(F.size(top) > 0, F.least(mean, F.lit(1.0))).otherwise(F.lit(0.0))


def success_rate(done: Column, total: Column) -> Column:
    return done / F.greatest(total, F.lit(1)) * 100


def sentence_units(c: Column | str, most: int = 10) -> Column:
    """Rule units: parts between ``[.!?]`` and white space, non-blank, at most ``most``."""
    parts = F.split(F.coalesce(lit_or_col(c), F.lit("")), "[.!?]" + SPACE)
    return F.slice(F.filter(parts, lambda x: F.regexp_replace(x, SPACE, "") != ""), 1, most)


def capitalised(c: Column | str, most: int | None = 35) -> Column:
    """Rule entities: distinct ``[A-Z][a-z]+`` of four letters or more, in order of first place."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(lit_or_col(c), F.lit("")), F.lit("[A-Z][a-z]+"), F.lit(0)), lambda x: F.length(x) >= 4))
    return F.slice(found, 1, most) if most else found


def unified_extraction(c: Column | str) -> Column:
    """A reply ``{"Output": [{semantic_unit, entities, relationships}]}`` as struct(units, entities, triples, success).

    Units that lack a key are left out; entities are upper-cased, trimmed, distinct and sorted;
    relationships of under three parts give none. Without a list ``Output`` nothing is read.
    """
    item = "struct<semantic_unit:string,entities:array<string>,relationships:array<string>>"
    out = F.from_json(lit_or_col(c), f"struct<Output:array<{item}>>")["Output"]
    whole = F.filter(out, lambda u: u["semantic_unit"].isNotNull() & u["entities"].isNotNull() & u["relationships"].isNotNull())
    units = F.transform(whole, lambda u: u["semantic_unit"])
    entities = F.array_sort(F.array_distinct(F.flatten(F.transform(whole, lambda u: F.transform(F.array_compact(u["entities"]), lambda e: F.trim(F.upper(e)))))))
    triples = F.array_compact(F.flatten(F.transform(whole, lambda u: F.transform(u["relationships"], relation_parse))))
    none = F.array().cast("array<string>")
    ok = out.isNotNull() & (F.size(out) > 0)
    no_triples = F.array().cast("array<struct<source:string,relation:string,target:string>>")
    return F.struct(F.when(ok, units).otherwise(none).alias("units"), F.when(ok, entities).otherwise(none).alias("entities"), F.when(ok, triples).otherwise(no_triples).alias("triples"), ok.alias("success"))


def repaired_triple(parts: Column, reply: Column | None = None) -> Column:
    """A malformed triple (list of strings) as struct(source, relation, target).

    From a model's JSON reply with ``source, relationship, target`` where one is given, and
    by rule otherwise: blank parts are dropped, the ends are upper-cased, what is between
    them is the relation. Fewer than three parts leave empty strings.
    """
    kept = F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    n = F.size(kept)
    rule = F.struct(F.when(n >= 1, F.upper(F.get(kept, F.lit(0)))).otherwise("").alias("source"), F.when(n >= 3, F.array_join(F.slice(kept, F.lit(2), F.greatest(n - 2, F.lit(0))), " ")).otherwise("").alias("relation"), F.when(n >= 2, F.upper(F.element_at(kept, -1))).otherwise("").alias("target"))
    if reply is None:
        return F.when(n >= 1, rule).otherwise(F.struct(F.lit("").alias("source"), F.lit("").alias("relation"), F.lit("").alias("target")))
    j = F.from_json(reply, "struct<source:string,relationship:string,target:string>")
    said = F.struct(F.upper(F.coalesce(j["source"], F.lit(""))).alias("source"), F.coalesce(j["relationship"], F.lit("")).alias("relation"), F.upper(F.coalesce(j["target"], F.lit(""))).alias("target"))
    return F.when(j["source"].isNotNull() | j["target"].isNotNull(), said).otherwise(repaired_triple(parts))


def usage(query: Column, reply: Column) -> Column:
    """Words of question and reply as prompt, completion and total tokens."""
    p, c = word_count(query), word_count(reply)
    return F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens"), (p + c).alias("total_tokens"))
