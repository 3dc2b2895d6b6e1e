"""Further named queries: replies and records, upkeep of graph and index, retrieval parts, augmentation.

Tables stand for the engine's state as in ``catalogue``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import augment as A, extract as X, graph as G, maintenance as M, ppr, retrieval as R, vector_search as VS, viz
from ..runtime import cut, table
from . import catalogue as K
from .catalogue import _BOTH, _COS, _EDGES, _L2SQ, _NODES, _OK, QUESTION, _graph, _rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.canonical_nodes(table(spark, d, "graph_nodes"))


# ---------------------------------------------------------------- replies and records


@query("SELECT seq, json_extract_string(metadata, '$.org_id') AS org_id FROM graph_nodes WHERE json_valid(metadata)")
def lenient_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON found in three kinds of reply: bare, in a fence, amid words."""
    n = table(spark, d, "graph_nodes").where("metadata is not null")
    reply = F.when(F.col("seq") % 3 == 0, F.col("metadata")).when(F.col("seq") % 3 == 1, F.concat(F.lit("Here it is:\n```json\n"), "metadata", F.lit("\n```"))).otherwise(F.concat(F.lit("It reads "), "metadata", F.lit(" as asked")))
    return n.select("seq", F.try_variant_get(T.lenient_json(reply), "$.org_id", "string").alias("org_id"))


_R = "(SELECT seq, json_extract_string(metadata,'$.entity1') AS a, json_extract_string(metadata,'$.relation') AS r, json_extract_string(metadata,'$.entity2') AS b FROM graph_nodes WHERE upper(trim(type)) = 'R')"


def _relations(spark: SparkSession, d: str) -> DataFrame:
    m = lambda k, to: F.get_json_object("metadata", f"$.{k}").alias(to)
    return table(spark, d, "graph_nodes").where(F.upper(F.trim("type")) == "R").select("seq", m("entity1", "a"), m("relation", "r"), m("entity2", "b")).where("a is not null and r is not null and b is not null")


@query(f"SELECT seq, a AS source, r AS relation, b AS target FROM {_R} WHERE a IS NOT NULL AND r IS NOT NULL AND b IS NOT NULL")
def json_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples out of replies that also hold a pair, which is no triple."""
    r = _relations(spark, d)
    reply = F.concat(F.lit("Found: "), F.to_json(F.array(F.array("a", "r", "b"), F.array("a", "b"))), F.lit("."))
    return r.select("seq", F.inline(T.json_triples_parse(reply)))


@query(f"SELECT seq, list_sort(list_distinct([trim(upper(a)), trim(upper(b))])) AS entities, 1 AS units, CASE WHEN len(string_split(r, ',')) >= 1 THEN upper(trim(a)) END AS source FROM {_R} WHERE a IS NOT NULL AND r IS NOT NULL AND b IS NOT NULL AND a NOT LIKE '%,%' AND b NOT LIKE '%,%'")
def unified_extraction(spark: SparkSession, d: str) -> DataFrame:
    r = _relations(spark, d).where("a not like '%,%' and b not like '%,%'")
    unit = F.struct(F.lit("a unit").alias("semantic_unit"), F.array("a", "b").alias("entities"), F.array(F.concat_ws(",", "a", "r", "b"), F.lit("too, short")).alias("relationships"))
    broken = F.lit('{"semantic_unit": "no lists"}')
    reply = F.concat(F.lit('{"Output": ['), F.to_json(unit), F.lit(", "), broken, F.lit("]}"))
    x = r.select("seq", T.unified_extraction(reply).alias("x"))
    return x.select("seq", "x.entities", F.size("x.units").alias("units"), F.col("x.triples")[0]["source"].alias("source"))


@query(f"SELECT seq, upper(trim(a)) AS source, trim(r) AS relation, upper(trim(b)) AS target FROM {_R} WHERE trim(a) <> '' AND trim(r) <> '' AND trim(b) <> ''")
def triple_repair(spark: SparkSession, d: str) -> DataFrame:
    """Triples with blank parts between, put right by rule."""
    r = _relations(spark, d).where("trim(a) != '' and trim(r) != '' and trim(b) != ''")
    return r.select("seq", T.repaired_triple(F.array(F.lit(" "), "a", "r", F.lit(""), "b")).alias("t")).select("seq", "t.*")


@query("SELECT item_id, trim(text) AS question FROM eval_items WHERE text IS NOT NULL AND NOT regexp_matches(trim(text), '^(Query|query|Output|output|Reformulated)')")
def reworded_question(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_items").where("text is not null").where(~F.trim("text").rlike("^(Query|query|Output|output|Reformulated)"))
    lead = F.when(F.col("item_id") % 3 == 0, "Reformulated Query: ").when(F.col("item_id") % 3 == 1, " Query:  Output: ").otherwise("")
    return q.select("item_id", T.strip_reworded_prefix(F.concat(lead, F.trim("text"))).alias("question"))


@query("SELECT seq, 'Describe ' || coalesce(content, '') || ' for ' || coalesce(json_extract_string(metadata, '$.org_id'), '') || '.' AS prompt FROM graph_nodes WHERE upper(trim(type)) = 'N'")
def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "graph_nodes").where(F.upper(F.trim("type")) == "N")
    return n.select("seq", T.fill_template("Describe {name} for {org}.", name=F.col("content"), org=F.get_json_object("metadata", "$.org_id")).alias("prompt"))


@query("SELECT id, CASE WHEN length(content) > 100 THEN content[1:100] || '...' ELSE content END AS short, content[1:500] AS head FROM noderag_embeddings")
def shortened(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "noderag_embeddings")
    return e.select("id", T.shorten("content", 100).alias("short"), T.shorten("content", 500, "").alias("head"))


_W = "len(list_filter(string_split_regex(regexp_replace(coalesce({0}, ''), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"


@query(f"SELECT doc_id, {_W.format('title')}::INT AS prompt_tokens, {_W.format('text')}::INT AS completion_tokens, ({_W.format('title')} + {_W.format('text')})::INT AS total_tokens FROM documents")
def usage_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.usage(F.col("title"), F.col("text")).alias("u")).select("doc_id", "u.*")


@query("SELECT chunk_key, coalesce(TRY_CAST(json_extract_string(metadata, '$.page') AS INT), 0) AS page, length(content)::INT AS n, CASE WHEN chunk_key % 3 = 2 THEN '' ELSE content END AS t FROM document_chunks WHERE content IS NOT NULL AND content <> '' AND regexp_replace(content, '[ \\t\\n\\r\\f]+', '', 'g') <> '' AND chunk_key % 3 <> 2")
def json_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks handed over as JSON under any of the names that are known for the content."""
    from ..sources.records import chunks_from_json

    c = table(spark, d, "document_chunks").where("content is not null")
    page = F.create_map(F.lit("page"), F.coalesce(F.get_json_object("metadata", "$.page"), F.lit("0")), F.lit("key"), F.col("chunk_key").cast("string"))
    name = lambda k, n: F.when(F.col("chunk_key") % 3 == k, F.col("content")).otherwise(F.lit(None)).alias(n)
    item = F.struct(name(0, "content"), name(1, "chunk_text"), page.alias("metadata"))
    lines = c.select(F.to_json(F.struct(F.lit("o").alias("org_id"), "file_id", F.lit("u").alias("user_id"), F.array(item).alias("chunks"))).alias("value"))
    out = chunks_from_json(lines)
    return out.select(F.col("metadata")["key"].cast("bigint").alias("chunk_key"), F.col("metadata")["page"].cast("int").alias("page"), F.col("end_char").alias("n"), F.col("content").alias("t"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN title WHEN doc_id % 3 = 1 THEN title ELSE title || chr(10) || chr(10) || 'second' END AS reply FROM documents WHERE title IS NOT NULL")
def parsed_reply(spark: SparkSession, d: str) -> DataFrame:
    """Text out of a parser's replies: markdown, else text, else the items of a list."""
    from ..sources.records import parse_reply

    t = table(spark, d, "documents").where("title is not null")
    one = F.to_json(F.struct(F.col("title").alias("markdown"), F.lit("x").alias("text")))
    two = F.to_json(F.struct(F.col("title").alias("text")))
    many = F.to_json(F.array(F.struct(F.col("title").alias("markdown")), F.struct(F.lit("second").alias("markdown"))))
    raw = F.when(F.col("doc_id") % 3 == 0, one).when(F.col("doc_id") % 3 == 1, two).otherwise(many)
    return t.select("doc_id", parse_reply(raw).alias("reply"))


@query("SELECT item_id, i::INT AS turn, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN i = 0 THEN text ELSE 'noted' END AS content FROM eval_items, (VALUES (0), (2)) v(i) WHERE text IS NOT NULL")
def conversation_json(spark: SparkSession, d: str) -> DataFrame:
    """The other form of a history: a JSON list, in which other roles are dropped."""
    from ..sources.records import parse_conversations

    q = table(spark, d, "eval_items").where("text is not null")
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    raw = q.select(F.col("item_id").cast("string").alias("conv"), F.to_json(F.array(turn("User", F.col("text")), turn("system", F.lit("dropped")), turn("assistant", F.lit("noted")))).alias("history"))
    m = parse_conversations(raw, "conv", "history")
    return m.select(F.col("conv").cast("bigint").alias("item_id"), F.col("turn").cast("int").alias("turn"), "role", "content")


@query("SELECT seq, CASE WHEN len(l) > 0 THEN l ELSE [] END AS items FROM (SELECT seq, list_filter(list_transform(file_ids, lambda x: trim(x)), lambda x: x <> '') AS l FROM graph_nodes WHERE file_ids IS NOT NULL AND len(file_ids) > 0)")
def list_from_lines(spark: SparkSession, d: str) -> DataFrame:
    """Items of a reply without a list: its lines without bullets and quotes."""
    n = table(spark, d, "graph_nodes").where("size(file_ids) > 0")
    reply = F.concat(F.lit('- "'), F.array_join("file_ids", '"\n- "'), F.lit('"\n'))
    return n.select("seq", T.json_list_parse(reply).alias("items"))


# ---------------------------------------------------------------- nodes and edges


@query(f"WITH {_NODES} SELECT id, type, content FROM n WHERE id = (SELECT max(id) FROM n)")
def node_by_id(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return G.node_detail(n, table(spark, d, "graph_edges").limit(0), n.agg(F.max("id")).first()[0]).select("id", "type", "content")


@query(f"WITH {_EDGES} SELECT s.id, s.type, list(t.id ORDER BY t.id) AS connected FROM n s JOIN e ON e.source = s.id JOIN n t ON t.id = e.target WHERE s.id = (SELECT min(source) FROM e) GROUP BY s.id, s.type")
def node_detail(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    got = G.node_detail(n, e, e.agg(F.min("source")).first()[0])
    return got.select("id", "type", F.transform("connected", lambda x: x["id"]).alias("connected"))


@query(f"WITH {_NODES} SELECT id, type, CASE WHEN length(content) > 100 THEN content[1:100] || '...' ELSE content END AS content FROM n WHERE type IN ('T', 'N', 'R', 'A', 'H') QUALIFY row_number() OVER (PARTITION BY type ORDER BY seq, id) <= 3")
def sample_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.sample_nodes(_nodes(spark, d))


@query(f"WITH RECURSIVE {_BOTH}, r(id, c) AS (SELECT id, id FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id) SELECT (SELECT count(*) FROM n) AS total_nodes, (SELECT count(*) FROM e) AS total_edges, (SELECT count(*) FROM n WHERE type = 'N') AS entities, (SELECT count(DISTINCT c) = 1 FROM (SELECT id, min(c) AS c FROM r GROUP BY id)) AS is_connected")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_stats(*_graph(spark, d)).select("total_nodes", "total_edges", F.try_element_at("node_type_counts", F.lit("N")).alias("entities"), "is_connected")


@query(f"WITH {_NODES} SELECT count(*) AS node_count FROM n WHERE list_contains(file_ids, '{K._FILE}')")
def file_node_count(spark: SparkSession, d: str) -> DataFrame:
    return G.file_node_count(_nodes(spark, d), K._FILE)


@query(f"WITH {_NODES} SELECT len(list_distinct(coalesce(file_ids, [])))::INT AS n_files, count(*) AS node_count FROM n GROUP BY 1")
def shared_histogram(spark: SparkSession, d: str) -> DataFrame:
    return G.shared_histogram(_nodes(spark, d))


@query(f"WITH {_EDGES.replace('list(relationship_type ORDER BY relationship_type NULLS FIRST, weight NULLS FIRST, metadata NULLS FIRST)', 'list(relationship_type ORDER BY metadata NULLS FIRST, weight NULLS FIRST, relationship_type NULLS FIRST)')} SELECT source, target, relationship_type FROM e")
def edge_fold_arrival(spark: SparkSession, d: str) -> DataFrame:
    """Folded by another order than that of names, so a name may come back: a; b; a."""
    n = _nodes(spark, d)
    return X.fold_edges(G.induced(n, table(spark, d, "graph_edges")), ["metadata", "weight", "relationship_type"]).select("source", "target", "relationship_type")


@query(f"WITH {_NODES} SELECT id, CASE WHEN seq % 10 = 0 THEN 'changed ' || id ELSE content END AS content, type FROM n")
def update_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    change = n.where("seq % 10 = 0").select("id", F.concat(F.lit("changed "), "id").alias("content")).union(n.limit(0).select("id", "content"))
    return M.update_nodes(n, change).select("id", "content", "type")


@query(f"WITH {_NODES}, old AS (SELECT * FROM n WHERE seq % 2 = 0), new AS (SELECT * FROM n WHERE seq % 2 <> 0), k AS (SELECT DISTINCT lower(content) AS k FROM old WHERE type = 'N' AND content IS NOT NULL), en AS (SELECT count(*) AS a, count(DISTINCT CASE WHEN lower(coalesce(content, id)) NOT IN (SELECT k FROM k) THEN lower(coalesce(content, id)) END) AS f FROM new WHERE type = 'N'), r AS (SELECT count(*) AS r FROM new WHERE type <> 'N' AND id NOT IN (SELECT id FROM old)) SELECT f + r AS nodes_added, a - f AS entities_merged FROM en, r")
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    n = cut(_nodes(spark, d))
    return M.merge_counts(n.where("seq % 2 = 0"), n.where("seq % 2 != 0"))


_ORG = "json_extract_string(metadata, '$.org_id')"
_MG = f"""{_EDGES}, o AS (SELECT id, type, content, lpad(seq::VARCHAR, 12, '0') AS seq, {_ORG} AS org, coalesce(file_ids, []) AS file_ids, CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS b FROM n),
  k AS (SELECT *, CASE WHEN type = 'N' AND content IS NOT NULL THEN 'N|' || coalesce(org, '') || '|' || lower(content) ELSE 'I|' || id END AS k FROM o),
  f AS (SELECT k, id AS kept FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY b, seq, id) = 1), mp AS (SELECT DISTINCT id, kept FROM k JOIN f USING (k))"""


@query(f"WITH {_MG} SELECT kept AS id, count(*) AS merged, (SELECT count(DISTINCT x) FROM (SELECT unnest(flatten(list(k.file_ids))) AS x)) AS n_files FROM k JOIN f USING (k) GROUP BY kept")
def merge_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, old, new = _halves(spark, d)
    out, _ = M.merge_graph(old, edges.where("source < target"), new, edges.where("source > target"))
    name = lambda n: F.when((F.col("type") == "N") & F.col("content").isNotNull(), F.concat_ws("|", F.lit("N"), F.coalesce("org_id", F.lit("")), F.lower("content"))).otherwise(F.concat(F.lit("I|"), "id"))
    sizes = nodes.select(name(nodes).alias("k")).groupBy("k").agg(F.count("*").alias("merged"))
    return out.withColumn("k", name(out)).join(sizes, "k").select("id", "merged", F.coalesce(F.size("file_ids"), F.lit(0)).cast("bigint").alias("n_files"))


@query(f"WITH {_MG}, mv AS (SELECT a.kept AS source, z.kept AS target, relationship_type, weight FROM e JOIN mp a ON a.id = e.source JOIN mp z ON z.id = e.target) SELECT source, target, count(*) AS folded FROM mv WHERE source <> target GROUP BY source, target HAVING count(*) >= 1")
def merge_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    _, edges, old, new = _halves(spark, d)
    out = M.merge_graph(old, edges.where("source < target"), new, edges.where("source > target"))
    moved = out[1].select("source", "target")
    both = M.merge_graph(old, edges.limit(0), new, edges.limit(0))[0]
    return moved.join(_folds(edges, old, new, both), ["source", "target"])


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    n, e = _graph(spark, d)
    n = n.select("id", "type", "content", F.lpad(F.col("seq").cast("string"), 12, "0").alias("seq"), F.get_json_object("metadata", "$.org_id").alias("org_id"), F.lit(None).cast("string").alias("file_id"), "file_ids", (F.col("seq") % 2 == 0).alias("o"))
    n = cut(n)
    return n, e, n.where("o"), n.where("not o")


def _folds(edges: DataFrame, old: DataFrame, new: DataFrame, merged: DataFrame) -> DataFrame:
    """How many edges fold into each pair, from the ids that went."""
    name = F.when((F.col("type") == "N") & F.col("content").isNotNull(), F.concat_ws("|", F.lit("N"), F.coalesce("org_id", F.lit("")), F.lower("content"))).otherwise(F.concat(F.lit("I|"), "id"))
    of = old.unionByName(new).select("id", name.alias("k")).join(merged.select(name.alias("k"), F.col("id").alias("kept")), "k")
    e = edges.join(of.select(F.col("id").alias("source"), F.col("kept").alias("s")), "source").join(of.select(F.col("id").alias("target"), F.col("kept").alias("t")), "target")
    return e.where("s != t").groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(F.count("*").alias("folded"))


@query(f"WITH {_NODES}, x AS (SELECT lower(content) AS name, seq, json_extract_string(metadata, '$.org_id') AS v FROM n WHERE type = 'N' AND content IS NOT NULL), l AS (SELECT name, list(v ORDER BY seq) AS vs FROM x WHERE v IS NOT NULL GROUP BY name) SELECT name, CASE WHEN len(vs) = 1 THEN vs[1] END AS one, CASE WHEN len(vs) > 1 THEN vs END AS several FROM l")
def merged_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What merged entities keep of a metadata key: the value, or all values in order of arrival."""
    n = _nodes(spark, d).where("type = 'N' and content is not null").select(F.lower("content").alias("name"), "seq", "metadata")
    m = M.merged_metadata(n, "name", "seq").select("name", F.try_element_at("values", F.lit("org_id")).alias("one"), F.try_element_at("lists", F.lit("org_id")).alias("several"))
    return m.where("one is not null or several is not null")


@query(f"WITH {_NODES} SELECT id, type FROM n WHERE type IN ('S', 'N', 'R', 'A', 'H', 'O')")
def needs_embedding(spark: SparkSession, d: str) -> DataFrame:
    return VS.needs_embedding(_nodes(spark, d)).select("id", "type")


@query("WITH f AS (SELECT min(file_id) AS f FROM noderag_embeddings WHERE embedding IS NULL AND length(content) > 20) SELECT id, node_id FROM noderag_embeddings, f WHERE embedding IS NULL AND (file_id = f OR file_id IS NULL) AND length(trim(content)) > 10")
def needs_embedding_file(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "noderag_embeddings")
    file = e.where("embedding is null and length(content) > 20").agg(F.min("file_id")).first()[0]
    return VS.needs_embedding(e, file or "").select("id", "node_id")


@query(f"SELECT id, node_id FROM noderag_embeddings WHERE node_type = 'N' AND file_id = '{K._FILE}'")
def current_file_entities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "noderag_embeddings").select("id", "node_id", F.col("node_type").alias("type"), "file_id")
    return A.current_file_entities(e, K._FILE).select("id", "node_id")


@query("SELECT id FROM noderag_embeddings WHERE NOT coalesce(id % 9 = 0, false)")
def live_rows(spark: SparkSession, d: str) -> DataFrame:
    return VS.live(table(spark, d, "noderag_embeddings").withColumn("deleted", F.when(F.col("id") % 9 == 0, True))).select("id")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 = 0")
def drop_vanished(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id")
    return M.drop_vanished(t.where("doc_id % 4 != 0"), t.where("doc_id % 3 = 0"), "doc_id")


# ---------------------------------------------------------------- vector store


@query("WITH o AS (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0), f AS (SELECT DISTINCT vec_id FROM embeddings WHERE len(embedding) = 64 AND vec_id NOT IN (SELECT vec_id FROM o) ORDER BY vec_id LIMIT 300) SELECT vec_id FROM o UNION ALL SELECT vec_id FROM f")
def add_vectors(spark: SparkSession, d: str) -> DataFrame:
    """What is not yet in the index joins it, as far as there is room."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    old = e.where("vec_id % 2 = 0")
    return VS.add_vectors(old, e, 64, capacity=old.count() + 300, key="vec_id").select("vec_id")


@query("SELECT node_id, min(node_type) AS node_type FROM noderag_embeddings WHERE len(embedding) = 64 AND id % 3 = 0 GROUP BY node_id")
def rebuilt_index(spark: SparkSession, d: str) -> DataFrame:
    """Rebuilt from bare vectors; metadata is taken over from the old index."""
    e = table(spark, d, "noderag_embeddings").where("size(embedding) = 64 and id % 3 = 0").select("node_id", "node_type", "embedding")
    new = e.withColumn("node_type", F.lit(None).cast("string"))
    return VS.rebuilt(e, new, 64, capacity=10**9).select("node_id", "node_type")


@query("SELECT node_id, node_type, org_id, len(embedding)::INT AS width FROM noderag_embeddings WHERE node_id IN (SELECT node_id FROM noderag_embeddings WHERE id IN (1, 2, 3))")
def vector_by_id(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "noderag_embeddings")
    ids = [r[0] for r in e.where("id in (1, 2, 3)").select("node_id").collect()]
    return VS.by_id(e, ids).select("node_id", "node_type", "org_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("width"))


@query("SELECT least(20, count(*))::INT AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 100 = 0")
def vec_approx_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the approximate search finds nine tenths of the exact neighbours of twenty vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = cut(VS.sketched(e, 64))
    asked = e.where("vec_id % 100 = 0").orderBy("vec_id").limit(20).collect()
    exact = VS.search_many(e.where(F.col("vec_id").isin(*[r[0] for r in asked])).select(F.col("vec_id").alias("query_id"), "embedding"), e, 10, key="vec_id").select("query_id", "vec_id")
    near = None
    for r in asked:
        got = VS.search_approx(index, list(r[1]), 10, key="vec_id").select(F.lit(r[0]).alias("query_id"), "vec_id")
        near = got if near is None else near.union(got)
    hit = exact.join(near, ["query_id", "vec_id"], "left_semi").agg(F.count("*").alias("hit"))
    return exact.agg(F.count("*").alias("n"), F.count_distinct("query_id").cast("int").alias("queries")).join(hit, F.lit(True)).select("queries", (F.col("hit") >= 0.9 * F.col("n")).alias("recall_reached"))


@query("WITH new AS (SELECT *, (row_number() OVER (PARTITION BY org_id, file_id ORDER BY id) - 1)::INT AS ci FROM noderag_embeddings WHERE id % 5 = 0) SELECT id, node_id, ci AS chunk_index FROM new QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY id DESC) = 1")
def upsert_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """New rows get their place in their file's list."""
    e = table(spark, d, "noderag_embeddings").select("id", "node_id", "org_id", "file_id", "content", "chunk_index")
    return M.upsert_embeddings(e.limit(0), e.where("id % 5 = 0"), ordinal=True).select("id", "node_id", "chunk_index")


@query("SELECT id AS key, node_id, node_type, sha256(content[1:2000]) AS h, json_extract_string(graph_metadata, '$.org_id') IS NOT DISTINCT FROM json_extract_string(graph_metadata, '$.org_id') AS wrapped FROM noderag_embeddings WHERE embedding IS NOT NULL")
def store_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "noderag_embeddings").select(F.concat_ws("|", "id", "node_id").alias("id"), F.col("node_type").alias("type"), "content", "embedding", F.col("graph_metadata").alias("metadata"))
    s = M.store_rows(e)
    same = F.get_json_object("graph_metadata", "$.node_type_value").eqNullSafe(F.col("node_type"))
    return s.select(F.split_part("node_id", F.lit("|"), F.lit(1)).cast("bigint").alias("key"), F.split_part("node_id", F.lit("|"), F.lit(2)).alias("node_id"), "node_type", F.sha2("content", 256).alias("h"), same.alias("wrapped"))


# ---------------------------------------------------------------- state


_VERS = "WITH old AS (SELECT org_id, 3::BIGINT AS version, list(DISTINCT file_id) AS p FROM noderag_file_processing WHERE id % 2 = 0 AND file_id IS NOT NULL GROUP BY org_id), new AS (SELECT org_id, list(DISTINCT file_id) AS f FROM noderag_file_processing WHERE file_id IS NOT NULL GROUP BY org_id) SELECT org_id, coalesce(version, 0) + 1 AS version, len(list_distinct(list_concat(coalesce(p, []), f)))::INT AS files FROM new LEFT JOIN old USING (org_id)"


@query(_VERS)
def org_versions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "noderag_file_processing").where("file_id is not null")
    old = s.where("id % 2 = 0").groupBy("org_id").agg(F.lit(3).cast("bigint").alias("version"), F.collect_set("file_id").alias("processed_files"))
    return M.next_versions(old, s).select("org_id", "version", F.size("processed_files").alias("files"))


@query("SELECT count_if(s = 'processing')::BIGINT AS active, count_if(s IN ('pending', 'queued'))::BIGINT AS scheduled, count_if(s IN ('completed', 'skipped'))::BIGINT AS finished, count_if(s = 'failed')::BIGINT AS failed, count_if(s IN ('processing', 'pending', 'queued'))::BIGINT AS total_pending FROM (SELECT lower(trim(processing_status)) AS s FROM noderag_file_processing)")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import queue_stats

    return queue_stats(table(spark, d, "noderag_file_processing"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'retry' ELSE lower(processing_status) END AS current_status FROM noderag_file_processing")
def task_status(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import task_status

    s = table(spark, d, "noderag_file_processing").select("id", "processing_status")
    return task_status(s, s.where("id % 3 = 0").select("id", F.lit("RETRY").alias("state")), "id").select("id", "current_status")


@query("SELECT id, CASE WHEN lower(processing_status) = 'failed' THEN 'pending' ELSE processing_status END AS processing_status FROM noderag_file_processing WHERE NOT coalesce(file_id IN ('file_00_000001', 'file_00_000002'), false)")
def reset_failed(spark: SparkSession, d: str) -> DataFrame:
    """Failed files wait again; two named files are forgotten."""
    from ..streaming.ingest import clear_state, reset_failed

    return clear_state(reset_failed(table(spark, d, "noderag_file_processing")), ["file_00_000001", "file_00_000002"], "file_id").select("id", "processing_status")


@query("SELECT id, file_id FROM noderag_file_processing WHERE lower(processing_status) = 'failed'")
def failed_files(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import failed

    return failed(table(spark, d, "noderag_file_processing")).select("id", "file_id")


# ---------------------------------------------------------------- graph analytics


@query(f"WITH {_EDGES}, d AS (SELECT id, count(x) AS degree FROM n LEFT JOIN (SELECT source AS x FROM e UNION ALL SELECT target FROM e) ON x = id GROUP BY id), s AS (SELECT n.id, seq, degree, content FROM n JOIN d USING (id) WHERE type = 'N'), t AS (SELECT greatest(1, floor(count(*) * 0.2)) AS k FROM s) SELECT id, degree FROM s QUALIFY row_number() OVER (ORDER BY degree DESC, seq, id) <= (SELECT k FROM t)")
def top_fraction(spark: SparkSession, d: str) -> DataFrame:
    """The fifth of the entities with the highest degree."""
    from ..operators.centrality import important_entities

    n, e = _graph(spark, d)
    s = G.degrees(n, e).withColumn("importance", F.col("degree").cast("double"))
    return important_entities(n, s, 0.2).select("id", "degree")


_TW = "tw AS (SELECT s, d, count(*) * 0.5 AS w FROM (SELECT DISTINCT source AS s, target AS d FROM e WHERE source <> target UNION ALL SELECT DISTINCT target, source FROM e WHERE source <> target) GROUP BY s, d)"


@query(f"WITH {_EDGES}, {_TW} SELECT (SELECT count(*) FROM n) AS n, count(*) AS nonzero, round(count(*) / ((SELECT count(*) FROM n) ** 2)::DOUBLE, 12) AS density FROM tw")
def matrix_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ppr.matrix_stats(*_graph(spark, d)), "density", digits=12)


_PPR = K._ppr_sql(_EDGES + ", gn AS (SELECT id FROM n)", "ge AS (SELECT source, target FROM e)", "SELECT min(id) AS i, 1.0 AS w FROM n WHERE type = 'N' UNION ALL SELECT max(id), 0.7 FROM n WHERE type = 'T'", 10)
_LEAK = _PPR.replace("UNION ALL SELECT x.it, gn.id, 0.85", "UNION ALL SELECT x.it, gn.id, 0.0")


def _seeds(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'N'").agg(F.min("id").alias("id"), F.lit(1.0).alias("weight")).union(nodes.where("type = 'T'").agg(F.max("id"), F.lit(0.7)))


@query(_LEAK)
def ppr_leaking(spark: SparkSession, d: str) -> DataFrame:
    """The unmodified walk, in which isolated nodes lose their mass."""
    n, e = _graph(spark, d)
    return _rounded(ppr.pagerank(n, e, _seeds(n), max_iter=10, tol=None, modified=False), "score", digits=8)


@query(f"SELECT p.id, t.type, p.score FROM ({_PPR}) p JOIN (SELECT id, upper(trim(type)) AS type, seq FROM graph_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1) t USING (id) ORDER BY p.score DESC, t.seq, p.id LIMIT 40")
def ppr_top(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    s = _rounded(ppr.pagerank(n, e, _seeds(n), max_iter=10, tol=None), "score", digits=8)
    return ppr.top_nodes(s, n, 40).select("id", "type", "score")


# ---------------------------------------------------------------- retrieval


_WALK = K._ppr_sql(_EDGES + ", gn AS (SELECT id FROM n), " + K._NV + ", " + K._HITS + ", " + K._EXACT, "ge AS (SELECT source, target FROM e)", K._SEEDS, 10)
_SEL = f"""WITH sc AS ({_WALK}), w AS (SELECT * FROM (WITH {_EDGES}, {K._NV}, {K._HITS}, {K._EXACT} SELECT id, type, content, seq, id IN (SELECT i FROM ({K._SEEDS})) AS seed FROM n)),
  top AS (SELECT id, type, score, seq, seed FROM sc JOIN w USING (id) ORDER BY score DESC, seq, id LIMIT {{}}), h AS (SELECT *, row_number() OVER (ORDER BY score DESC, seq, id) AS rank, CASE WHEN type IN ('N', 'R') THEN type WHEN type IN ('H', 'O') THEN 'HO' ELSE 'other' END AS cat FROM top WHERE NOT seed),
  c AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY rank) AS k FROM h), st AS (SELECT CASE WHEN count(*) = 3 THEN max(rank) ELSE 2147483647 END AS stop FROM c WHERE (cat = 'N' AND k = 10) OR (cat = 'R' AND k = 30) OR (cat = 'HO' AND k = 10)),
  sel AS (SELECT id, type, 'seed' AS origin, 0 AS rank, true AS listed FROM w WHERE seed UNION ALL SELECT id, type, 'walk', rank::INT, cat = 'other' OR k <= CASE cat WHEN 'R' THEN 30 ELSE 10 END FROM c WHERE rank <= (SELECT stop FROM st))"""


def _walked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    nodes, edges, seeds, scores = K._fused(spark, d)
    return nodes, edges, seeds, cut(_rounded(scores, "score", digits=8))


@query(_SEL.format(200) + " SELECT id, type, origin, rank, listed FROM sel")
def search_category_quota(spark: SparkSession, d: str) -> DataFrame:
    """Seeds and walk hits in order, with the quotas of their categories."""
    nodes, _, seeds, scores = _walked(spark, d)
    return R.select_nodes(seeds, ppr.top_nodes(scores, nodes, 200), nodes)


@query(_SEL.format(20) + " SELECT sha256(string_agg('[' || type || '] ' || coalesce(content, ''), chr(10) || chr(10) ORDER BY origin <> 'seed', score DESC, seq, id)) AS h FROM sel JOIN (SELECT id, content, seq FROM w) USING (id) JOIN sc USING (id)")
def context_build(spark: SparkSession, d: str) -> DataFrame:
    nodes, _, seeds, scores = _walked(spark, d)
    return R.context(R.select_nodes(seeds, ppr.top_nodes(scores, nodes, 20), nodes), nodes, scores).select(F.sha2("context", 256).alias("h"))


@query(_SEL.format(20) + " SELECT origin, count(*) AS n FROM sel GROUP BY origin")
def search_counters(spark: SparkSession, d: str) -> DataFrame:
    """The whole search by one call: how many nodes each step brought."""
    nodes, edges = _graph(spark, d)
    found = R.retrieve(nodes, edges, table(spark, d, "noderag_embeddings"), QUESTION, ["Monday, 7 July"], 12, 0.1, max_iter=10, expand=False)
    ranked = ppr.top_nodes(_rounded(found.scores, "score", digits=8), nodes, 20)
    seeds = found.selected.where("origin = 'seed'")
    return R.select_nodes(seeds, ranked, nodes).groupBy("origin").agg(F.count("*").alias("n"))


@query(f"WITH {_EDGES} SELECT DISTINCT e.source AS id, 'A' AS type FROM e JOIN n a ON a.id = e.source AND a.type = 'A' JOIN n b ON b.id = e.target AND b.type = 'N'")
def attribute_expansion(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    return R.expand_attributes(n, e, n)


@query(f"WITH {_EDGES}, x AS (SELECT e.source, e.target FROM e JOIN n h ON h.id = e.target AND h.type = 'H' JOIN n o ON o.id = e.source AND o.type IN ('H', 'O') QUALIFY row_number() OVER (PARTITION BY e.source ORDER BY h.seq, h.id) = 1) SELECT DISTINCT target AS id, 'H' AS type FROM x")
def title_expansion(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    return R.expand_titles(n, e, n)


@query(f"WITH {_NODES}, s AS (SELECT CASE type WHEN 'N' THEN 'ENTITIES' WHEN 'R' THEN 'RELATIONSHIPS' WHEN 'H' THEN 'HIGH-LEVEL' WHEN 'A' THEN 'ATTRIBUTES' ELSE 'OTHER' END AS section, content, seq FROM n WHERE seq % 100 = 0 AND content IS NOT NULL) SELECT section, sha256(string_agg(content, chr(10) ORDER BY seq)) AS h FROM s GROUP BY section")
def grouped_context(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return R.grouped_context(n.where("seq % 100 = 0 and content is not null"), n).select("section", F.sha2("content", 256).alias("h"))


@query(f"WITH {_NODES} SELECT DISTINCT unnest(file_ids) AS file_id FROM n WHERE type = 'R'")
def result_sources(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return R.sources(n.where("type = 'R'"), n)


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_of_each(spark: SparkSession, d: str) -> DataFrame:
    return R.first_of_each(table(spark, d, "events"), "user_id", "event_id")


_RESP = f"WITH s AS (SELECT node_id, content, sqrt(s) AS dist FROM (SELECT node_id, content, {_L2SQ} AS s FROM noderag_embeddings WHERE {_OK} AND org_id = 'org-halden') ORDER BY dist, node_id LIMIT 10), r AS (SELECT *, row_number() OVER (ORDER BY dist, node_id) AS k FROM s), c AS (SELECT *, row_number() OVER (ORDER BY k) AS j FROM r WHERE content IS NOT NULL AND content <> '') SELECT (SELECT count(*) FROM c)::INT AS total_results, (SELECT count(*) FROM c WHERE j <= 5)::INT AS contexts_used, 'database' AS source, round(least(1.0, (SELECT avg(1 - dist) FROM c WHERE j <= 5)), 6) AS confidence, sha256((SELECT string_agg(content, chr(10) || chr(10) ORDER BY j) FROM c WHERE j <= 5)) AS h"


@query(_RESP)
def respond(spark: SparkSession, d: str) -> DataFrame:
    """The nearest stored rows of an organisation as contexts of a response."""
    r = R.respond(table(spark, d, "noderag_embeddings").where("size(embedding) = 64"), QUESTION, "org-halden")
    return r.select("total_results", "contexts_used", "source", F.round("confidence", 6).alias("confidence"), F.sha2("response", 256).alias("h"))


@query(f"WITH {_NODES} SELECT id, id || '<br>' || type || '<br>' || CASE WHEN length(content) > 100 THEN content[1:100] || '...' ELSE content END || '<br>content: ' || CASE WHEN length(content) > 50 THEN content[1:50] || '...' ELSE content END AS title FROM n WHERE content IS NOT NULL")
def hover_title(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).where("content is not null")
    return n.withColumn("metadata", F.to_json(F.struct("content"))).select("id", viz.hover_title().alias("title"))


# ---------------------------------------------------------------- augmentation


_CTX = "near AS (SELECT DISTINCT e.target AS entity, s.id, s.type, s.content, s.seq FROM e JOIN n s ON s.id = e.source JOIN n t ON t.id = e.target AND t.type = 'N' WHERE s.type IN ('T', 'R')), rk AS (SELECT *, row_number() OVER (PARTITION BY entity, type ORDER BY seq, id) AS r FROM near), cx AS (SELECT entity, string_agg(CASE WHEN length(coalesce(content, '')) > 200 THEN content[1:200] || '...' ELSE coalesce(content, '') END, ' | ' ORDER BY r) FILTER (type = 'T' AND r <= 5) AS c, string_agg(CASE WHEN length(coalesce(content, '')) > 200 THEN content[1:200] || '...' ELSE coalesce(content, '') END, ' | ' ORDER BY r) FILTER (type = 'R' AND r <= 3) AS q FROM rk GROUP BY entity)"


@query(f"WITH {_EDGES}, {_CTX} SELECT 'A_' || n.id || '_org' AS id, sha256('Entity: ' || coalesce(n.content, '') || CASE WHEN c IS NOT NULL THEN chr(10) || 'Context: ' || c ELSE '' END || CASE WHEN q IS NOT NULL THEN chr(10) || 'Relationships: ' || q ELSE '' END) AS h, n.id AS describes FROM n LEFT JOIN cx ON cx.entity = n.id WHERE n.type = 'N'")
def attribute_nodes(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    made, link = A.attribute_nodes(n.where("type = 'N'"), n, e, "org")
    return made.join(link.select(F.col("source").alias("id"), F.col("target").alias("describes")), "id").select("id", F.sha2("content", 256).alias("h"), "describes")


_COMM = f"WITH RECURSIVE {_BOTH}, r(id, c) AS (SELECT id, id FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id), k AS (SELECT id, min(c) AS c FROM r GROUP BY id), m AS (SELECT c, id, content, row_number() OVER (PARTITION BY c ORDER BY seq, id) AS r, count(*) OVER (PARTITION BY c) AS size FROM k JOIN n USING (id))"


@query(f"{_COMM} SELECT 'H_community_' || c AS id, sha256(string_agg(CASE WHEN length(coalesce(content, '')) > 100 THEN content[1:100] || '...' ELSE coalesce(content, '') END, '; ' ORDER BY r)) AS h, any_value(size) AS node_count, count(*) AS linked FROM m WHERE r <= 10 AND c <> (SELECT min(c) FROM k) GROUP BY c")
def community_nodes(spark: SparkSession, d: str) -> DataFrame:
    """High-level nodes of components as communities; one community has its node already."""
    n, e = _graph(spark, d)
    c = cut(G.components(n, e).withColumnRenamed("component", "community"))
    made, link = A.community_nodes(c, n, known=c.agg(F.min("community").alias("community")))
    linked = link.where("relationship_type = 'summarizes_content'").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("linked"))
    size = F.get_json_object("metadata", "$.node_count").cast("bigint").alias("node_count")
    return made.where("type = 'H'").join(linked, "id").select("id", F.sha2("content", 256).alias("h"), size, "linked")


@query(f"{_COMM} SELECT 'O_community_' || c AS source, 'H_community_' || c AS target FROM m GROUP BY c")
def community_titles(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    c = G.components(n, e).withColumnRenamed("component", "community")
    return A.community_nodes(c, n)[1].where("relationship_type = 'summarizes'").select("source", "target")


@query(f"WITH {_NODES} SELECT 'A' AS type, least(5, count(*)) AS n FROM n WHERE type = 'N'")
def augment_new(spark: SparkSession, d: str) -> DataFrame:
    """After a file with few new entities: attributes only."""
    n, e = _graph(spark, d)
    few = n.where("type = 'N'").orderBy("seq").limit(A.NEW_ENTITIES)
    made, _ = A.augment_new(n, e, few)
    return made.groupBy("type").agg(F.count("*").alias("n"))


@query(f"SELECT id, node_id, round({_COS}, 6) AS similarity FROM noderag_embeddings WHERE {_OK} AND org_id = 'org-halden' AND ({_COS}) >= 0.15 ORDER BY 1 - ({_COS}), id LIMIT 25")
def vec_org_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of one organisation that are similar enough."""
    hit = VS.search(table(spark, d, "noderag_embeddings"), QUESTION, 25, min_similarity=0.15, org_id="org-halden", key="id")
    return _rounded(hit.select("id", "node_id", "similarity"), "similarity")
