"""Named queries of the core operators, with the SQL that states each result.

Tables stand for the engine's state as follows: ``documents`` are files (org = source),
``document_chunks`` chunks, ``noderag_embeddings`` the vector store, ``graph_nodes`` and
``graph_edges`` the graph, ``noderag_file_processing`` the state log, ``eval_items`` the
questions.  The star schema serves as a second graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T, vectors as V
from ..operators import centrality as C, chunking, extract as X, graph as G, maintenance as M, ppr, retrieval as R, vector_search as VS, viz
from ..runtime import cut, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- vectors

#: A fixed question for the vector queries.
QUESTION = [round(((i * 37) % 17 - 8) / 10, 1) for i in range(64)]
_Q = "[" + ",".join(map(str, QUESTION)) + "]::DOUBLE[]"
_OK = "embedding IS NOT NULL AND len(embedding) = 64 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x*x)) > 0"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]*z[2]))"


def _norm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: x*x)))"


_COS = f"{_dot('embedding::DOUBLE[]', _Q)} / ({_norm('embedding::DOUBLE[]')} * {_norm(_Q)})"
_L2SQ = f"list_sum(list_transform(list_zip(embedding::DOUBLE[], {_Q}), lambda z: (z[1]-z[2])*(z[1]-z[2])))"


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(f"SELECT vec_id, round(1 - c, 6) AS distance, round(c, 6) AS similarity FROM (SELECT vec_id, {_COS} AS c FROM embeddings WHERE {_OK}) ORDER BY 1 - c, vec_id LIMIT 10")
def vec_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(VS.search(table(spark, d, "embeddings"), QUESTION, 10, key="vec_id").select("vec_id", "distance", "similarity"), "distance", "similarity")


@query(f"SELECT node_id, id, round(c, 6) AS similarity FROM (SELECT node_id, id, {_COS} AS c FROM noderag_embeddings WHERE {_OK}) WHERE c >= 0.2")
def vec_cosine_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(VS.search(table(spark, d, "noderag_embeddings"), QUESTION, None, min_similarity=0.2).select("node_id", "id", "similarity"), "similarity")


@query(f"SELECT vec_id, round(sqrt(s), 6) AS distance, round(1 - sqrt(s), 6) AS score FROM (SELECT vec_id, {_L2SQ} AS s FROM embeddings WHERE {_OK}) ORDER BY s, vec_id LIMIT 10")
def vec_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(VS.search_l2(table(spark, d, "embeddings"), QUESTION, 10, key="vec_id").select("vec_id", "distance", "score"), "distance", "score")


@query(f"SELECT vec_id, round(1 - p, 6) AS distance FROM (SELECT vec_id, {_dot('embedding::DOUBLE[]', _Q)} AS p FROM embeddings WHERE {_OK}) ORDER BY 1 - p, vec_id LIMIT 10")
def vec_ip_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(VS.search(table(spark, d, "embeddings"), QUESTION, 10, "ip", key="vec_id").select("vec_id", "distance"), "distance")


@query(f"SELECT id, node_id, round({_COS}, 6) AS similarity FROM noderag_embeddings WHERE {_OK} AND org_id = 'org-halden' AND node_type IN ('N', 'S') ORDER BY 1 - ({_COS}), id LIMIT 15")
def vec_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    hit = VS.search(table(spark, d, "noderag_embeddings"), QUESTION, 15, org_id="org-halden", types=["N", "S"], key="id")
    return _rounded(hit.select("id", "node_id", "similarity"), "similarity")


@query(f"WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e, {_norm('embedding::DOUBLE[]')} AS n FROM embeddings WHERE {_OK}), p AS (SELECT a.vec_id AS source, b.vec_id AS target, {_dot('a.e', 'b.e')} / (a.n * b.n) AS w FROM u a JOIN u b ON a.vec_id < b.vec_id) SELECT source, target, round(w, 6) AS weight FROM p WHERE w >= 0.4")
def vec_knn_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(VS.similarity_graph(table(spark, d, "embeddings"), 0.4, "vec_id"), "weight")


@query(f"WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, {_norm('embedding::DOUBLE[]')} AS n FROM embeddings WHERE vec_id % 100 = 0 AND {_OK}), b AS (SELECT vec_id, embedding::DOUBLE[] AS e, {_norm('embedding::DOUBLE[]')} AS n FROM embeddings WHERE {_OK}), s AS (SELECT query_id, vec_id, {_dot('q.e', 'b.e')} / (q.n * b.n) AS c FROM q, b) SELECT query_id, vec_id, round(c, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 5")
def vec_many_queries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return _rounded(VS.search_many(q, e, 5, key="vec_id"), "similarity")


@query(f"SELECT count(*) AS elements, count(*) * 64 * 4 / 1048576.0::DOUBLE AS memory_mb, count(*) / 100000.0::DOUBLE * 100 AS fill_percent FROM embeddings")
def vec_index_stats(spark: SparkSession, d: str) -> DataFrame:
    return VS.index_stats(table(spark, d, "embeddings"), 64)


# ---------------------------------------------------------------- chunks and text

_WS = "'[ \\t\\n\\r\\f]+'"
_WORDS = f"CASE WHEN regexp_replace(coalesce(text,''), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace(text, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'), {_WS}) END"


def _windows(size: int, overlap: int) -> str:
    step = size - overlap
    return f"w AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT doc_id, w, (1 + ceil(greatest(0, len(w) - {size}) / {step}.0))::INT AS total FROM w WHERE len(w) > 0), x AS (SELECT doc_id, w, total, unnest(range(0, total)) AS i FROM c)"


@query(f"WITH {_windows(1536, 75)} SELECT doc_id, i::INT AS chunk_index, sha256(array_to_string(w[i*1461+1 : i*1461+1536], ' ')) AS content_hash, len(w[i*1461+1 : i*1461+1536])::INT AS token_count, total AS total_chunks FROM x")
def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunk_words(table(spark, d, "documents").select("doc_id", "text"))
    return c.select("doc_id", "chunk_index", F.sha2("content", 256).alias("content_hash"), "token_count", "total_chunks")


@query(f"WITH {_windows(200, 20)}, y AS (SELECT doc_id, i, array_to_string(w[i*180+1 : i*180+200], ' ') AS content, CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(w[1 : i*180], ' ')) END AS s FROM x) SELECT doc_id, i::INT AS chunk_index, s::INT AS start_char, (s + length(content))::INT AS end_char FROM y")
def chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_words(table(spark, d, "documents").select("doc_id", "text"), size=200, overlap=20).select("doc_id", "chunk_index", "start_char", "end_char")


@query(f"WITH w AS (SELECT source, doc_id, len({_WORDS}) AS n FROM documents) SELECT source, count(*) AS docs, sum(n)::BIGINT AS total_tokens, max(n)::INT AS longest FROM w GROUP BY source")
def doc_token_stats(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("source", T.word_count("text").alias("n"))
    return n.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("total_tokens"), F.max("n").alias("longest"))


@query("SELECT doc_id, strlen(text) AS chars, strlen(text)//4 AS tokens, greatest(1, strlen(text)//4//1536) AS chunks, greatest(1, strlen(text)//4//1536) AS llm_calls, 3*greatest(1, strlen(text)//4//1536) AS embedding_calls, strlen(text)/1048576.0::DOUBLE AS megabytes FROM documents WHERE text IS NOT NULL")
def doc_cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("text").cast("bigint")
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.cost_estimate(size).alias("e")).select("doc_id", "e.*")


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE text IS NOT NULL")
def doc_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("file_hash"))


@query("WITH c AS (SELECT file_id, chunk_index, chunk_key, length(content) AS n, json_extract_string(metadata, '$.page') AS page FROM document_chunks WHERE content IS NOT NULL AND content <> '') SELECT chunk_key, file_id, chunk_index, coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY chunk_index, chunk_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_position, coalesce(TRY_CAST(page AS INT), row_number() OVER (PARTITION BY file_id ORDER BY chunk_index, chunk_key))::INT AS page_number FROM c")
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.records import running_chunks

    return running_chunks(table(spark, d, "document_chunks"), ["file_id"], ["chunk_index", "chunk_key"]).select("chunk_key", "file_id", "chunk_index", "char_position", "page_number")


@query("SELECT chunk_key, len(string_split_regex(regexp_replace(content, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'), '[ \\t\\n\\r\\f]+'))::INT AS words, 0 AS start_char, length(content)::INT AS end_char FROM document_chunks WHERE content IS NOT NULL AND regexp_replace(content, '[ \\t\\n\\r\\f]+', '', 'g') <> ''")
def chunk_ingest(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.records import ingest_chunks

    return ingest_chunks(table(spark, d, "document_chunks")).select("chunk_key", F.col("token_count").alias("words"), "start_char", "end_char")


_REL = "(SELECT seq, json_extract_string(metadata,'$.entity1') || ', ' || json_extract_string(metadata,'$.relation') || ' , ' || json_extract_string(metadata,'$.entity2') AS s FROM graph_nodes WHERE upper(trim(type)) = 'R')"


@query(f"WITH p AS (SELECT seq, list_transform(string_split(s, ','), lambda x: trim(x)) AS p FROM {_REL} WHERE s IS NOT NULL) SELECT seq, upper(p[1]) AS source, array_to_string(p[2:len(p)-1], ', ') AS relation, upper(p[len(p)]) AS target FROM p WHERE len(p) >= 3")
def relation_parse(spark: SparkSession, d: str) -> DataFrame:
    m = lambda k: F.get_json_object("metadata", f"$.{k}")
    r = table(spark, d, "graph_nodes").where(F.upper(F.trim("type")) == "R").select("seq", F.concat(m("entity1"), F.lit(", "), m("relation"), F.lit(" , "), m("entity2")).alias("s"))
    return r.select("seq", T.relation_parse("s").alias("t")).where("t is not null").select("seq", "t.*")


@query("SELECT seq, list_filter(list_transform(file_ids, lambda x: trim(x)), lambda x: x <> '') AS items FROM graph_nodes WHERE file_ids IS NOT NULL")
def json_list_parse(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "graph_nodes").where("file_ids is not null")
    reply = F.concat(F.lit("Here is the list:\n```json\n"), F.to_json("file_ids"), F.lit("\n```\n"))
    return n.select("seq", T.json_list_parse(reply).alias("items"))


@query("SELECT item_id, trim(split_part(text, '. ', 1)) AS first_user, 2 AS messages FROM eval_items WHERE text IS NOT NULL")
def conversation_parse(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.records import parse_conversations

    q = table(spark, d, "eval_items").where("text is not null")
    raw = q.select(F.col("item_id").cast("string").alias("conv"), F.concat(F.lit("noise before\nUser: "), F.trim(F.split_part("text", F.lit(". "), F.lit(1))), F.lit("\nassistant : noted\nsystem: dropped")).alias("history"))
    m = parse_conversations(raw, "conv", "history")
    return m.groupBy("conv").agg(F.max(F.when(F.col("role") == "user", F.col("content"))).alias("first_user"), F.count("*").cast("int").alias("messages")).select(F.col("conv").cast("bigint").alias("item_id"), "first_user", "messages")


# ---------------------------------------------------------------- extraction and merging

#: Documents cut into chunks of 200 words before extraction, so that its limits hold by chunk and no text is left out.
_SIZE, _OVERLAP = 200, 20
_CHUNKS = f"{_windows(_SIZE, _OVERLAP)}, ch AS (SELECT doc_id, i AS ci, array_to_string(w[i*{_SIZE - _OVERLAP}+1 : i*{_SIZE - _OVERLAP}+{_SIZE}], ' ') AS content FROM x)"
_UNITS = "list_filter(string_split_regex(content, '[.!?][ \\t\\n\\r\\f]+'), lambda x: regexp_replace(x, '[ \\t\\n\\r\\f]+', '', 'g') <> '')[1:10]"
_CAPS = "list_filter(regexp_extract_all({0}, '[A-Z][a-z]+'), lambda x: length(x) >= 4)"
_DISTINCT = "list_transform(list_filter(list_transform(range(1, len({0})+1), lambda i: [i, list_position({0}, {0}[i])]), lambda z: z[1] = z[2]), lambda z: {0}[z[1]])"
_ENT = f"{_CHUNKS}, f AS (SELECT doc_id, ci, {_CAPS.format('content')} AS a FROM ch), e AS (SELECT doc_id, ci, ({_DISTINCT.format('a')})[1:35] AS ents FROM f), m AS (SELECT doc_id, ci, unnest(ents) AS content, generate_subscripts(ents, 1) AS i FROM e)"


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("org_id"), "text")
    return X.rule_extract(chunking.chunk_words(docs, size=_SIZE, overlap=_OVERLAP))


_SEEN = "lpad(doc_id::VARCHAR, 24, '0') || '|' || lpad(ci::VARCHAR, 9, '0') || '|' || lpad((i-1)::VARCHAR, 6, '0')"


@query(f"WITH {_ENT} SELECT lower(content) AS name, min({_SEEN}) AS first_seen, count(DISTINCT doc_id) AS n_files, count(*) AS mentions FROM m GROUP BY 1")
def entity_dedup(spark: SparkSession, d: str) -> DataFrame:
    n = _extracted(spark, d).select("file_id", "chunk_index", F.posexplode("entities").alias("i", "content"))
    seen = F.concat_ws("|", F.lpad(F.col("file_id").cast("string"), 24, "0"), F.lpad(F.col("chunk_index").cast("string"), 9, "0"), F.lpad(F.col("i").cast("string"), 6, "0"))
    return n.groupBy(T.index_key("content").alias("name")).agg(F.min(seen).alias("first_seen"), F.count_distinct("file_id").alias("n_files"), F.count("*").alias("mentions"))


@query(f"WITH {_ENT}, k AS (SELECT doc_id, 'N_' || doc_id || '_' || ci || '_' || (i-1) AS id, lower(content) AS name, {_SEEN} AS seen FROM m) SELECT id, first_value(id) OVER (PARTITION BY name ORDER BY seen) AS canonical_id FROM k")
def mention_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every mention with the node that its name has in the merged graph."""
    return X.canonical_entities(X.chunk_graph(_extracted(spark, d))[0])


@query(f"WITH {_ENT}, u AS (SELECT doc_id, ci, len({_UNITS}) AS us FROM ch) SELECT u.doc_id, u.ci::INT AS chunk_index, us::INT AS units, coalesce(len(ents), 0)::INT AS entities FROM u JOIN e USING (doc_id, ci)")
def extract_counts(spark: SparkSession, d: str) -> DataFrame:
    x = _extracted(spark, d)
    return x.select(F.col("file_id").alias("doc_id"), "chunk_index", F.size("units").alias("units"), F.size("entities").alias("entities"))


_TRIPLES = f"""{_ENT}, un AS (SELECT doc_id, ci, unnest(us) AS u, generate_subscripts(us, 1) AS k FROM (SELECT doc_id, ci, {_UNITS} AS us FROM ch)),
  cu AS (SELECT doc_id, ci, k, {_CAPS.format('u')} AS a FROM un), du AS (SELECT doc_id, ci, k, {_DISTINCT.format('a')} AS d FROM cu),
  pr AS (SELECT doc_id, ci, k, unnest(range(1, len(d))) AS j, d FROM du WHERE len(d) > 1),
  t25 AS (SELECT doc_id, ci, lower(d[j]) AS s, lower(d[j + 1]) AS t, row_number() OVER (PARTITION BY doc_id, ci ORDER BY k, j) - 1 AS i FROM pr QUALIFY i < 25),
  tr AS (SELECT t25.* FROM t25 JOIN e USING (doc_id, ci) WHERE list_contains(list_transform(ents, lambda x: lower(x)), s) AND list_contains(list_transform(ents, lambda x: lower(x)), t))"""


@query(f"WITH {_TRIPLES} SELECT 'contains_semantic_unit' AS relationship_type, count(*) AS n FROM un UNION ALL SELECT 'mentions_entity', count(DISTINCT (doc_id, ci, lower(content))) FROM m UNION ALL SELECT 'involves_entity', count(DISTINCT (doc_id, ci, i, x)) FROM (SELECT doc_id, ci, i, unnest([s, t]) AS x FROM tr) UNION ALL SELECT 'FOLLOWED_BY', count(DISTINCT (s, t)) FROM tr WHERE s <> t")
def document_graph(spark: SparkSession, d: str) -> DataFrame:
    """Chunks to a merged graph, as edge counts by relation."""
    nodes, edges = X.chunk_graph(_extracted(spark, d))
    edges = X.merge_entities(cut(nodes), cut(edges))[1]
    return edges.groupBy("relationship_type").agg(F.count("*").alias("n"))


_NODES = "n AS (SELECT id, upper(trim(type)) AS type, content, metadata, file_ids, seq FROM graph_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)"
_FOLD = "list_reduce(list(relationship_type ORDER BY relationship_type NULLS FIRST, weight NULLS FIRST, metadata NULLS FIRST) FILTER (relationship_type IS NOT NULL), lambda acc, t: CASE WHEN acc = t THEN acc ELSE acc || '; ' || t END)"
_EDGES = f"{_NODES}, e AS (SELECT source, target, {_FOLD} AS relationship_type, coalesce(arg_min_null(weight, 0), 1.0) AS weight FROM graph_edges WHERE source <> target AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) GROUP BY source, target)".replace("coalesce(arg_min_null(weight, 0), 1.0)", "coalesce((list(weight ORDER BY relationship_type NULLS FIRST, weight NULLS FIRST, metadata NULLS FIRST))[1], 1.0)")


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = cut(G.canonical_nodes(table(spark, d, "graph_nodes")))
    return nodes, cut(G.valid_edges(nodes, table(spark, d, "graph_edges")))


@query(f"WITH {_EDGES} SELECT source, target, relationship_type, weight FROM e")
def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1].select("source", "target", "relationship_type", "weight")


@query(f"WITH {_NODES} SELECT type, count(*) AS node_count FROM n GROUP BY type")
def graph_node_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.type_counts(G.canonical_nodes(table(spark, d, "graph_nodes")))


@query(f"WITH {_NODES}, x AS (SELECT type, unnest(file_ids) AS file_id FROM n) SELECT file_id, type, count(*) AS node_count FROM x GROUP BY ROLLUP(file_id, type)")
def org_file_distribution(spark: SparkSession, d: str) -> DataFrame:
    return G.file_distribution(G.canonical_nodes(table(spark, d, "graph_nodes")))


@query(f"WITH {_NODES} SELECT id, list_sort(list_distinct(coalesce(file_ids, []))) AS files FROM n")
def entity_file_refs(spark: SparkSession, d: str) -> DataFrame:
    return G.file_references(G.canonical_nodes(table(spark, d, "graph_nodes")))


@query(f"WITH {_NODES}, c AS (SELECT len(list_distinct(coalesce(file_ids, []))) AS k FROM n) SELECT count_if(k = 1)::BIGINT AS single_file, count_if(k > 1)::BIGINT AS multi_file, coalesce(max(k), 0)::INT AS max_files, count_if(k > 1) / greatest(1, count_if(k >= 1))::DOUBLE AS shared_ratio FROM c")
def shared_node_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.shared_stats(G.canonical_nodes(table(spark, d, "graph_nodes")))


# ---------------------------------------------------------------- lookups


@query(f"WITH {_EDGES} SELECT e.source, e.target AS id, n.type, n.content, e.relationship_type FROM e JOIN n ON n.id = e.target JOIN n s ON s.id = e.source WHERE s.type = 'T'")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return G.neighbours(nodes, edges, G.nodes_of_type(nodes, "t"))


_PHRASES = "q AS (SELECT DISTINCT '  ' || content || ' ' AS query FROM graph_nodes WHERE upper(trim(type)) = 'N' AND content IS NOT NULL)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Names as a user may type them, with blanks around."""
    n = table(spark, d, "graph_nodes").where((F.upper(F.trim("type")) == "N") & F.col("content").isNotNull())
    return n.select(F.concat(F.lit("  "), "content", F.lit(" ")).alias("query")).distinct()


@query(f"WITH {_NODES}, {_PHRASES} SELECT query, id FROM n JOIN q ON lower(n.content) = trim(lower(q.query)) WHERE n.type = 'N'")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    return G.entity_lookup(G.canonical_nodes(table(spark, d, "graph_nodes")), _asked(spark, d))


_TOPICS = "(VALUES ('energy services'), ('energy international'), ('robotics holdings'), ('mineral associates'), ('maritime systems'), ('single')) AS q(query)"


@query(f"WITH {_NODES} SELECT query, id FROM n JOIN {_TOPICS} ON regexp_matches(lower(n.content), '\\b' || replace(q.query, ' ', '\\s+') || '\\b') WHERE n.type = 'N' AND query LIKE '% %' AND query NOT IN (SELECT lower(content) FROM n WHERE type = 'N')")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([(x,) for x in ("energy services", "energy international", "robotics holdings", "mineral associates", "maritime systems", "single")], "query string")
    return G.phrase_match(G.canonical_nodes(table(spark, d, "graph_nodes")), q)


# ---------------------------------------------------------------- graph analytics

_BOTH = f"{_EDGES}, u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e)"


@query(f"WITH RECURSIVE {_BOTH}, r(id, c) AS (SELECT id, id FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id) SELECT id, min(c) AS component FROM r GROUP BY id")
def components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(*_graph(spark, d))


@query(f"WITH {_EDGES}, d AS (SELECT id, count(x) AS degree FROM n LEFT JOIN (SELECT source AS x FROM e UNION ALL SELECT target FROM e) ON x = id GROUP BY id) SELECT id, round(degree / greatest(1, max(degree) OVER ())::DOUBLE, 8) AS score FROM d")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(G.degree_centrality(*_graph(spark, d)), "score", digits=8)


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1))::DOUBLE, 10) AS density")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(G.density(*_graph(spark, d)), "density", digits=10)


@query(f"WITH {_BOTH}, dg AS (SELECT a, count(*) AS d FROM u GROUP BY a), t AS (SELECT x.a, count(*) AS k FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY x.a) SELECT id, round(CASE WHEN d >= 2 THEN 2 * coalesce(k, 0) / (d * (d - 1))::DOUBLE ELSE 0 END, 8) AS coefficient FROM n LEFT JOIN dg ON dg.a = id LEFT JOIN t ON t.a = id")
def clustering_coefficient(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(G.clustering(*_graph(spark, d)), "coefficient", digits=8)


_STAR_N = "sn AS (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier)"
_STAR_E = "se AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def _ppr_sql(nodes: str, edges: str, seeds: str, rounds: int) -> str:
    return f"""WITH RECURSIVE {nodes}, {edges},
  tw AS (SELECT s, d, count(*) * 0.5 AS w FROM (SELECT DISTINCT source AS s, target AS d FROM ge WHERE source <> target UNION ALL SELECT DISTINCT target, source FROM ge WHERE source <> target) GROUP BY s, d),
  m AS (SELECT s, d, w / sum(w) OVER (PARTITION BY s) AS p FROM tw),
  lone AS (SELECT id FROM gn WHERE id NOT IN (SELECT s FROM m)), cnt AS (SELECT count(*)::DOUBLE AS k FROM gn),
  seed AS (SELECT id AS n, coalesce(w, 0) / (SELECT sum(w) FROM ({seeds}) WHERE i IN (SELECT id FROM gn)) AS v FROM gn LEFT JOIN ({seeds}) ON i = id),
  r(it, n, v) AS (SELECT 0, n, v::DOUBLE FROM seed UNION ALL
    SELECT any_value(it) + 1, n, sum(v) FROM (
      SELECT r.it, m.d AS n, 0.85 * r.v * m.p AS v FROM r JOIN m ON m.s = r.n WHERE r.it < {rounds}
      UNION ALL SELECT x.it, gn.id, 0.85 * (x.t - CASE WHEN gn.id IN (SELECT id FROM lone) THEN coalesce(o.v, 0) ELSE 0 END) / ((SELECT k FROM cnt) - 1) FROM (SELECT it, sum(v) AS t FROM r WHERE n IN (SELECT id FROM lone) AND it < {rounds} GROUP BY it) x CROSS JOIN gn LEFT JOIN r o ON o.n = gn.id AND o.it = x.it
      UNION ALL SELECT x.it, seed.n, 0.15 * seed.v FROM seed, (SELECT DISTINCT it FROM r WHERE it < {rounds}) x
    ) GROUP BY n)
SELECT n AS id, round(v, 8) AS score FROM r WHERE it = {rounds}"""


def _star(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, d, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = t("region").select(key("r", "r_regionkey").alias("id")).union(t("nation").select(key("n", "n_nationkey"))).union(t("customer").select(key("c", "c_custkey"))).union(t("supplier").select(key("s", "s_suppkey")))
    edges = t("nation").select(key("n", "n_nationkey").alias("source"), key("r", "n_regionkey").alias("target"))
    edges = edges.union(t("customer").select(key("c", "c_custkey"), key("n", "c_nationkey"))).union(t("supplier").select(key("s", "s_suppkey"), key("n", "s_nationkey")))
    return nodes, edges


def _seeds(spark: SparkSession, *rows: tuple[str, float]) -> DataFrame:
    return spark.createDataFrame(list(rows), "id string, weight double")


@query(_ppr_sql(_STAR_N + ", gn AS (SELECT id FROM sn)", _STAR_E + ", ge AS (SELECT * FROM se)", "SELECT 'c1' AS i, 1.0 AS w", 20))
def ppr_star_schema(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ppr.pagerank(*_star(spark, d), _seeds(spark, ("c1", 1.0)), max_iter=20, tol=None), "score", digits=8)


@query(_ppr_sql(_STAR_N + ", gn AS (SELECT id FROM sn)", _STAR_E + ", ge AS (SELECT * FROM se)", "SELECT * FROM (VALUES ('c1', 1.0), ('s3', 0.5), ('absent', 2.0)) AS t(i, w)", 20))
def ppr_multi_seed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ppr.pagerank(*_star(spark, d), _seeds(spark, ("c1", 1.0), ("s3", 0.5), ("absent", 2.0)), max_iter=20, tol=None), "score", digits=8)


@query(_ppr_sql(_EDGES + ", gn AS (SELECT id FROM n)", "ge AS (SELECT source, target FROM e)", "SELECT min(id) AS i, 1.0 AS w FROM n WHERE type = 'N' UNION ALL SELECT max(id), 0.7 FROM n WHERE type = 'T'", 10))
def ppr_isolated(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    seeds = nodes.where("type = 'N'").agg(F.min("id").alias("id"), F.lit(1.0).alias("weight")).union(nodes.where("type = 'T'").agg(F.max("id"), F.lit(0.7)))
    return _rounded(ppr.pagerank(nodes, edges, seeds, max_iter=10, tol=None), "score", digits=8)


@query(f"WITH RECURSIVE {_BOTH}, r(it, id, core) AS (SELECT 0, a, count(*) FROM u GROUP BY a UNION ALL SELECT it, id, list_max(list_transform(range(1, len(l) + 1), lambda i: least(i, l[i]))) FROM (SELECT any_value(x.it) + 1 AS it, x.id, list(least(y.core, x.core) ORDER BY least(y.core, x.core) DESC) AS l FROM r x JOIN u ON u.a = x.id JOIN r y ON y.id = u.b WHERE x.it < 40 GROUP BY x.id)) SELECT id, coalesce(core, 0)::BIGINT AS core FROM n LEFT JOIN (SELECT id, core FROM r WHERE it = 40) USING (id)")
def kcore(spark: SparkSession, d: str) -> DataFrame:
    return C.core_numbers(*_graph(spark, d))


@query()
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.betweenness(*_graph(spark, d)), "betweenness", digits=10)


@query()
def node_importance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.importance(*_graph(spark, d)), "importance", digits=8)


@query()
def important_entities(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return C.important_entities(nodes, cut(C.importance(nodes, edges))).select("id", "content", F.round("importance", 8).alias("importance"))


@query()
def louvain(spark: SparkSession, d: str) -> DataFrame:
    return C.communities(*_graph(spark, d))


@query(f"WITH RECURSIVE {_BOTH}, r(id, c) AS (SELECT id, id FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id), k AS (SELECT id, min(c) AS community FROM r GROUP BY id), s AS (SELECT community, count(*) OVER (PARTITION BY community) AS size, row_number() OVER (PARTITION BY community ORDER BY seq, id)::INT AS rank, id FROM k JOIN n USING (id)) SELECT community, size, rank, id FROM s WHERE rank <= 10")
def top_members(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    c = G.components(nodes, edges).withColumnRenamed("component", "community").join(nodes.select("id", "seq"), "id")
    return G.top_members(c)


# ---------------------------------------------------------------- retrieval

_NV = "e0 AS (SELECT node_id, embedding::DOUBLE[] AS v FROM noderag_embeddings WHERE " + _OK + ")"
_HITS = f"h AS (SELECT node_id AS i, max(s) AS sim FROM (SELECT node_id, {_dot('v', _Q)} / ({_norm('v')} * {_norm(_Q)}) AS s FROM e0 ORDER BY 1 - s, node_id LIMIT 12) WHERE s >= 0.1 GROUP BY node_id)"
_EXACT = "x AS (SELECT id AS i FROM n WHERE type = 'N' AND lower(content) = 'monday, 7 july')"
_SEEDS = "SELECT coalesce(h.i, x.i) AS i, CASE WHEN x.i IS NOT NULL THEN 1.0 ELSE sim END AS w FROM h FULL JOIN x ON h.i = x.i"


def _fused(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    nodes, edges = _graph(spark, d)
    hits = VS.search(table(spark, d, "noderag_embeddings"), QUESTION, 12, min_similarity=0.1)
    seeds = cut(R.personalization(hits, R.exact_matches(nodes, spark.createDataFrame([("Monday, 7 July",)], "query string"))))
    return nodes, edges, seeds, ppr.pagerank(nodes, edges, seeds, max_iter=10, tol=None)


@query(_ppr_sql(_EDGES + ", gn AS (SELECT id FROM n), " + _NV + ", " + _HITS + ", " + _EXACT, "ge AS (SELECT source, target FROM e)", _SEEDS, 10) + " ORDER BY score DESC, id LIMIT 60")
def search_fused(spark: SparkSession, d: str) -> DataFrame:
    """Vector hits and an exact match seed a random walk; the best sixty nodes."""
    nodes, _, _, scores = _fused(spark, d)
    return _rounded(scores, "score", digits=8).orderBy(F.desc("score"), "id").limit(60)


@query("SELECT doc_id, least(1.0, CASE WHEN len(t) = 0 THEN 0 ELSE list_sum(t) / len(t) END) AS confidence FROM (SELECT doc_id, list_filter([doc_id % 3 / 2.0::DOUBLE, 0.0, doc_id % 7 / 4.0::DOUBLE, 0.25, NULL], lambda x: x <> 0) AS t FROM documents)")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    s = F.array(F.col("doc_id") % 3 / F.lit(2.0), F.lit(0.0), F.col("doc_id") % 7 / F.lit(4.0), F.lit(0.25), F.lit(None).cast("double"), F.lit(9.0))
    return table(spark, d, "documents").select("doc_id", T.confidence(s).alias("confidence"))


# ---------------------------------------------------------------- maintenance and state

_FILE = "file_00_000100"


@query(f"WITH {_NODES} SELECT id, list_filter(list_distinct(file_ids), lambda f: f <> '{_FILE}') IS NOT NULL AS has_files, len(list_filter(coalesce(file_ids, []), lambda f: f <> '{_FILE}'))::INT AS n_files FROM n WHERE NOT (len(list_distinct(coalesce(file_ids, []))) = 1 AND list_contains(file_ids, '{_FILE}'))")
def clear_file(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    left, _, _ = M.clear_file(nodes, edges, _FILE)
    return left.select("id", F.col("file_ids").isNotNull().alias("has_files"), F.size(F.coalesce("file_ids", F.array().cast("array<string>"))).alias("n_files"))


@query(f"WITH {_EDGES}, gone AS (SELECT id FROM n WHERE len(list_distinct(coalesce(file_ids, []))) = 1 AND list_contains(file_ids, '{_FILE}')) SELECT (SELECT count(*) FROM gone) AS removed, (SELECT count(*) FROM n WHERE list_contains(file_ids, '{_FILE}')) - (SELECT count(*) FROM gone) AS preserved, (SELECT count(*) FROM e WHERE source IN (SELECT id FROM gone) OR target IN (SELECT id FROM gone)) AS edges_removed")
def clear_file_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.clear_file(*_graph(spark, d), _FILE)[2]


@query(f"WITH {_NODES}, k AS (SELECT CASE WHEN type = 'N' THEN 'N|' || lower(coalesce(content, id)) ELSE 'I|' || id END AS k, id, type, seq, file_ids, CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS o FROM n), f AS (SELECT k, id, type, seq FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY o, seq, id) = 1), g AS (SELECT k, list_sort(list(DISTINCT x)) AS file_ids FROM (SELECT k, unnest(file_ids) AS x FROM k) GROUP BY k) SELECT f.id, f.type, g.file_ids FROM f LEFT JOIN g USING (k)")
def merge_file(spark: SparkSession, d: str) -> DataFrame:
    nodes = cut(G.canonical_nodes(table(spark, d, "graph_nodes")))
    return M.merge_file(nodes.where("seq % 2 = 0"), nodes.where("seq % 2 != 0")).select("id", "type", "file_ids")


@query("WITH new AS (SELECT * FROM noderag_embeddings WHERE id % 5 = 0), t AS (SELECT DISTINCT org_id, file_id FROM new), kept AS (SELECT o.* FROM noderag_embeddings o WHERE id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM t WHERE t.org_id = o.org_id AND t.file_id = o.file_id)), a AS (SELECT 0 AS b, id, node_id, content FROM kept UNION ALL SELECT 1, id, node_id, content FROM new) SELECT id, node_id, sha256(substr(content, 1, 2000)) AS h FROM a QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY b DESC, id DESC) = 1")
def upsert_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "noderag_embeddings").select("id", "node_id", "org_id", "file_id", "content")
    return M.upsert_embeddings(e.where("id % 5 != 0"), e.where("id % 5 = 0")).select("id", "node_id", F.sha2("content", 256).alias("h"))


@query("WITH seen AS (SELECT doc_id, sha256(text) AS h, length(text) AS z, doc_id % 11 <> 0 AS ok FROM documents WHERE doc_id % 4 <> 0), cur AS (SELECT doc_id, sha256(CASE WHEN doc_id % 6 = 0 THEN text || '!' ELSE text END) AS h, length(text) AS z FROM documents) SELECT cur.doc_id, CASE WHEN seen.doc_id IS NULL THEN 'new' WHEN NOT ok THEN 'failed' ELSE 'changed' END AS reason FROM cur LEFT JOIN seen USING (doc_id) WHERE seen.doc_id IS NULL OR NOT ok OR cur.h IS DISTINCT FROM seen.h OR cur.z IS DISTINCT FROM seen.z")
def changed_documents(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text")
    cols = lambda c: [F.sha2(F.encode(c, "UTF-8"), 256).alias("sha256"), F.length("text").alias("size"), F.lit(0).alias("mtime")]
    seen = t.where("doc_id % 4 != 0").select("doc_id", *cols(F.col("text")), (F.col("doc_id") % 11 != 0).alias("success"))
    cur = t.select("doc_id", *cols(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return M.changed_documents(seen, cur, "doc_id")


@query("SELECT count(*) AS total, count_if(s = 'completed')::BIGINT AS completed, count_if(s = 'failed')::BIGINT AS failed, count_if(s IN ('pending','processing'))::BIGINT AS open, coalesce(sum(node_count), 0)::BIGINT AS nodes, round(avg(processing_time) FILTER (s = 'completed'), 6) AS mean_time, round(count_if(s = 'completed') / greatest(1, count(*))::DOUBLE * 100, 6) AS success_rate FROM (SELECT *, lower(trim(processing_status)) AS s FROM noderag_file_processing)")
def processing_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.processing_stats(table(spark, d, "noderag_file_processing")), "mean_time", "success_rate")


@query("SELECT file_id, org_id, node_type, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at FROM noderag_embeddings GROUP BY ALL ORDER BY last_at DESC, file_id, org_id, node_type LIMIT 50")
def embedding_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.embedding_summary(table(spark, d, "noderag_embeddings"))


@query("SELECT org_id, file_id, count(*) AS n_rows, count(DISTINCT node_id) AS n_nodes FROM noderag_embeddings GROUP BY org_id, file_id")
def file_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.file_stats(table(spark, d, "noderag_embeddings"))


@query("SELECT org_id, file_id, id, lower(processing_status) AS status FROM noderag_file_processing QUALIFY row_number() OVER (PARTITION BY org_id, file_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "noderag_file_processing").select("org_id", "file_id", "created_at", "id", F.lower("processing_status").alias("status"))
    return M.latest(s, ["org_id", "file_id"], ["created_at", "id"]).select("org_id", "file_id", "id", "status")


@query("SELECT id, org_id, file_id FROM noderag_embeddings e WHERE NOT EXISTS (SELECT 1 FROM noderag_file_processing p WHERE p.org_id = e.org_id AND p.file_id = e.file_id AND lower(processing_status) = 'completed')")
def idempotent_ingest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "noderag_embeddings").select("id", "org_id", "file_id")
    return M.unprocessed(e, table(spark, d, "noderag_file_processing")).select("id", "org_id", "file_id")


@query("SELECT id, org_id FROM noderag_embeddings WHERE NOT (coalesce(org_id, '') = 'org-halden')")
def delete_org(spark: SparkSession, d: str) -> DataFrame:
    return M.delete_files(table(spark, d, "noderag_embeddings"), "org-halden").select("id", "org_id")


@query("WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) AS last_seen, count(*) AS n_events FROM s GROUP BY user_id, k")
def sessionize_events(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import sessions

    return sessions(table(spark, d, "events"), "user_id", "ts", "event_id", hours=24)


# ---------------------------------------------------------------- drawing


@query(f"WITH {_EDGES}, d AS (SELECT id, count(x) AS degree FROM n LEFT JOIN (SELECT source AS x FROM e UNION ALL SELECT target FROM e) ON x = id GROUP BY id), s AS (SELECT id, degree / greatest(1, max(degree) OVER ())::DOUBLE AS score FROM d) SELECT id, n.type, round(score, 8) AS score, round(10 + score * 40, 6) AS size FROM s JOIN n USING (id) ORDER BY s.score DESC, id LIMIT 300")
def viz_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    v = viz.viz_nodes(nodes, G.degree_centrality(nodes, edges), 300)
    return v.select("id", "type", F.round("score", 8).alias("score"), F.round("size", 6).alias("size"))


@query(f"WITH {_EDGES}, d AS (SELECT id, count(x) AS degree FROM n LEFT JOIN (SELECT source AS x FROM e UNION ALL SELECT target FROM e) ON x = id GROUP BY id), s AS (SELECT id FROM d ORDER BY degree DESC, id LIMIT 300) SELECT source, target, relationship_type, weight FROM e WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)")
def viz_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    drawn = cut(viz.viz_nodes(nodes, G.degree_centrality(nodes, edges), 300))
    return viz.viz_edges(drawn, edges)


@query(f"WITH RECURSIVE {_BOTH}, r(id, c) AS (SELECT id, id FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id), comp AS (SELECT count(DISTINCT c) AS k FROM (SELECT id, min(c) AS c FROM r GROUP BY id)), dg AS (SELECT a, count(*) AS d FROM u GROUP BY a), t AS (SELECT x.a, count(*) AS k FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY x.a), cl AS (SELECT avg(CASE WHEN d >= 2 THEN 2 * coalesce(k, 0) / (d * (d - 1))::DOUBLE ELSE 0 END) AS a FROM n LEFT JOIN dg ON dg.a = id LEFT JOIN t ON t.a = id) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1))::DOUBLE, 10) AS density, (SELECT k FROM comp) AS components, round((SELECT a FROM cl), 10) AS average_clustering")
def viz_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(viz.viz_stats(*_graph(spark, d)), "density", "average_clustering", digits=10)
