"""Queries of this subpackage: one or more for each problem, with SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import cut, table
from . import knn, leak, names, neardup, packing, scanned, sentences, splitting


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, pairs = neardup.near_duplicates(table(spark, sf_dir, "noderag_embeddings"), "node_id", "content")
    nodes = neardup.node_pairs(members, pairs).select(F.lit("node").alias("rec_kind"), "key_a", "key_b")
    files = neardup.same_files(table(spark, sf_dir, "noderag_file_processing"))
    return nodes.union(files.select(F.lit("file"), "key_a", "key_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a stored node of 32 words or more: its class of equal sets, its group, its links."""
    members, pairs = neardup.near_duplicates(table(spark, sf_dir, "noderag_embeddings"), "node_id", "content")
    return neardup.groups(members, cut(pairs))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.similar_vectors(table(spark, sf_dir, "noderag_embeddings")).select("node_id_a", "node_id_b")


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar nodes of every row whose id is divisible by 100, against all rows."""
    rows = table(spark, sf_dir, "noderag_embeddings")
    return knn.nearest_of(rows.where(F.col("id") % 100 == 0), rows)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.findings(table(spark, sf_dir, "document_chunks"))[0]


def p3_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repair(table(spark, sf_dir, "document_chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_pairs(names.link_names(table(spark, sf_dir, "graph_nodes")))


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.link_names(table(spark, sf_dir, "graph_nodes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "document_chunks")).select("chunk_key").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_chunks(table(spark, sf_dir, "document_chunks"))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every packing: all documents come out, no container overflows, only what exceeds a container is split."""
    got = cut(packing.pack_documents(table(spark, sf_dir, "documents")))
    fill = got.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    of = got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    over = fill.agg(F.count_if(F.col("n") > 2048).alias("overfull"))
    return of.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= 2048)).alias("split_short")).where("documents > 0").join(over, F.lit(True))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leak.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.removal_spans(leak.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_nearest": p2_nearest, "p3_found": p3_found, "p3_text": p3_text, "p4_found": p4_found, "p4_entities": p4_entities, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_packing": p6_packing, "p6_invariants": p6_invariants, "p7_found": p7_found, "p7_spans": p7_spans, "p8_found": p8_found}
ORACLE: dict[str, str] = {
    "p1_found": """
        WITH t AS (SELECT DISTINCT node_id, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM noderag_embeddings WHERE content IS NOT NULL),
        b AS (SELECT node_id, w, row_number() OVER () AS r FROM t WHERE len(w) >= 32),
        g AS (SELECT DISTINCT r, node_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM b),
        s AS (SELECT r, count(*) AS n FROM g GROUP BY r),
        j AS (SELECT x.r AS a, y.r AS b, x.node_id AS na, y.node_id AS nb, count(*) AS c FROM g x JOIN g y ON x.p = y.p AND x.node_id < y.node_id GROUP BY ALL),
        d AS (SELECT DISTINCT file_id, CASE WHEN regexp_full_match(lower(file_hash), '[0-9a-f]{64}') THEN lower(file_hash)
            WHEN regexp_full_match(file_hash, '[A-Za-z0-9+/_-]{43}=?') THEN lower(hex(from_base64(replace(replace(rtrim(file_hash, '='), '-', '+'), '_', '/') || '='))) END AS d FROM noderag_file_processing)
        SELECT DISTINCT 'node' AS rec_kind, na AS key_a, nb AS key_b FROM j JOIN s sa ON sa.r = a JOIN s sb ON sb.r = b WHERE c / (sa.n + sb.n - c)::DOUBLE >= 0.6
        UNION ALL SELECT DISTINCT 'file', x.file_id, y.file_id FROM d x JOIN d y ON x.d = y.d AND x.file_id < y.file_id WHERE NOT regexp_full_match(x.d, '0{64}')
    """,
    "p2_found": """
        WITH v AS (SELECT node_id, any_value(embedding::DOUBLE[64]) AS e FROM noderag_embeddings WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY node_id),
        p AS (SELECT x.node_id AS a, y.node_id AS b, array_cosine_similarity(x.e, y.e) AS c FROM v x JOIN v y ON x.node_id <> y.node_id WHERE c >= 0.9),
        r AS (SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) <= 5)
        SELECT DISTINCT least(a, b) AS node_id_a, greatest(a, b) AS node_id_b FROM r
    """,
    "p6_invariants": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS split_short, 0::BIGINT AS overfull FROM documents",
    "p5_found": r"""
        SELECT chunk_key FROM document_chunks
        WHERE len(regexp_extract_all(content, '[\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]|[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]+')) > 512
    """,
}
