import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import text as T, vectors as V
from loomgraph.operators import chunking, vector_search as VS
from loomgraph.sources import files as FS, records


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first()["x"]


def test_parsers(spark):
    assert tuple(one(spark, "a, is, part of, b", T.relation_parse)) == ("A", "is, part of", "B")
    assert one(spark, "a, b", T.relation_parse) is None
    assert one(spark, 'Sure:\n["x", " y ", ""]\nbye', T.json_list_parse) == ["x", "y"]
    assert one(spark, '- one\n- "two"\n', T.json_list_parse) == ["one", "two"]
    assert one(spark, None, T.json_list_parse) == []
    assert [tuple(x) for x in one(spark, 'x [["a","r","b"],["a","b"]] y', T.json_triples_parse)] == [("a", "r", "b")]
    assert one(spark, "broken [", T.json_triples_parse) == []
    js = lambda c: T.lenient_json(c).cast("string")
    assert one(spark, '```json\n{"a": 1}\n```', js) == '{"a":1}'
    assert one(spark, 'so {"a": 2} it is', js) == '{"a":2}' and one(spark, "nothing", js) == "{}"
    assert one(spark, "Query: what now", T.strip_reworded_prefix) == "what now"
    assert one(spark, "C++ and (so)", T.phrase_pattern).startswith("\\bc\\+\\+\\s+and")
    assert one(spark, "x" * 101, lambda c: T.shorten(c, 100)) == "x" * 100 + "..."


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [-1.0, 0.0]), (2, [1.0, 0.0], [1.0, 0.0]), (3, [0.0, 0.0], [1.0, 0.0]), (4, [1.0], [1.0, 0.0]), (5, None, [1.0, 0.0])], "id int, a array<float>, b array<float>")
    got = {r["id"]: r["c"] for r in df.select("id", V.cosine_similarity(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {1: -1.0, 2: 1.0, 3: None, 4: None, 5: None}
    hits = VS.search(df.select(F.col("id").alias("node_id"), F.col("b").alias("embedding")), [1.0, 0.0], 3)
    assert [r["node_id"] for r in hits.collect()] == [2, 3, 4]


def test_index_upkeep(spark):
    old = spark.createDataFrame([("a", [1.0, 0.0])], "node_id string, embedding array<float>")
    new = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.0, 1.0]), ("b", [0.0, 1.0]), ("c", [1.0]), ("d", [1.0, 1.0])], "node_id string, embedding array<float>")
    assert sorted(r[0] for r in VS.add_vectors(old, new, 2).collect()) == ["a", "b", "d"]
    assert VS.add_vectors(old, new, 2, capacity=2).count() == 2
    e = VS.embed_texts(spark.createDataFrame([("x", "some words"), ("y", None)], "id string, t string"), "id", "t", 16).collect()
    assert all(len(r["embedding"]) == 16 for r in e) and math.isclose(sum(v * v for v in e[0]["embedding"]), 1, rel_tol=1e-6)


@pytest.mark.parametrize("n", [0, 1, 10, 11, 30, 31])
def test_chunk_counts(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = chunking.chunk_words(spark.createDataFrame([(1, " ".join(words))], "id int, text string"), size=10, overlap=3).orderBy("chunk_index").collect()
    assert len(got) == (0 if n == 0 else 1 + math.ceil(max(0, n - 10) / 7))
    back = []
    for r in got:
        back += r["content"].split(" ")[3 if r["chunk_index"] else 0 :]
    assert back == words


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 200), st.integers(2, 30), st.integers(0, 29))
def test_token_windows(n, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            chunking.token_windows(list(range(n)), size, overlap)
        return
    w = chunking.token_windows(list(range(n)), size, overlap)
    assert w[0][0] == 0 and w[-1][1] == n and all(b[0] == a[1] - overlap for a, b in zip(w, w[1:]))


def test_chunk_tokens(spark):
    class Chars:
        def encode(self, t):
            return list(t)

        def decode(self, ids):
            return "".join(ids)

    got = chunking.chunk_tokens(spark.createDataFrame([(1, " ab cd ef "), (2, None)], "id int, t string"), "id", "t", Chars, 6, 2).collect()
    assert [(r["content"], r["start_char"]) for r in got] == [("ab cd", 0), ("cd ef", 4)]


def test_conversations(spark):
    rows = [("a", '[{"role": "User", "content": "hi"}, {"role": "system", "content": "x"}, {"role": "assistant", "content": "yo"}]'), ("b", "noise\nUser: one\nmore\nsystem: drop\nASSISTANT : two"), ("c", None), ("d", "")]
    got = records.parse_conversations(spark.createDataFrame(rows, "k string, h string"), "k", "h").orderBy("k", "turn").collect()
    assert [(r["k"], r["role"], r["content"]) for r in got] == [("a", "user", "hi"), ("a", "assistant", "yo"), ("b", "user", "one\nmore"), ("b", "assistant", "two")]


def test_json_chunks(spark):
    rows = [('{"org_id":"o","file_id":"f","user_id":"u","chunks":[{"text":"a b"},{"content":"  "},{"chunk_text":"c"}]}',), ("broken",)]
    got = records.chunks_from_json(spark.createDataFrame(rows, "value string")).collect()
    assert [(r["content"], r["token_count"], r["end_char"]) for r in got] == [("a b", 2, 3), ("c", 1, 1)]


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_text("plain é", encoding="utf-8")
    (tmp_path / "b.md").write_bytes("latin é".encode("latin-1"))
    (tmp_path / "c.txt").write_text("  ")
    (tmp_path / "e.xyz").write_text("unknown")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>One</w:t></w:p><w:p></w:p><w:p><w:t>Two</w:t></w:p></w:document>')
    f = FS.read_files(spark, [str(tmp_path), "/no/such/folder"])
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in FS.load_documents(f).collect()}
    assert got == {"a.txt": "plain é", "b.md": "latin é", "d.docx": "One\nTwo"}
    assert FS.discover(spark, ["/no/such/folder"]).count() == 0


def test_many_queries_go_in_blocks(spark):
    rows = [(i, [float(i % 5), float(i % 7), 1.0]) for i in range(30)]
    base = spark.createDataFrame(rows, "node_id bigint, embedding array<double>")
    queries = base.where("node_id < 11").withColumnRenamed("node_id", "query_id")
    got = [sorted(tuple(r) for r in VS.search_many(queries, base, 3, most_queries=m).collect()) for m in (4, 100)]
    assert got[0] == got[1] and len(got[0]) == 33


def test_approximate_search_and_rebuild(spark):
    import random

    rng = random.Random(4)
    rows = [(f"v{i:03d}", f"type{i % 3}", [rng.gauss(0, 1) for _ in range(16)]) for i in range(900)] + [("none", "x", None)]
    df = spark.createDataFrame(rows, "node_id string, node_type string, embedding array<float>")
    index = VS.sketched(df, 16)
    q = rows[5][2]
    want = [r["node_id"] for r in VS.search(df, q, 10).collect()]
    got = [r["node_id"] for r in VS.search_approx(index, q, 10).collect()]
    assert len(set(want) & set(got)) >= 9 and got[0] == "v005"
    new = df.where("node_id < 'v010'").withColumn("node_type", F.lit(None).cast("string"))
    assert {r["node_type"] for r in VS.rebuilt(df, new, 16).collect()} == {"type0", "type1", "type2"}
    assert VS.by_id(df, ["v001", "zz"]).count() == 1 and VS.by_id(df, []).count() == 0


def test_replies(spark):
    reply = '{"Output": [{"semantic_unit": "u", "entities": [" acme ", "ACME"], "relationships": ["Acme, bought, Globex", "too, short"]}, {"semantic_unit": "no lists"}]}'
    x = one(spark, reply, T.unified_extraction)
    assert x["units"] == ["u"] and x["entities"] == ["ACME"] and [tuple(t) for t in x["triples"]] == [("ACME", "bought", "GLOBEX")] and x["success"]
    bad = one(spark, '{"other": 1}', T.unified_extraction)
    assert not bad["success"] and bad["units"] == []
    fix = lambda c: T.repaired_triple(F.split(c, r"\|"))
    assert tuple(one(spark, "a||is|part of|b", fix)) == ("A", "is part of", "B") and tuple(one(spark, "", fix)) == ("", "", "")
    said = lambda c: T.repaired_triple(F.array(F.lit("x")), c)
    assert tuple(one(spark, '{"source": "a", "relationship": "r", "target": "b"}', said)) == ("A", "r", "B") and tuple(one(spark, "broken", said)) == ("X", "", "")
    assert one(spark, "Query: query: Output: what", T.strip_reworded_prefix) == "what" and one(spark, "Answer: x", T.strip_reworded_prefix) == "Answer: x"


def test_rebuilt_index_equals_its_sql(spark, tmp_path):
    from loomgraph.plans import more

    rows = [(i, f"n{i // 2 % 70:02d}" if i % 11 else None, [None, "S", "N", "A"][i % 4], [1.0] * (64 if i % 13 else 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, node_id string, node_type string, embedding array<float>")
    df.write.parquet(f"{tmp_path}/noderag_embeddings.parquet")
    want: dict = {}
    for i, node, kind, v in rows:
        if i % 3 == 0 and len(v) == 64:
            want[node] = min([x for x in (want.get(node), kind) if x is not None], default=None)
    got = more.rebuilt_index(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and dict(map(tuple, got)) == want


@pytest.mark.parametrize("most", [0, 1, 2, 37, 68, 71, 10**9])
def test_added_vectors_are_the_least_keys(spark, most):
    rows = [(f"n{i % 70:02d}" if i % 11 else None, [1.0, 0.0]) for i in range(300)]
    new = spark.createDataFrame(rows, "node_id string, embedding array<float>")
    want = sorted({r[0] or "" for r in rows})[:most]
    assert sorted(r["node_id"] or "" for r in VS.add_vectors(new.limit(0), new, 2, most).collect()) == want
