"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

import datetime as dt

import pytest

from loomgraph.llm import queries as Q

LONG = "The legal unit audited the annual contract, and nobody objected. " * 3000
SCHEMAS = {
    "noderag_embeddings": "id bigint, node_id string, node_type string, content string, embedding array<float>, org_id string, file_id string, user_id string, chunk_index int, graph_metadata string, created_at timestamp, updated_at timestamp, set_id string, items int, cosine double",
    "noderag_file_processing": "id bigint, org_id string, file_id string, file_hash string, processing_status string, node_count int, processing_time double, created_at timestamp, completed_at timestamp, d string",
    "document_chunks": "chunk_key bigint, org_id string, file_id string, chunk_index int, content string, start_char int, end_char int, token_count int, metadata string, heads string, piece int",
    "graph_nodes": "id string, type string, content string, metadata string, file_ids array<string>, seq bigint, kind string, root string, component bigint",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, title string, doc_format string, created_at timestamp, size int, salt int",
    "eval_items": "item_id bigint, text string, lang string, suite string, split_name string",
}
T0 = dt.datetime(2024, 1, 1)
WORDS = " ".join(f"word{i}" for i in range(40))
V = [1.0] * 64
ROWS = {
    "noderag_embeddings": [(1, "a", "T", WORDS, V), (2, "a", "T", WORDS, V), (3, "b", "T", WORDS + " more", V), (4, "c", None, LONG, [0.0] * 64), (5, None, None, None, None), (6, "d", "T", "", []), (7, "e", "T", WORDS, [float("nan")] * 64), (8, "f", "S", "short", [0.5] * 32), (9, "g", "S", None, [None] * 64), (10, "h", "S", LONG, [2.0] * 64), (None, None, None, None, None)],
    "noderag_file_processing": [(1, "o", "f1", "AB" * 32), (2, "o", "f2", "ab" * 32), (2, "o", "f2", "ab" * 32), (3, None, None, "ab" * 32), (4, "o", "f3", None), (5, "o", "f4", "0" * 64), (6, "o", "f5", "n/a"), (7, "o", "f6", "q6urq6urq6urq6urq6urq6urq6urq6urq6urq6urq6s=")],
    "document_chunks": [(1, "o", "f", 0, LONG, 0, len(LONG)), (2, "o", "f", 1, "", None, None), (3, "o", "f", 2, None, None, None), (4, None, None, None, "x " * 600, None, None), (5, "o", "f", 3, "Annual budget of Vomo   3\nThe harbour board audi-\nted it.\n\fAnnual budget of Vomo   4\nIt was done.", 0, 10), (5, "o", "f", 3, "Annual budget of Vomo   3\nThe harbour board audi-\nted it.\n\fAnnual budget of Vomo   4\nIt was done.", 0, 10), (None, None, None, None, None, None, None)],
    "graph_nodes": [("n1", "N", "Dr. Robert Fezapavi", '{"entity_kind": "PERSON"}', ["f"], 1), ("n2", "n", "Fezapavi, Bob", '{"entity_kind": "PERSON"}', None, 2), ("n2", "n", "Fezapavi, Bob", '{"entity_kind": "PERSON"}', None, 3), ("n3", "N", "  ", '{"entity_kind": "ORG"}', None, 4), ("n4", "N", None, None, None, None), (None, None, None, None, None, None), ("n5", "N", "?!", '{"entity_kind": "ORG"}', None, 5), ("n6", "N", LONG, '{"entity_kind": "PERSON"}', None, 6), ("n7", "N", "x", "not json", None, 7)],
    "documents": [(1, LONG), (2, None), (3, ""), (4, "   \n\n "), (5, "One. Two? 三。四！"), (5, "One. Two? 三。四！"), (6, "x" * 50000), (None, None), (7, "." * 3000), (8, '"“«„((' * 50)],
    "eval_items": [(1, LONG[:800]), (2, None), (3, ""), (4, "too short"), (4, "too short")],
}


def write(spark, folder, empty):
    for name, schema in SCHEMAS.items():
        width = len(schema.replace("array<", "").split(", "))
        rows = [] if empty else [tuple(r) + (None,) * (width - len(r)) for r in ROWS[name]]
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("dirty"), False)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), True)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert Q.QUERIES[name](spark, empty).count() == 0


def rows(spark, d, name):
    return {tuple(r) for r in Q.QUERIES[name](spark, d).collect()}


def test_p1(spark, dirty):
    got = rows(spark, dirty, "p1_found")
    assert ("node", "a", "b") in got and ("node", "a", "e") in got and ("node", "c", "h") in got
    assert ("file", "f1", "f2") in got and ("file", "f1", "f6") in got
    assert not any("f4" in r or "f5" in r or None in r for r in got)
    assert rows(spark, dirty, "p1_groups")


def test_p2(spark, dirty):
    # scaled copies of one vector are equally near; zero, NaN, null and narrow vectors are out
    assert rows(spark, dirty, "p2_found") == {("a", "b"), ("a", "h"), ("b", "h")}
    assert {r[0] for r in rows(spark, dirty, "p2_nearest")} <= {"a", "b", "h"}


def test_p3(spark, dirty):
    got = rows(spark, dirty, "p3_found")
    assert (5, "hyphen", "audited") in got and (5, "header", "Annual budget of Vomo   3") in got
    assert {r[0] for r in got} == {5}
    text = dict(rows(spark, dirty, "p3_text"))
    assert text[5] == "The harbour board audited it. It was done." or "audited" in text[5]


def test_p4(spark, dirty):
    assert rows(spark, dirty, "p4_found") == {("n1", "n2")}
    assert {r[0] for r in rows(spark, dirty, "p4_entities")} == {"n1", "n2", "n5", "n6"}


def test_p5(spark, dirty):
    assert {r[0] for r in rows(spark, dirty, "p5_found")} == {1, 4}
    assert rows(spark, dirty, "p5_pieces")


def test_p6(spark, dirty):
    got = Q.QUERIES["p6_packing"](spark, dirty).collect()
    assert all((r["container"] is None) == (r["n_tokens"] == 0) for r in got)


def test_p7(spark, dirty):
    assert rows(spark, dirty, "p7_found") == {(1, 1)}
    assert Q.QUERIES["p7_spans"](spark, dirty).count() >= 1


def test_p8(spark, dirty):
    got = rows(spark, dirty, "p8_found")
    assert {(5, 0, 4), (5, 5, 9), (5, 10, 12), (5, 12, 14)} <= got
    assert not {2, 3, 4} & {r[0] for r in got}


def test_short_words_in_a_crowd_of_companions(spark, monkeypatch):
    from itertools import product

    from loomgraph.llm import names

    crowd = ["".join(w) for w in product("bcdfgh", "aeiou", "klmnp")] + ["aerospace", "aero", "international", "intl", "wide", "widely", "winter", "wider", "wntr"]
    rows = [("ORG", "", f"{w}-harbour") for w in crowd]
    for block in (names.MEET_WORDS, 3):
        monkeypatch.setattr(names, "MEET_WORDS", block)
        got = names._short_words(spark.createDataFrame(rows, "kind string, initial string, root string")).collect()
        assert {(r["root"], r["better"]) for r in got} == {(f"{a}-harbour", f"{b}-harbour") for a, b in (("aero", "aerospace"), ("intl", "international"), ("wide", "widely"), ("wntr", "winter"))}
