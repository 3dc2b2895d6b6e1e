import json

from loomgraph.plans.service import Workspace
from loomgraph.streaming import ingest as I


def test_ingest_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps(x) for x in [{"k": "a", "v": 1}, {"k": "b", "v": 1}]))
    s = I.chunk_stream(spark, str(src), "k string, v int")
    I.ingest(s, str(out), str(tmp_path / "cp"), ["k"], ["v"]).awaitTermination()
    (src / "2.json").write_text(json.dumps({"k": "a", "v": 5}))
    I.ingest(s, str(out), str(tmp_path / "cp"), ["k"], ["v"]).awaitTermination()
    assert {tuple(r) for r in I.read_table(spark, str(out)).collect()} == {("a", 5), ("b", 1)}
    I.upsert_table(spark, spark.createDataFrame([("a", 9)], "k string, v int"), str(out), ["k"], ["v"], 0)
    assert I.read_table(spark, str(out)).where("v = 9").count() == 0


def test_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00", 1), (1, "2024-01-01 23:00:00", 2), (1, "2024-01-03 00:00:00", 3), (None, "2024-01-01 00:00:00", 4), (2, None, 5)]
    e = spark.createDataFrame(rows, "u int, t string, id int").selectExpr("u", "cast(t as timestamp) as t", "id")
    got = sorted((r["u"] or 0, r["n_events"]) for r in I.sessions(e, "u", "t", "id").collect())
    assert got == [(0, 1), (1, 1), (1, 2)]


def test_document_states(spark, tmp_path):
    src = tmp_path / "ev"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"path": p, "event": e}) for p, e in [("a", "start"), ("a", "fail"), ("b", "start")]))
    s = spark.readStream.schema("path string, event string").json(str(src))
    q = I.document_states(s).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("states").collect()} == {("a", "failed", 1), ("b", "processing", 1)}


def test_service(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"))
    docs = spark.createDataFrame([("f1", "Acme bought Globex last year. Globex makes turbines."), ("f2", "Initech sued Acme in court.")], "file_id string, text string")
    assert ws.index_documents("o", docs)["files"] == 2
    assert ws.index_documents("o", docs)["status"] == "skipped"
    assert ws.stats("o").first()["total_nodes"] > 5
    assert {r["query"] for r in ws.search_entities("o", ["acme", "nothing here"]).collect()} == {"acme"}
    a = ws.answer("o", "Globex makes turbines", k=5)
    assert "Globex" in a["context"] and "f1" in a["sources"]
    assert ws.delete("o", ["f1"])["deleted_embeddings"] > 0
    left = {r["content"] for r in ws.nodes("o", "N").collect()}
    assert "Initech" in left and "Globex" not in left and "Acme" in left


def test_requests_share_entities(spark, tmp_path):
    ws = Workspace(spark, "file://" + str(tmp_path / "ws"))  # a path with a scheme is no local path
    one = spark.createDataFrame([("f1", "Acme bought Globex last year.")], "file_id string, text string")
    two = spark.createDataFrame([("f2", "Initech sued Acme in court.")], "file_id string, text string")
    heard, called = [], []
    assert ws.index_documents("o", one)["version"] == 1
    got = ws.process("o", two.selectExpr("file_id", "0 as chunk_index", "text as content"), lambda f, s: heard.append((f, s)), called.append)
    assert got["version"] == 2 and heard == [("f2", "processing"), ("f2", "completed")] and called[0]["file_ids"] == ["f2"]
    acme = [r for r in ws.nodes("o", "N").collect() if r["content"] == "Acme"]
    assert len(acme) == 1 and acme[0]["file_ids"] == ["f1", "f2"]
    assert ws.graph("o")[1].where("target = source").count() == 0
    assert ws.graph("o")[1].where(f"target = '{acme[0]['id']}'").count() >= 2
    ws.index_documents("p", one)  # another organisation keeps its own
    assert ws.nodes("p", "N").count() == 2 and ws.read("graphs").count() == 2
    assert ws.respond("o", "Acme bought Globex")["total_results"] > 0 and ws.respond("q", "x")["source"] == "memory"
    assert ws.queue()["finished"] == 3 and ws.rebuild_index("p") > 0
    assert ws.augment("o")["A"] >= 1 and ws.nodes("o", "H").count() >= 1
    drawn, _ = ws.drawing("o", by_community=True)
    assert drawn.where("colour != '#CCCCCC'").count() > 0


def test_pipeline_resumes(spark, tmp_path):
    seen, saved = [], []
    steps = {"DOCUMENT_DISCOVERY": lambda: seen.append(1) or {}, "DOCUMENT_PROCESSING": lambda: 1 / 0}
    out = I.run_pipeline(steps, saved.append)
    assert not out["success"] and out["failed_phase"] == "DOCUMENT_PROCESSING" and saved[-1]["phase"] == "ERROR"
    steps["DOCUMENT_PROCESSING"] = lambda: seen.append(2) or {}
    assert I.run_pipeline(steps, saved.append, "DOCUMENT_DISCOVERY")["success"] and seen == [1, 2]
    assert saved[-1]["phase"] == "FINISHED" and not I.can_resume(saved[-1]) and I.can_resume(saved[-2])


def test_sessions_cross_weeks_and_hot_users(spark):
    import datetime as dt
    import random

    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice([None, None, 1, 2]), start + dt.timedelta(hours=rng.randrange(24 * 120)), i) for i in range(400)]
    got = sorted((r["u"] or 0, r["session_start"], r["last_seen"], r["n_events"]) for r in I.sessions(spark.createDataFrame(rows, "u int, t timestamp_ntz, id int"), "u", "t", "id").collect())
    want = []
    for u in (None, 1, 2):
        times = sorted(t for w, t, _ in rows if w == u)
        cuts = [0, *(i for i in range(1, len(times)) if times[i] - times[i - 1] > dt.timedelta(hours=24)), len(times)]
        want += [(u or 0, times[a], times[b - 1], b - a) for a, b in zip(cuts, cuts[1:])]
    assert got == sorted(want)
