"""The service surface as plain functions over a workspace of Parquet tables.

A workspace holds, for each organisation, nodes, edges, embeddings and the state log.
Functions return DataFrames or small dicts; nothing here talks to a network.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import augment as A, centrality as C, chunking, extract, graph as G, maintenance as M, retrieval as R, vector_search as VS, viz
from ..runtime import complete_versions, cut
from ..sources.files import ALLOWED
from ..sources.records import ingest_chunks
from ..streaming.ingest import can_resume, queue_stats, read_table, replace_table, run_pipeline, upsert_table

#: What callers are told of a file (fixed values).
STATES = ("processing", "skipped", "completed", "failed")


class Workspace:
    """The tables of one installation under ``root``, on any file system that Spark reads.

    Writes of one organisation follow one another: callers in one process wait for each
    other; between processes one writer is expected (as one streaming job is).
    """

    def __init__(self, spark: SparkSession, root: str, width: int = 64) -> None:
        self.spark, self.root, self.width = spark, root.rstrip("/"), width
        self._locks: dict[str, threading.RLock] = {}
        self._guard = threading.RLock()

    def _turn(self, org_id: str) -> threading.RLock:
        # tables are shared by all organisations, so the tables' turn is taken as well
        with self._guard:
            return self._locks.setdefault("", threading.RLock())

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _write(self, name: str, df: DataFrame) -> None:
        """A new version; readers take the last complete one."""
        replace_table(self.spark, df, self._path(name))

    def read(self, name: str) -> DataFrame | None:
        return read_table(self.spark, self._path(name))

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version}

    def config(self) -> dict:
        """The settings that results depend on."""
        return {"chunk_size": 1536, "chunk_overlap": 75, "units": extract.MAX_UNITS, "entities": extract.MAX_ENTITIES, "relations": extract.MAX_RELATIONS, "width": self.width, "quotas": dict(R.QUOTAS), "types": list(G.TYPES)}

    @staticmethod
    def accepts(filename: str) -> bool:
        return filename.lower().endswith(ALLOWED)

    def _report(self, webhook: Callable[[str, str], None] | None, file: str, status: str) -> None:
        """Tell the caller; what goes wrong there stays there."""
        if webhook is not None:
            try:
                webhook(file, status)
            except Exception:
                pass

    def process(self, org_id: str, chunks: DataFrame, webhook: Callable[[str, str], None] | None = None, callback: Callable[[dict], None] | None = None) -> dict:
        """Index chunk rows ``file_id, chunk_index, content`` of an organisation; files completed before are skipped.

        New nodes merge with what earlier requests stored: one node an entity name. ``webhook``
        hears (file, status), ``callback`` the whole result; errors of both are swallowed.
        """
        with self._turn(org_id):
            return self._process(org_id, chunks, webhook, callback)

    def _process(self, org_id: str, chunks: DataFrame, webhook: Callable | None, callback: Callable | None) -> dict:
        asked = cut(ingest_chunks(chunks).withColumn("org_id", F.lit(org_id)))
        state = self.read("state")
        rows = asked if state is None else cut(M.unprocessed(asked, state))
        files = [r[0] for r in rows.select("file_id").distinct().collect()]  # files of one request
        for r in asked.select("file_id").distinct().collect():
            self._report(webhook, r[0], "processing" if r[0] in files else "skipped")
        if not files:
            return {"status": "skipped", "files": 0}
        try:
            out = self._store(org_id, rows, files)
        except Exception as e:
            self._state(rows.select("org_id", F.col("file_id").cast("string").alias("file_id")).distinct().withColumns({"processing_status": F.lit("failed"), "node_count": F.lit(0).cast("bigint")}))
            for f in files:
                self._report(webhook, f, "failed")
            return {"status": "failed", "files": len(files), "error": str(e)}
        for f in files:
            self._report(webhook, f, "completed")
        if callback is not None:
            self._report(lambda _, __: callback(out | {"org_id": org_id, "file_ids": [str(f) for f in files]}), "", "")
        return out

    def _store(self, org_id: str, rows: DataFrame, files: list) -> dict:
        nodes, edges = extract.merge_entities(*(cut(x) for x in extract.chunk_graph(extract.rule_extract(rows), by_org=True)))
        nodes, edges = cut(nodes), cut(edges)
        old_n, old_e, old_v = self.read("nodes"), self.read("edges"), self.read("embeddings")
        none_n = nodes.limit(0)
        all_n, all_e = M.merge_graph(none_n if old_n is None else old_n, edges.limit(0) if old_e is None else old_e, nodes, edges)
        all_n = cut(all_n)
        all_e = cut(all_e)
        fresh = all_n.join(nodes.select("id"), "id", "left_semi")  # merged entities have their vector already
        vectors = VS.embed_texts(fresh.where(F.col("type") != "T"), "id", "content", self.width)
        e = fresh.join(vectors, "id").select(F.xxhash64("id").alias("id"), F.col("id").alias("node_id"), F.col("type").alias("node_type"), "content", "embedding", "org_id", "file_id")
        stored = cut(e if old_v is None else M.upsert_embeddings(old_v, e))
        self._write("nodes", all_n)
        self._write("edges", all_e)
        self._write("embeddings", stored)
        counts = nodes.groupBy(F.col("file_id").cast("string").alias("file_id")).agg(F.count("*").alias("node_count"))
        new = cut(rows.select("org_id", F.col("file_id").cast("string").alias("file_id")).distinct().join(counts, "file_id", "left").withColumn("processing_status", F.lit("completed")))
        self._state(new)
        stats = self.read("graphs")
        empty = self.spark.createDataFrame([], "org_id string, version bigint, processed_files array<string>")
        now = cut(M.next_versions(empty if stats is None else stats, new))
        self._write("graphs", now if stats is None else now.unionByName(stats.join(now.select("org_id"), "org_id", "left_anti")))
        return {"status": "completed", "files": len(files), "nodes": nodes.count(), "edges": edges.count(), "version": now.first()["version"]}

    def _state(self, rows: DataFrame) -> None:
        old = self.read("state")
        n = 1 if old is None else (old.agg(F.max("change")).first()[0] or 0) + 1
        new = rows.select("org_id", "file_id", "processing_status", "node_count", F.lit(n).cast("bigint").alias("change"))
        done = complete_versions(self.spark, self._path("state"))
        upsert_table(self.spark, new, self._path("state"), ["org_id", "file_id"], ["change"], int(done[-1][1:]) + 1 if done else 0)

    def augment(self, org_id: str, file_id: str | None = None) -> dict:
        """Attribute, high-level and overview nodes of the organisation, or those that a file calls for."""
        with self._turn(org_id):
            n, e = (cut(x) for x in self.graph(org_id))
            n = n.withColumn("metadata", F.lit(None).cast("string")) if "metadata" not in n.columns else n
            new_n, new_e = A.augment(n, e, org_id=org_id) if file_id is None else A.augment_new(n, e, A.current_file_entities(n, file_id), org_id)
            new_n = cut(new_n.join(n.select("id"), "id", "left_anti"))
            rows = new_n.select("id", "type", "content", F.concat(F.lit("~"), "id").alias("seq"), F.lit(org_id).alias("org_id"), F.lit(None).cast("string").alias("file_id"), F.lit(None).cast("array<string>").alias("file_ids"))
            every = M.merge_graph(self.read("nodes"), self.read("edges"), rows, new_e)
            every = [cut(x) for x in every]
            self._write("nodes", every[0])
            self._write("edges", every[1])
            return {r["type"]: r["count"] for r in new_n.groupBy("type").count().collect()}

    def run(self, org_id: str, docs: DataFrame, start: str = "INIT") -> dict:
        """All phases over documents ``file_id, text``, with the state kept in table ``pipeline``."""
        steps = {
            "DOCUMENT_DISCOVERY": lambda: {"documents": docs.count()},
            "DOCUMENT_PROCESSING": lambda: self.index_documents(org_id, docs),
            "GRAPH_AUGMENTATION": lambda: self.augment(org_id),
            "EMBEDDING_GENERATION": lambda: {"vectors": self.embed_missing(org_id)},
            "HNSW_INDEXING": lambda: self.index_stats(),
        }
        save = lambda row: self._write("pipeline", self.spark.createDataFrame([(org_id, row["phase"], row["processed"], row["total"], row["resume"])], "org_id string, phase string, processed int, total int, resume boolean"))
        return run_pipeline(steps, save, start)

    def pipeline_status(self) -> dict:
        """The stored state, or that of a run that never began."""
        rows = self.read("pipeline")
        return rows.first().asDict() if rows is not None else {"phase": "INIT", "processed": 0, "total": 0, "resume": False}

    def resume(self, org_id: str, docs: DataFrame) -> dict:
        state = self.pipeline_status()
        return self.run(org_id, docs, state["phase"]) if can_resume(state) else {"success": False, "error": "nothing to resume"}

    def embed_missing(self, org_id: str) -> int:
        """Vectors for nodes that have none yet."""
        n, v = self.graph(org_id)[0].where("type != 'T'"), self.read("embeddings")
        todo = cut(n.join(v.select(F.col("node_id").alias("id")), "id", "left_anti"))
        made = todo.join(VS.embed_texts(todo, "id", "content", self.width), "id").select(F.xxhash64("id").alias("id"), F.col("id").alias("node_id"), F.col("type").alias("node_type"), "content", "embedding", "org_id", "file_id")
        made = cut(made)
        if made.limit(1).count():
            self._write("embeddings", cut(v.unionByName(made)))
        return made.count()

    def index_stats(self) -> dict:
        return VS.index_stats(self.read("embeddings"), self.width).first().asDict()

    def rebuild_index(self, org_id: str) -> int:
        """All vectors of the organisation anew from its nodes."""
        v = self.read("embeddings")
        self._write("embeddings", cut(v.where(F.col("org_id") != org_id)))
        return self.embed_missing(org_id)

    def communities(self, org_id: str) -> DataFrame:
        n, e = self.graph(org_id)
        return G.top_members(C.communities(n, e).join(n.select("id", "seq"), "id"))

    def important(self, org_id: str, fraction: float = 0.2) -> DataFrame:
        n, e = (cut(x) for x in self.graph(org_id))
        return C.important_entities(n, C.importance(n, e), fraction)

    def knowledge_base(self, org_id: str) -> DataFrame:
        """A look at the organisation's graph: the first nodes of each type."""
        return G.sample_nodes(self.graph(org_id)[0])

    def save(self, org_id: str, path: str) -> None:
        G.save_graph(*self.graph(org_id), path)

    def drawing(self, org_id: str, types: list[str] | None = None, by_community: bool = False, most: int = viz.MAX_NODES) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges to draw: all, of some types, or coloured by community."""
        n, e = (cut(x) for x in self.graph(org_id))
        n = n if "metadata" in n.columns else n.withColumn("metadata", F.lit(None).cast("string"))
        drawn = viz.viz_nodes(n, G.degree_centrality(n, e), most, types)
        if by_community:
            c = C.communities(n, e)
            number = c.select("community").distinct().withColumn("n", F.dense_rank().over(W.orderBy("community")) - 1)
            drawn = drawn.join(c.join(number, "community").select("id", "n"), "id", "left").withColumn("colour", viz.community_colour(F.col("n"))).drop("n")
        drawn = cut(drawn)
        return drawn, viz.viz_edges(drawn, e)

    def drawing_stats(self, org_id: str) -> dict:
        return viz.viz_stats(*self.graph(org_id)).first().asDict()

    def queue(self) -> dict:
        state = self.read("state")
        return queue_stats(state).first().asDict() if state is not None else {"active": 0, "scheduled": 0, "finished": 0, "failed": 0, "total_pending": 0}

    def sessions(self) -> DataFrame | None:
        """Organisations with their graph version and files."""
        return self.read("graphs")

    def respond(self, org_id: str, question: str, k: int = 10) -> dict:
        """The nearest stored rows of the organisation, or what a walk finds if there are none."""
        walk = lambda: self._walked(org_id, question)
        return R.respond(self.read("embeddings"), VS.hash_embedding(self.width, "query")([question])[0], org_id, k, fallback=walk).first().asDict(recursive=True)

    def _walked(self, org_id: str, question: str) -> DataFrame:
        chosen = self.retrieve(org_id, question).selected
        return chosen.join(self.graph(org_id)[0].select("id", "content"), "id").select(F.col("id").alias("node_id"), "content", F.col("type").alias("node_type"), F.row_number().over(W.orderBy("rank", "id")).alias("rank"))

    def index_documents(self, org_id: str, docs: DataFrame, size: int = 1536, overlap: int = 75) -> dict:
        """Documents ``file_id, text`` cut by words and processed."""
        return self.process(org_id, chunking.chunk_words(docs, size=size, overlap=overlap).drop("start_char", "end_char", "token_count", "total_chunks"))

    def status(self, org_id: str) -> DataFrame:
        return self.read("state").where(F.col("org_id") == org_id)

    def graph(self, org_id: str) -> tuple[DataFrame, DataFrame]:
        n = self.read("nodes").where(F.col("org_id") == org_id)
        return n, G.induced(n, self.read("edges"))

    def stats(self, org_id: str) -> DataFrame:
        return G.graph_stats(*self.graph(org_id))

    def nodes(self, org_id: str, kind: str, limit: int = 100) -> DataFrame:
        return G.nodes_of_type(self.graph(org_id)[0], kind).orderBy("seq", "id").limit(limit)

    def node(self, org_id: str, node_id: str) -> DataFrame:
        return G.node_detail(*self.graph(org_id), node_id)

    def search_entities(self, org_id: str, names: Sequence[str]) -> DataFrame:
        q = self.spark.createDataFrame([(x,) for x in names], "query string")
        n, _ = self.graph(org_id)
        return G.entity_lookup(n, q).union(G.phrase_match(n, q)).distinct()

    def search_vector(self, org_id: str, text: str, k: int = 10) -> DataFrame:
        return VS.search(self.read("embeddings"), VS.hash_embedding(self.width)([text])[0], k, org_id=org_id)

    def retrieve(self, org_id: str, question: str, k: int = 10) -> R.RetrievalResult:
        n, e = self.graph(org_id)
        v = VS.hash_embedding(self.width)([question])[0]
        return R.retrieve(n, e, self.read("embeddings"), v, R.decompose(question), k, threshold=0.1, org_id=org_id)

    def answer(self, org_id: str, question: str, model: Callable[[str, str], str] | None = None, k: int = 10, history: Sequence[dict[str, str]] | None = None, reword: Callable[[str, str], str] | None = None) -> dict:
        """Context, sources and an answer: the context itself unless a model is given."""
        question = R.reformulate(question, history, reword)
        r = self.retrieve(org_id, question, k)
        text = r.context.first()[0]
        reply = model(question, text) if model else text
        used = {"query_tokens": len(question.split()), "response_tokens": len(reply.split())}
        return {"answer": reply, "context": text, "sources": [x[0] for x in r.sources.collect()], "usage": used}  # bounded by the selection

    def delete(self, org_id: str, file_ids: Sequence[str] | None = None) -> dict:
        """Remove files, or with none named the whole organisation; the graph keeps what other files share."""
        with self._turn(org_id):
            return self._delete(org_id, file_ids)

    def _delete(self, org_id: str, file_ids: Sequence[str] | None) -> dict:
        before = self.read("embeddings").count()
        self._write("embeddings", M.delete_files(self.read("embeddings"), org_id, list(file_ids) if file_ids is not None else None))
        graphs = self.read("graphs")
        if graphs is not None and file_ids is None:
            self._write("graphs", M.delete_files(graphs, org_id))
        n, e = self.read("nodes"), self.read("edges")
        if file_ids is None:
            n = M.delete_files(n, org_id)
            e = G.induced(n, e)
        else:
            for f in file_ids:
                mine = n.where(F.col("org_id") == org_id)
                left, _, _ = M.clear_file(mine, e, f)
                n = n.where(F.col("org_id") != org_id).unionByName(left)
            n = cut(n)
            e = G.induced(n, e)
        self._write("nodes", n)
        self._write("edges", e)
        self._write("state", M.delete_files(self.read("state"), org_id, list(file_ids) if file_ids is not None else None))
        return {"deleted_embeddings": before - self.read("embeddings").count()}
