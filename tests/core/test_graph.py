"""Small graphs worked out by hand, and plain-Python versions of the iterative operators."""

import random
from collections import defaultdict, deque

import pytest

from loomgraph.operators import centrality as C, extract as X, graph as G, maintenance as M, ppr, retrieval as R, viz

NODE = "id string, type string, content string, metadata string, file_ids array<string>, seq bigint"
EDGE = "source string, target string, relationship_type string, weight double, metadata string"


def nodes(spark, ids, kind="N"):
    return spark.createDataFrame([(i, kind, i, None, None, n) for n, i in enumerate(ids)], NODE)


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "r", 1.0, None) for a, b in pairs], EDGE)


def test_path(spark):
    n, e = nodes(spark, "abcd"), edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert {r[0]: r[1] for r in C.betweenness(n, e, False).collect()} == {"a": 0, "b": 2, "c": 2, "d": 0}
    assert {r[1] for r in C.core_numbers(n, e).collect()} == {1}
    assert {r[1] for r in G.components(n, e).collect()} == {"a"}
    assert G.density(n, e).first()["density"] == 3 / 12


def test_core_numbers_settle_or_say_so(spark):
    ids = [f"v{i:02d}" for i in range(14)]
    n, e = nodes(spark, ids), edges(spark, list(zip(ids, ids[1:])))
    assert {r[1] for r in C.core_numbers(n, e).collect()} == {1}
    with pytest.raises(RuntimeError, match="settle"):
        C.core_numbers(n, e, max_rounds=2)


def cliques():
    k = [(a, b) for g in ("abcd", "wxyz") for a in g for b in g if a < b]
    return k + [("d", "w")]


@pytest.mark.parametrize("send", [10**6, 0])
def test_two_cliques(spark, send):
    n, e = nodes(spark, "abcdwxyz"), edges(spark, cliques())
    c = C.communities(n, e, send_edges=send)
    got = {r["id"]: r["community"] for r in c.collect()}
    assert all(got[x] == "a" for x in "abcd") and all(got[x] == "w" for x in "wxyz")
    assert C.modularity(e, c) > 0.4


def test_communities_are_the_same_in_a_task_and_by_joins(spark):
    pairs = random_graph(1, 12, 16)
    n, e = nodes(spark, sorted(adjacency(pairs))), edges(spark, pairs)
    one, two = ({r[0]: r[1] for r in C.communities(n, e, send_edges=send).collect()} for send in (10**6, 0))
    assert one == two and 1 < len(set(one.values())) < len(one)


def test_sampled_betweenness(spark):
    pairs = random_graph(5, 40, 80)
    n, e = nodes(spark, sorted(adjacency(pairs))), edges(spark, pairs)
    exact = {r[0]: r[1] for r in C.betweenness(n, e).collect()}
    whole = {r["id"]: (r["betweenness"], r["error"]) for r in C.betweenness_sampled(n, e, 10**6).collect()}
    assert all(abs(whole[k][0] - v) < 1e-9 and whole[k][1] == 0 for k, v in exact.items())
    some = {r["id"]: (r["betweenness"], r["error"]) for r in C.betweenness_sampled(n, e, 20).collect()}
    assert 0 < sum(abs(some[k][0] - v) for k, v in exact.items()) <= 2 * sum(e for _, e in some.values())


def test_communities_by_joins_settle_or_say_so(spark):
    n, e = nodes(spark, "abcdwxyz"), edges(spark, cliques())
    with pytest.raises(RuntimeError, match="settle"):
        C.communities(n, e, send_edges=0, most_passes=1)


def test_two_cliques_centrality(spark):
    n, e = nodes(spark, "abcdwxyz"), edges(spark, cliques())
    assert {r[1] for r in C.core_numbers(n, e).collect()} == {3}
    b = {r[0]: r[1] for r in C.betweenness(n, e).collect()}
    assert b["d"] == b["w"] == max(b.values())
    assert {r["id"] for r in C.important_entities(n, C.importance(n, e), 0.25).collect()} == {"d", "w"}


def random_graph(seed, n=24, m=50):
    rng = random.Random(seed)
    return sorted({(f"v{a:02d}", f"v{b:02d}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def adjacency(pairs):
    adj = defaultdict(set)
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    return adj


def brute_betweenness(adj):
    def paths(s):
        dist, count, q = {s: 0}, {s: 1}, deque([s])
        while q:
            v = q.popleft()
            for w in adj[v]:
                if w not in dist:
                    dist[w], count[w] = dist[v] + 1, 0
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
        return dist, count

    all_paths = {s: paths(s) for s in adj}
    out = dict.fromkeys(adj, 0.0)
    for s in adj:
        for t in adj:
            if s < t and t in all_paths[s][0]:
                for v in adj:
                    if v not in (s, t) and v in all_paths[s][0] and v in all_paths[t][0] and all_paths[s][0][v] + all_paths[t][0][v] == all_paths[s][0][t]:
                        out[v] += all_paths[s][1][v] * all_paths[t][1][v] / all_paths[s][1][t]
    return out


def test_betweenness_and_cores_equal_brute_force(spark):
    pairs = random_graph(7)
    adj = adjacency(pairs)
    n, e = nodes(spark, sorted(adj)), edges(spark, pairs)
    got = {r[0]: round(r[1], 6) for r in C.betweenness(n, e, False).collect()}
    assert got == {k: round(v, 6) for k, v in brute_betweenness(adj).items()}
    core, left, k = {}, {v: set(a) for v, a in adj.items()}, 0
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        core[v] = k
        for w in left.pop(v):
            left[w].discard(v)
    assert {r[0]: r[1] for r in C.core_numbers(n, e).collect()} == core


def test_betweenness_by_joins(spark):
    pairs = random_graph(3, 8, 12)
    adj = adjacency(pairs)
    raw = C._betweenness_joined(G.both_ways(edges(spark, pairs)), block=1)
    got = {r["id"]: round(r["raw"] / 2, 6) for r in raw.collect()}
    assert got == {k: round(v, 6) for k, v in brute_betweenness(adj).items() if k in got} and all(brute_betweenness(adj)[k] == 0 for k in adj if k not in got)


def test_reciprocal_weights(spark):
    m = {(r["src"], r["dst"]): r["p"] for r in ppr.transition(edges(spark, [("a", "b"), ("b", "a"), ("a", "c")])).collect()}
    assert abs(m["a", "b"] - 2 / 3) < 1e-12 and abs(m["a", "c"] - 1 / 3) < 1e-12


def test_isolated_mass(spark):
    n, e = nodes(spark, "abc"), edges(spark, [("a", "b")])
    s = spark.createDataFrame([("c", 1.0)], "id string, weight double")
    assert abs(sum(r[1] for r in ppr.pagerank(n, e, s, max_iter=6, tol=None).collect()) - 1) < 1e-9
    assert sum(r[1] for r in ppr.pagerank(n, e, s, max_iter=6, tol=None, modified=False).collect()) < 0.2
    none = spark.createDataFrame([("zz", 1.0)], "id string, weight double")
    assert abs(sum(r[1] for r in ppr.pagerank(n, e, none, max_iter=6).collect()) - 1) < 1e-9


def test_self_loops_and_missing_ends(spark):
    n = G.canonical_nodes(nodes(spark, "ab"))
    assert G.valid_edges(n, edges(spark, [("a", "a"), ("a", "missing"), ("a", "b")])).count() == 1


def test_fold(spark):
    e = spark.createDataFrame([("a", "b", "r1", None, 1), ("a", "b", "r2", 2.0, 2), ("a", "b", "r1", 3.0, 3), ("c", "d", "r1", 1.0, 1), ("c", "d", "r1", 1.0, 2)], "source string, target string, relationship_type string, weight double, seq int")
    got = {(r["source"], r["target"]): (r["relationship_type"], r["weight"]) for r in X.fold_edges(e, ["seq"]).collect()}
    assert got == {("a", "b"): ("r1; r2; r1", 1.0), ("c", "d"): ("r1", 1.0)}


def test_entity_key_is_not_trimmed(spark):
    n = spark.createDataFrame([("1", "N", "Acme", 1), ("2", "N", "ACME", 2), ("3", "N", " acme", 3)], "id string, type string, content string, seq int")
    assert {r[0]: r[1] for r in X.canonical_entities(n).collect()} == {"1": "1", "2": "1", "3": "3"}


def test_document_graph_equals_plain_python(spark):
    text = "Alpha met Beta there. Gamma saw alpha and Beta! Nothing here. Beta liked Delta"
    docs = spark.createDataFrame([("f1", "o", 0, text), ("f2", "o", 0, "Alpha again"), ("f3", "o", 0, None)], "file_id string, org_id string, chunk_index int, content string")
    n, e = X.merge_entities(*X.chunk_graph(X.rule_extract(docs)))
    ents = {r["content"]: r["file_ids"] for r in n.where("type = 'N'").collect()}
    assert ents == {"Alpha": ["f1", "f2"], "Beta": ["f1"], "Gamma": ["f1"], "Nothing": ["f1"], "Delta": ["f1"]}
    rel = {(r["source"], r["target"]) for r in e.where("relationship_type = 'FOLLOWED_BY'").collect()}
    name = {r["id"]: r["content"] for r in n.collect()}
    assert {(name[a], name[b]) for a, b in rel} == {("Alpha", "Beta"), ("Gamma", "Beta"), ("Beta", "Delta")}


def test_clear_after_merge_restores(spark):
    old = spark.createDataFrame([("t1", "T", "x", None, ["f1"], 1), ("n1", "N", "Acme", None, ["f1"], 2), ("h", "H", "sum", None, None, 3)], NODE)
    new = spark.createDataFrame([("t2", "T", "y", None, ["f2"], 4), ("n2", "N", "ACME", None, ["f2"], 5)], NODE)
    both = M.merge_file(old, new)
    assert {r["id"]: r["file_ids"] for r in both.collect()} == {"t1": ["f1"], "n1": ["f1", "f2"], "h": None, "t2": ["f2"]}
    left, kept, counts = M.clear_file(both, edges(spark, [("t2", "n1"), ("t1", "n1")]), "f2")
    assert {r["id"]: r["file_ids"] for r in left.collect()} == {"t1": ["f1"], "n1": ["f1"], "h": None}
    assert tuple(counts.first()) == (1, 1, 1) and kept.count() == 1


def test_quota_walk(spark):
    n = nodes(spark, [f"e{i:02d}" for i in range(12)]).unionByName(nodes(spark, ["r1", "r2"], "R"))
    ranked = n.select("id", "type", "content", "seq").withColumn("score", -n["seq"])
    got = R.select_nodes(spark.createDataFrame([], "id string"), ranked, n).collect()
    assert len(got) == 14 and sum(r["listed"] for r in got if r["type"] == "N") == 10


def test_seed_override(spark):
    hits = spark.createDataFrame([("a", 0.6), ("b", 0.7)], "node_id string, similarity double")
    exact = spark.createDataFrame([("b",), ("c",)], "id string")
    assert {r[0]: r[1] for r in R.personalization(hits, exact).collect()} == {"a": 0.6, "b": 1.0, "c": 1.0}


def test_connect_adds_the_path(spark):
    drawn = nodes(spark, ["a", "b", "c", "z"])
    e = edges(spark, [("a", "b"), ("b", "c"), ("z", "y"), ("y", "a")])
    assert viz.connect(drawn, e) == ["y"]


def test_empty_graph(spark):
    n, e = nodes(spark, []), edges(spark, [])
    assert G.density(n, e).first()["density"] == 0 and G.components(n, e).count() == 0
    assert not G.graph_stats(n, e).first()["is_connected"]
    assert ppr.pagerank(n, e, spark.createDataFrame([], "id string, weight double")).count() == 0
    assert C.communities(n, e).count() == 0


def test_augmentation(spark):
    from loomgraph.operators import augment as A

    n = nodes(spark, ["e1", "e2"]).unionByName(nodes(spark, ["t1", "t2"], "T")).unionByName(nodes(spark, ["r1"], "R"))
    e = edges(spark, [("t1", "e1"), ("t2", "e1"), ("r1", "e1")])
    made, link = A.attribute_nodes(n.where("type = 'N'"), n, e, "o")
    got = {r["id"]: r["content"] for r in made.collect()}
    assert got == {"A_e1_o": "Entity: e1\nContext: t1 | t2\nRelationships: r1", "A_e2_o": "Entity: e2"}
    assert {(r["source"], r["target"]) for r in link.collect()} == {("A_e1_o", "e1"), ("A_e2_o", "e2")}
    c = spark.createDataFrame([("e1", "x"), ("t1", "x"), ("e2", "y")], "id string, community string")
    made, link = A.community_nodes(c, n, known=spark.createDataFrame([("y",)], "community string"))
    assert {r["id"] for r in made.collect()} == {"H_community_x", "O_community_x"}
    assert {(r["source"], r["target"]) for r in link.collect()} == {("O_community_x", "H_community_x"), ("H_community_x", "e1"), ("H_community_x", "t1")}
    none = A.augment_new(n, e, n.where("id = 'e1'"))[0]
    assert [r["type"] for r in none.collect()] == ["A"]
    assert A.augment(n, e, 0.5)[0].groupBy("type").count().where("type = 'H'").first()["count"] == 2


def test_walk_brings_attributes_and_titles(spark):
    n = nodes(spark, ["e1"]).unionByName(nodes(spark, ["a1"], "A")).unionByName(nodes(spark, ["o1"], "O")).unionByName(nodes(spark, ["h1", "h2"], "H"))
    e = edges(spark, [("a1", "e1"), ("o1", "h2"), ("o1", "h1")])
    chosen = spark.createDataFrame([("e1", "N", "seed", 0, True), ("o1", "O", "walk", 1, True)], "id string, type string, origin string, rank int, listed boolean")
    got = {r["id"]: r["origin"] for r in R.with_expansions(chosen, e, n).collect()}
    assert got == {"e1": "seed", "o1": "walk", "a1": "attribute", "h1": "high_level"}


def test_reformulate():
    said = [{"role": "user", "content": "Who is Ann?"}]
    assert R.reformulate("and her office?", None, lambda h, q: "x") == "and her office?"
    assert R.reformulate("and her office?", said, lambda h, q: "Query: where is the office of Ann?") == "where is the office of Ann?"
    assert R.reformulate("q", said, lambda h, q: 1 / 0) == "q"
    assert R.decompose("a b a")[0] == "a b a" and len(R.decompose("one two three four five six")) == 21


def test_many_phrases_meet_by_their_longest_word(spark):
    names = ["Acme Energy Services Ltd", "Energy  services", "energy-services co", "Bio Energy", "the energy services-group", "???", "a ??? !! b"]
    n = spark.createDataFrame([(f"n{i}", "N", c, None, None, i) for i, c in enumerate(names)], NODE)
    q = spark.createDataFrame([(x,) for x in ("energy services", "bio energy inc", "acme energy", "single", "??? !!")], "query string")
    few, many = ({tuple(r) for r in G.phrase_match(n, q, most_queries=m).collect()} for m in (100, 1))
    assert few == many and {("energy services", "n0"), ("energy services", "n1"), ("acme energy", "n0")} <= few


def test_communities_settle_however_many_passes_it_takes():
    import numpy as np

    o, n, m = np.random.default_rng(2), 8_000, 20_000
    a, b = o.integers(0, n, m), (n * o.random(m) ** 3).astype(int)
    k = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    a, b = k // n, k % n
    ends, at = np.unique(np.r_[a[a != b], b[a != b]], return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    ids, mark = np.arange(len(ends)), o.integers(0, C.PRIME, len(ends))
    run = lambda most: C._local_moving(ids, mark, np.r_[a, b], np.r_[b, a], 1.0, most)
    with pytest.raises(RuntimeError, match="settle"):
        run(64)
    label = run(None)
    assert 1 < len(set(label)) < len(ids) and (label[label] == label).all() and (label <= ids).all()


@pytest.mark.parametrize("seed", range(4))
def test_betweenness_folds_trees(spark, seed):
    import numpy as np

    rng = random.Random(seed)
    # cores of two components with trees on them, a tree, a pair and a cycle
    pairs = random_graph(seed, 12, 18) + [("x" + a, "x" + b) for a, b in random_graph(seed + 9, 6, 9)]
    pairs += [(rng.choice([p for q in pairs for p in q]), f"t{i}") for i in range(8)] + [(f"t{i // 2}", f"u{i}") for i in range(8)]
    pairs += [("p0", "p1"), ("q0", "q1"), ("q1", "q2"), ("q1", "q3"), ("q3", "q4")] + [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    adj = adjacency(pairs)
    n, e = nodes(spark, sorted(adj)), edges(spark, pairs)
    got = {r[0]: round(r[1], 6) for r in C.betweenness(n, e, False).collect()}
    assert got == {k: round(v, 6) for k, v in brute_betweenness(adj).items()}
    number = {v: i for i, v in enumerate(sorted(adj))}
    a, b = (np.array([number[p[k]] for p in sorted({tuple(sorted(p)) for p in pairs})]) for k in (0, 1))
    stays, weight, _ = C._folded(len(number), a, b)
    left = set(a[stays]) | set(b[stays])
    assert all(sum((a[stays] == v) | (b[stays] == v)) > 1 for v in left) and weight[[number["t7"], number["q0"], number["p1"]]].max() == 1
