"""Graph operators on small literal graphs with known answers."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom.operators import algorithms as a
from graphloom.operators import clones, scan, traverse
from graphloom.operators.graph_stats import modularity


@pytest.fixture(scope="module")
def repo(spark):
    """Two diamonds in a row, with a parallel edge, a self-loop, a pair of edges back and forth, and a node
    alone: top -> l1, r1 -> mid -> l2, r2 -> end; top -> l1 twice; mid -> mid; end <-> tail; island."""
    e = [("top", "l1"), ("top", "r1"), ("l1", "mid"), ("r1", "mid"), ("mid", "l2"), ("mid", "r2"), ("l2", "end"), ("r2", "end")]
    e += [("top", "l1"), ("mid", "mid"), ("end", "tail"), ("tail", "end")]
    edges = spark.createDataFrame([(s, d, "calls", 1) for s, d in e], "src string, dst string, kind string, weight long")
    ids = ["top", "l1", "r1", "mid", "l2", "r2", "end", "tail", "island"]
    nodes = spark.createDataFrame([(i, "routine", i, f"lib/{i}.py", "", 1) for i in ids], "id string, kind string, name string, file_path string, repo_prefix string, size long")
    return nodes, edges


def test_bfs_takes_the_first_parent(repo):
    nodes, edges = repo
    got = {r.node_id: (r.depth, r.parent_id) for r in traverse.bfs(nodes.where("id = 'top'"), edges, 9).collect()}
    assert got == {"top": (0, None), "l1": (1, "top"), "r1": (1, "top"), "mid": (2, "l1"), "l2": (3, "mid"), "r2": (3, "mid"), "end": (4, "l2"), "tail": (5, "end")}


def test_reach_tiers_are_disjoint(repo):
    _, edges = repo
    got = {(r.caller, r.tier) for r in traverse.reach_tiers(edges, ["calls"]).where("node = 'end'").collect()}
    assert got == {("l2", 1), ("r2", 1), ("tail", 1), ("mid", 2), ("l1", 3), ("r1", 3)}


def test_would_cycle(repo, spark):
    _, edges = repo
    pairs = spark.createDataFrame([("end", "top"), ("top", "end"), ("tail", "tail")], "src string, dst string")
    got = {(r.src, r.dst): r.cycle for r in traverse.would_cycle(pairs, edges, 9).collect()}
    assert got == {("end", "top"): True, ("top", "end"): False, ("tail", "tail"): True}


def test_k_shortest_paths(repo):
    nodes, edges = repo
    got = traverse.shortest_paths(nodes.where("id = 'top'"), nodes.where("id = 'end'"), edges, 4, k=3)
    assert [(r.rank, r.path) for r in got.orderBy("rank").collect()] == [(1, "top>l1>mid>l2>end"), (2, "top>l1>mid>r2>end"), (3, "top>r1>mid>l2>end")]


def test_strong_components(repo):
    nodes, edges = repo
    got = {r.id: r.component for r in a.strong_components(nodes.select("id"), edges).collect()}
    assert got["end"] == got["tail"] == "end"
    assert len({got[i] for i in ("top", "l1", "r1", "mid", "l2", "r2", "end", "island")}) == 8


def test_weak_components_and_cores(repo, spark):
    nodes, edges = repo
    got = {r.id: r.component for r in a.components(nodes.select("id"), edges).collect()}
    assert {i for i, c in got.items() if c == "end"} == {"top", "l1", "r1", "mid", "l2", "r2", "end", "tail"} and got["island"] == "island"
    assert a.k_core(edges, 3).count() == 0 and a.k_core(edges, 2).count() == 7
    cores = {r.id: r.core for r in a.core_numbers(nodes.select("id"), edges).collect()}
    assert cores == {**dict.fromkeys(["top", "l1", "r1", "mid", "l2", "r2", "end"], 2), "tail": 1, "island": 0}


def test_core_numbers_equal_peeling(spark):
    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(60)}", f"n{int(60 * rng.random() ** 3)}") for _ in range(500)}
    near: dict[str, set[str]] = {}
    for x, y in pairs:
        if x != y:
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
    want, k, left = {}, 0, {x: set(n) for x, n in near.items()}
    while left:
        x = min(left, key=lambda y: (len(left[y]), y))
        k = max(k, len(left[x]))
        want[x] = k
        for y in left.pop(x):
            left[y].discard(x)
    e = spark.createDataFrame([(x, y, 1) for x, y in pairs], "src string, dst string, weight long")
    got = a.core_numbers(spark.createDataFrame([(x,) for x in near], "id string"), e)
    assert {r.id: r.core for r in got.collect()} == want and len(set(want.values())) > 3


def test_betweenness_of_diamonds(repo):
    nodes, edges = repo
    got = {r.id: r.betweenness for r in a.betweenness(nodes.select("id"), edges, nodes.select("id")).collect()}
    # through mid run top, l1, r1 to l2, r2, end, tail; two of three paths from top go by l1
    assert got["mid"] == 12 and got["end"] == 6 and got["top"] == got["tail"] == got["island"] == 0
    assert abs(got["l1"] - 5 * 2 / 3) < 1e-9 and abs(got["r1"] - 5 / 3) < 1e-9 and got["l2"] == got["r2"] == 4


def test_betweenness_pivots_are_drawn_from_all_nodes(spark):
    from graphloom.plans import registry
    from graphloom.sources.model import edges, nodes

    sf = "/root/testdata/sf0.001"
    ids = nodes(spark, sf).select("id").cache()
    chosen = {r.id for r in a.pivots(ids).collect()}
    assert len(chosen) == (256 if ids.count() > 2000 else ids.count())
    assert {i.split(":")[0] for i in chosen} >= {"order", "part", "customer"}
    assert a.pivots(ids.limit(2000)).count() == 2000 or ids.count() < 2000
    # Brandes again, from the same pivots
    out: dict = {}
    for e in edges(spark, sf).collect():
        out.setdefault(e.src, []).append((e.dst, e.weight))
    want: dict = {}
    for s in chosen:
        sigma, dist, order = {s: 1.0}, {s: 0}, [s]
        for v in order:
            for w, m in out.get(v, []):
                if w not in dist:
                    dist[w], sigma[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v] * m
        dep = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            dep[v] = sum(sigma[v] * m / sigma[w] * (1 + dep[w]) for w, m in out.get(v, []) if dist[w] == dist[v] + 1)
            if v != s:
                want[v] = want.get(v, 0.0) + dep[v]
    got = {r.id: r.betweenness for r in registry.queries()["betweenness"](spark, sf).collect()}
    n = ids.count()
    assert len(got) == n and all(abs(x - want.get(i, 0.0) * n / len(chosen)) < 1e-4 for i, x in got.items())


def test_pagerank_keeps_its_mass(repo):
    nodes, edges = repo
    assert abs(sum(r.rank for r in a.pagerank(nodes.select("id"), edges, 10).collect()) - 1) < 1e-9


def test_modularity_of_two_cliques(spark):
    e = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    edges = spark.createDataFrame([(s, d, 1) for s, d in e], "src string, dst string, weight long")
    m = spark.createDataFrame([(i, "ab"[i > "c"]) for i in "abcdef"], "id string, community string")
    assert abs(modularity(edges, m).first()[0] - (6 / 7 - 0.5)) < 1e-6


def test_pipeline_language(repo):
    nodes, edges = repo
    got = scan.run_pipeline(nodes, edges, "nodes name~^top$ | traverse calls out | traverse calls out | filter path=lib/mid")
    assert [r.id for r in got.collect()] == ["mid"]
    with pytest.raises(ValueError):
        scan.run_pipeline(nodes, edges, "filter kind=routine")


def _brute_classes(docs, threshold=clones.THRESHOLD):
    """Classes by testing all pairs of different texts that share a band."""
    sets = {r.key: set(r.s) for r in docs.select("key", clones.shingle_hashes(F.col("text")).alias("s")).collect() if r.s}
    sig = {r.key: (sets[r.key], [tuple(r.signature[i : i + 4]) for i in range(0, 64, 4)]) for r in clones.signatures(docs, "key", "text").collect()}
    root = {r.key: r.key for r in docs.collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(sorted(sig), 2):
        (s, p), (t, q) = sig[x], sig[y]
        if any(i == j for i, j in zip(p, q, strict=True)) and len(s & t) >= threshold * len(s | t):
            low, high = sorted((find(x), find(y)))
            root[high] = low
    return {x: find(x) for x in root}


def test_clone_classes_equal_brute_force(spark):
    """Copies near one original but not near each other, whose smallest key is an unrelated one's; chains
    in which only neighbours are near; unrelated, short and empty texts."""
    rng = random.Random(3)
    base = [f"word{i}x" for i in range(200)]
    rows = [(99, " ".join(base)), (100, " ".join(base)), (900, ""), (901, "too short"), (902, None)]
    for k in range(40):
        w = list(base)
        for i in rng.sample(range(200), 6):
            w[i] = f"new{k}x{i}"
        rows.append((k, " ".join(w)))
    chain = [f"link{i}x" for i in range(120)]
    for k in range(30):
        for i in range(4):
            chain[(4 * k + i) % 120] = f"chain{k}x{i}"
        rows.append((200 + k, " ".join(chain)))
    for k in range(20):  # half of the words in common: buckets met without a link
        w = [x if i % 4 else f"far{k}x{i}" for i, x in enumerate(base)]
        rows.append((300 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "key long, text string")
    want = _brute_classes(docs)
    got = {r.key: r for r in clones.clone_classes(docs, "key", "text").collect()}
    assert {k: r.class_id for k, r in got.items()} == want
    sizes = {c: sum(v == c for v in want.values()) for c in want.values()}
    assert {r.class_id: r.class_size for r in got.values()} == sizes and max(sizes.values()) > 20
    clusters = clones.clone_clusters(clones.clone_links(docs, "key", "text")).collect()
    assert sorted(r.size for r in clusters) == sorted(n for n in sizes.values() if n > 1)


def test_minhash_clones_equal_brute_force(spark):
    from graphloom.plans import registry
    from graphloom.sources.model import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    got = {r.doc_id: r.class_id for r in registry.queries()["minhash_clones"](spark, sf).collect()}
    assert got == _brute_classes(docs) and len(set(got.values())) < len(got)


def test_signatures_are_spark_hashes_without_a_row_per_shingle(spark, monkeypatch):
    """Minima equal those of Spark's xxhash64, whatever blocks the shingles are cut into; nothing is exploded or moved."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(40)}é" for _ in range(n)) for n in (24, 300, 25, 3, 90)] + ["", None, "same " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    found = clones.signatures(docs, "key", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    got = {r.key: (r.n, r.signature) for r in found.collect()}
    x = docs.select("key", F.explode(clones.shingle_hashes(F.col("text"))).alias("x"))
    mins = x.groupBy("key").agg(F.count("x").alias("n"), F.array(*[F.min(F.xxhash64("x", F.lit(h))) for h in range(clones.HASHES)]).alias("m"))
    want = {r.key: (r.n, r.m) for r in mins.collect()}
    assert got == want and set(got) == {0, 1, 2, 4, 7}
    tokens = docs.select(F.transform(clones.query_tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("t")).where("t is not null").toArrow()
    monkeypatch.setattr(clones, "_BLOCK", 7)
    assert [list(m) for m in clones._signed(tokens["t"].combine_chunks())[3]] == [want[k][1] for k in sorted(want)]


def test_texts_that_share_buckets_form_no_square_of_pairs(spark, monkeypatch):
    """A family of texts with three quarters of their words in common shares buckets without being clones: after
    the pivots, hardly any two of their sets are compared. A clone among them is still found."""
    shared = [f"word{i}x" for i in range(150)]
    rows = [(k, " ".join(shared + [f"own{k}x{i}" for i in range(50)])) for k in range(60)]
    rows.append((90, " ".join(shared + [f"own31x{i}" for i in range(45)])))
    docs = spark.createDataFrame(rows, "key long, text string")
    seen, verified = [], clones._verified
    monkeypatch.setattr(clones, "_verified", lambda pairs, *more: (seen.append(pairs.count()), verified(pairs, *more))[1])
    links = {(r.a, r.b) for r in clones.clone_links(docs, "key", "text").collect()}
    assert links == {(31, 90)} and len(seen) == 3 and seen[-1] < len(rows)


def test_vector_topk_equals_brute_force(spark):
    """Ties after rounding go by key; zero, null and shorter vectors have no cosine; nothing but k rows a query
    and task leaves the search."""
    from graphloom.operators import search

    rng = random.Random(9)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(i, [x + 1e-9 * (i % 7) for x in base[i % 40]]) for i in range(700)]
    rows += [(700, [0.0] * 8), (701, None), (702, [1.0, 2.0]), (703, [float(i) for i in range(8)])]
    df = spark.createDataFrame(rows, "vid long, v array<double>").repartition(5)
    found = search.vector_topk(df.where("vid % 100 < 4").withColumnsRenamed({"vid": "qid", "v": "q"}), df, 10)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.vid, r.score))
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    whole = {k: v for k, v in rows if v and any(v)}
    for q in [k for k in whole if k % 100 < 4]:
        score = [(-round(dot(whole[q], v) / (dot(v, v) * dot(whole[q], whole[q])) ** 0.5, 6), k) for k, v in whole.items() if k != q and len(v) == len(whole[q])]
        assert got.pop(q, []) == [(k, -s) for s, k in sorted(score)[:10]]
    assert not got


def test_reaching_definitions_need_no_rounds(spark):
    """A chain of 300 blocks with a back edge and a skip; another function with a variable that is never
    redefined; and no table is stored on the way."""
    from graphloom.operators import analysis

    defs = [("f", 0, "x"), ("f", 150, "y"), ("f", 299, "x"), ("g", 1, None), ("g", 2, "x")]
    flow = [("f", i, i + 1) for i in range(299)] + [("f", 299, 0), ("f", 298, 5), ("g", 1, 2), ("g", 2, 3), ("h", 1, 2), (None, 1, 2)]
    d = spark.createDataFrame(defs, "func string, block long, var string")
    found = analysis.reaching_definitions(d, spark.createDataFrame(flow, "func string, a long, b long"))
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan
    got = {tuple(r) for r in found.collect()}
    want = {("f", "x", 0, b) for b in range(1, 300)} | {("f", "y", 150, b) for b in range(300)} | {("f", "x", 299, 0)}
    assert got == want | {("g", None, 1, 2), ("g", None, 1, 3), ("g", "x", 2, 3)}


def test_rounds_move_only_the_sums_of_blocks(spark, monkeypatch):
    """A round over the dealt-out edges has one exchange, that of sums; results do not hang on the number of
    buckets and blocks."""
    from graphloom.operators import blocks

    monkeypatch.setattr(blocks, "BUCKET_EDGES", 20)
    monkeypatch.setattr(blocks, "BLOCK", 2)
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(50)}", f"n{rng.randrange(50)}", rng.randrange(1, 4)) for _ in range(90)]
    e = spark.createDataFrame(pairs, "src string, dst string, weight long")
    ids = spark.createDataFrame([(f"n{i}",) for i in range(50)], "id string")
    web = blocks.Web(ids, e, "test")
    state, links = web.state(web.names.select("no", F.lit(1.0).alias("x"))), web.links(web.met)
    with blocks._by_block(spark):
        plan = web.sent(state, links, F.col("x") * F.col("w"), F.sum)._jdf.queryExecution().executedPlan().toString()
    assert web.buckets == 5 and plan.count("Exchange") == 1
    got = {r.id: r.rank for r in a.pagerank(ids, e, 5).collect()}
    out = {i: sum(w for s, _, w in pairs if s == i) for i in got}
    rank = dict.fromkeys(got, 1 / 50)
    for _ in range(5):
        lost = sum(x for i, x in rank.items() if not out[i])
        rank = {i: 0.15 / 50 + 0.85 * (sum(rank[s] * w / out[s] for s, d, w in pairs if d == i) + lost / 50) for i in rank}
    assert got.keys() == rank.keys() and all(abs(got[i] - x) < 1e-12 for i, x in rank.items())


def test_graph_edges_are_grouped_by_keys(spark):
    """Edges are counted by the keys of the tables, not by ids as text."""
    from graphloom.sources import model

    for _, part in model._built_edges(spark, "/root/testdata/sf0.001"):
        moved = [x for x in part._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        assert moved and not any("src" in x or "dst" in x for x in moved)


def test_impact_stores_no_pairs(spark, monkeypatch):
    """150 seeds on a random graph against sets; what is stored of a tier is a row for each node and 64 seeds,
    and the last tier is not stored."""
    from graphloom.operators import analysis

    rng = random.Random(8)
    pairs = sorted({(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(900)})
    weak = {p for p in pairs if p[0].endswith("3")}
    e = spark.createDataFrame(pairs, "src string, dst string")
    seeds = [f"n{i}" for i in range(150)]
    made = []
    keep = analysis.store
    monkeypatch.setattr(analysis, "store", lambda df, label: made.append(keep(df, label)) or made[-1])
    found = analysis.impact(spark.createDataFrame([(s,) for s in seeds], "id string"), e, F.col("src").like("%3"))
    got = {r.seed: (r.tier1, r.tier2, r.tier3, r.total, r.direct) for r in found.collect()}
    for s in seeds:
        tiers, seen = [{s}], {s}
        for k in range(3):
            near = {x for x, y in pairs if y in tiers[-1] and (k == 0 or (x, y) not in weak)} - seen
            tiers.append(near)
            seen |= near
        n = [len(x) for x in tiers[1:]]
        assert got.pop(s) == (*n, sum(n), n[0])
    assert not got and len(made) == 5 and all(x.count() <= 300 * 3 for x in made[2:])


def test_leiden_moves_refines_and_aggregates(spark):
    """In one task and in rounds: cliques in a ring are found, and communities are connected inside."""
    from graphloom.operators.communities import Partition

    e = [(f"n{c}{i}", f"n{c}{j}") for c in range(6) for i, j in combinations(range(5), 2)] + [(f"n{c}0", f"n{(c + 1) % 6}1") for c in range(6)]
    edges = spark.createDataFrame([(x, y, 1) for x, y in e] + [("n00", "gone", 5)], "src string, dst string, weight long")
    ids = spark.createDataFrame([(f"n{c}{i}",) for c in range(6) for i in range(5)] + [("alone",)], "id string")
    for refined, most in ((True, None), (True, 40), (False, 40)):
        got = {r.id: r.community for r in Partition(ids, edges, refined, one_task=most).by_id().collect()}
        assert got == {"alone": "alone"} | {f"n{c}{i}": f"n{c}0" for c in range(6) for i in range(5)}, (refined, most)


def test_budgeted_walk_ends_when_the_budget_is_spent(spark, repo, monkeypatch):
    nodes, edges = repo
    made = []
    real = traverse.store
    monkeypatch.setattr(traverse, "store", lambda df, label: made.append(label) or real(df, label))
    got = [(r.node_id, r.depth) for r in traverse.budgeted_walk(nodes.where("id = 'top'"), edges, 9, 24).collect()]
    assert got == [("top", 0), ("l1", 1), ("r1", 1)] and len(made) == 2


def test_processes_store_no_edges(repo, monkeypatch):
    from graphloom.operators import analysis

    nodes, edges = repo
    made = []
    real = analysis.store
    monkeypatch.setattr(analysis, "store", lambda df, label: made.append(set(df.columns)) or real(df, label))
    entries = nodes.where("id = 'mid'").select("id", F.lit(1.0).alias("score"))
    got = {(r.node_id, r.depth) for r in analysis.processes(entries, edges.unionByName(edges)).collect()}
    assert got == {("mid", 0), ("l2", 1), ("r2", 1), ("end", 2), ("tail", 3)}
    assert all("entry" in columns for columns in made)


def test_receipt_of_an_eviction_compares_no_snapshots(repo):
    from dataclasses import replace

    from graphloom.operators.store import GraphStore

    g = GraphStore(*repo)
    g = replace(g, edges=g.edges.dropDuplicates(["src", "dst", "kind"]))
    new = g.evict_nodes(g.nodes.where("id in ('mid', 'island')").select("id"))
    short, full = new.receipt(g), replace(new, evicted=None).receipt(g)
    row = lambda df: sorted(map(tuple, df.select("what", "change", "kind", "n").collect()))
    assert row(short) == row(full) == [("edge", "removed", "calls", 5), ("node", "removed", "routine", 2)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" in plan(full) and "FullOuter" not in plan(short)


def _watch_stores(monkeypatch):
    """Rows of every table that a traversal stores."""
    from graphloom.operators import traverse as t
    from graphloom.sources import scratch

    kept, store = [], scratch.store

    def counted(df, label):
        out = store(df, label)
        kept.append(out.count())
        return out

    monkeypatch.setattr(scratch, "store", counted)
    monkeypatch.setattr(t, "store", counted)
    return kept


def test_taint_stores_no_pairs(spark, monkeypatch):
    """40 sources reach 300 sinks over 2 nodes: 12,000 pairs, none of them stored; arrays of sinks are cut; hops are least ones on cycles."""
    from graphloom.operators import rules

    e = [(f"s{i}", f"m{i % 2}") for i in range(40)] + [(f"m{k}", f"t{j}") for k in range(2) for j in range(300)] + [("s0", "t5"), ("s0", "t5"), ("m0", "m1"), ("m1", "s1"), ("t5", "t6"), ("s1", "s1")]
    near: dict[str, set[str]] = {}
    for x, y in e:
        near.setdefault(x, set()).add(y)
    sources, sinks = [f"s{i}" for i in range(40)], [*(f"t{j}" for j in range(300)), "m1", "s1"]
    want = {}
    for s in sources:
        seen, front = {s}, {s}
        for hop in range(1, 3):
            front = {y for x in front for y in near.get(x, ())} - seen
            seen |= front
            want |= {(s, y): hop for y in front if y in sinks}
    kept = _watch_stores(monkeypatch)
    if hasattr(traverse, "ARRAY"):
        monkeypatch.setattr(traverse, "ARRAY", 50)
    ids = lambda v: spark.createDataFrame([(x,) for x in v], "id string")
    got = rules.taint(spark.createDataFrame(e, "src string, dst string"), ids(sources), ids(sinks), 2).collect()
    assert {(r.source, r.sink): r.hops for r in got} == want and len(got) == len(want) > 12_000
    assert max(kept) < 1_000


def test_k_shortest_paths_store_no_ends(spark, monkeypatch):
    """40 starts reach 300 targets over 4 nodes: of 48,000 paths none is stored whole; three a pair stay, shorter ones first, by path."""
    e = [(f"s{i}", f"m{k}") for i in range(40) for k in (1, 12, 3, 2)] + [(f"m{k}", f"t{j}") for k in (1, 12, 3, 2) for j in range(300)] + [("s0", "t5"), ("m3", "t5"), ("m3", "s7")]
    starts, targets = [f"s{i}" for i in range(40)], [*(f"t{j}" for j in range(300)), "m3", "s7"]
    near: dict[str, set[str]] = {}
    for x, y in e:
        near.setdefault(x, set()).add(y)
    found: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for s in starts:
        for m in near[s]:
            found.setdefault((s, m), []).append((1, f"{s}>{m}"))
            for t in near.get(m, set()) - {s}:
                found.setdefault((s, t), []).append((2, f"{s}>{m}>{t}"))
    want = {(*pair, n + 1, *p) for pair, ps in found.items() if pair[1] in targets for n, p in enumerate(sorted(ps)[:3])}
    kept = _watch_stores(monkeypatch)
    ids = lambda v: spark.createDataFrame([(x,) for x in v], "id string")
    got = traverse.shortest_paths(ids(starts), ids(targets), spark.createDataFrame([(*x, "calls") for x in e], "src string, dst string, kind string"), 2).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 36_000
    assert max(kept) < 2_000


def test_owners_are_dealt_by_rows(spark):
    """The partitions follow the rows, not the session's shuffle partitions; the owners equal a count by hand."""
    from graphloom.operators import history

    rng = random.Random(3)
    commits = {c: (f"p{rng.randrange(5)}", rng.randrange(9)) for c in range(60)}
    rows = [(rng.choice([None, *"abcd"]), c, *commits[c]) for c in commits for _ in range(3)]
    want = {}
    for f in "abcd":
        mine = [(ts, c, p) for g, c, p, ts in rows if g == f]
        n = {p: len({c for _, c, q in mine if q == p}) for *_, p in mine}
        owner = min(n, key=lambda p: (-n[p], p))
        want[f] = (max(mine)[2], owner, n[owner])
    out = history.last_owner(spark.createDataFrame(rows, "file string, commit long, author string, ts long"), 1_300_000)
    assert {r.file: (r.last_author, r.owner, r.owner_commits) for r in out.collect()} == want
    assert out.rdd.getNumPartitions() == 7


def test_degrees_and_the_build_are_dealt_by_rows(spark):
    """Pieces follow the rows in degrees and inside `lean`, which leaves the session as it was."""
    from graphloom.operators.graph_stats import degrees
    from graphloom.sources.scratch import lean

    key = "spark.sql.shuffle.partitions"
    with lean(spark, 1_300_000):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == "4"
    n = spark.range(500_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.lit("k").alias("kind"))
    e = spark.range(500_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("id") % 2).cast("string")).alias("dst"), F.lit("k").alias("kind"))
    out = degrees(n, e)
    assert out.rdd.getNumPartitions() == 5
    assert {tuple(r) for r in out.groupBy("fan_in", "fan_out").count().collect()} == {(0, 1, 499_998), (250_000, 1, 2)}
