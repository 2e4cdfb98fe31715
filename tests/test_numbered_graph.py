"""Graph operators over numbered ids, and what their queries read."""

import random

import pytest
from pyspark.sql import functions as F

from quayside import queries
from quayside.operators import graph, motifs
from quayside.plans import lineage

DATA = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


@pytest.fixture(scope="module")
def lines(spark):
    made = [(f"p{i % 7}", f"s{(i * i + i // 3) % 23}", i % 9) for i in range(120)] + [("hub", f"s{i}", 3) for i in range(23)]
    return spark.createDataFrame(made, "customer_unique_id string, seller_id string, delay_days int")


def test_numbers_are_dense_and_keep_the_order_of_texts(spark):
    ids = spark.createDataFrame([("b",), ("a",), (None,), ("10",), ("9",), ("b",)], "id string")
    assert rows(graph.numbered(ids)) == [("10", 0), ("9", 1), ("a", 2), ("b", 3)]


def test_numbered_ids_give_what_texts_give(spark, lines):
    pairs, names, sellers = graph.coded(graph.purchases(lines))
    edge, text = graph.both_ways(pairs), graph.edges(lines)
    named = lambda df, *cols: graph.renamed(df, names, list(cols), "code", "id")
    met, plain = graph.shared_customer_motifs(edge, tile=5), graph.shared_customer_motifs(text)
    assert rows(named(met, "seller_a", "seller_b")) == rows(plain)
    assert rows(named(graph.backup_map(met), "seller_id", "backup_seller_id")) == rows(graph.backup_map(plain))
    parts = graph.connected_components(edge, symmetric=True)
    assert rows(named(parts, "id", "component")) == rows(graph.connected_components(text))
    shared, near = graph.cocustomer_edges(met), graph.cocustomer_edges(plain)
    assert rows(named(graph.label_propagation(shared), "id", "community")) == rows(graph.label_propagation(near))
    assert sellers.count() == 23


def test_equal_pairs_and_sellers_of_many_persons_are_counted_whole(spark, monkeypatch):
    edge = spark.createDataFrame([(s, f"p{p}", "serves") for p in range(40) for s in ("a", "b", "b")], "src string, dst string, edge_type string")
    monkeypatch.setattr(graph, "SPREAD", 3)
    assert rows(graph.shared_customer_motifs(edge)) == [("a", "b", 80)]


def test_open_wedges_and_named_paths(spark):
    edge = graph.mirrored(spark.createDataFrame([(0, 1, 9), (1, 2, 4), (0, 3, 2), (3, 2, 1)], "a int, b int, w long"), "a", "b", "w")
    assert rows(motifs.open_wedges(edge)) == [(0, 2, 2, 4), (1, 3, 2, 2), (2, 0, 2, 4), (3, 1, 2, 2)]
    names = spark.createDataFrame([(0, "w"), (1, "x"), (2, "y"), (3, "z")], "code int, id string")
    found = motifs.bfs_paths(edge, graph.endpoints(edge), F.lit(True), F.lit(True), every_target=True, names=names)
    assert [r.path for r in found.filter("from_id = 0 AND to_id = 2").collect()] == [["w", "x", "y"]]


def test_network_lines_meet_orders_only(spark):
    plan = queries.graph_lines(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_lines_of_repeated_keys_stay_repeated(spark, tmp_path):
    for name in ("orders", "lineitem", "supplier", "nation", "region", "customer", "part", "events"):
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        (df.union(df.filter("p_partkey = 1")) if name == "part" else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert queries.lines(spark, str(tmp_path), "sellers", "products").count() == queries.lines(spark, str(tmp_path)).count()


def test_votes_where_lists_lie(spark, monkeypatch):
    """Few vertices hear by lists, many by a shuffle: communities and ranks are equal, on graphs with repeated, one-way and looped edges too; lists are not shuffled a round."""
    rng = random.Random(11)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(150)]
    apart = sorted({p for a, b in pairs for p in ((a, b), (b, a))})
    for rows, symmetric in ((apart, True), (pairs + pairs[:30], False)):
        edge = spark.createDataFrame(rows, "src int, dst int").cache()
        found = []
        for names in (500_000, 0):
            monkeypatch.setattr(graph, "NAMES", names)
            linked = graph.adjacency(edge, names > 0) if symmetric else None
            found.append([
                sorted(map(tuple, graph.label_propagation(edge, 4).collect())),
                sorted((r.id, round(r.pagerank, 9)) for r in graph.pagerank(edge, rounds=3).collect()),
                sorted(map(tuple, graph.connected_components(edge).collect())),
                sorted(map(tuple, graph.label_propagation(edge, 4, linked).collect())),
            ])
        assert found[0] == found[1] and found[0][0] == found[0][3]
    monkeypatch.setattr(graph, "NAMES", 500_000)
    edge = spark.createDataFrame(apart, "src int, dst int")
    seen = []
    monkeypatch.setattr(lineage, "WATCHERS", [lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString())])
    graph.pagerank(edge, rounds=5).collect()
    assert "rightHint=(strategy=broadcast)" in seen[-1]


def test_two_hop_partners_come_by_lists(spark):
    """Numbers, texts and brute force agree; pairs of two hops are no rows of a join with the edges, nor are pairs counted after a second shuffle."""
    rng = random.Random(6)
    pairs = {(a, b): rng.randrange(2, 5) for a in range(30) for b in range(a) if rng.random() < 0.15}
    both = [(a, b, n) for (x, y), n in pairs.items() for a, b in ((x, y), (y, x))]
    edge = spark.createDataFrame(both, "src int, dst int, weight long")
    top = {a: sorted((-n, b) for x, b, n in both if x == a)[:3] for a in range(30)}
    want = []
    for a in range(30):
        direct = {b for x, b, _ in both if x == a} | {a}
        far = [(w, c) for _, b in top[a] for w, c in top[b] if c not in direct]
        if far:
            want.append((a, len({c for _, c in far}), min(far)[1]))
    out = graph.two_hop_backups(edge, 3)
    assert rows(out) == want != []
    name = lambda c: F.concat(F.lit("s"), F.lpad(F.col(c).cast("string"), 2, "0")).alias(c)
    assert rows(graph.two_hop_backups(edge.select(name("src"), name("dst"), "weight"), 3)) == [(f"s{a:02d}", n, f"s{c:02d}") for a, n, c in want]
    assert "LeftAnti" not in out._jdf.queryExecution().toString()
    served = spark.createDataFrame([(i % 9, 100 + i % 7, "serves") for i in range(60)], "src int, dst int, edge_type string")
    plan = graph.shared_customer_motifs(served)._jdf.queryExecution().executedPlan().toString()
    last = plan[: plan.index("Generate explode(tail")]
    assert "Exchange" not in last
