"""Graph operators against plain implementations on random graphs."""

import random

from quarry.operators import graph as G
from quarry.operators import modules as M


def reach(edges, start):
    seen, stack = set(start), list(start)
    while stack:
        x = stack.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src long, dst long")


def graphs():
    rng = random.Random(1)
    for n, m in ((6, 8), (12, 18), (20, 30), (15, 60)):
        yield {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}


def test_cycle_groups_are_strong_components(spark):
    for edges in graphs():
        nodes = {x for e in edges for x in e}
        ahead = {x: reach(edges, [x]) for x in nodes}
        want = {(x, min(y for y in ahead[x] if x in ahead[y])) for x in nodes if sum(x in ahead[y] for y in ahead[x]) > 1}
        assert {(r.node, r.group) for r in G.cycle_groups(frame(spark, edges)).collect()} == want


def test_cycles_are_simple_rings(spark):
    def rings(edges, longest):
        out = set()

        def walk(path):
            for a, b in edges:
                if a == path[-1]:
                    if b == path[0] and len(path) > 1:
                        out.add(tuple(path))
                    elif b > path[0] and b not in path and len(path) < longest:
                        walk([*path, b])

        for a in {a for a, _ in edges}:
            walk([a])
        return out

    for edges in list(graphs())[:3]:
        assert {tuple(r.cycle) for r in M.cycles(frame(spark, edges), 6).collect()} == rings(edges, 6)


def clusters(edges):
    """In ascending order: what isn't visited yet starts a cluster of all that it leads to."""
    nodes = {x for e in edges for x in e}
    left = sorted(nodes - reach(edges, {a for a, _ in edges} - {b for _, b in edges}))
    out = set()
    while left:
        met = reach(edges, [left[0]])
        out |= {(x, left[0], len(met)) for x in met}
        left = [x for x in left if x not in met]
    return out


def test_zombie_clusters_are_walks_from_what_is_left(spark):
    for edges in [*graphs(), {(1, 2), (2, 1), (3, 4), (4, 3), (2, 5), (4, 5)}, {(0, 9), (1, 2), (2, 1), (2, 9)}]:
        assert {(r.node, r.cluster, r.size) for r in M.zombie_clusters(frame(spark, edges)).collect()} == clusters(edges)
    two = M.zombie_clusters(frame(spark, {(1, 2), (2, 1), (3, 4), (4, 3), (2, 5), (4, 5)})).collect()
    assert sorted((r.cluster, r.node) for r in two) == [(1, 1), (1, 2), (1, 5), (3, 3), (3, 4), (3, 5)] and {r.risk for r in two} == {"medium"}


def test_a_ring_of_any_length_is_found(spark):
    ring = {(i, (i + 1) % 12) for i in range(12)}
    (r,) = M.cycles(frame(spark, ring)).collect()
    assert list(r.cycle) == list(range(12)) and r.size == 12 and r.critical
    s = M.cycle_statistics(M.cycles(frame(spark, ring))).first()
    assert (s.cycles, s.longest, s.critical, s.nodes) == (1, 12, 1, 12)
    assert {(x.node, x.group, x.ring) for x in G.ring_lengths(frame(spark, ring)).collect()} == {(i, 0, 12) for i in range(12)}
    assert M.cycles(frame(spark, {(1, 2)})).collect() == [] and G.ring_lengths(frame(spark, {(1, 2)})).collect() == []


def test_shortest_rings(spark):
    for edges in graphs():
        nodes = {x for e in edges for x in e}
        want = set()
        for x in nodes:
            n, front, seen = 0, {x}, set()
            while front:
                n, front = n + 1, {b for a, b in edges if a in front} - seen
                seen |= front
                if x in front:
                    want.add((x, n))
                    break
        assert {(r.node, r.ring) for r in G.ring_lengths(frame(spark, edges)).collect()} == want


def test_walks_keep_their_names_and_depths(spark):
    edges = {(i, i + 1) for i in range(20)} | {(0, 10)}
    start = spark.createDataFrame([("a", 0), ("b", 12), ("a", 0)], "who string, node long")
    got = {(r.who, r.node, r.depth) for r in G.walk(frame(spark, edges), start).collect()}
    assert got == {("a", i, i if i < 10 else i - 9) for i in range(21)} | {("b", i, i - 12) for i in range(12, 21)}
    assert {(r.who, r.node) for r in G.walk(frame(spark, edges), start, 2).collect()} == {("a", 0), ("a", 1), ("a", 2), ("a", 10), ("a", 11), ("b", 12), ("b", 13), ("b", 14)}


def test_components_of_one_name_stay_apart(spark):
    from quarry.plans import flow as P

    edges = {(r.src_path, r.dst_path, r.external) for r in P.component_edges(spark, "").collect() if r.dst in ("Card", "Button")}
    assert edges == {("src/app/page.tsx", "src/ui/Card.tsx", False), ("src/app/shop/[id]/page.tsx", "src/shop/Card.tsx", False), ("src/ui/Item.tsx", "src/ui/Card.tsx", False), ("src/app/page.tsx", None, True)}


def settled(groups):
    """Groups (name, members, score) in order: which are kept, one after the other."""
    order = sorted(groups, key=lambda g: (-len(g[1]), -g[2], g[0]))
    taken, kept = set(), []
    for name, members, _ in order:
        if len(members) >= 3 and 2 * len(members - taken) >= len(members):
            kept.append((name, members))
            taken |= members
    for name, members, score in order:
        if len(members) == 2 and (not members & taken or (score > 0.8 and any(members <= m for _, m in kept))):
            kept.append((name, members))
            taken |= members
    return {n for n, _ in kept}


def test_groups_settled_in_rounds_are_those_settled_one_by_one(spark):
    from quarry.operators import duplicates as D

    rng = random.Random(8)
    for n, m in ((12, 8), (60, 30), (60, 12)):
        groups = [(f"g{i}", set(rng.sample(range(m), rng.choice([1, 2, 2, 3, 4, 5]))), rng.choice([0.7, 0.8, 0.85, 0.9])) for i in range(n)]
        df = spark.createDataFrame([(g, sorted(x), s) for g, x, s in groups], "group string, members array<int>, score double")
        assert {r.group for r in D.consolidated(df).collect()} == settled(groups)
    assert D.consolidated(df.limit(0)).collect() == []


def test_orders_that_cover_parts(spark):
    from quarry.plans import dup as P

    sf = "/root/testdata/sf0.001"
    lines = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_discount").collect():
        lines.setdefault(r.l_orderkey, []).append(r)
    groups = [(str(o), {r.l_partkey for r in rs}, round(1 - sum(r.l_discount for r in rs) / len(rs), 4)) for o, rs in lines.items()]
    assert {str(r.order_key) for r in P.order_cover(spark, sf).collect()} == settled([g for g in groups if len(g[1]) > 1])


def test_components_of_chains_in_order_take_few_rounds(spark, monkeypatch):
    edges = {(i, i + 1) for i in range(300)} | {(1000, 1001), (1001, 1002), (2000, 2000)}
    kept, seen = G.checkpointed, []
    monkeypatch.setattr(G, "checkpointed", lambda df: seen.append(kept(df)) or seen[-1])
    got = {(r.node, r.group) for r in G.components(frame(spark, edges)).collect()}
    assert got == {(i, 0) for i in range(301)} | {(i, 1000) for i in (1000, 1001, 1002)} | {(2000, 2000)}
    assert len(seen) < 60


def test_a_walk_without_names_drops_edges_it_took(spark):
    edges = {(i, i + 1) for i in range(14)} | {(3, 9), (9, 3), (14, 0), (20, 21), (21, 20), (30, 31)}
    got = {(r.node, r.depth) for r in G.reachable(frame(spark, edges), spark.createDataFrame([(0,), (30,)], "node long")).collect()}
    assert got == {(i, i if i < 9 else i - 5) for i in range(15)} | {(30, 0), (31, 1)}
