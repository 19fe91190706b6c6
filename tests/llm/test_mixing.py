import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from hindsight.llm import mixing


def test_targets_share_all_words_and_stop_at_three_times():
    sizes = {"a": 10_000, "b": 10, "c": 500, None: 700, "": 300}
    got = mixing.share_out(sizes)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))
    assert all(got[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    assert got["b"] == 30
    assert mixing.share_out({"b": 100, "a": 100, None: 100}, (1, 2, 3)) == pytest.approx({"a": 50, "b": 100, None: 150})
    assert mixing.share_out({}) == {} and mixing.share_out({"x": 0}) == {"x": 0}


def brute_force_cost(capacities, members, quotas):
    """Least cost of a whole flow of the greatest amount, over all integer flows."""
    links = [(p, s) for p, own in enumerate(members) for s in own]
    best = None
    for flow in itertools.product(*[range(min(3 * capacities[p], quotas[s]) + 1) for p, s in links]):
        into, out = [0] * len(quotas), [0] * len(capacities)
        for (p, s), f in zip(links, flow, strict=True):
            out[p] += f
            into[s] += f
        if any(a > 3 * b for a, b in zip(out, capacities, strict=True)) or any(a > b for a, b in zip(into, quotas, strict=True)):
            continue
        cost = sum(max(0, min(o - c, c)) * 1 + max(0, o - 2 * c) * 3 for o, c in zip(out, capacities, strict=True))
        key = (-sum(flow), cost)
        best = min(best or key, key)
    return best


def test_flow_is_cheapest():
    random.seed(3)
    for _ in range(30):
        capacities = [random.randint(0, 3) for _ in range(3)]
        members = [sorted(random.sample(range(2), random.randint(0, 2))) for _ in range(3)]
        quotas = [random.randint(0, 6) for _ in range(2)]
        flows = mixing.min_cost_flow(capacities, members, quotas)
        out = [sum(f.values()) for f in flows]
        cost = sum(max(0, min(o - c, c)) + max(0, o - 2 * c) * 3 for o, c in zip(out, capacities, strict=True))
        assert (-sum(out), cost) == brute_force_cost(capacities, members, quotas)


def flow_network_cost(capacities, members, quotas):
    """Amount and cost of the cheapest flow, by shortest paths found by relaxing all arcs (Bellman-Ford)."""
    start, end = -1, -2
    arcs = [[start, ("p", p), c, cost] for p, c in enumerate(capacities) for cost in (0, 1, 3)]
    arcs += [[("p", p), ("s", s), 3 * capacities[p], 0] for p, own in enumerate(members) for s in own]
    arcs += [[("s", s), end, q, 0] for s, q in enumerate(quotas)]
    arcs = [a for u, v, r, c in arcs for a in ([u, v, r, c], [v, u, 0, -c])]
    amount = cost = 0
    while True:
        distance, into, changed = {start: 0}, {}, True
        while changed:
            changed = False
            for e, (u, v, r, c) in enumerate(arcs):
                if r and u in distance and distance[u] + c < distance.get(v, 10**9):
                    distance[v], into[v], changed = distance[u] + c, e, True
        if end not in distance:
            return amount, cost
        path, node = [], end
        while node != start:
            path.append(into[node])
            node = arcs[into[node]][0]
        words = min(arcs[e][2] for e in path)
        for e in path:
            arcs[e][2] -= words
            arcs[e ^ 1][2] += words
        amount, cost = amount + words, cost + words * distance[end]


def test_larger_flows_are_cheapest():
    rng = random.Random(5)
    for _ in range(120):
        n = rng.randint(1, 7)
        capacities = [rng.randint(0, 30) for _ in range(rng.randint(0, 12))]
        members = [sorted(rng.sample(range(n), rng.randint(0, min(n, 4)))) for _ in capacities]
        quotas = [rng.randint(0, 60) for _ in range(n)]
        flows = mixing.min_cost_flow(capacities, members, quotas)
        into, cost = [0] * n, 0
        for c, own, flow in zip(capacities, members, flows, strict=True):
            out = sum(flow.values())
            assert out <= 3 * c and set(flow) <= set(own) and all(f > 0 for f in flow.values())
            cost += max(0, min(out - c, c)) + max(0, out - 2 * c) * 3
            for s, f in flow.items():
                into[s] += f
        assert all(a <= b for a, b in zip(into, quotas, strict=True))
        assert (sum(into), cost) == flow_network_cost(capacities, members, quotas)


def test_many_sources_take_linear_time():
    rng = random.Random(6)
    n = 20_000
    members = [[s] for s in range(n)] + [sorted(rng.sample(range(n), 2)) for _ in range(n)]
    capacities = [rng.randint(1, 1000) for _ in members]
    quotas = [rng.randint(1, 1500) for _ in range(n)]
    began = time.process_time()
    alone = mixing.min_cost_flow(capacities[:n], members[:n], quotas)
    assert time.process_time() - began < 5
    assert [sum(f.values()) for f in alone] == [min(3 * c, q) for c, q in zip(capacities, quotas, strict=False)]
    overlapping = mixing.min_cost_flow(capacities, members, quotas)
    assert time.process_time() - began < 60
    assert sum(sum(f.values()) for f in overlapping) <= sum(quotas)


SCHEMA = "doc_id long, text string, source string, size int, sources string, last long"


def documents(spark):
    random.seed(2)
    rows = []
    for i in range(600):
        source = random.choice(["hot"] * 6 + ["b", "c", "d", None, ""])
        rows.append((i, " ".join("w" * random.randint(1, 5) for _ in range(random.randint(0, 60))) or None, source, 1, "x", 2))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_sources_come_near_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    docs = documents(spark)
    out = mixing.mix(docs).collect()
    sizes = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in out} == sizes
    totals, taken, targets = {}, {}, {}
    for r in out:
        totals[r.source] = totals.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
        assert r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
    assert {r.source: r.source_size for r in out} == totals
    assert targets == pytest.approx(mixing.share_out(totals))
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 4
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)


def test_mixture_repeats_rows_as_taken(spark):
    docs = documents(spark)
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(docs).collect() if r["size"]}
    mixed = mixing.mixed_documents(docs, F.array("source"))
    assert mixed.columns == docs.columns
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for r in docs.collect():
        assert times.get(r.doc_id, 0) == taken.get(r.doc_id, 1)


def test_overlapping_sources(spark):
    rows = [(i, "a b c d", ["x", "y"] if i % 2 else ["x"]) for i in range(40)] + [(99, "a b", None), (98, "a", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own array<string>")
    even = lambda sizes: {"x": 80.0, "y": 80.0}
    plan = mixing.plan_mixture(docs, F.col("own"), targets=even)
    words = mixing._times(plan.sized, plan.decisions).groupBy("sources").agg(F.sum(F.col("size") * F.col("times")).alias("n"))
    got = {tuple(r.sources): r.n for r in words.collect()}
    assert got["x", "y"] == 80 and got["x",] == 80 and got[None,] == 0 and got[()] == 0


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty, F.array("source")).count() == 0
    rows = [(1, "a b", "s", 0, "", 0), (1, "a b", "s", 0, "", 0), (None, None, None, 0, "", 0), (2, "", "s", 0, "", 0)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 4 and sum(r.taken for r in out) == 4


def test_no_document_fits_what_is_wanted(spark):
    rows = [(1, "a " * 50, "s", 0, "", 0), (2, "b " * 200, "t", 0, "", 0)]
    out = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: 100, 2: 200}  # targets of 83 and 167
