"""G operators: renumbered graphs stay equivalent, a changed relation does not,
tied colours take the exact path."""

from kgflow.operators import qgraph as G


def _g(spark, nodes, edges):
    n = spark.createDataFrame(nodes, "qid long, nid long, id string, type string, question int, function string")
    e = spark.createDataFrame(edges, "qid long, src long, dst long, relation string")
    return n, e


def test_equivalence(spark):
    nodes, edges = [], []
    # q1 and q2: same graph, nodes numbered differently; q3 differs in one relation
    for q, order in ((1, [1, 2, 3]), (2, [3, 1, 2]), (3, [1, 2, 3])):
        a, b, c = order
        nodes += [(q, a, "Doc", "class", 1, "none"), (q, b, "m.x", "entity", 0, "none"), (q, c, "m.y", "entity", 0, "none")]
        edges += [(q, a, b, "issues"), (q, a, c, "requirement" if q != 3 else "services")]
    # q4, q5: tied colours (two identical entity leaves), renumbered
    for q, order in ((4, [1, 2, 3]), (5, [2, 3, 1])):
        a, b, c = order
        nodes += [(q, a, "Doc", "class", 1, "none"), (q, b, "m.x", "entity", 0, "none"), (q, c, "m.x", "entity", 0, "none")]
        edges += [(q, a, b, "issues"), (q, a, c, "issues")]
    n, e = _g(spark, nodes, edges)
    cls = {r.qid: r.class_id for r in G.equivalent_queries(n, e).collect()}
    assert cls[1] == cls[2] == 1 and cls[3] == 3 and cls[4] == cls[5] == 4


def test_comparable(spark):
    df = spark.createDataFrame([("( A @@UNKNOWN@@ )",), ("( A )",)], "f string")
    assert [r.c for r in df.select(G.comparable("f").alias("c")).collect()] == [False, True]


def test_tied_graphs_of_twelve_nodes():
    """Rings, stars of paths, bipartite and edgeless graphs: relabelled copies agree, others differ, quickly."""
    import random
    import time
    from kgflow.operators.qgraph import _exact_certificate
    ring = lambda ns: [(ns[i], ns[(i + 1) % len(ns)], "r") for i in range(len(ns))]
    graphs = {
        "ring12": ring(range(12)), "two rings": ring(range(6)) + ring(range(6, 12)), "none": [],
        "pairs": [(2 * i, 2 * i + 1, "r") for i in range(6)], "star": [(0, i, "r") for i in range(1, 12)],
        "bipartite": [(a, b, "r") for a in range(6) for b in range(6, 12)],
        "other label": ring(range(11)) + [(11, 11, "r")], "turned": [(b, a, "r") if a == 3 else (a, b, "r") for a, b, _ in ring(range(12))],
    }
    start, seen = time.time(), {}
    for name, edges in graphs.items():
        certs = set()
        for seed in range(4):
            p = list(range(100, 112))
            random.Random(seed).shuffle(p)
            certs.add(_exact_certificate([(p[i], "c") for i in range(12)], [(p[a], p[b], r) for a, b, r in edges]))
        assert len(certs) == 1, name
        seen[name] = certs.pop()
    assert len(set(seen.values())) == len(graphs) and time.time() - start < 20


def test_certificates_against_all_orders():
    """Small random graphs: equal certificates exactly if some renaming maps one to the other."""
    import itertools
    import random
    from kgflow.operators.qgraph import _exact_certificate
    rnd = random.Random(7)
    graphs = []
    for _ in range(60):
        n = 4
        graphs.append((["ab"[rnd.random() < 0.3] for _ in range(n)], sorted({(rnd.randrange(n), rnd.randrange(n), rnd.choice("rs")) for _ in range(rnd.randrange(5))})))
    def least(cols, edges):
        return min((tuple(cols[p.index(i)] for i in range(4)), tuple(sorted((p[a], p[b], r) for a, b, r in edges))) for p in itertools.permutations(range(4)))
    want = [least(*g) for g in graphs]
    got = [_exact_certificate(list(enumerate(c)), e) for c, e in graphs]
    for i, j in itertools.combinations(range(60), 2):
        assert (got[i] == got[j]) == (want[i] == want[j])
