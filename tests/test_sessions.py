import random

from hostweave.operators.components import component_labels
from hostweave.operators.sessions import gap_sessions, range_islands
from tests.model import frame, auth


def test_gap_is_inclusive(spark):
    for gap, n in ((600, 1), (601, 2)):
        rows = gap_sessions(frame(spark, [auth("a", "u", 0), auth("b", "u", gap)]), ["user"], "host_id", "ts", 600).collect()
        assert len(rows) == n


def test_islands_match_a_scan(spark):
    rng = random.Random(1)
    rows = [(k, i, s, s + rng.choice([0, 5, 90])) for k in range(5) for i, s in enumerate(rng.randrange(4000) for _ in range(60))]
    got = range_islands(spark.createDataFrame(rows, "k int, i int, a bigint, b bigint"), ["k"], "a", "b", 40).collect()
    want = {}
    for k in range(5):
        no, reach = 0, None
        for _, i, a, b in sorted((r for r in rows if r[0] == k), key=lambda r: r[2]):
            no += reach is None or a - reach > 40
            reach = b if reach is None else max(reach, b)
            want[(k, i)] = no
    assert {(r["k"], r["i"]): r["session_no"] for r in got} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    want = {}
    for n in {x for e in edges for x in e}:
        want.setdefault(find(n), set()).add(n)
    got = {}
    for r in component_labels(spark.createDataFrame(edges, "u int, v int")).collect():
        got.setdefault(r["label"], set()).add(r["node"])
    assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in want.values()}
