import random

from hostweave.session import with_place_rank


def test_place_ranks_count_within_each_source(spark):
    r = random.Random(1)
    rows = [("ab"[r.random() < 0.3], p) for p in r.sample(range(-500, 10_000_000), 400)] + [("c", 8_589_934_592 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "source string, pos long").repartition(5)
    got = {(x.source, x.pos): x.n for x in with_place_rank(df, "pos", "n", ["source"], chunk=1000).collect()}
    want = {}
    for s in "abc":
        want.update({(s, p): i + 1 for i, p in enumerate(sorted(p for q, p in rows if q == s))})
    assert got == want
    whole = [x.n for x in with_place_rank(df, "pos", "n", chunk=1 << 16).orderBy("pos").collect()]
    assert whole == list(range(1, len(rows) + 1))
    assert with_place_rank(df.limit(0), "pos", "n", ["source"]).count() == 0
