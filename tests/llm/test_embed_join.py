import numpy as np
from strandweave.llm import embed_join as m


def brute(rows):
    units = []
    for i, v, label in rows:
        ok = i is not None and label is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        units.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    links = {k: set() for k in range(len(rows))}
    for a in links:
        for b in links:
            if a != b and units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.98:
                links[a].add(b)
    out = []
    same = {}
    for k, r in enumerate(rows):
        if r[0] is not None and units[k] is not None:
            same.setdefault(r[0], set()).add(k)
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            at = todo.pop()
            for x in (links[at] | same.get(rows[at][0], set())) - seen:
                seen.add(x)
                todo.append(x)
        out.append((rows[k][0], len(links[k]), min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)))
    return sorted(out, key=str)


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 24))
    rows = []
    for i in range(240):
        v = base[rng.integers(0, 12 if i % 3 else 2)] + rng.standard_normal(24) * rng.choice([0, 0.05, 0.12, 0.14, 1])
        rows.append((i, [float(np.float32(c)) for c in v * rng.choice([1, 3])], int(rng.integers(0, 2))))
    rows += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, [None] * 24, 1), (304, rows[0][1], None), (305, [], 0), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (None, rows[0][1], rows[0][2])]
    rows += [(10, [-c for c in rows[10][1]], rows[10][2]), (11, rows[20][1], 1), (11, rows[20][1], 1)]  # one id, several vectors
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, copy string, n int").repartition(3)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in m.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert sum(n > 0 for _, n, _ in got) > 80
    assert m.near_duplicates(df.limit(0)).count() == 0


def stored(x):
    return m.Codes(x.shape[1], *m.encode(x))


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    for d in (24, 64, 200):
        x = rng.standard_normal((300, d))
        x[150:] = x[:150] + rng.standard_normal((150, d)) * 0.19  # cosines about 0.98
        x /= np.linalg.norm(x, axis=1)[:, None]
        c, all_ = stored(x), slice(0, 300)
        off = ~np.eye(300, dtype=bool)
        gap = c.estimates(all_) - x @ x.T
        assert abs(gap[off].mean()) < 0.003
        near = (x @ x.T >= 0.98) & off
        passed = c.estimates(all_) >= c.least(all_, 0.98)
        assert near.sum() > 60 and passed[near].all()
        assert passed[x @ x.T < 0.5].mean() < 0.01
        half = c.least(all_, 0.98, eps=3.0)  # one in several hundred may fall below three deviations
        assert (c.estimates(all_) >= half)[near].mean() > 0.98


def test_codes_decide_what_is_recomputed(spark):
    """Vectors of one label around many centres: of the pairs that share a band few stay undecided."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 64))
    x = np.repeat(base, 6, axis=0) + rng.standard_normal((240, 64)) * 0.5
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    nodes = m.cut(m.coded(df).withColumn("mult", m.F.lit(1)))
    rows = m.cut(m.bands(nodes).withColumn("grp", m.F.col("vec_id")))
    pairs = rows.groupBy("bucket").count().selectExpr("sum(count * (count - 1) / 2) s").first()["s"]
    undecided = m.bounded(nodes, rows, 0.98).agg(m.F.sum("n_undecided")).first()[0] or 0
    assert undecided < pairs / 10 and pairs > 100
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert sum(r["n_links"] for r in m.near_duplicates(df).collect()) == int(((u @ u.T) >= 0.98).sum() - 240)
