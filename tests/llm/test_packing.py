import random

import numpy as np
from strandweave.llm import packing


def brute(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        best = None
        for i, b in enumerate(bins):
            if b["free"] >= n and n < capacity and (s is None or s not in b["s"]) and (c is None or c not in b["c"]):
                if best is None or b["free"] < bins[best]["free"]:
                    best = i
        if best is None:
            bins.append({"free": capacity, "s": set(), "c": set()})
            best = len(bins) - 1
        bins[best]["free"] -= n
        bins[best]["s"].add(s)
        bins[best]["c"].add(c)
        out.append((n, capacity - bins[best]["free"] - n, bins[best]["free"]))
    return out, len(bins)


def test_tightest_compatible_bin_every_time():
    rng = random.Random(3)
    for trial in range(40):
        n, cap = rng.randint(1, 120), rng.choice([7, 16, 100])
        lengths = sorted((rng.randint(1, cap) for _ in range(n)), reverse=True)
        sources = [rng.choice(["hot", "hot", "a", "b", "c", None]) for _ in range(n)]
        clusters = [rng.choice([None, "x", "y", str(i)]) for i in range(n)]
        bins, offsets = packing.pack(np.array(lengths), sources, clusters, cap)
        seen: dict = {}
        free: dict = {}
        for k in range(n):
            b = int(bins[k])
            mine = seen.setdefault(b, [])
            assert offsets[k] == cap - free.get(b, cap)
            for j in mine:
                assert sources[j] is None or sources[j] != sources[k]
                assert clusters[j] is None or clusters[j] != clusters[k]
            # no other open bin that fits was tighter
            if lengths[k] < cap:
                for other, left in free.items():
                    fits = lengths[k] <= left and left > 0 and all(
                        (sources[j] is None or sources[j] != sources[k]) and (clusters[j] is None or clusters[j] != clusters[k]) for j in seen[other]
                    )
                    if fits:
                        assert b in free and free[b] <= left
            mine.append(k)
            free[b] = free.get(b, cap) - lengths[k]
            assert free[b] >= 0


def test_bins_equal_brute_force():
    """As many bins, as full, as a search through all bins for the tightest one."""
    rng = random.Random(4)
    for _ in range(60):
        n, cap = rng.randint(1, 150), rng.choice([9, 20, 100])
        lengths = sorted((rng.randint(1, cap) for _ in range(n)), reverse=True)
        sources = [rng.choice([None, str(i)]) for i in range(n)]  # no conflicts: equally tight bins are interchangeable
        bins, offsets = packing.pack(np.array(lengths), sources, [None] * n, cap)
        want, used = brute(lengths, sources, [None] * n, cap)
        assert len(set(bins.tolist())) == used
        assert [(n, o) for n, o in zip(lengths, offsets.tolist(), strict=True)] == [(n, o) for n, o, _ in want]


def test_rows_without_an_id_spread(make_docs):
    rows = [(None, "same text", "en", None)] * 300 + [(i, f"t{i}", "en", "a") for i in range(20)]
    got = packing.best_fit(make_docs(rows), capacity=64, shard_rows=40).toPandas()
    assert len(got) == 320 and got[got.doc_id.isna()].groupby(got.bin_id // 2**32).size().max() < 100
    assert got[got.doc_id.isna()].bin_id.nunique() == 300  # copies of one text are kept apart


def test_odd_rows(odd_docs):
    got = packing.best_fit(odd_docs, capacity=64).toPandas()
    whole = got.groupby("doc_id", dropna=False).n_units.sum()
    assert len(odd_docs.collect()) == 10 and whole[0] == 1 and whole[1] == 1 and whole[5] == 16
    assert got.groupby("bin_id").n_units.sum().max() <= 64
    assert got.groupby(["bin_id", "bin_offset"]).size().max() == 1


def test_empty(odd_docs):
    assert packing.best_fit(odd_docs.limit(0)).count() == 0


def test_several_shards(make_docs):
    rng = random.Random(5)
    words = ["".join(rng.choices("abc ", k=rng.randint(0, 150))) for _ in range(60)]
    rows = [(i, rng.choice(words), "en", rng.choice(["hot", "hot", "a", "b", None])) for i in range(400)]
    got = packing.best_fit(make_docs(rows), capacity=64, shard_rows=50).toPandas()
    assert 4 <= (got.bin_id // 2**32).nunique() <= 8
    assert got.groupby("doc_id").n_units.sum().to_dict() == {i: len(t) + 1 for i, t, *_ in rows}
    assert not got.duplicated(["doc_id", "piece"]).any()
    for shard, part in got.groupby(got.bin_id // 2**32):  # every shard is what one shard gives alone
        part = part.sort_values(["n_units", "doc_id", "piece"], ascending=[False, True, True])
        of = [rows[i] for i in part.doc_id]
        bins, offsets = packing.pack(part.n_units.to_numpy(), [r[3] for r in of], [r[1] or None for r in of], 64)
        assert (bins + shard * 2**32 == part.bin_id).all() and (offsets == part.bin_offset).all()
    for _, b in got.groupby("bin_id"):
        of = [rows[i] for i in b.doc_id]
        for values in ([r[3] for r in of if r[3]], [r[1] for r in of if r[1]]):
            assert len(values) == len(set(values))
        assert b.n_units.sum() <= 64
