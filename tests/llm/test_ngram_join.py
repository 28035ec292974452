import random
import re

import numpy as np
import pyarrow as pa
import pytest
from strandweave.llm import ngram_join as m
from strandweave.llm import wordhash


def brute(rows):
    sets = {}
    for k, (doc, text, *_) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = min(5, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    links = {k: set() for k in sets}
    for a in sets:
        for b in sets:
            if a != b and sets[a] and rows[a][0] is not None and rows[b][0] is not None:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                    links[a].add(b)
    out = []
    for k in sets:
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        low = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((rows[k][0], len(links[k]), low))
    return sorted(out, key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 6, 30, 80, 200]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base[:4] if rng.random() < 0.4 else base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w), "en", "a"))
    return rows


def test_links_and_classes_equal_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_ROWS", 8)
    monkeypatch.setattr(m, "SMALL", 3)
    rows = corpus(1) + [(500, None, None, None), (501, "", "en", "a"), (502, " \n", "en", "a"), (None, "w1 w2", "en", "a"), (503, "w1 w2", "en", "a"), (504, "w1 w2", "en", "a"), (504, "w1 w2", "en", "a")]
    got = sorted(((r["doc_id"], r["n_links"], r["component_id"]) for r in m.near_duplicates(make_docs(rows)).collect()), key=str)
    assert got == brute(rows)
    assert sum(n > 0 for _, n, _ in got) > 60


def test_depth_reaches_the_target():
    d = m.forest_depth()
    assert 1 - (1 - 0.8**d) ** m.TREES >= m.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** m.TREES
    for n in range(1, 40):  # every similarity that a set of n can have with any other
        can = {i / u for i in range(1, n + 1) for u in range(n, 200) if i / u >= 0.8 - 1e-12}
        assert m.least_similarity(n) == pytest.approx(min(can))
    assert m.forest_depth(m.least_similarity(3)) == m.DEPTH > m.forest_depth(m.least_similarity(7)) > d


def test_rows_of_one_id(make_docs):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(7, a, "en", "x"), (7, b, "en", "x"), (7, b, "en", "w"), (8, a + " tail", "en", "x"), (9, b + " tail", "en", "x"), (3, "other words", "en", "x")]
    got = sorted((r["doc_id"], r["n_links"], r["component_id"]) for r in m.near_duplicates(make_docs(rows)).collect())
    assert got == [(3, 0, 3), (7, 1, 7), (7, 2, 7), (7, 2, 7), (8, 1, 7), (9, 2, 7)]
    kept = sorted((r["doc_id"], r["text"], r["source"]) for r in m.keep_one(make_docs(rows)).collect())
    assert kept == [(3, "other words", "x"), (7, a, "x")]


def test_trees_are_read_in_order(make_docs):
    """Runs are complete however partitions cut them, and low marks equal whole keys."""
    rows = corpus(6, 300)
    nodes = m.signatures(make_docs(rows), 3, 4, 0.8, 0.99).filter("octet_length(values) > 0").groupBy("copy").agg(*[m.F.min(c).alias(c) for c in ("doc_id", "values")])
    values = {r["doc_id"]: np.frombuffer(r["values"], ">u2").reshape(3, 4) for r in nodes.collect()}
    want = {}
    for d, v in values.items():
        for t in range(3):
            want.setdefault((t, tuple(v[t][:2])), set()).add(d)
    got, deep = {}, set()
    for r in m.tries(nodes, 3, 4, 2).collect():
        got.setdefault(r["bucket"], set()).add(r["doc_id"])
        if r["doc_id"] != r["low"]:
            deep.add((r["doc_id"], r["low"]))
    assert sorted(sorted(x) for x in got.values() if len(x) > 1) == sorted(sorted(x) for x in want.values() if len(x) > 1)
    assert deep and all(any((values[u][t] == values[v][t]).all() for t in range(3)) for u, v in deep)


@pytest.mark.parametrize("same", [lambda h: h, lambda h: h & np.uint64(7), lambda h: h * np.uint64(0)])
def test_shingles_are_compared_word_by_word(same, monkeypatch):
    texts = [t for _, t, *_ in corpus(3, 30)] + ["", None, "one", "one two", "one two one two one two one two", "é one two three four five"]
    want = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = min(5, len(w))
        want.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    mix = wordhash.mix
    monkeypatch.setattr(wordhash, "mix", lambda h: same(mix(h)))
    got = [set(x.tolist()) for x in m.exact_sets(pa.array(texts))]
    assert [len(x) for x in got] == [len(x) for x in want]
    assert all(len(got[i] & got[j]) == len(want[i] & want[j]) for i in range(len(got)) for j in range(len(got)))


def test_recall_of_the_forest(make_docs):
    """Pairs at 0.8 to 0.9 between a stated query set and all rows."""
    rng, rows = random.Random(8), []
    for i in range(0, 600, 3):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(40, 150))]
        rows.append((i, " ".join(w), "en", "a"))
        for k in (1, 2):
            x = list(w)
            for _ in range(max(1, len(w) // 60)):
                x[rng.randrange(len(x))] = "changed"
            rows.append((i + k, " ".join(x), "en", "a"))
    want = {(d, n, c) for d, n, c in brute(rows) if d % 100 == 0}
    got = {(r["doc_id"], r["n_links"], r["component_id"]) for r in m.near_duplicates(make_docs(rows)).collect() if r["doc_id"] % 100 == 0}
    assert got == want and sum(n for _, n, _ in want) > 3


def test_odd_rows_and_empty(odd_docs):
    got = m.near_duplicates(odd_docs).collect()
    assert len(got) == 10 and {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    assert [r["n_links"] for r in got if r["doc_id"] in (0, 1, 2, 3, 7)] == [0] * 5
    assert m.near_duplicates(odd_docs.limit(0)).count() == 0
    assert m.keep_one(odd_docs).count() == 8
