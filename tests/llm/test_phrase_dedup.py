import random
import re

import numpy as np
import pyarrow as pa
import pytest
from strandweave.llm import phrase_dedup as m
from strandweave.llm import repeats


def brute(rows, n):
    docs = sorted(((d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows if d is not None), key=lambda x: x[0])
    least: dict = {}
    for d, w in docs:
        for i in range(len(w) - n + 1):
            least.setdefault(tuple(w[i : i + n]), d)
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    passages = [[f"p{rng.randint(0, 60)}" for _ in range(rng.randint(8, 50))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                p = passages[min(rng.randrange(8), rng.randrange(8))]
                a = rng.randint(0, 5)
                w += p[a : a + rng.randint(5, 50)]
            else:
                w += [rng.choice(["of", "the", f"w{rng.randint(0, 300)}"]) for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.1:
                w += ["same"] * rng.randint(1, 40)
        rows.append((i * 3 + rng.randint(0, 2), "".join(x + rng.choice([" ", " ", "\n", " \t"]) for x in w), "en", "a"))
    for i in range(0, n, 10):
        rows.append((1000 + i, rows[i][1], "en", "b"))
    for i in range(0, n, 7):  # one id with several texts, longer and shorter, and repeated rows
        rows += [(rows[i][0], rows[i + 3][1], "en", "c"), (rows[i][0], rows[i + 5][1], "en", "c"), rows[i]]
    return rows


def test_equals_brute_force(make_docs, monkeypatch):
    for seed, flush, hot in ((1, 10**6, 4096), (2, 50, 4096), (3, 10**6, 3), (4, 50, 2)):
        monkeypatch.setattr(repeats, "FLUSH", flush)
        monkeypatch.setattr(repeats, "HOT", hot)
        monkeypatch.setattr(repeats, "HOT_SHARE", 10**9 if hot < 10 else 10)
        rows = corpus(seed)
        got = sorted(tuple(r) for r in m.remove(make_docs(rows)).collect())
        want = brute(rows, 13)
        assert got == want
        assert sum(r[2] > 0 for r in want) > 50


def test_kept_rows(make_docs):
    rows = [*corpus(5), (None, "left as it is " * 9, "en", "z"), (9001, " \n", "en", "z")]
    docs = make_docs(rows)
    got = m.keep_rest(docs)
    assert got.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) and r["shard"] == "x" and r["slot"] == 0.5 for r in got.collect())
    want = sorted((r[0], r[3]) for r in brute(rows[:-2], 13) if r[1] > r[2])
    assert sorted((r["doc_id"], " ".join(r["text"].split())) for r in got.collect() if r["doc_id"] is not None) == want
    assert [r["text"] for r in got.collect() if r["doc_id"] is None] == ["left as it is " * 9]


def test_odd_rows(odd_docs):
    got = m.digests(odd_docs).collect()
    assert len(got) == 10 and all(r["n_removed"] == 0 for r in got)
    assert m.remove(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize(("count", "anchors", "symbols"), [(70_000, 1, None), (70_000, 70, None), (300, 1, 100), (300, 5, 400)])
def test_more_words_than_code_points(count, anchors, symbols, monkeypatch):
    if symbols:
        monkeypatch.setattr(m, "SYMBOLS", symbols)
    rng = random.Random(count + anchors)
    heads = np.array([f"a{i} b c d" for i in range(20_000)])
    data = " ".join(heads).encode()
    u = repeats.word_units(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    lowest = heads[np.argsort(repeats.wordhash.mix(_fourfold(u.hash))[::4])[:anchors]]  # smallest in any window
    texts: list[list[str]] = []
    for i in range(count):
        left, right = ([f"{side}{i}.{k}" for k in range(9)] for side in "lr")
        same = lambda i=i: texts[i - anchors * rng.randint(1, i // anchors)]
        if i >= anchors and rng.random() < 0.05:
            left = same()[:9]
        if i >= anchors and rng.random() < 0.05:
            right = same()[13:]
        texts.append(left + lowest[i % anchors].split() + right)
    raw = [" ".join(t).encode() + b" " for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    u = repeats.word_units(np.frombuffer(b"".join(raw), np.uint8), offsets)
    h, text, first, last, anchor = repeats.cut_segments(u, 13, 4)
    low, high = first - u.first[text], last + 13 - u.first[text]
    content = [" ".join(texts[t][a:b]).encode() for t, a, b in zip(text.tolist(), low.tolist(), high.tolist(), strict=True)]
    assert len({w for c in content for w in c.split()}) > (symbols or 1_112_063)
    part = pa.table({"data": [repeats.block_of((h.view(np.int64) | (anchor - first) << 56).tolist(), text.tolist(), [0] * len(text), (low << 32 | high).tolist(), content)]})
    gone: list[set] = [set() for _ in texts]
    for r in m.locate(part).to_pylist():
        gone[r["doc_id"]].update(range(r["low"], r["high"]))
    want = brute([(d, " ".join(t)) for d, t in enumerate(texts)], 13)
    assert [len(g) for g in gone] == [r[2] for r in want]
    assert sum(map(bool, gone)) > count // 50


def _fourfold(h):
    with np.errstate(over="ignore"):
        p = np.uint64(0x9E3779B97F4A7C15)
        two = h[:-1] * p + h[1:]
        return two[:-2] * (p * p) + two[2:]
