import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from strandweave.llm import repeats, substring_dedup, suffixes


@pytest.mark.parametrize("seed", range(30))
def test_suffix_order(seed):
    rng = random.Random(seed)
    n, depth = rng.randint(1, 300), rng.choice([1, 3, 8, 20, 50])
    s = np.array([rng.randint(0, rng.choice([1, 2, 5, 200])) for _ in range(n)], np.uint8)
    if seed % 3 == 0:
        s = np.tile(s[: 1 + n // 7], 9)
    at = suffixes.order(s, depth)
    assert sorted(at) == list(range(len(s)))
    keys = [s[i : i + depth].tobytes() for i in at]
    assert keys == sorted(keys)
    ok = np.arange(len(s)) + depth <= len(s)
    group = suffixes.repeats(s, ok, depth)
    seen: dict = {}
    for i in np.flatnonzero(ok):
        assert seen.setdefault(group[i], s[i : i + depth].tobytes()) == s[i : i + depth].tobytes()
    assert len(seen) == len(set(seen.values()))


def brute(rows, n):
    docs = sorted(((d, (t or "").encode()) for d, t, *_ in rows if d is not None), key=lambda x: x[0])
    least: dict = {}
    for d, w in docs:  # rows of one id are neighbours and do not remove each other
        for i in range(len(w) - n + 1):
            least.setdefault(w[i : i + n], d)
    out = []
    for d, w in docs:
        mask = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - n + 1):
            if least[w[i : i + n]] < d:
                mask[i : i + n] = True
        m = mask[:-1]
        out.append((d, len(w), int(m.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), bytes(b for b, x in zip(w, m, strict=True) if not x)))
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdeé日 \n") for _ in range(k))
    passages = [text(rng.randint(20, 200)) for _ in range(8)] + ["a" * 120, "ab" * 90]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.6:
                p = passages[min(rng.randrange(10), rng.randrange(10))]
                a = rng.randint(0, 20)
                t += p[a : a + rng.randint(10, 200)]
            else:
                t += text(rng.randint(1, 60))
        rows.append((i * 2 + rng.randint(0, 1), t, "en", "a"))
    for i in range(0, n, 9):
        rows.append((1000 + i, rows[i][1], "en", "b"))
    for i in range(0, n, 7):  # one id with several texts, longer and shorter, and repeated rows
        rows += [(rows[i][0], rows[i + 3][1], "en", "c"), (rows[i][0], rows[i + 5][1], "en", "c"), rows[i]]
    return rows


def test_equals_brute_force(make_docs, monkeypatch):
    for seed, flush, chunk, hot in ((1, 10**6, 1 << 20, 4096), (2, 50, 400, 4096), (3, 10**6, 1 << 20, 3), (4, 50, 400, 2)):
        monkeypatch.setattr(repeats, "FLUSH", flush)
        monkeypatch.setattr(repeats, "HOT", hot)
        monkeypatch.setattr(repeats, "HOT_SHARE", 10**9 if hot < 10 else 10)
        monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
        rows = corpus(seed)
        got = sorted((*r[:4], bytes(r[4])) for r in substring_dedup.remove(make_docs(rows)).collect())
        assert got == brute(rows, 50)
        assert sum(r[2] > 0 for r in got) > 30


def test_odd_rows(odd_docs):
    got = substring_dedup.digests(odd_docs).collect()
    assert len(got) == 10 and all(r["n_removed"] == 0 for r in got)
    assert substring_dedup.remove(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("line", ["The and attion of", "The and attion of the words that they all have in it", "ab" * 40])
def test_one_anchor_above_the_limit(line, monkeypatch):
    monkeypatch.setattr(suffixes, "LIMIT", 3000)
    n, k, rng = 50, 16, random.Random(line)
    ends = ["".join(rng.choice("abcde") for _ in range(40)) for _ in range(120)]
    texts = [(rng.choice(ends) + line + rng.choice(ends)).encode() for _ in range(400)]
    texts += [t[5:] for t in texts[:40]]
    offsets = np.cumsum([0, *map(len, texts)])
    data = b"".join(texts)
    h, text, first, last, anchor = repeats.cut_segments(repeats.byte_units(np.frombuffer(data, np.uint8), offsets), n, k)
    low, high = first - offsets[text], last + n - offsets[text]
    contents = [data[a : b + n] for a, b in zip(first, last, strict=True)]
    block = repeats.block_of((h.view(np.int64) | (anchor - first) << 56).tolist(), text.tolist(), [0] * len(text), (low << 32 | high).tolist(), contents)
    part = pa.table({"data": [block]})
    distinct: dict = {}
    for key, content in zip(h.tolist(), contents, strict=True):
        distinct.setdefault(key, set()).add(content)
    assert max(sum(map(len, x)) for x in distinct.values()) > suffixes.LIMIT
    got = [np.zeros(len(t), bool) for t in texts]
    for r in substring_dedup.locate(part, n, 2000).to_pylist():
        got[r["doc_id"]][r["low"] : r["high"]] = True
    want = brute([(d, t.decode()) for d, t in enumerate(texts)], n)
    assert [(int(m.sum()), bytes(b for b, x in zip(t, m, strict=True) if not x)) for t, m in zip(texts, got, strict=True)] == [(r[2], r[4]) for r in want]


def test_a_line_of_all_documents_is_dealt_to_many_buckets(make_docs, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 100)
    monkeypatch.setattr(repeats, "HOT_SHARE", 10)
    rng, line = random.Random(9), "one line that is in every document of the table, so its anchors are hot"
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(60))
    ends = [word() for _ in range(30)]
    rows = [(d, (rng.choice(ends) if d % 3 else word()) + line[rng.randint(0, 5) :] + (rng.choice(ends) if d % 5 else word()), "en", "a") for d in range(600)]
    docs = make_docs(rows)
    first = repeats.firsts(docs)
    found = repeats.candidates(first, repeats.byte_units, 50, 16)
    parts = repeats.segments(first, found, repeats.byte_units, 50, 16)
    per = Counter(r[4] for r in repeats.rows_of([b["data"] for b in parts.collect()], 50, 16) if r[-1])
    assert max(per.values()) < 200 and len(per) > 200
    got = sorted((*r[:4], bytes(r[4])) for r in substring_dedup.remove(docs).collect())
    assert got == brute(rows, 50)


def test_phrases_that_recur_by_chance_are_not_ordered(make_docs):
    """Runs of a few words that many documents hold must not send every segment to the suffix order."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(40)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    rows = [(d, " ".join(rng.choices(vocabulary, k=60)) + passage * (d % 20 == 0), "en", "a") for d in range(300)]
    first = repeats.firsts(make_docs(rows))

    def sent(k):
        parts = repeats.segments(first, repeats.candidates(first, repeats.byte_units, 50, k), repeats.byte_units, 50, k)
        return sum(len(r[-1]) - 49 for r in repeats.rows_of([b["data"] for b in parts.collect()], 50, k) if r[-1])

    windows = sum(len(t) - 49 for _, t, *_ in rows)
    assert sent(16) > 0.5 * windows and sent(substring_dedup.anchor(50)) < 0.1 * windows
    got = sorted((*r[:4], bytes(r[4])) for r in substring_dedup.remove(make_docs(rows)).collect())
    assert got == brute(rows, 50) and sum(r[2] > 200 for r in got) == 14


@pytest.mark.parametrize("n", [2, 5, 20, 33, 100])
def test_any_length(make_docs, n):
    rows = corpus(5, 60)
    got = sorted((*r[:4], bytes(r[4])) for r in substring_dedup.remove(make_docs(rows), n).collect())
    assert got == brute(rows, n)
