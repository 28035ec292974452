import random
import re
from collections import Counter

from strandweave.llm import quality as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    hit = {p for i, t in enumerate(tri) if n[t] > 1 for p in (i, i + 1, i + 2)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_lines": len(lines),
    }


def bucket(v):
    """Lowest and highest value of a value's bucket."""
    e = max(0, v.bit_length() - 6)
    return (v >> e) << e, (((v >> e) + 1) << e) - 1


def fence(values, side):
    q = {p: bucket(sorted(values)[-(-len(values) * p // 100) - 1]) for p in (5, 25, 50, 75, 95)}
    if side == "hi":
        return max(q[75][1] + m.REACH * (q[75][1] - q[50][0]), q[95][1])
    return max(0, min(q[25][0] - m.REACH * (q[50][1] - q[25][0]), q[5][0]))


def brute(rows):
    """By place in ``rows`` and, for unique ids, by id."""
    out, groups = {}, {}
    for at, (doc, text, lang, source, *_) in enumerate(rows):
        b = base(text)
        b["base_failed"] = b["n_words"] < 50 or 100 * b["n_repeat_words"] > 50 * b["n_words"]
        b["key"] = (lang or "", source or "")
        b["value"] = {k: s * b[n] // max(b[d], 1) for k, (n, d, s, _) in m.METRICS.items()}
        out[doc, at] = b
        if not b["base_failed"]:
            for key in (b["key"], b["key"][0]):
                groups.setdefault(key, []).append(b["value"])
    for b in out.values():
        own, ok = groups.get(b["key"]), True
        for k, side in m.SIDES if own else []:
            limit = [fence([x[k] for x in some], side) for some in (own, groups[b["key"][0]])]
            limit = (len(own) * limit[0] + m.PRIOR * limit[1]) // (len(own) + m.PRIOR)
            ok &= b["value"][k] <= limit if side == "hi" else b["value"][k] >= limit
        b["kept"] = not b["base_failed"] and ok
    return {doc: b for (doc, _), b in out.items()}


def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(700):
        n = rng.choice([10, 60, 90, 200])
        w = [rng.choice(["of", "and"]) if rng.random() < 0.2 else "x" * rng.randint(1, 9) + str(rng.randint(0, 500)) for _ in range(n)]
        if rng.random() < 0.1:
            w = [x + rng.choice(["###", "$$$", "|"]) for x in w]
        if rng.random() < 0.1:
            w = w[:7] * (n // 5)
        if rng.random() < 0.05:
            w = [x * 9 for x in w]
        sep = ["\n" if rng.random() < 0.1 else rng.choice([" ", " ", "\t"]) for _ in w]
        rows.append((i, "".join(a + b for a, b in zip(w, sep, strict=True)), rng.choice(["en", "en", "fr", None]), rng.choice(["hot", "hot", "hot", "a", "b"])))
    return rows


def test_equals_brute_force(make_docs):
    rows = corpus()
    want = brute(rows)
    for r in m.quality_rules(make_docs(rows)).collect():
        w = want[r["doc_id"]]
        for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"):
            assert r[c] == w[c], (r["doc_id"], c)
    assert sorted(r["doc_id"] for r in m.keep_good(make_docs(rows)).collect()) == sorted(d for d, w in want.items() if w["kept"])
    assert 50 < sum(w["kept"] for w in want.values()) < 650 and any(not w["kept"] and not w["base_failed"] for w in want.values())


def test_equal_hashes_of_different_windows(make_docs):
    """The two windows agree on the 44 hash bits that a text of over 65,536 words has left."""
    a, b = "x1149021 b c", "x1310953 b c"
    far = " ".join(f"f{i}" for i in range(66_000))
    rows = [(1, f"{a} {far} {b}", "en", "a"), (2, f"{a} {b} {far} {a}", "en", "a"), (3, f"{far} {b} - {a} {b}", "en", "a")]
    got = {r["doc_id"]: r["n_repeat_words"] for r in m.quality_rules(make_docs(rows)).collect()}
    assert got == {d: base(t)["n_repeat_words"] for d, t, *_ in rows} == {1: 0, 2: 6, 3: 6}


def test_odd_rows(odd_docs):
    rows = m.quality_rules(odd_docs).collect()
    assert len(rows) == 10 and [r["n_words"] for r in rows if r["doc_id"] in (0, 1, 2)] == [0, 0, 0]
    for r in rows:
        for d in odd_docs.filter("doc_id is not null").collect():
            if d["doc_id"] == r["doc_id"]:
                assert r["n_repeat_words"] == base(d["text"])["n_repeat_words"]
    assert m.quality_rules(odd_docs.limit(0)).count() == 0
    assert m.keep_good(odd_docs).columns == odd_docs.columns


def test_no_python_on_the_main_path(odd_docs):
    plan = m.quality_rules(odd_docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_many_groups_are_not_broadcast(make_docs, monkeypatch):
    rows, want = corpus(), brute(corpus())
    monkeypatch.setattr(m, "BROADCAST_GROUPS", 0)
    got = m.quality_rules(make_docs(rows)).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {d: w["kept"] for d, w in want.items()} and len(got) == len(rows)


def test_fences_follow_the_source(make_docs):
    """Two sources of one language whose documents differ in symbols and word length."""
    rng, rows = random.Random(4), []
    for i in range(1200):
        own = i % 2
        w = ["x" * rng.randint(2 + 5 * own, 5 + 5 * own) + str(rng.randint(0, 900)) for _ in range(80)]
        w[:: 9 if own else 40] = [x + "#" for x in w[:: 9 if own else 40]]
        rows.append((i, " ".join(w), "en", "ab"[own]))
    got = {r["_group"]["source"]: r for r in m.limits(m.base_counts(make_docs(rows))).collect()}
    assert got["b"]["symbols_hi"] > 1.2 * got["a"]["symbols_hi"] and got["b"]["word_len_lo"] > got["a"]["word_len_lo"]
    assert got["b"]["word_len_hi"] > 1.2 * got["a"]["word_len_hi"]
    strange = [(5000, rows[1][1], "en", "a"), (5001, rows[3][1], "en", "b")]
    kept = {r["doc_id"]: r["kept"] for r in m.quality_rules(make_docs(rows + strange)).collect()}
    assert not kept[5000] and kept[5001]


def test_equal_ids_and_clashing_names(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), "few words"
    rows = [(1, good, "en", "a", 3, "x"), (1, bad, "en", "a", 3, "x"), (1, good, "en", "a", 3, "x"), (None, good, "en", "a", 3, "x"), (None, bad, None, None, 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, _group string")
    assert sorted(map(str, m.keep_good(docs).collect())) == sorted(str(r) for r in docs.collect() if r["text"] == good)
    assert sorted(r["kept"] for r in m.quality_rules(docs).collect()) == [False, False, True, True, True]
