import math
import random
import re

from strandweave.llm import licenses as m


def brute_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute_base(words):
    out = []
    for phrase, label in m.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return sorted(out)


def brute_blocks(words, templates, threshold):
    """Every start of every template's block, one by one."""
    out = []
    for label, text in templates:
        t = brute_words(text)
        g = min(m.GRAM, len(t))
        want = {tuple(t[i : i + g]) for i in range(len(t) - g + 1)}
        size, runs = math.ceil(m.STRETCH * len(t)), []
        for start in range(len(words)):
            block = words[start : start + size]
            share = len(want & {tuple(block[i : i + g]) for i in range(len(block) - g + 1)}) / len(want)
            if share >= threshold - 1e-9:
                if runs and runs[-1][2] == start - 1:
                    runs[-1] = (label, runs[-1][1], start, max(runs[-1][3], share))
                else:
                    runs.append((label, start, start, share))
        out += runs
    return out


def test_blocks_equal_brute_force():
    rng, found = random.Random(5), 0
    short = [t for t in m.TEMPLATES if len(brute_words(t[1])) < 60] + [("x", "one"), ("y", "two words"), ("z", "a a a a b a a a a b")]
    vocab = sorted({w for _, t in short for w in brute_words(t)})[:60] + [f"x{i}" for i in range(10)]
    for trial in range(250):
        words = rng.choices(vocab, k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            t = brute_words(rng.choice(short)[1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                t.insert(rng.randrange(len(t) + 1), "more") if rng.random() < 0.5 or len(t) < 2 else t.pop(rng.randrange(len(t)))
            at = rng.randint(0, len(words))
            words[at:at] = t
        threshold = rng.choice([0.9, 0.6, 1.0])
        counts = [rng.randint(0, 9) for _ in range(m.Grams(short).total)]
        got = m.Scanner(counts, short, threshold).blocks([w.encode() for w in words])
        want = brute_blocks(words, short, threshold)
        assert sorted(got) == sorted(want)
        found += len(want)
    assert found > 200


def test_whole_license_texts():
    scanner = m.Scanner([1] * m.Grams().total)
    rng = random.Random(2)
    for label, text in m.TEMPLATES:
        words = brute_words(text)
        noise = [f"n{rng.randint(0, 99)}" for _ in range(rng.randint(0, 333))]
        assert label in {b[0] for b in scanner.blocks([w.encode() for w in noise + words + noise])}
        if len(words) > 60:
            assert label in {b[0] for b in scanner.blocks([w.encode() for w in noise + words[: len(words) // 2] + ["Jane"] + words[len(words) // 2 :]])}
            assert not scanner.blocks([w.encode() for w in sorted(words)])  # its words, in another order


def test_scattered_words_do_not_match(make_docs):
    texts = [
        "The committee released its report while MIT was under review for a driving license.",
        "Licensed drivers under review at MIT, the 2 Apache helicopters, version 0 of the license",
    ]
    rows = m.license_scan(make_docs([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    assert all(r["labels"] == "" and r["score"] == 0 for r in rows)


def test_base_counters_equal_brute_force():
    rng = random.Random(7)
    vocab = sorted({w for p, _ in m.PHRASES for w in p.split()}) + ["x"]
    for _ in range(400):
        words = rng.choices(vocab, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(m.PHRASES)[0].split()
        assert m.base_places([w.encode() for w in words]) == brute_base(words)


def test_base_phrases_and_rows(make_docs, odd_docs):
    docs = make_docs(
        [
            (1, "Under THE mit-License. under the mit license CC BY-NC 4.0", "en", "a"),
            (2, "apache license, version 2.0; xcc by nc", "en", "a"),
            (3, "This work is licensed under the GNU General Public License, version 3.", "en", "a"),
            (4, "İCC by nc", None, None),
        ]
    )
    got = {r["doc_id"]: r for r in m.license_scan(docs).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (13, 3, 0, 8, "cc-by-nc,mit")
    assert got[2]["base_labels"] == "apache-2" and got[2]["n_base"] == 1
    assert (got[3]["labels"], got[3]["base_labels"], got[3]["first_word"], got[3]["score"]) == ("gpl-3", "", None, 1.0)
    assert got[4]["n_base"] == 0
    odd = m.license_scan(odd_docs).collect()
    assert len(odd) == 10 and all(r["labels"] == "" and r["score"] == 0 for r in odd)
    for r, d in ((r, d) for r in odd for d in odd_docs.collect() if r["doc_id"] == d["doc_id"]):
        assert r["n_words"] == len(brute_words(d["text"]))
    assert m.license_scan(odd_docs.limit(0)).count() == 0
