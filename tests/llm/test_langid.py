import random
import zlib
from collections import Counter

import numpy as np
from strandweave.llm import langid as m


def brute_profile(texts, top):
    count = Counter()
    for text in texts:
        word, out = "", []
        for c in (text or "").lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                w = f"\1{word}\1"
                count.update((1, 0, c) for c in word)
                count.update((2, a, b) for a, b in zip(w, w[1:], strict=False))
                count.update((3, *w[i : i + 3]) for i in range(len(w) - 2))
                word = ""
    num = lambda c: 1 if c == "\1" else ord(c) + 2
    key = lambda g: (-count[g], g[0], [num(c) for c in g[1:] if c])
    return [g for g in sorted(count, key=key)[:top]]


def brute_predict(text, profiles, top):
    mine = brute_profile([text], top)
    if not mine:
        return "und", 0.0
    dist = {k: sum(abs(i - p.index(g)) if g in p else top for i, g in enumerate(mine)) for k, p in profiles.items()}
    best = min(sorted(dist), key=dist.get)
    return best, 1 - dist[best] / (top * len(mine))


def corpus():
    rng = random.Random(7)
    bits = {"xx": ["tha", "ing", "en", "ou", "é"], "yy": ["ung", "sch", "ö", "ke", "it"], "zz": ["ción", "do", "os", "ñ", "ie"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(bits))
        text = " ".join("".join(rng.choices(bits[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 60))) + rng.choice([".", "!", " 12", ""])
        rows.append((i, text, lang if rng.random() < 0.95 else None, "a"))
    return rows


def test_equals_brute_force_and_holds_out(make_docs):
    rows = corpus()
    got = {r["doc_id"]: r for r in m.predict(make_docs(rows), m.learn(make_docs(rows), top=40)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    profiles = {k: brute_profile([t for i, t, lang, _ in rows if lang == k and not held[i]], 40) for k in ("xx", "yy", "zz")}
    for i, text, _, _ in rows:
        want = brute_predict(text, profiles, 40)
        assert got[i]["held_out"] == held[i]
        assert (got[i]["lang_pred"], round(got[i]["score"], 9)) == (want[0], round(want[1], 9))
    mine = [got[i]["lang_pred"] == lang for i, _, lang, _ in rows if held[i] and lang]
    assert sum(mine) > 0.97 * len(mine)


def test_odd_rows(odd_docs, make_docs):
    got = m.language_id(odd_docs)
    assert [f.name for f in got.schema] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == 10 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert m.language_id(odd_docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in m.language_id(make_docs([(1, "abc", None, None)])).collect()} == {"und"}
    assert m.keep_known(odd_docs).count() == 7 and m.keep_known(odd_docs).columns == odd_docs.columns


def test_unlearned_languages_are_rejected(make_docs):
    """A floor from the training texts: prose of the learned languages stays, other text goes."""
    rng = random.Random(3)
    common = {"en": "the of and to in is that it was for on with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines es jahr zwei jahren diese dieser wieder keine".split()}
    rows = [(i, " ".join(rng.choices(common[lang], k=rng.randint(40, 120))), lang, "a") for i, lang in enumerate(["en", "de"] * 600)]
    strange = {
        5000: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900)),
        5001: "Suomen kieli kuuluu itämerensuomalaisiin kieliin ja sitä puhutaan pääasiassa Suomessa jossa se on toinen virallisista kielistä " * 2,
        5002: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem " * 2,
        5003: "12 34 !!",
    }
    kept = {r["doc_id"] for r in m.keep_known(make_docs(rows + [(k, t, "en", "a") for k, t in strange.items()])).collect()}
    assert not kept & set(strange)
    assert len(kept) > 0.98 * len(rows)


def test_profiles_and_floors_come_from_all_training_texts(make_docs, monkeypatch):
    """Far more texts than any sample took: ranks and floors are those of all of them."""
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("abcde" if i % 2 else "efghé", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 9))), ["xx", "yy"][i % 2], "a") for i in range(9000)]
    monkeypatch.setattr(m, "PENDING", 5000)
    model = m.learn(make_docs(rows), top=60, floors=True)
    learned = [(t, lang) for i, t, lang, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    num = lambda c: 1 if c == "\1" else ord(c) + 2
    for k, lang in enumerate(model.langs):
        want = brute_profile([t for t, own in learned if own == lang], 60)
        mine = sorted((r, c) for r, c in zip(model.rank[:, k].tolist(), model.codes.tolist(), strict=True) if r >= 0)
        packed = [sum(num(c) << 21 * p for p, c in enumerate(reversed([c for c in g[1:] if c]))) for g in want]
        assert [c for _, c in mine] == packed
        scores = [score for t, own in learned if own == lang for got, score in [model.predict(t)] if got == lang]
        low, mid = np.percentile(scores, [25, 50])
        assert len(scores) > 3000 and abs(model.floor[lang] - (mid - m.REACH * (mid - low)) * len(scores) / (len(scores) + m.PRIOR)) < 1e-9
