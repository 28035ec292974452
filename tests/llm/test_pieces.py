import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from strandweave.llm import pieces as m

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")


def test_equals_the_library():
    c, rng = m.PieceCodec(MODEL, bound=300), random.Random(2)
    alphabet = list("abc ▁\n.,'\"_éß日🎉\t-1\0") + ["the ", " in", "er", "  ", "..", "tion"]
    texts = ["", " ", "  a", "<s></s><unk>", "▁", "." * 100, " " * 70, "x²Ⅷ½.com", "ab" * 400] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        want = c.library.encode(t, add_bos=True, add_eos=True)
        assert c.encode(t) == want
        assert c.decode(want) == c.library.decode(want)


def test_both_agendas_agree():
    c, rng = m.PieceCodec(MODEL), random.Random(3)
    for size in (1, 2, 3, 7, 20, 40):
        segs = ["".join(rng.choices("▁theinorast日🎉", k=size)) for _ in range(300)]
        sym, left = c._merge_batch(segs)
        for seg, row, n in zip(segs, sym.tolist(), left.tolist(), strict=True):
            want = c._merge_long(seg)
            assert n == len(want)
            assert [x if x < c.pieces else None for x in row[:n]] == [int.from_bytes(c.ids[p], "little") if p in c.ids else None for p in want]


def test_generations_of_the_cache():
    c, rng = m.PieceCodec(MODEL, bound=50), random.Random(4)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abcde", k=4)) for _ in range(20)) for _ in range(5)]
        assert c.encode_texts(texts) == [np.array(c.library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes() for t in texts]
        assert len(c.known) <= 150 + 50


def test_rows(odd_docs):
    got = m.digests(odd_docs, MODEL).collect()
    lib = m.codec(MODEL).library
    texts = {d["doc_id"]: d["text"] or "" for d in odd_docs.collect()}
    assert len(got) == 10
    for r in got:
        ids = lib.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert m.digests(odd_docs.limit(0), MODEL).count() == 0


@pytest.mark.parametrize("wrong", [None, 0, 1, 70])
def test_every_text_is_checked(wrong, monkeypatch):
    texts = [f"text number {i}" for i in range(100)]
    cut = m.codec(MODEL).cut
    letters = SimpleNamespace(findall=lambda s: list(s) if wrong is not None and s.endswith(f"▁{wrong}") else cut.findall(s))
    monkeypatch.setattr(m.codec(MODEL), "cut", letters)
    column = SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))
    docs = SimpleNamespace(schema={"doc_id": column}, select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], ["doc_id", "text"])
    run = m.encode_decode(docs, MODEL)
    if wrong is None:
        got = next(run([batch]))
        assert got.column(2).to_pylist() == texts
        assert all(got.column(3).to_pylist())
    else:
        got = next(run([batch]))
        assert got.column(2).to_pylist() == texts
        assert [k for k, ok in enumerate(got.column(3).to_pylist()) if not ok] == [wrong]
        lib = m.codec(MODEL).library
        assert got.column(1).to_pylist() == [np.array(lib.encode(t, add_bos=True, add_eos=True), "<u4").tobytes() for t in texts]


def checked(texts):
    column = SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))
    docs = SimpleNamespace(schema={"doc_id": column}, select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    got = next(m.encode_decode(docs, MODEL)([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])]))
    return [got.column(k).to_pylist() for k in (1, 2, 3)]


def library_ids(texts):
    lib = m.PieceCodec(MODEL).library
    return [np.array(lib.encode(t, add_bos=True, add_eos=True), "<u4").tobytes() for t in texts]


def test_segments_go_to_the_library_once(monkeypatch):
    c, rng = m.PieceCodec(MODEL), random.Random(6)
    monkeypatch.setitem(m._codecs, MODEL, c)
    words = ["".join(rng.choices("etaoinshrd", k=6)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(100)]
    lib, seen = c.library, []
    c.library = SimpleNamespace(encode=lambda t, **kw: seen.append(t) or lib.encode(t, **kw), decode=lib.decode)
    assert checked(texts) == [library_ids(texts), texts, [True] * 100]
    assert all(w in "".join(seen) for w in words)
    assert sum(map(len, seen)) < sum(map(len, texts)) / 20


@pytest.mark.parametrize("check", [1, 40, 1 << 14])
def test_a_wrong_segment_is_found(check, monkeypatch):
    c = m.PieceCodec(MODEL)
    monkeypatch.setitem(m._codecs, MODEL, c)
    monkeypatch.setattr(m, "CHECK", check)
    texts = ["some words here", "words and others", "x" * 50 + " y", f"a {c.shield}b {c.shield}", "", "others alone", "others again"]
    merge, long = c._merge_batch, c._merge_long

    def wrong(segs):
        sym, left = merge(segs)
        for k, seg in enumerate(segs):
            if seg == "▁words":
                sym[k, 0] = c.symbol_of[ord("q")]
        return sym, left

    monkeypatch.setattr(c, "_merge_batch", wrong)
    monkeypatch.setattr(c, "_merge_long", lambda seg: list(seg) if c.shield in seg or len(seg) > 40 else long(seg))
    for _ in range(2):  # learned, then known
        assert checked(texts) == [library_ids(texts), texts, [False, False, False, True, True, True, True]]


def test_cuts_against_all_pairs_of_pieces():
    c, rng = m.PieceCodec(MODEL), random.Random(7)
    pairs = {p[k : k + 2] for p in c.score for k in range(len(p) - 1)}
    texts, rows = [], []
    for _ in range(3000):
        text = "".join(rng.choices([*"▁aethn", "\n", "日", "q", "7", "²", "."], k=rng.randint(0, 8)))
        cuts = sorted(rng.choices(range(len(text) + 1), k=rng.randint(0, 3)))
        row = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if text else []
        texts.append(text)
        rows.append(row[:-1] if rng.random() < 0.1 else row)
    want = []
    for text, row in zip(texts, rows, strict=True):
        full = [x for x in row if x]
        want.append("".join(row) == text and not any(a[-1] + b[0] in pairs for a, b in zip(full, full[1:], strict=False)))
    assert 500 < sum(want) < 2500
    assert c._cuts_hold(texts, rows) == want
    for text, row, ok in zip(texts[:300], rows, want, strict=False):
        assert c._cuts_hold([text], [row]) == [ok]


def test_signs_stay_with_what_pieces_join_them_to():
    """Quotation marks, dashes and other signs beyond ASCII: the operator's own ids, no text left to the library."""
    c, rng = m.PieceCodec(MODEL), random.Random(8)
    alphabet = [*map(chr, range(32, 127)), *"\n\t\r“”‘’—–…«»°·²½éßжλ日あ한🎉▁\u00a0\u200b\u0301\x85", *" " * 20]
    texts = ["“Yes,” they said — ‘no’…", "a “b”. (“c”), «d». [… e]", "——", "5 °C"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(3000)]
    ids, hold, same = c.encode_checked(texts)
    assert ids == library_ids(texts)
    assert all(hold) and all(same)
