import numpy as np
import pytest
from strandweave.llm import common
from strandweave.llm import token_output as m

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")


def test_chunks_give_the_librarys_ids():
    import random

    enc, rng = m.WordEncoder(RANKS, P.PATTERN, bound=50), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(list("ab 1\n.,'\té日🎉") + ["the ", " in", "  "], k=rng.randint(0, 30)))
        assert np.frombuffer(enc.encode(text), "<u2").tolist() == enc.library.encode_ordinary(text)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    x = np.arange(n)
    got = m.permute(x, n)
    assert sorted(got) == list(range(n))
    assert n < 64 or (got != x).mean() > 0.9
    assert n < 64 or (m.permute(x, n, key=5) != got).any()


def texts_of(stream, lib):
    out, low = [], 0
    for k in np.flatnonzero(stream == m.END):
        out.append(lib.decode(stream[low:k].tolist()))
        low = k + 1
    assert low == len(stream)
    return out


def stream_of(rows, layout):
    """The ids of all texts in order, by undoing the permutation."""
    by_slot = {r["slot"]: np.frombuffer(r["ids"], "<u2") for r in rows}
    assert sorted(by_slot) == list(range(layout.sequences))
    return np.concatenate([by_slot[s] for s in m.permute(np.arange(layout.sequences), layout.sequences, layout.key).tolist()])


def test_round_trip_and_resume(spark, odd_docs, make_docs, tmp_path):
    docs = odd_docs.union(make_docs([(100 + i, f"text {i} " * (i % 40), "en", "a") for i in range(300)]))
    want = [r["text"] or "" for r in docs.orderBy(m.F.col("doc_id"), m.F.xxhash64("text")).collect()]
    lib = m.encoder(RANKS, P.PATTERN).library
    size = {"length": 64, "shard": 16, "wave": 100}
    layout = m.materialise(docs, str(tmp_path / "a"), RANKS, P.PATTERN, **size)
    assert layout.shards > 200
    rows = m.read_from(spark, layout).collect()
    assert texts_of(stream_of(rows, layout), lib) == want
    assert layout.tokens == sum(len(lib.encode_ordinary(t)) + 1 for t in want)

    # the bytes of a file, straight from their offset
    files = {r["shard"]: r["path"].removeprefix("file:") for r in m.shard_files(spark, layout).select("shard", "path").collect()}
    assert sorted(files) == list(range(layout.shards))
    for r in rows[:: len(rows) // 40]:
        with open(files[r["shard"]], "rb") as f:
            f.seek(r["byte_offset"])
            data = f.read(layout.stride)
        assert data[: 2 * r["n_tokens"]] == r["ids"] and data.endswith(m.TAIL) and len(data) == layout.stride
        assert set(np.frombuffer(data[2 * r["n_tokens"] : -2], "<u2").tolist()) <= {m.PAD}
    assert [x[: 2 * r["n_tokens"]] for r in rows if r["slot"] in (40, 41) for x in m.seek(spark, layout, r["slot"])] == [r["ids"] for r in rows if r["slot"] in (40, 41)]
    # every part of every text, by the index
    bytes_of = {}
    for r in spark.read.parquet(f"{layout.path}/index").orderBy("doc_id", "piece").collect():
        if r["doc_id"] is not None and r["doc_id"] >= 100:
            own = rows_by_slot(rows)[r["slot"]]
            at = r["byte_offset"] - r["slot"] % layout.shard * layout.stride
            bytes_of[r["doc_id"]] = bytes_of.get(r["doc_id"], b"") + own[at : at + 2 * r["n_tokens"]]
    assert {d: np.frombuffer(x, "<u2").tolist() for d, x in bytes_of.items()} == {100 + i: [*lib.encode_ordinary(f"text {i} " * (i % 40)), m.END] for i in range(300)}

    # reading goes on at any slot
    assert {r["slot"] for r in m.read_from(spark, layout, 999).collect()} == set(range(999, layout.sequences))
    # a wave that was not committed is written again, the others are kept
    common.remove_folder(spark, f"{layout.path}/ids/wave=1")
    kept = [f for k, f in files.items() if k // 100 != 1]
    again = m.materialise(docs, layout.path, RANKS, P.PATTERN, **size)
    files = {r["path"].removeprefix("file:") for r in m.shard_files(spark, again).select("path").collect()}
    assert again == layout and files.issuperset(kept)
    assert sorted(m.read_from(spark, again).collect()) == sorted(rows)
    # slots depend on the table alone
    other = m.materialise(docs.repartition(7), str(tmp_path / "b"), RANKS, P.PATTERN, **size)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    third = m.materialise(docs, str(tmp_path / "c"), RANKS, P.PATTERN, **size)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(m.read_from(spark, other).collect()) == sorted(m.read_from(spark, third).collect()) == sorted(rows)


def rows_by_slot(rows, seen={}):  # noqa: B006
    if not seen:
        seen.update({r["slot"]: r["ids"] for r in rows})
    return seen


def test_rows(spark, odd_docs):
    got = m.training_order(odd_docs, RANKS, P.PATTERN).collect()
    lib = m.encoder(RANKS, P.PATTERN).library
    assert sum(r["n_tokens"] for r in got) == sum(len(lib.encode_ordinary(r["text"] or "")) + 1 for r in odd_docs.collect())
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in odd_docs.collect()}
    assert m.training_order(odd_docs.limit(0), RANKS, P.PATTERN).count() == 0
    common.sweep(spark)


@pytest.mark.parametrize("bound", [5, 10_000])
def test_chunks_equal_the_library(bound):
    enc = m.WordEncoder(RANKS, P.PATTERN, bound)
    for t in ["", " ", "a b", "don't  stop", "x\n y", " lead", "tail ", "日本 語 a1 b22 c333", "a\t b \n\n c", "it's we're I'll " * 30]:
        assert enc.encode(t) == np.array(enc.library.encode_ordinary(t), "<u2").tobytes()


def test_one_wave_at_a_time_is_on_the_disk(spark, make_docs, tmp_path):
    """Shuffle files go with their job, and no job moves all ids."""
    import time

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before, key = shuffles(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(key, None)
    docs = make_docs([(i, f"text {i} " * 40, "en", "a") for i in range(200)])
    layout = m.materialise(docs, str(tmp_path / "a"), RANKS, P.PATTERN, length=64, shard=16)
    waves = {r["path"].split("wave=")[1].split("/")[0] for r in m.shard_files(spark, layout).select("path").collect()}
    assert waves == {"0", "1"} and layout.wave == -(-layout.shards // 2) > 1
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(key, None) == had
    assert len(m.read_from(spark, layout).collect()) == layout.sequences


def test_new_words_take_no_longer_than_in_the_library():
    """Texts of words that do not come again; lists of the library's ids are the measure."""
    import random
    import time

    enc, rng = m.WordEncoder(RANKS, P.PATTERN), random.Random(2)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=9)) for _ in range(500)) for _ in range(800)]

    def seconds(encode, texts):
        start = time.process_time()
        for text in texts:
            encode(text)
        return time.process_time() - start

    for encode in (enc.encode, enc.library.encode_ordinary):
        seconds(encode, texts[:100])
    assert seconds(enc.encode, texts[100:]) < 1.5 * seconds(enc.library.encode_ordinary, texts[100:])


@pytest.mark.parametrize("text", [" " * 2_000_000 + "x", "a" + "\n" * 2_000_000 + "x y", "a b" + " \t" * 1_000_000, "a" + "\x1c" * 1_000_000])
def test_white_space_longer_than_the_pattern_takes(text):
    enc = m.encoder(RANKS, P.PATTERN)
    assert enc.library.decode(np.frombuffer(enc.encode(text), "<u2").tolist()) == text


def test_cuts_at_white_space_give_the_librarys_ids(monkeypatch):
    import random
    import re

    monkeypatch.setattr(m, "LONG", 3)
    monkeypatch.setattr(m, "LONG_BLANK", re.compile(m.LONG_BLANK.pattern.replace("100000", "3")))
    enc, rng = m.encoder(RANKS, P.PATTERN), random.Random(5)
    for _ in range(5000):
        text = "".join(rng.choices([*"\t\n\v\r\x85\xa0 　", *" " * 9, "a", "é", "1", ".", "'s", "\x1c", "​", "<|endoftext|>"], k=rng.randint(0, 14)))
        assert np.frombuffer(enc.encode(text), "<u2").tolist() == enc.library.encode_ordinary(text)
