"""Token ids in training order, written as binary shards (operator 6).

1. Texts are put in doc_id order by range partitioning and tokenised whole, with an
   end token each. Only the number of tokens of each partition reaches the driver.
2. The ids of all texts, one after the other, are cut every ``SEQUENCE`` ids. A
   sequence's ordinal depends on the table alone, not on partitions: a text's part
   of a sequence knows its place in it, and the parts meet in step 4. The last
   sequence alone is padded, with ``PAD``, which is no token.
3. A keyed Feistel network with cycle-walking permutes ordinals into global slots.
4. Slots are cut into shards of ``SHARD``. A task writes one shard as one file of
   fixed stride (``2 * SEQUENCE`` bytes of little-endian 16-bit ids, then a zero and
   a line feed), through Spark's own writer and commit, so that a lost executor
   leaves no half file and any file system will do. Slot ``s`` lies at byte
   ``(s % SHARD) * stride`` of the file of shard ``s // SHARD``.

Shards are written in ``WAVES`` waves or more, each a job of its own, whose shuffle
files go before the next: a folder whose
writing was stopped is finished by calling ``materialise`` again, which keeps the
tokens, the index and the waves that are complete. ``read_from`` goes on reading at
any slot, ``seek`` reads bytes of one file. The index says which part of which text lies
where.

Null text counts as empty and gives the end token. Repeated rows have a part each;
rows of one id are put in order by a hash of their text, and equal rows are
interchangeable. Texts of any length are cut alike. Only doc_id and text are read,
so other columns may have any name. An empty table gives no shard.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, remove_folder, scratch, shuffles_dropped

SEQUENCE = 1024
SHARD = 4096
WAVE = 10_000  # shards at most
WAVES = 2  # at least: what travels to the shards is on the disk for one wave at a time
KEY = 20240229
END, PAD = 50256, 50257
TAIL = b"\0\n"
ROUNDS = 6
LONG = 100_000
LONG_BLANK = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG},}}")  # white space of the pattern

_encoders: dict = {}


class WordEncoder:
    """Byte-level ids of whole texts, by the library, which hands them over as one buffer.

    The library's pattern goes back over a run of white space step by step and
    gives up on runs of about a million characters. Such a run is one piece
    without its last character, or to the end of the text, and what comes before
    and after it stands alone, so the text is cut there. ``bound`` is of no
    effect: it was the size of a cache of words, which took longer than the library.
    """

    def __init__(self, ranks_file: str, pattern: str, bound: int = 0):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # an end token in a text is no end token, as none is allowed
        self.library = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": END})

    def _plain(self, text: str) -> bytes:
        return self.library.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()

    def encode(self, text: str) -> bytes:
        run = LONG_BLANK.search(text) if len(text) >= LONG else None
        if run is None:
            return self._plain(text)
        out, low = [], 0
        while run:
            high = run.end() - (run.end() < len(text))
            blank = self.library._encode_single_piece(text[run.start() : high])
            out += [self._plain(text[low : run.start()]), np.array(blank, "<u2").tobytes()]
            low, run = high, LONG_BLANK.search(text, run.end())
        return b"".join(out) + self._plain(text[low:])


def encoder(ranks_file: str, pattern: str) -> WordEncoder:
    if (ranks_file, pattern) not in _encoders:
        _encoders[ranks_file, pattern] = WordEncoder(ranks_file, pattern)
    return _encoders[ranks_file, pattern]


def permute(ordinals: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Keyed bijection of 0 .. n-1: balanced Feistel rounds, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rng = np.random.Generator(np.random.Philox(key))
    keys = rng.integers(0, 1 << 63, size=ROUNDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            z = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = once(ordinals.astype(np.uint64))
        while (far := np.flatnonzero(out >= np.uint64(n))).size:
            out[far] = once(out[far])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Where a written corpus lies and how it is cut."""

    path: str
    tokens: int
    length: int = SEQUENCE
    shard: int = SHARD
    wave: int = WAVE
    key: int = KEY

    @property
    def sequences(self) -> int:
        return -(-self.tokens // self.length)

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.shard)

    @property
    def stride(self) -> int:
        return 2 * self.length + len(TAIL)


def tokenised(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row, and its place: partition and tokens before it there."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        enc, before, end = encoder(ranks_file, pattern), 0, np.array([END], "<u2").tobytes()
        for batch in batches:
            ids = [enc.encode(text or "") + end for text in batch.column(1).to_pylist()]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            start = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(start), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "start", "n_tokens", "ids"])

    return ordered.mapInArrow(run, f"doc_id {kind}, part int, start long, n_tokens long, ids binary")


def parts(tokens: DataFrame, base: dict[int, int], layout: Layout, slots: range | None = None) -> DataFrame:
    """Each text's part of each sequence: doc_id, piece, slot, at (token in the sequence), n_tokens; with ``slots``, of these alone and with ids."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    first = np.zeros(max(base, default=0) + 1, np.int64)
    first[list(base)] = list(base.values())
    length, total, key = layout.length, layout.sequences, layout.key

    def run(batches):
        for batch in batches:
            start = first[batch.column("part").to_numpy()] + batch.column("start").to_numpy()
            end = start + batch.column("n_tokens").to_numpy()
            count = (end - 1) // length - start // length + 1
            row = np.repeat(np.arange(batch.num_rows), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            ordinal = start[row] // length + piece
            low, high = np.maximum(start[row], ordinal * length), np.minimum(end[row], (ordinal + 1) * length)
            slot = permute(ordinal, total, key) if len(row) else ordinal
            if slots is not None:
                own = np.flatnonzero((slot >= slots.start) & (slot < slots.stop))
                row, piece, ordinal, low, high, slot = (x[own] for x in (row, piece, ordinal, low, high, slot))
            out = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(slot), pa.array((low - ordinal * length).astype(np.int32)), pa.array((high - low).astype(np.int32))]
            names = ["doc_id", "piece", "slot", "at", "n_tokens"]
            if slots is not None:
                data = batch.column("ids").to_pylist()
                cuts = zip(row.tolist(), (2 * (low - start[row])).tolist(), (2 * (high - start[row])).tolist(), strict=True)
                out, names = [*out, pa.array([data[k][a:b] for k, a, b in cuts], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    columns = ["doc_id", "part", "start", "n_tokens"] + ["ids"] * (slots is not None)
    return tokens.select(*columns).mapInArrow(run, f"doc_id {kind}, piece int, slot long, at int, n_tokens int" + ", ids binary" * (slots is not None))


def records(ordered: DataFrame, layout: Layout) -> DataFrame:
    """One row a slot, in order: the sequence's bytes without the closing line feed."""
    size, pad, tail = 2 * layout.length, np.array([PAD], "<u2").tobytes(), TAIL[:-1]

    def run(batches):
        slot, held = None, []
        close = lambda: _filled(b"".join(held), size, pad) + tail
        for batch in batches:
            out = []
            for s, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != slot:
                    if held:
                        out.append(close())
                    slot, held = s, []
                held.append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([close()], pa.binary())], ["value"])

    return ordered.select("slot", "ids").mapInArrow(run, "value binary")


def _filled(data: bytes, size: int, pad: bytes) -> bytes:
    return data + pad * ((size - len(data)) // len(pad))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def materialise(docs: DataFrame, path: str, ranks_file: str, pattern: str, length: int = SEQUENCE, shard: int = SHARD, wave: int | None = None, key: int = KEY) -> Layout:
    """Write tokens, index and shards of ``docs`` under ``path``; what is complete there is kept."""
    with shuffles_dropped(docs.sparkSession):
        return _materialise(docs, path, ranks_file, pattern, length, shard, wave, key)


def _materialise(docs: DataFrame, path: str, ranks_file: str, pattern: str, length: int, shard: int, wave: int | None, key: int) -> Layout:
    spark = docs.sparkSession
    if not _exists(spark, f"{path}/tokens"):
        tokenised(docs, ranks_file, pattern).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/tokens")
    tokens = spark.read.schema(tokenised(docs, ranks_file, pattern).schema).parquet(f"{path}/tokens")
    counts = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a partition
    base, total = {}, 0
    for part in sorted(counts):
        base[part], total = total, total + counts[part]
    wave = wave or min(WAVE, max(1, -(-Layout(path, total, length, shard).shards // WAVES)))
    layout = Layout(path, total, length, shard, wave, key)
    if not _exists(spark, f"{path}/index"):
        at = F.col("slot") % shard * layout.stride + 2 * F.col("at")
        parts(tokens, base, layout).select("slot", F.floor(F.col("slot") / shard).alias("shard"), at.alias("byte_offset"), "doc_id", "piece", "n_tokens").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/index")
    for k in range(0, layout.shards, wave):
        folder = f"{path}/ids/wave={k // wave}"
        if _exists(spark, folder):
            continue
        last = min(k + wave, layout.shards)
        own = parts(tokens, base, layout, range(k * shard, last * shard))
        ordered = own.repartitionById(last - k, (F.floor(F.col("slot") / shard) - k).cast("int")).sortWithinPartitions("slot", "at")
        records(ordered, layout).select(F.col("value").cast("string")).write.mode("overwrite").text(folder)
    return layout


def shard_files(spark: SparkSession, layout: Layout, first: int = 0) -> DataFrame:
    """(shard, path, length, content) of the files from shard ``first`` on."""
    if not layout.shards:
        return spark.createDataFrame([], "shard long, path string, length long, content binary")
    files = spark.read.format("binaryFile").load(f"{layout.path}/ids").filter(F.col("wave") >= first // layout.wave)
    number = F.regexp_extract(F.col("path"), "part-([0-9]+)-[^/]*$", 1).cast("long")
    return files.select((F.col("wave") * layout.wave + number).alias("shard"), "path", "length", "content").filter(F.col("shard") >= first)


def read_from(spark: SparkSession, layout: Layout, slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, n_tokens, ids) of the written sequences from ``slot`` on, in order inside a shard."""
    stride, size, shard, tokens, last = layout.stride, 2 * layout.length, layout.shard, layout.tokens, layout.sequences - 1
    short = tokens - last * layout.length
    end_slot = int(permute(np.array([last]), layout.sequences, layout.key)[0]) if layout.sequences else -1

    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(data) % stride:
                    raise ValueError("a shard's length is no multiple of the stride")
                for low in range(max(0, slot - number * shard), len(data) // stride, 4096):
                    places = range(low, min(low + 4096, len(data) // stride))
                    slots = [number * shard + k for k in places]
                    n = [short if s == end_slot else size // 2 for s in slots]
                    ids = [data[k * stride : k * stride + 2 * m] for k, m in zip(places, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([number] * len(n), pa.int64()), pa.array([k * stride for k in places], pa.int64()), pa.array(n, pa.int32()), pa.array(ids, pa.binary())], ["slot", "shard", "byte_offset", "n_tokens", "ids"])

    files = shard_files(spark, layout, slot // layout.shard).select("shard", "content")
    return files.mapInArrow(run, "slot long, shard long, byte_offset long, n_tokens int, ids binary")


def seek(spark: SparkSession, layout: Layout, slot: int, count: int = 1) -> list[bytes]:
    """``count`` sequences from ``slot`` on, of one shard: one seek and one read of its file."""
    file = shard_files(spark, layout, slot // layout.shard).filter(F.col("shard") == slot // layout.shard).select("path").first()["path"]
    at = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        stream.seek(slot % layout.shard * layout.stride)
        data = bytes(stream.readNBytes(count * layout.stride))
    finally:
        stream.close()
    return [data[k : k + 2 * layout.length] for k in range(0, len(data), layout.stride)]


def training_order(docs: DataFrame, ranks_file: str, pattern: str, length: int = SEQUENCE, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """Write the shards to the shared folder; one row for each text's part of each sequence.

    doc_id, piece, n_tokens, slot, shard and byte_offset come from the index, and
    sequence_tokens and sequence_sha256 from the bytes read back from the shards.
    """
    spark = docs.sparkSession
    layout = materialise(docs, scratch(spark, "training-order"), ranks_file, pattern, length, shard, key=key)
    remove_folder(spark, f"{layout.path}/tokens")
    written = read_from(spark, layout).select("slot", F.col("n_tokens").alias("sequence_tokens"), F.sha2("ids", 256).alias("sequence_sha256"))
    return spark.read.parquet(f"{layout.path}/index").join(written, "slot").select("doc_id", "piece", "n_tokens", "slot", "shard", "byte_offset", "sequence_tokens", "sequence_sha256")
