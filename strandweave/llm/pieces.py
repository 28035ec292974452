"""SentencePiece encoding and decoding for merge-type vocabularies (operator 9).

Encoding normalises like an identity vocabulary with a dummy prefix (blanks
become U+2581, one is put in front), cuts the text where no vocabulary piece
can reach across, and runs a score-ordered agenda of adjacent symbol pairs on
every distinct segment: the pair with the best score merges first, the leftmost
of equals, until no adjacent pair is a piece. Segments of one length that an
Arrow batch brings for the first time share their agenda: a matrix of pair
ranks, a row a segment, in which every row merges its best pair at a time; long
segments use a heap. Characters without a piece fall back to bytes. Segments
repeat, so a worker keeps a bounded cache of them.

All of this is compared with the sentencepiece library. A segment's ids are
compared with the library's when a worker learns it, between two characters of
no piece, which nothing merges with. A cut is right if no piece holds the two
characters beside it next to each other, as then no merge, in whatever order,
goes across; every cut of every text is looked at, and a text with another cut
is encoded by the library as a whole. Every text is decoded by the library too.
Where the two differ the library's ids and text are returned, and ``agrees`` is
false.

Null text counts as empty and gives the begin and end ids alone. Rows are
independent: repeated rows, ties, very long texts and empty tables need no care,
and only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
CACHE = 400_000  # segments after which a worker starts a new generation
SHORT = 40
BATCH = 4 << 20  # characters whose segments are looked up together
CHECK = 1 << 14  # characters of segments that go to the library together
WIDE = 21  # bits of a symbol
NEVER = np.int32(2**31 - 1)


class PieceCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, model_file: str, bound: int = CACHE):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("a merge-type vocabulary with identity normalisation is needed")
        if not (spec.add_dummy_prefix and spec.escape_whitespaces and proto.trainer_spec.byte_fallback):
            raise ValueError("a vocabulary with a dummy prefix and byte fallback is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.score: dict[str, float] = {}
        self.ids: dict[str, bytes] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids: list[bytes] = [b""] * 256
        self.raw: set[int] = set()
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.NORMAL:
                self.score[p.piece] = p.score
                self.ids[p.piece] = i.to_bytes(4, "little")
                self.bytes_of.append(p.piece.replace(BLANK, " ").encode())
            elif p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:-1], 16)] = i.to_bytes(4, "little")
                self.bytes_of.append(bytes([int(p.piece[3:-1], 16)]))
                self.raw.add(i)
            elif p.type == kinds.CONTROL:
                self.bytes_of.append(b"")
            elif p.type == kinds.UNKNOWN:
                self.bytes_of.append(proto.trainer_spec.unk_surface.encode())
            else:
                raise ValueError("only normal, byte and control pieces are supported")
        self.cut = self._cutter()
        self._cut_table()
        self._shield()
        self.differs: set[str] = set()  # segments that the library encodes otherwise
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bound = bound
        self._pair_table()

    def _cutter(self) -> re.Pattern:
        """Segments end before a blank, and after letters or signs where no piece goes on."""
        pairs = {p for piece in self.score for p in itertools.pairwise(piece)}
        letter = re.compile(r"[^\W_]").match
        if any(b == BLANK != a for a, b in pairs):
            return re.compile(r"(?s).+")  # pieces span words: no cuts
        over = {(a, b) for a, b in pairs if letter(a) and not letter(b)}
        join = ""
        if over:
            heads, tails = (re.escape("".join(sorted(set(x)))) for x in zip(*over, strict=True))
            join = f"(?:(?<=[{heads}])[{tails}][^{BLANK}]*)?"
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in pairs))
        signs = {c for c in map(chr, range(128)) if not letter(c)} | {c for p in pairs for c in p if not letter(c)}
        word, rest = r"[^\W_]", f"[{re.escape(''.join(sorted(signs - {BLANK, *alone})))}]"
        return re.compile(rf"{BLANK}*{rest}*{word}*{join}|[^{BLANK}]")

    def _cut_table(self) -> None:
        """Whether a piece holds two characters next to each other, by numbers of the left and the right one."""
        pairs = sorted({p for piece in self.score for p in itertools.pairwise(piece)})
        sides = [sorted(set(x)) for x in zip(*pairs, strict=True)] or [[], []]
        self.left_of, self.right_of = np.zeros((2, 0x110000), np.int32)  # 0: in no pair
        for number, side in zip((self.left_of, self.right_of), sides, strict=True):
            number[[ord(c) for c in side]] = np.arange(1, len(side) + 1)
        self.joined = np.zeros((len(sides[0]) + 1, len(sides[1]) + 1), bool)
        for a, b in pairs:
            self.joined[self.left_of[ord(a)], self.right_of[ord(b)]] = True

    def _shield(self) -> None:
        """A character of no piece, its ids, and the library's ids of a text that starts with it."""
        used = {c for piece in self.score for c in piece}
        self.shield = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in used)
        self.shield_ids = b"".join(self.byte_ids[b] for b in self.shield.encode())
        self.shield_head = self._library_ids(self.shield)
        if not self.shield_head.endswith(self.shield_ids):
            raise ValueError("a character without a piece must give its bytes")

    def _library_ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text), "<u4").tobytes()

    def _pair_table(self) -> None:
        """Symbols of all characters, and every pair of symbols that makes a piece, by key."""
        ids = {p: int.from_bytes(x, "little") for p, x in self.ids.items()}
        self.pieces = len(self.bytes_of)
        letters = {c for p in ids for c in p} - ids.keys()
        if self.pieces + len(letters) + 0x110000 >= 1 << WIDE:
            raise ValueError("the vocabulary has too many pieces")
        symbol = ids | {c: self.pieces + k for k, c in enumerate(sorted(letters))}
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + self.pieces + len(letters)  # characters of no piece
        for c, k in symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = k
        rank = dict(zip(self.score, np.unique([-x for x in self.score.values()], return_inverse=True)[1].tolist(), strict=True))
        rows = [(symbol[p[:k]] << WIDE | symbol[p[k:]], rank[p], ids[p]) for p in ids for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        table = np.array(rows, np.int64).reshape(-1, 3)
        table = table[np.argsort(table[:, 0])]
        self.pair_key = np.append(table[:, 0], np.int64(2**62))
        self.pair_rank = np.append(table[:, 1], NEVER).astype(np.int32)
        self.pair_to = np.append(table[:, 2], 0)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs of symbols; ``NEVER`` if they make none."""
        key = left << WIDE | right
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER), self.pair_to[at]

    def _merge_batch(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of segments of one length after all merges, and how many each has left."""
        n, m = len(segs), len(segs[0])
        sym = self.symbol_of[np.frombuffer("".join(segs).encode("utf-32-le"), "<u4")].reshape(n, m)
        left = np.full(n, m)
        rank, to = self._pairs(sym[:, :-1], sym[:, 1:])
        live = np.arange(n)
        while m > 1 and len(live):
            at = rank[live].argmin(axis=1)
            go = rank[live, at] != NEVER
            live, at = live[go], at[go]
            s, r, t, rows = sym[live], rank[live], to[live], np.arange(len(live))
            piece = t[rows, at]
            tail = np.arange(m - 1) >= at[:, None]
            s[:, :-1] = np.where(tail, s[:, 1:], s[:, :-1])
            r[:, :-1] = np.where(tail[:, :-1], r[:, 1:], r[:, :-1])
            t[:, :-1] = np.where(tail[:, :-1], t[:, 1:], t[:, :-1])
            s[rows, at], r[:, -1] = piece, NEVER
            left[live] -= 1
            k = np.flatnonzero(at)
            r[k, at[k] - 1], t[k, at[k] - 1] = self._pairs(s[k, at[k] - 1], piece[k])
            k = np.flatnonzero(at + 1 < left[live])
            r[k, at[k]], t[k, at[k]] = self._pairs(piece[k], s[k, at[k] + 1])
            sym[live], rank[live], to[live] = s, r, t
        return sym, left

    def learn(self, segs: set[str]) -> None:
        """Have the ids of all ``segs`` in ``known``; a full generation becomes the older one, the oldest goes."""
        if len(self.known) >= self.bound:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        by_length: dict[int, list[str]] = {}
        for seg in segs.difference(known):
            if seg in older:
                known[seg] = older[seg]
            else:
                by_length.setdefault(len(seg), []).append(seg)
        self._merge_all(by_length)
        self._compare(list(itertools.chain.from_iterable(by_length.values())))

    def _merge_all(self, by_length: dict[int, list[str]]) -> None:
        known = self.known
        for m, own in by_length.items():
            if not 0 < m <= SHORT:
                known.update((seg, self._encode_segment(seg)) for seg in own)
                continue
            sym, left = self._merge_batch(own)
            plain = ((sym < self.pieces) | (np.arange(m) >= left[:, None])).all(axis=1).tolist()
            width, data, left = 4 * m, sym.astype("<u4").tobytes(), left.tolist()
            for k, seg in enumerate(own):
                known[seg] = data[k * width : k * width + 4 * left[k]] if plain[k] else self._encode_segment(seg)

    def _compare(self, segs: list[str]) -> None:
        """The library's ids for ``segs`` of ``known`` that differ from it, and their names in ``differs``."""
        block, size = [], 0
        for seg in segs:
            if self.shield in seg:
                self._compare_block([seg])
                continue
            block.append(seg)
            size += len(seg) + 1
            if size >= CHECK:
                self._compare_block(block)
                block, size = [], 0
        if block:
            self._compare_block(block)

    def _compare_block(self, block: list[str]) -> None:
        # a character's bytes are found nowhere else in UTF-8, so equal blocks have equal segments
        own = self.shield_head + self.shield_ids.join(map(self.known.__getitem__, block))
        ids = self._library_ids(self.shield + self.shield.join(block))
        if ids == own:
            return
        if len(block) > 1:
            for seg in block:
                self._compare_block([seg])
        else:
            self.known[block[0]] = ids[len(self.shield_head) :]
            self.differs.add(block[0])

    def _cuts_hold(self, texts: list[str], rows: list[list[str]]) -> list[bool]:
        """Whether each text's segments make it up, and no merge can go across a cut."""
        sizes = np.fromiter(map(len, itertools.chain.from_iterable(rows)), np.int64)
        ends = np.append(0, np.cumsum(sizes))
        last = ends[np.cumsum([len(row) for row in rows], dtype=np.int64)]  # where each text ends
        hold = np.diff(last, prepend=0) == np.fromiter(map(len, texts), np.int64, len(texts))
        if not hold.all():
            texts = ["".join(row) for row in rows]
        code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        cut = np.zeros(len(code) + 1, bool)
        cut[ends] = True
        cut[last] = cut[0] = False
        at = np.flatnonzero(cut)
        across = at[self.joined[self.left_of[code[at - 1]], self.right_of[code[at]]]]
        hold[np.searchsorted(last, across, side="right")] = False
        return hold.tolist()

    def _encode_segment(self, seg: str) -> bytes:
        return b"".join(self.ids.get(x) or b"".join(self.byte_ids[b] for b in x.encode()) for x in self._merge_long(seg))

    def _merge_long(self, seg: str) -> list[str]:
        """The agenda as a heap; stale pairs are skipped when they come up."""
        sym: list[str | None] = list(seg)
        n, score = len(sym), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(seg[i : i + 2])
            if s is not None:
                agenda.append((-s, i, i + 1, seg[i : i + 2]))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if sym[i] is None or sym[j] is None or after[i] != j or len(sym[i]) + len(sym[j]) != len(piece):
                continue
            sym[i], sym[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                s = score.get(new := piece + sym[k])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, k, new))
            h = before[i]
            if h >= 0:
                s = score.get(new := sym[h] + piece)
                if s is not None:
                    heapq.heappush(agenda, (-s, h, i, new))
        return [x for x in sym if x is not None]

    def encode_checked(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """Ids as of ``encode_texts``, whether all cuts of a text hold, and whether all its segments were as in the library."""
        begin, end, at = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little"), 0
        out, hold, same = [], [], []
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and size < BATCH:
                some.append(BLANK + texts[at].replace(" ", BLANK) if texts[at] else "")
                size += len(texts[at]) + 1
                at += 1
            rows = [self.cut.findall(text) if text else [] for text in some]
            self.learn(set().union(*rows))
            out.extend(begin + b"".join(map(self.known.__getitem__, row)) + end for row in rows)
            hold.extend(self._cuts_hold(some, rows))
            same.extend(not self.differs or self.differs.isdisjoint(row) for row in rows)
        return out, hold, same

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """All ids of each text, begin and end included, as little-endian unsigned 32-bit integers."""
        return self.encode_checked(texts)[0]

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_texts([text])[0]).cast("I").tolist()

    def decode(self, ids: list[int]) -> str:
        parts = list(map(self.bytes_of.__getitem__, ids))
        for k, p in enumerate(parts):
            if p:  # the dummy prefix
                if ids[k] not in self.raw and p[:1] == b" ":
                    parts[k] = p[1:]
                break
        data = b"".join(parts)
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self.library.decode(ids)  # ids that no text gives


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode_decode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (binary, unsigned 32-bit), the text decoded from them, and whether the library agrees."""

    def run(batches):
        c = codec(model_file)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            ids, hold, agrees = c.encode_checked(texts)
            back = []
            for k, text in enumerate(texts):
                row = want = memoryview(ids[k]).cast("I").tolist()
                back.append(c.decode(row))
                if not hold[k]:
                    want = c.library.encode(text, add_bos=True, add_eos=True)
                plain = c.library.decode(want)
                if want != row or plain != back[k]:
                    ids[k], back[k], agrees[k] = np.array(want, "<u4").tobytes(), plain, False
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.string()), pa.array(agrees, pa.bool_())], ["doc_id", "ids", "decoded", "agrees"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string, agrees boolean")


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and agrees for every row."""
    both = encode_decode(docs, model_file)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )
