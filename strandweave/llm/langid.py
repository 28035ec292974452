"""Language identification by rank-order n-gram profiles (operator 3).

A profile is the list of the ``TOP`` most frequent letter n-grams (one to
three letters, word edges as a boundary mark, ties by code point order). A
text gets the language whose profile has the smallest out-of-place distance:
the sum of rank differences, or ``TOP`` for an n-gram the profile lacks. The
score is one minus the distance over its largest possible value. Equal
distances go to the alphabetically first language.

Profiles are learned from all labelled rows outside the held-out fold, whole
texts. The model is ``TOP`` n-grams a language and nothing larger reaches the
driver. Prediction reads only the text, all of it.

``keep_known`` also rejects a text that scores less than the floor of its
language, ``q50 - REACH * (q50 - q25)`` of the scores of all the training texts,
drawn to 0 as if ``PRIOR`` more texts had that floor: texts in languages that were
not learned, or in none, score far below it.

Null text, or text without letters, gets ``und`` with score 0. A null doc_id is
never held out and never learned from. Repeated rows are predicted one by one and
equal texts get equal predictions; very long texts are counted whole. Only
doc_id, text and lang are read (``keep_known`` keeps all columns), so other
columns may have any name. An empty table gives an empty result, and no labelled
row at all gives ``und`` everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 300
PENDING = 1 << 18  # n-grams that wait to be summed in a task
REACH = 6  # quartile distances under the median
PRIOR = 100  # training texts that a floor of 0 counts for
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
EDGE = 1  # letters are their code point plus 2; 0 marks an unused place

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        codes = np.arange(0x110000, dtype=np.int64)
        alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _letters.append(np.where(alpha, codes + 2, EDGE))
    return _letters[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, ascending, as packed codes, and their counts."""
    none = np.empty(0, np.int64)
    if not text:
        return none, none
    c = _letter_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    c = np.concatenate(([EDGE], c, [EDGE]))
    c = c[np.concatenate(([True], (c[1:] != EDGE) | (c[:-1] != EDGE)))]
    if len(c) < 3:
        return none, none
    three = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    three = np.sort(three[c[1:-1] != EDGE])
    new = np.flatnonzero(np.concatenate(([True], three[1:] != three[:-1])))
    codes3 = three[new]
    n3 = np.diff(np.append(new, len(three)))
    # Every pair that does not end at an edge starts exactly one kept triple;
    # pairs that end at an edge are the tails of the triples that do.
    ends = (codes3 & 0x1FFFFF) == EDGE
    pair = np.concatenate((codes3 >> 21, codes3[ends] & 0x3FFFFFFFFFF))
    codes2, n2 = _sum(pair, np.concatenate((n3, n3[ends])))
    mid = (codes3 >> 21) & 0x1FFFFF
    codes1, n1 = _sum(mid, n3)
    return np.concatenate((codes1, codes2, codes3)), np.concatenate((n1, n2, n3))


def _sum(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[new], np.add.reduceat(n, new)


def top_codes(codes: np.ndarray, n: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    if len(n) > top:
        least = np.partition(n, len(n) - top)[len(n) - top]
        keep = n >= least
        codes, n = codes[keep], n[keep]
    return codes[np.argsort(-n, kind="stable")[:top]]


class Profiles:
    """Learned profiles, ready to compare; small and picklable."""

    def __init__(self, ranked: dict[str, list[int]], top: int = TOP):
        self.top = top
        self.floor: dict[str, float] = {}
        self.langs = sorted(ranked)
        self.codes = np.unique(np.array([c for x in ranked.values() for c in x], np.int64))
        self.rank = np.full((len(self.codes), len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, np.array(ranked[lang], np.int64)), k] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = top_codes(*grams(text), self.top)
        if not len(mine) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        hit = self.codes[at] == mine
        rank = self.rank[at[hit]]
        gap = np.where(rank < 0, self.top, np.abs(rank - np.flatnonzero(hit)[:, None]))
        total = gap.sum(axis=0) + self.top * int((~hit).sum())
        best = int(np.argmin(total))
        return self.langs[best], 1.0 - float(total[best]) / (self.top * len(mine))


    def knows(self, text: str | None) -> bool:
        """Whether the text is in a learned language, as far as its score tells."""
        lang, score = self.predict(text)
        return lang != UNKNOWN and score >= self.floor.get(lang, 0.0)


def _fold():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, top: int = TOP, floors: bool = False) -> Profiles:
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~_fold()).select("lang", "text")
    bound = PENDING

    def count(batches):
        total: dict[str, tuple] = {}
        held: dict[str, list] = {}
        size = 0

        def merge() -> None:
            for lang, parts in held.items():
                total[lang] = _sum(*map(np.concatenate, zip(total.get(lang, grams(None)), *parts, strict=True)))
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = grams(text)
                if len(mine[0]):
                    held.setdefault(lang, []).append(mine)
                    size += len(mine[0])
                if size >= max(bound, sum(len(x) for x, _ in total.values())):
                    merge()
                    size = 0
        merge()
        for lang, (codes, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    counted = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked: dict[str, list[int]] = {}
    for r in counted.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top).orderBy("lang", "r").collect():
        ranked.setdefault(r["lang"], []).append(r["code"])
    model = Profiles(ranked, top)

    def scores(batches):
        for batch in batches:
            got = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] == lang for g, lang in zip(got, batch.column(0).to_pylist(), strict=True)]), pa.array([g[1] for g in got], pa.float64())], ["lang", "right", "score"])

    if floors:
        own = rows.mapInArrow(scores, "lang string, right boolean, score double").filter("right").groupBy("lang", "score").agg(F.count("*").alias("n"))
        for r in own.groupBy("lang").agg(F.percentile("score", [0.25, 0.5], F.col("n")).alias("q"), F.sum("n").alias("n")).collect():  # a row a language
            model.floor[r["lang"]] = (r["q"][1] - REACH * (r["q"][1] - r["q"][0])) * r["n"] / (r["n"] + PRIOR)
    return model


def predict(docs: DataFrame, model: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row."""

    def run(batches):
        for batch in batches:
            got = [model.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", _fold().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))


def keep_known(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` in a learned language, judged by their text alone.

    Judged where the text is, so no text is shuffled; all columns stay.
    """
    model = learn(docs, floors=True)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.knows(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
