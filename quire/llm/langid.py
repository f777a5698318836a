"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word scores by its character n-grams (the word padded
with one space on either side): the longest order of which any n-gram is known counts, as the mean of the log frequencies.
A text's score is the sum over its words; the answer is the best language and its posterior (all languages equally likely
beforehand).

Words are counted over every training text, and n-grams over every counted word, and all counts stay tables in the shared folder.
Only the most frequent words and n-grams of each order (``words`` and ``grams`` counts at most), each whole with its counts in
every language, are sent to the executors, which score most of a text at once. The distinct words left over are scored once each by joins (with the
word counts, and if a word is in none with the n-gram counts), and added to their texts' sums; so what is sent decides
where a word is scored, never how.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing could be learned;
a text of letters none of which is known gets the language with most training words, with an even score; ties go to the
first language by code point; repeated rows count each; training rows with a null language are not used; kept columns may have any
names, but those called as the results are left out.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import extended, written

ORDERS = (4, 3, 2, 1)
#: Runs of word characters other than decimal digits; numerals of other kinds ("½", "²", "Ⅳ") are cut out of the few that hold one.
RUNS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
SMOOTH = 0.1
_KEPT = 1 << 18


def words_of(text: str) -> list[str]:
    """Runs of letters, by Unicode's categories, in lower case."""
    found = RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for run in found for part in ("".join(c if c.isalpha() else " " for c in run).split() if not run.isalpha() else [run])]


def grams_of(word: str, order: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def _flush(counts: dict[str, Counter], order: int) -> pa.RecordBatch:
    rows = [(lang, gram, n) for lang, c in counts.items() for gram, n in c.items()]
    counts.clear()
    lang, gram, n = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([order] * len(rows), pa.int32()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], ["lang", "order", "gram", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if text:
                counts.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, counts.values())) > 1 << 20:
            yield _flush(counts, 0)
    yield _flush(counts, 0)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_order: dict[int, dict[str, Counter]] = {o: {} for o in ORDERS}
    for batch in batches:
        for lang, word, n in zip(batch["lang"].to_pylist(), batch["gram"].to_pylist(), batch["n"].to_pylist(), strict=True):
            for order, counts in by_order.items():
                own = counts.setdefault(lang, Counter())
                for gram in grams_of(word, order):
                    own[gram] += n
        for order, counts in by_order.items():
            if sum(map(len, counts.values())) > 1 << 19:
                yield _flush(counts, order)
    for order, counts in by_order.items():
        yield _flush(counts, order)


_COUNTS = "lang string, order int, gram string, n long"


def learn(texts: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = 200_000, grams: int = 40_000) -> dict:
    """The model: ``langs`` and, by word or n-gram, the log frequency in each language."""
    given = texts.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = given.mapInArrow(_count_words, _COUNTS).groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    counted = written(counted)
    spelled = written(counted.mapInArrow(_count_grams, _COUNTS).groupBy("lang", "order", "gram").agg(F.sum("n").alias("n")))
    every = counted.unionAll(spelled)
    totals = {(r["lang"], r["order"]): (r["n"], r["kinds"]) for r in every.groupBy("lang", "order").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    langs = sorted({lang for lang, _ in totals})
    if not langs:
        return {"langs": [], "known": [], "most": 0, "key": uuid.uuid4().hex}
    table = written(every.groupBy("order", "gram").agg(F.collect_list(F.struct("lang", "n")).alias("by_lang"), F.sum("n").alias("n")).withColumn("bin", F.floor(F.log2("n") * 64)))
    bins: dict[int, list[tuple[int, int]]] = {}
    for r in table.groupBy("order", "bin").agg(F.sum(F.size("by_lang")).alias("n")).collect():  # at most some thousand bins an order
        bins.setdefault(r["order"], []).append((r["bin"], r["n"]))
    kept, least = F.lit(False), {}
    for order, own in bins.items():
        least[order] = _least_bin(own, grams if order else words)
        kept = kept | ((F.col("order") == order) & (F.col("bin") >= least[order]))
    by_order = {order: {lang: totals.get((lang, order), (0, 0)) for lang in langs} for order in (0, *ORDERS)}
    top = table.where(kept).select("order", "gram", F.explode("by_lang").alias("one")).select("order", "gram", F.array_position(F.lit(langs), F.col("one.lang")).alias("at"), "one.n")
    known = [_log_frequencies(top.where(F.col("order") == order).select("gram", "at", "n").toArrow(), langs, by_order[order]) for order in by_order]  # an order at a time, for the driver's memory
    most = max(range(len(langs)), key=lambda i: (by_order[0][langs[i]][0], -i))
    partial = [order for order, own in bins.items() if any(at < least[order] for at, _ in own)]
    return {"langs": langs, "known": known, "most": most, "key": uuid.uuid4().hex, "base": {order: _base(langs, own) for order, own in by_order.items()}, "partial": partial, "table": table.where(~kept).select("order", "gram", "by_lang")}


def _least_bin(bins: list[tuple[int, int]], most: int) -> int:
    """The lowest bin with which, from the top down, at most ``most`` entries are kept (above all bins if the top one has more)."""
    total, least = 0, max(at for at, _ in bins) + 1
    for at, n in sorted(bins, reverse=True):
        total += n
        if total > most:
            break
        least = at
    return least


def _base(langs: list[str], totals: dict[str, tuple[int, int]], smooth: float = SMOOTH) -> np.ndarray:
    return np.array([totals[lang][0] + smooth * (totals[lang][1] + 1) for lang in langs], dtype=float)


def _log_frequencies(rows, langs: list[str], totals: dict[str, tuple[int, int]], smooth: float = SMOOTH) -> tuple[dict[str, int], np.ndarray]:
    base = _base(langs, totals, smooth)
    index: dict[str, int] = {}
    place = np.fromiter((index.setdefault(g.as_py(), len(index)) for g in rows["gram"]), dtype=np.int64, count=len(rows))
    table = np.full((len(index), len(langs)), smooth)
    np.add.at(table, (place, rows["at"].to_numpy().astype(np.int64) - 1), rows["n"].to_numpy().astype(float))
    return index, np.log(table / base)


class Scorer(dict):
    """Row in ``scores`` (by language) of a word, filled on demand."""

    def __init__(self, model: dict):
        super().__init__()
        self.langs, self.known, self.most = model["langs"], model["known"], model["most"]
        self.scores = np.zeros((_KEPT, max(1, len(self.langs))))

    def score(self, word: str) -> np.ndarray | float:
        index, table = self.known[0]
        at = index.get(word)
        if at is not None:
            return table[at]
        for order, (index, table) in zip(ORDERS, self.known[1:], strict=True):
            found = [index[g] for g in grams_of(word, order) if g in index]
            if found:
                return table[found].mean(axis=0)
        return 0.0

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.scores[at] = self.score(word)
        return at

    def judge(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        return self.best(self.total(words))

    def total(self, words: list[str]) -> np.ndarray:
        total = np.zeros(len(self.langs))
        for a in range(0, len(words), _KEPT // 2):
            part = words[a : a + _KEPT // 2]
            if len(self) + len(part) > _KEPT:
                self.clear()
            total += self.scores[np.fromiter(map(self.__getitem__, part), dtype=np.int64, count=len(part))].sum(axis=0)
        return total

    def best(self, total: np.ndarray) -> tuple[str, float]:
        best = int(np.argmax(total)) if total.any() else self.most
        odds = np.exp(total - total.max())
        return self.langs[best], float(odds[best] / odds.sum())


_scorers: dict[str, Scorer] = {}


def scorer_of(model: dict) -> Scorer:
    """One scorer a worker, so that later tasks know the words of earlier ones."""
    if model["key"] not in _scorers:
        _scorers.clear()
        _scorers[model["key"]] = Scorer(model)
    return _scorers[model["key"]]


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model.value)
        for batch in batches:
            found = [scorer.judge(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def _sent(model: dict) -> dict:
    """What the executors get of a model."""
    return {k: v for k, v in model.items() if k != "table"}


def _begin(model):
    """The sum over the words that were sent out, and the other words with their counts; no sum where there is no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model.value)
        sent = model.value["known"][0][0]
        for batch in batches:
            sums, rest = [], []
            for text in batch["text"].to_pylist():
                words = words_of(text) if text else []
                left = Counter(w for w in words if w not in sent)
                rest.append(list(left.items()))
                sums.append(scorer.total([w for w in words if w not in left] if left else words).tolist() if words else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.list_(pa.float64())), pa.array(rest, pa.map_(pa.string(), pa.int64()))], [*batch.schema.names[:-1], "__sum", "__rest"])

    return run


def _vector(by_lang: list[dict], at: dict[str, int], base: np.ndarray) -> np.ndarray:
    own = np.full(len(base), SMOOTH)
    for x in by_lang:
        own[at[x["lang"]]] += x["n"]
    return np.log(own / base)


def _score_words(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = {lang: i for i, lang in enumerate(model.value["langs"])}, model.value["base"][0]
        for batch in batches:
            own = [_vector(x, at, base).tolist() for x in batch["by_lang"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["gram"], pa.array(own, pa.list_(pa.float64()))], ["gram", "scores"])

    return run


def _ask_grams(model):
    """The n-grams of unseen words that were not sent out, down to the first order of which one was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, partial = model.value["known"][1:], set(model.value["partial"])
        for batch in batches:
            rows = []
            for word in batch["gram"].to_pylist():
                for order, (index, _) in zip(ORDERS, known, strict=True):
                    own = Counter(grams_of(word, order))
                    if order in partial:
                        rows += [(word, order, gram, n) for gram, n in own.items() if gram not in index]
                    if any(gram in index for gram in own):
                        break
            word, order, gram, n = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(order, pa.int32()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], ["word", "order", "gram", "times"])

    return run


def _score_unseen(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, known, bases = model.value["langs"], model.value["known"][1:], model.value["base"]
        at = {lang: i for i, lang in enumerate(langs)}
        for batch in batches:
            scores = []
            for word, joined in zip(batch["gram"].to_pylist(), batch["found"].to_pylist(), strict=True):
                own = np.zeros(len(langs))
                for order, (index, table) in zip(ORDERS, known, strict=True):
                    found = [(table[index[g]], 1) for g in grams_of(word, order) if g in index]
                    found += [(_vector(x["by_lang"], at, bases[order]), x["times"]) for x in joined or () if x["order"] == order]
                    if found:
                        own = sum(v * n for v, n in found) / sum(n for _, n in found)
                        break
                scores.append(own.tolist())
            yield pa.RecordBatch.from_arrays([batch["gram"], pa.array(scores, pa.list_(pa.float64()))], ["gram", "scores"])

    return run


def _score_rest(rest: DataFrame, model: dict, sent) -> DataFrame:
    """``gram`` (a word) and ``scores`` of every different word of ``rest``."""
    counted = model["table"]
    of_words = counted.where("order = 0").select("gram", "by_lang")
    looked = written(rest.select("gram").distinct().join(of_words, "gram", "left"))
    seen = looked.where("by_lang is not null").mapInArrow(_score_words(sent), "gram string, scores array<double>")
    unseen = looked.where("by_lang is null").select("gram")
    asked = unseen.mapInArrow(_ask_grams(sent), "word string, order int, gram string, times long")
    found = asked.join(counted.where("order > 0"), ["order", "gram"]).groupBy(F.col("word").alias("gram")).agg(F.collect_list(F.struct("order", "times", "by_lang")).alias("found"))
    return seen.unionAll(unseen.join(found, "gram", "left").mapInArrow(_score_unseen(sent), "gram string, scores array<double>"))


def _finish(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model.value)
        for batch in batches:
            found = []
            for own, more in zip(batch["__sum"].to_pylist(), batch["__more"].to_pylist(), strict=True):
                found.append((UNKNOWN, 0.0) if own is None else scorer.best(np.array(own) + (more or 0.0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], [*batch.schema.names[:-2], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score`` of every row; only the text decides."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep if c not in ("lang_pred", "score")])
    given = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"))
    fields = given.schema.fields[:-1]
    sent = docs.sparkSession.sparkContext.broadcast(_sent(model))
    if not model.get("partial"):
        return given.mapInArrow(_predict(sent), extended(fields, "lang_pred string, score double")).select("row.*", "lang_pred", "score")
    begun = given.mapInArrow(_begin(sent), extended(fields, "__sum array<double>, __rest map<string,bigint>"))
    begun = written(begun.withColumn("__row", F.monotonically_increasing_id()))  # as a table, a row keeps its number
    rest = begun.select("__row", F.explode("__rest").alias("gram", "n"))
    scored = rest.join(_score_rest(rest, model, sent), "gram")
    more = scored.groupBy("__row").agg(F.array(*[F.sum(F.col("n") * F.col("scores")[i]) for i in range(len(model["langs"]))]).alias("__more"))
    ended = begun.drop("__rest").join(more, "__row", "left").drop("__row")
    return ended.select("row", "__sum", "__more").mapInArrow(_finish(sent), extended(fields, "lang_pred string, score double")).select("row.*", "lang_pred", "score")
