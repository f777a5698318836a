"""Quality rules: counted rules and a hashed word and character n-gram logistic regression, scored in Arrow batches.

The classifier is fitted on a bounded sample of labelled rows (``sample`` rows a class, the smallest hashes of their ids),
its probabilities are calibrated on every fifth of them (Platt scaling, then the classes' true odds), and every document
is judged against one fixed threshold. The model is ``2 * 2**bits`` weights, whatever the corpus.

Defined cases: a null text has no words, so it fails the rules; with no labels, or one class only, the classifier has no
verdict and the rules alone decide; repeated rows are judged alike; of an id labelled more than once the worst label holds;
labelled ids that are null are not used, and of an id with several texts the one of the smallest hash; other columns are ignored (or
kept, whatever their names, in ``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACES, Words, as_bytes, extended, mixed, slices

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Fixed threshold on the calibrated probability that a document is good.
KEEP_FROM = 0.5
BITS = 15
CHAR_N = 4
#: Bytes of texts that are hashed at a time; hashing takes about forty bytes a byte.
SLICE = 1 << 18


def repeat_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``window`` words that are found twice or more in the text, first finds included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    if len(known) > len(words) - 1:
        return 0
    key = ids[:n]
    for k in range(1, window):  # exact: each step renumbers the different prefixes
        key = np.unique(key, return_inverse=True)[1] * len(known) + ids[k : k + n]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def rules(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    points = len(text) - sum(text.count(c) for c in SPACES.encode()) if text.isascii() else len((s := text.decode())) - sum(map(s.count, SPACES))
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line and not line.isspace():  # bytes.isspace knows the same six characters
            seen.add(line)
    return len(words), points, sum(text.count(c) for c in SYMBOLS.encode()), again, repeat_words(words)


def _grams(texts: list[bytes], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For word unigrams and n-grams of code points: hashed indexes, and each text's offsets among them."""
    words = Words(texts)
    shift = np.uint64(64 - bits)
    first = (words.hashes() >> shift).astype(np.int32)
    begins = (words.buffer & 0xC0) != 0x80  # of a code point
    at = np.concatenate([[0], np.cumsum(begins)])[words.text_at]
    b = np.frombuffer(words.buffer.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    n = len(b) - CHAR_N + 1
    if n <= 0:
        return [(first, words.offsets), (np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64))]
    value = b[:n].astype(np.uint64)
    for k in range(1, CHAR_N):
        value = value * np.uint64(0x9E3779B97F4A7C15) + b[k : k + n]
    value = mixed(value) >> shift
    # the n-grams that begin in a text end before the next text's first character; those over the edge are left out
    sizes = np.maximum(np.diff(at) - CHAR_N, 0)
    inside = np.zeros(n + 1, dtype=np.int8)
    np.add.at(inside, at[:-1][sizes > 0], 1)
    np.add.at(inside, (at[:-1] + sizes)[sizes > 0], -1)
    return [(first, words.offsets), (value[np.cumsum(inside)[:-1] > 0].astype(np.int32), np.concatenate([[0], np.cumsum(sizes)]))]


def _means(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def _index_type(bits: int) -> np.dtype:
    return np.min_scalar_type((2 << bits) - 1)


def _unpacked(at: bytes, size: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's indexes, and their counts as shares of their family."""
    index = np.frombuffer(at, _index_type(bits))
    counts = np.frombuffer(size, f"u{len(size) // max(1, len(index)) or 1}")
    cut = np.searchsorted(index, 1 << bits)
    return index, np.concatenate([x / max(1, x.sum()) for x in (counts[:cut], counts[cut:])]).astype(np.float32)


def _featurise(bits: int):
    """What the driver gets of a text: indexes, and their counts, in as few bytes as they need."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, size = as_bytes(batch["text"]), [], []
            for a, b in slices(texts, SLICE):
                both = _grams(texts[a:b], bits)
                for i in range(b - a):
                    ids, found = [], []
                    for family, (index, offsets) in enumerate(both):
                        own, counts = np.unique(index[offsets[i] : offsets[i + 1]], return_counts=True)
                        ids.append(own + (family << bits))
                        found.append(counts)
                    counts = np.concatenate(found)
                    at.append(np.concatenate(ids).astype(_index_type(bits)).tobytes())
                    size.append(counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes())
            yield pa.RecordBatch.from_arrays([batch["label"], batch["fold"], pa.array(at, pa.binary()), pa.array(size, pa.binary())], ["label", "fold", "at", "size"])

    return features


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 1500, bits: int = BITS, rounds: int = 80) -> dict | None:
    """The calibrated model, or None where the labels don't have both classes among the documents."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    known = known.withColumn("draw", F.xxhash64("id", F.lit(7)))
    odds = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(odds) != {0, 1}:
        return None
    few = known.where("label = 0").orderBy("draw", "id").limit(sample).unionAll(known.where("label = 1").orderBy("draw", "id").limit(sample))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")  # at most 2 * sample small rows
    one = rows.groupBy("id", "label", "draw").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # so at most 2 * sample rows, the same ones in every run
    one = one.select("text", "label", (F.pmod("draw", F.lit(5)) == 0).alias("fold"), "draw", "id").coalesce(8).sortWithinPartitions("draw", "id")
    got = one.select("text", "label", "fold").mapInArrow(_featurise(bits), "label int, fold boolean, at binary, size binary").toArrow()
    got = got.sort_by([(c, "ascending") for c in ("label", "at", "size", "fold")])
    y, held = got["label"].to_numpy().astype(float), got["fold"].to_numpy()
    if len(set(y[~held])) < 2:
        return None
    at, size = zip(*(_unpacked(x.as_py(), n.as_py(), bits) for x, n in zip(got["at"], got["size"], strict=True)), strict=True)
    return train(list(at), list(size), y, held, odds, bits, rounds)


#: Values that training unfolds at a time.
BLOCK = 1 << 18


def train(at: list[np.ndarray], size: list[np.ndarray], y: np.ndarray, held: np.ndarray, odds: dict[int, int], bits: int, rounds: int) -> dict:
    """Logistic regression by Adam, each step over all rows (unfolded ``BLOCK`` values at a time), on inverse-frequency scaled features; Platt scaling on ``held``."""
    offsets, cuts = np.concatenate([[0], np.cumsum([len(x) for x in at])]), list(slices(at, BLOCK))
    at, size = np.concatenate(at), np.concatenate(size)
    total = np.zeros(2 << bits)
    for low, high in cuts:
        own = slice(offsets[low], offsets[high])
        total += np.bincount(at[own], size[own], minlength=2 << bits)
    scale = 1.0 / np.sqrt(total / len(y) + 1e-6)

    def blocks() -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, and the index, scaled size and row of each of their values."""
        for low, high in cuts:
            own = slice(offsets[low], offsets[high])
            index = at[own].astype(np.int64)
            yield slice(low, high), index, size[own] * scale[index], np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))

    w, b, m, v = np.zeros(2 << bits), 0.0, np.zeros((2 << bits) + 1), np.zeros((2 << bits) + 1)
    weight = np.where(held, 0.0, 1.0)
    weight /= weight.sum()
    margin = np.zeros(len(y))
    for k in range(1, rounds + 2):
        miss, g = np.zeros(len(y)), np.zeros(2 << bits)
        for rows, index, value, row in blocks():
            margin[rows] = np.bincount(row, w[index] * value, minlength=rows.stop - rows.start) + b
            if k <= rounds:
                miss[rows] = weight[rows] * (1 / (1 + np.exp(-np.clip(margin[rows], -30, 30))) - y[rows])
                g += np.bincount(index, value * miss[rows][row], minlength=2 << bits)
        if k > rounds:
            break
        g = np.append(g + 1e-4 * w / len(w), miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    fit_on = held if len(set(y[held])) == 2 else ~held
    slope, shift = platt(margin[fit_on], y[fit_on])
    shift += np.log(odds[1] / odds[0]) - np.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum()))
    return {"w": (w * scale * slope).astype(np.float32), "b": float(b * slope + shift), "bits": bits}


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (score, label), with Platt's smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    spread = max(1e-9, float(np.std(x)))
    z = np.stack([x / spread, np.ones_like(x)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(h, z.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0])), -2, 2)
    return float(beta[0] / spread), float(beta[1])


def probabilities(texts: list[bytes], model: dict) -> np.ndarray:
    out = [np.zeros(0)]
    for a, b in slices(texts, SLICE):
        score = np.full(b - a, model["b"])
        for family, (index, offsets) in enumerate(_grams(texts[a:b], model["bits"])):
            score += _means(model["w"][index + (family << model["bits"])], offsets)
        out.append(1 / (1 + np.exp(-np.clip(score, -30, 30))))
    return np.concatenate(out)


_NEW = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def _judge(model, threshold: float):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch["text"])
            found = np.array([rules(t) for t in texts], dtype=np.int64).reshape(-1, 5)
            failed = (found[:, 0] < MIN_WORDS) | (100 * found[:, 4] > MAX_REPEAT_PERCENT * found[:, 0])
            p = probabilities(texts, model.value) if model.value else None
            kept = ~failed & (p >= threshold) if p is not None else ~failed
            new = [pa.array(found[:, k]) for k in range(5)] + [pa.array(failed), pa.array(p) if p is not None else pa.nulls(len(texts), pa.float64()), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], *(x.split()[0] for x in _NEW.split(", "))])

    return judge


def judge(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = KEEP_FROM, carry: bool = False) -> DataFrame:
    """The rules' counts, the calibrated ``probability`` and the verdict ``kept`` of every document; with ``carry``, all its columns in ``row``."""
    spark = docs.sparkSession
    held = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else [F.col(f"`{id_col}`")]
    given = docs.select(*held, F.col(f"`{text_col}`").alias("text"))
    return given.mapInArrow(_judge(spark.sparkContext.broadcast(model), threshold), extended(given.schema.fields[:-1], _NEW))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their columns, that pass the rules and the classifier."""
    return judge(docs, fit(docs, labels, id_col, text_col), id_col, text_col, carry=True).where("kept").select("row.*")
