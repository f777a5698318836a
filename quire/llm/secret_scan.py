"""Secret scans: three patterns, and a character convolutional network in numpy over every other candidate and its context.

A *candidate* is a run of 16 or more of ``[A-Za-z0-9+/_=-]``. The network sees 40 characters of it with 24 before and 8
after it; of a longer candidate it sees every run of 40 characters, and the most suspicious one counts: character embeddings, one convolution of width 5, maximum and mean over positions, a logistic unit. It is trained on
all labelled findings of all documents: candidates that a pattern found are secrets, candidates of letters only or digits only are not, others are not used.
Findings are dealt by hash into shares, each run of a long one included (a finding weighs the same however long it is); in every round each share goes on from the
common weights by itself, and the shares' weights are averaged. A fifth of the findings is held out to calibrate the probability and to set the threshold,
both from counts of all their logits in steps of 1/64: the highest that still recalls ``recall`` of the held-out
secrets. What the network adds has the kind ``model``; what the patterns found stays.

Defined cases: a null text is empty; without findings of both labels there is no network and the patterns decide alone;
repeated rows are scanned each; offsets count code points; null ids are kept; kept columns may have any names, but
those called ``secrets`` or ``redacted`` give way to the results (in ``redact`` every column stays).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import extended, written
from quire.llm.quality import platt

# The patterns, kinds in order, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
MIN_VALUE, MIN_ACCESS = 6, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEFT, BODY, RIGHT = 24, 40, 8
WIDTH = LEFT + BODY + RIGHT
KERNEL, FILTERS, EMBED = 5, 16, 8
REDACTED = "[SECRET]"

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789=:\"' _-+/.\n"
_CODES = np.full(256, len(_ALPHABET) + 1, dtype=np.uint8)  # 0 is beyond the text
_CODES[np.frombuffer(_ALPHABET.encode(), dtype=np.uint8)] = np.arange(1, len(_ALPHABET) + 1)
_SYMBOLS = len(_ALPHABET) + 2


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the secret itself) of the patterns' matches, by start and kind."""
    out, low = [], text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def free(spans: list[tuple[int, int]], found: list[tuple[int, int, int, int]]) -> list[bool]:
    """Whether each span (they don't overlap and are in order) overlaps none of ``found`` (in order of start): one pass over both."""
    out, k, reach = [], 0, -1
    for a, b in spans:
        while k < len(found) and found[k][0] < b:
            reach = max(reach, found[k][2])
            k += 1
        out.append(reach <= a)
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def windows(text: str, spans: list[tuple[int, int]], low: int = 0, high: int | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Character codes around each span: ``LEFT`` before it, ``BODY`` of it, ``RIGHT`` after it; zero beyond each.

    A span has a row for each run of ``BODY`` characters in it (one if it is shorter); the second result is the first row of each span.
    Only the rows from ``low`` to ``high`` are made; or, with ``most``, so many of each span at most, spread evenly over it.
    """
    own = np.concatenate([np.zeros(LEFT, np.uint8), _CODES[np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)], np.zeros(max(BODY, RIGHT), np.uint8)])
    start, end = np.array([a for a, _ in spans]) + LEFT, np.array([b for _, b in spans]) + LEFT
    rows = np.maximum(1, end - start - BODY + 1)
    first = np.cumsum(rows) - rows
    row = np.arange(low, rows.sum() if high is None else min(high, rows.sum())) if most is None else np.concatenate([f + np.unique(np.linspace(0, n - 1, min(n, most)).astype(np.int64)) for f, n in zip(first, rows, strict=True)])
    span = np.searchsorted(first, row, side="right") - 1
    start, end, at = start[span], end[span], start[span] + row - first[span]
    left = own[start[:, None] + np.arange(-LEFT, 0)]
    body = own[at[:, None] + np.arange(BODY)] * (np.arange(BODY) < (end - at)[:, None])
    return np.concatenate([left, body, own[end[:, None] + np.arange(RIGHT)]], axis=1).astype(np.uint8), first if most is None else np.searchsorted(span, np.arange(len(spans)))


class Network:
    """Weights of the network; ``features`` and ``train`` work on arrays of character codes."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (_SYMBOLS, EMBED)).astype(np.float32)
        self.conv = rng.normal(0, 0.2, (KERNEL * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, dtype=np.float32)
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5
        self.report: dict[str, float] = {}

    def forward(self, codes: np.ndarray):
        x = self.embed[codes]
        places = WIDTH - KERNEL + 1
        cols = np.concatenate([x[:, k : k + places] for k in range(KERNEL)], axis=2)
        z = np.maximum(cols @ self.conv + self.bias, 0)
        pooled = np.concatenate([z.max(axis=1), z.mean(axis=1)], axis=1)
        return cols, z, pooled, pooled @ self.out + self.shift[0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.float32), *[self.forward(codes[a : a + 512])[3] for a in range(0, len(codes), 512)]])

    def worst(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each span, the highest logit of its rows."""
        return np.maximum.reduceat(self.logits(codes), first) if len(first) else np.zeros(0, np.float32)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(codes))

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -30, 30)))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.out, self.shift]

    def train(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 0) -> None:
        rng, params = np.random.default_rng(seed), self.params()
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        swap, prose = np.arange(_SYMBOLS), np.flatnonzero(y == 0)
        swap[1:27], swap[27:53] = np.arange(27, 53), np.arange(27, 53)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), 128):
                at = order[a : a + 128]
                x = codes[at].copy()
                alone = rng.random(len(at)) < 0.5  # in prose that tells nothing, and in capitals: what no pattern says about a secret
                if len(prose):
                    x[alone, :LEFT] = codes[rng.choice(prose, size=alone.sum()), :LEFT]
                capital = rng.random(len(at)) < 0.4
                x[capital, LEFT : LEFT + BODY] = swap[x[capital, LEFT : LEFT + BODY]]
                cols, z, pooled, logit = self.forward(x)
                miss = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[at]) * weight[at] / len(at)
                d_pooled = miss[:, None] * self.out
                d_z = np.repeat(d_pooled[:, None, FILTERS:] / z.shape[1], z.shape[1], axis=1)
                rows, filters = np.arange(len(at))[:, None], np.arange(FILTERS)[None, :]
                d_z[rows, z.argmax(axis=1), filters] += d_pooled[:, :FILTERS]
                d_z *= z > 0
                d_cols = d_z @ self.conv.T
                d_embed = np.zeros_like(self.embed)
                for k in range(KERNEL):
                    np.add.at(d_embed, x[:, k : k + z.shape[1]], d_cols[:, :, k * EMBED : (k + 1) * EMBED])
                grads = [d_embed, np.tensordot(cols, d_z, ([0, 1], [0, 1])), d_z.sum(axis=(0, 1)), pooled.T @ miss, np.array([miss.sum()])]
                step += 1
                for p, g, mean, square in zip(params, grads, m, v, strict=True):
                    mean += 0.1 * (g - mean)
                    square += 0.01 * (g * g - square)
                    p -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)


def _labelled(text: str) -> list[tuple[int, int, int]]:
    """Start, end and label (1: a secret) of the candidates that have one."""
    spans = candidates(text)
    out = []
    for (a, b), alone in zip(spans, free(spans, base_spans(text)) if spans else [], strict=True):
        if not alone:
            out.append((a, b, 1))
        elif text[a:b].isalpha() or text[a:b].isdigit():
            out.append((a, b, 0))
    return out


def _findings(batches: Iterator[pa.RecordBatch], runs: int = 64) -> Iterator[pa.RecordBatch]:
    """Each finding's codes, of a long one those of ``runs`` runs: to look at; ``fit`` takes ``_pieces``."""
    for batch in batches:
        codes, labels = [], []  # a finding's codes are those of its rows, one after the other
        for text in batch["text"].to_pylist():
            if own := _labelled(text or ""):
                rows, first = windows(text, [(a, b) for a, b, _ in own], most=runs)
                codes += [x.tobytes() for x in np.split(rows, first[1:])]
                labels += [y for _, _, y in own]
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(labels, pa.int32())], ["codes", "label"])


PIECE = 512
_PIECES = "finding long, part int, label int, runs int, weight double, codes binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of each finding, in pieces of ``PIECE`` runs: the codes of the ``LEFT`` characters before the finding, of the piece and of the ``RIGHT`` characters after the
    finding. ``weight``: the piece's share of the finding's runs."""
    for batch in batches:
        out = []
        for text in batch["text"].to_pylist():
            for a, b, label in _labelled(text or ""):
                around = text[max(0, a - LEFT) : a].rjust(LEFT, "\0") + text[a:b] + text[b : b + RIGHT].ljust(RIGHT, "\0")
                codes = _CODES[np.frombuffer(around.encode("latin-1", "replace"), dtype=np.uint8)].copy()
                codes[: max(0, LEFT - a)] = 0  # beyond the text
                codes[len(codes) - max(0, b + RIGHT - len(text)) :] = 0
                codes = codes.tobytes()
                finding, every = xxhash.xxh64_intdigest(codes) - (1 << 63), max(1, b - a - BODY + 1)
                for part, low in enumerate(range(0, every, PIECE)):
                    runs = min(PIECE, every - low)
                    out.append((finding, part, label, runs, runs / every, codes[:LEFT] + codes[LEFT + low : min(LEFT + low + runs + BODY - 1, len(codes) - RIGHT)] + codes[len(codes) - RIGHT :]))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["finding", "part", "label", "runs", "weight", "codes"])


def _share(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A share's pieces in a fixed order, the codes of all their runs, and each piece's first row."""
    table = table.sort_by([(c, "ascending") for c in ("finding", "part", "label")]).combine_chunks()
    rows = []
    for codes in table["codes"].to_pylist():
        own = np.frombuffer(codes, dtype=np.uint8)
        body = np.concatenate([own[LEFT : len(own) - RIGHT], np.zeros(max(0, WIDTH - len(own)), np.uint8)])
        body = np.lib.stride_tricks.sliding_window_view(body, BODY)
        side = np.broadcast_to(own, (len(body), len(own)))
        rows.append(np.concatenate([side[:, :LEFT], body, side[:, len(own) - RIGHT :]], axis=1))
    runs = table["runs"].to_numpy()
    return table, np.concatenate(rows), np.cumsum(runs) - runs


def _trained(net: Network, epochs: int, rate: float, scale: dict[int, float]):
    """A share's weights after ``epochs`` more passes over it, a row a number, with what the share weighs."""

    def run(table: pa.Table) -> pa.Table:
        table, codes, _ = _share(table)
        runs, y = table["runs"].to_numpy(), table["label"].to_numpy()
        each = table["weight"].to_numpy() * np.array([scale[x] for x in y.tolist()])
        own = Network()
        for p, q in zip(own.params(), net.params(), strict=True):
            p[...] = q
        own.train(codes, np.repeat(y, runs).astype(np.float32), np.repeat(each / runs, runs).astype(np.float32), epochs, rate)
        flat = np.concatenate([p.ravel() for p in own.params()]).astype(np.float64)
        return pa.table({"place": pa.array(np.arange(len(flat))), "value": pa.array(flat), "weight": pa.array(np.full(len(flat), each.sum()))})

    return run


STEPS, REACH = 64, 64  # bins of a logit, and the largest


def _judged(net: Network):
    """The highest logit of each held-out piece, as a bin. What the patterns miss stands in prose, so the findings are judged behind the words of others of the share."""

    def run(table: pa.Table) -> pa.Table:
        table, codes, first = _share(table)
        prose = codes[first[table["label"].to_numpy() == 0], :LEFT]
        if len(prose):
            codes[:, :LEFT] = np.repeat(prose[np.arange(len(first)) % len(prose)], table["runs"].to_numpy(), axis=0)
        bins = np.floor(np.clip(net.worst(codes, first), -REACH, REACH) * STEPS).astype(np.int64)
        return pa.table({"finding": table["finding"], "label": table["label"], "bin": pa.array(bins)})

    return run


def fit(docs: DataFrame, text_col: str = "text", recall: float = 0.98, share: int = 8192, rounds: int = 4, epochs: int = 12) -> Network | None:
    """The network trained on all runs of all different findings, in shares of about ``share`` runs. Weights (averaged exactly, so that reruns agree) and counts of bins come to the driver."""
    given = docs.select(F.col(f"`{text_col}`").alias("text"))
    held = F.pmod(F.xxhash64("finding", F.lit(3)), F.lit(5)) == 0
    pieces = written(given.mapInArrow(_pieces, _PIECES).dropDuplicates(["finding", "part", "label"]).withColumn("held", held))
    sizes = {(r.held, r.label): r for r in pieces.groupBy("held", "label").agg(F.sum("runs").alias("runs"), F.sum((F.col("part") == 0).cast("long")).alias("findings")).collect()}
    if any((False, y) not in sizes for y in (0, 1)):
        return None

    def shares(of: bool) -> tuple[DataFrame, int]:
        n = sum(r.runs for (on, _), r in sizes.items() if on == of) // share + 1
        return pieces.where(F.col("held") == of).withColumn("share", F.pmod(F.xxhash64("finding", "part", F.lit(11)), F.lit(n))).repartition(n, "share"), n

    train, n = shares(False)
    runs = sum(sizes[False, y].runs for y in (0, 1))
    scale = {y: 0.5 * runs / sizes[False, y].findings for y in (0, 1)}
    net = Network()
    rounds, epochs = (rounds, epochs) if n > 1 else (1, max(epochs, 80_000 // runs))  # few findings make few steps a pass
    for k in range(rounds):
        found = train.groupBy("share").applyInArrow(_trained(net, epochs // rounds, 0.01 * (1 - k / (2 * rounds)), scale), "place long, value double, weight double")
        exact = F.col("weight").cast("decimal(16,4)")
        mean = found.groupBy("place").agg(F.sum(F.col("value").cast("decimal(18,12)") * exact).cast("double").alias("total"), F.sum(exact).cast("double").alias("weight"))
        flat = np.array([r.total / r.weight for r in mean.orderBy("place").collect()])
        for p, q in zip(net.params(), np.split(flat, np.cumsum([p.size for p in net.params()])[:-1]), strict=True):
            p[...] = q.reshape(p.shape)
    judged = shares(True)[0] if all((True, y) in sizes for y in (0, 1)) else train
    worst = judged.groupBy("share").applyInArrow(_judged(net), "finding long, label int, bin long").groupBy("finding", "label").agg(F.max("bin").alias("bin"))
    bins = worst.groupBy("label", "bin").count().orderBy("label", "bin").toPandas()  # a fixed number of bins
    logits = np.repeat(bins["bin"].to_numpy() / STEPS, bins["count"])
    y = np.repeat(bins["label"].to_numpy(), bins["count"])
    net.slope, net.offset = platt(logits, y.astype(np.float32))
    p = np.sort(net.calibrated(logits)[y == 1])
    net.threshold = float(p[int((1 - recall) * len(p))])
    flagged = net.calibrated(logits) >= net.threshold
    net.report = {"secrets": int((y == 1).sum()), "others": int((y == 0).sum()), "recall": float(flagged[y == 1].mean()), "precision": float((y == 1)[flagged].mean())}
    return net


def all_spans(text: str, base: list[tuple[int, int, int, int]], net: Network | None) -> list[tuple[int, int, int, int]]:
    every = candidates(text) if net else []
    if net is None or not (spans := [x for x, alone in zip(every, free(every, base), strict=True) if alone]):
        return base
    total, logits = sum(max(1, b - a - BODY + 1) for a, b in spans), []
    for low in range(0, total, 4096):  # a long candidate has many rows
        codes, first = windows(text, spans, low, low + 4096)
        logits.append(net.logits(codes))
    more = net.calibrated(np.maximum.reduceat(np.concatenate(logits), first)) >= net.threshold
    return sorted(base + [(a, 3, b, a) for (a, b), yes in zip(spans, more, strict=True) if yes])


_SPAN = "array<struct<kind:string,start:long,end:long,secret_start:long>>"


def _scan(net, clean_too: bool):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret_start", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, clean = [], []
            for text in batch["text"].to_pylist():
                spans = all_spans(text or "", base_spans(text or ""), net.value)
                found.append([{"kind": KINDS[k], "start": a, "end": b, "secret_start": s} for a, k, b, s in spans])
                clean.append(redacted(text, spans) if spans and clean_too else text if clean_too else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind), pa.array(clean, pa.string())], [*batch.schema.names[:-1], "secrets", "redacted"])

    return run


def redacted(text: str, spans: list[tuple[int, int, int, int]]) -> str:
    """``text`` with each secret (of an assignment, its value) replaced."""
    out, at = [], 0
    for a, b in sorted((s, e) for _, _, e, s in spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], REDACTED]
        at = b
    return "".join([*out, text[at:]])


def _scanned(docs: DataFrame, net: Network | None, keep: list[str], text_col: str, clean_too: bool) -> DataFrame:
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return given.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(net), clean_too), extended(given.schema.fields[:-1], f"secrets {_SPAN}, redacted string"))


def scan(docs: DataFrame, net: Network | None, keep: list[str], text_col: str = "text", clean_too: bool = True) -> DataFrame:
    """The columns ``keep``, the ``secrets`` found (by start, then kind) and the ``redacted`` text (null without ``clean_too``) of every row."""
    return _scanned(docs, net, [c for c in keep if c not in ("secrets", "redacted")], text_col, clean_too).select("row.*", "secrets", "redacted")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, with their columns, and their secrets replaced."""
    out = _scanned(docs, fit(docs, text_col), docs.columns, text_col, True)
    return out.select(*[F.col("redacted").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
