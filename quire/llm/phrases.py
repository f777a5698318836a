"""Phrase collocation mining over count streams in prefix and suffix order.

1. *Counting.* Documents are dealt to groups of a few MB. A group sends the hash of each different n-gram (of one word up to ``longest``) once, with its
   count, packed by *bucket* (a range of the hash); a bucket adds the counts up and returns to each group the hashes of its own that may be frequent. The group
   spells those out and counts them; Spark adds the counts up by spelling and keeps the frequent ones. A hash decides what is spelled, and tells
   n-grams apart within a group (by 64 bits: one pair in about ten million groups would be taken for one).
2. *Streams.* The frequent n-grams of all orders together are one stream, cut by range and sorted by language and words: a phrase stands before all that it
   begins. One pass in lockstep over the orders reads off, for each n-gram, the count of each of its beginnings (the last row of that order: a part of a
   frequent phrase is frequent), and for each phrase the largest count of the extensions that follow it. The same pass over the stream
   in suffix order (words last to first) gives the counts of the endings, and the extensions to the left. Nothing is looked up by hash and a frequent
   first word is no key: a range boundary may lie anywhere, and what is open there is handed over by a small summary a partition (two numbers an order).
3. *Scores* in exact decimals, the lowest cut of each phrase, and each language's best, first within shares of its phrases, then over those.

Defined cases: a null text is empty, a null language is ``und``; empty pieces have no words; an empty table gives no rows; repeated rows count
each; other columns are ignored. A text is held by one task as bytes, its hashes by blocks of a MB
(a piece longer than that by itself).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import as_bytes, mixed, rolling, slices, text_bytes, written

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND = np.zeros(256, dtype=np.uint8)  # 1: blank, 2: ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_ENDS = [bytes([c]) for c in np.flatnonzero(_KIND == 2).tolist()]
_LOW = np.uint64(0xFFFFFFFF)


class Block:
    """The n-grams of some texts (``langs``: a code each): for each order the hashes and first words, and the words in ``spaced`` bytes, lower-cased,
    a space after each, from ``starts`` to ``ends``; an n-gram's words are one range of them."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, seeds: np.ndarray, longest: int):
        buffer = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)]
        kind = np.concatenate([[2], _KIND[buffer], [2]]).astype(np.uint8)
        inside = kind == 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        piece = np.cumsum(kind[1:] == 2)[starts] if len(starts) else np.zeros(0, dtype=np.int64)
        words = mixed(rolling(buffer.astype(np.uint64) + np.uint64(1), starts, ends) + (ends - starts).astype(np.uint64))
        text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.lang = np.repeat(langs, np.diff(np.searchsorted(starts, text_at)))  # of each word
        run = seeds[self.lang]
        self.hashes, self.first = [], []
        for n in range(1, longest + 1):
            at = np.arange(max(0, len(words) - n + 1))
            run = mixed(run[: len(at)] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :][: len(at)])
            whole = piece[at] == piece[at + n - 1]
            self.hashes.append(run[whole])
            self.first.append(at[whole])
        # what stands behind a word (there is always something) becomes its space
        kept = inside[1:-1].copy()
        kept[ends] = True
        buffer[ends] = 0x20
        self.spaced = buffer[kept]
        self.ends = np.cumsum(ends - starts + 1) - 1
        self.starts = self.ends - (ends - starts)


def hash_of(name: bytes) -> int:
    at = np.frombuffer(name + b"\0", dtype=np.uint8).astype(np.uint64)
    return int(rolling(at + np.uint64(1), np.array([0]), np.array([len(at)]))[0])


def cuts(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``text`` in parts of about ``size`` bytes, cut where a piece ends (a longer piece stands alone): no n-gram crosses a cut."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(c, at, at + size) for c in _ENDS)
        if end < 0:
            found = re.compile(b"[.,;:!?\n-\r]").search(text, at + size)
            end = found.start() if found else len(text) - 1
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


def _blocks(table: pa.Table, longest: int) -> tuple[list[bytes], Iterator[Block]]:
    """The languages by code, and the table's texts in blocks."""
    named = as_bytes(table["lang"])
    codes = {name: i for i, name in enumerate(dict.fromkeys(named))}
    seeds = mixed(np.array([hash_of(name) for name in codes], dtype=np.uint64))
    texts, langs = [], []
    for text, lang in zip(as_bytes(table["text"]), named, strict=True):
        for part in cuts(text):
            texts.append(part)
            langs.append(codes[lang])
    every = np.array(langs, dtype=np.int64)
    return list(codes), (Block(texts[a:b], every[a:b], seeds, longest) for a, b in slices(texts))


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins in sorted ``values``."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: equal ranges of the upper half."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _send(longest: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """A row a bucket: hashes met once, and hashes met more often with their counts. A hash is sent as its low 32 bits."""

    def send(table: pa.Table) -> pa.Table:
        _, blocks = _blocks(table, longest)
        found = np.concatenate([np.zeros(0, dtype=np.uint64), *(h for block in blocks for h in block.hashes)])
        found.sort()
        first = _runs(found)
        counts = np.diff(np.concatenate([first, [len(found)]]))
        found = found[first]
        cuts = np.searchsorted(_bucket(found, buckets), np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        once, more, times = [], [], []
        for i in full:
            own, n = (found[cuts[i] : cuts[i + 1]] & _LOW).astype(np.uint32), counts[cuts[i] : cuts[i + 1]]
            once.append(own[n == 1].tobytes())
            more.append(own[n > 1].tobytes())
            times.append(n[n > 1].astype(np.int64).tobytes())
        group = pa.array([table["g"][0].as_py()] * len(full), pa.int64())
        return pa.table({"bucket": pa.array(full, pa.int64()), "g": group, "once": pa.array(once, pa.binary()), "more": pa.array(more, pa.binary()), "times": pa.array(times, pa.binary())})

    return send


def _frequent(least: int) -> Callable[[pa.Table], pa.Table]:
    """For each group its low hashes of this bucket whose counts reach ``least`` over all groups."""

    def frequent(table: pa.Table) -> pa.Table:
        once, more, times = (table[c].to_pylist() for c in ("once", "more", "times"))
        own = [np.concatenate([np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)]) for a, b in zip(once, more, strict=True)]
        counts = [np.concatenate([np.ones(len(a) // 4, dtype=np.int64), np.frombuffer(t, dtype=np.int64)]) for a, t in zip(once, times, strict=True)]
        every = np.concatenate(own)
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = _runs(every)
        kept = every[first][np.add.reduceat(np.concatenate(counts)[order], first) >= least]
        out = [(g, b, x) for g, b, o in zip(table["g"].to_pylist(), table["bucket"].to_pylist(), own, strict=True) if len(x := o[np.isin(o, kept)])]
        return pa.table({"g": pa.array([g for g, _, _ in out], pa.int64()), "bucket": pa.array([b for _, b, _ in out], pa.int64()), "hashes": pa.array([np.sort(x).tobytes() for _, _, x in out], pa.binary())})

    return frequent


def _spelled(blocks: list[Block], block: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """The n-grams of ``n`` words from the word ``first`` of a ``block`` on, as strings."""
    sizes, parts = np.zeros(len(block), dtype=np.int64), []
    for i, b in enumerate(blocks):  # n-grams stand block by block
        own = slice(*np.searchsorted(block, [i, i + 1]))
        starts = b.starts[first[own]]
        sizes[own] = b.ends[first[own] + n[own] - 1] - starts
        ahead = np.cumsum(sizes[own]) - sizes[own]
        parts.append(b.spaced[np.repeat(starts - ahead, sizes[own]) + np.arange(sizes[own].sum())])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = np.concatenate([np.zeros(0, dtype=np.uint8), *parts])
    return pa.LargeStringArray.from_buffers(len(block), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())).cast("string")


def _spell(longest: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The group's n-grams whose hashes came back, spelled and counted; and a row of order 0 a language: all its words. Within the group, n-grams are told
    apart by their 64 bits."""
    spread = np.uint64(0xFFFFFF)

    def spell(docs: pa.Table, known: pa.Table) -> pa.Table:
        blobs = [(np.uint64(b) << np.uint64(32)) | np.frombuffer(x, dtype=np.uint32) for b, x in zip(known["bucket"].to_pylist(), known["hashes"].to_pylist(), strict=True)]
        keys = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *blobs]))
        some = np.zeros(int(spread) + 1, dtype=bool)  # most others are told by 24 bits already
        some[keys & spread] = True
        names, stream = _blocks(docs, longest)
        totals = np.zeros(len(names), dtype=np.int64)
        blocks, found = [], []
        for i, block in enumerate(stream):
            totals += np.bincount(block.lang, minlength=len(names))
            for n, (hashes, first) in enumerate(zip(block.hashes, block.first, strict=True), 1):
                may = np.flatnonzero(some[hashes & spread])
                place = (_bucket(hashes[may], buckets) << np.uint64(32)) | (hashes[may] & _LOW)
                at = np.minimum(np.searchsorted(keys, place), max(len(keys) - 1, 0))
                may = may[keys[at] == place] if len(keys) else may[:0]
                found.append((hashes[may], *(x.astype(np.int32) for x in (first[may], np.full(len(may), n), np.full(len(may), i)))))  # places within a block of a MB or one piece
            block.hashes = block.first = None
            blocks.append(block)
        hashes, first, n, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int32)] * 3)
        found.clear()
        order = np.argsort(hashes, kind="stable")
        begins = _runs(hashes[order])
        times = np.diff(np.concatenate([begins, [len(order)]]))
        one = order[begins]
        by_block = np.argsort(at[one], kind="stable")
        one, times = one[by_block], times[by_block]
        phrase = _spelled(blocks, at[one], first[one], n[one])
        lang = np.concatenate([np.zeros(0, dtype=np.int64), *(b.lang[first[one][slice(*np.searchsorted(at[one], [i, i + 1]))]] for i, b in enumerate(blocks))])
        named = pa.array(names, pa.binary()).cast("string")
        return pa.table({
            "lang": pa.concat_arrays([named.take(pa.array(lang)), named]), "words": pa.array(np.concatenate([n[one], np.zeros(len(names), dtype=np.int64)]), pa.int32()),
            "phrase": pa.concat_arrays([phrase, pa.array([""] * len(names), pa.string())]), "f": pa.array(np.concatenate([times, totals]), pa.int64()),
        })

    return spell


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, group_bytes: int = 4 << 20, bucket_ngrams: int = 1 << 21) -> DataFrame:
    """``lang``, ``words`` (how many), ``phrase`` and ``f`` of every n-gram met ``least`` times or more in its language; with 0 words, a language's words in all.

    ``docs`` should be a table: rows are dealt by their place, so they must be read in the same order by both passes (and again after a lost executor)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    total = text_bytes(rows, "text")
    groups = int(total / group_bytes) + 1
    buckets = int(total / 3 / bucket_ngrams) + 1  # an n-gram of each order about every six bytes
    # dealt by place, not by text: rows that repeat are spread like others
    dealt = rows.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))).repartition(groups, "g")
    sent = dealt.groupBy("g").applyInArrow(_send(longest, buckets), "bucket long, g long, once binary, more binary, times binary")
    known = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_frequent(least), "g long, bucket long, hashes binary")
    spelled = dealt.groupBy("g").cogroup(known.repartition(groups, "g").groupBy("g")).applyInArrow(_spell(longest, buckets), "lang string, words int, phrase string, f long")
    return spelled.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


class Sweep:
    """What the rows of a sorted stream (``orders``, ``f``) say of each other."""

    def __init__(self, orders: np.ndarray, f: np.ndarray, longest: int):
        self.orders, self.f, self.longest = orders, f, longest

    def summary(self) -> dict[str, list[int]]:
        """By order: the last count (-1 if none), the largest extension before the first row that could take it, whether there is such a row."""
        last, head, closed = [], [], []
        for n in range(1, self.longest):
            own = np.flatnonzero(self.orders == n)
            last.append(int(self.f[own[-1]]) if len(own) else -1)
            ends = np.flatnonzero(self.orders <= n)
            upto = ends[0] if len(ends) else len(self.orders)
            part = self.f[:upto][self.orders[:upto] == n + 1]
            head.append(int(part.max()) if len(part) else 0)
            closed.append(int(len(ends) > 0))
        return {"last": last, "head": head, "closed": closed}

    def parts(self, before: list[int]) -> list[np.ndarray]:
        """For each order below the longest, the count of the last row of that order: a row's part of so many words."""
        out = []
        for n in range(1, self.longest):
            at = np.maximum.accumulate(np.where(self.orders == n, np.arange(len(self.orders)), -1))
            out.append(np.where(at >= 0, self.f[at], before[n - 1]))
        return out

    def extensions(self, after: list[int]) -> np.ndarray:
        """For each row the largest count of the rows one word longer that follow before a row as short."""
        out = np.zeros(len(self.orders), dtype=np.int64)
        for n in range(1, self.longest):
            ends = np.flatnonzero(self.orders <= n)
            if len(ends):
                largest = np.maximum.reduceat(np.where(self.orders == n + 1, self.f, 0), ends)
                largest[-1] = max(largest[-1], after[n - 1])
                own = self.orders[ends] == n
                out[ends[own]] = largest[own]
        return out


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """One partition's rows: a range of the stream of bounded length."""
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches) if batches else None


def _sweep(table: pa.Table, longest: int) -> Sweep:
    return Sweep(table["words"].to_numpy(), table["f"].to_numpy(), longest)


def swept(stream: DataFrame, order: list[Column], parts: str, longest: int, partition_rows: int) -> DataFrame:
    """``stream`` (``words``, ``f``) with ``parts`` (counts of its beginnings in this order, by number of words) and ``parts_longer``.

    The sorted partitions are checkpointed, so that both passes, and a pass after a lost executor, see the same ones.
    """
    n = stream.count() // partition_rows + 1
    ordered = stream.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is not None:
            found = _sweep(table, longest).summary()
            yield pa.RecordBatch.from_pydict({"at": [TaskContext.get().partitionId()], **{k: [v] for k, v in found.items()}}, pa.schema([("at", pa.int64()), *((k, pa.list_(pa.int64())) for k in found)]))

    # a row a partition, of a fixed size
    rows = ordered.mapInArrow(summarise, "at long, last array<long>, head array<long>, closed array<long>").orderBy("at").collect()
    before, after = {}, {}
    last = [0] * (longest - 1)
    for r in rows:
        before[r["at"]] = last
        last = [x if x >= 0 else y for x, y in zip(r["last"], last, strict=True)]
    open_ = [0] * (longest - 1)
    for r in reversed(rows):
        after[r["at"]] = open_
        open_ = [h if c else max(h, o) for h, c, o in zip(r["head"], r["closed"], open_, strict=True)]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is not None:
            at, found = TaskContext.get().partitionId(), _sweep(table, longest)
            found_parts = np.stack(found.parts(before[at]), axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found_parts.ravel()), longest - 1).cast(pa.list_(pa.int64()))
            table = table.append_column(parts, lists).append_column(f"{parts}_longer", pa.array(found.extensions(after[at])))
            yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    return ordered.mapInArrow(sweep, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema) + f", {parts} array<long>, {parts}_longer long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, share: int = 50, most: int = 2000, partition_rows: int = 200_000, shares: int = 64, **bounds: int) -> DataFrame:
    """Each language's first ``most`` phrases of two to ``longest`` words by score: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase that a longer one holds, met at least ``share`` hundredths as often, is left out.
    """
    every = written(counts(docs, text_col, lang_col, longest, least, **bounds))
    sizes = every.where("words = 0").select("lang", F.col("f").alias("n"))
    stream = every.where("words > 0").withColumn("w", F.split("phrase", " "))
    words = [F.get("w", F.lit(i)).asc_nulls_first() for i in range(longest)]
    ends = [F.get("w", F.col("words") - 1 - i).asc_nulls_first() for i in range(longest)]
    left = swept(stream.select("lang", "words", "phrase", "f", "w"), [F.col("lang").asc(), *words], "begins", longest, partition_rows)
    both = swept(left, [F.col("lang").asc(), *ends], "ends", longest, partition_rows)
    found = both.where((F.col("words") > 1) & (100 * F.greatest("begins_longer", "ends_longer") < share * F.col("f")))
    exact = lambda c: c.cast("decimal(19,0)")
    a = exact(F.col("f"))

    def cut(k: Column) -> Column:
        l, r = F.get(F.col("begins"), k - 1), F.get(F.col("ends"), F.col("words") - k - 1)
        score = F.call_function("div", 1_000_000 * (a * a).cast("decimal(38,0)"), exact(l) * exact(r))
        return F.struct(score.cast("long").alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    scored = found.withColumn("cut", F.array_min(F.transform(F.sequence(F.lit(1), F.col("words") - 1), cut)))
    scored = scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    best = top(scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares))), ["lang", "share"], order, most).drop("share", "rank")
    return top(best, ["lang"], order, most).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def top(rows: DataFrame, by: list[str], order: tuple[Column, ...], most: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most)
