"""Substring dedup: Rabin-Karp hashes of every window of N words, counted in Spark; repeated windows merge into removal intervals.

1. Documents are dealt to groups of a few MB by a hash of the row. Each group computes the rolling hash of every window
   and sends each different hash once, sorted, as one packed array per *bucket* (a range of the hash).
2. Each bucket finds the hashes that more than one group sent, and returns to each group those of its own.
3. Each group meets its documents again (the same exchange), adds what repeats inside the group, marks every word that a
   repeated window covers and merges the marks into maximal intervals.

A window that occurs a million times is sent once a group, so no bucket holds a hot window's occurrences. Windows are judged
on the input alone. Hashes have 64 bits: n windows hold about n*n/2**65 accidental pairs (one at 6 billion windows).

Defined cases: null and empty texts have no words (``kept`` is empty); a text shorter than the window loses nothing;
repeated rows are documents like others, so their windows repeat; a null id is a value like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_bytes, mixed, rolling, text_bytes, word_hashes


def window_hashes(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first word of every window of ``length`` words (never across two texts), and the texts' word offsets."""
    hashes, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    ends = np.repeat(offsets[1:], counts)
    starts = np.flatnonzero(np.arange(len(hashes)) + length <= ends)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, offsets
    return mixed(rolling(hashes, starts, starts + length)), starts, offsets


def _send(length: int, buckets: int):
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)

    def send(table: pa.Table) -> pa.Table:
        found, _, _ = window_hashes(as_bytes(table["text"]), length)
        found = np.unique(found)
        cuts = np.concatenate([[0], np.searchsorted(found, edges), [len(found)]])
        full = np.flatnonzero(np.diff(cuts))
        return pa.table({"bucket": pa.array(full, pa.int64()), "g": pa.array([table["g"][0].as_py()] * len(full), pa.int64()), "hashes": pa.array([found[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary())})

    return send


def _repeated(table: pa.Table) -> pa.Table:
    groups, blobs = table["g"].to_pylist(), [np.frombuffer(x, dtype=np.uint64) for x in table["hashes"].to_pylist()]
    every = np.sort(np.concatenate(blobs))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    own = [x[np.isin(x, again, assume_unique=True)] for x in blobs] if len(again) else []
    out = [(g, x.tobytes()) for g, x in zip(groups, own, strict=False) if len(x)]
    return pa.table({"g": pa.array([g for g, _ in out], pa.int64()), "hashes": pa.array([x for _, x in out], pa.binary())})


def intervals(marked: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of marked words, end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _remove(length: int):
    def remove(docs: pa.Table, known: pa.Table) -> pa.Table:
        texts = as_bytes(docs["text"])
        found, starts, offsets = window_hashes(texts, length)
        _, inverse, counts = np.unique(found, return_inverse=True, return_counts=True)
        hit = counts[inverse] > 1 if len(found) else np.zeros(0, dtype=bool)
        if known.num_rows:
            hit |= np.isin(found, np.frombuffer(b"".join(known["hashes"].to_pylist()), dtype=np.uint64))
        cover = np.zeros(offsets[-1] + 1, dtype=np.int64)
        np.add.at(cover, starts[hit], 1)
        np.add.at(cover, starts[hit] + length, -1)
        marked = np.cumsum(cover)[:-1] > 0
        kept, gone = [], []
        for i, text in enumerate(texts):
            words, cut, out, at = text.split(), intervals(marked[offsets[i] : offsets[i + 1]]), [], 0
            for a, b in cut:
                out += words[at:a]
                at = b
            kept.append(b" ".join(out + words[at:] if cut else words))
            gone.append([{"first_word": a, "end_word": b} for a, b in cut])
        return pa.table({"id": docs["id"], "n_words": pa.array(np.diff(offsets), pa.int64()), "removed": pa.array(gone, pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))), "kept": pa.array(kept, pa.binary()).cast("string")})

    def digest(docs: pa.Table, known: pa.Table) -> pa.Table:
        out = remove(docs, known)
        n = [sum(x["end_word"] - x["first_word"] for x in row) for row in out["removed"].to_pylist()]
        return pa.table({"id": out["id"], "n_words": out["n_words"], "n_removed": pa.array(n, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in as_bytes(out["kept"])], pa.string())})

    return remove, digest


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, digests: bool = False, group_bytes: int = 4 << 20, bucket_windows: int = 1 << 20) -> DataFrame:
    """Documents without the words of any ``length``-word window that starts more than once in the table.

    Returns the id, ``n_words``, ``removed`` (intervals of words) and ``kept`` (the words left, joined by a space); with
    ``digests``, ``n_removed`` and ``kept_sha256`` in place of the last two. ``group_bytes`` and ``bucket_windows`` bound
    what one group or bucket holds; both grow with the square root of the input beyond 1 GB, to keep the arrays long.
    """
    kind = docs.schema[id_col].dataType
    total = text_bytes(docs, text_col)
    grown = min(32.0, max(1.0, (total / 2**30) ** 0.5))
    groups = int(total / (group_bytes * grown)) + 1
    buckets = int(total / 4 / (bucket_windows * grown)) + 1
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(groups))).repartition(groups, "g")
    sent = dealt.groupBy("g").applyInArrow(_send(length, buckets), "bucket long, g long, hashes binary")
    known = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_repeated, "g long, hashes binary")
    remove, digest = _remove(length)
    id_type = kind.simpleString()
    schema = f"id {id_type}, n_words long, " + ("n_removed long, kept_sha256 string" if digests else "removed array<struct<first_word:long,end_word:long>>, kept string")
    both = dealt.groupBy("g").cogroup(known.repartition(groups, "g").groupBy("g"))
    return both.applyInArrow(digest if digests else remove, schema).withColumnRenamed("id", id_col)
