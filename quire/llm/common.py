"""What the training-data operators share: tables in the shared folder, word splitting and vectorised hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import shared_folder

#: A word is a run of characters other than space, tab, LF, VT, FF and CR; ``bytes.split()`` splits UTF-8 at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder (partitioned ``by`` columns): computed once, lineage cut, readable after an executor is lost."""
    path = shared_folder(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extended(fields: list[T.StructField], ddl: str) -> T.StructType:
    """A schema of ``fields``, whatever their names, and the columns of ``ddl`` after them."""
    return T.StructType([*fields, *T.StructType.fromDDL(ddl).fields])


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts."""
    return df.agg(F.sum(F.octet_length(F.col(text)))).head()[0] or 0


def slices(texts: list[bytes], budget: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``budget`` bytes together (a longer text stands alone)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > budget:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def mixed(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial (Rabin-Karp) hashes modulo 2**64 of ``values[starts:ends]``, from one running sum."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=sums[1:])
    return (sums[ends] - sums[starts]) * _power(_BASE_INVERSE, len(values) + 1)[starts]


class Words:
    """The words of a list of UTF-8 texts: byte ranges in ``buffer``, a 64-bit hash each, and ``offsets`` of each text's words."""

    _blank = np.zeros(256, dtype=bool)
    _blank[[32, 9, 10, 11, 12, 13]] = True

    def __init__(self, texts: list[bytes]):
        self.buffer = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_at = np.concatenate([[0], np.cumsum(lengths)])
        blank = np.concatenate([[True], self._blank[self.buffer], [True]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.offsets = np.searchsorted(self.starts, self.text_at)

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        return mixed(rolling(self.buffer.astype(np.uint64) + np.uint64(1), self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` and the offsets of each text's words, in pieces of bounded memory."""
    parts, counts = [np.zeros(0, dtype=np.uint64)], []
    for a, b in slices(texts):
        words = Words(texts[a:b])
        parts.append(words.hashes())
        counts.append(np.diff(words.offsets))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, dtype=np.int64)
    return np.concatenate(parts), offsets.astype(np.int64)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null is empty."""
    return [t or b"" for t in column.cast("binary").to_pylist()]


#: Keys that a table may send out to all tasks in place of a shuffle; a key among them has more than a 4096th of the rows, so there are no more.
HOT_KEYS = 4096


def split_hot(table: DataFrame, weight: str) -> tuple[DataFrame, DataFrame]:
    """``table`` (one row a key, ``weight`` rows of another table each) as its hot keys, at most ``HOT_KEYS`` whatever its size, and all others."""
    total = table.agg(F.sum(weight)).head()[0] or 0
    hot = F.col(weight) > total // HOT_KEYS + 1
    return table.where(hot), table.where(~hot)


def matched(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """The inner join of ``rows`` with ``table`` (one row a key): hot keys are sent out, so that no task gets all rows of one; the rest is shuffled.
    Both should be written tables, as they are read more than once."""
    hot, rest = split_hot(table, weight)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))
