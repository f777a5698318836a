"""Packing by Karmarkar-Karp multiway differencing: documents' token ids into sequences of at most ``capacity`` with little padding.

Each document is tokenised (plus one end id) and cut: as many full sequences as it holds, then pieces of at most ``piece``
ids. Pieces are packed ``group`` at a time as they stream through a task: the largest differencing method keeps partial
partitions, ordered by the spread of their window sums, and always merges the two of widest spread by laying the heaviest
windows of one on the lightest of the other. The windows it ends with are nearly equal; if one is over capacity, the group
is packed again with one window more. No group is larger than ``group``, so memory and time a document are constant, and
nothing is shuffled.

A word is tokenised once a worker: text is cut at ASCII white space (which this tokenizer drops, and which no token spans),
and ids are kept by word and by its letters in lower case, up to twice ``remembered`` of each.

Defined cases: null and empty texts have the end id alone; repeated rows are packed each; null ids are kept; an empty table
gives no pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.common import as_bytes, slices

CAPACITY = 2048
_SUM = itemgetter(0)
END_ID = 1
#: Words, and word stems, of each of two generations: the older one is dropped when the newer is full, but for words met again since.
REMEMBERED = 100_000


#: Latin letters, which this tokenizer lower-cases and takes as one piece, and ASCII punctuation after them, another piece.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")
_PUNCTUATION = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
#: Printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 characters for themselves, the others from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STAND_INS = {**{b: chr(b) for b in _PLAIN}, **{b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}}


class _Known(dict):
    """Ids by word. One that is missing is taken over from ``older`` or made, so that each word of a text is looked up once."""

    def __init__(self, make: Callable[[bytes], bytes], older: dict[bytes, bytes]):
        self.make, self.older, self.long = make, older, []

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
            if len(word) > 64:
                self.long.append(word)
        self[word] = ids
        return ids


class WordIds:
    """Little-endian 32-bit token ids of texts (UTF-8), word by word.

    A plain word goes to the tokenizer's merge model alone, in lower case and once for all endings, without the passes over the
    text before it; the result is the same.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.merge = self.tokenizer.model.tokenize
        self.words, self.stems, self.older_stems = _Known(self.made, {}), {}, {}
        probe = "Éducation thing's, unlike. Stra\u00dfe"
        self.plain = all(self.merged(w.lower()) == self.encoded(w) for w in re.findall(_SIMPLE.pattern.partition(")")[0][1:], probe))

    def encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, low: str) -> bytes:
        pieces = low if low.isascii() else low.encode().decode("latin-1").translate(_STAND_INS)
        return array("I", [t.id for t in self.merge(pieces)]).tobytes()

    def stem(self, letters: bytes) -> bytes:
        ids = self.stems.get(letters)
        if ids is None:
            ids = self.older_stems.get(letters)
            if ids is None:
                ids = self.merged(letters.decode())
            self.stems[letters] = ids
        return ids

    def made(self, word: bytes) -> bytes:
        if not self.plain:
            return self.encoded(word.decode())
        letters = word if word.isalpha() else word.rstrip(_PUNCTUATION)
        if letters.isalpha():  # of ASCII
            stem = letters.lower()
        elif simple := _SIMPLE.fullmatch(text := word.decode()):
            letters = simple[1].encode()
            stem = simple[1].lower().encode()
        else:
            return self.encoded(text)
        ids = self.stem(stem)
        if len(letters) < len(word):
            ending = word[len(letters) :]
            if ending not in self.words:
                self.words[ending] = self.encoded(ending.decode())
            ids += self.words[ending]
        return ids

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Words are looked up here and made once; long ones are forgotten with the call."""
        if len(self.words) > self.most:
            self.words.older = {}
            self.words = _Known(self.made, self.words)
        if len(self.stems) > self.most:
            self.older_stems, self.stems = self.stems, {}
        words = self.words
        out = [b"".join(map(words.__getitem__, t.split())) for t in texts]
        for word in words.long:
            del words[word]
        words.long.clear()
        return out


_tokenizers: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, most: int = REMEMBERED) -> WordIds:
    if (path, most) not in _tokenizers:
        _tokenizers[path, most] = WordIds(path, most)
    return _tokenizers[path, most]


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Multiway Karmarkar-Karp: the numbers 0.. of ``sizes`` dealt over ``windows`` nearly equal sums.

    A partial partition is its windows in use, heaviest first, each its sum over the lightest window and its numbers.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free_a, free_b = windows - len(a), windows - len(b)
        if len(a) > free_b:  # the heaviest of one fall on the lightest of the other
            both = [(x + y, own + more) for (x, own), (y, more) in zip(a[free_b:], b[: free_a - 1 if free_a else None : -1], strict=True)]
            after = a[:free_b] + both + b[:free_a]
            after.sort(key=_SUM, reverse=True)
            if lightest := after[-1][0]:
                after = [(x - lightest, own) for x, own in after]
            spread = after[0][0]
        else:
            after = sorted(a + b, key=_SUM, reverse=True)
            spread = after[0][0] - (after[-1][0] if len(after) == windows else 0)
        heapq.heappush(heap, (-spread, i, after))
    return [own for _, own in heap[0][2]]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows (lists of numbers of ``sizes``) of at most ``capacity`` each; one window more whenever it is exceeded."""
    if not sizes:
        return []
    windows = -(-sum(sizes) // capacity)
    while True:
        out = differencing(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return [w for w in out if w]
        windows += 1


def _cuts(n: int, capacity: int, piece: int) -> Iterator[tuple[int, int]]:
    full = n - n % capacity
    yield from ((a, capacity) for a in range(0, full, capacity))
    yield from ((a, min(piece, n - a)) for a in range(full, n, piece))


def _tokenised(batch: pa.RecordBatch, ids_of: WordIds) -> Iterator[tuple[object, bytes]]:
    """Id and token ids, with the end id, of each row, of some texts at a time."""
    for a in range(0, batch.num_rows, 256):
        keys, texts = batch["id"].slice(a, 256).to_pylist(), as_bytes(batch["text"].slice(a, 256))
        for low, high in slices(texts):
            for key, ids in zip(keys[low:high], ids_of.of(texts[low:high]), strict=True):
                yield key, ids + END_ID.to_bytes(4, "little")


def _run(path: str, capacity: int, piece: int, group: int, remembered: int = REMEMBERED):
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task = word_ids(path, remembered), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        made, waiting, out, kind = 0, [], [], None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        def settle() -> None:
            nonlocal made
            for window in pack([x[2] for x in waiting], capacity):
                at = 0
                for i in window:
                    out.append((*waiting[i], task + made, at))
                    at += waiting[i][2]
                made += 1
            waiting.clear()

        for batch in batches:
            kind = batch.schema.field("id").type
            for key, ids in _tokenised(batch, ids_of):
                n = len(ids) // 4
                for start, length in _cuts(n, capacity, piece):
                    row = (key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n)
                    if length == capacity:
                        out.append((*row, task + made, 0))
                        made += 1
                    else:
                        waiting.append(row)
                        if len(waiting) == group:
                            settle()
            if out:
                yield rows()
        settle()
        if out:
            yield rows()

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, piece: int = CAPACITY // 4, group: int = 512, remembered: int = REMEMBERED) -> DataFrame:
    """One row for each piece of a document: where it starts in its document and in which sequence, at which offset, it lies. ``remembered`` words and stems of each generation
    take memory (about 400 bytes each, of two generations) and save time, and change no result."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    schema = f"id {given.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return given.mapInArrow(_run(path, capacity, piece, group, remembered), schema).withColumnRenamed("id", id_col)
