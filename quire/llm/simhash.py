"""SimHash near-dedup: fingerprints within a Hamming radius, found by vantage-point trees, joined into components.

* A fingerprint's 64 bits are cut into ``blocks``. Two fingerprints at distance <= R differ by at most r_i bits in some
  block i whenever the sum of (r_i + 1) over the blocks exceeds R: at R = 4 three blocks of 21 bits with radii 1, 1 and 0.
* Each block has a vantage-point tree that shares one vantage point a level (so no tree has to be sent around): a
  fingerprint goes near or far by its block's distance to that point against the level's median. A fingerprint is *at home*
  in one leaf and *visits* every leaf that the triangle bounds cannot rule out: at radius r both branches within r of the edge.
  At radius 1 the bounds of all levels are also taken together: of the leaves within them only those that a point one bit away
  lies in are visited, at most one for each bit of the block, however deep the tree.
* A leaf is one shuffle key. Its homes are held a bounded part at a time, visitors stream past them, and XOR and popcount on
  whole fingerprints decide; a leaf with more homes than ``part`` is dealt over several keys that its visitors all visit.
  Only the links that join two sets so far apart leave a task: a spanning forest, never all pairs of a group.
* Components come from alternating large-star and small-star steps over the forest, each step written to the shared folder.

Equal fingerprints are one node, whatever the number of copies. Optionally a wider ``sketch`` of 128 bits rides along and a
link also needs it within ``sketch_bits``: then ``bits`` may be wide without linking unrelated texts.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; fewer words than ``shingle`` make
one shingle of them all; repeated rows are kept and share a component; null ids are kept and never are a component's
smallest unless all are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import as_bytes, mixed, written

SEED = 42
LEAF = 2048
SALTS = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of ``shingle`` words joined by a space, repeats included (A-Z lower-cased)."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    at = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(at, at[shingle:])], dtype=np.uint64)  # noqa: B905


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of ``hashes`` (zero of none)."""
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def _sketch(hashes: np.ndarray) -> bytes:
    """128 bits: the majority words of two remixings of the different hashes."""
    own = np.unique(hashes)
    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    mixes = [(own ^ (own >> np.uint64(29))) * np.uint64(m) for m in odd]
    return b"".join(majority(x ^ (x >> np.uint64(32))).to_bytes(8, "little") for x in mixes)


def _fingerprints(shingle: int, distinct: bool, sketch_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sketches = [], []
            for text in as_bytes(batch["text"]):
                hashes = shingle_hashes(text, shingle)
                prints.append(majority(np.unique(hashes) if distinct else hashes))
                sketches.append(_sketch(shingle_hashes(text, sketch_shingle)) if sketch_shingle else None)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(sketches, pa.binary())], ["id", "print", "sketch"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distinct: bool = False, sketch_shingle: int = 0) -> DataFrame:
    """``id``, ``print`` (64 bits as a long) and ``sketch`` (null unless ``sketch_shingle`` is set) of every row."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(_fingerprints(shingle, distinct, sketch_shingle), f"id {given.schema['id'].dataType.simpleString()}, print long, sketch binary")


def _block_masks(blocks: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def radii(bits: int, blocks: int) -> list[int]:
    """The least radii of the blocks with sum of (r + 1) = bits + 1."""
    return [(bits + 1) // blocks + (i < (bits + 1) % blocks) - 1 for i in range(blocks)]


class Trees:
    """One vantage-point tree for each block: masks, radii and, for each level, the vantage point and the split distance."""

    def __init__(self, sample: np.ndarray, count: int, bits: int, blocks: int, leaf: int = LEAF):
        rng = np.random.default_rng(SEED)
        self.tables = []
        for mask, radius in zip(_block_masks(blocks), radii(bits, blocks), strict=True):
            if radius < 0:
                continue
            width = mask.bit_count()
            levels = min(2 * width, max(0, int(count / leaf).bit_length() + 1))
            points = [np.uint64(int(x) & mask) for x in rng.integers(0, 2**64, size=levels, dtype=np.uint64)]
            own = sample & np.uint64(mask)
            splits = [int(np.median(np.bitwise_count(own ^ p))) if len(own) else width // 2 for p in points]
            self.tables.append((np.uint64(mask), radius, list(zip(points, splits, strict=True))))

    def leaves(self, prints: np.ndarray, table: int, visits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, leaf and whether it is the row's home, for every leaf that a row is at home in or (``visits``) visits."""
        mask, radius, levels = self.tables[table]
        own = prints & mask
        if visits and radius == 1:
            return self._within_one(own, int(mask), levels)
        row, leaf, home = np.arange(len(own)), np.zeros(len(own), dtype=np.int64), np.ones(len(own), dtype=bool)
        for point, split in levels:
            d = np.bitwise_count(own ^ point).astype(np.int64)[row]
            near = d <= split
            if not visits:
                leaf = 2 * leaf + near
                continue
            other = (near & (d + radius > split)) | (~near & (d - radius <= split))
            row, home = np.concatenate([row, row[other]]), np.concatenate([home, np.zeros(int(other.sum()), dtype=bool)])
            leaf = np.concatenate([2 * leaf + near, 2 * leaf[other] + ~near[other]])
        return row, leaf, home


    @staticmethod
    def _within_one(own: np.ndarray, mask: int, levels: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """At radius 1 the bounds of all levels together are exact: a leaf is visited if the code, or one bit away, lies in it."""
        flips = np.array([0, *(1 << b for b in range(64) if mask >> b & 1)], dtype=np.uint64)
        codes = own[:, None] ^ flips[None, :]
        leaf = np.zeros(codes.shape, dtype=np.int64)
        for point, split in levels:
            leaf = 2 * leaf + (np.bitwise_count(codes ^ point) <= split)
        at_home = leaf[:, :1]
        away = np.sort(np.where(leaf == at_home, -1, leaf), axis=1)
        new = (away >= 0) & np.concatenate([np.ones((len(own), 1), dtype=bool), away[:, 1:] != away[:, :-1]], axis=1)
        row, column = np.nonzero(new)
        rows = np.arange(len(own))
        return np.concatenate([rows, row]), np.concatenate([at_home[:, 0], away[row, column]]), np.concatenate([np.ones(len(own), dtype=bool), np.zeros(len(row), dtype=bool)])


def _homes(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch["print"].to_numpy(zero_copy_only=False).view(np.uint64)
            for t in range(len(trees.tables)):
                leaf = trees.leaves(prints, t, visits=False)[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t, dtype=np.int32)), pa.array(leaf)], ["tree", "leaf"])

    return run


def _deal(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch["print"].to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(prints), 2048):
                for t in range(len(trees.tables)):
                    row, leaf, home = trees.leaves(prints[a : a + 2048], t)
                    part = batch.slice(a, 2048).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, dtype=np.int32)), pa.array(leaf), pa.array(home), *part.columns], ["tree", "leaf", "home", *part.schema.names])

    return run


class _Forest:
    """Union-find over the nodes of one leaf part."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _compare(bits: int, sketch_bits: int):
    def words(column) -> np.ndarray | None:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, 2) if sketch_bits else None

    def links(forest: _Forest, at_home: list, node: np.ndarray, prints: np.ndarray, sketch: np.ndarray | None) -> list[tuple[int, int]]:
        out = []
        for home_node, home_print, home_sketch in at_home:
            some = max(1, (1 << 19) // len(home_print))
            for a in range(0, len(prints), some):
                i, j = np.nonzero(np.bitwise_count(prints[a : a + some, None] ^ home_print[None, :]) <= bits)
                i += a
                if sketch_bits and len(i):
                    close = np.bitwise_count(sketch[i] ^ home_sketch[j]).sum(axis=1, dtype=np.int64) <= sketch_bits
                    i, j = i[close], j[close]
                for x, y in zip(node[i].tolist(), home_node[j].tolist(), strict=True):
                    if x != y and forest.join(x, y):
                        out.append((x, y))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, homes first; a key's homes are few (at most ``part``), its visitors stream."""
        key, forest, at_home = None, None, []
        for batch in batches:
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tree", "leaf", "salt")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                if a == b:
                    continue
                if tuple(keys[a]) != key:
                    key, forest, at_home = tuple(keys[a]), _Forest(), []
                rows = batch.slice(a, b - a)
                node, prints, sketch = rows["node"].to_numpy(zero_copy_only=False), rows["print"].to_numpy(zero_copy_only=False).view(np.uint64), words(rows["sketch"])
                home = rows["home"].to_numpy(zero_copy_only=False)
                if home.any():
                    at_home.append((node[home], prints[home], sketch[home] if sketch_bits else None))
                out += links(forest, at_home, node, prints, sketch)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def close_links(nodes: DataFrame, bits: int, blocks: int, sketch_bits: int = 0, leaf: int = LEAF, part: int = 8 * LEAF, sample: int = 8192) -> DataFrame:
    """A forest (``a``, ``b``) with the components of all links between ``nodes`` (``node``, ``print``, ``sketch``).

    ``sample`` fingerprints (the smallest hashes) place the splits; they decide how even the leaves are, not what is found.
    """
    spark, count = nodes.sparkSession, nodes.count()
    few = nodes.orderBy(F.xxhash64("node"), "node").limit(sample).select("print").toArrow()["print"].to_numpy().view(np.uint64)  # merged by a task, not here
    trees = Trees(few, count, bits, blocks, leaf)
    large = nodes.select("print").mapInArrow(_homes(trees), "tree int, leaf long").groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > part)
    # as a table its size is known: Spark sends it to the rows where it is small, and they are shuffled once
    large = written(large.select("tree", "leaf", F.ceil(F.col("n") / F.lit(part)).cast("int").alias("salts")))
    dealt = nodes.mapInArrow(_deal(trees), "tree int, leaf long, home boolean, node long, print long, sketch binary")
    joined = dealt.join(large, ["tree", "leaf"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    spread = joined.withColumn("salt", F.explode(F.when(F.col("salts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))))
    spread = spread.withColumn("home", F.col("home") & (F.element_at(own, 1) == F.col("salt"))).drop("salts")
    keyed = spread.repartition(*(F.col(c) for c in ("tree", "leaf", "salt"))).sortWithinPartitions("tree", "leaf", "salt", F.desc("home"))
    return keyed.select("tree", "leaf", "salt", "home", "node", "print", "sketch").mapInArrow(_compare(bits, sketch_bits), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node of ``links``, which it writes at each step. It ends when all edges are stars: no node leads to
    two others or to one that leads on; as edges lead to smaller nodes, a star's middle is its smallest."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("middle")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        most = ends.groupBy("node").agg((F.sum("up") + F.max("middle")).alias("n")).agg(F.max("n")).head()[0]
        if (most or 0) < 2:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 4, blocks: int = 3, distinct: bool = False, sketch_shingle: int = 0, sketch_bits: int = 0) -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits) and ``component`` (the smallest id reachable over links) of every document."""
    prints = written(fingerprints(docs, id_col, text_col, shingle, distinct, sketch_shingle))
    node = F.xxhash64("print", "sketch") if sketch_shingle else F.col("print")
    prints = prints.withColumn("node", node)
    nodes = written(prints.groupBy("node", "print", "sketch").agg(F.min("id").alias("first")))
    roots = components(close_links(nodes, bits, blocks, sketch_bits))
    linked = written(roots.join(nodes.select("node", "first"), "node"))
    # a large component's nodes are dealt over ``SALTS`` keys to learn their smallest id; nodes without links need not ask
    least = linked.groupBy("root").agg(F.min("first").alias("component")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"]).select("node", "component")
    smallest = nodes.select("node", "first").join(known, "node", "left").select("node", F.when(F.col("component").isNull() | (F.col("first") < F.col("component")), F.col("first")).otherwise(F.col("component")).alias("component"))
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return prints.join(smallest, "node").select("id", hexed.alias("fingerprint"), "component")


ROWS, BANDS, JACCARD = 4, 16, 0.8
_MIX = np.random.default_rng(SEED).integers(0, 2**64, size=ROWS * BANDS, dtype=np.uint64)


def _bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: the least of ``ROWS`` remixings of the different hashes."""
    least = np.array([mixed(hashes ^ m).min() for m in _MIX], dtype=np.uint64).reshape(BANDS, ROWS)
    key = np.zeros(BANDS, dtype=np.uint64)
    for column in least.T:
        key = mixed(key ^ column) + column
    return key


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, keys, sets = [], [], [], []
            for text in as_bytes(batch["text"]):
                own = np.unique(shingle_hashes(text, shingle))
                prints.append(majority(own))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                keys.append(_bands(own).view(np.int64).tolist() if len(own) else [])
                sets.append(np.unique((own >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["hash"], *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, prints)), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["id", "hash", "node", "print", "keys", "shingles"])

    return run


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``JACCARD`` at least."""
    if min(len(a), len(b)) < JACCARD * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 5 * same >= 4 * (len(a) + len(b) - same)


def _similar_in_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group and part; each is compared with all earlier ones that no link joins it to yet."""
    key, forest, seen = None, _Forest(), []
    for batch in batches:
        out = []
        for x, y, z, node, shingles in zip(*(batch[c].to_pylist() for c in ("group", "low", "high", "node", "shingles")), strict=True):
            if (x, y, z) != key:
                key, forest, seen = (x, y, z), _Forest(), []
            own = np.frombuffer(shingles, dtype=np.uint32)
            for other, theirs in seen:
                if forest.root(node) != forest.root(other) and _similar(own, theirs):
                    forest.join(node, other)
                    out.append((node, other))
            seen.append((node, own))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def close_keys(sets: DataFrame, bits: int = 4, blocks: int = 3) -> DataFrame:
    """``node`` and ``key`` of ``sets`` (``node``, ``print``; rows of one node are alike): one key for what links of fingerprints within ``bits`` connect, found by the vantage-point trees."""
    prints = written(sets.select(F.col("print").alias("node"), "print", F.lit(None).cast("binary").alias("sketch")).distinct())
    roots = components(close_links(prints, bits, blocks)).withColumnRenamed("node", "print")
    return written(sets.select("node", "print").distinct().join(roots, "print", "left").select("node", F.coalesce("root", "print").alias("key")))


def similar_links(sets: DataFrame, block: int = 256, close: DataFrame | None = None) -> DataFrame:
    """A forest (``a``, ``b``) with the components of all pairs of ``sets`` (``node``, ``keys``, ``shingles``; rows of one node are
    alike) that share a band key, or a key of ``close`` (``node``, ``key``), and have a Jaccard similarity of ``JACCARD`` at least. Only nodes that share a key send their shingles.

    A group is the nodes of one key; groups of the same nodes are compared once. One of over ``block`` nodes is dealt in
    blocks, every two of which meet in one task, so that no pair is left out and none is large.
    """
    keyed = sets.groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.posexplode("keys").alias("band", "key"))
    if close is not None:
        keyed = keyed.unionAll(close.select("node", F.lit(-1).alias("band"), "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = written(keyed.join(sizes, ["band", "key"]).select("node", F.xxhash64("band", "key").alias("group"), "n"))
    small = keyed.where(F.col("n") <= block).groupBy("group").agg(F.array_sort(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
    small = small.select(F.xxhash64("nodes").alias("group"), F.lit(0).alias("low"), F.lit(0).alias("high"), F.explode("nodes").alias("node"))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    large = keyed.where(F.col("n") > block).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("group", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node")
    # as a table its size is known: Spark sends the nodes to the sets where they are few
    asked = written(keyed.select("node").distinct())
    few = written(sets.select("node", "shingles").join(asked, "node", "left_semi").dropDuplicates(["node"]))
    met = small.unionAll(large).join(few, "node")
    dealt = met.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "node")
    return dealt.select("group", "low", "high", "node", "shingles").mapInArrow(_similar_in_group, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``id``, ``hash`` (of the text), ``node`` and ``root`` (one node of its group) of every document."""
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), F.col(f"`{text_col}`").alias("text"))
    every = written(given.mapInArrow(_shingle_sets(shingle), f"id {given.schema['id'].dataType.simpleString()}, hash long, node long, print long, keys array<long>, shingles binary"))
    roots = components(similar_links(every.select("node", "keys", "shingles"), close=close_keys(every)))
    return every.select("id", "hash", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document, with its columns, of each group of near copies: the one of the smallest id (null is the largest), then of the smallest hash of its text (Jaccard similarity of their
    different five-word shingles of 0.8 or more, decided on 32 bits of the shingles' hashes; groups are what such pairs connect).

    Candidates are what SimHash finds (fingerprints of the same shingles linked within 4 bits by the vantage-point trees, and what such links connect), and those that agree in one of 16 bands of 4 least hashes, each of other mixings of the shingles: at Jaccard s by a chance of
    1 - (1 - s^4)^16, which is 0.9998 at 0.8. Of rows of one id and text one stays; an id whose texts are in different groups stays in each.
    """
    found = similar_groups(docs, id_col, text_col)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "hash")
    stay = found.groupBy("root").agg(F.min(order).alias("least")).select("least.id", "least.hash")
    again = written(found.groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("__id"), F.col("hash").alias("__hash")))
    row, own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id")
    given = docs.select(own, F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), row)
    same = lambda x, y: x["id"].eqNullSafe(y[0]) & (x["hash"] == y[1])
    s = stay.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"))
    left = given.join(s, same(given, (s["__id"], s["__hash"])), "left_semi")
    # only rows that repeat an id and text, which a small table names, are dealt anew to leave one of each
    once = left.join(again, same(left, (again["__id"], again["__hash"])), "left_anti")
    many = left.join(again, same(left, (again["__id"], again["__hash"])), "left_semi").dropDuplicates(["id", "hash"])
    return once.unionAll(many).select("row.*")
