"""Local image descriptors: cropped and edited copies by multiscale corners, rotated binary tests, Hamming-table joins and geometric consensus.

1. Images of equal bytes (SHA-256) are one *picture* from here on, whatever the number of copies.
2. On a pyramid of factor 1.1, local maxima of the Harris response are corners, as many as the level's area has room for; the
   intensity centroid of the patch around a corner gives its orientation, by which 256 pixel-pair tests are rotated: one descriptor.
3. In each of five Hamming tables a descriptor has a key of 56 of its bits. Rows of (key, picture and corner, 16 more bits) are sorted by
   key once; rows of one key that differ in at most ``CHECK`` of the 16 bits meet, and pictures that meet in two corners are candidates.
   Of n differing bits of 256 a table meets with a chance of about (1 - n/256)**56: one of the five with 0.9 at 4 bits, 0.4 at 10 bits.
4. A candidate pair is decided on all its corners: each corner's nearest descriptor in the other picture, within ``bits``, is a match,
   any two matches give a rotation, scale and shift, and pictures are linked if ``votes`` matches at different places agree on one.
5. Linked pictures form classes; an image's class is the smallest image id in it.

A bucket (one key) of over ``crowd`` rows, as a large group of copies makes, gives neighbours in picture order only at first. Where its
pictures are one class after that, nothing can be missing. Where not, its rows meet in blocks, every two of them in one task, so
that all its pairs are candidates after all: whole, with work that grows with the square of such a bucket.

Images are binary PGM (``P5``, 8 bits). Defined cases: a null or undecodable image, or one too small for corners, has no
descriptor and is in a class with its equals (nulls each alone); repeated rows share a class; ties of corners' strength go by place;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mixed, written
from quire.llm.simhash import components

RADIUS = 7
STEPS = 24
FACTOR = 1.1
TABLES, WIDTH = 5, 56
#: The bits of a descriptor that are a table's key, of the tests chosen first, which tell most; and the bits that go along as a check.
_TABLE_BITS = np.stack([np.random.default_rng(k).permutation(160)[:WIDTH] for k in range(TABLES)])
_CHECK_BITS, CHECK = np.arange(160, 256, 6), 3
#: Pixels of a level for each corner of it.
ROOM = 480
#: A corner as the picture's table keeps it: its place in the picture, and its descriptor.
CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("bits", "<u8", (4,))])
_DISC = np.hypot(*np.meshgrid(np.arange(-RADIUS, RADIUS + 1), np.arange(-RADIUS, RADIUS + 1))) <= RADIUS


def pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def decode(image: bytes | None) -> np.ndarray | None:
    found = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", image or b"")
    if not found or len(image) - found.end() != int(found[1]) * int(found[2]):
        return None
    return np.frombuffer(image, dtype=np.uint8, offset=found.end()).reshape(int(found[2]), int(found[1]))


def _smooth(x: np.ndarray) -> np.ndarray:
    x = x[:, :-2] + 2 * x[:, 1:-1] + x[:, 2:]
    return (x[:, :, :-2] + 2 * x[:, :, 1:-1] + x[:, :, 2:]) / 16


def _padded(x: np.ndarray, by: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (by, by), (by, by)), mode="edge")


def resized(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """Equally large images at another size, by linear interpolation."""
    out = images
    for axis, size in ((1, height), (2, width)):
        n = out.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * (n / size) - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(0, n - 2))
        part = (at - low).astype(np.float32).reshape((-1, 1) if axis == 1 else (-1,))
        out = np.take(out, low, axis=axis) * (1 - part) + np.take(out, np.minimum(low + 1, n - 1), axis=axis) * part
    return out


def corners(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image number, row and column of the strongest corners of each of equally large (smoothed) images."""
    x = images
    dx, dy = (x[:, 1:-1, 2:] - x[:, 1:-1, :-2]) / 2, (x[:, 2:, 1:-1] - x[:, :-2, 1:-1]) / 2
    a, b, c = (_smooth(_smooth(_padded(v, 2))) for v in (dx * dx, dy * dy, dx * dy))
    r = _padded(a * b - c * c - 0.05 * (a + b) ** 2, 1)
    edge = RADIUS + 1
    height, width = r.shape[1] - 2 * edge, r.shape[2] - 2 * edge
    if min(height, width) < 3:
        return (np.zeros(0, int),) * 3
    inner = r[:, edge:-edge, edge:-edge]
    top = np.ones(inner.shape, dtype=bool)
    for v in (-1, 0, 1):
        for u in (-1, 0, 1):
            if u or v:
                top &= inner >= r[:, edge + v : r.shape[1] - edge + v, edge + u : r.shape[2] - edge + u]
    value = np.where(top & (inner > 1), inner, 0).reshape(len(x), -1)
    k = min(max(3, images.shape[1] * images.shape[2] // ROOM), value.shape[1])
    at = np.argsort(-value, axis=1, kind="stable")[:, :k]
    image, rank = np.nonzero(np.take_along_axis(value, at, axis=1) > 0)
    flat = at[image, rank]
    return image, flat // width + edge, flat % width + edge


def rotated(pairs: np.ndarray) -> np.ndarray:
    """For each orientation, the places in a patch of the pairs (x, y of either pixel), turned by it."""
    angle = 2 * np.pi * np.arange(STEPS)[:, None, None] / STEPS
    x, y = pairs[None, :, 0::2], pairs[None, :, 1::2]
    u, v = (np.clip(np.rint(z), -RADIUS, RADIUS).astype(int) + RADIUS for z in (np.cos(angle) * x - np.sin(angle) * y, np.sin(angle) * x + np.cos(angle) * y))
    return v * (2 * RADIUS + 1) + u


@cache
def tests(count: int = 256, offered: int = 3000) -> np.ndarray:
    """``rotated`` places of the pixel pairs that are compared: of random ones those that tell most on pictures of smoothed noise,
    each near half and half, and little correlated with those before it. Chosen on the driver, so that all tasks use the same."""
    rng = np.random.default_rng(5)
    pairs = np.clip(rng.normal(0, RADIUS / 2, (offered, 4)), -RADIUS + 0.5, RADIUS - 0.5)
    noise = [rng.random((12, 96 // k + 1, 96 // k + 1)).repeat(k, axis=1).repeat(k, axis=2)[:, :96, :96] for k in (2, 4, 8)]
    images = _smooth(_smooth(_padded(255 * np.concatenate(noise), 2)))
    told = compared(images, *corners(images), rotated(pairs)).astype(np.float32)
    bias = np.abs(told.mean(axis=0) - 0.5)
    told = (told - told.mean(axis=0)) / np.maximum(told.std(axis=0), 1e-3) / np.sqrt(len(told))
    chosen, tied = [], bias.copy()  # at each step the pair that is least biased and least like any chosen one
    for _ in range(count):
        best = int(tied.argmin())
        chosen.append(best)
        tied = np.maximum(tied, np.abs(told.T @ told[:, best]))
        tied[best] = np.inf
    return rotated(pairs[chosen])


def compared(images: np.ndarray, image: np.ndarray, row: np.ndarray, col: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Outcome of each test of each corner, turned by the corner's orientation."""
    offset = np.arange(-RADIUS, RADIUS + 1)
    patch = images[image[:, None, None], row[:, None, None] + offset[None, :, None], col[:, None, None] + offset[None, None, :]]
    disc = patch * _DISC
    step = np.rint(np.arctan2((disc * offset[None, :, None]).sum(axis=(1, 2)), (disc * offset[None, None, :]).sum(axis=(1, 2))) * STEPS / (2 * np.pi)).astype(int) % STEPS
    values = np.take_along_axis(patch.reshape(len(patch), -1), places[step].reshape(len(patch), -1), axis=1).reshape(len(patch), -1, 2)
    return values[:, :, 0] < values[:, :, 1]


def features(images: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """The corners (``CORNER``) of each of equally large images, over all levels of the pyramid."""
    found = [[np.zeros(0, CORNER)] for _ in images]
    base, level = images.astype(np.float32), 0
    while True:
        grow = FACTOR**level
        height, width = int(round(images.shape[1] / grow)), int(round(images.shape[2] / grow))
        if min(height, width) < 4 * RADIUS or level > 24:
            return [np.concatenate(x) for x in found]
        own = _smooth(_smooth(_padded(resized(base, height, width) if level else base, 2)))
        image, row, col = corners(own)
        if len(image):
            rows = np.zeros(len(image), CORNER)
            rows["x"], rows["y"], rows["bits"] = (col + 0.5) * images.shape[2] / width, (row + 0.5) * images.shape[1] / height, np.packbits(compared(own, image, row, col, places), axis=1).view(np.uint64)
            cuts = np.searchsorted(image, np.arange(len(images) + 1))
            for i, x in enumerate(found):
                x.append(rows[cuts[i] : cuts[i + 1]])
        level += 1
        if level % 4 == 0:  # from a smaller copy, so that far levels are not sampled from single pixels
            base = resized(_smooth(_padded(base, 1)), max(4, base.shape[1] // 2), max(4, base.shape[2] // 2)) if min(base.shape[1:]) > 8 * RADIUS else base


def _describe(places: np.ndarray):
    """Digest and corners of each image; a task describes and numbers a picture once and leaves those of its later copies null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        task = TaskContext.get().partitionId() << 23
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                images, digests, blobs, numbers, shapes = part["image"].to_pylist(), [], [None] * part.num_rows, [None] * part.num_rows, {}
                for i, image in enumerate(images):
                    digests.append(None if image is None else hashlib.sha256(image).digest())
                    if image is None or digests[i] in seen:
                        continue
                    numbers[i] = task + len(seen)
                    seen.add(digests[i])
                    pixels = decode(image)
                    blobs[i] = b""
                    if pixels is not None:
                        shapes.setdefault(pixels.shape, []).append((i, pixels))
                for own in shapes.values():
                    for (i, _), found in zip(own, features(np.stack([x for _, x in own]), places), strict=True):
                        blobs[i] = found.tobytes()
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(digests, pa.binary()), pa.array(blobs, pa.binary()), pa.array(numbers, pa.int64())], ["id", "digest", "corners", "picture"])

    return run


def keys_of(bits: np.ndarray) -> np.ndarray:
    """The keys of descriptors (four words each) in the tables: ``WIDTH`` bits of the 256, and the table's number."""
    own = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 32), axis=1)
    keys = np.zeros((len(own), TABLES, 8), dtype=np.uint8)
    keys[:, :, : WIDTH // 8] = np.packbits(own[:, _TABLE_BITS].reshape(-1, WIDTH), axis=1).reshape(-1, TABLES, WIDTH // 8)
    keys[:, :, -1] = np.arange(TABLES)
    return keys.view(np.uint64)[:, :, 0]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            own = [np.frombuffer(x or b"", CORNER) for x in part["corners"].to_pylist()]
            sizes = np.array([len(x) for x in own], dtype=np.int64)
            number = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            who = (np.repeat(part["picture"].to_numpy().astype(np.int64), sizes) << 20) | number
            bits = np.concatenate([np.zeros(0, CORNER), *own])["bits"]
            keys, check = mixed(keys_of(bits)), np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 32), axis=1)[:, _CHECK_BITS] @ (1 << np.arange(len(_CHECK_BITS), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(who, TABLES)), pa.array(np.repeat(check.astype(np.int32), TABLES))], ["key", "who", "check"])


def _meet(crowd: int):
    """Rows come sorted by key and ``who``. Pairs of one key whose check bits are alike, or in a crowd its neighbours, as (``a``, ``b``,
    corner of ``a``); and the rows of crowds, as (key, -1 - picture, corner)."""

    def told(keys: np.ndarray, who: np.ndarray, check: np.ndarray, many: np.ndarray, last: tuple | None) -> pa.RecordBatch:
        small_key, small, bits = keys[~many], who[~many], check[~many]
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for d in range(1, crowd):
            same = np.flatnonzero(small_key[:-d] == small_key[d:]) if len(small) > d else ()
            if not len(same):
                break
            same = same[np.bitwise_count(bits[same] ^ bits[same + d]) <= CHECK]
            pairs.append((small[same], small[same + d]))
        large_key, large = keys[many], who[many]
        before_key, before = (large_key, large) if last is None else (np.append(last[0], large_key), np.append(last[1], large))
        near = np.flatnonzero(before_key[:-1] == before_key[1:]) if len(before) else np.zeros(0, int)
        pairs.append((before[near], before[near + 1]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        other = a >> 20 != b >> 20
        columns = np.append(a[other] >> 20, large_key), np.append(b[other] >> 20, -1 - (large >> 20)), np.append(a[other], large) & 0xFFFFF
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "corner"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3  # the rows of the last key so far, while they are not a crowd
        last = None  # key and row before, while a crowd goes on
        for batch in batches:
            keys, who, check = (np.append(k, batch[c].to_numpy().astype(np.int64)) for k, c in zip(kept, ("key", "who", "check"), strict=True))
            if not len(keys):
                continue
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(start, len(keys)))
            many = np.repeat(size > crowd, size)
            if last is not None:
                many |= keys == last[0]
            end = len(keys) if many[-1] else int(start[-1])  # a crowd's rows need not wait for the rest of it
            if end:
                yield told(keys[:end], who[:end], check[:end], many[:end], last)
                last = (keys[-1], who[-1]) if many[-1] else None
            kept = [keys[end:], who[end:], check[end:]]
        if len(kept[0]):
            yield told(*kept, np.zeros(len(kept[0]), dtype=bool), None)

    return run


def consensus(a: np.ndarray, b: np.ndarray, bits: int, votes: int, within: float = 1.5) -> bool:
    """Whether ``votes`` corners at different places of ``a`` match corners of ``b`` under one rotation, scale and shift."""
    if min(len(a), len(b)) < votes:
        return False
    best, apart = np.zeros(len(a), int), np.full(len(a), 257)
    for low in range(0, len(b), 1024):
        d = np.zeros((len(a), len(b[low : low + 1024])), dtype=np.int16)
        for w in range(4):
            d += np.bitwise_count(a["bits"][:, None, w] ^ b["bits"][None, low : low + 1024, w])
        own = d.argmin(axis=1)
        least = d[np.arange(len(a)), own]
        best, apart = np.where(least < apart, own + low, best), np.minimum(apart, least)
    match = np.flatnonzero(apart <= bits)
    if len(match) < votes:
        return False
    p = a["x"][match] + 1j * a["y"][match]
    q = b["x"][best[match]] + 1j * b["y"][best[match]]
    n = len(p)
    i, j = (np.repeat(np.arange(n), 32), np.repeat(np.arange(n), 32) + np.tile(np.arange(1, 33), n))
    i, j = i[j < n], j[j < n]
    far = (np.abs(p[i] - p[j]) > 2 * within) & (np.abs(q[i] - q[j]) > 2 * within)
    i, j = i[far], j[far]
    turn = (q[j] - q[i]) / (p[j] - p[i])
    fits = (np.abs(turn) > 1 / 3) & (np.abs(turn) < 3)
    i, turn = i[fits], turn[fits]
    place = np.unique(np.stack([p.real // (2 * within), p.imag // (2 * within)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    target = np.unique(np.stack([q.real // (2 * within), q.imag // (2 * within)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    for low in range(0, len(i), 4096):
        z, at = turn[low : low + 4096, None], i[low : low + 4096, None]
        inside = np.abs(z * (p[None, :] - p[at]) + q[at] - q[None, :]) <= within
        for row in np.flatnonzero(inside.sum(axis=1) >= votes):
            if min(len(set(place[inside[row]].tolist())), len(set(target[inside[row]].tolist()))) >= votes:
                return True
    return False


def _decide(bits: int, votes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [consensus(np.frombuffer(x, CORNER), np.frombuffer(y, CORNER), bits, votes) for x, y in zip(batch["of_a"].to_pylist(), batch["of_b"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(yes, pa.bool_())), batch["b"].filter(pa.array(yes, pa.bool_()))], ["a", "b"])

    return run


def _often(met: DataFrame) -> DataFrame:
    """Pairs that met in two corners of ``a`` at least; and the rows of crowds."""
    both = met.groupBy("a", "b").agg(F.min("corner").alias("corner"), F.max("corner").alias("other"))
    return both.where("b < 0 or corner < other")


def _decided(pairs: DataFrame, pictures: DataFrame, bits: int, votes: int) -> DataFrame:
    """The links among pairs (``a``, ``b``)."""
    side = lambda c: pictures.select(F.col("picture").alias(c), F.col("corners").alias(f"of_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(_decide(bits, votes), "a long, b long")


def links(pictures: DataFrame, bits: int = 32, votes: int = 4, crowd: int = 1024) -> DataFrame:
    """Pairs (``a`` < ``b``) whose classes are those of all linked pairs of ``pictures`` (``picture``, ``corners``)."""
    keyed = pictures.mapInArrow(_keys, "key long, who long, check int").repartition("key").sortWithinPartitions("key", "who")
    often = written(_often(keyed.mapInArrow(_meet(crowd), "a long, b long, corner long")))
    found = written(_decided(often.where("b >= 0").select("a", "b"), pictures, bits, votes))
    crowds = often.where("b < 0").select(F.col("a").alias("key"), (-1 - F.col("b")).alias("picture"), F.explode(F.array_distinct(F.array("corner", "other"))).alias("corner"))
    if crowds.isEmpty():
        return found
    # crowds whose pictures are in several classes: all their pairs of different classes, block by block
    roots = components(found).withColumnRenamed("node", "picture")
    crowds = crowds.join(roots, "picture", "left").withColumn("root", F.coalesce("root", "picture"))
    several = crowds.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("key", F.ceil(F.col("n") / F.lit(crowd)).cast("int").alias("blocks"))
    rest = crowds.join(several, "key").withColumn("own", F.pmod(F.xxhash64("picture"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("own", "block").alias("low"), F.greatest("own", "block").alias("high"), "own", "picture", "corner", "root")
    met = rest.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "picture").mapInArrow(_meet_in_blocks, "a long, b long, corner long")
    return found.unionAll(written(_decided(_often(met).select("a", "b"), pictures, bits, votes)))


def _meet_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different classes within each two blocks (of one block, where both are one); rows come sorted by key and blocks."""
    held, key = [], None
    for batch in batches:
        rows = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("key", "low", "high", "own", "picture", "corner", "root")], axis=1)
        out = []
        for row in np.split(rows, np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1) if len(rows) else ():
            if key is None or (row[0, :3] != key).any():
                key, held = row[0, :3].copy(), []
            before = np.concatenate([*held, row])
            i, j = np.nonzero((before[:, None, 6] != row[None, :, 6]) & (before[:, None, 4] < row[None, :, 4]) & ((key[1] == key[2]) | (before[:, None, 3] != row[None, :, 3])))
            k, m = np.nonzero((before[:, None, 6] != row[None, :, 6]) & (before[:, None, 4] > row[None, :, 4]) & ((key[1] == key[2]) | (before[:, None, 3] != row[None, :, 3])) & (np.arange(len(before)) < len(before) - len(row))[:, None])
            out += [np.stack([before[i, 4], row[j, 4], before[i, 5]], axis=1), np.stack([row[m, 4], before[k, 4], row[m, 5]], axis=1)]
            held.append(row)
        pairs = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, c]) for c in range(3)], ["a", "b", "corner"])


def copies(images: DataFrame, id_col: str = "image_id", image_col: str = "image", crowd: int = 256) -> DataFrame:
    """``class_id`` (the smallest id among the copies) and ``n_copies`` (images in the class) of every image."""
    given = images.select(F.col(id_col).alias("id"), F.col(image_col).alias("image"))
    kind = given.schema["id"].dataType.simpleString()
    seen = written(given.mapInArrow(_describe(tests()), f"id {kind}, digest binary, corners binary, picture long"))
    # a picture that several tasks described is known by its least number
    known = written(seen.where("picture is not null").groupBy("digest").agg(F.min("picture").alias("picture"), F.count("*").alias("n")))
    again = written(seen.where("picture is not null").join(known.where("n > 1").select("digest", F.col("picture").alias("least")), "digest").where("picture <> least").select("picture"))
    pictures = seen.where("picture is not null").select("picture", "corners").join(again, "picture", "left_anti")
    roots = components(links(pictures, crowd=crowd))
    named = known.select("digest", "picture").join(roots.withColumnRenamed("node", "picture"), "picture", "left").select("digest", F.coalesce("root", "picture").alias("root"))
    own = seen.where("digest is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).join(named, "digest")
    classes = own.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_copies"))
    classed = own.join(classes, "root").select("digest", "class_id", "n_copies")
    with_image = seen.where("digest is not null").select("id", "digest").join(classed, "digest").select("id", "class_id", "n_copies")
    alone = seen.where("digest is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    return with_image.unionAll(alone).withColumnRenamed("id", id_col)


SIDE = 64
EDITS = ("crop", "resize", "turn", "noise")


def edited(whole: np.ndarray, edit: str, rng: np.random.Generator) -> np.ndarray:
    """A copy of a picture: cropped, dimmed and brightened; resized to nine tenths; turned by a right angle; or with noise."""
    if edit == "crop":
        down, right = rng.integers(0, 13, size=2)
        return 0.8 * whole[down : down + whole.shape[0] - 12, right : right + whole.shape[1] - 12] + 25
    if edit == "resize":
        return resized(whole[None].astype(np.float32), round(0.9 * whole.shape[0]), round(0.9 * whole.shape[1]))[0]
    if edit == "turn":
        return np.rot90(whole, int(rng.integers(1, 4)))
    return whole + rng.normal(0, 4, whole.shape)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"image_id": [], "vec_id": [], "edit": [], "image": []}
        for key, vector in zip(batch["vec_id"].to_pylist(), batch["embedding"].to_pylist(), strict=True):
            values = np.array([0.0 if v is None else v for v in vector or []], dtype=np.float32)
            rng = np.random.default_rng(np.frombuffer(values.tobytes() + b"\0" * 8, dtype=np.uint32))
            coarse = rng.random((SIDE // 8 + 2, SIDE // 8 + 2)).repeat(8, axis=0).repeat(8, axis=1)[: SIDE + 4, : SIDE + 4]
            fine = rng.random((SIDE // 2 + 2, SIDE // 2 + 2)).repeat(2, axis=0).repeat(2, axis=1)[: SIDE + 4, : SIDE + 4]
            whole = _smooth(_smooth((120 * coarse + 130 * fine)[None]))[0]
            edit = EDITS[int(rng.integers(0, len(EDITS)))]
            for name, pixels in (("none", whole), (edit, edited(whole, edit, rng))):
                out["image_id"].append(2 * (key or 0) + (name != "none"))
                out["vec_id"].append(key)
                out["edit"].append(name)
                out["image"].append(pgm(np.rint(np.clip(pixels, 0, 255))))
        yield pa.RecordBatch.from_arrays([pa.array(out["image_id"], pa.int64()), pa.array(out["vec_id"], pa.int64()), pa.array(out["edit"], pa.string()), pa.array(out["image"], pa.binary())], list(out))


def rendered(vectors: DataFrame) -> DataFrame:
    """A media table from vectors: for each, a picture that it seeds, and a copy with one of the ``EDITS``."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_render, "image_id long, vec_id long, edit string, image binary")
