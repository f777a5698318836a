"""Image copies: cropped, resized, turned and noisy pictures found, others left alone, crowds whole, odd rows defined."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import media


def noise(rng, n):
    return media._smooth(media._smooth(255 * rng.random((1, n, n)).repeat(2, axis=1).repeat(2, axis=2)))[0]


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(1)
    a, b, c = noise(rng, 40), noise(rng, 40), noise(rng, 40)
    rows = [(1, media.pgm(a)), (2, media.pgm(a)), (3, media.pgm(a[8:66, 4:70] * 0.8 + 20)), (4, media.pgm(b)), (5, media.pgm(np.rot90(b))), (6, media.pgm(c)), (7, None), (8, b"not an image"), (9, media.pgm(np.zeros((9, 9)))), (None, media.pgm(b)), (10, media.pgm(np.full((300, 200), 7)))]
    return [(i, x, 1, "k", "d") for i, x in rows]


TABLE = "image_id long, image binary, picture int, `a-b` string, digest string"


def test_copies(spark, images):
    got = media.copies(spark.createDataFrame(images, TABLE)).collect()
    by = {r.image_id: r for r in got}
    assert len(got) == len(images)
    assert {by[i].class_id for i in (1, 2, 3)} == {1} and {by[i].class_id for i in (4, 5, None)} == {4}
    assert [by[i].class_id for i in (6, 7, 8, 9, 10)] == [6, 7, 8, 9, 10]
    assert by[1].n_copies == 3 and by[6].n_copies == 1


def test_empty(spark):
    assert media.copies(spark.createDataFrame([], TABLE)).count() == 0


def test_recall_of_each_edit(spark):
    """Of every kind of edit nine tenths and more are found, and no strangers are joined."""
    vectors = [(i, np.random.default_rng(i).random(64).tolist()) for i in range(200)]
    rows = media.rendered(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    edits = {r.vec_id: r.edit for r in rows.where("edit <> 'none'").select("vec_id", "edit").collect()}
    classes = {r.image_id: r.class_id for r in media.copies(rows).collect()}
    for edit in media.EDITS:
        own = [i for i, e in edits.items() if e == edit]
        assert len(own) > 20 and np.mean([classes[2 * i] == classes[2 * i + 1] for i in own]) >= 0.9
    assert all(c // 2 == i // 2 for i, c in classes.items())


def test_tables_against_all_pairs(spark):
    """Candidates come from the tables, the decision is that of all pairs: nearly every pair that all pairs link is linked."""
    rng = np.random.default_rng(4)
    whole = [0.5 * noise(rng, 34) + 0.5 * media.resized(noise(rng, 8)[None], 64, 64)[0] for _ in range(12)]
    shown = [x for w in whole for x in (w, media.resized(w[None], 58, 58)[0], w[4:60, 6:64])]
    found = [media.features(np.rint(np.clip(x, 0, 255))[None], media.tests())[0] for x in shown]
    want = {(i, j) for j in range(len(found)) for i in range(j) if media.consensus(found[i], found[j], 32, 4)}
    pictures = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(found)], "picture long, corners binary")
    got = {(r.a, r.b) for r in media.links(pictures).collect()}
    assert got <= want and len(want) >= 24 and len(got) >= 0.9 * len(want)


def test_crowds(spark):
    """Buckets over the crowd limit give the classes that all their pairs give."""
    rng = np.random.default_rng(2)
    a, b = noise(rng, 40), noise(rng, 40)
    shown = [x[: 76 - i % 9, : 75 - i % 7] * (1 - i / 200) for i in range(24) for x in (a, b)]
    found = [media.features(np.rint(np.clip(x, 0, 255))[None], media.tests())[0] for x in shown]
    pictures = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(found)], "picture long, corners binary")
    for crowd in (4, 256):
        roots = {r.node: r.root for r in media.components(media.links(pictures, crowd=crowd)).collect()}
        assert {roots[i] for i in range(0, 48, 2)} == {0} and {roots[i] for i in range(1, 48, 2)} == {1}


def test_meetings_equal_brute_force(spark):
    """The stream of sorted rows, in batches of any size, meets every pair of a small key that the check bits allow and chains a crowd;
    blocks meet every pair of it."""
    rng = np.random.default_rng(6)
    rows = sorted({(int(k), int(p) << 20 | int(c)) for k, p, c in zip(rng.choice([1, 2, 3, 9, 9, 9, 9], 120), rng.integers(0, 40, 120), rng.integers(0, 3, 120), strict=True)})
    check = {r: int(rng.integers(0, 64)) for r in rows}
    small = {(x[1] >> 20, x[1] & 0xFFFFF, y[1] >> 20) for x in rows for y in rows if x[0] == y[0] != 9 and x < y and x[1] >> 20 != y[1] >> 20 and (check[x] ^ check[y]).bit_count() <= media.CHECK}
    crowd = [w for k, w in rows if k == 9]
    chain = {(x >> 20, y >> 20) for x, y in zip(crowd, crowd[1:]) if x >> 20 != y >> 20}  # noqa: B905
    for size in (1, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + size]], pa.int64()), pa.array([w for _, w in rows[i : i + size]], pa.int64()), pa.array([check[r] for r in rows[i : i + size]], pa.int32())], ["key", "who", "check"]) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for x in media._meet(30)(iter(batches)) for r in x.to_pylist()]
        met = {(a, c, b) for a, b, c in got if b >= 0}
        assert small <= met and {(a, b) for a, _, b in met - small} <= chain <= {(a, b) for a, _, b in met}
        assert len(crowd) > 30 and sorted((-1 - b, c) for a, b, c in got if b < 0) == [(w >> 20, w & 0xFFFFF) for w in crowd]
    members = [(5, own, p, 0, p % 3) for p, own in enumerate(rng.integers(0, 3, 30).tolist())]
    dealt = sorted((k, min(own, o), max(own, o), p, own, c, r) for k, own, p, c, r in members for o in range(3))
    for size in (1, 11, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((k, lo, hi, own, p, c, r) for k, lo, hi, p, own, c, r in dealt[i : i + size]), strict=True)], ["key", "low", "high", "own", "picture", "corner", "root"]) for i in range(0, len(dealt), size)]
        got = [(r["a"], r["b"]) for x in media._meet_in_blocks(iter(batches)) for r in x.to_pylist()]
        assert sorted(got) == sorted((x, y) for x in range(30) for y in range(x + 1, 30) if x % 3 != y % 3)


def test_query_table(spark):
    vectors = spark.createDataFrame([(1, [0.1] * 64), (2, None), (3, [0.2] * 64)], "vec_id long, embedding array<float>")
    rows = media.rendered(vectors)
    assert rows.count() == 6 and rows.where(F.length("image") > 2000).count() == 6
