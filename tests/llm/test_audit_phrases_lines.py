"""The filter audit, the collocations and the line dedup against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import inspect
import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import audit, lines, phrases, queries

DOC = "doc_id long, text string, lang string, source string, id string, h binary, docs int, largest int, part string, mask int, n int, words int, f long, g long, k1 long, k2 long, at int, batch int"
REST = ("x", b"y", 1, 2, "p", 3, 4, 5, 6, 7, 8, 9, 10, 11)
SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(12)]
    prose = lambda n, sep=" ": sep.join(rng.choice(vocabulary) for _ in range(n))
    line = "A line of the licence that stands in many of these documents"
    mixed = line.upper().replace("OF", "oF")
    texts = [None, "", " \n\t ", "one", "Ünïcode word\x85x\x00y", prose(4000), "SHOUTED Words # here", "x\n" * 30, prose(60, "  \t")]
    for i in range(50):
        texts.append("\n".join([prose(rng.randint(1, 90), rng.choice([" ", ". ", " , "])), "\t" + (line if i % 3 else mixed) + " ", prose(5), line] if i % 2 else [prose(70), "short", "é" * 40, ""]))
    texts += [texts[12], texts[12], texts[13]]
    out = [(i, s, ("en", "fr", None)[i % 3], ("a", "b", None, "c", "")[i % 5], *REST) for i, s in enumerate(texts)]
    out.append(out[20])  # a repeated row
    out.append((None, texts[13], "en", "a", *REST))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def fails(text, ident, firsts):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [
        len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        bool(re.search("[#$%&*|]", text)), ident is not None and text in firsts and firsts[text] < ident,
    ]


def test_audit(spark, docs, none, rows):
    marks = [(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(0, 55, 2)] + [(0, 0, 1), (None, 1, 1), (4, None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    good, toxic = ({i for i, *m in marks if m[k] == 1 and i is not None} for k in (0, 1))
    firsts = {}
    for i, text, *_ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    judged = [(r[3] or "", r[0], fails(r[1], r[0], firsts)) for r in rows]
    want = {}
    for part in {p for p, _, _ in judged}:
        own = [(i, f) for p, i, f in judged if p == part]
        shapley = Counter()
        for order in permutations(range(5)):
            left = own
            for k, j in enumerate(order):
                gone = [x for x in left if x[1][j]]
                left = [x for x in left if not x[1][j]]
                failing, only = sum(f[j] for _, f in own), sum(f[j] and sum(f) == 1 for _, f in own)
                want[part, "".join("ABCDE"[x] for x in order), k + 1] = [len(left), len(gone), failing - len(gone), only, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), "ABCDE"[j]]
                shapley[j] += len(gone)
        for key, value in want.items():
            if key[0] == part:
                value[-1] = shapley["ABCDE".index(value[-1])] if isinstance(value[-1], str) else value[-1]
    got = audit.audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == want
    assert len(got) == len(want) == 600 * 4
    assert audit.audit(none, labels).count() == 0
    assert sum(r.good_lost for r in audit.audit(docs, labels.limit(0)).collect()) == 0


@pytest.mark.parametrize("n", [2, 3, 5])
def test_shapley_weights_equal_the_orders(n):
    rng = random.Random(n)
    value = [0, *(rng.randint(0, 99) for _ in range(2**n - 1))]  # any game, not only coverage
    below, weights = audit.shapley_weights(n)
    for i in range(n):
        steps = [value[sum(1 << x for x in o[: o.index(i) + 1])] - value[sum(1 << x for x in o[: o.index(i)])] for o in permutations(range(n))]
        assert Fraction(sum(w * v for w, v in zip(weights[i], value, strict=True)), below[i]) == Fraction(sum(steps), len(steps))


def ngrams(rows, longest):
    counts = Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            counts.update((lang or "und", tuple(words[i : i + n])) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    return counts


def best(counts, longest, least, share, most):
    out = {}
    for lang in {x for x, _ in counts}:
        found = []
        for (of, words), a in counts.items():
            if of != lang or len(words) < 2 or a < least:
                continue
            holds = lambda w, p: any(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1))
            if any(100 * f >= share * a for (o, w), f in counts.items() if o == lang and len(w) > len(words) and f >= least and holds(w, words)):
                continue
            score, _, l, r = min((1_000_000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k, counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words)))
            found.append((-score, -a, " ".join(words).encode(), l, r))
        n = sum(f for (o, w), f in counts.items() if o == lang and len(w) == 1)
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:most], 1):
            out[lang, rank] = (phrase.decode(), -a, l, r, n, -score)
    return out


@pytest.mark.parametrize(("longest", "share", "partition_rows"), [(3, 50, 200_000), (3, 20, 5), (4, 50, 7)])
def test_collocations(docs, none, rows, longest, share, partition_rows):
    want = best(ngrams(rows, longest), longest, 3, share, 60)
    got = phrases.collocations(docs, longest=longest, least=3, share=share, most=60, partition_rows=partition_rows, group_bytes=3000, bucket_ngrams=500)
    assert {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()} == want
    assert len({lang for lang, _ in want}) == 3 and len(want) > 60
    assert phrases.collocations(none).count() == 0


def test_a_group_takes_little_memory():
    """Two tasks of an executor spell a group each beside the JVM: arrays of one take 180 MB at most."""
    rng = np.random.default_rng(9)
    size = inspect.signature(phrases.counts).parameters["group_bytes"].default
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400).clip(max=50_000)) for _ in range(size // 1600)]
    docs = pa.table({"g": pa.array([0] * len(texts), pa.int64()), "lang": ["en"] * len(texts), "text": texts})
    peaks = []
    tracemalloc.start()
    try:
        sent = phrases._send(3, 4)(docs)
        peaks.append(tracemalloc.get_traced_memory()[1])
        known = pa.table({"bucket": sent["bucket"], "hashes": sent["more"]})
        tracemalloc.reset_peak()
        spelled = phrases._spell(3, 4)(docs, known)
        peaks.append(tracemalloc.get_traced_memory()[1])
    finally:
        tracemalloc.stop()
    assert sum(len(t) + 1 for t in texts) > 0.8 * size and spelled.num_rows > 50_000
    assert max(peaks) < 180e6, peaks


def test_scores_pass_64_bits(spark):
    rows = [("und", 0, "", 10**13)] + [("und", 1, w, 4 * 10**12) for w in ("a", "b")] + [("und", 2, "a b", 3 * 10**12)]
    saved = phrases.counts
    phrases.counts = lambda *_, **__: spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    try:
        assert [tuple(r) for r in phrases.collocations(spark.range(0)).collect()] == [("und", 1, "a b", 3 * 10**12, 4 * 10**12, 4 * 10**12, 10**13, 562500)]
    finally:
        phrases.counts = saved


def test_sweeps_over_any_boundary():
    rng = np.random.default_rng(3)
    orders, f = rng.integers(1, 4, 400), rng.integers(1, 99, 400)
    orders[:3] = [1, 2, 3]
    whole = phrases.Sweep(orders, f, 3)
    for size in (1, 3, 50):
        parts = [phrases.Sweep(orders[a : a + size], f[a : a + size], 3) for a in range(0, 400, size)]
        sums = [p.summary() for p in parts]
        got_parts, got_longer = [], []
        for i, p in enumerate(parts):
            before = [next((s["last"][n] for s in reversed(sums[:i]) if s["last"][n] >= 0), 0) for n in (0, 1)]
            after = [0, 0]
            for n in (0, 1):
                for s in sums[i + 1 :]:
                    after[n] = max(after[n], s["head"][n])
                    if s["closed"][n]:
                        break
            got_parts.append(p.parts(before))
            got_longer.append(p.extensions(after))
        for n in (0, 1):
            assert np.array_equal(np.concatenate([g[n] for g in got_parts]), whole.parts([0, 0])[n])
        assert np.array_equal(np.concatenate(got_longer), whole.extensions([0, 0]))


def test_long_texts_are_cut_between_pieces():
    text = b"ab cd, ef\ngh " * 40 + b"x" * 100 + b". tail"
    parts = list(phrases.cuts(text, 50))
    assert b"".join(parts) == text and all(p[-1:] in phrases._ENDS for p in parts[:-1])
    assert max(map(len, parts)) < 130
    assert list(phrases.cuts(b"x" * 90, 50)) == [b"x" * 90, b""] and list(phrases.cuts(b"", 50)) == [b""]


def key(line):
    return line.strip(SPACES).translate(LOWER)


def without(rows, least_chars, least_docs):
    holders = Counter()
    largest = {}
    for i, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                holders[k] += 1
                if i is not None:
                    largest[k] = max(i, largest.get(k, i))
    out = []
    for i, text, *_ in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if not (holders[key(x)] >= least_docs and largest.get(key(x)) != i)]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least_docs", "batches", "fanout"), [(5, 4, 2), (2, 1, 2), (3, 5, 3)])
def test_lines(docs, none, rows, least_docs, batches, fanout):
    got = lines.drop_repeated(docs, least_docs=least_docs, batches=batches, fanout=fanout)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == without(rows, 40, least_docs)
    assert lines.drop_repeated(none).count() == 0
    assert not [t for t in docs.sparkSession.catalog.listTables() if t.name.startswith("quire_run_")]


def test_runs_take_batches_in_any_order(spark):
    rng = random.Random(5)
    seen, held, totals = lines.LineRuns(spark, buckets=3, fanout=2), set(), {}
    for b in range(7):
        batch = {bytes([rng.randint(0, 90)]): (rng.randint(1, 4), rng.randint(0, 99)) for _ in range(rng.randint(0, 40))}
        fresh = seen.add(spark.createDataFrame([(k, *v) for k, v in batch.items()], "h binary, docs long, largest long"))
        assert {bytes(r.h) for r in fresh.collect()} == set(batch) - held
        assert all(len(level) < 2 for level in seen.levels + seen.ledger)
        held |= set(batch)
        for k, (n, most) in batch.items():
            totals[k] = (totals.get(k, (0, 0))[0] + n, max(totals.get(k, (0, 0))[1], most))
    assert {bytes(r.h): (r.docs, r.largest) for r in seen.counts().collect()} == totals
    seen.forget()


def test_lines_of_a_long_text(spark):
    same = "this line of more than forty characters comes again"
    text = "\n".join([same if i % 2 else f"line {i}" for i in range(200_000)])
    got = {r[0]: r for r in lines.drop_repeated(spark.createDataFrame([(1, text), *((i, same) for i in range(2, 7))], "doc_id long, text string")).collect()}
    assert (got[1].n_lines, got[1].n_dropped) == (200_000, 100_000) and got[1].kept == "\n".join(f"line {i}" for i in range(0, 200_000, 2))
    assert got[6].kept == same and got[2].kept == ""


def test_the_registered_queries_have_sql_and_digests(spark, tmp_path, rows):
    kept = [r for r in dict.fromkeys(rows) if r[0] is not None]
    spark.createDataFrame(kept, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r for r in queries.op13_line_runs(spark, str(tmp_path)).collect()}
    for i, n, gone, text in without(kept, 40, 5):
        assert tuple(found[i]) == (i, n, gone, hashlib.sha256(text.encode()).hexdigest())
    assert queries.op12_phrase_streams(spark, str(tmp_path)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert queries.op11_filter_audit(spark, str(tmp_path)).count() == 600 * 4
    assert {"op11_filter_audit", "op12_phrase_streams", "op13_line_runs"} <= set(queries.ORACLE)
