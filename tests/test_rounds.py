"""Choices among many options: heats and finals asked anew, and ranking by rounds of choices."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import decide
from quire.plans.more_queries import Digest


def said(salt, call, option, off=0):
    return max(int(hashlib.md5(f"{salt}:{call}:{option}".encode()).hexdigest()[:6], 16) % 101 - off, 0) / 100


def asked(spark, sizes):
    rows = [(f"a{i}", f"o{k}", k, "?", "") for i, n in enumerate(sizes) for k in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "ask_id string, option string, pos int, instruction string, state string")


def fought(ask, options, heat, nth=1):
    if len(options) <= heat + 1:
        return {o: (said("t", f"{ask}#{nth}", o), nth) for o in options}
    out, winners = {}, []
    for h in range(0, len(options), heat):
        own = [*options[h : h + heat], decide.NONE]
        best = max(own, key=lambda o: said("t", f"{ask}#{nth}#{h // heat}", o))
        out |= {o: (0.0, nth) for o in own if o not in (best, decide.NONE)}
        winners += [best] if best != decide.NONE else []
    return out | (fought(ask, winners, heat, nth + 1) if winners else {})


def test_tournament(spark):
    sizes = [1, 4, 5, 9, 40, 130]
    got = {(r.ask_id, r.option): (r.p, r.rounds) for r in decide.tournament(asked(spark, sizes), Digest("t"), heat=4).collect()}
    want = {(f"a{i}", o): v for i, n in enumerate(sizes) for o, v in fought(f"a{i}", [f"o{k}" for k in range(n)], 4).items()}
    assert got == want and max(r for _, r in want.values()) > 2
    plain = {i: max(range(n), key=lambda k, i=i: said("t", f"a{i}#1#{k // 4}", f"o{k}")) for i, n in enumerate(sizes) if n > 5}
    best = {i: max((o for a, o in want if a == f"a{i}"), key=lambda o, i=i: want[f"a{i}", o][0]) for i in plain}
    assert any(best[i] != f"o{k}" for i, k in plain.items())  # the finals are no repetition of the heats


def rounds(ask, options, want, most, off):
    left, picked = list(options), []
    for nth in range(1, 5):
        if not left or len(picked) >= want:
            break
        chunks = [left[k : k + most] for k in range(0, len(left), most)]
        heats = []
        for c, own in enumerate(chunks):
            p = {o: said("r", f"{ask}#{nth}#{c}", o, off) for o in own}
            heats += [(o, p[o]) for o in sorted((o for o in own if p[o] > 0), key=lambda o, p=p: -p[o])]
        if len(chunks) > 1 and len(heats) > 1:
            p = {o: said("r", f"{ask}#{-nth}", o, off) for o, _ in heats[:most]}
            final = sorted((o for o, _ in heats[:most] if p[o] > 0), key=lambda o: -p[o])
            heats = [(o, p[o]) for o in final] + [(o, 0.0) for o, _ in heats if o not in final]
        if not heats:
            break
        picked += [(o, p, nth) for o, p in heats]
        left = [o for o in left if o not in {o for o, _ in heats}]
    n = len(picked)
    return [(o, i + 1, r, 3 - 2 * i / max(1, n), p) for i, (o, p, r) in enumerate(picked)] + [(o, n + i + 1, None, 0.0, 0.0) for i, o in enumerate(left)]


@pytest.mark.parametrize(("want", "most", "off"), [(12, 254, 80), (6, 7, 90), (3, 5, 60), (12, 10, 101)])
def test_ranked_by_choice(spark, want, most, off):
    sizes = [1, 8, 30]
    got = {}
    for r in decide.ranked_by_choice(asked(spark, sizes), Digest("r", off), want=want, most=most).orderBy("ask_id", "rank").collect():
        got.setdefault(r.ask_id, []).append((r.option, r["rank"], r.round, r.score, r.p))
    for i, n in enumerate(sizes):
        assert got[f"a{i}"] == rounds(f"a{i}", [f"o{k}" for k in range(n)], want, most, off)


def test_only_wanted_options_count(spark):
    asks = asked(spark, [9]).withColumn("wanted", F.col("pos") < 3)
    every = decide.ranked_by_choice(asks, Digest("r", 80), want=2)
    assert every.where("round > 1").count() >= decide.ranked_by_choice(asks.drop("wanted"), Digest("r", 80), want=2).where("round > 1").count()
