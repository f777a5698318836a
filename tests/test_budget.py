"""Walks over files under one budget, against a loop that opens one file after the other."""

import random

import pytest

from quire.operators import budget


def shelf(seed):
    """Questions with up to five files; a file's sections have sections below them, some counted whole."""
    rng, files, rows = random.Random(seed), [], []
    for q in range(12):
        scores = sorted((rng.choice([0.5, 1.0, 1.6, 2.0]) for _ in range(rng.randint(1, 5))), reverse=True)
        for rank, score in enumerate(scores, 1):
            files.append((q, f"f{rank}", rank, score))
            page = 0
            for chapter in "abc" if rng.random() < 0.9 else "":
                for path in [chapter, f"{chapter} > x", f"{chapter} > y", f"{chapter} > x > z"]:
                    whole, own = rng.random() < 0.3, rng.choice([0.8, 1.1, 1.4])
                    for _ in range(rng.randint(0, 2)):
                        page += 1
                        rows.append((q, f"f{rank}", path, own, page, rng.randint(0, 9), rng.randint(0, 99), rng.choice(["take", "keep", "keep", "drop"]), whole))
    return files, rows


def walked(files, rows, hits, most_kept, floor, hard, title_floor):
    out = []
    for q in sorted({f[0] for f in files}):
        taken, kept = 0, 0
        for _, name, rank, score in sorted(f for f in files if f[0] == q):
            if floor is not None and score < floor and (hard or taken > 0):
                break
            own = sorted((r for r in rows if r[:2] == (q, name)), key=lambda r: (-r[3], r[2], -r[5], r[4]))
            here, keeps, counted, seen, read, at_section = 0, [], [], set(), [], {}
            for r in own:
                path = r[2]
                at_section.setdefault(path, here)
                if any(path.startswith(f"{c} > ") for c in counted) or (title_floor is not None and r[3] < title_floor and at_section[path] > 0):
                    continue
                if r[8]:
                    if path in seen:
                        continue
                    seen.add(path)
                    counted.append(path)
                    for k in [k for k in keeps if k["path"].startswith(f"{path} > ")]:
                        k["outcome"] = "drop"
                        keeps.remove(k)
                step = {"path": path, "page": r[4], "outcome": r[7]}
                read.append(step)
                here += r[7] == "take"
                if r[7] == "keep":
                    keeps.append(step)
                if taken + here >= hits or kept + len(keeps) >= most_kept:
                    break
            out += [(q, rank, s["path"], s["page"], s["outcome"]) for s in read]
            taken, kept = taken + here, kept + len(keeps)
            if taken >= hits or kept >= most_kept:
                break
    return sorted(out)


@pytest.mark.parametrize(("hits", "most_kept", "floor", "hard", "title_floor"), [(1, 5, None, False, None), (3, 4, 1.5, False, None), (2, 6, 1.5, True, None), (4, 9, 1.2, False, None), (2, 3, 1.5, False, 1.0), (5, 30, None, False, 1.2)])
def test_shelf_walk_equals_a_loop(spark, hits, most_kept, floor, hard, title_floor):
    files, rows = shelf(hits * 10 + most_kept)
    f = spark.createDataFrame(files, "qid int, file string, rank int, score double")
    r = spark.createDataFrame(rows, "qid int, file string, section string, section_score double, page int, gate int, p int, verdict string, whole boolean")
    got = budget.shelf_walk(f, r, hits, most_kept, floor, hard, title_floor).collect()
    want = walked(files, rows, hits, most_kept, floor, hard, title_floor)
    assert sorted((x.qid, x["rank"], x.section, x.page, x.outcome) for x in got) == want
    assert any(x.fragment for x in got) == any(x.fragment and x.outcome == "drop" for x in got)


def test_fragments_are_met():
    files, rows = shelf(34)
    assert any(walked(files, rows, 3, 4, 1.5, False, None) != walked(files, [(*r[:8], False) for r in rows], 3, 4, 1.5, False, None) for _ in [0])


def test_no_rows(spark):
    f = spark.createDataFrame([(1, "a", 1, 2.0)], "qid int, file string, rank int, score double")
    r = spark.createDataFrame([], "qid int, file string, section string, section_score double, page int, gate int, p int, verdict string, whole boolean")
    assert budget.shelf_walk(f, r).count() == 0
    opened = budget.allotted(f, budget.summaries(budget.steps(r), 2, 3), 2, 3).collect()
    assert [(x.file, x.hits_left, x.keeps_left, x.stop) for x in opened] == [("a", 2, 3, 0)]
