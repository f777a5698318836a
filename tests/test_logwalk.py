"""Walks read off logs, against a machine that goes line by line."""

import re

import pytest

from quire.operators import logwalk as w
from quire.plans import log_queries

DATA = "/root/testdata/sf0.001"


def machine(lines):
    """Files (with reads) and the ranking of one run's (depth, text, header) lines."""
    found, file, cur, scan, at, opened, paths = [], None, None, None, None, {}, None
    times = 0

    def here():
        nonlocal file
        if file is None:
            file = {"reads": []}
            found.append(file)
        return file

    def add(**read):
        nonlocal cur
        cur = read
        here()["reads"].append(read)
        return read

    for depth, text, header in lines:
        if scan is not None and depth <= scan:
            scan = None
        opened = {d: t for d, t in opened.items() if d < depth}
        if m := re.match(w.PATHS, text):
            above = re.search(w.ABOVE, text)
            at, paths, times, file, cur = depth, (int(m[1]), int(above[1]) if above else None, above[2] if above else None), times + 1, None, None
        elif re.match(r"^ranked (\d+) names", text):
            pass
        elif header and depth == at and (m := re.match(w.FILE, text)):
            file, cur = {"path": m[2], "score": float(m[1]), "under": opened.get(depth - 1), "reads": []}, None
            found.append(file)
        elif not header and depth == (depth if at is None else at) and (m := re.match(w.LEFT, text)):
            found.append({"path": m[2], "score": None if m[1] == "--" else float(m[1]), "under": opened.get(depth - 1), "left": m[3], "reads": []})
            file = cur = None
        elif m := re.match(w.SECTIONS, text):
            here()["ranked"] = f"{m[1]} section{'s' * (m[1] != '1')}" + (f" and {m[2]} excerpt{'s' * (m[2] != '1')}" if m[2] != "0" else "")
        elif re.match(w.CACHED, text):
            here()["ranked"] = "from the cache"
        elif m := re.match(w.SECTION, text):
            add(kind="section", name=f"{m[1]} p.{m[2]}" + (f"-{m[3]}" if m[2] != m[3] else ""))
        elif m := re.match(w.EXCERPT, text):
            add(kind="excerpt", name=re.sub(r"^(p\.\d+) \1$", r"\1", m[3]), p=float(m[2]), gate=m[1])
        elif re.match(w.SCAN, text):
            scan = depth
        elif m := re.match(w.GATE, text):
            if scan is not None or cur is None or cur["kind"] != "section":
                add(kind="window", name=m[3], p=float(m[2]), gate=m[1])
            else:
                cur |= {"p": max(cur.get("p", 0), float(m[2])), "gate": "yes" if cur.get("gate") == "yes" else m[1]}
        elif m := re.match(w.VERDICT, text):
            named = re.sub(r" \(excerpt\)$", "", m[4])
            r = next((x for x in reversed(here()["reads"]) if x["name"] == named), None) or cur or add(kind="window", name=m[4])
            if "verdict" not in r or w.STRENGTH[r["verdict"]] <= w.STRENGTH[m[1]]:
                pages = re.findall(r"p\.(\d+)", m[4])
                r |= {"verdict": m[1], "answer": m[2], "sure": float(m[3])} | ({"page": int(pages[-1])} if pages else {})
        elif m := re.match(w.CONTENTS, text):
            add(kind="contents", name=m[3], p=float(m[2]), verdict="take", answer=m[1], sure=float(m[2]))
        if header:
            opened[depth] = text[:-1]
    return found, (paths or (None, None, None)) + (times,)


def held(log):
    """The operators' rows of each run in the machine's form."""
    runs = {}
    for r in log.orderBy("run", "idx").collect():
        runs.setdefault(r.run, []).append((r.depth, r.text, r.header))
    want = {run: machine(lines) for run, lines in runs.items()}
    of = {}
    for f in sorted(w.files(log).collect(), key=lambda f: (f.run, f["at"])):
        of.setdefault(f.run, []).append((f.path, f.score, f.ranked, f.under, f.left, f.file))
    own = {}
    for r in sorted(w.reads(log).collect(), key=lambda r: (r.run, r.read)):
        own.setdefault((r.run, r.file), []).append(tuple(r)[3:])
    for run, (files, _) in want.items():
        keys = ("path", "score", "ranked", "under", "left")
        assert [f[:5] for f in of.get(run, [])] == [tuple(f.get(k) for k in keys) for f in files], run
        fields = ("kind", "name", "p", "gate", "verdict", "answer", "sure", "page")
        for f, got in zip(files, of.get(run, []), strict=True):
            if got[4] is None:
                assert own.get((run, got[5]), []) == [tuple(r.get(k) for k in fields) for r in f["reads"]], (run, f)
    for r in w.walks(log).collect():
        files, (ranked, above, floor, times) = want[r.run]
        every = [x for f in files for x in f["reads"]]
        assert (r.ranked, r.above, r.floor, r.times) == (ranked, above, floor, times)
        assert (r.opened, r.left_out) == (sum("left" not in f for f in files), sum("left" in f for f in files))
        assert [r[f"{k}_reads"] for k in ("contents", "section", "excerpt", "window")] == [sum(x["kind"] == k for x in every) for k in ("contents", "section", "excerpt", "window")]
        assert r.took == sum(x.get("verdict") == "take" for x in every)
    return want


def rows(spark, text):
    out = []
    for run, log in enumerate(text):
        for i, line in enumerate(log.split("\n")):
            bare = line.lstrip(" ")
            out.append((run, i, (len(line) - len(bare)) // 2, bare, bare.endswith("…")))
    return spark.createDataFrame(out, "run int, idx int, depth int, text string, header boolean")


SHELF = """--  /s/empty.pdf  --  empty file, left out of the ranking
ranked 12 paths and 3 excerpts in 0.5s (model 0.4s), 1 above file floor 1.5 (11 below)
2.90  /s/torn.pdf  --  cannot be opened, skipped
2.70  /s/Field.pdf  (by p.7)…
  ranked 1 sections and 20 excerpts in 0.5s
  section Part I > Start  p.13-14…
    gated 2 pages (batch 1/1), 0.2s model, 2 yes  Part I > Start
    no   0.78  Part I > Start p.13 (window 1/2)
    yes  0.76  Part I > Start p.14 (window 2/2)
    keep  None (p=0.66)  Part I > Start p.14 (window 2/2)
    take  Lift the lid… (p=0.76)  Part I > Start p.13 (window 1/2)
    drop  no (p=0.99)  Part I > Start p.14 (window 2/2)
  section 1.8s (model 0.7s)  Part I > Start
  excerpt  no   0.10  Lists p.20 (excerpt)
  excerpt  yes  0.99  Lists p.24 (excerpt)…
    take  410 (p=1.00)  Lists p.20 (excerpt)
file 2.3s (model 1.0s)  2 windows read"""
CELLS = """Oak: how many…
  ranked 9 paths and 0 excerpts in 0.2s
  2.94  /s/oak.pdf…
    no outline: scanning 2 of 2 windows in page order…
      no   0.45  p.1 (window 1/2)
      yes  0.95  p.2 (window 2/2)
    no outline 0.2s (model 0.2s)
    section S  p.1-1…
      yes  0.81  S p.1
  file 2.5s
Oak: how many: N/A (1 file opened)
Elm: how many…
  ranked 9 paths and 0 excerpts in 0.4s, 3 above file floor 1.5
  2.61  /s/elm.pdf…
    ranked from cache in 0.1s
    toc   9 (p=0.98)  Guilds  in 0.4s
total 5.1s"""
ALONE = "take  7 (p=1.00)  Tools p.1 (excerpt)\nkeep  8 (p=0.50)  Tools p.2\nyes  0.5  odd\nexcerpt  yes  0.98  p.1 p.1 (excerpt)…"


def test_logs(spark):
    want = held(rows(spark, [SHELF, CELLS, ALONE, "nothing here"]))
    assert [f.get("path") for f in want[0][0]] == ["/s/empty.pdf", "/s/torn.pdf", "/s/Field.pdf"]
    first = want[0][0][2]["reads"][0]
    assert (first["p"], first["gate"], first["verdict"], first["page"]) == (0.78, "yes", "take", 13)
    assert [f["under"] for f in want[1][0]] == ["Oak: how many", "Elm: how many"] and [r["kind"] for r in want[1][0][0]["reads"]] == ["window", "window", "section"]


def test_logs_of_conversations(spark):
    assert len(held(log_queries._log(spark, DATA))) > 1


def test_no_lines(spark):
    none = rows(spark, ["x"]).limit(0)
    assert w.walks(none).count() == w.files(none).count() == w.reads(none).count() == 0


@pytest.mark.parametrize("query", [log_queries.log_walks, log_queries.log_files, log_queries.log_reads])
def test_registered(spark, query):
    assert query(spark, DATA).count() > 0
