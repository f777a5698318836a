"""Text functions, packing and runs against small Python models."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import numbers
from quire.functions import text as t
from quire.operators import answers, decide, runlog, tables, walk, windows
from quire.streaming import runs

WORDS = st.text(alphabet="abs theieschx ABC,.;'-0 12\n", max_size=40)
some = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def normalize(s):
    return re.sub("[^a-z0-9]+", " ", re.sub(r"^the\s+", "", s.lower())).strip(" ")


def singular(w):
    if w.endswith("ies"):
        return w[:-3] + "y"
    if re.search("(ch|sh|ss|x)es$", w):
        return w[:-2]
    return w[:-1] if w.endswith("s") else w


@some
@given(st.lists(WORDS, min_size=1, max_size=30))
def test_stems(spark, texts):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = {r.i: r.w for r in df.select("i", t.stems(F.col("s")).alias("w")).collect()}
    assert got == {i: [singular(w) for w in normalize(s).split(" ") if w] for i, s in enumerate(texts)}


@some
@given(st.lists(st.lists(st.integers(0, 100), max_size=12), min_size=1, max_size=20))
def test_best_run(spark, groups):
    rows = [(g, i, x) for g, xs in enumerate(groups) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g int, i int, x long")
    got = {r.g: (r.start, r.end) for r in windows.best_run(df, "g", "i", "x").collect()}
    want = {}
    for g, xs in enumerate(groups):
        best, start, total = None, 0, 0
        for i, x in enumerate(xs):
            if total <= 0:
                start, total = i, 0
            total += x - 65
            if total > 0 and (best is None or total > best[2]):
                best = (start, i + 1, total)
        if best:
            want[g] = best[:2]
    assert got == want


@some
@given(st.lists(st.integers(0, 30), min_size=1, max_size=15), st.integers(1, 40))
def test_batches(spark, sizes, most):
    got = spark.createDataFrame([(sizes,)], "s array<int>").select(windows.batches(F.col("s"), most).alias("b")).head().b
    want, size = [], None
    for n in sizes:
        if size is None or size + n > most:
            want.append((want[-1] if want else 0) + 1)
            size = n
        else:
            want.append(want[-1])
            size += n
    assert got == want


def test_chunks_nearly_equal(spark):
    df = spark.createDataFrame([("x" * 13000,), ("",), ("a  b",)], "s string")
    got = [r.c for r in df.select(t.chunks(F.col("s"), 6000).alias("c")).collect()]
    assert [len(x) for x in got[0]] == [4334, 4334, 4332] and got[1] == [] and got[2] == ["a b"]


def test_cells(spark):
    df = spark.createDataFrame([("The Rifle and Big Gun, small thing; An Axe",)], "s string")
    assert df.select(t.cells(F.col("s")).alias("c")).head().c == ["Rifle", "Big Gun", "Axe"]


def test_deciders(spark):
    asks = spark.createDataFrame([(1, "yes", 0, "red bolt", "a red bolt"), (1, "no", 1, "red bolt", ""), (2, "yes", 0, "gear", "none")], "ask_id int, option string, pos int, instruction string, state string")
    lexical = {(r.ask_id, r.option): r.p for r in decide.Lexical().answers(asks).collect()}
    assert lexical == {(1, "yes"): 1.0, (1, "no"): 0.0, (2, "yes"): 0.0}
    given = spark.createDataFrame([(1, "no", 0.9), (1, "yes", 0.9)], "ask_id int, option string, p double")
    answered = decide.Recorded(given).answers(asks)
    assert {r.ask_id: (r.option, r.p) for r in decide.choice(answered).collect()} == {1: ("yes", 0.9), 2: ("yes", 0.0)}
    remote = decide.Remote(lambda frame: frame["option"].map({"yes": 0.7, "no": 0.1}), most=1).answers(asks)
    assert {r.ask_id: r.p for r in decide.noul(remote).collect()} == {1: 0.7, 2: 0.7}


def test_walk_equals_loop(spark):
    import random

    rng, rows, want = random.Random(3), [], {}
    for q in range(60):
        own = []
        for s in range(4):
            score = rng.choice([0.5, 1.0, 1.5])
            own += [(q, s, score, 10 * s + k, rng.randint(0, 9), 50, rng.choice(["take", "keep", "drop", "drop"])) for k in range(4)]
        own.sort(key=lambda r: (-r[2], r[1], -r[4], r[3]))
        rows += own
        takes = keeps = 0
        before, read = {}, []
        for r in own:
            before.setdefault(r[1], takes)
            if takes >= 2 or keeps >= 3:
                break
            if r[2] < 1.0 and before[r[1]]:
                continue
            read.append(r[3])
            takes, keeps = takes + (r[6] == "take"), keeps + (r[6] == "keep")
        want[q] = read
    df = spark.createDataFrame(rows, "qid int, section int, section_score double, page int, gate int, p int, verdict string")
    got = {}
    for r in walk.walk(df, hits=2, most_kept=3, floor=1.0).orderBy("qid", "step").collect():
        got.setdefault(r.qid, []).append(r.page)
    assert got == {q: x for q, x in want.items() if x}


def test_claim_and_counts(spark):
    df = spark.createDataFrame([(60, 10, 0, False), (10, 60, 0, False), (10, 0, 80, False), (10, 0, 80, True)], "s int, c int, k int, n boolean")
    got = [(r.t, r.p) for r in df.select(*[x.alias(a) for x, a in zip(answers.claim_verdict(F.col("s"), F.col("c"), F.col("k"), F.col("n")), "tp", strict=True)]).collect()]
    assert got == [("true", 60), ("false", 60), ("false", 80), ("not stated", 90)]
    cells = spark.createDataFrame([("w", "b", "The Axe", 1, 80), ("w", "b", "axe.", 2, 60), ("w", "i", "Head", 3, 90), ("w", "b", "Bow", 4, 40)], "window string, style string, cell string, pos int, p int")
    row = answers.counts(cells, "window").head()
    assert row.names == ["axe"] and abs(row.p - 0.5) < 1e-9


def test_tables(spark):
    rows = [(1, 1, "row", "", "h", ["", "G"]), (1, 2, "row", "", "h", ["a", "b"]), (1, 3, "text", "…", "", []), (1, 4, "row", "", "h", ["c", "d"]), (1, 5, "text", "x", "", []), (1, 6, "row", "", "h", ["e", "f"])]
    df = spark.createDataFrame(rows, "doc int, pos int, kind string, text string, heads string, cells array<string>")
    got = [(r.pos, r.table_id, r.grp) for r in tables.tables_from(df, "doc", "pos").orderBy("pos").collect()]
    assert got == [(2, 1, "G"), (4, 1, "G"), (6, 2, None)]


def cells_of(spark, *texts):
    return [r.c for r in spark.createDataFrame([(x,) for x in texts], "s string").select(t.cells(F.col("s")).alias("c")).collect()]


def test_cells_of_texts(spark):
    got = cells_of(
        spark,
        "Every crew has five posts: Pilot, Gunner, Medic, Cook and Scout. Each post is filled",
        "   The Anvil, a smith of note.\n   The Kestrel, who sees far.",
        "Harpooner      Lookout\nLong Rifle    7C    Kinetic",
        "The orders are the Lantern, the Salt Wife, the Old Hound and AN Otter.",
        "Hull\n12\nhull\nThe Ballast sits in every common hold\n" + "B" * 61,
        "Rifle (Basic) including Scope or HULL, Hull",
    )
    assert set(got[0]) >= {"Pilot", "Gunner", "Medic", "Cook", "Scout"}
    assert got[1:] == [["Anvil", "Kestrel"], ["Harpooner", "Lookout", "Long Rifle", "Kinetic"], ["Lantern", "Salt Wife", "Old Hound", "Otter"], ["Hull"], ["Rifle", "Basic", "Scope", "HULL"]]


def test_name_keys(spark):
    names = [("The Long Rifle gun", "guns"), ("REPAIR", "skills"), ("Repair skill.", "skills"), ("Order Box", "order boxes"), ("Scout Class", "classes"), ("Wild Ability", "abilities"), ("An Axe", "")]
    got = [spark.createDataFrame([(n,)], "n string").select(answers.name_key(F.col("n"), k).alias("k")).head().k for n, k in names]
    assert got == ["long rifle", "repair", "repair", "order", "scout", "wild", "axe"]


def test_units(spark):
    texts = ["Cost e.g. ten. Then more! Why? no. 2. PICK one. A", "2. 3. Go on. x"]
    got = [r.s for r in spark.createDataFrame([(x,) for x in texts], "s string").select(t.sentences(F.col("s")).alias("s")).collect()]
    assert got == [["Cost e.g. ten.", "Then more!", "Why? no.", "2. PICK one."], ["2. 3.", "Go on. x"]]


def test_rows_and_heads(spark):
    df = spark.createDataFrame([(["Cost", "Cost", "", "Cost x"], ["1", "", "a\tb", "\"q\""]), (["A", "B", "C", "D"], ["", "", "", ""]), (["A", "B", "C", "D"], ["", "z", "", ""])], "h array<string>, c array<string>")
    got = df.select(tables.heads_named(F.col("h")).alias("h"), tables.row_text(tables.heads_named(F.col("h")), F.col("c")).alias("r")).collect()
    assert got[0].h == ["Cost", "Cost 2", "column 3", "Cost x"] and got[0].r == '{"Cost":"1","column 3":"a\\tb","Cost x":"\\"q\\""}'
    assert [r.r for r in got[1:]] == ["", "z"]
    marks = spark.createDataFrame([(x,) for x in ("None.", "N.A.", "n/a", "-", "", "nap")], "s string").select(tables.placeholder(F.col("s")).alias("p")).collect()
    assert [r.p for r in marks] == [True, True, True, True, True, False]


def test_palette_and_history(spark):
    rows = spark.createDataFrame([(1, "Open file", "x"), (2, "File open", "y"), (3, "Close", "open file"), (4, "Quit", "z")], "ord int, label string, more string")
    assert [r.ord for r in runlog.palette(rows, "label", "more", ["open", "file"]).collect()] == [1, 2, 3]
    assert [r.ord for r in runlog.palette(rows, "label", "more", [], 2).collect()] == [1, 2]
    asked = spark.createDataFrame([("How many?", 1, 1), (" how many? ", 2, 2), ("How many more", 3, 3)], "q string, at int, id int")
    assert [r.q for r in runlog.recent(asked, "How many?").collect()] == [] and [r.q for r in runlog.recent(asked, "how many").collect()] == ["How many more", "how many?"]


def test_limits_and_numbers(spark):
    got = spark.range(1).select(t.figure_limit(F.lit(0), F.lit(1), F.lit(60)).alias("a"), t.figure_limit(F.lit(99_999), F.lit(3), F.lit(60)).alias("b"), numbers.spelled(F.lit(12_000_345)).alias("n")).head()
    assert (got.a, got.b, got.n) == (254, 1, "twelve million three hundred and forty-five") and spark.range(1).select(numbers.words_to_number(F.lit(got.n)).alias("v")).head().v == 12_000_345


def test_streamed_charges(spark, tmp_path):
    """However often a run reports, what its updates add up to is its largest report."""
    schema = "run string, event_id long, event_type string, dollars long, sent boolean"
    batches = [[("a", 1, "log", 5, True), ("b", 2, "beat", 9, True)], [("a", 3, "error", 4, True), ("a", 4, "end", 9, False), ("b", 5, "log", 7, True)], [("a", 6, "end", 8, True)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"in/{i}"))
    events = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    updates = runs.charges(runs.run_to_end(spark, runs.fold(events)))
    got = {r.run: (r.more, r.lines, r.errors) for r in updates.groupBy("run").agg(F.sum("more").alias("more"), F.max("lines").alias("lines"), F.max("errors").alias("errors")).collect()}
    assert got == {"a": (8, 4, 1), "b": (7, 1, 0)}
