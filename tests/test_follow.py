"""Runs followed from pieces of NDJSON: cut lines, pieces out of order, one end, timers, and a batch that is killed."""

import datetime
import json

import pytest

from quire.streaming import follow

SCHEMA = "run string, seq long, ts timestamp, piece string"


def piece(run, seq, minute, text):
    return (run, seq, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute), text)


def log(**more):
    return json.dumps({"type": "log", "line": "read", **more}) + "\n"


END = json.dumps({"type": "end", "code": 0, "ms": 5}) + "\n"
STOP = json.dumps({"type": "end", "code": None, "ms": 5, "error": "stopped"}) + "\n"
A = log(spent=3) + '{"type": "trying", "line": "p.4"}\n' + log(spent=2, error=True) + log(spent=9) + END + log(spent=50)
BATCHES = [
    [piece("a", 1, 0, A[:20]), piece("a", 3, 2, A[75:160]), piece("b", 1, 1, log(spent=4)), piece("gone", 1, 0, log() + '{"type":'), piece("bad", 1, 3, log(spent=1) + "oops\n" + log())],
    [piece("a", 2, 5, A[20:75]), piece("b", 2, 6, '{"type": "beat"}\n{"type": "trying", "line": "p.9"}\n')],
    [piece("a", 4, 7, A[160:]), piece("b", 2, 8, "again\n"), piece("b", 3, 9, STOP), piece("c", 2, 9, END)],
    [piece("a", 5, 10, log(spent=99)), piece("c", 1, 11, log(spent=2)), piece("d", 1, 400, log(spent=6) + '{"type": "trying", "line": "p.2"}\n')],
]
WANT = {"a": (3, 1, None, "done", 9), "b": (1, 0, None, "stopped", 4), "bad": (1, 0, None, "lost", 1), "gone": (1, 0, None, "left", 0), "c": (1, 0, None, "done", 2), "d": (1, 0, "p.2", "running", 6)}


@pytest.fixture
def pieces(spark, tmp_path):
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def standing(updates):
    return {r.run: tuple(r)[1:] for r in follow.standing(updates).collect()}


def test_runs_as_they_stand(spark, pieces):
    updates = follow.followed(spark, pieces, quiet=7200)
    assert standing(updates) == WANT
    assert updates.where("run = 'a' and more > 0").count() == 2  # 3 of the first lines, then 6 more with the rest


def test_a_killed_batch_charges_nothing_twice(spark, pieces, tmp_path):
    folder, calls = str(tmp_path / "out"), []

    def killed(updates, batch, number):
        calls.append(number)
        follow._keep(updates, batch, number)
        if number == 2 and calls.count(2) == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        follow.followed(spark, pieces, 7200, folder, killed)
    assert standing(follow.followed(spark, pieces, 7200, folder, killed)) == WANT
    assert calls.count(2) == 2 and calls.count(1) == 1


def test_a_folder_of_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(0, len(A), 40):
        (tmp_path / f"in/x.y.{i // 40 + 1}.ndjson").write_text(A[i : i + 40])
    (tmp_path / "in/other.txt").write_text(END)
    assert standing(follow.followed(spark, follow.text_pieces(spark, str(tmp_path / "in"), 2), 7200)) == {"x.y": (3, 1, None, "done", 9)}


def test_lines_may_be_cut_anywhere():
    for cut in range(len(A)):
        state = {"next": 1, "rest": "", "lines": 0, "errors": 0, "trying": None, "charged": 0, "status": "running"}
        follow.fed(state, A[:cut])
        follow.fed(state, A[cut:])
        assert (state["lines"], state["errors"], state["charged"], state["status"], state["rest"]) == (3, 1, 9, "done", "")
