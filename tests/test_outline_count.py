"""Counts from the contents: when bookmarks are the list, and when they send to pages."""

import pytest

from quire.operators import outline


def said(spark, paths, parent, counted="", grouped=10, p=90, floor=70):
    rows = spark.createDataFrame([("b", x) for x in paths], "book string, path string")
    picks = spark.createDataFrame([(1, "b", parent, p, grouped, counted)], "qid int, book string, parent string, p int, grouped int, counted string")
    got = outline.counted(rows, picks, floor).collect()
    return (got[0].text, got[0].p, got[0].parent) if got else None


ORDERS = ["Orders", *[f"Orders > {x}" for x in ("Oak", "Ash", "Elm", "Fir")]]
SWALLOWED = ["Spells", "Spells > Alarm", "Spells > Speed", "Spells > Armour", *[f"Spells > Alarm > Spell {i}" for i in range(9)]]
BESIDE = ["People", "People > Guilds", "People > Ranks", *[f"People > Guilds > {i}" for i in range(4)], *[f"People > Ranks > {i}" for i in range(8)]]
PLAIN = ["People", "People > Ranks", "People > Birth", "People > Growth", *[f"People > Ranks > {i}" for i in range(8)]]


@pytest.mark.parametrize(("paths", "parent", "more", "want"), [
    (ORDERS, "Orders", {}, ("4", 90, "Orders")),
    (ORDERS, "Orders", {"p": 60}, None),
    (ORDERS, "Orders", {"grouped": 50, "counted": "trees"}, (None, None, "Orders")),
    (ORDERS[:2], "Orders", {}, None),
    (ORDERS, "none of these", {}, None),
    (SWALLOWED, "Spells", {}, (None, None, "Spells")),
    (SWALLOWED, "Spells > Alarm", {"counted": "spells"}, (None, None, "Spells")),
    (SWALLOWED, "Spells > Alarm", {"counted": "great spells"}, (None, None, "Spells")),
    (SWALLOWED, "Spells > Alarm", {}, (None, None, "Spells")),
    (SWALLOWED, "Spells > Alarm", {"counted": "curses"}, ("9", 90, "Spells > Alarm")),
    (BESIDE, "People > Ranks", {}, ("8", 90, "People > Ranks")),
    (PLAIN, "People > Ranks", {"counted": "ranks"}, ("8", 90, "People > Ranks")),
    (PLAIN, "People > Ranks", {"counted": "people"}, (None, None, "People")),
    (["a", "a > b", "a > b"], "a", {}, ("2", 90, "a")),
])
def test_counted(spark, paths, parent, more, want):
    assert said(spark, paths, parent, **more) == want
