"""Case a character for a character, as SQL has it, and what it means for kept rankings."""

import duckdb
from pyspark.sql import functions as F

from quire.functions import text
from quire.plans import store_queries

WORDS = ["größe", "SCHENSCHSS", "straße.", "maßẞ", "ΑΣ", "σοφός", "İzmir", "ﬁn", "ᾳ", "ŉ", "ǆ", "a\x0bb", ""]


def test_one_character_for_one(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", text.upper(F.col("w")).alias("u"), text.lower(F.col("w")).alias("l"))
    for r in rows.collect():
        assert (r.u, r.l) == duckdb.execute("SELECT upper($w), lower($w)", {"w": r.w}).fetchone()


def test_kept_rankings_of_words_with_a_sharp_s(spark, tmp_path):
    turns = [(i, j, "user", f" {w} rest") for i in range(40) for j, w in enumerate(WORDS)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = store_queries.cache_stored(spark, str(tmp_path)).select("book", "question", "at", "rich").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(f"SELECT book, question, \"at\", rich FROM ({store_queries.ORACLE['cache_stored']})").fetchall()
    assert any("ẞ" in w[1] for w in want)
    assert sorted(map(tuple, got)) == sorted(want)
