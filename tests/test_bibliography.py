"""Bibliography scores beside letters, marks and white space that aren't ASCII, against the query's SQL."""

import duckdb

import __spark_entry__

TEXTS = [
    "\u00e9no", "no\u00e9", "\u00e9doi x", "doi\u00e9", "\u00e910.1234/a", "1999\u00e9 2000\u00e9", "works\x0bcited", "works\fcited", "works cited", "B\u0130BL\u0130OGRAPHY",
    "pp\x0b12", "pp.\n12", "\u1e55no", "no\u0301", "vo\u013a x", "\U0001d7d8no", "\u0661no", "2000\u0661 1999\u0661", "\u00e9references", "references\u00e9", "\u4e2dno\u4e2d", "no.x", "no._", "xno", "no_", "ed.", "",
    "a,b,c,d,e", "19990 2000", "1999 2000", None,
]


def test_word_bounds_are_those_of_the_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(__spark_entry__.oracle_sql()["bibliography_score"]).fetchall()}
    got = {r.doc_id: (r.score, r.bib_like) for r in __spark_entry__.queries()["bibliography_score"](spark, str(tmp_path)).collect()}
    assert {TEXTS[i]: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
