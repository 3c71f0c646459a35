"""Line-first quality rules on small texts; the whole query is compared with SQL elsewhere."""

import duckdb
from pyspark.sql import functions as F

from tidewater.llm import line_quality as q
from tidewater.llm.q06_line_quality import ORACLE_SQL, op6_line_quality

PROSE = "It was a plain day and the small river ran past the old mill as it had always done."


def line(i):
    """A line that shares no word with the others."""
    return " ".join(f"{w}{i}" for w in PROSE.split())


TEXTS = [
    None,
    "",
    " \n\t ",
    PROSE,
    "\n".join([PROSE] * 2 + [line(i) for i in range(4)]),
    "\n".join(f"Line {i}: {line(i)}" for i in range(6)) + "\nHome | News | Contact | About\nAll rights reserved.",
    "\n".join(f"{w}### {w}***  {w}&&&" for w in PROSE.split() * 4),
    " | ".join(PROSE.split() * 4),
    " ".join(f"{w.upper()}!!" for w in PROSE.split() * 4),
    "spam " * 400,
    "a b c\x00 a b c\x00 d e " + " ".join(line(i) for i in range(3)),
    ("word%d " * 300) % tuple(range(300)) * 40,
]


def test_equal_to_sql(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_line_quality(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_verdicts_and_clean_text(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("quality", F.lit("clash")).withColumn("_words", F.lit(1))
    rows = {r.doc_id: r for r in q.judge(docs, "verdict").collect()}
    kept = {i for i, r in rows.items() if r.verdict.kept}
    assert kept == {4, 5, 10} and rows[0].quality == "clash"
    assert rows[5].verdict.clean_text.count("\n") == 5 and "Home" not in rows[5].verdict.clean_text
    assert rows[0].verdict.n_words == 0 and rows[0].verdict.base_failed
    assert q.judge(docs.limit(0), "verdict").count() == 0
