"""Filter audit against its DuckDB statement and a plain run of every order."""

from itertools import permutations

import duckdb
import pytest

from tidewater.llm import filter_audit
from tidewater.llm.q11_filter_audit import ORACLE, op11_filter_audit

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_equal_to_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(ORACLE["op11_filter_audit"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, op11_filter_audit(spark, SMALL).select(names).collect())) == sorted(want.fetchall())


def plain_failures(docs):
    out = []
    for doc, text, _ in docs:
        text = text or ""
        words = [w for w in __import__("re").split("[ \t-\r]+", text) if w]
        out.append(
            {
                "A": len(words) < 100,
                "B": 100 * len(set(words)) < 80 * len(words),
                "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                "D": any(c in "#$%&*|" for c in text),
                "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs),
            }
        )
    return out


def plain(docs, labels):
    """Every order applied to every document, one after the other."""
    fails, out = plain_failures(docs), {}
    good, toxic = {d for d, q, _ in labels if d is not None and q == 1}, {d for d, _, t in labels if d is not None and t == 1}
    parts = {(part or "") for *_, part in docs}
    for part in parts:
        own = [(d, f) for (d, _, p), f in zip(docs, fails) if (p or "") == part]
        for order in permutations("ABCDE"):
            left = list(range(len(own)))
            for step, letter in enumerate(order, 1):
                gone = [i for i in left if own[i][1][letter]]
                before, left = left, [i for i in left if not own[i][1][letter]]
                failing = [i for i in range(len(own)) if own[i][1][letter]]
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    len(set(failing) - set(before)),
                    sum(sum(own[i][1].values()) == 1 for i in failing),
                    sum(own[i][0] in good for i in gone),
                    sum(own[i][0] in toxic for i in gone),
                ]
        for letter in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == letter)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == letter:
                    v.append(total)
    return out


@pytest.mark.parametrize("copies", [1, 40])
def test_odd_rows_equal_a_plain_run(spark, copies):
    long = " ".join(f"word{i}" for i in range(120))
    docs = [(1, long, "en"), (2, long, "de"), (2, long, "de"), (2, long, None), (3, "A B", ""), (4, None, None), (None, None, "en"), (None, long, "en"), (5, "", "de"), (6, "x # y", "en"), (7, "w " * 200, "de"), (8, long.upper(), "en"), (-1, "tie", "en"), (-1, "tie", "de")]
    docs += [(100 + i, "copy of one", "fr") for i in range(copies)] + [(9, "日本\x1c語 \x0b" * 30000, "ja")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, 1, 1), (None, 1, 1), (105, None, 1), (-1, 1, None), (999, 1, 1)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'own' AS mask", "1 AS part", "2 AS n").repartition(5)
    got = filter_audit.audit(filter_audit.cells(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    want = plain(docs, labels)
    assert {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in got} == want and len(got) == len(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.cells(docs.limit(0), labels)).count() == 0
    assert filter_audit.audit(filter_audit.cells(docs, labels)).count() == 600


def test_other_letters(spark):
    cells = spark.createDataFrame([("", 0b01, 5, 1, 0), ("", 0b11, 2, 0, 0), ("", 0, 9, 3, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(cells, "XY").collect()}
    assert got == {("XY", 1): (9, 7, 0, 5, 12), ("XY", 2): (9, 0, 2, 0, 2), ("YX", 1): (14, 2, 0, 0, 2), ("YX", 2): (9, 5, 2, 5, 12)}
