"""Intervals and boxes on odd rows, held against their SQL."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__

LINE = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)


def line(order=1, part=1, supp=1, number=1, quantity=1.0, status="O", day="1992-01-11"):
    import datetime

    return (order, part, supp, number, quantity, 1.0, 0.0, 0.0, "N", status, day and datetime.datetime.fromisoformat(day))


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query and of its SQL over a table of lineitem rows."""

    def run(name, rows):
        spark.createDataFrame(rows, LINE).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        con = duckdb.connect()
        con.execute("SET threads = 1")
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        out = __spark_entry__.queries()[name](spark, str(tmp_path))
        sql = con.execute(__spark_entry__.oracle_sql()[name])
        at = [out.columns.index(c[0]) for c in sql.description]
        return Counter(tuple(row[i] for i in at) for row in out.collect()), Counter(sql.fetchall())

    return run


def test_intervals_without_a_stop_or_start(both):
    rows = [line(number=3), line(number=None), line(day=None), line(day=None), line(supp=2, number=None), line(supp=2, number=None), line(supp=None), line(number=2), line(number=2)]
    got, expected = both("interval_coalesce", rows)
    assert got == expected
    assert got[(1, 10, 13, 4)] == 1


def test_parity_bits_travel_for_candidate_pairs_only(spark, monkeypatch):
    from codexa.llm import jaccard

    kept, write = {}, jaccard.materialise

    def noted(df, name):
        kept.setdefault(name, set()).update(df.columns)
        return write(df, name)

    monkeypatch.setattr(jaccard, "materialise", noted)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[1:])), (3, "other words that link with nothing here")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.components(docs, 4, 85).collect()} == {1: 1, 2: 1, 3: 3}
    assert "wide" not in kept["jaccard-owned"] | kept["jaccard-signs"] and "jaccard-sets" not in kept


def test_nearest_graphic_makes_no_pairs_and_keeps_odd_rows(both):
    rows = [line(part=p, supp=s, quantity=float(q), status=t) for p, (s, q, t) in enumerate([(1, 3, "O"), (1, 3, "O"), (4, 9, "F"), (4, 9, "F"), (30, 1, None), (45, 50, "O"), (2, 2, "F"), (0, 3, "F")])]
    rows += [line(part=None, supp=7, status="F"), line(part=None, supp=7), line(part=None, supp=8), line(number=None), line(supp=None), line(order=2), line(part=3, supp=6, status="F", number=5)]
    got, expected = both("nearest_graphic", rows)
    assert got == expected and len(got) == 4


def test_nearest_graphic_never_joins_boxes_with_boxes(spark):
    plan = __spark_entry__.queries()["nearest_graphic"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "(x#" in plan.split("Join", 1)[1].split("\n")[0]


def test_connected_boxes_on_odd_rows_and_over_the_ends_of_lists(both):
    rows = [line(part=p, supp=p % 47, quantity=float(p % 50 + 1), status="F") for p in range(1100)]
    rows += [line(part=p, supp=p % 31, quantity=float(p % 9), status=t) for p, t in enumerate(["O", "O", "F", None] * 5)]
    rows += [line(part=3, supp=7, status="F")] * 3 + [line(part=3, supp=7)] * 2
    for status in "OF":
        rows += [line(order=None, status=status), line(number=None, status=status), line(part=None, status=status), line(supp=None, status=status), line(quantity=None, status=status)]
        rows += [line(order=2, number=n, quantity=q, status=status) for n, q in ((1, 1.0), (2, 500.0), (4, 9.0))]
    rows += [line(order=3), line(order=4, status="F"), line(order=502, status="F")]
    got, expected = both("connected_boxes", rows)
    assert got == expected and sum(got.values()) > 12_000
    assert both("connected_boxes", [line()]) == (Counter(), Counter())


def test_connected_boxes_of_a_large_page_take_little_disk(spark, tmp_path):
    rows = [line(part=p, supp=p * 7, quantity=float(p * 3 % 50 + 1), status="OF"[p % 2]) for p in range(3000)]
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    __spark_entry__.queries()["connected_boxes"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 1500 * 1500
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 1500 * 1500 / 2
