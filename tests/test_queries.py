"""Every registered query against its SQL, as the driver compares them."""

import os
import random

import duckdb
import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if type(v).__name__ in ("Timestamp", "datetime", "datetime64") else v


def said(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k in ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = said(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[name])
    want = said([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) and len(got[1]) > 0
    for a, b in zip(got[1], want[1], strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, int | float) for x in (*a, *b)) else all(x == y or (isinstance(x, float) and abs(x - y) < 2e-6) for x, y in zip(a, b, strict=True)), (a, b)


def test_agreement_rates_of_halves_and_nulls(spark, tmp_path):
    con = duckdb.connect()
    totals = [None, 0.0, 24999.99, 25000.0, 75000.0, 125000.0, 125000.01, 175000.0, 225000.0, 275000.0, 449999.99]
    con.execute("create table orders as select (unnest(generate_series(1, len($1))))::bigint o_orderkey, unnest($1)::double o_totalprice", [totals])
    con.execute("create table lineitem as select o_orderkey l_orderkey, i % 2 l_suppkey from orders, range(3) t(i) where o_orderkey <> 3")
    for t in ("orders", "lineitem"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    got, want = QUERIES["agreement_rates"](spark, str(tmp_path)).select("k", "line_rate", "supplier_rate"), con.execute(ORACLE["agreement_rates"])
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_sentence_split_of_odd_texts(spark, tmp_path):
    """Nothing but white space, white space of Unicode, vertical tabs, the mark at which SQL splits."""
    rnd = random.Random(7)
    signs = [*". ! ? A b 9 \" ' ( é ß \\ $1".split(" "), *" \n\t\f\r\v\0\1\x1c\x85\xa0\u1680\u180e\u2003\u200b\u2028\u2029\u202f\u3000\ufeff\U0001f600"]
    texts = [None, "", " \n", "\xa0", "\v", "\1", "One.\xa0Two. Three", "One.\1 Two", "One. \1Two", *("".join(rnd.choices(signs, k=rnd.randint(1, 12))) for _ in range(3000))]
    con = duckdb.connect()
    con.execute("create table documents as select i::bigint doc_id, $1[i] as text from range(1, len($1) + 1) t(i)", [texts])
    con.execute(f"copy documents to '{tmp_path}/documents.parquet' (format parquet)")
    got = QUERIES["sentence_split"](spark, str(tmp_path)).select("doc_id", "n", "chars")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLE["sentence_split"]).fetchall())


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in ORACLE and not k.startswith(("op", "pipeline"))))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_chunks_are_numbered_without_an_order_of_all_texts(spark):
    """Windows of the last plan order counts of pages, and no text is in one; numbers go from 1 through each source."""
    made = QUERIES["layout_chunks"](spark, os.path.join(os.path.dirname(SF), "sf0.001"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" in plan and "row_number()" not in plan
    for r in made.groupBy("source_file").agg({"chunk_index": "max", "*": "count"}).collect():
        assert r["max(chunk_index)"] == r["count(1)"]


def test_coverage_counts_tokens_within_pages(spark):
    """Tokens of a page's two texts are counted in its row: none is a row of its own that is sent to meet the others."""
    plan = QUERIES["layout_chunk_coverage"](spark, os.path.join(os.path.dirname(SF), "sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "token#" not in plan and "MapInArrow" in plan
