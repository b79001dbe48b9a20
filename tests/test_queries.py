"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from tallyloom.plans.queries import QUERIES, SQL
from tests.compare import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, data, duck):
    same(QUERIES[name](spark, data), duck.sql(SQL[name]))


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def held_against_sql(spark, name, tables, folder):
    """The query over tables of its own, against its SQL."""
    import duckdb

    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    out = QUERIES[name](spark, str(folder))
    same(out, con.sql(SQL[name]))
    return out


def test_leak_contains_finds_short_items_and_inside_words(spark, tmp_path):
    texts = ["The quick brown fox jumps over a lazy dog", "unquick brownish", "quick", "", None, "a b", "one two three four five six seven eight", "xone two three four five six seven eightx"]
    items = ["quick", "quick brown", "k b", "fox jumps over", "x jumps ov", "lazy dog!", "one two three four", "one two three four five six seven eight", "one two three four five", "nothing", "a", "the quick brown fox jumps", "", None]
    tables = {"documents": spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "benchmark": spark.createDataFrame(list(enumerate(items)), "item_id long, text string")}
    got = {(r.doc_id, r.item_id) for r in held_against_sql(spark, "leak_contains", tables, tmp_path).collect()}
    assert {(0, 0), (1, 0), (2, 0), (1, 1), (0, 2), (0, 4), (6, 7), (7, 7), (7, 8)} <= got


def test_exact_dedupe_looks_at_whole_texts(spark, tmp_path):
    head = "licence " * 300
    rows = [(1, "b", head + "one"), (2, "a", head + "two"), (3, "a", head + "one"), (4, "a", "x"), (5, "a", "x"), (6, "a", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in QUERIES["exact_dedupe_state"](spark, str(tmp_path)).collect()) == [2, 3, 4, 6]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sets_meet_without_a_join(spark, tmp_path):
    """Otherwise all rows of a frequent key are joined by one task."""
    orders = [(3, 5.0, "a"), (4, 2e5, "b"), (6, 2e5, "c"), (9, None, None), (1, 2e5, None), (None, None, "d"), (7, 1.0, "e"), (12, 1.0, "a")]
    out = held_against_sql(spark, "set_operations", {"orders": spark.createDataFrame(orders, "o_orderkey long, o_totalprice double, o_orderpriority string")}, tmp_path)
    assert out.count() == 7 and "Join" not in _plan(out)


def test_options_are_hashed_once(spark, data):
    assert _plan(QUERIES["mcq_options"](spark, data)).count("sha1(") == 2  # of the pool and of gold


def test_record_lines_are_read_once_and_by_row(spark, tmp_path):
    orders = [(1, 7, "P", 5.0, "1-URGENT"), (1, 8, "F", 200000.0, "3-MEDIUM"), (2, 9, "O", 100000.5, "5-LOW"), (3, 9, "O", 1.0, "2-HIGH")]
    df = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    out = held_against_sql(spark, "record_lines_read", {"orders": df}, tmp_path)
    assert out.count() == 3 * len(orders)
    assert not [x for x in _plan(out).split("\n") if "from_json" in x and x.strip(" :+-").startswith(("Filter", "Join"))]
