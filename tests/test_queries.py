"""Registered queries against their SQL, on small tables that hold what the given ones hold seldom."""

import tempfile

import duckdb

import __spark_entry__


def both(spark, name, **tables):
    """A query's rows and those of its SQL over (schema, rows) by table."""
    folder, db = tempfile.mkdtemp(), duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found = sorted((tuple(r) for r in __spark_entry__.queries()[name](spark, folder).collect()), key=str)
    return found, sorted(db.execute(__spark_entry__.oracle_sql()[name]).fetchall(), key=str)


def test_key_rule_over_groups_of_any_size(spark):
    docs = [(i, "many") for i in range(1, 31)] + [(i, f"pair {i // 2}") for i in range(40, 44)] + [(50, "alone"), (51, None), (52, None)]
    got, want = both(spark, "rule_prp_key_star", documents=("doc_id long, text string", docs))
    assert got == want and len(got) == 29 + 2


def test_whole_log_is_replayed(spark):
    events = [(i, i % 7, "view" if i % 3 else "buy", float(i * 7919 % 100)) for i in range(0, 20_000, 37)]
    tables = {"events": ("event_id long, user_id long, event_type string, value double", events)}
    got, want = both(spark, "change_replay_whole", **tables)
    assert got == want
    half, until_middle = both(spark, "change_replay", **tables)
    assert half == until_middle and got != half


def test_inverse_path_takes_all_nations(spark):
    people = [(1, 3), (2, 3), (3, 20), (4, 24), (5, 9)]
    got, want = both(spark, "sparql_path_inverse_counts", customer=("c_custkey long, c_nationkey int", people), supplier=("s_suppkey long, s_nationkey int", [(1, 3), (2, 20), (3, 20), (4, 24)]))
    assert got == want == [(1, 3, 1), (2, 3, 1), (3, 20, 2), (4, 24, 1)]


def test_sameness_of_every_customer(spark):
    got, want = both(spark, "rule_eq_rep_s_accounts", customer=("c_custkey long, c_name string", [(2, "a"), (3, "a"), (4, "b"), (5, None)]), orders=("o_orderkey long, o_custkey long", [(10, 2), (11, 3), (12, 4), (13, 5)]))
    assert got == want and len(got) == 5


def test_violations_from_the_data(spark):
    tables = {
        "orders": ("o_orderkey long, o_custkey long", [(1, 1), (2, 3), (3, 2), (4, 2)]),
        "documents": ("doc_id long, text string, source string", [(5, "t", "web"), (6, "t", "web"), (7, "t", "book"), (8, "u", "web")]),
        "labels": ("doc_id long, quality int, toxic int", [(5, 1, 1), (6, 0, 1)]),
    }
    got, want = both(spark, "check_other_data", **tables)
    assert got == want and {r[0] for r in got} == {"prp-irp", "prp-asyp", "eq-diff1", "cls-nothing2"}
