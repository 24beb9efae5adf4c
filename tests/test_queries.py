"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SOME = ["agg3_top_connected", "gr9_clustering", "tmp5_many_times", "flt7_terms", "txt1_word_chunks", "vec1_cosine", "agg8_scores", "con1_values", "jn21_cascade", "gr5_closeness", "gr12_paths", "asm6_outcomes", "dq12_relations", "txt8_product_record", "str1_ingest", "str2_history"]
SOME += ["gr13_paths", "vec2_index_exact", "vec5_links", "jn12_fuzzy", "jn13_people", "jn14_venues", "fn23_typed", "fn23_faulty", "txt12_closure", "str2_stateful", "str3_attempts"]
SOME += ["srch1_keyword", "srch5_strategy", "dq3_venues", "dq4_dates", "dq7_phases", "txt16_queue", "asm4_links"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    import duckdb

    df = entry.queries()[name](spark, DATA)
    got = [tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()]
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    table = con.sql(entry.oracle_sql()[name]).to_arrow_table()
    want = [tuple(map(str, r.values())) for r in table.select(sorted(table.column_names)).to_pylist()]
    show = lambda rows: sorted(tuple(str(round(float(x), 6)) if x.replace(".", "", 1).replace("-", "", 1).isdigit() else x.lower() for x in r) for r in rows)
    assert show(got) == show(want)
