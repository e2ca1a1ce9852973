"""Every registered query against its SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, database

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_query(spark, con, name):
    good, note = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert good, note


def test_flagship(spark):
    assert entry.entry(spark).count() == 40


def test_a_small_table_of_parts_is_rendered_by_several_tasks(spark, tmp_path):
    from passageworks.plans import queries

    rows = [(n, f"part {n}", "BRAND", "KIND", n % 50) for n in range(100)]
    spark.createDataFrame(rows, "p_partkey LONG, p_name STRING, p_brand STRING, p_type STRING, p_size INT").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = queries.markdown_html(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() > 1
    assert sorted(r["p_partkey"] for r in made.collect()) == list(range(100))
