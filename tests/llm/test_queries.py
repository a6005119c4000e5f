"""Every registered query of the subpackage, against its SQL where it has some."""

import compare
import pytest

import __spark_entry__ as entry
from trawl.llm.queries import ORACLES, QUERIES


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    names, rows = compare.spark_rows(QUERIES[name](spark, sf_dir))
    expected_names, expected = compare.sql_rows(compare.connect(sf_dir), ORACLES[name])
    assert names == expected_names and rows == expected and rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_one_row_per_input_row_or_more(spark, sf_dir, name):
    table = {"op1": "pages", "op5": "embeddings"}.get(name.split("_")[0], "documents")
    least = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert QUERIES[name](spark, sf_dir).count() >= (least // 50 if table == "embeddings" else least)
