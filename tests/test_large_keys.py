"""Queries on keys of more digits than those of the small tables, against their SQL."""

import pytest

from attestlake.plans import registry
from tests.compare import difference

SF = "/root/testdata/sf0.001"
#: Tables and the column whose values are shifted, so that its numbers get more digits.
SHIFTED = {"supplier": ("s_suppkey", 999_980), "customer": ("c_custkey", 9_900), "part": ("p_partkey", 99_800)}


@pytest.fixture(scope="module")
def large_keys(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("large"))
    for name, (key, by) in SHIFTED.items():
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        df.unionByName(df.withColumn(key, (df[key] + by).cast(df.schema[key].dataType))).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", ["N3_grouped_number", "N9_table_cells", "V16_V24_captions_in_texts"])
def test_same_rows_as_sql_on_large_keys(spark, large_keys, name):
    assert difference(spark, name, registry.queries()[name], registry.oracle_sql()[name], large_keys) is None
