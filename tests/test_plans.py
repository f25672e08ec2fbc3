"""Plans: what reaches the scan, how often rows move, and that the library stands without its training-data part."""

import os
import re
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from tessella.catalog import FLAGSHIP, table
from tessella.plans.request import process

DATA = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_filters_and_columns_reach_the_scan(spark):
    req = {
        "filterers": [{"type": "FILTER_RANGE", "field": "l_quantity", "params": {"values": [10, 20]}}, {"type": "FILTER_INCLUDE", "field": "l_returnflag", "params": {"values": ["A", "R"]}}],
        "groups": [{"type": "GROUP_CATEGORY", "field": "l_returnflag"}],
        "aggregations": [{"type": "AGG_SUM", "field": "l_quantity", "label": "q"}],
    }
    plan = plan_of(process(table(spark, DATA, "lineitem"), req).rows)
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "In(l_returnflag" in plan
    assert set(re.search(r"ReadSchema: struct<([^>]*)>", plan)[1].replace("...", "").split(",")) <= {"l_quantity:double", "l_returnflag:string"}
    assert "partial_sum" in plan and plan.count("Exchange hashpartitioning") == 1


def test_one_aggregate_for_all_measures(spark):
    df = table(spark, DATA, "lineitem").withColumn("ship", F.date_format("l_shipdate", "yyyy-MM-dd"))
    plan = plan_of(process(df, FLAGSHIP).rows)
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_crosstab_margins_take_one_scan(spark):
    spec = {"rows": [{"type": "GROUP_CATEGORY", "field": "l_returnflag"}], "columns": [{"type": "GROUP_CATEGORY", "field": "l_linestatus"}], "cell": {"type": "AGG_COUNT", "label": "n"}, "margins": ["row", "column", "grand"]}
    plan = plan_of(process(table(spark, DATA, "lineitem"), {"crosstab": spec}).rows)
    assert plan.count("FileScan") == 1 and "Expand" in plan


def test_layered_attributes_share_one_aggregate(spark):
    req = {"attributes": [{"type": f"ATTR_{k}", "field": "l_quantity", "label": k} for k in ("ZSCORE", "TSCORE", "NORMALIZED")]}
    assert plan_of(process(table(spark, DATA, "lineitem"), req).rows).count("FileScan") == 2


def test_the_library_stands_without_the_training_data_part(tmp_path):
    copy = f"{tmp_path}/repo"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
