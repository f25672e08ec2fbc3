"""Findings of the review of round 1, each by a case that used to come out wrong."""

import math

import pytest

from tessella.errors import RequestError
from tessella.operators.slots import Slot
from tessella.operators.tests import TESTS


def run(kind, df, field, **params):
    return TESTS.find(kind)(df, Slot(kind, field, None, params))


def test_more_groups_than_the_limit(spark):
    rows = [(f"g{k}", f"s{i}", float(100 * k + 10 * i + i * i * k % 7), float(i * i + k)) for k in range(4) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, s string, x double, y double")
    whole = run("TEST_KRUSKAL_WALLIS", df, "x", split_by="g")
    assert run("TEST_KRUSKAL_WALLIS", df, "x", split_by="g", max_groups=2) == whole
    # Groups in order without overlap: rank sums are 6 * (6k + 3.5).
    terms = sum((6 * (6 * k + 3.5)) ** 2 / 6 for k in range(4))
    assert whole["df"] == 3 and math.isclose(whole["statistic"], 12 / (24 * 25) * terms - 75)
    for kind, params in (("TEST_ANOVA_RM", {"subject_field": "s"}), ("TEST_MANOVA", {"members": ["x", "y"]}), ("TEST_BOX_M", {"members": ["x", "y"]})):
        with pytest.raises(RequestError):
            run(kind, df, "x", split_by="g", max_groups=2, **params)
