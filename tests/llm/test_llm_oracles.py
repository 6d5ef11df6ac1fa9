"""The operators that SQL can express, against their oracles over the smallest tables."""

import os

import pytest

import oracle
from strandloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    oracle.compare(spark, oracle.duck(SF), queries.QUERIES[name], queries.ORACLE[name], SF)
