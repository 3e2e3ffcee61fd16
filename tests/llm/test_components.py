import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkloom.llm.components import components


def brute(edges):
    name = {}
    for a, b in edges:
        if a != b:
            name.setdefault(a, a)
            name.setdefault(b, b)
    for _ in name:
        for a, b in edges:
            if a != b:
                name[a] = name[b] = min(name[a], name[b])
    return name


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=25))
def test_any_graph(spark, edges):
    rows = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in components(rows).collect()} == brute(edges)


@pytest.mark.parametrize("how", [{}, {"chunk": 50}, {"chunk": 50, "limit": 20}])
def test_long_path_and_hubs(spark, how):
    path = [(i, i + 1) for i in range(150)]
    hub = [(1000, 1000 + i) for i in range(1, 100)] + [(1000 + i, 1300) for i in range(50)] + [(2000 + i, 1300) for i in range(50)]
    edges = path + hub
    random.Random(1).shuffle(edges)
    rows = spark.createDataFrame(edges, "a long, b long").repartition(8)
    assert {r.node: r.root for r in components(rows, **how).collect()} == brute(edges)
