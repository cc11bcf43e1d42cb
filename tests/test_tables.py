"""Reviewed products beside plain Python, their reviews read once and dealt by their number."""

from __future__ import annotations

import random

from quillon.operators import tables
from quillon.plans import catalog


def test_reviewed_products_against_plain_python(spark):
    rng = random.Random(5)
    products = [(k, rng.choice([None, k, k // 10 * 10, 900 + k])) for k in range(1, 80)] + [(7, 20), (7, 30), (None, 10)]
    reviews = [(rng.choice([None, *range(100)]), rng.choice([None, "a", "b", "c"])) for _ in range(400)]
    held = {p for p, _ in products if p is not None}
    want = {(p, u) for p, u in reviews if p in held}
    want |= {(up, u) for p, up in products for asin, u in reviews if p is not None and asin == p and up in held}
    given = spark.createDataFrame(products, "asin long, parent_asin long"), spark.createDataFrame(reviews, "asin long, user_id string")
    for tasks in (None, 3):
        found = tables.reviewed_products(*given, **({} if tasks is None else {"tasks": tasks}))
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_reviewed_products_reads_each_line_once_and_deals_by_their_number(spark, monkeypatch):
    asked = []
    real = tables.reviewed_products
    monkeypatch.setattr(tables, "reviewed_products", lambda products, reviews, tasks: asked.append(tasks) or real(products, reviews, tasks))
    monkeypatch.setattr(catalog, "ROWS_A_TASK", 7000)
    plan = catalog.reviewed_products(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    assert asked == [1 + lines // 7000] and plan.count("Relation [l_orderkey") == 1
