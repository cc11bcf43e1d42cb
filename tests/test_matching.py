from __future__ import annotations

import random
from collections import Counter

import pytest
from compare import SMALL

from quillon.operators import matching
from quillon.plans import catalog


def greatest(edges, capacity):
    """The size of a maximum matching by augmenting paths, one at a time."""
    choices, owner = {}, {}
    for user, product in edges:
        choices.setdefault(user, set()).add(product)

    def place(user, seen):
        for product in choices[user] - seen:
            seen.add(product)
            if product not in owner or place(owner[product], seen):
                owner[product] = user
                return True
        return False

    for user in choices:
        for _ in range(capacity):
            place(user, set())
    return len(owner)


@pytest.mark.parametrize(("users", "products", "n", "capacity"), [(30, 60, 70, 3), (40, 40, 60, 1), (25, 80, 120, 2), (12, 8, 40, 3), (5, 5, 0, 3)])
def test_matching_is_as_large_as_by_brute_force(spark, users, products, n, capacity):
    rng = random.Random(n + capacity)
    edges = [(f"u{rng.randrange(users)}", rng.randrange(products)) for _ in range(n)]
    rows = spark.createDataFrame([*edges, ("u0", None), (None, 1)], "user_id string, asin long")
    found = [(r.user_id, r.asin) for r in matching.match(rows, capacity).collect()]
    assert len({p for _, p in found}) == len(found) == greatest(edges, capacity)
    assert set(found) <= set(edges) and max(Counter(u for u, _ in found).values(), default=0) <= capacity


def test_long_augmenting_path(spark):
    """A chain whose only larger matching turns every edge over."""
    edges = [edge for k in range(6) for edge in ((f"u{k}", k), (f"u{k}", k + 1))] + [("first", 0)]
    assert matching.match(spark.createDataFrame(edges, "user_id string, asin long"), 1).count() == 7


def test_registered_matching_is_maximum(spark):
    edges = [(r.user_id, r.asin) for r in catalog._edges(spark, SMALL).collect()]
    found = [(r.user_id, r.asin) for r in catalog.user_product_matching(spark, SMALL).collect()]
    assert len({p for _, p in found}) == len(found) and set(found) <= set(edges)
    assert max(Counter(u for u, _ in found).values()) <= 3
    products = len({p for _, p in edges})
    assert len(found) <= min(products, 3 * len({u for u, _ in edges})) and (len(found) == products or len(found) == greatest(edges, 3))
