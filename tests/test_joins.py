"""Nearest matches in crowded and empty places against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpulse.operators import joins
from sparkpulse.sources.io import Temporary

PLACES = "lat double, lon double"


def met(spark, orders, drivers, **more):
    o = spark.createDataFrame([(f"o{i}", float(a), float(b)) for i, (a, b) in enumerate(orders)], f"order_id string, {PLACES}")
    d = spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in drivers], f"driver_id long, {PLACES}")
    return {r.order_id: (r.driver_id, r.distance) for r in joins.nearest_available(o, d, **more).collect()}


def all_pairs(orders, drivers):
    best = [min((((a - c) ** 2 + (b - d) ** 2) ** 0.5, i) for i, c, d in drivers) for a, b in orders]
    return {f"o{k}": (i, x) for k, (x, i) in enumerate(best)}


@pytest.mark.parametrize("crowd", [4, 64])
def test_one_city_in_a_sparse_country(spark, crowd):
    rng = np.random.default_rng(9)
    city, country = rng.normal(50.0, 0.01, (400, 2)), rng.uniform(0, 80, (25, 2))
    spots = np.vstack([city, country, city[:30]])
    drivers = [(i, *p) for i, p in enumerate(spots)]
    orders = np.vstack([rng.normal(50.0, 0.01, (150, 2)), rng.uniform(-200, 300, (40, 2)), spots[:5], [[50.0, 120.0]]])
    got, want = met(spark, orders, drivers, crowd=crowd), all_pairs(orders, drivers)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_only_crowded_cells_are_split(spark):
    rng = np.random.default_rng(3)
    spots = np.vstack([rng.uniform(0, 80, (60, 2)), rng.normal(40.0, 0.001, (1000, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(spots)], "driver_id long, d_lat double, d_lon double")
    with Temporary() as temporary:
        nodes, leaves = joins.quadtree(df, 32, temporary)
        cells = nodes.collect()
        assert leaves.count() == 1060 and nodes.where("NOT inner AND n > 32 AND level < 10").isEmpty()
        assert max(r.level for r in cells) > 5 and sum(r.n for r in cells if not r.inner) == 1060
        assert len(cells) < 60 * 3 + 16 * 1000 / 32 * 3  # a full grid of that depth has 16^level cells


def test_orders_at_one_place_go_down_as_one(spark, monkeypatch):
    rng, kept = np.random.default_rng(4), {}
    tables = joins.Temporary.stored

    def counted(self, df, name):
        out = tables(self, df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(joins.Temporary, "stored", counted)
    drivers, places = [(i, *p) for i, p in enumerate(rng.uniform(0, 80, (200, 2)))], rng.uniform(0, 80, (7, 2))
    orders = [tuple(places[i % 7]) for i in range(700)]
    want = all_pairs(orders, drivers)
    for most in (200_000, 0):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", most, raising=False)
        assert {k: v[0] for k, v in met(spark, orders, drivers, crowd=8).items()} == {k: v[0] for k, v in want.items()}
        assert max(n for name, n in kept.items() if name.startswith("orders-")) == 7


def test_ties_spots_and_missing_places(spark):
    assert met(spark, [(0.0, 0.0)], [(5, 0.0, 1.0), (3, 1.0, 0.0), (4, 1.0, 0.0)]) == {"o0": (3, 1.0)}
    same = [(i, 2.0, 2.0) for i in range(200, 0, -1)]
    assert met(spark, [(2.0, 2.0), (9.0, 2.0)], same) == {"o0": (1, 0.0), "o1": (1, 7.0)}
    grid = [(i * 20 + j, float(i), float(j)) for i in range(20) for j in range(20)]
    assert met(spark, [(4.5, 4.5), (19.5, 0.5)], grid, crowd=8) == {"o0": (84, 0.5**0.5), "o1": (380, 0.5**0.5)}
    o = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 0.0), ("b", None, 1.0)], f"order_id string, {PLACES}")
    d = spark.createDataFrame([(1, 3.0, 4.0), (2, None, 0.0)], f"driver_id long, {PLACES}")
    assert [tuple(r) for r in joins.nearest_available(o, d).collect()] == [("a", 1, 5.0)]
    assert joins.nearest_available(o.where("lat > 9"), d).count() == 0 and joins.nearest_available(o, d.where(F.lit(False))).count() == 0
