"""Neighbour and link operators against brute force."""

import numpy as np
import pandas as pd
import pytest

from firn.operators import spatial
from firn.operators.spatial import components, knn, link_components


def frame(spark, ids, xy, **more):
    return spark.createDataFrame(pd.DataFrame({"id": ids, "x": xy[:, 0], "y": xy[:, 1], **more}))


def clumped(rng, n):
    """A third of the rows in one tiny clump, a sixth exact copies of one point, the rest spread."""
    hot = rng.normal(0, 0.01, (n // 3, 2))
    copies = np.tile([[3.0, 3.0]], (n // 6, 1))
    return np.concatenate([hot, copies, rng.uniform(-10, 10, (n - len(hot) - len(copies), 2))])


@pytest.mark.parametrize("exclude", [False, True])
def test_knn_matches_brute_force(spark, exclude):
    rng = np.random.default_rng(5)
    xy = clumped(rng, 300)
    ids = np.arange(len(xy))
    points = frame(spark, ids, xy)
    got = knn(points, points, 3, exclude_self=exclude, leaf_rows=8).toPandas().sort_values(["id", "rank"])
    d2 = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2)
    if exclude:
        np.fill_diagonal(d2, np.inf)
    want = np.array([np.lexsort((ids, row))[:3] for row in d2])
    assert len(got) == 3 * len(xy)
    assert np.array_equal(got["neighbour"].to_numpy().reshape(-1, 3), want)


def labels_by_hand(xy, rho):
    d2 = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2)
    link = d2 <= np.maximum(rho[:, None], rho[None, :]) ** 2
    label = np.arange(len(xy))
    while True:
        new = np.array([label[link[i]].min() for i in range(len(xy))])
        if np.array_equal(new, label):
            return label
        label = new


@pytest.mark.parametrize("pair_rows", [1, 4, 4096])
@pytest.mark.parametrize("mixed", [False, True])
def test_link_components_match_brute_force(spark, pair_rows, mixed):
    rng = np.random.default_rng(7)
    xy = clumped(rng, 150)
    rho = rng.choice([0.3, 0.5, 1.1], len(xy)) if mixed else np.full(len(xy), 0.7)
    points = frame(spark, np.arange(len(xy)), xy, rho=rho)
    got = link_components(points, pair_rows=pair_rows).toPandas().sort_values("id")
    assert np.array_equal(got["label"].to_numpy(), labels_by_hand(xy, rho))


def test_touching_cells_enter_the_contraction_as_forests(spark, monkeypatch):
    xy = np.random.default_rng(9).uniform(0, 12, (600, 2))
    rho = np.full(len(xy), 1.5)
    points = frame(spark, np.arange(len(xy)), xy, rho=rho)
    met = []
    contract = spatial.components
    monkeypatch.setattr(spatial, "components", lambda edges, by: met.append(edges.count()) or contract(edges, by))
    got = link_components(points).toPandas().sort_values("id")
    assert np.array_equal(got["label"].to_numpy(), labels_by_hand(xy, rho))
    # Cells half a unit wide, 24 x 24 of them: a forest of each tile has fewer edges than cells.
    assert met[0] < 24 * 24


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(200)]
    hub = [(1000, i) for i in range(1001, 1400)]
    edges = spark.createDataFrame(path + hub, "src bigint, dst bigint")
    got = components(edges).toPandas()
    assert set(got[got["id"] <= 200]["label"]) == {0}
    assert set(got[got["id"] >= 1000]["label"]) == {1000}
    assert len(got) == 201 + 400


def test_neighbours_with_a_place_that_is_not_finite(spark):
    rows = [(i, float(i), 0.0) for i in range(40)] + [(99, float("nan"), 0.0), (98, None, 0.0), (97, float("inf"), 1.0)]
    points = spark.createDataFrame(rows, "id int, x double, y double")
    found = {(r["id"], r["neighbour"]) for r in knn(points, points, 1, exclude_self=True).collect()}
    assert len(found) == 40 and all(abs(a - b) == 1 for a, b in found)


def test_pairs_that_sure_links_join_are_not_opened(spark, monkeypatch):
    xy = np.random.default_rng(9).uniform(0, 12, (600, 2))
    rho = np.random.default_rng(4).choice([1.2, 2.5], len(xy))
    points = frame(spark, np.arange(len(xy)), xy, rho=rho)
    opened = []
    compare = spatial._compare
    monkeypatch.setattr(spatial, "_compare", lambda small, *rest: opened.append(small.count()) or compare(small, *rest))
    got = link_components(points).toPandas().sort_values("id")
    assert np.array_equal(got["label"].to_numpy(), labels_by_hand(xy, rho))
    # Hundreds of cell pairs are neither surely linked nor surely apart; nearly all lie within one group of their tile.
    assert sum(opened) < 20


def test_crowded_tiles_are_parted(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TILE_ROWS", 16)
    xy = np.random.default_rng(11).uniform(0, 30, (400, 2))
    rho = np.random.default_rng(12).choice([0.2, 0.9, 9.0], len(xy), p=[0.6, 0.38, 0.02])
    got = link_components(frame(spark, np.arange(len(xy)), xy, rho=rho)).toPandas().sort_values("id")
    assert np.array_equal(got["label"].to_numpy(), labels_by_hand(xy, rho))


def test_cells_beyond_a_query_are_not_opened(spark):
    cells = [(1, 0.0, 1.0, 0.0, 1.0), (2, 3.0, 4.0, 0.0, 1.0), (3, 2.0, 2.5, 2.0, 2.5)]
    asked = spark.createDataFrame([(c[0], *c[1:], 0.5, 0.5, b) for c in cells for b in (2.5**2, 2.0, None)], "cell int, r_minx double, r_maxx double, r_miny double, r_maxy double, x double, y double, _bound double")
    got = sorted((r["cell"], r["_bound"] or 0.0) for r in spatial._in_bound(asked, None).collect())
    assert got == [(1, 0.0), (1, 2.0), (1, 6.25), (2, 0.0), (2, 6.25), (3, 0.0), (3, 6.25)]
    assert {r["cell"] for r in spatial._in_bound(asked, 2.2).collect()} == {1, 3}


def test_few_queries_among_many_points(spark):
    rng = np.random.default_rng(8)
    points, queries = np.round(rng.uniform(0, 40, (4000, 2)), 1), np.round(rng.uniform(-5, 45, (150, 2)), 1)
    made = [spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double") for p in (queries, points)]
    got = {(r["id"], r["rank"]): r["neighbour"] for r in knn(*made, 3, max_distance=4.0).collect()}
    want = {}
    for i, q in enumerate(queries):
        d2 = ((points - q) ** 2).sum(axis=1)
        for rank, at in enumerate(np.lexsort((np.arange(len(points)), d2))[:3]):
            if d2[at] <= 16.0:
                want[(i, rank + 1)] = at
    assert got == want


def test_searches_run_in_shares(spark, monkeypatch):
    """Shares change the disk that a search takes, not what it finds."""
    rows = [(i if i % 7 else None, float((i * 37) % 50), float((i * i) % 41)) for i in range(400)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    whole = sorted(knn(points.filter("id is not null"), points.filter("id is not null"), 3, exclude_self=True, leaf_rows=4).collect())
    written, old = [], spatial.materialize
    monkeypatch.setattr(spatial, "SHARE_ROWS", 100)
    monkeypatch.setattr(spatial, "materialize", lambda df, label="step": written.append(label) or old(df, label))
    assert sorted(knn(points.filter("id is not null"), points.filter("id is not null"), 3, exclude_self=True, leaf_rows=4).collect()) == whole
    assert written.count("placed") == written.count("ranked") > 2
