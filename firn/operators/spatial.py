"""Nearest neighbours and link graphs on the plane, without pairing up dense groups.

Both operators work on cells with counts and tight bounds rather than on rows. A cell
pair is settled by its bounds where possible, split where it is heavy, and only pairs of
small cells are compared row by row. One place holding a third of all rows therefore
costs a few more rounds of splitting, not a quadratic number of comparisons.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from firn.functions.compare import finite, where
from firn.session import discard, materialize, shuffle_width

DEPTH = 24
LEAF_ROWS = 32
PAIR_ROWS = 4096
BROADCAST_DEPTH = 5
LINK_DEPTH = 30
LEVELS_PER_PASS = 6
ROUNDS_PER_WRITE = 6
#: Points of a share of a search, and its shares at most: a share takes less disk, all together find the same.
SHARE_ROWS = 200_000
MOST_SHARES = 16
TILE_SHIFT = 5
#: Cells of one tile's group, besides the tile's own.
TILE_ROWS = 65_536
#: A link is shorter than four cells of its band.
CELL_REACH = 4
_TILE = ("_gb", "_tx", "_ty")


def _low(a: str, b: str, axis: str) -> Column:
    """Gap between two boxes along an axis."""
    return F.greatest(
        F.lit(0.0), F.col(f"{a}_min{axis}") - F.col(f"{b}_max{axis}"), F.col(f"{b}_min{axis}") - F.col(f"{a}_max{axis}")
    )


def _high(a: str, b: str, axis: str) -> Column:
    """Largest separation of two boxes along an axis."""
    return F.greatest(F.col(f"{b}_max{axis}") - F.col(f"{a}_min{axis}"), F.col(f"{a}_max{axis}") - F.col(f"{b}_min{axis}"))


def _square(a: Column, b: Column) -> Column:
    return a * a + b * b


def min_sq(a: str, b: str) -> Column:
    return _square(_low(a, b, "x"), _low(a, b, "y"))


def max_sq(a: str, b: str) -> Column:
    return _square(_high(a, b, "x"), _high(a, b, "y"))


_BOX = (("minx", F.min, "x"), ("maxx", F.max, "x"), ("miny", F.min, "y"), ("maxy", F.max, "y"))


def _box(prefix: str) -> list[Column]:
    return [fn(source).alias(f"{prefix}_{name}") for name, fn, source in _BOX]


# --- nearest neighbours -------------------------------------------------------------


class _Frame:
    """A square covering all points, cut into 2^depth cells a side."""

    def __init__(self, x0: float, y0: float, side: float):
        self.x0, self.y0, self.side = x0, y0, side or 1.0

    @staticmethod
    def around(df: DataFrame) -> "_Frame":
        x0, x1, y0, y1 = df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if x0 is None:
            return _Frame(0.0, 0.0, 1.0)
        return _Frame(x0, y0, max(x1 - x0, y1 - y0))

    def cells(self, df: DataFrame) -> DataFrame:
        top = (1 << DEPTH) - 1

        def index(axis: str, origin: float) -> Column:
            scaled = F.floor((F.col(axis) - F.lit(origin)) * F.lit((1 << DEPTH) / self.side))
            return F.greatest(F.lit(0), F.least(F.lit(top), scaled)).cast("long")

        return df.withColumns({"_ix": index("x", self.x0), "_iy": index("y", self.y0)})


def _at(column: str, depth: int) -> Column:
    return F.shiftright(F.col(column), DEPTH - depth)


_CELL = ["d", "cx", "cy"]


def _levels(first: int, last: int) -> Column:
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(d).alias("d"), _at("_ix", d).alias("cx"), _at("_iy", d).alias("cy"))
                for d in range(first, last + 1)
            ]
        )
    ).alias("_k")


def _tree(points: DataFrame, leaf_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Cells holding at most ``leaf_rows`` points, for each ``side`` on its own.

    Returns the points with their leaf cell, the table of all nodes (``side``, cell, ``n``,
    bounds, ``leaf``) and the depth reached. A cell exists when its parent is over the
    limit, so several levels come from one pass and one self-join.
    """
    passes: list[DataFrame] = []
    first, heavy = 0, None
    while True:
        last = min(first + LEVELS_PER_PASS - 1, DEPTH)
        rows = points.select("side", "_ix", "_iy", "x", "y")
        if heavy is not None:
            rows = rows.withColumns({"cx": _at("_ix", first - 1), "cy": _at("_iy", first - 1)}).join(
                heavy, ["side", "cx", "cy"], "left_semi"
            )
        # Points are counted in the deepest cells only; the cells above are made of these.
        deepest = rows.groupBy("side", _at("_ix", last).alias("_x"), _at("_iy", last).alias("_y")).agg(
            F.count("*").alias("n"), *[fn(source).alias(name) for name, fn, source in _BOX]
        )
        above = [F.struct(F.lit(d).alias("d"), F.shiftright("_x", last - d).alias("cx"), F.shiftright("_y", last - d).alias("cy")) for d in range(first, last + 1)]
        counted = (
            deepest.withColumn("_k", F.explode(F.array(*above)))
            .groupBy("side", *[F.col("_k")[c].alias(c) for c in _CELL])
            .agg(F.sum("n").alias("n"), *[fn(name).alias(name) for name, fn, _ in _BOX])
            .withColumn("leaf", (F.col("n") <= leaf_rows) | (F.col("d") == DEPTH))
        )
        parents = counted.filter(~F.col("leaf")).select(
            "side", (F.col("d") + 1).alias("d"), F.col("cx").alias("_px"), F.col("cy").alias("_py")
        )
        up = counted.withColumns({"_px": F.shiftright("cx", 1), "_py": F.shiftright("cy", 1)})
        kept = up.filter(F.col("d") > first).join(parents, ["side", "d", "_px", "_py"], "left_semi")
        nodes = materialize(counted.filter(F.col("d") == first).unionByName(kept.drop("_px", "_py")), "cells")
        passes.append(nodes)
        heavy = nodes.filter(~F.col("leaf") & (F.col("d") == last)).select("side", "cx", "cy")
        if last == DEPTH or heavy.isEmpty():
            break
        first = last + 1
    tree = passes[0]
    for more in passes[1:]:
        tree = tree.unionByName(more)
    leaves = tree.filter("leaf").select("side", *_CELL)
    shallow, depth = (d or 0 for d in leaves.agg(F.min("d"), F.max("d")).first())
    # Walk each point to its leaf: one candidate per level with leaves, exactly one of them is a leaf.
    keyed = points.select("side", "id", "x", "y", _levels(shallow, depth)).select("side", "id", "x", "y", "_k.*")
    return keyed.join(leaves, ["side", *_CELL], "left_semi"), tree, depth


def _named(df: DataFrame, side: str) -> DataFrame:
    """Rows of one side with prefixed column names."""
    rest = [c for c in df.columns if c not in ("side", "id", "x", "y")]
    own = [c for c in ("id", "x", "y") if c in df.columns]
    return df.filter(F.col("side") == side).select(*own, *[F.col(c).alias(f"{side}_{c}") for c in rest])


def knn(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    exclude_self: bool = False,
    max_distance: float | None = None,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The k nearest points of every query.

    Both inputs have ``id``, ``x`` and ``y``; ties go to the smaller id. Result: ``id``,
    ``rank`` (from 1), ``neighbour``, ``distance``. Rows without a finite place neither ask nor are found.
    """
    queries, points = (where(side, finite(F.col("x")), finite(F.col("y"))) for side in (queries, points))
    need = k + 1 if exclude_self else k
    # Of points sharing one place only the first few ids can ever be among the nearest.
    # The rank filter is applied before the shuffle too, so a pile of copies stays local.
    same_place = Window.partitionBy("x", "y").orderBy("id")
    distinct = points.select("id", "x", "y").withColumn("_r", F.row_number().over(same_place)).filter(F.col("_r") <= need)
    # Queries at one place share one search.
    asked = queries.groupBy("x", "y").agg(F.min("id").alias("id"))
    both = distinct.select(F.lit("r").alias("side"), "id", "x", "y").unionByName(
        asked.select(F.lit("q").alias("side"), "id", "x", "y")
    )
    both = materialize(both, "points")
    placed, tree, depth = _tree(_Frame.around(both).cells(both), leaf_rows)
    shares = min(MOST_SHARES, -(-both.count() // SHARE_ROWS))
    placed = _shared(placed, shares, ["side", "id", "x", "y"], "placed", lambda share: share)
    ref_points = _named(placed, "r")
    ask_points = _named(placed, "q")
    nodes = _named(tree, "r")
    q_key = ["q_d", "q_cx", "q_cy"]
    q_cols = [*q_key, "q_minx", "q_maxx", "q_miny", "q_maxy"]
    r_cols = nodes.columns
    root = nodes.filter(F.col("r_d") == 0).first()
    if root is None:
        return _no_neighbours(queries.select("id"))
    frontier = _named(tree, "q").filter("q_leaf").select(*q_cols).withColumns({c: F.lit(root[c]) for c in r_cols} | {"_bound": F.lit(None).cast("double")})
    for level in range(1, depth + 1):
        children = nodes.filter(F.col("r_d") == level).select(
            F.shiftright("r_cx", 1).alias("_px"), F.shiftright("r_cy", 1).alias("_py"), F.struct(*r_cols).alias("_child")
        )
        # A level has at most 4^level cells: known small near the root, shuffled below.
        side = F.broadcast(children) if level <= BROADCAST_DEPTH else children
        # Leaves match nothing and stay as they are; every other cell has children. Their keys are negative, as no
        # cell's is, and spread: a NULL key would bring all of them into one partition.
        apart = -1 - F.pmod(F.xxhash64(*q_key, "r_cx", "r_cy"), F.lit(1 << 20))
        keyed = frontier.withColumns({f"_p{c}": F.when(~F.col("r_leaf"), F.col(f"r_c{c}")).otherwise(apart) for c in "xy"})
        grown = keyed.join(side, ["_px", "_py"], "left")
        stepped = [F.coalesce(F.col("_child")[c], F.col(c)).alias(c) for c in r_cols]
        frontier = _prune(grown.select(*q_cols, *stepped), q_key, need, max_distance)
        if level % ROUNDS_PER_WRITE == 0 and level < depth:
            frontier = materialize(frontier, "frontier")

    def ranked(part: DataFrame) -> DataFrame:
        # Few cells, much row-level work behind each: a fixed width keeps adaptive execution
        # from packing them into a handful of tasks.
        spread = part.repartition(shuffle_width(points.sparkSession), *q_key)
        pairs = (
            _in_bound(spread.join(ask_points.select(*q_key, "id", "x", "y"), q_key), max_distance)
            .join(
                ref_points.select("r_d", "r_cx", "r_cy", F.col("id").alias("neighbour"), F.col("x").alias("_rx"), F.col("y").alias("_ry")),
                ["r_d", "r_cx", "r_cy"],
            )
        )
        d2 = _square(F.col("x") - F.col("_rx"), F.col("y") - F.col("_ry"))
        # The cell's bound holds enough points for each of its queries: farther rows need no sorting.
        scored = pairs.select("id", "x", "y", "neighbour", d2.alias("_d2"), "_bound").filter(F.col("_bound").isNull() | (F.col("_d2") <= F.col("_bound")))
        scored = scored.drop("_bound")
        if max_distance is not None:
            scored = scored.filter(F.col("_d2") <= max_distance * max_distance)
        w = Window.partitionBy("id").orderBy("_d2", "neighbour")
        return scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= need)

    reached = frontier.select(*q_key, *r_cols, "_bound")
    ranked_rows = _shared(materialize(reached, "reached") if shares > 1 else reached, shares, q_key, "ranked", ranked)
    # At most ``need`` neighbours per place, given back to every query there.
    found = F.array_sort(F.collect_list(F.struct("_r", "neighbour", F.sqrt("_d2").alias("distance"))))
    answers = ranked_rows.groupBy("id").agg(F.first("x").alias("x"), F.first("y").alias("y"), found.alias("_found")).drop("id")
    given = queries.select("id", "x", "y").join(answers, ["x", "y"])
    others = F.filter("_found", lambda n: n["neighbour"] != F.col("id")) if exclude_self else F.col("_found")
    listed = given.select("id", F.posexplode(F.slice(others, 1, k)).alias("_at", "_n"))
    return listed.select("id", (F.col("_at") + 1).alias("rank"), "_n.neighbour", "_n.distance")


def _shared(rows: DataFrame, shares: int, key: list[str], label: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``made`` of ``rows``, written in shares by ``key`` where there are several: the shuffle files of a share go with it."""
    if shares <= 1:
        return made(rows)
    share = F.pmod(F.xxhash64(*key), F.lit(shares))
    return reduce(DataFrame.unionByName, [materialize(made(rows.filter(share == i)), label) for i in range(shares)])


def _prune(frontier: DataFrame, q_key: list[str], need: int, max_distance: float | None) -> DataFrame:
    """Drop cells farther than a distance already known to hold ``need`` points; its square stays as ``_bound``."""
    measured = frontier.withColumns({"_far": max_sq("q", "r"), "_near": min_sq("q", "r")})
    if max_distance is not None:
        measured = measured.filter(F.col("_near") <= max_distance * max_distance)
    by_far = Window.partitionBy(*q_key).orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)
    counted = measured.withColumn("_have", F.sum("r_n").over(by_far))
    enough = F.min(F.when(F.col("_have") >= need, F.col("_far"))).over(Window.partitionBy(*q_key))
    bounded = counted.withColumn("_bound", enough)
    kept = bounded.filter(F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound")))
    return kept.drop("_far", "_near", "_have")


def _in_bound(asked: DataFrame, max_distance: float | None) -> DataFrame:
    """Queries ``x``, ``y`` with the cells that they themselves, not only their cell, reach within the bound."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"r_min{c}") - F.col(c), F.col(c) - F.col(f"r_max{c}")) for c in "xy"]
    near = _square(*gaps)
    kept = asked.filter(F.col("_bound").isNull() | (near <= F.col("_bound")))
    return kept if max_distance is None else kept.filter(near <= max_distance * max_distance)


def _no_neighbours(asked: DataFrame) -> DataFrame:
    return asked.filter(F.lit(False)).select(
        "id", F.lit(0).alias("rank"), F.col("id").alias("neighbour"), F.lit(0.0).alias("distance")
    )


# --- link graph ----------------------------------------------------------------------


def link_edges(points: DataFrame, by: Sequence[str] = (), pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Edges whose connected components are those of the full link graph.

    Points have ``id``, ``x``, ``y`` and a link radius ``rho`` > 0, and two of them are
    linked when their distance is at most the larger radius. Rows with different ``by``
    values never link. Instead of all linked pairs the result holds about one edge per
    row and a few per cell, which connect exactly the same groups.
    """
    members, touching = _links(points, list(by), pair_rows)
    stars = members.filter(F.col("id") != F.col("rep")).select(*by, F.col("id").alias("src"), F.col("rep").alias("dst"))
    return stars.unionByName(touching.distinct())


def _links(points: DataFrame, by: list[str], pair_rows: int) -> tuple[DataFrame, DataFrame]:
    """Each point's cell representative, and edges that join the representatives of linked cells."""
    places = points.groupBy(*by, "x", "y").agg(F.min("id").alias("id"), F.max("rho").alias("rho"))
    band = F.floor(F.log2("rho")).cast("int")
    # A cell's diagonal is below every radius of its band, so its points are all linked.
    side = F.pow(F.lit(2.0), F.col("_band") - 1)
    celled = materialize(
        places.withColumn("_band", band).withColumns(
            {"_cx": F.floor(F.col("x") / side).cast("long"), "_cy": F.floor(F.col("y") / side).cast("long")}
        ),
        "places",
    )
    bands = sorted(r["_band"] for r in celled.select("_band").distinct().collect())  # one per power of two
    key = [*by, "_band", "_cx", "_cy"]
    nodes = materialize(
        celled.groupBy(*key).agg(
            F.count("*").alias("n"), F.min("id").alias("rep"), F.min("rho").alias("rmin"), F.max("rho").alias("rmax"), *_box("b")
        ),
        "nodes",
    )
    homes = celled.select(*key, "x", "y").join(nodes.select(*key, "rep"), key)
    members = points.select(*by, "id", "x", "y").join(homes.select(*by, "x", "y", "rep"), [*by, "x", "y"]).select(*by, "id", "rep")
    return members, _touching(celled, nodes, by, bands, pair_rows)


def _judged(pairs: DataFrame) -> DataFrame:
    """Settle pairs by their bounds: drop the far ones, mark the certain ones."""
    reach = F.greatest("a_rmax", "b_rmax")
    sure = F.greatest("a_rmin", "b_rmin")
    near = pairs.filter(min_sq("a", "b") <= reach * reach)
    return near.withColumn("_linked", max_sq("a", "b") <= sure * sure)


_SIDE = {
    "_band": "band", "_cx": "cx", "_cy": "cy", "n": "n", "rep": "rep", "rmin": "rmin", "rmax": "rmax",
    "b_minx": "minx", "b_maxx": "maxx", "b_miny": "miny", "b_maxy": "maxy",
}


def _tiled(nodes: DataFrame, by: list[str], bands: list[int], tile_rows: int) -> DataFrame:
    """Cells copied to every tile, of their own band or a wider one, whose cells they may link to.

    A tile is 32 x 32 cells of its band, of which a link crosses at most ``CELL_REACH``: few cells are copied. Cells
    far finer than the tile's may be very many there: they are parted, and the tile's own cells meet every part.
    """
    bands_up = F.filter(F.array(*[F.lit(b) for b in bands]), lambda b: b >= F.col("_band"))
    lifted = nodes.withColumn("_gb", F.explode(bands_up))
    for c in "xy":
        lifted = lifted.withColumn(f"_l{c}", F.floor(F.col(f"_c{c}") / F.pow(F.lit(2.0), F.col("_gb") - F.col("_band"))).cast("long"))
    for c in "xy":
        ends = [F.shiftright(F.col(f"_l{c}") + step, TILE_SHIFT) for step in (-CELL_REACH, CELL_REACH)]
        lifted = lifted.withColumn(f"_t{c}", F.explode(F.sequence(*ends)))
    own = (F.col("_gb") == F.col("_band")) & (F.shiftright("_cx", TILE_SHIFT) == F.col("_tx")) & (F.shiftright("_cy", TILE_SHIFT) == F.col("_ty"))
    copies = lifted.withColumn("_own", own)
    # At most rows / limit tiles are parted.
    crowded = copies.groupBy(*by, *_TILE).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("_parts")).filter("_parts > 1")
    part = F.pmod(F.xxhash64("_band", "_cx", "_cy"), F.col("_parts")).cast("int")
    parts = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).when(F.col("_own"), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(part))
    return copies.join(F.broadcast(crowded), [*by, *_TILE], "left").withColumn("_part", F.explode(parts)).drop("_parts")


def _met(rows: pa.Table, by: list[str]) -> pa.Table:
    """Of one tile's cells: a star for each group that surely linked pairs join, and the open pairs between groups.

    A pair that other cells of the tile surely join needs no look at its rows.
    """
    at = {new: rows[old].to_numpy() for old, new in _SIDE.items()}
    lx, ly, own = rows["_lx"].to_numpy(), rows["_ly"].to_numpy(), rows["_own"].to_numpy(zero_copy_only=False)
    gb = int(rows["_gb"][0].as_py())
    names, vertex = np.unique(at["rep"], return_inverse=True)
    order = np.lexsort((ly, lx))
    first, low, wide = lx.min(), ly.min() - CELL_REACH, int(ly.max() - ly.min()) + 2 * CELL_REACH + 1

    def key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x - first) * wide + (y - low)

    held, asking = key(lx[order], ly[order]), np.flatnonzero(own)
    sure, open_pairs = [], []
    for step in range(-CELL_REACH, CELL_REACH + 1):
        # Cells of one column are in order: those within reach are a run of them.
        start = np.searchsorted(held, key(lx[asking] + step, ly[asking] - CELL_REACH), "left")
        end = np.searchsorted(held, key(lx[asking] + step, ly[asking] + CELL_REACH), "right")
        count = end - start
        a = np.repeat(asking, count)
        b = order[np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)]
        ahead = (at["cx"][a] < at["cx"][b]) | ((at["cx"][a] == at["cx"][b]) & (at["cy"][a] < at["cy"][b]))
        kept = (at["band"][b] < gb) | ahead
        a, b = a[kept], b[kept]
        gap, span = np.zeros(len(a)), np.zeros(len(a))
        for c in "xy":
            ab, ba = at[f"min{c}"][a] - at[f"max{c}"][b], at[f"min{c}"][b] - at[f"max{c}"][a]
            gap += np.maximum(0.0, np.maximum(ab, ba)) ** 2
            span += np.minimum(ab, ba) ** 2
        near = gap <= np.maximum(at["rmax"][a], at["rmax"][b]) ** 2
        linked = span <= np.maximum(at["rmin"][a], at["rmin"][b]) ** 2
        for found, mask in ((sure, near & linked), (open_pairs, near & ~linked)):
            found.append(np.stack((a[mask], b[mask])))
    label = _least_joined(len(names), *vertex[np.concatenate(sure, axis=1)])
    a, b = np.concatenate(open_pairs, axis=1)
    apart = label[vertex[a]] != label[vertex[b]]
    a, b = a[apart], b[apart]
    leaves = np.flatnonzero(label != np.arange(len(names)))
    made: dict[str, pa.Array] = {"_linked": pa.array(np.repeat([True, False], [len(leaves), len(a)]))}
    for side, star, cells in (("a", leaves, a), ("b", label[leaves], b)):
        for old, new in _SIDE.items():
            kind = rows.schema.field(old).type
            head = pa.array(names[star], kind) if new == "rep" else pa.nulls(len(star), kind)
            made[f"{side}_{new}"] = pa.concat_arrays([head, pa.array(at[new][cells], kind)])
    for c in by:
        made[c] = rows[c].take(pa.array(np.zeros(len(leaves) + len(a), np.int64)))
    return pa.table(made)


def _least_joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest vertex of each component of the edges u - v on vertices 0 .. n - 1."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        # Every label hangs on the least smaller one it touches.
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label[label], label):
            label = label[label]
    return label


def _touching(celled: DataFrame, nodes: DataFrame, by: list[str], bands: list[int], pair_rows: int) -> DataFrame:
    """Edges between representatives that join all cells with at least one link between them.

    Cells meet tile by tile; only pairs that no sure links of their tile join are opened.
    """
    fields = [*[nodes.schema[c] for c in by], *[T.StructField(f"{s}_{new}", nodes.schema[old].dataType) for s in "ab" for old, new in _SIDE.items()]]
    schema = T.StructType([*fields, T.StructField("_linked", T.BooleanType())])
    tiles = _tiled(nodes, by, bands, TILE_ROWS).groupBy(*by, *_TILE, "_part")
    current = materialize(tiles.applyInArrow(lambda rows: _met(rows, by).select(schema.names), schema), "pairs")

    pair = [*by, "a_band", "a_cx", "a_cy", "b_band", "b_cx", "b_cy"]
    edge = [*by, F.col("a_rep").alias("src"), F.col("b_rep").alias("dst")]
    found = [current.filter("_linked").select(*edge)]
    open_pairs = current.filter(~F.col("_linked")).withColumns(
        {"a_sx": F.col("a_cx"), "a_sy": F.col("a_cy"), "b_sx": F.col("b_cx"), "b_sy": F.col("b_cy")}
    )
    depth = 0
    while True:
        small = F.lit(True) if depth == LINK_DEPTH else (F.col("a_n") * F.col("b_n") <= pair_rows)
        found.append(_compare(open_pairs.filter(small), celled, by, depth).select(*edge))
        heavy = open_pairs.filter(~small)
        if depth == LINK_DEPTH or heavy.isEmpty():
            break
        depth += 1
        children = _children(celled, by, depth)
        split = heavy
        for s in ("a", "b"):
            keep = [c for c in split.columns if not c.startswith(f"{s}_") or c in (*pair, f"{s}_rep")]
            link = [*by, f"{s}_band", f"{s}_cx", f"{s}_cy"]
            parent = split.select(*keep, F.col(f"{s}_sx").alias("_px"), F.col(f"{s}_sy").alias("_py"))
            named = children.select(
                *by,
                *[F.col(o).alias(f"{s}_{n}") for o, n in (
                    ("_band", "band"), ("_cx", "cx"), ("_cy", "cy"), ("_sx", "sx"), ("_sy", "sy"), ("n", "n"),
                    ("rmin", "rmin"), ("rmax", "rmax"), ("b_minx", "minx"), ("b_maxx", "maxx"), ("b_miny", "miny"), ("b_maxy", "maxy"),
                )],
            ).withColumns({"_px": F.shiftright(f"{s}_sx", 1), "_py": F.shiftright(f"{s}_sy", 1)})
            split = parent.join(named, [*link, "_px", "_py"]).drop("_px", "_py")
        judged = materialize(_judged(split.drop("_linked")), "split")
        linked = judged.filter("_linked")
        found.append(linked.select(*edge))
        # A cell pair needs one link only; its other open parts are settled with it.
        open_pairs = judged.filter(~F.col("_linked")).join(linked.select(*pair).distinct(), pair, "left_anti")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def _sub_cells(celled: DataFrame, depth: int) -> DataFrame:
    side = F.pow(F.lit(2.0), F.col("_band") - 1 - depth)
    return celled.withColumns(
        {"_sx": F.floor(F.col("x") / side).cast("long"), "_sy": F.floor(F.col("y") / side).cast("long")}
    )


def _children(celled: DataFrame, by: list[str], depth: int) -> DataFrame:
    return _sub_cells(celled, depth).groupBy(*by, "_band", "_cx", "_cy", "_sx", "_sy").agg(
        F.count("*").alias("n"), F.min("id").alias("rep"), F.min("rho").alias("rmin"), F.max("rho").alias("rmax"), *_box("b")
    )


def _compare(small: DataFrame, celled: DataFrame, by: list[str], depth: int) -> DataFrame:
    """Row-level test of the pairs of small cells."""
    rows = _sub_cells(celled, depth)
    out = small.select(*by, *[f"{s}_{c}" for s in "ab" for c in ("band", "cx", "cy", "sx", "sy", "rep")])
    for s in "ab":
        named = rows.select(
            *by,
            *[F.col(f"_{c}").alias(f"{s}_{c}") for c in ("band", "cx", "cy", "sx", "sy")],
            *[F.col(c).alias(f"{s}_{c}") for c in ("x", "y", "rho")],
        )
        out = out.join(named, [*by, *[f"{s}_{c}" for c in ("band", "cx", "cy", "sx", "sy")]])
    radius = F.greatest("a_rho", "b_rho")
    hit = _square(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")) <= radius * radius
    return out.filter(hit).select(*by, "a_rep", "b_rep").distinct()


# --- connected components -------------------------------------------------------------


def components(edges: DataFrame, by: Sequence[str] = (), max_rounds: int = 60) -> DataFrame:
    """Smallest id of each connected component: ``by``, ``id``, ``label``, one row per edge end.

    Alternating large-star and small-star contraction (Kiveris et al. 2014): every step is
    a grouped minimum and an equi-join, no neighbourhood is ever collected, and the number
    of rounds grows with the logarithm of the graph. Each round is written out, so a lost
    executor costs at most one round.
    """
    by = list(by)
    pairs = edges.select(*by, F.col("src").alias("u"), F.col("dst").alias("v"))
    ends = pairs.select(*by, F.col("u").alias("id")).union(pairs.select(*by, F.col("v").alias("id"))).distinct()
    stars = materialize(pairs.filter(F.col("u") != F.col("v")).distinct(), "stars")
    for _ in range(max_rounds):
        before, stars = stars, materialize(_small_star(_large_star(stars, by), by), "stars")
        discard(before)
        if _settled(stars, by):
            break
    else:
        raise RuntimeError("components did not settle")
    labels = stars.select(*by, F.col("u").alias("id"), F.col("v").alias("label"))
    return ends.join(labels, [*by, "id"], "left").select(*by, "id", F.coalesce("label", "id").alias("label"))


def _settled(stars: DataFrame, by: list[str]) -> bool:
    """Every vertex hangs on one centre and no centre hangs on another."""
    up = stars.select(*by, F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("centre"))
    down = stars.select(*by, F.col("v").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("centre"))
    roles = up.union(down).groupBy(*by, "id").agg(F.sum("below").alias("below"), F.max("centre").alias("centre"))
    return roles.filter((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("centre") == 1))).isEmpty()


def _large_star(edges: DataFrame, by: list[str]) -> DataFrame:
    both = edges.select(*by, "u", "v").union(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*by, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.filter(F.col("v") > F.col("u")).join(least, [*by, "u"])
    return moved.select(*by, F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))


def _small_star(edges: DataFrame, by: list[str]) -> DataFrame:
    down = edges.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(*by, "u").agg(F.min("v").alias("m"))
    moved = down.join(least, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select(*by, "u", F.col("m").alias("v"))
    return moved.union(kept).filter(F.col("u") != F.col("v")).distinct()


def link_components(points: DataFrame, by: Sequence[str] = (), pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Component label (smallest id) of every point of the link graph, isolated points included."""
    by = list(by)
    members, touching = _links(points, by, pair_rows)
    hung = _hung(touching, by)
    # Only what stands at the head of a tile's stars enters the contraction.
    heads = components(hung.filter(F.col("t") != F.col("m")).select(*by, F.col("t").alias("src"), F.col("m").alias("dst")).distinct(), by)
    least = hung.groupBy(*by, "v").agg(F.min("m").alias("m"))
    named = heads.select(*by, F.col("id").alias("m"), "label")
    labels = least.join(named, [*by, "m"], "left").select(*by, F.col("v").alias("rep"), F.coalesce("label", "m").alias("label"))
    return members.join(labels, [*by, "rep"], "left").select(*by, "id", F.coalesce("label", "rep").alias("label"))


def _hung(edges: DataFrame, by: list[str]) -> DataFrame:
    """Each vertex ``v``, what it hangs on (``t``, below it; itself, if others hang on it), and the least of these, ``m``.

    Edges t - m and the hanging of v on m have the same components as ``edges``.
    """
    down = edges.select(*by, F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("t"))
    heads = down.select(*by, F.col("t").alias("v"), "t").distinct()
    least = F.min("t").over(Window.partitionBy(*by, "v"))
    return materialize(down.unionByName(heads).withColumn("m", least), "hung")
