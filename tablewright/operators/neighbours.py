"""Fill missing numbers from the nearest rows, exactly and without a cross join.

Rows with equal features collapse into one weighted location on both sides.
Donor locations are cut into boxes of bounded size. A query first visits its
closest box, which gives a radius, and then just the boxes that reach into that
radius; a box answers with the nearest few donors, never with pairs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.errors import PrepareError
from tablewright.functions.kinds import number, ref
from tablewright.operators.fused import scalars
from tablewright.session import broadcast_if_small, held

# Fixed value: neighbours averaged.
NEIGHBOURS = 5
# Donor locations per box and queries per task aimed at.
BOX_ROWS = 20_000
QUERY_ROWS = 50_000
# Distances held at once by a task.
BLOCK_CELLS = 2_000_000
# Donor locations per cell of a box, and queries from which cells are worth their cutting.
CELL_ROWS = 100
CELL_QUERIES = 16
# Patterns of gaps are bits of a whole number.
MOST_FEATURES = 62
# Locations looked at per box when the cuts are chosen.
CUT_SAMPLE = 32


def _locations(df: DataFrame, features: list[str]) -> DataFrame:
    """Distinct feature rows with their number, as ``f`` (array) and ``loc`` (text)."""
    cells = F.array(*[number(df, c) + F.lit(0.0) for c in features])
    as_text = F.array_join(F.transform("f", lambda x: x.cast("string")), ",", "null")
    return (
        df.select(cells.alias("f"))
        .groupBy("f")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("loc", as_text)
    )


def _cut(points, boxes: int, useful=None) -> list[tuple]:
    """Split points at medians, widest side first: ``(dim, at, left, right)`` nodes.

    A leaf is ``(-1, leaf number, 0, 0)``. Sides not ``useful`` are cut only where the
    others have no spread left.
    """
    import numpy as np

    nodes: list[list] = []
    leaves = 0

    def grow(rows, share) -> int:
        nonlocal leaves
        place = len(nodes)
        nodes.append([-1, 0.0, 0, 0])
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(points.shape[1])
        if useful is not None and spread[useful].any():
            spread = np.where(useful, spread, 0.0)
        dim = int(np.argmax(spread)) if len(spread) else 0
        if share <= 1 or len(rows) < 2 or spread[dim] == 0:
            nodes[place][1] = leaves
            leaves += 1
            return place
        at = float(np.median(rows[:, dim]))
        right = rows[:, dim] > at
        if not right.any():
            at = float(rows[:, dim][rows[:, dim] < at].max())
            right = rows[:, dim] > at
        node = [dim, at, grow(rows[~right], share / 2), grow(rows[right], share / 2)]
        nodes[place] = node
        return place

    grow(points, boxes)
    return [tuple(n) for n in nodes]


def _leaf_of(points, nodes):
    import numpy as np

    out = np.zeros(len(points), dtype="int64")
    stack = [(0, np.arange(len(points)))]
    while stack:
        place, rows = stack.pop()
        dim, at, left, right = nodes[place]
        if dim < 0:
            out[rows] = int(at)
            continue
        upper = points[rows, dim] > at
        stack += [(left, rows[~upper]), (right, rows[upper])]
    return out


def _nearest_in_cells(donors, asked, k: int, scale: tuple[int, int]):
    """Donors as near as each row's ``k``-th, and maybe more: yields rows asked, donors, distances.

    ``scale`` is the number of features and of those shared. Donors are cut into small cells. Some donors of a row's closest cell give a radius, and
    only the donors of cells that reach into it are looked at.
    """
    import numpy as np

    def distances(rows, found):
        total = np.zeros(found.shape)
        for i in range(donors.shape[1]):
            gap = asked[rows, i] - donors[found, i]
            total += gap * gap
        return total * scale[0] / scale[1]

    leaf = _leaf_of(donors, _cut(donors, -(-len(donors) // CELL_ROWS)))
    order = np.argsort(leaf, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(leaf[order]) > 0])
    sizes = np.diff(np.r_[starts, len(order)])
    low, high = np.minimum.reduceat(donors[order], starts), np.maximum.reduceat(donors[order], starts)
    block = max(1, BLOCK_CELLS // max(len(starts), CELL_ROWS))
    for first in range(0, len(asked), block):
        rows = np.arange(first, min(first + block, len(asked)))
        apart = np.zeros((len(rows), len(starts)))
        for i in range(donors.shape[1]):
            v = asked[rows, i][:, None]
            gap = np.maximum(np.maximum(low[:, i] - v, v - high[:, i]), 0.0)
            apart += gap * gap
        apart = apart * scale[0] / scale[1]
        home = apart.argmin(axis=1)
        place = np.arange(max(k, CELL_ROWS // 2))
        known = distances(rows[:, None], order[starts[home][:, None] + np.minimum(place, sizes[home][:, None] - 1)])
        known[place >= sizes[home][:, None]] = np.inf
        radius = np.partition(known, k - 1, axis=1)[:, k - 1]
        at, cell = np.nonzero(apart <= radius[:, None] * (1 + 1e-9))
        # as many rows at a time as their donors allow
        portion = np.cumsum(sizes[cell]) // BLOCK_CELLS
        edges = np.unique(np.r_[0, np.searchsorted(at, at[np.flatnonzero(np.diff(portion)) + 1]), len(at)])
        for a, b in zip(edges, edges[1:]):
            n = sizes[cell[a:b]]
            here = np.repeat(at[a:b], n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found = order[np.repeat(starts[cell[a:b]], n) + inside]
            distance = distances(rows[here], found)
            near = distance <= radius[here]
            yield rows[here[near]], found[near], distance[near]


def nearest_fill(
    df: DataFrame, columns: Iterable[str], donors: DataFrame | None = None, k: int = NEIGHBOURS
) -> DataFrame:
    """Replace missing numbers by the mean over the ``k`` nearest rows that have them.

    The squared distance is taken over the features both rows have and scaled by
    all features over shared features. Equally near donors are taken in order of
    their value. Without any comparable donor the column mean is used.
    """
    import numpy as np
    import pandas as pd

    features = list(columns)
    d = len(features)
    if d > MOST_FEATURES:
        raise PrepareError("too many features to tell patterns of gaps apart", {"most": MOST_FEATURES})
    source = df if donors is None else donors
    means = scalars(source, {c: F.avg(number(source, c)) for c in features})
    wide = df.withColumns({c: number(df, c) for c in features})
    pattern = sum((F.col("f")[i].isNotNull().cast("long") * (1 << i) for i in range(d)), F.lit(0).cast("long"))
    # to Python features go as plain columns, which cost far less than arrays
    cols = [f"_f{i}" for i in range(d)]
    flat = [F.col("f")[i].alias(c) for i, c in enumerate(cols)]
    doubles = ", ".join(f"{c} double" for c in cols)
    places = held(_locations(source, features).drop("loc").withColumn("p", pattern))
    queries = _locations(df, features).withColumn("p", pattern).filter(F.col("p") < (1 << d) - 1)
    queries = held(queries.select("loc", "f", "p"))
    sizes = {r["p"]: r["n"] for r in places.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}

    # cuts per pattern, from a hash-ordered selection of its locations, along what the queries have
    seen = queries.agg(F.bit_or("p")).first()[0] or 0
    trees: dict[int, tuple[list[int], list[tuple]]] = {}
    for p, size in sizes.items():
        dims = [i for i in range(d) if p >> i & 1]
        boxes = max(1, -(-size // BOX_ROWS))
        if boxes == 1 or not dims:
            trees[p] = (dims, [(-1, 0.0, 0, 0)])
            continue
        chosen = (
            places.filter(F.col("p") == p).orderBy(F.xxhash64("f"), "f").limit(CUT_SAMPLE * boxes)
        )
        rows = np.array([[r["f"][i] for i in dims] for r in chosen.select("f").collect()])
        trees[p] = (dims, _cut(rows, boxes, np.array([bool(seen >> i & 1) for i in dims])))
    first_box, total = {}, 0
    for p, (_, nodes) in trees.items():
        first_box[p] = total
        total += sum(1 for n in nodes if n[0] < 0)

    def assign(batches):
        for batch in batches:
            vectors = batch[cols].to_numpy(dtype="float64")
            box = np.zeros(len(batch), dtype="int64")
            for p in batch["p"].unique():
                rows = np.flatnonzero(batch["p"].to_numpy() == p)
                dims, nodes = trees[p]
                box[rows] = first_box[p] + _leaf_of(vectors[np.ix_(rows, dims)], nodes)
            yield batch.assign(box=box)[["box", *cols, "n"]]

    boxed = held(places.select(*flat, "n", "p").mapInPandas(assign, f"box long, {doubles}, n long"))
    corners = boxed.groupBy("box").agg(
        F.array(*[F.min(c) for c in cols]).alias("low"), F.array(*[F.max(c) for c in cols]).alias("high")
    )
    # one row per box
    corner = {
        r["box"]: (np.array(r["low"], dtype="float64"), np.array(r["high"], dtype="float64"))
        for r in corners.collect()
    }

    def by_case(vectors, targets):
        """Rows with the same gaps that ask for the same feature."""
        masks = np.isnan(vectors) @ (1 << np.arange(d))
        for mask in np.unique(masks):
            for target in np.unique(targets[masks == mask]):
                yield (1 << d) - 1 - int(mask), int(target), np.flatnonzero((masks == mask) & (targets == target))

    def comparable(q, target):
        return [p for p in trees if p >> target & 1 and p & q]

    def at_home(vectors, targets):
        """One box per row: where the row falls in the largest fitting pattern."""
        for q, target, rows in by_case(vectors, targets):
            patterns = comparable(q, target)
            if patterns:
                p = max(patterns, key=lambda p: (sizes[p], p))
                dims, nodes = trees[p]
                yield rows, first_box[p] + _leaf_of(vectors[np.ix_(rows, dims)], nodes)

    def in_reach(vectors, targets, radius):
        """Every box that comes as near as the radius, found down the cuts."""
        for q, target, rows in by_case(vectors, targets):
            for p in comparable(q, target):
                dims, nodes = trees[p]
                scale = d / bin(p & q).count("1")
                stack = [(0, rows, np.zeros((len(rows), len(dims))))]
                while stack:
                    place, at_node, offsets = stack.pop()
                    dim, at, left, right = nodes[place]
                    if dim < 0:
                        box = first_box[p] + int(at)
                        if box in corner:
                            low, high = corner[box]
                            v = vectors[at_node]
                            gap = np.nan_to_num(np.maximum(np.maximum(low - v, v - high), 0.0))
                            near = (gap * gap).sum(axis=1) * scale <= radius[at_node]
                            yield at_node[near], np.full(near.sum(), box)
                        continue
                    beyond = np.nan_to_num(vectors[at_node, dims[dim]] - at)
                    for child, away in ((left, np.maximum(beyond, 0.0)), (right, np.maximum(-beyond, 0.0))):
                        moved = offsets.copy()
                        moved[:, dim] = np.maximum(moved[:, dim], away)
                        near = (moved * moved).sum(axis=1) * scale <= radius[at_node]
                        if near.any():
                            stack.append((child, at_node[near], moved[near]))

    def route(first: bool):
        def run(batches):
            for batch in batches:
                vectors = batch[cols].to_numpy(dtype="float64")
                targets = batch["target"].to_numpy()
                if first:
                    hits = at_home(vectors, targets)
                else:
                    radius = batch["radius"].to_numpy(dtype="float64")
                    radius = np.where(np.isnan(radius), np.inf, radius * (1 + 1e-9))
                    hits = in_reach(vectors, targets, radius)
                for rows, boxes in hits:
                    yield batch.iloc[rows].assign(box=boxes)[["box", "loc", *cols, "target"]]

        return run

    def answer(query, donor):
        """Nearest donors of one box for its queries; at most ``k`` rows a query."""
        columns = ["loc", "target", "distance", "value", "n"]
        if query.empty or donor.empty:
            return pd.DataFrame({c: [] for c in columns})
        donor_f = donor[cols].to_numpy(dtype="float64")
        donor_n = donor["n"].to_numpy()
        here = ~np.isnan(donor_f[0])  # one pattern a box
        places = query["loc"].to_numpy()
        vectors = query[cols].to_numpy(dtype="float64")
        targets = query["target"].to_numpy()
        block = max(1, BLOCK_CELLS // len(donor_f))
        parts = []

        def as_matrix(asked, donors):
            """All distances, for few queries or few donors."""
            for start in range(0, len(asked), block):
                some = asked[start : start + block]
                distance = np.zeros((len(some), len(donors)))
                for i in range(donors.shape[1]):
                    gap = some[:, i][:, None] - donors[:, i]
                    distance += gap * gap
                distance = distance * d / donors.shape[1]
                if len(donors) > k:
                    near = distance <= np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
                else:
                    near = np.ones(distance.shape, dtype=bool)
                at, found = np.nonzero(near)
                yield at + start, found, distance[at, found]

        # queries of one target and one pattern of gaps look for donors together
        for _, target, rows in by_case(vectors, targets):
            values = donor_f[:, target]
            shared = np.flatnonzero(here & ~np.isnan(vectors[rows[0]]))
            asked, donors = vectors[np.ix_(rows, shared)], donor_f[:, shared]
            many = len(rows) >= CELL_QUERIES and len(donors) > 2 * CELL_ROWS
            if many and np.isfinite(asked).all() and np.isfinite(donors).all():
                hits = _nearest_in_cells(donors, asked, k, (d, len(shared)))
            else:
                hits = as_matrix(asked, donors)
            for at, found, apart in hits:
                order = np.lexsort((values[found], apart, at))
                at, found, apart = at[order], found[order], apart[order]
                kept = np.arange(len(at)) - np.searchsorted(at, at) < k
                at, found, apart = at[kept], found[kept], apart[kept]
                parts.append((places[rows[at]], np.full(len(at), target), apart, values[found], donor_n[found]))
        return pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(columns)})

    def visit(routed: DataFrame) -> DataFrame:
        # a box with many queries is copied and its queries spread over the copies
        loads = routed.groupBy("box").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(float(QUERY_ROWS))).cast("long").alias("copies")
        )
        loads = broadcast_if_small(held(loads))  # one row per box
        copy = F.pmod(F.xxhash64("loc", "target"), F.col("copies"))
        asked_here = routed.join(loads, "box").withColumn("copy", copy).drop("copies")
        copied = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
        donors_here = boxed.join(loads, "box").select("box", *cols, "n", copied)
        return (
            asked_here.groupBy("box", "copy")
            .cogroup(donors_here.groupBy("box", "copy"))
            .applyInPandas(answer, "loc string, target int, distance double, value double, n long")
        )

    routed_schema = f"box long, loc string, {doubles}, target int"
    order = Window.partitionBy("loc", "target").orderBy("distance", "value")
    earlier = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    gaps_of = F.filter(F.transform("f", lambda x, i: F.when(x.isNull(), i)), lambda i: i.isNotNull())
    asked = queries.select("loc", *flat, F.explode(gaps_of).alias("target"))
    home = held(visit(held(asked.mapInPandas(route(True), routed_schema))))
    # distance of the k-th donor in the home box; none when it has fewer
    radius = (
        home.withColumn("_before", earlier)
        .groupBy("loc", "target")
        .agg(
            F.max(F.when(F.col("_before") < k, F.col("distance"))).alias("radius"),
            F.sum("n").alias("found"),
        )
        .select("loc", "target", F.when(F.col("found") >= k, F.col("radius")).alias("radius"))
    )
    asked = asked.join(radius, ["loc", "target"], "left")
    if total > 1:
        routed = held(
            asked.select("loc", *cols, "target", "radius").mapInPandas(route(False), routed_schema)
        )
        nearest = visit(routed)
    else:
        nearest = home
    # at most k rows per box visited
    taken = nearest.withColumn(
        "take", F.least(F.col("n"), F.greatest(F.lit(k) - earlier, F.lit(0)))
    )
    fills = taken.groupBy("loc", "target").agg(
        (F.sum(F.col("value") * F.col("take")) / F.sum("take")).alias("fill")
    )
    by_location = fills.groupBy("loc").agg(
        *[F.max(F.when(F.col("target") == i, F.col("fill"))).alias(f"_fill{i}") for i in range(d)]
    )
    loc = F.array_join(
        F.transform(F.array(*[ref(c) + F.lit(0.0) for c in features]), lambda x: x.cast("string")), ",", "null"
    )
    gaps = sum((ref(c).isNull().cast("int") for c in features), F.lit(0)) > 0
    # rows of one location may be very many: spread them over copies of its fills
    spread = F.pmod(F.xxhash64(*[ref(c) for c in wide.columns]), F.lit(16)).cast("int")
    keyed = wide.withColumns({"_loc": F.when(gaps, loc), "_copy": spread})
    whole = keyed.filter("_loc IS NULL").drop("_loc", "_copy")
    spread_fills = by_location.select(
        F.col("loc").alias("_l"), *[f"_fill{i}" for i in range(d)],
        F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_c"),
    )
    broken = keyed.filter("_loc IS NOT NULL").join(
        spread_fills, (F.col("_loc") == F.col("_l")) & (F.col("_copy") == F.col("_c")), "left"
    )
    filled = broken.select(
        *[
            F.coalesce(ref(c), F.col(f"_fill{features.index(c)}"), F.lit(means[c]).cast("double")).alias(c)
            if c in features
            else ref(c)
            for c in wide.columns
        ]
    )
    return whole.unionByName(filled)
