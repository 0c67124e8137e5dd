"""Density clustering over a grid.

The space is cut into cells small enough that two points of one cell are always within
``eps`` of each other. A cell with ``min_samples`` points then holds core points only, and
all core points of a cell share a cluster, so nothing is ever compared inside a cell: a
dense spot, or one point repeated a million times, is one cell. Points are compared only
between cells close to each other, and only where the cells alone do not decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import ref
from ..functions.ordered import running_totals
from ..session import cut_lineage

# Neighbouring cells are found over at most this many leading dimensions, and all
# dimensions are checked afterwards.
_GRID_DIMENSIONS = 3
_PROBES = 16


def _spread(df: DataFrame) -> DataFrame:
    """Join ``df``, which holds a row per point, by a shuffle, never by a broadcast.

    Point tables read back from parquet compress to a few megabytes, so the planner would
    send them whole through the driver, however many points they hold.
    """
    return df.hint("merge")


def _squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def dbscan(df: DataFrame, keys: list[str], point: str, eps: float, min_samples: int) -> DataFrame:
    """(keys, cluster_label): clusters numbered by their smallest key, −1 for noise.

    A point counts among its own neighbours. A border point in reach of several clusters
    gets the smallest label.
    """
    size = df.select(F.size(ref(point)).alias("d")).first()
    if size is None:
        return df.select(*map(ref, keys), F.lit(-1).alias("cluster_label"))
    dims = size["d"]
    # A hair below the limit, so that rounding cannot put two points of a cell out of reach.
    side = eps / dims**0.5 * (1 - 1e-9)
    cell = F.transform(F.col("p"), lambda v: F.floor(v / F.lit(side)))
    points = df.select(F.struct(*map(ref, keys)).alias("id"), ref(point).alias("p")).withColumn("cell", cell)
    points = cut_lineage(points)
    cells = points.groupBy("cell").agg(F.count("*").alias("n"))
    near = cut_lineage(_near_cells(cells, dims, side, eps))
    core = cut_lineage(_core_points(points, cells, near, eps, min_samples))
    links = _linked_cells(core, near, eps)
    clusters = _components(core.select("cell").distinct(), links)
    return _label(points, core, clusters, near, keys, eps)


def _near_cells(cells: DataFrame, dims: int, side: float, eps: float) -> DataFrame:
    """(a, b) of different cells whose boxes come within ``eps`` of each other."""
    used = min(dims, _GRID_DIMENSIONS)
    block = max(1, int(eps // side) + 1)
    blocks = F.array(*[F.floor(F.col("cell")[i] / block) for i in range(used)])
    own = cells.select(F.col("cell").alias("a"), blocks.alias("block"))
    offsets = [[]]
    for _ in range(used):
        offsets = [o + [s] for o in offsets for s in (-1, 0, 1)]
    around = F.array(*[F.array(*[F.lit(s).cast("long") for s in o]) for o in offsets])
    reach = cells.select(F.col("cell").alias("b"), blocks.alias("at"), F.explode(around).alias("step"))
    reach = reach.select("b", F.zip_with("at", "step", lambda x, s: x + s).alias("block"))
    met = own.join(reach, "block").where(F.col("a") != F.col("b"))
    gap = F.zip_with("a", "b", lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)).cast("double") * side)
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return met.where(apart <= eps * eps).select("a", "b")


def _core_points(points, cells, near, eps, min_samples) -> DataFrame:
    """(id, p, cell) of points with enough neighbours; full cells need no distances."""
    full = cells.where(F.col("n") >= min_samples).select("cell")
    sparse = cells.where(F.col("n") < min_samples)
    sure = points.join(full, "cell", "left_semi")
    asked = _spread(points).join(sparse, "cell")
    others = points.select(F.col("p").alias("q"), F.col("cell").alias("b"))
    tries = _spread(asked).join(near, F.col("cell") == F.col("a")).drop("a").join(_spread(others), "b")
    close = tries.where(_squared_distance(F.col("p"), F.col("q")) <= eps * eps)
    counts = close.groupBy("id").agg(F.count("*").alias("met"))
    found = asked.join(_spread(counts), "id", "left").where(F.col("n") + F.coalesce("met", F.lit(0)) >= min_samples)
    return sure.select("id", "p", "cell").unionByName(found.select("id", "p", "cell"))


def _linked_cells(core: DataFrame, near: DataFrame, eps: float) -> DataFrame:
    """(a, b) of cells with core points within ``eps``.

    A few probes per cell settle most pairs. The pairs left are decided by all their core
    points, less those too far from the box around the other cell's core points.
    """
    limit = eps * eps
    boxes = core.groupBy("cell").agg(F.count("*").alias("n"), *_box(core))
    pairs = near.where(F.col("a") < F.col("b"))
    pairs = pairs.join(boxes.select(F.col("cell").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high")), "a")
    pairs = pairs.join(boxes.select(F.col("cell").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high")), "b")
    pairs = cut_lineage(pairs)
    # The probes with the smallest hashes; min_by keeps at most _PROBES entries per cell.
    spread = core.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(_PROBES)))
    probes = spread.groupBy("cell", "slot").agg(F.min_by("p", F.xxhash64("id")).alias("p"))
    left = pairs.select("a", "b").join(probes.select(F.col("cell").alias("a"), "p"), "a")
    both = left.join(probes.select(F.col("cell").alias("b"), F.col("p").alias("q")), "b")
    settled = cut_lineage(both.where(_squared_distance(F.col("p"), F.col("q")) <= limit).select("a", "b").distinct())
    open_pairs = pairs.join(settled, ["a", "b"], "left_anti")
    ours = open_pairs.join(_spread(core.select(F.col("cell").alias("a"), "p")), "a")
    ours = ours.where(_box_distance(F.col("p"), F.col("b_low"), F.col("b_high")) <= limit).select("a", "b", "p")
    theirs = open_pairs.join(_spread(core.select(F.col("cell").alias("b"), F.col("p").alias("q"))), "b")
    theirs = theirs.where(_box_distance(F.col("q"), F.col("a_low"), F.col("a_high")) <= limit).select("a", "b", "q")
    decided = _spread(ours).join(_spread(theirs), ["a", "b"]).where(_squared_distance(F.col("p"), F.col("q")) <= limit)
    return settled.unionByName(decided.select("a", "b").distinct())


def _box(core: DataFrame) -> list[Column]:
    dims = core.select(F.size("p").alias("d")).first()
    count = dims["d"] if dims else 0
    return [
        F.array(*[F.min(F.col("p")[i]) for i in range(count)]).alias("low"),
        F.array(*[F.max(F.col("p")[i]) for i in range(count)]).alias("high"),
    ]


def _box_distance(p: Column, low: Column, high: Column) -> Column:
    under = F.zip_with(low, p, lambda a, v: F.greatest(a - v, F.lit(0.0)))
    over = F.zip_with(p, high, lambda v, b: F.greatest(v - b, F.lit(0.0)))
    out = F.zip_with(under, over, lambda x, y: x + y)
    return F.aggregate(out, F.lit(0.0), lambda s, v: s + v * v)


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cell, root): each cell with the smallest cell it is linked to over any path.

    Every round takes the smallest label around, then follows labels one step further; the
    rounds needed grow with the logarithm of the longest path. Labels are written to the
    checkpoint folder each round.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut_lineage(edges)
    labels = cut_lineage(nodes.select("cell", F.col("cell").alias("root")))
    while True:
        around = edges.join(labels.withColumnRenamed("cell", "b"), "b").groupBy("a").agg(F.min("root").alias("seen"))
        lower = labels.join(around, F.col("cell") == F.col("a"), "left").select(
            "cell", F.col("root").alias("old"), F.least("root", "seen").alias("root")
        )
        ahead = lower.select(F.col("cell").alias("root"), F.col("root").alias("next"))
        stepped = lower.join(ahead, "root").select(
            "cell", "old", F.least("root", "next").alias("root")
        )
        stepped = cut_lineage(stepped)
        changed = stepped.where(F.col("old") != F.col("root")).limit(1).count()
        labels = stepped.select("cell", "root")
        if not changed:
            return labels


def _label(points, core, clusters, near, keys, eps) -> DataFrame:
    members = _spread(core).join(clusters, "cell")
    # Clusters are numbered by their smallest key.
    firsts = members.groupBy("root").agg(F.min("id").alias("first"))
    members = cut_lineage(members.join(_numbered(firsts), "root").select("id", "p", "cell", "cluster_label"))
    rest = points.join(_spread(members), "id", "left_anti")
    inside = members.groupBy("cell").agg(F.min("cluster_label").alias("own"))
    rest = rest.join(inside, "cell", "left")
    others = members.select(F.col("p").alias("q"), F.col("cell").alias("b"), F.col("cluster_label").alias("other"))
    tries = _spread(rest.where("own is null")).join(near, F.col("cell") == F.col("a")).join(_spread(others), "b")
    # A point of a cell with core points may still reach a cluster with a smaller number.
    also = _spread(rest.where("own is not null")).join(near, F.col("cell") == F.col("a")).join(_spread(others), "b")
    also = also.where(F.col("other") < F.col("own"))
    close = tries.unionByName(also).where(_squared_distance(F.col("p"), F.col("q")) <= eps * eps)
    border = close.groupBy("id").agg(F.min("other").alias("reached"))
    labelled = rest.join(_spread(border), "id", "left").select(
        "id", F.coalesce(F.least("own", "reached"), F.lit(-1)).alias("cluster_label")
    )
    result = members.select("id", "cluster_label").unionByName(labelled)
    return result.select(*[F.col("id")[k].alias(k) for k in keys], F.col("cluster_label").cast("int").alias("cluster_label"))


def _numbered(firsts: DataFrame) -> DataFrame:
    """(root, cluster_label): position of each cluster by its first key."""
    fields = firsts.schema["first"].dataType.fieldNames()
    lead = fields[0]
    flat = firsts.select("root", F.col("first")[lead].alias("__lead"), F.col("first"))
    totals = running_totals(flat.groupBy("__lead").agg(F.count("*").alias("n")), "__lead", {"before": F.col("n")})
    within = W.partitionBy("__lead").orderBy("first")
    joined = flat.join(totals.select("__lead", "before"), "__lead")
    return joined.select("root", (F.col("before") + F.row_number().over(within) - 1).cast("int").alias("cluster_label"))

