"""Near copies among embeddings: an exact metric range join.

For unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c),
so links are a range join in a metric space. Pivots divide the vectors into
cells, each vector being at home with its nearest pivot. A linked pair with homes
i < j is found in cell i, so a vector is replicated into a lower cell unless the
triangle inequality rules out a partner there, in two ways: no vector at home in
i is further from its pivot than the cell's radius, and all of them lie on the
pivot's side of the plane halfway to the vector's own pivot. Cells join
independently, in blocks of bounded size.

The bounds only save work, they never decide: every pair they leave is measured
in double precision, so the result is exact whatever the pivots. They prune
well where vectors lie in clusters narrower than the distance between pivots,
and little where directions are spread evenly over many dimensions; then the
join approaches a comparison of all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landflux.llm.components import components
from landflux.llm.simhash import _unite
from landflux.llm.store import Store

LEAST_COSINE = 0.9
CELL = 8192  # vectors a cell should hold; sets the number of pivots
MOST_PIVOTS = 1024
SAMPLE = 4096  # vectors from which pivots are fitted, by smallest hash
ROUNDS = 5  # of centring the pivots on the sample
BLOCK = 4096  # rows of one side in a comparison
STRIP = 512  # rows of it multiplied at once
SLACK = 1e-9  # for rounding in the bounds


def _unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Directions as bytes of doubles; null where there is none."""
    for batch in batches:
        column = batch.column("value")
        units: list[bytes | None] = []
        for value in column:
            row = value.values.to_numpy(zero_copy_only=False).astype(np.float64) if value.is_valid else np.empty(0)
            top = np.abs(row).max(initial=0.0)
            if not top > 0 or not np.isfinite(top):  # also a null or NaN, which spoils the maximum
                units.append(None)
                continue
            row = row / top
            units.append((row / np.sqrt(row @ row)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(units, pa.binary())], names=["vec_id", "unit"])


def _stack(units) -> np.ndarray:
    return np.frombuffer(b"".join(units)).reshape(len(units), -1)


def fit_pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Unit vectors among which the sample divides: some of it, centred a few times."""
    pivots = sample[:number].copy()
    for _ in range(ROUNDS):
        home = (sample @ pivots.T).argmax(axis=1)
        for k in range(len(pivots)):
            total = sample[home == k].sum(axis=0)
            length = np.sqrt(total @ total)
            if length > 0:
                pivots[k] = total / length
    return np.unique(pivots, axis=0)


def _cells(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, radii, reach: float) -> Iterator[pa.RecordBatch]:
    """Home cell and distance to its pivot; with ``radii`` also the lower cells that may hold a partner."""
    between = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))
    for batch in batches:
        units = batch.column("unit").to_pylist()
        home = np.array([-len(u) for u in units], np.int64)
        distance = np.zeros(len(units))
        also: list[list[int]] = [[] for _ in units]
        same = np.flatnonzero(home == -8 * pivots.shape[1]) if len(pivots) else np.empty(0, np.int64)
        if len(same):
            cosine = _stack([units[i] for i in same.tolist()]) @ pivots.T
            nearest = cosine.argmax(axis=1)
            own = cosine[np.arange(len(same)), nearest]
            home[same] = nearest
            distance[same] = np.sqrt(np.maximum(2 - 2 * own, 0))
            if radii is not None:
                away = np.sqrt(np.maximum(2 - 2 * cosine, 0))
                possible = np.arange(len(pivots)) < nearest[:, None]
                possible &= away - radii <= reach + SLACK
                possible &= own[:, None] - cosine <= reach * between[nearest] + SLACK
                rows, cells = np.nonzero(possible)
                for row, cell in zip(rows.tolist(), cells.tolist(), strict=True):
                    also[int(same[row])].append(cell)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(home), pa.array(distance), pa.array(also, pa.list_(pa.int64()))],
            names=[*batch.schema.names, "home", "distance", "also"],
        )


def _compare(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between the sides of one pair of blocks: per vector how many, and its group's first vector."""
    rows = rows.sort_values(["side", "node"], ignore_index=True)
    within = not (rows.side == 1).any()
    left = np.flatnonzero(rows.side == 0)
    right = left if within else np.flatnonzero(rows.side == 1)
    units = _stack(rows.unit.tolist())
    weight = rows.copies.to_numpy(np.float64)
    links = np.zeros(len(rows))
    root = np.arange(len(rows))
    other = units[right]
    for start in range(0, len(left), STRIP):
        strip = left[start : start + STRIP]
        near = units[strip] @ other.T >= least
        if within:
            near &= right[None, :] > strip[:, None]
        if not near.any():
            continue
        flags = near.astype(np.float64)
        links[strip] += flags @ weight[right]
        links[right] += weight[strip] @ flags
        a, b = np.nonzero(near)
        _unite(root, strip[a], right[b])
    found = links > 0
    node = rows.node.to_numpy()
    return pd.DataFrame({"node": node[found], "links": links[found].astype(np.int64), "first": node[root[found]]})


def near_vectors(
    vectors: DataFrame, least: float = LEAST_COSINE, vec_id: str = "vec_id", value: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Links are pairs of rows with cosine >= ``least``; vectors of different
    lengths never link. Rows with no direction (null, empty, zero, with null or
    non-finite components) link with nothing and stand alone. Equal vectors are
    one entry with a count, so a group of copies costs one comparison; repeated
    rows link with each other. A null id never names a component and is not
    kept. Columns other than the two named are ignored; an empty table gives an
    empty table.
    """
    reach = float(np.sqrt(2 - 2 * least))
    store = Store(vectors.sparkSession, "vectors")
    plain = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(value).cast("array<double>").alias("value"))
    rows = store.keep(plain.mapInArrow(_unit_vectors, "vec_id bigint, unit binary"))
    groups = rows.filter("unit IS NOT NULL").groupBy("unit").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = store.keep(groups.withColumn("node", F.monotonically_increasing_id()))
    sample = nodes.select("unit").orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE).collect()
    lengths = [len(r.unit) for r in sample]
    usual = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    sample = [r.unit for r in sample if len(r.unit) == usual]
    number = min(MOST_PIVOTS, -(-nodes.count() // CELL), len(sample))
    pivots = fit_pivots(_stack(sample), number) if sample else np.empty((0, 0))
    schema = "unit binary, first_id bigint, copies bigint, node bigint, home bigint, distance double, also array<bigint>"
    homes = nodes.mapInArrow(partial(_cells, pivots=pivots, radii=None, reach=reach), schema)
    # one row a cell: no more than the pivots, and one for each unusual length
    radii = np.zeros(len(pivots))
    for r in homes.filter("home >= 0").groupBy("home").agg(F.max("distance").alias("radius")).collect():
        radii[r.home] = r.radius
    placed = store.keep(nodes.mapInArrow(partial(_cells, pivots=pivots, radii=radii, reach=reach), schema))
    at_home = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("own"))
    visiting = placed.select(F.explode("also").alias("cell")).groupBy("cell").agg(F.count("*").alias("visitors"))
    blocks = at_home.join(visiting, "cell", "left").select(
        "cell",
        F.ceil(F.col("own") / BLOCK).alias("own_blocks"),
        F.ceil(F.coalesce("visitors", F.lit(0)) / BLOCK).alias("visitor_blocks"),
    )
    blocks = store.keep(blocks)
    spread = F.xxhash64("node")
    stays = placed.join(blocks, placed.home == blocks.cell).withColumn("block", F.pmod(spread, F.col("own_blocks")))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("own_blocks") + F.col("visitor_blocks") - 1)
    stays = stays.select("cell", "node", "unit", "copies", "block", F.explode(every).alias("against"), "own_blocks").select(
        "cell",
        F.least("block", "against").alias("left"),
        F.greatest("block", "against").alias("right"),
        (F.col("against") < F.col("block")).cast("int").alias("side"),
        "node",
        "unit",
        "copies",
    )
    visits = placed.select(F.explode("also").alias("cell"), "node", "unit", "copies").join(blocks, "cell")
    visits = visits.select(
        "cell",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("own_blocks") - 1)).alias("left"),
        (F.col("own_blocks") + F.pmod(spread, F.col("visitor_blocks"))).alias("right"),
        F.lit(1).alias("side"),
        "node",
        "unit",
        "copies",
    )
    met = stays.unionByName(visits).groupBy("cell", "left", "right")
    found = store.keep(met.applyInPandas(partial(_compare, least=least), "node bigint, links bigint, first bigint"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    connected = store.keep(components(store.keep(found.select(F.col("node").alias("a"), F.col("first").alias("b"))), store))
    named = nodes.join(connected, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = store.keep(named.join(linked, "node", "left").withColumn("links", F.coalesce("links", F.lit(0))))
    smallest = store.keep(named.groupBy("component").agg(F.min("first_id").alias("component_id")))
    labels = store.keep(named.join(smallest, "component").select("unit", "copies", "links", "component_id"))
    lone = rows.filter("unit IS NULL").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    result = rows.join(labels, "unit").select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    return result.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
