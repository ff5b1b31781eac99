"""Boxes of all sizes against a plain test of every pair."""

from __future__ import annotations

import random

from plan_rows import rows_made

from landflux.operators import prepare

POINT = "unit_id bigint, lon double, lat double"
BOX = "box_id int, lon0 double, lon1 double, lat0 double, lat1 double"


def plain(points, boxes):
    def holds(lon, lat, lon0, lon1, lat0, lat1):
        across = lon0 <= lon < lon1 if lon0 <= lon1 else lon0 <= lon < 180 or -180 <= lon < lon1
        return across and lat0 <= lat < lat1

    return {(u, b) for u, lon, lat in points for b, *box in boxes if holds(lon, lat, *box)}


def test_boxes_of_all_sizes(spark):
    rng = random.Random(4)
    points = [(i, rng.choice([-180.0, 0.0, 45.0, 90.0, rng.uniform(-180, 180)]), rng.choice([-90.0, 0.0, rng.uniform(-60, 80)])) for i in range(400)]
    boxes = []
    for b in range(300):
        wide, high = 360 * 2 ** -rng.uniform(0, 14), 180 * 2 ** -rng.uniform(0, 14)
        _, lon, lat = rng.choice(points)
        lon0, lat0 = rng.choice([lon, lon - wide * rng.random()]), rng.choice([lat, lat - high * rng.random()])
        lon0, lon1 = max(lon0, -180.0), lon0 + wide
        boxes.append((b, lon0, lon1 - 360 if lon1 > 180 else lon1, lat0, lat0 + high))
    boxes += [(900, -180.0, 180.0, -90.0, 90.0), (901, 5.0, 5.0, 0.0, 1.0), (902, 1.0, 1.0 + 1e-9, 0.0, 1e-9), (903, 45.0, 90.0, 0.0, 45.0), (904, 0.0, 0.0, 0.0, 0.0)]
    got = prepare.zones_of_points(spark.createDataFrame(points, POINT), spark.createDataFrame(boxes, BOX))
    pairs = [(r.unit_id, r.box_id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain(points, boxes) and len(pairs) > 700


def test_very_many_small_boxes_in_one_place(spark):
    """100,000 boxes of a hundredth of a degree, and some of ten degrees, all within three degrees."""
    points = [(i, 10 + (i * 37 % 3000) / 1000, 50 + (i * 53 % 3000) / 1000) for i in range(2000)]
    small = [(b, 10 + b % 316 / 110, 10 + b % 316 / 110 + 0.01, 50 + b // 316 / 110, 50 + b // 316 / 110 + 0.01) for b in range(100_000)]
    large = [(200_000 + b, 5.0 + b, 15.0 + b, 45.0, 55.0) for b in range(3)]
    boxes = spark.createDataFrame(small + large, BOX).repartition(4)
    got = prepare.zones_of_points(spark.createDataFrame(points, POINT), boxes)
    hits = got.count()
    by_side = {}
    for b, lon0, lon1, lat0, lat1 in small:
        by_side.setdefault((int(lon0 * 10), int(lat0 * 10)), []).append((b, lon0, lon1, lat0, lat1))
    near = [(p, [box for dx in (0, -1) for dy in (0, -1) for box in by_side.get((int(p[1] * 10) + dx, int(p[2] * 10) + dy), [])]) for p in points]
    assert hits == sum(len(plain([p], some + large)) for p, some in near)
    # met in the join: a few times the hits, where one cell for all would give 200 million
    assert rows_made(prepare.zones_of_points(spark.createDataFrame(points, POINT), boxes.drop("none")), "SortMergeJoin") + rows_made(got, "BroadcastHashJoin") < 8 * hits + 20_000


def test_no_boxes_and_no_points(spark):
    points, boxes = spark.createDataFrame([(1, 0.0, 0.0)], POINT), spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0)], BOX)
    assert prepare.zones_of_points(points, boxes.filter("false")).count() == 0
    assert prepare.zones_of_points(points.filter("false"), boxes).count() == 0
    assert prepare.zones_of_points(spark.createDataFrame([(1, None, 0.0)], POINT), boxes).count() == 0
