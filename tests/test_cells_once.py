"""Cells are worked out once for each row, and as a walk over one level at a time gives them."""

import math
import random

from pyspark.sql import functions as F

from cairn.functions import spatial
from cairn.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def customers(spark, folder, n=3000):
    spark.range(n).select(F.col("id").alias("c_custkey")).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def leaf(lat, lon):
    """Leaf id of a point, level by level; null coordinates not allowed."""
    p, q = math.radians(lat), math.radians(lon)
    x, y, z = math.cos(p) * math.cos(q), math.cos(p) * math.sin(q), math.sin(p)
    axis = 0 if abs(x) >= abs(y) and abs(x) >= abs(z) else 1 if abs(y) >= abs(z) else 2
    face = axis + 3 * ((x, y, z)[axis] < 0)
    u, v = ((lambda: (y / x, z / x)), (lambda: (-x / y, z / y)), (lambda: (-x / z, -y / z)), (lambda: (z / x, y / x)), (lambda: (z / y, -x / y)), (lambda: (-y / z, -x / z)))[face]()
    i, j = (min(int((0.5 * math.sqrt(1 + 3 * t) if t >= 0 else 1 - 0.5 * math.sqrt(1 - 3 * t)) * 2**30), 2**30 - 1) for t in (u, v))
    return spatial._Cell(face, 30, i, j).leaves()[0]


def test_box_cover_works_out_each_cell_once(spark, tmp_path):
    df = QUERIES["points_within_box_cover"](spark, customers(spark, tmp_path))
    assert plan(df).count("aggregate(") == 1
    want = QUERIES["points_within_box"](spark, str(tmp_path))
    assert sorted(r.c_custkey for r in df.collect()) == sorted(r.c_custkey for r in want.collect()) != []


def test_leaf_ids_agree_with_a_walk_by_single_levels(spark):
    rng = random.Random(5)
    rows = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(600)]
    rows += [(float(a), float(b)) for a in (-90, -45, -30, 0, 35, 45, 90) for b in (-180, -135, -90, -45, 0, 45, 90, 135, 180)]
    df = spark.createDataFrame(rows, "lat double, lon double").select("lat", "lon", spatial.cell_id(F.col("lat"), F.col("lon")).alias("cell"))
    assert plan(df).count("COS(") <= 3  # as often as a direction needs it, not once for each test of a face
    # sines of Python and of the JVM may differ in the last bit: leaves then differ by a step, coarser cells don't
    for r in df.collect():
        assert r.cell == leaf(r.lat, r.lon) or parent_of(r.cell, 24) == parent_of(leaf(r.lat, r.lon), 24)


def parent_of(cell, level):
    low = 1 << 2 * (30 - level)
    return cell & -low | low


def test_radius_cover_works_out_each_cell_once(spark, tmp_path):
    df = QUERIES["points_within_cell_cover"](spark, customers(spark, tmp_path))
    assert plan(df).count("aggregate(") == 1
    want = QUERIES["points_within_radius"](spark, str(tmp_path))
    assert sorted(r.c_custkey for r in df.collect()) == sorted(r.c_custkey for r in want.collect()) != []


def test_decoding_walks_a_cell_once_for_each_coordinate(spark, tmp_path):
    df = QUERIES["cells_decoded"](spark, customers(spark, tmp_path))
    assert plan(df).count("aggregate(") <= 3  # the cell, and its place for latitude and longitude
    rows = df.collect()
    assert rows and all((r.lat, r.lon) == (round((r.c_custkey * 7919 % 170000) / 1000 - 85), round((r.c_custkey * 104729 % 360000) / 1000 - 180)) for r in rows)


def test_places_at_every_level_agree_with_the_cells_they_came_from(spark):
    rng = random.Random(6)
    cells = [spatial._Cell(rng.randrange(6), level, rng.randrange(1 << level), rng.randrange(1 << level)) for level in range(31) for _ in range(6)]
    for level in range(31):
        own = [(k, *c.leaves(), c.face, c.i, c.j) for k, c in enumerate(cells) if c.level == level]
        df = spark.createDataFrame(own, "k long, low long, high long, face int, i long, j long")
        # the first and the last leaf and the cell itself, which lies between them
        for cell in (F.col("low"), F.col("high"), spatial.cell_parent(F.col("low"), level)):
            assert all(tuple(r.at) == (r.face, r.i, r.j) for r in df.select("*", spatial.cell_place(cell, level).alias("at")).collect())
