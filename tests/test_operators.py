import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.catalog import Catalog, Index, RecordType, Store
from cairn.functions import spatial, vectors
from cairn.functions.predicates import field
from cairn.operators import aggregates, evolution, joins, maintenance, parts, statistics, versions
from cairn.operators.ranks import Leaderboard
from cairn.sources import tables
from cairn.streaming import views


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(i, f"g{i % 3}", rng.choice([10, 20, 30, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "player long, game string, score long")
    for order, sign in (("desc", -1), ("asc", 1)):
        want = sorted((sign * s, sign * p) for p, _, s in rows if s is not None)
        board = Leaderboard(df, "score", ["player"], order=order)
        assert [r.player for r in board.ranked(8).orderBy("rank").collect()] == [sign * p for _, p in want]
        assert board.rank_of(sign * want[7][0], [sign * want[7][1]]) == 8 and board.rank_of(20, [9999]) is None
        assert [r.player for r in board.top(3).collect()] == [sign * p for _, p in want[:3]] and board.score_at(5).first().score == sign * want[4][0]
    grouped = Leaderboard(df, "score", ["player"], ["game"])
    best = {r.game: r.player for r in grouped.at(1).collect()}
    assert best == {g: max((s, p) for p, h, s in rows if h == g and s is not None)[1] for g in ("g0", "g1", "g2")}
    assert grouped.rank_of(30, [best["g0"]], {"game": "g0"}) == 1 and {r["count"] for r in grouped.count().collect()} <= set(range(40, 70))
    with pytest.raises(ValueError):
        grouped.top(0)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0]), (4, [1.0]), (5, None)], "id long, v array<float>")
    store = Store(df, RecordType("v", df.schema, ("id",)))
    assert [(r.id, round(r.distance, 6)) for r in store.query().nearest(9, [1.0, 0.0], "v", "cosine").collect()] == [(1, 0.0), (3, 0.4), (2, 2.0)]
    assert [(r.id, round(r.distance, 6)) for r in store.query().nearest(2, [1.0, 0.0], "v", "inner").collect()] == [(3, -3.0), (1, -1.0)]
    assert [r.id for r in store.query().where(field("id") > 1).nearest(1, [1.0, 0.0], "v").collect()] == [2]
    out = df.where("id in (2, 3)").select(vectors.normalized(F.col("v")).alias("n")).collect()
    assert [[round(x, 6) for x in r.n] for r in out] == [[0, 0], [0.6, 0.8]]
    for k, name in ((0, "v"), (1, "id")):
        with pytest.raises(ValueError):
            store.query().nearest(k, [1.0], name)


def test_codes(spark):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random(), rng.random(), rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(200)]
    rows += [(200, 0.0, 0.0, 0.0, 37.7749, -122.4194), (201, 1.0, 1.0, 1.0, 35.6762, 139.6503), (202, 0.5, 0.5, 0.5, 51.5074, -0.1278)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, lat double, lon double")
    two, three = spatial.morton([F.col("x"), F.col("y")], 30), spatial.morton([F.col("x"), F.col("y"), F.col("z")], 20)
    out = df.select("*", two.alias("m2"), three.alias("m3"), spatial.geohash(F.col("lat"), F.col("lon"), 7).alias("hash"), spatial.geohash(F.col("lat"), F.col("lon"), 12).alias("long"), spatial.cell_id(F.col("lat"), F.col("lon")).alias("cell"))
    out = out.select("*", *[c.alias(f"d{k}") for k, c in enumerate(spatial.morton_decode(F.col("m2"), 2, 30) + spatial.morton_decode(F.col("m3"), 3, 20))])
    out = out.select("*", spatial.cell_parent(F.col("cell"), 9).alias("up")).select("*", spatial.cell_contains(F.col("up"), F.col("cell")).alias("inside")).collect()
    for r in out:
        assert r.m2 == spatial.morton_value([r.x, r.y], 30) and r.m3 == spatial.morton_value([r.x, r.y, r.z], 20)
        assert max(abs(a - b) for a, b in zip((r.d0, r.d1, r.d2, r.d3, r.d4), (r.x, r.y, r.x, r.y, r.z), strict=True)) < 1e-5
        assert r.hash == spatial.geohash_of(r.lat, r.lon, 7) and r.long == spatial.geohash_of(r.lat, r.lon, 12) and r.inside
        south, west, north, east = spatial.geohash_bounds(r.hash)
        assert south <= r.lat <= north and west <= r.lon <= east and r.hash in spatial.geohash_cover(r.lat - 0.001, r.lon - 0.001, r.lat + 0.001, r.lon + 0.001, 7)
    assert [r.hash for r in out[-3:]] == ["9q8yyk8", "xn76cyd", "gcpvj0d"] and out[200].m2 == 0
    # near points lie in the same coarse cell
    pair = spark.createDataFrame([(48.8584, 2.2945), (48.8585, 2.2946)], "lat double, lon double").select(spatial.cell_parent(spatial.cell_id(F.col("lat"), F.col("lon")), 12).alias("c"))
    assert len({r.c for r in pair.collect()}) == 1


def test_geohash_helpers():
    around = spatial.geohash_neighbors("9q8yyk8")
    assert len(around) == 8 and spatial.geohash_neighbors(around["n"])["s"] == "9q8yyk8" and spatial.geohash_neighbors(around["ne"])["sw"] == "9q8yyk8"
    assert spatial.geohash_cover(-1, 179, 1, -179, 3) == sorted({*spatial.geohash_cover(-1, 179, 1, 180, 3), *spatial.geohash_cover(-1, -180, 1, -179, 3)})
    assert spatial.geohash_precision(5) == 4 or min(spatial.geohash_size_km(spatial.geohash_precision(5))) >= 5


def test_radius_and_box(spark):
    df = spark.createDataFrame([(1, 35.0, 139.0), (2, 35.001, 139.0), (3, 36.0, 139.0), (4, None, 139.0)], "id long, lat double, lon double")
    q = Store(df, RecordType("p", df.schema, ("id",))).query()
    assert sorted(r.id for r in q.within_radius("lat", "lon", (35.0, 139.0), 112).to_df().collect()) == [1, 2]
    assert [r.id for r in q.nearest_points(1, "lat", "lon", (36.1, 139.0)).collect()] == [3]
    with pytest.raises(ValueError):
        q.within_box(["lat", "lon"], [1, 1], [0, 2])


def test_joins(spark, monkeypatch):
    monkeypatch.setattr(parts, "ROWS", 50)
    rng = random.Random(3)
    a, b = ([(i, rng.randrange(3), s := rng.randrange(100), s + 1 + rng.randrange(30)) for i in range(60)] for _ in range(2))
    one, two = spark.createDataFrame(a, "i long, k int, a0 long, a1 long"), spark.createDataFrame(b, "j long, k int, b0 long, b1 long")
    got = sorted((r.i, r.j) for r in joins.interval_join(one, two, ("a0", "b0"), ("a1", "b1"), 7, ["k"]).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and x[3] > y[2])
    times = spark.createDataFrame([(j, k, t, v) for j, (k, t, v) in enumerate({(x[1], x[2]): (x[1], x[2], x[3]) for x in b}.values())], "j long, k int, t long, v long")
    got = {r.i: r.v for r in joins.as_of_join(one, times, ["k"], "a0", "t", ["v"]).collect()}
    rows = times.collect()
    for i, k, t, _ in a:
        before = max((r for r in rows if r.k == k and r.t <= t), key=lambda r: r.t, default=None)
        assert got[i] == (before.v if before else None)
    odd = spark.createDataFrame([(1, None, 5), (2, 0, None), (3, 9, 5), (4, 9, 5)], "i long, k int, a0 long")
    facts = spark.createDataFrame([(None, 1, 1), (0, None, 2), (9, 5, 3), (9, 5, 4)], "k int, t long, v long")
    assert sorted((r.i, r.v) for r in joins.as_of_join(odd, facts, ["k"], "a0", "t", ["v"]).collect()) == [(1, None), (2, None), (3, 4), (4, 4)]
    hot = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    marks = hot.where("t % 700 = 0").select("k", "t", F.col("t").alias("v"))
    assert joins.as_of_join(hot, marks, ["k"], "t", "t", ["v"]).where("v <> t - t % 700 or v is null").count() == 0
    assert joins.as_of_join(hot, marks.limit(0), ["k"], "t", "t", ["v"]).where("v is null").count() == 3000
    assert joins.as_of_join(hot.limit(0), marks, ["k"], "t", "t", ["v"]).count() == 0
    assert joins.in_list(spark, one, "i", list(range(0, 600, 2))).count() == 30 and joins.in_list(spark, one, "i", []).count() == 0


def test_statistics(spark):
    df = spark.range(20000).select("id", (F.col("id") % 100).alias("v"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("n"))
    stats = {r.column: r for r in statistics.column_stats(df, "v", "n").collect()}
    assert stats["n"].n_null == 5000 and abs(stats["v"].n_distinct - 100) < 10 and (stats["v"].low, stats["v"].high) == ("0", "99")
    assert abs(statistics.merged_distinct(statistics.distinct_sketches(df, ["v"], "id")).first().n_distinct - 20000) < 600
    sample = statistics.reservoir(df, ["id"], 1000).collect()
    assert len(sample) == 1000 and 8500 < sum(r.id for r in sample) / 1000 < 11500
    buckets = [(r.low, r.high, r.n) for r in statistics.range_histogram(df, "v", 0, 100, 10).collect()]
    for p, true in ((field("v") < 25, 0.25), (field("v") >= 90, 0.1), (~(field("v") < 25), 0.75), ((field("v") < 50) & (field("v") < 50), 0.25), ((field("v") < 50) | (field("v") < 50), 0.75)):
        assert abs(statistics.selectivity(p, {"v": buckets}) - true) < 0.03
    assert statistics.selectivity(field("x") == 1) == 0.02 and statistics.selectivity(field("x") != 1, None, {"x": 4}) == 0.75 and statistics.selectivity(field("x").contains("a")) == 0.5
    assert statistics.table_stats(df).first().n_rows == 20000


def test_versions(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    history = spark.createDataFrame([(1, v, t(v), f"a{v}") for v in range(1, 6)] + [(2, 1, t(1), "b")], "id long, version long, ts timestamp, x string")
    assert {(r.id, r.x) for r in versions.current(history, ["id"]).collect()} == {(1, "a5"), (2, "b")}
    assert versions.keep_last(history, ["id"], 2).count() == 3 and versions.keep_last(history, ["id"], 0).count() == 2
    assert sorted((r.id, r.version) for r in versions.keep_since(history, ["id"], t(4)).collect()) == [(1, 4), (1, 5), (2, 1)]
    versions.check_version(history, {"id": 1}, 5)
    with pytest.raises(versions.StaleVersion):
        versions.check_version(history, {"id": 1}, 4)
    more = versions.append(history, spark.createDataFrame([(2, "c")], "id long, x string"), 9, t(9))
    assert [r.version for r in versions.versions_of(more, {"id": 2}).collect()] == [1, 9]


def test_maintained_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "n", 1000, ["a", "b"]), (2, "n", 500, []), (3, "s", 750, ["a"]), (4, "s", None, None)], "id long, region string, amount long, tags array<string>")
    store = Store(df, RecordType("sales", df.schema, ("id",)))
    index = maintenance.built(store, Index("sum", "sum", ("region", "amount")), f"{tmp_path}/sum")
    table = {r.region: r for r in spark.read.parquet(f"{tmp_path}/sum").collect()}
    assert index.state == "readable" and (table["n"].total, table["n"].low, table["s"].n, table["s"].n_values) == (1500, 500, 2, 1)
    tags = Index("tags", "value", ("tags",))
    entries = maintenance.index_table(store, tags)
    broken = entries.where("id <> 3").unionByName(spark.createDataFrame([("z", 9), ("z", 9)], "tags string, id long"))
    assert {(r.tags, r.id, r.issue, r.n) for r in maintenance.scrub(store, tags, broken).collect()} == {("a", 3, "missing", 1), ("z", 9, "dangling", 2)}
    assert maintenance.scrub(store, tags, maintenance.repaired(store, tags, broken)).count() == 0
    done = spark.createDataFrame([(10, 20), (15, 30), (50, 60)], "lower long, upper long")
    assert sorted((r.lower, r.upper) for r in maintenance.gaps(done, 0, 100).collect()) == [(0, 10), (30, 50), (60, 100)]
    whole = aggregates.maintained(df, ["region"], "amount")
    left = aggregates.retracted(whole, aggregates.maintained(df.where("region = 'n'"), ["region"], "amount"), ["region"]).collect()
    assert [(r.region, r.n, r.total) for r in left] == [("s", 2, 750)]


def test_evolution(spark):
    kind = lambda fields, **k: RecordType("t", T.StructType(fields), ("id",), **k)
    i, x = T.StructField("id", T.IntegerType()), T.StructField("x", T.StringType())
    old = Catalog([kind([i, x], enums=(("x", ("a", "b")),))], {"t": [Index("by_x", "value", ("x",))]}, (1, 0, 0))
    y = T.StructField("y", T.LongType(), False, {"default": 7})
    new = Catalog([kind([T.StructField("id", T.LongType()), x, y], enums=(("x", ("a", "b", "c")),))], {"t": [Index("by_y", "value", ("y",))]}, (1, 1, 0), ("by_x",))
    assert evolution.evolution_errors(old, new) == []
    bad = Catalog([kind([T.StructField("id", T.StringType()), T.StructField("z", T.LongType(), False)], enums=(("x", ("a",)),))], {}, (2, 0, 0))
    assert len(evolution.evolution_errors(old, bad)) == 5
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], old.types["t"].schema)
    steps = evolution.Migration((1, 1, 0), (1, 2, 0), (evolution.delete_where("t", F.col("x") == "a"), evolution.transform("t", lambda d: d.withColumn("y", F.col("y") + 1)), evolution.rebuild_index("t", "by_y")))
    state = evolution.migrate(evolution.State({"t": df}, old.indexes, (1, 0, 0)), [evolution.lightweight(old, new), steps], (1, 2, 0))
    assert sorted((r.id, r.y) for r in state.tables["t"].collect()) == [(2, 8), (3, 8)] and state.former == ("by_x",) and state.rebuild == ("by_y",)
    with pytest.raises(LookupError):
        evolution.path([steps], (1, 0, 0), (1, 2, 0))
    with pytest.raises(ValueError):
        evolution.lightweight(old, bad)
    assert evolution.allowed(df, "x", ["a"]).count() == 1


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "t1", "x", 0), (2, "t2", "y", 0)], "id long, tenant string, v string, scratch int")
    kind = RecordType("r", df.schema, ("id",), transient=("scratch",), tenant=("tenant",))
    tables.write(df, kind, f"{tmp_path}/r.parquet", ["id"])
    kind = RecordType("r", df.drop("scratch").schema, ("id",), tenant=("tenant",))
    store = tables.open_store(spark, Catalog([kind]), str(tmp_path), "r", {"tenant": "t2"})
    assert [(r.id, r.v) for r in store.scan().collect()] == [(2, "y")] and "PartitionFilters: [isnotnull(tenant" in store.df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        tables.replace(store, "a", "a")
    assert tables.replace(store, f"{tmp_path}/r.parquet", f"{tmp_path}/new").df.count() == 1


def test_streams(spark, tmp_path):
    rows = [(1, "n", 5, 1), (2, "n", 7, 1), (1, "n", 5, -1), (3, "s", None, 1)]
    spark.createDataFrame(rows, "id long, region string, amount long, delta int").repartition(2).write.parquet(f"{tmp_path}/in")
    changes = spark.readStream.schema("id long, region string, amount long, delta int").parquet(f"{tmp_path}/in")
    for name, df in (("counts", views.maintained_counts(changes, ["region"], "amount")), ("extremes", views.maintained_extremes(changes, ["region"], "amount"))):
        views.to_table(df, name, f"{tmp_path}/{name}").awaitTermination(120)
    assert {(r.region, r.n, r.total) for r in spark.table("counts").collect()} == {("n", 1, 7), ("s", 1, None)}
    assert {(r.region, r.low, r.high) for r in spark.table("extremes").collect()} == {("n", 5, 7), ("s", None, None)}
    spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, m), "k") for m in (1, 4, 7)], "ts timestamp, k string").write.parquet(f"{tmp_path}/ev")
    events = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/ev")
    views.to_table(views.windowed_counts(events, "ts", "5 minutes", "1 minute", ["k"]), "windows", f"{tmp_path}/w").awaitTermination(120)
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 2]


def test_sphere_cells_decode_children_neighbours_and_covers(spark):
    import math
    import random

    rng = random.Random(3)
    rows = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(400)] + [(0.0, 0.0), (90.0, 0.0), (-90.0, 10.0), (45.0, 45.0), (0.0, 180.0)]
    df = spark.createDataFrame(rows, "lat double, lon double").withColumn("cell", spatial.cell_id(F.col("lat"), F.col("lon")))
    assert {r.cell for r in df.where("lat = 0 and lon = 0").collect()} == {0x1000000000000001}
    lat, lon = spatial.cell_center(F.col("cell"))
    far = df.select(spatial.haversine(F.col("lat"), F.col("lon"), lat, lon).alias("m")).agg(F.max("m")).first()[0]
    assert far < 0.02
    for level in (0, 1, 7, 29):
        up = df.select(spatial.cell_parent(F.col("cell"), level).alias("up"), spatial.cell_parent(F.col("cell"), level + 1).alias("own"))
        got = up.select("own", spatial.cell_children(F.col("up")).alias("four"), "up").collect()
        assert all(r.own in r["four"] and len(set(r["four"])) == 4 for r in got)
    for level in (2, 9, 30):
        near = df.select(spatial.cell_parent(F.col("cell"), level).alias("c")).distinct().withColumn("n", F.explode(spatial.cell_neighbors(F.col("c"), level)))
        back = near.withColumn("back", spatial.cell_neighbors(F.col("n"), level))
        assert near.groupBy("c").agg(F.countDistinct("n").alias("k")).where("k <> 4").isEmpty() and back.where("not array_contains(back, c) or n = c").isEmpty()
    for c in (spatial._Cell(f, 5, 17, 9) for f in range(6)):
        at = spark.createDataFrame([c.leaves()], "a long, b long").select(spatial.cell_place(F.col("a"), 5).alias("p"), spatial.cell_place(F.col("b"), 5).alias("q")).first()
        assert tuple(at.p) == tuple(at.q) == (c.face, 17, 9)
    for lat0, lon0, meters in ((35.0, 139.0, 2_000_000), (89.0, 10.0, 900_000), (0.0, 179.9, 1_500_000), (-45.0, -44.0, 30_000)):
        cover = spatial.cells_around(lat0, lon0, meters)
        assert len(cover) <= 16 and all(a <= b for a, b in cover) and all(b < c for (_, b), (c, _) in zip(cover, cover[1:], strict=False))
        exact = df.where(spatial.within_radius(F.col("lat"), F.col("lon"), (lat0, lon0), meters))
        assert exact.where(~spatial.in_ranges(F.col("cell"), cover)).isEmpty()
        assert df.where(spatial.in_ranges(F.col("cell"), cover)).count() < 120
    for south, west, north, east in ((-20, -60, 40, 10), (50, 170, 88, -160), (-90, -180, -60, 180)):
        cover = spatial.cells_of_box(south, west, north, east)
        inside = F.col("lat").between(south, north) & (F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east))
        assert df.where(inside & ~spatial.in_ranges(F.col("cell"), cover)).isEmpty()
    code = df.withColumn("alt", F.col("lat") * 10 + 1000).withColumn("code", spatial.geo3d_code(F.col("lat"), F.col("lon"), F.col("alt"), 0, 2000))
    a, b, c = spatial.geo3d_decode(F.col("code"), 0, 2000)
    worst = code.select(spatial.haversine(F.col("lat"), F.col("lon"), a, b).alias("m"), F.abs(c - F.col("alt")).alias("h")).agg(F.max("m"), F.max("h")).first()
    assert worst[0] < 60 and worst[1] <= 2000 / 2**24


def test_ranks_of_tied_and_unusual_scores(spark, monkeypatch):
    monkeypatch.setattr(parts, "ROWS", 50)
    from cairn.operators.ranks import Leaderboard

    df = spark.range(3000).select(F.col("id"), F.lit(7).alias("one"), F.concat(F.lit("s"), F.col("id") % 5).alias("word"), F.timestamp_seconds(F.col("id") % 40).alias("at"))
    for score in ("one", "word", "at"):
        for order in ("desc", "asc"):
            board = Leaderboard(df, score, ["id"], order=order)
            got = {r.id: r["rank"] for r in board.ranked(parts=32).collect()}
            want = sorted(df.select("id", score).collect(), key=lambda r: (r[1], r.id), reverse=order == "desc")
            assert got == {r.id: k + 1 for k, r in enumerate(want)}
            assert [(r.id, r["rank"]) for r in board.between(3, 6).orderBy("rank").collect()] == [(r.id, k + 3) for k, r in enumerate(want[2:6])]
    grouped = df.withColumn("g", F.when(F.col("id") % 3 == 0, F.lit("a")))
    for order in ("asc", "desc"):
        board = Leaderboard(grouped, "one", ["id"], ["g"], order)
        places = [(r.g, r.id, r["rank"]) for r in board.ranked(parts=32).collect()]
        for g in (None, "a"):
            own = sorted(((i, n) for h, i, n in places if h == g), reverse=order == "desc")
            assert own and [n for _, n in own] == list(range(1, len(own) + 1))
        assert sorted(map(str, board.top(5).collect())) == sorted(map(str, board.ranked(parts=32).where("rank <= 5").collect()))
    assert Leaderboard(grouped.limit(0), "one", ["id"], ["g"]).ranked().count() == 0
    sizes = Leaderboard(df, "one", ["id"]).ranked(parts=32)
    assert sizes.select("rank").distinct().count() == 3000


def test_gaps_over_many_parts(spark):
    import random

    rng = random.Random(1)
    for parts in (1, 3, 50):
        done = sorted((a, a + rng.randrange(0, 30)) for a in (rng.randrange(-20, 520) for _ in range(40)))
        covered = {x for a, b in done for x in range(a, b)}
        free = [x for x in range(500) if x not in covered]
        want = [(x, next(y for y in range(x + 1, 501) if y == 500 or y in covered)) for x in free if x - 1 not in free]
        rows = spark.createDataFrame(done, "lower long, upper long")
        assert sorted((r.lower, r.upper) for r in maintenance.gaps(rows, 0, 500, parts).collect()) == want
    assert [tuple(r) for r in maintenance.gaps(rows.limit(0), 5, 9).collect()] == [(5, 9)] and maintenance.gaps(rows, 3, 3).count() == 0


def test_maps_dimensions_and_unique_values(spark):
    rows = [(1, {"a": 1}, [1.0, 2.0], "x"), (2, {"b": 2}, [0.0, 1.0], "x"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "id long, m map<string,int>, v array<double>, tag string")
    own = Catalog([RecordType("r", df.schema, ("id",))], {"r": [Index("near", "vector", ("v",), options=(("dimensions", 2),)), Index("tags", "value", ("tag",), unique=True)]}).store(df, "r")
    after = own.upsert(spark.createDataFrame([(2, {"c": 3}, [5.0, 5.0], "y")], df.schema))
    assert {r.id: r.m for r in after.df.collect()} == {1: {"a": 1}, 2: {"c": 3}, 3: None}
    with pytest.raises(ValueError, match="dimensions"):
        own.upsert(spark.createDataFrame([(4, None, [1.0], None)], df.schema))
    assert [(r.tag, r.n) for r in own.violations("tags").collect()] == [("x", 2)] and own.violations("tags").columns == ["tag", "n"]
    history = spark.createDataFrame([(1, 1, 10, {"a": 1}), (1, 2, 20, {"a": 2})], "id long, version long, ts long, m map<string,int>")
    assert [(r.version, r.m) for r in versions.current(history, ["id"]).collect()] == [(2, {"a": 2})]
