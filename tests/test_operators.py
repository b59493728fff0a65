"""Operators on small streams with expected values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glint.operators import augment, core, grids, motion, recon, render, synthetic, transforms, windows
from glint.schema import narrow, signed
from glint.sources import readers, writers


def make(spark, xs, ys, ts, ps):
    return readers.from_arrays(spark, xs, ys, ts, ps)


@pytest.fixture(scope="module")
def four(spark):
    return make(spark, [10, 20, 30, 40], [50, 60, 70, 80], [0.1, 0.2, 0.3, 0.4], [1, -1, 1, -1]).cache()


def column(df, name):
    return [r[0] for r in df.orderBy("seq").select(name).collect()]


def pixels(df, *keys):
    return {tuple(r[k] for k in keys): r["value"] for r in df.collect()}


def test_block_flip_crop_clip(spark, four):
    assert [tuple(r) for r in core.to_block(four).collect()] == [(10, 50, 0.1, 1), (20, 60, 0.2, -1), (30, 70, 0.3, 1), (40, 80, 0.4, -1)]
    assert column(transforms.flip_x(four, width=50), "x") == [39, 29, 19, 9]
    assert column(transforms.flip_y(four, height=100), "y") == [49, 39, 29, 19]
    line = make(spark, [10, 20, 30, 40, 50], [10, 20, 30, 40, 50], [0.1, 0.2, 0.3, 0.4, 0.5], [1, -1, 1, -1, 1])
    assert column(transforms.clip(line, (15, 45, 15, 45)), "x") == [20, 30, 40]
    assert column(transforms.clip_to_zero(line, (15, 45, 15, 45)), "x") == [0, 20, 30, 40, 0]
    assert column(transforms.crop(line, x0=20, y0=20, x1=41, y1=40), "x") == [0, 10]
    with pytest.raises(ValueError):
        transforms.clip(line, (1, 2, 3))


def test_rotate(four):
    turned = transforms.rotate(four, radians=math.pi / 4, center=(20, 60))
    assert column(turned, "x") == [20, 20, 20, 20] and column(turned, "y") == [46, 60, 74, 88]
    clamped = transforms.rotate_degrees(four, degrees=90, center=(0, 0), width=50, height=100)
    assert column(clamped, "x") == [0, 0, 0, 0] and column(clamped, "y") == [10, 20, 30, 40]
    assert transforms.rotation(width=5, height=5, seed=1) == transforms.rotation(width=5, height=5, seed=1)


def test_warps(four):
    moved = transforms.warp_linear(four, vx=-1000.0, vy=10.0, t_ref=0.1)
    assert column(moved, "x") == [10, 0, 0, 0] and column(moved, "t") == [0.1, 0.2, 0.3, 0.4]
    kept = transforms.warp_constant_flow(four, vx=-1000.0, vy=10.0, t_ref=0.1)
    assert column(kept, "x") == [10] and column(kept, "t") == [0.1]


def test_merge_bounds_resolution(spark, four):
    other = make(spark, [5, 6], [7, 8], [0.2, 0.05], [1, -1])
    merged = core.merge(four, other)
    assert column(merged, "x") == [6, 10, 20, 5, 30, 40] and column(merged, "seq") == list(range(6))
    assert tuple(core.bounding_box(four).first()) == (10, 50, 40, 80)
    assert tuple(core.resolution(four).first()) == (41, 81)
    empty = make(spark, [], [], [], [])
    assert tuple(core.bounding_box(empty).first()) == (None,) * 4 and tuple(core.resolution(empty).first()) == (0, 0)
    assert core.merge(empty, empty).count() == 0 and grids.voxel_grid(empty, width=5, height=5, bins=3).count() == 0


def test_narrowing(spark):
    wide = spark.createDataFrame([(0, 0.5, -1, 70_000, 200)], "seq long, t double, x long, y long, p long")
    assert tuple(narrow(wide, "wrap").first()) == (0, 0.5, 65_535, 4_464, -56)
    with pytest.raises(Exception, match="out of range"):
        narrow(wide).collect()
    with pytest.raises(Exception, match="NaN"):
        readers.from_arrays(spark, [1], [1], [float("nan")], [1]).collect()
    assert column(signed(readers.from_arrays(spark, [1, 1], [1, 1], [0, 1], [0, 1])), "p") == [-1, 1]


def test_voxels_and_images(spark):
    e = make(spark, [10, 20, 30, 40], [15, 25, 35, 45], [0.1, 0.3, 0.6, 0.9], [1, -1, 1, -1])
    assert pixels(grids.voxel_grid(e, width=50, height=60, bins=3), "bin", "y", "x") == {(0, 15, 10): 1, (0, 25, 20): 1, (1, 35, 30): 1, (2, 45, 40): 1}
    assert set(pixels(grids.voxel_grid(e, width=50, height=60, bins=3, method="polarity_separate"), "bin", "x")) == {(0, 10), (3, 20), (1, 30), (5, 40)}
    assert grids.voxel_grid(e, width=25, height=60, bins=3).count() == 2
    with pytest.raises(ValueError):
        grids.voxel_grid(e, width=5, height=5, bins=3, method="time")
    drawn = {(r.y, r.x): (r.r, r.g, r.b) for r in render.draw_events(e, width=50, height=50).collect()}
    assert drawn == {(15, 10): (255, 0, 0), (25, 20): (0, 0, 255), (35, 30): (255, 0, 0), (45, 40): (0, 0, 255)}
    same = make(spark, [1, 1, 2], [1, 1, 1], [0.5, 0.5, 0.5], [1, 0, 1])
    assert pixels(grids.time_surface(same, width=4, height=4, normalize=True), "channel", "x") == {(0, 1): None, (1, 1): None, (0, 2): None}
    assert {r.x: r.r for r in render.draw_events(same, width=4, height=4, mode="polarity_time").collect()} == {1: 0, 2: 255}
    assert pixels(grids.temporal_histogram(same, bins=4).withColumn("value", F.col("positive")), "bin") == {(0,): 2}
    assert grids.densify(grids.count_image(same, width=4, height=3), width=4, height=3, channels=2).count() == 24


def test_windows(spark):
    e = make(spark, [1] * 5, [1] * 5, [0.0, 0.1, 0.2, 0.9, 1.0], [1] * 5)
    assert column(windows.tumbling(e, 0.25), "w") == [0, 0, 0, 3, 4]
    assert column(windows.tumbling_exact(e, 0.1), "w")[:3] == [0, 1, 2]
    assert {r.w: r.n_events for r in windows.window_counts(e, 0.5).collect()} == {0: 3, 1: 2}
    assert {r.w: r.n_events for r in windows.window_counts(e, 0.2).collect()} == {0: 3, 1: 0, 2: 0, 3: 0, 4: 2}
    assert column(windows.slices(e, 2), "w") == [0, 0, 0, 1]
    with pytest.raises(ValueError):
        windows.tumbling(e, 0)


def test_motion(spark):
    e = make(spark, [0, 1, 2, 3, 4], [2] * 5, [0.0, 1.0, 2.0, 3.0, 4.0], [1] * 5)
    best = motion.estimate_flow(e, [(-1.0, 1.0, 1.0), (0.0, 0.0, 1.0)], width=8, height=4).first()
    assert (best.vx, best.vy) == (-1.0, 0.0) and best.score == pytest.approx(25 / 32 - (5 / 32) ** 2)
    away = motion.grid_scores(e, [(1000.0, 1000.0, 1.0), (0.0, 1.0, 1.0)], width=3, height=4).collect()
    assert len(away) == 2
    with pytest.raises(ValueError):
        motion.grid([(0, 1, 1)])


def test_frames_grow_to_the_whole(spark):
    e = synthetic.spiral(spark, 200)
    series = recon.cumulative_frames(e, 3, width=128, height=128)
    upto = e.where(F.col("t") <= windows.frame_ends(0.0, 199 / 200, 3)[-1])
    last = {(r.y, r.x): r.value for r in series.where("frame = 2").collect()}
    assert last == {(r.y, r.x): r.value for r in recon.frame(upto, width=128, height=128).collect()}
    empty = make(spark, [], [], [], [])
    assert recon.frame(empty, width=3, height=2).agg(F.sum("value"), F.count("*")).first()[:] == (0.0, 6)


def test_random_events(spark, four):
    more = augment.add_random(four, 6, seed=3)
    assert more.count() == 10 and column(more, "t") == sorted(column(more, "t"))
    new = augment.add_random(four, 6, seed=3, return_merged=False)
    again = augment.add_random(four.repartition(3), 6, seed=3, return_merged=False)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, again.collect()))
    ten = make(spark, list(range(10, 110, 10)), [5] * 10, np.arange(10) / 10, [1, -1] * 5)
    assert augment.remove_random(ten, 4, seed=3).count() == 6
    assert augment.remove_random(ten, 15, seed=3, add_noise=5).count() == 0
    assert augment.remove_random(ten, 4, seed=3, add_noise=2).count() == 8
    both = augment.add_correlated(ten, 15, seed=3, add_noise=3)
    assert both.count() == 28 and max(column(both, "x")) <= 100
    assert augment.add_correlated_sampled(ten, 7, seed=3, xy_std=1.0, ts_std=0.1).count() == 17


def test_text_round_trip(spark, four, tmp_path):
    path = str(tmp_path / "events.txt")
    writers.write_text(four, path)
    assert [tuple(r)[1:] for r in readers.read_events(spark, path).orderBy("seq").collect()] == [tuple(r)[1:] for r in four.orderBy("seq").collect()]
    file = tmp_path / "odd.txt"
    file.write_text("# head\n\n0.1 1 2 1 extra\n  0.2 3 4 -1\nbad line here now\n0.3 1.5 2 1\n0.4 7\n1.5d 1 2 1\n")
    assert readers.read_text(spark, str(file)).count() == 2
    with pytest.raises(Exception, match="not an event"):
        readers.read_text(spark, str(file), strict=True).collect()
    assert readers.read_events(spark, str(file), min_x=2).count() == 1
    assert list(readers.iterate(readers.read_text(spark, str(file)))) == [(0.1, 1, 2, 1), (0.2, 3, 4, -1)]


def test_other_files(spark, four, tmp_path):
    writers.write_binary(four, str(tmp_path / "e.bin"))
    with open(tmp_path / "e.bin", "ab") as f:
        f.write(b"tail")
    assert column(readers.read_events(spark, str(tmp_path / "e.bin")), "x") == [10, 20, 30, 40]
    writers.write_parquet(four, str(tmp_path / "e.parquet"))
    assert readers.read_events(spark, str(tmp_path / "e.parquet"), t_start=0.2, t_end=0.4).count() == 2
    writers.write_png(render.draw_events(four, width=50, height=90), str(tmp_path / "e.png"), 90, 50)
    assert (tmp_path / "e.png").read_bytes()[:4] == b"\x89PNG"
    cells = spark.createDataFrame([(r, c, 1.0, 0.5) for r in range(3) for c in range(2)], "row int, col int, vx double, vy double")
    assert (render.flow_image(cells, width=20, height=30, grid=10) == 0).any() and render.line_pixels(0, 0, 4, 2) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)]


def test_streaming(spark, four, tmp_path):
    from glint.streaming import windows as live

    writers.write_parquet(four, str(tmp_path / "in"))
    stream = live.window_counts(live.read_stream(spark, str(tmp_path / "in")), "200 milliseconds", late="0 seconds")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n_events for r in spark.sql("select * from counts").collect()) == [1, 1, 2]


@pytest.mark.parametrize("adaptive, parts", [("true", "8"), ("true", "200"), ("false", "200")])
def test_numbers_of_many_rows(spark, tmp_path, adaptive, parts):
    """All columns are written: a count alone may read a plan that was pruned."""
    from glint.schema import numbered

    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        i = F.col("id")
        # a third of the rows have one time; x tells rows apart
        e = spark.range(100_000).select(i.alias("seq"), F.when(i % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(40_000)) / 1000).alias("t"), (i % 60_000).cast("int").alias("x"), F.lit(1).alias("y"), F.lit(1).alias("p"))
        wanted = e.toPandas().sort_values(["t", "seq"])
        for k, made in enumerate((core.sort_by_time(e), core.merge(e.where("x % 2 = 0"), e.where("x % 2 = 1")), numbered(e.withColumn("_seq", F.col("seq")).drop("seq"), "_seq"))):
            made.write.parquet(str(tmp_path / str(k)))
            got = spark.read.parquet(str(tmp_path / str(k))).toPandas().sort_values("seq")
            assert (got["seq"].to_numpy() == np.arange(100_000)).all()
            if k == 0:
                assert (got["t"].to_numpy() == wanted["t"].to_numpy()).all() and (got["x"].to_numpy() == wanted["x"].to_numpy()).all()
            if k == 1:
                assert (np.diff(got["t"]) >= 0).all() and (np.diff((got["x"] % 2).to_numpy()[got["t"] == 7.0]) >= 0).all()
            if k == 2:
                assert (got["_seq"].to_numpy() == np.arange(100_000)).all()
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)


def test_exact_draws_from_many_rows(spark):
    e = spark.range(50_000).select(F.col("id").alias("seq"), (F.col("id") / 10).alias("t"), F.lit(1).alias("x"), F.lit(1).alias("y"), F.lit(1).alias("p"))
    for k in (0, 1, 9_999, 25_000, 49_999, 50_000, 60_000):
        assert augment.remove_random(e, k, seed=1).count() == max(0, 50_000 - k)
    less, more = ({r.seq for r in augment.remove_random(e, k, seed=1).collect()} for k in (30_000, 20_000))
    assert less < more


def test_colour_maps(spark):
    """Expected values worked out from 1.5 - |2v - 1|, 1.5 - |2v - 0.5|, 1.5 - |2v|, cut to 0..1."""
    image = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.25), (0, 2, 0.5), (0, 3, 1.0)], "y int, x int, value double")
    assert {r.x: (r.r, r.g, r.b) for r in render.colour_map(image, "jet").collect()} == {0: (127, 255, 255), 1: (255, 255, 255), 2: (255, 255, 127), 3: (127, 0, 0)}
    assert {r.x: (r.r, r.g, r.b) for r in render.colour_map(image).collect()} == {0: (0, 0, 0), 1: (63, 63, 63), 2: (127, 127, 127), 3: (255, 255, 255)}
    three = spark.createDataFrame([(c, 0, x, float(10 * c + x)) for c in range(3) for x in range(2)], "channel int, y int, x int, value double")
    assert {r.x: (r.r, r.g, r.b) for r in render.rgb_image(three).collect()} == {0: (0, 121, 242), 1: (12, 133, 255)}


def test_arrows(spark):
    one = lambda vx, vy: render.flow_image(spark.createDataFrame([(0, 0, vx, vy)], "row int, col int, vx double, vy double"), width=20, height=20, grid=20)
    marked = lambda picture: {(int(y), int(x)) for y, x in zip(*(picture != 255).any(axis=2).nonzero(), strict=True)}
    right = one(3.0, 0.0)
    assert {(10, x) for x in range(10, 19)} <= marked(right) and (14, 14) in marked(right) and (6, 14) in marked(right)
    assert all(tuple(right[y, x]) == (0, 0, 255) for y, x in marked(right))
    assert not marked(one(0.0, 0.0)) and not marked(one(9e-6, 0.0))


def test_overlay_by_hand(spark):
    for alpha in (0.5, 0.3):
        rng = np.random.default_rng(1)
        ps = rng.choice([-1, 1], 40).tolist()
        e = make(spark, [1] * len(ps), [1] * len(ps), np.arange(len(ps)) / 10, ps)
        frame = spark.createDataFrame([(1, 1, 100, 200, 7)], "y int, x int, r int, g int, b int")
        want = [100, 200, 7]
        for p in ps:
            want = [math.floor(old * (1 - alpha) + new * alpha) for old, new in zip(want, (255.0 if p > 0 else 0.0, 0.0, 0.0 if p > 0 else 255.0), strict=True)]
        r = render.overlay_events(e, frame, width=4, height=4, alpha=alpha).first()
        assert [r.r, r.g, r.b] == want


def test_text_order_over_files(spark, tmp_path):
    """Later files are longer, so that the scan takes them first."""
    for k, n in enumerate((3, 40, 500)):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"{k}.{i:04d} {k} {i} 1\n" for i in range(n)))
    rows = readers.read_text(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.x, r.y) for r in rows] == [(k, i) for k, n in enumerate((3, 40, 500)) for i in range(n)] and [r.seq for r in rows] == list(range(543))
    for k, n in enumerate((3, 40)):
        writers.write_binary(make(spark, [k] * n, range(n), np.arange(n) / 10, [1] * n), str(tmp_path / f"{k}.bin"))
    rows = readers.read_binary(spark, f"{tmp_path}/*.bin").orderBy("seq").collect()
    assert [(r.seq, r.x, r.y) for r in rows] == [(3 * k + i, k, i) for k, n in enumerate((3, 40)) for i in range(n)]


def test_exact_edges(spark):
    e = make(spark, [1] * 6, [1] * 6, [0.5, 0.4, 0.6, 0.7, 1.4000000000000001, 1.5], [1] * 6)
    edges = [0.5]
    while edges[-1] <= 1.5:
        edges.append(edges[-1] + 0.1)
    want = {t: next(i for i in range(len(edges) - 1) if edges[i] <= t < edges[i + 1]) for t in (0.5, 0.6, 0.7, 1.4000000000000001, 1.5)}
    assert {r.t: r.w for r in windows.tumbling_exact(e, 0.1).collect()} == want


@pytest.fixture
def nothing_on_the_driver(spark, monkeypatch):
    """What brings rows of a table to the driver, but for collect, fails."""

    def fail(self, *args, **kwargs):
        raise AssertionError("rows go to the driver")

    for name in ("toPandas", "toLocalIterator", "toArrow"):
        monkeypatch.setattr(type(spark.range(0)), name, fail)


def _events(spark, n):
    """Events whose seq has gaps, dealt in another order than theirs; with their rows as seq, t, x, y, p from 0."""
    i = F.col("id")
    e = spark.range(n).select((i * 3 + 5).alias("seq"), (i / 7).alias("t"), (i * 31 % 65_536).cast("int").alias("x"), (i * 17 % 65_536).cast("int").alias("y"), (i % 256 - 128).cast("int").alias("p"))
    return e.repartition(5, F.xxhash64("seq")), [(i, i / 7, i * 31 % 65_536, i * 17 % 65_536, i % 256 - 128) for i in range(n)]


def _query_over(spark, name, n, tmp_path):
    """The rows of a query over n events whose seq is from 1, in their order."""
    from glint.plans.queries import QUERIES

    i = F.col("id")
    spark.range(1, n + 1).select(i.alias("event_id"), F.timestamp_micros(i * 1_000_003).cast("timestamp_ntz").alias("ts"), (i * 5).alias("user_id"), F.lit("view").alias("event_type")).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    want = [(k - 1, k * 1_000_003 / 1e6, k * 5 % 64, k * 12 % 48, 0) for k in range(1, n + 1)]
    made = QUERIES[name](spark, str(tmp_path))
    return sorted(tuple(r) for r in made.collect()), want


def test_array_blocks(spark, nothing_on_the_driver):
    e, want = _events(spark, 5_000)
    blocks = writers.to_array_blocks(e, 700)
    assert sorted((r.first, len(r.xs)) for r in blocks.select("first", "xs").collect()) == [(a, min(700, 5_000 - a)) for a in range(0, 5_000, 700)]
    assert [tuple(r) for r in readers.from_array_blocks(blocks).orderBy("seq").collect()] == want
    assert readers.from_array_blocks(writers.to_array_blocks(e.limit(0))).count() == 0
    uneven = spark.createDataFrame([(0, [1, 2], [1], [0.5, 0.6], [1, 1])], "first long, xs array<long>, ys array<long>, ts array<double>, ps array<long>")
    with pytest.raises(Exception, match="different lengths"):
        readers.from_array_blocks(uneven).collect()


def test_array_source_leaves_events_where_they_lie(spark, nothing_on_the_driver, tmp_path):
    got, want = _query_over(spark, "array_source", 40_000, tmp_path)
    assert got == want


def test_arrays_on_the_driver(spark):
    e, want = _events(spark, 3_000)
    assert [tuple(a) for a in zip(*(x.tolist() for x in writers.to_arrays(e)), strict=True)] == [(x, y, t, p) for _, t, x, y, p in want]
    assert [(len(a), a.dtype.kind) for a in writers.to_arrays(e.limit(0))] == [(0, "i"), (0, "i"), (0, "f"), (0, "i")]


def test_binary_source_leaves_events_where_they_lie(spark, nothing_on_the_driver, tmp_path):
    got, want = _query_over(spark, "binary_source", 40_000, tmp_path)
    assert got == want


@pytest.mark.parametrize("single_file", [True, False])
def test_binary_files_of_many_parts(spark, tmp_path, single_file):
    e, want = _events(spark, 30_000)
    e, path = e.union(e.limit(0)).withColumn("t", F.sqrt("t") - 20), str(tmp_path / "e.bin")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        writers.write_binary(e, path, single_file=single_file)
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
    files = [tmp_path / "e.bin"] if single_file else sorted((tmp_path / "e.bin").glob("part-*"))
    assert len(files) == (1 if single_file else 12) and sum(f.stat().st_size for f in files) == 30_000 * 16 and all(f.stat().st_size % 16 == 0 for f in files)
    assert np.concatenate([np.fromfile(f, readers.RECORD) for f in files])["x"].tolist() == [r[2] for r in want]
    assert [tuple(r) for r in readers.read_events(spark, path).orderBy("seq").collect()] == [(i, math.sqrt(t) - 20, x, y, p) for i, t, x, y, p in want]
    writers.write_binary(e.limit(0), path + "0", single_file=single_file)
    assert readers.read_binary(spark, path + "0").count() == 0


def test_rounding_is_that_of_decimals(spark):
    from glint.functions.pixels import rounded

    rng = np.random.default_rng(2)
    odd = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 0.0, 1e-300, 2.0**52 + 0.5, 2.0**53 + 2, -1e300, 4503599627370495.5, math.inf, -math.inf, math.nan, 65_535.49999999999, 65_535.5]
    values = [*odd, *(np.nextafter(k + 0.5, d) for k in range(-20, 20) for d in (-99, 99)), *(rng.normal(size=2000) * 1000), *(rng.integers(-999, 999, 500) + 0.5)]
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").select(F.round("v").alias("a"), rounded(F.col("v")).alias("b"), F.col("v"))
    assert rows.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def test_grid_search_is_dealt_to_all_cores(spark):
    """A stream in one partition; candidates meet the events in several tasks, and no value is rounded by way of decimals."""
    e = make(spark, [0, 1, 2, 3, 4] * 40, [2] * 200, np.arange(200.0), [1] * 200).coalesce(1)
    scores = motion.grid_scores(e, [(-1.0, 1.0, 0.25), (-0.5, 0.5, 0.5)], width=8, height=4)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "RepartitionByExpression [seq" in plan
    want = []
    for gid, vx, vy in motion.grid([(-1.0, 1.0, 0.25), (-0.5, 0.5, 0.5)]):
        counts = {}
        for i in range(200):
            x, y = (math.copysign(math.floor(abs(v) + 0.5), v) for v in (i % 5 + vx * (i - 199.0), 2 + vy * (i - 199.0)))
            if 0 <= x < 8 and 0 <= y < 4:
                counts[x + 0.0, y + 0.0] = counts.get((x + 0.0, y + 0.0), 0) + 1
        want.append((gid, vx, vy, sum(n * n for n in counts.values()) / 32 - (sum(counts.values()) / 32) ** 2))
    got = sorted(tuple(r) for r in scores.collect())
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_iterator_leaves_events_where_they_lie(spark, nothing_on_the_driver, tmp_path):
    from glint.plans.queries import QUERIES

    _, want = _query_over(spark, "block", 40_000, tmp_path)
    assert sorted(tuple(r) for r in QUERIES["iterator"](spark, str(tmp_path)).collect()) == [r[1:] for r in want]


def test_iterating_apart(spark):
    e, want = _events(spark, 25_000)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")

    def numbers(events):
        for i, (t, x, y, p) in enumerate(events):
            yield i, t, x, y, p
            if p == 0:
                yield -1, None, None, None, None

    try:
        rows = [tuple(r) for r in readers.iterate_apart(e, numbers, "i long, t double, x int, y int, p int").collect()]
        assert list(readers.iterate(e)) == [r[1:] for r in want]
        assert readers.iterate_apart(e.limit(0), numbers, "i long, t double, x int, y int, p int").count() == 0
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
    assert [r[1:] for r in rows if r[0] >= 0] == [r[1:] for r in want]  # a task's in their order, and the tasks in theirs
    assert sum(r[0] == 0 for r in rows) == 6 and sum(r[0] == -1 for r in rows) == sum(r[4] == 0 for r in want)


def test_binary_files_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "PER_FILE", 2, raising=False)
    e, want = _events(spark, 90_000)
    writers.write_binary(e.coalesce(1), str(tmp_path / "e.bin"), single_file=False)
    sizes = [f.stat().st_size for f in (tmp_path / "e.bin").glob("part-*")]
    assert max(sizes) <= 2 * 10_000 * 16 and sum(sizes) == 90_000 * 16
    assert [tuple(r) for r in readers.read_binary(spark, str(tmp_path / "e.bin")).orderBy("seq").collect()] == want
