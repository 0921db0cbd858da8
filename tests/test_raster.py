"""Raster operators: published example values and all oracle queries at sf0.001."""

import math
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import catalog
from rasterloom.operators import align, exposure, lens, merge, repair, stats, stencil, tone, wiener
from rasterloom.plans.job import BurstJob, Sensor
from rasterloom.plans.settings import Settings
from rasterloom.sources import codecs, files, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("part", "lineitem", "events", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


SQL = catalog.oracle_sql(16)  # the side of sf0.001


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(cols).collect()), key=str)
    r = db.execute(SQL[name])
    names = [d[0] for d in r.description]
    want = sorted((tuple(x[names.index(c)] for c in cols) for x in r.fetchall()), key=str)
    assert got and got == want


LARGE = "/root/testdata/sf0.1"  # over 200,000 rows of lineitem


@pytest.fixture(scope="module")
def large_db():
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{LARGE}/lineitem.parquet'")
    return c


@pytest.mark.parametrize("name", ["q_binomial16", "q_bit_depth", "q_box_blur", "q_dense_field", "q_dense_field_weighted", "q_downsample2", "q_expbracket_average", "q_exposure_linear", "q_fourier_shift", "q_freq_align", "q_global_search", "q_highlight_bayer", "q_highlight_mosaic", "q_hot_pixel_mono"])
def test_registered_sql_on_larger_tables(spark, large_db, name):
    df = catalog.QUERIES[name](spark, LARGE)
    cols = sorted(df.columns)
    r = large_db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    want = sorted((tuple(x[names.index(c)] for c in cols) for x in r.fetchall()), key=str)
    assert want and sorted((tuple(r) for r in df.select(cols).collect()), key=str) == want


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Tables of lineitem around 20,000 rows, from which on queries without a side of their own change the grid, and one of five rows."""
    tables = {}
    for n in (5, 19_999, 20_000):
        d, c = tmp_path_factory.mktemp(f"rows{n}"), duckdb.connect()
        c.execute(f"copy (select * from '{LARGE}/lineitem.parquet' limit {n}) to '{d}/lineitem.parquet' (format parquet)")
        c.execute(f"create view lineitem as select * from '{d}/lineitem.parquet'")
        tables[n] = str(d), c
    return tables


@pytest.mark.parametrize("rows", [5, 19_999, 20_000])
@pytest.mark.parametrize("name", ["q_binomial16", "q_bit_depth", "q_box_blur", "q_downsample2", "q_expbracket_average", "q_exposure_linear", "q_fourier_shift", "q_highlight_bayer", "q_highlight_mosaic", "q_hot_pixel_mono"])
def test_registered_sql_at_any_size(spark, small, name, rows):
    d, c = small[rows]
    df = catalog.QUERIES[name](spark, d)
    cols = sorted(df.columns)
    r = c.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    want = sorted((tuple(x[names.index(q)] for q in cols) for x in r.fetchall()), key=str)
    assert want and sorted((tuple(r) for r in df.select(cols).collect()), key=str) == want


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Three rows for each cell; quantities with NaN, infinities and values beyond 64-bit millionths, in frames of their own."""
    d = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    c.execute(f"""copy (select CAST(i + 1024 * k AS BIGINT) AS l_orderkey, CAST(f + 1 AS INTEGER) AS l_linenumber,
      CASE WHEN i % 97 > 0 THEN (i * 7 + f * 13) % 50 WHEN f = 1 THEN 'nan'::DOUBLE WHEN f = 2 THEN 'inf'::DOUBLE WHEN f = 4 THEN -1e14 ELSE 1e14 END AS l_quantity,
      CAST((i * 11 + f * 3 + k) % 50 * 1000 AS DOUBLE) AS l_extendedprice, i % 11 / 100 AS l_discount, (i + k) % 9 / 100 AS l_tax
      from range(7) a(f), range(1024) b(i), range(3) c(k)) to '{d}/lineitem.parquet' (format parquet)""")
    c.execute(f"create view lineitem as select * from '{d}/lineitem.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["q_box_blur", "q_downsample2", "q_expbracket_average", "q_exposure_linear", "q_fourier_shift", "q_highlight_bayer", "q_highlight_mosaic"])
def test_registered_sql_on_odd_values(spark, odd, name):
    df = catalog.QUERIES[name](spark, odd[0])
    r = odd[1].execute(catalog.ORACLE_SQL[name])
    assert [d[0] for d in r.description] == df.columns
    assert sorted(map(str, r.fetchall())) == sorted(str(tuple(x)) for x in df.collect())


@pytest.mark.parametrize("name", ["q_freq_align"])
def test_registered_sql_on_tiny_values(spark, tmp_path, name):
    """Costs that are less than a millionth apart."""
    c = duckdb.connect()
    c.execute(f"""copy (select CAST(i + 1024 * k AS BIGINT) AS l_orderkey, CAST(f + 1 AS INTEGER) AS l_linenumber, (i * i * 31 + i * 7 + f * f * 5) % 50 * 1e-9 AS l_quantity,
      1e3 AS l_extendedprice, 0.01 AS l_discount, 0.02 AS l_tax
      from range(7) a(f), range(1024) b(i), range(3) c(k)) to '{tmp_path}/lineitem.parquet' (format parquet)""")
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = c.execute(catalog.ORACLE_SQL[name]).fetchall()
    assert sorted(want) == sorted(tuple(x) for x in catalog.QUERIES[name](spark, str(tmp_path)).collect())


def test_tile_costs_tie_as_in_the_sql(spark):
    cells = [(0, 0, 0, 0, 0.0), (0, 0, 0, 1, 0.0), (0, 1, 0, 0, 1.0000002), (0, 1, 0, 1, 1.00000048)]
    px = spark.createDataFrame([(b, f, y, x, 0, v) for b, f, y, x, v in cells], "burst int, frame int, y int, x int, c int, v double")
    asks = spark.createDataFrame([(0, 1, 0, 0, 0, -1), (0, 1, 0, 0, 0, 0)], "burst int, frame int, ty int, tx int, dy int, dx int")
    refs = spark.createDataFrame([(0, 0)], "burst int, ref int")
    assert [r.dx for r in align.tile_search(px, refs, asks, 1, 1, (1, 1)).collect()] == [0]


def test_frame_costs_tie_as_in_the_sql(spark):
    costs = spark.createDataFrame([(0, -1, 1.00000048), (0, 1, 1.0000002), (0, 2, 1.00000019)], "dy int, dx int, sad double")
    assert costs.agg(align._first_best("sad").alias("b")).first().b.dx == 1


def stack(spark, frames, scales=None, ref=0):
    """frames: for each frame the channel values of one pixel."""
    rows = [(0, f, 0, 0, c, float(v), ref, (scales or {}).get(f, 1.0), 1 / (scales or {}).get(f, 1.0)) for f, vs in enumerate(frames) for c, v in enumerate(vs)]
    return spark.createDataFrame(rows, "burst int, frame int, y int, x int, c int, v double, ref int, scale double, wn double")


def values(df):
    return [r.v for r in df.orderBy("c").collect()]


def test_median_examples(spark):
    for frames, want in (([10, 20, 30, 40, 50], 30), ([10, 20, 30, 40], 25), ([10, 20, 30, 40, 5000], 30), ([10], 10)):
        assert values(merge.temporal_median(stack(spark, [[v] for v in frames]), None)) == [want]
    clip = 0.98 * 1023
    px = stack(spark, [[1010, 100, 100, 100], [120] * 4, [1010, 120, 120, 120], [110] * 4])
    assert values(merge.temporal_median(px, clip)) == [1010, 110, 110, 110]
    assert values(merge.temporal_median(stack(spark, [[100] * 4, [120] * 4, [120] * 4, [110] * 4]), clip)) == [115] * 4
    assert values(merge.temporal_median(stack(spark, [[100], [600]], {1: 0.5}), clip)) == [100]


def test_exposure_examples(spark):
    def one(ev):
        f = spark.createDataFrame([(0, i, float(e), 0.0) for i, e in enumerate(ev)], "burst int, frame int, ev double, bias double")
        c = exposure.classify(f).first()
        return c.has_exposure, c.is_bracketed, c.needs_chained, exposure.select_reference(f).first().ref

    assert one([1, 1, 1]) == (True, False, False, 1)
    assert one([1, 1.25, 1.5]) == (True, True, False, 0)
    assert one([1, 0.25, 4]) == (True, True, True, 1)
    assert one([0, 0])[:3] == (False, False, False)
    assert align.chained_order([(0.25, 1), (1.0, 0), (4.0, 2)], 1, [0, 1, 2, 3]) == [(0, 1), (2, 0), (3, 1)]


def test_weighting_example(spark):
    px = stack(spark, [[100], [90], [110]], {1: 2.0, 2: 0.5})
    assert values(merge.spatial(px, 8.0, 0.0, 1e6, 0.0, multi=False)) == [pytest.approx(100)]
    assert values(merge.spatial(px, 8.0, 0.0, 1e6, 0.0, multi=False, weighted=True)) == [pytest.approx(365 / 3.5)]


def test_recovery_examples(spark):
    def planes(cells, n):
        rows = [(0, 0, y, x, c, float(cells.get((y, x), {}).get(c, 500))) for y in range(3) for x in range(3) for c in range(n)]
        return spark.createDataFrame(rows, "burst int, frame int, y int, x int, c int, v double")

    bayer = planes({(1, 1): {0: 995, 1: 850, 3: 991}, (1, 2): {0: 995}, (0, 1): {3: 991}}, 4)
    got = repair.recover_bayer(bayer, 1000.0, 1.0, 1.0).where("y = 1 AND x = 1 AND c = 1").first().v
    assert got == pytest.approx(882.175)
    flat = repair.recover_linear(planes({(1, 1): {0: 995, 1: 850, 2: 991}}, 3), 1000.0, 1.0, 1.0)
    assert flat.where("y = 1 AND x = 1 AND c = 1").first().v == pytest.approx(882.175)
    dark = repair.recover_linear(planes({(1, 1): {0: 995, 1: 700, 2: 991}}, 3), 1000.0, 1.0, 1.0)
    assert dark.where("y = 1 AND x = 1 AND c = 1").first().v == 700


def ramp(spark, shift=(3, 2)):
    a = np.arange(32 * 32).reshape(32, 32) % 1024 * 1.0
    b = np.zeros_like(a)
    b[shift[1] :, shift[0] :] = a[: -shift[1], : -shift[0]]
    rows = [(0, f, y, x, 0, float(v[y, x])) for f, v in enumerate((a, b)) for y in range(32) for x in range(32)]
    return spark.createDataFrame(rows, "burst int, frame int, y int, x int, c int, v double")


def test_alignment(spark):
    px, refs = ramp(spark), spark.createDataFrame([(0, 0)], "burst int, ref int")
    r = align.sparse_sad(px, refs, 4, 32, 32).first()
    assert (r.dx, r.dy) == (-3, -2)
    assert {(r.dx, r.dy) for r in align.standard_field(px, refs, 16, 32, 32).where("ty = 0 AND tx = 0").collect()} == {(-3, -2)}
    assert {(r.dx, r.dy) for r in align.skip(px, refs).collect()} == {(0, 0)}
    assert stencil.pyramid_sizes(128, 128, 16)[:2] == [(128, 128), (64, 64)] and stencil.pyramid_sizes(8, 8, 16) == [(8, 8)]


def far_pair(spark, shift=(6, 4), side=64):
    """Two frames of a smooth field; the second is the first moved by more than a tile's own search reaches."""
    rng = np.random.default_rng(5)
    a = rng.random((side, side))
    for _ in range(3):
        a = (a + np.roll(a, 1, 0) + np.roll(a, 1, 1) + np.roll(a, (1, 1), (0, 1))) / 4
    a = np.round(1000 * (a - a.min()) / (a.max() - a.min()))
    b = np.roll(a, (shift[1], shift[0]), (0, 1))
    rows = [(0, f, y, x, 0, float(v[y, x])) for f, v in enumerate((a, b)) for y in range(side) for x in range(side)]
    return a, spark.createDataFrame(rows, "burst int, frame int, y int, x int, c int, v double")


def test_global_search(spark):
    a, px = far_pair(spark)
    refs = spark.createDataFrame([(0, 0)], "burst int, ref int")
    found = align.global_search(px, refs, 16, 64, 64).first()
    assert (found.dx, found.dy, found.sad, found.confidence) == (-6, -4, 0.0, 1.0)
    tiny = align.global_search(px.where("y < 1 AND x < 1"), refs, 16, 1, 1).first()
    assert (tiny.dx, tiny.dy) == (0, 0)
    none = align.global_search(px.where("frame = 0"), refs, 16, 64, 64)
    assert none.count() == 0
    frames = spark.createDataFrame([(0, i, 1.0, 0.0, 1023.0, 0.0) for i in range(2)], "burst int, frame int, ev double, bias double, white double, black double")
    out = BurstJob(px, frames, Settings(merge="median", align="standard", tile=16, depth=10)).run().collect()
    want = np.roll(a, (4, 6), (0, 1))  # of two frames the second is the reference
    # tiles at the upper and left border pay for cells outside and pass their shift on to the next ones, so only cells that none of them feeds are whole
    inner = [r for r in out if r.y >= 48 and r.x >= 32]
    assert len(inner) == 512 and all(abs(r.v - want[r.y, r.x]) <= 1 for r in inner)


def seeded_refinement(frames, ref, tile=4, side=16):
    """Plain version of q_refine_wavefront: two levels of whole-frame search, then tiles from the seed and the tiles before."""

    def search(a, b, start, step):
        n, found = len(a), []
        for dy in range(start[0] - 3, start[0] + 4):
            for dx in range(start[1] - 3, start[1] + 4):
                d = [abs(a[y, x] - b[y - dy, x - dx]) for y in range(abs(dy), n - abs(dy), step) for x in range(abs(dx), n - abs(dx), step)]
                found += [(round(sum(d) / len(d), 6), dy, dx)] if d else []
        return min(found)[1:] if found else start

    def cost(a, b, ty, tx, dy, dx):
        cells = [(y, x) for y in range(ty * tile, (ty + 1) * tile) for x in range(tx * tile, (tx + 1) * tile)]
        return sum(abs(a[y, x] - b[y - dy, x - dx]) if 0 <= y - dy < side and 0 <= x - dx < side else align.OUTSIDE for y, x in cells)

    half = lambda v: v.reshape(side // 2, 2, side // 2, 2).mean((1, 3))
    seeds, out = {}, {}
    for f, b in frames.items():
        if f == ref:
            continue
        a = frames[ref]
        coarse = search(half(a), half(b), (0, 0), 4)
        seeds[f] = search(a, b, (2 * coarse[0], 2 * coarse[1]), 8)
        for ty in range(side // tile):
            for tx in range(side // tile):
                at = seeds[f]
                for before in ([(ty, tx - 1)] if tx else []) + ([(ty - 1, tx)] if ty else []):
                    at = tuple(int((p + q) / 2) for p, q in zip(at, out[f, *before]))
                out[f, ty, tx] = min((round(cost(a, b, ty, tx, at[0] + y, at[1] + x), 6), at[0] + y, at[1] + x) for y in range(-3, 4) for x in range(-3, 4))[1:]
    return seeds, out


def test_refine_wavefront_is_seeded(spark):
    frames = {}
    for r in catalog.px(spark, SF).collect():
        frames.setdefault(r.frame, np.zeros((16, 16)))[r.y, r.x] = r.v
    seeds, want = seeded_refinement(frames, 3)
    assert any(s != (0, 0) for s in seeds.values())
    assert {(r.frame, r.ty, r.tx): (r.dy, r.dx) for r in catalog.QUERIES["q_refine_wavefront"](spark, SF).collect()} == want


def test_freq_align_pyramid(spark):
    """Two levels of half-overlapping tiles by brute force: absolute cost, the parent's doubled shift, no neighbour correction."""
    frames = {}
    for r in catalog.px(spark, SF).collect():
        frames.setdefault(r.frame, np.zeros((16, 16)))[r.y, r.x] = r.v
    half = lambda v: v.reshape(8, 2, 8, 2).mean((1, 3))

    def best(a, b, ty, tx, start):
        n, found = len(a), []
        for dy in range(start[0] - 3, start[0] + 4):
            for dx in range(start[1] - 3, start[1] + 4):
                cells = [(y, x) for y in range(2 * ty, 2 * ty + 4) for x in range(2 * tx, 2 * tx + 4)]
                cost = sum(abs(a[y, x] - b[y - dy, x - dx]) if 0 <= y - dy < n and 0 <= x - dx < n else align.OUTSIDE for y, x in cells)
                found.append((round(cost, 6), dy, dx))
        return min(found)[1:]

    want = {}
    for f in frames.keys() - {3}:
        coarse = {(ty, tx): best(half(frames[3]), half(frames[f]), ty, tx, (0, 0)) for ty in range(3) for tx in range(3)}
        for ty in range(7):
            for tx in range(7):
                up = coarse[min(ty // 2, 2), min(tx // 2, 2)]
                want[f, ty, tx] = best(frames[3], frames[f], ty, tx, (2 * up[0], 2 * up[1]))
    got = {(r.frame, r.ty, r.tx): (r.dy, r.dx) for r in catalog.QUERIES["q_freq_align_pyramid"](spark, SF).collect()}
    assert len(got) == 6 * 49 and got == want


def test_tone():
    assert [tone.target_white(d, 1000.0) for d in (12, 14, 16, 99)] == [4095, 16383, 65535, 1000]
    assert [tone.snap_depth(d, f) for d, f in ((14, "png"), (7, "tiff"), (16, "bmp"), (20, "dng"))] == [16, 8, 8, 16]
    assert [round(stats.robustness(n), 2) for n in (8, 13, 17)] == [4.27, 2.0, 1.0]


def plain_wiener(frames, ref, scale, wn, nr, robust, white, black):
    """The frequency merge by loops over passes, tiles, bins and cells."""
    import cmath

    r = frames[ref]
    height, width, channels = r.shape
    others = [i for i in range(len(frames)) if i != ref]
    rev = 0.5 * (26.5 - int(nr + 0.5))
    read, norm, most = (2 ** (10 - rev)) ** 1.6, 2 ** (7.5 - rev), max(1, 1.3 ** (11 - rev))
    clamp = lambda v, low=0, high=1: min(high, max(low, v))
    bell = lambda i, n: 1.0 if n <= 1 else 0.5 - 0.5 * math.cos(2 * math.pi * (i + 0.5) / n)
    wide = lambda i: 0.5 - 0.17 * math.cos(2 * math.pi * (i + 0.5) / 8)
    sharp = [0, 0.02, 0.04, 0.08, 0.04, 0.08, 0.04, 0.02]

    def tile(y0, x0):
        h, w = min(8, height - y0), min(8, width - x0)
        cells = [(y, x) for y in range(h) for x in range(w)]
        window = {(y, x): bell(y, h) * bell(x, w) for y, x in cells}

        def spectrum(a):
            return {(fy, fx): sum(a[y0 + y, x0 + x] * window[y, x] * cmath.exp(-2j * math.pi * (fy * y / h + fx * x / w)) for y, x in cells) for fy, fx in cells}

        own = spectrum(r)
        total = dict(own)
        rms = sum(0.25 * math.sqrt(sum(max(0, r[y0 + y, x0 + x, c]) ** 2 for y, x in cells)) / 8 for c in range(channels)) / channels
        facts = []
        for i in others:
            ef, top, bottom = 1 / max(1e-6, scale[i]), 0.0, 0.0
            for y in range(max(0, y0 - 4), min(height, y0 + 12)):
                for x in range(max(0, x0 - 4), min(width, x0 + 12)):
                    k = wide(y - y0 + 4) * wide(x - x0 + 4)
                    top, bottom = top + k * abs(r[y, x] - frames[i][y, x]).mean(), bottom + k
            clipped = sum(clamp(((max(0, frames[i][y0 + y, x0 + x].max()) * ef + black) / max(1, white) - 0.5) / 0.49) for y, x in cells) / len(cells)
            facts.append([top / bottom / max(1e-9, math.sqrt(0.5 * rms + 0.5 * rms / max(1, ef) + 1)), clamp((1 - clipped) ** 2, 0.04 / min(max(1, ef), 4)), ef])
        mean = sum(f[0] for f in facts) / len(facts)
        for f in facts:
            f[0] = clamp(f[0] * 0.12 / max(1e-12, mean))
        for i, (mm, bright, ef) in zip(others, facts):
            theirs, best = spectrum(frames[i]), None
            for iy in range(-3, 4):
                for ix in range(-3, 4):
                    moved = {(fy, fx): v * cmath.exp(-2j * math.pi * (fx * ix / 6 / w + fy * iy / 6 / h)) for (fy, fx), v in theirs.items()}
                    cost = sum((abs(own[k] - v) ** 2).sum() for k, v in moved.items())
                    if best is None or cost < best[0]:
                        best = cost, moved
            for k, v in best[1].items():
                d2, noise = abs(own[k] - v) ** 2, (rms + read) * 64 * norm
                if robust:
                    size = 1.0
                    if sum(k) and mm < 0.3 and abs(ef - 1) < 1e-3:
                        size = clamp(1 - 10 * (mm - 0.2)) * clamp((abs(v).sum() / max(1e-12, abs(own[k]).sum())) ** 4, 0.5, 3)
                    noise *= size * min(4, ef) * math.sqrt(clamp(most - (mm - 0.02) * (most - 1) / 0.15, 1, most)) * bright
                q = d2 / (d2 + max(1e-9, noise))
                q = clamp(0.5 * (q.sum() - q.min() - q.max()) if channels >= 4 else q.mean())
                total[k] = total[k] + (1 if robust else wn[i]) * ((1 - q) * v + q * own[k])
        if robust:
            mean, zero = sum(f[0] for f in facts) / len(facts), abs(total[0, 0]).sum()
            for fy, fx in cells:
                if fy + fx and mean < 0.3:
                    more = clamp(1 - 10 * (mean - 0.2)) * clamp(1.25 - 25 * abs(total[fy, fx]).sum() / max(1e-12, zero))
                    total[fy, fx] = total[fy, fx] * (1 + more * sharp[fx]) * (1 + more * sharp[fy])
        share = 1 + (len(others) if robust else sum(wn[i] for i in others))
        return {(y, x): (sum(v * cmath.exp(2j * math.pi * (fy * y / h + fx * x / w)) for (fy, fx), v in total.items()).real / (h * w) / share, window[y, x]) for y, x in cells}

    made = {(y, x): tile(y, x) for y in range(0, height, 4) for x in range(0, width, 4)}
    out, count = np.zeros_like(r), np.zeros((height, width, 1))
    for oy, ox in ((0, 0), (0, 4), (4, 0), (4, 4)) if robust else ((0, 0),):
        total, weight = np.zeros_like(r), np.zeros((height, width, 1))
        for (y0, x0), cells in made.items():
            if y0 >= oy and x0 >= ox:
                for (y, x), (v, k) in cells.items():
                    total[y0 + y, x0 + x] += v
                    weight[y0 + y, x0 + x] += k
        v = total / np.maximum(1e-6, weight)
        out += np.maximum(v, -1) if robust else v
        count += weight > 1e-6
    return out / np.maximum(1, count)


@pytest.mark.parametrize("robust", [False, True])
def test_wiener_like_loops(spark, robust):
    """Unequal frames with edge tiles, as arrays and in blocks of a table."""
    rng = np.random.default_rng(1)
    base = 100 + 50 * rng.random((11, 14, 4))
    frames = [base + rng.normal(size=base.shape) * s for s in (0, 3, 9)]
    frames[2][3:7] += 30
    scale = [1.0, 1.0, 0.6]
    want = plain_wiener(frames, 1, scale, [1 / s for s in scale], 13, robust, 200, 10)
    got = wiener.merge_arrays(frames, 1, scale, [1 / s for s in scale], 13, robust, 200, 10)
    assert np.abs(got - want).max() < 1e-4
    one = wiener.merge_arrays([f[..., :1] for f in frames], 1, scale, [1.0] * 3, 13, robust, 200, 10)
    assert np.abs(one - plain_wiener([f[..., :1] for f in frames], 1, scale, [1.0] * 3, 13, robust, 200, 10)).max() < 1e-4


@pytest.mark.parametrize("robust", [False, True])
def test_wiener_blocks(spark, monkeypatch, robust):
    """A frame over several blocks gives the same as one array; a burst without comparisons keeps its frame."""
    rng = np.random.default_rng(2)
    frames = [100 + 50 * rng.random((45, 70, 1)) for _ in range(2)]
    rows = [(0, f, y, x, 0, float(v[y, x, 0]), 0, 1.0, 1.0) for f, v in enumerate(frames) for y in range(45) for x in range(70)]
    px = spark.createDataFrame(rows, "burst int, frame int, y int, x int, c int, v double, ref int, scale double, wn double")
    got = wiener.merge(px, 13, robust, True, 200, 10).toPandas().set_index(["y", "x"]).v
    want = wiener.merge_arrays(frames, 0, [1.0, 1.0], [1.0, 1.0], 13, robust, 200, 10)
    assert len(got) == 45 * 70 and max(abs(got[y, x] - want[y, x, 0]) for y in range(45) for x in range(70)) < 1e-9
    alone = wiener.merge(px.where("frame = 0"), 13, robust, True, 200, 10).toPandas().set_index(["y", "x"]).v
    assert max(abs(alone[y, x] - frames[0][y, x, 0]) for y in range(45) for x in range(70)) < 1e-9


def test_blocks_like_whole_arrays(spark):
    """Blurs and tile searches of a frame over several blocks."""
    from rasterloom.operators import blocks

    rng = np.random.default_rng(3)
    a = np.round(100 * rng.random((70, 133)), 3)
    b = np.roll(a, (2, -3), (0, 1))
    rows = [(0, f, y, x, 0, float(v[y, x])) for f, v in enumerate((a, b)) for y in range(70) for x in range(133)]
    px = spark.createDataFrame(rows, "burst int, frame int, y int, x int, c int, v double").repartition(3)
    for got, kernel in ((stencil.box_blur(px, 3), blocks.box(3)), (stencil.binomial16(px), blocks.separable({k: float(math.comb(32, 16 + k)) for k in range(-5, 6)}, True))):
        got = got.where("frame = 0").toPandas().set_index(["y", "x"]).v
        want = kernel(a)
        assert len(got) == a.size and max(abs(got[y, x] - want[y, x]) for y in range(70) for x in range(133)) < 1e-9
    refs = spark.createDataFrame([(0, 0)], "burst int, ref int")
    best = align.sparse_sad(px, refs, 4, 133, 70, 2).first()
    assert (best.dx, best.dy) == (3, -2)
    grid = align.dense_grid(133, 70, 16)
    field = align.tile_search(px, refs, align.around(align.zero_field(px, refs, grid), 3), 16, 8, grid).collect()
    assert len(field) == grid[0] * grid[1] and sum((r.dx, r.dy, round(r.cost, 6)) == (3, -2, 0.0) for r in field) > 0.6 * len(field)


def test_lens(spark):
    knots = [int(-400 * math.sin(i / 7)) for i in range(16)]
    text = spark.createDataFrame([(1, "16 " + " ".join(map(str, knots)))], "id int, t string").select("id", lens.parse_knots(F.col("t")).alias("k"))
    assert text.first().k == knots
    points = text.select("id", F.explode(lens.distortion_points(F.col("k"))).alias("p")).select("id", "p.*")
    got = lens.solve(lens.moments(points, "id", 3), "id", 3).first().k
    x = (np.arange(16) / 15) ** 2
    y = (1 + np.array(knots) / 16384) / (1 + knots[15] / 16384)
    assert got == pytest.approx(np.polyfit(x, y, 3)[::-1], abs=1e-5)
    want = struct.pack(">I", 2) + struct.pack(">4I", 1, 0x01030000, 1, 68) + struct.pack(">I8d", 1, 1, 0.5, 0.25, 0.125, 0, 0, 0.5, 0.5) + struct.pack(">4I", 3, 0x01030000, 1, 56) + struct.pack(">7d", 1, 2, 3, 4, 5, 0.5, 0.5)
    assert lens.opcode_list([1, 0.5, 0.25, 0.125], [1, 2, 3, 4, 5]) == want
    assert lens.opcode_list([1, 0.5, 0.25, 0.125]) == struct.pack(">I", 1) + want[4:88]


def test_codecs():
    rng = np.random.default_rng(0)
    for n in (1, 3, 4):
        for kind in (np.uint8, np.uint16):
            image = rng.integers(0, np.iinfo(kind).max + 1, (13, 17, n)).astype(kind)
            for encode, decode in ((codecs.encode_png, codecs.decode_png), (codecs.encode_tiff, codecs.decode_tiff)):
                got, white = decode(encode(image))
                assert (got == image).all() and white == np.iinfo(kind).max
    for bad in (codecs.decode_png, codecs.decode_tiff, codecs.decode_bmp):
        with pytest.raises(ValueError):
            bad(b"nothing of the kind, by any measure")


def png(w, h, bits, colour, rows, chunks=()):
    """A PNG of raw filtered rows."""
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + b"".join(chunk(k, b) for k, b in chunks) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_png_kinds():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (10, 9, 3))
    rows, flat = [], image.reshape(10, -1)
    for y in range(10):  # all five filters, by definition
        kind, line = y % 5, []
        for i in range(27):
            a, b, c = (int(flat[yy, ii]) if yy >= 0 and ii >= 0 else 0 for yy, ii in ((y, i - 3), (y - 1, i), (y - 1, i - 3)))
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((int(flat[y, i]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        rows.append(bytes([kind, *line]))
    assert (codecs.decode_png(png(9, 10, 8, 2, rows))[0] == image).all()
    palette = bytes(range(12))
    got, white = codecs.decode_png(png(5, 1, 2, 3, [b"\0" + bytes([0b00011011, 0b10000000])], [(b"PLTE", palette)]))
    assert got[0].tolist() == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11], [6, 7, 8]] and white == 255
    got, _ = codecs.decode_png(png(5, 1, 2, 3, [b"\0" + bytes([0b00011011, 0b10000000])], [(b"PLTE", palette), (b"tRNS", b"\7")]))
    assert got[0, :, 3].tolist() == [7, 255, 255, 255, 255]
    assert codecs.decode_png(png(4, 1, 1, 0, [b"\0" + bytes([0b01010000])]))[0].ravel().tolist() == [0, 255, 0, 255]
    got, white = codecs.decode_png(png(2, 1, 16, 4, [b"\0" + struct.pack(">4H", 1, 2, 60000, 4)]))
    assert got.tolist() == [[[1], [60000]]] and white == 65535
    with pytest.raises(ValueError):
        codecs.decode_png(png(2, 1, 8, 0, [b"\7ab"]))


def tiff(order, tags, body):
    """A TIFF whose strip begins at byte 8."""
    kinds = {3: "H", 4: "I"}
    n, more, entries = len(tags), b"", b""
    start = 8 + len(body)
    start += start % 2
    for tag, kind, values in tags:
        packed = struct.pack(f"{order}{len(values)}{kinds[kind]}", *values)
        if len(packed) > 4:
            at = start + 6 + 12 * n + len(more)
            more += packed
            packed = struct.pack(order + "I", at)
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, start)
    return (head + body).ljust(start, b"\0") + struct.pack(order + "H", n) + entries + b"\0\0\0\0" + more


def lzw(data):
    """TIFF's LZW of data, by the book."""
    table, width, bits, word, out = {bytes([i]): i for i in range(256)}, 9, "", b"", []
    emit = lambda code: out.append(format(code, f"0{width}b"))
    emit(256)
    size = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        emit(table[word])
        table[longer] = size
        size += 1
        if size == 4095:
            emit(256)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        else:
            width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
        word = data[i : i + 1]
    emit(table[word])
    size += 1
    width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
    emit(257)
    bits = "".join(out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_tiff_kinds():
    rng = np.random.default_rng(5)
    base = lambda w, h, bits, n, form, packing, length, more=(): [(256, 3, [w]), (257, 3, [h]), (258, 3, [bits] * n), (259, 3, [packing]), (262, 3, [1 if n == 1 else 2]), (273, 4, [8]), (277, 3, [n]), (278, 3, [h]), (279, 4, [length]), (339, 3, [form] * n), *more]
    for order in "<>":
        for kind, form, white in (("u1", 1, 255), ("u2", 1, 65535), ("u4", 1, 4294967295), ("i1", 2, 127), ("i2", 2, 32767), ("i4", 2, 2147483647), ("f4", 3, 1)):
            a = (rng.random((4, 5, 3)) * 100).astype(order + kind)
            body = a.tobytes()
            got, level = codecs.decode_tiff(tiff(order, base(5, 4, 8 * a.itemsize, 3, form, 1, len(body)), body))
            assert (got == a).all() and level == white
    a = np.repeat(rng.integers(0, 256, (40, 50, 1)), 3, 2).astype("u1")
    for packing, body in ((8, zlib.compress(a.tobytes())), (5, lzw(a.tobytes()))):
        assert (codecs.decode_tiff(tiff("<", base(50, 40, 8, 3, 1, packing, len(body)), body))[0] == a).all()
    packed = bytes([2, 1, 2, 3, 254, 9, 128, 0, 7])
    assert codecs.decode_tiff(tiff("<", base(7, 1, 8, 1, 1, 32773, len(packed)), packed))[0].ravel().tolist() == [1, 2, 3, 9, 9, 9, 7]
    steps = np.diff(a.astype(int), axis=1, prepend=0).astype("u1")
    body = zlib.compress(steps.tobytes())
    assert (codecs.decode_tiff(tiff("<", base(50, 40, 8, 3, 1, 8, len(body), [(317, 3, [2])]), body))[0] == a).all()
    planes = np.moveaxis(a, 2, 0).tobytes()
    tags = [t for t in base(50, 40, 8, 3, 1, 1, 0) if t[0] not in (273, 279)] + [(273, 4, [8, 2008, 4008]), (279, 4, [2000] * 3), (284, 3, [2])]
    assert (codecs.decode_tiff(tiff("<", sorted(tags), planes))[0] == a).all()
    cells = np.zeros((2, 16, 16, 1), "u1")
    cells[0, :10], cells[1, :10, :4] = a[:10, :16, :1], a[:10, 16:20, :1]
    tags = [t for t in base(20, 10, 8, 1, 1, 1, 0) if t[0] not in (273, 278, 279)] + [(322, 3, [16]), (323, 3, [16]), (324, 4, [8, 264]), (325, 4, [256, 256])]
    assert (codecs.decode_tiff(tiff("<", sorted(tags), cells.tobytes()))[0] == a[:10, :20, :1]).all()
    for bad in ([(262, 3, [5])], [(258, 3, [10])]):
        tags = [t for t in base(5, 4, 8, 1, 1, 1, 20) if t[0] != bad[0][0]] + bad
        with pytest.raises(ValueError):
            codecs.decode_tiff(tiff("<", sorted(tags), b"\0" * 20))


def test_images_by_extension(spark, tmp_path):
    """Inputs in order, each by its decoder; JPEG as Spark's image source reads it."""
    rng = np.random.default_rng(6)
    y, x = np.mgrid[0:24, 0:33]
    image = np.stack([y * 5, x * 4, y + x], -1).astype(np.uint8)
    made = {"b.png": codecs.encode_png(image), "a.bmp": codecs.encode_bmp(image), "d.TIF": codecs.encode_tiff(image.astype(np.uint16) * 257), "c.jpg": codecs.encode_jpeg(image), "e.jpeg": codecs.encode_jpeg(image[..., :1]), "f.jpg": codecs.encode_jpeg(rng.integers(0, 256, (24, 33, 3)).astype(np.uint8))}
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "sub").mkdir()
    for name, data in made.items():
        (folder / name).write_bytes(data)
    (tmp_path / "first.png").write_bytes(made["b.png"])
    names = files.listed(spark, [str(tmp_path / "first.png")], [str(folder)])
    assert [r.path.rsplit("/", 1)[-1] for r in names.orderBy("frame").collect()] == ["first.png", "a.bmp", "b.png", "c.jpg", "d.TIF", "e.jpeg", "f.jpg"]
    got = files.images(spark, names).toPandas()
    for frame, name in enumerate(["b.png", "a.bmp", "b.png", "c.jpg", "d.TIF", "e.jpeg", "f.jpg"]):
        g = got[got.frame == frame]
        n = 1 if name == "e.jpeg" else 3
        back = np.zeros((24, 33, n))
        back[g.y, g.x, g.c] = g.v
        assert len(g) == back.size and set(g.white) == {65535.0 if name == "d.TIF" else 255.0}
        if name == "f.jpg":
            continue  # noise: only that it is read
        want = image[..., :n].astype(float) * (257 if name == "d.TIF" else 1)
        assert np.abs(back - want).max() <= (6 if "jp" in name else 0), name
    for bad in (lambda: files.listed(spark, [], [str(tmp_path / "none")]), lambda: files.listed(spark, [], [str(tmp_path / "first.png")]), lambda: files.listed(spark), lambda: files.images(spark, spark.createDataFrame([(0, "x.txt")], "frame int, path string")), lambda: files.decode("x.txt", b"")):
        with pytest.raises(ValueError):
            bad()
    (folder / "z.txt").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported input file format"):
        files.known(files.scan(spark, str(folder)).withColumn("burst", F.lit(0)).drop("content")).collect()


def test_raw_samples(spark):
    data = [(0, 0, np.arange(12, dtype="<u2").tobytes())]
    got = files.raw_samples(spark.createDataFrame(data, "burst int, frame int, content binary"), "u16", 3, 2, 0.5).orderBy("y", "x", "c").collect()
    assert [(r.y, r.x, r.c, r.v) for r in got] == [(i // 6, i // 2 % 3, i % 2, i / 2) for i in range(12)]
    got = files.raw_samples(spark.createDataFrame([(0, 1, np.array([0.25, 4], "<f4").tobytes())], "burst int, frame int, content binary"), "f32", 2).collect()
    assert [(r.frame, r.x, r.v) for r in got] == [(1, 0, 0.25), (1, 1, 4.0)]


def test_sinks(spark, tmp_path):
    assert [sinks.format_of(p, a, r) for p, a, r in (("x.jpg", "auto", True), ("x", "auto", True), ("x", "auto", False), ("x.tif", "png", False), ("x.TIFF", "auto", False))] == ["jpeg", "dng", "png", "png", "tiff"]
    assert [sinks.resolve_path(p, f) for p, f in (("o/x.jpeg", "jpeg"), ("o/x.png", "tiff"), ("o", "bmp"), ("", "png"))] == ["o/x.jpeg", "o/x.tif", "o/burst_output.bmp", "burst_output.png"]
    assert sinks.white_of([0.0, 1.0, 1023.0, 255.0]) == 1023.0 and sinks.white_of([1.0]) == 255.0
    image = np.add.outer(np.arange(6), np.arange(8))[..., None] * np.array([1.0, 2.0, 3.0])
    rows = [(0, y, x, c, float(image[y, x, c])) for y in range(6) for x in range(8) for c in range(3)]
    px = spark.createDataFrame(rows, "burst int, y int, x int, c int, v double")
    for name, depth, top in (("a.png", 14, 65535), ("b.tif", 8, 255), ("c.bmp", 16, 255), ("d.png", 8, 255)):
        path = sinks.write(spark, px, str(tmp_path / name), depth, whites=[40.0])
        got, _ = files.decode(path, open(path, "rb").read())
        assert (got == np.floor(image * top / 40 + 0.5).clip(0, top)).all()
    path = sinks.write(spark, px, str(tmp_path / "e"), 8, "jpeg", [40.0])
    assert path.endswith("e/burst_output.jpg") and open(path, "rb").read()[:2] == b"\xff\xd8"
    gray = sinks.dump_gray(spark, px.where("c = 0"), str(tmp_path / "g.bmp"), 40.0)
    assert files.decode(gray, open(gray, "rb").read())[0].shape == (6, 8, 3)
    for bad in (lambda: sinks.write(spark, px, str(tmp_path / "x.dng")), lambda: sinks.format_of("x", "gif"), lambda: sinks.check_channels("jpeg", 4)):
        with pytest.raises(ValueError):
            bad()
    field = spark.createDataFrame([(0, f, ty, tx, 10 * ty + tx, f) for f in (1, 2) for ty in range(2) for tx in range(3)], "burst int, frame int, ty int, tx int, dx int, dy int")
    sinks.dump_field(field, str(tmp_path / "field"))
    assert [r.value for r in spark.read.text(str(tmp_path / "field/burst=0/frame=2")).collect()] == ["0 2", "1 2", "2 2", "10 2", "11 2", "12 2"]
    sinks.dump_region(spark.createDataFrame([(1, 0, 2.5), (0, 0, 1.5)], "x int, y int, raw_value double"), str(tmp_path / "region"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "region")).collect()] == [("0", "0", "1.5"), ("1", "0", "2.5")]


def frame_rows(spark, n, ev=1.0, white=1023.0, black=0.0):
    return spark.createDataFrame([(0, i, ev, 0.0, white, black) for i in range(n)], "burst int, frame int, ev double, bias double, white double, black double")


@pytest.mark.parametrize("merge_name", ["spatial", "median", "average", "expbracket", "frequency"])
def test_job(spark, merge_name):
    rows = [(0, f, y, x, 0, float((y * 16 + x) % 251)) for f in range(3) for y in range(16) for x in range(16)]
    px = spark.createDataFrame(rows, "burst int, frame int, y int, x int, c int, v double")
    out = BurstJob(px, frame_rows(spark, 3), Settings(merge=merge_name, align="dense" if merge_name == "median" else "skip", depth=10)).run().collect()
    assert len(out) == 256 and all(abs(r.v - (r.y * 16 + r.x) % 251) <= 1 for r in out)


@pytest.mark.parametrize("merge_name,mode", [("spatial", "standard"), ("spatial", "linear"), ("median", ""), ("average", ""), ("expbracket", ""), ("frequency", "laplacian"), ("frequency", "wiener"), ("frequency", "wiener-robust")])
@pytest.mark.parametrize("period", [2, 3])
def test_job_on_a_mosaic(spark, merge_name, mode, period):
    """A mosaic is taken apart, merged by cell and put together again, with the black level back in."""
    if period == 3 and merge_name != "spatial" and mode != "laplacian":
        pytest.skip("one of each is enough")
    value = lambda y, x: float(64 + 100 * (1 + (y % period * period + x % period)) + (y // period + x // period) % 7)
    rows = [(0, f, y, x, 0, value(y, x)) for f in range(3) for y in range(19) for x in range(22)]
    px = spark.createDataFrame(rows, "burst int, frame int, y int, x int, c int, v double")
    options = {"spatial_mode": mode} if merge_name == "spatial" else {"frequency_mode": mode} if mode else {}
    stages = []
    job = BurstJob(px, frame_rows(spark, 3, white=4095.0, black=64.0), Settings(merge=merge_name, align="skip", depth=12, hot_pixels=True, **options), sensor=Sensor(period=period, pattern=(0, 1, 1, 2) if period == 2 else (0, 1, 2) * 3, blacks=(64.0, 66.0, 0.0, 64.0) if period == 2 else ()), progress=lambda share, stage: stages.append((share, stage)))
    out = job.run().collect()
    more = {(0, 1): 2} if period == 2 else {}  # the second cell's own black level
    assert len(out) == 19 * 22 and {r.c for r in out} == {0}
    off = [abs(r.v - value(r.y, r.x) - more.get((r.y % period, r.x % period), 0)) for r in out]
    assert np.mean(off) < 20 if mode == "wiener-robust" else max(off) <= 1  # the robust merge sharpens
    assert [s for s, _ in stages] == sorted(s for s, _ in stages) and stages[0][0] == 0.0 and stages[-1] == (1.0, "done")


def test_job_chained(spark):
    """Exposures far apart: each frame is aligned to its neighbour in exposure, which was moved already."""
    rng = np.random.default_rng(7)
    a = rng.random((64, 64))
    for _ in range(3):
        a = (a + np.roll(a, 1, 0) + np.roll(a, 1, 1) + np.roll(a, (1, 1), (0, 1))) / 4
    a = 40 * (a - a.min()) / (a.max() - a.min())
    ev = [1.0, 2.0, 4.0]
    frames = [np.roll(a * e, (i, 2 * i), (0, 1)) for i, e in enumerate(ev)]  # the darkest is the reference
    rows = [(0, f, y, x, 0, float(v[y, x])) for f, v in enumerate(frames) for y in range(64) for x in range(64)]
    px = spark.createDataFrame(rows, "burst int, frame int, y int, x int, c int, v double")
    meta = spark.createDataFrame([(0, i, e, 0.0, 1023.0, 0.0) for i, e in enumerate(ev)], "burst int, frame int, ev double, bias double, white double, black double")
    for mode in ("dense", "frequency"):
        out = BurstJob(px, meta, Settings(merge="median", align=mode, tile=16, depth=10)).merged().where("y between 16 and 47 and x between 16 and 47").collect()
        assert len(out) == 1024 and np.mean([abs(r.v - a[r.y, r.x]) for r in out]) < 0.2


def test_job_refuses(spark):
    px = spark.createDataFrame([(0, 0, 0, 0, 0, 1.0), (0, 1, 0, 1, 0, 1.0)], "burst int, frame int, y int, x int, c int, v double")
    with pytest.raises(ValueError, match="differ"):
        BurstJob(px, frame_rows(spark, 2)).run()
    mixed = frame_rows(spark, 2).withColumn("period", F.col("frame") * 2)
    with pytest.raises(ValueError, match="mixed"):
        BurstJob(px, mixed).run()


def test_settings():
    assert Settings.parse({"frequency": "true", "freq-mode": "fft-legacy", "b": "16", "exposure-mode": "curve", "exposure-curve": "local-reinhard", "output-format": "tif"}) == Settings(merge="frequency", frequency_mode="wiener", depth=16, exposure="local", exposure_curve="local", output_format="tiff")
    s = Settings.parse({"align": "legacy", "merge": "avg", "frequency_mode": "wiener-v2", "tile": "8", "depth": "12"})
    assert (s.align, s.merge, s.frequency_mode, s.tile) == ("standard", "average", "wiener-robust", 16)
    for bad in ({"depth": "9"}, {"merge": "x"}, {"what": "1"}):
        with pytest.raises(ValueError):
            Settings.parse(bad)


def test_streaming(spark, tmp_path):
    from rasterloom.streaming.stacking import running_average

    schema = "ts timestamp, burst int, y int, x int, c int, v double"
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' ts, 0 burst, 0 y, 0 x, 0 c, v FROM VALUES (1.0D), (3.0D) t(v)").write.parquet(str(tmp_path / "in"))
    q = running_average(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("stack").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.v, r.n_frames) for r in spark.table("stack").collect()] == [(2.0, 2)]
