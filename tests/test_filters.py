import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.functions.catalog import FILTERS, custom_filter, filters_df, get_filter
from rasterweave.operators.kernels import filter_band
from rasterweave.operators.stencil import apply_filter, compose
from rasterweave.plans.rewrite import choose_engine, rewrites
from rasterweave.sources.raster import PIXEL_SCHEMA, transpose

SUMS = {"mb": 9, "bb": 13, "gb": 256, "co": 1, "sh": 1, "em": 0, "gg": 1349, "mg": 227, "bo": 225}


def pixels_of(spark, image, name="i"):
    rows = [(name, y, x, *map(int, image[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])]
    return spark.createDataFrame(rows, PIXEL_SCHEMA)


def image_of(df, shape):
    out = np.zeros(shape, dtype=int)
    for r in df.collect():
        out[r["y"], r["x"]] = (r["b"], r["g"], r["r"])
    return out


def plain(image, kernel):
    """The definition, pixel by pixel."""
    h, w, _ = image.shape
    out = np.zeros_like(image, dtype=int)
    p = kernel.halo
    for y in range(h):
        for x in range(w):
            for c in range(3):
                if kernel.taps is None:
                    out[y, x, c] = sorted(image[(y + dy) % h, (x + dx) % w, c] for dy in range(-p, p + 1) for dx in range(-p, p + 1))[kernel.size**2 // 2]
                else:
                    acc = sum(int(kernel.taps[dy + p, dx + p]) * int(image[min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1), c]) for dy in range(-p, p + 1) for dx in range(-p, p + 1))
                    v = acc * kernel.factor + kernel.bias
                    out[y, x, c] = min(255, max(0, int(np.copysign(np.floor(abs(v) + 0.5), v))))
    return out


def test_catalogue():
    assert {k: int(f.taps.sum()) for k, f in FILTERS.items() if f.taps is not None} == SUMS
    assert all((f.taps == f.taps.T).all() for f in FILTERS.values() if f.taps is not None)
    assert {k for k, f in FILTERS.items() if f.separated()} == {"gb", "co", "bo"}
    assert "identity" in rewrites(get_filter("co")) and "zero_taps" in rewrites(get_filter("mb"))
    with pytest.raises(ValueError):
        get_filter("xx")
    with pytest.raises(ValueError):
        custom_filter("c", [[1, 2], [3, 4]])


def test_filters_table(spark):
    rows = {r["code"]: r for r in filters_df(spark).collect()}
    assert len(rows) == 10 and rows["mm"]["taps"] == [] and len(rows["bb"]["taps"]) == 13


@pytest.mark.parametrize("code", list(FILTERS))
def test_kernels_against_the_definition(code):
    kernel = get_filter(code)
    for shape in ((9, 8, 3), (1, 5, 3), (5, 1, 3), (4, 17, 3)):
        image = np.random.default_rng(3).integers(0, 256, shape).astype(np.uint8)
        mode = "wrap" if kernel.taps is None else "edge"
        band = np.pad(image, ((kernel.halo, kernel.halo), (0, 0), (0, 0)), mode=mode)
        assert (filter_band(band, kernel, shape[0]) == plain(image, kernel)).all()


@pytest.mark.parametrize("code", ["sh", "em", "mm", "gb"])
def test_engines_agree(spark, code):
    image = np.random.default_rng(5).integers(0, 256, (11, 7, 3))
    want = plain(image, get_filter(code))
    df = pixels_of(spark, image).cache()
    engines = ["relational", "tile"] + (["separable"] if code == "gb" else []) + (["rowarray"] if code == "sh" else [])
    for engine in engines:
        assert (image_of(apply_filter(df, code, engine), image.shape) == want).all(), engine
    assert (image_of(apply_filter(df, code, "tile", 11, 7), image.shape) == want).all()


def test_asymmetric_kernel_and_impulse(spark):
    kernel = custom_filter("c", [[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    image = np.zeros((5, 5, 3), dtype=int)
    image[2, 2] = 1
    got = image_of(apply_filter(pixels_of(spark, image), kernel, "relational"), image.shape)[1:4, 1:4, 0]
    assert (got == np.array([[9, 8, 7], [6, 5, 4], [3, 2, 1]])).all()


@pytest.mark.parametrize("value", [0, 1, 100, 147, 255])
def test_flat_images(value):
    image = np.full((16, 16, 3), value, dtype=np.uint8)
    want = {"em": 128, "gg": min(255, int(np.floor(value * 1349 / 771 + 0.5))), "mg": min(255, int(np.floor(value * 227 / 213 + 0.5)))}
    for code, kernel in FILTERS.items():
        band = np.pad(image, ((kernel.halo, kernel.halo), (0, 0), (0, 0)), mode="edge")
        assert (filter_band(band, kernel, 16) == want.get(code, value)).all(), code


def test_composition_rounds_between_and_transpose_commutes(spark):
    image = np.random.default_rng(8).integers(0, 256, (6, 9, 3))
    df = pixels_of(spark, image).cache()
    want = plain(plain(image, get_filter("gb")), get_filter("sh"))
    assert (image_of(compose(df, ["gb", "sh"], "tile"), image.shape) == want).all()
    turned = transpose(apply_filter(transpose(df), "em", "relational"))
    assert (image_of(turned, image.shape) == plain(image, get_filter("em"))).all()
    assert transpose(transpose(df)).exceptAll(df.select("img", "y", "x", "b", "g", "r")).count() == 0


def test_no_self_join_and_engine_choice(spark):
    df = spark.range(64).select(F.lit("i").alias("img"), (F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), *[F.lit(1).alias(c) for c in "bgr"])
    plan = apply_filter(df, "sh", "relational", 8, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert choose_engine(get_filter("gg"), 4480, 6720) == "tile" and choose_engine(get_filter("sh"), 64, 64) == "relational"
    assert apply_filter(df.limit(0), "sh", "tile").count() == 0
    with pytest.raises(ValueError):
        apply_filter(df, "sh", "nope")
