"""The registered queries of the raster engine and their SQL."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions import scalars
from rasterweave.functions.catalog import FILTERS, filters_df, get_filter
from rasterweave.operators import compare, loganalytics, stencil, tiling
from rasterweave.sources import bmp, raster

Query = Callable[[SparkSession, str], DataFrame]

#: Sides of the derived rasters: large kernels take the small one.
SIDE, SMALL = 64, 32


def _side(code: str) -> int:
    return SMALL if FILTERS[code].size >= 9 else SIDE


def _raster(spark: SparkSession, d: str, side: int) -> DataFrame:
    return raster.lineitem_raster(spark, d, side)


def _filtered(code: str, engine: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        side = _side(code)
        return stencil.apply_filter(_raster(spark, d, side), code, engine, side, side)

    return run


# --- SQL -------------------------------------------------------------------------------------


def _pixels_sql(side: int) -> str:
    return f"""cells as (select l_returnflag img, cast(l_orderkey % {side} as int) y, cast(l_partkey % {side} as int) x,
  sum(l_linenumber) % 256 b, sum(cast(l_quantity as bigint)) % 256 g, sum(l_suppkey) % 256 r from lineitem group by 1, 2, 3),
every as (select img, cast(yy as int) y, cast(xx as int) x from (select distinct img from cells) i, range({side}) a(yy), range({side}) c(xx)),
pixels as (select e.img, e.y, e.x, cast(coalesce(c.b, 0) as int) b, cast(coalesce(c.g, 0) as int) g, cast(coalesce(c.r, 0) as int) r
  from every e left join cells c on e.img = c.img and e.y = c.y and e.x = c.x)"""


def _conv_ctes(code: str, source: str, name: str, side: int) -> str:
    f = FILTERS[code]
    taps = ", ".join(f"({y}, {x}, {w})" for y, x, w in f.nonzero())
    fin = {c: f"cast(greatest(0.0, least(255.0, round(cast(sum(p.{c} * t.w) as double) * (cast(1 as double) / {f.divisor}) + cast({f.bias} as double)))) as int) {c}" for c in raster.CHANNELS}
    return f"""taps_{name}(dy, dx, w) as (values {taps}),
{name} as (select o.img, o.y, o.x, {fin["b"]}, {fin["g"]}, {fin["r"]} from {source} o, taps_{name} t, {source} p
  where p.img = o.img and p.y = greatest(0, least({side - 1}, o.y + t.dy)) and p.x = greatest(0, least({side - 1}, o.x + t.dx)) group by o.img, o.y, o.x)"""


def _conv_sql(code: str) -> str:
    side = _side(code)
    return f"with {_pixels_sql(side)}, {_conv_ctes(code, 'pixels', 'out1', side)} select img, y, x, b, g, r from out1"


def _compose_sql(first: str, second: str) -> str:
    return f"with {_pixels_sql(SIDE)}, {_conv_ctes(first, 'pixels', 'out1', SIDE)}, {_conv_ctes(second, 'out1', 'out2', SIDE)} select img, y, x, b, g, r from out2"


def _median_sql() -> str:
    n = SMALL
    mid = ", ".join(f"cast(quantile_disc(p.{c}, 0.5) as int) {c}" for c in raster.CHANNELS)
    return f"""with {_pixels_sql(n)}, s as (select cast(d as int) d from range(-7, 8) q(d))
select o.img, o.y, o.x, {mid} from pixels o, s a, s e, pixels p
where p.img = o.img and p.y = ((o.y + a.d) % {n} + {n}) % {n} and p.x = ((o.x + e.d) % {n} + {n}) % {n} group by o.img, o.y, o.x"""


# --- queries ---------------------------------------------------------------------------------


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    weights = F.transform("taps", lambda t: t["w"])
    return filters_df(spark).select("code", "name", "size", "factor", "bias", F.aggregate(weights, F.lit(0.0), lambda a, w: a + w).alias("tap_sum"), F.size("taps").alias("tap_count"))


def _catalog_sql() -> str:
    rows = []
    for f in FILTERS.values():
        total, count = (0, 0) if f.taps is None else (int(f.taps.sum()), len(f.nonzero()))
        rows.append(f"('{f.code}', '{f.name}', {f.size}, cast(1 as double) / {f.divisor}, cast({f.bias} as double), cast({total} as double), {count})")
    return f"select * from (values {', '.join(rows)}) v(code, name, size, factor, bias, tap_sum, tap_count)"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    codes = raster.lineitem_raster(spark, d, 4).select(F.element_at(F.array(*[F.lit(c) for c in [*FILTERS, "zz"]]), (F.col("x") + F.col("y")) % 11 + 1).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("n")).select("code", loganalytics.label_map(F.col("code")).alias("label"), "n")


def _labels_sql() -> str:
    codes = ", ".join(f"'{c}'" for c in [*FILTERS, "zz"])
    names = " ".join(f"when '{c}' then '{f.name}'" for c, f in FILTERS.items())
    return f"with {_pixels_sql(4)}, k as (select list_extract([{codes}], (x + y) % 11 + 1) code from pixels) select code, case code {names} else code end label, count(*) n from k group by code"


def _shifted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = _raster(spark, d, SIDE)
    b = a.withColumn("b", F.when((F.col("x") + F.col("y")) % 97 == 5, (F.col("b") + 1) % 256).otherwise(F.col("b"))).where("not (img = 'N' and y = 63)")
    return a, b


_SHIFT_SQL = f"""with {_pixels_sql(SIDE)}, q as (select img, y, x, case when (x + y) % 97 = 5 then (b + 1) % 256 else b end b, g, r from pixels where not (img = 'N' and y = 63)),
d as (select coalesce(p.img, q.img) img, coalesce(p.y, q.y) y, coalesce(p.x, q.x) x, p.b a_b, p.g a_g, p.r a_r, q.b b_b, q.g b_g, q.r b_r from pixels p full join q on p.img = q.img and p.y = q.y and p.x = q.x
  where p.b is distinct from q.b or p.g is distinct from q.g or p.r is distinct from q.r)"""


def _band_plans(spark: SparkSession, d: str) -> DataFrame:
    made = None
    for extent in (10, 64, 15):
        for ranks in (2, 3, 8):
            one = tiling.band_plan(spark, extent, ranks, 7).select(F.lit(extent).alias("extent"), F.lit(ranks).alias("ranks"), "*")
            made = one if made is None else made.unionByName(one)
    return made


_BAND_SQL = """with a as (select * from (values (10), (64), (15)) e(extent), (values (2), (3), (8)) n(ranks), range(8) k(rank) where rank < ranks),
s as (select extent, ranks, cast(rank as int) rank, cast(rank * (extent // ranks) + least(rank, extent % ranks) as int) as start, cast(extent // ranks + case when rank < extent % ranks then 1 else 0 end as int) num from a)
select extent, ranks, rank, start, num, cast(case when num = 0 then start else greatest(0, start - 7) end as int) send_start,
  cast(case when num = 0 then 0 else least(extent, start + num + 7) - greatest(0, start - 7) end as int) send_num from s"""


def _tiles(mode: str, block: int) -> Query:
    return lambda spark, d: tiling.tiles(spark, 50, 37, mode, block)


def _tiles_sql(mode: str, block: int) -> str:
    block = 1 if mode == "by_pixel" else block
    tall, wide = (50 if mode == "by_column" else block), (37 if mode == "by_row" else block)
    across, down = -(-37 // wide), -(-50 // tall)
    return f"""select '{mode}' as mode, cast(t as int) tile, cast(t // {across} * {tall} as int) y0, cast(least(50, t // {across} * {tall} + {tall}) as int) y1,
cast(t % {across} * {wide} as int) x0, cast(least(37, t % {across} * {wide} + {wide}) as int) x1 from range({across * down}) q(t)"""


def _memory(spark: SparkSession, d: str) -> DataFrame:
    sizes = raster.dimensions(_raster(spark, d, SIDE)).crossJoin(spark.range(1, 9).select((F.col("id") * 900).alias("k")))
    return sizes.select("img", "k", scalars.image_memory_mb(F.col("width") * F.col("k"), F.col("height") * F.col("k")).alias("mb"))


_MEMORY_SQL = f"""with {_pixels_sql(SIDE)}, s as (select img, max(y) + 1 h, max(x) + 1 w from pixels group by img), n as (select (k * 900)::bigint k from range(1, 9) q(k))
select img, k, cast(ceil((cast(w * k * h * k as double) * 24 / 8 + 64 + h * k * 8 + 1) / 1048576) + 1 as bigint) mb from s, n"""


def _roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Pixels that differ after a trip through file bytes; none."""
    pixels = _raster(spark, d, SIDE)
    images = bmp.pixels_to_images(pixels).select(F.col("img").alias("path"), "content")
    back = bmp.images_to_pixels(bmp.decode_files(images, "FAILFAST"))
    return compare.pixel_diff(pixels, back).agg(F.count("*").alias("diffs"))


def _header_scan(spark: SparkSession, d: str) -> DataFrame:
    images = bmp.pixels_to_images(_raster(spark, d, SIDE)).select(F.col("img").alias("path"), "content")
    return bmp.header_columns(images)


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The events table read as a queue log: tag = event type, time = value."""
    events = spark.read.parquet(f"{d}/events.parquet")
    return loganalytics.clean(events.select(F.col("event_id").alias("line_no"), F.col("event_type").alias("tag"), "user_id", F.col("value").alias("time")), ["time"], ["tag", "time"])


_LOG_SQL = "with l as (select event_id line_no, event_type tag, user_id, value as time from events where event_type is not null and value is not null)"


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _mean_std(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(loganalytics.mean_std_by(_log(spark, d), ["tag"], "time"), ["mean", "std"])


def _ci95(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(loganalytics.ci95_by(_log(spark, d), ["tag", "user_id"], "time"), ["mean", "ci95"])


def _t_by_integration(df: int) -> float:
    """The 0.975 quantile of Student's t found another way: Simpson's rule over t = sqrt(df) * tan(angle), then secants."""
    total = lambda a, n=2000: a / n / 3 * sum((1 if k in (0, n) else 4 if k % 2 else 2) * math.cos(a * k / n) ** (df - 1) for k in range(n + 1))
    wanted = 0.95 * math.sqrt(math.pi) / 2 * math.exp(math.lgamma(df / 2) - math.lgamma((df + 1) / 2))
    low, high = 0.0, math.pi / 2
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < wanted else (low, middle)
    return math.sqrt(df) * math.tan(low)


def _ci95_sql() -> str:
    t = ", ".join(str(_t_by_integration(df)) for df in range(1, 61))
    return f"""{_LOG_SQL}, s as (select tag, user_id, count(time) n, avg(time) mean, stddev_samp(time) sd from l group by all)
select tag, user_id, n, round(mean, 6) mean, round(case when n < 2 then cast(0 as double) when n > 61 then error('more than 60 degrees of freedom') else cast(list_extract([{t}], (n - 1)::int) as double) * sd / sqrt(n) end, 6) ci95 from s"""


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(loganalytics.summary_by(_log(spark, d), ["tag"], "time"), ["mean", "std"])


def _reindex(spark: SparkSession, d: str) -> DataFrame:
    means = loganalytics.mean_by(_log(spark, d), ["tag"], "time")
    domain = spark.createDataFrame([(t,) for t in ("click", "purchase", "error", "absent", "none")], "tag string")
    return _rounded(loganalytics.reindex(means, domain, ["tag"]), ["mean"])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    found = loganalytics.consecutive_pairs(_log(spark, d), ["user_id"], "line_no", "tag", "time", [("click", "purchase"), ("view", "click")])
    return found.groupBy("first", "second").agg(F.count("*").alias("n"), F.round(F.avg("total"), 6).alias("mean"))


def _first_seen(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return loganalytics.first_appearance(log, ["tag"], "line_no").join(loganalytics.first_value(log, ["tag"], "line_no", "user_id"), "tag")


def _single_thread(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).select("time", (F.col("user_id") % 4).cast("int").alias("ThreadNum"), F.col("tag").alias("ComputeMode"), (F.col("user_id") % 3).cast("int").alias("BlockSize"))
    out = loganalytics.label_single_thread(log)
    return _rounded(loganalytics.mean_by(out, ["ThreadNum", "ComputeMode", "BlockSize"], "time"), ["mean"])


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The rasters as files, through the rate-limited stream with ``sh``, read back as pixels."""
    from rasterweave.streaming.pipeline import run_stream

    top = shared_folder(spark)
    bmp.register(spark)
    bmp.write_images(bmp.pixels_to_images(_raster(spark, d, SIDE)), f"{top}/in")
    run_stream(spark, f"{top}/in", ["sh"], f"{top}/out", f"{top}/state", max_files=2).awaitTermination()
    pixels = bmp.images_to_pixels(bmp.read_images(spark, f"{top}/out", "FAILFAST"))
    return pixels.withColumn("img", F.regexp_extract("img", r"qmt_out_(.*)\.bmp$", 1))


def _bands(spark: SparkSession, d: str) -> DataFrame:
    """The production path: files, row bands with halos by seek, the tile engine, images gathered and written, read again."""
    top = shared_folder(spark)
    bmp.register(spark)
    bmp.write_images(bmp.pixels_to_images(_raster(spark, d, SIDE)), f"{top}/in")
    done = bmp.bands_to_image(stencil.filter_bands(bmp.read_bands(spark, f"{top}/in", 9, get_filter("bb").halo), "bb"))
    bmp.write_images(done, f"{top}/out")
    pixels = bmp.images_to_pixels(bmp.read_images(spark, f"{top}/out", "FAILFAST"))
    return pixels.withColumn("img", F.regexp_extract("img", r"([^/]*)\.bmp$", 1))


def _same_name(spark: SparkSession, d: str) -> DataFrame:
    """Images of one name in several folders stay apart from the scan to the sink."""
    top = shared_folder(spark)
    bmp.register(spark)
    images = bmp.pixels_to_images(_raster(spark, d, SIDE))
    bmp.write_images(images.withColumn("img", F.concat("img", F.lit("/same.bmp"))), f"{top}/in")
    done = bmp.bands_to_image(stencil.filter_bands(bmp.read_bands(spark, f"{top}/in", 20, get_filter("sh").halo), "sh"))
    bmp.write_images(done, f"{top}/out")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{top}/out")
    pixels = bmp.images_to_pixels(bmp.decode_files(files, "FAILFAST"))
    return pixels.withColumn("img", F.regexp_extract("img", r"/([^/]*)/same\.bmp$", 1))


def _normal_passes(spark: SparkSession, d: str) -> DataFrame:
    """Two passes of a run in normal mode on one image."""
    from rasterweave.plans.config import RunConfig
    from rasterweave.streaming.pipeline import run

    top = shared_folder(spark)
    bmp.register(spark)
    bmp.write_images(bmp.pixels_to_images(_raster(spark, d, SIDE).where("img = 'R'")), f"{top}/in")
    run(spark, RunConfig(("R.bmp",), "gb", block=10, passes=("gb", "sh")), f"{top}/in", f"{top}/out")
    return bmp.images_to_pixels(bmp.read_images(spark, f"{top}/out", "FAILFAST")).withColumn("img", F.lit("R"))


def _truncated(code: str, engine: str) -> Query:
    return lambda spark, d: stencil.apply_filter(_raster(spark, d, SIDE), code, engine, SIDE, SIDE, "truncate")


def _headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers, pixels and bytes of each image against its written form without the header's size, and against its shifted form."""
    a, b = _shifted(spark, d)
    files = {k: bmp.pixels_to_images(v, legacy_size=k == "legacy") for k, v in (("plain", a), ("legacy", a), ("shifted", b))}
    decoded = {k: bmp.decode_files(v.withColumnRenamed("img", "path"), "FAILFAST") for k, v in files.items()}
    made = None
    for k in ("plain", "legacy", "shifted"):
        one = compare.header_diff(decoded["plain"], decoded[k]).join(compare.same_bytes(files["plain"], files[k]).withColumnRenamed("img", "path"), "path").select(F.lit(k).alias("other"), "path", "same_header", "same_pixels", "same")
        made = one if made is None else made.unionByName(one)
    return made


_HEADERS_SQL = f"""{_SHIFT_SQL}, s as (select img, max(y) my, max(x) mx from pixels group by img), t as (select img, max(y) my, max(x) mx from q group by img), n as (select img, count(*) c from d group by img)
select 'plain' as other, img path, true same_header, true same_pixels, true same from s union all select 'legacy', img, false, true, false from s
union all select 'shifted', s.img, s.my = t.my and s.mx = t.mx, coalesce(n.c, 0) = 0, coalesce(n.c, 0) = 0 from s join t on s.img = t.img left join n on n.img = s.img"""


def _log_files(spark: SparkSession, d: str) -> DataFrame:
    """Events through the queue log's sink and scan."""
    from rasterweave.sources import runlog

    path = f"{shared_folder(spark)}/log"
    runlog.append_queue_timings(_log(spark, d).select(F.lit("by_row").alias("COMPUTE_MODE"), F.col("tag").alias("LOG_TAG"), F.col("time").alias("TIME")), path)
    return runlog.read_queue_timings(spark, path).groupBy("COMPUTE_MODE", "LOG_TAG").agg(F.count("TIME").alias("n"), F.round(F.min("TIME"), 6).alias("least"), F.round(F.max("TIME"), 6).alias("most"))


def _checker(spark: SparkSession, d: str) -> DataFrame:
    return raster.checkerboard(spark, 40, 7).unionByName(raster.black(spark, 9))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder; a local one only where none is set."""
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="rasterweave-")
    return f"{top.removeprefix('file://').removeprefix('file:')}/{uuid.uuid4().hex}"


def _elapsed(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).groupBy("tag").agg((F.count("time") * 1.25).alias("seconds")).select("tag", scalars.elapsed_label(F.col("seconds")).alias("label"))


_ELAPSED_SQL = f"{_LOG_SQL}, s as (select tag, cast(count(time) * 125 as bigint) v from l group by tag) select tag, printf('%02d:%02d.%02d', v // 6000, v // 100 % 60, v % 100) as label from s"


def queries() -> dict[str, Query]:
    made: dict[str, Query] = {"raster_pixels": lambda s, d: _raster(s, d, SIDE), "filter_catalog": _catalog, "filter_labels": _labels}
    for code in FILTERS:
        if code != "mm":
            made[f"conv_{code}"] = _filtered(code, "relational")
        made[f"conv_{code}_tile" if code != "mm" else "median_mm_tile"] = _filtered(code, "tile")
    made["median_mm"] = _filtered("mm", "relational")
    made |= {"conv_gb_separable": _filtered("gb", "separable"), "conv_bo_window": _filtered("bo", "separable"), "conv_sh_rowarray": _filtered("sh", "rowarray")}
    for a, b in (("gb", "sh"), ("sh", "gb")):
        made[f"compose_{a}_{b}"] = lambda s, d, a=a, b=b: stencil.compose(_raster(s, d, SIDE), [a, b], "tile", SIDE, SIDE)
    for mode, block in (("by_row", 4), ("by_column", 8), ("by_grid", 16), ("by_pixel", 1)):
        made[f"tiles_{mode}"] = _tiles(mode, block)
    return made | {
        "transpose_raster": lambda s, d: raster.transpose(_raster(s, d, SIDE)),
        "region_raster": lambda s, d: raster.region(_raster(s, d, SIDE), 5, 20, 10, 40),
        "band_distribution_halo": _band_plans,
        "pixel_diff": lambda s, d: compare.pixel_diff(*_shifted(s, d)),
        "first_diff": lambda s, d: compare.first_diff(*_shifted(s, d)),
        "dims_check": lambda s, d: compare.compare(*_shifted(s, d)),
        "queue_mem_estimate": _memory,
        "bmp_roundtrip": _roundtrip,
        "bmp_header_scan": _header_scan,
        "log_mean_std": _mean_std,
        "log_ci95": _ci95,
        "log_p95": _summary,
        "log_reindex": _reindex,
        "log_filter_pairs": _pairs,
        "log_first_seen": _first_seen,
        "log_single_thread": _single_thread,
        "log_elapsed_label": _elapsed,
        "stream_pipeline": _stream,
        "bmp_bands_bb": _bands,
        "images_same_name": _same_name,
        "compose_normal": _normal_passes,
        "conv_gb_truncate": _truncated("gb", "relational"),
        "conv_gb_truncate_tile": _truncated("gb", "tile"),
        "conv_gb_truncate_separable": _truncated("gb", "separable"),
        "conv_em_truncate_rowarray": _truncated("em", "rowarray"),
        "header_and_byte_diff": _headers,
        "queue_log_roundtrip": _log_files,
        "synthetic_images": _checker,
    }


def oracle_sql() -> dict[str, str]:
    made = {"raster_pixels": f"with {_pixels_sql(SIDE)} select img, y, x, b, g, r from pixels", "filter_catalog": _catalog_sql(), "filter_labels": _labels_sql()}
    for code in FILTERS:
        if code != "mm":
            made[f"conv_{code}"] = made[f"conv_{code}_tile"] = _conv_sql(code)
    made["median_mm"] = made["median_mm_tile"] = _median_sql()
    made |= {"conv_gb_separable": made["conv_gb"], "conv_bo_window": made["conv_bo"], "conv_sh_rowarray": made["conv_sh"]}
    made |= {"compose_gb_sh": _compose_sql("gb", "sh"), "compose_sh_gb": _compose_sql("sh", "gb")}
    for mode, block in (("by_row", 4), ("by_column", 8), ("by_grid", 16), ("by_pixel", 1)):
        made[f"tiles_{mode}"] = _tiles_sql(mode, block)
    px = f"with {_pixels_sql(SIDE)}"
    return made | {
        "transpose_raster": f"{px} select img, x as y, y as x, b, g, r from pixels",
        "region_raster": f"{px} select img, y, x, b, g, r from pixels where y >= 5 and y < 20 and x >= 10 and x < 40",
        "band_distribution_halo": _BAND_SQL,
        "pixel_diff": f"{_SHIFT_SQL} select * from d",
        "first_diff": f"{_SHIFT_SQL} select img, (min(y * 100000 + x) // 100000)::int y, (min(y * 100000 + x) % 100000)::int x, count(*) diffs from d group by img",
        "dims_check": f"{_SHIFT_SQL}, s as (select img, max(y) my, max(x) mx from pixels group by img), t as (select img, max(y) my, max(x) mx from q group by img), n as (select img, count(*) c from d group by img) select s.img, cast(case when s.my <> t.my or s.mx <> t.mx then -1 when coalesce(n.c, 0) > 0 then 1 else 0 end as int) status from s join t on s.img = t.img left join n on n.img = s.img",
        "queue_mem_estimate": _MEMORY_SQL,
        "bmp_roundtrip": "select cast(0 as bigint) diffs",
        "bmp_header_scan": f"{px} select img path, max(x) + 1 width, max(y) + 1 height, true valid from pixels group by img",
        "log_mean_std": f"{_LOG_SQL} select tag, round(avg(time), 6) mean, round(coalesce(stddev_samp(time), 0), 6) std from l group by tag",
        "log_ci95": _ci95_sql(),
        "log_p95": f"{_LOG_SQL} select tag, count(time) n, min(time) min, max(time) max, round(avg(time), 6) mean, round(stddev_pop(time), 6) std, quantile_disc(time, 0.95) p95 from l group by tag",
        "log_reindex": f"{_LOG_SQL}, m as (select tag, avg(time) mean from l group by tag) select v.tag, round(coalesce(m.mean, 0), 6) mean from (values ('click'), ('purchase'), ('error'), ('absent'), ('none')) v(tag) left join m on m.tag = v.tag",
        "log_filter_pairs": f"{_LOG_SQL}, p as (select tag as first, lead(tag) over w as second, time + lead(time) over w as total from l window w as (partition by user_id order by line_no)) select first, second, count(*) n, round(avg(total), 6) mean from p where (first = 'click' and second = 'purchase') or (first = 'view' and second = 'click') group by all",
        "log_first_seen": f"{_LOG_SQL} select tag, min(line_no) first_at, arg_min(user_id, line_no) user_id from l group by tag",
        "log_single_thread": f"{_LOG_SQL}, s as (select time, (user_id % 4)::int t, tag, (user_id % 3)::int k from l), e as (select time, t, case when t = 1 then 'single_thread' else tag end m, case when t = 1 then 0 else k end k from s) select t as \"ThreadNum\", m as \"ComputeMode\", k as \"BlockSize\", round(avg(time), 6) mean from e group by all",
        "log_elapsed_label": _ELAPSED_SQL,
        "stream_pipeline": made["conv_sh"],
        "bmp_bands_bb": made["conv_bb"],
        "images_same_name": made["conv_sh"],
        "compose_normal": made["compose_gb_sh"] + " where img = 'R'",
        **{f"conv_gb_truncate{e}": made["conv_gb"].replace("round(", "floor(") for e in ("", "_tile", "_separable")},
        "conv_em_truncate_rowarray": made["conv_em"].replace("least(255.0, round(", "least(255.0, trunc("),
        "header_and_byte_diff": _HEADERS_SQL,
        "queue_log_roundtrip": f"{_LOG_SQL} select 'by_row' as \"COMPUTE_MODE\", tag as \"LOG_TAG\", count(*) n, round(min(time), 6) least, round(max(time), 6) most from l group by tag",
        "synthetic_images": "select 'checker' img, cast(a as int) y, cast(c as int) x, cast((a // 7 + c // 7) % 2 * 255 as int) b, cast((a // 7 + c // 7) % 2 * 255 as int) g, cast((a // 7 + c // 7) % 2 * 255 as int) r from range(40) p(a), range(40) q(c) union all select 'black', cast(a as int), cast(c as int), 0, 0, 0 from range(9) p(a), range(9) q(c)",
    }


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large Gaussian blur of the derived raster."""
    return stencil.apply_filter(_raster(spark, sf_dir, SIDE), get_filter("gg"), "tile", SIDE, SIDE)
