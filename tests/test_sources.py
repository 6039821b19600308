import os

import numpy as np
import pytest

from rasterweave.functions.catalog import get_filter
from rasterweave.operators import compare, loganalytics, tiling
from rasterweave.operators.kernels import filter_band
from rasterweave.operators.stencil import filter_bands
from rasterweave.plans.config import RunConfig, parse_args
from rasterweave.sources import bmp, raster, runlog
from rasterweave.streaming.pipeline import run, run_stream


def picture(height, width, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3)).astype(np.uint8)


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 8])
def test_codec_round_trip(width):
    image = picture(7, width)
    data = bmp.encode(image)
    header, back = bmp.decode(data)
    assert (back == image).all() and header["bfSize"] == len(data)
    assert bmp.default_header(width, 7, legacy_size=True)["bfSize"] == len(data) - 54


def test_top_down_and_offset():
    image = picture(4, 3)
    data = bytearray(bmp.encode(image))
    data[22:26] = (-4).to_bytes(4, "little", signed=True)
    assert (bmp.decode(bytes(data))[1] == image[::-1]).all()
    data = bytearray(bmp.encode(image))
    data[10:14] = (64).to_bytes(4, "little")
    assert (bmp.decode(bytes(data[:54]) + b"x" * 10 + bytes(data[54:]))[1] == image).all()


def test_faulty_files(spark, tmp_path):
    good = bmp.encode(picture(5, 6))
    for name, data in {"a": good, "b": good[:60], "c": b"XX" + good[2:], "d": good[:28] + b"\x20" + good[29:]}.items():
        (tmp_path / f"{name}.bmp").write_bytes(data)
    codes = {os.path.basename(r["path"]): r["error"] for r in bmp.read_images(spark, str(tmp_path)).collect()}
    assert codes == {"a.bmp": 0, "b.bmp": -1, "c.bmp": -2, "d.bmp": -2}
    assert bmp.read_images(spark, str(tmp_path), "DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="BMP_"):
        bmp.read_images(spark, str(tmp_path), "FAILFAST").collect()


@pytest.mark.parametrize("code", ["gg", "mm", "mb"])
def test_bands_equal_whole(spark, tmp_path, code):
    image, kernel = picture(37, 20), get_filter(code)
    (tmp_path / "p.bmp").write_bytes(bmp.encode(image))
    bands = bmp.read_bands(spark, str(tmp_path / "p.bmp"), 5, kernel.halo, kernel.taps is None)
    content = bmp.bands_to_image(filter_bands(bands, code)).collect()[0]["content"]
    whole = np.pad(image, ((kernel.halo, kernel.halo), (0, 0), (0, 0)), mode="wrap" if kernel.taps is None else "edge")
    assert (bmp.decode(content)[1] == filter_band(whole, kernel, 37)).all()


def test_batch_queue_and_stream_agree(spark, tmp_path):
    (tmp_path / "in").mkdir()
    names = [f"p{k}.bmp" for k in range(4)]
    for k, n in enumerate(names):
        (tmp_path / "in" / n).write_bytes(bmp.encode(picture(9 + k, 6, k)))
    log = str(tmp_path / "log")
    run(spark, RunConfig(tuple(names), "em", exec_mode="queue", log=True), str(tmp_path / "in"), str(tmp_path / "a"), log)
    run_stream(spark, str(tmp_path / "in"), ["em"], str(tmp_path / "b"), str(tmp_path / "s"), max_files=2).awaitTermination()
    assert sorted(os.listdir(tmp_path / "a")) == [f"qmt_out_{n}" for n in names]
    for n in os.listdir(tmp_path / "a"):
        assert (tmp_path / "a" / n).read_bytes() == (tmp_path / "b" / n).read_bytes()
    run(spark, RunConfig(("p1.bmp",), "em", exec_mode="mpi", block=3), str(tmp_path / "in"), str(tmp_path / "c"))
    assert (tmp_path / "c" / "mpi_out_p1.bmp").read_bytes() == (tmp_path / "a" / "qmt_out_p1.bmp").read_bytes()
    timing = runlog.read_timings(spark, log).collect()
    assert len(timing) == 1 and timing[0]["Filter"] == "em" and timing[0]["Result"] > 0


def test_tiles_cover_once(spark):
    for mode in ("by_row", "by_column", "by_grid", "by_pixel"):
        for block in (1, 4, 128):
            seen = np.zeros((13, 9), dtype=int)
            for t in tiling.tiles(spark, 13, 9, mode, block).collect():
                seen[t["y0"] : t["y1"], t["x0"] : t["x1"]] += 1
            assert (seen == 1).all(), (mode, block)
    with pytest.raises(ValueError):
        tiling.tiles(spark, 3, 3, "by_x", 1)


@pytest.mark.parametrize(("extent", "ranks"), [(10, 3), (1, 2), (15, 8)])
def test_band_plan(spark, extent, ranks):
    rows = tiling.band_plan(spark, extent, ranks, 7).orderBy("rank").collect()
    assert sum(r["num"] for r in rows) == extent and max(r["num"] for r in rows) - min(r["num"] for r in rows) <= 1
    assert all(r["send_start"] >= 0 and r["send_start"] + r["send_num"] <= extent for r in rows)


def test_comparison(spark):
    a = raster.synthetic(spark, "i", 5, 4, raster.F.col("y") * 7 + raster.F.col("x"))
    b = a.withColumn("g", raster.F.when((raster.F.col("y") == 3) & (raster.F.col("x") >= 2), 9).otherwise(raster.F.col("g")))
    assert compare.compare(a, a).first()["status"] == 0 and compare.compare(a, b).first()["status"] == 1
    assert compare.compare(a, a.where("y < 4")).first()["status"] == -1
    first = compare.first_diff(a, b).first()
    assert (first["y"], first["x"], first["diffs"]) == (3, 2, 2)


def test_logs(spark, tmp_path):
    (tmp_path / "t.dat").write_text("RunID ProcessNum Backend Mode Filter ThreadNum ComputeMode BlockSize Result\n1 1 CPU normal gb 1 by_grid 16 0.5\n2 1 CPU normal sh  4 by_row 8 x\n\n3 1 CPU normal sh 4 by_row 8 1.5\n")
    df = runlog.read_timings(spark, str(tmp_path / "t.dat"))
    assert df.count() == 3 and loganalytics.clean(df, ["Result"]).count() == 2
    single = loganalytics.label_single_thread(df).where("RunID = 1").first()
    assert single["ComputeMode"] == "single_thread" and single["BlockSize"] == 0
    (tmp_path / "q.dat").write_text("# c\nby_row QPOP 0.1\nby_row QPOP 0.3\nby_row WORKER 2\n")
    q = runlog.read_queue_timings(spark, str(tmp_path / "q.dat"))
    rows = {r["LOG_TAG"]: r for r in loganalytics.ci95_by(q, ["LOG_TAG"], "TIME").collect()}
    assert rows["WORKER"]["ci95"] == 0 and abs(rows["QPOP"]["ci95"] - 12.706205 * np.std([0.1, 0.3], ddof=1) / np.sqrt(2)) < 1e-6
    summary = loganalytics.mean_std_by(q, ["COMPUTE_MODE", "LOG_TAG"], "TIME").selectExpr("'1,1,1' as MIX", "*")
    runlog.append_summary(summary, str(tmp_path / "s"))
    assert runlog.read_summary(spark, str(tmp_path / "s")).count() == 2


def test_arguments():
    c = parse_args(["-cpu", "-queue", "a.bmp", "b.bmp", "c.bmp", "--filter=gb", "--rww=6,6,1", "--queue-size=4"])
    assert c.exec_mode == "queue" and c.rww == (6, 6, 1) and c.queue_size == 4
    for bad in (["-cpu", "a", "b", "--filter=gb"], ["-cpu", "a", "--filter=zz"], ["-cpu", "a", "--filter=gb", "--mode=by_x"], ["-gpu", "-queue", "a", "--filter=gb"]):
        with pytest.raises(ValueError):
            parse_args(bad)
