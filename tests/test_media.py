import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspark.functions import pixels as P
from auditspark.operators import vouchers
from auditspark.sources import files, sinks
from auditspark.sources.file_layout import local


def plain_lanczos(values, side=8):
    """Value by value from the formula of the filter."""

    def line(xs):
        n, out = len(xs), []
        step = n / side
        wide = max(step, 1)
        for i in range(side):
            at = [((j + 0.5) - (i + 0.5) * step) / wide for j in range(n)]
            w = [np.sinc(x) * np.sinc(x / 3) if abs(x) < 3 else 0 for x in at]
            out.append(min(255, max(0, np.floor(sum(a * b for a, b in zip(w, xs)) / sum(w) + 0.5))))
        return out

    half = [line(row) for row in values]
    return np.array([line(col) for col in zip(*half)]).T


def test_images_read_back_as_they_were_written(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {n: rng.integers(0, 256, (h, w)) for n, (h, w) in enumerate([(8, 8), (5, 7), (40, 33), (120, 64), (1, 1), (3, 200)])} | {6: np.full((16, 16), 77)}
    for n, m in made.items():
        (tmp_path / f"{n}.bmp").write_bytes(P.bitmap(m))
    (tmp_path / "7.png").write_bytes(b"no image")
    (tmp_path / "8.bmp").write_bytes(P.bitmap(made[2])[:500])
    (tmp_path / "9.bmp").write_bytes(b"")  # Spark reads no empty files
    got = {int(r.name.split(".")[0]): r for r in files.measured_images(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(9)) and all(got[n].width is None and got[n].variance is None and got[n].hash is None for n in (7, 8))
    for n, m in made.items():
        r = got[n]
        assert (r.height, r.width) == m.shape and r.size == len(P.bitmap(m)) and abs(r.variance - m.var()) < 1e-9
        small = plain_lanczos(m)
        assert (P.shrunk(m) == small).all()
        assert f"{r.hash & (2**64 - 1):064b}" == "".join("01"[int(x > small.mean())] for x in small.ravel())
    assert got[6].hash == 0


def test_colours_and_alpha_become_gray():
    blue, red_alpha = bytes([255, 0, 0]), bytes([0, 0, 255, 9])
    assert P.gray(1, 1, 3, blue).tolist() == [[29]] and P.gray(1, 1, 4, red_alpha).tolist() == [[76]] and P.gray(2, 1, 1, b"\x01\x02").tolist() == [[1, 2]]


def test_files_and_twins(spark, tmp_path):
    at = str(tmp_path / "out")
    rows = [(f"{k % 3}/{k:03d}.bin", bytes([k] * k), f"text\n{k}" if k % 2 else None) for k in range(60)] + [("only.txt.bin", None, "twin"), ("plain", b"x", None)]
    sinks.write_files(spark.createDataFrame(rows, "file string, content binary, text string").repartition(5), at)
    found = {os.path.relpath(os.path.join(d, n), at): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(at) for n in names}
    want = {f: c for f, c, _ in rows if c is not None} | {f.rsplit(".", 1)[0] + ".txt": t.encode() for f, _, t in rows if t is not None}
    assert found == want
    sinks.write_files(spark.createDataFrame([("plain", b"new", None)], "file string, content binary, text string"), at)
    assert open(f"{at}/plain", "rb").read() == b"new" and len(os.listdir(at)) == 5


@pytest.mark.parametrize("bad", [None, "../up.bin", "0/000.bin"])
def test_a_job_that_fails_leaves_nothing(spark, tmp_path, bad):
    at = str(tmp_path / "out")
    rows = [(f"0/{k:03d}.bin", b"x", "t") for k in range(20)] + [(bad, b"y", None)]
    with pytest.raises(Exception, match="(?s)no name for a file|File exists"):
        sinks.write_files(spark.createDataFrame(rows, "file string, content binary, text string").coalesce(1), at)
    assert not os.path.exists(at)
    os.makedirs(at)
    open(f"{at}/before", "w").close()
    with pytest.raises(Exception, match="(?s)no name for a file|File exists"):
        sinks.write_files(spark.createDataFrame(rows, "file string, content binary, text string").coalesce(1), at)
    assert os.listdir(at) == ["before"]


def test_a_path_must_be_mounted():
    assert local("file:///a/b") == local("file:/a/b") == "/a/b"
    with pytest.raises(ValueError):
        local("hdfs://a/b")


def test_numbers_go_on_over_partitions(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 9, F.lit(None)).otherwise("cold").alias("kind"), (F.col("id") * 7 % 5000).alias("o"))
    got = vouchers.numbered(rows.repartition(7), "kind", "o").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.o):
        by.setdefault(r.kind, []).append(r.number)
    assert {k: len(x) for k, x in by.items()} == {"hot": 3500, "cold": 1000, None: 500} and all(x == list(range(1, len(x) + 1)) for x in by.values())
    laid = vouchers.file_layout(spark.createDataFrame([(k, None if k == 1 else "a?b", f"x{k}.JPG") for k in range(3)], "id long, kind string, name string"), "kind", "name", "id")
    assert sorted((r.folder, r.file, r.twin) for r in laid.collect()) == [("a_b", "0001_a_b_x0.JPG", "0001_a_b_x0.txt"), ("a_b", "0002_a_b_x2.JPG", "0002_a_b_x2.txt"), ("其他", "0001_其他_x1.JPG", "0001_其他_x1.txt")]
