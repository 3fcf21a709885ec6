"""Text files and the run store: files written, read again and overwritten by frame."""

import pytest

from skein.sources import text
from skein.sources.store import Store

ROWS = [(7, 0, -1, 2, 1.5, -2.25, 3.0), (7, 1, 0, -2, 0.0, 1e3, -0.5), (8, 0, 1, 1, 9.0, 8.0, 7.0)]
SCHEMA = "frame long, row_id int, prev int, next int, x double, y double, z double"


def test_text_files_in_fixed_order(spark, tmp_path):
    (tmp_path / "cam3.10003_targets").write_text("2\n   0  900.7171  338.2859   100    10    10  1000     4\n   1  571.5725  473.7072   100    10    10  1000     3\n")
    (tmp_path / "cam1.10004_targets").write_text("0\n")
    (tmp_path / "ptv_is.10095").write_text("2\r\n  -1     0     30.0     -5.0     50.0\r\nx y\r\n  -1     1     80.0     10.0     30.0\r\n")
    got = [tuple(r) for r in text.read(spark, str(tmp_path / "cam*_targets"), "targets").orderBy("row_id").collect()]
    assert got == [(10003, 3, 0, 0, 900.7171, 338.2859, 100, 10, 10, 1000, 4), (10003, 3, 1, 1, 571.5725, 473.7072, 100, 10, 10, 1000, 3)]
    got = [tuple(r) for r in text.read(spark, str(tmp_path / "ptv_is.10095"), "ptv_is").orderBy("row_id").collect()]
    assert got == [(10095, 0, -1, 0, 30.0, -5.0, 50.0), (10095, 1, -1, 1, 80.0, 10.0, 30.0)]


def test_text_is_written_with_its_count_first(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    text.write(rows, str(tmp_path / "out"), "ptv_is")
    found = list((tmp_path / "out" / "frame=7").glob("part-*"))
    assert len(found) == 1 and found[0].read_text().startswith("2\n-1 2 1.500000 -2.250000 3.000000\n")
    assert sorted(tuple(r) for r in text.parse(text.lines(rows, "ptv_is"), "ptv_is").collect()) == ROWS
    assert not text.parse(text.lines(rows.where("false"), "ptv_is"), "ptv_is").collect()


def test_store_replaces_single_frames(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/run")
    rows = spark.createDataFrame(ROWS, SCHEMA)
    assert not store.has("correspondences")
    store.write("correspondences", rows)
    store.write("correspondences", rows.where("frame = 8").selectExpr("frame", "row_id", "prev", "next", "x + 1 AS x", "y", "z"))
    assert sorted((r.frame, r.row_id, r.x) for r in store.read("correspondences").collect()) == [(7, 0, 1.5), (7, 1, 0.0), (8, 0, 10.0)]
    assert store.read("correspondences", frame=7).count() == 2
    assert sorted(r.frame for r in store.frames().collect()) == [7, 8]
    for name in ("a", "b"):
        store.write("linkage", rows.selectExpr("*", f"'{name}' AS name"))
    store.clear("linkage", name="a")
    assert [r.name for r in store.names().collect()] == ["b"] and store.read("linkage", name="b").count() == 3
    with pytest.raises(ValueError):
        store.read("nothing")
