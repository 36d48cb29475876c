"""Bags in ranges of bytes, against reading a file from its beginning."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import BagError
from tessera.sources import bag

RNG = np.random.default_rng(3)


def made(path, n=400, tail=b"", footer=True):
    """Messages of many sizes, some larger than a range, with payloads that quote records."""
    inner = bag.record("/lidar/points", 1.0, b'{"a": 1}')
    with bag.Writer(str(path)) as w:
        for i in range(n):
            size = int(RNG.integers(0, 50)) if i % 30 != 29 else 1500
            w.write(f"/t{i % 7}é" if i % 3 else "/lidar/points", float(i) / 4, {"i": i, "pad": "x{}" * size, "raw": inner.decode("latin-1")})
    data = path.read_bytes()
    data = data if footer else data[: -len(bag.FOOTER)]
    path.write_bytes(data + tail)
    return list(bag.messages(path.read_bytes()))


def rows(frame):
    return [tuple(r)[1:] for r in frame.orderBy("path", "offset").collect()]


@pytest.mark.parametrize(("split", "n"), [(64, 9), (1500, 90), (1 << 20, 400)])
def test_ranges_give_what_the_whole_file_gives(spark, tmp_path, split, n):
    want = made(tmp_path / "a.sbag", n)
    assert rows(bag.read(spark, str(tmp_path / "a.sbag"), split=split)) == want


def test_cut_off_files_and_files_without_a_footer(spark, tmp_path):
    whole = made(tmp_path / "a.sbag", 60, footer=False)
    assert rows(bag.read(spark, str(tmp_path / "a.sbag"), split=700)) == whole
    data = (tmp_path / "a.sbag").read_bytes()
    (tmp_path / "a.sbag").write_bytes(data[:-10])
    assert rows(bag.read(spark, str(tmp_path / "a.sbag"), split=700)) == whole[:-1]
    (tmp_path / "a.sbag").write_bytes(bag.MAGIC + b"\x07")
    assert rows(bag.read(spark, str(tmp_path / "a.sbag"))) == []
    (tmp_path / "a.sbag").write_bytes(b"nothing at all")
    with pytest.raises(Exception, match="no bag"):
        bag.read(spark, str(tmp_path / "a.sbag")).count()


def test_a_wrong_guess_is_corrected(spark, tmp_path, monkeypatch):
    """A payload of raw bytes that holds a chain of whole records misleads a range, and the chain from the file's beginning sets it right."""
    chain = b"".join(bag.record("/fake", 2.0, b'{"fake": 1}') for i in range(40))
    with open(tmp_path / "a.sbag", "wb") as f:
        f.write(bag.MAGIC + b"\x01")
        for i in range(12):
            f.write(bag.record("/real", float(i), b'{"i": "' + chain + b'"}' if i % 4 == 1 else b'{"i": 1}'))
        f.write(bag.FOOTER)
    want = list(bag.messages((tmp_path / "a.sbag").read_bytes()))
    assert len(want) == 12
    with open(tmp_path / "a.sbag", "rb") as f:
        window = bag._Window(f, (tmp_path / "a.sbag").stat().st_size)
        assert any(bag._first_likely(window, s, s + 300) not in {None, *(w[0] for w in want)} for s in range(300, 1500, 300))  # the guess alone is wrong
    for split in (300, 1000):
        assert rows(bag.read(spark, str(tmp_path / "a.sbag"), split=split)) == want


def test_filters_are_pushed_down(spark, tmp_path):
    made(tmp_path / "a.sbag", 120)
    path = str(tmp_path / "a.sbag")
    asked = bag.read(spark, path, ["/lidar/points", "/t1é"], 5.0, 27.25, split=9000)
    said = io.StringIO()
    with redirect_stdout(said):
        asked.explain("formatted")
    plan = said.getvalue()
    assert "PushedFilters: [IsNotNull(timestamp), In(topic, [/lidar/points,/t1é]), GreaterThanOrEqual(timestamp,5.0), LessThanOrEqual(timestamp,27.25)]" in plan
    assert "Filter (" not in plan  # nothing is left for Spark to test
    whole = list(bag.messages((tmp_path / "a.sbag").read_bytes()))
    want = [m for m in whole if m[1] in ("/lidar/points", "/t1é") and 5.0 <= m[2] <= 27.25]
    assert rows(asked) == want and len(want) > 20
    assert rows(bag.read(spark, path, "/lidar/points")) == [m for m in whole if m[1] == "/lidar/points"] and rows(bag.read(spark, path, [])) == []


def test_plans_over_one_frame_do_not_narrow_each_other(spark, tmp_path):
    made(tmp_path / "a.sbag", 60)
    whole = list(bag.messages((tmp_path / "a.sbag").read_bytes()))
    frame = bag.read(spark, str(tmp_path / "a.sbag"), start=2.0)
    here = [m for m in whole if m[2] >= 2.0]
    one, other = frame.where("topic = '/lidar/points'"), frame.where((F.col("timestamp") > 5) & (F.col("timestamp") < 9))
    assert one.count() == sum(m[1] == "/lidar/points" for m in here) and frame.count() == len(here)
    assert other.count() == sum(5 < m[2] < 9 for m in here) and one.unionByName(other).count() == one.count() + other.count() and frame.count() == len(here)


def test_parts_and_one_file(spark, tmp_path):
    made(tmp_path / "a.sbag", 150)
    frame = bag.read(spark, str(tmp_path / "a.sbag"), split=2000)
    bag.write_parts(frame, str(tmp_path / "parts"), parts=3)
    back = bag.read(spark, str(tmp_path / "parts"), split=2000)
    assert back.select("path").distinct().count() > 1 and [r[1:] for r in rows(back)] == [r[1:] for r in rows(frame)]
    bag.write_parts(frame.where("topic = '/lidar/points'"), str(tmp_path / "parts"), "overwrite")
    assert set(r[1] for r in rows(bag.read(spark, str(tmp_path / "parts")))) == {"/lidar/points"}
    assert not [p for p in (tmp_path / "parts").iterdir() if p.name.startswith("_")]
    bag.write(frame, str(tmp_path / "one.sbag"))
    assert len((tmp_path / "one.sbag").read_bytes()) == len((tmp_path / "a.sbag").read_bytes())
    assert (tmp_path / "one.sbag").read_bytes() == (tmp_path / "a.sbag").read_bytes() and not (tmp_path / "one.sbag.parts").exists()
    bag.write_parts(frame.limit(0), str(tmp_path / "none"))
    for bad in ((None, 1.0, "{}"), ("", 1.0, "{}"), ("/a", None, "{}"), ("/a", 1.0, "[1]"), ("/a", 1.0, None)):
        with pytest.raises(Exception, match="a message has"):
            bag.write_parts(spark.createDataFrame([bad], "topic string, timestamp double, data string"), str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("part-*"))


def test_magic(spark, tmp_path):
    with pytest.raises(BagError):
        list(bag.messages(b"nothing"))
