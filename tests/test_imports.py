"""CSV import with bad records set aside."""

import datetime as dt

import pytest

from salesloom.sources.imports import import_csv, import_csv_tables
from salesloom.sources.loaders import load_csv_tables
from tests.shop import write_shop

SCHEMA = "id bigint, name string, day timestamp_ntz, price decimal(10,2)"
GOOD = [
    (1, "plain", dt.datetime(2001, 1, 2), 5),
    (2, 'a "b"\nsecond\n\nfourth', dt.datetime(2001, 1, 3), None),
    (3, "c, d", None, 1),
    (None, None, None, None),
]
TEXT = (
    "﻿name,id,day,extra,price\r\n"
    "plain  ,1,2001-01-02 00:00:00,x,5\r\n"
    '"a ""b""\r\nsecond\r\n\r\nfourth",2,2001-01-03 00:00:00,"y",NULL\r\n'
    "\r\n"
    "few,3\r\n"
    "many,3,NULL,x,1,7\r\n"
    "word,three,NULL,x,1\r\n"
    '"c, d",3,NULL,x,1\r\n'
    "wrong day,4,soon,x,1\r\n"
    "NULL,NULL,NULL,NULL,NULL\r\n"
)
BAD = [
    (8, 1, "not 5 fields", "few,3"),
    (9, 1, "not 5 fields", "many,3,NULL,x,1,7"),
    (10, 1, "id is no bigint: three", "word,three,NULL,x,1"),
    (12, 1, "day is no timestamp_ntz: soon", "wrong day,4,soon,x,1"),
]


def _rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("split", ["128m", "48b"])
def test_bad_records_are_set_aside(spark, tmp_path, split):
    (tmp_path / "t").mkdir()
    for n in range(3):
        (tmp_path / "t" / f"{n}.csv").write_bytes(TEXT.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = import_csv(spark, str(tmp_path / "t"), SCHEMA)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert _rows(found.accepted) == sorted(GOOD * 3, key=str)
    assert _rows(found.rejected.drop("File")) == sorted(BAD * 3, key=str)
    assert _rows(found.counts.drop("File")) == [(13, 10, 1, 1, 4, 4)] * 3


def test_an_open_quote_costs_its_line(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1,"x\n2,y\n3,z\n')
    found = import_csv(spark, str(path), "a int, b string")
    assert _rows(found.accepted) == [(2, "y"), (3, "z")]
    assert [(r["Line"], r["Reason"]) for r in found.rejected.collect()] == [(2, "quote not closed")]
    path = tmp_path / "y.csv"
    path.write_text('a,b\n0,w\n1,"x\n2,y\n3,"\n4,v\n')
    assert _rows(import_csv(spark, str(path), "a int, b string").accepted) == [(0, "w"), (1, "x\n2,y\n3,"), (4, "v")]
    found = import_csv(spark, str(path), "a int, b string", most_lines=2)
    assert _rows(found.accepted) == [(0, "w"), (2, "y"), (4, "v")]
    assert sorted(r["Line"] for r in found.rejected.collect()) == [3, 5]


def test_a_clean_shop_loses_nothing(spark, tmp_path):
    write_shop(tmp_path)
    plain = load_csv_tables(spark, str(tmp_path))
    for name, found in import_csv_tables(spark, str(tmp_path)).items():
        assert found.rejected.count() == 0
        assert found.accepted.dtypes == plain[name].dtypes
        assert _rows(found.accepted) == _rows(plain[name])
        assert found.counts.where("Records <> Headers + Blank + Accepted + Rejected").count() == 0


def test_nothing_but_a_header(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n")
    found = import_csv(spark, str(path), "a int, b string")
    assert found.accepted.count() == found.rejected.count() == 0
    with pytest.raises(ValueError, match="c"):
        import_csv(spark, str(path), "a int, c int")
