"""Zipped XML tables, files by address, packed numbers."""

import datetime
import random
import zipfile

import numpy as np
import pytest

from terrane.sources import osm_pbf
from terrane.sources.files import open_at
from terrane.sources.xml_zip import read_xml_zip

GUID = "0a1b2c3d-0000-4000-8000-000000000001"


@pytest.fixture
def archive(tmp_path):
    path = tmp_path / "gar.zip"
    house = lambda k, more="": f'<HOUSE ID="{k}" HOUSENUM="{k} &amp; б" ISACTUAL="{k % 2}" STARTDATE="2020-01-0{k}" {more}/>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"77/AS_HOUSES_20240101_{GUID}.XML", "﻿<?xml version='1.0' encoding='utf-8'?><HOUSES>" + house(1) + house(2, 'OTHER="x"') + "</HOUSES>")
        z.writestr(f"50/AS_HOUSES_20240101_{GUID}.XML", f"<HOUSES>{house(3)}<HOUSE ID='nine' HOUSENUM=''><NESTED ID='4'/></HOUSE></HOUSES>")
        z.writestr(f"77/AS_HOUSES_PARAMS_20240101_{GUID}.XML", "<PARAMS><PARAM ID='7' VALUE='123456'/></PARAMS>")
        z.writestr(f"AS_HOUSE_TYPES_20240101_{GUID}.XML", "<HOUSETYPES><HOUSETYPE ID='5' NAME='Дом'/></HOUSETYPES>")
        z.writestr(f"50/AS_ROOMS_20240101_{GUID}.XML", "<ROOMS></ROOMS>")
        z.writestr("readme.txt", "x")
    return str(path)


def test_xml_tables_inside_a_zip(spark, archive):
    schema = "region string, ID bigint, HOUSENUM string, ISACTUAL boolean, STARTDATE date, ADDNUM1 string"
    day = datetime.date
    for path in (archive, f"file://{archive}", f"file:{archive}"):
        df = read_xml_zip(spark, path, "as_houses", schema)
        assert sorted(map(tuple, df.collect()), key=str) == [("50", 3, "3 & б", True, day(2020, 1, 3), None), ("50", None, "", None, None, None), ("77", 1, "1 & б", True, day(2020, 1, 1), None), ("77", 2, "2 & б", False, day(2020, 1, 2), None)]
        assert df.rdd.getNumPartitions() == 2
    assert [r.ID for r in read_xml_zip(spark, archive, "AS_HOUSES", "ID bigint", "77").orderBy("ID").collect()] == [1, 2]
    assert [(r.ID, r.VALUE) for r in read_xml_zip(spark, archive, "AS_PARAM", "ID int, VALUE string").collect()] == [(7, "123456")]
    assert [(r.region, r.NAME) for r in read_xml_zip(spark, archive, "AS_HOUSE_TYPES", "region string, NAME string", "77").collect()] == [(None, "Дом")]
    assert read_xml_zip(spark, archive, "AS_ROOMS", "ID int").count() == 0 == read_xml_zip(spark, archive, "AS_STEADS", "ID int").count()


def test_packed_numbers():
    rnd = random.Random(1)
    values = [0, 1, 127, 128, 300, 2**32, 2**63, 2**64 - 1] + [rnd.getrandbits(rnd.randint(1, 64)) for _ in range(500)]
    raw = bytearray()
    for n in values:
        while n > 127:
            raw.append(n & 127 | 128)
            n >>= 7
        raw.append(n)
    assert osm_pbf.numbers(bytes(raw)) == values == osm_pbf.numbers(memoryview(bytes(raw))) and osm_pbf.numbers(b"") == [] == osm_pbf.running(b"")
    steps = [(v % 2**40) - 2**39 for v in values]
    raw = bytearray()
    for s in steps:
        n = s << 1 if s >= 0 else (-s << 1) - 1
        while n > 127:
            raw.append(n & 127 | 128)
            n >>= 7
        raw.append(n)
    assert osm_pbf.running(bytes(raw)) == np.cumsum(steps).tolist()


def test_files_by_address_seek(tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    for path in (str(tmp_path / "f"), f"file://{tmp_path}/f"):
        with open_at(path) as f:
            f.seek(4)
            assert f.read(3) == b"456" and f.tell() == 7
