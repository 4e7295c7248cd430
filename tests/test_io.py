"""Sources, sinks, streams."""

import base64
import gzip
import io
import http.server
import json
import os
import re
import struct
import threading
import urllib.parse
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.sources import archives as ar
from orrery.sources import readers as rd
from orrery.sources import sinks as sk
from orrery.streaming import windows as sw
from tests.conftest import DATA


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id long, x double")
    assert rd.clean(df).agg(F.avg("x")).first()[0] == 3.0


def test_schema_drift(spark):
    df = spark.createDataFrame([(1, "a")], "id long, x string")
    assert rd.checked(df, T._parse_datatype_string("id long")).columns == ["id"]
    with pytest.raises(ValueError, match="x: double expected"):
        rd.checked(df, T._parse_datatype_string("id long, x double"))


def test_csv_keys_stay_text(spark, tmp_path):
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write("oktmo,value\n01234,1.5\n00007,\n")
    got = sorted(map(tuple, rd.read_csv(spark, f"{tmp_path}/t.csv.gz", "oktmo string, value double").collect()))
    assert got == [("00007", None), ("01234", 1.5)]


def test_indicator_reads_only_its_years(spark, tmp_path):
    head = "oktmo;oktmo_stable;municipality;year;indicator_period;mun_level;okved2;indicator_value;noise\n"
    for year in (2022, 2023, 2024):
        (tmp_path / f"data_Y1_year{year}_x.csv").write_text(head + f"01;02;A;{year};q1;upper;Total;5;z\n01;02;A;{year};q1;lower;Total;6;z\n01;02;A;{year};q1;upper;Other;7;z\n")
    got = rd.read_indicator(spark, str(tmp_path), [2023, 2024], ["okved2"], {"okved2": ["Total"]}, "upper")
    assert got.columns == ["oktmo", "oktmo_stable", "municipality", "year", "period", "okved2", "value"]
    assert sorted((r["year"], r["value"]) for r in got.collect()) == [("2023", "5"), ("2024", "5")]


def test_zip_parquet(spark, tmp_path):
    pq.write_table(pa.table({"id": [1, 2], "date": ["2023-01", "2023-02"], "extra": [0, 0]}), tmp_path / "c.parquet")
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.write(tmp_path / "c.parquet", "data/consumption.parquet")
        z.writestr("readme.txt", "x")
    got = rd.read_zip_parquet(spark, f"{tmp_path}/p.zip", r"data/.*\.parquet", "id long, date string")
    assert sorted(map(tuple, got.collect())) == [(1, "2023-01"), (2, "2023-02")]


def test_sdmx(spark, tmp_path):
    (tmp_path / "p.xml").write_text("""<?xml version="1.0" encoding="utf-8"?><m:G xmlns:m="urn:m" xmlns:g="urn:g"><m:CodeLists><m:CodeList id="s_OKATO"><m:Code value="1"><m:Description>North</m:Description></m:Code><m:Code value="2"><m:Description>South</m:Description></m:Code></m:CodeList></m:CodeLists>
<m:DataSet><g:Series><g:SeriesKey><g:Value concept="s_OKATO" value="1"/><g:Value concept="PERIOD" value="февраль"/></g:SeriesKey><g:Obs><g:Time>2023</g:Time><g:ObsValue value="101,5"/></g:Obs><g:Obs><g:Time>2024</g:Time><g:ObsValue value="99"/></g:Obs></g:Series></m:DataSet></m:G>""", encoding="utf-8")
    got = sorted(map(tuple, rd.read_sdmx(spark, f"{tmp_path}/p.xml", "s_OKATO", "s_OKATO").collect()))
    assert got == [("North", 2023, 2, 101.5), ("North", 2024, 2, 99.0)]


def b64(s):
    return base64.b64encode(s.encode()).decode()


def test_tagged_values(spark):
    value = {"type": "object", "value": [{"key": "a", "type": "number", "value": "__number__1.5"}, {"key": "b", "value": ["__null__", "__boolean__true", "__string__" + b64("né")]}, {"key": "c", "value": "plain"}]}
    assert rd.decode_tagged(value) == {"a": 1.5, "b": [None, True, "né"], "c": "plain"}
    assert rd.decode_tagged({"type": "object", "value": [{"type": "longstring", "value": ["__string__" + b64("ab"), "__string__" + b64("c")]}]}) == "abc"
    df = spark.createDataFrame([("__number__2",), ("__null__",), ("__string__" + b64("né"),), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(rd.untagged(F.col("t"))).collect()] == ["2", None, "né", "x", None]


def test_paged_source(spark):
    data = [[f"__number__{i}", "__string__" + b64(f"n{i}")] for i in range(25)]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
            lo, n = int(q["offset"][0]), int(q["limit"][0])
            body = json.dumps({"data": data[lo : lo + n], "fields": ["id", "name"], "pagination": {"total_records": len(data)}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(rd.PagedSource)
        df = spark.read.format("paged").option("url", f"http://127.0.0.1:{server.server_port}/d").option("limit", 10).load()
        assert sorted(r["name"] for r in df.collect()) == sorted(f"n{i}" for i in range(25))
    finally:
        server.shutdown()


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"paths": {"raw": "data/raw"}, "k": 6}')
    c = rd.load_config(str(tmp_path / "c.json"))
    assert c["k"] == 6 and c["paths"]["raw"] == f"{tmp_path}/data/raw"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024Q1", 0.125), (2, "2024Q2", 0.375)], "id long, period string, x double")
    sk.write_table(df, f"{tmp_path}/t", ["period"])
    assert spark.read.parquet(f"{tmp_path}/t").filter("period = '2024Q1'").count() == 1
    sk.write_result(df, f"{tmp_path}/r", 2)
    assert sorted(r["x"] for r in spark.read.option("header", True).csv(f"{tmp_path}/r").collect()) == ["0.12", "0.38"]
    for value in (1.0, 2.0):
        sk.append_cell(spark.createDataFrame([(value,)], "x double"), f"{tmp_path}/g", "k=3")
    sk.append_cell(spark.createDataFrame([(9.0,)], "x double"), f"{tmp_path}/g", "k=4")
    assert sorted(r["x"] for r in spark.read.parquet(f"{tmp_path}/g").collect()) == [2.0, 9.0]
    sk.dump(sk.payload(df, "id"), f"{tmp_path}/p.json")
    assert (tmp_path / "p.json").read_text() == '{"1":{"period":"2024Q1","x":0.125},"2":{"period":"2024Q2","x":0.375}}'
    wkb = sk.polygon_wkb([[(0, 0), (1, 0), (1, 1), (0, 0)]])
    assert struct.unpack_from("<BIII", wkb) == (1, 3, 1, 4) and struct.unpack_from("<dd", wkb, 13 + 16) == (1, 0) and len(wkb) == 13 + 4 * 16


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{DATA}/events.parquet")
    ev.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    stream = sw.event_shares(sw.stream_of(spark, f"{tmp_path}/in", ev.schema, 1), late="30 days")
    got = sw.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    batch = {(str(r["start"]), r["user_id"]): (r["n"], round(r["value"], 6)) for r in sw.event_shares(ev).collect()}
    rows = [((str(r["start"]), r["user_id"]), (r["n"], round(r["value"], 6))) for r in got.collect()]
    assert len(rows) == len(dict(rows)) and all(batch[k] == v for k, v in rows)


class FileServer:
    """Serves bytes, with ranges, and counts the requests."""

    def __init__(self, content, answer_ranges=True):
        outer = self
        self.asked = []

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                r = self.headers.get("Range") if answer_ranges else None
                lo, hi = map(int, r.removeprefix("bytes=").split("-")) if r else (0, len(content))
                outer.asked.append((lo, hi))
                self.send_response(206 if r else 200)
                if r:
                    self.send_header("Content-Range", f"bytes {lo}-{min(hi, len(content) - 1)}/{len(content)}")
                self.end_headers()
                self.wfile.write(content[lo : hi + 1])

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["BOX"]
                route = base64.b64decode(body["route"]).decode()
                lo, n = int(re.search(r"offset=(\d+)", route)[1]), int(re.search(r"limit=(\d+)", route)[1])
                page = {"type": "object", "value": [{"key": "data", "value": content[lo : lo + n]}, {"key": "fields", "value": ["id", "name"]}, {"key": "pagination", "value": {"type": "object", "value": [{"key": "total_records", "value": f"__number__{len(content)}"}]}}]}
                self.send_response(200 if route.startswith("/set/7") else 404)
                self.end_headers()
                self.wfile.write(json.dumps({"BOX": {"data": page}}).encode())

            def log_message(self, *a):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/a.zip"

    def __enter__(self):
        return self

    def __exit__(self, *a):
        self.server.shutdown()


def test_fetch(tmp_path):
    with FileServer(b"some content") as web:
        assert rd.fetch(web.url, f"{tmp_path}/x/a.bin") and not rd.fetch(web.url, f"{tmp_path}/x/a.bin")
    assert (tmp_path / "x" / "a.bin").read_bytes() == b"some content" and os.listdir(tmp_path / "x") == ["a.bin"]


@pytest.mark.parametrize("block", [64, 4096, 1 << 20])
def test_remote_archive(block):
    rng, packed = np.random.default_rng(1), io.BytesIO()
    files = {"noise.bin": rng.bytes(50_000), "plain/текст.txt": "много слов ".encode() * 3000, "empty": b"", "stored.bin": bytes(range(256)) * 20}
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=name.startswith("plain")) as f:
                f.write(data)
        z.writestr("stored.bin2", b"abc" * 100, zipfile.ZIP_STORED)
        z.comment = b"a comment at the end"
    content = packed.getvalue()
    with FileServer(content) as web:
        archive = ar.RemoteArchive(web.url, block=block)
        assert set(archive.members) == {*files, "stored.bin2"}
        assert all(archive.read(n) == d and archive.members[n].size == len(d) for n, d in files.items())
        assert archive.read("stored.bin2") == b"abc" * 100
        one = ar.RemoteArchive(web.url, block=4096)
        before = len(web.asked)
        assert one.read("stored.bin2") and len(web.asked) - before <= 2
        spoilt = ar.RemoteArchive(web.url, block=block)
        spoilt.members["empty"].crc = 5
        with pytest.raises(zipfile.BadZipFile):
            spoilt.read("empty")
    with FileServer(b"not an archive" * 10) as web, pytest.raises(zipfile.BadZipFile):
        ar.RemoteArchive(web.url)
    with FileServer(content, answer_ranges=False) as web, pytest.raises(OSError):
        ar.RemoteArchive(web.url)


def test_large_archive_directory():
    """Places beyond four gigabytes come from the 64-bit records."""
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", b"hello")
    raw = packed.getvalue()
    at, end = raw.index(ar.ENTRY), raw.index(ar.END)
    entry = bytearray(raw[at:end])
    struct.pack_into("<H", entry, 30, 28)
    struct.pack_into("<II", entry, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<I", entry, 42, 0xFFFFFFFF)
    entry += struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    there = at + len(entry)
    record = ar.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    tail = ar.LOCATOR + struct.pack("<IQI", 0, there, 1) + ar.END + struct.pack("<HHHHIIH", 0, 0, 1, 1, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    with FileServer(raw[:at] + bytes(entry) + record + tail) as web:
        assert ar.RemoteArchive(web.url).read("a.txt") == b"hello"


def test_paged_post(spark):
    rows = [[f"__number__{i}", "__string__" + base64.b64encode(f"n{i}".encode()).decode()] for i in range(23)]
    with FileServer(rows) as web:
        spark.dataSource.register(rd.PagedSource)
        df = spark.read.format("paged").option("url", web.url).option("route", "/set/7").option("envelope", "BOX").option("limit", 10).load()
        assert sorted(r["name"] for r in df.collect()) == sorted(f"n{i}" for i in range(23))


def test_zipped_csv(spark, tmp_path):
    def pack(name, members):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for member, text in members.items():
                z.writestr(member, text)

    rows = lambda year, n: "code;value;year;note\n" + "".join(f'0{i};"{i},5";{year};"a\nb"\n' for i in range(n))
    pack("one.zip", {"data_1_year2020_x.csv": rows(2020, 3), "data_1_year2021_x.csv": rows(2021, 4), "readme.txt": "no"})
    pack("two.zip", {"data_2_2020_v1.csv": rows(2019, 2)})
    got = ar.read_zipped_csv(spark, str(tmp_path), ["code", "value", "other"], [2021, 2030])
    assert sorted((r["member"], r["code"], r["value"], r["other"]) for r in got.collect()) == sorted([("data_1_year2021_x.csv", f"0{i}", f"{i},5", None) for i in range(4)] + [("data_2_2020_v1.csv", f"0{i}", f"{i},5", None) for i in range(2)])
    assert ar.read_zipped_csv(spark, f"{tmp_path}/one.zip", ["code"], piece=64).count() == 7


def test_sheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'''<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>
    <row r="2"><c r="A2" t="inlineStr"><is><t>007</t></is></c><c r="C2"><v>1.5</v></c></row><row r="3"><c r="C3"><v>2</v></c></row></sheetData></worksheet>'''
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>code</t></si><si><r><t>val</t></r><r><t>ue</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/sheet10.xml", "<worksheet/>")
    assert [tuple(r) for r in ar.read_sheet(spark, f"{tmp_path}/b.xlsx", "value double, code string").collect()] == [(1.5, "007"), (2.0, None)]
