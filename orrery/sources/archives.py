"""Archives and spreadsheets: CSV members of zips as a table, members of a remote zip without the whole of it, first
sheets of workbooks."""

from __future__ import annotations

import io
import struct
import urllib.request
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.shipping import ship

#: Fixed values of the zip format: signatures and layouts of its records.
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str], years: list[int] | None = None, member: str = r"\.csv$", year: str = r"year(\d{4})", sep: str = ";", piece: int = 16 << 20) -> DataFrame:
    """All CSV members of the zips at path (a file, folder or pattern), the named columns as text and `member`, the file's
    name. Of zips that have members of the asked years those alone are read, else the members without a year. Each zip is
    a task, which holds its packed bytes; members are unpacked and parsed piece by piece."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).filter(F.col("path").endswith(".zip")).select("content")
    schema = pa.schema([*((c, pa.string()) for c in columns), ("member", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for rb in batches:
            for content in rb.column("content"):
                z = zipfile.ZipFile(io.BytesIO(content.as_py()))
                names = [n for n in z.namelist() if re.search(member, n)]
                of = {n: (m := re.search(year, n)) and int(m[1]) for n in names}
                dated = sorted(n for n in names if of[n] is not None and of[n] in (years or [of[n]]))
                for name in names if years is None else dated or [n for n in names if of[n] is None]:
                    with z.open(name) as f:
                        options = pc.ConvertOptions(include_columns=columns, column_types=dict.fromkeys(columns, pa.string()), include_missing_columns=True, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""])
                        for part in pc.open_csv(f, pc.ReadOptions(block_size=piece), pc.ParseOptions(delimiter=sep, newlines_in_values=True), options):
                            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([name] * part.num_rows, pa.string())], schema=schema)

    return files.mapInArrow(run, T.StructType([T.StructField(n, T.StringType()) for n in schema.names]))


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first sheet of a workbook, a small dictionary: names in its first row, each field's text cast to its type; cells
    that are missing or empty are null."""
    with zipfile.ZipFile(path) as z:
        local = lambda node: node.tag.rsplit("}", 1)[-1]
        text = lambda node: "".join(t.text or "" for t in node.iter() if local(t) == "t")
        shared = [text(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        sheet = ET.fromstring(z.read(min((n for n in z.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml")), key=lambda n: (len(n), n))))
    rows = []
    for row in (r for r in sheet.iter() if local(r) == "row"):
        cells = {}
        for n, c in enumerate(row):
            column = 0
            for letter in "".join(filter(str.isalpha, c.get("r", ""))):
                column = 26 * column + ord(letter) - 64
            value = text(c) if c.get("t") == "inlineStr" else next((v.text for v in c if local(v) == "v"), None)
            cells[column - 1 if column else n] = shared[int(value)] if c.get("t") == "s" and value else value
        rows.append(cells)
    fields = T._parse_datatype_string(schema).fields
    at = {name: i for i, name in (rows[0] if rows else {}).items()}
    data = [tuple(r.get(at[f.name]) or None for f in fields) for r in rows[1:]]
    raw = spark.createDataFrame(data, T.StructType([T.StructField(f.name, T.StringType()) for f in fields]))
    return raw.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))


class Blocks:
    """Bytes of a remote file by aligned blocks, of which the last few stay in memory."""

    def __init__(self, url: str, block: int = 1 << 20, keep: int = 8, headers: dict[str, str] | None = None):
        self.url, self.block, self.keep, self.headers = url, block, keep, headers or {}
        self.cache: OrderedDict[int, bytes] = OrderedDict()
        self.length = 0
        self.ask(0)  # the answer to the first range says how long the file is

    def ask(self, number: int) -> bytes:
        if number in self.cache:
            self.cache.move_to_end(number)
            return self.cache[number]
        first = number * self.block
        request = urllib.request.Request(self.url, headers=self.headers | {"Range": f"bytes={first}-{first + self.block - 1}"})
        with urllib.request.urlopen(request, timeout=120) as answer:
            data, of = answer.read(), answer.headers.get("Content-Range")
        if of is None:
            raise OSError(f"{self.url} does not answer ranges")
        self.length = int(of.rsplit("/", 1)[1])
        self.cache[number] = data
        while len(self.cache) > self.keep:
            self.cache.popitem(last=False)
        return data

    def span(self, first: int, end: int) -> bytes:
        end = min(end, self.length)
        parts = [self.ask(n) for n in range(first // self.block, -(-end // self.block))]
        start = first - first // self.block * self.block
        return b"".join(parts)[start : start + end - first]


@dataclass
class Member:
    name: str
    method: int
    packed: int
    size: int
    crc: int
    offset: int


class RemoteArchive:
    """A zip on a server that answers ranges: its directory, and members unpacked piece by piece."""

    def __init__(self, url: str, **settings):
        self.blocks = Blocks(url, **settings)
        length = self.blocks.length
        tail_at = max(0, length - (1 << 16) - 22)
        tail = self.blocks.span(tail_at, length)
        end = tail.rfind(END)
        if end < 0:
            raise zipfile.BadZipFile(f"{url} has no directory")
        size, at = struct.unpack_from("<II", tail, end + 12)
        if end >= 20 and tail[end - 20 : end - 16] == LOCATOR:
            there = struct.unpack_from("<Q", tail, end - 12)[0]
            size, at = struct.unpack_from("<QQ", self.blocks.span(there, there + 56), 40)
        directory, place = self.blocks.span(at, at + size), 0
        self.members: dict[str, Member] = {}
        while directory[place : place + 4] == ENTRY:
            flags, method = struct.unpack_from("<HH", directory, place + 8)
            crc, packed, full, n, extra, comment = struct.unpack_from("<IIIHHH", directory, place + 16)
            offset = struct.unpack_from("<I", directory, place + 42)[0]
            name = directory[place + 46 : place + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            more, wide = directory[place + 46 + n : place + 46 + n + extra], {}
            while len(more) >= 4:  # sizes and places that need 64 bits stand here, in this order
                kind, k = struct.unpack_from("<HH", more)
                if kind == 1:
                    values = iter(struct.unpack_from(f"<{k // 8}Q", more, 4))
                    wide = {key: next(values) for key, v in (("size", full), ("packed", packed), ("offset", offset)) if v == 0xFFFFFFFF}
                more = more[4 + k :]
            self.members[name] = Member(name, method, wide.get("packed", packed), wide.get("size", full), crc, wide.get("offset", offset))
            place += 46 + n + extra + comment

    def pieces(self, name: str) -> Iterator[bytes]:
        m = self.members[name]
        if m.method not in (0, 8):
            raise zipfile.BadZipFile(f"{name} is packed by method {m.method}")
        head = self.blocks.span(m.offset, m.offset + 30)
        if head[:4] != LOCAL:
            raise zipfile.BadZipFile(f"{name} does not stand where the directory says")
        at = m.offset + 30 + sum(struct.unpack_from("<HH", head, 26))
        unpack, crc, end = zlib.decompressobj(-15), 0, at + m.packed
        while at < end:
            raw = self.blocks.span(at, min(end, at + self.blocks.block))
            at += len(raw)
            data = raw if m.method == 0 else unpack.decompress(raw)
            crc = zlib.crc32(data, crc)
            yield data
        if crc != m.crc:
            raise zipfile.BadZipFile(f"{name} has another checksum")

    def read(self, name: str) -> bytes:
        return b"".join(self.pieces(name))
