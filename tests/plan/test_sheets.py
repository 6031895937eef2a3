"""Spreadsheets: .xls, .xlsx and .csv give the same points; what is written is read back; files keep their order."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from stopwise.sources import sheets, tables

ROWS = [("a1", "106.9,29.8", 3.5), ("", "106.9,29.8", 7), ("b2", "bad", None), ("nan", "1,2", -4), ("长寿区小区", "107.0,29.9", 0.25), ("长" * 3000 + "x" * 3000, "107.1,29.7", 1e10)]
HEAD = ("addr", "xy", "size")
MAPPING = {"name": "addr", "coordinates": "xy", "metadata": {"size": "size"}}


def record(kind, data):
    return struct.pack("<HH", kind, len(data)) + data


def string(text):
    """A string with its flags; in two bytes a character where it must."""
    wide = any(ord(c) > 255 for c in text)
    return struct.pack("<HB", len(text), wide), text.encode("utf-16-le" if wide else "latin-1"), wide


def workbook(rows):
    """A workbook stream: text by the table of strings, numbers in all their forms."""
    texts = list(dict.fromkeys(v for row in rows for v in row if isinstance(v, str)))
    pieces, now = [], struct.pack("<II", len(texts), len(texts))
    for text in texts:
        head, body, wide = string(text)
        if len(now) + len(head) > 8000:
            pieces.append(now)
            now = b""
        now += head
        while len(now) + len(body) > 8000:  # goes on in the next record behind a flag
            room = (8000 - len(now)) // 2 * 2
            pieces.append(now + body[:room])
            now, body = bytes([wide]), body[room:]
        now += body
    pieces.append(now)
    sst = record(0xFC, pieces[0]) + b"".join(record(0x3C, p) for p in pieces[1:])
    bof = lambda kind: record(0x0809, struct.pack("<HHHHII", 0x0600, kind, 0, 0, 0, 0))
    cells = b""
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            at = struct.pack("<HHH", r, c, 0)
            if isinstance(v, str):
                cells += record(0xFD, at + struct.pack("<I", texts.index(v))) if r % 2 == 0 or ord(max(v, default=" ")) > 255 or len(v) > 200 else record(0x0204, at + struct.pack("<HB", len(v), 0) + v.encode("latin-1"))
            elif isinstance(v, int) and abs(v) < 1 << 28:
                cells += record(0x027E, at + struct.pack("<I", (v << 2 | 2) & 0xFFFFFFFF)) if v != 7 else record(0xBD, struct.pack("<HHHIH", r, c, 0, 7 << 2 | 2, c))
            elif v == 0.25:
                cells += record(0x027E, at + struct.pack("<I", 25 << 2 | 3))
            elif v is not None:
                cells += record(0x0203, at + struct.pack("<d", v)) if v != 3.5 else record(0x06, at + struct.pack("<d", v) + bytes(8))
    name = record(0x85, struct.pack("<IBBBB", 0, 0, 0, 1, 0) + b"S")
    start = len(bof(5)) + len(name) + len(sst) + 4
    name = record(0x85, struct.pack("<IBBBB", start, 0, 0, 1, 0) + b"S")
    return bof(5) + name + sst + record(0x0A, b"") + bof(0x10) + cells + record(0x0A, b"")


def compound(stream):
    """A compound file with one stream, in the small stream if it is short."""
    small = len(stream) < 4096
    pad = lambda x, n: x + bytes(-len(x) % n)
    body, end, free = pad(stream, 512), 0xFFFFFFFE, 0xFFFFFFFF
    n = len(body) // 512
    chain = lambda first, count: [*range(first + 1, first + count), end]
    fat = [0xFFFFFFFD, end, end, *chain(3, n)]  # table, directory, small table, data
    fat += [free] * (128 - len(fat))
    assert len(fat) == 128
    minis = -(-len(stream) // 64)
    small_table = struct.pack("<128I", *(chain(0, minis) + [free] * (128 - minis))) if small else struct.pack("<128I", *[free] * 128)
    entry = lambda name, kind, start, size: pad(name.encode("utf-16-le") + bytes(2), 64) + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + struct.pack("<III", free, free, 1 if kind == 5 else free) + bytes(36) + struct.pack("<III", start, size, 0)
    directory = pad(entry("Root Entry", 5, 3 if small else end, len(body) if small else 0) + entry("Workbook", 2, 0 if small else 3, len(stream)), 512)
    header = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIII", 1, 1, 0, 4096, 2, 1, end, 0) + struct.pack("<109I", 0, *[free] * 108)
    return header + struct.pack("<128I", *fat) + directory + small_table + body


def points_of(spark, path):
    got = tables.points(tables.read_table(spark, str(path)), MAPPING).orderBy("point_idx").select("point_idx", "point_id", "name", "lng", "lat", "metadata").collect()
    return [tuple(r) for r in got]


def test_xls_xlsx_and_csv_give_the_same_points(spark, tmp_path):
    (tmp_path / "p.xls").write_bytes(compound(workbook([HEAD, *ROWS])))
    (tmp_path / "short.xls").write_bytes(compound(workbook([HEAD, *ROWS[:5]])))
    with open(tmp_path / "p.xlsx", "wb") as f:
        sheets.write_rows(f, list(HEAD), iter(ROWS))
    text = lambda v: "" if v is None else sheets._number(float(v)) if isinstance(v, int | float) else v
    (tmp_path / "p.csv").write_text(",".join(HEAD) + "\n" + "\n".join(f'{a},"{b}",{text(c)}' for a, b, c in ROWS) + "\n")
    found = [points_of(spark, tmp_path / f) for f in ("p.csv", "p.xls", "p.xlsx")]
    for other in found[1:]:
        assert [(*r[:5], float(r[5]["size"] or 0)) for r in other] == [(*r[:5], float(r[5]["size"] or 0)) for r in found[0]]
    assert [r[2] for r in found[0]] == ["a1", "b2", "长寿区小区", ROWS[5][0]]
    assert points_of(spark, tmp_path / "short.xls") == found[1][:3]
    assert points_of(spark, f"file://{tmp_path}/p.xls") == found[1]


def test_broken_workbooks_are_errors():
    with pytest.raises(ValueError):
        list(sheets.xls_rows(b"\xd0\xcf\x11\xe0 no more"))
    with pytest.raises(ValueError):
        list(sheets.xls_rows(compound(record(0x0809, struct.pack("<HH", 0x0600, 5)) + record(0x2F, b"\0\0"))))


def test_written_sheets_are_read_back_in_order(spark, tmp_path):
    odd = ["plain", "", " lead and trail ", "a<b>&\"'", "line\nbreak\ttab\rreturn", "\x00\x1f", "_x0041_", "_x005F_", "日本\U0001f600", None]
    rows = [(k, odd[k % len(odd)], None if k % 7 == 0 else k / 8, k % 2 == 0, k * 10**12) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, t string, x double, b boolean, big long").repartition(4)
    sheets.write_sheets(df, f"file://{tmp_path}/out", ["k"], 4)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert "_SUCCESS" in names and sum(n.endswith(".xlsx") for n in names) > 1 and not any(n.startswith("_temp") for n in names)
    back = tables.read_table(spark, f"file://{tmp_path}/out", "xlsx")
    assert back.columns == ["k", "t", "x", "b", "big", "row_no"]
    got = back.select(F.col("row_no"), F.col("k").cast("int"), "t", F.col("x").cast("double"), F.col("b") == "1", F.col("big").cast("long")).orderBy("row_no").collect()
    assert [tuple(r) for r in got] == [(k, *r) for k, r in enumerate(rows)]
    sheets.write_sheets(df.filter("k < 3"), f"file://{tmp_path}/out", ["k"])  # overwrites
    assert tables.read_table(spark, f"{tmp_path}/out", "xlsx").count() == 3
    sheets.write_sheets(df.limit(0), f"{tmp_path}/none", ["k"])
    assert tables.read_table(spark, f"{tmp_path}/none", "xlsx").columns == back.columns
    with zipfile.ZipFile(next((tmp_path / "none").glob("*.xlsx"))) as z:
        assert z.testzip() is None and "[Content_Types].xml" in z.namelist()


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    df = spark.range(40).repartition(4).select(F.col("id"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise("x").alias("t"))
    spark.dataSource.register(sheets.SheetTarget)
    with pytest.raises(Exception, match="broken"):
        df.write.format("xlsx").mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []


def test_rows_are_numbered_in_order_of_files_and_blocks(spark, tmp_path):
    for name, lo, n in (("b.csv", 100, 400), ("a.csv", 0, 100), ("c.csv", 500, 3)):  # the largest file is neither first nor last
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("v\n" + "\n".join(str(lo + k) for k in range(n)) + "\n")
    got = tables.read_table(spark, str(tmp_path / "in"), "csv").select(F.col("v").cast("int"), "row_no").collect()
    assert len(got) == 503 and all(r.v == r.row_no for r in got)
    spark.range(2000).repartitionByRange(3, "id").sortWithinPartitions("id").write.option("parquet.block.size", 2048).parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = tables.read_table(spark, str(tmp_path / "p"), "parquet").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2000 and all(r.id == r.row_no for r in got)
