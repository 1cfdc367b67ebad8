"""The workbook data source: one task per sheet, damaged sheets report themselves."""

import zipfile

from voxtally.sources import workbook
from voxtally.sources.workbook_source import WorkbookReader, read_sheets, write_workbooks

from .xlsx import write_xlsx

SHEETS = {
    "first": [["id", "text", None, "id"], [1, "a b", True, 2.5], [2, "inline:x", None, ("date", 45000.25)]],
    "second": [["k"], ["é"], [None], ["last"]],
    "third": [["only a header"]],
}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_same_cells_as_whole_file_read(spark, tmp_path):
    write_xlsx(tmp_path / "a.xlsx", SHEETS)
    write_xlsx(tmp_path / "b.xlsx", {"s": [["h"], ["v"]]})
    assert len(WorkbookReader(str(tmp_path)).partitions()) == 4
    by_sheet = read_sheets(spark, str(tmp_path))
    whole = workbook.read_cells(spark, f"file://{tmp_path}/a.xlsx", f"file://{tmp_path}/b.xlsx")
    assert by_sheet.rdd.getNumPartitions() == 4 and rows(by_sheet) == rows(whole)


def test_damaged_sheet_and_file(spark, tmp_path):
    write_xlsx(tmp_path / "a.xlsx", SHEETS)
    with zipfile.ZipFile(tmp_path / "a.xlsx") as src, zipfile.ZipFile(tmp_path / "d.xlsx", "w") as dst:
        for item in src.infolist():
            data = src.read(item)
            dst.writestr(item, data[: len(data) // 2] if item.filename.endswith("sheet2.xml") else data)
    (tmp_path / "n.xlsx").write_bytes(b"not a zip")
    cells = read_sheets(spark, str(tmp_path))
    errors = [(r.source_file, r.sheet_name) for r in cells.filter("error IS NOT NULL").collect()]
    assert sorted(errors, key=repr) == sorted([("d.xlsx", "second"), ("n.xlsx", None)], key=repr)
    good = lambda name: rows(cells.filter(f"source_file = '{name}' AND sheet_name <> 'second' AND error IS NULL")
                             .drop("source_file"))
    assert good("d.xlsx") == good("a.xlsx") and good("a.xlsx")


def test_writer_round_trip_and_empty_tasks(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"t<{i}>&\x01", "x" * (i % 3)) for i in range(250)],
                               "id long, text string, other string").repartition(3)
    written = write_workbooks(df.union(df.limit(0)), str(tmp_path / "w"), rows_per_sheet=40).collect()
    assert 0 < len(written) <= 3 and sum(r.sheets for r in written) >= 7
    cells = read_sheets(spark, str(tmp_path / "w")).filter("row_pos > 0 AND error IS NULL")
    back = {}
    for r in cells.collect():
        back.setdefault((r.source_file, r.sheet_pos, r.row_pos), {})[r.header] = r.value
    got = sorted((int(v["id"]), v.get("text"), v.get("other")) for v in back.values())
    want = sorted((i, t.replace("\x01", "�") if t else t, o or ("" if o == "" else None))
                  for i, t, o in df.collect())
    assert got == want
    assert write_workbooks(spark.createDataFrame([], "a string"), str(tmp_path / "e")).collect() == []


def test_many_small_sheets_share_tasks(spark, tmp_path):
    sheets = {f"s{i}": [["id", "text"], *[[f"{i}-{r}", f"t{r}"] for r in range(3)]] for i in range(60)}
    write_xlsx(tmp_path / "a.xlsx", sheets)
    write_xlsx(tmp_path / "b.xlsx", sheets)
    (tmp_path / "n.xlsx").write_bytes(b"not a zip")
    cells = read_sheets(spark, str(tmp_path))
    assert cells.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 1
    whole = workbook.read_cells(spark, f"file://{tmp_path}/a.xlsx", f"file://{tmp_path}/b.xlsx")
    assert rows(cells.filter("error IS NULL")) == rows(whole)
    assert [r.source_file for r in cells.filter("error IS NOT NULL").collect()] == ["n.xlsx"]


def test_damaged_sheet_among_packed_ones(spark, tmp_path):
    sheets = {f"s{i}": [["k"], [f"v{i}"]] for i in range(60)}
    write_xlsx(tmp_path / "a.xlsx", sheets)
    with zipfile.ZipFile(tmp_path / "a.xlsx") as src, zipfile.ZipFile(tmp_path / "d.xlsx", "w") as dst:
        for item in src.infolist():
            data = src.read(item)
            dst.writestr(item, data[: len(data) // 2] if item.filename.endswith("sheet7.xml") else data)
    (tmp_path / "a.xlsx").unlink()
    cells = read_sheets(spark, str(tmp_path))
    assert cells.rdd.getNumPartitions() < 60
    bad = [r.sheet_name for r in cells.filter("error IS NOT NULL").collect()]
    good = {r.sheet_name for r in cells.filter("error IS NULL AND row_pos > 0").collect()}
    assert len(bad) == 1 and good == set(sheets) - set(bad)
