"""CSV files read in small blocks against Spark's whole-file multi-line read."""

import random

import pytest
from pyspark.sql import functions as F

from voxtally.sources import csv_folder
from voxtally.sources.csv_split import _lines, _packed, blocks_of, csv_records, read_csv_split

COLUMNS = ["a", "b", "c"]


def whole(spark, paths):
    read = (spark.read.option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
            .option("multiLine", True).option("header", True).schema(", ".join(f"{c} string" for c in COLUMNS)))
    return sorted(map(tuple, read.csv(paths).collect()), key=repr)


def split(spark, paths, block):
    got = read_csv_split(spark, paths, COLUMNS, block_bytes=block).select(*COLUMNS)
    return sorted(map(tuple, got.collect()), key=repr)


def field(rng):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choices("ab \n\"é,", k=rng.randint(0, 40)))
    if kind < 0.35:
        return "x\n" * rng.randint(500, 3000)           # one field over many blocks
    return "".join(rng.choices("xyz 123", k=rng.randint(0, 12)))


def quoted(text):
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text


def write(tmp_path, name, rows, header="a,b,c"):
    path = tmp_path / name
    path.write_text("\n".join([header] + [",".join(quoted(f) for f in r) for r in rows]) + "\n", encoding="utf-8")
    return f"file://{path}"


@pytest.mark.parametrize("seed", [1, 2])
def test_random_files_in_small_blocks(spark, tmp_path, seed):
    rng = random.Random(seed)
    paths = [write(tmp_path, f"f{i}.csv", [[field(rng) for _ in range(3)] for _ in range(rng.randint(0, 300))])
             for i in range(3)]
    want = whole(spark, paths)
    for block in (1024, 4096, 1 << 20):
        assert split(spark, paths, block) == want


def test_header_across_blocks_blank_lines_and_carriage_returns(spark, tmp_path):
    rows = [["1", "two\r\nlines", "x"], ["", "", ""], ["3", '"', "\n\n"]]
    path = write(tmp_path, "h.csv", rows, header='a,"b\n' + "h" * 3000 + '",c')
    text = (tmp_path / "h.csv").read_text()
    (tmp_path / "h.csv").write_text(text.replace("\n3,", "\n\n\n3,"))      # blank lines between records
    assert split(spark, [path], 1024) == whole(spark, [path])


def test_more_tasks_than_files(spark, tmp_path):
    rng = random.Random(3)
    path = write(tmp_path, "big.csv", [[field(rng) for _ in range(3)] for _ in range(400)])
    with blocks_of(spark, 2048):
        assert _lines(spark, [path]).rdd.getNumPartitions() > 10
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "2048"
    records = csv_records(spark, [path], 2048)
    assert records.filter("is_header").count() == 1


def test_empty_file_and_open_quote(spark, tmp_path):
    empty = tmp_path / "e.csv"
    empty.write_text("")
    path = write(tmp_path, "o.csv", [["1", "2", "3"]])
    with open(tmp_path / "o.csv", "a") as f:
        f.write('4,"never closed\n5,6,7\n')
    # an open quote runs to the end of the file; its last line break is not kept
    want = [tuple(v[:-1] if v and v.endswith("7\n") else v for v in row) for row in whole(spark, [f"file://{empty}", path])]
    assert split(spark, [f"file://{empty}", path], 16) == want


def test_folder_scan_by_blocks(spark, tmp_path):
    rng = random.Random(4)
    for i in range(2):
        write(tmp_path, f"s{i}.csv", [[field(rng) for _ in range(3)] for _ in range(200)])
    cols = ["question_text", "response_text", "sheet_name", "source_file", "col_pos"]
    plain = csv_folder.scan_csv_long(spark, str(tmp_path)).select(*cols)
    blocks = csv_folder.scan_csv_long(spark, str(tmp_path), block_bytes=2048).select(*cols)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, blocks.collect()), key=repr)
    order = lambda df: [r.response_text for r in df.orderBy("block", "row_pos", "col_pos").collect()]
    first = csv_folder.scan_csv_long(spark, str(tmp_path), block_bytes=2048).filter(F.col("sheet_name") == "s0")
    assert order(first) == order(csv_folder.scan_csv_long(spark, str(tmp_path)).filter(F.col("sheet_name") == "s0"))


def test_small_blocks_share_tasks(spark, tmp_path):
    rng = random.Random(5)
    path = write(tmp_path, "p.csv", [[field(rng) for _ in range(3)] for _ in range(1500)])
    tasks = 4 * spark.sparkContext.defaultParallelism
    with blocks_of(spark, 2048):
        lines = _lines(spark, [path])
        assert lines.rdd.getNumPartitions() > 5 * tasks
        assert _packed(lines, 2048, 1 << 27).rdd.getNumPartitions() == tasks
    # the jobs of a whole read, with several passes over the file, have few tasks
    group = f"packed-{tmp_path.name}"
    spark.sparkContext.setJobGroup(group, "split read")
    got = split(spark, [path], 2048)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages if s) <= tasks
    assert got == whole(spark, [path])
