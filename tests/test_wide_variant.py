"""Wide loads through VARIANT rows against the per-file load."""

from functools import reduce

from pyspark.sql import DataFrame

from voxtally.sources import csv_folder
from voxtally.sources.wide_variant import load_wide_variant


def test_equal_to_per_file_tables(spark, tmp_path):
    files = {
        "a.csv": 'id,Text,,x y\n1,"one\nline",blank,p\n2,,,q\n',
        "b.csv": 'id,text,lang,x y,text\n3,three,en,r,again\n4,"say ""hi""",fr,,\n',
        "c.csv": "id,only\n",
        "d.csv": "id,a.b,q'uote\n5,6,7,8\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    paths = csv_folder.list_files(spark, str(tmp_path), "csv")
    got = load_wide_variant(spark, paths, block_bytes=16)
    per_file = csv_folder.load_wide(spark, str(tmp_path))
    want = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), per_file)
    assert got.columns[:-2] == ["id", "Text", "Unnamed: 2", "x y", "lang", "text.1", "only", "a.b", "q'uote"]
    cols = [c for c in got.columns if c != "row"]
    quoted = [f"`{c}`" for c in cols]
    # the per-file tables give empty cells as empty text, this load as NULL
    norm = lambda df: sorted((tuple(v or None for v in r) for r in df.select(*quoted).collect()), key=repr)
    assert norm(got) == norm(want)
    assert got.filter("id = '5'").first()["q'uote"] == "7"


def test_plan_does_not_grow_with_files(spark, tmp_path):
    def plan_size(n):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"f{i}.csv").write_text(f"k,v{i % 3}\n{i},x\n")
        df: DataFrame = load_wide_variant(spark, csv_folder.list_files(spark, str(folder), "csv"))
        assert df.count() == n
        return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert plan_size(40) == plan_size(5)
