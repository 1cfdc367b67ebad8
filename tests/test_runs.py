import csv
from pathlib import Path

import numpy as np
import pytest

from tests.xlsx import write_xlsx
from voxtally.plans import survey_run, two_step
from voxtally.sources import csv_folder, vocabulary, workbook
from voxtally.streaming.enrich import enrich_stream


def put(path: Path, rows) -> None:
    with path.open("w", newline="") as f:
        csv.writer(f).writerows(rows)


@pytest.fixture()
def folder(tmp_path):
    put(tmp_path / "b survey+1.CSV", [["Why?", "Sheet Name", "How?", "Why?"],
                                      ["good data\nwork, really", "s", "", "NA"],
                                      [" ", "s", 'say "hi"', " dup "]])
    put(tmp_path / "a.csv", [["How?"], ["data science helps"], ["nan"]])
    put(tmp_path / "processed_old.csv", [["How?"], ["skip me"]])
    put(tmp_path / "keywords.csv", [["Data Science (DS), AI; ai, jobs etc.", "Career"], ["data??", ""]])
    (tmp_path / "sub.csv").mkdir()
    write_xlsx(tmp_path / "c.xlsx", {
        "Main": [["Rating", "When", None], [5, ("date", 45292.5), "inline:free & text"], [4.5, None, True]],
        "Keywords": [["x"], ["not read"]],
    })
    write_xlsx(tmp_path / "d.xlsx", {"keywords": [["Topic A, data; DATA"], ["work"]]})
    (tmp_path / "e.xlsx").write_bytes(b"broken")
    return str(tmp_path)


def test_csv_scan(spark, folder):
    cells = csv_folder.scan_csv_long(spark, folder, exclude=[f"file:{folder}/keywords.csv"])
    got = [tuple(r) for r in cells.orderBy(*csv_folder.POSITION).select(
        "source_file", "sheet_name", "question_text", "response_text").collect()]
    assert got == [
        ("a.csv", "a", "How?", "data science helps"),
        ("b survey+1.CSV", "b survey+1", "Why?", "good data\nwork, really"),
        ("b survey+1.CSV", "b survey+1", "How?", 'say "hi"'),
        ("b survey+1.CSV", "b survey+1", "Why?.1", "dup")]


def test_headers_that_differ_by_case(spark, tmp_path):
    put(tmp_path / "a.csv", [["Why?", "why?", "sheet_name"], ["x", "y", "z"]])
    put(tmp_path / "b.csv", [["Sheet  name"], ["only provenance"]])
    cells = csv_folder.scan_csv_long(spark, str(tmp_path))
    assert sorted((r["question_text"], r["response_text"]) for r in cells.collect()) == [("Why?", "x"), ("why?", "y")]
    wide = csv_folder.load_wide(spark, str(tmp_path))
    assert wide[0].columns == ["Why?", "why?.1", "sheet_name"]


def test_nothing_to_read(spark, tmp_path):
    with pytest.raises(ValueError):
        survey_run.run(spark, str(tmp_path))
    put(tmp_path / "a.csv", [["Q"], [" "], ["NA"]])
    with pytest.raises(ValueError):
        survey_run.run(spark, str(tmp_path))


def test_workbook(spark, folder):
    cells = workbook.scan_workbooks(spark, folder)
    main = cells.filter("sheet_name = 'Main' and row_pos > 0").orderBy("row_pos", "col_pos")
    assert [(r["header"], r["value"]) for r in main.collect()] == [
        ("Rating", "5"), ("When", "2024-01-01 12:00:00"), ("Unnamed: 2", "free & text"),
        ("Rating", "4.5"), ("Unnamed: 2", "True")]
    broken = cells.filter("error is not null").collect()
    assert [r["source_file"] for r in broken] == ["e.xlsx"]
    with pytest.raises(ValueError):
        workbook.column_values(cells, "Main", 9)


def test_vocabulary(spark, folder):
    vocab, path = vocabulary.find_vocabulary(spark, folder)
    assert path.endswith("keywords.csv")
    got = [(r["keyword"], r["category"]) for r in vocab.orderBy("pos").collect()]
    assert got == [("Data Science", "Career"), ("AI", "Career"), ("jobs", "Career"), ("data", None)]
    book, path = vocabulary.find_vocabulary(spark, folder, f"{folder}/d.xlsx")
    assert [r["keyword"] for r in book.orderBy("pos").collect()] == ["Topic A", "data", "work"]
    assert vocabulary.provided_topics(spark, f"{folder}/missing.xlsx").count() == 0
    assert vocabulary.provided_topics(spark, f"{folder}/c.xlsx").count() == 0


def test_vocabulary_from_first_workbook(spark, tmp_path):
    put(tmp_path / "s.csv", [["Q"], ["x"]])
    write_xlsx(tmp_path / "a.xlsx", {"Main": [["Q"], ["y"]]})
    write_xlsx(tmp_path / "b.xlsx", {"keywords": [["one; two"]]})
    vocab, path = vocabulary.find_vocabulary(spark, str(tmp_path))
    assert path.endswith("b.xlsx") and vocab.count() == 2
    assert [r["keyword"] for r in vocabulary.provided_topics(spark, path).orderBy("pos").collect()] == ["one", "two"]


def test_whole_run(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    settings = survey_run.Settings(topics_file=f"{folder}/d.xlsx", single_file=True)
    result = survey_run.run(spark, folder, out, settings)
    responses = result.responses.orderBy("response_id").collect()
    assert [r["response_id"] for r in responses] == list(range(1, len(responses) + 1))
    assert result.responses.columns == list(survey_run.FEATURE_COLUMNS)
    assert [r["source_file"] for r in responses] == ["a.csv"] + ["b survey+1.CSV"] * 3 + ["c.xlsx"] * 5 + ["d.xlsx"] * 0
    first = responses[0]
    assert first["topics"] == "data" and "data science" in first["keywords"] and first["theme"] == first["keywords"]
    assert responses[0]["question_id"] == 1 and responses[1]["question_id"] == 2 and responses[2]["question_id"] == 1
    back = spark.read.option("header", True).csv(result.paths["topics"])
    assert back.columns == ["data", "work"]
    assert result.summary.count() >= 5
    instances = result.keywords.count()
    assert instances == spark.read.option("header", True).option("multiLine", True).csv(result.paths["keywords"]).count()
    again = survey_run.run(spark, folder, out, settings)
    assert sorted(map(str, again.responses.collect())) == sorted(map(str, responses))


def test_only_the_vocabulary_itself_is_skipped(spark, tmp_path):
    (tmp_path / "other").mkdir()
    (tmp_path / "in").mkdir()
    put(tmp_path / "other" / "x.csv", [["data, work", "c"]])
    put(tmp_path / "in" / "x.csv", [["Q"], ["from x"]])
    put(tmp_path / "in" / "y.csv", [["Q"], ["from y"]])
    (tmp_path / "in" / "bad.xlsx").write_bytes(b"broken")
    settings = survey_run.Settings(vocabulary_file=str(tmp_path / "other" / "x.csv"))
    result = survey_run.run(spark, str(tmp_path / "in"), settings=settings)
    assert sorted(r["source_file"] for r in result.responses.collect()) == ["x.csv", "y.csv"]
    assert sorted(f.rsplit("/", 1)[-1] for f, _ in result.failed) == ["bad.xlsx"]
    put(tmp_path / "in" / "keywords.csv", [["Q"], ["data"]])
    for skip, files in ((True, ["x.csv", "y.csv"]), (False, ["keywords.csv", "x.csv", "y.csv"])):
        result = survey_run.run(spark, str(tmp_path / "in"), settings=survey_run.Settings(skip_vocabulary=skip))
        assert sorted(r["source_file"] for r in result.responses.collect()) == files


def test_more_topics_than_can_be_inlined(spark, folder, monkeypatch):
    few = survey_run.run(spark, folder, settings=survey_run.Settings(topics_file=f"{folder}/d.xlsx"))
    want = {(c, r["row_no"], int(r[c])) for r in few.topics.collect() for c in few.topics.columns
            if c != "row_no" and r[c]}
    monkeypatch.setattr(vocabulary, "bounded_rows", lambda df: None)
    many = survey_run.run(spark, folder, settings=survey_run.Settings(topics_file=f"{folder}/d.xlsx"))
    assert many.topic_names is None and {tuple(r) for r in many.topics.select("topic", "row_no", "response_id").collect()} == want
    assert sorted(map(str, many.responses.collect())) == sorted(map(str, few.responses.collect()))


def test_similarity_in_run(spark, folder):
    def load():
        return lambda texts: np.array([[1.0, 0.0] if "data" in t.lower() else [0.0, 1.0] for t in texts])
    long = survey_run.ingest(spark, folder, [f"file:{folder}/keywords.csv"])
    vocab = spark.createDataFrame([(1, "Data", "data", None)], vocabulary.VOCABULARY_SCHEMA)
    settings = survey_run.Settings(encoder=load)
    df = survey_run.enrich(long, settings, vocab, ["the"])
    bags = {r["response_text_original"]: [k["keyword"] for k in r["keywords"]] for r in df.collect()}
    assert bags["data science helps"] == ["data science helps", "data"]
    assert bags["dup"] == []


def test_wide_workbook(spark, folder):
    tables = workbook.load_wide(spark, folder)
    assert [t.columns for t in tables] == [["sheet_name", "Rating", "When", "Unnamed: 2"],
                                           ["sheet_name", "x"]]
    assert [tuple(r) for r in tables[0].orderBy("Rating").collect()] == [
        ("Main", "4.5", None, "True"), ("Main", "5", "2024-01-01 12:00:00", "free & text")]


def test_two_step(spark, tmp_path, tmp_path_factory):
    write_xlsx(tmp_path / "w.xlsx", {"S": [["Q", "z"], ["Sheet words", 1]]})
    put(tmp_path / "one.csv", [["Q", "n"], ["The Big Data!", "5"], ["Jobs", "6"]])
    put(tmp_path / "two.csv", [["Q", "other"], ["more jobs", ""]])
    out = str(tmp_path_factory.mktemp("two"))
    paths = two_step.run_two_step(spark, str(tmp_path), out, ["the"])
    got = {r["Q"]: r["keywords"] for r in csv_folder.read_table(spark, paths["with_keywords"]).collect()}
    assert got == {"big data": "big data", "jobs": "jobs", "more jobs": "more jobs",
                   "sheet words": "sheet words"}
    with pytest.raises(Exception):
        csv_folder.read_table(spark, f"{out}/none.csv").count()


def test_stream(spark, tmp_path, tmp_path_factory):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "Q?", "good data work"), (2, "Q?", "bad")],
                          "response_id int, question_text string, response_text string").write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = enrich_stream(spark.readStream.schema(schema).parquet(source), ["the"], ["data"], ["Work"])
    query = (stream.writeStream.format("memory").queryName("enriched_stream")
             .option("checkpointLocation", str(tmp_path_factory.mktemp("cp"))).start())
    query.processAllAvailable()
    query.stop()
    batch = enrich_stream(spark.read.parquet(source), ["the"], ["data"], ["Work"])
    streamed = spark.table("enriched_stream")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    assert streamed.filter("response_id = 1").first()["topics"] == ["Work"]
