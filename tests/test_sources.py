import io

import pandas as pd
import pytest
from pyspark.errors import AnalysisException

from corpusmith.sources.readers import as_dataframe, assert_unique, read_corpus, with_row_key
from corpusmith.sources.sinks import append_corpus, write_corpus, write_unquoted
from corpusmith.sources.staging import shared_dir, stage

CSV = (
    "ID,text,target\n"
    'a1,"say ""hi"", now",0\n'
    'a2,"two\nlines",1\n'
    "a3,NA,2\n"
    "a4,,3\n"
    "a5,plain,\n"
    "a6,None,6\n"
)


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "train.csv"
    path.write_text(CSV, encoding="utf-8")
    return str(path)


def test_reader_agrees_with_pandas(spark, csv_file):
    got = read_corpus(spark, csv_file).orderBy("ID").collect()
    expected = pd.read_csv(io.StringIO(CSV))
    for row, (_, want) in zip(got, expected.iterrows()):
        assert row.ID == want.ID
        assert row.text == (None if pd.isna(want.text) else want.text)
        assert row.target == (None if pd.isna(want.target) else int(want.target))


def test_reader_errors(spark, tmp_path, csv_file):
    bad = tmp_path / "bad.csv"
    bad.write_text("ID,body\n1,x\n", encoding="utf-8")
    with pytest.raises(ValueError, match="text"):
        read_corpus(spark, str(bad))
    with pytest.raises(AnalysisException):
        read_corpus(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(ValueError, match="differ"):
        read_corpus(spark, [csv_file, str(bad)])


def test_several_files_and_bom(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"g{i}.csv").write_text(f"text,target\nt{i},{i}\n", encoding="utf-8-sig")
    paths = [str(tmp_path / f"g{i}.csv") for i in range(3)]
    rows = read_corpus(spark, paths).orderBy("target").collect()
    assert [(r.text, r.target) for r in rows] == [("t0", 0), ("t1", 1), ("t2", 2)]


def test_path_or_frame(spark, csv_file):
    df = as_dataframe(spark, csv_file)
    assert as_dataframe(spark, df) is df
    assert as_dataframe(spark, 5) == 5
    with pytest.raises(ValueError):
        as_dataframe(spark, 5, strict=True)


def test_round_trips(spark, csv_file, tmp_path):
    df = with_row_key(read_corpus(spark, csv_file))
    expected = sorted(map(str, df.select("ID", "text", "target").collect()))
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        write_corpus(df, path, fmt=fmt)
        back = read_corpus(spark, path) if fmt == "csv" else spark.read.parquet(path)
        assert sorted(map(str, back.collect())) == expected


def test_append_has_no_header_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(3):
        append_corpus(spark.createDataFrame([(f"t{i}", i)], "text string, target int"), path)
    rows = read_corpus(spark, path).collect()
    assert sorted((r.text, r.target) for r in rows) == [("t0", 0), ("t1", 1), ("t2", 2)]


def test_unquoted_sink(spark, tmp_path):
    path = str(tmp_path / "plain")
    write_unquoted(
        spark.createDataFrame([("i", 'a,b\\c"d\ne', 1)], "ID string, text string, target int"), path
    )
    text = "".join(p.read_text() for p in (tmp_path / "plain").glob("part-*"))
    assert text == 'ID,text,target\ni,a\\,b\\\\c\\"d\\\ne,1\n'


def test_unquoted_folder_reads_back(spark, tmp_path):
    path = str(tmp_path / "many")
    rows = [(f"i{i}", f"plain {i}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "ID string, text string, target int").repartition(3)
    write_unquoted(df, path)
    assert sorted(map(tuple, read_corpus(spark, path).collect())) == sorted(rows)


def test_columns_are_found_by_name_in_every_file(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("ID,text,target\n1,one,1\n")
    (folder / "b.csv").write_text("text,ID,target\ntwo,2,2\n")
    (folder / "c.csv").write_text("text,ID\nthree,3\n")
    rows = sorted(map(tuple, read_corpus(spark, str(folder)).select("ID", "text", "target").collect()))
    assert rows == [("1", "one", 1), ("2", "two", 2), ("3", "three", None)]


def test_quoted_header_with_comma(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('"ID","a, b",text,target\n1,x,yes,2\n')
    assert [tuple(r) for r in read_corpus(spark, str(path)).collect()] == [("1", "yes", 2)]


def test_unique_keys(spark):
    df = spark.createDataFrame([("a",), ("b",)], "row_key string")
    assert assert_unique(df) is df
    with pytest.raises(ValueError, match="not unique"):
        assert_unique(df.unionAll(df))


def test_staging_uses_the_checkpoint_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == folder
    df = stage(spark.range(5).withColumnRenamed("id", "x"), "numbers")
    assert df.columns == ["x"] and df.count() == 5
    assert all(folder in f for f in df.inputFiles())


def test_csv_keeps_spaces_at_the_ends(spark, tmp_path):
    texts = ["  a", "b\t ", " c, \n d "]
    rows = [(str(i), text, i) for i, text in enumerate(texts)]
    path = str(tmp_path / "spaces")
    write_corpus(spark.createDataFrame(rows, "ID string, text string, target int"), path, fmt="csv")
    assert sorted(tuple(r) for r in read_corpus(spark, path).collect()) == rows
