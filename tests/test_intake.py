import json

from check import compare, connect
from tableprobe.queries import QUERIES, intake
from tableprobe.sources.csv import read_csv
from tests.conftest import SMALL


def test_quotes_of_both_styles(spark, tmp_path):
    """One folder with doubled quotes, quotes behind backslashes, and a field that ends with a backslash."""
    rows = [(1, 'say "hi" now'), (2, 'plain'), (3, 'two\nlines "x" here'), (4, '"all"')]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    for kind, escape in (("doubled", '"'), ("behind", "\\")):
        df.write.option("header", True).option("escape", escape).option("quoteAll", True).csv(str(tmp_path / kind))
    (tmp_path / "path").mkdir()
    (tmp_path / "path" / "a.csv").write_text('id,text\n"5","C:\\"\n"6","a ""b"" c"\n')
    got = read_csv(spark, f"{tmp_path}/*")
    assert sorted(map(tuple, got.collect())) == sorted([*rows, *rows, (5, "C:\\"), (6, 'a "b" c')])


def test_file_charsets_with_quotes_in_texts(spark):
    folder = "/root/testdata/sf0.01"
    status, detail = compare(spark, connect(folder), "file_charsets", folder)
    assert status == "match", detail


def test_json_lists_have_bounded_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(intake, "LIST_ROWS", 40, raising=False)
    monkeypatch.setattr(intake, "scratch", lambda _: str(tmp_path / "json"))
    got = QUERIES["json_of_both_kinds"](spark, SMALL).select("event_id").collect()
    ids = [r.event_id for r in spark.read.parquet(f"{SMALL}/events.parquet").select("event_id").collect()]
    assert sorted(r.event_id for r in got) == sorted(ids)
    texts = [p.read_text() for p in (tmp_path / "json").glob("list*/part-*")]
    lists = [json.loads(text) for text in texts if text]
    assert sum(map(len, lists)) == sum(i % 2 for i in ids)
    assert len(lists) > 2 and max(map(len, lists)) <= 80
