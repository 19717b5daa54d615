import pytest

from textloom.operators import rowparse
from textloom.operators.rowparse import assemble, parse_row, spec_of

CSV = spec_of("id:int,score:float,day:date,text:string")


@pytest.mark.parametrize(
    "raw,want",
    [
        ("1,2.5,2024-02-29,hello", None),
        ('"1","","","a ""quoted"" one, with comma\nand line"', None),
        ("1,,,x", None),
        ('1,2,2024-01-01,"open', "broken"),
        ('1,2,2024-01-01,"a"b', "broken"),
        ("1,2,2024-01-01", "wrong_shape"),
        ("1,2,2024-01-01,x,y", "wrong_shape"),
        ("", "wrong_shape"),
        (",2,2024-01-01,x", "bad_value"),
        ("1,2,2024-01-01,", "bad_value"),
        ("9223372036854775808,2,2024-01-01,x", "bad_value"),
        ("1,2,2023-02-29,x", "bad_value"),
        ("1,2,2024-1-01,x", "bad_value"),
        ("1,4;5,2024-01-01,x", "bad_value"),
        ("0x1,2,2024-01-01,x", "bad_value"),
        (None, "broken"),
    ],
)
def test_csv(raw, want):
    assert parse_row(raw, "csv", ",", CSV, "text")[0] == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"id": 1, "score": 2, "day": "2024-01-31", "text": "x", "more": []}', None),
        ('{"id": 1, "score": null, "day": null, "text": "x"}', None),
        ("{'id': 1}", "broken"),
        ('{"id": NaN, "score": 1, "day": null, "text": "x"}', "broken"),
        ("[1]", "wrong_shape"),
        ('{"id": 1, "score": 2, "text": "x"}', "wrong_shape"),
        ('{"id": true, "score": 2, "day": null, "text": "x"}', "bad_value"),
        ('{"id": 1.0, "score": 2, "day": null, "text": "x"}', "bad_value"),
        ('{"id": 1, "score": "2", "day": null, "text": "x"}', "bad_value"),
        ('{"id": null, "score": 2, "day": null, "text": "x"}', "bad_value"),
        ('{"id": 1, "score": 2, "day": null, "text": null}', "bad_value"),
    ],
)
def test_json(raw, want):
    assert parse_row(raw, "jsonl", None, CSV, "text")[0] == want


def test_assemble():
    assert list(assemble(['1,"a', 'b"', "2,c", '3,"d""', 'e"', '4,"open'])) == ['1,"a\nb"', "2,c", '3,"d""\ne"', '4,"open']


def test_assembling_is_linear_and_quote_aware():
    many = ['1,"a'] + ["x,y"] * 200_000 + ['end",2']
    assert [r.count("\n") for r in assemble(many)] == [200_001]
    assert list(assemble(['a"b,c', '"x""', 'y",z'])) == ['a"b,c', '"x""\ny",z']
    assert list(assemble(['in",1', "2,b"], quoted=True)) == ['in",1', "2,b"]


def test_csv_file_with_line_breaks_over_partitions(spark, tmp_path):
    path = tmp_path / "a.csv"
    rows = [f'{k},"cell {k}\nwith ""quotes"", lines\n\nand more"' if k % 3 else f"{k},plain {k}" for k in range(1, 3001)]
    path.write_text("\n".join([*rows, '3001,"' + "long\n" * 5000 + '"', "x,bad", '3003,"open', "to the end"]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        raw = rowparse.csv_rows(spark, str(path), "in").cache()
        inputs = spark.createDataFrame([("in", "csv", ",", "id:int,text:string", "text")], "input_path string, input_format string, delimiter string, column_spec string, text_field string")
        assert [r.raw for r in raw.orderBy("row_id").collect()][:3000] == rows
        sound = {r.id: r.text for r in rowparse.loaded(raw, inputs, "id:int,text:string").collect()}
        assert len(sound) == 3001 and sound[3001] == "long\n" * 5000 and sound[4] == 'cell 4\nwith "quotes", lines\n\nand more'
        assert sorted(r.reason for r in rowparse.failures(raw, inputs).collect()) == ["bad_value", "broken"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tables(spark):
    inputs = spark.createDataFrame([("a", "csv", ",", "id:int,text:string", "text"), ("b", "jsonl", None, "id:int,day:date", "text")], "input_path string, input_format string, delimiter string, column_spec string, text_field string")
    rows = [(1, "a", "1,x"), (2, "a", "1,x"), (3, "a", '1,"x'), (4, "b", '{"id": 5, "day": "2024-05-06"}'), (5, "none", "1,x"), (6, None, None)]
    raw = spark.createDataFrame(rows, "row_id long, input_path string, raw string")
    assert {r.row_id: r.reason for r in rowparse.failures(raw, inputs).collect()} == {3: "broken", 5: "wrong_shape", 6: "broken"}
    day = rowparse.loaded(raw, inputs, "id:int,day:date").collect()
    assert [(r.row_id, r.id, str(r.day)) for r in day if r.id is not None] == [(4, 5, "2024-05-06")]
    assert rowparse.failures(raw.limit(0), inputs).count() == 0
