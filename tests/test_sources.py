"""Files, databases (options only; no database is started) and incremental loads."""

import zipfile

import pytest
from pyspark.sql import DataFrame, functions as F

from gridsmith.sources import sql
from gridsmith.sources.csv import read_csv, read_csv_many, write_csv
from gridsmith.sources.datasets import write_datasets
from gridsmith.sources.excel import read_excel, read_excel_many
from gridsmith.sources.incremental import last_key, read_incremental, source_name
from gridsmith.sources.xml import read_xml

EDGE_CSV = 'a,b,c\n1,2,3\n1,2,3,4\n1,2\nNA,null,x\n\n"q""q","multi\nline",z\n'


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_edges(spark, tmp_path, rows):
    df = read_csv(spark, write(tmp_path / "edge.csv", EDGE_CSV))
    assert df.dtypes == [("a", "string"), ("b", "string"), ("c", "string")]
    assert set(rows(df)) == {("1", "2", "3"), ("1", "2", None), (None, None, "x"), ('q"q', "multi\nline", "z")}


def test_csv_without_open_quotes_is_split_by_lines(spark, tmp_path):
    path = write(tmp_path / "plain.csv", 'a,b\n"x, y",1\n"say ""hi""",2\n')
    assert [tuple(r) for r in read_csv(spark, path).collect()] == [("x, y", "1"), ('say "hi"', "2")]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_csv_encodings(spark, tmp_path, encoding):
    path = write(tmp_path / "names.csv", "name,city\nJosé,Köln\nAnn,Bonn\n", encoding)
    df = read_csv(spark, path)
    assert df.columns == ["name", "city"] and df.where("name = 'José' and city = 'Köln'").count() == 1


def test_csv_without_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        read_csv(spark, write(tmp_path / "empty.csv", "a,b\n"))


def test_many_csv_files(spark, tmp_path):
    paths = [write(tmp_path / f"t{i}.csv", f"a\n{i}\n") for i in range(2)]
    found = read_csv_many(spark, paths)
    assert {k: v.first()["a"] for k, v in found.items()} == {"t0": "0", "t1": "1"}
    together = read_csv(spark, paths, source_file=True)
    assert sorted(r["source_file"].rsplit("/")[-1] for r in together.collect()) == ["t0.csv", "t1.csv"]


def test_csv_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("a,b", 'q"q', None), ("x", "y", "z")], "s string, t string, u string")
    write_csv(df, str(tmp_path / "out"))
    back = read_csv(spark, str(tmp_path / "out"))
    assert back.columns == ["s", "t", "u"] and rows(back) == rows(df)


def test_datasets(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    write_datasets({"raw": df, "cleaned": df.dropna()}, str(tmp_path / "parquet"))
    assert rows(spark.read.parquet(str(tmp_path / "parquet" / "raw"))) == rows(df)
    assert spark.read.parquet(str(tmp_path / "parquet" / "cleaned")).count() == 1
    write_datasets({"ml_ready": df}, str(tmp_path / "csv"), "csv")
    assert read_csv(spark, str(tmp_path / "csv" / "ml_ready")).count() == 2
    with pytest.raises(ValueError):
        write_datasets({"raw": df}, str(tmp_path), "xlsx")


def test_xml(spark, tmp_path, rows):
    path = write(tmp_path / "rows.xml", "<t><row><a>1</a><b>x</b></row><row><a>2</a></row></t>")
    assert rows(read_xml(spark, path, "row").select("a", "b")) == [("1", "x"), ("2", None)]


def workbook(path, sheets):
    """A minimal workbook: shared strings, numbers and inline strings."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shared = []
    with zipfile.ZipFile(path, "w") as book:
        listed, relations = "", ""
        for n, (name, table) in enumerate(sheets.items(), 1):
            listed += f'<sheet name="{name}" sheetId="{n}" r:id="rId{n}"/>'
            relations += f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml" Type="t"/>'
            body = ""
            for i, row in enumerate(table, 1):
                cells = ""
                for j, value in enumerate(row):
                    at = f"{chr(65 + j)}{i}"
                    if isinstance(value, str) and value.startswith("="):
                        cells += f'<c r="{at}" t="inlineStr"><is><t>{value[1:]}</t></is></c>'
                    elif isinstance(value, str):
                        shared.append(value)
                        cells += f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'
                    elif value is not None:
                        cells += f'<c r="{at}"><v>{value}</v></c>'
                body += f'<row r="{i}">{cells}</row>'
            book.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        book.writestr("xl/workbook.xml", f"<workbook {main} {rel}><sheets>{listed}</sheets></workbook>")
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{relations}</Relationships>',
        )
        strings = "".join(f"<si><t>{s}</t></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>{strings}</sst>")
    return str(path)


def test_excel(spark, tmp_path, rows):
    folder = tmp_path / "books"
    folder.mkdir()
    one = workbook(folder / "one.xlsx", {"First": [["id", "name"], [1, "Ann"], [2, "=Bob"], [3, None]], "Second": [["x"], [9.5]]})
    workbook(folder / "two.xlsx", {"First": [["name", "id"], ["NA", 4]]})
    df = read_excel(spark, str(folder))
    assert rows(df.select("id", "name")) == [("1", "Ann"), ("2", "Bob"), ("3", None), ("4", None)]
    assert rows(read_excel(spark, one, "Second")) == [("9.5",)] == rows(read_excel(spark, one, 1))
    assert read_excel_many(spark, [one])["one"].count() == 3
    assert read_excel(spark, str(folder), source_file=True).select("source_file").distinct().count() == 2


class FakeJdbc:
    """Stands in for the reader or writer and records the options."""

    def __init__(self):
        self.seen = {}

    def format(self, name):
        self.seen["format"] = name
        return self

    def options(self, **options):
        self.seen.update(options)
        return self

    def mode(self, mode):
        self.seen["mode"] = mode
        return self

    def load(self):
        return self.seen

    save = load


class FakeSession:
    @property
    def read(self):
        return FakeJdbc()


def test_jdbc_options():
    found = sql.read_sql_table(FakeSession(), "jdbc:x:y", "t", {"user": "u"}, "id", (0, 100), 4)
    assert found == {
        "format": "jdbc", "url": "jdbc:x:y", "dbtable": "t", "user": "u", "partitionColumn": "id", "lowerBound": "0",
        "upperBound": "100", "numPartitions": 4,
    }
    with pytest.raises(ValueError):
        sql.read_sql_table(FakeSession(), "jdbc:x:y", "t", partition_column="id")
    assert sql.read_sql_query(FakeSession(), "jdbc:x:y", "select 1")["query"] == "select 1"
    assert set(sql.read_sql_tables(FakeSession(), "jdbc:x:y", ["a", "b"])) == {"a", "b"}


@pytest.mark.parametrize("policy,mode", [("replace", "overwrite"), ("append", "append"), ("fail", "errorifexists")])
def test_jdbc_write_modes(spark, monkeypatch, policy, mode):
    writer = FakeJdbc()
    monkeypatch.setattr(DataFrame, "write", property(lambda self: writer), raising=False)
    df = spark.range(1)
    monkeypatch.setattr(type(df), "write", property(lambda self: writer))
    sql.write_sql(df, "jdbc:x:y", "t", policy)
    assert writer.seen["mode"] == mode and writer.seen["dbtable"] == "t"
    with pytest.raises(ValueError):
        sql.write_sql(df, "jdbc:x:y", "t", "merge")


def test_incremental_load(spark, tmp_path):
    state, name = str(tmp_path / "state"), source_name("jdbc:x:y", "t", "id")
    table = spark.range(10)
    first = read_incremental(table, "id", state, name)
    assert first.rows.count() == 10 and last_key(spark, state, name) is None
    assert first.commit() == 9
    grown = spark.range(15)
    second = read_incremental(grown, "id", state, name)
    assert [r["id"] for r in second.rows.orderBy("id").collect()] == [10, 11, 12, 13, 14]
    # Not committed: the same rows come again.
    assert read_incremental(grown, "id", state, name).rows.count() == 5
    assert second.commit() == 14
    assert read_incremental(grown, "id", state, name).commit() is None and last_key(spark, state, name) == 14
    assert read_incremental(grown, "id", state, "other").rows.count() == 15


def test_incremental_load_by_text_key_loads_all(spark, tmp_path):
    table = spark.range(3).select(F.col("id").cast("string").alias("id"))
    load = read_incremental(table, "id", str(tmp_path / "state"), "s")
    assert load.commit() is None and read_incremental(table, "id", str(tmp_path / "state"), "s").rows.count() == 3
