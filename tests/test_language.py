import pytest
from pyspark.sql import functions as F

from cohortlab.plans.expressions import ExpressionError, condition, evaluate, parse
from cohortlab.plans.session import ProgramError, Session
from cohortlab.sources import readers, writers


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Ann", 30.0, True, "1.5"), (2, " bob ", None, False, "x"), (3, None, 41.0, None, " "), (4, "", 30.0, True, "1.50"), (5, "Ann", 7.0, False, None)]
    return spark.createDataFrame(rows, "id int, name string, age double, ill boolean, code string")


def chosen(people, text):
    return sorted(r.id for r in people.where(condition(people, text)).collect())


@pytest.mark.parametrize(
    "text, ids",
    [
        ('name = "ann"', [1, 5]), ('name <> "ann"', [2]), ("age <> 30", [3, 5]), ("NOT age = 30", [2, 3, 5]), ("age = (.)", [2]), ("NOT ill", [2, 3, 5]), ("ill = (+)", [1, 4]),
        ("code = 1.5", [1, 4]), ('name LIKE "*n*"', [1, 5]), ("age > 10 AND ill", [1, 4]), ("age > 10 XOR ill", [3]), ("age / 0 = (.)", [1, 2, 3, 4, 5]), ("-2^2 = 4", [1, 2, 3, 4, 5]),
        ("2^3^2 = 512", [1, 2, 3, 4, 5]), ("STRLEN(name) = 3", [1, 5]), ('name & "!" = "ann!"', [1, 5]), ("ABS(-3) = 3 AND ROUND(1.005, 2) = 1", [1, 2, 3, 4, 5]), ("age MOD 4 = 2", [1, 4]), ('UPPERCASE(name) = "ANN"', [1, 5]),
    ],
)
def test_conditions(people, text, ids):
    assert chosen(people, text) == ids


def test_errors(people):
    for text in ("age >", "(age", "age = 1 )", "$", "nosuch = 1"):
        with pytest.raises(ExpressionError):
            condition(people, text)


def test_session(spark, people):
    s = Session(spark, {"people": people}, {"people": ["id"]})
    out = s.run('READ people\nSELECT age > 10\nSORT age DESC id\nLIST id\n')
    assert [r.id for r in out.collect()] == [3, 1, 4]
    s.run("CANCEL SELECT\nCANCEL SORT")
    assert s.active.count() == 5
    assert s.run("EPIAI QUALITY *").where("field = 'age'").first().missing == 1
    assert s.run("MEANS age").first().n == 4
    with pytest.raises(ProgramError):
        s.run("REGRESS a = b")


def test_freq_missing_and_exact_limits(spark, people):
    s = Session(spark, {"people": people})
    out = {r.value: r for r in s.run("READ people\nSET MISSING=ON\nFREQ ill").collect()}
    assert out["Yes"]["count"] == 2 and out[""].is_missing and 0 < out["No"].low < 0.4 < out["No"].high < 1


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('First name,x,x\r\n"a, ""b""",1,2020-01-02\r\n,,\r\n"c\nd",2.5,2021-01-02\r\n'.encode())
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), typed=True)
    assert df.columns == ["First_name", "x", "x_2"] and df.count() == 2
    assert {r.First_name for r in df.collect()} == {'a, "b"', "c\nd"} and df.schema["x"].dataType.typeName() == "double"
    (tmp_path / "b.json").write_text('[{"a": 1, "b": "x"}, {"a": null, "b": "y"}]')
    assert readers.read_json(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "c.json").write_text('[{"a": [1]}]')
    with pytest.raises(ValueError):
        readers.read_json(spark, str(tmp_path / "c.json"))
    (tmp_path / "d.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":"1"},"geometry":{"type":"Polygon","coordinates":[[[1,2],[3,2],[3,5],[1,2]]]}}]}')
    row = readers.inspect_features(readers.read_geojson(spark, str(tmp_path / "d.geojson"))).first()
    assert (row.features, row.kinds, row.fields, row.west, row.south, row.east, row.north) == (1, ["Polygon"], ["n"], 1, 2, 3, 5)
    writers.write_csv(df, str(tmp_path / "out"), one_file=True)
    assert readers.read_csv(spark, str(tmp_path / "out")).count() == 2
    assert {r.table_name: r.records for r in writers.convert({"t": df}, str(tmp_path / "db")).collect()} == {"t": 2}
    assert writers.package(df, [("First_name", "contains", "B")], ["x"]).first().x == ""
