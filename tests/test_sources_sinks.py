"""Sources and sinks against files written by the test, and round trips."""

import pathlib
from datetime import datetime

import pytest

from millrace.operators import scaling
from millrace.session import checkpoint_folder
from millrace.sources import readers, sinks


@pytest.fixture()
def people(spark):
    return spark.createDataFrame([(1, "Ann", 1.5), (2, None, float("nan")), (3, "Bob;x", 2.5)], "id int, name string, v double")


def test_csv_options(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("junk line\nid;name;v\n1;Jos\xe9\u20ac;2.5\nid;name;v\n2;junk line;\n".encode("cp1252"))
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), sep=";", encoding="cp1252", skip_rows=1)
    rows = sorted(tuple(r) for r in df.collect() if r["id"] is not None)
    assert ("1", "José€", "2.5") in [tuple(str(x) for x in r) for r in rows] or (1.0, "José€", 2.5) in rows
    assert df.count() == 3  # a data row equal to a skipped line stays
    plain = readers.read_csv(spark, str(tmp_path / "a.csv"), sep=";", encoding="cp1252")
    assert plain.columns[0] == "junk line"


def test_csv_below_a_head(spark, tmp_path):
    """Quoted separators in the header, quoted line breaks, an empty line above, usual types, two files."""
    head = 'report, of "today"\n\n"name, full",n,d,ok,x\n'
    (tmp_path / "a.csv").write_text(head + '"Ann\nBell",1,2024-01-02,true,1.5\nBob,,2024-03-04,false,7\n')
    (tmp_path / "b.csv").write_text(head + '"Cy, D",30000000000,,true,\n')
    df = readers.read_csv(spark, str(tmp_path), skip_rows=2, multi_line=True)
    assert df.dtypes == [("name, full", "string"), ("n", "bigint"), ("d", "date"), ("ok", "boolean"), ("x", "double")]
    got = sorted(tuple(map(str, r)) for r in df.collect())
    assert got == [
        ("Ann\nBell", "1", "2024-01-02", "True", "1.5"),
        ("Bob", "None", "2024-03-04", "False", "7.0"),
        ("Cy, D", "30000000000", "None", "True", "None"),
    ]
    given = readers.read_csv(spark, str(tmp_path), skip_rows=2, schema="a string, n double, d string, ok string, x string", multi_line=True)
    assert sorted(r["n"] or 0 for r in given.collect()) == [0, 1, 3e10]


def test_csv_head_in_many_blocks(spark, tmp_path):
    """Only the first block of a file has a head, whatever the number of tasks."""
    lines = "\n".join(f"{i},v{i}" for i in range(5000))
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(f"junk\nid,v\n{lines}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = readers.read_csv(spark, str(tmp_path), skip_rows=1)
        assert df.rdd.getNumPartitions() > 4
        assert df.count() == 10_000 and df.agg({"id": "sum"}).first()[0] == 2 * sum(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_quotes_round_trip(spark, tmp_path):
    """What export writes, quotes, separators and line breaks included, the reader gives back."""
    rows = [(1, 'he said "x, y"'), (2, '"'), (3, "a,b"), (4, 'line\nbreak "q"'), (5, 'back\\slash'), (6, "plain")]
    path = sinks.export(spark.createDataFrame(rows, "id int, note string"), str(tmp_path), "notes", "csv")
    back = readers.read_csv(spark, path, multi_line=True)
    assert sorted(map(tuple, back.collect())) == rows
    slashed = tmp_path / "s.csv"
    slashed.write_text('id,note\n1,"a \\" b"\n')
    assert readers.read_csv(spark, str(slashed), escape="\\").first()["note"] == 'a " b'


def test_raw_and_text(spark, tmp_path):
    assert readers.from_raw(spark, '[{"a": 1}, {"a": 2}]', "json").count() == 2
    assert readers.from_raw(spark, '{"a": 1}', "json").count() == 1
    assert [tuple(r) for r in readers.from_raw(spark, "a|b\n1|x\n2|y", "csv", "|").collect()] == [(1, "x"), (2, "y")]
    assert readers.from_raw(spark, "one\ntwo", "text").columns == ["text"]
    (tmp_path / "t.txt").write_text("just some words\nand more\n")
    assert readers.read_text(spark, str(tmp_path / "t.txt")).columns == ["text"]
    (tmp_path / "j.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert readers.read_any(spark, str(tmp_path / "j.json")).count() == 2


def _jobs(spark, action):
    """What ``action`` returns, and the tasks of its jobs."""
    context, group = spark.sparkContext, "jobs-of-a-test"
    context.setJobGroup(group, group)
    out = action()
    status = context.statusTracker()
    stages = [s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    return out, sum(status.getStageInfo(s).numTasks for s in stages if status.getStageInfo(s))


def test_text_in_many_files_is_opened_once(spark, tmp_path):
    """Whether text is a table is told by its first line, not by opening and listing each file for types."""
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        for i in range(60):
            (tmp_path / folder / f"{i}.txt").write_text(f"text {folder}{i}\nof two lines\n")
    texts, tasks = _jobs(spark, lambda: readers.read_text(spark, f"{tmp_path}/*"))
    assert tasks <= 4
    assert texts.columns == ["text"] and texts.distinct().count() == 120


@pytest.mark.parametrize(
    "text, columns",
    [('\n  \nid,"a ""b"", c"\n1,x\n', ["id", 'a "b", c']), ('"one, column"\nx\n', ["text"]), ("", ["text"]), ("\n \n", ["text"]), ("a,,\n1,2,3\n", ["a", "_c1", "_c2"])],
)
def test_text_or_table(spark, tmp_path, text, columns):
    (tmp_path / "t.txt").write_text(text)
    path = str(tmp_path / "t.txt")
    got = readers.read_text(spark, path)
    assert got.columns == columns
    table = spark.read.options(header=True, inferSchema=True, escape='"').csv(path)
    assert (len(table.columns) > 1) == (got.columns != ["text"])


def test_texts_are_written_by_many_tasks(spark, tmp_path):
    """Files of one text each lie in folders that one task wrote, not all in one folder by one task."""
    from millrace.plans import queries_order as q
    from millrace.plans.catalog import QUERIES

    spark.createDataFrame([(f"name {i % 700}",) for i in range(2_100)], "s_name string").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    before = {p for p in pathlib.Path(checkpoint_folder(spark).removeprefix("file:")).glob("trip-*")}
    got = QUERIES["s4_text"](spark, str(tmp_path)).collect()
    assert sorted((r["text"], r["n"]) for r in got) == sorted((f"name {i}", 3) for i in range(700))
    (trip,) = {p for p in pathlib.Path(checkpoint_folder(spark).removeprefix("file:")).glob("trip-*")} - before
    sizes = [len(list(p.glob("*.txt"))) for p in trip.glob("part=*")]
    assert sum(sizes) == 2_100 and len(sizes) > 1 and max(sizes) <= q.FILES_PER_FOLDER


def test_many_files(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,2\n")
    (tmp_path / "bad.xyz").write_text("?")
    tables, report = readers.load_files(spark, [str(tmp_path / "good.csv"), str(tmp_path / "bad.xyz")])
    assert list(tables) == ["good"]
    assert {r["dataset"]: r["success"] for r in report.collect()} == {"good": True, "bad": False}


def test_payload_types(spark):
    rows = [('{"k": 1, "a: VOID`b": "x", "z": {"q": [1.5, null]}, "n": null, "m": 1}',), ('{"k": 2.5, "z": {"q": []}, "m": "y"}',)]
    got = readers.explode_payloads(spark.createDataFrame(rows, "p string"), "p")
    assert got.schema.simpleString() == "struct<a: VOID`b:string,k:double,m:string,n:string,z:struct<q:array<double>>>"
    assert sorted((r["k"], r["m"], tuple(r["z"]["q"])) for r in got.collect()) == [(1.0, "1", (1.5, None)), (2.5, "y", ())]
    assert readers.explode_payloads(spark.createDataFrame([], "p string"), "p").count() == 0


def test_payload_errors(spark):
    df = spark.createDataFrame([('{"a": {"b": [{"k": 1}, {"k": 2}]}}',)], "p string")
    assert readers.explode_payloads(df, "p", "a.b").count() == 2
    assert readers.explode_payloads(df, "p", "a", "b string").count() == 1
    with pytest.raises(Exception, match="no list or object"):
        readers.explode_payloads(df, "p", "a.missing", "k int").collect()


def test_jdbc_options():
    plain = readers.jdbc_options("jdbc:postgresql://h/db", "SELECT 1")
    assert plain["driver"] == "org.postgresql.Driver" and plain["query"] == "SELECT 1"
    ranged = readers.jdbc_options("jdbc:mysql://h/db", "SELECT id FROM t", dict(column="id", lower=0, upper=9, parts=3))
    assert ranged["dbtable"] == "(SELECT id FROM t) q" and ranged["numPartitions"] == "3"


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_export(spark, tmp_path, people, fmt):
    path = sinks.export(people, str(tmp_path), "people", fmt, datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith(f"people_20240102_030405.{fmt}")
    assert readers.read_any(spark, path).count() == 3


def test_powerbi_and_filtered(spark, tmp_path, people):
    assert spark.read.csv(sinks.export_powerbi(people, str(tmp_path), "p"), header=True).count() == 3
    sinks.export_filtered(people, [("range", "v", (2.0, None))], str(tmp_path / "f"))
    rows = spark.read.csv(str(tmp_path / "f"), header=True).collect()
    assert "3" in [r["id"] for r in rows]


def test_session(spark, tmp_path, people):
    registry = sinks.Registry(spark)
    registry.add("people", people)
    registry.save(str(tmp_path), models=["m"], preferences={"theme": "x"})
    again, manifest = sinks.Registry.load(spark, str(tmp_path))
    assert again.get().count() == 3 and manifest["models"] == ["m"] and again.columns("people") == people.columns


def test_history(spark, tmp_path):
    history = sinks.History(spark, str(tmp_path / "h"))
    assert history.steps().count() == 0
    history.log("load", "a file", {"rows": 3}, at=datetime(2024, 1, 1))
    history.log("clean", "gaps", status="error", at=datetime(2024, 1, 2))
    got = sinks.summarise_history(history.steps()).first()
    assert (got["total_steps"], got["failed"], got["duration_seconds"]) == (2, 1, 86400.0)
    assert sinks.recent_steps(history.steps(), 1).first()["operation"] == "clean"
    history.export(str(tmp_path / "out"), "json")
    history.clear()
    assert history.steps().count() == 0


def test_transformers(spark, tmp_path, people):
    fitted = scaling.fit(people.where("v > 0 AND NOT isnan(v)"), ["v"], "standard")
    sinks.save_transformers(spark, fitted, str(tmp_path / "t"))
    assert sinks.load_scalers(spark, str(tmp_path / "t")) == fitted
