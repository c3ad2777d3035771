"""Damaged and awkward inputs: nothing is lost silently, no cell ends a job."""

import glob
import gzip
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from test_plans import plan
from voltaic.functions.columns import canonical_region_code, kw_to_mw, parse_mw, safe_double
from voltaic.operators import joins as J
from voltaic.operators import upsert as U
from voltaic.plans import catalog, silver
from voltaic.session import checkpoint_root
from voltaic.sources import files, html_events, sinks
from voltaic.streaming import streams as T

SMOKE = "/root/testdata/sf0.001"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_damaged_json_fails_or_is_quarantined(spark, tmp_dir):
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType([StructField("a", StringType())])
    root = os.path.join(tmp_dir, "b")
    write(f"{root}/lines.json", '{"a": "1"\n{"a": "2"}\n\n{"a": "3"}\n{"a": "4"}\n')
    write(f"{root}/cut.json", '[{"a": "5"}, {"a": ')
    write(f"{root}/pretty.json", '{\n "records": [\n  {"a": "6"},\n  {"a": "7"}\n ]\n}\n')
    write(f"{root}/empty.json", " \n")
    with pytest.raises(Exception, match="damaged JSON"):
        files.read_bronze_json(spark, root, schema).collect()
    q = os.path.join(tmp_dir, "q")
    good = files.read_bronze_json(spark, root, schema, on_damage="quarantine", quarantine=q)
    assert sorted(r.a for r in good.collect()) == ["2", "3", "4", "6", "7"]
    kept = {(os.path.basename(r._file), r._pos): r.text for r in spark.read.parquet(q).collect()}
    assert kept == {("lines.json", 0): '{"a": "1"', ("cut.json", 0): '[{"a": "5"}, {"a": '}


def test_mostly_damaged_json_lines_lose_nothing(spark, tmp_dir):
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType([StructField("a", StringType())])
    root, q = os.path.join(tmp_dir, "m"), os.path.join(tmp_dir, "q")
    files_ = {"first.json": '{"a": "1"}\n{"a": "2"}\n{"a": "3"\n{"a": \ncut"}\n', "later.json": '{"a": "4"\n{"a": \n{"a": "5"}\n',
              "after.json": '{"a": "6"} {"a": "7"}', "closed.json": '{"a": "8"}] x', "array.json": '[{"a": "9"}]\n]',
              "pretty.json": '[\n{"a": "10"},\n{"a": "11"}\n]', "object.json": '{\n "a": "12"\n}\n', "cut.json": '[\n{"a": "13"},\n{"a": "14"}\n'}
    for name, text in files_.items():
        write(f"{root}/{name}", text)
    for name in ("first", "after"):
        with pytest.raises(Exception, match="damaged JSON"):
            files.read_bronze_json(spark, root, schema, glob=f"{name}.json").collect()
    good = files.read_bronze_json(spark, root, schema, on_damage="quarantine", quarantine=q)
    assert sorted(int(r.a) for r in good.collect()) == [1, 2, 5, 10, 11, 12]
    kept = sorted((os.path.basename(r._file), r.text) for r in spark.read.parquet(q).collect())
    assert kept == sorted([("first.json", '{"a": "3"'), ("first.json", '{"a": '), ("first.json", 'cut"}'), ("later.json", '{"a": "4"'),
                           ("later.json", '{"a": '), *((n, files_[n]) for n in ("after.json", "closed.json", "array.json", "cut.json"))])


def test_every_element_of_a_payload_is_judged_alone(spark, tmp_dir):
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
    schema = StructType([StructField("a", StringType()), StructField("x", DoubleType()), StructField("n", LongType())])
    root, q = os.path.join(tmp_dir, "e"), os.path.join(tmp_dir, "q")
    texts = {"array": '[{"a":"1","x":1.5}, 5]', "envelope": '{"records":[{"a":"2"},7,null,"t",[1]]}', "number": '{"records":5}',
             "scalar": "42", "null": "null", "cell": '[{"a":"3","x":"abc","n":true},{"a":"4","x":"2.5","n":4}]', "none": "[]",
             "nulls": '{"a":null,"x":null,"more":{"y":1}}', "twice": '{"a":"5","a":"6"}', "no": '{"records":null}',
             "lines": '{"a":"7"}\n{"records":[{"a":"8"},{"a":"9","n":"1.x"}]}\n{"a":"10","x":1e3}\n'}
    for name, text in texts.items():
        write(f"{root}/{name}.json", text)
        if name not in ("none", "nulls"):
            with pytest.raises(Exception, match="damaged JSON"):
                files.read_bronze_json(spark, root, schema, glob=f"{name}.json").collect()
    rows = files.read_bronze_json(spark, root, schema, on_damage="quarantine", quarantine=q)
    got = sorted(((os.path.basename(r._file)[:-5], r._pos % 2**32, r.a, r.x, r.n) for r in rows.collect()), key=str)
    assert got == sorted([("array", 0, "1", 1.5, None), ("envelope", 0, "2", None, None), ("cell", 1, "4", 2.5, 4), ("nulls", 0, None, None, None),
                          ("lines", 0, "7", None, None), ("lines", 0, "8", None, None), ("lines", 0, "10", 1000.0, None)], key=str)
    kept = sorted((os.path.basename(r._file)[:-5], r.text, r.reason) for r in spark.read.parquet(q).collect())
    assert kept == sorted([("array", "5", "no object"), *(("envelope", t, "no object") for t in ("7", "null", '"t"', "[1]")),
                           ("number", texts["number"], "records is no array"), ("no", texts["no"], "records is no array"),
                           ("scalar", "42", "no object"), ("null", "null", "no object"), ("twice", texts["twice"], "no JSON"),
                           ("cell", '{"a":"3","n":true,"x":"abc"}', "unreadable: x"), ("lines", '{"a":"9","n":"1.x"}', "unreadable: n")])
    order = [r._pos for r in rows.where("_file LIKE '%lines.json'").orderBy("_pos").collect()]
    assert len(set(order)) == 3


def test_payloads_are_parsed_once(spark, tmp_dir):
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType([StructField("a", StringType())])
    write(f"{tmp_dir}/p/x.json", '[{"a":"1"},2]')
    rows = files.read_bronze_json(spark, f"{tmp_dir}/p", schema, on_damage="quarantine", quarantine=f"{tmp_dir}/q")
    assert "parse_json" not in plan(rows) and "Generate" not in plan(rows)


def test_payloads_are_landed_in_parallel_and_lines_in_bounded_files(spark, tmp_dir):
    kinds = ["view", "purchase", "error", "click", "signup"]
    events = spark.range(1000).selectExpr(
        "id AS event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts", "id % 200 AS user_id",
        f"array({', '.join(map(repr, kinds))})[int(id div 200)] AS event_type", "double(id % 300) AS value",
        """concat('{"k": ', id % 7, '}') AS props""")
    events.write.parquet(f"{tmp_dir}/events.parquet")
    root = catalog._mixed_bronze(spark, tmp_dir, lines=50).removeprefix("file:")
    assert all(len(open(f).readlines()) <= 50 for kind in ("lines", "damaged") for f in glob.glob(f"{root}/{kind}/*.txt"))
    nd = events.where("event_type = 'signup' AND value > 150").count()
    counts = {r["kind"]: r["texts"] for r in entry_mod.queries()["s01_quarantine"](spark, tmp_dir).collect()}
    assert counts == {"cut line": nd, "cut file": 200, "number": 200, "text": 200, "null": 200}
    assert entry_mod.queries()["s01_mixed_json"](spark, tmp_dir).count() == 800 - nd


def test_landed_payloads_are_whole_and_again_the_same(spark, tmp_dir):
    texts = {"a": "one\nline é", "b": "", "c": "x" * 100_000}
    df = spark.createDataFrame([*texts.items()], "name string, value string").repartition(3)
    for _ in range(2):  # a task that runs again overwrites its own files
        assert sinks.land_payloads(df, f"file:{tmp_dir}/p q", ".txt") == 3
        assert {os.path.basename(f)[:-4]: open(f, encoding="utf-8", newline="").read() for f in glob.glob(f"{tmp_dir}/p q/*")} == texts


def test_payloads_are_listed_and_read_by_tasks(spark, tmp_dir):
    from pyspark.sql.types import LongType, StructField, StructType
    for i in range(300):
        write(f"{tmp_dir}/p/{i % 7}/{i}.json", f'[{{"a":{i}}}]')
    df = files.read_bronze_json(spark, f"{tmp_dir}/p", StructType([StructField("a", LongType())]))
    assert not any("/p/" in f for f in df.inputFiles()) and "FileScan text" not in plan(df)
    assert df.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    write(f"{tmp_dir}/p/later.json", '{"a":300}')  # the files are those of the time of the call
    assert sorted((os.path.basename(r._file), r.a) for r in df.collect()) == sorted((f"{i}.json", i) for i in range(300))


def test_a_task_of_the_quarantine_reads_many_payloads(spark, tmp_dir):
    kinds = ["view", "purchase", "error", "signup"]
    events = spark.range(400).selectExpr(
        "id AS event_id", "timestamp'2024-01-01 00:00:00' AS ts", "id % 100 AS user_id",
        f"array({', '.join(map(repr, kinds))})[int(id div 100)] AS event_type", "double(id % 100) AS value", """'{"k": 1}' AS props""")
    events.write.parquet(f"{tmp_dir}/events.parquet")
    staged = lambda: set(glob.glob(f"{checkpoint_root(spark)}/bronze-records-*".removeprefix("file:")))
    before = staged()
    counts = {r["kind"]: r["texts"] for r in entry_mod.queries()["s01_quarantine"](spark, tmp_dir).collect()}
    assert counts == {"cut file": 100, "number": 100, "text": 100, "null": 100}
    (new,) = staged() - before
    assert len(glob.glob(f"{new}/part-*")) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_payload_files_are_those_of_a_file_scan(spark, tmp_dir):
    root = f"{tmp_dir}/a b+é%20'x/d ~!@#$^&()=,;[1]"
    for name in ("x y", "é\u00a0ü\u0085\u2028", "p%41+q", "_s", "_metadata", ".t", "_h/i", "_k=1/j", ".g/k", "_metadata_d/l", "_a=1", "n\nl", "tab\t",
                 "bs\\q", 'q"<>|`{}', "sub/𝄞 x/y"):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}.json", "wb") as f:
            f.write(b'\xef\xbb\xbf{"a": "\xff\xfe"}\r\n')
    write(f"{root}/empty.json", "")
    write(f"{root}/other.txt", "1")
    with gzip.open(f"{root}/z.json.gz", "wb") as f:
        f.write(b"2")
    got = {}
    for path in (f"{tmp_dir}/a*", f"{tmp_dir}/a*/*/", f"file:{tmp_dir}/a b+é%20'x/", f"{root}/x y.json".replace("[", "\\[").replace("]", "\\]")):
        for pattern in ("*.json", "{x,_}*.json", "[!x]*.json", "*.gz", "*"):
            scan = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
            both = [sorted(map(tuple, df.select("_file", F.hex("value")).collect())) for df in (
                files._payload_texts(spark, path, pattern, batch_bytes=40), scan.select("value", F.col("_metadata.file_path").alias("_file")))]
            assert both[0] == both[1]
            got[path, pattern] = len(both[0])
    assert got[f"{tmp_dir}/a*", "*.json"] == 11 and got[f"{tmp_dir}/a*", "*"] == 13
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files._payload_texts(spark, f"{tmp_dir}/none", "*.json")
    os.makedirs(f"{tmp_dir}/nothing")
    assert files._payload_texts(spark, f"{tmp_dir}/nothing", "*.json").count() == 0


def test_payloads_are_read_without_a_shared_folder(spark, tmp_dir, monkeypatch):
    def refuse(*_):
        raise RuntimeError("spark.checkpoint.dir is unset")
    write(f"{tmp_dir}/in/a.txt", "1")
    monkeypatch.setattr(files, "scratch_path", refuse)
    assert [r.value for r in files._payload_texts(spark, f"{tmp_dir}/in", "*.txt").collect()] == ["1"]


def test_payloads_that_only_spark_reads_are_left_to_it(spark, tmp_dir):
    names = lambda path: sorted(os.path.basename(r._file) for r in files._payload_texts(spark, path, "*.txt").select("_file").collect())
    write(f"{tmp_dir}/in/a.txt", "1")
    write(f"{tmp_dir}/in/b.txt", "2")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.payloads.link./in", f"file://{tmp_dir}/in")
    assert names("viewfs://payloads/in") == ["a.txt", "b.txt"]
    (spark.readStream.text(f"{tmp_dir}/in").writeStream.trigger(availableNow=True).format("text").option("checkpointLocation", f"{tmp_dir}/ckpt")
     .start(f"{tmp_dir}/sink").awaitTermination())
    write(f"{tmp_dir}/sink/not-committed.txt", "3")
    assert "not-committed.txt" not in names(f"{tmp_dir}/sink") and names(f"{tmp_dir}/sink")
    listed = files._payload_texts(spark, f"{tmp_dir}/in", "*.txt")
    os.remove(f"{tmp_dir}/in/b.txt")
    with pytest.raises(Exception, match="b.txt"):
        listed.count()
    spark.conf.set("spark.sql.files.ignoreMissingFiles", True)
    try:
        scanned = files._payload_texts(spark, f"{tmp_dir}/in", "*.txt")
        os.remove(f"{tmp_dir}/in/a.txt")
        assert scanned.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.ignoreMissingFiles")


def test_capacity_files_are_read_by_their_own_headers(spark, tmp_dir):
    root = os.path.join(tmp_dir, "c")
    write(f"{root}/a.csv", "code_insee_region;filiere;puissance\n11;Éolien;1,5\n")
    write(f"{root}/b.csv", "﻿filiere,puissance,code_insee_region,extra\n\"Gaz, vapeur\",2.5,84,x\n\"two\nlines\",3,93,\n")
    rows = files.read_capacity_csv(spark, root)
    got = sorted((r.code_insee_region, r.filiere, r.puissance, r.extra) for r in rows.collect())
    assert got == [("11", "Éolien", "1,5", None), ("84", "Gaz, vapeur", "2.5", "x"), ("93", "two\nlines", "3", None)]


def test_wide_files_are_read_and_landed_whole(spark, tmp_dir):
    root, land = os.path.join(tmp_dir, "w"), os.path.join(tmp_dir, "l")
    names = [f"c{i}" for i in range(300)] + ["Code_Insee_Region", "puissance_installee_mw"]
    write(f"{root}/wide.csv", ",".join(names) + "\n" + ",".join(str(i) for i in range(302)) + "\n")
    got = files.read_capacity_csv(spark, root).drop("_file", "_row").first().asDict()
    assert got == {n.lower(): str(i) for i, n in enumerate(names)}
    assert [(r.status, r.rows, r.error) for r in files.validate_and_route_csv(spark, root, landing=land).collect()] == [("PASS", 1, None)]
    assert spark.read.parquet(land).drop("_file").first().asDict() == got


def test_repeated_header_cells_and_records_wider_than_their_header(spark, tmp_dir):
    root, land = os.path.join(tmp_dir, "r"), os.path.join(tmp_dir, "l")
    write(f"{root}/twice.csv", "a;A; a ;b;;code_insee_region;puissance_installee_mw\n1;2;3;4;5;6;7\n8\n")
    rows = files.read_capacity_csv(spark, root).orderBy("_row").collect()
    assert [(r.a, r.a_2, r.a_3, r.b, r.column_5) for r in rows] == [("1", "2", "3", "4", "5"), ("8", None, None, None, None)]
    st = files.validate_and_route_csv(spark, root, landing=land, sep=";").first()
    assert (st.status, st.error, st.rows) == ("PASS", "repeated columns: a", 2) and spark.read.parquet(land).count() == 2
    write(f"{root}/wide.csv", 'code_insee_region;puissance_installee_mw\n1;"2;x"\n3;4;"5;;";6\n')
    with pytest.raises(Exception, match="more cells than the header in .*wide.csv"):
        files.read_capacity_csv(spark, root).collect()
    files.validate_and_route_csv(spark, root, landing=f"{land}2", sep=";")
    kept = spark.read.parquet(f"{land}2").where("_file LIKE '%wide.csv'").orderBy("code_insee_region").collect()
    assert [(r.code_insee_region, r.puissance_installee_mw, (r._beyond or "").strip()) for r in kept] == [("1", "2;x", ""), ("3", "4", '3;4;"5;;";6')]


def test_headers_behind_blank_records_and_over_several_lines(spark, tmp_dir):
    root = os.path.join(tmp_dir, "h")
    write(f"{root}/late [1].csv", ' ; \n;;\n\ncode;n\n1;2\n \n;\n3;4\n')
    write(f"{root}/open.csv", '"co\nde";"n;m"\n5;"6\n7"\n')
    write(f"{root}/blank.csv", " \n;;\n")
    rows = files.read_capacity_csv(spark, root, sep=";")
    got = sorted((r["code"] or r["co\nde"], r["n"] or r["n;m"]) for r in rows.collect())
    assert got == [("1", "2"), ("3", "4"), ("5", "6\n7")]


def test_files_of_one_header_are_parsed_once(spark, tmp_dir):
    root = os.path.join(tmp_dir, "o")
    for i in range(4):
        write(f"{root}/{i}.csv", f"code_insee_region,puissance_installee_mw\n{i},1\n")
    assert plan(files.read_capacity_csv(spark, root), "simple").count("FileScan csv") == 1
    assert plan(files.validate_and_route_csv(spark, root), "simple").count("FileScan csv") == 1
    assert "FileScan csv" not in plan(files.validate_and_route_csv(spark, root, landing=f"{tmp_dir}/l"), "simple")


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_files_are_digested_in_blocks_and_known_ones_stay_closed(spark, tmp_dir, block):
    import hashlib
    root = os.path.join(tmp_dir, "s")
    texts = {"a b.csv": "h\r\n1\r\n\r\n  \n2", "b.csv": "h\n\r\n3\n", "c.csv": "h\n é \n \r", "d.csv": ""}
    for name, text in texts.items():
        write(f"{root}/{name}", text)
    todo, state = files.skip_unchanged(spark, root, None, block_bytes=block)
    got = {r.name: (r.checksum, r.records) for r in todo.collect()}
    import re
    want = {n: (hashlib.sha256(t.encode()).hexdigest()[:16], sum(x.strip(" ") != "" for x in re.split("\r?\n", t)) - 1) for n, t in texts.items()}
    assert {n: v for n, v in got.items() if n != "d.csv"} == {n: v for n, v in want.items() if n != "d.csv"}
    state = spark.createDataFrame(state.collect(), state.schema)
    write(f"{root}/b.csv", "h\n4\n5\n")
    os.utime(f"{root}/c.csv", (1, 1))  # touched, not changed
    again, new = files.skip_unchanged(spark, root, state, block_bytes=block)
    assert [(r.name, r.records) for r in again.collect()] == [("b.csv", 2)]
    assert "a b.csv" not in {r.name for r in spark.read.parquet(sorted(glob.glob(
        f"{checkpoint_root(spark)}/file-digests-*".removeprefix("file:")), key=os.path.getmtime)[-1]).collect()}
    old = files.skip_unchanged(spark, root, new.select("name", "checksum"), block_bytes=block)[0]
    assert old.count() == 0 and {r.name for r in new.collect()} >= {"a b.csv", "b.csv", "c.csv"}


def test_validation_reads_csv_records_and_keeps_bad_files(spark, tmp_dir):
    root, q = os.path.join(tmp_dir, "v"), os.path.join(tmp_dir, "q")
    write(f"{root}/quoted.csv", '"code_insee_region","puissance_installee_mw","note"\n11,2,"two\nlines"\n')
    write(f"{root}/bad.csv", "a,b\n1,2\n")
    got = {os.path.basename(r.file): (r.status, r.rows) for r in files.validate_and_route_csv(spark, root, quarantine=q).collect()}
    assert got == {"quoted.csv": ("PASS", 1), "bad.csv": ("FAIL", 1)}
    kept = spark.read.parquet(q).orderBy("position").collect()
    assert [r.line for r in kept] == ["a,b", "1,2"] and {r.error for r in kept} == {"missing columns: code_insee_region, puissance_installee_mw"}


def test_export_quotes_cells(spark, tmp_dir):
    df = spark.createDataFrame([('a;b "c"', 1.5)], "unit string, mw double")
    path = sinks.export_fr_csv(df.coalesce(1), os.path.join(tmp_dir, "x"), ["unit", "mw"], {"unit": "Unit", "mw": "MW"})
    text = open(glob.glob(f"{path}/part-*")[0], encoding="utf-8-sig", newline="").read()
    assert text == 'Unit;MW\r\n"a;b ""c""";1,5\r\n'
    assert sinks.fr_csv_lines(df, ["unit", "mw"]).first().line == '"a;b ""c""";1,5'


def test_pages_are_parsed_a_few_at_a_time(spark):
    row = '<tr class="event-row" data-event-id="E{0}"><td class="unit-name">U{0}</td></tr>'
    batch = pa.record_batch([pa.array(range(1200), pa.int64()), pa.array([row.format(i) for i in range(1200)]),
                             pa.array([None, *("u",) * 1199], pa.string())], names=["page_id", "html", "url"])
    parts = list(html_events._extract(iter([batch])))
    assert sum(p.num_rows for p in parts) == 1200 and max(p.num_rows for p in parts) <= 50
    assert parts[0].to_pylist()[0]["source_url"] is None and parts[-1].to_pylist()[-1]["event_id"] == "E1199"
    html_events.extract_events_html(spark.createDataFrame([(1, "", "")], "page_id long, html string, url string"))
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_open_rows_and_nested_tags_in_pages(spark):
    page = ('<table><tr class="event-row" data-event-id="E1"><td class="unit-name">A<b>bold</b> tail<td class="unavail-mw">1'
            '<tr class="event-row"><td class="event-id">E2</td><td class="unit-name"><i>inner</i>own</td>')
    ev = {r["event_id"]: r for r in html_events.parse_event_rows(page)}
    assert set(ev) == {"E1", "E2"} and ev["E1"]["unit_name"] == "A" and ev["E2"]["unit_name"] == "own"
    pages = spark.createDataFrame([(1, "u", page), (2, "u", "<p>none</p>"), (3, "u", None)], "page_id long, url string, html string")
    assert html_events.extract_events_html(pages).count() == 2
    assert "contains" in plan(html_events.extract_events_html(pages)).lower()


@pytest.mark.parametrize("text,number", [("100d", None), ("0x1p3", None), ("1f", None), (" 12.5 ", 12.5), ("1e3", 1000.0), ("-.5", -0.5),
                                         ("nan", None), ("", None), ("ND", None), ("\t12", 12.0), ("12\u00a0", 12.0), ("\u2003-3.5\r\n", -3.5),
                                         ("1 2", None), ("\x1c7\x85", 7.0)])
def test_numbers_are_what_python_reads(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(safe_double("t")).first()[0] == number
    assert df.select(parse_mw("t")).first()[0] == (12.0 if text == "1 2" else number or 0.0)
    assert df.select(kw_to_mw("t")).first()[0] == (None if number is None else number / 1000.0)
    assert df.select(canonical_region_code("t")).first()[0] == (None if number is None or not int(number) else str(int(number)))


def test_region_codes_never_end_the_job(spark):
    df = spark.createDataFrame([("1e30",), ("11.9",), ("-2.5",), ("1e300",), ("0.4",), ("x",)], "t string")
    assert [r[0] for r in df.select(canonical_region_code("t")).collect()] == [str(10**30), "11", "-2", None, None, None]


def test_unreadable_consumption_is_null(spark):
    df = spark.createDataFrame([("11", "2025-01-01T00:00:00+00:00", "ND", 1)],
                               "code_insee_region string, date_heure string, consommation string, load_ordinal int")
    out, metrics = silver.transform_readings(df)
    assert out.first().consommation_mw is None and metrics.first().values_flagged == 1


def test_metrics_count_rows_as_they_came_in(spark):
    rows = [("11", "2025-01-01T00:00:00+00:00", 1), (None, "2025-01-01T00:00:00+00:00", 2), ("11", None, 3),
            ("11", "2025-01-01T00:00:00+00:00", 4)]
    df = spark.createDataFrame(rows, "code_insee_region string, date_heure string, load_ordinal int")
    out, metrics = silver.transform_readings(df)
    m = metrics.first()
    assert out.count() == 1
    assert (m.input_rows, m.rows_dropped, m.output_rows) == (4, 2, 2)
    assert m.nulls_found == {"code_insee_region": 1, "date_heure": 1}


def test_equal_unmatched_rows_count_each(spark):
    staged = spark.createDataFrame([("a", 1), ("x", 1), ("x", 1), ("a", 9), ("x", 9)], "r string, t int")
    dims = [(spark.createDataFrame([("a",), ("b",)], "r string"), "r"), (spark.createDataFrame([(1,)], "t int"), "t")]
    resolved, count = J.resolve_keys(staged, dims)
    assert resolved.count() == 1 and count.first()[0] == 4


def test_a_late_reading_lowers_first_seen(spark, tmp_dir):
    merge = T.merge_last_seen(f"{tmp_dir}/seen")
    batch = lambda a, b: spark.createDataFrame([("11", "Ile", a, b)], "code_insee string, nom_region string, first_seen_at string, last_seen_at string")
    merge(batch("2025-01-02", "2025-01-03"), 0)
    merge(batch("2025-01-01", "2025-01-01"), 1)
    row = T.read_upserted(spark, f"{tmp_dir}/seen").first()
    assert (row.first_seen_at, row.last_seen_at) == ("2025-01-01", "2025-01-03")


def test_upserts_read_only_the_touched_partitions(spark, tmp_dir, monkeypatch):
    path = f"{tmp_dir}/fact"
    old = spark.createDataFrame([(f"2025-01-{d:02d}", "11", 1.0) for d in range(1, 20)], "day string, k string, v double")
    U.upsert_table(spark, path, old, ["day", "k"], partition_by=["day"])
    seen = []
    real = U.merge_frames
    monkeypatch.setattr(U, "merge_frames", lambda base, *a, **k: seen.append(plan(base)) or real(base, *a, **k))
    U.upsert_table(spark, path, old.limit(0).union(spark.createDataFrame([("2025-01-07", "84", 2.0)], old.schema)),
                   ["day", "k"], partition_by=["day"])
    assert "2025-01-07" in seen[0].split("PartitionFilters")[1].split("\n")[0]
    assert spark.read.schema(old.schema).parquet(path).count() == 20


def test_day_bounds_prune_days(spark, tmp_dir):
    df = spark.createDataFrame([(2025, m, d, f"2025-{m:02d}-{d:02d} 12:00:00") for m in (1, 2) for d in (3, 15)],
                               "year int, month int, day int, date_heure string").withColumn("date_heure", F.col("date_heure").cast("timestamp_ntz"))
    df.write.partitionBy("year", "month", "day").parquet(f"{tmp_dir}/t")
    out = files.incremental_filter(spark.read.parquet(f"{tmp_dir}/t"), since="2025-01-15", partition_cols=True)
    filters = plan(out).split("PartitionFilters")[1].split("\n")[0]
    assert "day" in filters and out.count() == 3


def test_serving_plans(spark):
    q = entry_mod.queries()
    a01 = plan(q["a01_production_regional"](spark, SMOKE), "simple")
    assert a01.count("lineitem.parquet") == 1
    for name in ("a08_national_by_timestamp", "a02_production_wide"):
        p = plan(q[name](spark, SMOKE), "simple")
        assert p.count("Exchange hashpartitioning") <= 3 and p.count("lineitem.parquet") == 1
    assert "GreaterThanOrEqual(l_shipdate" in plan(q["l08_last_period"](spark, SMOKE))
    assert "RoundRobin" not in plan(q["s16_extract_events_html"](spark, SMOKE)) + a01


def test_shared_folder_rule(spark, monkeypatch):
    class Session:
        conf = {"spark.master": "local-cluster[3,2,1000]"}

        class sparkContext:  # noqa: N801
            @staticmethod
            def getCheckpointDir():
                return None
    session = Session()
    session.conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: {"spark.master": "local-cluster[3,2,1000]"}.get(k, d))})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(session)


def test_a_hot_region_has_many_payloads_of_bounded_size(spark):
    from voltaic.plans import catalog
    root = catalog._mixed_bronze(spark, SMOKE, block=100)
    events = spark.read.parquet(f"{SMOKE}/events.parquet").withColumn("slot", F.floor(F.col("event_id") / 100))
    for kind, event in (("array", "view"), ("envelope", "purchase"), ("cut", "error")):
        values = [v for v in (open(f).read() for f in glob.glob(f"{root}/{kind}/**/*.txt".removeprefix("file:"), recursive=True)) if v.strip()]
        want = events.where(F.col("event_type") == event)
        assert len(values) == want.select("user_id", "slot").distinct().count() > want.select("user_id").distinct().count()
        if kind != "cut":
            assert sum(v.count('"load_ordinal"') for v in values) == want.count()
        assert max(v.count('"load_ordinal"') for v in values) <= 100
