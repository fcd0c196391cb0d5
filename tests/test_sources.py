import gzip
import hashlib
import io
import json
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.sources import formats, store


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl_keeps_broken_lines(spark, tmp_path):
    df = formats.jsonl(spark, put(tmp_path / "x.jsonl", '{"a":1,"b":"x"}\nnot json\n{"a":2}\n'), "a int, b string").cache()
    assert rows(df.where("_corrupt IS NULL").select("a", "b")) == [(1, "x"), (2, None)] and df.where("_corrupt IS NOT NULL").count() == 1


def test_manifest_checks_hash_and_count(spark, tmp_path):
    payload = gzip.compress(b'{"a":1}\n{"a":2}\n')
    (tmp_path / "c1.jsonl.gz").write_bytes(payload)
    good = [("c1.jsonl.gz", hashlib.sha256(payload).hexdigest(), 2)]
    read = lambda m: formats.manifest_jsonl(spark, str(tmp_path), spark.createDataFrame(m, "path string, sha256 string, rows long"), "a int")
    assert rows(read(good).select("a")) == [(1,), (2,)]
    for bad in ([("c1.jsonl.gz", "0" * 64, 2)], [("c1.jsonl.gz", good[0][1], 3)]):
        with pytest.raises(ValueError, match="c1.jsonl.gz"):
            read(bad)


def test_ledger_csv_header_types_and_hashes(spark, tmp_path):
    text = "d,p,note\n2024-01-02,70,\n2024-01-03,x,bad\n"
    df = formats.ledger_csv(spark, put(tmp_path / "l.csv", text), "d date, p int, note string")
    got = {str(r["d"]): r for r in df.collect()}
    assert got["2024-01-02"]["p"] == 70 and got["2024-01-02"]["note"] is None and not got["2024-01-02"]["bad"]
    assert got["2024-01-02"]["line_hash"] == hashlib.sha256(b"2024-01-02,70,").hexdigest() and got["2024-01-03"]["bad"]
    with pytest.raises(ValueError, match="header"):
        formats.ledger_csv(spark, put(tmp_path / "m.csv", "p,d\n1,2\n"), "d date, p int")


def test_dated_and_quote_csv(spark, tmp_path):
    df = formats.dated_csv(spark, put(tmp_path / "f.csv", "DATE,GDP\n2024-01-01,1.5\n2024-02-01,.\nnote,\n"), value="GDP")
    assert [(str(a), b) for a, b in rows(df)] == [("2024-01-01", 1.5), ("2024-02-01", None)]
    vix = formats.vix_csv(spark, put(tmp_path / "v.csv", "DATE,OPEN,HIGH,LOW,CLOSE\n01/02/2024,1,2,0.5,13.2\n"))
    assert [(str(a), b) for a, b in rows(vix)] == [("2024-01-02", 13.2)]
    ohlcv = formats.ohlcv_csv(spark, put(tmp_path / "s.csv", "Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,100\n2024-01-03,1,2,0.5,N/D,0\n"))
    assert rows(ohlcv.select("close", "volume")) == [(1.5, 100.0)]


def test_yields_xml(spark, tmp_path):
    entry = "<entry><content><m:properties><d:NEW_DATE>{}</d:NEW_DATE><d:BC_2YEAR>{}</d:BC_2YEAR><d:BC_10YEAR>{}</d:BC_10YEAR></m:properties></content></entry>"
    text = "<feed>" + entry.format("2024-01-02T00:00:00", "4.3", "3.9") + entry.format("2024-01-03T00:00:00", "", "4.0") + "</feed>"
    df = formats.yields_xml(spark, put(tmp_path / "y.xml", text), {"y2": "BC_2YEAR", "y10": "BC_10YEAR"})
    assert [(str(a), b, c) for a, b, c in rows(df)] == [("2024-01-02", 4.3, 3.9), ("2024-01-03", None, 4.0)]


def test_zipped_factors_stop_at_the_annual_block(spark, tmp_path):
    text = "A note\n,Mkt,SMB\n196307,-0.39,-0.41\n196308,5.07,-99.99\n\n Annual\n1964,12.5,1.0\n"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("f.CSV", text)
    (tmp_path / "f.zip").write_bytes(buffer.getvalue())
    assert [(str(a), b) for a, b in rows(formats.zipped_factors(spark, str(tmp_path / "f.zip")).select("date", "values"))] == [("1963-07-01", [-0.39, -0.41]), ("1963-08-01", [5.07, None])]


def test_parallel_arrays(spark):
    df = spark.createDataFrame([("A", '{"ts":[1,2,3],"close":[1.0,null,3.0]}'), ("B", "{}"), ("C", "broken")], "s string, j string")
    assert rows(formats.parallel_arrays(df, "j", {"ts": "bigint", "close": "double"}).where("close IS NOT NULL")) == [("A", 1, 1.0), ("A", 3, 3.0)]


def test_company_facts_as_filed_by(spark):
    u = lambda end, val, filed, form="10-Q": {"start": "2023-01-01", "end": end, "val": val, "form": form, "filed": filed, "accn": filed}
    doc = json.dumps({"cik": 7, "units": {"USD": [u("2023-03-31", 1.0, "2023-05-01"), u("2023-03-31", 2.0, "2023-08-01"), u("2023-03-31", 3.0, "2024-08-01"), u("2023-06-30", 4.0, "2023-08-01"), u("2023-06-30", 5.0, "2023-08-01", "8-K")]}})
    got = formats.company_facts(spark.createDataFrame([(doc,)], "j string"), "j", as_of="2023-12-31").select("end", "val")
    assert rows(got) == [("2023-03-31", 2.0), ("2023-06-30", 4.0)]


def test_vintages_close_at_the_next(spark):
    wide = spark.createDataFrame([("2024-01-01", "1.0", "1.1", "."), ("2024-02-01", None, "2.0", "2.1")], "date string, GDP_20240301 string, GDP_20240401 string, GDP_20240501 string")
    got = [tuple(map(str, r)) for r in rows(formats.vintages(wide, "GDP"))]
    assert got == [("2024-01-01", "2024-03-01", "1.0", "2024-03-31"), ("2024-01-01", "2024-04-01", "1.1", "None"), ("2024-02-01", "2024-04-01", "2.0", "2024-04-30"), ("2024-02-01", "2024-05-01", "2.1", "None")]


def test_records_with_front_matter(spark, tmp_path):
    put(tmp_path / "a.md", "---\nid: x-1\nprobability: 42\nextra: 'kept'\n---\n\nBody: text\n")
    put(tmp_path / "b.md", "no matter\n---\n")
    got = {r["path"][-4:]: r for r in formats.records(spark, str(tmp_path)).collect()}
    assert got["a.md"]["fields"] == {"id": "x-1", "probability": "42", "extra": "kept"} and got["a.md"]["body"] == "Body: text"
    assert got["b.md"]["fields"] == {}


def test_store_appends_once_and_prunes(spark, tmp_path):
    root = str(tmp_path / "facts")
    facts = spark.createDataFrame([("s", "g", "2023-01-01", 1.0), ("s", "g", "2024-01-01", 2.0), ("t", "g", "2024-01-01", None)], "source_id string, series_id string, d string, value double").withColumn("observation_date", F.to_date("d")).drop("d")
    keys = ["source_id", "series_id", "observation_date"]
    assert store.append_facts(facts, root, keys=keys) == 3 and store.append_facts(facts, root, keys=keys) == 0
    early = store.read_facts(spark, root, upto_year=2023)
    assert early.count() == 1 and "PartitionFilters: [isnotnull(year" in early._jdf.queryExecution().toString()


def test_store_refuses_other_content_for_a_key(spark, tmp_path):
    root = str(tmp_path / "facts")
    at = lambda *data: spark.createDataFrame(data, "source_id string, d string, value double").withColumn("observation_date", F.to_date("d")).drop("d")
    keys = ["source_id", "observation_date"]
    assert store.append_facts(at(("s", "2023-01-01", 1.0), ("s", "2023-01-01", 1.0), (None, None, None)), root, keys=keys) == 2
    with pytest.raises(ValueError, match="other content"):
        store.append_facts(at(("s", "2023-01-01", 2.0), ("s", "2023-01-02", 2.0)), root, keys=keys)
    with pytest.raises(ValueError, match="other content"):
        store.append_facts(at(("t", "2023-01-01", 2.0), ("t", "2023-01-01", 3.0)), root, keys=keys)
    assert store.append_facts(at(("s", "2023-01-01", 1.0), ("t", "2023-01-01", 2.0), (None, None, None)), root, keys=keys) == 1 and store.read_facts(spark, root).count() == 3


def test_lines_are_numbered_per_file(spark, tmp_path):
    for name, n in (("a.csv", 500), ("b.csv", 3), ("c.csv", 0)):
        put(tmp_path / name, "\ufeff" * (name == "b.csv") + "k,v\n" + "".join(f"{name[0]},{i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = rows(formats.ledger_csv(spark, str(tmp_path), "k string, v long").select("k", "v", "line_no"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 503 and all(line == v + 2 for _, v, line in got)
    put(tmp_path / "d.csv", "v,k\n1,a\n")
    with pytest.raises(ValueError, match="header"):
        formats.ledger_csv(spark, str(tmp_path), "k string, v long")


def test_cells_of_html_tables(spark, tmp_path):
    put(tmp_path / "p.html", "<table><tr><th>a</th></tr><tr><td>1&amp;2 <b>x</b></td><td></td></tr></table><p>no</p><table><tr><td>\n y </td></tr></table>")
    put(tmp_path / "q.html", "no table")
    got = [(r["table"], r["row"], r["cells"]) for r in formats.html_tables(spark, str(tmp_path)).orderBy("table", "row").collect()]
    assert got == [(0, 0, ["a"]), (0, 1, ["1&2 x", ""]), (1, 0, ["y"])]


def test_a_workbook_is_read_as_written(spark, tmp_path):
    data = [["year", None, "a & b"], [2024, 3.5, None], [None, " x ", "<y>"]]
    (tmp_path / "w.xlsx").write_bytes(formats.workbook_bytes(data))
    got = [r["cells"] for r in formats.workbook(spark, str(tmp_path / "w.xlsx")).orderBy("row").collect()]
    assert got == [["year", None, "a & b"], ["2024", "3.5"], [None, " x ", "<y>"]]


def test_seed_files_have_their_header(spark, tmp_path):
    path = put(tmp_path / "s.csv", "era,anchor\nearly,1995-01-01\n")
    assert [(a, str(b)) for a, b in rows(formats.seed_csv(spark, path, "era string, anchor date"))] == [("early", "1995-01-01")]
    with pytest.raises(Exception, match="(?i)header|malformed|FAILED"):
        formats.seed_csv(spark, path, "anchor date, era string").collect()


def test_publish_and_write_once(spark, tmp_path):
    root = str(tmp_path)
    first = store.publish(spark.range(2), root, "t")
    second = store.publish(spark.range(5), root, "t")
    assert store.latest(spark, root, "t").count() == 5 and spark.read.parquet(first).count() == 2
    assert store.publish(spark.range(5).repartition(3), root, "t") == second and store.publish(spark.range(5).withColumn("x", F.lit(None).cast("int")), root, "t") != second
    assert store.publish(spark.range(2), root, "t") != second and store.latest(spark, root, "t").count() == 2
    # a pointer that is being written says nothing yet; another writer takes the number after it
    (tmp_path / "t.latest" / f"{5:010d}").touch()
    assert store.latest(spark, root, "t").count() == 2
    assert store.publish(spark.range(7), root, "t") and store.latest(spark, root, "t").count() == 7
    with pytest.raises(FileNotFoundError):
        store.latest(spark, root, "other")
    store.write_once(spark.range(1), f"{root}/once")
    with pytest.raises(Exception, match="already exists"):
        store.write_once(spark.range(1), f"{root}/once")


def test_workbook_cells(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="one" r:id="r1"/><sheet name="two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>year</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="B2"><v>3.5</v></c><c r="AA2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {main}><sheetData/></worksheet>")
    got = [r["cells"] for r in formats.workbook(spark, str(tmp_path / "w.xlsx")).orderBy("row").collect()]
    assert got == [["year", None, "ab"], [None, "3.5", *[None] * 24, "x"]]
    assert formats.workbook(spark, str(tmp_path / "w.xlsx"), "two").count() == 0


def test_registry(spark, tmp_path):
    pytest.importorskip("yaml")
    path = put(tmp_path / "q.yaml", "questions:\n  - id: a\n    deadline: 2099-01-01\n  - id: b\n    deadline: null\n")
    assert rows(formats.registry(spark, path, "id string, deadline string")) == [("a", "2099-01-01"), ("b", None)]
