import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lexgrid.sources import files, sinks, xml
from lexgrid.streaming import streams

ACT = """<akomaNtoso xmlns="urn:x"><act><meta><identification><FRBRWork><FRBRuri value="/oc/1"/><FRBRdate date="1999-04-18"/></FRBRWork></identification></meta>
<body><level eId="c1"><num/><heading>General</heading><level eId="c1/a1"><num>Art. 1</num><p>Text<b>bold</b> <ref href="/a">a</ref>
<authorialNote><p>note <ref href="/b">b</ref><ref href="/a">a</ref><ref href="/b">b</ref></p></authorialNote> end</p><blockList><listIntroduction>of</listIntroduction><item>x<br/>y</item></blockList></level>
</level><level><p>without id</p></level></body></act>
<components><component><doc name="annex"><preface><h1>Annex <i>A</i></h1></preface><mainBody><p>first<authorialNote><ref href="/c"/></authorialNote></p><level eId="z"><p>later<authorialNote><ref href="/d"/></authorialNote></p></level><p>cut</p></mainBody></doc></component>
<component><doc name="annex"><preface><container><block name="num"><num>2</num></block></container></preface><body><p>second</p></body></doc></component></components></akomaNtoso>"""


def test_xml(spark):
    got = xml.parse_sections(ACT)
    assert [(s["id"], s["title"], s["references"]) for s in got] == [
        ("annex_1", "Annex A", ["/c"]), ("annex_2", "2", []), ("c1", "General", []), ("c1/a1", "Art. 1", ["/b", "/a"]), ("z", "Level z", ["/d"]),
    ]
    assert [s["text"] for s in got] == ["first", "second", "General", "Art. 1\n\nText bold a end\n\nof\nx\ny", "later"]
    assert xml.parse_sections("<broken") == [] and xml.parse_sections(None) == []
    df = spark.createDataFrame([(ACT,), (None,), ("<broken",)], "xml string")
    assert xml.sections(df).count() == 3
    r = xml.metadata(df.limit(1)).first()
    assert (r.law_url, r.decision_date) == ("/oc/1", "1999-04-18")


def test_acts_parse_each_row_once(spark):
    """One tree gives metadata and sections, also under the filter that goes with an explode of the sections."""
    df = spark.createDataFrame([(ACT,), ("<broken",), (None,)], "xml string")
    acts = xml.acts(df)
    flat = acts.select("law_url", F.explode("sections").alias("s"))
    assert flat._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [s.asDict() for s in acts.first().sections] == xml.parse_sections(ACT)
    assert [(r.law_url, r.decision_date) for r in acts.collect()] == [tuple(xml.parse_metadata(x).values()) for x in (ACT, "<broken", None)]
    assert flat.count() == len(xml.parse_sections(ACT))


def test_json_documents_and_broken_files(spark, tmp_path):
    (tmp_path / "Leggi").mkdir()
    (tmp_path / "Leggi" / "a.json").write_text(json.dumps({"source_file": "a", "sections_list": [{"marker": "I"}]}))
    (tmp_path / "Leggi" / "b.json").write_text("{broken")
    rows = {r.file: r for r in files.json_documents(spark, str(tmp_path)).collect()}
    assert rows["a.json"].category == "Leggi" and rows["a.json"].sections_list[0].marker == "I"
    assert rows["b.json"]._corrupt_record is not None


def test_required_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"""\nrs , uri\n1.1,u\n')
    assert files.dict_rows(spark, str(tmp_path / "x.csv"), ["rs"]).first().asDict() == {"rs": "1.1", "uri": "u"}
    with pytest.raises(ValueError):
        files.dict_rows(spark, str(tmp_path / "x.csv"), ["other"])


def test_row_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 100,) for i in range(100)], "k int")
    rows = files.numbered(df, "k").collect()
    assert sorted((r.k, r._row) for r in rows) == [(i, i) for i in range(100)]


def test_snapshots(spark, tmp_path):
    store = sinks.SnapshotStore(spark, str(tmp_path / "s"))
    assert store.runs() == []
    store.save("1", {"t": spark.range(1)})
    store.save("2", {"t": spark.range(2)})
    assert store.load("t").count() == 2 and store.load("t", "1").count() == 1
    store.save("10", {"t": spark.range(10)})
    assert store.load("t").count() == 10
    store.save("9", {"t": spark.range(9)})
    assert store.load("t").count() == 9


def test_report_says_what_it_leaves_out(spark):
    text = sinks.report("Numbers", spark.range(5), 3)
    assert text.splitlines()[2:] == ["id", "0", "1", "2", "(2 more rows)"]
    assert "more" not in sinks.report("Numbers", spark.range(3), 3)


def test_deep_markup():
    deep = "<a>" + "<level eId='x'>" * 5000 + "<p>x</p>" + "</level>" * 5000 + "</a>"
    assert xml.parse_sections(deep)[-1]["text"] in ("", "x") and len(xml.parse_sections(deep)) == 5000


def test_stream_upsert_and_windows(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, v string, o int"
    for rows in ([("a", "1", 1), ("a", "2", 2)], [("a", "3", 3), ("b", "1", 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(streams.upsert_into(target, "k", "o", ["k", "v"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        stream.awaitTermination(120)
    final = streams.current(spark, target, spark.createDataFrame([], "k string, v string").schema)
    assert sorted(map(tuple, final.collect())) == [("a", "1"), ("b", "1")]
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1), "x", 1.0, 1), (dt.datetime(2024, 1, 1, 1, 10), "x", 2.0, 1), (dt.datetime(2024, 1, 2), "x", 4.0, 1)], "ts timestamp, event_type string, value double, user_id int")
    assert sorted(r.total for r in streams.windowed(events).collect()) == [3.0, 4.0]
    assert sorted(r.n for r in streams.sessions(events).collect()) == [1, 2]
