from pyspark.sql import functions as F

from lexgrid.operators import classify, documents as D, sequences as S

COLUMNS = "doc string, seq int, page int, block int, line int, span int, id string, text string, bold boolean, superscript boolean, y0 double, block_y0 double"


def flat(spark, rows):
    """rows: page, block, text, bold, superscript."""
    full = [("d", i, p, b, 0, i, f"page-{p}.block-{b}.line-0.span-{i}", t, bold, sup, 200.0, 200.0) for i, (p, b, t, bold, sup) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def test_nearest_labels(spark):
    rows = [(0, 3, "7", False, False), (0, 3, "RS", False, False), (0, 4, "832.20", True, False), (0, 6, "101", True, False), (1, 0, "FF", False, False), (1, 0, "1997", True, False)]
    f = flat(spark, rows)
    refs = D.references(f, D.elements(f)).orderBy("seq").collect()
    assert [r.type for r in refs] == ["RS", None, "FF"]
    annex = D.references(f, D.elements(f), annex=F.lit(True)).orderBy("seq").collect()
    assert annex[0].fn_number == "7" and refs[0].fn_number is None


def test_suffix_digits_and_sections(spark):
    rows = [
        (0, 0, "Federal Act", True, False), (0, 1, "intro text", False, False), (0, 2, "Art. 1", True, False), (0, 2, "Scope", True, False), (0, 2, "it holds", False, False), (0, 2, "1", False, True),
        (0, 3, "1", False, False), (0, 3, "RU", False, False), (0, 3, "1999", True, False), (0, 3, " ", False, False), (0, 3, "1321", False, False), (1, 0, "RU 1999", False, False), (1, 4, "II", False, False), (1, 4, "more", False, False),
    ]
    f = flat(spark, rows)
    found = D.elements(f)
    title, marks, refs = D.title(found), D.markers(found), D.references(f, found)
    assert title.first().title == "Federal Act"
    assert [(r.marker, r.title) for r in marks.orderBy("seq").collect()] == [("Art. 1", "Scope"), ("II", "")]
    r = refs.where("type = 'RU'").first()
    assert (r.type, r.text, r.fn_number) == ("RU", "1999 1321", "1")
    out = {x.marker: x for x in D.sections(f, marks, title, refs).collect()}
    assert out["Preamble"].text == "intro text"
    assert "[FN_1]" in out["Art. 1"].text and out["Art. 1"].fn_indexes == [1]
    assert "1321" not in out["Art. 1"].text


def test_number_fold(spark):
    for values, kept, gap in (([1, 2, 2, 3, 7, 20, 8], [1, 2, 3, 7, 8], True), ([5, 6], [], False), ([4, 5, 6], [4, 5, 6], True)):
        a, g = S.accepted(F.col("v"))
        r = spark.createDataFrame([(values,)], "v array<int>").select(a.alias("a"), g.alias("g")).first()
        assert r.a == kept and r.g == gap


def test_annex_parts(spark):
    rows = [(0, 0, "body", False, False), (1, 0, "Anhang", False, False), (1, 0, "2", False, False), (1, 1, "x", False, False), (2, 0, "Anhang IV", False, False), (3, 0, "Anhang", False, False)]
    f = flat(spark, rows).withColumn("block_y0", F.lit(100.0))
    got = [(r.part, r.suffix) for r in D.annex_parts(f).orderBy("seq").collect()]
    assert got == [(0, None), (1, "2"), (1, "2"), (1, "2"), (2, "IV"), (3, "3")]


def test_document_classes(spark):
    head = "Titolo\nIl Consiglio ordina:\n"
    texts = {"Base": "Art. 1\nx\nArt. 2\ny", "Modification": "I\nx\nII\ny", "Unknown": "plain words only"}
    df = spark.createDataFrame([(k, head + v) for k, v in texts.items()] + [("Modification", head + "La legge è modificata come segue:\nArt. 1"), ("Unknown", " \n"), ("Modification", head + "1. Legge federale\n2. Codice civile")], "want string, text string")
    assert all(r.want == r["class"] for r in D.document_classes(df).collect())
    early = {r.text: r["class"] for r in D.document_classes(df, whole=False).collect()}
    assert early[head + texts["Base"]] == "Base" and early[head + texts["Modification"]] == "Modification"


def test_quality_report(spark):
    finals = spark.createDataFrame([("d", "I", "t", "x", [1, 2]), ("d", "I", "", " ", [])], "doc string, marker string, title string, text string, fn_indexes array<int>")
    refs = spark.createDataFrame([("d", "1", "RU"), ("d", "4", None)], "doc string, fn_number string, type string")
    got = {r.issue: r.n for r in D.quality_report(finals, refs).collect()}
    assert got == {"empty text": 1, "missing title": 1, "duplicate marker": 1, "missing type": 1, "footnote without reference": 1, "reference without footnote": 1, "gap": 1}


def test_classification_chain(spark):
    sections = spark.createDataFrame([("d", "Art. 1", "abrogato [FN_1] qui", [1])], "doc string, marker string, text string, fn_indexes array<int>")
    refs = spark.createDataFrame([("d", 0, "1", "RU", "1999 3"), ("d", 1, "1", "FF", "FF 2000 1")], "doc string, place int, fn_number string, type string, text string")
    decided = spark.createDataFrame([("RU 1999 3", None)], "code string, decision_date date")
    prompts = classify.prompts(sections, refs, decided)
    assert prompts.first().target == "RU 1999 3"
    labelled = classify.label_maps(classify.predict(prompts, "prompt"))
    assert labelled.first().fn_labels == {"1": "ABROGATES"}
    edges = {(e.src, e.rel_type, e.dst) for e in classify.citations(labelled, refs).collect()}
    assert edges == {("d/Art. 1", "ABROGATES", "RU 1999 3"), ("d/Art. 1", "ABROGATES", "FF 2000 1")}


def test_citations_of_whole_acts(spark):
    """What the chain of single steps gives, from acts as they are: several references of a number, numbers without one, missing parts."""
    from lexgrid.plans import trees  # noqa: F401
    from lexgrid.plans.registry import QUERIES

    data = [
        ("d", [("Art. 1", "abrogato [FN_1] qui, modificato [FN_2]", [1, 2]), ("Art. 2", "introdotto [FN_3]", [3, 9]), ("Art. 3", None, None)], [(1, "1", "FF", "FF 2000 1"), (0, "1", "RU", "1999 3"), (2, "2", None, "x"), (3, "3", "RS", "1.2"), (4, None, "RU", "4")]),
        ("e", [("Art. 1", "vedi [FN_1]", [1])], [(0, "1", "RU", "1999 3")]), ("f", [], None), ("g", None, [(0, "1", "RU", "5")]),
    ]
    acts = spark.createDataFrame(data, "doc string, sections array<struct<marker:string,text:string,fn_indexes:array<int>>>, references array<struct<place:int,fn_number:string,type:string,text:string>>")
    decided = spark.createDataFrame([("RU 1999 3", None)], "code string, decision_date date")
    sections, refs = acts.select("doc", F.inline("sections")), acts.select("doc", F.inline("references"))
    want = classify.citations(classify.label_maps(classify.predict(classify.prompts(sections, refs, decided), "prompt")), refs).collect()
    got = classify.cited(acts, decided).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 5
    plan = QUERIES["x12_act_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("Exchange hashpartitioning" in x for x in plan) <= 4 and sum("ArrowEvalPython" in x for x in plan) == 1


def test_footers(spark):
    rows = [("d", 0, 0, 30.0, 700.0, "1 First note of all"), ("d", 0, 1, 60.0, 720.0, "goes on here"), ("d", 0, 2, 31.0, 740.0, "2 Second note text"), ("d", 0, 3, 30.0, 100.0, "9 Not a footnote")]
    df = spark.createDataFrame(rows, "doc string, page int, block int, x0 double, y0 double, text string")
    r = D.footers(df, F.lit(1000.0)).first()
    assert r.numbers == [1, 2] and r.footnotes[0] == "1 First note of all goes on here"


def test_sections_without_joins(spark):
    """Trees of all sorts of spans, with several pages, repeated and missing marks: read() gives what the separate steps give."""
    import random

    words = ["Act", " Federal ", "Art. 1", "Art. 2b", "II", "3. Scope", "RU", "RS", "FF", "1999", "832.20", "7", "1", "12", " ", "", "RU 1999", "plain"]
    draw = random.Random(5)
    rows = []
    for d in range(60):
        seq = 0
        for p in range(draw.randint(1, 3)):
            for b in range(draw.randint(1, 5)):
                for i in range(draw.randint(1, 4)):
                    rows.append((f"d{d}", seq, p, b, 0, i, f"{p}-{b}-{i}", draw.choice(words), draw.random() < 0.5, draw.random() < 0.3, draw.choice([50.0, 200.0]), 200.0))
                    seq += 1
    f = spark.createDataFrame(rows, COLUMNS)
    found = D.elements(f)
    apart = D.sections(f, D.markers(found), D.title(found), D.references(f, found))
    columns = ["doc", "at", "marker", "title", "text", "fn_indexes"]
    got, want = (sorted(map(str, x.select(columns).collect())) for x in (D.read(f), apart))
    assert got == want and any("Content" in x for x in got) and any("FN_" in x for x in got)


def test_acts_are_shuffled_narrow(spark):
    """Only line items and acts are shuffled, not spans; and the rows of an act are sorted by place once."""
    from lexgrid.plans import trees  # noqa: F401
    from lexgrid.plans.registry import QUERIES

    for name in ("x1_annex_parts", "x5_markers", "x6_references", "x7_act_sections", "w4_title"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
        assert sum(" Exchange" in x for x in plan) <= 2 and sum("Sort [doc" in x and "page" in x for x in plan) == 1, name
