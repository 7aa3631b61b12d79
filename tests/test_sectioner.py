from lexgrid.operators import sectioner

COLUMNS = "doc string, page int, block int, y0 double, height double, text string"


def test_sections_with_linked_notes(spark):
    rows = [
        ("d", 0, 0, 10.0, 1000.0, "Legge federale1\n  del  18 aprile 19992 \n"),
        ("d", 0, 1, 20.0, 1000.0, "Art. 1.2 Scopo\nvale3, e 500 no600."),
        ("d", 0, 2, 900.0, 1000.0, "1 Nota una\nsegue"),
        ("d", 0, 3, 910.0, 1000.0, "² Nota due\n3 Nota una segue"),
        ("d", 1, 0, 20.0, 1000.0, "IV\ntesto1\nCapitolo II Fine3"),
        ("d", 1, 1, 900.0, 1000.0, "piede senza numero\n1 altra"),
        ("e", 0, 0, None, None, "  \n"),
        ("f", 0, 0, None, None, None),
    ]
    got = {(r.doc, r.at): (r.marker, r.title, r.text, r.notes) for r in sectioner.sections(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {
        ("d", 0): ("Preamble", "Preamble", "Legge federale1\ndel 18 aprile 1999", ["Nota una segue", "Nota due"]),
        # The 2 of a heading's 1.2 stands at the end of a word, so it is a mark too; of equal notes one is listed.
        ("d", 1): ("Art_1_2", "Art. 1.2 Scopo", "Art. 1.2 Scopo\nvale3, e 500 no600.", ["Nota due", "Nota una segue"]),
        ("d", 2): ("Roman_IV", "IV", "IV\ntesto1", ["altra"]),
        # A block of the foot that starts before the page's first note stays in the text, its note as well.
        ("d", 3): ("Capitolo_II", "Capitolo II Fine3", "Capitolo II Fine3\npiede senza numero\n1 altra", []),
    }


def test_no_blocks(spark):
    assert sectioner.sections(spark.createDataFrame([], COLUMNS)).count() == 0


def test_last_text_of_a_number_and_ties(spark):
    rows = [("d", 0, 0, 10.0, 1000.0, "Art. 1\nx1"), ("d", 0, 0, 10.0, 1000.0, "Art. 1\nx1"), ("d", 0, 5, 950.0, 1000.0, "1 old\n1 new\n1\n2 "), (None, 0, 0, 1.0, 1000.0, "y")]
    got = sorted((r.doc or "", r.at, r.notes) for r in sectioner.sections(spark.createDataFrame(rows, COLUMNS)).collect())
    assert [g for g in got if g[0]][-1][2] == ["new"] and ("", 0, []) in got


def test_documents_are_dealt_out_once(spark):
    """No join, and one shuffle, by document; without links the same sections."""
    rows = [("d", 0, 0, 10.0, 1000.0, "intro\n\nArt. 1\nx1"), ("d", 0, 1, 900.0, 1000.0, "foot\n1 note"), ("d", 0, 2, 910.0, 1000.0, "2 more"), ("e", 0, 0, 900.0, 1000.0, "1 only a note")]
    both = [sectioner.sections(spark.createDataFrame(rows, COLUMNS), linked=x) for x in (True, False)]
    plan = both[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    linked, plain = ([tuple(r) for r in df.orderBy("doc", "at").collect()] for df in both)
    assert [r[:5] for r in linked] == plain == [("d", 0, "Preamble", "Preamble", "intro"), ("d", 1, "Art_1", "Art. 1", "Art. 1\nx1\nfoot\n1 note")]
    assert [r[5] for r in linked] == [[], ["note"]]
