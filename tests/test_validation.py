"""Citations of sections and drafts."""

from scholium.operators import validation

REPORT = ("valid", "invalid", "uncited", "markers", "unique_markers")


def reports(frame, key):
    return {r[key]: tuple(r[c] for c in REPORT) for r in frame.collect()}


def test_sections_with_and_without_markers(spark):
    rows = [
        ("1", "A [@p1] and [@p2], again [@p1].", ["p1", "p2"]),
        ("2", "Nothing is cited.", ["p3", "p1", "p1"]),
        ("3", "Ghost [@x9] [@p1] [@b]", ["p2"]),
        ("4", None, None),
        ("5", "", []),
        ("6", "[@] [@ p1] [@p1", ["p1"]),
    ]
    known = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p1",)], "id string")
    found = reports(validation.validate_sections(spark.createDataFrame(rows, "section string, text string, assigned array<string>"), known, ["section"]), "section")
    assert found == {
        "1": (["p1", "p2"], [], [], 3, 2),
        "2": ([], [], ["p1", "p1", "p3"], 0, 0),
        "3": (["p1"], ["b", "x9"], ["p2"], 3, 3),
        "4": ([], [], [], 0, 0),
        "5": ([], [], [], 0, 0),
        "6": ([], [" p1"], ["p1"], 1, 1),
    }


def test_drafts_report_every_paper_that_is_never_cited(spark):
    drafts = spark.createDataFrame([("r", "[@p1] [@q]"), ("s", "none"), ("t", None)], "review string, text string")
    known = spark.createDataFrame([("r", "p1"), ("r", "p2"), ("s", "p1"), ("s", "p0"), ("s", "p0")], "review string, id string")
    assert reports(validation.validate_drafts(drafts, known, "review"), "review") == {"r": (["p1"], ["q"], ["p2"], 2, 2), "s": ([], [], ["p0", "p1"], 0, 0), "t": ([], [], [], 0, 0)}


def test_issues(spark):
    sections = spark.createDataFrame([("1", "[@x]", ["p1"]), (None, "[@p1]", ["p1"])], "section string, text string, assigned array<string>")
    known = spark.createDataFrame([("p1",)], "id string")
    found = validation.issues(validation.validate_sections(sections, known, ["section"]), "section").collect()
    assert [(r.location, r.severity) for r in found] == [("1", "critical"), ("1", "major")]
    assert found[0].description == "[@x] cites a paper that is not in the corpus"
    assert validation.issues(validation.validate_sections(sections.limit(0), known, ["section"]), "section").collect() == []
