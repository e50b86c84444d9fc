import random
import re

from pyspark.sql import functions as F

from scholium.functions import references, text
from scholium.functions.text import STOPWORDS
from scholium.operators import answers, matching, metrics, rounds, trees
from scholium.operators.joins import indel_ratio
from scholium.sources import snapshots


def norm(ref):
    parts = re.split(r"\.\s+", re.sub(r"^\[?\d+[\]\.]\s*", "", ref), maxsplit=2)
    words = re.sub(r"[^\w\s]", " ", (parts[1] if len(parts) > 1 else parts[0]).lower()).split()
    return sorted(w for w in words if w not in STOPWORDS and len(w) > 1)


def doi(ref):
    found = re.search(r"10\.\d{4,}/\S+", ref)
    return found and found[0].lower().rstrip(".,;)")


def alike(a, b):
    if doi(a) and doi(a) == doi(b):
        return True
    x, y = norm(a), norm(b)
    union = set(x) | set(y)
    return bool(union) and len(set(x) & set(y)) / len(union) >= 0.45 or indel_ratio(" ".join(x), " ".join(y)) >= 80


def brute(made, wanted):
    takes = lambda r: bool(norm(r) or doi(r))
    lost = lambda xs, ys: [x for x in xs if takes(x) and not any(alike(x, y) for y in ys)]
    kept = lambda xs, ys: sum(takes(x) and any(alike(x, y) for y in ys) for x in xs)
    p = kept(made, wanted) / len(made) if made else 0.0
    r = kept(wanted, made) / len(wanted) if wanted else 0.0
    return round(p, 4), round(r, 4), round(2 * p * r / (p + r) if p + r else 0.0, 4), "\n".join(lost(wanted, made)), "\n".join(lost(made, wanted))


def test_match_citations_equals_brute_force(spark):
    rng = random.Random(5)
    words = "gut axis brain river growth ab ac acb cell deep model flow drought of the".split()

    def title():
        made = " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
        return "".join(rng.choice("abe") if rng.random() < 0.08 else c for c in made)

    def ref(i):
        return f"[{i}] Doe J. {title()}. J." + (f" 10.1234/{rng.choice('AaBb')}{rng.randint(1, 9)}." if rng.random() < 0.3 else "")

    lists = {r: ([ref(i) for i in range(rng.randint(0, 9))], [ref(i) for i in range(rng.randint(0, 9))]) for r in range(60)}
    lists[60] = (["[1] A. Deep models. J.", "[2] A. Deep models. J."], ["[1] B. Deep model. J."])
    rows = lambda k: spark.createDataFrame([(r, i, x) for r, v in lists.items() for i, x in enumerate(v[k])], "review int, id int, ref string")
    got = {r.review: (r.precision, r.recall, r.f1, r.missed, r.hallucinated) for r in matching.match_citations(rows(0), rows(1)).collect()}
    assert got == {r: brute(*v) for r, v in lists.items() if v[0] or v[1]}
    assert got[60][1] == 1.0
    for r in matching.match_citations(rows(0), rows(1)).collect():
        usable = [x for x in lists[r.review][1] if x not in r.missed.split("\n")]
        assert [x for x in usable if x in r.matched] == r.matched and len(r.matched) == r.matched_count
    empty = rows(0).limit(0)
    assert matching.match_citations(empty, empty).count() == 0


def test_reference_lines(spark):
    lines = ["[1] Doe J. The gut axis in mice. Nature 2020. doi:10.1038/S41586-023.", "3. Roe. Short. Another title of words. Cell", "plain", "A. B. C. D. E", "", None, "x https://doi.org/10.1000/abc), see"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, ref string")
    c = F.col("ref")
    got = {r.i: r for r in rows.select("i", references.listed_doi(c).alias("doi"), references.matched_doi(c).alias("key"), references.likely_title(c).alias("title"), references.second_part(c).alias("part")).collect()}
    assert (got[0].doi, got[0].key, got[0].title, got[0].part) == ("10.1038/S41586-023", "10.1038/s41586-023", "The gut axis in mice", "The gut axis in mice")
    assert got[1].title == "Another title of words" and got[1].part == "Short"
    assert got[2].title == got[2].part == "plain" and got[3].title == "D" and got[4].title == ""
    assert got[5].doi is None and got[5].title is None and got[6].key == "10.1000/abc),".rstrip(".,;)")


def test_answers(spark):
    texts = spark.createDataFrame([(1, "[1][2]. It grows [2]! Then (2019) in [1] and [3]. Last [1]."), (2, None)], "k int, text string")
    got = {(r.k, r.idx): r.context for r in answers.contexts(texts, "k", "text").collect()}
    assert got == {(1, 1): ".", (1, 2): ".", (1, 3): "Then (2019) in  and ."}
    cited = spark.createDataFrame([(1, 3, " http://x.org/a/gut-microbiome-study.html "), (1, 1, "http://x.org/1/12345"), (1, 9, "http://doi.org/10.1234/long-slug-here.")], "k int, idx int, url string")
    got = {r.idx: (r.title, r.year, r.doi) for r in answers.papers(cited, answers.contexts(texts, "k", "text"), "k").collect()}
    assert got[3] == ("Gut Microbiome Study", 2019, None) and 1 not in got and got[9][2] == "10.1234/long-slug-here"


def test_rounds(spark):
    old = spark.createDataFrame([("a", "x"), ("a", "x")], "db string, q string")
    new = spark.createDataFrame([("a", "y"), ("a", "y"), ("a", "x"), ("b", "z")], "db string, q string")
    assert sorted(map(tuple, rounds.append_absent(old, new, "db", "q").collect())) == [("a", "x"), ("a", "x"), ("a", "y"), ("a", "y")]
    gaps = spark.createDataFrame([(1, "minor", 0.9, ["q"]), (1, "major", 0.9, ["r"]), (2, "minor", 0.8, ["q"])], "topic int, severity string, coverage double, queries array<string>")
    found = spark.createDataFrame([(1, "q", 7, "10.1/X "), (1, "r", 8, None), (1, "s", 9, None), (2, "q", 7, "10.1/new")], "topic int, query string, id int, doi string")
    corpus = spark.createDataFrame([(1, 5, "10.1/x"), (2, 6, None)], "topic int, id int, doi string")
    assert sorted((r.topic, r.id, r.added) for r in rounds.gap_round(gaps, found, corpus, "topic").collect()) == [(1, 5, False), (1, 8, True), (2, 6, False)]


def test_assembled_draft(spark):
    sections = spark.createDataFrame([(1, "1", None, 0, "A"), (1, "1.1", "1", 0, "B"), (1, "2", None, 1, "C"), (1, "2.1", "2", 0, "D"), (1, "2.1.1", "2.1", 0, "E")], "doc int, section string, parent string, pos int, title string")
    drafts = spark.createDataFrame([(1, "1.1", "text b"), (1, "2.1.1", "text e")], "doc int, section string, text string")
    documents = spark.createDataFrame([(1, "T"), (2, "U")], "doc int, title string")
    got = {r.doc: r.draft for r in trees.assemble(documents, sections, drafts).collect()}
    assert got[1] == "# T\n\n\n## A\n\n### B\n\ntext b\n\n### D\n\n#### E\n\ntext e"
    assert got[2] == "# U\n"


def test_snapshots(spark, tmp_path):
    papers = spark.createDataFrame([(1, "s2", "long"), (2, "s1", None), (3, "s2", None)], "id int, source_database string, full_text string")
    folder = str(tmp_path / "snap")
    snapshots.save({"papers": papers}, folder, "search", "20200101T000000")
    path = snapshots.save({"papers": papers.filter("id > 1")}, folder, "screening", "20200102T000000")
    got = snapshots.latest(spark, folder)["papers"]
    assert path.endswith("20200102T000000_screening") and got.columns == ["id", "source_database"] and sorted(r.id for r in got.collect()) == [2, 3]
    assert [r.line for r in snapshots.search_summary(papers, "ok").collect()] == ["# search\n\n**Summary**: ok\n\n- Candidates: 3", "  - s1: 1", "  - s2: 2"]
    assert [r.line for r in snapshots.search_summary(papers.limit(0), "ok").collect()] == ["# search\n\n**Summary**: ok\n\n- Candidates: 0"]
    for run, body in (("run a", '{"model": "m", "input_tokens": 1000000, "output_tokens": 2000000}'), ("b", '{\n"input_tokens": 5}')):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "token_usage.json").write_text(body)
    got = {r.label: (r.model, r.tokens_in, r.cost) for r in snapshots.usage_costs(spark, f"{tmp_path}/runs/*/token_usage.json", [("m", 3.0, 15.0)]).collect()}
    assert got == {"run a": ("m", 1000000, 33.0), "b": ("unknown", 5, 0.0)}


def test_small_lookups(spark, tmp_path):
    dois = ["10.1016/j.x", "10.1038/s41", "10.1101/2020", "10.1/x", None, "10.10166/x"]
    assert [r[0] for r in spark.createDataFrame([(d,) for d in dois], "d string").select(text.publisher(F.col("d"))).collect()] == ["elsevier", "springer", "biorxiv", None, None, None]
    assert [r[0] for r in spark.createDataFrame([("1",), ("1.2.3",), (None,)], "n string").select(text.outline_depth(F.col("n"))).collect()] == [1, 3, None]
    sections = spark.createDataFrame([("d", "1", None, 0), ("d", "1.1", "1", 0), ("d", "2", None, 1)], "doc string, section string, parent string, pos int")
    wanted = spark.createDataFrame([("d", "2"), ("d", "9"), ("e", "1")], "doc string, section string")
    assert [tuple(r) for r in trees.find_section(sections, wanted).collect()] == [("d", "2", 1, 3)]
    nodes = spark.createDataFrame([("search", "done", 1.5), ("screening", "running", None)], "name string, status string, seconds double")
    snapshots.save_progress(nodes, f"{tmp_path}/progress", "a topic", "2026-01-01", "screening")
    read = spark.read.json(f"{tmp_path}/progress").first()
    assert (read.topic, read.current_node, read.nodes.search.seconds, read.nodes.screening.status) == ("a topic", "screening", 1.5, "running")


def test_inverted_index_within_the_row(spark):
    rows = [("b a b c a b",), ("",), (None,), ("x",)]
    words = F.split("t", " ")
    found = spark.createDataFrame(rows, "t string").select(text.inverted_index(words).alias("i")).withColumn("back", F.array_join(text.from_index(F.col("i")), " ")).collect()
    assert [(e.word, e.places) for e in found[0].i] == [("a", [1, 4]), ("b", [0, 2, 5]), ("c", [3])]
    assert [r.back for r in found] == ["b a b c a b", "", None, "x"]


def test_reading_grade_against_plain_counts(spark):
    v, c = text.VOWELS, text.CONSONANTS

    def syllables(word):
        if not re.search(f"[{v}]", word):
            return 1
        ends = (f"[{v}][{c}]+e$", f"[{c}]le$"), (f"[{v}][{c}]+es$", "[sxzcgh]es$"), (f"[{v}][{c}]+ed$", "[td]ed$")
        return len(re.findall(f"[{v}]+", word)) - any(re.search(a, word) and not re.search(b, word) for a, b in ends)

    for word, n in (("the", 1), ("table", 2), ("whale", 1), ("jumped", 1), ("wanted", 2), ("boxes", 2), ("makes", 1), ("hmm", 1), ("idea", 2), ("élève", 2)):
        assert syllables(word) == n, word
    texts = ["The whale jumped. It was a table of wanted boxes! Hmm, makes no sense?", "One.", "", None, "Élève très sage et des idées. Straße und Öl.", "a b c. d e f g"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(metrics.reading_grade(F.col("t"))).collect()]
    for t, grade in zip(texts, got, strict=True):
        words = re.findall(text.LETTERS, t or "")
        sentences = max(1, sum(len(re.findall(text.LETTERS, s)) > 2 for s in re.findall("[^.!?]+", t or "")))
        want = round(0.39 * len(words) / sentences + 11.8 * sum(syllables(w.lower()) for w in words) / len(words) - 15.59, 2) if words else 0.0
        assert (grade or 0.0) == want, t
