"""The expectations of FIXTURES.md, restated on small frames."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholium.functions import bibliography, text
from scholium.operators import dedup, joins, metrics, ordered, resolution, sections, trees
from scholium.sources import markup, records
from scholium.sources.recorded import recorded

PAPER = "pos int, title string, doi string, abstract string, year int, citation_count int, source_database string"


def values(spark, column, rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_title_and_doi_keys(spark):
    assert values(spark, text.title_key(F.col("v")), ["Hello World!", "A test: with, punct.", "  too   many   spaces  ", "café résumé", None]) == ["hello world", "a test with punct", "too many spaces", "cafe resume", None]
    assert values(spark, text.doi_key(F.col("v")), [" HTTPS://DOI.org/10.1/X", "http://dx.doi.org/10.1/y", "", None, "10.2/Z"]) == ["10.1/x", "10.1/y", None, None, "10.2/z"]


@pytest.mark.parametrize(("given_range", "want"), [("2015-2025", (2015, 2025)), ("-2020", (None, 2020)), ("2020-", (2020, None)), ("", (None, None)), (None, (None, None))])
def test_year_ranges(given_range, want):
    assert dedup.parse_year_range(given_range) == want


@pytest.mark.parametrize("wrong", ["2025-2015", "-", "abc", "20a-2020"])
def test_wrong_year_ranges(wrong):
    with pytest.raises(ValueError, match="year"):
        dedup.parse_year_range(wrong)


def test_year_filter(spark):
    rows = spark.createDataFrame([(y,) for y in (2010, 2015, 2018, 2020, 2030, None)], "year int")
    kept = lambda low, high: [r.year for r in dedup.year_range(rows, low, high).collect()]
    assert kept(2015, 2020) == [2015, 2018, 2020]
    assert kept(None, None) == [2010, 2015, 2018, 2020, 2030, None]


def test_merge_fills_and_groups(spark):
    rows = [
        (0, "A", "https://doi.org/10.1/X", None, None, None, "s1"), (1, "A b", "10.1/x", "An abstract", 2023, 10, "s2"), (2, "a", None, "dropped", 1, 1, "s3"),
        (3, "Other", None, "", None, 5, "s1"), (4, "OTHER!", "", "later", 2000, None, "s2"), (5, "A", "10.1/z", None, None, None, "s1"),
    ]
    got = sorted(tuple(r) for r in dedup.merge_papers(spark.createDataFrame(rows, PAPER)).select("first_pos", "title", "abstract", "year", "citation_count", "source_database", "n_merged").collect())
    assert got == [(0, "A", "An abstract", 2023, 10, "s1", 2), (3, "Other", "", 2000, 5, "s1", 2), (5, "A", None, None, None, "s1", 1)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["10.1/a", "10.1/B", "", None]), st.sampled_from(["T", "t!", "U", "V"])), max_size=12))
def test_merge_properties(spark, rows):
    papers = spark.createDataFrame([(i, t, d, None, None, None, "s") for i, (d, t) in enumerate(rows)], PAPER)
    once = dedup.merge_papers(papers)
    got = once.collect()
    assert len({r.merge_key for r in got if r.doi}) == len([r for r in got if r.doi])
    again = dedup.merge_papers(once.withColumn("pos", F.col("first_pos").cast("int")).select("pos", "title", "doi", "abstract", "year", "citation_count", "source_database"))
    assert sorted(r.merge_key for r in again.collect()) == sorted(r.merge_key for r in got)
    mixed = dedup.merge_papers(papers.repartition(3))
    assert sorted(map(str, mixed.collect())) == sorted(map(str, got))


def test_maps_and_snowball(spark):
    rows = spark.createDataFrame([("k", 0, {"pmid": "123"}), ("k", 1, {"s2": "abc", "pmid": "9"})], "key string, pos int, ids map<string,string>")
    assert dedup.merge_maps(rows, "key", "ids", "pos").collect()[0].ids == {"pmid": "123", "s2": "abc"}
    refs = spark.createDataFrame([("s", 0, "d1", "One"), ("s", 1, "d2", " ONE "), ("s", 2, "d2", "Two"), ("s", 3, "d1", "Three"), ("s", 4, None, "Four")], "seed string, pos int, doi string, title string")
    assert sorted(r.pos for r in dedup.snowball(refs, "pos").collect()) == [0, 2, 4]


def test_only_new_keeps_missing_keys(spark):
    found = spark.createDataFrame([("10.1/A ",), (None,), ("",), ("x",)], "doi string")
    known = spark.createDataFrame([("10.1/a",), (None,)], "doi string")
    assert sorted(map(str, (r.doi for r in dedup.only_new(found, known, "doi").collect()))) == ["", "None", "x"]


@pytest.mark.parametrize(
    ("scores", "threshold", "most", "delta", "reason"),
    [([0.85], 0.8, 9, 0.02, "threshold"), ([0.8], 0.8, 9, 0.02, "threshold"), ([0.7], 0.8, 9, 0.02, None), ([0.5, 0.6, 0.7], 0.8, 3, 0.02, "max_iterations"), ([0.7, 0.71], 0.8, 9, 0.02, "converged"), ([0.7, 0.72], 0.8, 9, 0.02, None), ([0.75, 0.73], 0.8, 9, 0.02, "converged"), ([], 0.8, 9, 0.02, None)],
)
def test_convergence(spark, scores, threshold, most, delta, reason):
    rows = spark.createDataFrame([("t", i, s) for i, s in enumerate(scores)], "target string, cycle int, score double")
    got = ordered.convergence(rows, "target", "cycle", "score", threshold, most, delta).collect()
    assert [r.reason for r in got] == ([reason] if reason else [])


def test_strength_and_progressions(spark):
    rows = spark.createDataFrame([("c", s) for s in ("strong", "moderate", "moderate", "weak", "odd")] + [("e", "odd"), ("t", "weak"), ("t", "strong")], "chain string, s string")
    got = {r.chain: tuple(r)[1:] for r in metrics.strength_distribution(rows, "chain", "s").collect()}
    assert got == {"c": (1, 2, 1, 0, "moderate"), "e": (0, 0, 0, 0, ""), "t": (1, 0, 1, 0, "strong")}
    years = [("a", y) for y in (2015, 2016, 2017, 2018, 2020, 2021, 2022, 2023)] + [("b", 2015), ("b", 2020)] + [("c", 2015)] * 5
    got = ordered.temporal_split(spark.createDataFrame(years, "theme string, year int"), "theme").collect()
    assert [tuple(r) for r in got] == [("a", 2015, 2023, 8, 4, 4)] or [(r.theme, r.n_early + r.n_late) for r in got] == [("a", 8)]


def test_statistics(spark):
    rows = spark.createDataFrame([(0.8, "x"), (0.9, "x"), (0.7, None)], "recall double, tier string")
    got = {r.tier: tuple(r)[1:] for r in metrics.grouped_stats(rows, "recall", "tier").collect()}
    assert got == {None: (0.8, 0.1, 0.7, 0.9, 3), "x": (0.85, 0.0707, 0.8, 0.9, 2)}
    assert tuple(rows.limit(0).agg(*metrics.stats("recall")).collect()[0]) == (0, 0, 0, 0, 0)


def test_cost(spark):
    usage = spark.createDataFrame([("big", 1_000_000, 100_000), ("free", 5, 5)], "model string, tokens_in long, tokens_out long")
    assert {r.model: r.cost for r in metrics.token_cost(usage, [("big", 3.0, 15.0)]).collect()} == {"big": 4.5, "free": 0.0}


def test_indel_and_resolution(spark):
    assert joins.indel_ratio("", "") == 100 and joins.indel_ratio("abc", "") == 0
    assert joins.indel_ratio("kitten", "sitting") == pytest.approx(100 * 8 / 13)
    refs = spark.createDataFrame([(1, "d1", "x"), (2, "", "deep learning of proteins"), (3, "", "deep learning in protein folds"), (4, "", "nothing alike")], "ref_id int, doi string, title string")
    known = spark.createDataFrame([(9, 0, "d1", "y"), (8, 0, "", "deep learning of proteins")], "paper_id int, source_pos int, doi string, title string")
    got = {r.ref_id: (r.paper_id, r.confidence) for r in resolution.resolve(refs, known).collect()}
    two = spark.createDataFrame([(5, 1, "", "deep learning of proteins"), (6, 0, "", "deep learning on protein")], "paper_id int, source_pos int, doi string, title string")
    assert [(r.paper_id, r.confidence) for r in resolution.resolve(refs.filter("ref_id = 2"), two).collect()] == [(6, "MEDIUM")]  # the first source that has any
    assert got[1] == (9, "HIGH") and got[2] == (8, "MEDIUM") and got[3][1] in ("LOW", "MEDIUM") and got[4] == (None, "NONE")


def test_bands_have_gaps(spark):
    rows = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.25, 0.95)], "s double")
    got = joins.in_band(rows, [(0.0, 0.2, "low"), (0.3, 1.0, "high")], "s").collect()
    assert [(r.anchor, r.next_anchor) for r in got] == [("low", "high"), ("low", "high"), (None, None), ("high", None)]


def test_urls_years_and_json(spark):
    urls = ["https://x.org/articles/gut-microbiome-and-neurodegeneration", "https://x.org/a/dopamine-signaling-pathways.html", "https://x.org/12345678", "https://x.org/deadbeef01", "https://x.org/short", "https://x.org", None]
    assert values(spark, text.slug_title(F.col("v")), urls) == ["Gut Microbiome And Neurodegeneration", "Dopamine Signaling Pathways", None, None, None, None, None]
    assert values(spark, text.url_year(F.col("v")), ["http://a/2023/x", "http://a/2021-05", "http://a/1234/", None]) == [2023, 2021, None, None]
    assert values(spark, text.latest_year(F.col("v")), ["Since 2015, studies (2020, 2023)", "none"]) == [2023, None]
    replies = ['{"a": 1}', 'x\n```json\n{"a": 1}\n```', 'so {"a": 1} it is', "<think>{</think>{\"a\": 1}", "nothing"]
    assert [r and json.loads(r) for r in values(spark, text.json_in_text(F.col("v")), replies)] == [{"a": 1}] * 4 + [None]


def test_numbering_and_continuation(spark):
    docs = spark.createDataFrame([(1, "X [@b] and [@a]. [@b]"), (2, "none")], "doc int, text string")
    got = {r.cited: (r.number, r.mentions) for r in ordered.citation_numbers(docs, "doc", "text").collect()}
    assert got == {"b": (1, 2), "a": (2, 1)}
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["orphan", "[1] first", " goes on", "[2] second"])], "doc int, no int, line string")
    assert [r.text for r in ordered.continued_lines(lines, "doc", "no", "line", r"^\[\d+\]").orderBy("entry").collect()] == ["[1] first goes on", "[2] second"]


def test_bibliography(spark):
    rows = spark.createDataFrame([(["A"], None, "T", None, None), (["A", "B"], 2020, "T", "J", "10.1/x"), ([f"A{i}" for i in range(25)], 2020, "T", None, None), ([], 2020, "T", None, None)], "a array<string>, y int, t string, j string, d string")
    apa = [r[0] for r in rows.select(bibliography.entry("apa", *(F.col(c) for c in "aytjd"))).collect()]
    assert apa[0] == "A (n.d.). T." and apa[1] == "A & B (2020). T. *J*. https://doi.org/10.1/x"
    assert ", ... A24 (2020)" in apa[2] and apa[3] == "Unknown (2020). T."
    vancouver, acs = ([r[0] for r in rows.select(bibliography.entry(s, *(F.col(c) for c in "aytjd"))).collect()] for s in ("vancouver", "acs"))
    assert vancouver[1] == "A, B. 2020. T. J. doi:10.1/x" and vancouver[0] == "A.. T." and vancouver[2].startswith("A0, A1, A2, A3, A4, A5, et al. 2020.")
    assert acs[1] == "A; B. T. *J* **2020**. DOI: 10.1/x" and acs[0] == "A. T.."


def test_markdown_structure(spark):
    assert values(spark, text.strip_markdown(F.col("v")), ["a `code here` b_c __x__ **y** [l](u)"]) == ["a  bc x y l"]
    assert values(spark, text.escape_latex(F.col("v")), ["a^b_~"]) == [r"a\^{}b\_\textasciitilde{}"]
    rows = values(spark, metrics.structure(F.col("v")), ["# One\na b\n## Two\nc d e f [1] [1] (Smith et al., 2020)", "plain words only", " ", None])
    assert [(r.words, r.sections, r.citations, r.avg_section, r.cv_section) for r in rows] == [(14, 2, 2, 7.0, 0.8081), (3, 1, 0, 3.0, 0.0), (0, 0, 0, 0.0, 0.0), (0, 0, 0, 0.0, 0.0)]


def test_merge_of_authors_and_ids(spark):
    rows = [(0, "A", "10.1/x", "s1", [], {"pmid": "1"}, None), (1, "A", "10.1/x", "s2", ["Z"], {"pmid": "2", "s2": "q"}, "J")]
    got = dedup.merge_papers(spark.createDataFrame(rows, "pos int, title string, doi string, source_database string, authors array<string>, external_ids map<string,string>, journal string")).first()
    assert (got.authors, got.external_ids, got.journal) == (["Z"], {"pmid": "1", "s2": "q"}, "J")


def test_outline_of_any_depth(spark):
    rows = [("d", i, i - 1 if i else None, i) for i in range(15)]
    got = trees.outline(spark.createDataFrame(rows, "doc string, section int, parent int, pos int")).orderBy("place").collect()
    assert [(r.section, r.depth) for r in got] == [(i, i + 1) for i in range(15)]


def test_themes_in_texts(spark):
    texts = [(1, "on a big red dog here"), (2, "a big  red dog"), (3, None), (4, "a study of deep learnings now"), (5, "deep"), (6, "the the"), (7, ""), (8, "xdeep learning"), (9, "the  the end")]
    themes = ["big red dog", "no such theme", "deep learning", "deep", "e", "the", "a big", "g red d", "", " ", None, "the  the", "dog ", " red", "of deep learnings n", "eep l", "ing"]
    rows, asked = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(t,) for t in themes * 2], "theme string")
    got = sorted(map(tuple, joins.containing(rows, asked, "id", "t", "theme").collect()))
    assert got == sorted((k, t) for k, x in texts for t in themes if x is not None and t and t.strip() and t in x)


def test_lcs_of_a_title_with_a_block():
    rnd = random.Random(2)
    for n in (1, 63, 64, 65, 200):
        title, block = "".join(rnd.choices("abcé 😀", k=n)), ["".join(rnd.choices("abcdé 😀", k=rnd.randrange(1, 150))) for _ in range(40)]
        points = np.full((len(block), max(map(len, block))), -1, np.int64)
        for i, t in enumerate(block):
            points[i, : len(t)] = [ord(c) for c in t]
        assert [200 * x / (n + len(t)) for x, t in zip(resolution.lcs_lengths(title, points), block, strict=True)] == [joins.indel_ratio(title, t) for t in block]


def test_resolution_against_all_pairs(spark):
    rnd = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "protein", "of", "the", "learning", "δέλτα", "😀"]
    titles = [" ".join(rnd.choices(words, k=rnd.choice([1, 2, 4, 8, 30]))).capitalize() for _ in range(150)]

    def typing_errors(t):
        t = list(t)
        for _ in range(rnd.choice([0, 1, len(t) // 8, len(t) // 4])):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randrange(2)] = rnd.choice("xyz ") * rnd.randrange(2)
        return "".join(t)

    titles += ["Long " + " ".join(rnd.choices(words, k=260)) for _ in range(3)]
    papers = [(k, k % 2, "d" + str(k) if k % 5 == 0 else "", t) for k, t in enumerate([*titles, None, "", titles[3]])]
    refs = [(k, rnd.choice(["", None, "", f"d{rnd.randrange(200)}"]), typing_errors(rnd.choice(titles))) for k in range(300)] + [(303 + k, "", typing_errors(t)) for k, t in enumerate(titles[-3:])] + [(300, None, None), (301, "", "short"), (302, "", "alphax betax gammax delta epsilon zeta")]
    want = {}
    for key, doi, title in refs:
        hits = [(s, p) for p, s, d, _ in papers if doi and d == doi]
        if hits:
            want[key] = (min(hits)[1], "HIGH", 100.0)
            continue
        want[key] = (None, "NONE", None)
        for source in (0, 1) if title and len(title) > 10 else ():
            score, back = max(((joins.indel_ratio(title.lower(), t.lower()), -p) for p, s, _, t in papers if s == source and t), default=(0, 0))
            if score >= 70:
                want[key] = (-back, "MEDIUM" if score >= 85 else "LOW", round(score, 4))
                break
    assert {w[1] for w in want.values()} == {"HIGH", "MEDIUM", "LOW", "NONE"}
    found = resolution.resolve(spark.createDataFrame(refs, "ref_id int, doi string, title string"), spark.createDataFrame(papers, "paper_id int, source_pos int, doi string, title string")).collect()
    assert len(found) == len(refs)
    for r in found:
        assert (r.paper_id, r.confidence, r.score) == want[r.ref_id], r


def test_dag(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")], "node string, dep string")
    assert {r.node: r.level for r in trees.dag_levels(edges).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r.node for r in trees.downstream(edges, spark.createDataFrame([("b",)], "node string")).collect()} == {"b", "d"}
    with pytest.raises(ValueError, match="cycle"):
        trees.dag_levels(spark.createDataFrame([("r", None), ("a", "b"), ("b", "a")], "node string, dep string"))


def test_sections(spark):
    body = "preamble text.\n1. Introduction\n" + "i" * 50 + "\n2. Methods\n" + "m" * 50 + "\nData\nshort\nResults\nend"
    docs = spark.createDataFrame([(1, body), (2, "no headings here."), (3, "")], "doc_id int, text string")
    names = {(r.doc_id, r.section): r["name"] for r in sections.parse_sections(docs).collect()}
    assert names[1, 1] == "Introduction" and names[1, 2] == "Methods" and names[2, 0] is None
    cut = {r.doc_id: r.text for r in sections.truncate(docs, 1000, intro=20, methods=0).collect()}
    assert sections.CUT_INTRO in cut[1] and "m" * 50 not in cut[1] and "short" not in cut[1] and cut[1].startswith("preamble")
    assert cut[2] == "no headings here."
    whole = {r.doc_id: r.text for r in sections.truncate(docs, 30).collect()}
    assert sections.CUT in whole[1] and len(whole[1]) == 30 + len(sections.CUT)


def test_records(spark):
    work = {"id": "W1", "title": "T", "doi": "https://doi.org/10.1/x", "publication_year": 2020, "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/77"}, "authorships": [{"author": {"display_name": "A"}}, {"author": {}}], "primary_location": None, "abstract_inverted_index": {"The": [0, 3], "gut": [1], "is.": [2]}}
    rows = spark.createDataFrame([(json.dumps(work),), (json.dumps({"title": ""}),), ("junk",)], "json string")
    got = records.openalex(rows).collect()
    assert len(got) == 1 and got[0].abstract == "The gut is. The" and got[0].external_ids == {"openalex": "W1", "pmid": "77"} and got[0].authors == ["A"] and got[0].journal is None
    paper = {"paperId": "p", "title": "T", "year": 2019, "authors": [{"name": "B"}], "externalIds": {"DOI": "10.1/y", "PubMed": "5"}, "journal": {"name": "J"}, "citationCount": 3}
    got = records.semantic_scholar(spark.createDataFrame([(json.dumps(paper),)], "json string")).collect()[0]
    assert (got.doi, got.journal, got.external_ids) == ("10.1/y", "J", {"pmid": "5", "s2_id": "p"})
    article = {"MedlineCitation": {"PMID": "9", "Article": {"ArticleTitle": "T", "AuthorList": [{"LastName": "Doe", "ForeName": "J"}, {"ForeName": "x"}], "Journal": {"Title": "N", "JournalIssue": {"PubDate": {"Year": "20x"}}}, "Abstract": {"AbstractText": ["a", "b"]}}}, "PubmedData": {"ArticleIdList": [{"type": "pmc", "value": "PMC1"}, {"type": "doi", "value": "10.1/z"}]}}
    got = records.pubmed(spark.createDataFrame([(json.dumps(article),)], "json string")).collect()[0]
    assert (got.doi, got.year, got.abstract, got.authors, got.external_ids) == ("10.1/z", None, "a b", ["Doe J"], {"pmid": "9", "pmcid": "PMC1"})


def test_recorded_source(spark, tmp_path):
    for q in ("a", "b"):
        (tmp_path / f"{q}.jsonl").write_text("".join(f'{{"title": "{q}{i}"}}\n' for i in range(30)))
    rows = recorded(spark, str(tmp_path), 50)
    assert rows.groupBy("query").count().orderBy("query").collect() == [("a", 25), ("b", 25)]


def test_markup():
    long = "word " * 40
    assert markup.text_of("<p>a</p><script>x</script><nav>n</nav>b &amp; c", "html") == "a\nb & c"
    assert "fig" not in markup.text_of(f"<article><body><p>{long}</p><fig>fig</fig></body></article>", "jats")
    assert markup.text_of("<article><body>short</body></article>", "jats") is None
    assert markup.text_of(f"<x><ce:sections><ce:para>{long}</ce:para></ce:sections></x>", "elsevier") == long.strip()
    assert markup.text_of(None, "html") is None


def test_resolution_compares_whole_titles(spark, tmp_path):
    from scholium.plans import corpus

    start = "measured growth rates under repeated seasonal drought across many northern river basins"
    texts = {1: (f"{start} alpha", "src0"), 2: (f"{start} omega", "src0"), 4: (f"{start} omega", "src2"), 6: (f"{start} zebra quilting njord", "src2"), 9: (f"{start} omega", "src2"), 12: ("nothing shared here", "src2"), 15: (f"{start} omega kappa", "src0")}
    spark.createDataFrame([(i, x, s, len(x)) for i, (x, s) in texts.items()], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want, in_order = {}, lambda x: x.lower()
    for i, (text, source) in texts.items():
        if source != "src0":
            score, paper = max((joins.indel_ratio(in_order(text), in_order(x)), -k) for k, (x, s) in texts.items() if s == "src0")
            want[i] = (-paper, "MEDIUM" if score >= 85 else "LOW", round(score, 4)) if score >= 70 else (None, "NONE", None)
    want[4] = (2, "HIGH", 100.0)
    got = {r.ref_id: (r.paper_id, r.confidence, r.score) for r in corpus.indel_ratio_topmatch(spark, str(tmp_path)).collect()}
    assert got == want
    assert got[9] == (2, "MEDIUM", 100.0) and got[6][2] < 100
