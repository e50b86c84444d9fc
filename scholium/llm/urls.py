"""URL filters: fixed rules first, then a path-template tree learned per host.

The tree has a node for each (host, first segments of the path). Segments are
generalised: digit runs become {n} and long hexadecimal names {h}. Level by
level, a branch that has siblings becomes the wildcard * unless its bad labels
differ by more than ``Z`` standard errors (of the count, and one more page) from
what its parent's share would give; branches without labels are similar to any.
A path that is the only one left below its branch is finished as it stands, so
the levels go as deep as paths share branches, to any depth. A template is
rejected if its share of bad labels, smoothed towards that of all labelled
pages, is over ``REJECT``.

All of it is counts of (host, segments), aggregated before anything is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.session import materialise, release

# fixed values: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
Z = 2.0
SMOOTHING = 10.0
REJECT = 0.5
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """Host of a url, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), CAPITALS, SMALL)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def with_rule(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Adds rule (host and path of the longest rule that fits) and rule_verdict; both null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [(F.col("host") == h) | F.endswith("host", F.lit(f".{h}")) for _, h, _ in ordered]
    cases = [(f & F.startswith("path", F.lit(p)), h + p, v) for f, (v, h, p) in zip(fits, ordered, strict=True)]
    pick = lambda i: F.coalesce(*(F.when(c[0], c[i]) for c in cases))
    return pages.withColumn("rule", pick(1)).withColumn("rule_verdict", pick(2))


def with_segments(pages: DataFrame) -> DataFrame:
    """Adds named: the generalised segments of the path, each after a slash."""
    parts = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.concat(F.lit("/"), F.when(s.rlike("^[0-9a-fA-F]{16,}$"), "{h}").otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))))
    return pages.withColumn("named", F.array_join(parts, ""))


def templates(pages: DataFrame) -> DataFrame:
    """Templates of pages with host, named and bad (1, 0, or null if unlabelled).

    Returns host, named, template and verdict: one row for each distinct path of
    generalised segments.
    """
    # every level reads the tree several times: written once, its plan stays short
    tree = materialise(pages.groupBy("host", "named").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).withColumns({"template": F.lit(""), "rest": F.col("named")}))
    done, above = [], ["host", "template"]
    while True:
        # what is alone below its branch, or has ended, stays as it is
        below = tree.groupBy(*above).agg(F.count(F.lit(1)).alias("rows"))
        placed = materialise(tree.join(below, above).withColumn("open", (F.col("rows") > 1) & (F.col("rest") != "")))
        done.append(materialise(placed.filter(~F.col("open")).select("host", "named", "labelled", "bad", F.concat("template", "rest").alias("template"))))
        going = placed.filter("open").withColumn("segment", F.regexp_extract("rest", "^/[^/]*", 0))
        release(tree)
        if placed.filter("open").isEmpty():
            release(placed)
            break
        # those that end at the branch are a child of it like any other
        nodes = materialise(placed.withColumn("segment", F.regexp_extract("rest", "^/[^/]*", 0)).groupBy(*above, "segment").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")))
        parents = nodes.groupBy(*above).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("pn"), F.sum("b").alias("pb"))
        share = (F.col("pb") + 1.0) / (F.col("pn") + 2.0)
        similar = F.abs(F.col("b") - F.col("n") * share) <= Z * F.sqrt(F.col("n") * share * (1 - share) + 1)
        kept = nodes.join(parents, above).select(*above, "segment", F.when((F.col("children") > 1) & similar, "/*").otherwise(F.col("segment")).alias("own"))
        tree = materialise(going.join(kept, [*above, "segment"]).select("host", "named", "labelled", "bad", F.concat("template", "own").alias("template"), F.substring(F.col("rest"), F.length("segment") + 1, F.length("rest")).alias("rest")))
        release(placed, nodes)
    whole = reduce(DataFrame.unionByName, done)
    total = whole.agg(((F.sum("bad") + 1.0) / (F.sum("labelled") + 2.0)).alias("prior"))
    purity = whole.groupBy(*above).agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    judged = purity.join(F.broadcast(total)).withColumn("share", (F.col("b") + SMOOTHING * F.col("prior")) / (F.col("n") + SMOOTHING))  # total is one row
    judged = judged.select(*above, F.when(F.col("share") > REJECT, "block").otherwise("allow").alias("verdict"))
    found = materialise(whole.join(judged, above).select("host", "named", F.concat("host", "template").alias("template"), "verdict"))
    release(*done)
    return found


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Verdict on each page's url: page_id, host, path, rule, verdict, template.

    A page is labelled by ``labels`` (doc_id, quality, toxic) of the number that
    ends its path: bad is quality 0 or toxic 1. A null url, or one without ://,
    has empty host and path and is judged by that template; with no label at all
    the verdict is allow. Repeated rows each give a row (and count as pages).
    """
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = with_segments(with_rule(parts, rules))
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.html)?/?$", 1).try_cast("long")
    bad = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("number")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad"))
    keys = ["host", "named"]
    learned = templates(rows.withColumn("number", number).select(*keys, "number").join(bad, "number", "left"))
    ruled = rows.filter(F.col("rule").isNotNull()).select("page_id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"), F.lit(None).cast("string").alias("template"))
    free = rows.filter(F.col("rule").isNull()).join(learned, keys, "left")
    return ruled.unionByName(free.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "template"))


def duckdb_sql(levels: int = 6) -> str:
    """The same verdicts as DuckDB SQL over pages and labels, for paths of up to so many segments (those of the tables have fewer)."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    pick = lambda i: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[i]}'" for v, h, p in ordered) + " END"
    segment = "CASE WHEN regexp_matches(s, '^[0-9a-fA-F]{16,}$') THEN '{h}' ELSE regexp_replace(s, '[0-9]+', '{n}', 'g') END"
    steps = [
        f"""parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{CAPITALS}', '{SMALL}') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)""",
        f"ruled AS (SELECT *, {pick(0)} AS rule, {pick(1)} AS rule_verdict, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {segment}) AS named, TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.html)?/?$', 1) AS BIGINT) AS number FROM parts)",
        "urls AS (SELECT page_id, host, path, rule, rule_verdict, number, array_to_string(list_transform(named, lambda s: '/' || s), '') AS named FROM ruled)",
        "marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)",
        "tree0 AS (SELECT host, named, '' AS template, named AS rest, false AS done, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM urls LEFT JOIN marks ON number = doc_id GROUP BY ALL)",
    ]
    for d in range(1, levels + 1):
        steps += [
            f"placed{d} AS (SELECT *, regexp_extract(rest, '^/[^/]*') AS segment, count(*) FILTER (NOT done) OVER (PARTITION BY host, template) > 1 AND rest <> '' AND NOT done AS open FROM tree{d - 1})",
            f"nodes{d} AS (SELECT host, template, segment, sum(labelled) AS n, sum(bad) AS b FROM placed{d} WHERE NOT done GROUP BY ALL)",
            f"parents{d} AS (SELECT host, template, count(*) AS children, (sum(b) + 1.0::DOUBLE) / (sum(n) + 2.0::DOUBLE) AS share FROM nodes{d} GROUP BY ALL)",
            f"kept{d} AS (SELECT host, template, segment, CASE WHEN children > 1 AND abs(b - n * share) <= {Z} * sqrt(n * share * (1 - share) + 1) THEN '/*' ELSE segment END AS own FROM nodes{d} JOIN parents{d} USING (host, template))",
            f"""tree{d} AS (SELECT host, named, CASE WHEN done THEN template WHEN open THEN template || own ELSE template || rest END AS template, CASE WHEN open THEN substr(rest, length(segment) + 1) ELSE '' END AS rest, NOT open AS done, labelled, bad
                FROM placed{d} LEFT JOIN kept{d} USING (host, template, segment))""",
        ]
    steps += [
        f"prior AS (SELECT (sum(bad) + 1.0::DOUBLE) / (sum(labelled) + 2.0::DOUBLE) AS prior FROM tree{levels})",
        f"judged AS (SELECT host, template, CASE WHEN (sum(bad) + {SMOOTHING}::DOUBLE * any_value(prior)) / (sum(labelled) + {SMOOTHING}::DOUBLE) > {REJECT} THEN 'block' ELSE 'allow' END AS verdict FROM tree{levels}, prior GROUP BY host, template)",
        f"learned AS (SELECT host, named, host || template AS template, verdict FROM tree{levels} JOIN judged USING (host, template))",
    ]
    return f"WITH {', '.join(steps)} SELECT page_id, host, path, rule, coalesce(rule_verdict, verdict, 'allow') AS verdict, CASE WHEN rule IS NULL THEN template END AS template FROM urls LEFT JOIN learned USING (host, named)"
