"""URL filtering by a path-template tree.

Per host, paths form a tree of segments. Segments that vary by digits or hexadecimal ids are
one shape from the start. Level by level, the children of a node that do not differ
statistically from their siblings, by the share of good pages among labelled ones, are
merged into a wildcard. A template's purity is its share of good labelled pages, smoothed
towards its host's, and that towards the corpus'. Templates of low purity are rejected.
Explicit rules go first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import attach, column, fresh, stored

# (host, path, verdict); a rule fits its host and all subdomains below its path.
Rule = tuple[str, str, str]
DEPTH = 4  # levels that the checking SQL writes out; the tree has as many as the paths
CRITICAL = 3.8416  # of the squared difference in standard errors: 1.96 of them
LEAST_LABELS = 5
STRENGTH = 10.0  # labelled pages that the level above counts for
LEAST_PURITY = 0.5
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPES = ((r"[0-9a-f]{8,}(-[0-9a-f]{4,})*", "{id}"), (r"[0-9]+", "{n}"))

# Whether a child (lab, good) differs from its siblings (all_lab, all_good less its own).
DIFFERS = f"""COALESCE(lab >= {LEAST_LABELS} AND all_lab - lab >= {LEAST_LABELS}
  AND power(good / NULLIF(lab, 0) - (all_good - good) / NULLIF(all_lab - lab, 0), 2)
  >= {CRITICAL} * (all_good / NULLIF(all_lab, 0)) * (1 - all_good / NULLIF(all_lab, 0))
     * (1 / NULLIF(lab, 0) + 1 / NULLIF(all_lab - lab, 0))
  AND all_good > 0 AND all_good < all_lab, false)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host, A-Z in lower case, and the path; both empty without one."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, CAPITALS, SMALL), path


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as ``host + path``, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own_host, own_path, own_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own_host) | F.endswith(host, F.lit(f".{own_host}"))) & F.startswith(path, F.lit(own_path))
        rule, verdict = F.when(fits, own_host + own_path).otherwise(rule), F.when(fits, own_verdict).otherwise(verdict)
    return rule, verdict


def shapes(path: Column) -> Column:
    """The path's segments, all of them, each generalised."""
    for pattern, shape in SHAPES:
        path = F.regexp_replace(path, pattern, shape)
    parts = F.split(path, "/", -1)
    return F.slice(parts, 2, F.size(parts))


def templates(paths: DataFrame) -> DataFrame:
    """``(host, shape, template, purity)`` for every host and path shape.

    ``paths`` has ``host, shape, good``: one row per page, ``good`` null where unlabelled.
    Pages are counted per shape first; the tree is built over those counts, so a host with a
    third of all pages is as many rows as it has shapes. Levels go on until no shape that
    shares its node with another has a further segment.
    """
    counted = paths.groupBy("host", "shape").agg(
        F.count("good").cast("double").alias("lab"), F.count_if("good").cast("double").alias("good")
    )
    names = ["host", "shape", "lab", "good", "template"]
    going = stored(counted.withColumn("template", F.lit("")), "url-shapes")
    done, level = [], 0
    while True:
        longer = F.size("shape") > level
        done.append(going.where(~longer).select(*names))
        going = going.where(longer)
        if going.isEmpty():
            break
        here = going.withColumn("segment", F.get("shape", F.lit(level)))
        kids = here.groupBy("host", "template", "segment").agg(F.sum("lab").alias("lab"), F.sum("good").alias("good"), F.count("*").alias("shapes"))
        kids = stored(kids, "url-children")
        above = stored(
            kids.groupBy("host", "template").agg(
                F.count("*").alias("kids"), F.sum("lab").alias("all_lab"), F.sum("good").alias("all_good"), F.sum("shapes").alias("all_shapes")
            ),
            "url-parents",
        )
        own = attach(kids, above, ["host", "template"], ["segment"]).select(
            "host", "template", "segment", F.expr(f"kids = 1 OR {DIFFERS}").alias("stays"), (F.col("all_shapes") == 1).alias("alone")
        )
        moved = attach(here, stored(own, "url-branches"), ["host", "template", "segment"], ["shape"])
        step = F.when(F.col("stays"), F.concat(F.lit("/"), F.col("segment"))).otherwise("/*")
        # A node's only shape has one child on every level below, so all its segments stay.
        rest = F.concat(F.lit("/"), F.array_join(F.slice("shape", level + 1, F.size("shape")), "/"))
        moved = moved.withColumn("template", F.concat("template", F.when(F.col("alone"), rest).otherwise(step)))
        moved = stored(moved.select(*names, "alone"), "url-tree")
        done.append(moved.where("alone").select(*names))
        going = moved.where("NOT alone").select(*names)
        level += 1
    tree = stored(reduce(DataFrame.unionByName, done), "url-tree")
    by_host = tree.groupBy("host").agg(F.sum("lab").alias("host_lab"), F.sum("good").alias("host_good"))
    by_template = tree.groupBy("host", "template").agg(F.sum("lab").alias("own_lab"), F.sum("good").alias("own_good"))
    lab, good = tree.agg(F.sum("lab"), F.sum("good")).first()
    corpus = F.lit(good / lab if lab else 1.0)
    host_purity = (F.col("host_good") + STRENGTH * corpus) / (F.col("host_lab") + STRENGTH)
    purity = (F.col("own_good") + STRENGTH * host_purity) / (F.col("own_lab") + STRENGTH)
    scored = stored(by_template.join(by_host, "host").select("host", "template", purity.alias("purity")), "url-purity")
    return attach(tree.select("host", "shape", "template"), scored, ["host", "template"], ["shape"])


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = (), key: str = "page_id", url: str = "url", least: float = LEAST_PURITY
) -> DataFrame:
    """``(key, host, path, rule, verdict, template, purity)`` for every page.

    ``labels`` is ``(key, good)``: some pages and whether they are good; of repeated keys the
    bad label counts. The verdict is the longest fitting rule's, else ``block`` where the
    purity of the page's template is below ``least``, else ``allow``. A null url, or one
    without ``://``, has an empty host and path, which is a host like others. Without labels
    everything else is allowed. Repeated rows get equal verdicts, an empty table gives an
    empty table; other columns are not read.
    """
    host, path = host_and_path(column(pages, url))
    (good,) = fresh([key], "good")
    parsed = pages.select(column(pages, key).alias(key), host.alias("host"), path.alias("path")).withColumn("shape", shapes(F.col("path")))
    known = labels.groupBy(key).agg(F.bool_and("good").alias(good))
    tree = stored(templates(parsed.join(known, key, "left").select("host", "shape", good)), "url-templates")
    judged = attach(parsed, tree, ["host", "shape"], [key])
    rule, ruled = first_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("purity") < least, "block").otherwise("allow")
    return judged.select(key, "host", "path", rule.alias("rule"), F.coalesce(ruled, by_method).alias("verdict"), "template", "purity")


def oracle(pages_sql: str, rules: Sequence[Rule], key: str = "page_id") -> str:
    """DuckDB SQL for ``judge_urls``; ``pages_sql`` gives ``key, host, path, good``."""
    shape = "path"
    for pattern, name in SHAPES:
        shape = f"regexp_replace({shape}, '{pattern}', '{name}', 'g')"
    ctes = [
        f"pages_in AS ({pages_sql})",
        f"parsed AS (SELECT *, string_split({shape}, '/')[2:{DEPTH + 1}] AS shape FROM pages_in)",
        "tree0 AS (SELECT host, shape, count(good)::DOUBLE AS lab, (count(*) FILTER (good))::DOUBLE AS good, '' AS template FROM parsed GROUP BY host, shape)",
    ]
    for level in range(DEPTH):
        ctes += [
            f"kids{level} AS (SELECT host, template, shape[{level + 1}] AS segment, sum(lab) AS lab, sum(good) AS good FROM tree{level} WHERE len(shape) > {level} GROUP BY ALL)",
            f"above{level} AS (SELECT host, template, count(*) AS kids, sum(lab) AS all_lab, sum(good) AS all_good FROM kids{level} GROUP BY ALL)",
            f"own{level} AS (SELECT k.host, k.template, k.segment, kids = 1 OR {DIFFERS} AS stays FROM kids{level} k JOIN above{level} USING (host, template))",
            f"""tree{level + 1} AS (SELECT t.host, shape, lab, good, CASE WHEN len(shape) <= {level} THEN t.template
                WHEN stays THEN t.template || '/' || segment ELSE t.template || '/*' END AS template
                FROM tree{level} t LEFT JOIN own{level} o ON o.host = t.host AND o.template = t.template AND o.segment = t.shape[{level + 1}])""",
        ]
    whens = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{0}}'".replace("{0}", f"{h}{p}|{v}")
        for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))
    )
    ctes += [
        f"corpus AS (SELECT coalesce(sum(good) / nullif(sum(lab), 0), 1.0::DOUBLE) AS p FROM tree{DEPTH})",
        f"hosts AS (SELECT host, (sum(good) + {STRENGTH}::DOUBLE * (SELECT p FROM corpus)) / (sum(lab) + {STRENGTH}::DOUBLE) AS p FROM tree{DEPTH} GROUP BY host)",
        f"purities AS (SELECT t.host, template, (sum(good) + {STRENGTH}::DOUBLE * any_value(p)) / (sum(lab) + {STRENGTH}::DOUBLE) AS purity FROM tree{DEPTH} t JOIN hosts USING (host) GROUP BY t.host, template)",
        f"judged AS (SELECT {key}, host, path, template, purity, CASE {whens} END AS fit FROM parsed JOIN tree{DEPTH} USING (host, shape) JOIN purities USING (host, template))",
    ]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT {key}, host, path, string_split(fit, '|')[1] AS rule,
       coalesce(string_split(fit, '|')[2], CASE WHEN purity < {LEAST_PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
       template, round(purity, 9) AS purity FROM judged"""
