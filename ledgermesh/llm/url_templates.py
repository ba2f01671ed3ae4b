"""URL verdicts by rules, and where none fits by a tree of path templates for each host.

The tree grows a level a round over distinct (host, path) rows. At a node, segments seldom seen again become wildcards by their shape where the node's
next segment is more likely new than known. Then branches that differ from their siblings in the same ways are merged: how often a path ends there, goes
on with a number, is labelled, and is labelled as blocked, each compared by Hoeffding's bound with the siblings together, so no pairs of branches arise.
Labels are the rules' own verdicts. A template is rejected by the smoothed share of blocked pages among its labelled ones.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.operators.skew import join_unique
from ledgermesh.session import stored

#: (rule, verdict): host and path; a rule fits its host and all subdomains.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUMS = ("pages", "bad", "good", "ends", "numbers")


@dataclass(frozen=True)
class Growth:
    """levels: segments of a template; what follows is its tail. variable: least share of pages with a segment seen once that makes
    wildcards. support: pages that keep a segment as it is. alpha: chance that two like branches are held apart by a figure. prior: pages
    that the overall share of blocked labels counts for, taken as a half at most, so no template goes without evidence of its own. purity: least smoothed share of blocked labels that rejects."""

    levels: int = 8
    variable: float = 0.5
    support: int = 5
    alpha: float = 0.05
    prior: float = 4.0
    purity: float = 0.8


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. The rules are hand-written, so they are part of the expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the last one asked first
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """A wildcard: runs of letters as a, of digits as 9, words with separators as a-a; a shape over 16 characters is *."""
    runs = F.regexp_replace(F.regexp_replace(segment, r"\p{L}+", "a"), r"[0-9]+", "9")
    words = F.regexp_replace(runs, r"a(?:[-_+ ][a9]+)+", "a-a")
    return F.concat(F.lit("{"), F.when(F.length(words) > 16, "*").otherwise(words), F.lit("}"))


def _differs(own: Column, n: Column, rest: Column, m: Column, alpha: float) -> Column:
    """-1, 0 or 1: whether own / n is below, near or above rest / m, by Hoeffding's bound for two samples."""
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / F.sqrt(n) + 1 / F.sqrt(m))
    gap = own / n - rest / m
    return F.when((n == 0) | (m == 0), 0).when(gap > bound, 1).when(gap < -bound, -1).otherwise(0)


def _branches(live: DataFrame, level: int, grown: Growth) -> DataFrame:
    """host, node, segment, token, paths: what each segment below a node is called. live: host, node, pages, bad, good, segments."""
    here, after = F.col("segments")[level], F.get("segments", F.lit(level + 1))
    last = F.size("segments") == level + 1
    rows = live.select("host", "node", here.alias("segment"), "pages", "bad", "good", F.when(last, F.col("pages")).otherwise(0).alias("ends"), F.when(F.coalesce(F.rlike(after, F.lit("^[0-9]+$")), F.lit(False)), F.col("pages")).otherwise(0).alias("numbers"))
    own = stored(rows.groupBy("host", "node", "segment").agg(*(F.sum(c).alias(c) for c in SUMS), F.count("*").alias("paths")))
    pool = own.groupBy("host", "node").agg(*(F.sum(c).alias(f"all_{c}") for c in SUMS), F.sum(F.when(F.col("pages") == 1, 1).otherwise(0)).alias("once"), F.count("*").alias("_segments"))
    total = own.count()
    named = join_unique(own, pool, ["host", "node"], "_segments", total)
    new = F.col("once") / (F.col("all_pages") + 2) > grown.variable
    named = stored(named.withColumn("token", F.when(new & (F.col("pages") < grown.support), shape(F.col("segment"))).otherwise(F.col("segment"))))
    tokens = named.groupBy("host", "node", "token").agg(*(F.sum(c).alias(c) for c in SUMS), *(F.first(f"all_{c}").alias(f"all_{c}") for c in SUMS), F.count("*").alias("_segments"))
    of = lambda c: (F.col(c), F.col(f"all_{c}") - F.col(c))
    labelled, rest_labelled = F.col("bad") + F.col("good"), F.col("all_bad") + F.col("all_good") - F.col("bad") - F.col("good")
    pages, rest = of("pages")
    figures = [(*of("ends"), pages, rest), (*of("numbers"), pages, rest), (labelled, rest_labelled, pages, rest), (*of("bad"), labelled, rest_labelled)]
    sides = F.concat_ws("", *(_differs(a, n, b, m, grown.alpha).cast("string") for a, b, n, m in figures))
    tokens = stored(tokens.select("host", "node", "token", "_segments", sides.alias("side")))
    merged = tokens.groupBy("host", "node", "side").agg(F.min("token").alias("least"), F.count("*").alias("_tokens"))
    merged = merged.withColumn("name", F.concat("least", F.when(F.col("_tokens") > 1, "~").otherwise("")))
    names = join_unique(tokens, merged.select("host", "node", "side", "name", "_tokens"), ["host", "node", "side"], "_tokens", tokens.count())
    known = join_unique(named.select("host", "node", "segment", "token", "paths"), names.select("host", "node", "token", "name", "_segments"), ["host", "node", "token"], "_segments", total)
    return known.select("host", "node", "segment", F.col("name").alias("token"), "paths")


def templates(paths: DataFrame, grown: Growth = Growth()) -> DataFrame:
    """paths with the template of each row. paths: host, path, pages, bad, good, a row for each host and path."""
    cut = F.split("path", "/")
    segments = F.when(F.startswith("path", F.lit("/")), F.slice(cut, 2, F.greatest(F.size(cut), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    kept = F.when(F.size(segments) > grown.levels, F.concat(F.slice(segments, 1, grown.levels), F.array(F.lit("**")))).otherwise(segments)
    rows = stored(paths.select("host", "path", "pages", "bad", "good", kept.alias("segments"), F.lit("").alias("node")))
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    done = []
    for level in range(deepest):
        done.append(rows.filter(F.size("segments") <= level))
        rows = rows.filter(F.size("segments") > level)
        live = rows.withColumn("segment", F.col("segments")[level])
        named = stored(_branches(rows, level, grown))
        known = join_unique(live, named, ["host", "node", "segment"], "paths", named.agg(F.sum("paths")).first()[0] or 0)
        rows = stored(known.select("host", "path", "pages", "bad", "good", "segments", F.concat("node", F.lit("/"), "token").alias("node")))
    return reduce(DataFrame.unionByName, done, rows).select("host", "path", "pages", "bad", "good", F.col("node").alias("template"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, grown: Growth = Growth()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page.

    pages: page_id, url. The verdict is that of the longest rule that fits; without one it is block if the template's purity, the
    smoothed share of blocked among its labelled pages, reaches the limit, else allow. Purity is 0 where nothing is labelled at all.

    A null url, or one without ://, has an empty host and path: it is a page of the host "" and is judged like all. Repeated pages
    stay, with null ids too; an empty table has no rows; other columns are not read. Segments beyond the levels are one tail.
    """
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", fitting(F.col("host"), F.col("path"), rules).alias("fit"))
    label = lambda v: F.count_if(F.col("fit.verdict") == v).cast("long")
    paths = stored(rows.groupBy("host", "path").agg(F.count("*").alias("pages"), label("block").alias("bad"), label("allow").alias("good")))
    total = paths.agg(F.count("*").alias("paths"), F.sum("pages").alias("pages"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    base = min(0.5, (total["bad"] or 0) / max((total["bad"] or 0) + (total["good"] or 0), 1))
    named = stored(templates(paths, grown))
    tree = named.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"), F.count("*").alias("_paths"))
    tree = tree.select("host", "template", "_paths", ((F.col("b") + grown.prior * base) / (F.col("b") + F.col("g") + grown.prior)).alias("purity"))
    judged = stored(join_unique(named, tree, ["host", "template"], "_paths", total["paths"] or 0))
    told = join_unique(rows, judged.select("host", "path", "pages", "template", "purity"), ["host", "path"], "pages", total["pages"] or 0)
    own = F.when(F.col("purity") >= grown.purity, "block").otherwise("allow")
    return told.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "template", "purity")
