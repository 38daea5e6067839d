"""URL filter: rules first, then word segmentation of hosts and naive Bayes.

* ``host``: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
  lower-cased; ``path``: from there up to ``?``, ``#`` or the end.  A null URL or
  one without ``://`` has an empty host and path.
* A rule (verdict, host, path) fits its host and all subdomains where the URL's
  path begins with the rule's path; the longest host and path wins.
* Unigrams: runs of letters of the pages' visible text, counted over all pages.
* Segmentation: each run of letters in a host is split into words by Viterbi,
  the cost of a word being -1000 ln of its share; words that no page has
  cost as much as a share of ``10 / 10 ** length`` of one occurrence.  Only distinct runs
  are split; their substrings (up to LONGEST letters) are joined to the counts.
* Tokens: the host's words (``h:``) and the runs of letters of the path
  (``p:``); runs of digits are the token ``0``, other signs separate, and runs beyond ASCII
  are tokens as they stand.
* Naive Bayes: multinomial, trained on all pages that a rule decides; its verdict
  is given where none does.  Seed words count, as words of a host to be blocked, for a
  hundredth of the class's tokens each; they are known to the segmentation too.

Costs and weights are integers (rounded down), so the split and the sums are
exact; ties go to the longer last word, and to ``allow``.

Work per page is a grouped count by host and by path shape (the path with its
digits as ``0``), and two joins to their scores (``hot_join``: a hot host is
never sent to one task).
Tokens are taken from distinct hosts and shapes only.

Defined cases.  Null or empty html has no words; a page without tokens gets the
class of more rows.  Where no rule fits any page the seeds alone train; every row gives
one row, repeated page_ids too.  An empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import hot_join

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words that speak for blocking a host.
SEEDS = ("adult", "bet", "bets", "casino", "gambling", "pills", "poker", "porn", "sex", "spam", "xxx")
#: Letters of the longest word that the segmentation looks up.
LONGEST = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = r"[a-z]+|[0-9]+|[^\x00-\x7F]+"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit("x"), url), "://", 1))
    rest = F.coalesce(F.substring(url, F.length(after) + 3, F.length(url)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, at, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(begin)
        rule, verdict = F.when(fits, at + begin).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def unigrams(pages: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """(word, n, total) of the pages' visible text; a seed counts for a ten-thousandth at least."""
    visible = F.translate(F.regexp_replace("html", "<[^>]*>", " "), UPPER, LOWER)
    words = pages.select(F.explode(F.regexp_extract_all(visible, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))).alias("word"))
    seen = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(f"word RLIKE '^[a-z]{{1,{LONGEST}}}$'").checkpoint()
    total = F.broadcast(seen.agg((F.coalesce(F.sum("n"), F.lit(0)) + 1).alias("total")))  # one row
    sown = pages.sparkSession.createDataFrame([(s,) for s in seeds], "word string").crossJoin(total).select("word", F.expr("total div 10000 + 1").alias("n"), "total")
    return seen.crossJoin(total).unionByName(sown).groupBy("word").agg(F.max("n").alias("n"), F.max("total").alias("total"))


def _viterbi(run: str, known: list[tuple[int, int, int]], total: int) -> list[str]:
    """``known`` has (begin, end, cost) of the known words in ``run``."""
    into: dict[int, dict[int, int]] = {}
    for begin, end, cost in known:
        into.setdefault(end, {})[begin] = cost
    rare = int(np.floor(1000 * np.log(total)))
    best, back = [0], [0]
    for end in range(1, len(run) + 1):
        here = into.get(end, {})
        cost, begin = min((best[b] + here.get(b, rare + 2303 * (end - b - 1)), b) for b in range(max(end - LONGEST, 0), end))
        best.append(cost)
        back.append(begin)
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of the distinct ``runs`` of letters."""
    begins = runs.select("run", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("begin"))
    ends = begins.select("run", "begin", F.explode(F.sequence(F.col("begin") + 1, F.least(F.length("run"), F.col("begin") + LONGEST))).alias("end"))
    word = F.substring(F.col("run"), F.col("begin") + 1, F.col("end") - F.col("begin"))
    cost = F.floor(1000 * (F.log("total") - F.log("n"))).cast("long")
    hits = ends.withColumn("word", word).join(counts, "word").groupBy("run").agg(F.collect_list(F.struct("begin", "end", cost.alias("cost"))).alias("known"))
    total = F.broadcast(counts.agg(F.coalesce(F.max("total"), F.lit(1)).alias("total")))  # one row

    def split(run: pd.Series, known: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([
            _viterbi(r, [] if k is None else [(x["begin"], x["end"], x["cost"]) for x in k], t) for r, k, t in zip(run, known, total, strict=True)])

    split.__annotations__ = {"run": pd.Series, "known": pd.Series, "total": pd.Series, "return": pd.Series}
    return runs.join(hits, "run", "left").crossJoin(total).select("run", F.pandas_udf(split, "array<string>")("run", "known", "total").alias("words"))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def host_tokens(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, token), a row for each occurrence, of the distinct ``hosts`` (key)."""
    found = hosts.select("key", F.explode(_runs(F.col("key"))).alias("run")).checkpoint()
    letters = found.select("run").filter("run RLIKE '^[a-z]'").distinct()
    rows = hot_join(found, segmented(letters, counts).checkpoint(), "run")
    whole = F.array(F.when(F.col("run").rlike("^[0-9]"), "0").otherwise(F.col("run")))
    return rows.select("key", F.explode(F.coalesce("words", whole)).alias("word")).select("key", F.concat(F.lit("h:"), "word").alias("token"))


def shape_tokens(shapes: DataFrame) -> DataFrame:
    return shapes.select("key", F.explode(_runs(F.col("key"))).alias("run")).select("key", F.concat(F.lit("p:"), "run").alias("token"))


def weights(tokens: DataFrame, rows: DataFrame, seeds: Sequence[str] = SEEDS) -> tuple[DataFrame, DataFrame]:
    """(token, weight) and the one row (prior) of the naive Bayes model.

    ``tokens``: (token, n_block, n_allow) in trained pages; ``rows``: one row (blocked, allowed).
    """
    counted = tokens.groupBy("token").agg(F.sum("n_block").alias("b"), F.sum("n_allow").alias("a")).filter("a + b > 0").checkpoint()
    share = F.broadcast(counted.agg(F.expr("coalesce(sum(b), 0) div 100 + 1").alias("b")))  # one row
    sown = tokens.sparkSession.createDataFrame([("h:" + s,) for s in seeds], "token string").crossJoin(share).select("token", "b", F.lit(0).cast("long").alias("a"))
    full = counted.unionByName(sown).groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    sums = F.broadcast(full.agg(F.sum("b").alias("all_b"), F.sum("a").alias("all_a"), F.count(F.lit(1)).alias("v")))  # one row
    part = lambda n, of: F.floor(1000 * F.log((F.col(n) + 1).cast("double") / (F.col(of) + F.col("v"))))
    model = full.crossJoin(sums).select("token", (part("b", "all_b") - part("a", "all_a")).cast("long").alias("weight"))
    prior = F.floor(1000 * F.log((F.col("blocked") + 1).cast("double") / (F.col("allowed") + 1))).cast("long")
    return model, rows.select(prior.alias("prior"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages``; score is null where a rule decides,
    else the naive Bayes sum (over 0: block)."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    shape = F.regexp_replace(F.translate("path", UPPER, LOWER), "[0-9]+", "0")
    rows = rows.withColumns({"rule": rule, "verdict": verdict, "shape": shape})

    counts = unigrams(pages, seeds).checkpoint()
    sides = [F.count_if(F.col("verdict") == s).alias(f"n_{s}") for s in ("block", "allow")]
    hosts, shapes = (
        rows.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n"), *sides).checkpoint() for c in ("host", "shape"))
    tokens = {"host": host_tokens(hosts, counts).checkpoint(), "shape": shape_tokens(shapes).checkpoint()}
    groups = {"host": hosts, "shape": shapes}
    trained = [tokens[c].join(groups[c].filter("n_block + n_allow > 0"), "key").select("token", "n_block", "n_allow") for c in groups]
    model, prior = weights(trained[0].unionByName(trained[1]), hosts.agg(
        F.coalesce(F.sum("n_block"), F.lit(0)).alias("blocked"), F.coalesce(F.sum("n_allow"), F.lit(0)).alias("allowed")), seeds)
    model = model.checkpoint()
    decided = rows.filter("verdict IS NOT NULL").withColumn("score", F.lit(None).cast("long"))
    open_rows = rows.filter("verdict IS NULL")
    for c, t in tokens.items():
        sums = hot_join(t, model, "token").groupBy("key").agg(F.sum("weight").alias("sum"))
        scores = groups[c].join(sums, "key", "left").select(F.col("key").alias(c), "n", F.coalesce("sum", F.lit(0)).alias(f"{c}_score")).checkpoint()
        open_rows = hot_join(open_rows, scores.drop("n"), c, scores)
    score = F.col("host_score") + F.col("shape_score") + F.col("prior")
    by_method = open_rows.crossJoin(F.broadcast(prior)).withColumn("score", score).withColumn(
        "verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return decided.unionByName(by_method.select(*decided.columns)).select("page_id", "host", "path", "rule", "verdict", "score")
