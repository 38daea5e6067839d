"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Only DataFrame functions run here.  Base spans are the leftmost non-overlapping
matches of four patterns that pass their check; they are the seeds.  The words
around a seed (the one and the two before, the one behind) are its lexical
patterns.  Candidates are other tokens that mix digits into at least
LEAST_CHARS characters.  Patterns and instances (distinct values) form a graph that
is scored in rounds:

* a pattern's score is the confidence of its confident instances over the number
  of all its instances + 1, if at least LEAST_SUPPORT of them are confident;
* a candidate's confidence is 1 - product of (1 - score) over its patterns, and
  candidates of ACCEPT or more count as confident in the next round, also for
  patterns without any seed.

More confident instances only raise scores, so confidences never fall; the rounds
end when no value is newly accepted and no accepted one gains more than SETTLED.

Every round is two grouped joins over distinct (pattern, instance) edges, so a
pattern that a third of all seeds share costs one partial sum for each task.
Accepted candidates become spans of kind ``id`` wherever they occur as tokens.

Positions are code points: ``split`` on a pattern gives the text between its
matches, and running lengths of both give the starts.  The scanning patterns
match exactly what the base patterns match, but start only where a run of their
characters starts, so a long run is read once and not from each of its
characters.

Defined cases.  A null text is empty: no spans, base_sha256 of the empty
string.  Rows that repeat a doc_id are judged each on its own text; equal rows
get equal results.  Without seeds no pattern scores and nothing is added.  An
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import null_safe

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
SCAN = {
    "email": f"(?:(?<!{LOCAL})|\\G){LOCAL}++@{HOST}++(?:\\.{HOST}++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    # the look-ahead skips runs of less than 14 digits
    "card": "(?<![0-9])(?=(?:[0-9][\\x20-]?){14})[0-9]++(?:[\\x20-][0-9]++)*+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
SPACE = "\\x20\\x09-\\x0D"
TOKEN = f"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"
CONTEXT_CHARS = 80
LEAST_CHARS = 8
LEAST_DIGITS = 2
LEAST_SUPPORT = 5
ACCEPT = 0.8
SETTLED = 1e-6


def spans(text: Column, pattern: str, gate: Column) -> Column:
    """Array of (start, end, value) of the matches; empty where ``gate`` is false."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda v, gap: F.struct(v.alias("value"), F.length(gap).alias("gap")))
    kind = "array<struct<start:int,end:int,value:string>>"
    empty = F.array().cast(kind)
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.when(gate, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _short(part: Column) -> Column:
    """The number that the digits spell, 1000 where it has more than three digits."""
    rest = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(rest) > 3, 1000).otherwise(F.substring(rest, 1, 3).cast("int"))


def _passes(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        # leading zeros aside, a part of at most 255 has at most three digits
        return F.forall(F.split(value, "\\."), lambda p: _short(p) <= 255)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "card":
        each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
        return F.length(digits).between(14, 19) & (F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0)
    return F.lit(True)


def _checked(kind: str, found: Column) -> Column:
    return F.transform(F.filter(found, lambda s: _passes(kind, s["value"])), lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, base, near): base spans (start, kind, end, value) in order, and all seeds and candidate tokens with their contexts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    gates = {"email": F.contains("text", F.lit("@")), "ip": digit & F.contains("text", F.lit(".")), "card": digit, "phone": digit & F.contains("text", F.lit("+"))}
    found = [_checked(k, spans(F.col("text"), SCAN[k], gates[k])) for k in KINDS]
    rows = rows.withColumns({"h": F.xxhash64("text"), "base": F.array_sort(F.concat(*found)), "tokens": spans(F.col("text"), TOKEN, digit)})

    def context(at: Column, end: Column) -> list[Column]:
        left = F.substring(F.col("text"), F.greatest(at - CONTEXT_CHARS, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT_CHARS)))
        right = F.substring(F.col("text"), end + 1, F.lit(CONTEXT_CHARS))
        word, gap, stuck = f"[^{SPACE}]+", f"[{SPACE}]+", f"[^{SPACE}]{{0,3}}"
        return [
            F.concat(F.lit("b1 "), F.lower(F.regexp_extract(left, f"({word}){gap}{stuck}$", 1))),
            F.concat(F.lit("b2 "), F.lower(F.regexp_extract(left, f"({word}{gap}{word}){gap}{stuck}$", 1))),
            F.concat(F.lit("a1 "), F.lower(F.regexp_extract(right, f"^{stuck}{gap}({word})", 1))),
        ]

    def near(at: Column, end: Column, value: Column, seed: bool) -> Column:
        return F.struct(at.alias("start"), end.alias("end"), F.lower(value).alias("value"), F.lit(seed).alias("seed"), F.array(*context(at, end)).alias("patterns"))

    seeds = F.transform("base", lambda s: near(s["start"], s["end"], s["value"], True))
    tokens = F.transform("tokens", lambda t: F.struct(
        (t["start"] + F.length(F.regexp_extract(t["value"], "^[^A-Za-z0-9]*", 0))).alias("start"),
        (t["end"] - F.length(F.regexp_extract(t["value"], "[^A-Za-z0-9]*$", 0))).alias("end"),
        F.regexp_replace(t["value"], "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "").alias("value")))
    other = F.filter(tokens, lambda t: (F.length(t["value"]) >= LEAST_CHARS) & (F.length(_digits(t["value"])) >= LEAST_DIGITS)
                     & ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    rows = rows.withColumn("other", other)
    candidates = F.transform("other", lambda t: near(t["start"], t["end"], t["value"], False))
    return rows.select("doc_id", "h", "base", F.concat(seeds, candidates).alias("near"))


def bootstrap(near: DataFrame) -> DataFrame:
    """(value, seed, patterns) rows to accepted candidate values with their confidence."""
    instances = near.groupBy("value").agg(F.max("seed").alias("seed")).withColumn("conf", F.col("seed").cast("double")).checkpoint()
    edges = (
        near.select("value", F.explode("patterns").alias("pattern")).filter("length(pattern) > 3").distinct()
    )
    # a pattern with fewer instances can never have LEAST_SUPPORT confident ones
    useful = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_SUPPORT).select("pattern")
    edges = edges.join(useful, "pattern").checkpoint()
    sure, gain = F.col("conf") >= ACCEPT, 1.0
    while gain > SETTLED:
        scored = edges.join(instances.select("value", "conf"), "value").groupBy("pattern").agg(
            F.sum(F.when(sure, F.col("conf")).otherwise(0)).alias("f"), F.count_if(sure).alias("support"), F.count(F.lit(1)).alias("n"))
        scored = scored.filter(F.col("support") >= LEAST_SUPPORT).select("pattern", (F.col("f") / (F.col("n") + 1)).alias("score"))
        better = edges.join(scored, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("new"))
        before = F.when(sure, F.col("conf")).otherwise(0.0)
        instances = instances.join(better, "value", "left").select(
            "value", "seed", before.alias("before"), F.greatest("conf", F.coalesce("new", F.lit(0.0))).alias("conf")).checkpoint()
        gain = instances.filter(sure).agg(F.max(F.col("conf") - F.col("before"))).first()[0] or 0.0
    return instances.filter((~F.col("seed")) & sure).select("value", "conf")


def _listed(spans_column: str, names: Column) -> Column:
    return F.concat_ws(",", F.transform(spans_column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def _count(kind: int) -> Column:
    return F.size(F.filter("plain", lambda s: s["kind"] == kind)).cast("long")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) for every row of ``docs``."""
    rows = base_spans(docs).checkpoint()
    near = rows.filter(F.size("near") > 0).select("doc_id", "h", F.explode("near").alias("x")).select("doc_id", "h", "x.*")
    accepted = bootstrap(near.select("value", "seed", "patterns"))
    more = near.filter("NOT seed").join(accepted, "value").groupBy("doc_id", "h").agg(
        F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("more"))
    out = null_safe(rows.select("doc_id", "h", "base"), more, ["doc_id", "h"], "left")
    names = F.array(*[F.lit(k) for k in (*KINDS, FOUND)])
    kind = "array<struct<start:int,kind:int,end:int>>"
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = out.withColumn("plain", plain.cast(kind)).withColumn("found", F.coalesce(F.col("more").cast(kind), F.array().cast(kind)))
    out = out.withColumn("all", F.array_sort(F.concat("plain", "found")))
    count = [_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *count, F.sha2(_listed("plain", names), 256).alias("base_sha256"), _listed("all", names).alias("spans"), F.size("found").cast("long").alias("n_found"))
