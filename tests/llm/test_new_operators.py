"""Phrases, URL filter and ranked search against brute-force versions and on odd inputs."""

import math
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartpulse.llm import marks, phrases, ranked, urls
from cartpulse.llm.tables import hot_join, ready

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def test_hot_keys_and_others_join_alike(spark):
    ready(spark)
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "k string, id long"))
    table = rows.filter("k IS NOT NULL AND id % 2 = 0").select("k").distinct().withColumn("v", F.length("k"))
    got = {r["id"]: r["v"] for r in hot_join(rows, table, "k").collect()}
    want = {r["id"]: r["v"] for r in rows.join(table, "k", "left").collect()}
    assert got == want and len(got) == 3001


# op11


def phrases_by_hand(docs, least, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, ph, a, l, r, n[lang], s) for i, (s, a, ph, l, r) in enumerate(rows[:top])]
    return sorted(out)


def _rows(df):
    return sorted(tuple(r)[:8] for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    few = [f"{a}{b}" for a in ("ka", "Lo", "mi") for b in ("t", "né", "x-1")]
    docs = [(" ".join(rng.choice(few, 30)) + ". " + ", ".join(" ".join(rng.choice(few, 4)) for _ in range(5)), str(rng.choice(["en", "de"]))) for _ in range(40)]
    passage = "one passage of many words that stands in several texts and reads the same everywhere; again again again again again again"
    docs += [(passage, "en")] * 7 + [(passage.upper(), None)] * 4 + [(f"{passage} tail{i}", "und") for i in range(3)]
    docs += [(None, "en"), ("", None), (" \t ", "en"), (".,;:!?\n\r\x0b\x0c", "en"), ("z" * 40000, "en"), ("solo", "xx"), (" ".join(["same"] * 5000), "fr")]
    return docs


@pytest.mark.parametrize("least", [2, 4, 9])
def test_phrases_match_all_runs_by_hand(spark, texts, least):
    ready(spark)
    df = spark.createDataFrame([(t, l, 1, "x", 5) for t, l in texts], "text string, lang string, n int, phrase string, rank int").repartition(4)
    assert _rows(phrases.collocations(df, least)) == phrases_by_hand(texts, least)


def test_phrases_of_many_flushes_and_a_short_list(spark, texts, monkeypatch):
    ready(spark)
    monkeypatch.setattr(phrases, "HELD_RUNS", 50)
    df = spark.createDataFrame(texts, "text string, lang string").repartition(2)
    assert _rows(phrases.collocations(df, 3, top=5)) == phrases_by_hand(texts, 3, top=5)
    assert phrases.collocations(df.filter("false"), 3).count() == 0


def test_a_repeated_passage_is_one_path(spark, texts):
    ready(spark)
    df = spark.createDataFrame(texts, "text string, lang string").filter("lang = 'und' OR lang IS NULL")
    edges, vocabulary = phrases.graph(df, 2)
    paths = phrases.compact_paths(phrases.flows(edges, 2).checkpoint()).collect()
    # of the passage's two pieces, the first is one path of 15 words, the second ends in a loop of one edge
    assert Counter(r["path_words"] for r in paths) == {15: 11, 5: 1}
    first = [r for r in paths if r["path_words"] == 15]
    assert sorted(r["place"] for r in first) == list(range(11)) and len({r["path"] for r in first}) == 1


def test_tasks_list_no_frequent_pairs_for_the_edges(spark):
    ready(spark)
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(30)], 40)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 200)], names=["text", "lang"])
    # every word and pair is frequent and no triple: counted before, they leave nothing for the edges
    runs = np.unique(np.concatenate([phrases._run_hash(w, k) for _, _, w, _ in phrases._pieces(batch) for k in (1, 2)]))
    bits = marks.marked(marks.no_bits(), spark.createDataFrame([(int(x),) for x in runs.view(np.int64)], "h long"))
    made = phrases._edge_counter(SimpleNamespace(value=bits))(iter([batch]))
    assert sum(b.num_rows for b in made) <= 1
    edges, _ = phrases.graph(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(7), 5)
    pairs = Counter(p for t in texts for p in zip(t.split(), t.split()[1:], strict=False))
    got = edges.filter("w2 IS NOT NULL AND w3 IS NULL").collect()
    assert sorted(r["n"] for r in got) == sorted(n for n in pairs.values() if n >= 5) and len({(r["w1"], r["w2"]) for r in got}) == len(got)


def test_runs_that_share_a_code_get_their_own_words(spark, texts, monkeypatch):
    ready(spark)
    monkeypatch.setattr(phrases, "CODE_BITS", 1)
    df = spark.createDataFrame(texts, "text string, lang string").repartition(3)
    assert _rows(phrases.collocations(df, 3)) == phrases_by_hand(texts, 3)


def test_marked_hashes_are_found(spark):
    ready(spark)
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 1000).astype(phrases.W.U) * phrases.W.U(2)
    bits = marks.marked(marks.no_bits(), spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long"))
    assert marks.Marks(bits).has(h).all()
    assert marks.Marks(bits).has(marks.W.mix(h + marks.W.U(1))).mean() < 0.01


# op12

ODD_URLS = [
    "http://Example.ORG/es/1", "https://example.org/en/12?x", "http://a.example.org/en/2#t", "http://org", "http://org/", "http://notexample.org/es/",
    "http://shop.com/fr/x", "http://shop.com/de/", "http://com/de/x", "http://shop.com:80/de/", None, "", "no scheme", "http://", "://x.com/fr/", "a://b://c.org/d",
    "http://thebestcasino.net/Win/99", "http://the-best-9-shop.net/win?u=http://org/", "http://ünïcode.net/é/ö1", "http://" + "z" * 300 + ".net/" + "y" * 9000,
    "http://thebest.org/a", "http://shop.com/fr/best", "http://x.com?y/fr/", "http://x.com#/fr/", "HTTP://THEBEST.NET/WIN", "http://line.net/a\nb?c",
]


def judged_by_hand(rows, rules=urls.RULES, seeds=urls.SEEDS):
    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        return lower(host), re.match(r"[^?#]*", rest[len(host) :]).group()

    def rule(host, path):
        fit = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    count = Counter(w for _, _, html in rows for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(re.sub("<[^>]*>", " ", html or ""))) if re.fullmatch("[a-z]{1,20}", w))
    total = sum(count.values()) + 1
    for s in seeds:
        count[s] = max(count[s], total // 10000 + 1)

    def split(run):
        best = [(0, [])]
        for e in range(1, len(run) + 1):
            ways = []
            for b in range(max(0, e - 20), e):
                w = run[b:e]
                c = math.floor(1000 * (math.log(total) - math.log(count[w]))) if w in count else math.floor(1000 * math.log(total)) + 2303 * (e - b - 1)
                ways.append((best[b][0] + c, b))
            c, b = min(ways)
            best.append((c, best[b][1] + [run[b:e]]))
        return best[-1][1]

    def tokens(host, path):
        out = []
        for run in re.findall(urls.TOKEN, host):
            out += [f"h:{w}" for w in (split(run) if "a" <= run[0] <= "z" else ["0"] if run[0].isascii() else [run])]
        return out + [f"p:{t}" for t in re.findall(urls.TOKEN, re.sub("[0-9]+", "0", lower(path)))]

    judged = [(i, *parts(u), *rule(*parts(u))) for i, u, _ in rows]
    b, a = Counter(), Counter()
    for _, h, p, v, _ in judged:
        if v:
            (b if v == "block" else a).update(tokens(h, p))
    extra = sum(b.values()) // 100 + 1
    for s in seeds:
        b["h:" + s] += extra
    all_b, all_a, v = sum(b.values()), sum(a.values()), len(set(b) | set(a))
    prior = math.floor(1000 * math.log((sum(j[3] == "block" for j in judged) + 1) / (sum(j[3] == "allow" for j in judged) + 1)))
    out = []
    for i, h, p, verdict, name in judged:
        score = None
        if verdict is None:
            score = prior + sum(
                math.floor(1000 * math.log((b[t] + 1) / (all_b + v))) - math.floor(1000 * math.log((a[t] + 1) / (all_a + v))) for t in tokens(h, p) if t in b or t in a)
            verdict = "block" if score > 0 else "allow"
        out.append((i, h, p, name, verdict, score))
    return sorted(out, key=str)


def test_urls_match_by_hand(spark):
    ready(spark)
    html = "<html><p class='casino'>The best shop wins. The BEST bets</p> win z9 é"
    rows = [(i, u, html if i % 3 else None) for i, u in enumerate(ODD_URLS)] + [(3, "http://thebest.net/win", ""), (3, "http://thebest.net/win", ""), (None, "http://bestshop.net/", html)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, host string, n int, verdict string").repartition(3)
    assert sorted((tuple(r) for r in urls.judged(df).collect()), key=str) == judged_by_hand(rows)
    assert urls.judged(df.filter("false")).count() == 0


def test_urls_without_a_rule_that_fits(spark):
    ready(spark)
    rows = [(1, "http://bestshop.net/a", "best shop"), (2, "http://bestbets.net/a", None)]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == judged_by_hand(rows)


def test_viterbi_splits_by_shares():
    known = {"the": 50, "best": 5, "shop": 5, "bests": 1, "hop": 1}
    total = 100

    def split(run):
        hits = [(b, e, math.floor(1000 * math.log(total / known[run[b:e]]))) for b in range(len(run)) for e in range(b + 1, len(run) + 1) if run[b:e] in known]
        return urls._viterbi(run, hits, total)

    assert split("thebestshop") == ["the", "best", "shop"]
    assert split("qqqthe") == ["qqq", "the"] and split("") == []


# op13


def ranked_by_hand(docs, items, top=20):
    docs = [(i, TERM.findall(lower(t))) for i, t in docs]
    n, total = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in docs:
            tf, m, score = Counter(w), 75 + (25 * len(w) * n) // max(total, 1), 0
            for t in TERM.findall(lower(text)):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library():
    rng = np.random.default_rng(3)
    vocab = ["the", "of", "and", "Über", "x1", "漢字"] + [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, len(vocab) + 1)
    text = lambda n: " ".join(rng.choice(vocab, n, p=share / share.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(200)]
    docs += [(5, docs[7][1]), (900, docs[7][1]), (901, docs[7][1]), (None, docs[7][1]), (902, None), (903, ""), (904, " .,-"), (905, "The the THE of"), (906, text(30000))]
    items = [(i, "the of and " + text(int(rng.integers(1, 15)))) for i in range(30)]
    items += [(40, text(200)), (41, None), (42, ""), (43, "unseen words only"), (44, "the"), (45, docs[7][1]), (None, "of x1 x1 x1"), (46, "THE, of; the?"), (47, items[3][1])]
    return docs, items


@pytest.mark.parametrize("block_terms", [10_000, 40])
def test_ranking_matches_by_hand(spark, library, block_terms):
    ready(spark)
    docs, items = library
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, score string").repartition(3)
    q = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, doc_id int").repartition(2)
    got = ranked.ranked(d, q, block_terms=block_terms)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked_by_hand(docs, items)
    assert ranked.ranked(d.filter("false"), q).count() == 0 and ranked.ranked(d, q.filter("false")).count() == 0
    assert dict(got.dtypes)["rank"] == "int"


def test_scores_do_not_depend_on_how_many_documents_are_held(spark, library, monkeypatch):
    ready(spark)
    monkeypatch.setattr(ranked, "CELLS", 1)
    docs, items = library
    small = docs[:60]
    got = ranked.ranked(spark.createDataFrame(small, "doc_id long, text string"), spark.createDataFrame(items[:8], "item_id long, text string"), top=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked_by_hand(small, items[:8], 3)


def test_items_share_nodes_and_classes(spark):
    ready(spark)
    items = spark.createDataFrame([(1, "a b c d x y"), (2, "a b c d z z"), (3, "a b e"), (4, "q")], "item long, text string")
    paths, classes = ranked.query_graph(items)
    kinds = {r["t"]: r["class"] for r in classes.collect()}
    # {a, b}, {c, d}, {x, y}, {z}, {e}, {q}
    assert len(kinds) == 9 and len(set(kinds.values())) == 6
    path = {r["item"]: r["path"] for r in paths.collect()}
    assert [s["shared"] for s in path[1]] == [True, True, False] and [s["shared"] for s in path[3]] == [True, False]
    assert path[1][1]["node"] == path[2][1]["node"] and path[1][0]["node"] == path[3][0]["node"] and path[4][0]["shared"] is False
