"""Operators of cartpulse.llm on odd inputs and against brute-force versions."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_MID, SF_SMALL
from harness import compare

import corpus_pipeline
from cartpulse.llm import bagminhash, catalog, components, decontaminate, forest, langid, licenses, mix, pii, shard, substring, toxicity
from cartpulse.llm import words as W
from cartpulse.llm.tables import prefix_sums, ready, table
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

LONG = " ".join(f"w{i % 97}x{i}" for i in range(12000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and further columns."""
    from cartpulse.llm.tables import ready

    ready(spark)
    near = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew a potion of mild confusion near the old stone bridge at dawn " * 3
    rows = [
        (1, near, "en", "a"), (2, near + "end", "en", "a"), (2, near + "end", "en", "a"), (3, near.replace("wizards", "witches"), "en", None),
        (4, None, "en", "a"), (5, "", None, "b"), (6, "   \n\t ", "de", "b"), (7, "***", "en", "b"), (8, "one two", "en", "a"), (9, "One, two!", "en", "b"),
        (10, LONG, "en", "a"), (11, LONG + " tail", "en", None), (None, near, "en", "a"), (None, None, None, None), (12, "é ü ñ 漢字", "fr", "c"),
        (13, "you idiot stupid moron loser", "en", "c"), (14, "x" * 50000, "en", "c"), (15, "mail bo@x.org or 10.0.0.1 now", "en", "c"), (15, "another text", "en", "c"),
    ]
    rows = [(i, t, l, s, None if t is None else len(t), "extra", 1, [1], 0.5) for i, t, l, s in rows]
    odd = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, label string, size int, hits array<int>, score double").repartition(3)
    # names that the operators use for columns of their own
    own = ["row", "key", "epochs", "left", "unit", "cut_key", "copies", "_copies", "_source", "source_size", "target", "_p", "_r_source", "_hot", "id", "bands", "class_id"]
    return odd.withColumns({c: F.lit(f"own {c}") for c in own})


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, k=5):
    w = ALNUM.findall(lower(text))
    return Counter(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else Counter()


def classes_by_hand(docs):
    """doc_id -> smallest doc_id of its class, comparing all pairs that share a shingle."""
    bags = [(i, b) for i, t in docs if (b := shingles(t)) and i is not None]
    parent = {i: i for i, _ in docs if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for n, (_, b) in enumerate(bags):
        for s in b:
            holders[s].add(n)
    for a, b in {(x, y) for group in holders.values() for x in group for y in group if x < y}:
        (i, x), (j, y) = bags[a], bags[b]
        both = sum((x & y).values())
        if both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
            p, q = root(i), root(j)
            parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    ok, msg = compare(catalog.QUERIES[name](spark, SF_SMALL), catalog.ORACLES[name], SF_SMALL)
    assert ok, msg


def test_words_match_regular_expressions():
    texts = [None, "", " a  b", "a", "é Ab1-é_x\x0b\x1cy", "x\n", "\n\n", "A" * 3000 + " b"]
    for cls, pattern, low in ((W.SPACED, r"[^\x20\x09-\x0D]+", False), (W.ALNUM, ALNUM.pattern, True)):
        for size in (1, 40, 1 << 20):
            got = [[] for _ in texts]
            for p in W.pieces(pa.array(texts), cls, size):
                for i in range(len(p.bounds) - 1):
                    got[p.first + i] = [p.word_bytes(j).decode() for j in range(p.bounds[i], p.bounds[i + 1])]
            assert [[lower(w) if low else w for w in g] for g in got] == [re.findall(pattern, lower(t) if low else t or "") for t in texts]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 3), (None, 5)]
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100)}


def test_prefix_sums_span_partitions(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.col("id").alias("v"))
    got = {r["k"]: r["before"] for r in prefix_sums(rows, [F.col("k")], {"before": "v"}).collect()}
    by_key = sorted((i * 7919 % 1000, i) for i in range(1000))
    total = 0
    for k, v in by_key:
        assert got[k] == total
        total += v


# op1


def test_hilbert_neighbours_touch_and_every_cell_has_one_place():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    place = shard.hilbert(grid, bits=3)
    assert sorted(place) == list(range(512))
    path = grid[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_of_odd_rows(odd, none):
    rows = shard.shards(odd, 4).collect()
    assert len(rows) == odd.count()
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(4))
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert set(want) == {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows}
    assert shard.shards(none).count() == 0


# op2


def test_licences_and_inheritance(spark):
    ready(spark)
    rows = [
        ("r/LICENSE", "Licensed under the Apache License, Version 2.0."), ("r/a/b/x.py", "import os"), ("r/a/y.py", "# Released under the MIT License.\ncode here"),
        ("r/a/b/LICENCE.txt", "This work is licensed under the GNU General Public License, version 3."), ("r/c/z.py", None), ("top.py", ""), (None, "Released under the MIT License."),
        ("r/a/COPYING", "nothing of the kind"), ("r/a/b/x.py", "import sys"),
    ]
    files = spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, text string, dir_cosine int")
    for c in ("row", "dir", "dir_license", "from_dir", "origin", "license", "cosine", "depth"):
        files = files.withColumn(c, F.lit("own"))
    got = Counter((r["path"], r["license"], r["origin"], r["from_dir"]) for r in licenses.scan(files).collect())
    assert got == Counter([
        ("r/LICENSE", "Apache-2.0", "own", None), ("r/a/b/x.py", "GPL-3.0", "inherited", "r/a/b"), ("r/a/b/x.py", "GPL-3.0", "inherited", "r/a/b"),
        ("r/a/y.py", "MIT", "own", None), ("r/a/b/LICENCE.txt", "GPL-3.0", "own", None), ("r/c/z.py", "Apache-2.0", "inherited", "r"),
        ("top.py", None, None, None), (None, "MIT", "own", None), ("r/a/COPYING", "Apache-2.0", "inherited", "r")])
    assert licenses.scan(files.filter("false")).count() == 0


GPL_HEADER = """# Copyright (C) 2020 Somebody Else
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
import os
"""
MIT_TEXT = """Copyright (c) 2020 Somebody Else

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_wrapped_headers_full_texts_and_notices_in_long_lines(spark):
    ready(spark)
    filler = [f"word{i % 61}x{i % 7}" for i in range(130)]
    inside = " ".join(filler[:70] + ["Released under the MIT License."] + filler[70:])
    rows = [(f"src/f{i}.txt", " ".join(np.roll(filler, i)) + " the license of the house and permission") for i in range(60)]
    rows += [("a/x.py", GPL_HEADER), ("b/LICENSE", MIT_TEXT), ("b/c/y.py", "import os"), ("d/LICENSE", inside), ("d/z.py", None),
             ("e/x.c", GPL_HEADER.replace("version 3", "version 2").replace("#", " *")), ("long", " ".join(filler * 400) + "\n" + GPL_HEADER)]
    got = {r["path"]: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string").repartition(3)).collect()}
    assert {p: r["license"] for p, r in got.items() if r["license"]} == {
        "a/x.py": "GPL-3.0", "b/LICENSE": "MIT", "b/c/y.py": "MIT", "d/LICENSE": "MIT", "d/z.py": "MIT", "e/x.c": "GPL-2.0", "long": "GPL-3.0"}
    # the same cosines by hand: every line, the whole text and every window of every text
    vocabulary, bag = licenses.Vocabulary(licenses.TEMPLATES), lambda w: Counter(w) + Counter(zip(w, w[1:]))
    listed = [x for n in sorted(licenses.TEMPLATES) for x in ([licenses.TEMPLATES[n]] if isinstance(licenses.TEMPLATES[n], str) else licenses.TEMPLATES[n])]
    words = lambda t: ALNUM.findall(lower(t))
    lines = [bag(words(x)) for _, t in rows for x in (t or "").split("\n") if words(x)]
    known = {t for x in listed for t in bag(words(x))}
    idf = {t: np.log((len(lines) + 1) / (sum(t in x for x in lines) + 1)) + 1 for t in known}
    unseen = np.log(len(lines) + 1) + 1

    def cosine(a, b):
        weigh = lambda c: {t: n * idf[t] for t, n in c.items() if t in idf}
        a_, b_ = weigh(a), weigh(b)
        rest = sum(n for t, n in a.items() if t not in idf) * unseen**2
        return sum(v * b_.get(t, 0) for t, v in a_.items()) / np.sqrt(sum(v * v for v in a_.values()) + rest) / np.sqrt(sum(v * v for v in b_.values()))

    for path, text in rows[-7:-1]:
        w = words(text)
        if not w:
            continue
        segments = [bag(words(x)) for x in text.split("\n") if words(x)] + [Counter(w) + sum((Counter(zip(v, v[1:])) for v in map(words, text.split("\n"))), Counter())]
        for size in licenses.WINDOWS:
            for phase in range(0, size, size // 4):
                cuts = [0, *range(phase or size, len(w), size), len(w)]
                segments += [bag(w[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]
        scores = [(cosine(s, bag(words(x))), n) for n, x in zip(vocabulary.names, listed, strict=True) for s in segments]
        best = max(c for c, _ in scores)
        if got[path]["origin"] == "own":
            assert got[path]["cosine"] == pytest.approx(best, abs=1e-8)
        else:
            assert best < licenses.LEAST_COSINE


def test_licence_query_finds_all_notices_and_nothing_else(spark):
    got = catalog.QUERIES["op2_license_scan"](spark, SF_MID).collect()
    text = {r["doc_id"]: r["text"] for r in table(spark, SF_MID, "documents").collect()}
    notice = re.compile("Apache License|MIT License|General Public License|CC BY-NC")
    assert len(got) == len(text)
    assert {r["doc_id"] for r in got if r["origin"] == "own"} == {i for i, t in text.items() if notice.search(t)}


# op3


def test_language_of_held_out_rows(spark):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op3_mixture_language_id"](spark, SF_MID).collect()}
    docs = {r["doc_id"]: r for r in table(spark, SF_MID, "documents").collect()}
    assert set(got) == set(docs)
    held = [i for i in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i]["held_out"]} == set(held)
    assert np.mean([got[i]["lang_pred"] == docs[i]["lang"] for i in held]) >= 0.97


def test_mixture_of_two_languages(spark):
    ready(spark)
    model = langid.train(table(spark, SF_MID, "documents").select("lang", "text"))
    by = {r["lang"]: r["text"] for r in table(spark, SF_MID, "documents").filter("length(text) BETWEEN 2000 AND 3000").collect()}
    both = spark.createDataFrame([(1, by["en"][:1500] + " " + by["de"][:1500]), (2, by["fr"])], "doc_id long, text string")
    got = {r["doc_id"]: r["languages"] for r in langid.identify(both, model).collect()}
    assert set(got[1]) == {"en", "de"} and abs(got[1]["en"] - 0.5) < 0.15
    assert set(got[2]) == {"fr"}


def test_foreign_and_garbled_texts_are_rejected_and_mixtures_kept(spark):
    docs = table(spark, SF_MID, "documents")
    by = {r["lang"]: r["text"] for r in docs.filter("length(text) BETWEEN 2000 AND 3000").collect()}
    letters = list("".join(by.values())[:2000])
    np.random.default_rng(1).shuffle(letters)
    texts = ["Litwo Ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił " * 5, "".join(letters), "xq zv wk qj " * 40,
             *by.values(), " ".join(by[x][:600] for x in sorted(by)), " ".join(by[x][:900] for x in sorted(by)[:3]), by["en"][:1500] + " " + by["de"][:1500]]
    more = spark.createDataFrame([(5 * 10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    both = docs.select("doc_id", "text", "lang").unionByName(more, allowMissingColumns=True)
    kept = {r["doc_id"] for r in langid.identified(both).select("doc_id").collect()}
    assert [i - 5 * 10**6 for i in sorted(kept) if i >= 5 * 10**6] == list(range(3, len(texts)))
    assert len(kept) >= 0.99 * docs.filter("text IS NOT NULL").count()
    got = {r["doc_id"]: r for r in langid.predictions(both).filter("doc_id >= 5000000").collect()}
    # rejected or not, a text with letters gets a learned language
    assert all(r["lang_pred"] in by and r["languages"] and r["explained"] == (i in kept) for i, r in got.items())


def test_two_languages_are_found_among_many():
    logs = np.full((40, 400), -1.2, np.float32)
    logs[:20, 7], logs[20:, 7], logs[:20, 300], logs[20:, 300] = 0, -4, -4, 0
    share, _ = langid.mixture(logs, np.full(40, 30, np.float32))
    assert set(np.flatnonzero(share)) == {7, 300}


def test_language_of_odd_rows(odd, none):
    rows = langid.predictions(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (4, 5, 6, 7))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.predictions(none).count() == 0
    kept = langid.identified(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IN (4, 5, 6, 7)").count() == 0


# op4


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng = np.random.default_rng(5)
    element = W.mix(np.arange(1, 301, dtype=np.uint64))
    a, b = rng.integers(1, 20, 300), rng.integers(1, 20, 300)
    sig = bagminhash.signatures(np.repeat([0, 1], 300), np.tile(element, 2), np.concatenate([a, b]), 2, m=6000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 6000)


def test_near_duplicates_match_all_pairs(spark):
    got = {r["doc_id"]: r["class_id"] for r in catalog.QUERIES["op4_bagminhash_near_duplicates"](spark, SF_MID).collect()}
    assert got == classes_by_hand([(r["doc_id"], r["text"]) for r in table(spark, SF_MID, "documents").collect()])


def test_many_near_copies_around_the_threshold(spark):
    ready(spark)
    rng = np.random.default_rng(3)
    base = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            words[at] = f"other{i}_{at}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_hand(rows)


def test_near_duplicates_of_odd_rows(odd, none):
    rows = bagminhash.near_duplicate_classes(odd).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(rows) == odd.count()
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10, 11: 10, None: None, 12: 12, 13: 13, 14: 14, 15: 15} | {3: got[3]}
    kept = bagminhash.one_of_each(odd)
    assert kept.columns == odd.columns
    left = Counter(r["doc_id"] for r in kept.collect())
    assert left == Counter({i: 1 for i in set(got.values()) - {None}} | {None: 2})
    assert bagminhash.near_duplicate_classes(none).count() == 0


def test_pairs_of_a_group_just_under_the_threshold_grow_with_the_group(spark):
    ready(spark)
    rng = np.random.default_rng(11)
    counts = []
    for m in (250, 1000):
        base = [f"w{i}" for i in range(90)]
        texts = []
        for i in range(m):
            w = list(base)
            for at in rng.choice(90, 3, replace=False):
                w[at] = f"n{i}x{at}"
            texts.append((i, " ".join(w)))
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        nodes = docs.selectExpr("doc_id AS id", "doc_id AS label")
        rows = bagminhash.prefixes(nodes, docs, 0.8)
        found = {(r["a"], r["b"]) for r in bagminhash.prefix_pairs(rows, nodes.filter("false"), 0.8, False).collect()}
        counts.append(len(found))
        bags = [shingles(t) for _, t in texts]
        near = {(a, b) for a in range(0, m, 5) for b in range(a + 1, m) if (x := sum((bags[a] & bags[b]).values())) >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - x)}
        assert near <= found
    assert counts[1] <= 4 * max(counts[0], 50)


# op5


def test_patterns_are_found_at_every_place():
    rng = np.random.default_rng(9)
    for size in (1, 2, 3, 10):
        texts = [" ".join(rng.choice(["a", "b", "c"], 400)) for _ in range(3)] + ["", "a"]
        strings = sorted({" ".join(rng.choice(["a", "b", "c"], size)) for _ in range(40)})
        pat = decontaminate.Patterns.build(strings, size)
        for p in W.pieces(pa.array(texts), W.ALNUM):
            low = p.cls.case.astype(np.uint8)[p.data]
            got = sorted((s, pat.strings[k].decode()) for s, k in pat.find(p, p.word_hashes(), p.text_of_word(), low))
            words = [w for t in texts for w in t.split()]
            want = sorted((int(p.bounds[i]) + s, " ".join(ws[s : s + size])) for i, t in enumerate(texts) for ws in (t.split(),)
                          for s in range(len(ws) - size + 1) if " ".join(ws[s : s + size]) in strings)
            assert got == want and len(words) == len(p.starts)


def test_contamination_of_odd_rows_in_one_and_many_blocks(spark, odd, none):
    items = [(1, "The quick brown fox jumps over the lazy dog while SEVEN wizards"), (2, "two"), (2, "two"), (3, None), (None, "another text"), (4, "***"), (5, "never seen here at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {(r["doc_id"], r["n_words"]): r.asDict() for r in decontaminate.contamination(odd, bench).collect()}
    many = {(r["doc_id"], r["n_words"]): r.asDict() for r in decontaminate.contamination(odd, bench, block_windows=2).collect()}
    assert one == many and decontaminate.contamination(odd, bench).count() == odd.count()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (one[8, 2]["n_hit"], one[8, 2]["n_items"], one[8, 2]["items_sha256"]) == (1, 1, sha("2"))
    assert (one[15, 2]["n_hit"], one[15, 2]["n_items"], one[15, 2]["contaminated"]) == (2, 0, True)
    assert (one[4, 0]["n_words"], one[4, 0]["contaminated"], one[4, 0]["items_sha256"]) == (0, False, sha(""))
    first = next(v for (i, _), v in one.items() if i == 1)
    assert (first["n_hit"], first["n_items"]) == (36, 1)
    clean = decontaminate.without_benchmark(odd, bench, block_windows=2)
    gone = {k[0] for k, v in one.items() if v["contaminated"]}
    assert clean.columns == odd.columns
    assert clean.count() == sum(1 for r in odd.collect() if not one[r["doc_id"], len(ALNUM.findall(lower(r["text"])))]["contaminated"])
    assert gone == {1, 2, 3, 8, 9, 15, None}
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(odd, bench.filter("false")).filter("contaminated").count() == 0


# op6


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else SF_MID
    got = catalog.QUERIES["op6_weak_supervision_toxicity"](spark, sf).filter("held_out").join(table(spark, sf, "labels"), "doc_id").toPandas()
    rank, one = got["score"].rank(), got["toxic"] == 1
    auc = (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())
    assert auc >= 0.95
    assert (got["predicted"] == (got["score"] >= 0.5)).all()


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(13, 1, 1), (13, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.filter("false")):
        rows = toxicity.scores(odd, marks).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        by = {r["doc_id"]: r["score"] for r in rows}
        assert by[13] > max(v for k, v in by.items() if k != 13)
        assert by[4] == by[5] == by[6]
    assert toxicity.scores(none, labels).count() == 0


def test_many_rarer_toxic_words_are_all_learned(spark):
    ready(spark)
    rng = np.random.default_rng(8)
    common = [f"common{i}" for i in range(200)]
    bad = ["".join(rng.choice(list("abcdefghij"), 9)) for _ in range(200)]
    rows, marks = [], []
    for i in range(12000):
        toxic = i % 4 == 0
        words = list(rng.choice(common, 12)) + ([bad[i // 4 % 200]] if toxic else [])
        rows.append((i, " ".join(rng.permutation(words))))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, labels).filter("held_out").collect()}
    assert len(got) > 2000 and np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in got]) >= 0.97


def test_label_model_recovers_rates():
    rng = np.random.default_rng(2)
    y = rng.random(20000) < 0.2
    rates = np.array([[0.02, 0.7], [0.05, 0.6], [0.01, 0.5]])
    fired = (rng.random((20000, 3)) < np.where(y[:, None], rates[:, 1], rates[:, 0])).astype(float)
    model = toxicity.LabelModel(3)
    for _ in range(30):
        stats = model.statistics(fired, np.full(20000, -1), np.ones(20000))
        model = toxicity.LabelModel(3)
        model.update(stats)
    assert np.abs(model.rates - rates).max() < 0.08 and abs(model.prior - 0.2) < 0.05


# op7


def removed_by_hand(docs, k=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for s in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[s : s + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - k + 1):
            if i is not None and first[tuple(w[s : s + k])] < i:
                gone |= set(range(s, s + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_substrings_match_all_windows(spark, odd, none, limit):
    rng = np.random.default_rng(4)
    texts = []
    for i in range(40):
        parts = [" ".join(rng.choice(["a", "b"], rng.integers(0, 30))) for _ in range(3)] + ["p q r s t u v w x y z 1 2 3 4"] * int(rng.integers(0, 2))
        texts.append((i % 37, "  ".join(parts)))
    extra = spark.createDataFrame(texts, "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra.withColumn("doc_id", F.col("doc_id") + 100))
    got = substring.duplicate_spans(docs, broadcast_rows=limit)
    rows = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect())
    assert rows == removed_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert substring.duplicate_spans(none).count() == 0


def test_factors_cut_at_gaps_and_references():
    assert substring.factors(np.array([3, 4, 5, 9, 10]), np.array([1, 1, 2, 2, 2])) == [(3, 14, 1), (5, 13, 2), (9, 14, 2)]


# op8


def test_mix_of_odd_rows(odd, none):
    rows = mix.mixture(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for own in by.values():
        target, n = own[0]["target"], own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - target) <= 2 and sum(r["size"] for r in own) == n and target <= 3 * n
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    whole = mix.mixed(odd)
    assert whole.columns == odd.columns
    assert mix.mixture(none).count() == 0 and mix.mixed(none).count() == 0


# op9


def test_forest_recall_and_exact_scores(spark):
    got = defaultdict(list)
    for r in catalog.QUERIES["op9_hash_prefix_forest"](spark, SF_MID).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    rows = table(spark, SF_MID, "embeddings").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    recall = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[i]
        s[i] = -2
        best = set(ids[np.argsort(-s)[:5]].tolist())
        found = got[int(ids[i])]
        assert [x[2] for x in found] == [1, 2, 3, 4, 5]
        assert all(abs(s[np.flatnonzero(ids == j)[0]] - score) < 1e-12 for j, score, _ in found)
        recall.append(len(best & {j for j, _, _ in found}) / 5)
    assert np.mean(recall) >= 0.9


def test_forest_recall_on_a_full_block():
    v = np.random.default_rng(1).standard_normal((forest.BLOCK_ROWS, 64))
    ids = np.arange(len(v))
    q = ids[::50]
    assert 5 * forest.LEAST < len(v)
    found = defaultdict(set)
    for i, j, _ in zip(*forest.Forest(v).search(ids, v[q], q, 5)):
        found[i].add(j)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit[q] @ unit.T
    near[np.arange(len(q)), q] = -2
    best = np.argsort(-near, axis=1)[:, :5]
    assert np.mean([len(found[i] & set(b.tolist())) / 5 for i, b in zip(q.tolist(), best)]) >= 0.95


def test_forest_of_odd_vectors(spark):
    ready(spark)
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]),
            (7, [None, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (100, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, block int")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in forest.nearest(vectors).orderBy("query_id", "rank").collect()]
    half = round(0.5**0.5, 9)
    assert got == [(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 2, half), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, half)]
    many = forest.nearest(vectors, block_rows=2, query_rows=1).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in many] == got
    assert forest.nearest(vectors.filter("false")).count() == 0


def test_repeats_of_a_vector_reach_no_block(spark, monkeypatch):
    ready(spark)
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(1, 101)] + [(50, rng.standard_normal(8).tolist()) for _ in range(2000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    least = min(v for i, v in rows if i == 50)
    want = spark.createDataFrame([r for r in rows if r[0] != 50] + [(50, least)], vectors.schema)
    want = [tuple(r) for r in forest.nearest(want).orderBy("query_id", "rank").collect()]
    handed, apply = spark.sparkContext.accumulator(0), PandasCogroupedOps.applyInPandas

    def counted(self, func, schema):
        def count(own, queries):
            handed.add(len(own))
            return func(own, queries)

        return apply(self, count, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", counted)
    got = forest.nearest(vectors)
    assert [tuple(r) for r in got.coalesce(1).sortWithinPartitions("query_id", "rank").collect()] == want
    assert handed.value == 100


# op10

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        luhn = sum((int(c) * 2 - (9 if int(c) > 4 else 0)) if i % 2 else int(c) for i, c in enumerate(digits[::-1]))
        return 14 <= len(digits) <= 19 and luhn % 10 == 0
    return True


def test_base_spans_match_the_patterns(spark, odd, none):
    texts = ["a@b.c_x@y.z a@b a@b@c.d 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0004", "4111 1111 1111 1111 2", "4111-1111-1111-1111", "é漢 +1 (555) 123-4567 +1 555",
             "a" * 5000 + "@b.c", "1 " * 3000, "+1" * 2000, "9" * 3000, "x@y.z.", "%a@b.c%d@e.f", "0000.0.0.0", "4242424242424242 4242424242424242", "12.3.4.5678", "٣@a.b +12345678901234567890"]
    docs = odd.select("doc_id", "text", "label").unionByName(spark.createDataFrame([(1000 + i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string"))
    docs = docs.unionByName(table(spark, SF_SMALL, "documents").select((F.col("doc_id") + 5000).alias("doc_id"), "text", F.lit("y").alias("label")))
    want = Counter()
    for r in docs.collect():
        found = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, r["text"] or "") if valid(k, m.group()))
        counts = Counter(x[3] for x in found)
        want[(r["doc_id"], *(counts[k] for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).encode()).hexdigest())] += 1
    rows = pii.personal_data(docs).collect()
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == want
    assert pii.personal_data(none).count() == 0


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    ready(spark)
    rows = [(i, f"please write to member p{i}@site{i}.org today thanks") for i in range(30)]
    rows += [(100, "please write to member AB77-33XK-9 today thanks"), (101, "we shipped version 2.0.1-beta9 quietly yesterday")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "id:23:34" and got[101] == "" and got[3].startswith("email:")


def test_found_identifiers_lead_to_further_identifiers(spark):
    ready(spark)
    rows = [(i, f"please write to member p{i}@site{i}.org today thanks") for i in range(30)]
    rows += [(100 + i, f"please write to member QX{i}0-7Z-00 today thanks") for i in range(8)]
    # the identifiers of a step stand in its context and, found, open that of the next; no seed stands there
    for step in range(6):
        rows += [(1000 * (step + 1) + i, f"left{step} mark{step} QX{i}0-7Z-{step}{step} right{step}") for i in range(8)]
        rows += [(1000 * (step + 1) + 100 + i, f"left{step} mark{step} QX{i}0-7Z-{step + 1}{step + 1} right{step}") for i in range(8)]
    rows += [(9000, "we shipped version 2.0.1-beta9 quietly yesterday")]
    got = {r["doc_id"]: r["n_found"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(100 <= i < 9000) for i, _ in rows}


# pipeline


def test_pipeline_matches_its_stages_by_hand(spark):
    docs = {r["doc_id"]: r for r in table(spark, SF_SMALL, "documents").collect()}
    pred = {r["doc_id"]: r for r in langid.identify(table(spark, SF_SMALL, "documents"), langid.train(
        table(spark, SF_SMALL, "documents").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("lang", "text"))).collect()}
    left = {i: r for i, r in docs.items() if pred[i]["explained"]}
    groups = classes_by_hand([(i, r["text"]) for i, r in left.items()])
    left = {i: r for i, r in left.items() if groups[i] == i}
    windows = set()
    for r in table(spark, SF_SMALL, "benchmark").collect():
        w = ALNUM.findall(lower(r["text"]))
        windows |= {tuple(w[s : s + 10]) for s in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        w = ALNUM.findall(lower(text))
        return not any(tuple(w[s : s + n]) in windows for n in sizes for s in range(len(w) - n + 1))

    left = {i: r for i, r in left.items() if clean(r["text"])}
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    taken = Counter(r["doc_id"] for r in rows)
    assert set(taken) <= set(left) and max(taken.values()) <= 3
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in left.items()}
    for source in {r["source"] for r in left.values()}:
        own = [i for i in left if left[i]["source"] == source]
        order = sorted(own, key=lambda i: hashlib.md5(f"{i}|{left[i]['text']}".encode()).hexdigest())
        counts = [taken[i] for i in order if size[i]]
        assert counts == sorted(counts, reverse=True) and max(counts) - min(counts) <= 1
    shards = Counter(r["shard"] for r in rows)
    assert max(shards.values()) - min(shards.values()) <= 1


def test_pipeline_stages_pass_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, SF_SMALL)
            assert kept.columns == docs.columns
            docs = kept.checkpoint()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()
