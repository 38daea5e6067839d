"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along paths.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; terms
are words and pairs of neighbouring words.  Segments of a text are its lines,
the text as a whole, and windows of WINDOWS words across line ends, each size
at every quarter of its length: so a notice is found where it is wrapped over comment
lines, stands inside a long line, or opens a full licence text.  A segment's vector holds term frequency times inverse line frequency, counted
over all lines of all texts; terms of no template share the weight of a term
never seen, so only the templates' vocabulary (a fixed size) is ever counted and
sent.  A file's own licence is that of the template with the largest cosine over its
segments, if that is at least LEAST_COSINE; ties go to the smaller name.  A licence
may have several templates.  Windows without a rare term of a template are skipped
where the common terms of no template can reach LEAST_COSINE alone, so no match is lost.

A file without a licence of its own inherits from the nearest directory above
it that holds a licence file (base name LICENSE, LICENCE, COPYING or NOTICE,
any case and extension) with a licence; the licence of a directory with several
such files is that with the largest cosine.  Directories are resolved first,
each once, over its ancestors (path depth many rows), then files join their own
directory; a directory that holds a third of all files is one row there.

Defined cases.  Null and wordless texts have no licence of their own.  A null
path has no ancestors and inherits nothing.  A path without slash lies in the
root ``""``.  Rows that repeat a path are files of their own with one directory.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import broadcast_if_small

LEAST_COSINE = 0.5
BROADCAST_DIRS = 1_000_000
# fixed values: the customary notices of common licences
TEMPLATES = {
    "AGPL-3.0": "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004"),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under CC BY 4.0, Creative Commons Attribution",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-2.0": "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    "ISC": "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3",
                 "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    "MIT": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
#: Words of the windows laid over a text.
WINDOWS = (8, 16, 32)


def terms(p: W.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, line, term) of every word and every pair of words of one line; lines are numbered through the piece."""
    breaks = np.flatnonzero(p.data == 0x0A)
    text = p.text_of_word()
    line = np.searchsorted(breaks, p.starts) + text  # a text's end ends its line too
    h = p.word_hashes()
    pair = np.flatnonzero((line[1:] == line[:-1]) & (text[1:] == text[:-1]))
    both = W.mix(h[pair] * W.U(0x9E3779B97F4A7C15) ^ h[pair + 1])
    return np.concatenate([text, text[pair]]), np.concatenate([line, line[pair]]), np.concatenate([h, both])


class Vocabulary:
    """Terms of all templates and their counts in each (terms x templates); template t is one of licence ``names[t]``."""

    def __init__(self, templates: dict[str, str | tuple[str, ...]]) -> None:
        listed = [(name, x) for name in sorted(templates) for x in ((templates[name],) if isinstance(templates[name], str) else templates[name])]
        self.names = [name for name, _ in listed]
        found = [terms(p) for p in W.pieces(pa.array([x for _, x in listed]), W.ALNUM)]
        text, _, term = (np.concatenate(x) for x in zip(*found, strict=True))
        self.terms, at = np.unique(term, return_inverse=True)
        self.counts = np.zeros((len(self.terms), len(self.names)))
        np.add.at(self.counts, (at, text), 1)

    def find(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == term)
        return hit, at[hit]


def line_frequencies(texts: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """Lines that hold each term of the vocabulary, and all lines with words."""
    width = len(vocabulary.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, np.int64)
        for batch in batches:
            for p in W.pieces(batch.column(0), W.ALNUM):
                _, line, term = terms(p)
                hit, which = vocabulary.find(term)
                seen = np.unique(line[hit] * width + which)
                total[:-1] += np.bincount(seen % width, minlength=width)
                total[-1] += len(np.unique(line))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    got = texts.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width + 1, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out[:-1], int(out[-1])


class Scorer:
    """Cosines of segments to the templates, under given line frequencies."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, unseen: float, least: float) -> None:
        self.vocabulary, self.idf, self.unseen = vocabulary, idf, unseen
        weights = vocabulary.counts * idf[:, None]
        self.weights = weights / np.sqrt((weights**2).sum(axis=0))
        rare = idf >= unseen / 2
        alone = np.sqrt((self.weights[~rare] ** 2).sum(axis=0)).max(initial=0.0)
        #: terms of which a window must hold one to be a match
        self.rare = rare if alone < least else np.ones(len(idf), bool)

    def cosines(self, segment: np.ndarray, which: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Cosine of each segment to each template; its vocabulary terms are (segment, which), all its terms ``sizes`` many."""
        n, width = len(sizes), len(self.idf)
        key, tf = np.unique(segment * width + which, return_counts=True)
        own, which = key // width, key % width
        value = tf * self.idf[which]
        norm = np.sqrt(np.bincount(own, value**2, minlength=n) + (sizes - np.bincount(segment, minlength=n)) * self.unseen**2)
        dots = np.stack([np.bincount(own, value * self.weights[which, t], minlength=n) for t in range(self.weights.shape[1])], axis=1)
        return dots / np.maximum(norm, 1e-12)[:, None]

    def best(self, p: W.Piece) -> np.ndarray:
        """The largest cosine of each text of a piece to each template, over its lines, its whole and its windows."""
        n = len(p.bounds) - 1
        out = np.zeros((n, len(self.vocabulary.names)))
        text, line, term = terms(p)
        if not len(term):
            return out
        hit, which = self.vocabulary.find(term)
        numbers, line = np.unique(line, return_inverse=True)
        of_line = np.zeros(len(numbers), np.int64)
        of_line[line] = text
        np.maximum.at(out, of_line, self.cosines(line[hit], which, np.bincount(line, minlength=len(numbers))))
        out = np.maximum(out, self.cosines(text[hit], which, np.bincount(text, minlength=n)))
        for owner, found in self._windows(p):
            np.maximum.at(out, owner, found)
        return out

    def _windows(self, p: W.Piece) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text of each, cosines) of the windows of one size and phase that can match."""
        text, h = p.text_of_word(), p.word_hashes()
        place = np.arange(len(h)) - p.bounds[text]
        single, which = self.vocabulary.find(h)
        pair = np.flatnonzero(text[1:] == text[:-1])
        both, which2 = self.vocabulary.find(W.mix(h[pair] * W.U(0x9E3779B97F4A7C15) ^ h[pair + 1]))
        at, span = np.concatenate([single, pair[both]]), np.concatenate([np.zeros(len(single), np.int64), np.ones(len(both), np.int64)])
        which = np.concatenate([which, which2])
        for size in WINDOWS:
            for phase in range(0, size, size // 4):
                # a window begins ``phase`` words after a multiple of its size; words before the first belong to one cut off
                k = (place[at] - phase) // size
                inside = (place[at] + span - phase) // size == k
                key = text[at] * (1 << 40) + k + 1
                live = np.unique(key[inside & self.rare[which]])
                slot = np.minimum(np.searchsorted(live, key), max(len(live) - 1, 0))
                mine = np.flatnonzero(inside & (live[slot] == key)) if len(live) else np.zeros(0, np.int64)
                if not len(mine):
                    continue
                owner, first = live >> 40, ((live & ((1 << 40) - 1)) - 1) * size + phase
                total = p.bounds[owner + 1] - p.bounds[owner]
                length = np.minimum(first + size, total) - np.maximum(first, 0)
                yield owner, self.cosines(slot[mine], which[mine], 2 * length - 1)


def own_licenses(files: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """Adds ``license`` and ``cosine`` (both null where no template is near enough) to the rows (path, text, ...); text goes."""
    files = files.drop("license", "cosine")
    vocabulary = Vocabulary(templates or TEMPLATES)
    seen, lines = line_frequencies(files.select("text"), vocabulary)
    idf = np.log((lines + 1) / (seen + 1)) + 1
    unseen = float(np.log(lines + 1) + 1)
    at = files.columns.index("text")
    rest = [c for c in files.columns if c != "text"]

    scorer = Scorer(vocabulary, idf, unseen, least)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.select([i for i in range(batch.num_columns) if i != at])
            for p in W.pieces(batch.column(at), W.ALNUM):
                n = len(p.bounds) - 1
                best = np.round(scorer.best(p), 9)
                top = best.argmax(axis=1)
                value = best[np.arange(n), top]
                none = value < least
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(p.first, n) for c in others.columns], pa.array([vocabulary.names[t] for t in top], pa.string(), mask=none), pa.array(value, mask=none)],
                    names=[*rest, "license", "cosine"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "text")
    return files.mapInArrow(score, f"{kinds}, license string, cosine double")


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(files: DataFrame) -> DataFrame:
    """(path, license, cosine, ...) rows with ``origin`` (own, inherited or null) and ``from_dir``; licences filled from the nearest
    directory above.  Columns of these names that ``files`` has already are replaced; all others travel as one struct."""
    kept = [c for c in files.columns if c not in ("license", "cosine", "origin", "from_dir")]
    rows = files.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "path", "license", "cosine", _directory(F.col("path")).alias("dir")).checkpoint()
    named = rows.filter(F.lower(F.regexp_extract("path", "([^/]*)$", 1)).rlike("^(license|licence|copying|notice)([.].*)?$") & F.col("license").isNotNull())
    holders = named.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best")).select(
        F.col("dir").alias("from_dir"), F.col("best.license").alias("dir_license"), (-F.col("best.c")).alias("dir_cosine")).checkpoint()
    dirs = rows.select("dir").filter("dir IS NOT NULL").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    climbs = dirs.filter("dir != ''").select("dir", F.posexplode(above).alias("depth", "from_dir")).unionByName(
        dirs.filter("dir = ''").select("dir", F.lit(0).alias("depth"), F.col("dir").alias("from_dir")))
    nearest = climbs.join(broadcast_if_small(holders, BROADCAST_DIRS), "from_dir").groupBy("dir").agg(
        F.max(F.struct("depth", "from_dir", "dir_license", "dir_cosine")).alias("n")).select("dir", "n.from_dir", "n.dir_license", "n.dir_cosine").checkpoint()
    out = rows.join(broadcast_if_small(nearest, BROADCAST_DIRS), "dir", "left")
    own = F.col("license").isNotNull()
    return out.select(
        "row.*", F.coalesce("license", "dir_license").alias("license"), F.coalesce("cosine", "dir_cosine").alias("cosine"),
        F.when(own, "own").when(F.col("dir_license").isNotNull(), "inherited").alias("origin"), F.when(~own, F.col("from_dir")).alias("from_dir"))


def scan(files: DataFrame) -> DataFrame:
    return inherited(own_licenses(files))


def document_paths(docs: DataFrame, fanout: int = 20) -> DataFrame:
    """(doc_id, path, text): documents laid out as files for the scan.

    ``source/<doc_id div fanout**2>/<doc_id div fanout>/<doc_id>``; the first document of a
    directory of either level is its LICENSE file.  A null doc_id or source gives a null path.
    """
    i = F.col("doc_id").cast("long")
    big, small = F.floor(i / (fanout * fanout)).cast("string"), F.floor(i / fanout).cast("string")
    source = F.col("source").cast("string")
    path = (
        F.when(i % (fanout * fanout) == 0, F.concat(source, F.lit("/"), big, F.lit("/LICENSE")))
        .when(i % fanout == 0, F.concat(source, F.lit("/"), big, F.lit("/"), small, F.lit("/LICENSE")))
        .otherwise(F.concat(source, F.lit("/"), big, F.lit("/"), small, F.lit("/"), i.cast("string"), F.lit(".txt")))
    )
    return docs.select(i.alias("doc_id"), path.alias("path"), F.col("text").cast("string").alias("text"))
