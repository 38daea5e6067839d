"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Features of a text are its distinct words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
after lower-casing A-Z) and their first 4, 5 and 6 bytes, as 64-bit hashes.

1. Voters.  Lexicons (general insults of four languages), patterns over their
   hits (several, several different, a share of the words) and learned voters.
   Every feature of the training rows is counted in both classes in Spark.  Those
   over-represented in rows labelled toxic are marked: the LEARNED_VOTERS
   strongest are voters of their own, and all marked features vote in groups of
   like strength (Z_BOUNDS).  A voter
   fires or not.  A training row's own label is one more voter, since labels
   err too.
2. Label model.  Expectation-maximisation over the votes of all documents that
   are not held out, labelled or not: each voter has a rate of firing on toxic
   and on clean documents (its accuracies), and within each class the
   correlations of all pairs of voters are estimated; a voter's evidence is
   divided by 1 + the sum of its correlations, so a word and its stem do not
   count twice.  Documents with equal votes are one row with a count; each
   round is one Spark aggregation whose result does not grow with the data.
3. Classifier.  Logistic regression on the CLASSIFIER_FEATURES strongest features
   and the groups, which cover every marked feature, fitted by
   Newton steps to the posterior labels of at most SAMPLE_ROWS labelled
   training rows (the smallest md5 of their doc_id).  This bounded sample is the
   only one; all counts, voters and the label model cover all training rows.

Rows whose crc32(doc_id as text) mod 5 is 0 are never learned from.  Labels,
lang, source and doc_id are never inputs of a score.

Defined cases.  A null or wordless text has no features and gets the
classifier's intercept.  Null labels are unlabelled; a doc_id labelled several
times counts as its largest label.  Without a training row labelled toxic and
one labelled clean only the lexicons vote.  Repeated rows count as often as they
occur.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import broadcast_if_small, held_out

# fixed word lists: common insults, one lexicon for each language
LEXICONS = {
    "en": "idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown clowns dumb fool foolish jerk garbage filthy ugly hate vile crap",
    "de": "idiot idioten dumm dummkopf abschaum müll wertlos erbärmlich widerlich versager trottel hässlich ekelhaft",
    "fr": "idiot idiote stupide imbécile ordure minable pathétique dégoûtant crétin débile nul raté abruti",
    "es": "idiota estúpido estúpida imbécil basura patético asqueroso inútil tonto perdedor escoria payaso",
}
PREFIXES = (4, 5, 6)
#: Marked features are grouped by how far the rates stand apart; those without a weight of their own have that of their group.
Z_BOUNDS = (2.0, 2.5, 3.0, 4.0, 6.0, 9.0, 14.0)
GROUPS = len(Z_BOUNDS) + 1
LEARNED_VOTERS = 40
LEAST_SUPPORT = 5
CLASSIFIER_FEATURES = 256
SAMPLE_ROWS = 50_000
EM_ROUNDS = 8
NEWTON_STEPS = 12
RIDGE = 1.0
BROADCAST_LABELS = 4_000_000


def features(p: W.Piece) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of the piece, distinct and sorted."""
    text = p.text_of_word()
    all_text, all_hash = [text], [p.word_hashes()]
    up, down = W.BYTE_POWERS[2].upto(max(len(p.data), 1))
    sums = np.zeros(len(p.data) + 1, W.U)
    np.cumsum(p.cls.table(2)[p.data] * up[: len(p.data)], out=sums[1:])
    for n in PREFIXES:
        long = np.flatnonzero(p.ends - p.starts >= n)
        s = p.starts[long]
        all_text.append(text[long])
        all_hash.append(W.mix((sums[s + n] - sums[s]) * down[s] + W.U(1000 + n)))
    text, h = np.concatenate(all_text), np.concatenate(all_hash)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]


def _hashes(words: str) -> np.ndarray:
    return np.concatenate([p.word_hashes() for p in W.pieces(pa.array([words]), W.ALNUM)])


def find(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in h, numbers in the sorted ``known``) of the values that are known."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = np.flatnonzero(known[at] == h)
    return hit, at[hit]


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (feature, clean, toxic): texts of each class that hold the feature."""
    for batch in batches:
        label = batch.column(1).to_numpy()
        for p in W.pieces(batch.column(0), W.ALNUM):
            text, h = features(p)
            known, at = np.unique(h, return_inverse=True)
            toxic = np.bincount(at[label[p.first + text] == 1], minlength=len(known))
            clean = np.bincount(at, minlength=len(known)) - toxic
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(known)), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], names=["feature", "clean", "toxic"])


class Groups:
    """All marked features, sorted, and the group (from 0) of each."""

    def __init__(self, known: np.ndarray, group: np.ndarray) -> None:
        order = np.argsort(known)
        self.known, self.group = known[order], group[order].astype(np.int8)

    def of(self, n: int, text: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Groups that occur in each text as a boolean matrix (texts x GROUPS)."""
        out = np.zeros((n, GROUPS), bool)
        hit, which = find(self.known, h)
        out[text[hit], self.group[which]] = True
        return out


def weigh(train: DataFrame) -> DataFrame | None:
    """(feature, z, marked) of every feature of LEAST_SUPPORT or more toxic training rows; z: how far its rates in the two classes stand apart."""
    rows = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(rows) < 2:
        return None
    counts = train.select("text", "toxic").mapInArrow(_class_counts, "feature long, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= LEAST_SUPPORT)
    yes, no = (F.col("toxic") + 0.5) / (rows[1] + 1), (F.col("clean") + 0.5) / (rows[0] + 1)
    z = (yes - no) / F.sqrt(yes * (1 - yes) / rows[1] + no * (1 - no) / rows[0])
    return counts.select("feature", z.alias("z"), (F.log(yes / no) > 1.5).alias("marked")).checkpoint()


def choose(weighed: DataFrame | None) -> tuple[np.ndarray, np.ndarray, Groups]:
    """(voters, classifier features), both sorted, and the groups of all marked features."""
    if weighed is None:
        return np.zeros(0, W.U), np.zeros(0, W.U), Groups(np.zeros(0, W.U), np.zeros(0))

    def known(top: DataFrame) -> np.ndarray:
        return np.sort(top.toArrow()["feature"].to_numpy().view(W.U))

    voters = weighed.filter("marked").orderBy(F.desc("z"), "feature").limit(LEARNED_VOTERS).select("feature")
    strong = weighed.orderBy(F.desc("marked"), F.desc(F.abs("z")), "feature").limit(CLASSIFIER_FEATURES).select("feature")
    marked = weighed.filter("marked").select("feature", "z").toArrow()
    groups = Groups(marked["feature"].to_numpy().view(W.U), np.searchsorted(Z_BOUNDS, marked["z"].to_numpy(), side="right"))
    return known(voters), known(strong), groups


class Votes:
    """Votes of a piece of texts as a boolean matrix (texts x voters)."""

    PATTERNS = 3

    def __init__(self, learned: np.ndarray, groups: Groups) -> None:
        self.learned, self.groups = learned, groups
        self.lexicons = [np.sort(_hashes(w)) for w in LEXICONS.values()]
        self.count = len(learned) + len(self.lexicons) + GROUPS + self.PATTERNS

    def of(self, p: W.Piece, text: np.ndarray, h: np.ndarray) -> np.ndarray:
        n = len(p.bounds) - 1
        out = np.zeros((n, self.count), bool)
        hit, which = find(self.learned, h)
        out[text[hit], which] = True
        word, word_text = p.word_hashes(), p.text_of_word()
        hits, kinds = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, lexicon in enumerate(self.lexicons):
            found = find(lexicon, word)[0]
            out[word_text[found], len(self.learned) + i] = True
            hits = np.maximum(hits, np.bincount(word_text[found], minlength=n))
            kinds = np.maximum(kinds, np.bincount(text[find(lexicon, h)[0]], minlength=n))
        out[:, -self.PATTERNS - GROUPS : -self.PATTERNS] = self.groups.of(n, text, h)
        out[:, -3] = hits >= 2
        out[:, -2] = kinds >= 2
        out[:, -1] = hits * 100 >= np.maximum(np.diff(p.bounds), 1)
        return out


class LabelModel:
    """Firing rates (voters x clean, toxic), the same for the label voter, prior, and the voters' weights."""

    def __init__(self, voters: int) -> None:
        self.rates = np.tile([0.02, 0.5], (voters, 1))
        self.label = np.array([0.05, 0.9])
        self.prior = 0.1
        self.weight = np.full(voters, 1.0 / max(voters, 1))

    def posterior(self, fired: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Probability of toxic; label: 1, 0, or -1 for none."""
        yes = np.log(self.rates[:, 1] / self.rates[:, 0]) * self.weight
        no = np.log((1 - self.rates[:, 1]) / (1 - self.rates[:, 0])) * self.weight
        odds = np.log(self.prior / (1 - self.prior)) + fired @ yes + (1 - fired) @ no
        odds += np.where(label == 1, np.log(self.label[1] / self.label[0]), 0) + np.where(label == 0, np.log((1 - self.label[1]) / (1 - self.label[0])), 0)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def statistics(self, fired: np.ndarray, label: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected counts for each class: all rows, labelled rows, rows labelled 1, and rows on which each pair of voters fires."""
        p = self.posterior(fired, label)
        out = []
        for weight in (count * (1 - p), count * p):
            out += [[weight.sum(), weight[label >= 0].sum(), weight[label == 1].sum()], (fired.T @ (fired * weight[:, None])).ravel()]
        return np.concatenate(out)

    def update(self, stats: np.ndarray) -> None:
        j = len(self.rates)
        link = np.zeros((j, j))
        total = np.zeros(2)
        for y, part in enumerate(stats.reshape(2, 3 + j * j)):
            n, labelled, ones = part[:3]
            pair = part[3:].reshape(j, j)
            total[y] = n
            self.rates[:, y] = (np.diag(pair) + 0.5) / (n + 1)
            self.label[y] = (ones + (0.05, 0.9)[y]) / (labelled + 1)
            rate = self.rates[:, y]
            spread = np.sqrt(np.outer(rate * (1 - rate), rate * (1 - rate)))
            link += n * np.abs((pair + 0.5) / (n + 1) - np.outer(rate, rate)) / spread
        link /= max(total.sum(), 1)
        np.fill_diagonal(link, 0)
        self.weight = 1 / (1 + np.minimum(link, 1).sum(axis=1))
        self.prior = float(np.clip(total[1] / max(total.sum(), 1), 1e-4, 0.5))
        self.rates = np.clip(self.rates, 1e-5, 1 - 1e-5)
        self.label = np.clip(self.label, 1e-3, 1 - 1e-3)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy()] = 1
    return out


def fit_label_model(patterns: DataFrame, voters: int, rounds: int = EM_ROUNDS) -> LabelModel:
    """EM over (votes, label, n) rows: voters that fired, label or -1, number of documents."""
    model = LabelModel(voters)
    for _ in range(rounds):
        def gather(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                total = total + model.statistics(_matrix(batch.column(0), voters), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float))
            if not np.isscalar(total):
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "v"])

        got = patterns.mapInArrow(gather, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        stats = np.zeros(2 * (3 + voters * voters))
        stats[got["at"].to_numpy()] = got["v"].to_numpy()
        fitted = LabelModel(voters)
        fitted.update(stats)
        model = fitted
    return model


def fit_classifier(x: np.ndarray, p: np.ndarray, steps: int = NEWTON_STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights and intercept (last) of a logistic regression on soft labels p."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((p.mean() + 1e-4) / (1 - p.mean() + 1e-4)) if len(p) else -3
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps if len(p) else 0):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (q - p) + penalty * w
        hess = (x * (q * (1 - q))[:, None].astype(x.dtype)).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
    return w


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    marks = broadcast_if_small(marks.filter(~held_out(F.col("doc_id"))).checkpoint(), BROADCAST_LABELS)
    open_rows = docs.filter(~held_out(F.col("doc_id")))
    train = open_rows.join(marks, "doc_id")
    learned, chosen, groups = choose(weigh(train))
    votes = Votes(learned, groups)
    if not len(chosen):
        chosen = np.unique(np.concatenate(votes.lexicons))
    width = len(chosen) + GROUPS
    sent = sc.broadcast((votes, chosen))

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text, label) to (doc_id, label, voters that fired, classifier features)."""
        ints = pa.list_(pa.int32())
        for batch in batches:
            for p in W.pieces(batch.column(1), W.ALNUM):
                n = len(p.bounds) - 1
                text, h = features(p)
                fired = sent.value[0].of(p, text, h)
                hit, which = find(sent.value[1], h)
                has = np.zeros((n, width), bool)
                has[text[hit], which] = True
                has[:, -GROUPS:] = sent.value[0].groups.of(n, text, h)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(p.first, n), batch.column(2).slice(p.first, n),
                     pa.array([np.flatnonzero(r).astype(np.int32) for r in fired], ints), pa.array([np.flatnonzero(r).astype(np.int32) for r in has], ints)],
                    names=["doc_id", "label", "votes", "has"])

    seen_rows = open_rows.join(marks, "doc_id", "left").select("doc_id", "text", F.coalesce("toxic", F.lit(-1).cast("long")).alias("label")).mapInArrow(
        observe, "doc_id long, label long, votes array<int>, has array<int>").checkpoint()
    patterns = seen_rows.groupBy("votes", "label").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    model = fit_label_model(patterns, votes.count)
    sample = seen_rows.filter("label >= 0").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE_ROWS).select("votes", "label", "has").toArrow().combine_chunks()
    x, p = np.zeros((0, width), np.float32), np.zeros(0)
    if sample.num_rows:
        fired, label, has = (sample[c].combine_chunks() if isinstance(sample[c], pa.ChunkedArray) else sample[c] for c in ("votes", "label", "has"))
        x = _matrix(has, width).astype(np.float32)
        p = model.posterior(_matrix(fired, votes.count), label.to_numpy())
    else:
        # without labels the label model's lexicon votes alone set the weights
        x = np.vstack([np.zeros((20, width)), np.eye(len(chosen), width)]).astype(np.float32)
        p = np.concatenate([np.zeros(20), np.full(len(chosen), 0.9)])
    weights = sc.broadcast((chosen, fit_classifier(x, p), groups))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w, groups = weights.value
        for batch in batches:
            for p in W.pieces(batch.column(1), W.ALNUM):
                n = len(p.bounds) - 1
                text, h = features(p)
                hit, which = find(known, h)
                odds = w[-1] + np.bincount(text[hit], w[which], minlength=n) + groups.of(n, text, h) @ w[-1 - GROUPS : -1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, n), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], names=["doc_id", "score"])

    out = docs.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
