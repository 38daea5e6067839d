"""Language ID by mixtures: expectation-maximisation over n-gram likelihoods.

A document is a bag of byte n-grams (SIZE bytes of words ``[^\\x20\\x09-\\x0D]+``
with A-Z lower-cased and a space at each side), hashed into 2**SLOT_BITS slots.  Training counts every n-gram of every training document in Spark, one
row for each (language, slot); the model is the smoothed log-likelihood of a
slot in each language.  Its size is languages x slots, whatever the corpus;
languages beyond MAX_LANGUAGES raise, so nothing unbounded is collected.

A document's text is explained as a mixture: EM estimates the share of each
language, starting from equal shares.  The languages are then dropped one by
one, least share first; each set is fitted again, and the set with the best
penalised likelihood (log-likelihood minus PENALTY * ln(n-grams) for each
language) is kept.  Where no shares of any languages can beat the best single
one (a bound, since the rounds may stop short), the other sets are not fitted.  The prediction is the language with the largest share,
ties to the smaller name; the score is that share times the posterior of the
language in the first place (how far the best single language stands above the
others, tempered by the repetition of n-grams), so short texts score low.

The score compares languages with each other; whether any of them explains the
text at all is decided apart.  A text's fit is its mean gain per n-gram: the
log-likelihood under its mixture over that of a background where every slot is
equally likely, plus the entropy of the shares (a mixture does not know the
language of an n-gram), plus SLACK standard errors of that mean.  The bar is the
fit that all but REJECTED of the training rows reach, each judged by the counts
of the others.  Texts under the bar are not ``explained``: garbled, or in no learned
language.  They still get the learned languages that fit best; the stage of the
pipeline drops them.  With fewer than 1 / REJECTED training rows the bar is their least fit.

Defined cases.  A null text or one without any letter (Unicode category L) is
``und`` with score 0, has no shares and is not explained.  Training ignores null
texts and null languages.  Without any training row every document is ``und``.  Repeated rows
count as often as they occur.  An empty table gives an empty result.  Columns
other than doc_id, text and (for training) lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import held_out

SIZE = 3
SLOT_BITS = 16
MAX_LANGUAGES = 512
SMOOTHING = 0.5
EM_ROUNDS = 8
#: Cost of each further language, times the logarithm of the number of n-grams.
PENALTY = 2.0
#: n-grams overlap and repeat, so a text counts as this share of its n-grams when evidence is weighed.
EVIDENCE = 0.05
PIECE = 1 << 18
#: The score rejects nothing; texts that no language explains have no shares.
LEAST_SCORE = 0.0
SLACK = 3.0
#: The share of the training rows that may lie under the bar, and the width of the bins their fits are counted in.
REJECTED = 1e-4
BIN = 0.01
LETTER = regex.compile(r"\p{L}")


def slots(p: W.Piece) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every n-gram of the piece; n-grams that hold a space other than at an end are left out."""
    n = len(p.rows) - 1
    shift = np.repeat(np.arange(1, n + 1), np.diff(p.rows))
    # every text between two spaces, every space byte a space
    data = np.full(len(p.data) + n + 1, 0x20, np.uint8)
    data[np.arange(len(p.data)) + shift] = np.where(p.cls.word, p.cls.case, 0x20).astype(np.uint8)[p.data]
    text = np.repeat(np.arange(n, dtype=np.uint32), np.diff(p.rows) + 1)
    m = max(len(data) - SIZE + 1, 0)
    key, inner = np.zeros(m, W.U), np.zeros(m, bool)
    for j in range(SIZE):
        part = data[j : j + m]
        key = (key << W.U(8)) | part
        if 0 < j < SIZE - 1:
            inner |= part == 0x20
    good = np.flatnonzero(~inner)
    slot = W.mix(key[good] + W.U(1)) >> W.U(64 - SLOT_BITS)
    return text[good], slot.astype(np.uint32)


def grams(p: W.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, count) over the n-grams of the piece, sorted by text and slot."""
    text, slot = slots(p)
    key = np.sort((text << np.uint32(SLOT_BITS)) | slot)
    first = np.flatnonzero(np.append(np.ones(min(len(key), 1), bool), key[1:] != key[:-1]))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint32(SLOT_BITS)).astype(np.int64), (key & np.uint32((1 << SLOT_BITS) - 1)).astype(np.int64), count


def _lowered() -> W.ByteClass:
    same = np.arange(256)
    return W.ByteClass(W.SPACED.word, np.where((same >= 0x41) & (same <= 0x5A), same + 32, same))


BYTES = _lowered()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, slot, n): one row for each language and slot of the partition."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for p in W.pieces(batch.column(1), BYTES, PIECE):
            text, slot = slots(p)
            own = langs[p.first : p.first + len(p.rows) - 1]
            for lang in set(own.tolist()):
                totals.setdefault(lang, np.zeros(1 << SLOT_BITS, np.int64))
                totals[lang] += np.bincount(slot[(own == lang)[text]], minlength=1 << SLOT_BITS)
        if len(totals) > MAX_LANGUAGES:
            yield from _flush(totals)
            totals = {}
    yield from _flush(totals)


def _flush(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, n in totals.items():
        slots = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots), pa.array(n[slots])], names=["lang", "slot", "n"])


class Model(NamedTuple):
    """Languages in order, their log-likelihoods (slots x languages) less the largest of each slot,
    that largest one over the background's, the n-grams of each language (smoothed), and the least fit that is accepted."""

    langs: list[str]
    table: np.ndarray
    base: np.ndarray
    total: np.ndarray
    bar: float = -np.inf


def train(rows: DataFrame) -> Model:
    """The model of (lang, text) rows."""
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = (
        rows.mapInArrow(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).checkpoint()
    )
    langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((1 << SLOT_BITS, max(len(langs), 1)), SMOOTHING)
    got = counts.toArrow()
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        at = np.array([place[x] for x in got["lang"].to_pylist()], np.int64)
        table[got["slot"].to_numpy(), at] += got["n"].to_numpy()
    total = table.sum(axis=0)
    logs = np.log(table / total)
    top = logs.max(axis=1, keepdims=True)
    model = Model(langs, (logs - top).astype(np.float32), (top[:, 0] + np.log(len(logs))).astype(np.float32), total)
    return model._replace(bar=_bar(rows, model)) if langs else model


def _without(model: Model, slot: np.ndarray, count: np.ndarray, own: int) -> np.ndarray:
    """Log-likelihoods (slots x languages, relative) of a training text's slots without its own counts in its language."""
    logs = model.table[slot]
    seen = np.exp(logs[:, own] + model.base[slot].astype(np.float64)) / len(model.table) * model.total[own]
    rest = np.maximum(seen - count, SMOOTHING) / max(model.total[own] - count.sum(), SMOOTHING * len(model.table))
    logs[:, own] = np.log(rest * len(model.table)) - model.base[slot]
    return logs


def fitness(logs: np.ndarray, base: np.ndarray, count: np.ndarray, share: np.ndarray) -> float:
    """Mean gain of a text's mixture over the background per n-gram, with the entropy of the shares and SLACK standard errors."""
    n = float(count.sum())
    gain = np.log(np.exp(logs.astype(np.float64)) @ share) + base
    mean = float(count @ gain) / n
    error = np.sqrt(max(float(count @ (gain - mean) ** 2), 0.0)) / n
    some = share[share > 0]
    return mean - float(some @ np.log(some)) + SLACK * error


def _bar(rows: DataFrame, model: Model) -> float:
    """The fit that all but REJECTED of the training rows with a letter reach, rounded down to a bin."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        place = {x: i for i, x in enumerate(own.langs)}
        for batch in batches:
            at = []
            langs = batch.column(0).to_pylist()
            for row, slot, count in _bags(batch.column(1)):
                if slot is not None:
                    logs = _without(own, slot, count, place[langs[row]])
                    at.append(int(np.floor(fitness(logs, own.base[slot], count, mixture(logs, count)[0]) / BIN)))
            bins, n = np.unique(np.array(at, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), pa.array(n, pa.int64())], names=["at", "n"])

    got = rows.mapInArrow(fits, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").toArrow()
    if not got.num_rows:
        return -np.inf
    upto = np.cumsum(got["n"].to_numpy())
    return float(got["at"].to_numpy()[np.searchsorted(upto, int(REJECTED * upto[-1]), side="right")] * BIN)


def _shares(like: np.ndarray, count: np.ndarray, share: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float]:
    """Mixture shares and log-likelihood; like: exp of the relative log-likelihoods (slots x languages)."""
    for _ in range(rounds if like.shape[1] > 1 else 0):
        share = share * ((count / (like @ share)) @ like)
        share /= share.sum()
    return share, float(count @ np.log(like @ share))


def mixture(logs: np.ndarray, count: np.ndarray, penalty: float = PENALTY, evidence: float = EVIDENCE) -> tuple[np.ndarray, float]:
    """(share of every language, posterior of the best single language) of one document.

    logs: log-likelihood of each distinct slot in each language, less the largest of the slot;
    count: how often the slot occurs.
    """
    n = logs.shape[1]
    like = np.exp(logs)
    alone = evidence * (count @ logs).astype(np.float64)
    top = int(np.argmax(alone))
    weight = np.exp(alone - alone[top])
    posterior = float(1 / weight.sum())
    cost = penalty * np.log(float(count.sum()) + 1)
    out = np.zeros(n)
    share, fit = _shares(like, count, np.full(n, 1 / n, np.float32))
    # the log-likelihood is concave in the shares, so no shares of any set fit better than this, however many rounds
    gain = (count / (like @ share)) @ like / count.sum()
    if evidence * (fit + float(count.sum()) * max(0.0, float(np.log(gain.max())))) - 2 * cost <= alone[top] - cost:
        out[top] = 1
        return out, posterior
    best = (alone[top] - cost, np.array([top]), np.ones(1))
    keep = np.arange(n)
    while len(keep) > 1:
        now = evidence * fit - cost * len(keep)
        if now > best[0]:
            best = (now, keep, share)
        keep = np.sort(keep[np.argsort(-share, kind="stable")[:-1]])
        share, fit = _shares(like[:, keep], count, np.full(len(keep), 1 / len(keep), np.float32))
    out[best[1]] = best[2]
    return out, posterior


def _bags(texts: pa.Array) -> Iterator[tuple[int, np.ndarray | None, np.ndarray | None]]:
    """(row, slots, counts) of each text, in order; None for a text without a letter."""
    for p in W.pieces(texts, BYTES, PIECE):
        text, slot, count = grams(p)
        cuts = np.searchsorted(text, np.arange(len(p.rows)))
        for i in range(len(p.rows) - 1):
            value = texts[p.first + i].as_py()
            if value is None or not LETTER.search(value):
                yield p.first + i, None, None
                continue
            a, b = cuts[i], cuts[i + 1]
            yield p.first + i, slot[a:b], count[a:b].astype(np.float32)


def judge(texts: pa.Array, model: Model) -> Iterator[tuple[int, np.ndarray, float, bool]]:
    """(row, share of every language, score, explained) of each text, in order; no shares for a text without a letter.

    A text is explained if its fit reaches the bar; one that is not still gets the languages that fit best.
    """
    nothing = np.zeros(0)
    for row, slot, count in _bags(texts):
        if not model.langs or slot is None:
            yield row, nothing, 0.0, False
            continue
        logs = model.table[slot]
        share, posterior = mixture(logs, count)
        explained = bool(fitness(logs, model.base[slot], count, share) >= model.bar)
        yield row, share, min(1.0, float(share.max()) * posterior), explained


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, languages, explained) for every row of ``docs``; languages maps each kept language to its
    share, explained says whether the text's fit reaches the bar."""
    langs = model.langs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.map_(pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, shares, fits = [], [], [], []
            for _, share, value, explained in judge(batch.column(1), sent.value):
                pred.append(langs[int(np.argmax(share))] if len(share) else "und")
                score.append(value)
                shares.append([(langs[j], float(share[j])) for j in np.flatnonzero(share)])
                fits.append(explained)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, kind), pa.array(fits, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "languages", "explained"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, languages map<string,double>, explained boolean")


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, explained): trained on the rows that are not held out."""
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "explained")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text a learned language or a mixture of them explains; rows never leave their partition."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text")))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for row, _, _, explained in judge(batch.column(at), sent.value):
                good[row] = explained
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
