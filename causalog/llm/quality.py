"""Quality classifier from weak labels.

Heuristic labellers look at every text and vote good, bad or nothing.  How often their
vote patterns occur is counted over all documents; expectation-maximisation on those
counts estimates how each labeller votes on good and on bad documents.  The posterior
labels of a bounded sample train a hashed linear model, which scores every text.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalog.llm.common import bounded_sample, chunks, column, lists, text_bytes
from causalog.llm.features import SpanHash, runs
from causalog.llm.linear import Rows, ftrl, softmax

# Votes: 0 none, 1 bad, 2 good.  Per labeller: bad from ``bad`` on, good up to ``good``.
# Fixed values, fractions of words or characters unless said otherwise.
LABELLERS = {
    "repeated": (0.25, 0.05),       # words equal to the word before
    "signs": (0.30, 0.08),          # words with two signs in a row
    "capitals": (0.40, 0.15),       # letters that are upper case
    "bare": (0.15, 0.04),           # words without letter or digit
    "few_words": (0.85, 0.60),      # 1 - distinct words / words, the mean over all runs of RUN words
    "few_letters": (0.45, 0.20),    # characters that are no letter, digit or white space
    "same_lines": (0.60, 0.10),     # lines that repeat an earlier line
}
#: Shorter texts get no votes: the fractions mean little there.
LEAST_WORDS = 8
#: Distinct words are counted in runs of so many words, as longer texts repeat more of theirs.
RUN = 300
BITS = 16

_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"):ord("9") + 1] = True
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SIGN = ~(_LETTER | _DIGIT | _SPACE)
_SIGN[[ord(c) for c in ".,'\"-"]] = False


class Measured:
    """Words of a chunk of texts and what the labellers and the features need of them."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.docs = n = len(at) - 1
        space = _SPACE[data]
        self.starts, self.ends, self.doc = runs(~space, at)
        self.hashed = SpanHash(data)
        self.word = self.hashed(self.starts, self.ends)
        self.words = np.bincount(self.doc, minlength=n)
        sums = {}
        for name, table in (("upper", _UPPER), ("letter", _LETTER), ("digit", _DIGIT), ("sign", _SIGN)):
            sums[name] = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        # The second byte of É, Ü and their like: upper case of the Latin-1 letters.
        high = np.zeros(len(data), bool)
        high[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        sums["upper"] += np.concatenate([[0], np.cumsum(high, dtype=np.int32)])
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
        twice = np.zeros(len(data), bool)
        twice[:-1] = _SIGN[data[:-1]] & _SIGN[data[1:]]
        sums["twice"] = np.concatenate([[0], np.cumsum(twice, dtype=np.int32)])
        per_word = {k: s[self.ends] - s[self.starts] for k, s in sums.items()}
        per_word["twice"] = sums["twice"][self.ends - 1] - sums["twice"][self.starts]
        self.signs, self.letters, self.upper = per_word["twice"] > 0, per_word["letter"], per_word["upper"]
        self.bare = (per_word["letter"] + per_word["digit"]) == 0
        self.digits = per_word["digit"]
        self.size = lead[self.ends] - lead[self.starts]
        same = np.zeros(len(self.word), bool)
        same[1:] = (self.word[1:] == self.word[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.same = same
        self.sign_chars = per_word["sign"]
        self.last = data[self.ends - 1] if len(self.ends) else np.zeros(0, np.uint8)
        self.data, self.at, self.sums, self.lead = data, at, sums, lead

    def _share(self, flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, flags, self.docs) / np.maximum(1, of)

    def _distinct(self, doc: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Distinct values per document."""
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        return np.bincount(doc[new], minlength=self.docs)

    def _repeats(self) -> np.ndarray:
        """Share of words that repeat one of their run: the mean over every run of ``RUN``
        words of the whole text, a shorter text being one run."""
        order = np.argsort(self.word, kind="stable")  # equal words in the order of the texts
        word, doc = self.word[order], self.doc[order]
        again = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1])) + 1
        first = np.cumsum(self.words) - self.words
        place = (np.arange(len(self.doc)) - first[self.doc]).astype(np.int32)
        before = np.full(len(self.doc), -1, np.int32)
        before[order[again]] = place[order[again - 1]]
        # A word is new in the runs that begin after its last occurrence and reach it.
        size = np.minimum(RUN, self.words).astype(np.int32)
        last_start = self.words.astype(np.int32) - size
        new = np.minimum(place, last_start[self.doc]) - np.maximum(before, place - size[self.doc])
        distinct = np.bincount(self.doc, np.maximum(0, new), self.docs)
        return np.where(self.words > 0, 1 - distinct / np.maximum(1, size.astype(np.int64) * (last_start + 1)), 0.0)

    def measures(self) -> dict[str, np.ndarray]:
        lines, line_end, of = runs(self.data != 10, self.at)
        n_lines, kinds = np.bincount(of, minlength=self.docs), self._distinct(of, self.hashed(lines, line_end))
        chars = np.bincount(self.doc, self.size, self.docs)
        letters = self.sums["letter"]
        doc_letters = letters[self.at[1:]] - letters[self.at[:-1]]
        return {
            "repeated": self._share(self.same, self.words),
            "signs": self._share(self.signs, self.words),
            "capitals": self._share(self.upper, doc_letters),
            "bare": self._share(self.bare, self.words),
            "few_words": self._repeats(),
            "few_letters": self._share(self.sign_chars, chars),
            "same_lines": 1 - np.where(n_lines > 0, kinds, 1) / np.maximum(1, n_lines),
        }

    def patterns(self) -> np.ndarray:
        """Votes of all labellers of a text as one number in base 3."""
        code = np.zeros(self.docs, np.int64)
        for name, value in self.measures().items():
            bad, good = LABELLERS[name]
            vote = np.where(value >= bad, 1, np.where(value <= good, 2, 0))
            code = code * 3 + np.where(self.words >= LEAST_WORDS, vote, 0)
        return code

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, bucket, value): hashed words and pairs of word shapes, by the root of their share."""
        shape = (
            np.minimum(self.letters, 1) + 2 * np.minimum(self.digits, 1) + 4 * self.signs + 8 * self.bare
            + 16 * (self.upper > 0) + 32 * ((self.upper > 1) & (self.upper * 2 > self.size)) + 64 * self.same
            + 128 * np.minimum(3, self.size // 4) + 512 * (self.last == ord("."))
        ).astype(np.uint64)
        before = np.zeros(len(shape), np.uint64)
        before[1:] = np.where(self.doc[1:] == self.doc[:-1], shape[:-1] + np.uint64(1), 0)
        mix = np.uint64(0x9E3779B97F4A7C15)
        found = [self.word * mix, (shape + np.uint64(1 << 20)) * mix * mix, ((shape << np.uint64(11)) + before + np.uint64(1 << 30)) * mix * mix]
        bucket = np.concatenate([(x ^ (x >> np.uint64(29))) * mix >> np.uint64(64 - BITS) for x in found]).astype(np.int64)
        cells, count = np.unique((np.tile(self.doc, 3).astype(np.int64) << BITS) | bucket, return_counts=True)
        doc = cells >> BITS
        return doc, cells & ((1 << BITS) - 1), np.sqrt(count / np.maximum(1, self.words[doc]))


def _measured(texts: pa.Array):
    data, at = text_bytes(texts)
    for lo, hi in chunks(at):
        own = at[lo:hi + 1]
        yield lo, hi - lo, Measured(data[own[0]:own[-1]], own - own[0])


def _count_patterns(batches):
    counts = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in batches:
        for _, _, m in _measured(batch.column(0)):
            counts += np.bincount(m.patterns(), minlength=len(counts))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["pattern", "n"])


def pattern_votes() -> np.ndarray:
    """(patterns, labellers): the votes each pattern number stands for."""
    codes = np.arange(3 ** len(LABELLERS))
    return np.stack([codes // 3 ** k % 3 for k in reversed(range(len(LABELLERS)))], 1)


def expectation_maximisation(counts: np.ndarray, rounds: int = 200, false_alarms: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of good per pattern, P(good vote | class) as (class, labeller), class shares.

    Bad texts come in kinds that few labellers see, so the model has one class of good
    texts (number 0) and as many kinds of bad ones as labellers; votes are independent
    within a class, and no vote says nothing.  Kind j starts from the patterns in which
    labeller j votes bad.  A kind that one labeller alone sees looks like that labeller's
    mistakes; so its bad votes on good texts are held to a share of ``false_alarms``.
    A pattern without votes gets the share of
    good; without any documents the start is returned.
    """
    votes = pattern_votes()
    yes_votes, no_votes = (votes == 2).astype(float), (votes == 1).astype(float)
    kinds = no_votes / np.maximum(1, no_votes.sum(1, keepdims=True))
    belief = np.concatenate([1 - kinds.sum(1, keepdims=True), kinds], 1)
    table, shares = np.full((belief.shape[1], votes.shape[1]), 0.9), np.full(belief.shape[1], 1 / belief.shape[1])
    if not counts.sum():
        return belief[:, 0], table, shares
    for _ in range(rounds):
        weight = belief.T * counts
        yes, no = weight @ yes_votes + 0.5, weight @ no_votes + 0.5
        table = yes / (yes + no)
        shares = (weight.sum(1) + 0.5) / (counts.sum() + 0.5 * len(weight))
        table[0] = np.maximum(table[0], 1 - false_alarms)
        new = softmax(np.log(shares) + yes_votes @ np.log(table).T + no_votes @ np.log(1 - table).T)
        done = np.abs(new - belief).max() < 1e-6
        belief = new
        if done:
            break
    return belief[:, 0], table, shares


def accuracies(table: np.ndarray, shares: np.ndarray) -> dict[str, tuple[float, float]]:
    """Per labeller how often its bad vote and its good vote are right."""
    good, bad = shares[0] * table[0], (shares[1:, None] * table[1:]).sum(0)
    no_good, no_bad = shares[0] * (1 - table[0]), (shares[1:, None] * (1 - table[1:])).sum(0)
    return {n: (float(b / (a + b)), float(c / (c + d))) for n, a, b, c, d in zip(LABELLERS, no_good, no_bad, good, bad)}


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = 6000, l1: float = 0.2, l2: float = 0.1, seed: int = 7, id_col: str = "doc_id") -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model for "good".

    Vote patterns are counted over all rows; at most ``sample_rows`` rows, drawn by a hash
    of text and, if there is one, ``id_col``, train the model on their posteriors.
    """
    own = [column(docs, id_col).alias("id")] if id_col in docs.columns else []
    rows = docs.select(column(docs, text_col).alias("text"), *own).where("text is not null")
    texts = rows.select("text")
    counts = np.zeros(3 ** len(LABELLERS), np.int64)
    for r in texts.mapInArrow(_count_patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect():
        counts[r["pattern"]] = r["n"]  # at most 3^labellers rows
    good, _, _ = expectation_maximisation(counts)

    def run(batches):
        for batch in batches:
            for _, n, m in _measured(batch.column(0)):
                doc, bucket, value = m.features()
                cut = np.searchsorted(doc, np.arange(n + 1))
                parts = [slice(a, b) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(good[m.patterns()]), lists([bucket[p] for p in parts], pa.int32()), lists([value[p] for p in parts], pa.float32())],
                    ["good", "bucket", "value"])

    sample = (
        bounded_sample(rows, sample_rows, min(1.0, sample_rows / max(1, int(counts.sum()))), rows.columns, seed).select("text")
        .mapInArrow(run, "good double, bucket array<int>, value array<float>").toArrow()
    )
    if not sample.num_rows:
        return np.zeros(1 << BITS), 0.0
    target = sample.column("good").to_numpy()
    features = Rows.from_arrow(sample.column("bucket"), sample.column("value"))
    sort = features.order(target)
    features, target = features.take(sort), target[sort]
    weights, bias = ftrl(features, np.stack([1 - target, target], 1), 1 << BITS, l1, l2, alpha=1.0, epochs=6, seed=seed)
    return weights[:, 1] - weights[:, 0], float(bias[1] - bias[0])


def with_quality(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with a score from 0 (bad) to 1 (good) for every row.

    Null, empty and wordless texts get the score of the bias alone.  A column that is
    already called ``score_col`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    @F.pandas_udf("double")
    def run(texts):
        weights, bias = shared.value
        total = np.full(len(texts), bias)
        for first in range(0, len(texts), 1000):  # not all texts of a batch twice in memory
            for lo, n, m in _measured(pa.array(texts.iloc[first:first + 1000], pa.string(), from_pandas=True)):
                doc, bucket, value = m.features()
                total[first + lo:first + lo + n] += np.bincount(doc, value * weights[bucket], n)
        return type(texts)(1 / (1 + np.exp(-np.clip(total, -500, 500))))

    return docs.withColumn(score_col, run(column(docs, text_col)))
