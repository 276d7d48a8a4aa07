"""Toxicity through a noisy channel: restore disguised words, then score the text.

Spans that may be disguised (leetspeak, letters spaced out, words split by signs, letters
repeated) become lattices: each character may stand for itself or for what it replaces, a
run of separators may be there or not, a run may be shortened.  Viterbi decoding finds the
most likely reading under a trigram character model counted over all documents.  Where
letters are doubled or spaced out, the counts of whole words decide: a doubled letter
stays unless the shortened word is attested and the written one is too rare beside it.
Everything else is kept as it is; a blank between two pieces of three or more characters
always is, as are numbers.  A linear model over the restored words, fitted on a
bounded sample of labelled rows, gives the score.
"""

import re
from itertools import groupby, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalog.llm.common import bounded_sample, chunks, column, lists, text_bytes
from causalog.llm.features import SpanHash, runs
from causalog.llm.linear import Rows, ftrl, softmax

# What a character is often written for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}

#: Log-probabilities of the channel's moves: a letter written as something else, a sign
#: that means itself right before a letter, a span's letters spaced out, a border of words
#: among such letters, a word split in longer pieces, a letter repeated; @ or $ that means
#: itself within a word, a word that repeats letters at all (once a word), a wide gap
#: within a word, a border of words in one of many equal gaps.
SWAP, SIGN, SPREAD, BREAK, SPLIT, SHORTEN = np.log(0.1), np.log(0.02), np.log(0.1), np.log(0.003), np.log(0.1), np.log(0.1)
STRANGE, DISGUISE, BRIDGE, BORDER = np.log(1e-6), np.log(1e-8), np.log(0.3), np.log(0.05)

# Symbols of the character model: 0 any non-letter, 1-26 a-z, 27 other letters, 28 digits.
SYMBOLS = 29
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[ord("a"):ord("z") + 1] = _SYMBOL[ord("A"):ord("Z") + 1] = np.arange(1, 27)
_SYMBOL[0x80:] = 27
_SYMBOL[ord("0"):ord("9") + 1] = 28
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_LETTER = (_SYMBOL > 0) & (_SYMBOL < 28)
_PLAIN = (_SYMBOL > 0) & (_SYMBOL < 27)
_LEET = np.isin(np.arange(256), [ord(c) for c in LEET])
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

_GAP = re.compile(r"[^\w" + re.escape("".join(x for x in LEET if x != "|")) + "]+")

BITS = 18

#: A word is attested with a share of 1 / WORDS of all words, so at most WORDS are, and three
#: occurrences; longer ones than LONGEST bytes never are.
WORDS, LEAST, LONGEST = 1 << 17, 3, 64


class Language(NamedTuple):
    """What is counted over all documents: log-probabilities of characters, counts of attested words, all words."""

    characters: np.ndarray
    words: dict[str, int]
    total: int


def _trigrams(batches):
    """Partial counts of symbol trigrams, at most SYMBOLS^3 rows a partition."""
    counts = np.zeros(SYMBOLS ** 3, np.int64)
    for batch in batches:
        data, at = text_bytes(batch.column(0))
        for lo, hi in chunks(at):
            own = data[at[lo]:at[hi]]
            inside = np.zeros(len(own) + 1, bool)
            inside[at[lo:hi + 1] - at[lo]] = True  # a text's end is a non-letter, too
            symbols = np.insert(_SYMBOL[own], np.flatnonzero(inside), 0)
            lead = np.insert((own & 0xC0) != 0x80, np.flatnonzero(inside), True)
            s = symbols[lead].astype(np.int64)
            s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
            s = np.concatenate([[0], s])
            counts += np.bincount(s[:-2] * SYMBOLS ** 2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS ** 3)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["gram", "n"])


def _character_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    counted = (
        docs.select(column(docs, text_col)).mapInArrow(_trigrams, "gram int, n long")
        .groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most SYMBOLS^3 rows
    )
    three = np.zeros(SYMBOLS ** 3)
    for r in counted:
        three[r["gram"]] = r["n"]
    return three.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def _smoothed(three: np.ndarray) -> np.ndarray:
    two, one = three.sum(0), three.sum((0, 1))
    p = (one + 1) / (one + 1).sum()
    for counts in (two, three):
        kinds = (counts > 0).sum(-1, keepdims=True) + 1  # Witten-Bell: more kinds, more weight to the shorter context
        p = (counts + kinds * p) / (counts.sum(-1, keepdims=True) + kinds)
    return np.log(p)


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probabilities [a, b, c] of symbol c after a, b, from all texts; backed off to pairs and single symbols."""
    return _smoothed(_character_counts(docs, text_col))


def _words(batches):
    """Partial counts of the words, lower-cased, of each chunk of texts."""
    for batch in batches:
        data, at = text_bytes(batch.column(0))
        for lo, hi in chunks(at):
            own = at[lo:hi + 1]
            low = _LOWER[data[own[0]:own[-1]]]
            starts, ends, _ = runs(_LETTER[low], own - own[0])
            short = ends - starts <= LONGEST
            starts, ends = starts[short], ends[short]
            if not len(starts):
                continue
            _, first, count = np.unique(SpanHash(low)(starts, ends), return_index=True, return_counts=True)
            size = ends[first] - starts[first]
            offsets = np.concatenate([[0], np.cumsum(size)])
            kept = low[np.repeat(starts[first] - offsets[:-1], size) + np.arange(offsets[-1])]
            words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(kept))
            yield pa.RecordBatch.from_arrays([words, pa.array(count, pa.int64())], ["word", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> Language:
    """Characters and words counted over all texts; only the attested words, at most ``WORDS``, reach the driver."""
    three = _character_counts(docs, text_col)
    total = int(three.sum(0)[[0, SYMBOLS - 1], 1:SYMBOLS - 1].sum())  # beginnings of words
    found = (
        docs.select(column(docs, text_col)).mapInArrow(_words, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= max(LEAST, -(-total // WORDS))).toArrow()
    )
    return Language(_smoothed(three), dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist())), total)


class Decoder:
    """Viterbi decoding of one disguised span; readings of frequent spans are remembered."""

    KEPT = 200_000

    def __init__(self, language: Language):
        self.model = language.characters.tolist()
        self.words = language.words
        self.total = max(1, language.total)
        self.rare = np.log(max(1, self.total - sum(self.words.values())) / self.total)  # any word that is not attested
        self.like: dict[str, list[str]] = {}  # attested words by their letters, repeated ones once
        for word in self.words:
            self.like.setdefault(self._once(word), []).append(word)
        self.known: dict[str, str] = {}

    def __call__(self, span: str) -> str:
        out = self.known.get(span)
        if out is None:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            out = self.known[span] = self._read(span)
        return out

    def _read(self, span: str) -> str:
        if span.isalpha():
            word = self._shorter(span)
            if word != span or not any(len(list(run)) > 2 for _, run in groupby(span)):
                return word
        total, pieces = self._best(self._lattice(span, False), 0.0)
        if _GAP.search(span):
            lattice = self._lattice(span)
            apart, letters = self._best(lattice, SPREAD)
            if apart > total:
                pieces = self._words_apart(lattice, letters)
        return re.sub(r"[^\W\d_]+", lambda m: self._shorter(m[0]), "".join(pieces))

    @staticmethod
    def _once(word: str) -> str:
        return "".join(c for c, _ in groupby(word))

    def _shorter(self, word: str) -> str:
        """The likeliest word that ``word`` is when letters were repeated: itself, or an attested one."""
        once = self._once(word)
        if once == word:
            return word
        own = [len(list(run)) for _, run in groupby(word)]
        best, value = word, self._log(word)
        for other in sorted(self.like.get(once, ())):
            size = [len(list(run)) for _, run in groupby(other)]
            if other != word and all(a <= b for a, b in zip(size, own)):
                total = self._log(other) + DISGUISE + SHORTEN * sum(a < b for a, b in zip(size, own))
                if total > value:
                    best, value = other, total
        return best

    def _log(self, word: str) -> float:
        """Log-probability of a word: its share, or, not attested, that of such words and its characters."""
        n = self.words.get(word)
        if n:
            return float(np.log(n / self.total))
        total, x, y = self.rare, 0, 0
        for c in word + " ":
            s = self._symbol(c)
            total, x, y = total + self.model[x][y][s], y, s
        return total

    def _words_apart(self, lattice: list, pieces: list[str]) -> list[str]:
        """Spaced-out letters with the borders of words set anew, by the counts of whole words.

        A border may stand in every gap; all gaps alike it costs little, else it should
        stand in the wide ones.  A word that is not attested costs its characters.
        """
        gap = [len(place) > 1 and place[-1][0] == () for place in lattice]
        widths = [len(place[0][1]) for place, is_gap in zip(lattice, gap) if is_gap]
        if not widths:
            return pieces
        narrow, uneven = min(widths), min(widths) < max(widths)
        out, stretch, between = [], [""], []
        for place, piece, is_gap in [*zip(lattice, pieces, gap), (None, None, False)]:
            if place is None or not is_gap and place[0][0] == (0,):  # the end, or what no word holds
                out += [self._cut(stretch, between, narrow, uneven), piece or ""]
                stretch, between = [""], []
            elif is_gap:
                between.append(place[0][1])
                stretch.append("")
            else:
                stretch[-1] += piece
        return out

    def _cut(self, units: list[str], gaps: list[str], narrow: int, uneven: bool) -> str:
        best = [(0.0, 0)]
        for j in range(1, len(units) + 1):
            found, word, joined = [], "", 0.0
            for i in range(j - 1, -1, -1):
                word = units[i] + word
                if len(word) > LONGEST and i < j - 1:
                    break
                wide = 0 < i and len(gaps[i - 1]) > narrow
                border = 0.0 if i == 0 or wide else BREAK if uneven else BORDER
                found.append((best[i][0] + border + joined + self._log(self._shorter(word)), i))
                if wide:
                    joined += BRIDGE
            best.append(max(found))
        out, j = "", len(units)
        while j:
            i = best[j][1]
            out = (gaps[i - 1] if i else "") + "".join(units[i:j]) + out
            j = i
        return out

    @staticmethod
    def _symbol(c: str) -> int:
        return int(_SYMBOL[ord(c)]) if ord(c) < 128 else 27 if c.isalpha() else 0

    @staticmethod
    def _separates(c: str) -> bool:
        return ord(c) < 128 and not ("a" <= c <= "z" or c in LEET)

    @staticmethod
    def _sign(span: str, i: int, j: int) -> float:
        """Cost of a sign that means itself: unlikely right before a letter and, but for
        marks and three in a row at the end of a word, beside a letter or another sign for one."""
        near = span[max(0, i - 1):i] + span[j:j + 1]
        if span[i] not in "!+|" and j - i < 3 and any("a" <= x <= "z" or x in "@$!|" for x in near):
            return STRANGE
        return SIGN if "a" <= span[j:j + 1] <= "z" else 0.0

    @staticmethod
    def _divides(span: str, i: int) -> bool:
        """A sign that may replace a letter, but stands again two places on: i|d|i|o|t."""
        c, near = span[i], span[i - 1:i] + span[i + 1:i + 2]
        return not (c.isalnum() or c in near) and (span[i - 2:i - 1] == c or span[i + 2:i + 3] == c) and near.isalnum()

    def _lattice(self, span: str, spread: bool = True) -> list:
        """Per place of a span its readings: (symbols, text, log-probability).

        A run of separators may be there or not; between two single letters it may be
        missing only if the span is read as ``spread`` out.  Borders of words are likelier
        where the gap is wide; with all gaps alike, beside a one-letter word at either end.
        """
        gaps = [len(gap) for gap in _GAP.findall(span)] or [0]
        narrow, uneven = min(gaps), min(gaps) < max(gaps)
        places, i, n = [], 0, len(span)
        while i < n:
            c, j = span[i], i + 1
            while j < n and span[j] == c and ("a" <= c <= "z" or c in LEET):
                j += 1
            s = self._symbol(c)
            if self._separates(c) or 0 < i < n - 1 and self._divides(span, i):
                while j < n and self._separates(span[j]):
                    j += 1
                places.append([((0,), span[i:j], 0.0)])
                if 0 < i and j < n:
                    alone = (i < 2 or not span[i - 2].isalnum()) and not (j + 1 < n and span[j + 1].isalnum())
                    if not alone:
                        places[-1].append(((), "", SPLIT))
                    elif spread:
                        border = j - i > narrow or not uneven and (i == 1 or j == n - 1)
                        places[-1] = [((0,), span[i:j], 0.0 if border else BREAK), ((), "", 0.0)]
                i = j
                continue
            sign = self._sign(span, i, j) if s == 0 and c in LEET else 0.0  # once a run
            read = [((self._symbol(x),), x, SWAP) for x in LEET.get(c, "")]
            if j - i == 1:
                places.append([((s,), c, sign), *read])
            else:
                m = j - i
                places.append([((s,) * m, c * m, sign)])
                if s and c not in LEET and m > 2:
                    places[-1] += [((s,) * k, c * k, DISGUISE) for k in (1, 2)]
                for k in range(1 if m > 2 else m, min(m, 3) + 1):  # 1111 as l or ll, 111 as ill; 55 as ss, words tell if it is one
                    cost = SWAP * k + (SHORTEN if k < m else 0.0)
                    places[-1] += [(sum((r[0] for r in p), ()), "".join(r[1] for r in p), cost) for p in product(read, repeat=k)]
            i = j
        return places

    def _best(self, lattice: list, start: float) -> tuple[float, list[str]]:
        """Viterbi, the best total and the text of each place: states are the last two symbols, non-letters in a row count as one."""
        best = {(0, 0): (start, None)}
        model = self.model
        for readings in [*lattice, [((0,), "", 0.0)]]:
            after: dict = {}
            for (a, b), (score, path) in best.items():
                for symbols, text, cost in readings:
                    x, y, total = a, b, score + cost
                    for s in symbols:
                        if s or y:
                            total += model[x][y][s]
                            x, y = y, s
                    held = after.get((x, y))
                    if held is None or total > held[0]:
                        after[x, y] = (total, (path, text))
            best = after
        total, path = max(best.values(), key=lambda v: v[0])
        out = []
        while path is not None:
            path, text = path
            out.append(text)
        return total, out[:0:-1]


def _groups(link: np.ndarray) -> np.ndarray:
    """Group numbers of pieces, given for all but the last whether the next one belongs to it."""
    return np.concatenate([[0], np.cumsum(~link)])


def _spans(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the spans to decode, of lower-cased texts.

    Pieces are runs of letters and of signs for letters.  A span is what only signs hold
    together, or tokens of pieces of one or two characters, three of one at least,
    whatever stands between them.
    """
    plain, leet = _PLAIN[low], _LEET[low]
    starts, ends, doc = runs(_LETTER[low] | leet, at)
    if not len(starts):
        return starts, ends, doc

    def total(flags: np.ndarray, a: np.ndarray = starts, b: np.ndarray = ends) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return sums[b] - sums[a]

    size, letters = ends - starts, total(plain)
    # Pieces with more than one reading: letters and signs for letters, doubled letters, or signs alone (not one repeated).
    double, other = np.zeros(len(low), bool), np.zeros(len(low), bool)
    double[1:] = plain[1:] & (low[1:] == low[:-1])
    other[1:] = low[1:] != low[:-1]
    signs = total(leet & (_SYMBOL[low] == 0))
    odd = ((letters > 0) & ((letters < size) & (total(leet) > 0) | (total(double, starts + 1, ends) > 0))
           | (letters == 0) & (signs > 1) & (total(other, starts + 1, ends) > 0) & (signs * 2 >= size))
    same = doc[1:] == doc[:-1]
    tight = same & (total(_SPACE[low], ends[:-1], starts[1:]) == 0)
    short = (size <= 2) & (letters + total(leet) == size)
    token = _groups(tight)
    short &= (np.bincount(token, ~short) == 0)[token]  # not the t of don't
    chain = _groups(same & short[1:] & short[:-1])
    single, plains = (np.bincount(chain, short * x) for x in (size == 1, letters))
    apart = short & ((single >= 3) & (plains >= 2))[chain]
    span = _groups(tight | (same & apart[1:] & apart[:-1]))
    taken = (np.bincount(span, odd | apart) > 0) | ((np.bincount(span) > 1) & (np.bincount(span, letters) > 0))
    first = np.flatnonzero(np.diff(span, prepend=-1))
    last = np.append(first[1:], len(span)) - 1
    return starts[first[taken]], ends[last[taken]], doc[first[taken]]


def restore(data: np.ndarray, at: np.ndarray, decode: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of texts with disguised spans decoded, and their new offsets."""
    low = _LOWER[data]
    starts, ends, doc = _spans(low, at)
    if not len(starts):
        return low, at
    raw = low.tobytes()
    pieces, last, grown = [], 0, np.zeros(len(starts), np.int64)
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        new = decode(raw[a:b].decode("utf-8", "replace")).encode()
        pieces += [raw[last:a], new]
        grown[k] = len(new) - (b - a)
        last = b
    pieces.append(raw[last:])
    sizes = np.diff(at) + np.bincount(doc, grown, len(at) - 1).astype(np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def word_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of the words of lower-cased texts and of their beginnings.

    The value is three times the root of the share of the document's words, at most 1.
    """
    starts, ends, doc = runs(_LETTER[data], at)
    size = ends - starts
    hashed = SpanHash(data)
    found = [(doc, hashed(starts, ends, 1))]
    for length in (4, 5, 6, 7):
        long = size > length
        found.append((doc[long], hashed(starts[long], starts[long] + length, 2)))
    cells = np.concatenate([(d.astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64) for d, h in found])
    cells, count = np.unique(cells, return_counts=True)
    doc_of = cells >> BITS
    words = np.bincount(doc, minlength=len(at) - 1)
    return doc_of, cells & ((1 << BITS) - 1), np.minimum(1, 3 * np.sqrt(count / np.maximum(1, words[doc_of])))


def _restored_features(texts: pa.Array, decode: Decoder):
    """Per chunk of rows: (first row, rows, document, bucket, value)."""
    data, at = text_bytes(texts)
    for lo, hi in chunks(at):
        own = at[lo:hi + 1]
        yield lo, hi - lo, *word_features(*restore(data[own[0]:own[-1]], own - own[0], decode))


def restored_texts(docs: DataFrame, language: Language, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``restored``: the lower-cased text with disguised words decoded (null stays null)."""
    shared = docs.sparkSession.sparkContext.broadcast(language)

    @F.pandas_udf("string")
    def run(texts):
        decode = Decoder(shared.value)
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            raw = np.frombuffer(text.encode(), np.uint8)
            out.append(restore(raw, np.array([0, len(raw)]), decode)[0].tobytes().decode("utf-8", "replace"))
        return type(texts)(out, dtype=object)

    return docs.withColumn("restored", run(column(docs, text_col)))


def train(
    labelled: DataFrame, language: Language, text_col: str = "text", label_col: str = "toxic", sample_rows: int = 6000,
    l1: float = 1.0, l2: float = 0.1, epochs: int = 10, seed: int = 7, id_col: str = "doc_id",
) -> tuple[np.ndarray, float]:
    """Weights per bucket and a bias, fitted on at most ``sample_rows`` labelled rows, drawn by a
    hash of text and, if there is one, ``id_col``; ids are used for nothing else.  Of rows equal
    in both the smallest label counts."""
    own = [column(labelled, id_col).alias("id")] if id_col in labelled.columns else []
    rows = labelled.select(
        column(labelled, text_col).alias("text"), column(labelled, label_col).cast("double").alias("label"), *own).where("text is not null and label is not null")
    total = rows.count()
    shared = labelled.sparkSession.sparkContext.broadcast(language)

    def run(batches):
        decode = Decoder(shared.value)
        for batch in batches:
            for lo, n, doc, bucket, value in _restored_features(batch.column(0), decode):
                cut = np.searchsorted(doc, np.arange(n + 1))
                parts = [slice(a, b) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, n), lists([bucket[p] for p in parts], pa.int32()), lists([value[p] for p in parts], pa.float32())],
                    ["label", "bucket", "value"])

    sample = (
        bounded_sample(rows, sample_rows, min(1.0, sample_rows / max(1, total)), [c for c in rows.columns if c != "label"], seed).select("text", "label")
        .mapInArrow(run, "label double, bucket array<int>, value array<float>").toArrow()
    )
    if not sample.num_rows:
        return np.zeros(1 << BITS), 0.0
    label = sample.column("label").to_numpy()
    features = Rows.from_arrow(sample.column("bucket"), sample.column("value"))
    sort = features.order(label)
    features, label = features.take(sort), label[sort]
    weights, bias = ftrl(features, np.stack([1 - label, label], 1), 1 << BITS, l1, l2, alpha=2.0, epochs=epochs, seed=seed)
    return weights[:, 1] - weights[:, 0], float(bias[1] - bias[0])


def score(docs: DataFrame, language: Language, weights: np.ndarray, bias: float, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` and score (0 to 1), one row per input row.

    Null and empty texts, and texts without words, get the score of the bias alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast((language, weights.astype(np.float32), bias))

    def run(batches):
        language, weights, bias = shared.value
        decode = Decoder(language)
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for lo, n, doc, bucket, value in _restored_features(batch.column(0), decode):
                total[lo:lo + n] += np.bincount(doc, value * weights[bucket], n)
            p = softmax(np.stack([np.zeros(len(total)), total], 1))[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p)], [*batch.schema.names[1:], "score"])

    rows = docs.select(column(docs, text_col).alias("_text"), *[column(docs, c) for c in id_cols])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{fields}, score double")
