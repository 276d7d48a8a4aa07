"""Cross-tokenizer alignment: tokens of two tokenizers grouped between shared cuts.

Every text is encoded twice, and byte offsets where tokens of both end are its shared
cuts.  They are found by divide and conquer: in every interval, from whole texts on, the
end of the first tokenizer nearest to the middle that bisection also finds among the ends
of the second splits the interval; both halves go on, and an interval without a shared
end inside is a leaf group.  All intervals of a level are searched at once, in windows
around their middles that double until they hold a shared end or the whole interval.

A link is a pair of tokens, one of each side, whose byte ranges overlap.  How often an id
pair is linked is counted over all texts by an ordinary grouped sum of per-text counts.

Texts are cut into units before single blanks between visible characters, where no entry
of either vocabulary can span (checked on the vocabularies); every distinct unit is
encoded once for many texts, and encoders never see more than a unit at a time.
"""

import re
import sys
from dataclasses import dataclass
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalog.llm.common import bounded_broadcast, chunks, column, stable, text_bytes

#: Where the vocabulary files lie, on the driver's and all executors' machines.
FOLDER, BYTE_FILE, PIECE_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"

#: Units kept encoded by a Python worker before it starts afresh, and the longest unit kept, in characters.
CACHED_UNITS, LONGEST_CACHED = 500_000, 64

_SEPARATORS = (",", "|", ";", "")


def byte_letters() -> dict[str, int]:
    """The printable letter of every byte in a byte-level vocabulary, reversed.

    Visible Latin-1 characters stand for themselves, the other bytes for the characters from 256 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: its encoder, and every id's bytes."""

    def __init__(self, encode, entries: list[bytes]):
        self.encode, self.entries = encode, pa.array(entries, pa.binary())
        self.sizes = np.array([len(e) for e in entries], np.int64)
        # An entry with a blank behind a visible character, or behind a part of one, could span a cut between units.
        self.splits = not any(re.search(r"[!-~\w\ufffd] ", e.decode(errors="replace")) for e in entries)

    def joined(self, ids: np.ndarray) -> pa.Buffer:
        return self.entries.take(pa.array(ids)).buffers()[2]


def byte_side(path: str) -> Side:
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), byte_letters()
    tokenizer.encode_special_tokens = True
    special = set(tokenizer.get_added_tokens_decoder())
    names = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    entries = [n.encode() if i in special else bytes(letters[c] for c in n) for i, n in enumerate(names)]

    def encode(units):
        return [e.ids for e in tokenizer.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]

    return Side(encode, entries)


def piece_side(path: str) -> Side:
    """A sentencepiece model that puts a blank before the text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)

    def entry(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return Side(lambda units: model.encode(units, num_threads=1), [entry(i) for i in range(model.vocab_size())])


class Encoder:
    """Both sides and the units encoded so far."""

    def __init__(self, a: Side, b: Side):
        self.sides = (a, b)
        self.splits = a.splits and b.splits
        most = max(len(a.sizes), len(b.sizes))
        self.labels = pa.array([f"{i}{s}" for i in range(most) for s in _SEPARATORS])
        self.start_afresh()

    def start_afresh(self):
        self.places: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32) for _ in self.sides]
        self.starts = [np.zeros(1, np.int64) for _ in self.sides]

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side the ids of all texts, one after another, and the texts' offsets among them."""
        if len(self.places) > CACHED_UNITS:
            self.start_afresh()
        own = [units(t) if self.splits else [t] for t in texts]
        ends = np.concatenate([[0], np.cumsum([*map(len, own)], dtype=np.int64)])
        own = [*chain.from_iterable(own)]
        at = [*map(self.places.get, own)]
        fresh, known, passing = [], len(self.places), {}
        for i, place in enumerate(at):
            if place is None:
                unit = own[i]
                if len(unit) > LONGEST_CACHED:  # of these texts alone; numbered downwards
                    at[i] = passing.setdefault(unit, -1 - len(passing))
                else:
                    at[i] = self.places.setdefault(unit, known + len(fresh))
                    if at[i] == known + len(fresh):
                        fresh.append(unit)
        at = np.array(at, np.int64)
        at = np.where(at < 0, len(self.places) - 1 - at, at)
        out = []
        for n, side in enumerate(self.sides):
            self.flat[n], self.starts[n] = _appended(self.flat[n], self.starts[n], side.encode(fresh))
            flat, starts = _appended(self.flat[n], self.starts[n], side.encode([*passing]))
            size = np.diff(starts)[at]
            before = np.concatenate([[0], np.cumsum(size)])
            out.append((flat[np.repeat(starts[at] - before[:-1], size) + np.arange(before[-1])], before[ends]))
        return out


def _appended(flat: np.ndarray, starts: np.ndarray, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return flat, starts
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
    return np.concatenate([flat, ids]), np.concatenate([starts, starts[-1] + np.cumsum(sizes)])


_LOOSE = re.compile(r"(?<![!-~\w]) | (?![!-~\w])")
_TIGHT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")


def units(text: str) -> list[str]:
    """The text cut at (and without) every single blank that stands between two visible characters."""
    return _TIGHT.split(text) if _LOOSE.search(text) else text.split(" ")


def shared_cuts(a: np.ndarray, b: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Offsets where both sides end, ascending.

    ``a`` and ``b`` are ascending ends; interval i holds the ends ``a[firsts[i]:lasts[i] + 1]``
    and closes with a shared one.
    """
    cuts = [a[lasts]]
    while True:
        inner = firsts < lasts
        firsts, lasts = firsts[inner], lasts[inner]
        if not len(firsts):
            return np.sort(np.concatenate(cuts))
        middle = (firsts + lasts) // 2
        cut = np.full(len(firsts), -1)
        open_ = np.arange(len(firsts))
        near, far = 0, 0  # distances from the middle now looked at
        while len(open_):
            lo, hi, mid = firsts[open_], lasts[open_] - 1, middle[open_]
            spans = [(np.maximum(lo, mid - far), mid - near), (np.maximum(mid + near, mid + 1), np.minimum(hi, mid + far))]
            start = np.concatenate([s for s, _ in spans])
            size = np.maximum(np.concatenate([e for _, e in spans]) + 1 - start, 0)
            owner = np.repeat(np.tile(np.arange(len(open_)), 2), size)
            at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
            hit = b[np.minimum(np.searchsorted(b, a[at]), len(b) - 1)] == a[at]
            owner, at = owner[hit], at[hit]
            # Nearest first; of two as near the earlier one.
            order = np.lexsort((at, np.abs(at - mid[owner]), owner))
            first = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
            cut[open_[owner[first]]] = at[first]
            left = (cut[open_] < 0) & ((mid - far > lo) | (mid + far < hi))
            open_ = open_[left]
            near, far = far + 1, 2 * far + 1
        split = cut >= 0
        cuts.append(a[cut[split]])
        firsts, lasts = np.concatenate([firsts[split], cut[split] + 1]), np.concatenate([cut[split], lasts[split]])


@dataclass
class Aligned:
    """Some texts, one after another: ids, ends, texts' offsets and shared cuts."""

    ids: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    places: tuple[np.ndarray, np.ndarray]
    bounds: np.ndarray
    cuts: np.ndarray

    def per_text(self, offsets: np.ndarray) -> np.ndarray:
        """How many of some ascending offsets lie in each text, its end included."""
        return np.diff(np.searchsorted(offsets, self.bounds, "right"))


def align(encoder: Encoder, texts: list[str]) -> tuple[np.ndarray, Aligned]:
    """Which texts both sides give back byte by byte, and the alignment of all, the others without tokens."""
    whole = [(" " + t).encode() for t in texts]
    found = encoder(texts)
    lengths = np.array([len(w) for w in whole], np.int64)
    good = lengths > 1
    for side, (ids, places) in zip(encoder.sides, found):
        ends = np.concatenate([[0], np.cumsum(side.sizes[ids])])[places]
        good &= np.diff(ends) == lengths
        joined = memoryview(side.joined(ids) or b"").cast("B")
        good &= np.array([joined[s:e] == w for s, e, w in zip(ends, ends[1:], whole)], bool)
    kept, offsets = [], []
    for ids, places in found:
        size = np.diff(places)
        kept.append(ids[np.repeat(good, size)])
        offsets.append(np.concatenate([[0], np.cumsum(np.where(good, size, 0))]))
    ends = tuple(np.cumsum(side.sizes[ids]) for side, ids in zip(encoder.sides, kept))
    bounds = np.concatenate([[0], np.cumsum(np.where(good, lengths, 0))])
    firsts, after = offsets[0][:-1][good], offsets[0][1:][good]
    cuts = shared_cuts(*ends, firsts, after - 1)
    return good, Aligned(tuple(kept), ends, tuple(offsets), bounds, cuts)


def group_texts(x: Aligned, labels: pa.Array) -> pa.Array:
    """Per text its groups as ``a1,a2|b1;a3|b2,b3``: ids of both sides in order; empty without tokens."""
    groups = [np.searchsorted(x.cuts, e) for e in x.ends]
    seen = [np.cumsum(np.bincount(g, minlength=len(x.cuts))) for g in groups]
    last = [np.zeros(len(g), bool) for g in groups]
    for flag, upto in zip(last, seen):
        flag[upto - 1] = True
    place_a = np.arange(len(groups[0])) + np.concatenate([[0], seen[1][:-1]])[groups[0]] if len(x.cuts) else np.zeros(0, np.int64)
    place_b = np.arange(len(groups[1])) + seen[0][groups[1]] if len(x.cuts) else np.zeros(0, np.int64)
    label = np.zeros(len(place_a) + len(place_b), np.int64)
    label[place_a] = x.ids[0].astype(np.int64) * 4 + last[0]
    closing = np.where(np.isin(x.ends[1], x.bounds), 3, 2)
    label[place_b] = x.ids[1].astype(np.int64) * 4 + np.where(last[1], closing, 0)
    text = labels.take(pa.array(label))
    at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1)[x.places[0] + x.places[1]]
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), text.buffers()[2] or pa.py_buffer(b""))


def link_lists(x: Aligned) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """Per text the number of links, its distinct id pairs (a << 32 | b) and how often each is linked."""
    # Every stretch between two neighbouring ends of any side lies in one token of each.
    both = np.concatenate(x.ends)
    order = np.argsort(both, kind="stable")  # merges two sorted runs
    both, of_a = both[order], order < len(x.ends[0])
    new = np.diff(both, prepend=-1) != 0
    stretches = both[new]
    # An end closes its own token: those before it are counted.
    a, b = (ids[(np.cumsum(own) - own)[new]].astype(np.int64) for ids, own in zip(x.ids, (of_a, ~of_a)))
    n_links = x.per_text(stretches)
    text = np.repeat(np.arange(len(n_links)), n_links)
    wide = int(a.max(initial=0)) + 1, int(b.max(initial=0)) + 1
    key = np.sort((text * wide[0] + a) * wide[1] + b)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(first, len(key)))
    key, b = np.divmod(key[first], wide[1])
    text, a = np.divmod(key, wide[0])
    ends = pa.array(np.searchsorted(text, np.arange(len(x.bounds))), pa.int32())
    pairs = pa.ListArray.from_arrays(ends, pa.array(a << 32 | b, pa.int64()))
    return n_links, pairs, pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))


def _encoder(folder: str, byte_file: str, piece_file: str) -> Encoder:
    """Loaded once in a Python worker's life."""
    held = sys.modules.setdefault("_causalog_encoders", ModuleType("_causalog_encoders")).__dict__
    key = f"{folder}:{byte_file}:{piece_file}"
    if key not in held:
        held[key] = Encoder(byte_side(f"{folder}/{byte_file}"), piece_side(f"{folder}/{piece_file}"))
    return held[key]


def align_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    folder: str = FOLDER, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE,
) -> DataFrame:
    """One row per document: row, id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    Side a is a byte-level vocabulary read on a blank and the text, side b a piece model
    that adds the blank itself; strings of special tokens are plain text.  ``groups`` is
    the alignment as text (see ``group_texts``), ``pairs`` the distinct linked id pairs
    (a << 32 | b) and ``times`` their links.  Null and empty texts, and texts that a side
    does not give back byte by byte, have no tokens: zeros and empty.  Repeated rows and ids
    each give a row; ``row`` tells rows apart once the result is written.  An empty table
    gives no rows.
    """
    def run(batches):
        encoder = _encoder(folder, byte_file, piece_file)
        for batch in batches:
            _, offsets = text_bytes(batch.column(0))
            for lo, hi in chunks(offsets):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(0).to_pylist()]
                _, x = align(encoder, texts)
                n_links, pairs, times = link_lists(x)
                numbers = [np.diff(x.places[0]), np.diff(x.places[1]), x.per_text(x.cuts), n_links]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *[pa.array(n, pa.int64()) for n in numbers], group_texts(x, encoder.labels), pairs, times],
                    ["row", id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    rows = docs.select(column(docs, text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"), column(docs, id_col).alias(id_col))
    kind = rows.schema[2].dataType.simpleString()
    return rows.mapInArrow(
        run, f"row long, `{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """Every linked id pair of all documents: pair, a, b, count, best.

    ``best`` says that no other a is linked to the same b more often.  ``aligned`` should be written.
    """
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    counts = stable(links.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("count")))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    top = stable(counts.groupBy(b.alias("b")).agg(F.max("count").alias("top")))
    return counts.withColumn("b", b).join(bounded_broadcast(top), "b").select(
        "pair", F.shiftright("pair", 32).alias("a"), "b", "count", (F.col("count") == F.col("top")).alias("best"))


def with_link_counts(aligned: DataFrame, columns: list[str], **limit) -> DataFrame:
    """``columns`` of every row of ``aligned`` with n_best and count_sum.

    n_best are the links whose pair is ``best``, count_sum sums the pairs' counts over all
    links.  The table of pairs is sent to the tasks if it is small enough, measured in
    bytes; then a row's links are summed where they lie.  Beyond that the links are
    shuffled by pair.  ``aligned`` must be written, so that ``row`` stays.
    """
    counts = bounded_broadcast(stable(link_counts(aligned).select("pair", "count", "best")), **limit)
    links = aligned.select("row", *columns, F.explode_outer(F.arrays_zip("pairs", "times")).alias("l"))
    found = links.select("row", *columns, F.col("l.pairs").alias("pair"), F.col("l.times").cast("long").alias("times")).join(counts, "pair", "left")
    return found.groupBy("row", *columns).agg(
        F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).alias("n_best"),
        F.coalesce(F.sum(F.col("times") * F.col("count")), F.lit(0)).alias("count_sum")).drop("row")
