"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all learning rows.  The weights are fitted on a bounded
sample of them (``sample_rows``) with FTRL and elastic-net penalties; a fifth of the
sample, not trained on, sets the temperature.  Every text is scored whole.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalog.llm.common import bounded_sample, chunks, column, lists, text_bytes
from causalog.llm.features import code_points, gram_buckets, letters, squeeze
from causalog.llm.linear import Rows, ftrl, softmax, temperature

BITS = 15


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def gram_counts(texts: pa.Array):
    """Per text its n-gram counts (2^BITS numbers), or None for a text without letters."""
    data, at = text_bytes(texts)
    for lo, hi in chunks(at):
        own = at[lo:hi + 1]
        points, places = code_points(data[own[0]:own[-1]], own - own[0])
        chars, places = squeeze(letters(points), places)
        grams = gram_buckets(chars, BITS)
        for i in range(hi - lo):
            a, b = places[i], places[i + 1]
            if not chars[a:b].any():
                yield None
                continue
            parts = [g[a:max(a, b - order)] for order, g in enumerate(grams)]
            yield np.bincount(np.concatenate(parts), minlength=1 << BITS)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.sqrt(v @ v)


def _document_frequencies(batches):
    seen, rows = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for counts in gram_counts(batch.column(0)):
            if counts is not None:
                seen += counts > 0
                rows += 1
    used = np.flatnonzero(seen)
    # Bucket -1 carries the number of rows.
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(seen[used], rows), pa.int64())], ["bucket", "n"])


def _sample_rows(idf: np.ndarray):
    def run(batches):
        for batch in batches:
            found = [(tf_idf(c, idf) if c is not None else None) for c in gram_counts(batch.column(0))]
            rows = [i for i, v in enumerate(found) if v is not None]
            at = [np.flatnonzero(found[i]) for i in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column(1).take(pa.array(rows, pa.int64())),
                lists(at, pa.int32()), lists([found[i][a] for i, a in zip(rows, at)], pa.float32()),
            ], ["lang", "at", "value"])
    return run


def train(
    learning: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 4000,
    l1: float = 0.02, l2: float = 1.0, seed: int = 7, id_col: str = "doc_id",
) -> Model:
    """Fit on rows with a text and a language.  At most ``sample_rows`` of them, dealt evenly
    to the languages by a hash of text and, if there is one, ``id_col`` (used for nothing
    else), train the weights; all of them give the IDF."""
    own = [column(learning, id_col).alias("id")] if id_col in learning.columns else []
    rows = learning.select(column(learning, text_col).alias("text"), column(learning, lang_col).alias("lang"), *own).where("text is not null and lang is not null")
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    languages = sorted(per_lang)
    seen = {r["bucket"]: r["n"] for r in rows.select("text").mapInArrow(_document_frequencies, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most 2^BITS + 1 rows
    total = seen.pop(-1, 0)
    idf = np.full(1 << BITS, np.log(1.0 + total) + 1)
    for bucket, n in seen.items():
        idf[bucket] = np.log((1.0 + total) / (1.0 + n)) + 1
    if not languages:
        return Model([], idf, np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)

    share: Column = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(1.0, sample_rows / len(languages) / per_lang[lang])).otherwise(share)
    sample = (
        bounded_sample(rows, sample_rows, share, rows.columns, seed).select("text", "lang").mapInArrow(_sample_rows(idf), "lang string, at array<int>, value array<float>")
        .toArrow()
    )
    order = {lang: k for k, lang in enumerate(languages)}
    label = np.array([order[x] for x in sample.column("lang").to_pylist()], np.int64)
    features = Rows.from_arrow(sample.column("at"), sample.column("value"))
    # Partitions arrive in any order; a fixed one keeps reruns equal.
    sort = features.order(label)
    features, label = features.take(sort), label[sort]
    targets = np.eye(len(languages))[label]
    held = np.arange(len(label)) % 5 == 4
    fit, rest = np.flatnonzero(~held), np.flatnonzero(held)
    weights, bias = ftrl(features.take(fit), targets[fit], 1 << BITS, l1, l2, seed=seed)
    heat = temperature(features.logits(weights, bias, rest), targets[rest])
    return Model(languages, idf, weights, bias, heat)


def predict(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` with lang_pred and score, one row per input row.

    A null text, or one without a letter, is ``und`` with score 0, as is any text when
    the model has learned no language.
    """
    # 2^BITS numbers a language.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.idf, model.weights, model.bias, model.temperature))

    def run(batches):
        languages, idf, weights, bias, heat = shared.value
        for batch in batches:
            langs, scores = [], []
            for counts in gram_counts(batch.column(0)):
                if counts is None or not languages:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                p = softmax(((tf_idf(counts, idf) @ weights + bias) / heat)[None])[0]
                langs.append(languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names[1:], "lang_pred", "score"])

    rows = docs.select(column(docs, text_col).alias("_text"), *[column(docs, c) for c in id_cols])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")
