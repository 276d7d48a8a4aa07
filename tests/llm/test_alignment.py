import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from causalog.llm import alignment as A
from causalog.llm.common import written
from llm.docs import docs

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


@pytest.fixture(scope="module")
def plain():
    """Both encoders on a whole text, without units: lists of (id, bytes)."""
    a = Tokenizer.from_file(f"{A.FOLDER}/{A.BYTE_FILE}")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{A.FOLDER}/{A.PIECE_FILE}")
    letters = A.byte_letters()

    def encode(text):
        left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return left, right
    return encode


def brute(texts, encode):
    per_text, total = [], Counter()
    for text in texts:
        left, right = encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            per_text.append(None)
            continue
        spans = []
        for side in (left, right):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, at = [], [0, 0]
        for hi in cuts:
            own = [[], []]
            for k, side in enumerate(spans):
                while at[k] < len(side) and side[at[k]][2] <= hi:
                    own[k].append(str(side[at[k]][0]))
                    at[k] += 1
            groups.append("|".join(map(",".join, own)))
        links, start = [], 0
        for i, s, e in spans[0]:
            for k in range(start, len(spans[1])):
                j, s2, e2 = spans[1][k]
                if e2 <= s:
                    start = k + 1
                elif s2 >= e:
                    break
                else:
                    links.append((i, j))
        total.update(links)
        per_text.append((len(left), len(right), len(groups), links, ";".join(groups)))
    best = {}
    for (i, j), n in total.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for row in per_text:
        if row is None:
            out.append((0, 0, 0, 0, "", 0, 0))
        else:
            a, b, g, links, text = row
            out.append((a, b, g, len(links), hashlib.sha256(text.encode()).hexdigest(), sum(total[p] == best[p[1]] for p in links), sum(total[p] for p in links)))
    return out


def result(table, **limit):
    aligned = A.align_tokens(table)
    rows = written(aligned.withColumn("sha", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups"))
    return A.with_link_counts(rows, [*COLUMNS, "sha"], **limit)


def check(spark, rows, encode, **limit):
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_a, r.n_b, r.n_groups, r.n_links, r.sha, r.n_best, r.count_sum) for r in result(docs(spark, rows), **limit).collect())
    want = sorted(((r[0] is None, r[0] or 0), *w) for r, w in zip(rows, brute([r[1] for r in rows], encode)))
    assert got == want


TEXTS = [
    "Hello world, how are you?", "", None, " ", "  two  blanks ", "a", "trailing ", "\ttab\n new \r\n line", "naïve café 日本語 テスト", "x y z",
    "<|endoftext|> </s> <unk> <0x41>", "it's we'll 'tis", "1234567 89 0", "🙂🙃 👩‍👩‍👧 é", "▁under▁ score", "a\x00b \x01", "ﬁne ﬀ ½ Å",
    "one two one two one two", "!!! ??? ...", "　wide space  em", "word ́combining", "Ω≈ç√ ∫ ≤ ≥", "same text", "same text",
]


def test_against_whole_texts(spark, plain):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, "again"), (5, "again"), (None, "no id"), (None, None)]
    check(spark, rows, plain)
    check(spark, rows, plain, limit=0)


def test_sample_documents(spark, plain):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in d.collect()], plain)


def test_long_texts(spark, plain):
    check(spark, [(1, "ab " * 20_000), (2, "x" * 3_000), (3, "日本" * 3_000), (4, " " * 2_000 + "end")], plain)


def test_units_join_to_the_text():
    for text in TEXTS:
        if text is not None:
            assert " ".join(A.units(text)) == text
    assert A.units("a b  c  d") == ["a", "b  c  d"]


def test_cuts_by_divide_and_conquer():
    rng = np.random.default_rng(1)
    for density in (0.02, 0.3, 0.9):
        for n in (1, 2, 17, 400):
            a, b = (np.unique(np.append(np.flatnonzero(rng.random(n) < density), n)) for _ in range(2))
            assert A.shared_cuts(a, b, np.array([0]), np.array([len(a) - 1])).tolist() == np.intersect1d(a, b).tolist()


def test_many_texts_share_the_encoder_and_its_cache(plain):
    encoder = A._encoder(A.FOLDER, A.BYTE_FILE, A.PIECE_FILE)
    assert encoder.splits
    for texts in (["some words here", "long" * 40 + " unit"], ["words here some", "long" * 40]):
        (a, at), (b, bt) = encoder(texts)
        for i, t in enumerate(texts):
            left, right = plain(t)
            assert a[at[i]:at[i + 1]].tolist() == [x for x, _ in left] and b[bt[i]:bt[i + 1]].tolist() == [x for x, _ in right]


def test_empty_table_and_clashing_columns(spark):
    assert result(docs(spark, [])).count() == 0
    extra = docs(spark, [(1, "a b")]).withColumns({c: F.lit(c) for c in ("row", "n_a", "pairs", "times", "groups", "pair", "count", "best")})
    assert result(extra).first()[:2] == (1, 2)
