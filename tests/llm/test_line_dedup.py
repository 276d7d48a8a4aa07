import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from causalog.llm.features import SpanHash
from causalog.llm.line_dedup import dedup_lines, one_edit_keys, part_keys, within_one_edit
from llm.docs import docs


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


ab = st.text("abé", max_size=7)


@settings(max_examples=300, deadline=None)
@given(ab, ab)
def test_verification_is_the_edit_distance(a, b):
    assert within_one_edit(a, b) == (edit_distance(a, b) <= 1)


def numbers(text):
    return np.array([ord(c) for c in text], np.uint32)


def parts_of(text):
    h = SpanHash(numbers(text))
    return part_keys(h, np.array([0]), np.array([len(text)]))[0].tolist()


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=4, max_size=12), st.integers(0, 12), st.sampled_from("abc"), st.sampled_from("pcr"))
def test_neighbours_meet_on_a_part_and_on_a_variant(a, at, c, kind):
    at = min(at, len(a) - 1)
    b = a[:at] + {"p": c + a[at:], "c": c + a[at + 1:], "r": a[at + 1:]}[kind]
    if a == b:
        return
    ka, kb = parts_of(a), parts_of(b)
    common = set(ka) & set(kb)
    assert common
    own = [[i for i, k in enumerate(ks) if k in common] for ks in (ka, kb)]
    assert met(keys_of(a, own[0]), keys_of(b, own[1]))


def keys_of(text, parts):
    return {(k, kind) for k, kind in zip(*(x.tolist() for x in one_edit_keys(numbers(text), parts)))}


def met(a, b):
    partner = {0: 1, 1: 0, 2: 2}
    return any((k, partner[kind]) in b for k, kind in a)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=9), st.text("ab", min_size=1, max_size=9))
def test_lines_that_meet_are_within_one_edit(a, b):
    every = list(range(8))
    if met(keys_of(a, every), keys_of(b, every)):
        assert edit_distance(a, b) <= 1


def brute(rows, least):
    order = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda r: r[:2])
    seen, kept = {}, {}
    for last, i, text in order:
        own = []
        for n, line in enumerate(text.split("\n")):
            near = len(line) >= least and any(
                len(x) >= least and abs(len(x) - len(line)) <= 1 and edit_distance(x, line) <= 1 for x in seen)
            if not line.strip() or (line not in seen and not near):
                own.append(n)
            if line.strip():
                seen.setdefault(line, True)
        kept[last, i, text] = own
    return kept


def check(spark, rows, least):
    got = dedup_lines(docs(spark, rows), least=least).collect()
    assert len(got) == len(rows)
    kept = brute(rows, least)
    want = []
    for i, text, *_ in rows:
        if text is None:
            want.append((i, 0, [], None))
        else:
            lines, own = text.split("\n"), kept[i is None, i or 0, text]
            want.append((i, len(lines), own, "\n".join(lines[n] for n in own)))
    assert sorted(((r.doc_id, r.n_lines, list(r.kept), r.text) for r in got), key=repr) == sorted(want, key=repr)


def test_against_all_pairs(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(4, 14))) for _ in range(25)]

    def line():
        t = rng.choice(base)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t = rng.choice([t[:at] + rng.choice("abx") + t[at:], t[:at] + t[at + 1:], t[:at] + "y" + t[at + 1:]])
        return t

    check(spark, [(i, "\n".join(line() for _ in range(rng.randrange(1, 7)))) for i in range(40)], 5)


def test_nulls_blanks_repeats_and_long_lines(spark):
    long = "all work and no play " * 70
    check(spark, [
        (4, "one line of text here\n\nother"), (2, "one line of text here!\n \nOther"), (1, None), (3, ""), (5, "\n"), (6, long),
        (7, long[:900] + long[901:] + "\nshort"), (None, "one line of text, here\nshort"), (8, "a\nb\na"), (9, "a\nb\na"), (9, "a\nb\na"), (10, "tail\n"),
    ], 20)


def test_one_template_with_many_lines(spark):
    # All differ at one place: every line is within one edit of the first.
    rows = [(i, f"report number {chr(200 + i)} of the year") for i in range(200)]
    got = dedup_lines(docs(spark, rows)).where(F.size("kept") > 0).collect()
    assert [r.doc_id for r in got] == [0]


def test_empty_table_and_clashing_columns(spark):
    assert dedup_lines(docs(spark, [])).count() == 0
    extra = docs(spark, [(1, "some line"), (2, "some line")]).withColumns({c: F.lit(c) for c in ("id", "th", "no", "digest", "keys", "lines", "kept", "first", "near")})
    assert sorted((r.doc_id, r.text) for r in dedup_lines(extra).collect()) == [(1, "some line"), (2, "")]
