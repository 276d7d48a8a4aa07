import random
import re

from pyspark.sql import functions as F

from causalog.llm.decontaminate import decontaminate
from llm.docs import docs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for item, content in items:
        w = words(content)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            part = w[at:at + window]
            for i in range(len(own) - len(part) + 1):
                if own[i:i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def check(spark, rows, items):
    got = decontaminate(docs(spark, rows), items_table(spark, items)).collect()
    want = sorted(((r[0], *brute(r[1], items)) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=repr) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    for r in got:
        assert len({p for s in r.spans for p in range(s.start, s.start + s.len)}) == r.n_hit


def test_random_texts_of_few_words(spark):
    rng = random.Random(4)

    def text(n):
        return " ".join(rng.choice(["The", "of", "a", "é", "x1", "B-c", "zz"]) for _ in range(n))

    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 30, 10, 2])]
    rows = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    rows += [(100 + i, text(4) + " ! " + t + ", " + text(4)) for i, (_, t) in enumerate(items)]
    check(spark, rows, items)


LONG = " ".join(f"word{i}" for i in range(40))


def test_nulls_repeats_and_long_texts(spark):
    items = [(7, LONG), (70, LONG), (8, None), (9, "..."), (10, "École ÉTÉ"), (None, "null item id here it is now and so on to ten words")]
    items = [i for i in items if i[0] is not None]
    rows = [
        (1, LONG.upper()), (1, "clean"), (2, None), (3, ""), (4, "x " * 30_000 + LONG + " y" * 30_000), (5, LONG), (5, LONG),
        (None, LONG + " tail"), (None, "nothing"), (6, "École ÉTÉ"), (7, "école été"), (8, " ".join(LONG.split()[5:15])), (9, " ".join(LONG.split()[5:14])),
    ]
    check(spark, rows, items)


def test_rows_without_ids_gather_their_own_windows_only(spark):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(10))) for i in range(80)]
    check(spark, [(None, f"so {text} on") for _, text in items] + [(5, text) for _, text in items] + [(None, items[3][1])] * 20, items)


def test_one_very_common_word_is_an_item(spark):
    check(spark, [(i, "the cat and the dog " * (i % 5)) for i in range(30)], [(1, "the"), (2, "the dog"), (3, "bird")])


def test_empty_tables_and_clashing_columns(spark):
    assert decontaminate(docs(spark, []), items_table(spark, [(1, "a b c")])).count() == 0
    for items in ([], [(1, None)]):
        got = decontaminate(docs(spark, [(1, "a b"), (2, None)]), items_table(spark, items)).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got) == [(1, 2, 0, False), (2, 0, 0, False)]
    extra = docs(spark, [(1, LONG)]).withColumns({c: F.lit(c) for c in ("id", "words", "n", "h", "pos", "hits", "item_id", "start", "len")})
    assert decontaminate(extra, items_table(spark, [(1, LONG)]).withColumn("words", F.lit(1))).first().n_hit == 40
