import random

import pytest

from millrace.llm import leakage as K

DOCS, ITEMS = "doc_id long, text string, item_id int", "item_id long, text string, doc_id int"


def brute(docs, items):
    out = set()
    for i, t, *_ in items:
        w = K.words_of(t or "")
        grams = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
        for d, x, *_ in docs:
            v = K.words_of(x or "")
            if any(tuple(v[k : k + 10]) in grams for k in range(len(v) - 9)):
                out.add((d, i))
    return out


def case(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40))), 0) for i in range(20)]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randint(5, 60))]
        if rng.random() < 0.6:
            t = rng.choice(items)[1].split()
            a = rng.randrange(len(t))
            cut = t[a : a + rng.randint(5, 20)]
            w[rng.randrange(len(w)) : 0] = [c.upper() if rng.random() < 0.3 else c for c in cut]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w), 0))
    return docs, items


@pytest.mark.parametrize("limit", [K.BROADCAST_WORDS, 0])
def test_against_all_windows(spark, limit):
    docs, items = case(3)
    docs += [(900, None, 0), (901, "", 0), (0, docs[0][1], 0)]
    items += [(900, None, 0), (901, "too short", 0), (0, items[0][1], 0)]
    got = K.leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), broadcast_words=limit)
    assert {(r["doc_id"], r["item_id"]) for r in got.where("longest_run >= 10").collect()} == brute(docs, items)


def test_substitutions_are_tolerated(spark):
    passage = " ".join(f"word{i}" for i in range(24))
    changed = passage.replace("word6 ", "other ").replace("word15 ", "thing ")
    got = K.leaked_items(spark.createDataFrame([(1, "start " + changed + " end", 0)], DOCS), spark.createDataFrame([(7, passage, 0)], ITEMS)).collect()
    assert [(r["doc_id"], r["item_id"], r["longest_run"], r["overlap"], r["substitutions"]) for r in got] == [(1, 7, 8, 22, 2)]


def test_empty(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert K.leaked_items(d, i).count() == 0
    assert K.leaked_items(spark.createDataFrame([(1, "a b", 0)], DOCS), i).count() == 0


def test_words():
    assert K.words_of("L’Été, naïve\nSTRASSE 42") == ["l", "ete", "naive", "strasse", "42"]
