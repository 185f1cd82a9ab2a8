import random

import numpy as np
import pandas as pd
import pytest

from millrace.llm import mixing as M

DOCS = "doc_id long, text string, lang string, source string, tokens int, uses string"
TARGETS = "source string, target_share double, max_repeats int"


def documents(spark, extra=()):
    rng = random.Random(1)
    words = "the mill was built near the old harbour and nobody knew why it had been closed".split()
    rows = []
    for k, (source, n) in enumerate((("big", 900), ("mid", 300), ("small", 40))):
        for i in range(n):
            rows.append((k * 10_000 + i, " ".join(rng.choices(words, k=rng.randint(5, 60))), rng.choice(["en", "DE", "fr-FR", None]), rng.choice([source, source.upper(), f"{source} "]), 0, ""))
    return spark.createDataFrame([*rows, *extra], DOCS)


def test_shares(spark):
    docs = documents(spark, [(90_001, None, "en", "big", 0, ""), (90_002, "x y", "en", None, 0, ""), (90_003, "x y", "en", "unknown", 0, ""), (None, "x", "en", "big", 0, "")])
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.1, 3)], TARGETS)
    mix = M.mixed(docs, targets)
    shares = {r["source"]: r for r in M.mix_shares(mix, targets).collect()}
    assert all(abs(shares[s]["actual_share"] - p) < 0.01 for s, p in (("big", 0.6), ("mid", 0.3), ("small", 0.1)))
    assert shares["small"]["most_uses"] == 3 and shares["big"]["most_uses"] == 1 and shares["mid"]["most_uses"] <= 2
    assert not {r["doc_id"] for r in mix.collect()} & {90_001, 90_002, 90_003, None}
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, M.mixed(docs, targets).collect()))


def test_missing_sources_and_empty_tables(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("ghost", 0.5, 2)], TARGETS)
    assert M.mixed(docs, targets).count() == 0  # no mix can give an absent source half of it
    assert M.mixed(docs.limit(0), targets).count() == 0 and M.mixed(docs, targets.limit(0)).count() == 0
    assert M.mix_shares(M.mixed(docs.limit(0), targets), targets).count() == 2


def test_rake_keeps_caps_and_shares():
    cells = pd.DataFrame([(s, g, t, n) for s, n in (("a", 1000), ("b", 100)) for g in ("en", "de") for t in (0, 1)], columns=["source", "lang", "topic", "tokens"])
    f, total = M.rake(cells, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4})
    used = (f * cells["tokens"]).groupby(cells["source"]).sum()
    assert total == pytest.approx(3200) and used["a"] == pytest.approx(1600) and used["b"] == pytest.approx(1600)
    assert (f <= cells["source"].map({"a": 1, "b": 4}) + 1e-9).all()


def plain_fit(x, topics=M.TOPICS, rounds=12):
    """The same k-means over vectors in memory, in their order."""
    x = x[x.any(axis=1)]
    c = [x[0] / np.linalg.norm(x[0])]
    while len(c) < topics:
        near = np.round((x @ np.stack(c).T).max(axis=1) / M.UNIT, 9)
        c.append(x[near.argmin()] / np.linalg.norm(x[near.argmin()]))
    c = np.stack(c)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == k].sum(axis=0) / np.linalg.norm(x[near == k].sum(axis=0)) if (near == k).any() else c[k] for k in range(len(c))])
    return c


def test_topics_are_fitted_on_all_documents(spark):
    """5,000 documents of four subjects and four of a fifth, with some that have no words: the fit equals one over all vectors, and the few have a topic of their own."""
    rng = random.Random(3)
    subjects = [["".join(rng.choices("abcdefghiklmnop", k=8)) for _ in range(12)] for _ in range(5)]
    texts = [" ".join(rng.choices(subjects[i % 4], k=30)) for i in range(5000)] + [" ".join(rng.choices(subjects[4], k=30)) for _ in range(4)] + ["1 2", "", "a b"]
    ids = [*range(5000), *range(5018, 5025)]  # 5018 to 5021 were not in the sample of a thousand that topics were once fitted on
    docs = spark.createDataFrame([(i, t, "en", "big", 0, "") for i, t in zip(ids, texts)], DOCS)
    topic = {r["doc_id"]: r["topic"] for r in M.measured(docs.repartition(7), ["big"], topics=5).collect()}
    few = {topic[i] for i in range(5018, 5022)}
    assert len(few) == 1 and not few & {topic[i] for i in range(5000)}
    centres = plain_fit(M._matrix(pd.Series(sorted(map(M._vector, texts)))), 5)
    assert [topic[i] for i in ids] == (M._matrix(pd.Series(list(map(M._vector, texts)))) @ centres.T).argmax(axis=1).tolist()
    assert len({topic[i] for i in range(5000)}) == 4
    again = {r["doc_id"]: r["topic"] for r in M.measured(docs.repartition(3), ["big"], topics=5).collect()}
    assert again == topic


def test_topics_of_few_texts(spark):
    docs = lambda texts: spark.createDataFrame([(i, t, "en", "big", 0, "") for i, t in enumerate(texts)], DOCS)
    assert {r["topic"] for r in M.measured(docs(["1", "", "2 3"]), ["big"]).collect()} == {0}
    assert len({r["topic"] for r in M.measured(docs(["mill bridge", "mill bridge", "harbour", ""]), ["big"]).collect()}) == 2
    assert M.measured(docs(["x"]).limit(0), ["big"]).count() == 0
