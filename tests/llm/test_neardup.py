import random

from millrace.llm import neardup as N

SCHEMA = "row_key string, text string, similarity int"


def brute(rows, t=0.5):
    sets = {}
    for k, x, _ in rows:
        if k is not None and x is not None:
            c = N.canonical(x)
            sets[k] = {c[i : i + N.N] for i in range(len(c) - N.N + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > t}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäß", k=rng.randint(3, 9))) for _ in range(4000)]
    rows = []
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        for v in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, len(words) // 6)):
                at = rng.randrange(len(words))
                words[at : at + rng.choice((0, 1, 1))] = [rng.choice(vocabulary)]
            rows.append((f"k{g:02d}{v}", " ".join(words).upper() if rng.random() < 0.2 else ", ".join(words), 1))
    return rows


def pairs(df):
    return {(r["row_key_a"], r["row_key_b"]) for r in df.collect()}


def test_against_all_pairs(spark):
    rows = corpus(5)
    rows += [("copy1", rows[0][1], 1), ("copy1", rows[0][1], 1), ("empty", "", 1), ("none", None, 1), (None, rows[0][1], 1), ("short", "abc", 1), ("short2", "abc", 1), ("exact9", "abcdefghi", 1), ("exact9b", "ABC def-ghi", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = brute(rows)
    got = pairs(N.similar_pairs(df))
    assert got <= expected and len(expected - got) <= 0.02 * len(expected)
    assert ("exact9", "exact9b") in got


def test_groups(spark):
    rows = corpus(6)
    df = spark.createDataFrame([*rows, ("x", rows[0][1], 1)], SCHEMA)
    links = brute([*rows, ("x", rows[0][1], 1)])
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in links:
        parent[find(a)] = find(b)
    got = {r["row_key"]: r["group_id"] for r in N.near_duplicate_groups(df).collect()}
    assert len(got) == len(rows) + 1
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in got for b in got)


def test_one_copied_text_is_one_class(spark):
    df = spark.createDataFrame([(f"k{i}", "the same text in every single row", 0) for i in range(50)], SCHEMA)
    members, links = N.similar_classes(df)
    assert members.select("a", "b").distinct().count() == 1 and links.count() == 0
    assert N.similar_pairs(df).count() == 50 * 49 // 2


def test_one_key_with_two_texts(spark):
    a, b = "the first of the two texts stands under the same key as", "another one which is quite unlike it in every way, really"
    df = spark.createDataFrame([("k", a, 0), ("k", b, 0), ("x", a + " x", 0), ("y", b + " y", 0)], SCHEMA)
    assert pairs(N.similar_pairs(df)) == {("k", "x"), ("k", "y")}


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert N.similar_pairs(empty).count() == 0 and N.near_duplicate_groups(empty).count() == 0
    long = "".join(random.Random(1).choices("abcdefghij ", k=300_000))
    df = spark.createDataFrame([("a", long, 0), ("b", long + " and more", 0)], SCHEMA)
    assert pairs(N.similar_pairs(df)) == {("a", "b")}


def test_a_group_of_many_near_copies(spark):
    """Near-copies and a chain of ever more changed texts come into the groups of all links, though not every pair is compared."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghiklmnoprst", k=6))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(120)] = word()
        rows.append((f"near{i:03}", " ".join(t)))
    chain = list(base)
    for i in range(12):
        for k in range(10 * i, 10 * i + 10):
            chain[k] = word()
        rows.append((f"step{i:02}", " ".join(chain)))
    rows += [(f"other{i}", " ".join(word() for _ in range(120))) for i in range(20)]
    df = spark.createDataFrame(rows, "row_key string, text string")
    _, links = N.similar_classes(df)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    members, links = N.similar_classes(df)
    for r in links.collect():
        parent[root((r["ax"], r["bx"]))] = root((r["ay"], r["by"]))
    expected = {}
    for r in members.collect():
        expected.setdefault(root((r["a"], r["b"])), set()).add(r["row_key"])
    got = {}
    for r in N.near_duplicate_groups(df).collect():
        got.setdefault(r["group_id"], set()).add(r["row_key"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values())) and max(map(len, got.values())) > 150
