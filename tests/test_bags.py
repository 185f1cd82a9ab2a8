"""Bag and pair operators against plain Python on random input."""

from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import bag as B
from millrace.operators import pairs as P

FAST = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
words = st.lists(st.text("abc", min_size=1, max_size=3), max_size=12)
pairs = st.lists(st.tuples(st.sampled_from("xyz"), st.text("ab", min_size=1, max_size=2)), max_size=10)


def frame(spark, p):
    return spark.createDataFrame(p, "key string, value string")


@FAST
@given(words, words)
def test_sets(spark, a, b):
    x, y = B.parallelize(spark, a), B.parallelize(spark, b)
    assert sorted(B.collect(B.distinct(x))) == sorted(set(a))
    assert sorted(B.collect(B.union(x, y))) == sorted(a + b)
    assert sorted(B.collect(B.intersection(x, y))) == sorted(set(a) & set(b))
    assert B.count(x) == len(a) and B.take(x, 3).count() == min(3, len(a))


@FAST
@given(pairs, pairs)
def test_pairs(spark, a, b):
    x, y = frame(spark, a), frame(spark, b)
    assert sorted(P.collect(P.join(x, y))) == sorted((k, f"{v},{w}") for k, v in a for q, w in b if k == q)
    assert sorted(P.collect(P.intersection(x, y))) == sorted(set(a) & set(b))
    left, right = defaultdict(list), defaultdict(list)
    for k, v in a:
        left[k].append(v)
    for k, v in b:
        right[k].append(v)
    expected = sorted((k, f"[{','.join(sorted(left[k]))}],[{','.join(sorted(right[k]))}]") for k in {*dict(a), *dict(b)})
    assert sorted(P.collect(P.cogroup(x, y))) == expected
    counts = P.fold_by_key(x, F.count(F.lit(1)), "n").collect()
    assert {r["key"]: r["n"] for r in counts} == Counter(k for k, _ in a)
    joined = P.fold_by_key_ordered(x, F.lit(""), lambda acc, v: F.concat(acc, v)).collect()
    assert {r["key"]: r["value"] for r in joined} == {k: "".join(sorted(v)) for k, v in left.items() if v}


def test_flat_maps(spark):
    b = B.parallelize(spark, ["a b", "", "c", None])
    assert sorted(B.collect(B.flat_map(b, F.filter(F.split("value", " "), lambda w: w != "")))) == ["a", "b", "c"]
    assert sorted(B.collect(B.flat_map_python(b, lambda s: s.split() if s else None))) == ["a", "b", "c"]
    assert sorted(B.collect(B.map_partitions(B.parallelize(spark, ["1", "2"]), lambda it: (str(int(v) + 5) for v in it)))) == ["6", "7"]
    assert sorted(P.collect(B.map_to_pair(b, F.nullif(F.substring("value", 1, 1), F.lit("")), F.col("value")))) == [("a", "a b"), ("c", "c")]
    made = F.array(F.struct(F.lit("k").alias("key"), F.col("value").alias("value")))
    assert B.flat_map_to_pair(b, made).count() == 4
    p = frame(spark, [("k", "a b"), (None, "c")])
    assert sorted(B.collect(P.flat_map(p, F.split("value", " ")))) == ["a", "b", "c"]
    assert P.flat_map_to_pair(p, F.array(F.struct("key", "value"))).count() == 1


def test_null_keys_never_match(spark):
    p = frame(spark, [(None, "a"), ("k", "b")])
    assert P.collect(P.join(p, p)) == [("k", "b,b")]


def test_folds(spark):
    b = B.parallelize(spark, ["1", "2", "3", "4"]).repartition(4)
    assert B.fold(b, F.sum(F.col("value").cast("int")).alias("s")).first()["s"] == 10
    n = b.rdd.getNumPartitions()
    assert int(B.fold_python(b, "10", lambda x, y: str(int(x) + int(y)))) == 10 + 10 * (n + 1)


def test_sample_share(spark):
    b = B.parallelize(spark, [str(i) for i in range(4000)])
    assert abs(B.sample(b, 0.3, 3).count() / 4000 - 0.3) < 0.1
    assert B.sample(b, 0.3, 3).count() == B.sample(b, 0.3, 3).count()


def test_group_by_table_and_destroy(spark):
    b = B.parallelize(spark, ["ab", "ac", "b"])
    assert sorted(P.collect(B.group_by(b, F.substring("value", 1, 1)))) == [("a", "ab,ac"), ("b", "b")]
    assert B.containing(b, "a").count() == 2
    t = B.save_as_table(b, "bag_under_test")
    assert t.count() == 3
    B.destroy(spark, "bag_under_test")
    assert not spark.catalog.tableExists("bag_under_test")
    assert B.collect(B.from_table(frame(spark, [("k", "v"), ("q", None)]), F.col("value"))) == ["v"]
