from millrace.operators import kv as K
from millrace.sources import rowformat as RF


def cells(spark, rows):
    return spark.createDataFrame(rows, K.SCHEMA)


ROWS = [("a", "x", "1", 1), ("a", "x", "2", 2), ("a", "y", "3", 1), ("b", "x", "4", 1), ("c", "z", None, 1)]


def found(df):
    return sorted((r["row_key"], r["col"], r["value"]) for r in df.collect() if r["value"] is not None)


def test_reads(spark):
    c = cells(spark, ROWS)
    assert found(K.latest(c)) == [("a", "x", "2"), ("a", "y", "3"), ("b", "x", "4")]
    assert found(K.get_row(c, "a", 1)) == [("a", "x", "1"), ("a", "y", "3")]
    assert K.get(c, "a", "x").first()["value"] == "2" and K.get(c, "q", "x").first() is None
    assert K.exists_row(c, "b") and not K.exists_row(c, "q")
    assert {r["row_key"] for r in K.scan(c, "a", "c").collect()} == {"a", "b"}
    assert K.count_rows(c).first()[0] == 3


def test_writes(spark):
    c = cells(spark, ROWS)
    new = spark.createDataFrame([("a", "x", "9"), ("n", "x", "8")], "row_key string, col string, value string")
    assert found(K.latest(K.put(c, new))) == [("a", "x", "9"), ("a", "y", "3"), ("b", "x", "4"), ("n", "x", "8")]
    assert found(K.latest(K.put_where(c, new, "y", "3"))) == [("a", "x", "9"), ("a", "y", "3"), ("b", "x", "4")]
    assert found(K.latest(K.put_rows(c, new))) == [("a", "x", "9"), ("b", "x", "4"), ("n", "x", "8")]


def test_versions_are_raised(spark):
    new = lambda v: spark.createDataFrame([("r", "c", v)], "row_key string, col string, value string")
    c = K.put(K.put(cells(spark, []), new("zebra")), new("apple"))
    assert K.get(c, "r", "c").first()["value"] == "apple"
    rows = K.put_rows(cells(spark, [("r", "c", "z", 7), ("r", "d", "z", 3)]), new("a"))
    assert [(r["col"], r["value"], r["version"]) for r in rows.collect()] == [("c", "a", 8)]
    s = K.Store(spark)
    s.delete("kv_raise")
    for v in ("zebra", "apple"):
        s.put("kv_raise", new(v))
    assert K.get(s.read("kv_raise"), "r", "c").first()["value"] == "apple" and s.read("kv_raise").agg({"version": "max"}).first()[0] == 2
    s.delete("kv_raise")


def test_view_pages(spark):
    c = cells(spark, [(f"k{i}", "c", "v" * 2000, 1) for i in range(5)])
    first = K.view(c, "", 2).orderBy("row_key").collect()
    assert [r["row_key"] for r in first] == ["k0", "k1"] and {r["next_key"] for r in first} == {"k2"} and len(first[0]["cells"]["c"]) == 1024
    last = K.view(c, "k4", 2).collect()
    assert len(last) == 1 and last[0]["next_key"] is None
    assert K.view(cells(spark, []), "", 2).count() == 0


def test_differences(spark):
    a = cells(spark, ROWS)
    b = cells(spark, [("a", "x", "2", 7), ("a", "y", "3", 7), ("b", "x", "5", 1), ("d", "x", "1", 1)])
    assert sorted((r["row_key"], r["side"]) for r in K.differing_rows(a, b).collect()) == [("b", "both"), ("c", "left"), ("d", "right")]


def test_store(spark):
    s = K.Store(spark)
    for t in ("kv_one", "kv_two"):
        s.delete(t)
    s.create("kv_one")
    s.put("kv_one", cells(spark, ROWS))
    s.rename("kv_one", "kv_two")
    assert s.read("kv_two").count() == 5 and "kv_two" in s.tables() and "kv_one" not in s.tables()
    s.delete("kv_two")
    s.delete("kv_two")


def test_row_format(spark, tmp_path):
    data = RF.format_row("k 1".replace(" ", "-"), {"a": b"x y\nz", "b": b""}) + RF.format_row("q", {})
    assert list(RF.parse_rows(data)) == [("k-1", "a", b"x y\nz"), ("k-1", "b", b"")]
    (tmp_path / "f").write_bytes(data)
    assert found(RF.read_cells(spark, str(tmp_path))) == [("k-1", "a", "x y\nz"), ("k-1", "b", "")]
    for key in ("plain-1", "a/b c", "ü_x"):
        assert RF.decode_key(RF.encode_key(key)) == key


def test_prefix_sample_and_cells(spark):
    rows = spark.createDataFrame([(k,) for k in ("aaa1", "aaa2", "aaa3", "aaa4", "aab1", "aab1")], "row_key string")
    assert sorted(r[0] for r in K.sampled_by_prefix(rows).collect()) == ["aaa1", "aaa2", "aaa3", "aab1"]
    from pyspark.sql import functions as F

    wide = spark.createDataFrame([("k", 1, None)], "id string, a int, b string")
    assert found(K.to_cells(wide, "id", F.lit(1), ["a", "b"])) == [("k", "a", "1")]
