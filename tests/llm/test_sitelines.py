from millrace.llm import sitelines as S

PROCESSED = "row_key string, url string, text string, line string"
CRAWL = "row_key string, url string, site string"


def frames(spark, rows, crawl=()):
    return spark.createDataFrame(rows, PROCESSED), spark.createDataFrame(list(crawl), CRAWL)


def test_lines(spark):
    rows = [(f"k{i}", "http://www.A.org:80/x" if i % 2 else "https://a.org/y", f"Share this page!\nText number one of page {'abcdefgh'[i] * 5}\n© {2000 + i} A. org\nabc", "") for i in range(5)]
    rows += [("k0", "https://a.org/y", "SHARE  this-page\n\nabc", ""), ("n", None, "share this page", ""), ("t", "https://a.org/", None, ""), (None, "https://a.org/", "share this page", ""), ("z", None, "share this page", "")]
    p, c = frames(spark, rows, [("n", "http://a.org/q", "x"), ("n", "http://a.org/q", "x")])
    found = S.repeated_lines(p, c).where("docs >= 5").collect()
    got = {(r["row_key"], r["line_no"]) for r in found}
    assert got == {(f"k{i}", 1) for i in range(5)} | {(f"k{i}", 3) for i in range(5)} | {("n", 1)}
    assert all(r["covered"] >= r["docs"] and r["constant"] == 1.0 for r in found)


def test_slots(spark):
    rows = [(f"k{i}", "https://b.org/", f"Posted by {n} in the evening news\n{n} went home while {i} others of the {n} family stayed", "") for i, n in enumerate("Ann Bob Cid Dora Emil Fay".split())]
    p, c = frames(spark, rows)
    found = {(r["row_key"], r["line_no"]): r for r in S.repeated_lines(p, c).collect()}
    assert set(found) == {(f"k{i}", 1) for i in range(6)} and all(r["docs"] == 1 and r["covered"] == 6 for r in found.values())
    assert all(0.8 < r["constant"] < 0.9 for r in found.values())
    clean = {r["row_key"]: r["clean_text"] for r in S.without_repeated_lines(p, c).collect()}
    assert clean["k1"] == "Bob went home while 1 others of the Bob family stayed"


def test_edges(spark):
    p, c = frames(spark, [])
    assert S.repeated_lines(p, c).count() == 0 and S.without_repeated_lines(p, c).count() == 0
    p, c = frames(spark, [("k", "https://a.org/", "x" * 500_000, ""), ("e", "https://a.org/", "", "")])
    assert S.repeated_lines(p, c).count() == 0
    assert {r["row_key"]: r["clean_text"] for r in S.without_repeated_lines(p, c).collect()}["e"] == ""


def test_templates_of_one_leaf_stay_apart(spark):
    names = "Ann Bob Cid Dora Emil Fay".split()
    rows = [(f"a{i}", "https://c.org/", f"Photographs by {n} for the valley news", "") for i, n in enumerate(names)]
    rows += [(f"b{i}", "https://c.org/", f"Photographs of {n} at the winter fair", "") for i, n in enumerate(names)]
    rows += [("odd", "https://c.org/", "Photographer seeks an old brass lens", ""), ("other", "https://d.org/", "Photographs by Ann for the valley news", "")]
    p, c = frames(spark, rows)
    found = {r["row_key"]: r for r in S.repeated_lines(p, c).collect()}
    assert set(found) == {f"{k}{i}" for k in "ab" for i in range(6)}
    assert all(r["covered"] == 6 and r["docs"] == 1 for r in found.values())


def test_spacing_and_scripts(spark):
    forms = ["E-mail us now", "Email us now!", "e mail USNOW", "Email us, now", "Email us now"]
    rows = [(f"k{i}", "https://e.org/", f"{x}\n著作権は当社に帰属します\nสงวนลิขสิทธิ์ทั้งหมด", "") for i, x in enumerate(forms)]
    p, c = frames(spark, rows)
    assert {(r["row_key"], r["line_no"]) for r in S.repeated_lines(p, c).where("docs = 5").collect()} == {(f"k{i}", n) for i in range(5) for n in (1, 2, 3)}


def test_joined_by_shuffle(spark, monkeypatch):
    rows = [(f"k{i}", "https://f.org/", f"Share this page\nOnly here {'xyzuvw'[i]}", "") for i in range(6)]
    p, c = frames(spark, rows)
    whole = sorted(map(tuple, S.repeated_lines(p, c).collect()))
    monkeypatch.setattr(S, "BROADCAST_LEAVES", 0)
    assert sorted(map(tuple, S.repeated_lines(p, c).collect())) == whole and len(whole) == 12
