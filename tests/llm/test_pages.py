"""Page blocks, furniture, stuffing and residue."""

import random

import numpy as np

from millrace.llm import boilerplate as B
from millrace.llm import residue as R
from millrace.llm import stuffing as F
from millrace.llm.pages import blocks_of

CRAWL = "row_key string, url string, title string, page string, text string, site string"
PROCESSED = "row_key string, text string, page string, line_no int"
NOUNS = "mill bridge garden clock library harbour kettle ledger valve lantern orchard tunnel".split()


def sentence(rng):
    a, b, c = rng.sample(NOUNS, 3)
    return rng.choice([f"The {a} near the {b} was repaired because the {c} had been moved before dawn.", f"Visitors to the {a} still ask about the old {b} and the {c} beside it.", f"When the {a} was closed, the people of the {b} had to rebuild the {c} by hand."])


def article(rng, site, names=True, extra=""):
    nav, side, foot = ("menu", "sidebar", "footer") if names else ("q1x", "z7k", "p3w")
    body = "".join(f"<p>{' '.join(sentence(rng) for _ in range(3))}</p>" for _ in range(4))
    head = f"How the {rng.choice(NOUNS)} of {rng.randint(1, 999)} was found"
    return head, (
        f'<html><head><title>{head} | {site}</title></head><body><div class="{nav}"><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></div>'
        f'<div class="{"article" if names else "m0"}"><h1>{head}</h1>{body}{extra}<ul><li>3 x eggs</li><li>1 x flour</li></ul></div>'
        f'<div class="{side}"><h4>Most read</h4><p><a href="/x">{head[::-1]}</a></p></div><div class="{foot}"><p>All rights reserved by {site}</p></div></body></html>'
    )


def test_blocks():
    b = blocks_of("<body><nav>A <a href=x>B</a> C</nav><p>One<br>two &amp; <i>three</i><P>four<noscript>off</noscript><script>x<y</script><!-- <p>no --></body>")
    assert [x.text for x in b] == ["A B C", "One", "two & three", "four", "off"]
    assert (b[0].words, b[0].linked, b[0].hold) == (3, 1, "nav") and "noscript" in b[4].path
    assert [x.text for x in blocks_of("a\n\n b  c ")] == ["a", "b c"] and blocks_of("") == [] and blocks_of("<") and blocks_of("<p") is not None


def test_tree_separates():
    rng = np.random.default_rng(1)
    x = rng.random((500, 4)).astype(np.float32)
    y = (x[:, 1] > 0.4) & (x[:, 3] < 0.7)
    tree = B.Tree().fit(x, y)
    assert ((tree.predict(x) >= 0.5) == y).mean() > 0.99
    assert B.Tree().fit(x[:5], np.ones(5)).predict(x[:5]).tolist() == [1.0] * 5


def test_furniture_of_unnamed_markup(spark):
    rng = random.Random(2)
    crawl, processed, truth = [], [], {}
    for i in range(80):
        named = i < 60
        head, page = article(rng, f"site{i % 7}", named)
        crawl.append((f"k{i}", f"http://site{i % 7}.org/{i}", head, page, "", ""))
        lines = [b.text for b in B.visible(page)]
        processed.append((f"k{i}", "\n".join(lines), "", 0))
        truth[f"k{i}"] = {n + 1 for n in (0, 1, len(lines) - 3, len(lines) - 2, len(lines) - 1)}
    crawl += [("pdf", "u", "t", "Plain title\nPlain text line.", "", ""), ("pdf", "u", "t", "Plain title\nPlain text line.", "", ""), ("nul", None, None, None, None, None)]
    processed += [("pdf", "Plain title\nPlain text line.\n--", "", 0), ("nul", None, None, None), ("orphan", "Menu\nA long sentence that says something about a mill and a bridge.", "", 0), ("empty", "", "", 0)]
    c, p = spark.createDataFrame(crawl, CRAWL), spark.createDataFrame(processed, PROCESSED)
    got = {}
    for r in B.furniture_lines(p, c).collect():
        got.setdefault(r["row_key"], set()).add(r["line_no"])
    wrong = sum(len(got.get(k, set()) ^ t) for k, t in truth.items())
    assert wrong <= 4, wrong
    assert got.get("pdf") == {3} and "nul" not in got
    texts = {r["row_key"]: r["main_text"] for r in B.main_text(p, c).collect()}
    assert "Home" not in texts["k70"] and texts["k70"].startswith("How the")
    assert B.furniture_lines(p.limit(0), c).count() == 0 and B.furniture_lines(p, c.limit(0)).count() > 0


def test_residue_in_a_block():
    bad = ["Dear [[first_name]], your {{order.kind}} is waiting", "{% include 'x' %} {{ body", "${content.abstract:-}", "<?= $row['a'] ?>", "Hello %FNAME% %LNAME%", "[object Object]", "[Your Company]", "TITLE GOES HERE", "null - null", "Lorem ipsum dolor sit amet", "XXXX TBD: copy from old brochure XXXX", "Click edit to replace this paragraph with your own words.", "Untitled"]
    good = ["In this template language a value is written as {{ name }} and Ann replaces it when the page is built, says the guide.", "The lantern costs 5 % more than 100 % of $20.", "It is [sic] a mill.", "Home", "Recipe for 4 people", "An article on the undefined and the null"]
    assert all(R.residue_in(x) for x in bad), [x for x in bad if not R.residue_in(x)]
    assert not any(R.residue_in(x) for x in good), [x for x in good if R.residue_in(x)]
    assert R.residue_in("| Some Site", True) and not R.residue_in("How the mill was found", True)


def test_residue_pages(spark):
    rng = random.Random(4)
    rows = []
    for i in range(12):
        head, page = article(rng, f"s{i}")
        rows.append((f"ok{i}", f"http://s{i}.org/", f"{head} | s{i}", page.replace("<body>", "<body><noscript>Please enable JavaScript.</noscript>"), "", ""))
        rows.append((f"odd{i}", f"http://s{i}.org/e", None, f'<body><div class="menu"><a href=x>Home</a></div><h1>Zut</h1><p>Kaputt wie nie zuvor, Nummer {i * 7919}</p></body>', "", ""))
    head, page = article(rng, "s0", extra="<p>safe }}</p>")
    rows += [("slot", "http://s0.org/1", head, page, "", ""), ("404", "http://s1.org/2", "404 – Page not found", "<h1>404 – Page not found</h1><p>The page you asked for does not exist.</p>", "", "")]
    head, page = article(rng, "s2", extra='<p>When a server returns "404 – Page not found", the team of the bridge first checks the redirects, then the names and finally the clocks of all the hosts it runs.</p>')
    rows += [("about", "http://s2.org/3", head, page, "", ""), ("title", "http://s3.org/4", "{{title}} | s3", article(rng, "s3")[1], "", ""), ("null", None, None, None, None, None), (None, "u", "Untitled", "x", "", ""), ("slot", "http://s0.org/1", head, page, "", "")]
    df = spark.createDataFrame(rows, CRAWL)
    got = {r["row_key"] for r in R.residue_pages(df).collect()}
    assert got == {"slot", "404", "title", *(f"odd{i}" for i in range(12))}
    assert {r["row_key"] for r in R.without_residue(df).collect()} == {"about", "null", None, *(f"ok{i}" for i in range(12))}
    assert R.residue_pages(df.limit(0)).count() == 0


def varied_article(rng, site, extra=""):
    """An article whose sentences hardly occur twice."""
    word = lambda: "".join(rng.choices("abcdefghilmnoprstuv", k=rng.randint(3, 8)))
    head = " ".join(word() for _ in range(5))
    body = "".join(f"<p>{' '.join(' '.join(word() for _ in range(9)) + '.' for _ in range(3))}</p>" for _ in range(4))
    return head, f'<body><div class="menu"><ul><li><a href="/a">Home</a></li></ul></div><div class="article"><h1>{head}</h1>{body}{extra}</div><div class="footer"><p>All rights reserved by {site}</p></div></body>'


def test_slots_without_lists(spark):
    rng = random.Random(14)
    ordinary = lambda i: varied_article(rng, f"s{i % 6}")
    rows = []
    for i in range(90):
        head, page = ordinary(i)
        rows.append((f"ok{i}", f"http://s{i % 6}.org/{i}", f"{head} | s{i % 6}", page, "", ""))
    for i in range(5):
        head, page = varied_article(rng, f"s{i}", "<p>Inserisci qui il testo della pagina</p>")  # a default in no list
        rows.append((f"default{i}", f"http://s{i}.org/d", f"{head} | s{i}", page, "", ""))
        head, page = ordinary(i)
        rows.append((f"title{i}", f"http://s{i}.org/t", f"Titolo provvisorio | s{i}", page, "", ""))
        menu = '<div class="menu"><ul><li><a href="/a">Home</a></li></ul></div>'
        rows.append((f"error{i}", f"http://s{i}.org/e", "Halaman tidak ditemukan", f'<body>{menu}<div class="article"><h1>Halaman tidak ditemukan</h1><p>Alamat nomor {i * 31} tidak ada lagi, <a href="/">kembali</a> ke halaman depan situs ini.</p></div></body>', "", ""))
    head, page = ordinary(0)
    for i in range(5):  # one article copied to other sites
        rows.append((f"copy{i}", f"http://s{i}.org/c", f"{head} | s{i}", page.replace("by s0", f"by s{i}").replace(".</p>", f" {'abcde'[i]}.</p>", 2), "", ""))
    rows.append(("blank", "http://s1.org/b", " | s1", ordinary(1)[1], "", ""))
    got = {}
    for r in R.residue_pages(spark.createDataFrame(rows, CRAWL), lists=False).collect():
        got.setdefault(r["row_key"], set()).add(r["reason"])
    assert set(got) == {f"{k}{i}" for k in ("default", "title", "error") for i in range(5)} | {"blank"}
    assert got["default0"] == {"shared default"} == got["title0"] and got["error0"] == {"template"} and got["blank"] == {"blank"}


def test_one_site_error_template(spark):
    rng = random.Random(15)
    rows = [(f"ok{i}", f"http://one.org/{i}", *varied_article(rng, "one"), "", "") for i in range(40)]
    rows += [(f"e{i}", f"http://one.org/e{i}", "Sidan kunde inte hittas", '<body><div class="article"><h1>Sidan kunde inte hittas</h1></div></body>', "", "") for i in range(6)]
    assert {r["row_key"] for r in R.residue_pages(spark.createDataFrame(rows, CRAWL), lists=False).collect()} == {f"e{i}" for i in range(6)}


def test_stuffed_pages(spark):
    rng = random.Random(5)
    brands = ["".join(rng.choices("abcdefghiklmnoprstu", k=7)) for _ in range(400)]
    rows = []
    for i in range(60):
        head, page = article(rng, f"s{i % 5}")
        rows.append((f"ok{i}", f"http://s{i}.org/", head, page, "", ""))
    for i in range(6):
        items = "".join(f"<li>{rng.choice(['cheap', 'best', 'buy now'])} {rng.choice(['boots', 'loans', 'slot games'])} {rng.choice(brands)}</li>" for _ in range(50))
        rows.append((f"list{i}", "u", "t", f"<h1>Best boots</h1><p>{sentence(rng)}</p><ul>{items}</ul>", "", ""))
        words = ", ".join(f"{rng.choice(['cheap', 'best'])} {rng.choice(brands)} boots" for _ in range(60))
        rows.append((f"tags{i}", "u", "t", f"<p>{words}</p>", "", ""))
    rows += [("null", None, None, None, None, None), ("empty", "u", "t", "", "", ""), ("list0", *rows[60][1:]), ("tiny", "u", "t", "<p>cheap boots</p>", "", "")]
    df = spark.createDataFrame(rows, CRAWL)
    got = {r["row_key"] for r in F.stuffed_pages(df).collect()}
    assert got == {f"{k}{i}" for k in ("list", "tags") for i in range(6)}
    assert F.stuffed_pages(df.limit(0)).count() == 0


def test_mean_pmi_of_all_pairs(spark):
    rng = random.Random(8)
    rows = [(f"ok{i}", "u", *article(rng, f"s{i % 5}"), "", "") for i in range(60)]
    prose = sorted({w for *_, page, _, _ in rows for b in blocks_of(page) for w in b.text.split() if w.isalpha()})
    salad = f"<p>{' '.join(rng.choice(prose) for _ in range(300))}</p>"
    short = "".join(f"<li>{rng.choice('abcdefg')}{i}x cheap{'abcdefgh'[i % 8] * (i % 5 + 1)} boots{'qrst'[i % 4] * (i % 7 + 1)}</li>" for i in range(9))
    rows += [("salad", "u", "t", salad, "", ""), ("again", "u2", "t", salad, "", ""), ("short", "u", "t", f"<ul>{short}</ul>", "", "")]
    got = {r["row_key"]: r for r in F.page_coherence(spark.createDataFrame(rows, CRAWL)).collect()}
    usual = sorted(r["mean_pmi"] for k, r in got.items() if k[:2] == "ok")
    assert {"salad", "again", "short"} <= set(got) and usual
    assert got["salad"]["mean_pmi"] == got["again"]["mean_pmi"] < usual[0] / 2
    assert got["salad"]["unsupported"] == got["again"]["unsupported"] > 0.5
    assert {r["row_key"] for r in F.stuffed_pages(spark.createDataFrame(rows, CRAWL)).collect()} == {"salad", "again", "short"}


def test_garbled_pages_are_counted_mended(spark):
    rng = random.Random(9)
    letters = "абвгдежзиклмнопрстуфхцчшы"
    words = ["".join(rng.choices(letters, k=6)) for _ in range(300)]
    rows = [(f"ok{i}", "u", *article(rng, f"s{i % 5}"), "", "") for i in range(40)]
    tags = ", ".join(rng.sample(words, 200))
    common = "".join(f"<li>{a} {b}</li>" for a, b in zip(words[::2], words[1::2]))
    garbled = lambda page: page.encode().decode("latin-1")
    rows += [("garbled", "u", "t", garbled(f"<p>{tags}</p>"), "", ""), ("pairs", "u", "t", garbled(f"<ul>{common}</ul>"), "", ""), ("clean", "u", "t", f"<ul>{common}</ul><p>{words[0]}</p>", "", "")]
    df = spark.createDataFrame(rows, CRAWL)
    got = {r["row_key"]: r for r in F.page_coherence(df).collect()}
    assert got["garbled"]["unsupported"] > 0.9 and got["pairs"]["unsupported"] == 0 == got["clean"]["unsupported"]
    assert "garbled" in {r["row_key"] for r in F.stuffed_pages(df).collect()}


def test_texts_without_a_page(spark):
    rng = random.Random(11)
    rows = [(f"ok{i}", "u", *article(rng, f"s{i % 5}"), "", "") for i in range(60)]
    texts = ["\n".join(f"{rng.choice(['cheap', 'best'])} {''.join(rng.choices('abcdefghik', k=6))} boots" for _ in range(40)) for _ in range(3)]
    rows += [("gone", "u", None, None, "", ""), ("gone", "u", None, None, "", "")]
    processed = spark.createDataFrame([("gone", texts[0], "x", 0), ("gone", texts[0], "x", 0), ("alone", texts[1], "x", 0), ("ok1", texts[2], "x", 0), ("nul", None, None, None), (None, texts[2], "", 0)], PROCESSED)
    df = spark.createDataFrame(rows, CRAWL)
    assert {r["row_key"] for r in F.stuffed_pages(df, processed).collect()} == {"gone", "alone"}
    assert F.stuffed_pages(df).count() == 0 and F.stuffed_pages(df.limit(0), processed.limit(0)).count() == 0


def test_shared_keywords_are_no_support(spark):
    """Stuffed pages that share all their pairs with each other are found by their mean PMI, though hardly a pair is their own."""
    rng = random.Random(12)
    rows = [(f"ok{i}", "u", *article(rng, f"s{i % 5}"), "", "") for i in range(80)]
    keys = ["".join(rng.choices("abcdefghik", k=6)) for _ in range(25)]
    for i in range(12):
        rows.append((f"bad{i}", "u", "t", "<ul>" + "".join(f"<li>{rng.choice(keys)} {rng.choice(keys)} {rng.choice(keys)}</li>" for _ in range(90)) + "</ul>", "", ""))
    df = spark.createDataFrame(rows, CRAWL)
    got = {r["row_key"]: r for r in F.stuffed_pages(df).collect()}
    assert set(got) == {f"bad{i}" for i in range(12)} and all(r["unsupported"] < 0.2 for r in got.values())


def salad_of_sentences(rng, words, n=30):
    """Words in any order, in paragraphs that end like sentences: all of the page counts as prose and hardly a pair is repeated."""
    return "".join(f"<p>{' '.join(rng.choice(words) for _ in range(14))} {rng.choice(NOUNS)}.</p>" for _ in range(n))


def test_salad_with_full_stops(spark):
    """Pages of nothing but prose that repeat nothing are scored too."""
    rng = random.Random(21)
    rows = [(f"ok{i}", "u", *article(rng, f"s{i % 5}"), "", "") for i in range(80)]
    rows += [(f"prose{i}", "u", "t", "".join(f"<p>{sentence(rng)}</p>" for _ in range(6)), "", "") for i in range(20)]
    words = ["".join(rng.choices("abcdefghiklmnoprstu", k=7)) for _ in range(60)]
    rows += [(f"bad{i}", "u", "t", salad_of_sentences(rng, words), "", "") for i in range(4)]
    rows += [("again", "u2", "t", rows[-1][3], "", ""), rows[-1]]
    df = spark.createDataFrame(rows, CRAWL)
    got = {r["row_key"]: r for r in F.page_coherence(df).collect()}
    assert set(got) == {r[0] for r in rows} and all(got[f"bad{i}"]["prose"] == 1 and got[f"bad{i}"]["repeated"] < 0.3 for i in range(4))
    assert {r["row_key"] for r in F.stuffed_pages(df).collect()} == {f"bad{i}" for i in range(4)} | {"again"}


def test_scores_against_plain_counts(spark, monkeypatch):
    """Every page's figures equal those of plain Python, however the texts under several keys are joined."""
    import math
    from collections import Counter

    rng = random.Random(22)
    texts = {f"k{i}": " ".join(rng.choice(NOUNS) for _ in range(rng.choice([1, 2, 40, 90]))) for i in range(30)}
    texts |= {"c1": texts["k3"], "c2": texts["k3"], "c3": texts["k4"]}
    df = spark.createDataFrame([(k, "u", "t", f"<p>{t}</p>", "", "") for k, t in texts.items()], CRAWL)
    pairs_of = {k: Counter(zip(t.split(), t.split()[1:])) for k, t in texts.items()}
    words, pairs = Counter(w for t in texts.values() for w in t.split()), sum(pairs_of.values(), Counter())
    size, wanted = sum(pairs.values()), {}
    for k, own in pairs_of.items():
        copies, of, total = sum(t == texts[k] for t in texts.values()), Counter(texts[k].split()), sum(own.values())
        if total:
            others = {p: pairs[p] - n * copies for p, n in own.items()}
            expected = {p: (words[p[0]] - of[p[0]] * copies) * (words[p[1]] - of[p[1]] * copies) / size for p in own}
            bits = sum(n * math.log2((others[p] + 0.5) / (expected[p] + 0.5)) for p, n in own.items())
            repeated = sum(n for p, n in own.items() if n >= 3 and math.log2(pairs[p] * size / words[p[0]] / words[p[1]]) >= 2)
            wanted[k] = (total, round(sum(n for p, n in own.items() if others[p] <= 0) / total, 6), round(repeated / total, 6), round(bits / total, 6))
    for bound in (F.BROADCAST_KEYS, 0):
        monkeypatch.setattr(F, "BROADCAST_KEYS", bound)
        got = {r["row_key"]: (r["pairs"], *(round(r[c], 6) for c in ("unsupported", "repeated", "mean_pmi"))) for r in F.page_coherence(df).collect()}
        assert got == wanted
