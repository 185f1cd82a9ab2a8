import pytest

from millrace.llm import sentences as S

CASES = {
    "titles": ["Dr. Miller met Mrs. Jones at 5 p.m. on Monday.", "They left."],
    "initials": ["Prof. A. R. Bell wrote it.", "See No. 7, e.g. the map."],
    "decimals": ["It is 3.14 m at docs.site.example now.", "Version v4.0.2 works!"],
    "quotes": ["“The cellar is old,” said Ann, “and it leaks.”", "Bob left."],
    "question inside": ['"Did you bring it?" asked Ann from Rome.', "No."],
    "brackets": ["(The valve was closed.)", "It held."],
    "ellipsis": ["It was simple ... and yet it failed.", "Why?"],
    "german": ["Am 28. Oktober kam Dr. Weiß mit ca. 47 Kisten.", "Nr. 5 (vgl. S. 3) fehlt."],
    "french": ["« La gare est fermée », a dit M. Martin.", "Voir l’art. 24 (p. 9) !"],
    "spanish": ["¿Quién dejó la puerta abierta?", "El Sr. López midió 4,5 m."],
    "russian": ["Г. Петров стоит на ул. Ленина, т. е. рядом.", "«Да», — сказал он."],
    "japanese": ["彼は「もうない。誰かが売った。」と言った。", "（倉庫は空だ。）", "終わり！"],
    "chinese": ["他说：“不在了。有人卖掉了。”", "我们走吧。"],
    "korean": ["등대가 있다.", "1915년에 75장을 썼다."],
    "hindi": ["डॉ. शर्मा ने नापा।", "क्या वह गया?", "हाँ।"],
    "arabic": ["هل باع الطاحونة؟", "في عام 1917 كتب."],
    "greek": ["Ήταν κλειστή;", "Ο δρ. Νίκος ήρθε."],
    "lower case": ["WE CLOSED IT ALL.", "after that the quarry passed to a firm in the next town, e.g. the mill.", "neither of them knew why it had been done in the dark.", "Then Ann came."],
    "thai": ["ช่างวัดสะพานเก่าในฤดูหนาว", "เก็บสมุดไว้ 66 เล่ม"],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    parts = CASES[name]
    text = " ".join(parts) if name not in ("japanese", "chinese") else "".join(parts)
    known = {w: False for w in "p.m e.g dr mr mrs prof no nr ca vgl s m p art sr г ул т е δρ".split()}
    out, last = [], 0
    for e in S.Splitter(known).ends(text):
        out.append(text[last:e].strip())
        last = e
    assert out == parts


def test_lines():
    ends = S.Splitter({}).ends
    headline = "A guide to the mill\nIt took years to build.\nThe end was near."
    assert [headline[:e].count("\n") for e in ends(headline)] == [0, 1, 2]
    wrapped = "The records from the old mill were moved to the large\nLondon office and nobody asked why that was done in the\nwinter. It was late."
    assert len(ends(wrapped)) == 2
    assert ends("") == [] and ends(" \n ") == [] and ends("No end") == [6] and ends("  Hi. ") == [5]


def test_table(spark):
    rows = [(1, "One. Two.", 0), (1, "One. Two.", 0), (2, None, 0), (3, "", 0), (None, "x.", 0), (4, "Long sentence. " * 20_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, end_pos int")
    got = [(r["doc_id"], r["end_pos"]) for r in S.sentence_ends(df).where("doc_id < 4").orderBy("doc_id", "end_pos").collect()]
    assert got == [(1, 4), (1, 9)]
    assert S.sentence_ends(df).where("doc_id = 4").count() == 20_000
    parts = [(r["sentence_no"], r["sentence"]) for r in S.sentences(df).where("doc_id = 1").orderBy("sentence_no").collect()]
    assert parts == [(1, "One."), (2, "Two.")]
    assert S.sentences(df).count() == S.sentence_ends(df).count()
    assert S.sentence_ends(df.limit(0)).count() == 0 and S.sentences(df.limit(0)).count() == 0


def test_document_decides_over_corpus():
    units = lambda known, text: len(S.Splitter(known).ends(text))
    for known in ({}, {"abc": True}, {"abc": False}):
        assert units(known, "See abc. Two. And abc. two more") == 2
    for known in ({}, {"col": False}):
        assert units(known, "We went up the col. Then it rained.\n\nThis is the col.") == 3
    assert units({}, "the xyz. of it and then xyz. Peter came") == 1


def test_proper_names():
    units = lambda known, text: len(S.Splitter(known).ends(text))
    body = "It was by etc. and lamps.\n\nIt ends in etc.\n\n"
    assert units({}, body + "We met Bell etc. Bell left.") == 3  # Bell is a name inside a sentence
    assert units({}, body + "We saw that these were etc. These left.") == 4  # in lower case elsewhere
    assert units({"art": False}, "The old art is dear and so is the mill. They love art. The mill is shut.") == 3
    assert units({"art": False}, "Voir art. Bell et la suite.") == 1


def test_wrapped_titles():
    text = "The keeper of the old lighthouse met Mr.\nCole near the large harbour and the council\nof the town wrote to Mr. Bell about the cost of\nthe new lamp."
    assert len(S.Splitter({"mr": False}).ends(text)) == 1


def test_long_documents_take_linear_time():
    import time

    began = time.time()
    assert len(S.Splitter({}).ends("\n".join(f"Line {i} of the book." for i in range(100_000)))) == 100_000
    S.Splitter({}).ends("“" + 'a "b" c\n' * 60_000)
    assert time.time() - began < 8


def test_corpus_counts(spark):
    df = spark.createDataFrame([(i, "Mr. Bell saw it. The end.\nMr. Cole left the town.") for i in range(10)], "doc_id long, text string")
    words = {r["word"] for r in S.abbreviations(df).collect()}
    assert "mr" in words and "town" not in words and "end" not in words


def test_no_windows():
    ends = S.Splitter({}).ends
    greek = "It was said. " * 40 + "Τι είναι αυτό; Δεν ξέρω."
    assert len(ends(greek)) == 42
    long = "“" + "He came home. " * 2_000 + "He left” and so it went on."
    assert len(ends(long)) == 1
    quoted = 'She said "we ' + "walked on and on " * 60 + 'today." Then it rained.'
    assert [quoted[e - 2 : e] for e in ends(quoted)][0] == '."'
    single = "It said 'we don't " + "walk on and on " * 60 + "today.' Then it rained."
    assert [single[e - 2 : e] for e in ends(single)][0] == ".'"


def test_abbreviations_beyond_the_bound(spark):
    rows = [(i, "Mr. Bell of Abt. Nine saw it. The end.\nMr. Cole left Abt. Two and the town.") for i in range(15)] + [(99, "No dots here"), (98, "D’Mr. Bell went. Then home.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole, joined = (sorted(map(tuple, S.sentence_ends(df, max_table=n).collect())) for n in (200_000, 1))
    assert whole == joined and len(whole) < 15 * 5 + 5
