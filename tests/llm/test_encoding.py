import pytest

from millrace.llm import encoding as E

TEXTS = ["La règle fut cédée à l’été – « bientôt » …", "Die Mühle in Köln wurde größer", "A canção não é só saudade, João", "Мельница стоит на реке, а рядом пекарня", "誰もトスラの図書館を調べたとは思わなかった。", "Źródło i ścieżka są żółte"]


@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "mac_roman", "cp850", "cp1251", "koi8_r"])
@pytest.mark.parametrize("text", TEXTS)
def test_utf8_read_in_a_legacy_charset(text, wrong):
    raw = text.encode()
    try:
        garbled = raw.decode(wrong)
    except UnicodeDecodeError:
        garbled = "".join(bytes([b]).decode(wrong, "replace") if wrong != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)
    got = E.repair(garbled)
    assert got is not None
    if "�" not in garbled and wrong in ("cp1252", "latin_1", "mac_roman"):
        assert got[1] == text and got[2]


@pytest.mark.parametrize("text", TEXTS[:3])
def test_twice(text):
    assert E.repair(text.encode().decode("latin_1").encode().decode("latin_1"))[1] == text


@pytest.mark.parametrize("wrong,right", [("latin_1", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251")])
def test_single_byte_cyrillic(wrong, right):
    text = TEXTS[3]
    assert E.repair(text.encode(right).decode(wrong))[1] == text


@pytest.mark.parametrize("charset", ["cp932", "euc_jp"])
def test_east_asian_bytes_read_one_by_one(charset):
    raw = TEXTS[4].encode(charset)
    got = E.repair("".join(E.byte_chars("web")[b] for b in raw))
    assert got is not None and "図書館" in got[1]


def test_one_span_in_a_sound_text():
    got = E.repair("The guide to MÃ¼hlheim lists 12 cafés and a piñata — “nice”.")
    assert got[1] == "The guide to Mühlheim lists 12 cafés and a piñata — “nice”."


def test_character_references():
    assert E.repair("<p>cr&#195;&#170;pe</p>")[1] == "<p>crêpe</p>"
    assert E.repair("<p>cr&Atilde;&ordf;pe &amp; caf&Atilde;&copy;</p>")[1] == "<p>crêpe &amp; café</p>"
    assert E.repair("<p>caf&eacute; &copy; &nbsp; a&lt;b &mdash; &laquo;x&raquo;</p>") is None
    assert E.repair("<p>cr&#234;pe &eacute; &amp; &#8217;</p>") is None


def test_replacement_characters_are_reported_but_lost():
    how, text, complete = E.repair("CH�TEAU")
    assert text == "CH�TEAU" and not complete


SOUND = ["", None, "plain", "« La gare est fermée », a répété l’élève ; où ? à Orléans…", "ÀÉÎ OÙ LA POTERIE", "¿Qué? ¡Niño! nº 5, 3.ª edición", "Größe: 5 m² × 3 µm ± 2 % — №7", "Гёте и ёж; РИМ", "日本語の「本」と中文和한국어 ไทย हिन्दी عربي", "Ελληνικά: ο άνθρωπος", "Łódź, żółć", "naïve coöperation, Ångström’s Brontë™ ®", "été à É»", "São Tomé e Príncipe; ÇÃO"]


@pytest.mark.parametrize("text", SOUND)
def test_sound_text(text):
    assert E.repair(text) is None


def test_table(spark):
    rows = [("k1", "MÃ¼hle", None, "x", 1), ("k1", "MÃ¼hle", None, "x", 1), ("k2", None, None, None, 2), (None, "Ã©t", "a", "b", 3), ("k3", "ok", "x" * 200_000 + "Ã©t", "", 4)]
    df = spark.createDataFrame(rows, "row_key string, title string, page string, description string, field int")
    got = E.garbled_fields(df).collect()
    assert sorted({(r["row_key"], r["field"]) for r in got}) == [("k1", "title"), ("k3", "page")]
    back = E.restored_crawl(df).collect()
    assert {r["title"] for r in back} == {"Mühle", None, "ét", "ok"} and back[0].__fields__ == df.columns
    assert E.garbled_fields(df.limit(0)).count() == 0


def test_passages_far_down_a_page():
    from millrace.llm.encoding import repair

    garbled = "机器学习模型在数据上进行训练".encode().decode("gb18030", "ignore")
    got = repair("An ordinary sentence in plain words. " * 700 + garbled)
    assert got is not None


def test_small_cyrillic_read_as_capitals():
    text = "старая мельница у реки была закрыта, и никто не знал почему; потом купил сосед"
    for right, wrong in (("cp1251", "koi8_r"), ("koi8_r", "cp1251")):
        garbled = text.encode(right).decode(wrong)
        whole = E.repair(garbled)
        assert whole and whole[1] == text
        part = E.repair(f"<p>Обычный текст о мельнице и реке.</p><p>{garbled}</p>")
        assert part and "старая мельница у реки" in part[1] and "Обычный текст" in part[1]
    assert E.repair(text.upper()) is None and E.repair("ВАЖНОЕ ОБЪЯВЛЕНИЕ О ЗАКРЫТИИ МЕЛЬНИЦЫ У СТАРОЙ РЕКИ") is None


def test_capitals_of_mac_roman():
    assert E.repair("La citadelle Žtroite de Brie")[1] == "La citadelle étroite de Brie"
    assert E.repair("Škoda, Štrba, Žďár a Židlochovice") is None
