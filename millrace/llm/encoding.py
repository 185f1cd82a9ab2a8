"""Text garbled by a wrong character decoding: found, and restored where the bytes allow it.

Characters are mapped back to the bytes of the legacy charset they were wrongly read in. An automaton over those bytes (compiled to a
pattern over the charset's characters) finds the maximal well-formed spans of a multibyte encoding, and only those spans are decoded again, as often
as needed. A span counts if what it decodes to is common in writing and what it was is not. Confusions between two single-byte
charsets have no byte structure; there, words that no orthography spells that way (signs or capitals inside a word, mixed scripts, letters that are all
accented) are read back through every pair of charsets, and a pair counts if it leaves no such word; runs of Cyrillic capitals count if their letters get commoner. Text with replacement characters is
reported as garbled; what they replaced is gone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import DataFrame

from millrace.functions.memo import memo
from millrace.llm.common import map_texts

FIELDS = ("page", "title", "description")

#: Charsets in which UTF-8 or other bytes are wrongly read. ``web`` is cp1252 whose unused bytes stand for themselves.
WRONG = ("web", "mac_roman", "cp850", "cp437", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_2", "cp1253", "iso8859_7", "cp1254", "mac_cyrillic", "iso8859_5")
#: Single-byte charsets that text may really be in.
RIGHT = ("web", "cp1251", "koi8_r", "mac_roman", "cp850", "cp1250", "iso8859_2", "cp866", "cp1253")

# Accented letters and signs that are common in European writing.
_COMMON = "éèàùçêüöäßñóáíãõúâîôûåøæłąęśżźćńœëïčšžřěýůőűğışășțāēīūÉÈÀÇÖÜÄÑÓÁÍÃÕÚÂÎÔÛÅØÆŁĄĘŚŻŹĆŃŒČŠŽŘÊËÏ"
_RUSSIAN_ORDER = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_SIGNS = "–—‘’“”„‚•…‹›«»€™©®°·§£¡¿½¼¾ºª±×÷²³µ¶¢¥†‡→↓←↑№´¨¸¦¬ "
_GOOD = frozenset(_COMMON + _SIGNS)


@memo()
def byte_chars(charset: str) -> tuple[str, ...]:
    """The character of each byte; bytes that stand for nothing are C1 controls or a private mark."""
    out = []
    for b in range(256):
        if charset == "web":
            try:
                c = bytes([b]).decode("cp1252")
            except UnicodeDecodeError:
                c = chr(b)
        else:
            try:
                c = bytes([b]).decode(charset)
            except UnicodeDecodeError:
                c = chr(0xE000 + b)
        out.append(c)
    return tuple(out)


@memo()
def char_bytes(charset: str) -> dict[str, int]:
    table = {c: b for b, c in enumerate(byte_chars(charset))}
    if charset == "web":
        table.update({chr(b): b for b in range(0x80, 0xA0)})  # read as latin-1
    return table


def _class(charset: str, low: int, high: int) -> str:
    chars = {c for c, b in char_bytes(charset).items() if low <= b <= high}
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


@memo()
def utf8_spans(charset: str) -> re.Pattern:
    """The automaton for well-formed UTF-8 of two to four bytes, over the characters of a charset."""
    c = lambda a, b: _class(charset, a, b)
    tail = c(0x80, 0xBF)
    unit = "|".join(
        (
            c(0xC2, 0xDF) + tail,
            c(0xE0, 0xE0) + c(0xA0, 0xBF) + tail,
            c(0xE1, 0xEC) + tail * 2,
            c(0xED, 0xED) + c(0x80, 0x9F) + tail,
            c(0xEE, 0xEF) + tail * 2,
            c(0xF0, 0xF0) + c(0x90, 0xBF) + tail * 2,
            c(0xF1, 0xF3) + tail * 3,
        )
    )
    return re.compile(f"(?:{unit})+")


def to_bytes(text: str, charset: str) -> bytes | None:
    table = char_bytes(charset)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def script_of(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "latin"
    if o < 0x400:
        return "greek" if o >= 0x370 else "sign" if o in (0x2C6, 0x2DC, 0x2D9, 0x2C7) else "other"
    if o < 0x530:
        return "cyrillic"
    if 0x590 <= o < 0x600:
        return "hebrew"
    if 0x600 <= o < 0x700:
        return "arabic"
    if 0x900 <= o < 0xE80:
        return "indic"
    if 0x2010 <= o < 0x2640 or o in (0xFEFF, 0xFFFD):
        return "sign"
    if 0x3000 <= o < 0xA000 or 0xFF00 <= o < 0xFFF0:
        return "cjk"
    if 0xAC00 <= o < 0xD7A4:
        return "hangul"
    return "emoji" if 0x1F300 <= o < 0x1FB00 else "other"


_CYRILLIC = ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5")
_RUSSIAN = frozenset("абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ")


def _credible(span: str, decoded: str, charset: str) -> bool:
    """Whether what a span decodes to is likelier than what it is."""
    kinds = [script_of(c) for c in decoded]
    if "other" in kinds:
        return False
    if charset in _CYRILLIC and not any(c not in _RUSSIAN for c in span):
        return False
    if all(k == "latin" for k in kinds):
        return all(c in _GOOD or c.isalpha() and 0xC0 <= ord(c) < 0x180 or 0x80 <= ord(c) < 0x100 for c in decoded)
    if all(k in ("sign", "latin", "emoji") for k in kinds):
        return all(k != "sign" or c in _GOOD or c == "﻿" or c == "�" or len(decoded) > 1 or 0x2010 <= ord(c) < 0x2200 for c, k in zip(decoded, kinds))
    foreign = sum(k not in ("sign", "latin") for k in kinds)
    return foreign >= 2 or any("\x80" <= c <= "\x9f" or "─" <= c <= "▟" for c in span)


_RUNS = re.compile(r"[^\x00-\x7f]{2,}")


@memo()
def _sjis_spans() -> re.Pattern:
    """The automaton for Shift JIS, over the characters of ``web``."""
    c = lambda a, b: _class("web", a, b)
    return re.compile(f"(?:(?:{c(0x81, 0x9F)}|{c(0xE0, 0xEA)})(?:{c(0x40, 0x7E)}|{c(0x80, 0xFC)}))+")


_BEYOND = re.compile("[^\x00-\x7f]+")
_REFERENCE = re.compile(r"&#(?:([0-9]{2,7})|[xX]([0-9a-fA-F]{2,6}));")


_SPACE = re.compile(r"(?<=[^\x00-\x7f])&nbsp;")


def _reference(m: re.Match) -> str:
    o = int(m.group(1)) if m.group(1) else int(m.group(2), 16)
    return chr(o) if 0x80 <= o < 0x110000 and not 0xD800 <= o < 0xE000 else m.group()


_NAMED = re.compile("&([A-Za-z]{2,8}[0-9]{0,2});")


def _named(m: re.Match) -> str:
    o = name2codepoint.get(m.group(1), 0)
    return chr(o) if o > 0xA0 else m.group()


def dereference(text: str) -> str:
    """References beyond ASCII as the characters they name, C1 controls included; others stay, among them those of markup and of the space."""
    if "&#" in text:
        text = _REFERENCE.sub(_reference, text)
    if "&" in text:
        text = _NAMED.sub(_named, text)
    return _SPACE.sub("\xa0", text) if "&nbsp;" in text else text


# Words that no orthography spells that way.
_LOW = "a-zß-öø-ÿąćęłńśźżœšž"
_ODD = re.compile(
    f"[{_LOW}][¢£¤¥¦§¨©ª¬®¯±²³´µ¶¸¹º¼½¾¿×÷†‡ˆ‰‹›€˙˜∂∑∏π∫Ω√≈∆◊‚„¡•¬][{_LOW}]"
    "|[a-zß-öø-ÿ][À-ÖØ-ÞŠŽŒŸ]"
    "|[A-Za-zÀ-ÿ][Ͱ-Ͽ]+[A-Za-zÀ-ÿ]|(?<![A-Za-z0-9])[Ͱ-Ͽ][a-z]{2}"
    "|[A-Za-z]{2}[Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]{2}"
    "|(?<![A-Za-z])[À-ÿ]{3,}(?![A-Za-z])"
    "|[\x80-\x9f]"
    "|(?<![Ѐ-ӿ])[а-яё][А-ЯЁ]{2}"
    "|[A-Za-zÀ-ÿЀ-ӿ][─-▟]|[─-▟][A-Za-zÀ-ÿЀ-ӿ]"
    "|[bcdfghjklmnpqrstvwxz]ß|[a-z]þ[À-ÿ]"
    "|(?<![A-Za-z])[à-ÿ][A-Z][a-z]|(?<![A-Za-z])[A-Z][À-ÖØ-ÞŠŽŒŸ][a-z]{2}|(?<![A-Za-zÀ-ž])Ž[cfkpst]|Ÿ[a-z]"
    "|(?<![─-▟])[─-▟](?![─-▟])|(?<=[a-z0-9.] )[ÐªòûùÙìîñôÑÕÆ](?= [A-Za-z])"
)
_WORD = re.compile(r"[^\s<>\"=/|()\[\]{},;:!?.&#]*[^\x00-\x7f][^\s<>\"=/|()\[\]{},;:!?.&#]*")
_SOLID = re.compile("[À-ÿ]+")
_PAIRS = [(w, r) for r in RIGHT for w in WRONG if w != r]


def _through(text: str, wrong: str, right: str) -> str | None:
    table, chars = char_bytes(wrong), byte_chars(right)
    out = []
    for c in text:
        if c < "\x80":
            out.append(c)
            continue
        b = table.get(c)
        if b is None:
            return None
        out.append(chars[b])
    return "".join(out)


def _weight(words: list[str]) -> float:
    """How common the letters beyond ASCII are, per word; minus one where a sign or letter is not."""
    total = 0.0
    for w in words:
        for c in w:
            if c < "\x80":
                continue
            k = _COMMON.find(c)
            if k >= 0:
                total += 1 - k / 160
            elif c in _RUSSIAN_ORDER:
                total += 1 - _RUSSIAN_ORDER.index(c) / 60
            elif "А" <= c <= "Я":
                total += 0.5
            elif c in "ё–—‘’“”…«»":
                total += 0.9
            elif c in "•·¦€£±™©®°":
                total += 0.6
            elif "ά" <= c <= "ώ":
                total += 0.5
            else:
                total -= 1
    return total


def _single_byte(text: str) -> tuple[str, str] | None:
    """The pair of charsets that makes every odd word of a text ordinary, and the text read through it."""
    odd = list(dict.fromkeys(w.group() for w in _WORD.finditer(text) if _ODD.search(text[max(0, w.start() - 2) : w.end() + 2])))
    if not odd:
        return None
    sample, strange = odd, set(odd)
    others = list(dict.fromkeys(w for w in _WORD.findall(text) if w not in strange))
    before = [_weight([w]) for w in others]
    had = _weight(sample)
    best, score = None, 0.0
    for wrong, right in _PAIRS:
        fixed = [_through(w, wrong, right) for w in sample]
        good = [f for f in fixed if f is not None and not _ODD.search(f if len(f) > 1 else f"x {f} a")]
        if len(good) < 0.8 * len(sample) or not good:
            continue
        if any(0xE000 <= ord(c) < 0xE100 or "\x80" <= c <= "\x9f" for f in good for c in f):
            continue
        value = _weight(good)
        letters = sum(c > "\x7f" for f in good for c in f)
        if value < 0.55 * letters or value <= had:
            continue
        value -= 0.5 * (wrong in ("cp437", "cp866"))
        value += 0.3 * sum((f := _through(w, wrong, right)) is not None and _weight([f]) > x for w, x in zip(others, before))
        if value > score:
            best, score = (wrong, right), value
    if not best:
        return None
    wrong, right = best
    fixed = "".join(f for w in sample if (f := _through(w, wrong, right)) is not None)
    letters = {script_of(c) for c in fixed if c > "\x7f" and c.isalpha()}
    solid = sum(c > "\x7f" for c in "".join(sample))
    if solid < 6 and all(len(w) > 2 and _SOLID.fullmatch(w) for w in sample):
        return None

    def goes_along(w: str, f: str | None) -> bool:
        return f is not None and letters == {"cyrillic"} and not any(c.isascii() and c.isalpha() for c in w) and all(script_of(c) == "cyrillic" for c in f if c > "\x7f" and c.isalpha())

    whole = [_through(w, wrong, right) for w in others]
    better = sum(f is not None and (_weight([f]) >= _weight([w]) or goes_along(w, f)) for f, w in zip(whole, others))
    if better >= 0.5 * len(others):
        out = _WORD.sub(lambda m: (f if (f := _through(m.group(), wrong, right)) is not None and not (_ODD.search(f) and not _ODD.search(m.group())) else m.group()), text)
    else:
        changed = {w: f for w in (*odd, *(w for w, f in zip(others, whole) if goes_along(w, f))) if (f := _through(w, wrong, right)) is not None}
        out = _WORD.sub(lambda m: changed.get(m.group(), m.group()), text)
    return f"{wrong}<-{right}", out


#: Words set in Cyrillic capitals, at least so many letters in a row of words.
_CAPITALS = re.compile(r"[А-ЯЁ]{2,}(?:[ \t\r\n,.;:!?()«»\"–—-]+[А-ЯЁ]+)+")
LEAST_CAPITALS, FREQUENCY_GAIN = 15, 0.08
_CASED = tuple((w, r) for w in ("koi8_r", "cp1251") for r in ("cp1251", "koi8_r") if w != r)


def _frequency(text: str) -> float:
    """How common the Cyrillic letters of a text are, on average from 1 for the commonest to 0 for the rarest; capitals count as small letters, unknown letters as -1."""
    letters = [c for c in text.lower() if "Ѐ" <= c <= "ӿ"]
    return sum(1 - _RUSSIAN_ORDER.index(c) / len(_RUSSIAN_ORDER) if c in _RUSSIAN_ORDER else -1 for c in letters) / (len(letters) or 1)


def _capitals(text: str) -> tuple[str, str] | None:
    """Small Cyrillic letters read as capitals of the other common charset: runs of capitals whose letters are commoner when they are read back."""
    how: list[str] = []

    def run(m: re.Match) -> str:
        found = m.group()
        if sum(c.isalpha() for c in found) < LEAST_CAPITALS:
            return found
        best, score = "", _frequency(found) + FREQUENCY_GAIN
        for wrong, right in _CASED:
            got = _through(found, wrong, right)
            if got is not None and sum(c.islower() for c in got) >= 0.9 * sum(c.isalpha() for c in got) and _frequency(got) >= score:
                best, score, name = got, _frequency(got), f"{wrong}<-{right}"
        if best:
            how.append(name)
        return best or found

    after = _CAPITALS.sub(run, text)
    return (how[0], after) if how else None


def _level1(raw: bytes) -> bool:
    """Whether the two-byte characters are mostly of the common rows that these charsets begin with."""
    leads = raw[::2]
    return sum(0xB0 <= b <= 0xD7 or b in (0xA1, 0xA3) for b in leads) >= 0.9 * len(leads) and any(b >= 0xB0 for b in leads)


_HAN = re.compile("[一-鿾]")


def _asian(text: str) -> tuple[str, str] | None:
    """Runs that are well-formed text of an East Asian encoding read byte by byte, or UTF-8 read in one."""
    how: list[str] = []

    def wide(m: re.Match) -> str:
        run = m.group()
        if len(run) < 4:
            return run
        raw = to_bytes(run, "web")
        if raw and len(raw) % 2 == 0 and raw[0] >= 0x81 and not all(c.isalpha() and c < "Ā" for c in run[:8]):
            for enc in ("euc_jp", "gb18030", "euc_kr", "big5"):
                try:
                    got = raw.decode(enc)
                except UnicodeDecodeError:
                    continue
                kinds = [script_of(c) for c in got]
                ok = sum(k in ("cjk", "hangul", "sign") for k in kinds) >= 0.9 * len(kinds)
                if ok and (enc != "euc_jp" or any("぀" <= c <= "ヿ" for c in got)) and (enc == "euc_jp" or _level1(raw)):
                    how.append(enc)
                    return got
        return run

    def sjis(m: re.Match) -> str:
        run = m.group()
        raw = to_bytes(run, "web")
        if raw is None or len(run) < 4:
            return run
        try:
            got = raw.decode("cp932")
        except UnicodeDecodeError:
            try:
                got = raw[:-1].decode("cp932") + run[-1]
            except UnicodeDecodeError:
                return run
        kana = sum("぀" <= c <= "ヿ" for c in got)
        if kana >= 2 and kana * 4 >= len(got) and sum(script_of(c) in ("cjk", "sign") for c in got) >= 0.8 * len(got):
            how.append("cp932")
            return got
        return run

    out = text
    if "‚" in out or "ƒ" in out:
        out = _sjis_spans().sub(sjis, out)
    out = _RUNS.sub(wide, out)

    def back(m: re.Match) -> str:
        run = m.group()
        for enc in ("cp932", "gb18030"):
            if enc == "cp932" and not any(c in run for c in "縺繧繝窶讌蜷譁髱險遘莠蜿驛"):
                continue
            try:
                raw = run.replace("�", "").encode(enc)
                got = raw.decode("utf-8", "replace")
            except UnicodeEncodeError:
                raw = run.encode(enc, "ignore")
                got = raw.decode("utf-8", "replace")
            lost = got.count("�")
            if enc == "gb18030" and (lost or len(got) < 3):
                continue
            if len(got) > lost * 3 and sum(script_of(c) in ("cjk", "cyrillic", "hangul", "latin", "sign") for c in got) - lost >= 0.6 * len(got):
                how.append(f"{enc}<-utf_8")
                return got
        return run

    if _HAN.search(out):
        out = _RUNS.sub(back, out)
    return (how[0], out) if how else None


def _utf8(charset: str, text: str) -> tuple[str, str, int] | None:
    """Decodes the credible UTF-8 spans of a text read in ``charset``, in runs that consist of such spans for the most part: how, the text, signs decoded.

    Once there are such spans, shorter ones that decode to the same scripts go with them.
    """
    pattern, table = utf8_spans(charset), char_bytes(charset)
    scripts: set[str] = set()
    hits = 0

    def run(m: re.Match) -> str:
        nonlocal hits
        found = m.group()
        if not pattern.search(found):
            return found
        covered = 0
        a, b = m.span()
        beside_latin = text[a - 1 : a].isascii() and text[a - 1 : a].isalpha() and text[b : b + 1].isascii() and text[b : b + 1].isalpha()
        good: dict[str, str] = {}
        for s in pattern.finditer(found):
            got = to_bytes(s.group(), charset).decode("utf-8")
            kinds = {script_of(c) for c in got}
            if kinds <= scripts or _credible(s.group(), got, charset) or (beside_latin and len(got) == 1 and got in _COMMON):
                covered += len(s.group())
                good[s.group()] = got
        if not good or covered < 0.6 * sum(c in table for c in found):
            return found
        hits += covered
        scripts.update(script_of(c) for got in good.values() for c in got)
        return pattern.sub(lambda s: good.get(s.group(), s.group()), found)

    after = _RUNS.sub(run, text)
    if hits and scripts - {"sign", "latin"}:
        after = _RUNS.sub(run, after)
    return (f"{charset}<-utf_8", after, hits) if hits else None


def _controls(text: str) -> tuple[str, str] | None:
    """cp1252 read as latin-1: C1 controls where typographic signs belong."""
    after = _C1.sub(lambda m: byte_chars("web")[ord(m.group())], text)
    return ("latin_1<-web", after) if after != text and not _ODD.search(after) else None


_C1 = re.compile("[\x80-\x9f]")


def repair(text: str | None) -> tuple[str, str, bool] | None:
    """None for sound text; else how it was garbled, the text restored as far as possible, and whether all of it was.

    Up to four layers of wrong decoding are taken off.
    """
    if not text or text.isascii() and "&" not in text:
        return None
    current = dereference(text)
    if current.isascii():
        return None
    near = "\n".join([current[max(0, m.start() - 4) : m.end() + 4] for m in _BEYOND.finditer(current)])
    if "�" not in near and not _RUNS.search(near) and not _ODD.search(near):
        return None
    how: list[str] = []
    for _ in range(4):
        step = None
        if _RUNS.search(current):
            tried = [t for t in (_utf8(c, current) for c in WRONG) if t]
            step = max(tried, key=lambda t: t[2])[:2] if tried else None
            if not step or step[0] != "web<-utf_8":
                step = _asian(current) or step
        if not step and _ODD.search(current):
            step = _controls(current) or _single_byte(current)
        if not step:
            step = _capitals(current)
        if not step or step[1] == current:
            break
        how.append(step[0])
        current = step[1]
    lost = "�" in text or "�" in current
    if not how and not lost and not any("\x80" <= c <= "\x9f" for c in current):
        return None
    return "+".join(how) or ("replaced" if lost else "controls"), current, not lost and bool(how)


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for field in FIELDS:
            for key, text in zip(batch["row_key"], batch[field]):
                if (got := repair(text)) is not None:
                    rows.append((key, field, got[0], got[1], got[2]))
        yield pd.DataFrame(rows, columns=["row_key", "field", "how", "restored", "complete"])


def garbled_fields(crawl: DataFrame) -> DataFrame:
    """row_key, field, how, restored, complete: one row for each garbled field of each crawl row.

    Null and empty fields are sound. Repeated rows are reported as often as they stand there. The crawl is read once, without a shuffle.
    """
    return map_texts(crawl.where("row_key is not null").select("row_key", *FIELDS), _check, "row_key string, field string, how string, restored string, complete boolean")


def restored_crawl(crawl: DataFrame) -> DataFrame:
    """The crawl with its garbled fields restored in place; other columns pass through."""

    names = crawl.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for field in FIELDS:
                batch[field] = [t if (g := repair(t)) is None else g[1] for t in batch[field]]
            yield batch[names]

    return map_texts(crawl, run, crawl.schema)
