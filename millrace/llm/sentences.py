"""Sentence units for every document, whatever its script.

Whether a dot ends a sentence is decided by the document first, from the places of it that leave no doubt. A short word with a dot before a lower-case word or a comma is an
abbreviation there, one that ends a paragraph can end a sentence, one that also stands without a dot is an ordinary word. A capitalised word inside a sentence that is
never in lower case is a proper name, and a word in lower case elsewhere is an ordinary one that opens a sentence where it is capitalised. Where the document is silent the corpus
decides: over all documents it is counted how often each short word with a dot is followed by a lower-case letter or a comma, by another word, or ends a paragraph; one that
never ends a paragraph cannot end a sentence. A list of titles is asked last. Every script has its own terminators; Thai has none and is cut at spaces between letters.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_texts
from millrace.session import cut

#: Only words up to this length are taken for abbreviations.
MAX_ABBREVIATION = 7
#: How often a word with a dot must occur in the corpus before the corpus decides.
MIN_SEEN = 12
#: Most abbreviations that travel to the executors. Beyond it each document is joined with those of its own.
MAX_TABLE = 200_000
#: Repeated document ids up to this many are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000

# Words after which a German day number with a dot is a date.
_BEFORE_DAY = frozenset("am vom zum bis den dem der seit ab".split())
# Titles and the like that stand before a name or number, for words that neither document nor corpus settles.
_TITLES = frozenset("dr mr mrs ms prof st sr sra dra no nr fig vol vs mme mlle m art pág núm p pp s d-r д-р г ул т е δρ κ αρ".split())

_OPEN = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "‹": "›", "‚": "‘", "《": "》"}
_CLOSE = frozenset("”»“」』)）]】›’‘\"'》")
_FULL = frozenset("。！？｡")
_TOKEN = re.compile(r"[.!?…]+|[。！？｡।॥؟۔]+|;|[“”„«»\"「」『』()（）\[\]【】‹›《》]|[ \t\r]*\n\s*|(?<=[฀-๿])[ \t]+(?=[฀-๿])")
_WORD_BEFORE = re.compile(r"(?:[^\W\d_][^\s\W]*[.\-’'])*[^\W_]+$")
_GUILLEMET = re.compile(r"[\s\u00a0\u202f]»")
_APART = re.compile(r"(?<!\w)'|'(?!\w)")
_NEXT = re.compile(r"\s*([^\W_]+)?")
_SOLID = re.compile(r"\S")
_ONE_BREAK = re.compile(r"[ \t]*\n[ \t]*(\S)")
_RUNNING = re.compile(r"(?<=(\S)\s)([^\W\d_]+)(?=(.?))")
_DOTTED = re.compile(r"(?<![^\W_])((?:[^\W\d_]\.){0,3}[^\W\d_]{1,%d})\.(?=([ \t]*(?:\n|$))|[ \t]+(\S)|([,;:)]))" % MAX_ABBREVIATION)


def dotted_words(text: str, quiet: bool = True, wrapped: bool = False) -> Iterator[tuple[str, int, int, int]]:
    """Every short word with a dot: the word, and ones where a lower-case letter or comma, another sign, or a paragraph's end follows.

    Without ``quiet``, lower case that goes on without capitals for a while is no evidence; the text may be set in lower case. In a ``wrapped`` text a single line break is
    a space.
    """
    for m in _DOTTED.finditer(text):
        follows = m.group(3)
        if wrapped and follows is None and m.group(4) is None and (n := _ONE_BREAK.match(text, m.end())):
            follows = n.group(1)
        if not quiet and follows is not None and follows.islower() and Splitter._quiet(text, text.index(follows, m.end(1))):
            continue
        low = m.group(4) is not None or (follows is not None and (follows.islower() or follows in ",;:"))
        yield m.group(1).lower(), int(low), int(follows is not None and not low), int(not low and follows is None)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen: dict[str, list[int]] = {}
        for text in batch["text"]:
            for w, low, other, end in dotted_words(text):
                s = seen.setdefault(w, [0, 0, 0])
                s[0] += low
                s[1] += other
                s[2] += end
        yield pd.DataFrame([(w, *s) for w, s in seen.items()], columns=["word", "low", "other", "ends"])


def abbreviations(documents: DataFrame, min_seen: int = MIN_SEEN) -> DataFrame:
    """word, low, other, ends over the whole corpus, of words that look like abbreviations there.

    A word qualifies if it is followed by lower case in at least a third of the cases, or ends a paragraph in fewer than 1 of 50.
    """
    counts = (
        map_texts(documents.where("text is not null").select("text"), _count, "word string, low bigint, other bigint, ends bigint")
        .groupBy("word")
        .agg(F.sum("low").alias("low"), F.sum("other").alias("other"), F.sum("ends").alias("ends"))
    )
    n = F.col("low") + F.col("other") + F.col("ends")
    return counts.where((n >= min_seen) & ((F.col("low") * 3 >= n) | (F.col("ends") * 50 < n)))


class Evidence:
    """What the unambiguous places of one document say about its words, all in lower case."""

    def __init__(self, text: str, wrapped: bool = False):
        self.text = text
        self.abbreviated: set[str] = set()  # with a dot before lower case or a comma
        self.ending: set[str] = set()  # with a dot at a paragraph's end
        if "." in text:
            for w, low, _, end in dotted_words(text, quiet=False, wrapped=wrapped):
                if end:
                    self.ending.add(w)
                elif low:
                    self.abbreviated.add(w)
        self.german = "ß" in text or " der " in text or " und " in text
        self.danda = "\u0964" in text
        self._read = False

    def _words(self) -> None:
        """Reads the running text, once and only if a dot is in doubt."""
        self._read = True
        self.common, names, self.plain = set(), set(), set()
        for m in _RUNNING.finditer(self.text):
            before, word, after = m.groups()
            if word[0].islower():
                if before not in ".!?…":
                    self.common.add(word.lower())
            elif word[0].isupper() and (before.islower() or before == ","):
                names.add(word.lower())
            if after != "." and len(word) >= 3 and (word.islower() or before not in ".!?…"):
                self.plain.add(word.lower())
        self.names = names - self.common

    def is_common(self, word: str) -> bool:
        if not self._read:
            self._words()
        return word in self.common

    def is_name(self, word: str) -> bool:
        if not self._read:
            self._words()
        return word in self.names

    def is_plain(self, word: str) -> bool:
        if not self._read:
            self._words()
        return word in self.plain

    def never_ends(self, word: str) -> bool:
        return word in self.abbreviated and word not in self.ending


class Splitter:
    """Cuts texts into sentences. ``known`` maps abbreviations of the corpus to whether they can end a sentence."""

    def __init__(self, known: dict[str, bool]):
        self.known = known

    def _ends(self, text: str, dot: int, after: int, own: Evidence) -> bool:
        """Whether the single dot at ``dot``, with text going on at ``after``, ends a sentence."""
        m = _NEXT.match(text, after)
        start = m.start(1) if m.group(1) else m.end()
        nxt = text[start : start + 1]
        if nxt in ",;:":
            return False
        if nxt.islower():
            return self._quiet(text, start) and self._ordinary(text, dot, own)
        if "\u0900" <= text[dot - 1] <= "\u0dff" and (own.danda or nxt.isdigit()):
            return False  # scripts with a danda use the dot for abbreviations
        before = _WORD_BEFORE.search(text, max(0, dot - 24), dot)
        if not before:
            return True
        word = re.split("[’']", before.group())[-1]
        lower = word.lower()
        if word.isdigit():
            if len(word) <= 2 and (nxt.isupper()) and own.german:
                lead = text[max(0, before.start() - 12) : before.start()].split()
                return not (lead and lead[-1].lower() in _BEFORE_DAY)
            return True
        if len(word) == 1 and word.isupper():
            return False
        if nxt.isdigit() and (own.never_ends(lower) or lower in self.known):
            return False
        if len(word) > MAX_ABBREVIATION and "." not in word:
            return True
        return self._settled(lower, m.group(1), own, not nxt.isalpha() or nxt.isupper())

    def _settled(self, word: str, following: str | None, own: Evidence, opens: bool) -> bool:
        """Whether a word with a dot, before a capitalised word, ends a sentence: by the document, the corpus, the titles."""
        nxt = (following or "").lower()
        if word in own.abbreviated:
            if word in own.ending:
                return not own.is_name(nxt)
            return self.known.get(word, False) and own.is_common(nxt)
        if word in own.ending:
            return not (word in self.known and own.is_name(nxt))
        if word in self.known:
            if len(word) >= 3 and not self.known[word] and own.is_plain(word) and own.is_common(nxt):
                return True
            return self.known[word]
        return not (word in _TITLES and (opens or not word.isascii()))

    @staticmethod
    def _quiet(text: str, at: int) -> bool:
        """Whether what follows has no capitals for a while, as in text set in lower case; near the end of the text what stands before counts as well."""
        part = text[max(0, min(at, len(text) - 40)) : at + 40]
        return part == part.lower()

    def _ordinary(self, text: str, dot: int, own: Evidence) -> bool:
        """Whether the word before a dot can't be an abbreviation."""
        before = _WORD_BEFORE.search(text, max(0, dot - 24), dot)
        if not before:
            return text[dot - 1 : dot] in _CLOSE
        word = re.split("[’']", before.group())[-1].lower()
        return len(word) >= 3 and "." not in word and word not in _TITLES and word not in self.known and not own.never_ends(word)

    def ends(self, text: str) -> list[int]:
        """The end of every sentence, as a number of characters."""
        newline = _Lines(text) if "\n" in text else None
        own = Evidence(text, newline is not None and newline.wrapped)
        last_of = {c: text.rfind(c) for c in set(_OPEN.values())}
        quotes = {'"': [m.start() for m in re.finditer('"', text)], "'": [m.start() for m in _APART.finditer(text)]}
        paragraph = 0
        cuts: list[int] = []
        stack: list[tuple[str, int, bool]] = []  # what closes it, where it opened, whether it opened a sentence
        inner: list[int] = []  # cuts inside an open quotation, kept only if it stands alone
        start, fresh, n = 0, True, len(text)
        skip = -1
        for m in _TOKEN.finditer(text):
            a, b = m.span()
            if a < skip:
                continue
            s = m.group()
            c = s[0]
            if "\n" in s:
                if newline.breaks(m):
                    paragraph = b
                    e = a
                    while e > start and text[e - 1].isspace():
                        e -= 1
                    if stack:  # never closed
                        cuts.extend(x for x in inner if start < x < e)
                    stack, inner = [], []
                    if e > start:
                        cuts.append(e)
                    start = b
                continue
            if s.isspace():  # between Thai letters
                if not stack:
                    cuts.append(a)
                    start = b
                continue
            if c in _CLOSE and stack and (c == stack[-1][0] or (c == "”" and stack[-1][0] == "“")):
                _, opened, alone = stack.pop()
                e = b
                prev = text[a - 1 : a]
                done = prev in ".!?…" or prev in "。！？｡।؟۔" or (prev.isspace() and self._solid_before(text, a) in (".", "!", "?", "…"))
                if not stack:
                    if done and prev and self._after_quote(text, b, n, alone, c):
                        if alone:
                            cuts.extend(x for x in inner if x < a)
                        e = self._closers(text, b, n, quotes, paragraph)
                        cuts.append(e)
                        start = skip = e
                    inner = []
                continue
            if c == '"':
                stack.append(('"', a, not _SOLID.search(text, start, a)))
                continue
            if c in _OPEN:
                close = _OPEN[c]
                if last_of[close] >= b or (c == "“" and quotes['"'] and quotes['"'][-1] >= b):
                    stack.append((close, a, not _SOLID.search(text, start, a)))
                continue
            if c in _CLOSE:
                continue
            if c == ";":
                if not ("Ͱ" <= text[a - 1 : a] <= "Ͽ" or "ἀ" <= text[a - 1 : a] <= "῿"):
                    continue
                if b < n and not text[b].isspace() and text[b] not in _CLOSE:
                    continue
            e = b
            if stack:
                if e < n and text[e].isspace() or c in _FULL:
                    if not (c == "." and len(s) == 1 and not self._ends(text, a, e, own)):
                        inner.append(e)
                continue
            e = self._closers(text, b, n, quotes, paragraph)
            if e < n:
                here = text[e]
                if c in "。！？｡":
                    pass
                elif not here.isspace():
                    if not (c in "!?…।॥؟۔" and not here.isalnum() and here not in ",;:—–-.…"):
                        continue
                elif c == "." and len(s) == 1:
                    if not self._ends(text, a, e, own):
                        continue
                else:
                    nm = _NEXT.match(text, e)
                    nxt = text[nm.start(1)] if nm.group(1) else text[nm.end() : nm.end() + 1]
                    if nxt in ("—", "–", "-", ",", ";"):
                        continue
                    if nxt.islower() and (e > b or len(s) > 1 or c not in "!?" or not self._quiet(text, e + 1)):
                        continue
            cuts.append(e)
            start = skip = e
        tail = len(text.rstrip())
        if tail > start and text[start:tail].strip():
            if inner and stack:
                cuts.extend(x for x in inner if start < x < tail)
            cuts.append(tail)
        out, last = [], 0
        for e in cuts:
            if e > last and _SOLID.search(text, last, e):
                out.append(e)
                last = e
        return out

    @staticmethod
    def _solid_before(text: str, at: int) -> str:
        """The last sign before ``at`` that isn't white space."""
        while at > 0 and text[at - 1].isspace():
            at -= 1
        return text[at - 1 : at]

    @staticmethod
    def _closers(text: str, at: int, n: int, quotes: dict[str, list[int]], paragraph: int) -> int:
        """Past closing quotes and brackets right after ``at``; a guillemet may follow a space. ``quotes`` are the places of all straight quotes, apostrophes inside words left out."""
        while at < n and text[at] in _CLOSE and text[at] not in "“‘\"'":
            at += 1
        if at < n and text[at] in "\"'" and (at + 1 == n or text[at + 1].isspace()) and (bisect_left(quotes[text[at]], at) - bisect_left(quotes[text[at]], paragraph)) % 2:
            at += 1
        m = re.compile(r"[   ]»").match(text, at)
        return m.end() if m else at

    @staticmethod
    def _after_quote(text: str, at: int, n: int, alone: bool, close: str) -> bool:
        """Whether a quotation whose last sign is a terminator also ends the sentence around it."""
        m = _NEXT.match(text, at)
        if m.end() >= n and not m.group(1):
            return True
        nxt = text[m.start(1)] if m.group(1) else text[m.end()]
        if text[at:m.end()].count("\n") and not nxt.islower():
            return True
        if nxt.islower() or nxt in ",;:—–-、，.。!?！？":
            return False
        if close in "」』" and "぀" <= nxt <= "ゟ":
            return False
        if "가" <= nxt <= "힯" and m.start(1) == at:
            return False
        return True


class _Lines:
    """Which line breaks are boundaries.

    An empty line is one. A single break after a line that ends without a terminator is one only if that line opens its block and looks like a
    headline: no sentence ends inside it, what follows doesn't go on in lower case or with a closing sign, and, in a text of
    wrapped lines, the next line's first word would have had room on it.
    """

    def __init__(self, text: str):
        self.text = text
        lines = [x.strip() for x in text.split("\n")]
        self.width = max(map(len, lines))
        self.first = len(text) - len(text.lstrip())
        bare = 0
        for k, x in enumerate(lines[:-1]):
            y = lines[k + 1]
            if x and y and x[-1] not in _DONE and (y[0].islower() or y[0] in "”»」』)）]】›’》" or (k and lines[k - 1])):
                bare += 1
        self.wrapped = bare > 0 and self.width <= 160

    def breaks(self, m: re.Match) -> bool:
        text = self.text
        a, b = m.span()
        if b >= len(text) or m.group().count("\n") > 1:
            return True
        nxt = text[b]
        if nxt.islower() or nxt in "”»」』)）]】›’》,;:":
            return False
        begin = text.rfind("\n", 0, a) + 1
        line = text[begin:a].strip()
        if line and line[-1] in _DONE:
            return not self.wrapped
        if line and line[-1] in ",—–-(«“„「（":
            return False
        first_block = begin <= self.first
        if begin > 1 and _SOLID.search(text, text.rfind("\n", 0, begin - 1) + 1, begin - 1):
            return False
        if _INNER.search(line):
            return False
        if not self.wrapped and (first_block or self.width > 160):
            return True
        end = text.find("\n", b)
        rest = text[b : end if end >= 0 else len(text)]
        first = rest.split(None, 1)[0] if rest else ""
        if " " not in line:
            first = first[:2]
        return len(line) + 1 + len(first) <= 0.85 * self.width


_DONE = ".!?…。！？।؟۔:;”»“」)）"
_INNER = re.compile(r"[^\W\d_]{2,}[.!?] +[\"“«„(]?\s?[^\W\d_a-z]|[^\W\d_]{2,}[.!?] +[\"“«„(]$|[。！？।؟]")


ENDS, UNITS = "doc_id bigint, end_pos int", "doc_id bigint, sentence_no int, start_pos int, end_pos int, sentence string"


def _cut_batch(batch: pd.DataFrame, splitters: Iterator[Splitter], units: bool) -> pd.DataFrame:
    """The ends of all sentences of a batch, or the sentences themselves."""
    ids, numbers, starts, ends, parts = [], [], [], [], []
    for doc_id, text, splitter in zip(batch["doc_id"], batch["text"], splitters):
        found = splitter.ends(text)
        ids.extend([doc_id] * len(found))
        ends.extend(found)
        if units:
            begins = [0, *found][: len(found)]
            numbers.extend(range(1, len(found) + 1))
            starts.extend(begins)
            parts.extend(text[a:b].strip() for a, b in zip(begins, found))
    out = {"doc_id": pd.Series(ids, dtype="int64")}
    if units:
        out |= {"sentence_no": pd.Series(numbers, dtype="int32"), "start_pos": pd.Series(starts, dtype="int32")}
    out["end_pos"] = pd.Series(ends, dtype="int32")
    return pd.DataFrame(out | {"sentence": pd.Series(parts, dtype="object")} if units else out)


def _split(known: dict[str, bool], units: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(known)
        for batch in batches:
            yield _cut_batch(batch, repeat(splitter), units)

    return run


def _looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words that a splitter may look up in each document: those before a dot."""
    for batch in batches:
        found = set()
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            for m in re.finditer(r"\.", text):
                before = _WORD_BEFORE.search(text, max(0, m.start() - 24), m.start())
                if before:
                    found.add((doc_id, re.split("[’']", before.group())[-1].lower()))
        yield pd.DataFrame(list(found), columns=["doc_id", "word"]).astype({"doc_id": "int64"})


def _split_each(units: bool):
    """Like ``_split``, with the abbreviations of each document in its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _cut_batch(batch, (Splitter({w[1:]: w[0] == "1" for w in (known if known is not None else ())}) for known in batch["known"]), units)

    return run


def _cut_all(documents: DataFrame, docs: DataFrame, units: bool, min_seen: int, max_table: int) -> DataFrame:
    """Cuts the rows of ``docs`` with the corpus evidence of ``documents``."""
    schema = UNITS if units else ENDS
    table = abbreviations(documents, min_seen)
    rows = table.limit(max_table + 1).collect()  # bounded by max_table
    if len(rows) > max_table:
        flags = table.select("word", (F.col("ends") * 50 >= F.col("low") + F.col("other") + F.col("ends")).cast("int").cast("string").alias("flag"))
        known_of = map_texts(docs, _looked_up, "doc_id bigint, word string").distinct().join(flags, "word").groupBy("doc_id").agg(F.collect_list(F.concat("flag", "word")).alias("known"))
        return map_texts(docs.join(known_of, "doc_id", "left"), _split_each(units), schema)
    known = {r["word"]: bool(r["ends"] * 50 >= r["low"] + r["other"] + r["ends"]) for r in rows}
    return map_texts(docs, _split(known, units), schema)


def sentence_ends(documents: DataFrame, min_seen: int = MIN_SEEN, max_table: int = MAX_TABLE) -> DataFrame:
    """doc_id, end_pos of every sentence of every document. Null and blank texts have none; repeated rows count once.

    end_pos counts code points up to and including the sentence's last sign, closing quotes and brackets included.
    """
    docs = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _cut_all(documents, docs, False, min_seen, max_table).distinct()


def sentences(documents: DataFrame, min_seen: int = MIN_SEEN, max_table: int = MAX_TABLE) -> DataFrame:
    """doc_id, sentence_no from 1, start_pos, end_pos, sentence: the units themselves, cut from the text in the pass that finds them.

    Repeated rows count once: only the texts of a doc_id that stands in several rows are compared, the others are not shuffled.
    """
    docs = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    again = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id"))
    n = again.count()
    if n:
        ids = F.broadcast(again) if n <= BROADCAST_IDS else again
        docs = docs.join(ids, "doc_id", "left_anti").unionByName(docs.join(ids, "doc_id", "left_semi").distinct())
    return _cut_all(documents, docs, True, min_seen, max_table)
