"""Text functions as Column expressions: cleaning, page metadata, scores of strings. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence and bracket signs at which a word is cut.
CUT = r"""[.,!?:;"'(){}\[\]-]"""
# Signs that the page index turns into spaces.
PAGE_SIGNS = r"""[.,:;!?'’"()\-\r\n\t]"""


def clean_words(s: Column) -> Column:
    """Non-ASCII characters become spaces, runs of spaces one, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\x00-\x7F]", " "), r"\s+", " "))


def clean_word(s: Column) -> Column:
    """Without non-ASCII characters, trimmed."""
    return F.trim(F.regexp_replace(s, r"[^\x00-\x7F]", ""))


def before_punctuation(s: Column) -> Column:
    """Up to the first sentence or bracket sign."""
    return F.regexp_extract(s, r"""^[^.,!?:;"'(){}\[\]-]*""", 0)


def first_number(s: Column) -> Column:
    """The first run of digits, or null."""
    return F.nullif(F.regexp_extract(s, r"[0-9]+", 0), F.lit(""))


def page_letters(s: Column) -> Column:
    """A page as lower-case ASCII letters: tags and everything else become single spaces."""
    untagged = F.regexp_replace(F.lower(s), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(untagged, r"[^a-z]+", " "))


def page_words(s: Column) -> Column:
    """A page as words: tags and punctuation become spaces, lower case, split at spaces, empty words dropped."""
    text = F.lower(F.regexp_replace(F.regexp_replace(s, r"<[^>]*>", " "), PAGE_SIGNS, " "))
    return F.filter(F.split(text, " +"), lambda w: w != "")


# What the crawler's cleaning replaces by spaces, in this order, before and after the elements that hold nothing to be read.
HIDDEN_TAGS = "meta head noscript iframe embed object applet link base area map param track wbr".split()
PATTERNS_BEFORE = (
    r"(?s)<script.*?>.*?</script>",
    r"(?s)<style.*?>.*?</style>",
    r'on\w+\s*=\s*"[^"]*"',
    r"on\w+\s*=\s*'[^']*'",
    r"(?s)<!--.*?-->",
    r"(?s)<footer.*?>.*?</footer>",
)
PATTERNS_AFTER = (
    r"<[^>]*>",
    r"[ \t\n\x0B\f\r]+",
    r"(?i)\b(?:privacy policy|terms of service|about us)\b",
    r"[^\p{L} ]",
)


def body_steps() -> list[str]:
    """The patterns that ``body_letters`` replaces by spaces, in order. Hidden elements are spelt out tag by tag, without back references, so that any engine takes them."""
    whole = "(?s)" + "|".join(f"<{t}[^>]*>.*?</{t}>" for t in HIDDEN_TAGS)
    return [*PATTERNS_BEFORE, whole, f"<(?:{'|'.join(HIDDEN_TAGS)})[^>]*>", *PATTERNS_AFTER]


def body_letters(s: Column) -> Column:
    """The stronger cleaning of the crawler: scripts, styles, handlers, comments, footers, hidden elements, tags and standing phrases go; letters of all scripts stay, in lower case."""
    for pattern in body_steps():
        s = F.regexp_replace(s, pattern, " ")
    return F.lower(F.trim(s))


def paragraph_letters(s: Column) -> Column:
    """Only what stands in paragraphs and headings, as lower-case letters of all scripts; tags inside leave the letters of their names."""
    parts = F.regexp_extract_all(s, F.lit(r"(?s)<(p|h[1-6]).*?>(.*?)</\1>"), F.lit(2))
    letters = F.regexp_replace(F.array_join(parts, " "), r"[^\p{L}\x0B\f]", " ")
    return F.lower(F.trim(F.regexp_replace(letters, " +", " ")))


def sanitized(s: Column) -> Column:
    """Letters and digits of all scripts, apostrophes and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}\s']", " "), r"\s+", " "))


def _meta(page: Column, attribute: str, name: str) -> Column:
    return F.regexp_extract(page, rf'(?i)<meta\s+{attribute}="{name}"\s+content="([^"]*)"', 1)


def page_title(page: Column) -> Column:
    """og:title, else the title element, else the description, else empty."""
    empty = F.lit("")
    return F.coalesce(
        F.nullif(_meta(page, "property", "og:title"), empty),
        F.nullif(F.trim(F.regexp_extract(page, r"(?i)<title>([^<]*)</title>", 1)), empty),
        F.nullif(_meta(page, "name", "description"), empty),
        empty,
    )


def page_description(page: Column) -> Column:
    return F.lower(F.regexp_replace(_meta(page, "property", "og:description"), "\n", " "))


def page_icon(page: Column, url: Column) -> Column:
    """apple-touch-icon, else shortcut icon, else icon, else favicon.ico under the url."""
    link = lambda rel: F.nullif(F.regexp_extract(page, rf'(?i)<link\s+rel="{rel}"\s+href="([^"]*)"', 1), F.lit(""))
    return F.coalesce(link("apple-touch-icon"), link("shortcut icon"), link("icon"), F.concat(url, F.lit("/favicon.ico")))


def page_keywords(page: Column) -> Column:
    return _meta(page, "name", "keywords")


def page_images(page: Column) -> Column:
    """The image tags of a page, as an array."""
    return F.regexp_extract_all(page, F.lit(r"(?i)(<img\s[^>]*>)"), F.lit(1))


def tag_attribute(tag: Column, name: str) -> Column:
    """The first quoted value of an attribute, or empty."""
    return F.regexp_extract(tag, rf'{name}\s*=\s*"([^"]*)"', 1)


def images_html(sources: Column) -> Column:
    return F.array_join(F.transform(sources, lambda s: F.concat(F.lit('<img src="'), s, F.lit('">'))), "")


def page_language(page: Column) -> Column:
    """The lang attribute of the html element in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(page, r'(?i)<html[^>]*\slang="([^"]*)"', 1)), F.lit(""))


def is_english(page: Column, detected: Column) -> Column:
    """By the lang attribute, and where there is none by the language detected elsewhere."""
    lang = F.coalesce(page_language(page), F.lower(detected), F.lit(""))
    return (lang == "en") | lang.startswith("en-")


def zip_codes(text: Column) -> Column:
    """The distinct passages of a page's text that name a ZIP code, in lower case: the word ``zip`` and five digits, perhaps with four more, at most 20 characters on."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?<!\.)\bzip\b.{0,20}\b\d{5}(?:-\d{4})?\b"), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def page_location(page: Column) -> Column:
    """``latitude,longitude`` of a page's meta elements, or empty where either is missing."""
    value = lambda names: F.regexp_extract(page, rf'(?i)<meta\s+property="[^"]*(?:{names})[^"]*"\s+content="([^"]*)"', 1)
    latitude, longitude = value("og:latitude|og:lat|place:location:latitude|geo.position"), value("og:longitude|place:location:longitude")
    return F.when((latitude != "") & (longitude != ""), F.concat(latitude, F.lit(","), longitude)).otherwise(F.lit(""))


def named_places(text: Column, places: list[str]) -> Column:
    """Which of the places occur as whole words."""
    return F.filter(F.array(*[F.lit(p) for p in places]), lambda p: F.concat(F.lit(" "), F.regexp_replace(text, r"[^A-Za-z]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" "))))


def title_case(s: Column) -> Column:
    return F.initcap(s)


# Parts of content types and the names that files of them go by; the first that fits counts.
FILE_TYPES = (("pdf", "PDF"), ("word", "DOC"), ("excel", "XLSX"), ("powerpoint", "PPT"), ("zip", "ZIP"), ("text/plain", "TXT"), ("xml", "XML"), ("json", "JSON"), ("csv", "CSV"), ("rtf", "RTF"))


def file_type(content_type: Column) -> Column:
    """The short name of a file's type, or null."""
    out = F.lit(None).cast("string")
    for part, name in reversed(FILE_TYPES):
        out = F.when(content_type.contains(part), F.lit(name)).otherwise(out)
    return out


def file_title(metadata: Column, url: Column, content_type: Column) -> Column:
    """The title in a file's metadata, else its name without the ending, its type and its host."""
    stem = F.regexp_replace(F.regexp_extract(url, r"([^/]*)$", 1), r"\.\w+$", "")
    host = F.coalesce(F.nullif(F.replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1), F.lit("www."), F.lit("")), F.lit("")), F.lit("unknown domain"))
    return F.coalesce(F.nullif(metadata, F.lit("")), F.concat(stem, F.coalesce(F.concat(F.lit(" "), file_type(content_type)), F.lit("")), F.lit(" from "), host))


def file_icon(content_type: Column, icons: dict[str, str], default: str) -> Column:
    """The address of the icon of a content type. ``icons`` is an input."""
    known = F.create_map(*[F.lit(x) for kv in icons.items() for x in kv])[content_type] if icons else F.lit(None).cast("string")
    return F.coalesce(known, F.lit(default))


def valid_word(w: Column) -> Column:
    """More than two letters, nothing else, no letter three times in a row."""
    triple = F.exists(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: (F.substr(w, i, F.lit(1)) == F.substr(w, i + 1, F.lit(1))) & (F.substr(w, i + 1, F.lit(1)) == F.substr(w, i + 2, F.lit(1))))
    return (F.length(w) > 2) & w.rlike("^[A-Za-z]+$") & ~triple


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1, a half where all values are equal."""
    return F.when(high == low, F.lit(0.5)).otherwise((x - low) / (high - low))


def query_words(query: str) -> list[str]:
    """A query's words, separated by hyphens, cleaned, in order, repeated ones kept."""
    cleaned = ("".join(c if c.isascii() else " " for c in part).strip().lower() for part in query.split("-"))
    return [w for w in cleaned if w]


def query_terms(query: str, stop_words: frozenset[str] = frozenset(), lemmas: dict[str, str] | None = None) -> list[str]:
    """A query's words as their lemmas, without stop words, each once; if only stop words are left, these stay."""
    words = query_words(query)
    kept = [w for w in words if w not in stop_words] or words
    return list(dict.fromkeys((lemmas or {}).get(w, w) for w in kept))


def query_counts(query: str, **analysis) -> dict[str, int]:
    """How often each term stands in the query."""
    lemmas = analysis.get("lemmas") or {}
    terms = [lemmas.get(w, w) for w in query_words(query)]
    return {t: terms.count(t) for t in query_terms(query, **analysis)}
