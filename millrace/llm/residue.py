"""Pages that show template residue, filler, error messages or a demand for scripts where content belongs.

Records of one template are aligned: every block of a page has a place, the element that holds it, its own element and whether it is the first of its like or of those that
repeat after it, and the title has a place for each of its parts; the records of a site agree in these. Over the records of a site a place is a constant (menus, notices, the site's name), or a slot if nearly every
record has a value of its own there. A slot that was never filled shows it in one of these ways:

- it holds the name of its variable, in the syntax of a template, or a bracketed instruction, or is a blank beside its separator;
- it holds a default: a value that stands in slots of several sites, beside headlines and texts that have nothing to do with each other, as no text written for one page does, copied pages excepted;
- it holds the message of a whole-page template: a value of several sites, or of many records of one slot, nearly always on pages without any article.

Lists of defaults, filler words and error wordings in nine languages are the last evidence, for records that have no others to be compared with. ``lists=False`` leaves them out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.memo import memo
from millrace.llm.common import map_texts, site_of
from millrace.llm.pages import Block, blocks_of
from millrace.session import stored

_MARK = re.compile(
    r"\{\{\{?[^{}]{0,80}\}?\}\}|\{\{|\}\}|\{%[^%]{0,80}%\}|\{%|[$#]\{[^{}]{0,80}\}|<[?%][=a-z].{0,80}?[?%]>|\[\[[^\[\]]{1,60}\]\]|%%?[A-Za-z][A-Za-z_]{2,30}%%?"
    r"|@@[A-Z_]{2,30}@@|\$\$\w{2,30}\$\$|__[A-Z][A-Z_]{2,30}__|\{[A-Z][A-Z_]{2,30}\}|\{\d\}|\[object Object\]|\$[a-z_]+(?:->|\[)\w+|<%|%>"
)
_BRACKETED = re.compile(r"^\W{0,2}\[{1,2}[^\[\]]{2,80}\]{1,2}\W{0,2}$")
# What a slot says when nobody filled it, as a whole block or title.
_DEFAULT = re.compile(
    r"^\W*(?:untitled(?: document| page| post)?|new (?:page|post|document|article)(?: \(?\d+\)?)?|(?:sample|demo|example|test|default) (?:page|post|article|text|title|heading)"
    r"|just another [\w ]{0,20}(?:site|blog|weblog)|hello world|app|home ?page title|undefined|null|nan|none|nil|\(?no (?:title|subject)\)?|unbenannt(?:es dokument)?|sans titre|sin título|sem título|без названия|無題|document"
    r"|(?:null|undefined|none)(?:\W+(?:null|undefined|none))+|(?:title|headline|heading|name|text|content|caption|subtitle|copy|description)(?: goes)? here)\W*$"
    r"|\bgoes here\b|\byour (?:own )?(?:words|text|company|name|title|content|headline|description|logo) (?:here|goes)?|\bwith your own words\b|\bto be (?:supplied|provided|added|confirmed|written|defined)\b|\bmax\.? \d+ (?:characters|chars|words)\b"
    r"|\b(?:TBD|TBC|TODO|FIXME|XXXX+)\b|\bclick (?:edit|here) to (?:edit|replace|change|add)\b|\breplace this (?:paragraph|text|sentence|content)\b|\b(?:placeholder|dummy|filler|lead) text\b|^\W*(?:coming soon|under construction|work in progress|page en construction|in kürze|próximamente|em breve|скоро|準備中|工事中)\W*$",
    re.I,
)
_SHOUTED = re.compile(r"\b(?:TBD|TBC|TODO|FIXME|XXXX+)\b")
_BLANK = re.compile(r"^(?:Dear|Hello|Hi|Welcome|Bonjour|Hola|Olá|Sehr geehrte\w*|Hallo)\s*[,!]|\(\s*\)\s*$|^\s*[|–—:·»-]\s+\S|\b(?:costs|from|at|by|in) ?[,.]$")
# Words of the usual filler prose.
_FILLER = re.compile(r"\b(?:lorem|ipsum|dolor|amet|consect\w*|adipis\w*|elit|eiusmod|incidid\w*|tincid\w*|nostrud|ullamco|veniam|aliqua)\b", re.I)
# The wording of errors and of demands for scripts.
_ERROR = re.compile(
    r"^\W*(?:error\W{0,3})?(?:40[0-9]|41[0-9]|42[0-9]|50[0-9])\b|page (?:was )?not found|page not available|does not exist or has|cannot (?:be found|find)|could not be found|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|internal (?:server )?error|access (?:is )?denied|forbidden|permission to (?:view|access)|too many requests|rate limit|session (?:\S+ )?(?:has )?(?:expired|timed out)|timed out|could not connect|connection failed|database error|down for maintenance|did not answer in time"
    r"|traceback \(most recent|fatal error|parse error|syntax error|undefined (?:index|variable|offset|method|property)|uncaught \w*(?:error|exception)|stack trace|\bexception in\b|on line \d+|warning: \w+\(|segmentation fault|out of memory|sqlstate"
    r"|(?:enable|activate|turn on|requires?|allow\w*|need\w*)[^.]{0,40}(?:javascript|scripts?\b|scripting|cookies)|(?:javascript|scripting|scripts?)[^.]{0,40}(?:enabled|disabled|required|allowed|switched on|turned on|must be)|checking your browser|not a robot|are you human|verify (?:that )?you"
    r"|seite nicht gefunden|gewünschte seite|fehler aufgetreten|interner fehler|zugriff verweigert|javascript aktivier|aktivier\w+ sie|wartungsarbeiten|page introuvable|page demandée|une erreur est survenue|erreur (?:du|de) serveur|accès (?:refusé|interdit)|activer javascript|página no encontrada|no (?:se )?ha(?: podido)? encontrad|error interno|se ha producido un error|acceso denegado|active javascript|página não encontrada|endereço pedido|ocorreu um erro|erro (?:interno|do servidor)|acesso negado|ative o javascript"
    r"|страница не найдена|запрошенный адрес|ошибка сервера|внутренняя ошибка|произошла ошибка|доступ (?:запрещ|закрыт)|включите javascript|ページが見つかりません|お探しのページ|エラー|javascriptを有効|アクセス(?:が拒否|権)|nie znaleziono|strona nie istnieje|błąd serwera|wystąpił błąd|brak dostępu|obsługę javascript|页面不存在|找不到页面|启用javascript",
    re.I,
)
# How such messages begin that leave no doubt even beside an article.
_BLUNT = re.compile(r"\W*(?:traceback|fatal|undefined|uncaught|warning: |parse error|sqlstate|please enable|you need to turn on|checking your browser|this application requires)", re.I)
_WAITING = re.compile(r"^\W*(?:loading|just a moment|please wait|one moment|bitte warten|chargement|cargando|carregando|загрузка|読み込み中|ładowanie|verify|warning|oops|error|fehler|erreur|ошибка)\W*$", re.I)
_SLOT = re.compile(r"[0-9a-f]*\d[0-9a-f]*", re.I)
_CLAUSE = re.compile(r"[.,;:!?—–()«»“”\"…。、！？।؟]+\s*")
_SEPARATOR = re.compile(r"\s+(?:\||–|—|-|::|·|»|â€“|‚Äì|ÔÇô)\s+")
#: A block with this many characters outside lists counts as prose of an article.
PROSE = 140
#: Clauses of this many characters in blocks of that many tell pages apart, by the least hashes of each page's; where more than this share of them stand on several pages of a group,
#: these are copies of one page.
CLAUSE, OWN, SKETCH, MOST_COPIED = 20, 60, 16, 0.25
#: A default stands on at least this share of all sites; short sentences meet by chance on a few.
DEFAULT_SITES = 0.004
#: One sign of a variable, default or error counts for so many words around it.
MARK_WORDS, DEFAULT_WORDS, BLANK_WORDS, ERROR_WORDS = 14, 14, 16, 32
#: A place is a slot if at least this many records have it and this share of their values is different.
MIN_RECORDS, MIN_DIFFERENT = 5, 0.6

#: What every phrase of the list of defaults has a part of; longer blocks need several phrases.
_HINTS = ("here", "your ", "to be ", "max", "tbd", "tbc", "todo", "fixme", "xxxx", "click ", "replace this", " text")

OUT = "row_key string, site bigint, article boolean, named bigint, headline bigint, reason string, sketch array<bigint>, places array<bigint>, values array<bigint>"
OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]


@memo(200_000)
def masked(text: str) -> str:
    return _SLOT.sub("#", text).lower().strip()


@memo(200_000)
def residue_in(text: str, title: bool = False, lists: bool = True) -> str | None:
    """Why a whole block or title is residue by itself, or none."""
    n = len(text)
    words = len(text.split())
    if not n:
        return None
    marks = _MARK.findall(text) if any(c in text for c in "{}$%@[_<") else ()
    if marks:
        share = sum(map(len, marks)) / n
        if title or len(marks) >= 2 or words <= len(marks) * MARK_WORDS or share >= 0.2:
            if not (len(marks) == 1 and re.fullmatch(r"\{\d\}", marks[0])):
                return "variable"
    if _BRACKETED.match(text) and (title or words >= 2 or text.strip("[] ").lower() in ("title", "name", "text", "image")):
        return "bracketed"
    if title and re.match(r"^\s*[|–—:·»-]\s+\S", text):
        return "blank"
    if not lists:
        return None
    low = text.lower() if words > DEFAULT_WORDS else ""
    if (not low or sum(map(low.count, _HINTS)) * DEFAULT_WORDS >= words) and (words <= len(_DEFAULT.findall(text)) * DEFAULT_WORDS or words <= len(_SHOUTED.findall(text)) * 25):
        return "default"
    if not title and words <= 2 * BLANK_WORDS and words <= len(_BLANK.findall(text)) * BLANK_WORDS:  # only at both ends
        return "blank"
    hits = _FILLER.findall(text)
    if len(hits) >= 2 and len({h.lower() for h in hits}) >= 2 and len(hits) >= 0.06 * words:
        return "filler"
    if title and len(hits) >= 1 and len(hits) >= 0.25 * words:
        return "filler"
    return None


def _is_article(blocks: list[Block], lists: bool) -> bool:
    """Whether a page has prose."""
    return any(len(b.text) >= (PROSE if b.text.isascii() or " " in b.text[:60] else PROSE // 3) and b.linked * 2 < b.words and not residue_in(b.text, False, lists) for b in blocks)


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


@memo(200_000)
def _place(name: str, head: bool) -> int:
    return _number(name) & ~1 | (not head)


def _own_residue(titles: list[str], body: list[Block], article: bool, lists: bool) -> str | None:
    """The reason that a record gives by itself."""
    heads = {masked(b.text) for b in body if b.tag in ("h1", "h2")}
    own = None
    for t in titles:
        slot = _SEPARATOR.split(t)[0] if not re.match(r"^\s*[|–—:·»-]\s", t) else t
        own = own or residue_in(slot, True, lists) or residue_in(t, True, lists)
        if lists and not own and masked(slot) not in heads and (_WAITING.match(slot) or len(slot.split()) <= 8 and _ERROR.search(slot) and "?" not in slot):
            own = "error title"
    for b in body:
        if own:
            break
        if b.tag == "li" and b.words > 25:
            continue
        own = residue_in(b.text, False, lists)
        if lists and not own and b.linked * 2 < b.words:
            if (not article or _BLUNT.match(b.text)) and (n := len(_ERROR.findall(b.text))) and b.words <= n * ERROR_WORDS:
                own = "error"
            elif not article and b.tag in ("h1", "h2") and _WAITING.match(b.text):
                own = "error"
    return own


def _scan(lists: bool):
    """One row a page. Headlines and title parts have even places, all others odd ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, site, title, page in zip(batch["row_key"], batch["site"], batch["title"], batch["page"]):
                blocks = [b for b in blocks_of(page) if "noscript" not in b.path] if page else []
                body = [b for b in blocks if b.tag != "title"]
                titles = list(dict.fromkeys(t for t in [title, *(b.text for b in blocks if b.tag == "title")] if t))
                article = _is_article(body, lists)
                clauses = {_number(c) for b in body if len(b.text) >= OWN and b.linked * 2 < b.words for c in _CLAUSE.split(b.text) if len(c) >= CLAUSE}
                places, values = [], []
                for t in titles:
                    for k, part in enumerate(_SEPARATOR.split(t)):
                        if part := masked(part):
                            places.append(_place(f"title {k}", True))
                            values.append(_number("t" + part))
                headline = None
                seen: set[str] = set()
                for b in body:
                    if len(b.text) > 3 and b.linked * 2 < b.words:
                        at = f"{b.path}>{b.tag}"
                        places.append(_place(at + (" 2" if at in seen else " 1"), b.tag == "h1"))
                        values.append(_number("b" + masked(b.text)))
                        seen.add(at)
                        if headline is None and b.tag == "h1":
                            headline = values[-1]
                named = _number("t" + masked(_SEPARATOR.split(titles[0])[0])) if titles else headline
                own = _own_residue(titles, body, article, lists)
                rows.append((key, -1 if site is None else _number(site), article, named, headline, own, sorted(clauses)[:SKETCH], places, values))
            yield pd.DataFrame(rows, columns=OUT_NAMES).astype({"site": "int64", "article": "bool", "named": "Int64", "headline": "Int64"})

    return run


def residue_pages(crawl: DataFrame, min_sites: int = 3, min_bare: float = 0.8, min_same: int = 5, lists: bool = True) -> DataFrame:
    """row_key, reason of every page with residue; a page may have several reasons.

    A value in slots of at least ``min_sites`` sites and ``DEFAULT_SITES`` of all is a default if its pages have as many different headlines (it may be the headline itself) and are no copies of each other. A value of at least ``min_sites`` sites, or of ``min_same``
    records of one slot, marks its pages without article if ``min_bare`` of its pages have none. Rows without title and page have no residue; repeated rows count once; pages are
    read once, and only 8-byte numbers are shuffled.
    """
    pages = crawl.where("row_key is not null and (page is not null or title is not null)").select("row_key", site_of(F.col("url")).alias("site"), "title", "page")
    found = stored(map_texts(pages, _scan(lists), OUT))
    single = found.where("reason is not null").select("row_key", "reason")
    at = F.explode(F.arrays_zip("places", "values")).alias("_p")
    head = (F.col("place") % 2) == 0
    parts = found.select("row_key", "site", "article", "named", "headline", at).select(
        "row_key", "site", "article", F.col("_p.places").alias("place"), F.col("_p.values").alias("value"), "named", "headline"
    )
    here = stored(
        parts.groupBy("site", "place", "value").agg(F.count_distinct(F.xxhash64("row_key")).alias("n"), F.sum((~F.col("article")).cast("bigint")).alias("bare"), F.count(F.lit(1)).alias("rows"))
    )
    slots = stored(here.groupBy("site", "place").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_d")).where((F.col("_n") >= MIN_RECORDS) & (F.col("_d") >= MIN_DIFFERENT * F.col("_n"))).select("site", "place"))
    spread = stored(
        here.groupBy("value", "site")
        .agg(F.sum("rows").alias("rows"), F.sum("bare").alias("bare"))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("sites"), F.sum("rows").alias("rows"), F.sum("bare").alias("bare"))
        .where(F.col("sites") >= min_sites)
    )
    empty = F.col("bare") >= min_bare * F.col("rows")
    messages = spread.where(empty).select("value").union(here.where((F.col("n") >= min_same) & empty).join(slots, ["site", "place"], "left_semi").select("value")).distinct()
    whole = parts.where("not article").join(messages, "value", "left_semi").select("row_key", F.lit("template").alias("reason"))
    shared = stored(parts.join(spread.where(~empty).select("value"), "value", "left_semi").join(slots, ["site", "place"], "left_semi").select("row_key", "site", "value", head.alias("head"), F.when(head, F.col("named")).otherwise(F.col("headline")).alias("title")).distinct())
    sketches = found.where("size(sketch) > 0").select("row_key", "sketch").distinct()
    copied = (
        sketches.join(shared.select("row_key", "value").distinct(), "row_key").select("value", F.explode("sketch").alias("clause")).groupBy("value", "clause").agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("twice"))
    )
    defaults = (
        shared.groupBy("value")
        .agg(F.count_distinct("site").alias("sites"), F.count_distinct("title").alias("titles"), F.max("head").alias("head"))
        .where((F.col("sites") >= F.greatest(F.lit(min_sites), DEFAULT_SITES * here.agg(F.count_distinct("site")).scalar())) & ((F.col("titles") >= min_sites) | F.col("head")))
        .join(copied.where(F.col("twice") <= MOST_COPIED * F.col("n")), "value")
        .select("value")
    )
    unfilled = shared.join(defaults, "value", "left_semi").select("row_key", F.lit("shared default").alias("reason"))
    return single.unionByName(whole).unionByName(unfilled).distinct()


def without_residue(crawl: DataFrame, **options) -> DataFrame:
    """The crawl without the pages that ``residue_pages`` finds; all columns pass through."""
    return crawl.join(residue_pages(crawl, **options).select("row_key").distinct(), "row_key", "left_anti")
