"""Main body of a page, told from the site's furniture by a small decision tree over flat text blocks.

A page is read as a flat list of blocks with their number of words and link density and those of their neighbours, where each stands in relation to the headline and
to the element that holds most of the prose, and how it is written. A decision tree is grown on a bounded table of labelled blocks: of ``sample_pages`` pages, the
blocks whose holding element names its role (``nav``, ``article``, class names such as ``sidebar`` or ``entry``). Names are used for labels only, never as a feature, so that the tree
serves sites whose markup says nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from millrace.llm.common import hash_sample, map_texts
from millrace.llm.pages import Block, blocks_of

#: Pages whose labelled blocks the tree is grown on, chosen by a hash of their key.
SAMPLE_PAGES = 1500
MAX_DEPTH = 10
MIN_LEAF = 8

#: What a headline adds to the prose, in words, where the main container is looked for, and what a word outside prose counts there.
HEADLINE, OTHER = 40, 0.25
#: So many letters of a line are looked up before the line is searched for.
BEGIN = 24

# What elements and class names say about the role of what they hold.
_FURNITURE = re.compile(r"(?:^|[.\s_-])(?:nav\w*|menu|crumb\w*|breadcrumb\w*|share\w*|social|author\w*|byline|meta|dateline|rail|side\w*|aside|related|recommend\w*|foot\w*|bottom|legal|print|small|copyright|consent|cookie\w*|banner|advert\w*|promo\w*|sponsor\w*|widget|toolbar|login|search)(?:$|[.\s_-])")
_BODY = re.compile(r"(?:^|[.\s_-])(?:article|main|entry|content|post|story|body|text)(?:$|[.\s_-])")
_END = re.compile(r"[.!?…。！？।؟:][\"”»“」)）']*$")
_LIST_SIGN = re.compile(r"[|·•¦>»/]")
_KEY = re.compile(r"[\W\d_]+")
_WIDE = re.compile("[぀-ヿ一-鿿]")

FEATURES = (
    "words words_before words_after linked linked_before linked_after ends ends_before ends_after head item quote plain before_head after_head "
    "same_hold hold_blocks hold_prose inside_main depth_to_main from_prose to_prose signs digits upper position rest in_title page_prose list_run hold_linked after_prose_share flat"
).split()


def label_of(hold: str) -> int | None:
    """1 for main body, 0 for furniture, none where the holding element doesn't say."""
    if _FURNITURE.search(hold):
        return 0
    if _BODY.search(hold):
        return 1
    return None


def _weight(text: str) -> float:
    return len(text) * (2.5 if _WIDE.search(text) else 1)


def features_of(blocks: list[Block], titles: str = "") -> np.ndarray:
    """One row of FEATURES per block."""
    n = len(blocks)
    x = np.zeros((n, len(FEATURES)), np.float32)
    if not n:
        return x
    words = np.array([_weight(b.text) / 6 for b in blocks], np.float32)
    linked = np.array([b.linked / b.words if b.words else 0 for b in blocks], np.float32)
    ends = np.array([1 if _END.search(b.text) else 0 for b in blocks], np.float32)
    prose = (words >= 12) * ends * (linked < 0.5) * words
    by_hold: dict[str, float] = {}
    count: dict[str, int] = {}
    links: dict[str, float] = {}
    for b, p, l in zip(blocks, prose, linked):
        by_hold[b.path] = by_hold.get(b.path, 0) + p
        count[b.path] = count.get(b.path, 0) + 1
        links[b.path] = links.get(b.path, 0) + l
    total = float(prose.sum())
    score = dict(by_hold)
    for b, v in zip(blocks, words):
        score[b.path] += HEADLINE * (b.tag == "h1") + OTHER * float(v)
    main = max(score, key=lambda h: score[h])
    depth = main.count("/") + (1 if main else 0)
    head = next((k for k, b in enumerate(blocks) if b.tag == "h1"), -1)
    where = np.flatnonzero(prose > 0)
    seen = np.cumsum(prose)
    title = _KEY.sub("", titles.lower())
    run = 0
    for k, b in enumerate(blocks):
        i = int(np.searchsorted(where, k))  # the first prose at k or after
        near = min(int(where[i]) - k if i < len(where) else 99, k - int(where[i - 1]) if i else 99)
        i += i < len(where) and where[i] == k
        ahead = int(where[i]) - k if i < len(where) else None
        text = b.text
        letters = sum(c.isalpha() for c in text) or 1
        run = run + 1 if b.tag in ("li", "br", "td", "option", "") else 0
        key = _KEY.sub("", text.lower())
        own = b.path.count("/") + (1 if b.path else 0)
        x[k] = (
            words[k], words[k - 1] if k else -1, words[k + 1] if k + 1 < n else -1,
            linked[k], linked[k - 1] if k else -1, linked[k + 1] if k + 1 < n else -1,
            ends[k], ends[k - 1] if k else -1, ends[k + 1] if k + 1 < n else -1,
            b.tag in ("h1", "h2", "h3", "h4"), b.tag in ("li", "dt", "dd"), b.tag == "blockquote", b.tag == "p",
            head >= 0 and k < head, k - head if head >= 0 and k >= head else -1,
            b.path == main, count[b.path], by_hold[b.path] / total if total else 0,
            b.path.startswith(main), own - depth, min(near, 20), 30 if ahead is None else min(ahead, 20),
            len(_LIST_SIGN.findall(text)), sum(c.isdigit() for c in text) / (len(text) or 1), sum(c.isupper() for c in text) / letters, k / n, n - k,
            len(key) > 5 and bool(title) and (key in title or title in key), total, run, links[b.path] / count[b.path], seen[k] / total if total else 0,
            len(count) == 1 and "" in count,
        )
    return x


class Tree:
    """A binary decision tree by Gini impurity over numeric features."""

    def __init__(self, depth: int = MAX_DEPTH, leaf: int = MIN_LEAF, first: int = -1):
        """``first``: a 0/1 feature that the root splits on, whatever its gain."""
        self.depth, self.leaf, self.first = depth, leaf, first
        self.nodes: list[tuple[int, float, int, int, float]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Tree:
        self.nodes = []
        self._grow(x, y.astype(np.float64), np.ones(len(y)) if w is None else w, 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, level: int) -> int:
        at = len(self.nodes)
        p = float((y * w).sum() / w.sum()) if len(y) else 0.0
        self.nodes.append((-1, 0.0, -1, -1, p))
        if level >= self.depth or len(y) < 2 * self.leaf or p in (0.0, 1.0):
            return at
        best, feature, cut = 1e-9, -1, 0.0
        if level == 0 and self.first >= 0 and len(np.unique(x[:, self.first])) == 2:
            best, feature, cut = np.inf, self.first, 0.5
        parent = p * (1 - p)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, cw, cy = x[order, f], np.cumsum(w[order]), np.cumsum((y * w)[order])
            ok = np.flatnonzero((v[1:] > v[:-1])) + 1
            ok = ok[(ok >= self.leaf) & (ok <= len(y) - self.leaf)]
            if not len(ok):
                continue
            lw, ly = cw[ok - 1], cy[ok - 1]
            rw, ry = cw[-1] - lw, cy[-1] - ly
            gain = parent - (ly * (1 - ly / lw) + ry * (1 - ry / rw)) / cw[-1]
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, feature, cut = float(gain[k]), f, float((v[ok[k]] + v[ok[k] - 1]) / 2)
        if feature < 0:
            return at
        left = x[:, feature] <= cut
        a = self._grow(x[left], y[left], w[left], level + 1)
        b = self._grow(x[~left], y[~left], w[~left], level + 1)
        self.nodes[at] = (feature, cut, a, b, p)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            feature, cut, a, b, p = self.nodes[at]
            if feature < 0 or not len(rows):
                out[rows] = p
                continue
            left = x[rows, feature] <= cut
            stack += [(a, rows[left]), (b, rows[~left])]
        return out


def labelled(pages: list[tuple[str | None, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of (title, page) whose holding element says its role; of pages that have both roles.

    Every page counts twice, the second time without its holding elements, so that the tree also learns what to do with flat pages and bare lines.
    """
    xs, ys = [], []
    for title, page in pages:
        blocks = visible(page)
        y = [label_of(b.hold) for b in blocks]
        if 0 not in y or 1 not in y:
            continue
        x = features_of(blocks, title or "")
        keep = [k for k, v in enumerate(y) if v is not None]
        bare = features_of([b._replace(hold="", path="") for b in blocks], title or "")
        xs += [x[keep], bare[keep]]
        ys += [np.array([y[k] for k in keep])] * 2
    if not xs:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0)
    return np.concatenate(xs), np.concatenate(ys)


def visible(page: str) -> list[Block]:
    return [b for b in blocks_of(page) if b.tag != "title" and "noscript" not in b.path]


def _label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The features of all labelled blocks of a page, and their labels."""
    for batch in batches:
        rows = []
        for key, title, page in zip(batch["row_key"], batch["title"], batch["page"]):
            x, y = labelled([(title, page)])
            if len(y):
                rows.append((key, x.astype("<f4").tobytes(), y.astype("i1").tobytes()))
        yield pd.DataFrame(rows, columns=["row_key", "x", "y"])


def fit_tree(crawl: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Tree | None:
    """The tree, grown on the driver from the labelled blocks of about ``sample_pages`` pages; none if they label nothing. Pages are read on the executors, numbers alone leave them."""
    sample = hash_sample(crawl.where("page is not null and row_key is not null").select("row_key", "title", "page"), "row_key", sample_pages)
    rows = sorted(map_texts(sample, _label, "row_key string, x binary, y binary").collect(), key=lambda r: (r["row_key"], bytes(r["x"])))  # at most twice sample_pages
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, len(FEATURES)) for r in rows] or [np.zeros((0, len(FEATURES)), np.float32)])
    y = np.concatenate([np.frombuffer(r["y"], "i1") for r in rows] or [np.zeros(0, "i1")])
    return Tree(first=FEATURES.index("flat")).fit(x, y) if len(y) else None


def _lines_of(text: str, page: str | None, title: str | None, tree: Tree | None) -> np.ndarray:
    """Whether each line of the text is main body."""
    lines = text.split("\n")
    if page and "<" not in page:  # a plain file has no furniture
        return np.array([bool(_KEY.sub("", x)) for x in lines])
    blocks = visible(page) if page else []
    if not blocks:
        blocks = [Block(x, "h1" if not k else "p", len(x.split()), 0, "", "", 0) for k, x in enumerate(lines)]
    x = features_of(blocks, title or "")
    main = tree.predict(x) >= 0.5 if tree else (x[:, 0] >= 8) & (x[:, 3] < 0.5)
    keys: dict[str, list[int]] = {}
    flat, starts = [], []
    size = 0
    for k, b in enumerate(blocks):
        key = _KEY.sub("", b.text.lower())
        keys.setdefault(key, []).append(k)
        flat.append(key)
        starts.append(size)
        size += len(key)
    joined = "".join(flat)
    out = np.zeros(len(lines), bool)
    last = reached = 0
    begins: set[str] | None = None  # how the text goes on at any place, so that lines that stand nowhere need no search
    for n, line in enumerate(lines):
        key = _KEY.sub("", line.lower())
        if not key:
            continue
        at = keys.get(key)
        if at:
            k = next((i for i in at if i >= last), at[-1])
            last = max(last, k)
            out[n] = main[k]
            continue
        if begins is None:
            begins = {joined[i : i + BEGIN] for i in range(len(joined))}
        found = -1
        if key[:BEGIN] in begins or len(key) < BEGIN:
            found = joined.find(key, reached)
            found = joined.find(key) if found < 0 else found
        if found >= 0:
            reached = found
            a = int(np.searchsorted(starts, found, side="right")) - 1
            b = int(np.searchsorted(starts, found + len(key) - 1, side="right")) - 1
            out[n] = main[a : b + 1].mean() >= 0.5
        else:
            out[n] = len(line) >= 40 and bool(_END.search(line))
    return out


def _classify(tree: Tree | None, clean: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, numbers, texts = [], [], []
            for key, text, page, title in zip(batch["row_key"], batch["text"], batch["page"], batch["title"]):
                main = _lines_of(text, page, title, tree)
                if clean:
                    keys.append(key)
                    texts.append("\n".join(x for x, m in zip(text.split("\n"), main) if m))
                else:
                    no = np.flatnonzero(~main) + 1
                    keys.extend([key] * len(no))
                    numbers.extend(no)
            if clean:
                yield pd.DataFrame({"row_key": keys, "main_text": texts})
            else:
                yield pd.DataFrame({"row_key": keys, "line_no": np.array(numbers, dtype="int32")})

    return run


def _joined(processed: DataFrame, crawl: DataFrame) -> DataFrame:
    texts = processed.where("row_key is not null and text is not null").select("row_key", "text")
    pages = crawl.where("row_key is not null and page is not null").select("row_key", "page", "title")
    return texts.join(pages, "row_key", "left")


def furniture_lines(processed: DataFrame, crawl: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """row_key, line_no (from 1) of the lines of the processed texts that are not main body.

    Texts without a page in the crawl are judged by their lines alone; null texts have no lines; a line without letters is not main body; repeated rows
    count once.
    """
    tree = fit_tree(crawl, sample_pages)
    return map_texts(_joined(processed, crawl), _classify(tree, False), "row_key string, line_no int").distinct()


def main_text(processed: DataFrame, crawl: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """row_key, main_text: each processed text reduced to its main body."""
    tree = fit_tree(crawl, sample_pages)
    return map_texts(_joined(processed, crawl), _classify(tree, True), "row_key string, main_text string").distinct()
