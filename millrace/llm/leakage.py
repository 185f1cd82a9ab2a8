"""Evaluation passages inside corpus documents, found by spaced-seed hashing.

Fixed masks over ``SPAN`` consecutive words keep some positions and ignore the others, so that a hit survives a replaced word
wherever one of the masks ignores it. The hashes of all windows of the test items meet those of all windows of the
documents; around every hit the overlap is extended in both directions along its diagonal, tolerating substitutions, and the longest run
of equal words is measured exactly. Any run of ``SPAN`` equal words hits under every mask, so none is missed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_texts

SPAN = 10
#: 1 marks a position that counts. Each mask starts and ends on one; together they tolerate any single substitution inside a span.
MASKS = ("1110111011", "1101101111", "1011110111")
#: Items up to this many words in all travel to the executors as one array (24 bytes a window); beyond it the windows are joined by shuffle.
BROADCAST_WORDS = 2_000_000
#: Beyond it, seeds of documents that no item has are dropped before the shuffle by a bitmap of so many bits (8 MB), whatever the number of items.
FILTER_BITS = 1 << 26

_WORD = re.compile(r"[^\W_]+")
_MIX = np.array([int(xxhash.xxh3_64_intdigest(f"position {i}")) | 1 for i in range(SPAN)], dtype=np.uint64)
OUT = "doc_id bigint, item_id bigint, longest_run int, overlap int, substitutions int, item_words int"


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFKD, without combining marks, case folded."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    return _WORD.findall(text.casefold())


class _Hasher:
    """Word to 64-bit number, remembering up to ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        self.seen: dict[str, int] = {}
        self.limit = limit

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.limit:
            seen.clear()
        out = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def _seeds(hashes: np.ndarray, mask: int) -> np.ndarray:
    """The hash of every window under one mask."""
    n = len(hashes) - SPAN + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, kept in enumerate(MASKS[mask]):
        if kept == "1":
            total += hashes[i : n + i] * _MIX[i]
    return (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * mask)


def overlap(doc: np.ndarray, item: np.ndarray, at_doc: int, at_item: int, slack: int = 2) -> tuple[int, int, int, int]:
    """Extends one hit along its diagonal: longest run, words of the tolerant overlap, substitutions in it, its last position in doc.

    The overlap goes on over at most ``slack`` consecutive different words and ends on equal ones.
    """
    back = min(at_doc, at_item)
    d, i = doc[at_doc - back :], item[at_item - back :]
    n = min(len(d), len(i))
    same = d[:n] == i[:n]
    breaks = np.flatnonzero(~same)
    edges = np.concatenate(([-1], breaks, [n]))
    longest = int(np.diff(edges).max() - 1)
    low = high = back + int(np.argmax(same[back:])) if same[back:].any() else back
    gap = 0
    for k in range(low, -1, -1):
        if same[k]:
            low, gap = k, 0
        elif (gap := gap + 1) > slack:
            break
    gap = 0
    for k in range(high, n):
        if same[k]:
            high, gap = k, 0
        elif (gap := gap + 1) > slack:
            break
    inside = same[low : high + 1]
    return longest, int(inside.sum()), int((~inside).sum()), at_doc - back + high


def compare(doc: np.ndarray, item: np.ndarray, hits: list[tuple[int, int]], min_overlap: int) -> tuple[int, int, int] | None:
    """The best of all hits between one document and one item, or none: longest run, overlap, substitutions."""
    longest = best = subs = 0
    done: dict[int, int] = {}
    for q, p in sorted(hits):
        if done.get(q - p, -1) >= q:
            continue
        run, size, wrong, end = overlap(doc, item, q, p)
        done[q - p] = end
        longest = max(longest, run)
        if (size, -wrong) > (best, -subs):
            best, subs = size, wrong
    return (longest, best, subs) if max(best, longest) >= min_overlap else None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in OUT.split(", ")]
    return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype="int64" if k < 2 else "int32") for k, n in enumerate(names)})


def _item_index(items: list[tuple[int, str]]):
    hasher = _Hasher()
    hashed = [hasher(words_of(t)) for _, t in items]
    keys, owners, places = [], [], []
    for k, h in enumerate(hashed):
        for m in range(len(MASKS)):
            s = _seeds(h, m)
            keys.append(s)
            owners.append(np.full(len(s), k, np.int64))
            places.append(np.arange(len(s)))
    keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    order = np.argsort(keys, kind="stable")
    return hashed, keys[order], np.concatenate(owners)[order] if len(keys) else keys, np.concatenate(places)[order] if len(keys) else keys


def _scan(index, ids_of: list[int], min_overlap: int):
    """Documents against the broadcast index of all items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed, keys, owners, places = index.value
        hasher = _Hasher()
        for batch in batches:
            out = []
            ids, docs = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if text:
                    ids.append(doc_id)
                    docs.append(words_of(text))
            if docs and len(keys):
                bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
                flat = hasher([w for d in docs for w in d])
                hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for m in range(len(MASKS)):
                    s = _seeds(flat, m)
                    if not len(s):
                        continue
                    low = np.searchsorted(keys, s)
                    found = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == s)
                    which = np.searchsorted(bounds, found, side="right") - 1
                    for q, d in zip(found, which):
                        if q + SPAN > bounds[d + 1]:
                            continue
                        j = low[q]
                        while j < len(keys) and keys[j] == s[q]:
                            hits.setdefault((int(d), int(owners[j])), []).append((int(q - bounds[d]), int(places[j])))
                            j += 1
                for (d, k), where in hits.items():
                    if got := compare(flat[bounds[d] : bounds[d + 1]], hashed[k], where, min_overlap):
                        out.append((ids[d], ids_of[k], *got, len(hashed[k])))
            yield _frame(out)

    return run


def _bit(seeds: np.ndarray) -> np.ndarray:
    """The place of each seed in the bitmap."""
    return (seeds >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def _bitmap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One bitmap of the seeds of all items of a task."""
    bits = np.zeros(FILTER_BITS, bool)
    hasher = _Hasher()
    for batch in batches:
        for text in batch["text"]:
            h = hasher(words_of(text))
            for m in range(len(MASKS)):
                bits[_bit(_seeds(h, m))] = True
    yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})


def _windows(id_name: str, known=None):
    """Every window of every text as (id, seed); with a broadcast bitmap only those whose bit is set in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher()
        bits = np.unpackbits(np.frombuffer(known.value, np.uint8)).view(bool) if known else None
        for batch in batches:
            ids, seeds = [], []
            for key, text in zip(batch[id_name], batch["text"]):
                h = hasher(words_of(text or ""))
                s = np.unique(np.concatenate([_seeds(h, m) for m in range(len(MASKS))]))
                s = s if bits is None else s[bits[_bit(s)]]
                ids.append(np.full(len(s), key, np.int64))
                seeds.append(s.view(np.int64))
            yield pd.DataFrame({id_name: np.concatenate(ids or [[]]).astype(np.int64), "seed": np.concatenate(seeds or [[]]).astype(np.int64)})

    return run


def _verify(min_overlap: int):
    """Pairs of texts that share a seed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, item_id, passage in zip(batch["doc_id"], batch["text"], batch["item_id"], batch["passage"]):
                hashed, keys, _, places = _item_index([(item_id, passage)])
                doc, hits = _Hasher()(words_of(text)), []
                for m in range(len(MASKS)):
                    for q, s in enumerate(_seeds(doc, m)):
                        j = int(np.searchsorted(keys, s))
                        while j < len(keys) and keys[j] == s:
                            hits.append((q, int(places[j])))
                            j += 1
                if hits and (got := compare(doc, hashed[0], hits, min_overlap)):
                    out.append((doc_id, item_id, *got, len(hashed[0])))
            yield _frame(out)

    return run


def leaked_items(documents: DataFrame, items: DataFrame, min_overlap: int = SPAN, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Which items each document contains: doc_id, item_id, longest_run, overlap, substitutions, item_words.

    A pair comes out if its longest run of equal words or its substitution-tolerant overlap has ``min_overlap`` words (at least
    ``SPAN``; shorter items can't be found). Null or empty texts give no rows, repeated rows one. Documents are read once,
    without a shuffle, while the items have at most ``broadcast_words`` words, measured before they are gathered; beyond that seeds are joined by shuffle.
    """
    if min_overlap < SPAN:
        raise ValueError(f"min_overlap is at least {SPAN}, the span of the seeds")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    tests = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null and item_id is not null").distinct()
    size = tests.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.length("text") / 2)), F.lit(0))).first()[0]
    if size <= broadcast_words:
        rows = [(r["item_id"], r["text"]) for r in tests.collect()]  # bounded by broadcast_words
        index = documents.sparkSession.sparkContext.broadcast(_item_index(rows))  # built once
        return map_texts(docs, _scan(index, [k for k, _ in rows], min_overlap), OUT).distinct()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in tests.select("text").repartition(8).mapInPandas(_bitmap, "bits binary").toLocalIterator():  # 8 bitmaps
        bits |= np.frombuffer(r["bits"], np.uint8)
    known = documents.sparkSession.sparkContext.broadcast(bits.tobytes())
    seeds = tests.mapInPandas(_windows("item_id"), "item_id bigint, seed bigint")
    hits = map_texts(docs, _windows("doc_id", known), "doc_id bigint, seed bigint").join(seeds, "seed").select("doc_id", "item_id").distinct()
    pairs = hits.join(docs, "doc_id").join(tests.withColumnRenamed("text", "passage"), "item_id")
    return map_texts(pairs.select("doc_id", "text", "item_id", "passage"), _verify(min_overlap), OUT).distinct()
