"""Near-duplicate texts: pigeonhole blocks over fingerprints, then Hamming distance, then an exact check.

A text's set is its distinct sequences of ``N`` consecutive letters and digits in lower case. Its fingerprint has ``SYMBOLS``
minima of a hashed set, one for each bin of one permutation (empty bins borrow from others by a fixed order). Two texts of similarity J
agree in each symbol with probability J. The fingerprint is split into ``SYMBOLS / ROWS`` blocks; pairs that differ in fewer symbols than there are blocks share at least one for
certain, others nearly always (at J = 0.5 98.4 % of them, at 0.6 99.98 %). Pairs are joined on a block, and pass if their sketches (one bit of each of the same symbols) are within
a Hamming distance that all but 1 in 500 pairs at the threshold keep. What passes is compared exactly on the texts. Equal texts are one
class from the start and are compared once, so no group of copies is ever multiplied out before the result asks for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_texts
from millrace.session import cut, stored

N = 9
SYMBOLS = 256
ROWS = 4
BLOCKS = SYMBOLS // ROWS
#: Of SYMBOLS bits. At J = 0.5 a quarter differs, 64 with a deviation of 6.9.
MAX_DISTANCE = 86
SKETCH = ("s1", "s2", "s3", "s4")
#: Candidate texts up to this many travel as broadcast keys (80 bytes each); beyond it they are joined by shuffle.
BROADCAST_KEYS = 300_000

_OTHER = re.compile(r"[\W_]+")
_POWERS = np.array([pow(0x9E3779B97F4A7C15, N - 1 - i, 1 << 64) for i in range(N)], dtype=np.uint64)


def _probes() -> np.ndarray:
    """For each bin the order in which other bins are tried."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    return np.stack([rng.permutation(SYMBOLS) for _ in range(SYMBOLS)]).astype(np.int16)


_PROBES = _probes()


def canonical(text: str) -> str:
    return _OTHER.sub("", text.lower())


def grams(canon: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the sequences of N characters."""
    codes = np.frombuffer(canon.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - N + 1
    if n < 1:
        return np.empty(0, np.uint64)
    codes = codes * np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for i in range(N):
        h += codes[i : n + i] * _POWERS[i]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def fingerprint(sorted_hashes: np.ndarray) -> np.ndarray:
    """The least hash of each of SYMBOLS equal bins; empty bins take that of the first filled bin in their order."""
    edges = (np.arange(SYMBOLS, dtype=np.uint64)) << np.uint64(64 - SYMBOLS.bit_length() + 1)
    at = np.searchsorted(sorted_hashes, edges)
    end = np.append(at[1:], len(sorted_hashes))
    filled = at < end
    least = sorted_hashes[np.minimum(at, len(sorted_hashes) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        source = _PROBES[empty][np.arange(len(empty)), np.argmax(filled[_PROBES[empty]], axis=1)]
        least[empty] = least[source] + empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return least


_FIRST = np.uint64(0xC2B2AE3D27D4EB4F)


def blocks_and_sketch(least: np.ndarray) -> tuple[np.ndarray, list[int]]:
    mixed = (least ^ (least >> np.uint64(33))) * _FIRST
    parts = mixed.reshape(BLOCKS, ROWS)
    key = np.arange(BLOCKS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = (key ^ parts[:, i]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(31)
    bits = np.packbits(((mixed >> np.uint64(40)) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return key.view(np.int64), bits.tolist()


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for batch in batches:
        keep, a, b, sketches, blocks = [], [], [], [], []
        for k, text in enumerate(batch["text"]):
            canon = canonical(text)
            h = grams(canon)
            if not len(h):
                continue
            d = xxhash.xxh3_128_intdigest(canon.encode("utf-8", "surrogatepass"))
            keys, sketch = blocks_and_sketch(fingerprint(h))
            keep.append(k)
            a.append((d >> 64) - (1 << 63))
            b.append((d & ((1 << 64) - 1)) - (1 << 63))
            sketches.append(sketch)
            blocks.append(keys)
        yield pd.DataFrame(
            {
                "row_key": batch["row_key"].iloc[keep].to_numpy(),
                "th": batch["th"].iloc[keep].to_numpy(),
                "a": np.array(a, np.int64),
                "b": np.array(b, np.int64),
                **dict(zip(SKETCH, np.array(sketches, np.int64).reshape(-1, len(SKETCH)).T)),
                "blocks": pd.Series(blocks, dtype=object),
            }
        )


def _exact(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sims = []
            last, h = None, None
            for x, y in zip(batch["text_x"], batch["text_y"]):
                if x != last:
                    last, h = x, grams(canonical(x))
                g = grams(canonical(y))
                both = len(np.intersect1d(h, g, assume_unique=True))
                sims.append(both / max(1, len(h) + len(g) - both))
            out = batch[["ax", "bx", "ay", "by"]].assign(similarity=sims)
            yield out[out["similarity"] > threshold]

    return run


def _indexed(texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts, the fingerprints of each row, and the blocks of each class."""
    if threshold < 0.5:
        raise ValueError("the blocks are laid out for similarities of 0.5 and above")
    docs = texts.where("row_key is not null and text is not null").select("row_key", "text", F.xxhash64("text").alias("th"))
    indexed = cut(map_texts(docs, _index, "row_key string, th bigint, a bigint, b bigint, s1 bigint, s2 bigint, s3 bigint, s4 bigint, blocks array<bigint>"))
    blocks = (
        indexed.groupBy("a", "b")
        .agg(*(F.first(c).alias(c) for c in (*SKETCH, "blocks")))
        .select("a", "b", *SKETCH, F.explode("blocks").alias("block"))
    )
    return docs, indexed, blocks


def _near(x: str = "x", y: str = "y") -> Column:
    """Whether two sketches are close enough."""
    return sum((F.bit_count(F.col(f"{c}{x}").bitwiseXOR(F.col(f"{c}{y}"))) for c in SKETCH), F.lit(0)) <= MAX_DISTANCE


def _side(blocks: DataFrame, end: str, *more: str) -> DataFrame:
    return blocks.select(*more, *[F.col(c).alias(f"{c}{end}") for c in ("a", "b", *SKETCH)])


def _verified(docs: DataFrame, indexed: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Of candidate pairs of classes (ax, bx, ay, by) those whose exact similarity is above the threshold, with it."""
    wanted = pairs.select(F.col("ax").alias("a"), F.col("bx").alias("b")).union(pairs.select("ay", "by")).distinct()
    holders = indexed.groupBy("a", "b").agg(F.min(F.struct("row_key", "th")).alias("_m")).join(wanted, ["a", "b"])
    holders = cut(holders.select("a", "b", "_m.row_key", "_m.th"))
    n = holders.count()
    small = F.broadcast(holders) if n <= BROADCAST_KEYS else holders
    found = docs.join(small, ["row_key", "th"]).groupBy("a", "b").agg(F.min("text").alias("text"))
    texts_of = (
        pairs.join(found.select(F.col("a").alias("ax"), F.col("b").alias("bx"), F.col("text").alias("text_x")), ["ax", "bx"])
        .join(found.select(F.col("a").alias("ay"), F.col("b").alias("by"), F.col("text").alias("text_y")), ["ay", "by"])
    )
    return map_texts(texts_of, _exact(threshold), "ax bigint, bx bigint, ay bigint, by bigint, similarity double")


def similar_classes(texts: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(members, links) of a table with row_key and text.

    members: row_key, a, b, where (a, b) is the 128-bit id of the row's canonical text; equal texts share it. links: ax, bx, ay, by, similarity, one
    row for each pair of classes whose exact Jaccard similarity is above ``threshold`` (0.5 or more). Null texts and
    texts with fewer than ``N`` letters and digits have an empty set and belong to no class. Empty input gives empty results.
    """
    docs, indexed, blocks = _indexed(texts, threshold)
    members = indexed.select("row_key", "a", "b").distinct()
    pairs = cut(
        _side(blocks, "x", "block").join(_side(blocks, "y", "block"), "block")
        .where("ax < ay or (ax = ay and bx < by)")
        .where(_near())
        .select("ax", "bx", "ay", "by")
        .distinct()
    )
    return members, _verified(docs, indexed, pairs, threshold)


def similar_pairs(texts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """row_key_a < row_key_b, similarity of every pair of different row_key whose texts are similar, copies multiplied out."""
    members, links = similar_classes(texts, threshold)
    m = members
    left = m.select(F.col("row_key").alias("ka"), F.col("a").alias("ax"), F.col("b").alias("bx"))
    right = m.select(F.col("row_key").alias("kb"), F.col("a").alias("ay"), F.col("b").alias("by"))
    across = links.join(left, ["ax", "bx"]).join(right, ["ay", "by"]).select("ka", "kb", "similarity")
    within = left.join(right, [F.col("ax") == F.col("ay"), F.col("bx") == F.col("by")]).where("ka < kb").select("ka", "kb", F.lit(1.0).alias("similarity"))
    return (
        across.unionByName(within)
        .where("ka <> kb")
        .select(F.least("ka", "kb").alias("row_key_a"), F.greatest("ka", "kb").alias("row_key_b"), "similarity")
        .distinct()
    )


def _name(a: str, b: str) -> Column:
    return F.concat(F.hex(a), F.hex(b))


def _components(links: DataFrame, max_rounds: int) -> DataFrame:
    """n, label: the least class id that each linked class reaches, by passing labels along edges until nothing changes, with pointer jumping; cut at each round."""
    edges = cut(links.select(_name("ax", "bx").alias("u"), _name("ay", "by").alias("v")))
    edges = edges.union(edges.select("v", "u"))
    label = cut(edges.select(F.col("u").alias("n")).distinct().withColumn("label", F.col("n")))
    for _ in range(max_rounds):
        least = edges.join(label, edges.v == label.n).groupBy(F.col("u").alias("n")).agg(F.min("label").alias("m"))
        step = label.join(least, "n", "left").select("n", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("n").alias("label"), F.col("label").alias("up"))
        after = cut(step.join(jump, "label", "left").select("n", F.least("label", F.coalesce("up", "label")).alias("label"), "old"))
        changed = after.where("label <> old").limit(1).count()
        label = after.select("n", "label")
        if not changed:
            return label
    raise RuntimeError("links did not close within max_rounds")


def near_duplicate_groups(texts: DataFrame, threshold: float = 0.5, max_rounds: int = 50) -> DataFrame:
    """One row per row_key with a text: row_key, group_id (least class id reachable over similar classes, as text), class_id.

    The groups are those of all links, but a group of n classes is not compared pair by pair: first each class meets the least class of each of its blocks, then only classes that share
    a block and are still in different groups meet. No link between groups is lost, and a block full of near-copies costs its size, not its square.
    """
    docs, indexed, blocks = _indexed(texts, threshold)
    nodes = cut(indexed.select("row_key", _name("a", "b").alias("class_id")).distinct())
    sketches = cut(indexed.groupBy("a", "b").agg(*(F.first(c).alias(c) for c in SKETCH)))
    keys = blocks.select("block", "a", "b")

    def near(pairs: DataFrame) -> DataFrame:
        """Candidate pairs whose sketches are close."""
        x, y = (sketches.select(*[F.col(c).alias(f"{c}{end}") for c in ("a", "b", *SKETCH)]) for end in "xy")
        return cut(pairs.distinct().join(x, ["ax", "bx"]).join(y, ["ay", "by"]).where(_near()).select("ax", "bx", "ay", "by"))

    first = keys.groupBy("block").agg(F.min(F.struct("a", "b")).alias("_r"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = stored(keys.join(first, "block").select("block", "a", "b", F.col("_r.a").alias("ax"), F.col("_r.b").alias("bx")))  # blocks of one class are done with
    star = near(shared.where("not (a = ax and b = bx)").select("ax", "bx", F.col("a").alias("ay"), F.col("b").alias("by")))
    links = cut(_verified(docs, indexed, star, threshold).select("ax", "bx", "ay", "by"))
    group = _components(links, max_rounds)
    named = sketches.select("a", "b", _name("a", "b").alias("n")).join(group, "n", "left").select("a", "b", F.coalesce("label", "n").alias("group"))
    grouped = shared.select("block", "a", "b").join(named, ["a", "b"])
    apart = grouped.groupBy("block").agg(F.min("group").alias("_l"), F.max("group").alias("_h")).where("_l <> _h").select("block")
    open_blocks = stored(grouped.join(apart, "block", "left_semi"))
    sides = open_blocks.select("block", "group").distinct()
    meet = sides.join(sides.select("block", F.col("group").alias("other")), "block").where(F.col("group") < F.col("other"))
    rest = near(
        meet.join(open_blocks.select("block", "group", F.col("a").alias("ax"), F.col("b").alias("bx")), ["block", "group"])
        .join(open_blocks.select("block", F.col("group").alias("other"), F.col("a").alias("ay"), F.col("b").alias("by")), ["block", "other"])
        .select("ax", "bx", "ay", "by")
    ).join(star, ["ax", "bx", "ay", "by"], "left_anti")
    rest = cut(rest)
    more = _verified(docs, indexed, rest, threshold).select("ax", "bx", "ay", "by")
    label = _components(links.union(more), max_rounds)
    return nodes.join(label.select(F.col("n").alias("class_id"), "label"), "class_id", "left").select("row_key", F.coalesce("label", "class_id").alias("group_id"), "class_id")
