"""Mixing sources to target weights by iterative proportional fitting.

Every document is counted in tokens of a public tokenizer and put in a cell of source, language and topic; the topics are fitted on all documents. The cells' token weights are raked in turn to the
language, topic and source marginals, each cell's factor staying within how often its source may be used, and the source marginal comes last and holds exactly. A
document of a cell with factor f is used floor(f) times and once more with probability f - floor(f); the draw orders the documents of a source by a
hash over their probability and stops where the source's tokens are reached, so that the shares come out as asked, up to a document.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_texts
from millrace.session import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that cuts text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOPICS = 8
DIMENSIONS = 256
#: Components of the documents' vectors are whole numbers up to this, so that their sums are exact in any order. As bytes, high byte first, they sort like the vectors.
UNIT, COMPONENT = 65_535, ">u2"
BUCKETS = 4096
#: Languages below this share of the tokens are raked together.
RARE_LANGUAGE = 0.001
#: Bounds of the table of cells that the driver rakes and sends out (about 60 bytes a cell).
MOST_TARGETS, MOST_CELLS = 10_000, 500_000

_WORD = re.compile(r"[^\W\d_]{3,}")


def _vector(text: str) -> bytes:
    """The roots of the counts of a text's hashed words, of length ``UNIT``; zeros where it has none."""
    words = [xxhash.xxh32_intdigest(w) % DIMENSIONS for w in _WORD.findall(text.lower())]
    v = np.sqrt(np.bincount(words, minlength=DIMENSIONS)) if words else np.zeros(DIMENSIONS)
    return np.rint(v * (UNIT / (np.linalg.norm(v) or 1))).astype(COMPONENT).tobytes()


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), COMPONENT).reshape(-1, DIMENSIONS).astype(np.float64)


def _furthest(centres: np.ndarray):
    """Of each task the vector least like its nearest centre, of several the first in order. Texts without words have no place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            x = _matrix(batch["v"])
            near = np.round((x @ centres.T).max(axis=1, initial=0) / UNIT, 9)
            near[~x.any(axis=1)] = np.inf
            at = np.flatnonzero(near == near.min(initial=np.inf))
            if len(at) and near[at[0]] < np.inf:
                found = (float(near[at[0]]), min(batch["v"].iloc[at]))
                best = found if best is None else min(best, found)
        if best is not None:
            yield pd.DataFrame({"near": [best[0]], "v": [best[1]]})

    return run


def _sums(centres: np.ndarray):
    """Of each task the sums of the vectors nearest to every centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(centres.shape, np.int64)
        for batch in batches:
            x = _matrix(batch["v"])
            near = (x @ centres.T).argmax(axis=1)
            for k in range(len(centres)):
                sums[k] += x[near == k].sum(axis=0).astype(np.int64)
        yield pd.DataFrame({"k": range(len(sums)), "sums": list(sums)})

    return run


def fit_topics(vectors: DataFrame, topics: int = TOPICS, rounds: int = 12) -> np.ndarray:
    """Centres of spherical k-means over all vectors ``v`` of texts; the first centres are the texts furthest apart.

    A pass over the vectors finds one of the first centres, and a pass makes one round. Each task sends one vector, or the sums of ``topics`` (2 KB each).
    """
    seeds: list[bytes] = []
    centres = np.zeros((0, DIMENSIONS))
    while len(seeds) < topics:
        found = vectors.mapInPandas(_furthest(centres), "near double, v binary").collect()  # one row a task
        v = min(((r["near"], bytes(r["v"])) for r in found), default=(0, None))[1]
        if v is None or v in seeds:
            break
        seeds.append(v)
        centres = _matrix(pd.Series(seeds))
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    if not seeds:
        return np.zeros((1, DIMENSIONS))
    for _ in range(rounds):
        sums = np.zeros(centres.shape, np.int64)
        for r in vectors.mapInPandas(_sums(centres), "k int, sums array<bigint>").collect():  # as many rows a task as topics
            sums[r["k"]] += np.array(r["sums"], np.int64)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
        if (moved == centres).all():
            break
        centres = moved
    return centres


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _measure(vocabulary: bytes, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        encoding = tiktoken.Encoding("millrace", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            tokens = [len(encoding.encode_ordinary(t)) for t in batch["text"]]
            yield batch[["doc_id", "source", "lang"]].assign(tokens=np.array(tokens, dtype="int64"), v=[_vector(t) for t in batch["text"]])

    return run


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            topic = (_matrix(batch["v"]) @ centres.T).argmax(axis=1).astype("int32")
            yield batch[["doc_id", "source", "lang"]].assign(topic=topic, tokens=batch["tokens"])

    return run


def measured(documents: DataFrame, sources: list[str], tokenizer: str = TOKENIZER, pattern: str = PATTERN, topics: int = TOPICS) -> DataFrame:
    """doc_id, source, lang, topic, tokens of every document with a text and a known source, however source and language are spelt."""
    source = F.lower(F.regexp_replace("source", r"[^\p{L}\p{N}]+", ""))
    lang = F.coalesce(F.nullif(F.lower(F.regexp_extract("lang", r"^\s*([A-Za-z]{2,3})", 1)), F.lit("")), F.lit("und"))
    known = {re.sub(r"[\W_]+", "", s.lower()): s for s in sources}
    name = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[source] if known else F.lit(None).cast("string")
    docs = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), name.alias("source"), lang.alias("lang"), "text").where("source is not null")
    docs = stored(map_texts(docs, _measure(read_vocabulary(tokenizer), pattern), "doc_id bigint, source string, lang string, tokens bigint, v binary"))
    centres = fit_topics(docs.select("v"), topics)
    return docs.mapInPandas(_assign(centres), "doc_id bigint, source string, lang string, topic int, tokens bigint")


def rake(cells: pd.DataFrame, shares: dict[str, float], repeats: dict[str, int], total: float | None = None, temperature: float = 0.8, rounds: int = 60) -> tuple[pd.Series, float]:
    """A factor for every cell (source, lang, topic, tokens) and the total reached.

    Languages aim at their natural share to the power of ``temperature``, topics at their natural share; both give way where a source's cap or share
    forbids them. Without ``total`` the largest mix is made that no cap cuts short.
    """
    have = cells.groupby("source")["tokens"].sum()
    live = {s: p for s, p in shares.items() if p > 0}
    limit = min((repeats[s] * have.get(s, 0) / p for s, p in live.items()), default=0.0)
    total = limit if total is None else min(total, limit)
    cap = cells["source"].map(repeats).to_numpy(float)
    tokens = cells["tokens"].to_numpy(float)
    goal = cells["source"].map(shares).fillna(0).to_numpy(float) * total
    f = np.minimum(cap, goal / np.maximum(1, cells["source"].map(have).to_numpy(float)))

    def scaled(f: np.ndarray, names: pd.Series, aims: dict, exact: bool) -> np.ndarray:
        out = f.copy()
        for name, rows in names.groupby(names).groups.items():
            k = np.asarray(rows)
            aim = aims.get(name, 0.0)
            for _ in range(30 if exact else 1):
                now = (out[k] * tokens[k]).sum()
                if now <= 0 or abs(now - aim) < 1e-9 * max(1.0, aim):
                    break
                out[k] = np.minimum(cap[k], out[k] * aim / now)
            if exact and (rest := aim - (out[k] * tokens[k]).sum()) > 1e-6 * max(1.0, aim):
                room = ((cap[k] - out[k]) * tokens[k]).sum()
                if room > 0:
                    out[k] += (cap[k] - out[k]) * min(1.0, rest / room)
        return out

    cells = cells.reset_index(drop=True)
    natural = cells.groupby("lang")["tokens"].sum() ** temperature
    langs = (natural / natural.sum() * total).to_dict()
    topic = cells.groupby("topic")["tokens"].sum()
    topics = (topic / topic.sum() * total).to_dict()
    sources = {s: p * total for s, p in shares.items()}
    for _ in range(rounds):
        f = scaled(f, cells["lang"], langs, False)
        f = scaled(f, cells["topic"], topics, False)
        f = scaled(f, cells["source"], sources, True)
    return pd.Series(f, index=cells.index), float(total)


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 0, **options) -> DataFrame:
    """doc_id, source, lang, topic, tokens, uses: the documents of the mix and how often each is used (1 or more).

    Documents without text or of no named source are left out. Targets that name no source, or an empty corpus, give an empty mix. Repeated rows of the targets count once; where one
    source has several, its shares add up and the most repeats hold; a null share is 0, null repeats are 1. More than ``MOST_TARGETS`` sources or ``MOST_CELLS`` cells are an error.
    """
    spark = documents.sparkSession
    named = targets.where("source is not null").select("source", "target_share", "max_repeats").distinct().groupBy("source")
    wanted = named.agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).cast("double").alias("share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("most")).limit(MOST_TARGETS + 1).collect()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} sources")
    shares = {r["source"]: r["share"] for r in wanted}
    repeats = {r["source"]: int(r["most"]) for r in wanted}
    docs = stored(measured(documents, list(shares), **options))
    by_lang = docs.groupBy("lang").agg(F.sum("tokens").alias("n"))
    whole = by_lang.agg(F.sum("n")).first()[0] or 0
    common = [r["lang"] for r in by_lang.where(F.col("n") >= RARE_LANGUAGE * whole).collect()]  # at most 1 / RARE_LANGUAGE
    docs = docs.withColumn("group", F.when(F.col("lang").isin(common), F.col("lang")).otherwise(F.lit("other")))
    cells = docs.groupBy("source", "group", "topic").agg(F.sum("tokens").alias("tokens")).limit(MOST_CELLS + 1).toPandas()  # sources x languages x topics
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of source, language and topic")
    if cells.empty:
        return docs.select("doc_id", "source", "lang", "topic", "tokens", F.lit(1).alias("uses")).limit(0)
    cells = cells.sort_values(["source", "group", "topic"]).rename(columns={"group": "lang"}).reset_index(drop=True)
    factor, total = rake(cells, shares, repeats, total_tokens)
    table = spark.createDataFrame(cells.rename(columns={"lang": "group"}).drop(columns="tokens").assign(factor=factor), "source string, group string, topic int, factor double")
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    docs = docs.join(F.broadcast(table), ["source", "group", "topic"])  # at most MOST_CELLS rows
    docs = docs.withColumn("whole", F.floor("factor").cast("int"))
    docs = docs.withColumn("part", F.col("factor") - F.col("whole")).withColumn("rank", F.when(F.col("part") > 1e-9, unit / F.col("part")).otherwise(F.lit(1e18)))
    bucket = F.least(F.floor(F.col("rank") / 2 * BUCKETS), F.lit(BUCKETS)).cast("int")
    sums = docs.groupBy("source", bucket.alias("bucket")).agg(F.sum(F.col("tokens") * F.col("whole")).alias("sure"), F.sum("tokens").alias("tokens")).toPandas()  # sources x BUCKETS
    cuts = []
    for s, g in sums.groupby("source"):
        g = g.sort_values("bucket")
        need = shares.get(s, 0) * total - g["sure"].sum()
        reach = np.concatenate(([0], g.loc[g["bucket"] < BUCKETS, "tokens"].cumsum()))
        edges = np.concatenate(([0], g.loc[g["bucket"] < BUCKETS, "bucket"] + 1)) / BUCKETS * 2
        cuts.append((s, float(np.interp(max(0.0, need), reach, edges)) if len(reach) > 1 else 0.0))
    limits = F.broadcast(spark.createDataFrame(cuts, "source string, cut double"))
    used = docs.join(limits, "source").withColumn("uses", F.col("whole") + (F.col("rank") < F.col("cut")).cast("int"))
    return used.where("uses > 0").select("doc_id", "source", "lang", "topic", "tokens", "uses")


def mix_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens (used, repeats counted), documents, most_uses of every target, also of those nothing was used of."""
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    total = mix.agg(F.sum(F.col("tokens") * F.col("uses"))).scalar()
    zero = F.lit(0).cast("bigint")
    return targets.join(got, "source", "left").select(
        "source", "target_share", (F.coalesce("tokens", zero) / total).alias("actual_share"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses")
    )
