"""Language identification with rank-order n-gram profiles (out-of-place distance).

A text is reduced to lower-cased letters; everything else is one word bound. Its letters, pairs and
triples (with bounds) are counted, and the ``PROFILE`` most frequent, ties by n-gram hash, are its
profile. A language's profile is made the same way from all texts of that language. The distance
sums the differences in rank, with ``PROFILE`` for an n-gram that the language's profile lacks; the
nearest language wins, ties by name. N-grams are carried as 32-bit hashes.

Defined results: a null text, an empty one or one without a letter is ``und`` with score 0; so is
every text if there are no languages to learn from. Rows with a null language teach nothing.
Repeated rows count and are returned row by row. Extra columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import storage
from .textops import Chunk, chunks, mix

PROFILE = 300
UNKNOWN = "und"
#: Bytes of text at a time; n-grams take some 60 times their text's space.
CHUNK_BYTES = 1 << 19
#: Distinct (language, n-gram) counts that a task gathers before it hands them on.
FLUSH = 1_000_000


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def ngrams(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Document number and 32-bit hash of every n-gram of a chunk."""
    cps = np.frombuffer(c.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80, dtype=np.int64)])
    bounds = lead[c.offsets]
    x = np.insert(_letters()[cps], bounds, 0).astype(np.uint64)  # a bound before each document and at the end
    doc = np.repeat(np.arange(c.n + 1, dtype=np.int32), np.append(np.diff(bounds) + 1, 1))
    keep = np.append(True, (x[1:] != 0) | (x[:-1] != 0))
    x, doc = x[keep], doc[keep]
    one = x != 0
    two = one[1:] | one[:-1]
    a, b = x[:-1][two], x[1:][two]
    d2 = np.where(a != 0, doc[:-1][two], doc[1:][two])
    mid = one[1:-1]
    codes = np.concatenate([
        x[one] | np.uint64(1 << 62),
        a << np.uint64(21) | b | np.uint64(1 << 63),
        (x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:])[mid],
    ])
    return np.concatenate([doc[one], d2, doc[1:-1][mid]]), mix(codes) >> np.uint64(32)


def _count(batches):
    """Counts of the n-grams of each language in a task."""
    langs: dict[str, int] = {}
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def out():
        names = np.array(list(langs), object)
        t = pa.table({"lang": pa.array(names[(keys >> np.uint64(32)).astype(int)], pa.string()), "gram": (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), "n": counts})
        return t.to_batches(max_chunksize=1 << 16)

    for batch in batches:
        names = batch.column("lang").dictionary_encode()
        own = np.array([langs.setdefault(x, len(langs)) for x in names.dictionary.to_pylist()], np.uint64)
        codes = own[np.asarray(names.indices)]
        for c in chunks(batch.column("text"), CHUNK_BYTES):
            doc, h = ngrams(c)
            k, n = np.unique(codes[c.first + doc] << np.uint64(32) | h, return_counts=True)
            every, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(every)).astype(np.int64)
            keys = every
            if len(keys) > FLUSH:
                yield from out()
                keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield from out()


def train(docs: DataFrame, profile: int = PROFILE) -> pd.DataFrame:
    """lang, gram, rank: profiles from all rows of ``docs`` (text, lang) with a language and a text.
    The result has at most ``profile`` rows for each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = known.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # Spark limits each task's rows by this filter before they meet, so a language's task gets few
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= profile)
    return top.select("lang", "gram", (F.col("place") - 1).alias("rank")).toPandas()


class Model:
    """Profiles as a matrix of ranks: languages by known n-grams, with a last column for the rest."""

    def __init__(self, profiles: pd.DataFrame, profile: int = PROFILE):
        self.profile = profile
        self.langs = sorted(profiles["lang"].unique())
        self.grams = np.unique(profiles["gram"].to_numpy(np.uint64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int32)
        row = {x: i for i, x in enumerate(self.langs)}
        at = np.searchsorted(self.grams, profiles["gram"].to_numpy(np.uint64))
        self.ranks[profiles["lang"].map(row).to_numpy(int), at] = profiles["rank"].to_numpy(np.int32)

    def predict(self, c: Chunk) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * c.n, np.zeros(c.n)
        doc, gram, rank = top(c, self.profile)
        at = np.searchsorted(self.grams, gram)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        held = np.bincount(doc, minlength=c.n)
        dist = np.empty((len(self.langs), c.n))
        for i in range(len(self.langs)):
            r = self.ranks[i][at]
            dist[i] = np.bincount(doc, np.where(r < 0, self.profile, np.abs(r - rank)), minlength=c.n)
        best = dist.argmin(0)
        score = np.where(held > 0, 1 - dist.min(0) / np.maximum(1, held * self.profile), 0.0)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, held, strict=True)], score


def top(c: Chunk, profile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, n-gram and rank of each document's most frequent n-grams."""
    doc, h = ngrams(c)
    if not len(h):
        z = np.empty(0, np.int64)
        return z, z.astype(np.uint64), z
    keys, n = np.unique(doc.astype(np.uint64) << np.uint64(32) | h, return_counts=True)
    d = (keys >> np.uint64(32)).astype(np.int64)
    first = np.searchsorted(d, np.arange(c.n + 1))
    if n.max() < 1 << 18 and len(n) < 1 << 24:
        packed = d.astype(np.uint64) << np.uint64(42) | (np.uint64((1 << 18) - 1) - n.astype(np.uint64)) << np.uint64(24) | np.arange(len(n), dtype=np.uint64)
        order = (np.sort(packed) & np.uint64((1 << 24) - 1)).astype(np.int64)
    else:
        order = np.lexsort((keys, -n, d))
    rank = np.arange(len(n)) - first[d]
    keep = rank < profile
    order = order[keep]
    return d[keep], keys[order] & np.uint64(0xFFFFFFFF), rank[keep]


def identify(docs: DataFrame, profiles: pd.DataFrame, profile: int = PROFILE, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` with a language and a score, called ``names``, for every row. The profiles are the only
    thing sent to the executors: ``profile`` rows for each language."""
    model = docs.sparkSession.sparkContext.broadcast(Model(profiles, profile))
    narrow = docs.select(*keep, F.col("text").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__text")

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            langs: list[str] = []
            scores = [np.empty(0)]
            for c in chunks(t["__text"], CHUNK_BYTES):
                pred, score = model.value.predict(c)
                langs += pred
                scores.append(score)
            t = t.drop(["__text"]).append_column(names[0], pa.array(langs, pa.string()))
            yield from t.append_column(names[1], pa.array(np.concatenate(scores))).to_batches()

    return narrow.mapInArrow(run, f"{fields}, {names[0]} string, {names[1]} double")


def held_out() -> F.Column:
    """True for every fifth document by CRC; those are kept from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = storage.read(spark, sf_dir, "documents")
    profiles = train(docs.where(~held_out()))
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: What a score must reach in a language of which no training row is recognised.
MIN_SCORE = 0.05
#: Elsewhere it must reach the LOW quantile of the language's own training rows, less SPREADS times its distance
#: to their median and MARGIN at least. Junk among up to a share of LOW of the labelled rows doesn't lower that.
LOW, SPREADS, MARGIN = 0.1, 2, 0.2


def floors(docs: DataFrame, profiles: pd.DataFrame) -> dict[str, float]:
    """The least score of each language, from the rows of ``docs`` (text, lang) that are recognised as their own."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    own = identify(known, profiles, keep=("lang",), names=("__lang", "__score")).where(F.col("lang") == F.col("__lang"))
    rows = own.groupBy("lang").agg(F.percentile_approx("__score", F.array(F.lit(LOW), F.lit(0.5)), 1000).alias("q")).collect()
    return {r.lang: max(MIN_SCORE, r.q[0] - max(SPREADS * (r.q[1] - r.q[0]), MARGIN)) for r in rows}


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters or unlike any language go."""
    learned = docs.where(~held_out())
    profiles = train(learned)
    least = F.lit(MIN_SCORE)
    for lang, x in floors(learned, profiles).items():
        least = F.when(F.col("__lang") == lang, x).otherwise(least)
    cols = docs.columns
    got = identify(docs, profiles, keep=tuple(cols), names=("__lang", "__score"))
    return got.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)).select(*cols)
