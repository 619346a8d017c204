"""Benchmark decontamination with SimHash over item-sized windows.

Words are lower-cased (A-Z) runs of letters, digits and bytes beyond ASCII; punctuation is no part of
them. An item's or window's shingles are its ``K``-word runs (all its words as one, if fewer). A
shingle weighs 1 / (number of items that hold it), so what many items share counts for less.

1. Each item has a ``BITS``-bit SimHash of its shingles, each with the square root of its weight; an item that shares a shingle with
   another one has a second one, in which all weigh the same. With square roots the cosine of two bags is at least
   2 J / (1 + J) for a weighted Jaccard J, whatever the weights are, so that one radius serves for all of them.
   ``HammingIndex`` cuts fingerprints into blocks; two within ``RADIUS`` bits agree in some
   block to within RADIUS // blocks bits, and each block's table lists, for each value of the block, the
   items that near to it.
   An item of fewer than ``K`` words is one shingle, so only windows of the very same words reach the
   threshold; those are looked up by hash in every document.
2. A document's window, for an item of L words, is any L words in a row (all words of a shorter
   document). A window reaches the threshold only if shingles of items make up three quarters of it, by
   weight or by number; other windows aren't fingerprinted, which loses nothing.
3. The index gives the items within the radius of each window's fingerprint. At the threshold the
   expected distance is 44 of 256 bits at most, with a deviation of 6; the radius is 4.5 deviations away, so the share
   of pairs at the very threshold that it misses is a few in a million.
4. Candidates are verified: weighted Jaccard of the shingles with their multiplicities, at least
   ``THRESHOLD``; or else plain Jaccard, at least that. A shingle that no item holds weighs most, so in
   an item that occurs often a single changed word outweighs the rest by far; plain Jaccard finds it.

Items go to the executors in blocks of ``ITEMS`` (a few MB at most); each block is a pass of its own
over the documents, so what is sent is bounded whatever the benchmark's size.

Defined results: null or empty texts have no windows and are clean; null or wordless items match
nothing. Repeated documents and items are handled row by row. Extra columns are ignored. Empty tables
give empty results, or clean documents if there are no items.
"""

from __future__ import annotations

from collections import Counter
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import storage
from .textops import LOWER, chunks, mix, runs, shingles, span_hash

K = 5
THRESHOLD = 0.75
BITS, BLOCKS, RADIUS = 256, 16, 71
ITEMS = 4096

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_shingles(col: pa.Array):
    """For each chunk of texts: the chunk, word bounds, shingle hashes and shingle bounds."""
    for c in chunks(col):
        data = LOWER[c.data]
        s, e, b = runs(_LETTER[data], c.offsets)
        h = span_hash(data, s, e)
        yield c, h, b, *shingles(h, b, K)


@cache
def _bits() -> np.ndarray:
    return np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def signs(h: np.ndarray) -> np.ndarray:
    """A vector of BITS signs for each shingle hash."""
    words = mix(h[:, None] ^ _bits()[None, :])
    return np.unpackbits(words.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").astype(np.int8) * 2 - 1


def simhash(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The fingerprint of one bag of shingles, packed into bytes."""
    return np.packbits(signs(h).T.astype(np.float64) @ weight > 1e-9, bitorder="little")


class HammingIndex:
    """Multi-index over packed fingerprints: exact for all within ``radius`` bits."""

    def __init__(self, prints: np.ndarray, blocks: int = BLOCKS, radius: int = RADIUS):
        self.prints, self.radius, self.near, self.n = prints, radius, radius // blocks, blocks
        own = self._cut(prints)
        #: For each block its distinct values and, for each of them, the items that have it.
        self.tables: list[tuple[np.ndarray, list[np.ndarray]]] = []
        for k in range(blocks):
            order = np.argsort(own[:, k], kind="stable")
            values, first = np.unique(own[order, k], return_index=True)
            self.tables.append((values, np.split(order, first[1:])))

    def _cut(self, prints: np.ndarray) -> np.ndarray:
        parts = prints.reshape(len(prints), self.n, -1).astype(np.int64)
        return (parts << (8 * np.arange(parts.shape[2]))).sum(2)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item) pairs within the radius: those near in some block, then over all bits."""
        mine = self._cut(prints)
        hit = np.zeros((len(prints), len(self.prints)), bool)
        for k, (values, members) in enumerate(self.tables):
            near = np.bitwise_count(values[None, :] ^ mine[:, k][:, None]) <= self.near
            for row, v in zip(*np.nonzero(near), strict=True):
                hit[row, members[v]] = True
        rows, items = np.nonzero(hit)
        near = np.bitwise_count(self.prints[items] ^ prints[rows]).sum(1) <= self.radius
        return rows[near], items[near]


class Items:
    """Benchmark items ready for search."""

    def __init__(self, ids: list, texts: list, df: dict[int, int] | None = None):
        self.ids, self.bags, self.lengths = [], [], []
        n = 0
        for _, _, wb, sh, sb in word_shingles(pa.array(texts, pa.string())):
            for i in range(len(wb) - 1):
                if wb[i + 1] > wb[i]:
                    self.ids.append(ids[n])
                    self.bags.append(Counter(sh[sb[i] : sb[i + 1]].tolist()))
                    self.lengths.append(int(wb[i + 1] - wb[i]))
                n += 1
        self.df = df if df is not None else Counter(x for b in self.bags for x in b)
        self.known = np.array(sorted({x for b in self.bags for x in b}), np.uint64)
        self.holders: dict[int, set[int]] = {}
        for i, b in enumerate(self.bags):
            for x in b:
                self.holders.setdefault(x, set()).add(self.lengths[i])
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known >> np.uint64(44)).astype(np.int64)] = True
        #: Items of fewer than K words: for each number of words their hashes in order, and who has each.
        self.short: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for size in range(1, K):
            own = {}
            for i, b in enumerate(self.bags):
                if self.lengths[i] == size:
                    own.setdefault(next(iter(b)), []).append(i)
            if own:
                self.short[size] = np.array(sorted(own), np.uint64), [own[x] for x in sorted(own)]
        #: Items by place in the indexes: by weighted fingerprints all, by plain ones those with a shingle that others hold.
        long = [i for i in range(len(self.bags)) if self.lengths[i] >= K]
        shared = [i for i in long if any(self.df.get(x, 0) > 1 for x in self.bags[i])]
        self.indexes = [(np.array(x, np.int64), HammingIndex(np.array([self._print(self.bags[i], plain) for i in x], np.uint8)), plain) for x, plain in ((long, False), (shared, True)) if x]

    def weight(self, h: np.ndarray) -> np.ndarray:
        return 1.0 / np.maximum(1, [self.df.get(x, 0) for x in h.tolist()])

    def _print(self, bag: Counter, plain: bool) -> np.ndarray:
        h = np.fromiter(bag, np.uint64, len(bag))
        n = np.fromiter(bag.values(), float, len(bag))
        return simhash(h, n if plain else np.sqrt(self.weight(h)) * n)

    def similarity(self, bag: Counter, i: int) -> tuple[float, float]:
        """Weighted and plain Jaccard of a bag and an item's: sum of minima by sum of maxima."""
        mine = self.bags[i]
        every = list({**bag, **mine})
        w = self.weight(np.array(every, np.uint64))
        low, high = (np.array([f(bag[s], mine[s]) for s in every], float) for f in (min, max))
        return float(w @ low / (w @ high)), float(low.sum() / high.sum())

    def _verify(self, bag: Counter, i: int, at: int, found: dict) -> None:
        """A match goes to ``found``; one of weighted Jaccard precedes those of plain Jaccard alone."""
        j, plain = self.similarity(bag, i)
        got = (True, j, at) if j >= THRESHOLD else (False, plain, at)
        if got[1] >= THRESHOLD and got[:2] > found.get(i, (False, 0.0))[:2]:
            found[i] = got

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item holds."""
        if not self.bags:
            return np.empty(0, np.int64)
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.known, h[maybe])
        at[at == len(self.known)] = 0
        return maybe[self.known[at] == h[maybe]]

    def search(self, h: np.ndarray, hits: np.ndarray, words: int) -> dict[int, tuple[float, int]]:
        """The best similarity and its window's first word, for each item that a document holds.
        ``h``: the document's shingles in order; ``hits``: places of known ones; ``words``: its words."""
        found: dict[int, tuple[bool, float, int]] = {}
        sizes = sorted({n for x in set(h[hits].tolist()) for n in self.holders[x]} - set(range(K)))
        if not sizes:
            return {}
        w, known = self.weight(h), np.zeros(len(h))
        known[hits] = 1
        run = lambda x: np.concatenate([[0.0], np.cumsum(x)])
        totals = run(w), run(w * known), run(known)
        for size in sizes:
            width = max(1, min(size, words) - K + 1)  # shingles in a window
            mass, held, count = (c[width:] - c[:-width] for c in totals)
            for ids, index, plain in self.indexes:
                starts = np.flatnonzero(count >= THRESHOLD * width - 1e-6 if plain else held >= THRESHOLD * mass - 1e-6)
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    for cut in range(0, len(part), 4096):  # bounded pieces of a long run
                        n = min(4096, len(part) - cut)
                        self._fingerprinted(h, None if plain else w, int(part[cut]), n, width, size, ids, index, found)
        return {i: x[1:] for i, x in found.items()}

    def _fingerprinted(self, h: np.ndarray, w: np.ndarray | None, lo: int, n: int, width: int, size: int, ids: np.ndarray, index: HammingIndex, found: dict) -> None:
        """Windows lo .. lo + n - 1 through an index; verified matches go to ``found``."""
        part = slice(lo, lo + n + width - 1)
        own, each = h[part], signs(h[part]).astype(np.float64)
        if w is not None:
            each *= np.sqrt(w[part])[:, None]
        total = np.zeros((len(own) + 1, BITS))
        np.cumsum(each, axis=0, out=total[1:])
        prints = np.packbits(total[width:] - total[:-width] > 1e-9, axis=1, bitorder="little")
        for k, i in zip(*map(np.ndarray.tolist, index.search(prints)), strict=True):
            i = int(ids[i])
            if self.lengths[i] == size:
                self._verify(Counter(own[k : k + width].tolist()), i, lo + k, found)

    def short_hits(self, h: np.ndarray, bounds: np.ndarray):
        """(document, item, first word) of windows of a chunk's words (hashes, bounds by document) that are short
        items; a document's first such window of an item comes first."""
        for size, (known, holders) in self.short.items():
            if len(h) < size:
                continue
            w = np.full(len(h) - size + 1, 0x1234567, np.uint64)
            for j in range(size):  # as textops.shingles does for fewer than K words
                w = mix(w * np.uint64(0xFF51AFD7ED558CCD) + h[j : len(h) - size + 1 + j])
            at = np.minimum(np.searchsorted(known, w), len(known) - 1)
            for k in np.flatnonzero(known[at] == w).tolist():
                d = int(np.searchsorted(bounds, k, "right")) - 1
                if k + size <= bounds[d + 1]:
                    yield from ((d, i, k - int(bounds[d])) for i in holders[at[k]])


def _frequencies(benchmark: DataFrame) -> DataFrame:
    """block-wise items with the number of items that hold each of their shingles."""

    def run(batches):
        for batch in batches:
            t = [np.unique(sh[sb[i] : sb[i + 1]]) for _, _, _, sh, sb in word_shingles(batch.column("text")) for i in range(len(sb) - 1)]
            n = np.fromiter(map(len, t), np.int64, len(t))
            flat = np.concatenate(t) if t else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("part")), n), pa.int64()), pa.array(flat.view(np.int64))], ["part", "shingle"])

    return benchmark.select("part", "text").mapInArrow(run, "part long, shingle long")


def item_blocks(benchmark: DataFrame, per_block: int = ITEMS):
    """Blocks of at most about ``per_block`` distinct items, each made on the driver in its turn."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    parts = -(-items.count() // per_block)
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts))))
    if parts > 1:
        each = storage.stage(_frequencies(items), "item-shingles")
        df = storage.stage(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")), "item-frequencies")
    for p in range(parts):
        rows = items.where(F.col("part") == p).orderBy("item_id", "text").collect()
        counts = None
        if parts > 1:
            mine = each.where(F.col("part") == p).select("shingle").distinct().join(df, "shingle").collect()
            counts = {r.shingle & (1 << 64) - 1: r.df for r in mine}
        yield Items([r.item_id for r in rows], [r.text for r in rows], counts)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), per_block: int = ITEMS) -> DataFrame:
    """A row (``keep``, item_id, similarity, at) for each document and item it holds; ``at`` is the
    best window's first word, counted from 0."""
    sc = docs.sparkSession.sparkContext
    narrow = docs.select(*keep, F.col("text").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__text")
    kind = benchmark.schema["item_id"].dataType

    def search(items: Items) -> DataFrame:
        sent = sc.broadcast(items)

        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_type

            for batch in batches:
                items, rows, ids, sims, at = sent.value, [], [], [], []
                for c, wh, wb, sh, sb in word_shingles(batch.column("__text")):
                    hits = items.hits(sh)
                    of = np.searchsorted(sb, hits, "right") - 1
                    short: dict[int, dict[int, tuple[float, int]]] = {}
                    for d, i, k in items.short_hits(wh, wb):
                        short.setdefault(d, {}).setdefault(i, (1.0, k))
                    for d in sorted(short.keys() | set(of.tolist())):
                        found = items.search(sh[sb[d] : sb[d + 1]], hits[of == d] - sb[d], int(wb[d + 1] - wb[d])) | short.get(d, {})
                        for i, (j, k) in sorted(found.items()):
                            rows.append(c.first + d)
                            ids.append(items.ids[i])
                            sims.append(j)
                            at.append(k)
                t = pa.Table.from_batches([batch]).drop(["__text"]).take(pa.array(rows, pa.int64()))
                t = t.append_column("item_id", pa.array(ids, to_arrow_type(kind)))
                yield from t.append_column("similarity", pa.array(sims, pa.float64())).append_column("at", pa.array(at, pa.int64())).to_batches()

        return narrow.mapInArrow(run, f"{fields}, item_id {kind.simpleString()}, similarity double, at long")

    parts = [search(x) for x in item_blocks(benchmark, per_block)]
    if parts:
        return reduce(DataFrame.unionByName, parts)
    return docs.sparkSession.createDataFrame([], f"{fields}, item_id {kind.simpleString()}, similarity double, at long")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Each (document, item) pair of a document that holds a benchmark item; clean ones give no row."""
    return contamination(storage.read(spark, sf_dir, "documents"), storage.read(spark, sf_dir, "benchmark"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows are told apart by hashes of the whole row, so a clean row
    stays whatever other rows share its doc_id, or its lack of one."""
    keyed = storage.row_keyed(docs)
    found = contamination(keyed, storage.read(spark, sf_dir, "benchmark"), keep=tuple(storage.ROW_KEY))
    held = storage.stage(found.select(*storage.ROW_KEY).distinct(), "contaminated")
    return keyed.join(held, storage.ROW_KEY, "left_anti").select(*docs.columns)
