"""Self-join of documents by the Jaccard similarity of word shingles: size-aware, heavy and light.

Sets: distinct hashes (48 bits) of five-word shingles of the lower-cased (A-Z) text. Documents with
equal sets form a class at once; what follows works on classes, keyed by a 64-bit hash of the set
together with its size.

Order: all shingles stand in one global order, rare ones first. The order takes the counts of
shingles that repeat inside some task's documents, the most frequent ``FREQUENT`` of them; any order
gives the right result, this one keeps common passages out of the lists below.

Two sets of sizes s and t that link share at least ceil(3 (s + t) / 7) shingles, so at least
ceil(3 s / 4) of either. Hence, of the first s - ceil(3 s / 4) + k shingles of each, they share k.

* Light sets (up to the boundary) enumerate the pairs (k = 2) among these first shingles; two light
  sets that link have a pair in common.
* Heavy sets are put in the inverted lists of their first shingles (k = 1); so are light sets that
  are large enough to link with a heavy one. Each list is scanned.
* The boundary minimises the cost over the sizes at hand: pairs written for light sets, and entries
  written and scanned (``SCAN`` each) for list members.

In a list or pair bucket two sets are candidates if sizes and the places of the shared shingles let
them reach the overlap. Lists also count: sets of which c listed shingles are shared, and at most b
more in large lists, overlap in c + b plus the rest of the longer one at most, and go if that is too
little. Buckets of up to ``SMALL`` sets give all their candidates. Larger ones, as
groups of near copies make them, first give each set's candidates with a few leaders; once the linked ones
are in components, only candidates of different components are looked at. So a group isn't expanded
into all its pairs, and no link between different components is missed. Buckets of over ``BLOCK`` rows meet
in no task: their leaders come from an aggregation by size level, and their members meet by pairs of blocks.

Candidates are verified by the exact overlap. The result is each document's class and component.

Defined results: a null, empty or blank text has no shingles, links with nothing and is its own
component. Repeated rows are linked. A null doc_id never names a component. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import storage
from .components import connected
from .textops import chunks, mix, owner, positions, shingles, span_hash, words

K = 5
SMALL = 16
SCAN = 4
LEADERS = 2
#: Rows of a bucket that may meet in one task, twice this at most.
BLOCK = 1024
FREQUENT = 1 << 18
#: Shingles of a task whose counts are held at a time.
HELD = 1_500_000
#: Bits of the filter for sets to verify: 16 for each, up to 32 MB.
FILTER_BITS = 1 << 28
#: Bits that a task sets before it gives them out.
FILTER_HELD = 1 << 20
_CHUNK = (1 << 20) - 1
#: Marks the place of an entry in a pair bucket.
_PAIR = 1 << 31
_M48, _M42 = np.uint64((1 << 48) - 1), np.uint64((1 << 42) - 1)


class Sets:
    """Distinct shingles of a chunk's documents: ``tok`` sorted by document, and bounds."""

    def __init__(self, c):
        data, s, e, b = words(c, lower=True)
        sh, sb = shingles(span_hash(data, s, e), b, K)
        packed = np.sort(owner(sb).astype(np.uint64) << np.uint64(48) | sh >> np.uint64(16))
        if len(packed):
            packed = packed[np.append(True, packed[1:] != packed[:-1])]
        self.tok = packed & _M48
        self.bounds = np.searchsorted(packed, np.arange(c.n + 1, dtype=np.uint64) << np.uint64(48))
        self.bounds[-1] = len(packed)
        self.size = np.diff(self.bounds)
        total = np.append(np.uint64(0), np.cumsum(mix(self.tok + np.uint64(1)), dtype=np.uint64))
        self.node = mix(total[self.bounds[1:]] - total[self.bounds[:-1]] + self.size.astype(np.uint64)).view(np.int64)

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of some documents, and bounds."""
        n = self.size[docs]
        return self.tok[positions(self.bounds[:-1][docs], n)], np.append(0, np.cumsum(n))


def _sets(batches):
    for batch in batches:
        for c in chunks(batch.column("text"), _CHUNK, 1 << 15):
            yield batch, c, Sets(c)


class _Fresh:
    """Drops classes that a task has met already."""

    def __init__(self):
        self.met: set[int] = set()

    def __call__(self, x: Sets, ok: np.ndarray) -> np.ndarray:
        out = []
        for d, node in zip(np.flatnonzero(ok).tolist(), x.node[ok].tolist(), strict=True):
            if node not in self.met:
                self.met.add(node)
                out.append(d)
        if len(self.met) > 200_000:
            self.met.clear()
        return np.array(out, np.int64)


def class_rows(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, node (the class) and n (set size) of each document."""
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches):
        for batch, c, x in _sets(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(c.first, c.n) for k in keep), pa.array(x.node), pa.array(x.size.astype(np.int64))], [*keep, "node", "n"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, node long, n long")


def frequent_shingles(docs: DataFrame, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (their first 42 bits, sorted) and the level of their frequency, 1 to 63."""

    def run(batches):
        fresh, keys, counts = _Fresh(), np.empty(0, np.uint64), np.empty(0, np.int64)

        def out():
            often = counts >= 2
            yield from pa.table({"tok": keys[often].view(np.int64), "n": counts[often]}).to_batches(max_chunksize=1 << 16)

        held: list[np.ndarray] = []
        for _, _, x in _sets(batches):
            held.append(x.of(fresh(x, x.size > 2))[0] >> np.uint64(6))
            if sum(map(len, held)) > 1 << 19:
                keys, counts = _added(keys, counts, held)
                if len(keys) > HELD:
                    yield from out()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = _added(keys, counts, held)
        yield from out()

    each = docs.select("text").mapInArrow(run, "tok long, n long")
    top = each.groupBy("tok").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tok").limit(limit)
    rows = top.toPandas()
    tok = rows["tok"].to_numpy(np.int64).view(np.uint64)
    level = np.minimum(63, 1 + np.log2(rows["n"].to_numpy(float).clip(1)).astype(np.int64) * 2)
    order = np.argsort(tok)
    return tok[order], level[order].astype(np.uint64)


def _added(keys: np.ndarray, counts: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return keys, counts
    k, n = np.unique(np.concatenate(held), return_counts=True)
    held.clear()
    every, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
    return every, np.bincount(at, np.concatenate([counts, n])).astype(np.int64)


def need(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares with any set it links with: ceil(3 n / 4)."""
    return (3 * n + 3) // 4


def boundary(sizes: list[tuple[int, int]]) -> int:
    """The largest light size, of least cost for (size, number of sets)."""
    if not sizes:
        return 0
    n, count = np.array(sizes, np.float64).T
    two, one = n - np.ceil(0.75 * n) + 2, n - np.ceil(0.75 * n) + 1

    def cost(x: int) -> float:
        listed = n > 0.75 * x
        return float((count * two * (two - 1) / 2)[n <= x].sum() + (1 + SCAN) * (count * one)[listed].sum())

    return min(range(0, 101, 4), key=cost)


def entries(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], light: int) -> DataFrame:
    """``key`` (a list or a pair bucket), ``node``, and ``np``: size and place in one long."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        fresh = _Fresh()
        tok, level = sent.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(tok >> np.uint64(22)).astype(np.int64)] = True
        for _, _, x in _sets(batches):
            docs_ = fresh(x, x.size > 2)
            t, b = x.of(docs_)
            if not len(t):
                continue
            t = t >> np.uint64(6)
            some = np.flatnonzero(maybe[(t >> np.uint64(22)).astype(np.int64)])
            at = np.searchsorted(tok, t[some])
            hit = np.append(tok, np.uint64(0))[at] == t[some]
            rank = np.zeros(len(t), np.uint64)
            rank[some[hit]] = level[at[hit]]
            doc = owner(b)
            key = np.sort(doc.astype(np.uint64) << np.uint64(48) | rank << np.uint64(42) | t) & _M42
            size, node = np.diff(b), x.node[docs_]
            place = np.arange(len(t)) - b[:-1][doc]
            listed = (place < (size - need(size) + 1)[doc]) & (size > 0.75 * light)[doc]
            yield _entry(mix(key[listed] + np.uint64(1 << 50)), node[doc[listed]], size[doc[listed]], place[listed])
            small = np.flatnonzero(size <= light)
            firsts, length = b[:-1][small], (size - need(size) + 2)[small]
            length = np.minimum(length, size[small])
            for j in range(1, int(length.max(initial=0))):
                ok = length > j
                for i in range(j):
                    one, two = key[firsts[ok] + i], key[firsts[ok] + j]
                    yield _entry(mix(mix(one) + two), node[small[ok]], size[small[ok]], np.full(int(ok.sum()), j - 1 | _PAIR))

    return docs.select("text").mapInArrow(run, "key long, node long, np long")


def _entry(key: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(size.astype(np.int64) << 32 | place)], ["key", "node", "np"])


def shared_entries(index: DataFrame) -> DataFrame:
    """Entries of keys that two classes have, with the number of the key's rows."""
    w = Window.partitionBy("key")
    seen = index.withColumn("rows", F.count(F.lit(1)).over(w)).withColumn("lo", F.min("node").over(w)).withColumn("hi", F.max("node").over(w))
    return seen.where("lo <> hi").select("key", "node", "np", "rows")


def possible(na, ia, nb, ib):
    """May sets of these sizes link, if the shingle (or the second of a pair) at these places is the
    first that they share?"""
    enough = (3 * (na + nb) + 6) // 7
    return (75 * np.maximum(na, nb) <= 100 * np.minimum(na, nb)) & (np.minimum(na - ia, nb - ib) >= enough)


def _groups(batches, columns: list[str]):
    """Whole keys of a stream sorted by key: arrays of the columns."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [np.asarray(batch.column(k)) for k in columns]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last or (held and held[-1][0][-1] != cols[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:last] for c in cols], strict=True)]
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


PAIR = "a long, b long, na long, nb long, c long, ok long"


def _pairs(a, b, na, nb, c, ok) -> pa.RecordBatch:
    """Pairs with the smaller node first; equal ones summed (c) and united (ok)."""
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    order = np.lexsort((b, a))
    first = np.flatnonzero(np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))[: len(a)]
    cols = [x[order][first] for x in (a, b, na, nb)]
    if len(a):
        cols += [np.add.reduceat(c[order], first), np.maximum.reduceat(ok[order], first)]
    else:
        cols += [c, ok]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["a", "b", "na", "nb", "c", "ok"])


def first_candidates(shared: DataFrame) -> DataFrame:
    """All candidates of small buckets; candidates with leaders in large ones."""
    few, many = shared.where(F.col("rows") <= BLOCK), shared.where(F.col("rows") > BLOCK)

    def run(batches):
        for key, np_, node in _groups(batches, ["key", "np", "node"]):
            new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node, n, place = key[new], node[new], np_[new] >> 32, np_[new] & _PAIR - 1
            paired = np_[new] & _PAIR > 0
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            count = np.diff(np.append(first, len(key)))
            of = np.repeat(count, count)
            left, right = [], []
            for d in range(1, SMALL):
                i = np.flatnonzero((key[:-d] == key[d:]) & (of[:-d] <= SMALL)) if len(key) > d else np.empty(0, np.int64)
                if not len(i):
                    break
                left.append(i)
                right.append(i + d)
            for f, c in zip(first[count > SMALL].tolist(), count[count > SMALL].tolist(), strict=True):
                for i, j in _led(n[f : f + c], place[f : f + c]):
                    left.append(i + f)
                    right.append(j + f)
            i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
            fit = 75 * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])
            i, j = i[fit], j[fit]
            ok = possible(n[i], place[i], n[j], place[j])
            sure = paired[i] | (of[i] > SMALL)
            keep = ok | ~sure
            i, j, ok, sure = i[keep], j[keep], ok[keep], sure[keep]
            yield _pairs(node[i], node[j], n[i], n[j], (~sure).astype(np.int64), np.where(sure, 2, ok))

    found = _by_key(few.select("key", "node", "np")).mapInArrow(run, PAIR).union(level_candidates(many))
    return _enough(found.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"), F.max("ok").alias("ok")), shared)


def _blocked(shared: DataFrame) -> DataFrame:
    """With the number of a bucket's ``blocks`` and an entry's ``own``."""
    return shared.withColumn("blocks", F.ceil(F.col("rows") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))


def _each_block(name: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias(name)


def level_candidates(many: DataFrame) -> DataFrame:
    """Candidates of buckets too large for a task. Sizes of one level link by their ratio (below 4/3); the
    set of least place leads its level and the next one."""
    sized = _blocked(many).select("key", "node", "blocks", "own", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND(_PAIR - 1).alias("place"))
    sized = sized.withColumn("level", F.floor(F.log("n") / math.log(4 / 3)))
    lead = sized.groupBy("key", "level", "blocks").agg(F.min(F.struct("place", "node", "n")).alias("lead"))
    lead = lead.select("key", "lead", "blocks", F.explode(F.array(F.col("level"), F.col("level") + 1)).alias("level"))
    met = sized.drop("blocks").join(lead.select("key", "lead", "level", _each_block("own")), ["key", "level", "own"]).where("node <> lead.node")
    least, most = F.least("n", "lead.n"), F.greatest("n", "lead.n")
    left = F.least(F.col("n") - F.col("place"), F.col("lead.n") - F.col("lead.place"))
    met = met.where((75 * most <= 100 * least) & (left >= F.floor((3 * (F.col("n") + F.col("lead.n")) + 6) / 7)))
    first = F.col("node") < F.col("lead.node")
    return met.select(
        F.least("node", "lead.node").alias("a"),
        F.greatest("node", "lead.node").alias("b"),
        F.when(first, F.col("n")).otherwise(F.col("lead.n")).alias("na"),
        F.when(first, F.col("lead.n")).otherwise(F.col("n")).alias("nb"),
        F.lit(0).cast("long").alias("c"),
        F.lit(2).cast("long").alias("ok"),
    )


def _enough(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs that shared entries let reach the overlap: ok 2 stands for places in pair buckets or
    large lists, ok 1 for places in small lists, whose count c then has to be enough."""

    def reach(b: Column) -> Column:
        rest = F.greatest("na", "nb")
        return 7 * (F.col("c") + b + F.floor((3 * rest + 3) / 4) - 1) >= 3 * (F.col("na") + F.col("nb"))

    pairs = storage.stage(pairs.where("ok > 0"), "counted-pairs")
    sure = (F.col("ok") == 2) | reach(F.lit(0))
    large = shared.where(F.col("rows") > SMALL).groupBy("node").agg(F.count(F.lit(1)).alias("big"))
    rest = pairs.where(~sure)
    for side in ("a", "b"):
        rest = rest.join(large.select(F.col("node").alias(side), F.col("big").alias(f"big_{side}")), side)
    more = rest.where(reach(F.least("big_a", "big_b")))
    return pairs.where(sure).select("a", "b").union(more.select("a", "b"))


def _led(n: np.ndarray, place: np.ndarray):
    """(leader, led) pairs of a large bucket. The sets with the fewest rare shingles before the shared
    one lead: a set that can link with any other at all is likeliest to link with those. Each size
    that the leaders can't link with gets leaders of its own."""
    order = np.argsort(place, kind="stable")
    free = np.ones(len(n), bool)
    while free.any():
        at = order[free[order]]
        near = (75 * np.maximum(n[at[0]], n[at]) <= 100 * np.minimum(n[at[0]], n[at]))
        for lead in at[near][:LEADERS]:
            rest = at[near][at[near] != lead]
            yield np.full(len(rest), lead), rest
        free[at[near]] = False


def _by_key(df: DataFrame) -> DataFrame:
    return df.repartition("key").sortWithinPartitions("key", "np", "node")


def more_candidates(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """Candidates of large buckets whose sets are in different components."""
    big = _blocked(shared.where(F.col("rows") > SMALL)).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = big.groupBy("key", "blocks").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    met = big.join(mixed.select("key", _each_block("own")), ["key", "own"], "left_semi").select("*", _each_block("other"))
    # 2: the whole bucket, 1: a block with itself, 0: two blocks
    kind = F.when(F.col("blocks") == 1, 2).when(F.col("own") == F.col("other"), 1).otherwise(0).cast("long").alias("kind")
    met = met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "np", "comp", "own", kind)

    def run(batches):
        for cols in _groups(batches, ["key", "np", "node", "comp", "own", "kind"]):
            cuts = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
            for _, np_, node, comp, own, kind in zip(*(np.split(c, cuts) for c in cols), strict=True):
                new = np.append(True, node[1:] != node[:-1])
                node, comp, own, kind = node[new], comp[new], own[new], kind[new]
                n, place = np_[new] >> 32, np_[new] & _PAIR - 1
                if (comp == comp[0]).all() or (len(node) <= SMALL and kind[0] == 2):
                    continue
                for lo in range(0, len(node), 256):  # blocks of rows; sizes ascend
                    hi = min(lo + 256, len(node))
                    end = int(np.searchsorted(n, n[hi - 1] * 100 // 75, "right"))
                    i, j = np.arange(lo, hi)[:, None], np.arange(lo, end)[None, :]
                    ok = (i < j) & (comp[i] != comp[j]) & ((kind[i] > 0) | (own[i] != own[j])) & possible(n[i], place[i], n[j], place[j])
                    x, y = np.nonzero(ok)
                    if len(x):
                        one = np.ones(len(x), np.int64)
                        yield _pairs(node[x + lo], node[y + lo], n[x + lo], n[y + lo], one, one)

    return _by_key(met).mapInArrow(run, PAIR).select("a", "b").distinct()


def _filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter with two hashes of rows (node, doc_id), or-ed together from tasks' filters by slices."""
    bits = 1 << int(np.clip(np.ceil(np.log2(16 * max(1, nodes.count()))), 16, np.log2(FILTER_BITS)))
    slices = max(1, bits >> 20)

    def packed(held: list[np.ndarray]):
        """The slices in which bits are set, from the bits' sorted numbers."""
        at, size = np.unique(np.concatenate(held)), bits // slices
        for some in np.split(at, np.flatnonzero(np.diff(at // size)) + 1):
            part = np.zeros(size, bool)
            part[some % size] = True
            yield pa.RecordBatch.from_arrays([pa.array([int(some[0] // size)]), pa.array([np.packbits(part).tobytes()], pa.binary())], ["slice", "bits"])

    def own(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            held += _probes(np.asarray(batch.column("node")), np.asarray(batch.column("doc_id")), bits)
            if sum(map(len, held)) > FILTER_HELD:
                yield from packed(held)
                held = []
        if sum(map(len, held)):
            yield from packed(held)

    def merged(batches):
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("slice").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint8)
                got[k] = got[k] | x if k in got else x
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array([x.tobytes() for x in got.values()], pa.binary())], ["slice", "bits"])

    schema = "slice long, bits binary"
    out = np.zeros((slices, bits // slices // 8), np.uint8)
    for r in nodes.mapInArrow(own, schema).repartition(slices, "slice").mapInArrow(merged, schema).collect():
        out[r["slice"]] |= np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _probes(node: np.ndarray, doc_id: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(node.view(np.uint64) + mix(doc_id.view(np.uint64)))
    return [(x & np.uint64(bits - 1)).astype(np.int64) for x in (h, mix(h))]


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_id")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that link, by their exact overlap. Each class's set comes from the row
    of its least doc_id; a filter of those ids keeps the other documents' sets from being written."""
    spark = docs.sparkSession
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    reps = classes.join(nodes.hint("merge"), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    reps = storage.stage(reps.select("node", _key(F.col("doc_id"))), "representatives")
    sent = spark.sparkContext.broadcast(_filter(reps))

    def sets(batches):
        fresh, bits = _Fresh(), sent.value
        for batch, c, x in _sets(batches):
            ids = np.asarray(batch.column("doc_id").slice(c.first, c.n))
            ok = x.size > 0
            for p in _probes(x.node, ids, 8 * len(bits)):
                ok &= (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
            own = fresh(x, ok)
            t, b = x.of(own)
            raw = np.ascontiguousarray(t[:, None].view(np.uint8)[:, :6]).tobytes()
            at = (6 * b).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x.node[own]), pa.array([raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "toks"])

    def overlap(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                s, t = _unpacked(x), _unpacked(y)
                both = np.sort(np.concatenate([s, t]))
                same = int((both[1:] == both[:-1]).sum())
                out.append(100 * same >= 75 * (len(s) + len(t) - same))
            ok = pa.array(out, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    held = storage.stage(docs.select(_key(F.col("doc_id")), "text").mapInArrow(sets, "node long, toks binary"), "shingle-sets")
    if held.count() > 1.2 * reps.count():  # rows with one doc_id and text, again and again
        held = storage.stage(held.dropDuplicates(["node"]), "shingle-sets")
    one = pairs.select("a", "b").hint("merge").join(held.select(F.col("node").alias("b"), F.col("toks").alias("tb")), "b")
    both = one.hint("merge").join(held.select(F.col("node").alias("a"), F.col("toks").alias("ta")), "a")
    links = storage.stage(both.mapInArrow(overlap, "a long, b long"), "links")
    storage.drop(held)
    return links


def _unpacked(x: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64)[:, 0]


def link_classes(spark: SparkSession, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node`` and ``comp`` of each class that links with another one."""
    sizes = classes.select("node", "n").distinct().where("n > 2").groupBy("n").count().collect()  # a row for each size
    light = boundary([(r.n, r["count"]) for r in sizes])
    index = entries(docs, frequent_shingles(docs), light)
    shared = storage.stage(shared_entries(index), "shared-entries")
    first = storage.stage(first_candidates(shared), "candidates")
    links = verified(docs, first, classes)
    comps = storage.stage(connected(links), "components")
    if not shared.where(F.col("rows") > SMALL).isEmpty():
        more = storage.stage(more_candidates(shared, comps).join(first, ["a", "b"], "left_anti"), "candidates")
        if not more.isEmpty():
            again = verified(docs, more, classes)
            comps = storage.stage(connected(links.union(again)), "components")
    storage.drop(shared)
    return comps


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark = docs.sparkSession
    classes = storage.stage(class_rows(docs), "classes")
    comps = link_classes(spark, docs, classes)
    some = classes.where("n > 0").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    low = some.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = some.join(low, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(classes.where("n = 0").select("doc_id", "n", "doc_id"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(storage.read(spark, sf_dir, "documents"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one of least doc_id (null last), of several with that id one.
    Documents without words are all kept. Rows alike in all columns are one. Rows are told apart by hashes
    of the whole row, so repeated or null ids neither lose a component nor leave a copy."""
    cols, key = docs.columns, storage.ROW_KEY
    keyed = storage.row_keyed(docs)
    classes = storage.stage(class_rows(keyed, ("doc_id", *key)), "classes")
    comps = link_classes(spark, docs, classes)
    some = classes.where("n > 0").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = some.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *key)).alias("k"))
    kept = storage.stage(first.select(*(f"k.{k}" for k in key)).union(classes.where("n = 0").select(*key).distinct()), "kept-documents")
    # the kept keys grow with the corpus: the join shuffles, at any size; rows of a key then stand together
    return keyed.join(kept.hint("merge"), key, "left_semi").dropDuplicates(key).select(*cols)


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS sh FROM d),
n AS (SELECT rid, doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
u AS (SELECT rid, unnest(sh) AS x FROM s),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.rid < b.rid GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b
  WHERE 100 * c >= 75 * (na.n_shingles + nb.n_shingles - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(rid, reach) AS (SELECT rid, rid FROM n UNION SELECT r.rid, both_ways.b FROM r JOIN both_ways ON r.reach = both_ways.a)
SELECT n.doc_id, n.n_shingles, min(m.doc_id) AS component_id
FROM n JOIN r USING (rid) JOIN n m ON m.rid = r.reach GROUP BY n.rid, n.doc_id, n.n_shingles
"""
