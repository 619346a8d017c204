"""Cross-entropy difference between matched n-gram models.

Tokens are white-space words, A-Z lower-cased, without one stop or comma at the end. The models share
one vocabulary: every word of all documents. (With ``size`` it is that many most frequent words, ties
by hash, and four classes for the rest: with a digit, with another mark, longer than ``LONG`` bytes,
other.)

Both are bigram models with the same smoothing,

    P(w | v) = (c(v, w) + MU P(w)) / (c(v) + MU),   P(w) = (c(w) + 0.5) / (N + 0.5 V),

one of the target documents (label quality 1), one of all documents. They are matched in size too:
background counts are scaled by the ratio of target to background tokens, so neither has an edge
from more evidence. A document's score is its mean loss per token under the target model less that
under the background model; lower is closer to the target.

All counts cover all documents, words and bigrams, and stay distributed:

1. Documents are coded once, in chunks of at most ``CHUNK`` bytes or one document: the hashes of a
   chunk's words, and its documents as places in them.
2. A chunk asks for its distinct words and its distinct bigrams, sorted by hash and cut into ranges. Chunks are the leaves of a
   tree whose nodes have some ``FAN`` children: a node's task gets what its children ask in one range, adds the counts
   up, and asks the same, once, of its own parent, in ranges that are cut further. The root's tasks have the sums of all text; answers go
   down the way that questions came. So a task has some ``FAN`` rows at every level, however many chunks there are and however
   many of them have a word, and a chunk makes at most ``FAN`` / 2 rows of each kind. Up to ``FAN`` chunks there is one level.
3. The answers meet their chunk, which scores its documents.

Only three sums (N of each model and V) reach the driver. Words and bigrams are 64-bit hashes: among
n of them, some two share one with odds of n**2 / 2**65, and then share their counts.

Defined results: a null, empty or blank text has no tokens and null losses and score. A document with
several labels is a target if one of them is 1. Repeated rows count and are returned row by row.
Extra columns are ignored. Without target documents both models are uniform and scores are 0.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import storage
from .textops import Chunk, chunks, mix, owner, span_hash, words

CLASSES = 4
LONG = 12
MU = 50.0
#: Distinct counts that a task gathers before it hands them on.
FLUSH = 1_500_000
#: Bytes of text in a chunk, and for each range of hashes.
CHUNK, RANGE = 8 << 20, 8 << 20
#: Children of a node, on average.
FAN = 256
#: The token before a document's first.
_START = np.uint64(0x9D8F3C5B7A61E24F)

_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of tokens, and bounds by document."""
    data, s, e, b = words(c, lower=True)
    last = data[e - 1] if len(e) else e
    return data, s, e - (((last == 0x2E) | (last == 0x2C)) & (e - s > 1)), b


def _flush(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.concatenate(counts)
    return k, np.stack([np.bincount(at, c[:, j], len(k)) for j in range(c.shape[1])], 1).astype(np.int64)


def _gather(batches, count, names: list[str]):
    """Merge what ``count`` gives for each chunk, and hand on distinct keys of the task."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def out():
        k, n = _flush(keys, counts)
        keys.clear(), counts.clear()
        t = pa.table({names[0]: k.view(np.int64), **{x: n[:, j] for j, x in enumerate(names[1:])}})
        return t.to_batches(max_chunksize=1 << 16)

    for batch in batches:
        for k, n in count(batch):
            keys.append(k)
            counts.append(n)
            if len(keys) >= 8:
                k, n = _flush(keys, counts)
                keys[:], counts[:] = [k], [n]
                if len(k) > FLUSH:
                    yield from out()
    if keys:
        yield from out()


def vocabulary(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the most frequent words of all documents."""

    def count(batch):
        for c in chunks(batch.column("text")):
            data, s, e, _ = tokens(c)
            k, n = np.unique(span_hash(data, s, e), return_counts=True)
            yield k, n[:, None]

    each = docs.select("text").mapInArrow(lambda it: _gather(it, count, ["word", "n"]), "word long, n long")
    top = each.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return np.sort(np.array([r.word for r in top.select("word").collect()], np.int64).view(np.uint64))


def token_hashes(c: Chunk, vocab: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's tokens (a class's number where ``vocab`` lacks the word) and bounds by document."""
    data, s, e, b = tokens(c)
    h = span_hash(data, s, e)
    if vocab is None or not len(s):
        return h, b
    at = np.searchsorted(vocab, h)
    known = np.append(vocab, np.uint64(0))[at] == h
    known &= at < len(vocab)
    digits, marks = (np.concatenate([[0], np.cumsum(t[data], dtype=np.int32)]) for t in (_DIGIT, _MARK))
    kind = np.where(digits[e] > digits[s], 0, np.where(marks[e] > marks[s], 1, np.where(e - s > LONG, 2, 3)))
    return np.where(known, h, kind.astype(np.uint64)), b


def _planes(a: np.ndarray) -> bytes:
    """All first bytes, all second ones and so on, so that the high ones compress away."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(x.T).reshape(-1).view(kind)


def coded(marked: DataFrame, vocab: np.ndarray | None) -> DataFrame:
    """Chunks of documents of ``marked`` (doc_id, text, target): ids, lengths and target flags of the
    documents, the chunk's word hashes by falling frequency, and its tokens as places in them."""
    sent = marked.sparkSession.sparkContext.broadcast(vocab)
    kind = marked.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            goal = batch.column("target").to_numpy(zero_copy_only=False)
            for c in chunks(batch.column("text"), CHUNK):
                h, b = token_hashes(c, sent.value)
                words, at, n = np.unique(h, return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                ids = pa.ListArray.from_arrays(pa.array([0, c.n], pa.int32()), batch.column("doc_id").slice(c.first, c.n))
                blobs = _planes(np.diff(b)), goal[c.first : c.first + c.n].astype(np.uint8).tobytes(), _planes(words[order]), _planes(place[at])
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), ids, *(pa.array([x], pa.binary()) for x in blobs)], ["chunk", "ids", "lengths", "goal", "words", "seq"])

    return storage.stage(marked.mapInArrow(run, f"chunk string, ids array<{kind}>, lengths binary, goal binary, words binary, seq binary"), "coded")


class Coded:
    """A coded chunk: word hashes with the start's at the end, and each token's place, that of the
    token before and its document."""

    def __init__(self, lengths: bytes, words: bytes, seq: bytes):
        self.lengths = _unplanes(lengths, np.int64)
        self.words = np.append(_unplanes(words, np.uint64), _START)
        self.at = _unplanes(seq, np.uint32).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.lengths)])
        self.before = np.concatenate([[len(self.words) - 1], self.at[:-1]])[: len(self.at)]
        self.before[self.bounds[:-1][self.lengths > 0]] = len(self.words) - 1

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigram hashes in order, a token of each, and each token's place in them."""
        pair = mix(mix(self.words)[self.before] * np.uint64(0xFF51AFD7ED558CCD) + self.words[self.at])
        return np.unique(pair, return_index=True, return_inverse=True)


ASKED = "node string, range int, keys binary, counts binary"


def _questions(node: str, keys: np.ndarray, counts: np.ndarray, ranges: int, first: int = 0, last: int | None = None) -> pa.Table:
    """Rows of ASKED: sorted keys with a node's counts of them, cut into the ranges from ``first`` to before ``last`` of
    ``ranges``."""
    last = ranges if last is None else last
    cut = np.searchsorted((keys >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24), np.arange(first, last + 1))
    full = np.flatnonzero(np.diff(cut))
    parts = [slice(cut[p], cut[p + 1]) for p in full]
    return pa.table(
        {
            "node": pa.array([node] * len(full), pa.string()),
            "range": pa.array(full + first, pa.int32()),
            "keys": pa.array([_planes(np.diff(keys[p], prepend=np.uint64(0))) for p in parts], pa.binary()),
            "counts": pa.array([_planes(counts[:, p].astype(np.int64).ravel()) for p in parts], pa.binary()),
        }
    )


def _added(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of rows of ASKED the distinct keys, the sums of their counts, and each row's places in them."""
    keys = [np.cumsum(_unplanes(x.as_py(), np.uint64), dtype=np.uint64) for x in t["keys"]]
    sizes = [len(k) for k in keys]
    flat = np.concatenate(keys)
    del keys
    every, at = np.unique(flat, return_inverse=True)
    del flat
    counts = [_unplanes(x.as_py(), np.int64).reshape(-1, n) for x, n in zip(t["counts"], sizes, strict=True)]
    sums = np.stack([np.bincount(at, np.concatenate([c[j] for c in counts]), len(every)).astype(np.int64) for j in range(len(counts[0]))])
    return every, sums, np.split(at, np.cumsum(sizes)[:-1])


def _asked(chunks_: DataFrame, what: str, ranges: int) -> DataFrame:
    """What each chunk asks, by range of hashes: its distinct ``what`` and its own counts of them, in all
    documents and in target ones; for words the counts as a token, then those as the token before."""

    def ask(row) -> tuple[np.ndarray, list[np.ndarray]]:
        c = Coded(row["lengths"], row["words"], row["seq"])
        goal = np.frombuffer(row["goal"], np.uint8)[owner(c.bounds)]
        if what == "bigrams":
            keys, _, at = c.bigrams()
            return keys, [np.bincount(at, w, len(keys)) for w in (None, goal)]
        order = np.argsort(c.words)
        return c.words[order], [np.bincount(x, w, len(c.words))[order] for x in (c.at, c.before) for w in (None, goal)]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts = ask({k: batch.column(k)[i].as_py() for k in ("lengths", "goal", "words", "seq")})
                yield from _questions(batch.column("chunk")[i].as_py(), keys, np.stack(counts), ranges).to_batches()

    return chunks_.mapInArrow(run, ASKED)


ANSWERED = "node string, range int, sums binary, found long, n long, n_target long"


def _answers(t: pa.Table, sums: np.ndarray, at: list[np.ndarray], facts: list[int]) -> pa.Table:
    """``sums`` for each row that asked, in its order; ``facts`` in the first row."""
    rows = np.zeros((3, len(at)), np.int64)
    rows[:, 0] = facts
    blobs = [_planes(np.concatenate(list(sums[:, x]))) for x in at]
    return pa.table({"node": t["node"], "range": t["range"], "sums": pa.array(blobs, pa.binary()), "found": rows[0], "n": rows[1], "n_target": rows[2]})


def _answered(asked: DataFrame, nodes: int, ranges: int, total: int) -> DataFrame:
    """The sums of what all nodes counted, for each node and range in the order asked. ``found``, ``n`` and ``n_target`` are
    tokens: distinct, all and target ones, of each range in one of its rows. ``nodes`` have asked in ``ranges`` ranges; the
    root answers in some ``total``."""

    def summed(t: pa.Table) -> pa.Table:
        _, sums, at = _added(t)
        return _answers(t, sums, at, [np.count_nonzero(sums[0]), sums[0].sum(), sums[1].sum()])

    if nodes <= FAN:
        return asked.groupBy("range").applyInArrow(summed, ANSWERED)
    parents = -(-nodes // FAN)
    cut = max(1, min(FAN // 2, -(-total // ranges)))

    def merged(key: tuple, t: pa.Table) -> pa.Table:
        every, sums, _ = _added(t)
        r = key[1].as_py()
        return _questions(key[0].as_py(), every, sums, ranges * cut, r * cut, (r + 1) * cut)

    def passed_on(key: tuple, t: pa.Table, got: pa.Table) -> pa.Table:
        _, sums, at = _added(t)
        got = got.sort_by("range")
        whole = np.concatenate([_unplanes(x.as_py(), np.int64).reshape(len(sums), -1) for x in got["sums"]], 1)
        return _answers(t, whole, at, [int(np.sum(got[k].to_numpy())) for k in ("found", "n", "n_target")])

    asked = storage.stage(asked, "asked")
    up = asked.withColumn("parent", F.concat(F.lit(f"{parents}-"), F.pmod(F.xxhash64("node"), F.lit(parents)).cast("string")))
    given = _answered(up.groupBy("parent", "range").applyInArrow(merged, ASKED), parents, ranges * cut, total)
    down = given.select(F.col("node").alias("to"), F.expr(f"`range` div {cut}").cast("int").alias("of"), "range", "sums", "found", "n", "n_target")
    return up.groupBy("parent", "range").cogroup(down.groupBy("to", "of")).applyInArrow(passed_on, ANSWERED)


def counted(parts: DataFrame, what: str, size: int) -> DataFrame:
    """What each chunk of ``parts`` asked of ``what``, answered; ``size`` is the text's in bytes."""
    nodes, total = parts.count(), 1 + size // RANGE
    ranges = total if nodes <= FAN else min(total, max(1, FAN // 2))
    return _answered(_asked(parts, what, ranges), nodes, ranges, total).withColumnRenamed("node", "chunk").withColumn("what", F.lit(what))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, size: int | None = None) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and score of every document. ``target`` has
    the doc_id of target documents."""
    vocab = vocabulary(docs, size) if size is not None else None
    wanted = target.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().withColumn("__t", F.lit(True))
    # the target's ids grow with the corpus: both sides shuffle, at any size
    marked = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("__t", F.lit(False)).alias("target"))
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = coded(marked, vocab)
    of_words = storage.stage(counted(parts, "words", text), "word-counts")
    facts = of_words.agg(F.sum("found"), F.sum("n"), F.sum("n_target")).first()
    found, n_all, n_goal = (x or 0 for x in facts)
    types = 1 + (found if vocab is None else len(vocab) + CLASSES)
    scales = (n_goal / n_all if n_all else 0.0, 1.0)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(mine: pa.Table, answers: pa.Table) -> pa.Table:
        c = Coded(*(mine[k][0].as_py() for k in ("lengths", "words", "seq")))
        keys, first, at = c.bigrams()
        got = {}
        for what, rows in (("words", 4), ("bigrams", 2)):
            own = sorted((r, x) for r, w, x in zip(*(answers[k].to_pylist() for k in ("range", "what", "sums")), strict=True) if w == what)
            got[what] = np.concatenate([np.zeros((rows, 0), np.int64), *(_unplanes(x, np.int64).reshape(rows, -1) for _, x in own)], 1)
        by_word = np.empty_like(got["words"])
        by_word[:, np.argsort(c.words)] = got["words"]
        losses = []
        for k, scale in enumerate(scales):
            p = (by_word[k, c.at[first]] * scale + 0.5) / ((n_all, n_goal)[k] * scale + 0.5 * types)
            loss = -np.log((got["bigrams"][k] * scale + MU * p) / (by_word[2 + k, c.before[first]] * scale + MU))
            losses.append(np.bincount(owner(c.bounds), loss[at], len(c.lengths)) / np.maximum(1, c.lengths))
        back, goal = losses
        none = c.lengths == 0
        return pa.table([mine["ids"][0].values, pa.array(c.lengths), *(pa.array(x, mask=none) for x in (goal, back, goal - back))], ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    answers = of_words.unionByName(counted(parts, "bigrams", text)).select("chunk", "range", "what", "sums")
    texts = parts.select("chunk", "ids", "lengths", "words", "seq")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, n_tokens long, loss_target double, loss_background double, score double")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    labels = storage.read(spark, sf_dir, "labels")
    return cross_entropy_difference(storage.read(spark, sf_dir, "documents"), labels.where("quality = 1"))
