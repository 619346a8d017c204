"""Quality by co-training a text view and a page-metadata view.

* Text view: shares of the words in ``WORD_BUCKETS`` hash buckets, and shares of symbols, capitals,
  digits, marks and distinct words, and the mean length of words.
* Metadata view: source and language in hash buckets, logarithms of the characters and lines, and
  the mean length of a line.

Both are logistic models. They start from at most ``SAMPLE`` labelled documents (those with the
smallest hash of doc_id: a bounded, documented sample; four fifths teach, one fifth calibrates).

Unlabelled documents form a pool, with documents of equal features as one, so that a group of copies
is one lesson. In each of ``ROUNDS`` rounds each view scores the pool and labels its most confident
documents for the other view: the share ``SHARE`` of those that it hasn't labelled yet, positives from the
top and negatives from the bottom in the classes' ratio among the labelled, and none on the wrong side
of even odds. Where a cut falls among documents of one bin of scores, a hash of their features decides. So a round's
lessons grow with the corpus, never exceed their share, and no document is taught twice by a view. All lessons of a view
together weigh ``WEIGHT`` times the labelled ones.

A view teaches only what it knows: on the calibrating fold, those that it puts in a class must be of that class
more often than not, and more often than all are, beyond what chance explains (Wilson's lower bound of ``Z`` standard errors). A view that doesn't know a class
gives no lessons of it; if neither view knows any, the rounds end. Of the models before and after each round those with the least
loss of the combined, calibrated score on the calibrating fold are kept.

What a view has labelled follows from the weights and cuts of the rounds so far, so it isn't stored. A
round is one pass for the distributions of scores (counts in bins of a logit's ``1 / FINE``) and at most ``PASSES``
passes of Newton's method, whose sums are made on executors and added up in a tree; the driver gets
counts by bin and a few sums, at any corpus size. A step is taken only where it lowers the summed loss enough, and halved
until it does, so the fit descends to its optimum from wherever it starts.

At the end each view is calibrated (Platt) on the calibrating fifth, a logistic combination of both
calibrated views is fitted there, and every document is scored.

Features are computed once from whole texts and written; rounds read only those.

Defined results: a null or empty text has the features of no words. Null source, language or
n_chars have values of their own (n_chars is taken from the text). Of several labels of a document
the largest counts; labels other than 0 and 1 don't count. Of several rows with a labelled doc_id the one
with the least features teaches. Repeated rows are scored row by row. Extra columns are ignored. If a class
has no labelled document, there is nothing to learn: every score is 0.5 and every document is kept.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import storage
from .host_rules import SYMBOL
from .textops import LOWER, chunks, owner, runs, span_hash, words

SAMPLE = 20_000
ROUNDS = 3
SHARE, WEIGHT, PASSES = 0.05, 0.5, 10
#: Bins of a logit, and where the outermost ones begin; standard errors of the bound for what a view knows.
FINE, BOUND = 100, 30
Z = 1.64
#: A fit ends when a whole step promises to lower the loss by less than this share of it.
ENOUGH = 1e-5
KEEP = 0.5
#: Rows of sums that the driver takes; more are added up on executors first.
SUMS = 16
RIDGE = 1.0
WORD_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS = 160, 48, 16
TEXT, META = WORD_BUCKETS + 6, SOURCE_BUCKETS + LANG_BUCKETS + 3
#: Lengths of the vectors of both views' sums.
TEXT_SUMS, META_SUMS = (1 + (n + 1) * (n + 2) for n in (TEXT, META))

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[0x30:0x3A] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?;:\"'()[]{}@/\\^_~`+=-")] = True


def _share(flags: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(1, of)


def _buckets(col: pa.Array, n: int) -> np.ndarray:
    """One-hot hash buckets of a string column; the last bucket is null's."""
    out = np.zeros((len(col), n), np.float32)
    null = np.asarray(col.is_null())
    for c in chunks(col):
        h = span_hash(c.data, c.offsets[:-1], c.offsets[1:])
        out[c.first + np.arange(c.n), (h % np.uint64(n - 1)).astype(int)] = 1
    out[null] = 0
    out[null, n - 1] = 1
    return out


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text and metadata features of each row."""
    text, layout = [np.empty((0, TEXT))], [np.empty((0, 3))]
    for c in chunks(batch.column("text")):
        data, s, e, b = words(c)
        n, size = np.diff(b), np.diff(c.offsets)
        h = span_hash(LOWER[data], s, e)
        doc = owner(b)
        bag = np.bincount(doc * WORD_BUCKETS + (h % np.uint64(WORD_BUCKETS)).astype(int), minlength=c.n * WORD_BUCKETS).reshape(c.n, WORD_BUCKETS)
        key = np.sort(doc.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
        first = np.append(True, key[1:] != key[:-1]) if len(key) else np.empty(0, bool)
        distinct = np.bincount((key[first] >> np.uint64(40)).astype(int), minlength=c.n)
        x = np.empty((c.n, TEXT))
        x[:, :WORD_BUCKETS] = np.sqrt(bag / np.maximum(1, n)[:, None])
        for j, flags in enumerate((SYMBOL[data], _UPPER[data], _DIGITS[data], _MARKS[data])):
            x[:, WORD_BUCKETS + j] = 4 * np.sqrt(_share(flags, c.offsets, size))
        x[:, WORD_BUCKETS + 4] = distinct / np.maximum(1, n)
        x[:, WORD_BUCKETS + 5] = np.minimum(4.0, np.bincount(doc, e - s, c.n) / np.maximum(1, n) / 8)
        text.append(x)
        lead = (data & 0xC0) != 0x80
        chars = _share(lead, c.offsets, np.ones(c.n))
        _, _, lb = runs(data != 0x0A, c.offsets)
        lines = np.diff(lb)
        layout.append(np.stack([np.log1p(chars) / 4, np.log1p(lines) / 2, np.log1p(chars / np.maximum(1, lines)) / 4], 1))
    meta = np.hstack([_buckets(batch.column("source"), SOURCE_BUCKETS), _buckets(batch.column("lang"), LANG_BUCKETS), np.concatenate(layout)])
    return np.concatenate(text), meta


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())


def _unpacked(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float16).reshape(-1, width).astype(np.float32)


def featurize(docs: DataFrame) -> DataFrame:
    """doc_id and both views' features (half floats) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            text, meta = features(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _packed(text), _packed(meta)], ["doc_id", "text", "meta"])

    narrow = docs.select("doc_id", "text", F.col("source").cast("string"), F.col("lang").cast("string"))
    return narrow.mapInArrow(run, f"doc_id {kind}, text binary, meta binary")


class Descent:
    """Newton's method with backtracking on a ridged loss, fed with the sums at each ``trial``."""

    def __init__(self, w: np.ndarray, ridge: float = RIDGE):
        self.w = self.trial = w
        self.penalty = np.full(len(w), ridge)
        self.penalty[-1] = 1e-6
        self.loss, self.size, self.slope, self.step = np.inf, 1.0, 0.0, np.zeros(len(w))
        self.done = False

    def observe(self, sums: np.ndarray) -> None:
        """Take or halve the step to ``trial``, whose loss, gradient and Hessian these are."""
        if self.done:
            return
        loss = sums[0] + self.penalty @ self.trial**2 / 2
        n = len(self.w)
        if loss <= self.loss - 1e-4 * self.size * self.slope:
            self.w, self.loss, self.size = self.trial, loss, 1.0
            gradient = sums[1 : n + 1] + self.penalty * self.w
            self.step = np.linalg.solve(sums[n + 1 :].reshape(n, n) + np.diag(self.penalty), gradient)
            self.slope = gradient @ self.step
            self.done = self.slope <= ENOUGH * (1e-9 + abs(loss))
        else:
            self.size /= 2
            self.done = self.size < 1e-6
        self.trial = self.w if self.done else self.w - self.size * self.step


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Logistic regression; the last weight is the intercept."""
    d, c = Descent(np.zeros(x.shape[1] + 1), ridge), np.ones(len(y))
    for _ in range(100):
        d.observe(newton_sums(x, y, c, d.trial))
        if d.done:
            break
    return d.w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -BOUND, BOUND)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def labelled_sample(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, quality and fold of at most ``size`` labelled documents."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    h = F.xxhash64(F.col("doc_id"), F.lit(11))
    return one.withColumn("h", h).orderBy("h", "doc_id").limit(size).select("doc_id", "quality", F.pmod("h", F.lit(5)).alias("fold"))


def newton_sums(x: np.ndarray, y: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of the loss of rows weighted by ``c``, as one vector."""
    a = np.hstack([x, np.ones((len(x), 1))])
    z = a @ w
    p = sigmoid(z)
    return np.concatenate([[c @ (np.logaddexp(0, z) - y * z)], a.T @ (c * (p - y)), ((a * (c * p * (1 - p))[:, None]).T @ a).ravel()])


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def known(z: np.ndarray, y: np.ndarray) -> set[int]:
    """The classes that logits tell better than even odds and the classes' shares do, beyond chance."""
    out = set()
    for label in (0, 1):
        called = (z >= 0) == bool(label)
        n = int(called.sum())
        if n and len(set(y.tolist())) == 2:
            right = float((y[called] == label).mean())
            spread = Z * np.sqrt(right * (1 - right) / n + Z * Z / (4 * n * n))
            if (right + Z * Z / (2 * n) - spread) / (1 + Z * Z / n) > max(0.5, float((y == label).mean())):
                out.add(label)
    return out


def bins(z: np.ndarray) -> np.ndarray:
    return np.floor((z + BOUND) * FINE).astype(np.int64)


#: A cut of one class: all bins beyond ``edge``, and of its own bin the documents whose hash is below ``part`` of 2**32.
Cut = tuple[int, int]


class Views:
    """The two models, what they learn from, and the rounds so far."""

    def __init__(self, rows):
        y = np.array([r.quality for r in rows], float)
        held = np.array([r.fold == 0 for r in rows], bool)
        x = [_unpacked(pa.array([bytes(r[k]) for r in rows]), n) for k, n in (("text", TEXT), ("meta", META))]
        self.check = [v[held] for v in x], y[held]
        self.x, self.y = [v[~held] for v in x], y[~held]
        self.w = [fit(v, self.y) for v in self.x]
        #: Weight of all lessons of each class.
        self.weight = WEIGHT * len(self.y) * np.array([1 - self.y.mean(), self.y.mean()])
        #: For each round the weights of both views, and for each view its cuts of 0 and of 1.
        self.rounds: list[tuple[list[np.ndarray], list[tuple[Cut, Cut]]]] = []
        #: For each view its lessons of 0 and 1 so far (as expected from their hashes), and for each round what was new.
        self.given = [[0.0, 0.0], [0.0, 0.0]]
        self.log: list[dict] = []
        self.fits: list[Descent] = []
        self.calibrate()
        self.best = self.checked(), self.w, self.platt, self.mix
        self.losses = [self.best[0]]

    def close_round(self, counts: list[dict[int, int]]) -> bool:
        """Set the cuts of a round from each view's counts by bin of documents it hasn't labelled; whether
        there is any lesson in it."""
        cuts, half, some = [], BOUND * FINE, False
        for k, by in enumerate(counts):
            total, share = sum(by.values()), self.y.mean()
            knows = known(logit(self.check[0][k], self.w[k]), self.check[1])
            limits = []
            for label, part, order in ((0, 1 - share, sorted(b for b in by if b < half)), (1, share, sorted((b for b in by if b >= half), reverse=True))):
                left = want = SHARE * part * total if label in knows else 0.0
                cut: Cut = (-1 if label == 0 else 2 * half + 1, 0)
                for b in order:
                    if left <= 0:
                        break
                    cut = b, min(1 << 32, int(left / by[b] * (1 << 32)))
                    left -= min(left, by[b])
                limits.append(cut)
                self.given[k][label] += want - left
                some |= want > left
                self.log.append({"round": len(self.rounds), "view": k, "label": label, "lessons": want - left, "of": total})
            cuts.append((limits[0], limits[1]))
        self.rounds.append((self.w, cuts))
        self.fits = [Descent(w) for w in self.w]
        return some

    def bare(self) -> Views:
        """What executors need: all but the labelled rows."""
        out = copy.copy(self)
        out.x = out.y = out.check = out.best = None
        return out

    def labels(self, x: list[np.ndarray], h: np.ndarray) -> list[np.ndarray]:
        """The label that each view has given each row (``h`` is its hash, below 2**32) in some round, or -1."""
        out = [np.full(len(x[0]), -1), np.full(len(x[0]), -1)]
        for w, cuts in self.rounds:
            for k in (0, 1):
                b, (low, high) = bins(logit(x[k], w[k])), cuts[k]
                zero = (b < low[0]) | (b == low[0]) & (h < low[1])
                one = (b > high[0]) | (b == high[0]) & (h < high[1])
                out[k] = np.where(out[k] >= 0, out[k], np.where(zero, 0, np.where(one, 1, -1)))
        return out

    def lesson_sums(self, x: list[np.ndarray], h: np.ndarray) -> np.ndarray:
        """Newton sums of both views' trials over the lessons among these rows."""
        given, out = self.labels(x, h), []
        for k in (0, 1):
            label, n = given[1 - k], np.maximum(1, self.given[1 - k])
            some = label >= 0
            c = (self.weight / n)[label[some]]
            out.append(newton_sums(x[k][some], label[some].astype(float), c, self.fits[k].trial))
        return np.concatenate(out)

    def observe(self, sums: np.ndarray) -> bool:
        """Add the labelled rows' sums, move both fits, and say whether both have ended."""
        for f, s, x in zip(self.fits, (sums[:TEXT_SUMS], sums[TEXT_SUMS:]), self.x, strict=True):
            f.observe(s + newton_sums(x, self.y, np.ones(len(x)), f.trial))
        return all(f.done for f in self.fits)

    def end_round(self) -> None:
        self.w = [f.w for f in self.fits]
        self.calibrate()
        self.losses.append(self.checked())
        if self.losses[-1] < self.best[0]:
            self.best = self.losses[-1], self.w, self.platt, self.mix

    def keep_best(self) -> None:
        _, self.w, self.platt, self.mix = self.best

    def _calibrating(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The calibrating fold; all labelled rows if that fold lacks a class."""
        x, y = self.check
        return (x, y) if len(set(y.tolist())) == 2 else (self.x, self.y)

    def calibrate(self) -> None:
        """Platt scaling of each view, and the combination of both."""
        x, y = self._calibrating()
        z = [logit(v, w) for v, w in zip(x, self.w, strict=True)]
        self.platt = [fit(v[:, None], y) for v in z]
        self.mix = fit(np.stack([v * p[0] + p[1] for v, p in zip(z, self.platt, strict=True)], 1), y)

    def checked(self) -> float:
        """The combined score's loss on the calibrating fold."""
        x, y = self._calibrating()
        z = [logit(v, w) * p[0] + p[1] for v, w, p in zip(x, self.w, self.platt, strict=True)]
        return log_loss(logit(np.stack(z, 1), self.mix), y)

    def score(self, text: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
        """Calibrated text view, calibrated metadata view, and both."""
        z = [logit(v, w) * p[0] + p[1] for v, w, p in zip((text, meta), self.w, self.platt, strict=True)]
        return [sigmoid(z[0]), sigmoid(z[1]), sigmoid(logit(np.stack(z, 1), self.mix))]


def _both(batch) -> list[np.ndarray]:
    return [_unpacked(batch.column("text"), TEXT), _unpacked(batch.column("meta"), META)]


def _hash(batch) -> np.ndarray:
    return batch.column("h").to_numpy()


def _counts(pool: DataFrame, views: Views) -> list[dict[int, int]]:
    """For each view, the number of documents that it hasn't labelled by bin of its present logit."""
    sent = pool.sparkSession.sparkContext.broadcast(views.bare())

    def run(batches):
        total = np.zeros((2, 2 * BOUND * FINE + 1), np.int64)
        for batch in batches:
            x = _both(batch)
            for k, given in enumerate(sent.value.labels(x, _hash(batch))):
                total[k] += np.bincount(bins(logit(x[k], sent.value.w[k]))[given < 0], minlength=total.shape[1])
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(total[k, b])], ["view", "bin", "n"])

    rows = pool.mapInArrow(run, "view long, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect()
    sent.destroy()
    return [{r.bin: r.n for r in rows if r.view == k} for k in (0, 1)]


def _lesson_sums(pool: DataFrame, views: Views, tasks: int) -> np.ndarray:
    """``Views.lesson_sums`` over the whole pool: a row from each task, added up in a tree."""
    sent = pool.sparkSession.sparkContext.broadcast(views.bare())

    def own(batches):
        total = sum((sent.value.lesson_sums(_both(b), _hash(b)) for b in batches), start=np.zeros(TEXT_SUMS + META_SUMS))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def merged(batches):
        got = [np.frombuffer(x.as_py(), float) for b in batches for x in b.column("sums")]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([sum(got).tobytes()], pa.binary())], ["sums"])

    out = pool.mapInArrow(own, "sums binary")
    while tasks > SUMS:
        tasks = int(np.ceil(np.sqrt(tasks)))
        out = out.repartition(tasks).mapInArrow(merged, "sums binary")
    total = sum((np.frombuffer(bytes(r.sums), float) for r in out.collect()), start=np.zeros(TEXT_SUMS + META_SUMS))
    sent.destroy()
    return total


def co_train(feats: DataFrame, sample: DataFrame, rounds: int = ROUNDS) -> Views | None:
    """Both views, calibrated, as of the best round; None if a class lacks lessons."""
    small = F.broadcast(sample)  # at most SAMPLE rows of three numbers
    one = feats.join(small, "doc_id").groupBy("doc_id", "quality", "fold").agg(F.min(F.struct("text", "meta")).alias("x"))
    rows = one.select("doc_id", "quality", "fold", "x.*").orderBy("doc_id").collect()
    if {r.quality for r in rows} < {0, 1} or len({r.quality for r in rows if r.fold != 0}) < 2:
        return None
    views = Views(rows)
    free = feats.join(small.select("doc_id"), "doc_id", "left_anti")
    own = F.shiftrightunsigned(F.xxhash64("text", "meta"), 32).alias("h")
    pool = storage.stage(free.select("text", "meta").distinct().select("text", "meta", own), "quality-pool")
    tasks = pool.rdd.getNumPartitions()
    for _ in range(rounds):
        if not views.close_round(_counts(pool, views)):
            break
        for _ in range(PASSES):
            if views.observe(_lesson_sums(pool, views, tasks)):
                break
        views.end_round()
    views.keep_best()
    return views


def quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, p_text, p_meta, score and kept of every document."""
    spark = docs.sparkSession
    feats = storage.stage(featurize(docs), "quality-features")
    sample = storage.stage(labelled_sample(labels), "quality-sample")
    kind = docs.schema["doc_id"].dataType.simpleString()
    views = co_train(feats, sample, rounds)
    if views is None:
        half = F.lit(0.5)
        return feats.select("doc_id", half.alias("p_text"), half.alias("p_meta"), half.alias("score"), F.lit(True).alias("kept"))
    sent = spark.sparkContext.broadcast(views.bare())

    def run(batches):
        for batch in batches:
            p = sent.value.score(*_both(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.float64()) for v in p)], ["doc_id", "p_text", "p_meta", "score"])

    out = feats.mapInArrow(run, f"doc_id {kind}, p_text double, p_meta double, score double")
    return out.withColumn("kept", F.col("score") >= KEEP)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality(storage.read(spark, sf_dir, "documents"), storage.read(spark, sf_dir, "labels"))
