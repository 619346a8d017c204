"""Host-level quality rules.

Each document gets counts from its whole text and a base verdict; failures are aggregated by host,
each host's failure rate is shrunk towards the corpus with an empirical beta prior, and the host's
verdict is joined back to its documents.

Defined results: a null or empty text has zero counts and fails the base rule (fewer than
``MIN_WORDS`` words). A null host is a host of its own. Repeated rows are judged and returned row
by row. Extra columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import storage
from .textops import chunks, owner, positions, runs, shingles, span_hash, words

MIN_WORDS = 50
MAX_HOST_RATE = 0.5
#: Hosts up to this many are sent to all executors (under 100 bytes each); beyond, the join shuffles.
BROADCAST_HOSTS = 100_000

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_doc(bounds: np.ndarray, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: is it found twice or more in its document; and is it equal to an earlier one."""
    n = len(h)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    same = np.concatenate([[False], (d[1:] == d[:-1]) & (x[1:] == x[:-1])])
    twice, later = np.zeros(n, bool), np.zeros(n, bool)
    later[order] = same  # lexsort is stable: the first of equal items is the earliest
    twice[order] = same | np.append(same[1:], False)
    return twice, later


def text_counts(col: pa.Array) -> dict[str, np.ndarray]:
    """The counts in COUNTS for each text of a batch."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in COUNTS}
    for c in chunks(col):
        data, s, e, b = words(c)
        n = np.diff(b)
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, s, 1)
        np.add.at(inside, e, -1)
        in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        out["n_words"].append(n)
        out["word_chars"].append(_per_doc(c.offsets, in_word & ((data & 0xC0) != 0x80)))
        out["n_symbols"].append(_per_doc(c.offsets, SYMBOL[data]))

        ls, le, lb = runs(data != 0x0A, c.offsets)
        held = np.searchsorted(s, le) > np.searchsorted(s, ls)  # lines with a word
        _, later = _repeated(owner(lb)[held], span_hash(data, ls[held], le[held]))
        dup = np.zeros(len(ls), bool)
        dup[held] = later
        out["n_dup_lines"].append(_per_doc(lb, dup))

        wd = owner(b)
        sh, sb = shingles(span_hash(data, s, e), b, 3)
        long = n >= 3
        windows = np.where(long, n - 2, 0)
        at = positions(sb[:-1], windows)
        twice, _ = _repeated(np.repeat(np.arange(c.n), windows), sh[at])
        first = positions(b[:-1], windows)[twice]
        cover = np.zeros(len(wd), bool)
        for k in range(3):
            cover[first + k] = True
        out["n_repeat_words"].append(_per_doc(b, cover))
    return {k: (np.concatenate(v) if v else np.empty(0, np.int64)).astype(np.int64) for k, v in out.items()}


def _map(batches):
    for batch in batches:
        t = pa.Table.from_batches([batch])
        got = text_counts(t["text"])
        t = t.drop(["text"])
        for k in COUNTS:
            t = t.append_column(k, pa.array(got[k]))
        yield from t.to_batches()


def rule_counts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of each document and its counts."""
    narrow = docs.select(*keys, F.col("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text")
    return narrow.mapInArrow(_map, kept + "".join(f", {k} long" for k in COUNTS))


def host_rates(flagged: DataFrame, host: str = "source") -> DataFrame:
    """One row for each host: ``host_n``, ``host_failed_docs`` and ``host_rate``, its failure rate
    under a beta prior with the moments of the rates of all hosts.

    Failures are pre-aggregated by host before any shuffle, so a hot host is a few rows. The prior
    comes from one row of sums: with mean m and between-host variance v (the variance of the rates
    less the binomial part), its weight is m (1 - m) / v - 1, between 1 and a million documents."""
    hosts = flagged.groupBy(host).agg(
        F.count(F.lit(1)).alias("host_n"), F.sum(F.col("base_failed").cast("long")).alias("host_failed_docs")
    )
    n, r = F.col("host_n"), F.col("host_failed_docs") / F.col("host_n")
    sums = hosts.agg(
        F.sum("host_n").alias("n"),
        F.sum("host_failed_docs").alias("f"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(n * r * r).alias("rr"),
    )
    m = F.col("f") / F.col("n")
    noise = m * (1 - m) * F.col("hosts") / F.col("n")
    between = F.col("rr") / F.col("n") - m * m - noise
    weight = F.when(between > 0, F.least(F.lit(1e6), F.greatest(F.lit(1.0), m * (1 - m) / between - 1))).otherwise(F.lit(1e6))
    prior = sums.select(m.alias("m"), weight.alias("k"))
    return hosts.crossJoin(F.broadcast(prior)).select(  # prior is a single row
        host, "host_n", "host_failed_docs", ((F.col("host_failed_docs") + F.col("m") * F.col("k")) / (F.col("host_n") + F.col("k"))).alias("host_rate")
    )


def host_rules(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, host, counts, base_failed, kept, host_failed, host_n and host_failed_docs."""
    counts = rule_counts(docs, ["doc_id", host])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    flagged = storage.stage(counts.withColumn("base_failed", failed), "host-rules")
    hosts = storage.stage(host_rates(flagged, host), "hosts").withColumnRenamed(host, "__host")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    joined = flagged.join(hosts, F.col(host).eqNullSafe(F.col("__host")), "left").drop("__host")
    bad = F.col("host_rate") > max_host_rate
    return joined.select(
        "doc_id", host, *COUNTS, "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), bad.alias("host_failed"), "host_n", "host_failed_docs"
    )


def op4_host_rules(spark, sf_dir: str) -> DataFrame:
    out = host_rules(storage.read(spark, sf_dir, "documents"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "host_failed", "host_n", "host_failed_docs")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, sum(n - 1) AS n_dup_lines FROM (SELECT rid, line, count(*) AS n FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1),
win AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM l WHERE len(w) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(3)) AS k) GROUP BY 1),
base AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
         FROM l LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
h AS (SELECT source, count(*) AS host_n, CAST(sum(CAST(base_failed AS BIGINT)) AS BIGINT) AS host_failed_docs FROM f GROUP BY 1),
s AS (SELECT sum(host_n) AS n, sum(host_failed_docs) / sum(host_n) AS m, count(*) AS hosts,
      sum(host_failed_docs * host_failed_docs / host_n) AS rr FROM h),
v AS (SELECT m, rr / n - m * m - m * (1 - m) * hosts / n AS between_var FROM s),
k AS (SELECT m, CASE WHEN between_var > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / between_var - 1)) ELSE 1e6 END AS k FROM v),
r AS (SELECT source, host_n, host_failed_docs, (host_failed_docs + m * k) / (host_n + k) > 0.5 AS host_failed FROM h, k)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept, host_failed, host_n, host_failed_docs
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
