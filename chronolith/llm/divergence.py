"""How sources of a language differ in the terms they use, with counts of whole columns evaluated once.

Terms are runs of letters and of characters beyond ASCII, with A-Z lower-cased. A language keeps the terms of at
least ``LEAST_DOCS`` of its documents. Every (language, source) group gives every kept term the integer share
``p = 1 + floor(10**9 * (count + 1) / (N + V))``, with N its occurrences of kept terms and V their number; a language
as a whole does so too. ``f(p, q) = floor((p - q)**2 / q)`` measures how far a share lies from another.

* ``pair``: each other source of the language, with f summed over all kept terms. Most terms are rare, so many have
  the same sparse vector of (source, count): terms are grouped by it, each pair of sources is evaluated once for
  each distinct vector, and counts as often as there are terms with that vector.
* ``term``: each kept term that the group has and uses more than its language, with f against the language; original
  terms are ranked, to ``TOP`` a group.

Plan: tasks count the terms of their texts chunk by chunk (NumPy, by 64-bit hashes: two of a chunk's terms share one
with odds below one in a million), Spark adds them up by (language, source, term) and gathers the counts
of a term to its vector, which has at most as many entries as the language has sources. Distinct vectors are dealt
into parts of some ``PART`` of a language, so a language with most of the text is many groups; a group is evaluated
against its language's sources in blocks of ``BLOCK``, and gives partial sums. All sums are integers: shares
are split before they are multiplied, and sums of f are carried in two halves, so nothing is rounded.

Defined results: a null text, language or source is read as ''. Repeated rows are documents of their own. A group
without terms has shares of count 0. A language without kept terms has pairs of value 0 and no terms. A source alone in
its language has no pairs. Equal values are ranked by item, in order of UTF-8. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import storage
from .textops import LOWER, chunks, mix, owner, positions, runs, span_hash

LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Two factors of SCALE, so that counts to 2.9 * 10**14 multiply without overflow.
_FIRST, _SECOND = 31_250, 32_000
PART, BLOCK = 20_000, 256
#: A language's vectors meet its sizes in so many groups.
SALTS = 64
#: Cells of counts that are evaluated at a time, and bytes of text that are counted at a time.
CELLS, CHUNK_BYTES = 1 << 19, 4 << 20

_TERM = np.zeros(256, bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True


def _spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The strings of byte spans."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    flat = data[positions(starts, sizes)]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.string())


def _counted(batch: pa.RecordBatch):
    """lang, source, term, n and docs of each chunk of a batch."""
    lang, source = (batch.column(k) for k in ("lang", "source"))
    codes = [np.asarray(pc.dictionary_encode(x).indices) for x in (lang, source)]
    group = codes[0].astype(np.uint64) * np.uint64(len(source) + 1) + codes[1].astype(np.uint64)
    for c in chunks(batch.column("text"), CHUNK_BYTES):
        data = LOWER[c.data]
        s, e, b = runs(_TERM[data], c.offsets)
        if not len(s):
            continue
        doc = owner(b)
        key = mix(span_hash(data, s, e) ^ mix(group[c.first + doc] + np.uint64(1)))
        order = np.argsort(key, kind="stable")  # within a key, documents stay in order
        k, d = key[order], doc[order]
        first = np.append(True, k[1:] != k[:-1])
        at = np.flatnonzero(first)
        one = first | np.append(True, d[1:] != d[:-1])
        n, docs, shown = np.diff(np.append(at, len(k))), np.add.reduceat(one.astype(np.int64), at), order[at]
        where = pa.array(c.first + doc[shown])
        yield pa.RecordBatch.from_arrays([lang.take(where), source.take(where), _spans(data, s[shown], e[shown] - s[shown]), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, ``n`` occurrences and ``docs`` documents with it."""
    counted = docs.mapInArrow(lambda batches: (out for b in batches for out in _counted(b)), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def term_vectors(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term and ``vec``, its (source, n) in order of sources, of every kept term."""
    vec = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec")
    return term_counts(docs).groupBy("lang", "term").agg(vec, F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), exactly."""
    x = (n + 1) * _FIRST
    return 1 + x // total * _SECOND + x % total * _SECOND // total


def _share(n: Column, total: Column) -> Column:
    x = (n + 1) * F.lit(_FIRST)
    div = lambda a, b: F.call_function("div", a, b)
    return 1 + div(x, total) * _SECOND + div(x % total * _SECOND, total)


def _pair_sums(key: tuple, vectors: pa.Table, groups: pa.Table) -> pa.Table:
    """f of the block's sources against all of the language, summed over the vectors, in two halves."""
    groups = groups.sort_by("source")
    names, total = groups["source"].combine_chunks(), groups["total"].to_numpy()
    block, width = key[2].as_py(), len(names)
    own = np.arange(block * BLOCK, min(width, (block + 1) * BLOCK))
    high, low = np.zeros((2, len(own), width), np.int64)
    for lo in range(0, len(vectors), max(1, CELLS // max(1, width))):
        some = vectors.slice(lo, max(1, CELLS // max(1, width))).combine_chunks()
        vec, m = some["vec"].combine_chunks(), some["m"].to_numpy()
        vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
        entries = vec.flatten()
        count = np.zeros((len(m), width), np.int64)
        count[np.repeat(np.arange(len(m)), pc.list_value_length(vec)), pc.index_in(entries.field("source"), names)] = entries.field("n")
        p = share(count, total)
        for i, s in enumerate(own):
            d = p[:, s : s + 1] - p
            f = d * d // p
            high[i] += m @ (f >> 32)
            low[i] += m @ (f & 0xFFFFFFFF)
    a, b = (x.ravel() for x in np.meshgrid(own, np.arange(width), indexing="ij"))
    other = a != b
    a, b = a[other], b[other]
    lang = pa.array([key[0].as_py()] * len(a), pa.string())
    return pa.table({"lang": lang, "source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "high": high.ravel()[other], "low": low.ravel()[other]})


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and value of all pairs of a language's sources."""
    distinct = storage.stage(kept.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("m")), "divergence-vectors")
    parts = F.greatest(F.lit(1), F.ceil(F.coalesce("d", F.lit(0)) / PART)).cast("int").alias("parts")
    blocks = F.ceil(F.col("sources") / BLOCK).cast("int").alias("blocks")
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("d")), "lang", "left").select("lang", parts, blocks)
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a row for each language and salt
    h = F.xxhash64("vec")
    left = distinct.withColumn("salt", F.pmod(h, F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).select("lang", F.pmod(F.shiftright(h, 8), "parts").cast("int").alias("part"), block, "vec", "m")
    right = groups.join(sizes, "lang").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("lang", "part", block, "source", "total")
    by = ["lang", "part", "block"]
    sums = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_pair_sums, "lang string, source string, item string, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return sums.groupBy("lang", "source", "item").agg((wide("high") * F.lit(1 << 32).cast("decimal(10,0)") + wide("low")).cast("long").alias("value"))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value and rank of each group's first terms."""
    whole = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("whole")
    rows = kept.select("lang", F.col("term").alias("item"), whole, F.explode("vec").alias("x")).select("lang", "item", "whole", "x.source", "x.n")
    used = rows.join(groups, ["lang", "source"]).withColumns({"p": _share(F.col("n"), F.col("total")), "q": _share(F.col("whole"), F.col("lang_total"))})
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    return _ranked(used.where("p > q").select("lang", "source", "item", value.alias("value"))).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank of both parts."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    narrow = docs.select(name("lang"), name("source"), F.coalesce("text", F.lit("")).alias("text"))
    kept = storage.stage(term_vectors(narrow, least), "divergence-terms")
    used = kept.select("lang", F.explode("vec").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sized = narrow.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(vocabulary, "lang", "left").fillna(0, ["n", "v"])
    lang_n = sized.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    totals = sized.join(lang_n, "lang").select("lang", "source", (F.col("n") + F.col("v")).alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total"))
    groups = storage.stage(totals, "divergence-groups")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = _ranked(_pairs(kept, groups)).withColumn("part", F.lit("pair")).select(columns)
    return pairs.union(_terms(kept, groups, top).withColumn("part", F.lit("term")).select(columns))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(storage.read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d
), t AS (
  SELECT id, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w
), k AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang
), g AS (
  SELECT s.lang, s.source, coalesce(u.n, 0) + coalesce(v.v, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) s
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) u ON u.lang = s.lang AND u.source = s.source
  LEFT JOIN v ON v.lang = s.lang
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // g.total::HUGEINT AS p
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT c.lang, c.term, 1 + 1000000000::HUGEINT * (sum(c.n) + 1)::HUGEINT // (any_value(l.n) + any_value(v.v))::HUGEINT AS q
  FROM c JOIN v ON v.lang = c.lang JOIN (SELECT lang, sum(n) AS n FROM c GROUP BY lang) l ON l.lang = c.lang GROUP BY c.lang, c.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // q.q
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 200
"""
