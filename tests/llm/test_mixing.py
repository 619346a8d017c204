import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronolith.llm import mixing as M, storage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, block string"


def targets(sizes):
    """Cap and reshare, round by round."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        w = sum(weight[s] for s in names if s not in capped)
        share = {s: left * weight[s] / w for s in names if s not in capped} if w else {}
        over = {s: 3 * sizes[s] for s, t in share.items() if t > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def docs(spark, n=400, hot="b"):
    rows = []
    for i in range(n):
        src = hot if i % 3 == 0 else [None, "a", "c", "tiny", "é"][i % 5]
        if src == "tiny" and i % 25:
            src = "a"
        rows.append((i, None if i % 41 == 0 else "w%d x\n" % i * (i % 90), "en", src, 0, 1, "z"))
    rows += [rows[10]] * 5
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation(spark, n):
    got = spark.range(n).select(M.permuted("id", f"bigint({n})", "7").alias("x")).collect()
    assert sorted(r.x for r in got) == list(range(n))


def test_mix(spark):
    df, rows = docs(spark)
    got = M.mix(df.repartition(5)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in got) == sorted((x[0], size(x[1])) for x in rows)
    sizes = Counter()
    for x in rows:
        sizes[x[3]] += size(x[1])
    want = targets(dict(sizes))
    source = {x[0]: x[3] for x in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2 * M.MIN_BLOCK, 0.02 * t)
    again = M.mix(df.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def spark_hash(*values):
    """xxhash64 of longs (and of ints given as numpy ints)."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<i" if isinstance(v, np.int32) else "<q", int(v)), h)
    return h - (1 << 64) if h >> 63 else h


def permuted(i, n, key):
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = i % a, i // a
        for r in (0, 2):
            left = (left + spark_hash(right, key, np.int32(r)) % a) % a
            right = (right + spark_hash(left, key, np.int32(r + 1)) % b) % b
        i = right * a + left
        if i < n:
            return i


def brute_slots(sources):
    """Rows (shard, slot, sid, block, pass), one draw after another, from rows (sid, quota, blocks)."""
    n = sum(q for _, q, _ in sources)
    ends = np.cumsum([q for _, q, _ in sources])
    drawn, draws = Counter(), []
    for at in range(n):
        u = ((spark_hash(at, np.int32(M.SEED)) % (1 << 64)) >> 11) / float(1 << 53)
        k = int(np.searchsorted(ends, min(n - 1, int(u * n)), "right"))
        draws.append((at, k, drawn[k]))
        drawn[k] += 1
    out, extra, over, short = [], [], 0, []
    starts = {}
    for k, (_, q, _) in enumerate(sources):
        starts[k] = over
        over += max(0, drawn[k] - q)
        short += [(k, drawn[k] + j) for j in range(q - drawn[k])]
    for at, k, i in draws:
        sid, q, _ = sources[k]
        i = permuted(i, drawn[k], spark_hash(sid, np.int32(M.SEED + 1)))
        if i < q:
            out.append((at, k, i))
        else:
            extra.append((at, permuted(starts[k] + i - q, over, np.int32(M.SEED + 2))))
    out += [(at, *short[y]) for at, y in extra]
    rows = []
    for at, k, i in out:
        sid, _, blocks = sources[k]
        rows.append((at // M.SHARD, at % M.SHARD, sid, permuted(i % blocks, blocks, spark_hash(sid, np.int32(M.SEED))), i // blocks))
    return draws, sorted(rows)


def plan_of(df):
    return M.plan_mix(df.select("doc_id", "source", M.n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h")))


@pytest.mark.parametrize("few", [True, False])
def test_slots_and_counts_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(M, "SHARD", 64)
    monkeypatch.setattr(M, "GROUP_SHARDS", 4)
    if not few:
        monkeypatch.setattr(M, "SMALL_SOURCES", 2)
    df, rows = docs(spark)
    plan = plan_of(df)
    draws, want = brute_slots([(r.sid, r.quota, r.blocks) for r in plan.sources.where("quota > 0").orderBy("sid").collect()])
    counts = Counter((at // 64, k) for at, k, _ in draws)
    got = Counter((r.shard, r.sid) for r in M.draws(plan).collect())
    assert got == counts
    assert sorted(tuple(r) for r in M.slots(plan).collect()) == want
    # what a document gives: its words in each block, as often as the block has a slot
    times = Counter((sid, block) for _, _, sid, block, _ in want)
    taken = Counter()
    for r in M.pieces(plan).collect():
        taken[r.doc_id, r.start] += r.n * times[r.sid, r.block]
    out = sorted((r.doc_id, r.taken) for r in M.mix(df).collect())
    assert out == sorted([(d, n) for (d, _), n in taken.items()] + [(r.doc_id, 0) for r in plan.docs.where("size = 0").collect()])


def test_counts_by_shard_vary_as_a_multinomial(spark):
    df, _ = docs(spark, 900)
    plan = plan_of(df)
    share = {r.sid: r.quota / plan.slots for r in plan.sources.collect()}
    by = Counter((r.shard, r.sid) for r in M.draws(plan).collect())
    shards = plan.slots // M.SHARD
    assert shards >= 3
    chi = sum((by[k, s] - M.SHARD * p) ** 2 / (M.SHARD * p) for k in range(shards) for s, p in share.items() if p)
    free = shards * (sum(p > 0 for p in share.values()) - 1)
    assert 0.2 * free < chi < 3 * free  # an exact split would give 0


def test_slots_fill_every_place_once(spark):
    df, _ = docs(spark)
    plan = plan_of(df)
    rows = M.slots(plan).collect()
    assert sorted(r.shard * M.SHARD + r.slot for r in rows) == list(range(plan.slots))
    counts = Counter((r.sid, r.block) for r in rows)
    for s in plan.sources.collect():
        n = [counts[s.sid, b] for b in range(s.blocks)]
        assert sum(n) == s.quota and (not n or max(n) - min(n) <= 1)


def test_mixed_documents(spark):
    df, rows = docs(spark)
    # the key names each row apart from repeated ones, so that both ways order the streams alike
    df = df.withColumns({"takes": F.lit(1), "cut": F.lit("c"), "size": F.lit(2)})  # names used inside
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    got, src = Counter(), {x[0]: x[3] for x in rows}
    texts = {x[0]: x[1] for x in rows}
    for r in out.collect():
        n = len((r.text or "").split())
        assert n and r.n_chars == len(r.text) and r.text in texts[r.doc_id]
        got[r.source] += n
    total = Counter()
    for r in M.mix(df).collect():
        total[src[r.doc_id]] += r.taken
    for s in total:
        assert abs(total[s] - got[s]) <= 2 * M.MIN_BLOCK


def test_mixed_documents_stand_by_slot(spark, tmp_path):
    rows = [(i, " ".join(f"{i}.{j}" for j in range(5 + i % 40)), "en", "ab"[i % 2], 0, 0, "") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "mix")
    M.mixed_documents(df).write.parquet(path)
    at = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    words = [w for r in spark.read.parquet(path).select("text", at.alias("f"), F.col("_metadata.row_index").alias("r")).orderBy("f", "r").collect() for w in r.text.split()]
    keyed = storage.row_keyed(df)
    plan = M.plan_mix(keyed.select("doc_id", "source", M.n_words(F.col("text")).alias("size"), F.struct(*storage.ROW_KEY).alias("h")))
    held = {}
    for r in M.pieces(plan).collect():
        held.setdefault((r.sid, r.block), []).append((r.start + r["from"], [f"{r.doc_id}.{r['from'] + j}" for j in range(r.n)]))
    want = [w for s in sorted(M.slots(plan).collect(), key=lambda s: (s.shard, s.slot)) for _, piece in sorted(held[s.sid, s.block]) for w in piece]
    assert words == want


def test_partitions_follow_bytes_and_leave_the_order(spark, monkeypatch):
    text = F.expr("repeat(concat(lpad(id, 39, 'x'), ' '), 24)")
    df = spark.range(0, 11_000, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"), (F.col("id") % 8).cast("string").alias("source"))
    as_few = [(r.doc_id, r.text) for r in M.mixed_documents(df).collect()]
    monkeypatch.setattr(M, "PART_BYTES", 1 << 20, raising=False)
    out = M.mixed_documents(df).withColumn("part", F.spark_partition_id()).collect()
    held = Counter()
    for r in out:
        held[r.part] += len(r.text)
    assert max(held.values()) <= 1.5 * (1 << 20)
    assert [(r.doc_id, r.text) for r in out] == as_few


def test_no_rows_and_no_words(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert M.mixed_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, 0, 0, ""), (2, " \n", None, "a", 0, 0, "")], SCHEMA)
    assert [(r.size, r.target, r.taken) for r in M.mix(blank).collect()] == [(0, 0.0, 0)] * 2
