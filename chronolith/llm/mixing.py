"""Mixing sources to target weights, with DataFrame functions only.

1. Tokens: each source's documents stand in a fixed pseudorandom order and their words form one
   stream, cut into blocks of one fixed length (a source's last one may be shorter).
2. Targets: sources ordered by code point (null last) weigh 1, 2, 3, repeating, and share all
   words; a source stops at ``MAX_EPOCHS`` times its size and its excess is reshared by weight. In
   blocks, a source's target is its quota.
3. Draws: the mix has as many slots as the quotas have blocks, in output shards of ``SHARD`` slots.
   Each slot draws its source with the quotas as odds, so that a shard's counts of sources are a
   multinomial draw, independent of other shards. The draws of a source are numbered through all
   shards, by running sums of its counts.
4. Quotas: draws of a source beyond its quota, picked by a permutation of its draw numbers, are dealt
   again to sources that fell short of theirs. These are some sqrt(slots) of all slots; with them each
   source meets its target to within a block, and none is drawn beyond its epochs.
5. Blocks: draw i of a source takes block permutation(i mod blocks) in pass i div blocks, so every
   pass takes each block once and no two blocks of a source differ by more than one.
6. Documents are joined to the slots by (source, block). ``mix`` counts what each document gives;
   ``mixed_documents`` writes the pieces in order of shard, slot and place in the block.

A permutation of 0..n-1 is a Feistel network over a grid of about sqrt(n) by sqrt(n), walked on
where it leaves the range: a bijection without state or sort. Hot sources never meet in one task:
stream positions are sums over buckets of a source's documents plus a running sum in a bucket, and
draw numbers are sums over groups of shards, shards and slots in a shard. Sums over all sources are
one window up to ``SMALL_SOURCES`` of them, and sums over ranges plus sums in a range beyond.

The block length follows from the corpus: a 4096th of the mean source, 8 to 1024 words. What places
the words are drawn from follows from seeded hashes of contents and slots, so reruns agree. Documents
of equal hash (64 bits) in a source stand by doc_id; nothing is lost by it.

Defined results: a null text has no words, size 0 and nothing taken. A null source is a source.
Repeated rows are documents of their own. Extra columns are ignored by ``mix`` and carried by
``mixed_documents``. An empty table gives an empty result; without any word all targets are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import storage

WORD = r"[^\x20\x09-\x0D]+"
MIN_BLOCK, MAX_BLOCK, BLOCKS_A_SOURCE = 8, 1024, 4096
SHARD = 1024
MAX_EPOCHS = 3
SEED = 20240
#: Documents of a source in a bucket, on average.
BUCKET_DOCS = 4096
#: Shards whose counts of a source are summed first.
GROUP_SHARDS = 1024
#: Sources up to this many (some 100 bytes each) are sent to all executors and summed in one window; more
#: are joined by shuffle and summed by ranges of this many.
SMALL_SOURCES = 100_000
#: Bytes of text in a partition that ``mixed_documents`` writes, on average; ``MAX_EPOCHS`` times as many where the mix
#: prefers sources of long words, and more where a shard alone has more. Its sorter and its writer hold a partition, and readers
#: hold a column of a row group, on the heap and once more in buffers outside it.
PART_BYTES = 16 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``value`` evaluated once, as ``name``. Written out, each round below would repeat
    the one before several times, and the expression would grow with a power of their number."""
    return f"transform(array({value}), {name} -> {body})[0]"


def permuted(i: str, n: str, key: str) -> Column:
    """The image of ``i`` under the bijection of 0..n-1 that ``key`` picks (n > 0); all are SQL."""

    def once(x: str, v: str) -> str:
        body = f"{v}r2 * g.a + {v}l2"
        for r in (3, 2, 1, 0):  # from the last round outwards
            side, other, m = (("l", "r", "g.a"), ("r", "l", "b"))[r % 2]
            old = f"{v}{side}{r // 2}"
            body = let(f"{v}{side}{r // 2 + 1}", f"pmod({old} + pmod(xxhash64({v}{other}{(r + 1) // 2}, g.k, {r}), {m}), {m})", body)
        return let(f"{v}l0", f"pmod({x}, g.a)", let(f"{v}r0", f"{x} div g.a", body))

    # out of the range at most once in sqrt(n), so the walk is hardly ever long
    on = f"aggregate(sequence(1, 64), y, (x, s) -> if(x < g.n, x, {once('x', 'w')}))"
    image = let("y", once("g.i", "f"), f"if(y < g.n, y, {on})")
    whole = let("b", "(g.n + g.a - 1) div g.a", image)
    return F.expr(let("g", f"named_struct('i', {i}, 'n', {n}, 'k', {key}, 'a', cast(ceil(sqrt(double({n}))) AS bigint))", whole))


@dataclass
class Plan:
    """What a mix is made of. ``sources``: a row for each source with its index ``sid``, size,
    target, number of blocks and quota of draws, and the quotas before its own. ``docs``: key, size,
    sid, and place in its source's stream, for each document."""

    sources: DataFrame
    docs: DataFrame
    block: int
    slots: int
    small: bool

    def by_source(self, df: DataFrame, *cols: str) -> DataFrame:
        return self.join(df, self.sources.select("sid", *cols), ["sid"])

    def join(self, df: DataFrame, of_sources: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        """Join with a table whose rows are at most a few for each source."""
        return df.join(F.broadcast(of_sources) if self.small else of_sources, on, how)


def running(rows: DataFrame, order: list, sums: dict[str, Column], few: bool) -> DataFrame:
    """Each row with sums over all rows before it in the (total) order. Few rows are one window; many
    are cut into ranges of the order, whose totals are summed first."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    if few:
        return rows.withColumns({k: zero(F.sum(c).over(before(Window.orderBy(*order)))) for k, c in sums.items()})
    parts = 1 + rows.count() // SMALL_SOURCES
    cut = storage.stage(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "mix-ranges")
    held = cut.groupBy("__part").agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    held = held.select("__part", *(zero(F.sum(f"__{k}").over(before(Window.orderBy("__part")))).alias(f"__{k}") for k in sums))
    within = before(Window.partitionBy("__part").orderBy(*order))
    out = cut.join(F.broadcast(held), "__part")  # a row for each range
    return out.withColumns({k: zero(F.sum(c).over(within)) + F.col(f"__{k}") for k, c in sums.items()}).drop("__part", *(f"__{k}" for k in sums))


def source_targets(sizes: DataFrame, few: bool = True) -> DataFrame:
    """``sid`` by code point, null last, ``weight`` and ``target`` for rows of (source, size).

    The final level of "cap and reshare until none is above" is the one at which the capped shares
    sum to all words; with sources in order of cap by weight, those below the level come first."""
    s = running(sizes, [F.col("source").asc_nulls_last()], {"sid": F.lit(1).cast("long")}, few)
    s = s.withColumn("weight", (F.col("sid") % 3 + 1).cast("double")).withColumn("cap", (MAX_EPOCHS * F.col("size")).cast("double"))
    s = storage.stage(s, "mix-weights")
    words, weights = s.agg(F.sum("size").cast("double"), F.sum("weight")).first()
    s = running(s, [F.col("cap") / F.col("weight"), F.col("sid")], {"caps": F.col("cap"), "weights": F.col("weight")}, few)
    level = (F.lit(words) - F.col("caps")) / (F.lit(weights) - F.col("weights"))
    is_open = F.col("cap") >= level * F.col("weight")
    first = s.where(is_open).agg(F.min_by(level, F.struct(F.col("cap") / F.col("weight"), "sid"))).first()[0]
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first) * F.col("weight"))  # the first that its cap doesn't bind
    return s.select("sid", "source", "size", "n_docs", "weight", target.alias("target"))


def plan_mix(keyed: DataFrame) -> Plan:
    """The plan for rows of (``doc_id``, ``source``, ``size``, ``h``), h being the row's hash."""
    rows = storage.stage(keyed.select("doc_id", "source", "size", "h"), "mix-rows")
    sizes = storage.stage(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_docs")), "mix-sizes")
    n, words = sizes.agg(F.count(F.lit(1)), F.sum("size")).first()
    small = n <= SMALL_SOURCES
    block = int(max(MIN_BLOCK, min(MAX_BLOCK, (words or 0) // max(1, n * BLOCKS_A_SOURCE))))
    blocks = F.ceil(F.col("size") / block).cast("long")
    quota = F.when(F.col("size") > 0, F.least(MAX_EPOCHS * blocks, F.floor(F.col("target") * blocks / F.col("size") + 0.5))).otherwise(0).cast("long")
    s = source_targets(sizes, small).withColumn("blocks", blocks).withColumn("quota", quota)
    s = storage.stage(running(s, ["sid"], {"first": F.col("quota")}, small), "mix-sources")
    slots = s.agg(F.sum("quota")).first()[0] or 0

    plan = Plan(s, rows, block, slots, small)
    named = s.select("sid", F.col("source").alias("__s"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_DOCS)).cast("long").alias("buckets"))
    d = rows.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    d = d.withColumn("bucket", F.pmod(F.xxhash64("h"), F.col("buckets"))).drop("buckets")
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("held").over(ahead), F.lit(0)).cast("long").alias("base"))
    within = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)).cast("long"))
    # what follows here and for draws has a row for each bucket or shard: it grows, so no side is broadcast
    plan.docs = d.join(sums.hint("merge"), ["sid", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("base", "bucket")
    return plan


def placed(plan: Plan, points: DataFrame, x: str, ranges: DataFrame, total: int) -> DataFrame:
    """Rows of ``points`` with the range (sid, first, n) that holds ``x``; ranges cover 0..total-1. They are
    looked up by equal cells, as many as there are ranges, so a point meets two ranges on average."""
    some = ranges.where("n > 0")
    width = -(-total // max(1, some.count()))
    cells = some.withColumn("cell", F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"(first + n - 1) div {width}"))))
    met = plan.join(points.withColumn("cell", F.expr(f"{x} div {width}")), cells, ["cell"])
    return met.where((F.col(x) >= F.col("first")) & (F.col(x) < F.col("first") + F.col("n"))).drop("cell", "n")


def draws(plan: Plan) -> DataFrame:
    """``shard``, ``slot`` and the source ``sid`` that the slot draws: one row for each slot."""
    spark = plan.sources.sparkSession
    at = spark.range(plan.slots).select(F.expr(f"id div {SHARD}").alias("shard"), F.col("id") % SHARD, F.xxhash64("id", F.lit(SEED)).alias("u")).toDF("shard", "slot", "u")
    u = F.shiftrightunsigned("u", 11).cast("double") / float(1 << 53)
    at = at.select("shard", "slot", F.least(F.floor(u * plan.slots), F.lit(plan.slots - 1)).cast("long").alias("x"))
    got = placed(plan, at, "x", plan.sources.select("sid", "first", F.col("quota").alias("n")), plan.slots)
    return got.select("shard", "slot", "sid")


def numbered(drawn: DataFrame) -> DataFrame:
    """Draws with ``i``, their number in their source: shards before it, and slots before it in its shard."""
    group = F.expr(f"shard div {GROUP_SHARDS}").alias("group")
    by_shard = storage.stage(drawn.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn("group", group), "mix-counts")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    groups = by_shard.groupBy("sid", "group").agg(F.sum("n").alias("n"))
    groups = groups.select("sid", "group", zero(F.sum("n").over(before(Window.partitionBy("sid").orderBy("group")))).alias("g"))
    within = zero(F.sum("n").over(before(Window.partitionBy("sid", "group").orderBy("shard"))))
    base = by_shard.withColumn("s", within).join(groups, ["sid", "group"]).select("sid", "shard", (F.col("g") + F.col("s")).alias("base"))
    rank = (F.row_number().over(Window.partitionBy("sid", "shard").orderBy("slot")) - 1).cast("long")
    return drawn.withColumn("i", rank).join(base.hint("merge"), ["sid", "shard"]).withColumn("i", F.col("i") + F.col("base")).drop("base")


def slots(plan: Plan) -> DataFrame:
    """The mix: ``shard``, ``slot`` in it, and the block (``sid``, ``block``, ``pass``) that fills it."""
    drawn = storage.stage(draws(plan), "mix-draws")
    got = drawn.groupBy("sid").agg(F.count(F.lit(1)).alias("drawn"))
    s = plan.join(plan.sources.select("sid", "quota", "blocks"), got, ["sid"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("long"))
    over, short = (F.greatest(F.lit(0).cast("long"), d) for d in (F.col("drawn") - F.col("quota"), F.col("quota") - F.col("drawn")))
    s = s.withColumn("over", over).withColumn("short", short)
    s = storage.stage(running(s, ["sid"], {"over_before": F.col("over"), "first": F.col("short")}, plan.small), "mix-quotas")
    again = s.agg(F.sum("over")).first()[0] or 0
    i = plan.join(numbered(drawn), s.select("sid", "quota", "drawn", "over_before"), ["sid"])
    i = i.withColumn("i", permuted("i", "drawn", f"xxhash64(sid, {SEED + 1})"))
    index = i.where(F.col("i") < F.col("quota")).select("shard", "slot", "sid", "i")
    if again:
        extra = i.where(F.col("i") >= F.col("quota"))
        y = permuted("over_before + i - quota", f"bigint({again})", f"{SEED + 2}")
        dealt = placed(plan, extra.select("shard", "slot", y.alias("y")), "y", s.select("sid", "first", F.col("short").alias("n"), "drawn"), again)
        index = index.union(dealt.select("shard", "slot", "sid", (F.col("drawn") + F.col("y") - F.col("first")).alias("i")))
    index = plan.by_source(index, "blocks")
    take = permuted("i % blocks", "blocks", f"xxhash64(sid, {SEED})")
    return index.select("shard", "slot", "sid", take.alias("block"), F.expr("i div blocks").alias("pass"))


def pieces(plan: Plan) -> DataFrame:
    """Each document's overlap with each of its source's blocks: document columns, ``block``, ``from``
    and ``n`` (words of the document)."""
    b = F.lit(plan.block).cast("long")
    first, last = F.floor(F.col("start") / b).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / b).cast("long")
    p = plan.docs.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("start"), F.col("block") * b)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    return p.withColumn("from", lo - F.col("start")).withColumn("n", hi - lo)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, with the number of slots that hold
    words of it and the first of them (``n_slots``, ``shard``, ``slot``; null if there is none)."""
    size = n_words(F.col("text"))
    plan = plan_mix(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("h")))
    key = ["doc_id", "sid", "size", "start"]
    # a piece meets as many slots as its block has: MAX_EPOCHS at most
    held = pieces(plan).join(slots(plan), ["sid", "block"], "left")
    place = F.min(F.when(F.col("slot").isNotNull(), F.struct("shard", "slot"))).alias("place")
    some = held.groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("n"))), F.lit(0)).cast("long").alias("taken"), F.count("slot").alias("n_slots"), place)
    none = plan.docs.where("size = 0").select(*key, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("n_slots"), F.lit(None).cast(some.schema["place"].dataType).alias("place"))
    out = plan.by_source(some.union(none), F.col("size").alias("source_size"), "target")
    return out.select("doc_id", "size", "source_size", "target", "taken", "n_slots", "place.shard", "place.slot")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a row for each piece of a document in a slot, with
    the piece's words and what stands between them. Partitions hold ranges of shards in order, rows stand
    by shard, slot and place in the block. A piece that is the whole document keeps its text as it is;
    ``n_chars`` follows the text."""
    cols = docs.columns
    key = storage.ROW_KEY
    keyed = storage.row_keyed(docs)
    plan = plan_mix(keyed.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*key).alias("h")))
    taken = pieces(plan).join(slots(plan), ["sid", "block"])
    # rows alike in all columns are one text here; their pieces come in groups of 64 copies
    takes = taken.groupBy("h", F.floor(F.col("start") / (64 * F.col("size")))).agg(F.collect_list(F.struct("shard", "slot", "start", "from", "n", "size")).alias("__takes"))
    takes = takes.select(*(F.col(f"h.{k}").alias(k) for k in key), "__takes")
    one = keyed.dropDuplicates(key)
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    j = one.join(takes.hint("merge"), key)
    whole = lambda t: t["n"] == t["size"]
    j = j.withColumn("__w", F.when(F.exists("__takes", lambda t: ~whole(t)), words)).withColumn("__t", F.explode("__takes")).drop("__takes")
    part = F.array_join(F.slice(F.col("__w"), (F.col("__t.from") + 1).cast("int"), F.col("__t.n").cast("int")), "")
    j = j.withColumn("text", F.when(whole(F.col("__t")), F.col("text")).otherwise(part)).drop("__w")
    if "n_chars" in cols:
        j = j.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    shards = -(-plan.slots // SHARD)
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # the mix has about as many words
    parts = max(1, min(shards, max(docs.sparkSession.sparkContext.defaultParallelism, held // PART_BYTES)))
    j = j.repartitionById(parts, F.floor(F.col("__t.shard") * parts / max(1, shards)).cast("int"))
    return j.sortWithinPartitions("__t.shard", "__t.slot", F.col("__t.start") + F.col("__t.from"), key[0]).select(*cols)


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(storage.read(spark, sf_dir, "documents"))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all documents, cut where blocks end, in order of its shards and slots. Documents
    without words, and words of blocks that no slot drew, are left out; others may come repeatedly."""
    return mixed_documents(docs)
