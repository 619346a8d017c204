"""A Merkle tree over a dataset: one root that fixes every row, and a proof for each row.

A row's leaf is the SHA-256 of its fields, each with its length. The leaves of a source, by ascending doc_id, are
the first level of its tree; runs of ``FANOUT`` nodes become their parents until one is left, and the sources'
roots, in order of sources, do likewise. A row's proof is its siblings level by level; folding a leaf with it gives
the root, unless the row was changed.

Ranks without a global sort: a row's place in its source is counted by a histogram of the digits of its id. The bits in which
a bucket's ids differ are cut into a leading digit (as wide as the bucket's size asks for, at most ``DIGIT`` bits);
counts by digit, added up in order, are the first ranks of the buckets below, and only buckets of over ``LIMIT``
rows are cut again. Rows of equal id are cut by their leaves' bits, and equal rows by a number that they got when the
leaves were written, so no bucket is too large to be put in order in a task.

A node's key is its rank's leading digits in base ``FANOUT``: ``rank div FANOUT**k`` at level k. A task reduces all rows
that share all but the last ``DEPTH`` digits, their longest prefix, through ``DEPTH`` levels, so 4 * 10**10 rows take five
rounds, each on 1 / 243 of the rows of the one before. Proofs go the same way down: a block gets the steps above it
once, and adds those of its own levels to them.

Defined results: a null field is '-'; text fields are counted in bytes of UTF-8. Rows without a source come first,
as do rows without an id in their source; rows of equal id stand in order of their leaves, and equal rows have places of their
own. doc_id and n_chars must be whole numbers (or strings of such). A null id isn't tampered with. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import storage

FANOUT, DEPTH = 3, 5
SPAN = FANOUT**DEPTH
LIMIT, DIGIT = 512, 12
#: Rows of a table that may be sent to all tasks; a larger one is met in so many parts of a key.
SMALL, PARTS = 20_000, 64
#: Bits of a leaf that part rows of equal ids.
LEAF_BITS = 60
_STEPS = "array<struct<before:string,after:string>>"


def node(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def _leaf(text: Column) -> Column:
    return F.sha2(F.concat(_field(F.col("doc_id").cast("long")), _field(F.col("source")), _field(F.col("lang")), _field(F.col("n_chars").cast("long")), _field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``tree`` (the source, with '' for null), doc_id, leaf, the leaf of the tampered row where it
    differs, and three whole numbers by which leaves are put in order."""
    tampered = (F.crc32(F.col("doc_id").cast("long").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    made = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        _leaf(F.col("text")).alias("leaf"),
        F.when(tampered, _leaf(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("bad"),
    )
    bits = F.conv(F.substring("leaf", 1, LEAF_BITS // 4), 16, 10).cast("long")
    by_leaf = bits - F.when(F.col("doc_id").isNull(), F.lit(1 << LEAF_BITS)).otherwise(F.lit(0))
    return made.withColumns({"k0": F.coalesce("doc_id", F.lit(-(1 << 63))), "k1": by_leaf, "k2": F.monotonically_increasing_id()})


KEYS = ("k0", "k1", "k2")


def _meet(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the one row that ``facts`` (a staged table) has for their key, however many rows share it."""
    if facts.count() <= SMALL:
        return rows.join(F.broadcast(facts), on)
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    own = F.pmod(F.xxhash64("leaf"), F.lit(PARTS)).cast("int")
    return rows.withColumn("__part", own).join(facts.withColumn("__part", part), [*on, "__part"]).drop("__part")


def _cut(rows: DataFrame, limit: int) -> DataFrame:
    """For each bucket (tree, bucket) its size, the key that parts it, and the shift that leaves its next digit."""
    sizes = rows.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("n"), *(f(k).alias(f"{f.__name__}_{k}") for k in KEYS for f in (F.min, F.max)))
    differs = [F.col(f"min_{k}") != F.col(f"max_{k}") for k in KEYS]
    key = F.when(differs[0], 0).when(differs[1], 1).otherwise(2)
    spread = F.element_at(F.array(*(F.col(f"min_{k}").bitwiseXOR(F.col(f"max_{k}")) for k in KEYS)), key + 1)
    bits = F.length(F.bin(spread))
    width = F.least(bits, F.lit(DIGIT), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / limit)).cast("int") + 2))
    shift = F.when(F.col("n") > limit, bits - width)  # null: the bucket stays whole
    return sizes.select("tree", "bucket", F.when(F.col("n") > limit, key).alias("key"), shift.alias("shift"))


def ranked(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of :func:`leaves` with ``idx``, their place in their tree from 0."""
    todo, out = rows.withColumns({"bucket": F.lit(""), "first": F.lit(0).cast("long")}), []
    while True:
        cuts = storage.stage(_cut(todo, limit), "merkle-cuts")
        digit = F.coalesce(F.expr("shiftright(CASE key WHEN 0 THEN k0 WHEN 1 THEN k1 ELSE k2 END, shift)"), F.lit(0).cast("long"))
        dealt = _meet(todo, cuts, ["tree", "bucket"]).withColumn("digit", digit).drop("key", "shift")
        by = ["tree", "bucket", "digit"]
        counts = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first("first").alias("first"))
        before = Window.partitionBy("tree", "bucket").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**DIGIT rows
        placed = counts.withColumn("first", F.col("first") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        buckets = storage.stage(placed, "merkle-buckets")
        within = dealt.drop("first").join(buckets, by)
        place = Window.partitionBy(*by).orderBy("k0", "k1", "leaf", "k2")
        done = within.where(F.col("n") <= limit).withColumn("idx", F.col("first") + F.row_number().over(place) - 1)
        out.append(done.select("tree", "idx", "doc_id", "leaf", "bad"))
        if not buckets.where(F.col("n") > limit).limit(1).count():
            break
        open_rows = within.where(F.col("n") > limit).withColumn("bucket", F.concat_ws("/", "bucket", F.col("digit").cast("string")))
        todo = storage.stage(open_rows.select(*rows.columns, "bucket", "first"), "merkle-open")
    for other in out[1:]:
        out[0] = out[0].union(other)
    return out[0]


def _height(n: int) -> int:
    """Levels above ``n`` nodes, at most DEPTH."""
    levels = 0
    while n > 1 and levels < DEPTH:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _levels(nodes: list[str], n: int) -> list[list[str]]:
    """The levels of a block in a tree whose lowest level has ``n`` nodes, from the block's nodes to its one root."""
    out = [nodes]
    for _ in range(_height(n)):
        nodes = [node(*nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        out.append(nodes)
    return out


def _steps(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Siblings before and after the i-th node and its ancestors in the block."""
    out = []
    for nodes in levels[:-1]:
        lo = i // FANOUT * FANOUT
        out.append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + FANOUT])))
        i //= FANOUT
    return out


def _reduced(key: tuple, t: pa.Table) -> pa.Table:
    t = t.sort_by("idx")
    n = t["n"][0].as_py()
    top = _levels(t["node"].to_pylist(), n)[-1]
    return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "idx": [key[1].as_py()], "node": top, "n": [-(-n // SPAN)]})


def _block() -> Column:
    return F.expr(f"idx div {SPAN}").alias("block")


def rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes (tree, idx, node, n) that each round of reductions starts from, and the trees' roots
    (tree, node, ``turn``: the round that made it)."""
    given, roots = [nodes], None
    while True:
        made = given[-1].select("tree", "idx", "node", "n", _block()).groupBy("tree", "block").applyInArrow(_reduced, "tree string, idx long, node string, n long")
        made = storage.stage(made, "merkle-nodes")
        own = made.where("n = 1").select("tree", "node", F.lit(len(given) - 1).alias("turn"))
        roots = own if roots is None else roots.union(own)
        if not made.where("n > 1").limit(1).count():
            return given, roots
        given.append(made.where("n > 1"))


def _stepped(key: tuple, t: pa.Table, above: pa.Table) -> pa.Table:
    t = t.sort_by("idx")
    levels, rest = _levels(t["node"].to_pylist(), t["n"][0].as_py()), above["steps"][0].as_py()
    rest = [(s["before"], s["after"]) for s in rest]
    steps = [[{"before": a, "after": b} for a, b in _steps(levels, i) + rest] for i in range(len(t))]
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.table({"tree": t["tree"], "idx": t["idx"], "steps": pa.array(steps, kind)})


def _beside(left: DataFrame, above: DataFrame):
    """Blocks with the steps above them; new names part columns that both sides have from one table."""
    return left.groupBy("tree", "block").cogroup(above.toDF(*(f"above_{c}" if c in ("tree", "block") else c for c in above.columns)).groupBy("above_tree", "above_block"))


def _above(given: list[DataFrame], roots: DataFrame, top: DataFrame) -> DataFrame:
    """tree, block and ``steps`` above each block of the first round; ``top`` has those above each tree."""
    ends = roots.join(top, "tree").select("tree", F.lit(0).cast("long").alias("block"), "steps", "turn")
    above = None
    for k in range(len(given) - 1, -1, -1):
        own = ends.where(F.col("turn") == k).select("tree", "block", "steps")
        above = own if above is None else own.union(above)
        if k:
            made = _beside(given[k].select("tree", "idx", "node", "n", _block()), above).applyInArrow(_stepped, f"tree string, idx long, steps {_STEPS}")
            above = storage.stage(made.withColumnRenamed("idx", "block"), "merkle-steps")
    return above


def _proved(key: tuple, t: pa.Table, above: pa.Table) -> pa.Table:
    t = t.sort_by("idx")
    own = t["node"].to_pylist()
    levels, subroot = _levels(own, t["n"][0].as_py()), above["subroot"][0].as_py()
    rest = [(s["before"], s["after"]) for s in above["steps"][0].as_py()]
    proofs, folded = [], []
    for i, bad in enumerate(t["bad"].to_pylist()):
        x, steps = bad or own[i], _steps(levels, i) + rest
        for a, b in steps:
            x = node(a, x, b)
        folded.append(x)
        proofs.append(node(*(y for s in steps for y in s)))
    return pa.table({"doc_id": t["doc_id"], "leaf": t["node"], "subroot": pa.array([subroot] * len(own), pa.string()), "proof_sha256": proofs, "folded_root": folded})


def _in_order(roots: DataFrame) -> DataFrame:
    """Trees' roots as the nodes of one tree, in order of trees: a range partitioning, and counts by partition."""
    made = storage.stage(roots.select("tree", "node").orderBy("tree").withColumn("m", F.monotonically_increasing_id()), "merkle-roots")
    part = F.shiftright("m", 33).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    first = made.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy()).alias("n"))
    idx = F.col("first") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    return made.select("tree", "node", part, "m").join(first, "part").select(F.col("tree").alias("name"), F.lit("").alias("tree"), idx.alias("idx"), "node", "n")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    rows = storage.stage(leaves(docs), "merkle-leaves")
    placed = storage.stage(ranked(rows), "merkle-ranks")
    sizes = storage.stage(placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "merkle-sizes")
    first = _meet(placed, sizes, ["tree"]).withColumnRenamed("leaf", "node")
    given, subroots = rounds(first)
    trees = storage.stage(_in_order(subroots), "merkle-trees")
    top_given, top = rounds(trees)
    found = top.first()
    nothing = F.array().cast(_STEPS)
    root = found.node if found else ""
    over = _above(top_given, top, top.select("tree", nothing.alias("steps")))
    steps = _beside(trees.select("tree", "idx", "node", "n", _block()), over).applyInArrow(_stepped, f"tree string, idx long, steps {_STEPS}")
    by_tree = storage.stage(trees.drop("tree").join(steps.drop("tree"), "idx").select(F.col("name").alias("tree"), "steps"), "merkle-steps")
    above = _above(given, subroots, by_tree).join(subroots.select("tree", F.col("node").alias("subroot")), "tree")
    made = _beside(first.select("tree", "idx", "node", "n", "doc_id", "bad", _block()), above).applyInArrow(_proved, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return made.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(storage.read(spark, sf_dir, "documents"))


#: Run of nodes in a level, siblings of each node of it, and the fold over all of a row's levels. An even checksum is one
#: whose reduced register, before its last inversion, is odd.
OP13_SQL = r"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS id, doc_id, text, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))) AS register
  FROM documents
), l AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN register & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS left_over
  FROM f
), x AS (
  SELECT id, doc_id, s, leaf, sha256(head || coalesce(strlen(left_over) || ':' || left_over, '-')) AS found,
    row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY s) AS n
  FROM l
), t AS (
  SELECT s, 0 AS lvl, idx, leaf AS node, n FROM x
  UNION ALL
  SELECT s, lvl + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY s, lvl, idx // 3, n
), p AS (
  SELECT 0 AS lvl, s AS idx, node, count(*) OVER () AS n FROM t WHERE n = 1
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (n + 2) // 3 FROM p WHERE n > 1 GROUP BY lvl, idx // 3, n
), every AS (
  SELECT s, lvl, idx, node, n FROM t UNION ALL SELECT -1, lvl, idx, node, n FROM p
), sib AS (
  SELECT a.s, a.lvl, a.idx, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
    coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM every a JOIN every b ON a.s = b.s AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY a.s, a.lvl, a.idx
), step AS (
  SELECT x.id, sib.lvl AS place, before, after FROM x JOIN sib ON sib.s = x.s AND sib.idx = x.idx // power(3, sib.lvl)::BIGINT
  UNION ALL
  SELECT x.id, 1000 + sib.lvl, before, after FROM x JOIN sib ON sib.s = -1 AND sib.idx = x.s // power(3, sib.lvl)::BIGINT
), path AS (
  SELECT id, string_agg(before || after, '' ORDER BY place) AS proof, list(before || '|' || after ORDER BY place) AS steps FROM step GROUP BY id
), done AS (
  SELECT x.doc_id, x.leaf, t.node AS subroot, p.node AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(x.found, coalesce(steps, [])), lambda h, st: sha256(split_part(st, '|', 1) || h || split_part(st, '|', 2))) AS folded_root
  FROM x JOIN t ON t.s = x.s AND t.n = 1 JOIN p ON p.n = 1 LEFT JOIN path ON path.id = x.id
)
SELECT *, folded_root = root AS verified FROM done
"""
