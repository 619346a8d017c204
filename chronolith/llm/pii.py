"""Personal data: base patterns, and bootstrapped contextual extraction, with DataFrame functions only.

Base spans come from four patterns (e-mail, IP, card, phone), leftmost and non-overlapping by kind;
matches that fail their check are dropped. They seed the bootstrap:

1. Candidates are runs of 1 to ``RUN`` white-space words, single spaces between them, each with a digit,
   an @ or an underscore, that no base span touches; without the marks around them they have ``LEAST``
   characters or more. What has a card's or an IP's form and fails its check is no candidate.
2. Each occurrence of a seed or candidate has patterns, each with a word of its context: the word before it, the two words
   before, the label (a word that ends in a colon, an equals sign or a number sign) among the ``NEAR`` words before, the word
   after; the word before or after with the value's shape (digits 0, runs of letters a); and each of the ``NEAR`` words
   before and after with its coarse shape (runs of digits as one). No pattern is a shape alone: what a value looks like counts
   only in a context that seeds have. Context words are lower-cased, without marks around them and with 0 for digits; they are looked for
   in ``CONTEXT`` characters on either side, whatever matches stand there.
3. Patterns and distinct values form a bipartite graph. A pattern's score for a kind is the summed
   score of its values over their number plus one; a seed scores 1 for its kind. Patterns of
   ``MIN_SUPPORT`` values' worth and ``MIN_PATTERN`` or more are trusted.
4. A candidate's score for a kind is 1 - product(1 - score) over its trusted patterns, and 1 if its value is
   also a seed; it has the kind it scores best for (ties: first by name). Steps 3 and 4 repeat
   ``ROUNDS`` times, or until nothing changes: promoted values support new patterns.
5. Values that score ``MIN_VALUE`` or more become spans of the kind ``ctx_<kind>`` wherever they are
   candidates: of those that begin at one place the one of the best score (ties: the longest), unless it lies inside another such
   span. A value that begins where better ones do, and is the best at no such place, is a piece of theirs and gives no span. Base
   spans stay as they are.

Only distinct (pattern, value) pairs are joined, patterns of fewer than ``MIN_SUPPORT`` values never (they can't be trusted
in any round), and sums are pre-aggregated, so that a very common word or value is one row. The text is read once; what the rounds need is written in between.

Regular expressions differ from the plain ones only in that they can't backtrack: possessive
repeats where the next character can't belong to the repeat, and starts bound to the beginning of a
run (or the end of the last match), so that time is linear in the text. Candidates are built by sorting
a document's words and spans, which is linear but for the sort.

Rows are joined on two 64-bit hashes of doc_id and text, 128 bits in all: among 10**12 documents some two
share them with odds of 10**-15.

Defined results: a null text is empty and has no spans. Repeated rows give repeated results. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import storage

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A text without this has no span of the kind.
NEEDS = {"email": None, "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": None}
WORD = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@_]*+[0-9@_])[^\x20\x09-\x0D]++"
#: Marks before a candidate; a parenthesis that closes before its end belongs to it.
LEAD = r"^(?!\([^()]*+\)[\x20-])[^\p{L}\p{N}+@_]*+"
RUN, LEAST, CONTEXT = 6, 6, 128
NEAR = 4
MIN_SUPPORT, MIN_PATTERN, MIN_VALUE, ROUNDS = 5.0, 0.7, 0.7, 4
#: Block of the two-level running sum below.
_BLOCK = 256

SPAN = "struct<start:long,end:long,value:string,before:string,after:string>"
ROW = ["row", "row2"]


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once; written out in a lambda it would be evaluated for each element."""
    return F.transform(F.array(x), f)[0]


def running(lengths: Column) -> Column:
    """Sums of all earlier elements, for each element of an array of longs. Sums run within blocks
    and over block totals, as appending to one array is quadratic in its length."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")

    def prefix(x: Column) -> Column:
        start = F.struct(zero.alias("sum"), none.alias("out"))
        step = lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(x, start, step, lambda acc: acc["out"])

    def sums(blocks: Column) -> Column:
        bases = prefix(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, v: a + v)))
        return F.flatten(F.zip_with(blocks, bases, lambda b, base: F.transform(prefix(b), lambda v: v + base)))

    def blocked(x: Column) -> Column:
        n = F.size(x)
        firsts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(firsts, lambda i: F.slice(x, i, _BLOCK)), sums)

    return let(lengths, blocked)


def found(text: Column, pattern: str) -> Column:
    """All matches with their code point spans and ``CONTEXT`` characters around them, of matches or not.
    Matches and the text between them come from the same search, so lengths add up to positions."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(cut: Column) -> Column:
        ahead = running(F.transform(cut, lambda x: (F.length(x["gap"]) + F.length(x["value"])).cast("long")))
        return F.zip_with(cut, ahead, span)

    def span(x: Column, base: Column) -> Column:
        start = base + F.length(x["gap"])
        near = lambda a, b: F.concat(a, b)
        return F.struct(
            start.cast("long").alias("start"), (start + F.length(x["value"])).cast("long").alias("end"), x["value"].alias("value"),
            F.right(near(x["last"], F.right(x["gap"], F.lit(CONTEXT))), F.lit(CONTEXT)).alias("before"),
            F.left(near(F.left(x["next_gap"], F.lit(CONTEXT)), x["next"]), F.lit(CONTEXT)).alias("after"),
        )

    def zipped(gaps: Column) -> Column:
        n = F.size(gaps) - 1
        edge = lambda side, x: F.transform(x, lambda v: side(v, F.lit(CONTEXT)))
        none = F.array(F.lit(""))
        around = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), lambda g, h: F.struct(g.alias("gap"), h.alias("next_gap")))
        near = F.zip_with(F.slice(F.concat(none, edge(F.right, m)), F.lit(1), n), F.slice(F.concat(edge(F.left, m), none), F.lit(2), n), lambda a, z: F.struct(a.alias("last"), z.alias("next")))
        cut = F.zip_with(m, F.zip_with(around, near, lambda g, v: F.struct(g["gap"].alias("gap"), g["next_gap"].alias("next_gap"), v["last"].alias("last"), v["next"].alias("next"))),
                         lambda x, g: F.struct(x.alias("value"), g["gap"].alias("gap"), g["next_gap"].alias("next_gap"), g["last"].alias("last"), g["next"].alias("next")))
        return let(cut, spans)

    return let(F.split(text, pattern, -1), zipped)


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    need = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind)
    need = text.rlike(NEEDS[kind]) if need is None else need
    kept = F.filter(found(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.when(need, kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def spotted(docs: DataFrame) -> DataFrame:
    """Row key, doc_id, base spans by kind, and ``words`` that may be part of a candidate, for every document."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("row2", F.xxhash64(F.lit(8), "text", "doc_id"))
    for k in KINDS:
        d = d.withColumn(k, base_spans(F.col("text"), k))
    some = F.when(F.col("text").rlike("[0-9@_]"), found(F.col("text"), WORD)).otherwise(F.array().cast(f"array<{SPAN}>"))
    return d.withColumn("words", some).drop("text")


def occurrences(spots: DataFrame) -> DataFrame:
    """Row key, ``kind`` (null for a candidate), start, end, value and context of seeds and candidates. Repeated
    rows give theirs once."""
    some = spots.where(F.size("words") + F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0)
    one = some.dropDuplicates(ROW)

    def of(col: str, kind: str) -> Column:
        return F.transform(F.col(col), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s")))

    each = one.select(*ROW, F.explode(F.concat(*(of(k, k) for k in KINDS), of("words", "word"))).alias("x")).select(*ROW, "x.kind", "x.s.*")
    seeds, word = each.where("kind <> 'word'"), F.col("kind") == "word"
    # a document's words and spans in order: a word is free if no span before it reaches it and none begins in it
    so_far = lambda *o: Window.partitionBy(*ROW).orderBy(*o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(~word, F.col("end"))).over(so_far("start", F.desc("end")))
    begin = F.min(F.when(~word, F.col("start"))).over(so_far(F.desc("start"), "end"))
    free = each.withColumn("reach", F.coalesce(reach, F.lit(-1))).withColumn("begin", begin).where(word & (F.col("reach") <= F.col("start")) & (F.col("begin").isNull() | (F.col("begin") >= F.col("end"))))
    free = free.drop("reach", "begin", "kind")
    # runs: the next words as long as one space parts them
    order = Window.partitionBy(*ROW).orderBy("start")
    ahead = F.collect_list(F.struct("start", "end", "value", "after")).over(order.rowsBetween(0, RUN - 1))
    joined = lambda xs, i: F.forall(F.sequence(F.lit(1), i), lambda j: xs[j]["start"] == xs[j - 1]["end"] + 1)
    sizes = F.filter(F.sequence(F.lit(0), F.size("ahead") - 1), lambda i: (i == 0) | joined(F.col("ahead"), i))
    runs = F.transform(sizes, lambda i: F.struct(F.col("ahead")[i]["end"].alias("end"), F.array_join(F.transform(F.slice(F.col("ahead"), F.lit(1), i + 1), lambda w: w["value"]), " ").alias("value"), F.col("ahead")[i]["after"].alias("after")))
    c = free.withColumn("ahead", ahead).withColumn("r", F.explode(runs)).select(*ROW, "start", "before", "r.value", "r.after")
    # without the marks around it
    lead = F.length(F.regexp_extract("value", LEAD, 0))
    c = c.withColumn("lead", lead).withColumn("value", F.regexp_replace("value", LEAD + r"|(?<=[\p{L}\p{N}_])[^\p{L}\p{N}_]++$", ""))
    c = c.withColumn("start", F.col("start") + F.col("lead")).withColumn("end", F.col("start") + F.length("value"))
    c = c.where((F.length("value") >= LEAST) & F.col("value").rlike("[0-9@_]") & ~failed(F.col("value")))
    cols = [*ROW, "kind", "start", "end", "value", "before", "after"]
    return seeds.select(*cols).union(c.withColumn("kind", F.lit(None).cast("string")).select(*cols))


def failed(value: Column) -> Column:
    """Has the form of a card or an IP, but not its check sum or range."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    card = value.rlike(r"^[0-9](?:[\x20-]?[0-9])++$") & F.length(digits).between(16, 19) & ~_valid("card", value)
    return card | (value.rlike(r"^[0-9]++(?:\.[0-9]++){3}$") & ~_valid("ip", value))


def shape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}++", "a"), "[0-9]", "0")


def lexical_patterns(value: Column, before: Column, after: Column) -> Column:
    """Patterns of an occurrence, each with a mark of what it is and at least one context word."""
    plain = lambda w: F.regexp_replace(F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}+@]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", ""), "[0-9]", "0")
    blank = r"[\x20\x09-\x0D]+"
    short = lambda w: (w != "") & (F.length(w) <= 60)
    # the first word before and the last one after may be cut off where the context ends
    ahead = F.split(before, blank)
    ahead = F.filter(F.when(F.length(before) >= CONTEXT, F.slice(ahead, F.lit(2), F.size(ahead))).otherwise(ahead), short)
    ahead = F.reverse(F.slice(F.reverse(ahead), 1, NEAR))
    behind = F.split(after, blank)
    last = F.when(F.length(after) >= CONTEXT, F.size(behind) - 2).otherwise(F.size(behind) - 1)
    behind = F.slice(F.filter(F.slice(behind, F.lit(2), F.greatest(F.lit(0), last)), short), 1, NEAR)

    def made(x: Column) -> Column:
        form, near = x["form"], x["ahead"]
        coarse = F.regexp_replace(form, "0++", "0")
        one, two, right = F.try_element_at(near, F.lit(-1)), F.try_element_at(near, F.lit(-2)), F.try_element_at(x["behind"], F.lit(1))
        some = F.array(
            F.concat(F.lit("1< "), one), F.concat(F.lit("1<= "), one, F.lit(" "), form), F.concat(F.lit("2< "), two, F.lit(" "), one),
            F.concat(F.lit(">1 "), right), F.concat(F.lit("=>1 "), form, F.lit(" "), right), F.concat(F.lit("l< "), x["label"]),
        )
        bag = lambda side, ws: F.transform(ws, lambda w: F.concat(F.lit(side), w, F.lit(" "), coarse))
        return F.array_compact(F.concat(some, bag("b<= ", near), bag("=>b ", x["behind"])))

    words = lambda ws: F.filter(F.transform(ws, plain), lambda w: w != "")
    label = F.try_element_at(F.filter(ahead, lambda w: w.rlike(r"[\p{L}\p{N}][:=#]++$")), F.lit(-1))
    return let(F.struct(shape(value).alias("form"), words(ahead).alias("ahead"), words(behind).alias("behind"), plain(label).alias("label")), made)


def edges(found_: DataFrame) -> DataFrame:
    """Distinct (pattern, value, kind); kind is null for a candidate."""
    return found_.select("kind", "value", F.explode(lexical_patterns(F.col("value"), F.col("before"), F.col("after"))).alias("pattern")).distinct()


def bootstrap(graph: DataFrame) -> DataFrame:
    """Candidate values and the kind and score that the graph gives them."""
    held = graph.groupBy("pattern").agg(F.count_distinct("value").alias("values")).where(F.col("values") >= MIN_SUPPORT)
    again = graph.where("kind IS NOT NULL").select("value", "kind").distinct().join(graph.where("kind IS NULL").select("value").distinct().hint("merge"), "value", "left_semi").withColumn("score", F.lit(1.0))
    graph = storage.stage(graph.join(held.hint("merge"), "pattern"), "pii-shared")
    held = graph.select("pattern", "values").distinct()
    seeds = graph.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count_distinct("value").cast("double").alias("score"))
    free = graph.where("kind IS NULL").select("pattern", "value")
    known, before = storage.stage(again, "pii-values"), None
    for _ in range(ROUNDS):
        # the values known differ from the seeds of the same pattern, or count there already
        lone = graph.where("kind IS NOT NULL").select("pattern", "value", "kind")
        gained = free.join(known.hint("merge"), "value").join(lone.hint("merge"), ["pattern", "value", "kind"], "left_anti").groupBy("pattern", "kind").agg(F.sum("score").alias("score"))
        total = seeds.unionByName(gained).groupBy("pattern", "kind").agg(F.sum("score").alias("support"))
        trusted = total.where(F.col("support") >= MIN_SUPPORT).join(held.hint("merge"), "pattern").withColumn("trust", F.col("support") / (F.col("values") + 1)).where(F.col("trust") >= MIN_PATTERN)
        scored = free.join(trusted.hint("merge"), "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        best = scored.unionByName(again).groupBy("value", "kind").agg(F.max("score").alias("score"))
        best = best.groupBy("value").agg(F.min_by(F.struct("kind", "score"), F.struct(-F.col("score"), F.col("kind"))).alias("b")).select("value", "b.kind", "b.score")
        after = storage.stage(best.where(F.col("score") >= MIN_VALUE), "pii-values")
        now = tuple(after.agg(F.count(F.lit(1)), F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 6)).first())
        known = after
        if now == before:
            break
        before = now
    return known


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, ``base`` and ``added`` spans (kind, start, end, value)."""
    spots = storage.stage(spotted(docs), "pii-spots")
    seen = storage.stage(occurrences(spots), "pii-occurrences")
    values = bootstrap(storage.stage(edges(seen), "pii-graph")).select("value", F.concat(F.lit("ctx_"), "kind").alias("kind"), F.round("score", 9).alias("score"))
    at = seen.where("kind IS NULL").drop("kind").join(values.hint("merge"), "value")
    start = Window.partitionBy(*ROW, "start")  # at most RUN rows
    ranked = storage.stage(at.withColumns({"best": F.row_number().over(start.orderBy(F.desc("score"), F.desc("end"))), "rivals": F.count(F.lit(1)).over(start)}), "pii-ranked")
    contested = ranked.where("rivals > 1").groupBy("value").agg(F.min("best").alias("best"))
    whole = ranked.join(contested.where("best > 1").select("value").hint("merge"), "value", "left_anti")
    at = whole.withColumn("best", F.row_number().over(start.orderBy(F.desc("score"), F.desc("end")))).where("best = 1").drop("best", "score", "rivals")
    outer = F.max("end").over(Window.partitionBy(*ROW).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn("outer", outer).where(F.col("outer").isNull() | (F.col("end") > F.col("outer")))
    added = at.groupBy(*ROW).agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end", "value"))).alias("added"))
    pack = lambda k: F.transform(F.col(k), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    base = spots.select(*ROW, "doc_id", F.concat(*map(pack, KINDS)).alias("base"))
    none = F.array().cast("array<struct<kind:string,start:long,end:long,value:string>>")
    return base.join(added.hint("merge"), ROW, "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    out = personal_data(storage.read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = _joined(F.col("base"))
    return out.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))
