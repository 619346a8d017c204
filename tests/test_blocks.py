import random

import pytest
from pyspark.sql import functions as F

from chronolith.operators import blocks as K, folds as R, late_results as L
from chronolith.streaming import ingest

GAMES = "u string, day int, game long, a long, b long, y int, surface string"


def games(seed, n=260, days=40):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.sample(range(9), 2)
        rows.append((f"u{i % 3}", r.randrange(days), i, a, b, r.randrange(2), r.choice(["hard", "clay", None])))
    return rows


def full(spark, rows):
    d = spark.createDataFrame(rows, GAMES).withColumn("opponent", F.col("b"))
    out = R.elo_block(d, ["u"], "day", ["game"], "a", "b", "y", "surface", ["game"])
    return {r.game: tuple(round(x, 8) for x in r[2:]) for r in out.collect()}


def stored(store):
    cols = ("elo_a", "elo_b", "surface_a", "surface_b", "games_a", "games_b", "expected")
    return {r.game: tuple(round(r[c], 8) for c in cols) for r in store.read("rated").collect()}


def test_a_killed_run_resumes_and_a_changed_block_restarts(spark, tmp_path, monkeypatch):
    rows = games(1)
    df = spark.createDataFrame(rows, GAMES)
    store = K.BlockStore(spark, f"file://{tmp_path}/s", "u", ["game"])
    assert store.run(df, span=15, stop_after=1) == 1 and 0 < len(stored(store)) < len(rows)
    # a span that dies before its marker leaves nothing behind
    seen = K.changed_states
    monkeypatch.setattr(K, "changed_states", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.run(df, span=15)
    monkeypatch.setattr(K, "changed_states", seen)
    assert store.generations() == [1]
    assert store.run(df, span=15) == 2
    assert stored(store) == full(spark, rows)
    assert store.run(df, span=15) == 0  # nothing to do
    # one result is corrected, one game is new, one block loses its only game
    fixed = [(*r[:5], 1 - r[5], r[6]) if r[2] == 200 else r for r in rows if r[2] != 7] + [("u1", 35, 999, 1, 2, 1, "hard")]
    before = stored(store)
    assert store.run(spark.createDataFrame(fixed, GAMES)) == 1
    after = stored(store)
    assert after == full(spark, fixed)
    first = min(r[1] for r in rows if r[2] in (200, 7) and r[0] == rows[200][0])
    same = [r[2] for r in rows if r[0] == rows[200][0] and r[1] < min(first, 35)]
    assert all(before[g] == after[g] for g in same)
    # states read back are those of a run over all
    ends = {(r.u, r.entity, r.kind): r for r in store.read("states").collect()}
    assert {k[2] for k in ends} == {"general", "hard", "clay"}


def test_preview_is_the_first_half_of_the_block(spark, tmp_path):
    rows = games(2, 120)
    df = spark.createDataFrame(rows, GAMES)
    store = K.BlockStore(spark, f"file://{tmp_path}/p", "u", ["game"])
    store.run(df, span=1000)
    states = store.read("states")
    out = {r.game: r for r in K.preview(states, df.drop("y"), "u").collect()}
    want = stored(store)
    assert len(out) == len(rows)
    for g, r in out.items():
        assert (round(r.elo_a, 8), round(r.elo_b, 8), round(r.surface_a, 8), round(r.surface_b, 8), r.games_a, r.games_b, round(r.expected, 8)) == want[g]
    assert store.read("states").count() == states.count()
    late = K.preview(states, spark.createDataFrame([("u0", 999, 5, 77, 0, 1, "grass")], GAMES), "u").first()
    assert (late.elo_a, late.games_a, late.surface_b) == (1500.0, 0, 1500.0)


def test_days_without_times_are_frozen(spark):
    rows = [("u", d, i, *random.Random(i).sample(range(4), 2), i % 2, "x" if d != 1 else None) for i, d in enumerate([0, 0, 0, 1, 1, 1, 2, 2])]
    df = K.frozen_days(spark.createDataFrame(rows, GAMES), "u", "day", F.col("surface").isNull() & (F.col("game") == 4))
    out = R.mixed_days(df, ["u"], "day", ["game"], "a", "b", "y", "frozen", ["game", "a", "b", "day"]).orderBy("game").collect()
    state = {}

    def observe(a, b, y):
        p, q = state.get(a, 1500.0), state.get(b, 1500.0)
        e = 1 / (1 + 10 ** ((q - p) / 400))
        state[a], state[b] = p + 32 * (y - e), q - 32 * (y - e)

    for day in (0, 1, 2):
        todo = [r for r in rows if r[1] == day]
        for i, r in enumerate(todo):
            if day == 1 and i == 0:
                frozen = dict(state)
            at = frozen if day == 1 else state
            got = out[r[2]]
            assert (got.rating_a, got.rating_b) == pytest.approx((at.get(r[3], 1500.0), at.get(r[4], 1500.0)))
            observe(r[3], r[4], r[5])
    every = K.frozen_days(df.drop("frozen"), "u", "day", F.lit(False), freeze=True)
    assert {r.frozen for r in every.collect()} == {True}


RESULTS, ASKS = "e long, played int, known int, won int", "e long, day int, ask long"


def brute(results, asks):
    out = {}
    for e, day, ask in asks:
        seen = sorted((p, w or 0) for x, p, k, w in results if x == e and max(p, k) < day and p < day)
        days = sorted({p for p, _ in seen}, reverse=True)
        won = n = 0
        for d in days:
            if n >= L.LAST:
                break
            block = [w for p, w in seen if p == d]
            won, n = won + sum(block), n + len(block)
        near = [w for p, w in seen if p >= day - L.DAYS]
        out[ask] = (won / n if n else None, n, sum(near) / len(near) if near else None, len(near), day - days[0] if days else None)
    return out


def cases(seed):
    r = random.Random(seed)
    results = [(r.randrange(3), p := r.randrange(300), p + r.choice([0, 0, 1, 5, 120]), r.randrange(2)) for _ in range(260)]
    return results, [(r.randrange(4), r.randrange(320), i) for i in range(150)]


def test_late_results_change_only_what_is_asked_later(spark):
    results, asks = cases(3)
    form = lambda rs: {r.ask: (r.recent_rate, r.recent_games, r.form_rate, r.form_games, r.rest_days) for r in L.form_as_known(spark.createDataFrame(rs, RESULTS), spark.createDataFrame(asks, ASKS), "e").collect()}
    got = form(results)
    assert got == brute(results, asks)
    late = [*results, (1, 100, 250, 1)]
    after = form(late)
    assert after == brute(late, asks)
    changed = {a for a in got if got[a] != after[a]}
    assert all(e == 1 and day > 250 for e, day, ask in asks if ask in changed)


def test_late_results_in_a_stream(spark, tmp_path):
    """Micro-batches by the day on which things came; the last result is late by months."""
    results, asks = cases(4)
    rows = L._sequence(spark.createDataFrame(results, RESULTS), spark.createDataFrame(asks, ASKS), "e")
    src = str(tmp_path / "in")
    for lo in range(0, 500, 60):
        rows.where((F.col("at") >= lo) & (F.col("at") < lo + 60)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    L.form_stream(stream, "e").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    out = {r.ask: (r.recent_rate, r.recent_games, r.form_rate, r.form_games, r.rest_days) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = brute(results, asks)
    assert {a: tuple(None if x is None or x != x else x for x in v) for a, v in out.items()} == want


def test_a_run_is_taken_once_and_whole(spark, tmp_path):
    kind = "run string, key long, n long, value string"
    one = [("r1", i, 4, f"a{i}") for i in range(4)]
    two = [("r2", i, 3, f"b{i}") for i in range(3)]

    def send(name, rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def take(store, name, state):
        store.take(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)), f"file://{tmp_path}/{state}")

    whole = ingest.RunStore(spark, f"file://{tmp_path}/whole", ["run"], ["key"], "n")
    send("a", one + two)
    take(whole, "a", "ca")
    cut = ingest.RunStore(spark, f"file://{tmp_path}/cut", ["run"], ["key"], "n")
    send("b", one + two[:2])  # the second run is cut off
    take(cut, "b", "cb")
    assert {r.run for r in cut.rows().collect()} == {"r1"}
    assert {(r.run, r.arrived, r.complete) for r in cut.runs().collect()} == {("r1", 4, True), ("r2", 2, False)}
    send("b", one)  # the first one comes twice
    send("b", two[1:])
    take(cut, "b", "cb")
    take(cut, "b", "cb")  # nothing new
    rows = lambda s: sorted(tuple(r) for r in s.rows().select("run", "key", "value").collect())
    assert rows(cut) == rows(whole) == sorted((r, k, v) for r, k, _, v in one + two)
    assert sorted((r.run, r.key) for r in cut.latest(["run"]).collect()) == [("r1", 3), ("r2", 0), ("r2", 1), ("r2", 2)]
    send("b", [("r2", 0, 3, "other")])
    take(cut, "b", "cb")
    assert {r.run: r.complete for r in cut.runs().collect()} == {"r1": True, "r2": False}
