import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolith.llm import language_id as L
from chronolith.llm.textops import chunks, mix

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, lang_pred string, score string"


def hashed(gram):
    x = [0 if c == " " else ord(c) for c in gram]
    code = [lambda a: a | 1 << 62, lambda a, b: a << 21 | b | 1 << 63, lambda a, b, c: a << 42 | b << 21 | c][len(x) - 1](*x)
    return int(mix(np.array([code], np.uint64))[0] >> np.uint64(32))


def grams(text):
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    t = " " + " ".join(letters.split()) + " "
    if t.strip() == "":
        return Counter()
    out = Counter(c for c in t if c != " ")
    out.update(t[i : i + 2] for i in range(len(t) - 1))
    out.update(t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " ")
    return Counter({hashed(g): n for g, n in out.items()})


def ranked(c, n):
    return {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:n])}


def brute(train, texts, n=40):
    by = {}
    for t, lang in train:
        if lang is not None and t is not None:
            by.setdefault(lang, Counter()).update(grams(t))
    profiles = {k: ranked(c, n) for k, c in by.items()}
    out = []
    for t in texts:
        r = ranked(grams(t), n)
        if not r or not profiles:
            out.append(("und", 0.0))
            continue
        dist = {k: sum(abs(p[g] - i) if g in p else n for g, i in r.items()) for k, p in profiles.items()}
        best = min(sorted(dist), key=dist.get)
        out.append((best, 1 - dist[best] / (len(r) * n)))
    return out


def test_against_brute_force(spark):
    base = {"en": "the house and the garden of that man was with this", "de": "das haus und der garten von dem mann für ÜBER straße", "fr": "la maison été et le jardin où était l'homme ça", "日": "日本語の 文章 です 日本"}
    train = [(" ".join(t.split()[i:] + t.split()[: i + 2]), k) for k, t in base.items() for i in range(5)] + [("skip me", None), (None, "en"), ("", "de")]
    texts = ["the man and house", "der MANN, und: haus", "été l'homme", "日本 です", "", None, "123 --- !!", "x", "İstanbul ǅ", "the man und haus " * 3000]
    df = spark.createDataFrame([(i, t, k, "s", "", "") for i, (t, k) in enumerate(train)], DOCS).repartition(3)
    profiles = L.train(df, 40)
    rows = spark.createDataFrame([(i, t, None, "s", "", "") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(rows, profiles, 40).collect()}
    for i, (lang, score) in enumerate(brute(train, texts)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score)


def test_no_languages_and_no_rows(spark):
    none = pd.DataFrame({"lang": pd.Series([], dtype=object), "gram": pd.Series([], dtype="int64"), "rank": pd.Series([], dtype="int32")})
    df = spark.createDataFrame([(1, "abc", None, "", "", "")], DOCS)
    assert [(r.lang_pred, r.score) for r in L.identify(df, none).collect()] == [("und", 0.0)]
    assert L.train(df.where("false")).empty and L.identify(df.where("false"), none).collect() == []


def test_ngrams_stay_in_their_document():
    c = next(chunks(pa.array(["ab", "", "cd"])))
    doc, _ = L.ngrams(c)
    assert Counter(doc.tolist()) == Counter({0: 7, 2: 7})


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = L.op5_language_id(spark, SF).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got[0] > 0.98 and got[1] > 100


def test_stage_keeps_columns_and_known_languages(spark):
    rows = [(i, "the house and the garden" if i % 2 else "das haus und der garten", "en" if i % 2 else "de", "s", "mine", "too") for i in range(40)]
    rows += [(90, "12 34", "en", "s", "mine", "too"), (91, None, None, None, None, None), (None, "the garden", None, "s", "mine", "too")]
    df = spark.createDataFrame(rows, DOCS)
    out = L.language_stage(spark, df, "")
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {*range(40), None} and {r.lang_pred for r in out.collect()} == {"mine"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stage_rejects_junk_and_unlearned_languages(spark):
    rnd = random.Random(3)
    junk = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(3, 9))) for _ in range(100))
    az = "abcdefghijklmnopqrstuvwxyz"
    bad = [junk(az), junk("0123456789abcdef"), junk(az + az.upper())]
    bad.append("kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä")
    bad.append("wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(bad)], "doc_id long, text string, lang string").select(*[F.col(f.name).cast(f.dataType) for f in docs.schema])
    kept = {r.doc_id for r in L.language_stage(spark, docs.unionByName(more), "").select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_each_task_limits_its_ngrams(spark, capsys):
    """The rows of a language don't meet in one task: Spark keeps each task's first ones."""
    plan = []
    frame = type(spark.range(0))
    keep = frame.toPandas
    try:
        frame.toPandas = lambda self: (plan.append(self._jdf.queryExecution().toString()), keep(self))[1]
        L.train(spark.createDataFrame([("ab cd", "x")], "text string, lang string"))
    finally:
        frame.toPandas = keep
    assert "WindowGroupLimit" in plan[0]
