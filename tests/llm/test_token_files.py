import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronolith.llm import storage, token_files as T
from chronolith.llm.textops import chunks

SCHEMA = "doc_id long, text string, n_tokens long, mask string"
TEXTS = [
    "a plain text", "", None, "two  spaces and   three", " lead", "trail ", "a\n b \n\n c\t d   e  f", "it's we'll 'd x'", "<|endoftext|> is text",
    "é" * 3000, "x " * 2000, "!!! ! ...", "\x1c a \x85 b   c", "日本 語 text", " ", "   ", "a plain text",
    "foo.\nBar, baz.\nQux.", "a.b,c\n\nd .\nE 12.\n3", "x's.\ny", "aé. b,",
]


def want(rows):
    tok = Tokenizer.from_file(T.default_tokenizer())
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("seq,batch", [(8, 2), (64, 4)])
def test_round_trip(spark, seq, batch):
    rows = [(i * 7 % 23, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], SCHEMA).repartition(3)
    path = storage.new_path(spark, "t")
    manifest = T.write(df, path, seq=seq, batch=batch)
    got = [tuple(r) for r in T.read_back(spark, path, manifest).orderBy("start").collect()]
    assert got == want(rows)
    row = manifest.orderBy("part").first()
    _, stream = T.open_folder(path, row.folder)
    whole = np.concatenate(list(stream))
    for i in range(-(-len(whole) // seq)):
        ids, mask = T.sequence(path, row.folder, i, seq, batch)
        real = whole[i * seq : (i + 1) * seq]
        assert list(ids[: len(real)]) == list(real) and mask.true_count == len(real) and len(ids) == seq


def test_empty_table(spark):
    assert T.token_files(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows(spark):
    rows = [(3, "same")] * 3 + [(3, "other")]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA)
    got = T.token_files(spark, df).orderBy("start").collect()
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in want(rows))
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))


def one(texts):
    return next(chunks(pa.array(texts)))


def test_forgets(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 2)
    e = T.Encoder(T.default_tokenizer())
    for text in ("one two three", "four five", "one two three"):
        ids, n = e.encode(one([text]))
        assert list(ids) == e.tok.encode(text).ids and n[0] == len(ids)


ENC, PLAIN = T.Encoder(T.default_tokenizer()), Tokenizer.from_file(T.default_tokenizer())


def test_added_tokens_keep_their_ids():
    texts = ["<|endoftext|> is text", "plain, text", "a<|endoftext|><|endoftext|>b c", "", "x <|endoftext|"]
    ids, n = ENC.encode(one(texts))
    assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == 50256


def test_other_pre_tokenizers_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    enc, tok = T.Encoder(path), Tokenizer.from_file(path)
    texts = ["Hello, World's  end.\nNew line", "", "a.b,c 12 <|endoftext|> x"]
    ids, n = enc.encode(one(texts))
    assert not enc.cuts and [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_stage_keeps_the_order_of_its_files(spark, tmp_path):
    rows = [(i * 7 % 50, f"text number {i}", 0, "") for i in range(50)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "docs"))
    got = T.token_stage(spark, spark.read.parquet(str(tmp_path / "docs")), "")
    assert [r.doc_id for r in got.orderBy("start").collect()] == [r[0] for r in rows]
    assert got.files_path and [r.doc_id for r in T.token_stage(spark, spark.createDataFrame(rows, SCHEMA), "").orderBy("start").collect()] == sorted(r[0] for r in rows)


def placed_rows(spark, path, n=60):
    """Three files of ``n`` rows in all, whose ids don't ascend; rows in the order of the files."""
    texts = spark.range(n).selectExpr("id * 7 % 61 AS doc_id", "repeat(concat('text number ', id, ' '), int(id % 9)) AS text")
    texts.repartitionByRange(3, F.desc("doc_id")).sortWithinPartitions(F.xxhash64("doc_id")).write.option("parquet.block.row.count.limit", 5).parquet(path)
    back = spark.read.parquet(path)
    return [r.doc_id for r in back.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]


def test_stage_writes_files_as_they_are_read(spark, tmp_path, monkeypatch):
    ids = placed_rows(spark, path := str(tmp_path / "docs"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(path).collect()}
    monkeypatch.setattr(T, "write", lambda *_, **__: pytest.fail("texts are shuffled"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "500"):  # whole files, then pieces of them
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for rows in (spark.read.parquet(path), spark.read.parquet(path).where("doc_id % 3 = 1")):
                got = T.token_stage(spark, rows, "").orderBy("start").collect()
                left = [i for i in ids if rows.count() == len(ids) or i % 3 == 1]
                assert [tuple(r)[::3] for r in got] == [(i, crc) for i, _, _, crc in (want([(i, texts[i])])[0] for i in left)]
                n = [r.n_tokens for r in got]
                assert [r.start for r in got] == np.append(0, np.cumsum(n))[:-1].tolist()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_stage_puts_rows_that_were_dealt_out_back_in_order(spark, tmp_path):
    ids = placed_rows(spark, path := str(tmp_path / "docs"))
    for rows in (spark.read.parquet(path).repartition(4), spark.read.parquet(path).repartition(1), spark.read.parquet(path).orderBy("doc_id")):
        assert [r.doc_id for r in T.token_stage(spark, rows, "").orderBy("start").collect()] == ids
    empty = T.token_stage(spark, spark.read.parquet(path).where("doc_id < 0"), "")
    assert empty.collect() == [] and empty.files_path


@given(st.lists(st.text(alphabet=" \n\t.,'!ab1é日\u00a0\u2003\x1c\x85\r_sSt<|", max_size=25), min_size=1, max_size=8))
@settings(max_examples=400, deadline=None)
def test_same_ids_as_the_library(texts):
    ids, n = ENC.encode(one(texts))
    want = [x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_forgetting_pieces_changes_no_ids(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 40)
    enc, tok = T.Encoder(T.default_tokenizer()), Tokenizer.from_file(T.default_tokenizer())
    for i in range(30):
        texts = [f"common words stand here {i}", " ".join(f"rare{i}x{j}" for j in range(i)), "common words"]
        ids, n = enc.encode(one(texts))
        expected = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert list(ids) == sum(expected, []) and list(n) == list(map(len, expected))
        assert len(enc.keys) == len(enc.again) == len(enc.start) == len(enc.count)
