import hashlib
import json
import os
import random

import pytest
from tokenizers import Tokenizer

from chronolith.llm import bpe_codec as B
from chronolith.llm.token_files import default_tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, ids string, n_tokens int, decoded_sha256 string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def enc():
    return B.PrefixEncoder(default_tokenizer())


def hostile(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "b", "e", "the", "'s", "'ll", "'", "é", "ß", "日", "😀", "1", "22", "===", "--", "<|endoftext|>", "<|endof", "x" * 50, "ing", "tion", "A", "́", "ﷺ", "\x00", " ", "\u0085"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_same_ids_and_text_as_the_library(lib, enc):
    texts = [*hostile(1, 4000), "", "x" * 30000, " " * 20000, "ab" * 20000, "\n" * 9000, "<|endoftext|>" * 300]
    got = enc._ids(texts)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert all(enc.decode(i) == lib.decode(i, skip_special_tokens=False) == t for i, t in zip(got, texts, strict=True))


def test_every_token_of_the_vocabulary(lib, enc):
    names = [enc.raw[i].decode("utf-8", "ignore") for i in sorted(enc.raw)]
    assert enc._ids(names) == [e.ids for e in lib.encode_batch(names, add_special_tokens=False)]


def test_broken_id_sequences(lib, enc):
    r = random.Random(3)
    for _ in range(500):
        ids = [r.randrange(50257) for _ in range(r.randint(1, 9))]
        assert enc.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert enc.decode([10**6, 40]) == lib.decode([40])


def small_file(path, merges, **model):
    letters = B.byte_alphabet()
    names = [*letters, *dict.fromkeys(a + b for a, b in merges)]
    told = {
        "version": "1.0", "truncation": None, "padding": None, "normalizer": None, "post_processor": None,
        "added_tokens": [{"id": len(names), "content": "<e>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}],
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {x: i for i, x in enumerate(names)}, "merges": [list(m) for m in merges]} | model,
    }
    path.write_text(json.dumps(told))
    return str(path)


def test_small_vocabularies_with_clashing_merges(tmp_path):
    """Random merge lists, with tokens that their own bytes never give, and ties."""
    r = random.Random(5)
    for case in range(60):
        names, merges = list("aab"), []
        for _ in range(r.randint(1, 14)):
            m = (r.choice(names), r.choice(names))
            if m[0] + m[1] not in names:
                merges.append(m)
                names.append(m[0] + m[1])
        p = small_file(tmp_path / f"{case}.json", merges)
        e, lib = B.PrefixEncoder(p), Tokenizer.from_file(p)
        texts = ["".join(r.choice("aaab") for _ in range(n)) for n in range(40)] + ["a" * n for n in range(30)] + ["ab<e>aa", "<e><e>"]
        assert e._ids(texts) == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)], merges
        assert len(e.suffixes) <= 256 + len(merges)


def test_other_files_are_an_error(tmp_path):
    with pytest.raises(ValueError):
        B.PrefixEncoder(small_file(tmp_path / "a.json", [("a", "b")], dropout=0.5))
    with pytest.raises(ValueError):
        B.PrefixEncoder(small_file(tmp_path / "b.json", [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_query_against_the_library(spark, lib):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = B.op11_bpe_codec(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False))


def test_edges(spark, lib):
    rows = [(1, None, "x", 1, ""), (2, "", None, None, None), (2, "", None, None, None), (None, "a <|endoftext|> b", "", 0, ""), (3, "日本語 word " * 40000, "", 0, ""), (4, "z" * 300000, "", 0, "")]
    df = spark.createDataFrame(rows, DOCS)
    out = B.round_trip(df).collect()
    assert len(out) == len(rows)
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out if r.doc_id in (1, 2)] == [(0, sha(""), sha(""))] * 3
    for d, t in ((None, rows[3][1]), (3, rows[4][1]), (4, rows[5][1])):
        r = next(r for r in out if r.doc_id == d)
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t))
    ids = B.encode(df)
    back = {(r.doc_id, r.text) for r in B.decode(ids).collect()}
    assert back == {(d, t or "") for d, t, *_ in rows}
    assert [r.text for r in B.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<long>")).collect()] == [None]
    assert B.round_trip(df.where("false")).collect() == [] and len(B.round_trip(df.where("false")).columns) == 4
