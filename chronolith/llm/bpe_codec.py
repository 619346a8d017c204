"""BPE encoding by dynamic programming over prefixes, and decoding.

Of every prefix of a text, the BPE encoding has one last token. It is the token ``t`` that ends there for
which the last token ``s`` of the prefix before ``t`` keeps apart from ``t``: encoding the bytes of ``s``
and ``t`` together gives ``s`` and ``t``. So one pass from left to right finds each prefix's last token among the
tokens that end there (a suffix automaton over the vocabulary lists them), and the ids of the whole text follow
from the last token back to the first. No merge is ever carried out, and the time is that of the matches, however
long a word without a break is.

Whether two tokens keep apart is decided on their merge trees: from the latest merge back, no token on the right
edge of the first may merge with one on the left edge of the second while both exist.

A worker encodes each distinct piece of text once, as the token files do (:class:`.token_files.Encoder`): texts are
cut where the pre-tokenizer always cuts, and the library's own pre-tokenizer cuts the pieces further. Added tokens
are taken out of a text first; what stands between two of them is pre-tokenized as a text of its own.

The tokenizer file must hold a byte-level BPE: all 256 bytes, each token but the added ones made by one merge, no
normalizer, dropout, affixes of words, or ``ignore_merges``, and added tokens that are taken as they stand. Other files are an
error. Truncation and padding settings aren't used.

Defined results: a null text is an empty one and has no ids; the digest of no ids is that of an empty string. A doc_id
may be null or repeat: each row has its own result. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import storage
from .textops import chunks
from .token_files import CHUNK_BYTES, Encoder, default_tokenizer

#: Pairs of tokens that a worker remembers; beyond, it starts anew.
PAIRS = 1 << 19
_SHIFT = 32


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others
    counted on from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Bytes(dict):
    """Each id's bytes; none for an id that the file hasn't."""

    def __missing__(self, i: int) -> bytes:
        return b""


class PrefixEncoder(Encoder):
    """Encodes as :class:`Encoder` does, with the last tokens of prefixes in place of the library's merges.

    Tokens are numbered by age: bytes first, then merges in the file's order."""

    def __init__(self, path: str):
        super().__init__(path)
        import ahocorasick

        told = json.loads(self.tok.to_str())
        model, how = told["model"], told.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        odd += [f for t in told.get("added_tokens") or [] for f in ("single_word", "lstrip", "rstrip") if t[f]]
        if model.get("type") != "BPE" or how.get("type") != "ByteLevel" or told.get("normalizer") or odd:
            raise ValueError(f"{path} is no plain byte-level BPE: {odd or how.get('type')}")
        vocab, letters = model["vocab"], byte_alphabet()
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        names = [*letters, *(a + b for a, b in merges)]
        if len({*names}) < len(names) or not {*names} <= vocab.keys():
            raise ValueError(f"{path} makes a token twice, or lacks a byte")
        age = {x: i for i, x in enumerate(names)}
        self.halves = [(-1, -1)] * 256 + [(age[a], age[b]) for a, b in merges]
        self.merged = {a << _SHIFT | b: 256 + i for i, (a, b) in enumerate(self.halves[256:])}
        self.out = [vocab[x] for x in names]
        self.size = [len(x) for x in names]
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens") or []}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        whole = [True] * 256  # whether a token's own bytes give that token; others are never met
        for t in range(256, len(names)):
            a, b = self.halves[t]
            whole.append(whole[a] and whole[b] and self.apart(a, b, t))
        self.suffixes = ahocorasick.Automaton()
        for t, x in enumerate(names):
            if whole[t]:
                self.suffixes.add_word(x, t)
        self.suffixes.make_automaton()
        self.known: dict[int, bool] = {}
        byte = {c: b for b, c in enumerate(letters)}
        self.raw = _Bytes({vocab[x]: bytes(byte[c] for c in x) for x in names} | {i: t.encode() for t, i in self.special.items()})
        self.decimal = {i: str(i) for i in self.raw}

    def apart(self, a: int, b: int, until: int) -> bool:
        """Whether no tokens at the border of ``a`` and ``b`` merge before ``until``."""
        while True:
            if self.merged.get(a << _SHIFT | b, until) < until:
                return False
            if max(a, b) < 256:
                return True
            if a > b:  # undo the younger; of equals the left one was made first
                until, a = a, self.halves[a][1]
            else:
                until, b = b + 1, self.halves[b][0]

    def _words(self, words: list[str]) -> list[list[int]]:
        """Ids of pre-tokens, written in the byte alphabet."""
        text = "\n" + "\n".join(words) + "\n"  # no letter of the alphabet
        last, known, apart, size, top = [-1] * len(text), self.known, self.apart, self.size, len(self.size)
        if len(known) > PAIRS:
            known.clear()
        for end, t in self.suffixes.iter(text):
            if last[end] < 0:
                before = last[end - size[t]]
                if before >= 0:
                    pair = before << _SHIFT | t
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = apart(before, t, top)
                    if not fits:
                        continue
                last[end] = t
        ids, end, out = [], len(text) - 2, self.out
        for w in reversed(words):
            own, at = [], end
            while at > end - len(w):
                t = last[at]
                own.append(out[t])
                at -= size[t]
            ids.append(own[::-1])
            end -= len(w) + 1
        return ids[::-1]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        parts: list[str] = []
        plan = []
        for text in texts:
            segments = []
            for x in self.split.split(text) if self.split else [text]:
                if x in self.special:
                    segments.append((-1, self.special[x]))
                elif x:
                    words = [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(x)]
                    segments.append((len(parts), len(words)))
                    parts += words
            plan.append(segments)
        ids = self._words(parts)
        return [[i for lo, n in segments for part in ([[n]] if lo < 0 else ids[lo : lo + n]) for i in part] for segments in plan]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; ids that the file hasn't are left out, broken UTF-8 is
        replaced."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")


_CODERS: dict[str, PrefixEncoder] = {}


def coder(path: str) -> PrefixEncoder:
    if path not in _CODERS:
        _CODERS[path] = PrefixEncoder(path)
    return _CODERS[path]


def _encoded(docs: DataFrame, tokenizer: str | None, made, columns: str) -> DataFrame:
    """doc_id and what ``made(coder, ids of a text)`` gives for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in columns.split(", ")]

    def run(batches):
        enc = coder(tokenizer or default_tokenizer())  # the vocabulary is a file of each executor's own
        for batch in batches:
            for c in chunks(batch.column("text"), CHUNK_BYTES):
                flat, n = enc.encode(c)
                ends = np.cumsum(n)
                rows = [made(enc, flat[e - k : e].tolist()) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                own = batch.column("doc_id").slice(c.first, c.n)
                yield pa.RecordBatch.from_arrays([own, *(pa.array(x) for x in zip(*rows, strict=True))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {columns}")


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and the array ``ids`` of every text."""
    return _encoded(docs, tokenizer, lambda enc, ids: (ids,), "ids array<long>")


def decode(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and ``text`` of every row's ``ids``; null for null."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = coder(tokenizer or default_tokenizer())
        for b in batches:
            text = [None if x is None else enc.decode([i for i in x if i is not None]) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def _digests(enc: PrefixEncoder, ids: list[int]) -> tuple[int, str, str]:
    listed = ",".join(map(enc.decimal.__getitem__, ids))
    return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest()


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text that they decode to."""
    return _encoded(docs, tokenizer, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return round_trip(storage.read(spark, sf_dir, "documents"))
