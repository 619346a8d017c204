"""Token ids in Arrow stream files with fixed-size-list batches.

Documents are tokenized in ascending id order, an end id is appended to each, and the ids are packed
into sequences of ``SEQ`` ids. Each range of documents becomes one folder with

* ``tokens.arrow``: an Arrow IPC stream of record batches of ``BATCH`` rows with the columns ``ids``
  (fixed_size_list<uint16>[SEQ], or uint32 where the vocabulary needs it) and ``mask``
  (fixed_size_list<bool>[SEQ], bit-packed, true for an id and false for the padding of the last
  sequence), uncompressed, so that a memory map gives any sequence and its
  mask without a copy: every batch but the last has the same byte length;
* ``docs.arrow``: doc_id, the first id's place in this file, and the number of ids, per document.

``manifest`` (Parquet) lists the folders with their numbers of documents and ids; places in the
whole corpus follow from the sums of earlier folders.

Documents are encoded as the library does with the file's own settings: a string of an added token in a
text gives that token's id. Where the file splits text like byte-level BPE with its usual pattern and has no
normalizer, texts are cut where its pattern always cuts, and each distinct piece is encoded once; texts
with an added token, and all texts for other files, are encoded whole.

A task writes to a name of its own attempt and renames it when complete, so a lost executor or a
second attempt leaves nothing half written in the manifest. Folders hold ranges of documents, so no
task holds more than one range. Documents that stand in files in the wanted order already are written as their
tasks read them, a folder for each piece of a file; they are neither shuffled nor sorted.

Defined results: a null text is empty and gives the end id alone. A null doc_id sorts first. Rows
with equal ids stand in order of a hash of their texts. Extra columns are ignored. An empty table gives a
manifest without rows and no documents.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import storage
from .textops import Chunk, chunks, positions, span_hash, trim

SEQ = 2048
BATCH = 256
END_ID = 0
VOCAB = "byte_bpe_50k.json"
#: Bytes of text in a folder: at most some ``RANGE_BYTES``, and less where that leaves a cluster's cores
#: without work, but no less than ``LEAST_RANGE``.
RANGE_BYTES, LEAST_RANGE = 1 << 30, 16 << 20
#: Pieces of text that a worker remembers with their ids; beyond, it forgets those that it has met once.
REMEMBERED = 400_000
#: Bytes of text that are encoded at a time; pieces take some 60 times their text's space.
CHUNK_BYTES = (1 << 20) - 1

_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCAB)


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


_ALNUM = _bytes((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_GRAPHIC = _bytes((0x21, 0x7E))
_PUNCT = _GRAPHIC & ~_ALNUM & ~_bytes((0x27, 0x27))
#: Bytes that surely don't begin white space; C2 and E1-E3 begin some of Unicode's.
_SURE = _GRAPHIC | _bytes((0xC3, 0xE0), (0xE4, 0xF4))


def pieces(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces that the pre-tokenizer never joins, and bounds by document.

    Its tokens are letters, digits or other marks with at most one space before them, contractions
    that begin with an apostrophe, and white space, whose last character is apart where something
    follows. So a text can be cut before a space that no white space follows, around a single line
    feed between two other characters, and between a letter or digit and a mark that is no
    apostrophe; elsewhere it isn't cut."""
    d, n = c.data, len(c.data)
    first = np.zeros(n + 1, bool)
    first[c.offsets] = True
    after = np.append(d[1:], 0) if n else d
    before = np.append(np.uint8(0), d[:-1]) if n else d
    sure_next = _SURE[after] & ~first[1:]
    inner = ~first[:n]
    feed = (d == 0x0A) & _GRAPHIC[before] & inner & sure_next
    cut = (d == 0x20) & sure_next | feed
    cut[1:] |= feed[:-1]
    cut |= inner & (_PUNCT[d] & _ALNUM[before] | _ALNUM[d] & _PUNCT[before])
    starts = np.flatnonzero(cut | first[:n])
    return starts, np.append(starts[1:], n) if len(starts) else starts, np.searchsorted(starts, c.offsets)


class Encoder:
    """Encodes with the tokenizers library, each distinct piece of text once.

    Known pieces are found by a 64-bit hash: among the ``REMEMBERED`` pieces that are known at a
    time, the odds that any two share one are under one in a million."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would each hold memory
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        told = json.loads(self.tok.to_str())
        how = told.get("pre_tokenizer") or {}
        usual = how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space")
        self.cuts = usual and not told.get("normalizer") and not told.get("truncation") and not told.get("post_processor")
        self.added = [t["content"].encode() for t in told.get("added_tokens") or []]
        del told
        trim()
        self.clear()

    def pieces(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that are encoded apart; a whole text where it can't be cut."""
        whole = np.arange(c.n)
        if self.cuts:
            raw = c.data.tobytes()
            hits = [m.start() for t in self.added for m in re.finditer(re.escape(t), raw)]
            whole = np.unique(np.searchsorted(c.offsets, hits, "right") - 1)
            if not len(whole):
                return pieces(c)
        s, e, b = pieces(c)
        kept = np.ones(len(s), bool)
        for d in whole.tolist():
            kept[b[d] + 1 : b[d + 1]] = False
        starts = s[kept]
        return starts, np.append(starts[1:], len(c.data)), np.searchsorted(starts, c.offsets)

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.start = self.count = np.empty(0, np.int64)
        self.again = np.empty(0, bool)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def forget(self) -> None:
        """Keep the pieces that were met again since the last time; none if they are over half of the bound."""
        kept = self.again
        if 2 * np.count_nonzero(kept) > REMEMBERED:
            return self.clear()
        n = self.count[kept]
        self.flat = self.flat[positions(self.start[kept], n)]
        self.keys, self.count, self.start, self.used = self.keys[kept], n, np.cumsum(n) - n, len(self.flat)
        self.again = np.zeros(len(n), bool)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Add pieces by their sorted keys."""
        counts: list[int] = []
        ids: list[np.ndarray] = []
        for lo in range(0, len(texts), 8192):
            got = self._ids(texts[lo : lo + 8192])
            counts += map(len, got)
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32))
        new, n = np.concatenate(ids), np.array(counts, np.int64)
        if self.used + len(new) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(new)))
        self.flat[self.used : self.used + len(new)] = new
        at = np.searchsorted(self.keys, keys)
        self.start = np.insert(self.start, at, self.used + np.cumsum(n) - n)
        self.count = np.insert(self.count, at, n)
        self.again = np.insert(self.again, at, False)
        self.keys = np.insert(self.keys, at, keys)
        self.used += len(new)

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's texts, one after another, and the number of ids of each text."""
        if len(self.keys) > REMEMBERED:
            self.forget()
        s, e, bounds = self.pieces(c)
        h = span_hash(c.data, s, e)
        if not len(h):
            return np.empty(0, np.uint32), np.zeros(c.n, np.int64)
        order = np.argsort(h)
        own = h[order]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        distinct, example = own[begin], order[begin]
        at = np.searchsorted(self.keys, distinct)
        new = np.append(self.keys, np.uint64(0))[at] != distinct
        new |= at == len(self.keys)
        self.again[at[~new]] = True
        if new.any():
            raw = c.data.tobytes()
            texts = [raw[x:y].decode() for x, y in zip(s[example[new]].tolist(), e[example[new]].tolist(), strict=True)]
            self._learn(distinct[new], texts)
            at = np.searchsorted(self.keys, distinct)
        each = np.empty(len(h), np.int64)
        each[order] = np.repeat(at, np.diff(np.append(begin, len(h))))
        n = self.count[each]
        ids = self.flat[positions(self.start[each], n)]
        total = np.append(0, np.cumsum(n))
        return ids, np.diff(total[bounds])


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Writer:
    """One folder: full sequences go to the stream as soon as there is a batch of them."""

    def __init__(self, root: str, seq: int, batch: int, vocabulary: int):
        self.fs, base = storage.local_or_remote(root)
        self.base, self.name = base, f"part-{uuid.uuid4().hex}"
        self.tmp = f"{base}/_open-{self.name}"
        self.fs.create_dir(self.tmp, recursive=True)
        self.seq, self.rows = seq, batch
        self.kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), seq)), ("mask", pa.list_(pa.bool_(), seq))])
        self.sink = self.fs.open_output_stream(f"{self.tmp}/tokens.arrow", compression=None)
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_docs = 0

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, counts))
        self.n_docs += len(counts)
        self.held.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        block = self.seq * self.rows
        if self.waiting >= block:
            all_ids = np.concatenate(self.held)
            full = len(all_ids) // block * block
            for lo in range(0, full, block):
                self._write(all_ids[lo : lo + block], block)
            self.held, self.waiting = [all_ids[full:]], len(all_ids) - full

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq) for x in (ids.astype(self.kind), mask)]
        self.out.write_batch(pa.record_batch(cols, schema=self.schema))

    def close(self) -> tuple[str, int, int]:
        if self.waiting:
            ids = np.concatenate(self.held)
            self._write(np.pad(ids, (0, -len(ids) % self.seq)), len(ids))
        self.out.close()
        self.sink.close()
        counts = np.concatenate([c for _, c in self.docs]).astype(np.int64)
        docs = pa.table({"doc_id": pa.concat_arrays([d for d, _ in self.docs]), "start": np.cumsum(counts) - counts, "n_tokens": counts})
        with self.fs.open_output_stream(f"{self.tmp}/docs.arrow", compression=None) as sink, pa.ipc.new_stream(sink, docs.schema) as out:
            out.write_table(docs, max_chunksize=1 << 16)
        self.fs.move(self.tmp, f"{self.base}/{self.name}")
        return self.name, self.n_docs, self.total


def write(docs: DataFrame, path: str, tokenizer: str | None = None, seq: int = SEQ, batch: int = BATCH, end_id: int = END_ID, key: str = "doc_id", order: tuple[Column | str, ...] = ()) -> DataFrame:
    """Write the files of ``docs`` below ``path`` and return the manifest: ``part``, ``folder``,
    ``n_docs`` and ``n_ids``, a row for each folder in document order: that of ``order``, if given, else
    that of ``key``."""
    spark = docs.sparkSession
    first = [F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)]
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *first)
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // RANGE_BYTES), min(-(-size // LEAST_RANGE), 4 * spark.sparkContext.defaultParallelism))
    by = [*(f"o{i}" for i in range(len(order))), "doc_id", F.xxhash64("text")]
    ranged = narrow.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, w = TaskContext.get().partitionId(), None
        enc = encoder(tokenizer or default_tokenizer())  # the vocabulary is a file of each executor's own
        for b in batches:
            for c in chunks(b.column("text"), CHUNK_BYTES):
                ids, n = enc.encode(c)
                w = w or _Writer(path, seq, batch, max(enc.tok.get_vocab_size(), end_id + 1))
                w.add(b.column("doc_id").slice(c.first, c.n), n + 1, np.insert(ids, np.cumsum(n), end_id))
        if w:
            folder, n_docs, n_ids = w.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "folder": [folder], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    made = ranged.mapInArrow(run, "part int, folder string, n_docs long, n_ids long")
    made.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema("part int, folder string, n_docs long, n_ids long").parquet(f"{path}/manifest")


def write_placed(placed: DataFrame, path: str, tokenizer: str | None = None, seq: int = SEQ, batch: int = BATCH, end_id: int = END_ID) -> DataFrame | None:
    """As :func:`write`, in order of ``part``, ``file`` and ``row``, for rows (``doc_id``, ``text``, these and ``block``) that
    are read from files: a task reads pieces of files, each from one ``block`` on and in order of its rows, and each
    becomes a folder as it is read. None, with what was written removed, if they come otherwise (dealt out anew, say)."""
    spark = placed.sparkSession
    narrow = placed.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "part", "file", "block", "row")
    fields = {"part": pa.int64(), "file": pa.string(), "block": pa.int64(), "folder": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64()}
    schema = pa.schema(list(fields.items()))

    def run(batches):
        enc = encoder(tokenizer or default_tokenizer())
        piece, last, met, w, ordered = None, -1, set(), None, True

        def line(*made):
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*piece, *made), schema, strict=True)], schema=schema)

        for b in batches:
            names = b.column("file").dictionary_encode()
            file, block, row = (np.asarray(x) for x in (names.indices, b.column("block"), b.column("row")))
            new = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0) | (np.diff(row) <= 0)) + 1
            for lo, hi in pairwise([0, *new.tolist(), b.num_rows] if b.num_rows and ordered else []):
                own = (b.column("part")[lo].as_py(), names[lo].as_py(), int(block[lo]))
                if own != piece or row[lo] <= last:
                    if w:
                        yield line(*w.close())
                    piece, w, ordered = own, None, own not in met
                    if not ordered:
                        yield line(None, None, None)
                        break
                    met.add(own)
                last = row[hi - 1]
                for c in chunks(b.column("text").slice(lo, hi - lo), CHUNK_BYTES):
                    ids, n = enc.encode(c)
                    w = w or _Writer(path, seq, batch, max(enc.tok.get_vocab_size(), end_id + 1))
                    w.add(b.column("doc_id").slice(lo + c.first, c.n), n + 1, np.insert(ids, np.cumsum(n), end_id))
        if w:
            yield line(*w.close())

    made = storage.stage(narrow.mapInArrow(run, "part long, file string, block long, folder string, n_docs long, n_ids long"), "token-folders")
    rows, folders, held = made.agg(F.count(F.lit(1)), F.count("folder"), F.count_distinct("file", "block")).first()
    if not rows == folders == held:
        storage.drop(made)
        storage.remove(spark, path)
        return None
    place = F.row_number().over(Window.orderBy("part", "file", "block")) - 1  # one row for each folder
    made.select(place.alias("part"), "folder", "n_docs", "n_ids").write.mode("overwrite").parquet(f"{path}/manifest")
    storage.drop(made)
    return spark.read.schema("part int, folder string, n_docs long, n_ids long").parquet(f"{path}/manifest")


def open_folder(root: str, folder: str):
    """The documents table and an iterator over real ids, batch by batch. A local file is mapped."""
    fs, base = storage.local_or_remote(root)

    def source(name: str):
        p = f"{base}/{folder}/{name}"
        return pa.memory_map(p) if fs.type_name == "local" else fs.open_input_file(p)

    docs = pa.ipc.open_stream(source("docs.arrow")).read_all()

    def ids():
        for b in pa.ipc.open_stream(source("tokens.arrow")):
            x, mask = b.column("ids").flatten().to_numpy(zero_copy_only=True), b.column("mask").flatten()
            yield x if mask[-1].as_py() else x[mask.to_numpy(zero_copy_only=False)]

    return docs, ids()


def sequence(root: str, folder: str, i: int, seq: int = SEQ, batch: int = BATCH) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of the i-th sequence of a folder, found by arithmetic in a mapped local file:
    all batches before the last are equally long, so the i-th one needs no scan."""
    _, base = storage.local_or_remote(root)
    m = pa.memory_map(f"{base}/{folder}/tokens.arrow")
    schema = pa.ipc.read_schema(m)
    head = m.tell()
    pa.ipc.read_message(m)
    m.seek(head + i // batch * (m.tell() - head))
    b = pa.ipc.read_record_batch(pa.ipc.read_message(m), schema)
    r = i % batch * seq
    return b.column("ids").flatten().to_numpy(zero_copy_only=True)[r : r + seq], b.column("mask").flatten().slice(r, seq)


def read_back(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each folder
    base = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).select("folder", "base")
    folders = base.count()
    spread = base.repartition(max(1, folders), "folder") if folders else base

    def run(batches):
        for b in batches:
            for folder, first in zip(b.column("folder").to_pylist(), b.column("base").to_pylist(), strict=True):
                docs, stream = open_folder(path, folder)
                starts = docs["start"].to_numpy()
                ends = starts + docs["n_tokens"].to_numpy()
                crc = np.zeros(len(starts), np.int64)
                d = at = 0
                for ids in stream:
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    stop = at + len(ids)
                    while d < len(starts) and starts[d] < stop:
                        lo, hi = max(starts[d], at), min(ends[d], stop)
                        crc[d] = zlib.crc32(raw[4 * (lo - at) : 4 * (hi - at)], int(crc[d]))
                        if ends[d] > stop:
                            break
                        d += 1
                    at = stop
                if at != (ends[-1] if len(ends) else 0):
                    raise ValueError(f"{folder} holds {at} ids, its documents {ends[-1]}")
                yield from pa.table({"doc_id": docs["doc_id"], "start": starts + first, "n_tokens": docs["n_tokens"], "ids_crc32": crc}).to_batches()

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, path: str | None = None, order: tuple[Column | str, ...] = ()) -> DataFrame:
    """Write ``docs`` below ``path`` (a new folder of the shared one if it isn't given) and read every document
    back. The result's ``files_path`` says where the files are; they are kept."""
    path = path or storage.new_path(spark, "token-files")
    out = read_back(spark, path, write(docs, path, tokenizer, order=order))
    out.files_path = path
    return out


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    return token_files(spark, storage.read(spark, sf_dir, "documents"))


def token_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: files of all its documents, and a row for each document read back. Documents stand as
    the stage before has written them (by number of its part files and row in them), so that the mix's
    order becomes the files'; where ``docs`` isn't read from files, by doc_id. Rows that were dealt out anew since they
    were read are put back in order first."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    try:
        placed = docs.select("doc_id", "text", part.alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return token_files(spark, docs)
    path = storage.new_path(spark, "token-files")
    manifest = write_placed(placed, path)
    if manifest is None:
        return token_files(spark, placed, path=path, order=("part", "file", "row"))
    out = read_back(spark, path, manifest)
    out.files_path = path
    return out
