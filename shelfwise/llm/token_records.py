"""Token ids as length-delimited binary records with masked checksums, and an offset index beside them.

A shard file is a run of records: length (8 bytes, little-endian), masked crc32 of those 8 bytes, the payload,
masked crc32 of the payload. A payload is the document id (8 bytes), the width of its token ids (1 byte) and the
ids, little-endian: 2 bytes each for vocabularies of up to 65,536 ids, else 4. The index has one row a record: shard file, offset, length; shuffled reads need nothing else.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import textkernel as tk
from shelfwise.llm.common import bound_batches, materialise, new_path

MASK = 0xA282EAD8  # fixed value of the public record format
WORDS, PIECES = 100_000, 200_000  # entries of each cache's younger generation: some 150 MB a worker for all
BATCH = 50_000  # records of an Arrow batch
NULL_ID = -(2**63)  # stands for a null document id in a payload
INDEX = "shard string, first_doc long, seq long, doc_id long, offset long, length long, n_tokens long"


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return n + struct.pack("<I", masked_crc(n)) + payload + struct.pack("<I", masked_crc(payload))


def unframe(data: bytes) -> bytes:
    """The payload of one record; raises ValueError where a checksum fails."""
    (n,), (a,) = struct.unpack_from("<Q", data), struct.unpack_from("<I", data, 8)
    payload = data[12 : 12 + n]
    if a != masked_crc(data[:8]) or len(payload) != n or struct.unpack_from("<I", data, 12 + n)[0] != masked_crc(payload):
        raise ValueError("damaged record")
    return payload


class Cache:
    """A bounded map of two generations: what is not asked for while the younger one fills is dropped."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


class Encoder:
    """Token ids of many texts at a time.

    Where the tokenizer folds white space and case and cuts words as in FOLDS and CUTS, white space never joins two
    words' tokens, so words are encoded once and their ids gathered. Words of letters and marks of known ranges go
    straight to the model; others, and texts with special tokens, through the whole tokenizer. Texts of any other
    tokenizer are encoded whole by the library.
    """

    # The parts of a tokenizer file for which words can be taken one by one.
    FOLDS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    CUTS = [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]

    PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ž]+")
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:_|[^\s\w])+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        parts = json.loads(self.tokenizer.to_str())
        self.by_word = (
            (parts["normalizer"] or {}).get("normalizers") == self.FOLDS and (parts["pre_tokenizer"] or {}).get("pretokenizers") == self.CUTS
            and parts["model"]["type"] == "BPE" and not parts["model"].get("unk_token") and all(not t["normalized"] for t in parts["added_tokens"])
        )
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words, self.pieces = Cache(WORDS), Cache(PIECES)
        # the byte alphabet of byte-level tokenizers: printable bytes stand for themselves
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in keep]
        self.alphabet = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(other)}

    def forget(self) -> None:
        """Empties the caches: the worker process may serve other stages next."""
        self.words, self.pieces = Cache(WORDS), Cache(PIECES)

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else "".join(self.alphabet[b] for b in piece.encode())
            ids = tuple(t.id for t in self.model.tokenize(shown))
            self.pieces.put(piece, ids)
        return ids

    def _word(self, word: str) -> bytes:
        if "<|" in word or not self.PLAIN.fullmatch(word) or not (word.isascii() or unicodedata.is_normalized("NFC", word)):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        else:
            low = word.lower()
            ids = self._piece(low) if low.isalpha() else [i for p in self.PIECES.findall(low) for i in self._piece(p)]
        return array(self.kind.char, ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and the offset of each text's."""
        if not self.by_word:
            coded = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.kind), *coded]), np.cumsum([0, *map(len, coded)])
        data, off = tk.flat(texts)
        s, e, first = tk.word_bounds(data, off)
        if not len(s):
            return np.zeros(0, self.kind), np.zeros(len(off), np.int64)
        cut = np.concatenate([s, e[-1:]])  # each word with the white space behind it
        words = pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pc.dictionary_encode(pc.ascii_trim(words, " \t\n\r\x0b\x0c"))
        parts = []
        for w in coded.dictionary.to_pylist():
            ids = self.words.get(w)
            if ids is None:
                ids = self._word(w)
                self.words.put(w, ids)
            parts.append(ids)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        at = np.zeros(len(parts), np.int64)
        np.cumsum(size[:-1], out=at[1:])
        ids = np.frombuffer(b"".join(parts), self.kind)
        which = coded.indices.to_numpy()
        n = size[which]
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        gathered = ids[np.repeat(at[which] - total[:-1], n) + np.arange(total[-1])]
        return gathered, total[first]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process: loading it takes time."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _filesystem(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 2, uri: str | None = None) -> DataFrame:
    """Encodes docs(doc_id, text), writes shard files under uri in ascending doc_id order, returns the index.

    A task writes to a name of its own, and the index names the file of the attempt that counted, so retries
    and lost executors leave no wrong records, only unused files. Null texts are empty; repeated ids stay, next
    to each other; null ids come first. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    uri = uri or new_path(spark, "records")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        store, root = _filesystem(uri)
        enc, out, shard, at, seq, first_doc = None, None, None, 0, 0, None
        for whole in batches:
            for b in tk.chunks(whole, "text", 4 << 20):
                if not b.num_rows:
                    continue
                if out is None:
                    enc, shard = encoder(tokenizer), f"shard-{uuid.uuid4().hex}.rec"
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{shard}")
                    first_doc = b.column("doc_id")[0].as_py()
                ids, off = enc.encode(b.column("text"))
                docs_, offsets, lengths, counts = b.column("doc_id").to_pylist(), [], [], []
                for d, x, y in zip(docs_, off[:-1], off[1:]):
                    body = struct.pack("<qB", NULL_ID if d is None else d, enc.kind.itemsize) + ids[x:y].tobytes() + np.array([end_id], enc.kind).tobytes()
                    record = frame(body)
                    out.write(record)
                    offsets.append(at)
                    lengths.append(len(record))
                    counts.append(int(y - x) + 1)
                    at += len(record)
                n = len(docs_)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n), pa.array([first_doc] * n, pa.int64()), pa.array(range(seq, seq + n), pa.int64()), pa.array(docs_, pa.int64())]
                    + [pa.array(v, pa.int64()) for v in (offsets, lengths, counts)],
                    ["shard", "first_doc", "seq", "doc_id", "offset", "length", "n_tokens"],
                )
                seq += n
        if out is not None:
            out.close()
            enc.forget()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    index = materialise(dealt.mapInArrow(write, INDEX), "records-index")
    return index.withColumn("shard", F.concat(F.lit(uri + "/"), "shard"))


def _records(path: str):
    """doc_id and ids (4 bytes each) of each record of a shard file; checksums are verified."""
    store, where = _filesystem(path)
    with store.open_input_stream(where, buffer_size=1 << 20) as f:
        while head := f.read(12):
            payload = unframe(head + f.read(struct.unpack_from("<Q", head)[0] + 4))
            doc, width = struct.unpack_from("<qB", payload)
            yield None if doc == NULL_ID else doc, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4").tobytes()


def read_records(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record; all but the names of the files comes from the files.

    A first pass counts each file's ids, so that every file knows where its own begin; a second gives the records.
    Null ids come first; an empty index gives none.
    """
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches):
        for batch in batches:
            for path in batch.column("shard").to_pylist():
                first, total = None, 0
                for i, (doc, ids) in enumerate(_records(path)):
                    first, total = (doc if i == 0 else first), total + len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.int64()), pa.array([total], pa.int64())], ["shard", "first_doc", "n"])

    shards = materialise(index.select("shard").distinct().repartition(n, "shard").mapInArrow(count, "shard string, first_doc long, n long"), "shards")
    # one row a shard: the running total is over files, not documents
    order = Window.orderBy(F.asc_nulls_first("first_doc"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))

    def read(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for path, start in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                rows = []
                for doc, ids in _records(path):
                    rows.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                    if len(rows) == BATCH:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return base.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
