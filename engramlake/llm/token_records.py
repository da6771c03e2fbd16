"""Token-ID / binary output: length-delimited records with masked checksums.

File format (all integers little endian).  A record file is a run of frames

    uint64 length | uint32 masked checksum of those 8 bytes | body | uint32 masked checksum of the body

and a body is ``int64 doc_id | uint8 flags | uint8 width | uint32 n_ids | ids``; flag 1 marks a null
doc_id, and width is 2 or 4 bytes an id.  The checksum is CRC-32, rotated right by 15 bits plus a
constant, so that a checksum of bytes that hold checksums is not degenerate.  Beside each file
``X.rec`` lies ``X.idx``, an array of uint64 byte offsets, one for each record, by which a loader
can read records in any order.  Files are numbered in the order of the data.

Each task writes a file under a name of its own, and only what the successful attempts report enters
the manifest, so a lost executor or a repeated task leaves nothing behind that a reader would see.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_by_worker, rows_of, scratch_path

MASK_DELTA = 0xA282EAD8
HEAD, BODY = struct.Struct("<QI"), struct.Struct("<qBBI")
END_ID = 0
RECORDS = "token-records"  # how folders of records in the shared folder are called
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    body = BODY.pack(doc_id or 0, int(doc_id is None), width, len(ids)) + ids.astype(f"<u{width}").tobytes()
    head = struct.pack("<Q", len(body))
    return b"".join((head, struct.pack("<I", masked_crc(head)), body, struct.pack("<I", masked_crc(body))))


def read_frame(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """The record that begins at a byte offset, and where the next begins."""
    length, crc = HEAD.unpack_from(data, at)
    if masked_crc(data[at : at + 8]) != crc:
        raise ValueError(f"damaged length at byte {at}")
    begin = at + HEAD.size
    body = data[begin : begin + length]
    if len(body) != length or masked_crc(body) != struct.unpack_from("<I", data, begin + length)[0]:
        raise ValueError(f"damaged record at byte {at}")
    doc_id, flags, width, n = BODY.unpack_from(body)
    ids = np.frombuffer(body, dtype=f"<u{width}", count=n, offset=BODY.size)
    return None if flags & 1 else doc_id, ids, begin + length + 4


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in a byte-level vocabulary: itself if printable
    in Latin-1, else the next free one from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class Memory(dict):
    """What has been made of a key before, or is made of it now."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        return value


def encoder(path: str, added_tokens: bool) -> Encoder:
    """One for all tasks of a worker process, so that what it remembers serves the next task too."""
    return kept_by_worker("encoder", (path, added_tokens), lambda: Encoder(path, added_tokens))


class Encoder:
    """Encodes texts with a public tokenizer file, as encode(add_special_tokens=False) does.

    A byte-level vocabulary never joins across the space before a word, so a text without runs of
    white space is the concatenation of its space-led pieces.  Pieces, and the words in them, are
    remembered (so many of each, then all are forgotten), and only new words go through the
    tokenizer's model.  Other texts, those that hold an added token of the file (such as
    <|endoftext|>), and other kinds of tokenizer files go through the tokenizer whole.  Without
    ``added_tokens`` special tokens in a text are text like any other."""

    def __init__(self, path: str, added_tokens: bool = True, pieces: int = 300_000, words: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.model, self.most = self.tokenizer.model, (pieces, words)
        self.pieces, self.words = Memory(self._piece), Memory(self._word)
        self.dtype, self.code = ("<u4", "I") if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16 else ("<u2", "H")
        made = json.loads(self.tokenizer.to_str())
        added = [re.escape(t["content"]) for t in made["added_tokens"] if t["content"] and (added_tokens or not t["special"])]
        self.added = re.compile("|".join(added)).search if added else None
        pre, model = made["pre_tokenizer"] or {}, made["model"]
        self.piecewise = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and not made["normalizer"] and model["type"] == "BPE" and not model["dropout"]
        # fixed value: how byte-level tokenizers cut text into words
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        shown = "\u0120" + word[1:] if word[0] == " " and word.isascii() and word[1:].isalpha() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(byte_letters())
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A piece comes without its space; one that a lone line feed leads has none."""
        words = self.words
        if piece.isalpha():
            return words[" " + piece]
        if piece[-1] in ".," and piece[:-1].isalpha():
            return words[" " + piece[:-1]] + words[piece[-1]]
        if piece[0] == "\n" and piece[1:].isalpha():
            return words["\n"] + words[piece[1:]]
        return b"".join(map(words.__getitem__, self.cut(piece if piece[0] == "\n" else " " + piece)))

    def __call__(self, text: str | None) -> np.ndarray:
        """The ids of one text; a null one has none."""
        if not text:
            return np.empty(0, dtype=self.dtype)
        if not self.piecewise or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1] == " " or self.added and self.added(text):
            return np.frombuffer(self._whole(text), dtype=self.dtype)
        for memory, most in zip((self.pieces, self.words), self.most):
            if len(memory) > most:
                memory.clear()
        first, *rest = text.replace("\n", " \n").split(" ")
        data = b"".join(map(self.words.__getitem__, self.cut(first))) + b"".join(map(self.pieces.__getitem__, rest))
        return np.frombuffer(data, dtype=self.dtype)


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def read_record(path: str, file: str, n: int) -> tuple[int | None, np.ndarray]:
    """Record n of a file, found by its offset index alone."""
    fs, base = _filesystem(path)
    with fs.open_input_file(f"{base}/{file}.idx") as f:
        at = struct.unpack("<Q", f.read_at(8, 8 * n))[0]
    with fs.open_input_file(f"{base}/{file}.rec") as f:
        length = HEAD.unpack(f.read_at(HEAD.size, at))[0]
        return read_frame(f.read_at(HEAD.size + length + 4, at))[:2]


def _write_file(batches: Iterator[pa.RecordBatch], path: str, tokenizer: str, end_id: int, added_tokens: bool) -> Iterator[pa.RecordBatch]:
    """Writes one file and its offsets, and describes it in a row; without records there is no row."""
    encode = encoder(tokenizer, added_tokens)
    fs, base = _filesystem(path)
    fs.create_dir(base, recursive=True)
    name, offsets, at, n_ids, first = f"part-{uuid.uuid4().hex}", [], 0, 0, None
    end = np.array([end_id], dtype=np.uint32)
    with fs.open_output_stream(f"{base}/{name}.rec", buffer_size=1 << 20) as out:
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = np.append(encode(text), end)
            data = frame(doc_id, ids)
            out.write(data)
            first = first or (doc_id is not None, doc_id or 0)
            offsets.append(at)
            at, n_ids = at + len(data), n_ids + len(ids)
    with fs.open_output_stream(f"{base}/{name}.idx") as out:
        out.write(np.array(offsets, dtype="<u8").tobytes())
    if first:
        yield pa.RecordBatch.from_pylist([{"known": first[0], "first": first[1], "file": name, "records": len(offsets), "ids": n_ids, "bytes": at}])


def _read_file(path: str, name: str, start: int) -> Iterator[pa.RecordBatch]:
    fs, base = _filesystem(path)
    rows: list[tuple] = []
    with fs.open_input_stream(f"{base}/{name}.rec", buffer_size=1 << 20) as f:
        while head := f.read(HEAD.size):
            length = HEAD.unpack(head)[0]
            doc_id, ids, _ = read_frame(head + f.read(length + 4))
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            start += len(ids)
            if len(rows) == 4096:
                yield _records(rows)
                rows = []
    yield _records(rows)


def write_records(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = END_ID, partitions: int | None = None, added_tokens: bool = True) -> None:
    """Encode ``docs(doc_id, text)`` and write them in ascending doc_id order.

    Null and empty texts are written as the end id alone; rows with the same doc_id stand side by
    side, ordered by text; null doc_ids come first.  Extra columns are ignored.  The rows are dealt
    by doc_id ranges, so no source or group of copies shares a task, and each text crosses the
    network once, before it is encoded.  Texts are encoded as the library does by default, added
    tokens in them included; without ``added_tokens`` special tokens are ordinary text.  Files of
    attempts that failed or came second are deleted at the end."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _write_file(batches, path, tokenizer, end_id, added_tokens)

    # one row a file: what a lost or repeated attempt wrote is in no row, so not in the manifest either
    files = rows.mapInArrow(write, "known boolean, first long, file string, records long, ids long, bytes long").collect()
    start, manifest = 0, []
    for f in sorted(files, key=lambda f: (f.known, f.first, f.file)):
        manifest.append({"file": f.file, "records": f.records, "ids": f.ids, "bytes": f.bytes, "start": start})
        start += f.ids
    fs, base = _filesystem(path)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    known = {f"{x['file']}{end}" for x in manifest for end in (".rec", ".idx")} | {"manifest.json"}
    for left in fs.get_file_info(pafs.FileSelector(base)):
        if left.base_name not in known:
            fs.delete_file(left.path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.  A task a file."""
    fs, base = _filesystem(path)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        files = [(x["file"], x["start"]) for x in json.loads(f.read())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (n,) in rows_of(batches, "id"):
            yield from _read_file(path, *files[n])

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(read, SCHEMA)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def is_record_folder(path: str) -> bool:
    return path.rpartition("/")[2].startswith(f"{RECORDS}-")


def token_digest(docs: DataFrame, tokenizer: str, path_of: Callable[[SparkSession, str], str] = scratch_path) -> DataFrame:
    """Write ``docs`` as records in the shared folder, encoded as encode(add_special_tokens=False)
    does, and read the files back."""
    path = path_of(docs.sparkSession, RECORDS)
    write_records(docs, path, tokenizer)
    return read_records(docs.sparkSession, path)
