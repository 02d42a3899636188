"""Token ids in compact binary files: byte-level BPE, then Huffman coding by global counts.

1. Texts become ids; each is written once, as bytes, to the shared folder.
2. Counts of ids are summed; the table, bounded by the vocabulary, gives the code.
3. Documents are dealt by ranges of doc_id, sorted, coded and written to files; the manifest keeps order.
4. Files are read back, every file a task of its own.

Null text is empty and has the end id alone; null doc_ids come first; rows with equal doc_ids are ordered
by their ids; an empty table makes no files and no rows; other columns are not read.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm import files, huffman
from tidewheel.llm.storage import bounded_batches, materialise, new_folder
from tidewheel.llm.unitcache import Memo, plain

END_ID = 0
#: A file is closed once it has this many ids.
FILE_IDS = 1 << 22
#: Signs that the pre-tokenizer joins to one piece behind a word; the apostrophe begins contractions.
_SIGNS = "!#$%&()*+,-./:;<=>?@[]^_{|}~"
assert sys.byteorder == "little" and array("I").itemsize == 4


class ByteBpe:
    """Ids of texts exactly as the tokenizers library gives them, as little-endian 32-bit bytes.

    In a plain text every space and line end begins a new pre-token, so the pieces between them are
    encoded apart and kept. Other texts go to the library as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words, self.units = Memo(self._word), Memo(self._unit)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """One pre-token through the library's model."""
        mapped = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        """Letters, perhaps a space before and signs behind, need no regex to be cut; the rest goes to the library."""
        if max(unit) < "ɐ":
            word = unit.rstrip(_SIGNS)
            if word[word[:1] == " " :].isalpha():
                return self.words[word] + (self.words[unit[len(word) :]] if len(word) < len(unit) else b"")
        return self._library(unit)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for t in texts:
            if not t:
                out.append(b"")
            elif plain(t) and "\0" not in t and not any(s in t for s in self.specials):
                # A unit is a line end, or a word with the space before it.
                self.words, self.units = self.words.turned(), self.units.turned()
                out.append(b"".join(map(self.units.__getitem__, t.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0"))))
            else:
                out.append(self._library(t))
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_ids(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and its ids as 16-bit (or, for larger vocabularies, 32-bit) little-endian bytes."""
    bounded_batches(docs.sparkSession)
    kind = id_type(path)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [np.frombuffer(b, "<u4").astype(kind).tobytes() + end for b in _tokenizer(path).encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(rows.mapInArrow(out, "doc_id long, ids binary"), "ids")


def id_type(path: str) -> str:
    return "<u2" if _tokenizer(path).vocabulary <= 1 << 16 else "<u4"


def count_ids(ids: DataFrame, kind: str, vocabulary: int) -> np.ndarray:
    """Counts of all ids; a partial sum for each task, and one row for each id at the driver."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                got = np.bincount(np.frombuffer(b, kind), minlength=0)
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(out, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write(ids: DataFrame, lengths: np.ndarray, kind: str, folder: str) -> DataFrame:
    """Code ``ids`` in ascending doc_id order; the manifest: part, seq, uri, n_docs, n_ids, first.

    ``first`` is the number of ids in all files before.
    """
    spark = ids.sparkSession
    table = lengths.tobytes()
    manifest = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = huffman.Codec(np.frombuffer(table, np.uint8)), TaskContext.get().partitionId()
        names: list = []
        parts: list[bytes] = []
        held, done = 0, []

        def close() -> None:
            nonlocal names, parts, held
            sizes = np.array([len(p) for p in parts], np.int64) // np.dtype(kind).itemsize
            all_ids = np.frombuffer(b"".join(parts), kind)
            f = files.Out(folder, f"ids-{part:05d}-{len(done):05d}", ".twh")
            f.write(huffman.write_file(codec, names, sizes, all_ids))
            f.close()
            done.append({"part": part, "seq": len(done), "uri": f.uri, "n_docs": len(names), "n_ids": len(all_ids)})
            names, parts, held = [], [], 0

        for batch in batches:
            for name, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                parts.append(b)
                held += len(b)
                if held >= FILE_IDS * np.dtype(kind).itemsize:
                    close()
        if names:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=manifest)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids")
    m = materialise(ordered.mapInArrow(out, "part int, seq int, uri string, n_docs long, n_ids long"), "ids-manifest")
    # One row for each part meets in a task; files are summed inside their part.
    whole = m.groupBy("part").agg(F.sum("n_ids").alias("n"))
    whole = whole.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return m.withColumn("inside", inside).join(whole, "part").withColumn("first", F.col("before") + F.col("inside")).drop("before", "inside")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                doc_ids, sizes, ids = huffman.read_file(files.read_all(uri))
                data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes, dtype=np.int64)
                starts = ends - sizes
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_ids, starts + first, sizes.astype(np.int64), crc)], names=names)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("uri", "first").repartition(n).mapInArrow(out, ", ".join(f"{x} long" for x in names))


def store(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the files and give their manifest."""
    ids = encode_ids(docs, path, end_id)
    counts = count_ids(ids, id_type(path), _tokenizer(path).vocabulary)
    return write(ids, huffman.code_lengths(counts), id_type(path), new_folder(docs.sparkSession, "tokens"))


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    return read(materialise(store(docs, path, end_id), "tokens-manifest"))
