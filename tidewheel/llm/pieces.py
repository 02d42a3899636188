"""SentencePiece encoding that keeps every piece's place in the source, and decoding.

The text is normalised by longest prefixes of the model's compiled character map, which records for each
normalised byte its source byte; pieces are cut from the normalised text and projected back to source
byte spans. Where the map is empty and white space is plain, alignment is arithmetic: a piece covers as
many source bytes as its surface has, with one byte for a space mark and none for the added first one.
A byte-fallback piece covers the byte that it stands for; with a character map it covers the character.

Null text is empty: the end id alone. Null doc_ids and repeated rows pass through; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.charsmap import SPACE, CharsMap, normalise
from tidewheel.llm.storage import bounded_batches, lean
from tidewheel.llm.unitcache import UnitCache, plain, portions

_MARK = "▁"


@dataclass
class Encoded:
    """ids and their decimal text without the end id, and the source end offset of each piece."""

    ids: np.ndarray
    text: str
    ends: np.ndarray


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.chars = CharsMap(spec.precompiled_charsmap)
        self.rules = (spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.end_id = self.lib.eos_id()
        kinds = model.SentencePiece.Type if hasattr(model, "SentencePiece") else pb.ModelProto.SentencePiece
        self.surface = []
        for p in model.pieces:
            if p.type == kinds.BYTE:
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.surface.append(b"" if p.type == kinds.CONTROL else p.piece.encode())
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN}
        self.length = np.array([len(s) for s in self.surface], np.int64)
        self.source_length = np.array([len(s.replace(SPACE, b" ")) for s in self.surface], np.int64)
        # Units can be encoded apart if pieces hold the mark only in front and never a line end.
        inner = any(a != _MARK and b == _MARK for p in model.pieces for a, b in zip(p.piece, p.piece[1:], strict=False))
        user = any(p.type == kinds.USER_DEFINED for p in model.pieces)
        ended = any("\n" in p.piece for p in model.pieces)
        fallback = any(p.type == kinds.BYTE for p in model.pieces)
        bpe = model.trainer_spec.model_type == model.trainer_spec.BPE
        self.apart = bpe and fallback and not (inner or user or ended) and not self.chars and self.rules == (True, False, True) and not model.trainer_spec.treat_whitespace_as_suffix
        self.units = UnitCache(self._units)

    def _units(self, units: list[str]) -> list[tuple[bytes, str]]:
        """A unit without a line end in front stands behind a mark, which the library adds by itself."""
        out = []
        for u, ids in zip(units, self.lib.encode(units, num_threads=1), strict=True):
            ids = ids[1:] if u.startswith("\n") else ids
            out.append((np.array(ids, "<u4").tobytes(), " ".join(map(str, ids))))
        return out

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """Source end offsets of the pieces ``ids`` of ``text`` through the character map."""
        norm, source = normalise(text, self.chars, *self.rules)
        at, ends = 0, []
        for k, i in enumerate(ids):
            if i in self.unknown:  # covers all up to the next known piece
                nxt = next((self.surface[j] for j in ids[k + 1 :] if j not in self.unknown), None)
                at = len(norm) if nxt is None else max(at, norm.find(nxt, at + 1))
            else:
                at += len(self.surface[i])
            ends.append(int(source[min(at, len(norm))]))
        return np.array(ends, np.int64)

    def encode(self, texts: list[str]) -> list[Encoded]:
        out: list[Encoded | None] = [None] * len(texts)
        for part in portions(texts):
            split: dict[int, list[str]] = {}
            whole: list[int] = []
            for i in part:
                t = texts[i]
                if self.apart and t and plain(t) and _MARK not in t and "\0" not in t:
                    split[i] = t.replace("\n", " \n").split(" ")
                else:
                    whole.append(i)
            known = self.units.ready(u for us in split.values() for u in us)
            get = known.__getitem__
            for i, units in split.items():
                got = list(map(get, units))
                ids = np.frombuffer(b"".join([g[0] for g in got]), "<u4")
                out[i] = Encoded(ids, " ".join([g[1] for g in got]), np.cumsum(self.source_length[ids]) - 1)
            for i, ids in zip(whole, self.lib.encode([texts[i] for i in whole], num_threads=1) if whole else [], strict=True):
                out[i] = Encoded(np.array(ids, "<u4"), " ".join(map(str, ids)), self.spans(texts[i], ids))
        return out  # type: ignore[return-value]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """As the library's decode(ids)."""
        return self.lib.decode(ids) if ids else []


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


_NAMES = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "source_bytes", "spans_crc32", "ids", "decoded", "spans"]


def encode(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """A row for each row of ``docs``: the contract's columns, source_bytes and spans_crc32.

    spans_crc32 is over the pieces' source end offsets as little-endian unsigned 32-bit numbers;
    source_bytes is the last of them. With ``keep`` the columns ids, decoded and spans hold the results; spans has the
    source bytes (start, end) of each piece but the end id, in order: a piece starts where the one before it ends.
    """
    bounded_batches(docs.sparkSession)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for part in portions(texts):
                rows: dict[str, list] = {n: [] for n in _NAMES}
                found = c.encode([texts[i] for i in part])
                ids = [[*e.ids.tolist(), c.end_id] for e in found]
                for i, e, own, back in zip(part, found, ids, c.decode(ids), strict=True):
                    rows["doc_id"].append(names[i])
                    rows["n_tokens"].append(len(own))
                    rows["ids_sha256"].append(hashlib.sha256(f"{e.text} {c.end_id}".lstrip().encode()).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                    rows["source_bytes"].append(int(e.ends[-1]) if len(e.ends) else 0)
                    rows["spans_crc32"].append(zlib.crc32(e.ends.astype("<u4").tobytes()))
                    rows["ids"].append(own if keep else None)
                    rows["decoded"].append(back if keep else None)
                    rows["spans"].append([{"start": a, "end": b} for a, b in zip([0, *e.ends.tolist()], e.ends.tolist(), strict=False)] if keep else None)
                yield pa.RecordBatch.from_pydict(rows, schema=_SCHEMA)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, source_bytes long, spans_crc32 long, ids array<int>, decoded string, spans array<struct<start:int,end:int>>"
    got = rows.mapInArrow(lean(out), schema)
    return got if keep else got.drop("ids", "decoded", "spans")


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("source_bytes", pa.int64()), ("spans_crc32", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
)
