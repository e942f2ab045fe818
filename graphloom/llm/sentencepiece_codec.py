"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Only the model file is read; the encoder is our own. For models of the BPE type with identity normalisation, a dummy
prefix, spaces kept and byte fallback. No piece has the space mark after another character and none has a line feed, so
text falls into units (space marks, then other characters; or a line feed, then others) across which nothing merges.
Distinct units of a batch are merged together (bpe.merge_words) and remembered in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PairRanks, merge_words
from .common import batch, by_bytes, documents
from .wordcache import WordCache, current

MARK = "▁"
CACHED_UNITS = 200_000
_UNITS = re.compile(r"\n[^ \n]*| +[^ \n]*")


class PieceModel:
    """encode_units(), unit by unit, and decode() of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        t, n = proto.trainer_spec, proto.normalizer_spec
        if t.model_type != t.BPE or not t.byte_fallback or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or t.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix")
        pieces = proto.pieces
        kinds = type(pieces[0])
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in pieces):
            raise ValueError("models with user-defined or unused pieces aren't supported")
        self.end_id = next(i for i, p in enumerate(pieces) if p.type == kinds.CONTROL and p.piece == t.eos_piece)
        normal = {p.piece: i for i, p in enumerate(pieces) if p.type == kinds.NORMAL}
        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in normal):
            raise ValueError("a piece has a line feed, or a space after another character")
        self.byte_ids = np.zeros(256, np.int64)
        for i, p in enumerate(pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        #: Characters without a piece are symbols from here on; they don't merge.
        self.unknown = len(pieces)
        self.chars = np.full(0x110000, -1, np.int64)
        for p, i in normal.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        # A character that is no piece itself may still be part of one.
        part = sorted({c for p in normal for c in p if self.chars[ord(c)] < 0})
        symbol = normal | {c: self.unknown + ord(c) for c in part}
        self.chars = np.where(self.chars < 0, self.unknown + np.arange(0x110000), self.chars)
        scores = np.unique(-np.array([p.score for p in pieces], np.float32), return_inverse=True)[1]
        rows, made = [], {p for p in symbol if len(p) == 1}
        for p in sorted(normal, key=len):  # pieces that no merges make are no parts of others
            splits = [k for k in range(1, len(p)) if p[:k] in made and p[k:] in made]
            rows += [(symbol[p[:k]], symbol[p[k:]], scores[normal[p]], normal[p]) for k in splits]
            made |= {p} if splits else set()
        self.pairs = PairRanks(*zip(*rows, strict=True))
        #: What a piece adds to the decoded text.
        self.bytes = [bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else p.piece.replace(MARK, " ").encode() for p in pieces]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units one after the other, and how many each has; spaces in a unit are written as MARK."""
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ids, lengths = merge_words(self.chars[flat], np.fromiter(map(len, units), np.int64, len(units)), self.pairs)
        lost = np.flatnonzero(ids >= self.unknown)
        if not len(lost):
            return ids, lengths
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in (ids[lost] - self.unknown).tolist()]
        times = np.ones(len(ids), np.int64)
        times[lost] = [len(x) for x in raw]
        out = np.repeat(ids, times)
        out[np.repeat(ids >= self.unknown, times)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(units)), lengths)
        return out, np.bincount(owner, times, len(units)).astype(np.int64)

    def encode(self, text: str) -> list[int]:
        """A text's ids, without the end id."""
        if not text:
            return []
        return self.encode_units([u.replace(" ", MARK) for u in _UNITS.findall(" " + text.replace(MARK, " "))])[0].tolist()

    def decode(self, ids) -> str:
        """The text of ids: the pieces with MARK as a space, without the first space; bytes that aren't UTF-8 become
        replacement characters."""
        data = b"".join([self.bytes[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _cache(path: str) -> tuple[PieceModel, WordCache]:
    """Of this worker process: for a unit, its ids as decimals with a space after each, and its decoded bytes. A unit's
    key has one space less in front; one that begins with a line feed has itself as its key."""

    def made() -> tuple[PieceModel, WordCache]:
        model = PieceModel(path)
        decimals = [b"%d " % i for i in range(len(model.bytes))]

        def make(keys: list[str]) -> list[tuple[bytes, bytes]]:
            ids, lengths = model.encode_units([k if k[:1] == "\n" else MARK + k.replace(" ", MARK) for k in keys])
            ids, ends = ids.tolist(), np.cumsum(lengths).tolist()
            said, text = list(map(decimals.__getitem__, ids)), list(map(model.bytes.__getitem__, ids))
            return [(b"".join(said[i:j]), b"".join(text[i:j])) for i, j in zip([0, *ends], ends)]

        return model, WordCache(make, CACHED_UNITS)

    return current(("pieces", path), made)


def _keys(text: str) -> list[str]:
    if not text:
        return []
    text = text.replace(MARK, " ")  # it counts as a space
    if "  " in text or text[0] == " " or text[0] == "\n":
        return [u if u[0] == "\n" else u[1:] for u in _UNITS.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


def round_trip_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens (the end id counts), ids_sha256, decoded_sha256. A null text is empty: the end id
    alone. Ids may be null or repeat; other columns aren't read."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = _cache(model_file)
        end = b"%d" % model.end_id
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in by_bytes(texts):
                keys = [_keys(t) for t in texts[i:j]]
                cache.fill(set().union(*keys))
                get, rows = cache.table.__getitem__, []
                for doc, ks in zip(ids[i:j], keys, strict=True):
                    both = list(map(get, ks))
                    said = b"".join([x for x, _ in both]) + end
                    text = b"".join([x for _, x in both])
                    text = text[1:] if text[:1] == b" " else text
                    rows.append((doc, said.count(b" ") + 1, hashlib.sha256(said).hexdigest(), hashlib.sha256(text).hexdigest()))
                yield batch(schema, *zip(*rows, strict=True))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip_digests(documents(spark, sf_dir), default_model())
