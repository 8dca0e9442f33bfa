"""SentencePiece encoding with source offsets, and decoding.

The normaliser walks the model's compiled character map (a double-array trie of byte strings) and, at each place, takes
the longest matching prefix, else one character (a broken byte becomes U+FFFD), as the library does. It records, for
every byte of the normalised text, the source bytes it came from. The merges of the normalised text are the library's
own, from a copy of the model that normalises nothing; every piece is projected through the recorded alignment to a span
of bytes of the original text.

No piece of the vocabulary has a space mark after another character (checked when a model is loaded), so merges never
cross the place before a run of space marks. Long texts are cut at such places, every PART characters or so, which
bounds the memory that merging takes; nothing is kept from text to text.

Defined results: null text is taken as empty: no ids, empty decoded text. Empty text has no ids. Repeated rows give
repeated rows. Extra columns of the input are ignored. Texts are processed whole, one at a time.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, read

SPACE = "▁"
PART = 1 << 16
SCHEMA = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"


class CharacterMap:
    """A compiled map: uint32 size, that many bytes of trie units, then zero-terminated replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest key that data has at `at`."""
        units, found = self.units, None
        if not units:
            return None
        node = self._child_base(0)
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            if node >= len(units) or (units[node] & 0x800000FF) != byte:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit & 0x100:  # a value hangs below: this prefix is a key
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _child_base(self, node: int) -> int:
        return node ^ self._offset(self.units[node])


class Codec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        pieces = [p.piece for p in model.pieces]
        self.byte_ids = np.array([p.type == 6 for p in model.pieces])
        plain = [p for p, b in zip(pieces, self.byte_ids, strict=True) if not b]
        self.unknown = model.trainer_spec.unk_id
        self.byte_fallback = model.trainer_spec.byte_fallback
        self.lengths = np.array([1 if b else len(p.encode()) for p, b in zip(pieces, self.byte_ids, strict=True)], np.int64)
        self.names = [str(i) for i in range(len(pieces))]
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        # the same merges over text that this class has normalised: no second normalisation
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        spec.name = "identity"
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in plain) and SPACE in plain and model.trainer_spec.model_type == 2

    def normalize(self, data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
        """Normalised text and, for each of its UTF-8 bytes, start and end of its source in data."""
        mark = SPACE.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze:
            if not data:
                return "", np.empty(0, np.int64), np.empty(0, np.int64)
            head = len(mark) if self.dummy else 0
            width = np.ones(len(data), np.int64)
            width[np.frombuffer(data, np.uint8) == 32] = len(mark)
            start = np.concatenate([np.zeros(head, np.int64), np.repeat(np.arange(len(data)), width)])
            end = start + 1
            end[:head] = 0
            return (b"" + (mark if self.dummy else b"") + data.replace(b" ", mark)).decode("utf-8", "replace"), start, end
        out, starts, ends = bytearray(), [], []

        def put(piece: bytes, s: int, e: int) -> None:
            same = data[s:e] == piece
            out.extend(piece)
            starts.extend(range(s, e) if same else [s] * len(piece))
            ends.extend(range(s + 1, e + 1) if same else [e] * len(piece))

        at, blank = 0, self.squeeze
        chunks = []
        while at < len(data):
            got = self.map.longest(data, at)
            if got is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 1
                try:
                    data[at : at + n].decode("utf-8")
                    got = (n, data[at : at + n])
                except UnicodeDecodeError:
                    got = (1, "�".encode())
            chunks.append((got[1], at, at + got[0]))
            at += got[0]
        if self.squeeze:
            while chunks and not chunks[-1][0].strip(b" "):
                chunks.pop()
            while chunks and not chunks[0][0].strip(b" "):
                chunks.pop(0)
        if chunks and self.dummy:  # stands for nothing, where the first kept character begins
            out.extend(mark)
            starts.extend([chunks[0][1]] * len(mark))
            ends.extend([chunks[0][1]] * len(mark))
        for piece, s, e in chunks:
            if self.squeeze and blank:
                piece = piece.lstrip(b" ")
            if b" " in piece:
                for k, part in enumerate(re.split(b"( )", piece)):
                    if part:
                        put(mark if part == b" " else part, s, e)
            elif piece:
                put(piece, s, e)
            if piece:
                blank = self.squeeze and piece.endswith(b" ")
        return out.decode("utf-8", "replace"), np.array(starts, np.int64), np.array(ends, np.int64)

    def segment(self, normalised: str, part: int = PART) -> list[int]:
        if not self.splits or len(normalised) <= part:
            return self.merger.encode(normalised) if normalised else []
        ids, s = [], 0
        while s < len(normalised):
            e = s + part
            while 0 < (e := normalised.find(SPACE, e)) and normalised[e - 1] == SPACE:
                e += 1
            e = e if e > 0 else len(normalised)
            ids += self.merger.encode(normalised[s:e])
            s = e
        return ids

    def encode(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        """ids and, for each, the span of bytes of text (start, end) that it stands for."""
        data = (text or "").encode("utf-8", "replace")
        normalised, start, end = self.normalize(data)
        ids = self.segment(normalised)
        if not ids:
            return [], np.empty(0, np.int64), np.empty(0, np.int64)
        number = np.array(ids, np.int64)
        length = self.lengths[number]
        if not self.byte_fallback and (number == self.unknown).any():
            # an unknown piece stands for a run of characters that no piece has: take its length from the library
            length = np.array([len(p.encode()) for p in self.merger.encode(normalised, out_type=str)], np.int64)
        stop = np.cumsum(length)
        return ids, start[stop - length], end[stop - 1]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_loaded: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """The model at path, or the public one, wherever the machine that asks has it."""
    path = path or public_model()
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """SCHEMA for each row of docs: ids, their source spans in bytes, and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # offsets take several times a text's size
                part = batch.slice(at, 64)
                rows = [c.encode(t.as_py()) for t in part.column("text")]
                as_lists = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *as_lists, pa.array([c.decode(r[0]) for r in rows], pa.string())], ["doc_id", "ids", "starts", "ends", "decoded"])

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long"


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The digest of encode() without shipping ids to the JVM: covered_bytes is the bytes of text under some piece's span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids, start, end = c.encode(text.as_py())
                reach = np.maximum.accumulate(end) if len(ids) else end
                covered = int((end - np.maximum(start, np.concatenate([[0], reach[:-1]]))).clip(0).sum()) if len(ids) else 0
                out.append((doc_id, len(ids), sha(",".join(map(c.names.__getitem__, ids))), sha(c.decode(ids)), covered))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    return map_arrow(docs.select("doc_id", "text"), run, DIGEST)


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
