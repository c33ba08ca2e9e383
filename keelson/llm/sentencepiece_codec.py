"""SentencePiece encoding and decoding that keeps offsets.

Texts are normalised by longest-prefix replacement through the model's compiled
character map (a double-array trie with a pool of replacements), while each
normalised byte records the source byte it stems from. The normalised text is
parted where no piece of the vocabulary can cross (before a run of the space
mark, around newlines of a byte-fallback model), each distinct part is segmented
once by the library's model, and every piece is projected to the bytes of the
original text that it covers.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, binaries, frugal, in_groups, kept, small_batches

SPACE = "▁"
#: Bytes of parts and their ids that a task remembers, an entry having ENTRY besides.
MEMO_BYTES, ENTRY = 128 << 20, 150
#: Documents that a result batch holds, so that batches of long texts stay small.
BATCH_DOCS = 128


class CharacterMap:
    """Longest-prefix lookups in a model's compiled character map."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.pool = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest mapped prefix of ``source[at:]`` and that prefix's length."""
        units = self.units
        if not units:
            return None
        place, best = 0, None
        unit = units[0]
        place ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(source)):
            place ^= source[k]
            if place >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != source[k]:
                break
            place ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = (units[place] & 0x7FFFFFFF, k + 1 - at)
        if best is None:
            return None
        return self.pool[best[0] : self.pool.index(b"\0", best[0])], best[1]


class Normalizer:
    """A model's normalisation with alignment to source bytes."""

    def __init__(self, spec, symbols: list[str], space_as_suffix: bool):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.trim, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, space_as_suffix
        self.symbols = sorted((s.encode() for s in symbols), key=len, reverse=True)
        self.space = SPACE.encode() if self.escape else b" "
        self.plain = not self.map.units and not self.symbols and not self.trim and not self.suffix

    def _next(self, source: bytes, at: int) -> tuple[bytes, int]:
        for symbol in self.symbols:
            if source.startswith(symbol, at):
                return symbol, len(symbol)
        mapped = self.map.longest(source, at)
        if mapped is not None:
            return mapped
        first = source[at]
        width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return source[at : at + width], width

    def normalise(self, source: bytes) -> tuple[str, np.ndarray]:
        """The normalised text, and of each of its bytes (and its end) the source offset."""
        if self.plain:
            prefix = self.space if self.dummy and source else b""
            offsets = np.arange(len(source) + 1)
            if self.escape:
                raw = np.frombuffer(source, np.uint8)
                offsets = np.repeat(offsets, np.append(np.where(raw == 32, len(self.space), 1), 1))
            return (prefix + source.replace(b" ", self.space)).decode("utf-8", "replace"), np.concatenate([np.zeros(len(prefix), np.int64), offsets])
        out, offsets, at, end = bytearray(), [], 0, len(source)
        if self.trim:
            while at < end:
                found, width = self._next(source, at)
                if found != b" ":
                    break
                at += width
        if at >= end:
            return "", np.array([at])

        def put(text: bytes, offset: int) -> None:
            out.extend(text)
            offsets.extend([offset] * len(text))

        if self.dummy and not self.suffix:
            put(self.space, at)
        after_space = self.trim
        while at < end:
            found, width = self._next(source, at)
            if after_space:
                found = found.lstrip(b" ")
            if found:
                put(found.replace(b" ", self.space), at)
                after_space = found.endswith(b" ")
            at += width
            if not self.trim:
                after_space = False
        if self.trim:
            while out.endswith(self.space):
                at = offsets[len(out) - len(self.space)]
                del out[len(out) - len(self.space) :], offsets[-len(self.space) :]
        if self.dummy and self.suffix:
            put(self.space, at)
        return out.decode("utf-8", "replace"), np.array([*offsets, at])


#: Texts in which a space mark is not simply one space before a word.
_UNEVEN = re.compile(b"  | \n| $|^ |\0|\xe2\x96\x81").search


def _spell(word: bytes) -> str:
    """A part as the segmenter takes it: normalised text as it is, a word after its space mark or the newline before it."""
    if word.startswith(b"\0"):
        return word[1:].decode()
    return word.decode("utf-8", "replace") if word.startswith(b"\n") else SPACE + word.decode("utf-8", "replace")


class Codec:
    """Encoding with byte spans and decoding by one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [p.piece for p in model.pieces]
        byte_pieces = {i for i, p in enumerate(model.pieces) if p.type == 6}
        self.normalizer = Normalizer(model.normalizer_spec, [p.piece for p in model.pieces if p.type == 4], model.trainer_spec.treat_whitespace_as_suffix)
        self.widths = np.array([1 if i in byte_pieces else len(p.encode()) for i, p in enumerate(pieces)], np.int32)
        self.unknown = self.processor.unk_id()
        spec = model.normalizer_spec
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        model.trainer_spec.treat_whitespace_as_suffix = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        parts = SPACE in pieces and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        lines = parts and byte_pieces and not any("\n" in p for p in pieces)
        self.part = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if parts else None
        self.ids: dict[bytes, bytes] = {}
        self.held = 0
        self.simple = lines and self.normalizer.plain and self.normalizer.dummy and self.normalizer.escape
        self.source_widths = self.widths - 2 * np.array([p.count(SPACE) for p in pieces], np.int32)
        self.decimals = [str(i) for i in range(len(pieces))]

    def _learn(self, parts: set[bytes]) -> None:
        """Segment the parts that are not remembered."""
        known = self.ids
        new = parts.difference(known)
        if new:
            if self.held > MEMO_BYTES:
                known.clear()
                self.held, new = 0, parts
            new = list(new)
            for part, ids in zip(new, self.segmenter.encode(list(map(_spell, new)), num_threads=1), strict=True):
                known[part] = packed = struct.pack(f"{len(ids)}i", *ids)
                self.held += ENTRY + len(part) + len(packed)

    def encode(self, source: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and of each piece the first source byte and the one after the last."""
        return self.encode_all([source])[0]

    def encode_all(self, sources: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``encode`` of several texts, whose new parts are segmented at once."""
        prepared = []
        for source in sources:
            if not source:
                prepared.append(([], None))
            elif self.simple and not _UNEVEN(source):
                # Without a character map only spaces change: a mark of three bytes for one, and one before the text.
                prepared.append((source.replace(b"\n", b" \n").split(b" "), None))
            else:
                text, offsets = self.normalizer.normalise(source)
                parts = self.part(text) if self.part else [text] if text else []
                prepared.append(([b"\0" + p.encode() for p in parts], offsets))
        self._learn(set().union(*(parts for parts, _ in prepared)))
        return [self._spans(*one) for one in prepared]

    def _spans(self, parts: list[bytes], offsets: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(b"".join(map(self.ids.__getitem__, parts)), np.int32)
        if offsets is None:
            if not len(ids):
                return ids, ids, ids
            ends = np.cumsum(self.source_widths[ids], dtype=np.int32) - np.int32(1)
            return ids, np.concatenate([np.zeros(1, np.int32), ends[:-1]]), ends
        widths = self.widths[ids]
        if len(ids) and (ids == self.unknown).any():
            surfaces = [p for part in parts for p in self.segmenter.encode(_spell(part), out_type=str)]
            widths = np.where(ids == self.unknown, [len(p.encode()) for p in surfaces], widths)
        marks = offsets[np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])].astype(np.int32)
        return ids, marks[:-1], marks[1:]


def _codec(path: str) -> Codec:
    return kept(Codec, path)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def _int_lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    """Python lists of a column of integer lists; much faster than ``to_pylist``."""
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    for i, missing in enumerate(column.is_null().to_pylist()):
        yield None if missing else values[offsets[i] : offsets[i + 1]].tolist()


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``ids``, and ``begins`` and ``ends``, each piece's bytes in the original text.

    A null text is encoded like an empty one, to no ids. Rows and repeats are
    encoded each; an empty table gives no rows; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*(rows.schema[k] for k in keep), *(T.StructField(n, ints) for n in ("ids", "begins", "ends"))])
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            done = 0
            for texts in in_groups(binaries(batch.column(len(keep)))):
                found = codec.encode_all([t or b"" for t in texts])
                columns = [*batch.slice(done, len(texts)).columns[: len(keep)], *(_lists([f[i] for f in found]) for i in range(3))]
                done += len(texts)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, wanted, strict=True)], schema=wanted)

    return rows.mapInArrow(frugal(run), schema)


def _each_ids(encoded: DataFrame, model: str, keep: tuple[str, ...], more: list[T.StructField], of) -> DataFrame:
    """``keep`` and what ``of(codec, ids)`` gives for each row's ``ids``."""
    rows = encoded.select(*keep, "ids")
    schema = T.StructType([*(rows.schema[k] for k in keep), *more])
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(start, BATCH_DOCS)
                found = [of(codec, ids) for ids in _int_lists(part.column(len(keep)))]
                columns = [*part.columns[: len(keep)], *(pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), list(wanted)[len(keep) :], strict=True))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, wanted, strict=True)], schema=wanted)

    return rows.mapInArrow(frugal(run), schema)


def decode(encoded: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``text``, decoded from ``ids`` (null and empty ids: empty)."""
    return _each_ids(encoded, model, keep, [T.StructField("text", T.StringType())], lambda codec, ids: (codec.processor.decode(ids or []) or "",))


def digests(encoded: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_tokens``, and hashes of the ids (decimal, joined by commas) and of the decoded text."""

    def of(codec: Codec, ids: list[int] | None) -> tuple[int, str, str]:
        ids = ids or []
        text = codec.processor.decode(ids) if ids else ""
        return len(ids), hashlib.sha256(",".join(map(codec.decimals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _each_ids(encoded, model, keep, fields, of)
