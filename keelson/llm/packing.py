"""Best-fit packing: hierarchical residual packing of token pieces into sequences.

Documents are tokenised in the partitions that hold them and cut into pieces of
at most ``LENGTH`` tokens. Each partition packs its own pieces best-fit
decreasing, block by block; bins that are full but for ``SLACK`` tokens are
emitted. The others are merged in a tree: as items with the length they have,
they meet in ever fewer groups, which pack them best-fit again and emit what
becomes nearly full, until one group is left or a round no longer saves bins.

No round gives a task more than about ``GROUP`` items: their number sets the
number of groups, and items are dealt evenly. Items that cannot be combined
(all longer than half a sequence, say) end the rounds instead of meeting in one
task. Membership of a merged bin travels as arrays of at most ``LENGTH`` pieces.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, frugal, kept, rows_to_batches, scratch, small_batches

LENGTH = 2048
SLACK = 4
#: Pieces that a partition packs at a time, and items that a task of a later round gets.
BLOCK = 100_000
GROUP = 100_000
SEPARATOR = 0
#: Words, and parts of words, whose ids a worker remembers in all, and as many that it met before these; fewer where they take more bytes.
MEMO_WORDS = 400_000
MEMO_BYTES = 40 << 20
#: Bytes of an entry besides its word and ids: two objects' heads and a place in the mapping.
_ENTRY = 160

_MEMBER = ("doc_id", "piece", "start", "length", "ids_crc32")
BIN = T.StructType(
    [
        T.StructField("bin", T.LongType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("doc_id", T.ArrayType(T.LongType())),
        T.StructField("piece", T.ArrayType(T.IntegerType())),
        T.StructField("start", T.ArrayType(T.LongType())),
        T.StructField("length", T.ArrayType(T.LongType())),
        T.StructField("ids_crc32", T.ArrayType(T.LongType())),
    ]
)


#: Texts of these characters are NFC already and lower-cased alike by any library; letters, then digits, of the range.
_PLAIN_CHARACTERS = " -~\u00a1-\u012f\u0131-\u024f"
_PLAIN = re.compile(f"[{_PLAIN_CHARACTERS}]*").fullmatch
_LETTERS = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"


def _as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_alphabet() -> dict[int, int]:
    """Byte-level vocabularies' character for each byte: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


class WordTokenizer(dict):
    """Ids of whole texts by a ``tokenizers`` file; a mapping from odd words to their ids.

    Where the vocabulary's pre-tokenizer drops white space and joins nothing over
    it, the ids of a text are those of its words in order. Runs of words of the
    common Latin ranges are lower-cased and parted by the vocabulary's own pattern
    here, and the library's model encodes each distinct part. A word with another
    character or an added token goes to the library whole; words end at space, tab
    and newline, other white space stays inside them. Each distinct part or word
    is encoded once (the last ``MEMO_WORDS`` of ``MEMO_BYTES`` are kept, and those
    of the ones before that are met again). For files of another kind every text
    is given to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.parts = Tokenizer.from_file(path), {}
        self.old_words, self.old_parts = {}, {}
        self.held = 0
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        spec["model"] = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        split = steps[0] if steps[0].get("type") == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] else None
        pattern = split["pattern"].get("Regex", "") if split else ""
        self.by_words = bool(split) and kinds == ["NFC", "Replace", "Lowercase"] and " " not in pattern and spec["post_processor"] is None
        own = pattern.replace("\\s", " ").replace("[\\p{L}]", f"[{_LETTERS}]").replace("\\p{L}", _LETTERS).replace("[\\p{N}]", f"[{_DIGITS}]").replace("\\p{N}", _DIGITS)
        self.find = re.compile(own).findall if self.by_words and "\\" not in own else None
        special = "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)"
        self.has_special = re.compile(special).search
        self.odd = re.compile(f"[^{_PLAIN_CHARACTERS}]|{special}").search
        self.alphabet = byte_alphabet()

    def _library(self, text: str) -> bytes:
        return _as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _hold(self, key: str, found: bytes) -> None:
        """Count an entry that is about to be kept; when the memo is full, what it has become the old ones."""
        if len(self) + len(self.parts) >= MEMO_WORDS or self.held >= MEMO_BYTES:
            self.old_words, self.old_parts, self.parts, self.held = dict(self), self.parts, {}, 0
            self.clear()
        self.held += _ENTRY + len(key) + len(found)

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self.old_parts.get(part)
            if found is None:
                mapped = part.encode().decode("latin-1").translate(self.alphabet)
                found = _as_bytes([t.id for t in self.model.tokenize(mapped)])
            self._hold(part, found)
            self.parts[part] = found
        return found

    def __missing__(self, word: str) -> bytes:
        found = self.old_words.get(word)
        if found is None:
            found = self._library(word) if word else b""
        self._hold(word, found)
        self[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        """Ids of a text of plain words and spaces, without added tokens."""
        known, part = self.parts.get, self._part
        return b"".join([known(p) or part(p) for p in self.find(text.lower())])

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.by_words:
            return self._library(text)
        text = text.replace("\n", " ").replace("\t", " ")
        if not self.find:
            return b"".join(map(self.__getitem__, text.split(" ")))
        if _PLAIN(text) and not self.has_special(text):
            return self._plain(text)
        found, at = [], 0
        odd = self.odd(text)
        while odd:
            begin = text.rfind(" ", at, odd.start()) + 1 or at
            end = text.find(" ", odd.end())
            end = len(text) if end < 0 else end
            found += self._plain(text[at:begin]), self[text[begin:end]]
            at, odd = end, self.odd(text, end)
        return b"".join([*found, self._plain(text[at:])])


def cut(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids (four bytes each)."""
    step = 4 * length
    return [(k // step, k // 4, len(part) // 4, zlib.crc32(part)) for k in range(0, len(ids), step) for part in (ids[k : k + step],)]


def best_fit(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Best-fit decreasing: the items' numbers by bin.

    Open bins are kept by their free room, the rooms in use as bits of one
    integer, so the tightest bin that an item fits is found in constant time.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist() if sizes else []
    for item in order:
        size = sizes[item]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            held = by_room[room]
            at = held.pop()
            if not held:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = length, len(bins)
            bins.append([item])
        room -= size
        if room:
            by_room[room].append(at)
            rooms |= 1 << room
    return bins


def _pack_locally(path: str, length: int, block: int):
    wanted = arrow_schema(BIN)

    def bins(pieces: list[tuple]) -> Iterator[tuple]:
        for held in best_fit([p[3] for p in pieces], length):
            members = [pieces[i] for i in held]
            yield (0, sum(m[3] for m in members), *map(list, zip(*members, strict=True)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tokenizer = kept(WordTokenizer, path)
        end = np.asarray([SEPARATOR], "<u4").tobytes()
        pieces: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id = doc_id.as_py()
                for piece, start, size, crc in cut(tokenizer.ids(text.as_py() or "") + end, length):
                    if size == length:
                        yield 0, size, [doc_id], [piece], [start], [size], [crc]
                    else:
                        pieces.append((doc_id, piece, start, size, crc))
            if len(pieces) >= block:
                yield from bins(pieces)
                pieces = []
        yield from bins(pieces)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows_to_batches(rows(batches), wanted, lambda r: 40 * len(r[2]))

    return pack


def _pack_bins(length: int):
    """Merge the bins of a partition as items."""
    wanted = arrow_schema(BIN)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        held.sort(key=lambda r: (r[1], r[2][0] is not None, r[2][0] or 0, r[3][0]))  # so that a retry packs alike

        def rows() -> Iterator[tuple]:
            for group in best_fit([r[1] for r in held], length):
                merged = [held[i] for i in group]
                yield (0, sum(m[1] for m in merged), *([x for m in merged for x in m[k]] for k in range(2, 7)))

        yield from rows_to_batches(rows(), wanted, lambda r: 40 * len(r[2]))

    return pack


def pack(docs: DataFrame, tokenizer: str, text: str = "text", length: int = LENGTH, slack: int = SLACK, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece.

    A null or empty text is the end token alone. A document longer than a
    sequence is cut into full pieces and a rest, which is packed like any other
    piece. Repeated rows and repeated or null ids are packed as often as they
    occur. Other columns of ``docs`` are not looked at; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col(text).alias("text"))
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    bins = scratch(rows.mapInArrow(frugal(_pack_locally(tokenizer, length, block)), BIN), "bins")
    done = [bins.where(F.col("size") >= length - slack)]
    open_bins = bins.where(F.col("size") < length - slack)
    n_open = open_bins.count()
    while n_open > 1:
        groups = max(1, -(-n_open // group))
        dealt = open_bins.repartition(groups, F.xxhash64("doc_id", "piece")) if groups > 1 else open_bins.coalesce(1)
        merged = scratch(dealt.mapInArrow(frugal(_pack_bins(length), "merging"), BIN), "bins")
        left = merged.count()
        if groups == 1 or left > 0.98 * n_open:
            open_bins = merged
            break
        done.append(merged.where(F.col("size") >= length - slack))
        open_bins = merged.where(F.col("size") < length - slack)
        n_open = open_bins.count()
    done.append(open_bins)
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    numbered = every.withColumn("sequence_id", F.monotonically_increasing_id())
    before = F.expr("transform(sequence(1, size(length)), i -> aggregate(slice(length, 1, i - 1), 0L, (a, x) -> a + x))")
    members = F.explode(F.arrays_zip(*_MEMBER, before.alias("offset")))
    return numbered.select("sequence_id", members.alias("m")).select(*(F.col(f"m.{c}").alias(c) for c in _MEMBER), "sequence_id", F.col("m.offset").alias("offset"))
