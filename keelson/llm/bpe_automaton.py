"""BPE as an automaton: merges are compiled one by one, words are encoded by transitions of a table.

The automaton over tokens starts as one state with an arc back to itself for each
base symbol. Each merge ``a b -> c`` is a gadget put into it: wherever an arc
``a`` was followed by an arc ``b``, an arc ``c`` is added past both, and all arcs
``a`` are led to a new state, a copy without the arc ``b``, so that ``a b`` can
no longer be spelled. After the last merge it accepts exactly the sequences that
BPE gives, one for each word. All arcs of a token lead to one state, so a merge
adds one state, which is held as its parent and the arc that it lacks.

For encoding, arcs are spelled out in base symbols (a trie of the tokens) and
made deterministic: a state of the table is the set of places where a prefix of
the word may stand, of which exactly one is between tokens. A transition gives
the next state and the token that ends there; walking back from the last one
gives the word's tokens. Table states are made when first met and forgotten when
they are many. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, binaries, frugal, in_groups, kept, small_batches
from .packing import WordTokenizer
from .sentencepiece_codec import _int_lists, _lists

#: Table states that are kept, and bytes of words, and of their parts, with ids, that are remembered (an entry has ENTRY
#: besides), and as many that were met before these.
MOST_STATES = 100_000
MEMO_BYTES, ENTRY = 40 << 20, 200


class MergeAutomaton:
    """The automaton over tokens. ``follows(state, token)`` says whether a state has a token's arc.

    States form a tree by their parents. A state lacks an arc that it or one
    above it was made without, which are intervals of the tree's order; far
    ancestors are reached by jumps that double.
    """

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]]):
        self.target = dict.fromkeys(base, 0)
        self.formed = dict.fromkeys(base, -1)
        self.left: dict[int, int] = {}
        self.parent, self.born, self.jump, lacks, depth = [0], [-1], [0], [-1], [0]
        for k, (a, b, c) in enumerate(merges):
            if c in self.formed or a not in self.formed or b not in self.formed:
                raise ValueError("a merge's parts must be base symbols or made by merges before it, and its result new")
            old = self.target[a]
            self.target[c], self.formed[c], self.left[c] = self.target[b], k, a
            self.target[a] = len(self.parent)
            near, far = self.jump[old], self.jump[self.jump[old]]
            self.jump.append(far if depth[old] - depth[near] == depth[near] - depth[far] else old)
            self.parent.append(old)
            self.born.append(k)
            lacks.append(b)
            depth.append(depth[old] + 1)
        size = [1] * len(lacks)
        for state in range(len(lacks) - 1, 0, -1):
            size[self.parent[state]] += size[state]
        self.at, free = [0] * len(lacks), [1] * len(lacks)
        for state in range(1, len(lacks)):  # a parent is older than its children
            above = self.parent[state]
            self.at[state] = self.at[above] + free[above]
            free[above] += size[state]
        self.lack_from: dict[int, list[int]] = {}
        self.lack_to: dict[int, list[int]] = {}
        for state in sorted(range(1, len(lacks)), key=self.at.__getitem__):
            self.lack_from.setdefault(lacks[state], []).append(self.at[state])
            self.lack_to.setdefault(lacks[state], []).append(self.at[state] + size[state])
        for a, b, c in merges:
            if not self.follows(self._before(a, self.formed[c]), b):
                raise ValueError("a merge that can never be applied")

    def _before(self, token: int, k: int) -> int:
        """The state that a token led to before a merge."""
        state = self.target[token]
        while self.born[state] >= k:
            state = self.parent[state]
        return state

    def follows(self, state: int, token: int) -> bool:
        """An arc made after the state is there if that of its left part is; an older one, unless the state lacks it."""
        born, jump, at = self.born, self.jump, self.at
        while state:
            formed = self.formed[token]
            if formed < born[state]:
                begins = self.lack_from.get(token)
                if begins:
                    i = bisect_right(begins, at[state]) - 1
                    if i >= 0 and at[state] < self.lack_to[token][i]:
                        return False
                while born[state] > formed:
                    far = jump[state]
                    state = far if born[far] > formed else self.parent[state]
                if not state:
                    return True
            token = self.left[token]
        return True


class WordAutomaton:
    """Transitions by base symbols over all the arcs of a ``MergeAutomaton``.

    A place within a token is a node of the trie and the state that the token's
    arc would leave. Below a node with up to ``FEW`` tokens the state matters only
    by which of them it allows, so these stand for it, and places of no token are
    dropped: this lets most prefixes share their table states.
    """

    FEW = 6

    def __init__(self, automaton: MergeAutomaton, spelled: dict[int, tuple[int, ...]], most_states: int = MOST_STATES):
        self.automaton, self.most = automaton, most_states
        self.width = {token: len(s) for token, s in spelled.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.below: list[tuple[int, ...] | None] = [None]
        for token, symbols in spelled.items():
            at = 0
            for x in symbols:
                if x not in self.children[at]:
                    self.children[at][x] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                    self.below.append(())
                at = self.children[at][x]
                few = self.below[at]
                if few is not None:
                    self.below[at] = (*few, token) if len(few) < self.FEW else None
            self.token[at] = token
        self._forget()

    def _forget(self) -> None:
        self.places: list[tuple] = [((0, 0),)]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.numbers: dict[tuple, int] = {((0, 0),): 0}
        self.allowed: dict[tuple[int, int], list[int]] = {}

    def _move(self, state: int, symbol: int) -> tuple[int, int]:
        """The table state after a symbol, and the token that ends with it."""
        after, ended, follows = [], None, self.automaton.follows
        for arc_from, node in self.places[state]:
            node = self.children[node].get(symbol)
            if node is None:
                continue
            few, token = self.below[node], self.token[node]
            if few is None:
                ends = token >= 0 and follows(arc_from, token)
                after.append((arc_from, node))
            else:
                if isinstance(arc_from, tuple):
                    allowed = [t for t in few if t in arc_from]
                else:
                    allowed = self.allowed.get((arc_from, node))
                    if allowed is None:
                        allowed = self.allowed[arc_from, node] = [t for t in few if follows(arc_from, t)]
                ends = token in allowed
                if len(allowed) > ends:
                    after.append((tuple(allowed), node))
            if ends:
                if ended is not None:
                    raise ValueError("a word has two spellings")
                ended = token
        if ended is None:
            raise ValueError("a word has no spelling")
        key = (*after, (self.automaton.target[ended], 0))
        number = self.numbers.setdefault(key, len(self.places))
        if number == len(self.places):
            self.places.append(key)
            self.moves.append({})
        found = self.moves[state][symbol] = number, ended
        return found

    def encode(self, symbols: list[int]) -> list[int]:
        """The tokens of a word of base symbols."""
        if len(self.places) > self.most or len(self.allowed) > 4 * self.most:
            self._forget()
        moves, state, ended = self.moves, 0, []
        for x in symbols:
            row = moves[state]
            state, token = row[x] if x in row else self._move(state, x)
            ended.append(token)
        tokens, at, width = [], len(ended), self.width
        while at:
            token = ended[at - 1]
            tokens.append(token)
            at -= width[token]
        return tokens[::-1]


class AutomatonTokenizer(WordTokenizer):
    """Ids of texts by a ``tokenizers`` BPE file, of which only normalisation and pre-splitting are the library's.

    Added tokens are cut out of a text first, as the library does. Files whose
    model does more than merges (unknown tokens, dropout, byte fallback, a prefix
    of continuing parts, merges ignored for whole words) are refused.
    """

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or spec.get("post_processor"):
            raise ValueError("a BPE model with merges alone is asked for")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must be taken as they are")
        self.end = model.get("end_of_word_suffix") or ""
        vocabulary = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        made = {c for _, _, c in merges}
        symbol = {ch: i for i, ch in enumerate(dict.fromkeys(ch for t in vocabulary for ch in (t.removesuffix(self.end) if self.end else t)))}
        self.symbol, self.last = symbol, len(symbol)

        def spelled(token: str) -> tuple[int, ...]:
            ends = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
            letters = [symbol[ch] for ch in (token.removesuffix(self.end) if ends else token)]
            return (*letters[:-1], letters[-1] + self.last) if ends else tuple(letters)

        self.labels = {i: t for t, i in vocabulary.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        by_id = {i: spelled(t) for t, i in vocabulary.items()}
        base = [i for i, s in by_id.items() if len(s) == 1]
        self.words = WordAutomaton(MergeAutomaton(base, merges), {i: s for i, s in by_id.items() if i in made or len(s) == 1})
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        decoder = (spec["decoder"] or {}).get("type")
        if decoder not in (None, "ByteLevel"):
            raise ValueError("a decoder of another kind")
        self.joins_bytes, self.held, self.held_parts = decoder == "ByteLevel", 0, 0
        if self.joins_bytes:
            byte_of = {chr(c): b for b, c in self.alphabet.items()}
            spell = lambda label: bytes(map(byte_of.__getitem__, label)) if all(ch in byte_of for ch in label) else label.encode()
        else:
            spell = str.encode
        self.emitted = [spell(self.labels[i]) if i in self.labels else None for i in range(max(self.labels, default=-1) + 1)]

    def _word(self, piece: str) -> list[int]:
        """A pre-split piece in the vocabulary's letters; letters that it lacks are left out, as the library does."""
        known = [self.symbol[ch] for ch in piece if ch in self.symbol]
        if self.end and known and piece[-1] in self.symbol:
            known[-1] += self.last
        return self.words.encode(known)

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self.old_parts.get(part)
            if found is None:
                found = array("I", self._word(part.encode().decode("latin-1").translate(self.alphabet))).tobytes()
            self.held_parts += ENTRY + len(part) + len(found)
            if self.held_parts > MEMO_BYTES:
                self.old_parts, self.parts, self.held_parts = self.parts, {}, 0
            self.parts[part] = found
        return found

    def _pieces(self, text: str) -> Iterator[str]:
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        if self.tokenizer.pre_tokenizer is None:
            yield normal
        else:
            yield from (piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))

    def _library(self, text: str) -> bytes:
        """Ids of a text: added tokens, and the pieces between them."""
        ids: list[int] = []
        at = 0
        while at < len(text):
            hit = self.has_special(text, at) if self.special else None
            part = text[at : hit.start() if hit else len(text)]
            for piece in self._pieces(part) if part else ():
                ids += self._word(piece)
            at = hit.end() if hit else len(text)
            if hit:
                ids.append(self.special[hit.group()])
        return array("I", ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.old_words.get(word)
        if found is None:
            found = self._library(word) if word else b""
        self.held += ENTRY + len(word) + len(found)
        if self.held > MEMO_BYTES:
            self.old_words, self.held = dict(self), 0
            self.clear()
        self[word] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """The labels of tokens, joined as the file's decoder does; unknown ids are left out."""
        emitted = self.emitted
        labels = [emitted[i] for i in ids if 0 <= i < len(emitted) and emitted[i] is not None]
        return b"".join(labels).decode("utf-8", "replace") if self.joins_bytes else b" ".join(labels).decode()


def tokenizer(path: str) -> AutomatonTokenizer:
    """The compiled automaton of a file, kept between this operator's tasks."""
    return kept(AutomatonTokenizer, path)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids`` of every row; null and empty texts have none.

    Repeated rows are encoded each; an empty table gives no rows. Other columns
    are not looked at; ``keep`` with a column ``ids`` is an error.
    """
    if "ids" in keep:
        raise ValueError("keep has a column ids")
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*(rows.schema[k] for k in keep), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for batch in batches:
            done = 0
            for group in in_groups(binaries(batch.column(len(keep)))):
                found = [np.frombuffer(model.ids((t or b"").decode()), np.int32) for t in group]
                columns = [*batch.slice(done, len(group)).columns[: len(keep)], _lists(found)]
                done += len(group)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, wanted, strict=True)], schema=wanted)

    return rows.mapInArrow(frugal(run), schema)


def _each(encoded: DataFrame, path: str, keep: tuple[str, ...], more: list[T.StructField], of) -> DataFrame:
    """``keep`` and what ``of(model, ids)`` gives for each row's ``ids``."""
    rows = encoded.select(*keep, "ids")
    schema = T.StructType([*(rows.schema[k] for k in keep), *more])
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = [of(model, ids or []) for ids in _int_lists(part.column(len(keep)))]
                columns = [*part.columns[: len(keep)], *(pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), list(wanted)[len(keep) :], strict=True))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, wanted, strict=True)], schema=wanted)

    return rows.mapInArrow(frugal(run), schema)


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``text``, decoded from ``ids`` (null and empty ids: empty)."""
    return _each(encoded, path, keep, [T.StructField("text", T.StringType())], lambda model, ids: (model.decode(ids),))


def digests(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_tokens``, and hashes of the ids (unsigned 32-bit, little-endian) and of the decoded text."""

    def of(model: AutomatonTokenizer, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _each(encoded, path, keep, fields, of)
