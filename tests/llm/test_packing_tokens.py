"""Packing, the word tokenizer and the SentencePiece codec against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from keelson.llm import bpe_automaton, packing, sentencepiece_codec  # noqa: E402
from keelson.llm.common import frugal  # noqa: E402
from keelson.llm.queries import PIECE_VOCABULARY, WORD_VOCABULARY, vocabulary  # noqa: E402

TEXTS = [None, "", " ", "a", "Hello  World\n\nx ", "Ünïcödé ﬁ ①Ａ㍿\t中文 😀 ▁ \x0b\x85 x", "don't I'LL <|endoftext|> 12½", "the " * 5000, "ΑΣ İıẞ", "trailing\n"]
ALPHABET = "aAbZ zé É'sSt 09²¼½ªºµ!?<|>\n\t\r\x0b\x85\xa0\u3000\u0301ΑΣ İıſßẞ中文😀_-endoftext|'ré'LL▁"


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_word_tokenizer_equals_library():
    words = packing.WordTokenizer(vocabulary(WORD_VOCABULARY))
    assert words.by_words
    for text in [t for t in TEXTS if t is not None] + random_texts(3000):
        assert np.frombuffer(words.ids(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_other_vocabularies_are_encoded_whole():
    whole = packing.WordTokenizer(vocabulary("byte_bpe_50k.json"))
    assert not whole.by_words
    for text in ("a  b\n c", "don't"):
        assert np.frombuffer(whole.ids(text), "<u4").tolist() == whole.tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_never_overfills_and_is_near_the_bound():
    r = random.Random(2)
    for sizes in ([], [2048], [1025] * 10, [r.randint(1, 2047) for _ in range(5000)], [1] * 4097):
        bins = packing.best_fit(sizes)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 2048 for b in bins)
        if len(sizes) == 5000:
            assert len(bins) <= 1.01 * sum(sizes) / 2048 + 1
    assert len(packing.best_fit([1024] * 8)) == 4


@pytest.mark.parametrize("group", [100_000, 7])
def test_pack(spark, group):
    r = random.Random(3)
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "word " * r.randint(0, 3000)) for i in range(60)] + [(100, "repeated row"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, piece int, offset string").repartition(5)
    got = packing.pack(df, vocabulary(WORD_VOCABULARY), group=group, block=20).collect()
    words = packing.WordTokenizer(vocabulary(WORD_VOCABULARY))
    want = sorted(str((i, *p)) for i, t in docs for p in packing.cut(words.ids(t or "") + b"\0\0\0\0"))
    assert sorted(str((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"])) for g in got) == want
    sequences = {}
    for g in got:
        sequences.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    total = sum(g["length"] for g in got)
    assert len(sequences) <= -(-total // packing.LENGTH) + 8
    assert packing.pack(df.limit(0), vocabulary(WORD_VOCABULARY)).count() == 0


def test_pieces_and_checksums():
    ids = np.arange(5000, dtype="<u4").tobytes()
    assert packing.cut(ids) == [(k, 2048 * k, n, zlib.crc32(ids[8192 * k : 8192 * (k + 1)])) for k, n in enumerate([2048, 2048, 904])]


def spans_of_library(codec, text):
    return [(p.begin, p.end) for p in codec.processor.encode(text, return_type="proto").pieces]


def check_codec(codec, texts):
    for text in texts:
        ids, begins, ends = codec.encode(text.encode())
        assert ids.tolist() == codec.processor.encode(text), text
        spans = list(zip(begins.tolist(), ends.tolist(), strict=True))
        if not any(codec.processor.is_byte(i) for i in ids.tolist()):
            assert spans == spans_of_library(codec, text), text
        assert all(a <= b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_codec_equals_library():
    codec = sentencepiece_codec.Codec(vocabulary(PIECE_VOCABULARY))
    assert codec.simple
    check_codec(codec, [t for t in TEXTS if t is not None] + random_texts(2000, 4))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("trim", [True, False])
def test_codec_with_a_character_map(tmp_path, rule, trim):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(vocabulary(PIECE_VOCABULARY), "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    rules = sentencepiece_model_pb2.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = trim
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    codec = sentencepiece_codec.Codec(str(tmp_path / "m.model"))
    check_codec(codec, [t for t in TEXTS if t is not None] + random_texts(1000, 5))


def test_encode_decode_on_spark(spark):
    model = vocabulary(PIECE_VOCABULARY)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").repartition(3)
    encoded = sentencepiece_codec.encode(df, model)
    rows = {r["doc_id"]: r for r in sentencepiece_codec.digests(encoded, model).collect()}
    texts = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(encoded, model).collect()}
    sp = sentencepiece_codec.Codec(model).processor
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "")
        text = sp.decode(ids) if ids else ""
        assert texts[i] == text
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    for r in encoded.collect():
        source = (TEXTS[r["doc_id"]] or "").encode()
        assert not source or (r["begins"][0] == 0 and r["ends"][-1] == len(source))
    assert sentencepiece_codec.encode(df.limit(0), model).count() == 0


def test_workers_let_go_of_what_another_operator_kept(spark):
    """A worker that packed keeps its vocabulary and words for more packing, not for other operators' tasks."""

    def held(batches):
        import gc
        import os

        import pyarrow as pa

        for batch in batches:
            found = sum(type(o).__name__ in ("WordTokenizer", "AutomatonTokenizer", "Codec") for o in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * batch.num_rows), pa.array([found] * batch.num_rows)], names=["pid", "held"])

    rows = spark.range(64).repartition(16)
    df = spark.createDataFrame([(i, f"word{i} and more") for i in range(64)], "doc_id long, text string").repartition(16)
    packing.pack(df, vocabulary(WORD_VOCABULARY)).collect()
    bpe_automaton.encode(df, vocabulary(WORD_VOCABULARY)).collect()
    sentencepiece_codec.encode(df, vocabulary(PIECE_VOCABULARY)).collect()
    packing.pack(df, vocabulary(WORD_VOCABULARY)).collect()
    kept = {r["pid"]: r["held"] for r in rows.mapInArrow(held, "pid long, held long").collect()}
    assert max(kept.values()) <= 1  # the last operator's alone
    assert {r["held"] for r in rows.mapInArrow(frugal(held), "pid long, held long").collect()} == {0}


def test_word_memo_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_BYTES", 20_000)
    words = packing.WordTokenizer(vocabulary(WORD_VOCABULARY))
    r = random.Random(5)
    for _ in range(50):
        text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.choice([3, 9, 3000]))) for _ in range(40))
        assert np.frombuffer(words.ids(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
        for memo in (words, words.old_words, words.parts, words.old_parts):
            assert sum(len(k) + len(v) for k, v in memo.items()) < 20_000 + 20_000  # one entry over


def test_words_in_many_guises_are_encoded_once():
    """Case and marks beside a word make no entry of their own; odd words alone go to the library whole."""
    words = packing.WordTokenizer(vocabulary(WORD_VOCABULARY))
    r = random.Random(6)
    stems = ["".join(r.choice("abcdéü") for _ in range(9)) for _ in range(50)]
    guises = [g + end for s in stems for g in (s, s.upper(), s.title()) for end in ("", ",", ".", "!!", ")")]
    odd = ["中文", "x\x0bÉ", "a<|endoftext|>B", "<|startoftext|>", "e\u0301t\u00e9", "ΑΣ,", "\u3000", "İ"]
    asked = []

    class Counting:
        def tokenize(self, part, model=words.model):
            asked.append(part)
            return model.tokenize(part)

    words.model = Counting()
    for n in range(60):
        text = "".join(r.choice(guises + odd * (n % 3) * 20) + r.choice([" ", "  ", "\n", "\t"]) for _ in range(r.randint(1, 200)))
        for text in (text, text.strip(), "\n" + text):
            assert np.frombuffer(words.ids(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert len(asked) == len(set(asked)) <= 50 + 4
    assert set(words) == set(odd)
