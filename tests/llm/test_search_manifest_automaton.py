"""Lexical search, the Merkle manifest and the BPE automaton against brute force and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from keelson.llm import bpe_automaton, lexical_search, merkle_manifest  # noqa: E402
from keelson.llm.queries import WORD_VOCABULARY, vocabulary  # noqa: E402
from tests.llm.test_packing_tokens import TEXTS, random_texts  # noqa: E402

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Lexical search


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def ranked_by_force(docs, items, k):
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_all = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for (doc, c), n in zip(counts, sizes, strict=True):
            m = 50 + (50 * n * n_docs) // n_all if n_all else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0))
        out += [(item, rank, doc if known else None, -s) for rank, (s, known, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def search(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, term int, shard string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, block int")
    return sorted(map(tuple, lexical_search.search(d, q, **more).collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "shard_docs": 40, "shard_words": 900, "k": 5}])
def test_search_equals_brute_force(spark, sizes):
    r = random.Random(5)
    common = ["the", "Of", "and", "ñandú", "x9"]
    rare = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(r.choice(common) if r.random() < 0.7 else r.choice(rare) for _ in range(r.randint(0, 60)))) for i in range(400)]
    docs += [(500 + i, "the same Text w1 w2, w1") for i in range(70)] + [(None, "w3 the w3"), (3, "w3 again"), (900, None), (901, ""), (902, "... !"), (903, "the " * 5000 + "w7")]
    items = [(1, "The, w1 w2 w3!"), (2, "and of the ÑANDÚ"), (2, "w5 w5"), (3, ""), (4, None), (None, "w7 the"), (6, "unheard"), (7, " ".join(rare[:80])), (8, "w9\x00w10_w11")]
    assert search(spark, docs, items, **sizes) == ranked_by_force(docs, items, sizes.get("k", 50))


def test_search_of_nothing(spark):
    assert search(spark, [], [(1, "a")]) == []
    assert search(spark, [(1, "a")], []) == []
    assert search(spark, [(1, None), (2, " ")], [(1, "a")]) == []


def test_all_terms_are_indexed_without_a_list(spark):
    docs = spark.createDataFrame([(1, "a b A"), (2, "b"), (None, None)], "doc_id long, text string").coalesce(1)
    rows = lexical_search.index(docs).collect()
    assert {(r.term, r.n_docs, r.n_terms) for r in rows} == {(None, 2, 4), ("a", 1, 2), ("b", 2, 2)}


def test_windows_are_skipped_and_nothing_is_lost():
    r = np.random.default_rng(3)
    n, k = 20_000, 10
    lists = {"long": np.sort(r.choice(n, 9000, replace=False)), "longer": np.arange(n), "short": np.sort(r.choice(3000, 100, replace=False)), "other": np.sort(r.choice(n, 30, replace=False))}
    scores = {"long": r.integers(1, 50, 9000), "longer": r.integers(1, 5, n), "short": r.integers(500, 900, 100), "other": r.integers(50, 90, 30)}
    shard = lexical_search.ShardSearch(r.permutation(n), np.zeros(n, np.uint8), window=256)
    sums = np.zeros(n, np.int64)
    for t in lists:
        shard.add(t, lists[t], scores[t])
        np.add.at(sums, lists[t], scores[t])
    assert set(shard.long) == {"long", "longer"} and set(shard.short) == {"short", "other"}
    docs, got = shard.best(list(lists), k)
    want = np.lexsort((shard.place, -sums))[:k]
    assert docs.tolist() == want.tolist() and got.tolist() == sums[want].tolist()
    assert shard.skipped > shard.read > 0


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[k] for k in merkle_manifest.FIELDS)))


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, at):
    for level in levels[:-1]:
        first = at - at % 8
        yield level[first:at], level[at + 1 : first + 8]
        at //= 8


def manifest_by_force(rows):
    order = lambda v: (v is not None, v if v is not None else 0)
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for rs in trees.values():
        rs.sort(key=lambda x: (order(x["doc_id"]), row_digest(x)))
    grown = {name: grow([row_digest(x) for x in trees[name]]) for name in names}
    top = grow([grown[name][-1][0] for name in names])
    out = []
    for i, name in enumerate(names):
        for at, row in enumerate(trees[name]):
            path = [*climb(grown[name], at), *climb(top, i)]
            changed = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"] is not None:
                changed["text"] = row["text"].translate(LOW)
            back = row_digest(changed)
            for left, right in path:
                back = sha(*left, back, *right)
            root = top[-1][0]
            out.append((row["doc_id"], row_digest(row), grown[name][-1][0], root, sha(*(d for pair in path for side in pair for d in side)), back, back == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 9}, {"en": 150, "de": 1, "": 64, None: 65, "zz": 2, "é": 7, "fr": 8, "es": 9, "it": 3, "pt": 10}])
def test_manifest_equals_brute_force(spark, sizes):
    r = random.Random(4)
    rows = []
    for lang, n in sizes.items():
        rows += [{"doc_id": r.randint(0, 10**6), "text": r.choice(["Ab ñ", "x", "", "ÀB Q" * 300]) + str(r.random()), "lang": lang, "source": r.choice(["s", None]), "n_chars": r.choice([5, None])} for _ in range(n)]
    rows[0]["text"] = None
    rows[-1]["doc_id"] = None
    rows += rows[:3] + [{**rows[0], "text": "Other text of the same id"}]
    df = spark.createDataFrame([(*(x[k] for k in merkle_manifest.FIELDS), 1, "n") for x in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string").repartition(5)
    got = merkle_manifest.verify_documents(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == manifest_by_force(rows)


def test_manifest_of_nothing(spark):
    assert merkle_manifest.verify_documents(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).collect() == []


def test_a_trees_rows_are_in_many_partitions(spark):
    df = spark.range(5000).selectExpr("'same' as lang", "id as doc_id", "sha2(cast(id as string), 256) as leaf").repartition(6)
    placed = merkle_manifest._placed(df.selectExpr("lang as tree", "doc_id as p0", "leaf as digest"), "p0")
    assert [r.pos for r in placed.orderBy("p0").select("pos").collect()] == list(range(5000))


# BPE automaton


def gadgets_by_force(base, merges):
    """States as dicts of arcs, each merge put in as it is written."""
    states, entry = [dict.fromkeys(base, 0)], dict.fromkeys(base, 0)
    for a, b, c in merges:
        old = entry[a]
        after = states[old][b]
        states.append({t: s for t, s in states[old].items() if t != b})
        for arcs in states:
            if a in arcs and arcs is not states[-1] or a in arcs and a != b:
                arcs[c] = after
        new = len(states) - 1
        for arcs in states:
            if a in arcs:
                arcs[a] = new
        entry[a], entry[c] = new, after
    return states, entry


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_the_gadgets_and_bpe(seed):
    r = random.Random(seed)
    spelled, merges = {i: (i,) for i in range(3)}, []
    while len(merges) < 25:
        a, b = r.choice(list(spelled)), r.choice(list(spelled))
        word = spelled[a] + spelled[b]
        if word in spelled.values() or bpe(spelled[a] + spelled[b], merges) != [a, b]:
            continue
        c = len(spelled)
        spelled[c] = word
        merges.append((a, b, c))
    automaton = bpe_automaton.MergeAutomaton([0, 1, 2], merges)
    states, entry = gadgets_by_force([0, 1, 2], merges)
    for t in spelled:
        assert {x for x in spelled if automaton.follows(automaton.target[t], x)} == set(states[entry[t]])
    words = bpe_automaton.WordAutomaton(automaton, spelled, most_states=50)
    for _ in range(400):
        word = tuple(r.randint(0, 2) for _ in range(r.randint(0, 30)))
        assert words.encode(list(word)) == bpe(word, merges)


def bpe(symbols, merges):
    tokens = list(symbols)
    for a, b, c in merges:
        i = 0
        while i + 1 < len(tokens):
            if tokens[i] == a and tokens[i + 1] == b:
                tokens[i : i + 2] = [c]
            i += 1
    return tokens


def test_improper_merges_are_refused():
    for merges in ([(0, 3, 4)], [(0, 1, 2), (0, 1, 3)]):
        with pytest.raises(ValueError):
            bpe_automaton.MergeAutomaton([0, 1], merges)


@pytest.mark.parametrize("name", [WORD_VOCABULARY, "byte_bpe_50k.json"])
def test_ids_and_decoded_texts_equal_the_library(name):
    ours = bpe_automaton.AutomatonTokenizer(vocabulary(name))
    for text in [t for t in TEXTS if t is not None] + random_texts(2000) + ["zq" * 3000, "<|endoftext|><|startoftext|>a<|endoftext|"]:
        ids = ours.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == ids, text
        assert ours.decode(ids) == ours.tokenizer.decode(ids, skip_special_tokens=False), text


def test_memos_are_bounded_and_change_nothing(monkeypatch):
    texts = random_texts(300)
    want = [bpe_automaton.tokenizer(vocabulary(WORD_VOCABULARY)).ids(t) for t in texts]
    monkeypatch.setattr(bpe_automaton, "MEMO_BYTES", 3000)
    small = bpe_automaton.AutomatonTokenizer(vocabulary(WORD_VOCABULARY))
    assert [small.ids(t) for t in texts] == want and small.held <= 3000


def test_codec_over_rows(spark):
    texts = [*TEXTS, "ab " * 200_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, "again", None), (None, "no id", "y")], "doc_id long, text string, ids string").repartition(3)
    model = vocabulary(WORD_VOCABULARY)
    encoded = bpe_automaton.encode(df, model)
    library = bpe_automaton.tokenizer(model).tokenizer
    want = []
    for i, t in [*enumerate(texts), (0, "again"), (None, "no id")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe_automaton.digests(encoded, model).collect()), key=str) == sorted(want, key=str)
    assert {r.doc_id: r.text for r in bpe_automaton.decode(encoded, model).where("doc_id = 3").collect()} == {3: "a</w>"}
    assert bpe_automaton.digests(bpe_automaton.encode(df.limit(0), model), model).count() == 0
    with pytest.raises(ValueError):
        bpe_automaton.encode(df, model, keep=("ids",))
