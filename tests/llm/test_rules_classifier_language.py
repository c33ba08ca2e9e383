"""Quality rules, quality classifier and language identification."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import language_id, quality_classifier, quality_rules
from keelson.llm.common import table

DOCS = "doc_id long, text string, lang string, source string"


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    times, marked = Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for i in range(len(words) - 2):
        if times[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), dup, len(marked)


def test_statistics_equal_brute_force():
    r = random.Random(1)
    texts = [None, "", " \n ", "a a a a", "x\ny\nx\n \n \nx"] + ["".join(r.choice("ab é#|\n\t\x0b\x1c\x85\u2003") for _ in range(r.randint(0, 80))) for _ in range(2000)]
    for text in texts:
        assert quality_rules.text_statistics(text.encode() if text is not None else None) == brute_statistics(text), repr(text)


def test_chi_square():
    assert quality_rules.chi2_cdf(11.0705, 5) == pytest.approx(0.95, abs=1e-4)
    assert quality_rules.chi2_quantile(0.75, 5) == pytest.approx(6.6257, abs=1e-3)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n)) + "."


def test_outliers_are_rejected_and_the_rest_kept(spark):
    r = random.Random(2)
    rows = [(i, prose(r, r.randint(60, 900)), "en", f"s{i % 3}" if i % 2 else "hot") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(r, 200).split()), "en", "hot") for i in range(10)]
    rows += [(2000, None, "en", "hot"), (2001, "", None, None), (2002, prose(r, 100), None, "rare"), (2003, "same words here " * 40, "en", "hot"), (2004, prose(r, 20_000), "en", "hot"), (1, prose(r, 100), "en", "hot")]
    df = spark.createDataFrame([(*x, "clash", 1.0) for x in rows], DOCS + ", kept string, d2 double").repartition(4)
    got = {(g["doc_id"], g["n_words"]): g for g in quality_rules.quality_rules(df).collect()}
    assert len(got) == len(rows)
    for (doc, _), g in got.items():
        want = doc < 1000 or doc in (2002, 2004)
        assert g["kept"] == want, g
        text = next(t for i, t, *_ in rows if i == doc and brute_statistics(t)[0] == g["n_words"])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_lines"], g["n_dup_lines"], g["n_repeat_words"]) == brute_statistics(text)
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def of_rows(x, factor):
    return quality_rules.estimate(len(x), x.sum(0), quality_rules._products(x), factor)


def test_core_estimate_equals_brute_force():
    """The estimate of a core set is its mean and (with the floors) its covariance."""
    x = np.random.default_rng(0).normal(size=(500, 5)) * 2 + 3
    centre, scatter = of_rows(x, 1.0)
    assert np.allclose(centre, x.mean(0))
    assert np.allclose(scatter, np.cov(x.T, bias=True) + np.diag(0.05 * quality_rules._FLOORS**2))


@pytest.mark.parametrize("seed", range(4))
def test_fast_mcd_finds_the_least_determinant(seed):
    """Of all cores of a small set, the one whose covariance has the least determinant."""
    g = np.random.default_rng(seed)
    x = g.normal(size=(12, 5)) * 3
    x[:4] += 40
    h = quality_rules.core_size(12)
    factor = quality_rules.consistency(h / 12, 5)
    least = min(np.linalg.slogdet(of_rows(x[list(c)], factor)[1])[1] for c in itertools.combinations(range(12), h))
    assert quality_rules.fast_mcd(x)[0][2] == pytest.approx(least, abs=1e-9)


def test_model_over_all_rows_equals_brute_force(spark):
    """A cluster of a third of the rows does not hide itself, and copies of one row do not make the core."""
    g = np.random.default_rng(3)
    x = g.normal(size=(3000, 5)) * quality_rules._FLOORS * 3
    x[:1000] += quality_rules._FLOORS * 40
    rows = [("a", *map(float, v)) for v in x] + [("b", *map(float, v)) for v in x[1000:1100]] + [("c", *map(float, x[0]))]
    vectors = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{n} double" for n in quality_rules._NAMES)).repartition(5)
    model = {r["grp"]: r for r in quality_rules.robust_model(vectors)[0].collect()}
    for grp, of in (("a", x), ("b", x[1000:1100])):
        centre, scatter, _ = quality_rules.fast_mcd(of)[0]
        away = of - centre
        near = of[((away @ np.linalg.inv(scatter)) * away).sum(axis=1) <= quality_rules.chi2_quantile(quality_rules.WEIGHED, 5)]
        centre, scatter = of_rows(near, quality_rules.consistency(quality_rules.WEIGHED, 5))
        inverse = np.linalg.inv(scatter)
        got = np.array([[model[grp][f"p{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)])
        assert np.abs(np.array([model[grp][f"c{i}"] for i in range(5)]) - centre).max() < 0.1 * quality_rules._FLOORS.max()
        far = lambda inv: ((away @ inv) * away).sum(axis=1)
        assert np.allclose(np.log(far(got)), np.log(far(inverse)), atol=0.15)
        assert ((far(got) > quality_rules.CUTOFF) == (of[:, 0] > quality_rules._FLOORS[0] * 20)).all()
    assert model["c"]["m"] == 1


def auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    return (rank[labels == 1].mean() - rank[labels == 0].mean()) / len(scores) + 0.5


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality_classifier.classify_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0 for g in got)
    y, s = np.array([g["quality"] for g in got]), np.array([g["score"] for g in got])
    assert auc(s, y) > 0.95
    assert ((s >= 0.3) == (y == 1)).mean() > 0.93
    assert ((s < 0.3) & (y == 1)).sum() <= 1


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b c", "x"), (3, "a b c", "x"), (4, "w" * 50_000 + " x" * 30_000, "x"), (None, "no id", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (1, 0)], "doc_id long, quality int")
    got = quality_classifier.classify_quality(docs, labels).collect()
    assert len(got) == 6 and all(0 <= g["score"] <= 1 for g in got)
    assert len({g["score"] for g in got if g["doc_id"] in (1, 2)}) == 1
    assert {g["score"] for g in quality_classifier.classify_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify_quality(docs.limit(0), labels).count() == 0


def test_scores_equal_brute_force(spark):
    """The score is the softmax of the average of a document's vectors, feature by feature."""
    g = np.random.default_rng(5)
    shape = (quality_classifier.BUCKETS, quality_classifier.DIMENSIONS)
    model = quality_classifier.SubwordClassifier(g.normal(size=shape).astype(np.float32), g.normal(size=(2, shape[1])).astype(np.float32), np.array([0.3, -0.2], np.float32))
    r = random.Random(4)
    texts = [prose(r, n) for n in (1, 5, 80)] + ["twice twice twice once", "a b\tc\nd", "", None]
    got = {s["doc_id"]: s["score"] for s in quality_classifier.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        words = [w.encode() for w in (text or "").split()]
        buckets = [b for w in words for b in quality_classifier.word_features([w])[1]]
        buckets += [quality_classifier.word_features([quality_classifier.REPEAT])[1][-1] for a, b in zip(words, words[1:], strict=False) if a == b]
        hidden = np.mean([model.embeddings[b].astype(float) for b in buckets], axis=0) if buckets else np.zeros(shape[1])
        logits = model.output @ hidden + model.bias
        assert got[i] == pytest.approx(np.exp(logits[1]) / np.exp(logits).sum(), abs=1e-6)


def test_word_features_do_not_depend_on_company():
    words = [b"abc", b"de", "é".encode(), b"x" * 30, b"\xff"]
    owner, bucket = quality_classifier.word_features(words)
    for i, w in enumerate(words):
        _, alone = quality_classifier.word_features([w])
        assert sorted(alone) == sorted(bucket[owner == i])


def test_language_models_are_distributions():
    owner, gram = language_id.windows([b"the", b"then", b"other", "d\u00e9j\u00e0".encode(), b"a1b"])
    distinct, times = np.unique(gram, return_counts=True)
    model = language_id.KneserNey(distinct, times)
    units = np.unique(distinct & np.uint64(0xFFFF))
    for one in distinct[:10]:
        context = one >> np.uint64(16)
        total = np.exp(model.log_probabilities((context << np.uint64(16)) | units)).sum() + np.exp(model.log_probabilities(np.array([(context << np.uint64(16)) | np.uint64(0xFFFE)])))[0]
        assert total == pytest.approx(1, abs=1e-5)
    assert sorted(set(owner.tolist())) == [0, 1, 2, 3, 4]


def brute_kneser_ney(words, order=4):
    """Interpolated Kneser-Ney by dictionaries: the probability of a window's last unit after the others."""
    counts = [Counter() for _ in range(order + 1)]
    for word, times in words.items():
        units = "\1" * (order - 1) + word + "\2"
        for i in range(order - 1, len(units)):
            counts[order][units[i - order + 1 : i + 1]] += times
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n in range(1, order + 1):
        once, twice = (sum(t == k for t in counts[n].values()) for k in (1, 2))
        discount[n] = once / (once + 2 * twice) if once and twice else 0.5

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        after = {g: t for g, t in counts[n].items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return p(gram[1:])
        return max(after.get(gram, 0) - discount[n], 0) / total + discount[n] * len(after) / total * p(gram[1:])

    return p


def test_models_equal_brute_force():
    r = random.Random(8)
    words = Counter("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(400))
    owner, gram = language_id.windows([w.encode() for w in words])
    distinct, at = np.unique(gram, return_inverse=True)
    model = language_id.KneserNey(distinct, np.bincount(at, np.array(list(words.values()))[owner]))
    p = brute_kneser_ney(words)
    for text in ("abc", "zebra", "éa", "bad", "xyz", "a"):
        _, asked = language_id.windows([text.encode()])
        units = "\1\1\1" + text + "\2"
        assert np.allclose(model.log_probabilities(asked), [np.log(p(units[i - 3 : i + 1])) for i in range(3, len(units))], atol=1e-5)


def test_letters():
    assert language_id.letter_runs("ab½c²①_9d") == ["ab", "c", "d"]
    assert language_id.letter_runs("½²①") == []


def test_language_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identify_languages(docs).join(docs, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2 for g in got)
    assert np.mean([g["lang"] == g["lang_pred"] for g in got]) > 0.98
    assert np.mean([g["rejected"] for g in got]) < 0.05


def test_rejection_is_calibrated_on_all_training_rows(spark):
    """Of 9,000 texts in random words, about 6,750 are learned from: each of them counts for the means and the limit."""
    r = random.Random(5)
    words = {lang: ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(400)] for lang, letters in (("aa", "abcdefgh"), ("zz", "fghijklmno"))}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(2, 30))), lang, "x") for i in range(9000) for lang in (r.choice(["aa", "zz"]),)]
    got = {g["doc_id"]: g for g in language_id.identify_languages(spark.createDataFrame(rows, DOCS)).collect()}
    length = {i: sum(len(w) + 1 for w in text.split()) for i, text, *_ in rows}
    right = [i for i, _, lang, _ in rows if got[i]["lang_pred"] == lang and zlib.crc32(str(i).encode()) % 4 != 2]
    mean = {lang: np.mean([got[i]["entropy"] for i in right if got[i]["lang_pred"] == lang]) for lang in words}
    away = {i: (g["entropy"] - mean[g["lang_pred"]]) * length[i] ** 0.5 for i, g in got.items()}
    limit = np.quantile([away[i] for i in right], 0.999)
    assert len(right) > 6500 and {i for i, g in got.items() if g["rejected"]} == {i for i in got if away[i] > limit + 1e-9} and any(a > limit for a in away.values())


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(["the cat and the dog", "this is that and the other"] * 8)] + [(100, None, "en", "x"), (101, "", "en", "x"), (102, "123 !?", None, "x"), (103, "the", None, "x"), (None, "the", "en", "x"), (104, "q" * 60_000, "en", "x")], "doc_id long, text string, lang string, score string")
    got = {g["doc_id"]: g for g in language_id.identify_languages(docs).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[103]["lang_pred"] == "en"
    assert all(0 <= g["score"] <= 1 for g in got.values())
    assert {g["lang_pred"] for g in language_id.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify_languages(docs.limit(0)).count() == 0
