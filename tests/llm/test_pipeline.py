"""The pipeline: each stage against the operator or a brute-force version on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from keelson.llm import jaccard_join, line_dedup, packing, quality_classifier, quality_rules
from keelson.llm.common import table


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").withColumns({"kept": F.lit("clash"), "score": F.lit(1), "row": F.lit("r"), "n_lines": F.lit(2)})
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_each_stage_does_its_operators_work(spark, stages):
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    assert ids(stages[1]) == ids(quality_classifier.classify_quality(stages[0], labels).where("predicted = 1"))
    assert ids(stages[2]) == ids(quality_rules.quality_rules(stages[1]).where("kept"))
    cut = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(stages[2].drop("n_lines")).collect()}
    assert {r["doc_id"]: r["text"] for r in stages[3].collect()} == cut
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())
    assert ids(stages[4]) == ids(jaccard_join.jaccard_components(stages[3]).where("doc_id = component_id"))
    assert 0 < len(ids(stages[4])) < len(ids(stages[0]))
    assert set(ids(stages[5])) == set(ids(stages[4]))
    places = {}
    for r in stages[5].collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= packing.LENGTH for p in places.values())


def test_no_documents_and_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "x y z", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, sf)
            rows = got.collect()
            assert docs.count() or not rows, name
            if name == "ngram_jaccard_join" and docs.count():
                assert len(rows) == 3  # the repeated row is one document


def test_copies_keep_one_whole_text(spark):
    """Groups of copies that are a third of their source: one whole text of each stays, and boilerplate goes."""
    words = lambda *k: " ".join(f"w{'x'.join(map(str, k))}y{i}" for i in range(12))
    copied = "\n".join(words("copy", k) for k in range(6))
    rows = [(i, "menu of the site\n" + "\n".join(words("own", i, k) for k in range(5)), "exact") for i in range(20)] + [(100 + i, copied, "exact") for i in range(10)]
    near = [words("near", k) for k in range(40)]
    rows += [(200 + i, "\n".join(words("other", i, k) for k in range(5)), "near") for i in range(20)]
    rows += [(300 + i, "\n".join([*near[:i], words("edit", i), *near[i + 1 :]]), "near") for i in range(10)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    cut = corpus_pipeline.line_dedup_stage(spark, docs, "").cache()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert all(texts[100 + i] == copied for i in range(10))
    assert all("menu of the site" not in texts[i] and texts[i] for i in range(20))
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.jaccard_join_stage(spark, cut, "").collect()}
    assert [d for d in kept if 100 <= d < 200] == [100]
    assert any(sum(line in text.split("\n") for line in near) == 39 for text in kept.values())
    assert all(kept.values())


def test_texts_that_share_an_id_are_judged_each(spark):
    text = lambda k: " ".join(f"w{k}y{i}" for i in range(30))
    rows = [(1, text("a")), (1, text("b")), (2, text("b")), (3, text("b") + " end"), (4, text("c")), (4, text("c")), (None, text("a")), (None, text("d")), (None, text("d")), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.jaccard_join_stage(spark, docs, "").collect()), key=str)
    assert kept == sorted([(1, text("a")), (1, text("b")), (4, text("c")), (None, text("d")), (5, "")], key=str)
