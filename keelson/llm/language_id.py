"""Language identification: interpolated Kneser-Ney character models per language.

Counting covers every training document: tasks count the words of each language
and turn them to counts of four-character windows of words (with their ends),
which are summed over the corpus. A language's model is assembled from all of
them by one task: highest order from counts, lower orders from the number of
distinct left neighbours, each interpolated with the next by one absolute
discount an order. Per language it is two sorted arrays of 64-bit hashes (grams
with log probabilities, contexts with log back-off weights). Distinct windows
grow with alphabets, hardly with the corpus; no window is dropped, and a corpus
with more than ``MODEL_WINDOWS`` of them, which could not be broadcast, raises
``ValueError``.

A text's language is the one whose model gives its letters the lowest cross
entropy per character. Rejection is calibrated on all training documents whose
language is found: a text is ``rejected`` if its entropy lies further above its
language's mean, for its length, than all but one in a thousand of them. Texts
are scored once; what is written of each is a few numbers, of which the means
and the exact quantile are taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quantiles import quantiles
from .common import WordMemo, arrow_schema, binaries, bucket_of, frugal, in_groups, scratch, small_batches

ORDER = 4
#: Distinct windows of all languages that models may have: about 40 bytes each are broadcast.
MODEL_WINDOWS = 1 << 23
#: Distinct words that a task counts before it emits their windows.
MAX_WORDS = 300_000
#: The share of the training documents that rejection would reject.
REJECTED_SHARE = 0.001
FOLDS, HELD_OUT = 4, 2
_START, _END, _OTHER = 1, 2, 3
_UNIT = np.uint64(16)


def letter_runs(word: str) -> list[str]:
    """Runs of letters, which are the characters of Unicode's category L."""
    if word.isalpha():
        return [word]
    return "".join(c if c.isalpha() else " " for c in word).split()


def _scrambled(x: np.ndarray, order: int) -> np.ndarray:
    x = (x + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, window): for each letter and each end, the four units that end there, 16 bits each."""
    pad = chr(_START) * (ORDER - 1)
    cased = [w.decode("utf-8", "replace").lower() for w in words]
    runs = [(i, run) for i, w in enumerate(cased) for run in letter_runs(w)]
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    joined = "".join(pad + run + chr(_END) for _, run in runs)
    units = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    units = np.where(units > 0xFFFF, np.uint64(_OTHER), units)
    gram = np.zeros(len(units) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        gram = (gram << _UNIT) | units[k : len(units) - ORDER + 1 + k]
    ends = units[ORDER - 1 :] != _START  # windows that end at a letter or an end lie within one run
    owner = np.repeat(np.array([i for i, _ in runs]), np.array([len(run) + ORDER for _, run in runs]))[ORDER - 1 :]
    return owner[ends], gram[ends]


_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("times", T.LongType())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wanted = arrow_schema(_COUNTS)
    words: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counter in words.items():
            owner, gram = windows(list(counter))
            if not len(gram):
                continue
            times = np.fromiter(counter.values(), np.int64, len(counter))[owner]
            distinct, at = np.unique(gram, return_inverse=True)
            summed = np.bincount(at, times).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct)), pa.array(distinct.astype(np.int64)), pa.array(summed)], schema=wanted)
        words.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), strict=True):
            words.setdefault(lang, Counter()).update(text.split())
        if sum(map(len, words.values())) > MAX_WORDS:
            yield from flush()
    yield from flush()


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class KneserNey:
    """One language's model."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        levels: list[tuple[np.ndarray, np.ndarray]] = [(grams, counts.astype(float))]
        for order in range(ORDER - 1, 0, -1):
            shorter = levels[-1][0] & np.uint64((1 << (16 * order)) - 1)
            distinct, times = np.unique(shorter, return_counts=True)
            levels.append((distinct, times.astype(float)))
        levels.reverse()
        keys, values, contexts, weights = [], [], [], []
        vocabulary = len(levels[0][0]) + 1
        below_keys, below = np.zeros(0, np.uint64), np.zeros(0)
        for order, (gram, times) in enumerate(levels, 1):
            once, twice = (times == 1).sum(), (times == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context = gram >> _UNIT
            distinct, at = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(at, times), np.bincount(at)
            weight = discount * kinds / total
            if order == 1:
                lower = np.full(len(gram), 1 / vocabulary)
                self.unknown = float(np.log(weight[0] / vocabulary))
            else:
                lower = below[np.searchsorted(below_keys, gram & np.uint64((1 << (16 * (order - 1))) - 1))]
            p = np.maximum(times - discount, 0) / total[at] + weight[at] * lower
            keys.append(_scrambled(gram, order))
            values.append(np.log(p))
            if order > 1:
                contexts.append(_scrambled(distinct, order))
                weights.append(np.log(weight))
            below_keys, below = gram, p
        self.keys, self.values = self._sorted(keys, values)
        self.contexts, self.weights = self._sorted(contexts, weights)

    @staticmethod
    def _sorted(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        return key[order], value[order].astype(np.float32)

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Of each window's last unit after the others."""
        found = np.zeros(len(grams))
        left = np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            gram = grams[left] & np.uint64((1 << (16 * order)) - 1) if order < 4 else grams[left]
            at, hit = _lookup(self.keys, _scrambled(gram, order))
            found[left[hit]] += self.values[at[hit]]
            left, gram = left[~hit], gram[~hit]
            if not len(left):
                break
            if order > 1:
                at, known = _lookup(self.contexts, _scrambled(gram >> _UNIT, order))
                found[left[known]] += self.weights[at[known]]
            else:
                found[left] += self.unknown
        return found


_ARRAYS = ("keys", "values", "contexts", "weights")
_MODEL = T.StructType([T.StructField("lang", T.StringType()), *(T.StructField(a, T.BinaryType()) for a in _ARRAYS), T.StructField("unknown", T.DoubleType())])


def _assemble(windows: pa.Table) -> pa.Table:
    """One language's model from its windows."""
    gram, times = windows["gram"].to_numpy().view(np.uint64), windows["times"].to_numpy()
    order = np.argsort(gram)
    model = KneserNey(gram[order], times[order])
    return pa.table([[windows["lang"][0].as_py()], *([getattr(model, a).tobytes()] for a in _ARRAYS), [model.unknown]], schema=arrow_schema(_MODEL))


def _restored(row: dict) -> KneserNey:
    model = object.__new__(KneserNey)
    for name, kind in zip(_ARRAYS, ("u8", "f4", "u8", "f4"), strict=True):
        setattr(model, name, np.frombuffer(row[name], f"<{kind}"))
    model.unknown = row["unknown"]
    return model


class LanguageModels:
    """Models by language, and what calibrates rejection."""

    def __init__(self, names: list[str], models: list[KneserNey]):
        self.names, self.models = names, models
        self.means, self.limit = np.zeros(len(names)), np.inf


def _learnable(lang: str) -> Column:
    """Whether a row's text and language may be learned from: it has a language and is outside the held-out fold."""
    return F.col(lang).isNotNull() & F.coalesce(bucket_of("doc_id", FOLDS) != HELD_OUT, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModels:
    """Models from every row with a text and a language outside the held-out fold."""
    small_batches(docs.sparkSession)
    rows = docs.where(_learnable(lang)).select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("text is not null")
    counts = scratch(rows.mapInArrow(frugal(_count), _COUNTS).groupBy("lang", "gram").agg(F.sum("times").alias("times")), "grams")
    if (total := counts.count()) > MODEL_WINDOWS:
        raise ValueError(f"{total} distinct windows; models may have {MODEL_WINDOWS}")
    got = sorted(counts.groupBy("lang").applyInArrow(_assemble, _MODEL).toArrow().to_pylist(), key=lambda r: r["lang"])  # of a checked size
    return LanguageModels([r["lang"] for r in got], [_restored(r) for r in got])


def calibrate(learned: LanguageModels, scored: DataFrame) -> None:
    """Set each language's mean entropy and the limit above it, from all rows of ``scored`` whose ``lang`` was found (held-out rows have none)."""
    right = scored.where((F.col("n_units") > 0) & (_of_language(learned.names, "string") == F.col("lang")))
    means = right.groupBy("best").agg(F.avg(F.col("entropy").cast("decimal(18,12)")).cast("double").alias("mean")).collect()  # a row a language
    learned.means = np.full(len(learned.names), np.inf)
    for row in means:
        learned.means[row["best"]] = row["mean"]
    limit = quantiles(right.select(_away(learned).alias("away")), "away", {"limit": 1 - REJECTED_SHARE}).first()["limit"]
    learned.limit = np.inf if limit is None else limit


def _of_language(values: Iterable, kind: str) -> Column:
    """Of a value for each language, that of the best one."""
    each = [F.lit(v) for v in values]
    return F.get(F.array(*each) if each else F.lit(None).cast(f"array<{kind}>"), F.col("best"))


def _away(learned: LanguageModels) -> Column:
    """How far a text's entropy lies above its language's mean, for its length."""
    return (F.col("entropy") - _of_language(map(float, learned.means), "double")) * F.sqrt("n_units")


def _score(docs: DataFrame, learned: LanguageModels, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, ``best`` (a number, null without units), ``entropy``, ``share``, ``n_units`` and ``has_letter``."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    more = [("best", T.IntegerType()), ("entropy", T.DoubleType()), ("share", T.DoubleType()), ("n_units", T.LongType()), ("has_letter", T.BooleanType())]
    schema = T.StructType([*(rows.schema[k] for k in keep), *(T.StructField(n, t) for n, t in more)])
    wanted = arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(learned.models)  # MODEL_WINDOWS windows at most
    n_models = len(learned.models)

    def measured(words: list[bytes]) -> np.ndarray:
        """Of each word, its log probability in every model, and its number of units."""
        owner, gram = windows(words)
        if not len(gram):
            return np.zeros((len(words), n_models + 1))
        return np.stack([*(np.bincount(owner, model.log_probabilities(gram), len(words)) for model in shared.value), np.bincount(owner, minlength=len(words))], axis=1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo(n_models + 1, measured, most_words=300_000)
        for batch in batches:
            out = []
            for group in in_groups(binaries(batch.column(len(keep)))):
                split = [(one or b"").split() for one in group]
                memo.learn(split)
                for one, words in zip(group, split, strict=True):
                    if not words or not n_models:
                        out.append((None, None, None, 0, False))
                        continue
                    total = memo.of(words).sum(axis=0)
                    n = int(total[n_models])
                    if n == 0:
                        out.append((None, None, None, 0, any(map(str.isalpha, one.decode("utf-8", "replace")))))
                        continue
                    entropy = -total[:n_models] / n
                    best = int(entropy.argmin())
                    share = 1 / np.exp(-(entropy - entropy[best]) * n).sum()
                    out.append((best, float(entropy[best]), float(share), n, True))
            columns = [pa.array(c, wanted.field(len(keep) + i).type) for i, c in enumerate(zip(*out, strict=True))] if out else [pa.array([], wanted.field(len(keep) + i).type) for i in range(5)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns[: len(keep)], *columns], wanted, strict=True)], schema=wanted)

    return rows.mapInArrow(frugal(scored), schema)


def identify_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, entropy, rejected`` for every row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0 (as is every
    text if nothing could be learned). Repeated rows are judged each; an empty
    table gives no rows; columns besides ``doc_id``, text and language are not
    looked at, and the language only where the models learn from it.
    """
    learned = fit(docs, text, lang)
    told = docs.select("doc_id", F.when(_learnable(lang), F.col(lang)).alias("lang"), F.col(text).alias("text"))
    scored = scratch(_score(told, learned, "text", ("doc_id", "lang")), "scored")
    calibrate(learned, scored)
    return scored.select(
        "doc_id",
        (bucket_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        F.coalesce(_of_language(learned.names, "string"), F.lit("und")).alias("lang_pred"),
        F.coalesce("share", F.lit(0.0)).alias("score"),
        "entropy",
        F.coalesce(_away(learned) > F.lit(float(learned.limit)), F.lit(True)).alias("rejected"),
    )
