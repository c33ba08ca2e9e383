"""Quality rules: robust multivariate outliers per language and source.

Each text gives a few counts (``statistics``), which are transformed to five
near-normal coordinates (``COORDINATES``). For every language and source the
minimum-covariance-determinant estimate of centre and scatter is sought, and a
document goes when its squared Mahalanobis distance from it exceeds ``CUTOFF``,
or when a base rule fails.

The estimate is the fast one: many random starts of six rows, two concentration
steps each, the best of them concentrated until their determinant falls no more
(on about ``SAMPLE`` rows a group); the ``STARTS`` best are then concentrated
over *all* rows, the one of the lowest determinant goes on until it falls no
more, and the rows within the usual quantile of it give the final estimate.
Each distinct vector of a group weighs once, so that copies do not make a core.

At scale: a step over all rows is one aggregation. Each row's distance falls
into one of a fixed number of bins; counts, sums and products are summed by
group and bin (partial sums before the shuffle, so a group with a third of all
rows is no hot task). The bins nearest to the centre that hold the core give
the next estimate, the last of them by the share of it that is still wanted.
Estimates are a row a group, joined to the rows with salted keys or, when few,
broadcast.

How far a small group's own estimate can be trusted is in its cutoff, which is
widened by the factor of a prediction region, (m^2 - 1) / (m (m - 5)) for m
vectors; there is no scatter of five vectors or less, so none are outliers there.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, binaries, frugal, scratch, small_batches

#: Share of a group's vectors that the estimate rests on at least.
CORE = 0.5
#: Vectors a group, about, that the starts are sought in; random starts there, those refined there, and those that all rows refine.
SAMPLE, DRAWS, REFINED, STARTS = 600, 100, 10, 2
#: Steps that all starts do over all rows, steps at most, and the fall of the determinant's logarithm that ends them.
FIRST_STEPS, MOST_STEPS, STILL = 2, 20, 1e-3
#: Quantile of normal rows that the final estimate rests on.
WEIGHED = 0.975
SEED = 7
#: Squared distance above which a document goes: of five normal coordinates, one in 10^7 exceeds it.
CUTOFF = 41.0
#: (name, expression over the statistics, smallest standard deviation that is believed). The floors
#: keep a coordinate that is constant among most documents from making every other value an outlier.
COORDINATES = (
    ("z_length", "ln(n_words)", 0.8),
    ("z_word", "ln(word_chars / n_words)", 0.12),
    ("z_symbols", "asin(sqrt(least(1.0, n_symbols / word_chars)))", 0.06),
    ("z_lines", "asin(sqrt(n_dup_lines / n_lines))", 0.15),
    ("z_repeats", "asin(sqrt(n_repeat_words / n_words))", 0.15),
)
#: Estimates of up to so many groups are broadcast (about 200 bytes each).
BROADCAST_GROUPS = 50_000
SALTS = 32
BINS_PER_OCTAVE, LOWEST_BIN, HIGHEST_BIN = 8, -80, 120
_NAMES = [name for name, _, _ in COORDINATES]
_FLOORS = np.array([floor for _, _, floor in COORDINATES])
_PAIRS = [(i, j) for i in range(len(_NAMES)) for j in range(i, len(_NAMES))]
_STATS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])
_SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
_SPACES = [bytes([c]) for c in b" \t\n\x0b\x0c\r"]


def text_statistics(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """Counts over a whole UTF-8 text; words are runs without ASCII white space."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()  # of bytes: at ASCII white space only
    n = len(words)
    points = len(text.decode("utf-8", "replace")) - sum(map(text.count, _SPACES))
    seen: set[bytes] = set()
    n_lines = n_dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        times, until = Counter(windows), 0
        for at, window in enumerate(windows):
            if times[window] > 1:
                repeated += at + 3 - max(at, until)
                until = at + 3
    return n, points, sum(map(text.count, _SYMBOLS)), n_lines, n_dup, repeated


def with_statistics(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and the counts of ``text_statistics`` for every row. ``text`` crosses to Python once, be it kept or not."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep) if text in keep else docs.select(*keep, text)
    text_at = rows.columns.index(text)
    schema = T.StructType([rows.schema[k] for k in keep] + list(_STATS))
    wanted = arrow_schema(schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_statistics(t) for t in binaries(batch.column(text_at))]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(_STATS))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns[: len(keep)], *columns], wanted, strict=True)], schema=wanted)

    return rows.mapInArrow(frugal(counted), schema)


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi2_cdf(x: float, df: int) -> float:
    return gamma_p(df / 2, x / 2) if x > 0 else 0.0


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return high


def consistency(core: float, p: int) -> float:
    """What makes the covariance of the nearest ``core`` of normal rows that of all."""
    if core >= 1:
        return 1.0
    return core / chi2_cdf(chi2_quantile(core, p), p + 2)


def estimate(n: float, sums: np.ndarray, products: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter from sums over the core; the floors are added to the scatter."""
    p = len(sums)
    centre = sums / n
    scatter = np.zeros((p, p))
    for (i, j), value in zip(_PAIRS, products, strict=True):
        scatter[i, j] = scatter[j, i] = value / n - centre[i] * centre[j]
    scatter *= factor
    values, vectors = np.linalg.eigh(scatter)
    scatter = (vectors * np.maximum(values, 0)) @ vectors.T
    scatter += np.diag(np.maximum(0, _FLOORS**2 - np.diag(scatter)) + 0.05 * _FLOORS**2)
    return centre, scatter


def core_size(n: int, core: float = CORE) -> int:
    """Of n vectors, those in the core: the share, but so many that no half less than it can be far off."""
    return min(n, max(math.floor(core * n), (n + len(_NAMES) + 1) // 2))


def _products(x: np.ndarray) -> np.ndarray:
    squared = x.T @ x
    return np.array([squared[i, j] for i, j in _PAIRS])


def concentrate(x: np.ndarray, centre: np.ndarray, scatter: np.ndarray, h: int, factor: float, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Concentration steps over the rows of ``x`` until the determinant falls no more: centre, scatter and the logarithm of its determinant."""
    best = (centre, scatter, np.inf)
    for _ in range(steps):
        away = x - centre
        near = x[np.argsort(((away @ np.linalg.inv(scatter)) * away).sum(axis=1), kind="stable")[:h]]
        centre, scatter = estimate(h, near.sum(axis=0), _products(near), factor)
        determinant = float(np.linalg.slogdet(scatter)[1])
        if determinant > best[2] - 1e-9:
            break
        best = (centre, scatter, determinant)
    return best


def fast_mcd(x: np.ndarray, core: float = CORE, starts: int = STARTS, draws: int = DRAWS, refined: int = REFINED) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The best ``starts`` estimates for the rows of ``x``, lowest determinant first, from ``draws`` random starts and that of all rows."""
    random, (n, p) = np.random.default_rng(SEED), x.shape
    h = core_size(n, core)
    factor = consistency(h / n, p)
    chosen = [np.arange(n)] + [random.choice(n, p + 1, replace=False) for _ in range(draws if n > p + 1 else 0)]
    tried = []
    for rows in chosen:
        few = x[rows]
        centre, scatter = estimate(len(few), few.sum(axis=0), _products(few), 1.0)
        tried.append(concentrate(x, centre, scatter, h, factor, 2))
    found: list[tuple[np.ndarray, np.ndarray, float]] = []
    for centre, scatter, _ in sorted(tried, key=lambda e: e[2])[:refined]:
        one = concentrate(x, centre, scatter, h, factor, 100)
        if all(abs(one[2] - other[2]) > 1e-6 for other in found):
            found.append(one)
    return sorted(found, key=lambda e: e[2])[:starts]


_MODEL = T.StructType(
    [
        T.StructField("grp", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("det", T.DoubleType()),
        T.StructField("m", T.DoubleType()),
        *(T.StructField(f"c{i}", T.DoubleType()) for i in range(len(_NAMES))),
        *(T.StructField(f"p{i}{j}", T.DoubleType()) for i, j in _PAIRS),
    ]
)


def _model_row(grp: str, start: int, m: float, centre: np.ndarray, scatter: np.ndarray) -> tuple:
    inverse = np.linalg.inv(scatter)
    return (grp, start, float(np.linalg.slogdet(scatter)[1]), float(m), *centre, *(inverse[i, j] for i, j in _PAIRS))


def _begin(core: float):
    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values(_NAMES)[_NAMES].to_numpy(float)
        return pd.DataFrame([_model_row(frame["grp"].iloc[0], k, len(x), centre, scatter) for k, (centre, scatter, _) in enumerate(fast_mcd(x, core))], columns=_MODEL.names)

    return begin


def _solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Estimates from sums (``n``, ``s``, ``q``) over ``share`` of the group's vectors."""
    for frame in frames:
        rows = []
        for row in frame.to_dict("records"):
            sums = np.array([row[f"s{i}"] for i in range(len(_NAMES))])
            rows.append(_model_row(row["grp"], row["start"], row["n"], *estimate(row["n"], sums, np.array([row[f"q{i}{j}"] for i, j in _PAIRS]), consistency(row["share"], len(_NAMES)))))
        yield pd.DataFrame(rows, columns=_MODEL.names)


_SUMS = ["n", *(f"s{i}" for i in range(len(_NAMES))), *(f"q{i}{j}" for i, j in _PAIRS)]


def _moments() -> list[Column]:
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(_NAMES)]
    return [F.count("*").cast("double").alias("n"), *sums, *(F.sum(F.col(_NAMES[i]) * F.col(_NAMES[j])).alias(f"q{i}{j}") for i, j in _PAIRS)]


def _with_distance(rows: DataFrame, model: DataFrame, few: bool) -> DataFrame:
    """Rows with ``d2``, the squared distance from their group's centre, once for each start; null without a model."""
    if few:
        joined = rows.join(F.broadcast(model), "grp", "left")
    else:
        salted = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.hash(*_NAMES), F.lit(SALTS))).join(salted, ["grp", "salt"], "left").drop("salt")
    away = [F.col(n) - F.col(f"c{i}") for i, n in enumerate(_NAMES)]
    terms = [away[i] * away[j] * F.col(f"p{i}{j}") * (1 if i == j else 2) for i, j in _PAIRS]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return joined.withColumn("d2", total).drop(*_MODEL.names[4:])


def _concentrated(vectors: DataFrame, model: DataFrame, sizes: DataFrame, few: bool) -> DataFrame:
    """The model after one concentration step over all vectors."""
    bin_of = F.greatest(F.lit(LOWEST_BIN), F.least(F.lit(HIGHEST_BIN), F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-300))) * BINS_PER_OCTAVE)))
    binned = _with_distance(vectors, model, few).withColumn("bin", bin_of.cast("int")).groupBy("grp", "start", "bin").agg(*_moments())
    upto = F.expr("sum(n) over (partition by grp, start order by bin)")
    part = F.least(F.lit(1.0), (F.col("h") - (F.col("upto") - F.col("n"))) / F.col("n"))
    core = binned.join(F.broadcast(sizes) if few else sizes, "grp").withColumn("upto", upto).withColumn("part", part).where("part > 0")
    summed = core.groupBy("grp", "start").agg(*(F.sum(F.col(c) * F.col("part")).alias(c) for c in _SUMS), F.first("share").alias("share"))
    return scratch(summed.mapInPandas(_solve, _MODEL), "model")


def robust_model(vectors: DataFrame, core: float = CORE) -> tuple[DataFrame, bool]:
    """The estimate of each group of distinct ``vectors`` (grp and coordinates), and whether groups are few."""
    p = len(_NAMES)
    h = F.least(F.col("total"), F.greatest(F.floor(F.lit(core) * F.col("total")), F.floor((F.col("total") + p + 1) / 2)))
    sizes = vectors.groupBy("grp").agg(F.count("*").alias("total")).withColumn("h", h).withColumn("share", F.col("h") / F.col("total"))
    sizes = scratch(sizes, "groups")
    few = sizes.count() <= BROADCAST_GROUPS
    drawn = vectors.join(F.broadcast(sizes) if few else sizes, "grp").where(F.pmod(F.xxhash64(F.lit(SEED), *_NAMES), F.lit(1 << 30)) < F.lit(SAMPLE << 30) / F.greatest(F.col("total"), F.lit(SAMPLE)))
    model = scratch(drawn.select("grp", *_NAMES).groupBy("grp").applyInPandas(_begin(core), _MODEL), "model")
    for step in range(MOST_STEPS):
        after = _concentrated(vectors, model, sizes, few)
        fell = after.join(model.select("grp", "start", F.col("det").alias("before")), ["grp", "start"]).agg(F.max(F.col("before") - F.col("det"))).first()[0]
        if step + 1 == FIRST_STEPS:
            best = after.groupBy("grp").agg(F.min_by("start", F.struct("det", "start")).alias("start"))
            after = scratch(after.join(best, ["grp", "start"], "left_semi"), "model")
        model = after
        if step + 1 >= FIRST_STEPS and (fell is None or fell < STILL):
            break
    weighed = _with_distance(vectors, model, few).where(F.col("d2") <= chi2_quantile(WEIGHED, p)).groupBy("grp", "start").agg(*_moments())
    return scratch(weighed.withColumn("share", F.lit(WEIGHED)).mapInPandas(_solve, _MODEL), "model"), few


def robust_distances(stats: DataFrame, good: Column, groups: tuple[str, str] = ("lang", "source"), core: float = CORE) -> DataFrame:
    """``stats`` with ``d2`` and ``widened``, what its group's cutoff is multiplied by (null without limit), from estimates over the rows for which ``good`` holds.

    Both are null where ``good`` fails.
    """
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in groups)
    rows = stats.withColumn("good", F.coalesce(good, F.lit(False)))
    for name, expression, _ in COORDINATES:
        rows = rows.withColumn(name, F.when(F.col("good"), F.expr(expression)))
    keyed = scratch(rows.withColumn("grp", F.concat(F.length(lang).cast("string"), F.lit(":"), lang, source)), "statistics")
    vectors = scratch(keyed.where("good").select("grp", *_NAMES).distinct(), "vectors")
    model, few = robust_model(vectors, core)
    p = len(_NAMES)
    widened = F.when(F.col("m") > p, (F.col("m") ** 2 - 1) / (F.col("m") * (F.col("m") - p)))
    return _with_distance(keyed, model, few).withColumn("widened", widened).drop("grp", "good", "start", "det", "m")


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def quality_rules(docs: DataFrame, text: str = "text", cutoff: float = CUTOFF, keep: tuple[str, ...] = (), doc_id: str = "doc_id", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row a document: ``keep``, ``doc_id``, its counts, ``base_failed``, ``d2``, ``widened`` and ``kept``.

    A null or empty text counts no words and fails. Null languages and sources
    are values of their own. Repeated rows are judged each, and weigh once in an
    estimate. An empty table gives no rows. Columns that are not named, whatever
    their names, are not looked at; kept ones may not be named like a result.
    """
    names = tuple(dict.fromkeys((*keep, doc_id)))
    if clash := set(names) & {*_STATS.names, *_NAMES, "base_failed", "kept", "d2", "widened", "grp", "good"}:
        raise ValueError(f"kept columns are named like results: {sorted(clash)}")
    stats = with_statistics(docs, text, tuple(dict.fromkeys((*names, *groups)))).withColumn("base_failed", F.expr(BASE_FAILED))
    scored = robust_distances(stats, ~F.col("base_failed"), groups)
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= F.lit(cutoff) * F.col("widened"), F.lit(True))
    return scored.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_lines", "d2", "widened", *_NAMES)
