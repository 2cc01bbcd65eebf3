"""Document quality: base rules and robust multivariate outliers.

Words and the base figures are counted with SQL functions inside the row; nothing but narrow figures is
shuffled. The outlier test fits, per language and source, a minimum covariance determinant estimate of
location and scatter to transformed figures by concentration steps, and rejects a document by its
Mahalanobis distance. Every step is a grouped aggregate over all documents; there is no Python in any task.

The estimate is regularised: ``FLOORS`` is added to each variance, so a figure that is the same in most
documents of a group (no repeated line, say) does not make every other value infinitely far, and a group of a
few documents stays defined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesloom.operators.lookups import broadcast_up_to
from salesloom.operators.materialize import materialize

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
_SPACES = " \t\n\x0b\f\r"
_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"

FIGURES = ("f0", "f1", "f2", "f3")
#: Standard deviations below which a spread counts as none: log word length, and square roots of shares. Where a figure is
#: mostly zero, its floor times the root of CUTOFF is the root of the share that rejects by itself: 8 % of symbols, 30 % of
#: repeated lines or of repeated words (base rules let pass up to half of the words).
FLOORS = (0.08, 0.05, 0.0948, 0.0948)
HALF = 0.75  # share of a group that a concentration step keeps
STEPS = 5
#: Squared distance beyond which a document is rejected; the chi-square quantile of 4 degrees of freedom at 1 - 1e-6.
CUTOFF = 33.38
_MEDIAN_CHI2, _KEPT_CHI2 = 3.357, 5.385  # quantiles of chi-square, 4 degrees, at 0.5 and at HALF
_BINS_PER_DOUBLING = 32


def counted(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang, source, the base figures and ``base_failed`` for every row; ``carry`` keeps further columns.

    A null text has no words; null lang or source stay null and form a group of their own later.
    """
    # each select makes its arrays once: Spark does not merge a projection whose result is used twice
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("_text"), *carry)
    words = F.array_remove(F.split(F.translate("_text", _SPACES, " " * len(_SPACES)), " "), "")
    lines = F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(_SPACES)) != "")
    split = base.select(
        *[c for c in base.columns if c != "_text"],
        F.length(F.translate("_text", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("words"),
    )
    figures = [c for c in split.columns if c not in ("lines", "words")]
    hashed = split.select(
        *figures,
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        # a 64-bit hash for each window of three words
        F.transform(
            F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
            lambda h, i: F.xxhash64(h, F.get("words", i + 1), F.get("words", i + 2)),
        ).alias("windows"),
    )
    figures += ["n_lines", "n_dup_lines", "n_words"]
    # windows that occur twice: sort (hash, place) and keep those with an equal neighbour
    placed = hashed.select(
        *figures,
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        )
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        .alias("placed"),
    )
    near = lambda x, k: x["h"] == F.get(F.col("placed"), k)["h"]
    alike = F.filter(
        "placed", lambda x, k: F.coalesce(near(x, k - 1), F.lit(False)) | F.coalesce(near(x, k + 1), F.lit(False))
    )
    at = placed.select(*figures, F.transform(alike, lambda x: x["i"]).alias("at"))
    second, third = F.transform("at", lambda i: i + 1), F.transform("at", lambda i: i + 2)
    n_repeat = F.size(F.array_union(F.array_union("at", second), third)).cast("long")
    return at.select(
        *figures,
        n_repeat.alias("n_repeat_words"),
        (
            (F.col("n_words") < MIN_WORDS) | (n_repeat * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
        ).alias("base_failed"),
    )


def _group_key() -> Column:
    """Null and empty language or source stay apart."""
    return F.to_json(F.struct("lang", "source"))


def figures(rows: DataFrame) -> DataFrame:
    """``rows`` of `counted` with grp and the transformed figures: log mean word length; roots of the shares of
    symbols, repeated lines and repeated words."""
    share = lambda a, b: F.sqrt(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)))
    word_length = F.coalesce(F.ln(F.try_divide(F.col("word_chars"), F.col("n_words"))), F.lit(0.0))
    return rows.withColumns(
        {
            "grp": _group_key(),
            "f0": word_length,
            "f1": share("n_symbols", "word_chars"),
            "f2": share("n_dup_lines", "n_lines"),
            "f3": share("n_repeat_words", "n_words"),
        }
    )


_PAIRS = [(i, j) for i in range(len(FIGURES)) for j in range(i + 1)]


def _moments() -> list[Column]:
    means = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FIGURES)]
    products = [F.sum(F.col(FIGURES[i]) * F.col(FIGURES[j])).alias(f"p{i}{j}") for i, j in _PAIRS]
    return [F.count("*").alias("n"), *means, *products]


_MOMENT_NAMES = ["n", *(f"s{i}" for i in range(len(FIGURES))), *(f"p{i}{j}" for i, j in _PAIRS)]


def _shape(sums: DataFrame, keys: Sequence[str], scale: float) -> DataFrame:
    """Centre m*, lower Cholesky factor l** of the regularised covariance, and its log determinant."""
    n = F.col("n")
    mean = [F.col(f"s{i}") / n for i in range(len(FIGURES))]
    low: dict[tuple[int, int], str] = {}
    frame = sums.select(
        *keys,
        *[m.alias(f"m{i}") for i, m in enumerate(mean)],
        *[
            ((F.col(f"p{i}{j}") / n - mean[i] * mean[j]) * scale + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
            for i, j in _PAIRS
        ],
    )
    for i, j in _PAIRS:  # ordered by i, then j: each entry needs earlier ones only
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(low[i, k]) * F.col(low[j, k])
        low[i, j] = f"l{i}{j}"
        entry = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(low[j, j])
        frame = frame.withColumn(low[i, j], entry)
    logdet = sum((F.ln(f"l{i}{i}") for i in range(len(FIGURES))), F.lit(0.0)) * 2
    return frame.withColumn("logdet", logdet).drop(*[f"c{i}{j}" for i, j in _PAIRS])


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor."""
    y: list[Column] = []
    for i, f in enumerate(FIGURES):
        rest = F.col(f) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * y[k]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _quantile_bin(bins: DataFrame, keys: Sequence[str], bin_name: str, share: float, count: str = "n") -> DataFrame:
    """Per key, the lowest bin at which the running count reaches ``share``."""
    whole = Window.partitionBy(*keys)
    running = whole.orderBy(bin_name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        bins.withColumn("upto", F.sum(count).over(running))
        .withColumn("total", F.sum(count).over(whole))
        .where(F.col("upto") >= F.col("total") * share)
        .groupBy(*keys)
        .agg(F.min(bin_name).alias("cut"))
    )


_BIN = 0.25  # of a floor: width of the bins that medians are read from


def _medians(rows: DataFrame, values: Sequence[Column]) -> DataFrame:
    """grp and per figure the middle of the bin that holds the median, from counts per bin."""
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("figure"), F.floor(v / (FLOORS[i] * _BIN)).alias("bin"))
                for i, v in enumerate(values)
            ]
        )
    ).alias("v")
    bins = rows.select("grp", each).groupBy("grp", "v.figure", "v.bin").agg(F.count("*").alias("n"))
    cut = _quantile_bin(bins, ["grp", "figure"], "bin", 0.5)
    return cut.groupBy("grp").agg(
        *[
            F.max(F.when(F.col("figure") == i, (F.col("cut") + 0.5) * (FLOORS[i] * _BIN))).alias(f"q{i}")
            for i in range(len(FIGURES))
        ]
    )


def _small(groups: DataFrame) -> DataFrame:
    """A written table of groups: broadcast if its count allows, so that a hot group's rows stay where they are."""
    return broadcast_up_to(groups, groups.count())


def _starts(rows: DataFrame) -> DataFrame:
    """Two first estimates per group: medians with median deviations, and the plain mean and covariance."""
    medians = materialize(_medians(rows, [F.col(f) for f in FIGURES]))
    apart = rows.join(_small(medians), "grp")
    spread = _medians(apart, [F.abs(F.col(f) - F.col(f"q{i}")) for i, f in enumerate(FIGURES)])
    deviation = spread.toDF("grp", *[f"d{i}" for i in range(len(FIGURES))])
    robust = medians.join(deviation, "grp").select(
        "grp",
        F.lit(0).alias("start"),
        *[F.col(f"q{i}").alias(f"m{i}") for i in range(len(FIGURES))],
        *[
            (F.greatest(F.col(f"d{i}") * 1.4826, F.lit(FLOORS[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}")
            for i, j in _PAIRS
        ],
        F.lit(0.0).alias("logdet"),
    )
    plain = _shape(rows.groupBy("grp").agg(*_moments()).withColumn("start", F.lit(1)), ["grp", "start"], 1.0)
    return robust.unionByName(plain)


def estimates(rows: DataFrame) -> DataFrame:
    """Per group the regularised minimum covariance determinant estimate: grp, m*, l**, logdet, factor.

    ``rows``: grp and figures of the documents to learn from. A concentration step orders the documents of a group by
    distance, keeps the nearest HALF and takes their mean and covariance. It is one aggregate: moments
    are summed per group and distance bin, and the bins up to the cut are then added. The
    start that ends with the smaller determinant wins (the medians' on a tie). ``factor`` scales the distances
    so that their median is the chi-square median, if they spread more than that.
    """
    shape = materialize(_starts(rows))
    for _ in range(STEPS):
        near = rows.join(_small(shape), "grp").withColumn("d", _distance())
        binned = near.withColumn("bin", F.floor(F.log2(F.col("d") + 1e-6) * _BINS_PER_DOUBLING))
        bins = materialize(binned.groupBy("grp", "start", "bin").agg(*_moments()))
        cut = _quantile_bin(bins, ["grp", "start"], "bin", HALF)
        kept = bins.join(cut, ["grp", "start"]).where(F.col("bin") <= F.col("cut"))
        sums = kept.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in _MOMENT_NAMES])
        shape = materialize(_shape(sums, ["grp", "start"], _CONSISTENCY))
    best = Window.partitionBy("grp").orderBy("logdet", "start")
    chosen = shape.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth", "start")
    near = rows.join(_small(materialize(chosen)), "grp").withColumn("bin", F.floor(F.log2(_distance() + 1e-6) * _BINS_PER_DOUBLING))
    bins = near.groupBy("grp", "bin").agg(F.count("*").alias("n"))
    median = F.pow(F.lit(2.0), (F.col("cut") + 1) / _BINS_PER_DOUBLING)
    factor = _quantile_bin(bins, ["grp"], "bin", 0.5).select(
        "grp", F.greatest(median / _MEDIAN_CHI2, F.lit(1.0)).alias("factor")
    )
    return materialize(chosen.join(factor, "grp"))


#: HALF over the share of chi-square with 6 degrees below the HALF quantile of 4 degrees.
_CONSISTENCY = 0.75 / 0.5046


def judged(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Base figures and verdict for every row of ``docs`` (doc_id, text, lang, source).

    Returns the columns of `counted` with grp, f0-f3, distance (squared, scaled; null if base_failed) and
    kept. ``kept`` is false for a document that fails the base rules, or whose distance from its group's centre exceeds
    CUTOFF. Documents that fail the base rules do not enter the estimates. Null language or source make
    groups of their own; a group of one or of equal documents keeps them. Repeated rows are judged alike; an empty
    table gives no rows. Columns not named here are ignored unless listed in ``carry``.
    """
    rows = materialize(figures(counted(docs, carry)))
    learn = rows.where(~F.col("base_failed")).select("grp", *FIGURES)
    shape = estimates(learn)
    met = rows.join(_small(shape), "grp", "left")
    distance = F.when(~F.col("base_failed"), _distance() / F.col("factor"))
    out = met.withColumn("distance", distance)
    return out.select(
        *rows.columns,
        "distance",
        (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)).alias("kept"),
    )
