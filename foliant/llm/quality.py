"""Text-quality statistics and a robust distance from running prose.

Each text gets its word count, mean word length, symbol ratio, share of lines that end in punctuation and share of
common words of its language. For each language, mean and covariance of prose are estimated robustly: from medians and
quartiles first, then twice from the three quarters of the documents that lie nearest. The squared Mahalanobis distance
of a text splits into one contribution per statistic. Residuals are shrunk by what sampling explains in a short text.

The distance is over all statistics. A residual on prose's better side (more common words, fewer symbols, more
punctuation) is no deviation, and the word count, which may be any in prose, has a wide least deviation. The verdict is
that of this distance against a quantile of the chi-square distribution, and the contributions reported are its own.

Defined results: null and empty texts, and texts of white space only, have no row; a text without words has mean word
length and share of common words 0; a language with too few texts to estimate from gets the floor of each deviation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.tables import cut

#: The most common function words of each language. Fixed values.
COMMON = {
    "en": "the of and to in that is was for on by with as not be at it this from had or no which has an under were also been any",
    "fr": "le la les de des du et en un une que qui est à au aux par pour dans sur ne pas ce cette sont a été il se son",
    "de": "der die das und in den von zu dem nicht mit des ist im auf für eine ein dass sich als auch es an war wurde hat nach durch aus",
    "vi": "của và là có được cho các không một trong đã với người này khi để theo những từ bị tại ra rằng do đến vào bên phải việc trước",
}
STATS = ("log_words", "mean_word_length", "symbol_ratio", "punctuation_share", "common_share")
#: Least deviation of each statistic between prose documents; variance within a document of one word (of one
#: character for symbol_ratio); side of each statistic that counts against prose (0: both).
FLOOR = (3.0, 0.2, 0.01, 0.1, 0.03)
WITHIN = (0.0, 6.0, 0.5, 1.0, 0.24)
ADVERSE = (0, 0, 1, -1, -1)
#: Squared distance from which a text is no prose: the 98 % quantile of chi-square with a degree for each statistic.
CUTOFF = 13.388
ENDS_OF_LINE = ".!?;:,…”»\""


def statistics(docs: DataFrame, id_col: str, text: str, lang: str) -> DataFrame:
    """(id_col, language, word_count, char_count, STATS) of each row with text."""
    rows = docs.select(id_col, F.col(lang).alias("label"), F.col(text).alias("t")).where(F.col("t").rlike(r"\S"))
    rows = rows.select(
        id_col, "label", F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"),
        F.filter(F.split("t", r"[\r\n]+"), lambda line: F.trim(line) != "").alias("lines"),
        F.length(F.regexp_replace("t", r"(?U)\s+", "")).alias("char_count"),
    )
    count = F.size("words")
    n = F.greatest(count, F.lit(1)).cast("double")
    letters = F.length(F.array_join("words", ""))

    def share(language: str) -> Column:
        return F.size(F.filter("words", lambda w: w.isin(COMMON[language].split()))) / n

    labelled = F.lit(-1.0)
    for language in COMMON:
        labelled = F.when(F.col("label") == language, share(language)).otherwise(labelled)
    rows = rows.select(
        id_col, "label", "words", count.alias("word_count"), "char_count", F.log1p(count.cast("double")).alias("log_words"),
        (letters / n).alias("mean_word_length"), ((F.col("char_count") - letters) / F.greatest(F.col("char_count"), F.lit(1))).alias("symbol_ratio"),
        (F.size(F.filter("lines", lambda line: F.instr(F.lit(ENDS_OF_LINE), F.right(F.rtrim(line), F.lit(1))) > 0)) / F.greatest(F.size("lines"), F.lit(1))).alias("punctuation_share"),
        labelled.alias("labelled"),
    )
    # Where few words are common in the language of the label, all languages are tried and the best one taken.
    tried = F.array_max(F.array(*[F.struct(share(k).alias("share"), F.lit(k).alias("language")) for k in COMMON]))
    best = F.when(F.col("labelled") >= 0.1, F.struct(F.col("labelled").alias("share"), F.col("label").alias("language"))).otherwise(tried)
    rows = rows.withColumn("best", best)
    language = F.when((F.col("best.share") <= 0) & F.col("label").isin(*COMMON), F.col("label")).otherwise(F.col("best.language"))
    return rows.select(id_col, language.alias("language"), "word_count", "char_count", *STATS[:-1], F.col("best.share").alias("common_share"))


def _by_language(values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for language, value in values.items():
        out = F.when(F.col("language") == language, F.lit(float(value))).otherwise(out)
    return out


def _distance(models: dict[str, tuple[np.ndarray, np.ndarray]], adverse: bool) -> list[Column]:
    """The contribution of each statistic; they add up to the squared distance. Fitting counts both sides of each."""
    sizes = (F.lit(1.0), F.col("word_count"), F.col("char_count"), F.col("word_count"), F.col("word_count"))
    residuals = []
    for j, name in enumerate(STATS):
        r = F.col(name) - _by_language({k: mean[j] for k, (mean, _) in models.items()})
        if adverse:
            r = {0: r, 1: F.greatest(r, F.lit(0.0)), -1: F.least(r, F.lit(0.0))}[ADVERSE[j]]
        if WITHIN[j]:
            variance = _by_language({k: cov[j, j] for k, (_, cov) in models.items()})
            r = r * F.sqrt(variance / (variance + F.lit(WITHIN[j]) / F.greatest(sizes[j], F.lit(1))))
        residuals.append(r)
    inverses = {k: np.linalg.inv(cov) for k, (_, cov) in models.items()}
    return [residuals[j] * sum((residuals[i] * _by_language({k: inv[j, i] for k, inv in inverses.items()}) for i in range(len(STATS))), F.lit(0.0)) for j in range(len(STATS))]


def fit(stats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Robust mean and covariance of prose for each language of COMMON; one row a language comes to the driver."""
    floor = np.diag(np.square(FLOOR))
    models = {k: (np.zeros(len(STATS)), floor) for k in COMMON}
    quartiles = stats.groupBy("language").agg(*[F.percentile_approx(s, [0.25, 0.5, 0.75], 1000).alias(s) for s in STATS])
    for row in quartiles.collect():
        spread = np.array([(row[s][2] - row[s][0]) / 1.349 for s in STATS])
        models[row.language] = (np.array([row[s][1] for s in STATS]), np.diag(np.maximum(np.square(spread), np.square(FLOOR))))
    for _ in range(2):
        near = stats.withColumn("d", sum(_distance(models, adverse=False), F.lit(0.0)))
        bounds = {r.language: r.bound for r in near.groupBy("language").agg(F.percentile_approx("d", 0.75, 1000).alias("bound")).collect()}
        near = near.where(F.col("d") <= _by_language(bounds))
        sums = [F.avg(s).alias(f"m{i}") for i, s in enumerate(STATS)]
        sums += [F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(STATS) for j, b in enumerate(STATS) if i <= j]
        for row in near.groupBy("language").agg(*sums).collect():
            mean = np.array([row[f"m{i}"] for i in range(len(STATS))])
            cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(STATS))] for i in range(len(STATS))])
            models[row.language] = (mean, cov + np.diag(np.maximum(0, np.square(FLOOR) - np.diag(cov))))
    return models


def judge(docs: DataFrame, id_col: str, text: str, lang: str) -> DataFrame:
    """The statistics of each text with ``distance``, its split into ``contribution_*``, and ``is_prose``."""
    stats = cut(statistics(docs, id_col, text, lang))
    parts = _distance(fit(stats), adverse=True)
    named = [p.alias(f"contribution_{s}") for s, p in zip(STATS, parts)]
    judged = stats.select("*", *named).withColumn("distance", sum((F.col(f"contribution_{s}") for s in STATS), F.lit(0.0)))
    return judged.withColumn("is_prose", F.col("distance") <= CUTOFF)
