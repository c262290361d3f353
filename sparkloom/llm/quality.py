"""Quality rules: counts per text, a plain base rule, and robust multivariate outliers. DataFrame operations only.

The outlier test fits a minimum covariance determinant (MCD) estimate for every language and source. From several
deterministic robust starts (scatters of tanh-wrapped, clipped, sign-only and independent coordinates around the medians)
concentration steps refit mean and covariance on the H share of rows that are nearest. After FIRST_STEPS the start with
the smallest determinant goes on until the determinant falls no more. Rows farther than CUTOFF in Mahalanobis distance
are rejected. The vector holds smoothed and transformed shares, so that a short text's noisy shares stay near its source's
centre; its length is no part of it. FLOOR is added to the spread of each share, so that a source where nobody uses, say,
symbols does not reject the first text that uses one. Rows that fail the base rule are neither fitted nor tested. A source
with fewer than MIN_GROUP rows to test in a language is judged by the estimate of the whole language, a language with
fewer by that of all rows; fewer rows than that altogether make no estimate, and none is rejected by it.

Scale: texts are scanned once; the counts, some 60 bytes a row, are written to the shared folder, and all fitting steps
group them by (lang, source) with partial aggregates, so a source that holds a third of all rows is no hot task. Quantiles
are sketches with a rank error of 1 / ACCURACY, exact for groups up to about that size. Estimates are a row per group
(half a KB) and are written and counted: up to BROADCAST_GROUPS are broadcast to the rows, so that no large source's rows
meet in one task; more groups than that are joined by a shuffle, whose large partitions the planner splits. A very long
text is held by one task, with about 60 bytes a word.

Edge cases: null texts are empty (no words: base_failed); a null lang or source is a value of its own, unlike an empty
one; repeated rows each count; an empty table gives no rows; other columns are ignored by `report` and carried by `kept`.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS_PER_FILE, stored

WORDS = r"[^\x20\x09-\x0D]+"
H, MIN_GROUP = 0.75, 50
#: Concentration steps with all starts; steps altogether, which no data met so far came near; and when a determinant (its logarithm) counts as settled.
FIRST_STEPS, MOST_STEPS, SETTLED, ACCURACY = 2, 30, 1e-6, 10_000
#: Digests of rejected rows up to so many are broadcast (16 bytes each) rather than shuffled with the texts.
BROADCAST_IDS = 500_000
#: Groups up to so many have their sizes, quartiles and estimates broadcast (half a KB each) to the rows.
BROADCAST_GROUPS = 10_000
#: Quantile 1 - 1e-6 of chi-squared with six degrees of freedom, and the MCD's consistency factor at H = 0.75 for six.
CUTOFF, CONSISTENCY = 38.26, 1.36
FEATURES = ("f_length", "f_symbol", "f_line", "f_repeat", "f_upper", "f_mark")
FLOOR = (0.08, 0.25, 0.06, 0.05, 0.25, 0.25)


def _content(docs: DataFrame) -> list[Column]:
    """Two digests of what a row is judged by: rows that are equal in it have one verdict."""
    parts = [F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("")) for c in ("lang", "source")] + [F.coalesce(docs["text"].cast("string"), F.lit(""))]
    return [F.xxhash64(*parts).alias("row1"), F.xxhash64(F.lit(1), *parts).alias("row2")]


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """Per row: row1, row2 (digests of its content), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the further counts of the outlier test."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"), *_content(docs))
    at = at.select(
        "doc_id", "lang", "source", "row1", "row2",
        (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("""[!?.,;:'"()]""")).cast("long").alias("n_marks"),
        F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("lines"),
    )
    word = lambda i: F.get("words", i)
    windows = F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2), word(i + 3), word(i + 4)))).otherwise(F.array().cast("array<bigint>"))
    at = at.withColumns({"n_words": F.size("words").cast("long"), "n_lines": F.size("lines").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "windows": windows}).drop("words", "lines")
    # the rest of the work only where a window comes twice: sort (window, place), keep places whose window is a neighbour's
    at = at.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))).otherwise(F.array().cast("array<struct<w:bigint,i:int>>"))).drop("windows")
    twice = F.filter("placed", lambda x, j: (x["w"] == F.get("placed", j - 1)["w"]) | (x["w"] == F.get("placed", j + 1)["w"]))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    at = at.withColumn("n_repeat_words", covered.cast("long")).drop("placed")
    at = at.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    share = lambda n: F.log1p(100 * F.col(n) / (F.col("word_chars") + 150))
    return at.withColumns({
        "f_length": F.log((F.col("word_chars") + 150) / (F.col("n_words") + 30)), "f_symbol": share("n_symbols"), "f_line": F.col("n_dup_lines") / (F.col("n_lines") + 10),
        "f_repeat": F.col("n_repeat_words") / (F.col("n_words") + 50), "f_upper": share("n_upper"), "f_mark": share("n_marks"),
    })


# The estimates' expressions are SQL text, as the driver would take seconds to build them from columns one by one.


def _estimate(moments: DataFrame, keys: list[str], floor: tuple[float, ...]) -> DataFrame:
    """keys, mean, inverse (of the covariance, its rows one after another) and det (the logarithm of the covariance's determinant),
    from m0 ... (means) and q0_0 ... (means of products)."""
    d = len(floor)
    cov = ", ".join(f"{CONSISTENCY}D * (q{min(i, j)}_{max(i, j)} - m{i} * m{j} + {floor[i] ** 2 if i == j else 0}D)" for i in range(d) for j in range(d))
    # the matrix is inverted in place by Gauss-Jordan steps, whose pivots make the determinant; the floor keeps them above 0
    p, row, column, t = f"a.s[k * {d + 1}]", f"a.s[k * {d} + t % {d}]", f"a.s[t div {d} * {d} + k]", "t"
    step = f"CASE WHEN {t} = k * {d + 1} THEN 1 / {p} WHEN {t} div {d} = k THEN v / {p} WHEN {t} % {d} = k THEN -v / {p} ELSE v - {column} * {row} / {p} END"
    swept = f"aggregate(sequence(0, {d - 1}), struct(array({cov}) AS s, 0D AS det), (a, k) -> struct(transform(a.s, (v, t) -> {step}) AS s, a.det + ln({p}) AS det))"
    est = moments.selectExpr(*keys, f"array({', '.join(f'm{i}' for i in range(d))}) AS mean", f"{swept} AS x")
    return est.selectExpr(*keys, "mean", "x.s AS inverse", "x.det AS det")


def _distance(names: tuple[str, ...]) -> str:
    """Squared Mahalanobis distance from a joined estimate."""
    d, z = len(names), [f"({x} - mean[{i}])" for i, x in enumerate(names)]
    return " + ".join(f"{z[i]} * ({' + '.join(f'{1 if i == j else 2}D * inverse[{i * d + j}] * {z[j]}' for j in range(i, d))})" for i in range(d))


def _moments(rows: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    means = [F.expr(f"avg({x}) AS m{i}") for i, x in enumerate(names)]
    return rows.groupBy(*keys).agg(*means, *[F.expr(f"avg({names[i]} * {names[j]}) AS q{i}_{j}") for i, j in combinations_with_replacement(range(len(names)), 2)])


def _per_group(df: DataFrame, tag: str) -> DataFrame:
    """df, a row or a few a group, stored in a few files; broadcast to what it is joined to if it is small."""
    df = stored(df, tag, 4 * ROWS_PER_FILE)
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def _starts(at: DataFrame, group: str, names: tuple[str, ...], floor: tuple[float, ...]) -> DataFrame:
    """(group, start, mean, inverse): robust estimates to start from, up to a factor."""
    d = len(names)
    quart = at.groupBy(group).agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], ACCURACY).alias(f"p{i}") for i, x in enumerate(names)])
    quart = _per_group(quart.selectExpr(group, f"array({', '.join(f'p{i}[1]' for i in range(d))}) AS median", f"array({', '.join(f'{floor[i]}D + (p{i}[2] - p{i}[0]) / 1.349D' for i in range(d))}) AS scale"), "quartiles")
    z = at.join(quart, group).selectExpr(group, *[f"({x} - median[{i}]) / scale[{i}] AS z{i}" for i, x in enumerate(names)])
    z = z.selectExpr("*", f"sqrt({' + '.join(f'z{i} * z{i}' for i in range(d))} + 1e-12D) AS far")
    wraps = {"tanh": "tanh(z{})", "clip": "greatest(least(z{}, 2D), -2D)", "sign": "z{} / far"}
    own = [f"struct('{name}' AS start, {', '.join(f'{f.format(i)} AS u{i}' for i in range(d))})" for name, f in wraps.items()]
    moments = _moments(z.selectExpr(group, f"explode(array({', '.join(own)})) AS u").select(group, "u.*"), [group, "start"], tuple(f"u{i}" for i in range(d)))
    # scatters around the medians with a diagonal of one (a tenth more, for a safe inverse); `independent` has nothing beside it
    moments = moments.withColumn("start", F.expr("explode(IF(start = 'tanh', array('tanh', 'independent'), array(start)))"))
    off = lambda i, j: "1D" if i == j else f"IF(start = 'independent', 0D, q{i}_{j} / sqrt((q{i}_{i} + 1e-9D) * (q{j}_{j} + 1e-9D)))"
    one = moments.selectExpr(group, "start", *[f"0D AS m{i}" for i in range(d)], *[f"{off(i, j)} AS q{i}_{j}" for i in range(d) for j in range(i, d)])
    shape = _estimate(one, [group, "start"], (0.1**0.5,) * d).join(quart, group)
    return shape.selectExpr(group, "start", "median AS mean", f"transform(inverse, (v, t) -> v / (scale[t div {d}] * scale[t % {d}])) AS inverse")


def mcd(rows: DataFrame, group: str, names: tuple[str, ...] = FEATURES, floor: tuple[float, ...] = FLOOR, h: float = H) -> DataFrame:
    """One row a group: mean, inverse (of the covariance) and det (the logarithm of its determinant), by MCD."""
    at, keys = rows.select(group, *names), [group, "start"]

    def step(est: DataFrame) -> DataFrame:
        """A concentration step: the moments of the h share of rows that are nearest by est."""
        near = at.join(est, group).selectExpr(*keys, *names, f"{_distance(names)} AS d")
        edge = _per_group(near.groupBy(*keys).agg(F.percentile_approx("d", h, ACCURACY).alias("edge")), "edges")
        return _per_group(_estimate(_moments(near.join(edge, keys).where("d <= edge"), keys, names), keys, floor), "mcd")

    est = _per_group(_starts(at, group, names, floor), "starts")
    for _ in range(FIRST_STEPS):
        est = step(est)
    est = _per_group(est.groupBy(group).agg(F.min(F.struct("det", "start", "mean", "inverse")).alias("x")).select(group, "x.*"), "best")
    for _ in range(MOST_STEPS):
        last, est = est, step(est)
        falls = est.select(*keys, "det").join(last.select(*keys, F.col("det").alias("was")), keys).agg(F.max(F.col("was") - F.col("det"))).head()[0]
        if falls is None or falls <= SETTLED:
            break
    return est.select(group, "mean", "inverse", "det")


def judged(docs: DataFrame) -> DataFrame:
    """counts() with the group that a row was judged by, its squared distance (null: not tested) and kept."""
    rows = stored(counts(docs).withColumns({"own": F.concat(F.lit("2"), F.to_json(F.struct("lang", "source"))), "wider": F.concat(F.lit("1"), F.to_json(F.struct("lang")))}), "quality")
    tested = rows.where("not base_failed")
    # a row a source: by which estimate it is judged, and to which ones its rows contribute
    sizes = stored(tested.groupBy("own", "wider").agg(F.count("*").alias("n")), "sizes", 4 * ROWS_PER_FILE)
    langs = sizes.groupBy("wider").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    total, least = langs.agg(F.coalesce(F.sum("n_lang"), F.lit(0)), F.coalesce(F.min("n_lang"), F.lit(0))).head()
    by = F.when(F.col("n") >= MIN_GROUP, F.col("own")).when(F.col("n_lang") >= MIN_GROUP, F.col("wider")).when(F.lit(total >= MIN_GROUP), F.lit("0"))
    of_lang, of_all = (F.col("least") < MIN_GROUP) & (F.col("n_lang") >= MIN_GROUP), F.lit(least < MIN_GROUP <= total)
    homes = sizes.join(langs, "wider").select("own", by.alias("judged_in"), F.array_compact(F.array(F.when(F.col("n") >= MIN_GROUP, F.col("own")), F.when(of_lang, F.col("wider")), F.when(of_all, F.lit("0")))).alias("fits"))
    homes = _per_group(homes, "homes")
    fit = mcd(tested.join(homes, "own").select(F.explode("fits").alias("fit"), *FEATURES), "fit")
    best = rows.join(homes.select("own", "judged_in"), "own", "left").join(_per_group(fit.withColumnRenamed("fit", "judged_in"), "fits"), "judged_in", "left")
    far = F.expr(f"IF(NOT base_failed, {_distance(FEATURES)}, NULL)")
    return best.select(*rows.columns, "judged_in", far.alias("distance2")).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= CUTOFF))


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "judged_in", F.round("distance2", 3).alias("distance2"))


def kept(docs: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject, each by its own verdict; all columns stay."""
    gone = stored(judged(docs).where("not kept").select("row1", "row2").distinct(), "rejected")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_content(docs))
    return packed.join(side, ["row1", "row2"], "left_anti").select(*[F.col(f"doc.`{c}`") for c in docs.columns])
