"""Quality rules: fixed limits first, then robust multivariate outliers per language and source.

For each group a minimum-covariance-determinant estimate (Rousseeuw and Van Driessen, 1999) is searched by concentration
steps: the half of the rows nearest to the current centre, in the current covariance, gives the next centre and covariance,
whose determinant is not larger. All starts (medians, all rows, small draws of rows) take two steps in one pass each, the
two of least determinant go on until it falls no more, and the least one is kept. Rows near to it then give the final
estimate. A document goes when the squared Mahalanobis distance of its transformed statistics exceeds ``cutoff``.
Everything is DataFrame functions. A step needs no sort of rows: distances are counted in narrow bins with the sums of each
bin, so a group of any size is pre-aggregated before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, words, written

#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"
#: Limits of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: The statistics and, for each, the standard deviation below which spread is not believed.
FLOORS = {"x_length": 0.06, "x_symbols": 0.03, "x_lines": 0.06, "x_repeats": 0.06}
#: Share of a group that an estimate rests on, most concentration steps, bins per unit of ln(d^2), rows of a drawn start.
CORE, STEPS, BINS, DRAWN = 0.5, 20, 16, 12
#: Squared distances: what 0.975 of a four-variate normal keep within, for the final estimate, and what one in 10^8 exceeds,
#: which rejects: the chance of any false rejection among a million documents of such a group is one in a hundred.
NEAR_SHARE, NEAR, CUTOFF = 0.975, 11.14, 43.2
#: Groups with fewer rows are pooled per language.
MIN_GROUP = 30

_POS_BITS = 21
#: A character that is part of a word.
NOT_BREAK = r"[^\x20\x09-\x0D]"


def _neighbours(rows: DataFrame, name: str, key, place) -> DataFrame:
    """Turns the sorted array ``name`` into the (place, place before) pairs of elements with equal keys."""
    shifted = f"{name}_shifted"  # the array itself, one place later, so that no lambda looks into an array by index
    rows = rows.withColumn(shifted, F.slice(name, 1, F.greatest(F.size(name) - 1, F.lit(0))))
    both = F.arrays_zip(F.slice(name, 2, F.greatest(F.size(name) - 1, F.lit(0))).alias("x"), F.col(shifted).alias("y"))
    near = F.filter(both, lambda z: key(z["x"]) == key(z["y"]))
    return rows.withColumn(name, F.transform(near, lambda z: F.struct(place(z["x"]).alias("p"), place(z["y"]).alias("q")))).drop(shifted)


def with_repeated_words(rows: DataFrame, words_col: str, out_col: str) -> DataFrame:
    """Adds the number of words that lie in a three-word window found twice or more in the array ``words_col``.

    Windows are compared by 43 bits of a hash, sorted together with their places as plain longs; neighbours with equal
    bits are compared word by word, and an array with a false neighbour, or with over two million words, is done again
    by the windows themselves. Each array is a column of its own, as a lambda would make it anew for every element.
    """
    w, mask = F.col(words_col), (1 << _POS_BITS) - 1
    n = F.size(w)
    at = F.sequence(F.lit(0), n - 3)
    long, short = n > 1 << _POS_BITS, n < 3
    hashed = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("q_hits", F.when(~long & ~short, F.sort_array(hashed)))
    rows = _neighbours(rows, "q_hits", lambda x: F.shiftright(x, _POS_BITS), lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))
    differ = lambda z: F.concat_ws(" ", F.slice(w, z["p"] + 1, 3)) != F.concat_ws(" ", F.slice(w, z["q"] + 1, 3))
    again = long | F.coalesce(F.exists("q_hits", differ), F.lit(False))
    grams = F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, 3)).alias("g"), i.alias("p")))
    rows = rows.withColumn("q_again", F.when(again, F.array_sort(grams)))
    rows = _neighbours(rows, "q_again", lambda x: x["g"], lambda x: x["p"])
    found = F.coalesce("q_again", "q_hits")
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda z: F.array(z["p"], z["q"])))))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum"))
    count = F.aggregate(places, start, step, lambda acc: acc["sum"])
    return rows.withColumn(out_col, F.coalesce(count, F.lit(0).cast("long"))).drop("q_hits", "q_again")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base statistics of each whole text (null counts as without words) in columns that start with ``q_``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_words = docs.withColumn("q_text", text).withColumn("q_words", words(F.col("q_text")))
    lines = F.filter(F.split("q_text", "\n"), lambda line: line.rlike(NOT_BREAK))
    counted = with_words.withColumn("q_lines", lines).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "q_words",
        F.size("q_words").cast("long").alias("q_n_words"),
        F.length(F.translate("q_text", "\x20\x09\x0a\x0b\x0c\x0d", "")).cast("long").alias("q_word_chars"),
        (F.length("q_text") - F.length(F.translate("q_text", SYMBOLS, ""))).cast("long").alias("q_n_symbols"),
        F.size("q_lines").cast("long").alias("q_n_lines"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("q_n_dup_lines"),
    )
    counted = with_repeated_words(counted, "q_words", "q_n_repeat_words").drop("q_words")
    n = F.col("q_n_words")
    return counted.withColumn("q_base_failed", (n < MIN_WORDS) | (F.col("q_n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT))


def transformed() -> list[Column]:
    """The statistic vector: log length of words, log symbols a word, shares of repeated lines and words."""
    n = F.greatest(F.col("q_n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("q_n_lines"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("q_word_chars"), F.lit(1)) / n).alias("x_length"),
        F.log1p(F.col("q_n_symbols") / n).alias("x_symbols"),
        (F.col("q_n_dup_lines") / lines).alias("x_lines"),
        (F.col("q_n_repeat_words") / n).alias("x_repeats"),
    ]


def core_factor(core: float) -> float:
    """What makes the covariance of the nearest ``core`` share of a four-variate normal that of the whole."""
    below, above = 0.0, 100.0
    for _ in range(80):
        q = (below + above) / 2
        below, above = (q, above) if 1 - math.exp(-q / 2) * (1 + q / 2) < core else (below, q)
    return core / (1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8))


def _distance(names: list[str]) -> Column:
    """Squared distance from the group's ``m_`` in its ``l_`` (a lower Cholesky factor)."""
    solved: list[Column] = []
    for i, a in enumerate(names):
        rest = F.col(a) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l_{i}{i}"))
    total = solved[0] * solved[0]
    for s in solved[1:]:
        total = total + s * s
    return total


_GROUP = ["g_lang", "g_source"]


def _sums(names: list[str]) -> list[Column]:
    """``n, s_i, s_ij``: what a centre and a covariance are made of."""
    k = range(len(names))
    return [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s_{i}{j}") for i in k for j in k if j <= i]]


def _with_factor(moments: DataFrame, names: list[str], scale: float) -> DataFrame:
    """Centre, Cholesky factor and half the logarithm of the determinant from ``n, s_i, s_ij``; no variance is below its floor."""
    k = range(len(names))
    keys = [c for c in (*_GROUP, "start") if c in moments.columns]
    out = moments.withColumns({f"m_{i}": F.col(f"s_{i}") / F.col("n") for i in k})
    cov = {(i, j): scale * (F.col(f"s_{i}{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) for i in k for j in k if j <= i}
    out = out.withColumns({f"c_{i}{j}": F.greatest(c, F.lit(FLOORS[names[i]] ** 2)) if i == j else c for (i, j), c in cov.items()})
    for j in k:
        square = F.col(f"c_{j}{j}")
        for t in range(j):
            square = square - F.col(f"l_{j}{t}") * F.col(f"l_{j}{t}")
        out = out.withColumn(f"l_{j}{j}", F.sqrt(F.greatest(square, F.lit(FLOORS[names[j]] ** 2 / 4))))
        below = {}
        for i in range(j + 1, len(names)):
            rest = F.col(f"c_{i}{j}")
            for t in range(j):
                rest = rest - F.col(f"l_{i}{t}") * F.col(f"l_{j}{t}")
            below[f"l_{i}{j}"] = rest / F.col(f"l_{j}{j}")
        out = out.withColumns(below) if below else out
    det = F.log("l_00")
    for i in k[1:]:
        det = det + F.log(f"l_{i}{i}")
    return out.select(*keys, *[f"m_{i}" for i in k], *[f"l_{i}{j}" for i in k for j in k if j <= i], det.alias("det"))


def _starts(rows: DataFrame, names: list[str]) -> DataFrame:
    """The starts of every group: medians with the floors doubled, all rows, two draws of some rows by hash."""
    k = range(len(names))
    whole = written(rows.groupBy(*_GROUP).agg(*_sums(names), *[F.percentile_approx(c, 0.5, 2000).alias(f"median_{i}") for i, c in enumerate(names)]), "moments")
    nominal = {f"l_{i}{j}": F.lit(2 * FLOORS[names[i]] if i == j else 0.0) for i in k for j in k if j <= i}
    medians = whole.select(*_GROUP, F.lit(0).alias("start"), *[F.col(f"median_{i}").alias(f"m_{i}") for i in k]).withColumns({**nominal, "det": F.lit(0.0)})
    draw = F.pmod(F.xxhash64(*names), F.greatest(F.lit(1), F.floor(F.col("n") / DRAWN)))
    drawn = rows.join(whole.select(*_GROUP, "n"), _GROUP).select(*_GROUP, *names, draw.alias("draw")).filter("draw < 2")
    few = drawn.groupBy(*_GROUP, (F.col("draw") + 2).cast("int").alias("start")).agg(*_sums(names))
    every = whole.select(*_GROUP, F.lit(1).alias("start"), *[c for c in whole.columns if c == "n" or c.startswith("s_")])
    return medians.unionByName(_with_factor(every.unionByName(few), names, 1.0))


def estimates(rows: DataFrame, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """A centre and a factor for each ``g_lang, g_source`` of ``rows``; a written table with one short row per group."""
    names = list(FLOORS)
    by = [*_GROUP, "start"]
    sums = [c for c in _sums(names)]
    now = written(_starts(rows, names), "centres")
    for at in range(steps):
        binned = rows.join(now, _GROUP).withColumn("bin", F.floor(F.log(_distance(names) + 1e-9) * BINS).cast("int"))
        bins = binned.groupBy(*by, "bin").agg(*sums)
        whole = Window.partitionBy(*by)
        bins = bins.withColumns({"before": F.sum("n").over(whole.orderBy("bin")) - F.col("n"), "all": F.sum("n").over(whole)})
        kept = bins.filter(F.col("before") < F.col("all") * core)
        moments = kept.groupBy(*by).agg(*[F.sum(c).alias(c) for c in bins.columns if c == "n" or c.startswith("s_")])
        new = _with_factor(moments, names, core_factor(core)).join(now.select(*by, F.col("det").alias("last_det")), by)
        if at == 1:
            best = Window.partitionBy(*_GROUP).orderBy("det", "start")
            new = new.withColumn("place", F.row_number().over(best)).filter("place <= 2").drop("place")
        last, now = now, written(new, "centres")
        drop_written(last)
        # bins make a step coarse, so that the determinant may also rise a little in the end
        if at > 1 and now.filter("det < last_det - 1e-3").isEmpty():
            break
    least = now.groupBy(*_GROUP).agg(F.min(F.struct("det", "start", *[c for c in now.columns if c[:2] in ("m_", "l_")])).alias("b")).select(*_GROUP, "b.*").drop("start", "det")
    least = written(least, "centres")
    drop_written(now)
    near = rows.join(least, _GROUP).filter(_distance(names) <= NEAR).groupBy(*_GROUP).agg(*sums)
    return written(_with_factor(near, names, core_factor(NEAR_SHARE)).drop("det"), "centres")


def _measured(docs: DataFrame, carried: list[Column], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``carried`` with the statistics, ``lang_key`` and ``source_key`` of each row."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(g) for c, g in ((lang_col, "lang_key"), (source_col, "source_key"))]
    counted = statistics(docs.select(*carried, F.col(text_col).alias("q_body"), *keys), "q_body").drop("q_body")
    counted = counted.select("*", *transformed())
    # an array of one struct, laid out again: a generator lets no filter through, which would put the statistics in its place
    figures = [c for c in counted.columns if c.startswith(("q_n_", "q_word_", "q_base_", "x_"))]
    return counted.select(*[c for c in counted.columns if c not in figures], F.inline(F.array(F.struct(*figures))))


def _scored(counted: DataFrame, known: DataFrame, cutoff: float, min_group: int) -> DataFrame:
    """Adds ``d2`` and ``q_kept`` to ``counted`` rows by the estimates over ``known``, a written table of the same statistics.

    Sizes and estimates are short rows, which Spark sends to all tasks unless they are many.
    """
    sizes = known.filter(~F.col("q_base_failed")).groupBy("lang_key", "source_key").agg(F.count(F.lit(1)).alias("rows"))
    sizes = written(sizes, "sizes")
    small = F.coalesce(F.col("rows"), F.lit(0)) < min_group
    grouped = lambda df: df.join(sizes, ["lang_key", "source_key"], "left").select("*", F.col("lang_key").alias("g_lang"), F.when(small, "\x01").otherwise(F.col("source_key")).alias("g_source"))
    found = estimates(grouped(known.filter(~F.col("q_base_failed"))).select(*_GROUP, *FLOORS))
    scored = grouped(counted).join(found, _GROUP, "left").withColumn("d2", F.when(~F.col("q_base_failed"), _distance(list(FLOORS))))
    return scored.withColumn("q_kept", ~F.col("q_base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff))


def judge(
    docs: DataFrame,
    cutoff: float = CUTOFF,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept``.

    ``d2`` is null where the base rules fail. Null languages and sources form groups of their own; groups under
    ``min_group`` rows are pooled per language. Null and empty texts fail the base rules. Repeated rows and ids are
    judged row by row; other columns of ``docs`` are not read. An empty table gives no rows.
    """
    counted = written(_measured(docs, [F.col(id_col).alias("doc_id")], text_col, lang_col, source_col), "statistics")
    scored = _scored(counted, counted, cutoff, min_group)
    return scored.select(
        "doc_id",
        *[F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        "d2",
        F.col("q_kept").alias("kept"),
    )


def keep_good(
    docs: DataFrame,
    cutoff: float = CUTOFF,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, each by its own verdict, whatever their identifiers.

    The statistics are written without the texts for the estimates, and made again where the rows are judged, so no text is
    shuffled or written twice.
    """
    known = written(_measured(docs, [], text_col, lang_col, source_col), "statistics")
    rows = _measured(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row")], text_col, lang_col, source_col)
    return _scored(rows, known, cutoff, min_group).filter("q_kept").select("q_row.*")
