"""Quality rules: base rules, then robust multivariate outliers, with DataFrame functions only.

Documents that pass the base rules give a vector of transformed statistics on
an integer grid.  For each language and source, the minimum-covariance-
determinant estimate is searched by concentration steps from three starts:
medians with the least deviations, medians with median absolute deviations,
and mean and covariance of all.  A step takes the half of the documents that
is nearest by the last estimate and estimates from it anew, until no group's
estimate changes or ``STEPS`` are done; of the three results the one with the
smallest determinant stays.  A document whose squared Mahalanobis distance by
it exceeds ``CUTOFF`` is rejected.  No statistic's variance, given those before
it, is taken to be below the square of its least deviation, so that a source
in which nothing varies does not reject the first document that does.

Everything that a step needs of a group is a histogram with sums of products of
integers, so it is aggregated before it is shuffled, does not depend on the
order of rows, and stays small however many rows a source has: distances are
counted in hundredths, up to ``FARTHEST``.  The sums of the nearer half are
those of its distances, so that a step broadcasts once, shuffles twice and
reads the vectors once; every exchange costs the driver memory and a thread.
Estimates are broadcast up to ``BROADCAST`` of them and joined by group beyond.  Groups of under ``SMALL``
documents are pooled by language, a parameter with effect: a source is judged
with its language until it has that many, and by itself from then on.

Null texts have no words and fail the base rules.  Null languages and sources
are groups like others.  Rows are judged one by one, repeated or null ids too;
other columns are ignored unless they are named to be carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lanelytics.llm.common import KEY, keyed, let, stored, whole_text

SPACE, NO_SPACE, SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first occurrence included.

    Windows are told apart by 64-bit hashes of their words.  Sorted by hash,
    repeats are neighbours; each then adds the words that the window before it
    does not hold already.
    """
    last = F.size(words) - 3
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("hash"), i.alias("at")
        ),
    )

    def covered(sorted_windows: Column) -> Column:
        same = lambda window, k: F.coalesce(F.get(sorted_windows, k)["hash"] == window["hash"], F.lit(False))
        repeated = F.filter(sorted_windows, lambda window, k: same(window, k - 1) | same(window, k + 1))
        places = F.sort_array(F.transform(repeated, lambda window: window["at"]))
        start = F.struct(F.lit(0).alias("words"), F.lit(-3).alias("before"))
        add = lambda seen, at: F.struct(
            (seen["words"] + F.least(F.lit(3), at - seen["before"])).alias("words"), at.alias("before")
        )
        return F.aggregate(places, start, add, lambda seen: seen["words"])

    return F.when(last >= 0, let(F.sort_array(windows), covered)).otherwise(0)


def text_counts(text: str = "text") -> Column:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a non-null text."""
    words = F.filter(F.split(text, SPACE), lambda word: word != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NO_SPACE))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda l: F.struct(
            F.size(l).cast("long").alias("n_lines"), (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines")
        ),
    )
    symbols = F.regexp_count(text, F.lit(SYMBOL)).cast("long")
    return F.struct(of_words.alias("words"), of_lines.alias("lines"), symbols.alias("n_symbols"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The frame with the counts; its text column must not be null."""
    return docs.withColumn("counts", text_counts(text)).select(
        *docs.columns, "counts.words.*", "counts.lines.*", "counts.n_symbols"
    )


LEAST_WORDS, MOST_REPEATED = 50, 50
#: Transformed statistics and the least deviation of each.
STATISTICS = {
    "z1": ("round(1000 * ln(word_chars / n_words))", 100),
    "z2": ("round(1000 * sqrt(n_symbols / word_chars))", 40),
    "z3": ("round(1000 * sqrt(n_dup_lines / n_lines))", 130),
    "z4": ("round(1000 * sqrt(n_repeat_words / n_words))", 130),
}
NAMES = tuple(STATISTICS)
#: Squared distance that one in 100,000 normal vectors of four components exceeds.
CUTOFF = 28.47
#: Covariance of normal vectors over that of their nearer half: 0.5 / P(chi2 of 6 <= median of chi2 of 4).
CONSISTENCY = 2.109
#: A median absolute deviation of normal values times this is their standard deviation.
MAD_SCALE = 1.4826
STARTS, STEPS, SMALL, FARTHEST, BROADCAST = 3, 8, 30, 5000, 20_000

_PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i:]]
_LEAST = {name: float(deviation**2) for name, (_, deviation) in STATISTICS.items()}
MEANS, COVARIANCES = tuple(f"m{n[1]}" for n in NAMES), tuple(f"c{a[1]}{b[1]}" for a, b in _PAIRS)
#: Rows of the factors L and D of the covariance, in an order in which each needs only those before it.
FACTORS = (
    ("d1", f"greatest(c11, {_LEAST['z1']}D)"),
    ("l21", "c12 / d1"),
    ("l31", "c13 / d1"),
    ("l41", "c14 / d1"),
    ("d2", f"greatest(c22 - l21 * l21 * d1, {_LEAST['z2']}D)"),
    ("l32", "(c23 - l31 * l21 * d1) / d2"),
    ("l42", "(c24 - l41 * l21 * d1) / d2"),
    ("d3", f"greatest(c33 - l31 * l31 * d1 - l32 * l32 * d2, {_LEAST['z3']}D)"),
    ("l43", "(c34 - l41 * l31 * d1 - l42 * l32 * d2) / d3"),
    ("d4", f"greatest(c44 - l41 * l41 * d1 - l42 * l42 * d2 - l43 * l43 * d3, {_LEAST['z4']}D)"),
)
PARAMETERS = (*MEANS, *(name for name, _ in FACTORS))
#: Forward substitution of a vector and its squared distance.
SUBSTITUTION = (
    ("y1", "z1 - m1"),
    ("y2", "z2 - m2 - l21 * y1"),
    ("y3", "z3 - m3 - l31 * y1 - l32 * y2"),
    ("y4", "z4 - m4 - l41 * y1 - l42 * y2 - l43 * y3"),
    ("square", "y1 * y1 / d1 + y2 * y2 / d2 + y3 * y3 / d3 + y4 * y4 / d4"),
)


def _in_turn(df: DataFrame, expressions: tuple[tuple[str, str], ...]) -> DataFrame:
    for name, expression in expressions:
        df = df.withColumn(name, F.expr(expression))
    return df


def _few(frame: DataFrame) -> bool:
    return frame.count() <= BROADCAST


def _sent(frame: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(frame) if few else frame


def _first_half(histogram: DataFrame, value: str, *by: str) -> DataFrame:
    """The least value of each group up to which at least half of its rows lie."""
    running = F.sum("rows").over(W.partitionBy("grp", *by).orderBy(value))
    total = F.sum("rows").over(W.partitionBy("grp", *by))
    reached = histogram.withColumn("reached", 2 * running >= total).filter("reached")
    return reached.groupBy("grp", *by).agg(F.min(value).alias("half"))


def _middles(vectors: DataFrame, values: list[Column], prefix: str) -> DataFrame:
    """(grp, and a column for each of four values): lower medians."""
    placed = vectors.select("grp", F.posexplode(F.array(*values)).alias("place", "value"))
    histogram = placed.groupBy("grp", "place", "value").agg(F.count("*").alias("rows"))
    halves = _first_half(histogram, "value", "place")
    by_place = [F.max(F.when(F.col("place") == i, F.col("half"))).alias(f"{prefix}{i + 1}") for i in range(len(NAMES))]
    return halves.groupBy("grp").agg(*by_place)


def _sums() -> list[Column]:
    """Aggregates of vectors: their number, their sums and those of their products."""
    products = [F.sum(F.col(a) * F.col(b)).alias(f"s{a[1]}{b[1]}") for a, b in _PAIRS]
    return [F.count("*").alias("n"), *[F.sum(name).alias(f"s{name[1]}") for name in NAMES], *products]


def _moments(sums: DataFrame, scale: float) -> DataFrame:
    """Means and covariances, times a scale, from the sums of each group."""
    means = sums.withColumns({f"m{name[1]}": F.expr(f"s{name[1]} / n") for name in NAMES})
    terms = {f"c{a[1]}{b[1]}": F.expr(f"{scale}D * (s{a[1]}{b[1]} / n - m{a[1]} * m{b[1]})") for a, b in _PAIRS}
    return means.withColumns(terms)


def _starts(vectors: DataFrame, medians: DataFrame, few: bool) -> DataFrame:
    """(grp, start, parameters): where the concentration steps begin."""
    away = vectors.join(_sent(medians, few), "grp")
    deviations = _middles(away, [F.abs(F.col(n) - F.col(f"m{n[1]}")) for n in NAMES], "s")

    def start(number: int, frame: DataFrame, variances: dict[str, Column] | None = None) -> DataFrame:
        if variances is not None:
            frame = frame.withColumns({f"c{a[1]}{b[1]}": variances[a] if a == b else F.lit(0.0) for a, b in _PAIRS})
        return _in_turn(frame, FACTORS).select("grp", F.lit(number).alias("start"), *[F.col(p).cast("double").alias(p) for p in PARAMETERS])

    robust = {n: F.pow(MAD_SCALE * F.col(f"s{n[1]}"), F.lit(2)) for n in NAMES}
    least = start(1, medians, {n: F.lit(value) for n, value in _LEAST.items()})
    return least.unionByName(start(2, deviations.join(_sent(medians, few), "grp"), robust)).unionByName(start(3, _moments(vectors.groupBy("grp").agg(*_sums()), 1.0)))


def _distances(vectors: DataFrame, parameters: DataFrame, few: bool) -> DataFrame:
    return _in_turn(vectors.join(_sent(parameters, few), "grp"), SUBSTITUTION)


def _concentrated(vectors: DataFrame, parameters: DataFrame, few: bool) -> DataFrame:
    """Parameters from the nearer half of each group and start, and a hash of the last ones (before).

    Rows as far as the last one of that half count too.
    """
    away = F.least(F.floor(100 * F.sqrt("square")), F.lit(FARTHEST)).alias("away")
    last = parameters.withColumn("before", F.xxhash64(*PARAMETERS))
    distances = _distances(vectors, last, few).select("grp", "start", *NAMES, away, "before")
    histogram = distances.groupBy("grp", "start", "away").agg(*_sums(), F.min("before").alias("before"))
    group = W.partitionBy("grp", "start")
    nearer = F.sum("n").over(group.orderBy("away")) - F.col("n")
    near = histogram.withColumn("near", 2 * nearer < F.sum("n").over(group)).filter("near")
    sums = [name for name in histogram.columns if name not in ("grp", "start", "away", "before")]
    by_start = near.groupBy("grp", "start").agg(*[F.sum(name).alias(name) for name in sums], F.min("before").alias("before"))
    return _in_turn(_moments(by_start, CONSISTENCY), FACTORS).select("grp", "start", *PARAMETERS, "before")


def estimates(vectors: DataFrame) -> DataFrame:
    """(grp, parameters): of the results of all starts the one with the smallest determinant, the first if several."""
    medians = stored(_middles(vectors, [F.col(name) for name in NAMES], "m"))
    groups = medians.count()
    parameters = stored(_starts(vectors, medians, groups <= BROADCAST))
    for _ in range(STEPS):
        parameters = stored(_concentrated(vectors, parameters, STARTS * groups <= BROADCAST))
        if parameters.filter(F.xxhash64(*PARAMETERS) != F.col("before")).isEmpty():
            break
    found = parameters.withColumn("determinant", F.expr("d1 * d2 * d3 * d4"))
    best = found.groupBy("grp").agg(F.min(F.struct("determinant", "start", *PARAMETERS)).alias("best"))
    return stored(best.select("grp", *[f"best.{p}" for p in PARAMETERS]))


def judge(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with the counts, base_failed and kept, for every row of docs (text, lang, source)."""
    rows = docs.select(
        *carried,
        F.to_json(F.struct("lang", "source", F.lit(False).alias("pool"))).alias("grp"),
        F.to_json(F.struct("lang", F.lit(True).alias("pool"))).alias("pool"),
        whole_text(),
    )
    counted = stored(
        with_counts(rows)
        .drop("text")
        .withColumn(
            "base_failed",
            (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        )
    )
    passed = counted.filter(~F.col("base_failed"))
    sizes = stored(passed.groupBy("grp").agg(F.count("*").alias("rows")))
    grouped = passed.join(_sent(sizes, _few(sizes)), "grp").withColumn("grp", F.when(F.col("rows") < SMALL, F.col("pool")).otherwise(F.col("grp")))
    vectors = stored(
        grouped.select(
            *carried, *COUNTS, "grp", *[F.expr(f"cast({z} as long)").alias(name) for name, (z, _) in STATISTICS.items()]
        )
    )
    best = estimates(vectors)
    judged = _distances(vectors, best, _few(best)).select(*carried, *COUNTS, F.lit(False).alias("base_failed"), (F.col("square") <= CUTOFF).alias("kept"))
    failed = counted.filter("base_failed").select(*carried, *COUNTS, "base_failed", F.lit(False).alias("kept"))
    return judged.unionByName(failed)


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    return judge(docs).drop("n_lines")


def without_rejected(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns; rows with the id and text of a rejected one go too."""
    rows = keyed(docs)
    rejected = judge(rows, KEY).filter(~F.col("kept")).select(*KEY)
    return rows.join(rejected, list(KEY), "left_anti").select(*[F.col(f"`{name}`") for name in docs.columns])
