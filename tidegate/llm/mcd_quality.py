"""Quality rules: robust multivariate outliers by minimum covariance determinant, in built-in expressions.

Each document becomes a vector of transformed statistics in fixed point.  For every language
and source the share SUPPORT of the documents whose covariance has the least determinant is
sought (Rousseeuw and Van Driessen, 1999): several starts, the median with the median
absolute deviations and small subsets drawn by hash, take concentration steps (mean and
covariance of the closest documents); the start of the least determinant goes on until no
step lowers it.  Documents far from that centre by Mahalanobis distance are rejected.
Languages and sources of few documents are judged by the language's estimate, or by that of
all documents.

Rows are summed by group and distance level, so a large group costs no task more than its
few hundred levels.  All sums are sums of integers and all quantiles exact quantiles of
integers, so a result does not depend on how rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import GAP_CHARS, materialize, null_coded, text_or_empty, words_of

MIN_WORDS = 50
#: Statistics are kept in units of 1/SCALE.
SCALE = 1024
SUPPORT = 0.75
#: Subsets drawn as starts beside the medians, about how many documents each has, and of how many of a group's they
#: are drawn and first concentrated: a subset without outliers has to be among them.
SUBSETS, SUBSET, SAMPLE = 32, 7, 320
#: Starts that go on with the whole group.
KEPT = 4
#: Concentration steps of every start, and at most of the best one after these.
FIRST_STEPS, MORE_STEPS = 2, 20
#: Documents an estimate needs; a group of fewer is judged by its language, a language of fewer by all documents.
LEAST = 50
#: A line told twice is no sign of a bad document: repeated lines beyond one and repeated words beyond these count.
LONE_LINES, LONE_WORDS = 1, 40
#: Squared distance beyond which a document goes: the chi-square quantile of five degrees of freedom at 1 - 1e-5.
CUTOFF = 30.856
#: Least standard deviations of the five statistics, for groups whose own hardly vary.
FLOOR = (0.05, 0.05, 0.04, 0.08, 0.08)
#: At p = 5 a normal sample's inner SUPPORT has covariance 1/CONSISTENCY of the whole.
CONSISTENCY = 1.41
NAMES = ("x1", "x2", "x3", "x4", "x5")
_P = len(NAMES)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, keys of the group and its language, counts and base verdict of each row (null and empty texts: all 0, failed)."""
    text = text_or_empty(docs["text"])
    lang = null_coded(docs["lang"])
    base = docs.select(docs["doc_id"], F.to_json(F.array(lang, null_coded(docs["source"]))).alias("_group"), F.to_json(F.array(lang)).alias("_lang"), text.alias("_text"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(GAP_CHARS)) != "")
    base = base.withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", lines)
    n = F.size("_words")
    tail = lambda k: F.slice("_words", F.lit(k), F.greatest(n - 2, F.lit(0)))
    triples = F.zip_with(F.zip_with(tail(1), tail(2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), tail(3), lambda ab, c: F.xxhash64(ab["a"], ab["b"], c))
    at = F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    base = base.select(
        "doc_id", "_group", "_lang",
        n.cast("long").alias("n_words"),
        F.length(F.translate("_text", GAP_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.array_sort(at).alias("_sorted"),
    )
    # Equal windows stand side by side once sorted; each covers three words.
    n = F.greatest(F.size("_sorted") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_sorted", F.lit(1), n), F.slice("_sorted", F.lit(2), n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.flatten(F.filter(pairs, lambda x: x.isNotNull()))
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    base = base.withColumn("n_repeat_words", covered.cast("long")).drop("_sorted")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    words = F.greatest("n_words", F.lit(1)).cast("double")
    beyond = lambda n, lone: F.greatest(F.col(n) - lone, F.lit(0))
    vector = (
        F.log(F.log(F.greatest(words, F.lit(3.0)))),  # lengths spread over decades
        F.log((F.col("word_chars") + 1) / words),
        F.sqrt((F.col("n_symbols") + 0.375) / (words + 0.75)),
        F.sqrt(beyond("n_dup_lines", LONE_LINES) / F.greatest("_n_lines", F.lit(1))),
        F.sqrt(beyond("n_repeat_words", LONE_WORDS) / words),
    )
    fixed = [F.round(v * SCALE).cast("long").alias(x) for v, x in zip(vector, NAMES, strict=True)]
    return base.withColumn("base_failed", failed).select(
        "doc_id", "_group", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *fixed
    )


_ALL = "[]"
_CELLS = [(i, j) for i in range(_P) for j in range(i + 1)]


def _moments() -> dict[str, Column]:
    """Sums that give a mean and a covariance."""
    return {f"s{i}": F.col(x) for i, x in enumerate(NAMES)} | {f"q{i}{j}": F.col(NAMES[i]) * F.col(NAMES[j]) for i, j in _CELLS}


def _estimated(sums: DataFrame, h: str, factor: float, *keys: str) -> DataFrame:
    """keys, centre m0.., lower Cholesky factor l_i_j and logdet of the covariance, from sums over ``h`` documents."""
    mean = {i: F.col(f"s{i}") / F.col(h) for i in range(_P)}
    cov = {(i, j): (F.col(f"q{i}{j}") / F.col(h) - mean[i] * mean[j]) / SCALE**2 * factor for i, j in _CELLS}
    least = {(i, j): F.greatest(c, F.lit(FLOOR[i] ** 2)) if i == j else c for (i, j), c in cov.items()}
    df = sums.select(*keys, *[(mean[i] / SCALE).alias(f"m{i}") for i in range(_P)], *[c.alias(f"v{i}{j}") for (i, j), c in least.items()])
    for i, j in _CELLS:
        rest = F.col(f"v{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return df.withColumn("logdet", sum((2 * F.log(f"l_{i}_{i}") for i in range(1, _P)), 2 * F.log("l_0_0"))).drop(*[f"v{i}{j}" for i, j in _CELLS])


def distance() -> Column:
    """Squared Mahalanobis distance from columns x1.., m0.. and the factor l_i_j, by forward substitution."""
    y: list[Column] = []
    for i in range(_P):
        z = F.col(NAMES[i]) / SCALE - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * y[k]
        y.append(z / F.col(f"l_{i}_{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _levels(d2: Column) -> Column:
    """Squared distances in steps of 1/32 of an octave, as integers: a small exact histogram for each group."""
    return F.round(F.log2(F.lit(1.0) + 1024 * F.least(d2, F.lit(1e12))) * 32).cast("int")


_STATE = [*(f"m{i}" for i in range(_P)), *(f"l_{i}_{j}" for i, j in _CELLS), "logdet"]


#: Estimates that a task is told whole; more are dealt by group, a group's documents over SALTS tasks.
TOLD, SALTS = 50_000, 32


def _with_estimates(vectors: DataFrame, now: DataFrame, how: str = "inner") -> DataFrame:
    """``vectors`` joined with the estimates of their groups, of which there are a few rows a group."""
    if now.count() <= TOLD:
        return vectors.join(F.broadcast(now), "_group", how)
    salted = now.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return vectors.withColumn("_salt", F.pmod("_draw", F.lit(SALTS)).cast("int")).join(salted, ["_group", "_salt"], how).drop("_salt")


def _starts(vectors: DataFrame) -> DataFrame:
    """(_group, _start, n, centre, factor, logdet): medians with their deviations (0), and the best of subsets drawn by hash (1 and on).

    Subsets are small, so that some hold no outlier, and many; they are drawn from, and
    concentrated on, a sample of each group that its hashes draw, of a size that doesn't
    grow.  The best by determinant go on with the whole group.
    """
    middle = materialize(vectors.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(x, F.lit(0.5)).alias(f"c{i}") for i, x in enumerate(NAMES)]), "mcd")
    off = _with_estimates(vectors, middle.drop("n")).select("_group", *[F.abs(F.col(x) - F.col(f"c{i}")).cast("long").alias(x) for i, x in enumerate(NAMES)])
    spread = off.groupBy("_group").agg(*[F.percentile(x, F.lit(0.5)).alias(f"s{i}") for i, x in enumerate(NAMES)])
    wide = [F.greatest(F.col(f"s{i}") / SCALE * 1.4826, F.lit(FLOOR[i])) for i in range(_P)]
    medians = middle.join(spread, "_group").select(
        "_group", F.lit(0).alias("_start"), "n",
        *[(F.col(f"c{i}") / SCALE).alias(f"m{i}") for i in range(_P)],
        *[(wide[i] if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i, j in _CELLS],
        F.lit(float("inf")).alias("logdet"),
    )
    draw = lambda k: F.shiftrightunsigned(F.xxhash64("_draw", k), 33) / F.lit(2.0**31)
    sample = materialize(_with_estimates(vectors, middle.select("_group", "n")).where(draw(F.lit(0)) * F.col("n") < SAMPLE), "mcd")
    some = sample.withColumn("_start", F.explode(F.sequence(F.lit(1), F.lit(SUBSETS)))).where(draw(F.col("_start")) * F.least("n", F.lit(SAMPLE)) < SUBSET)
    sums = some.groupBy("_group", "_start").agg(F.count(F.lit(1)).alias("h"), F.first("n").alias("n"), *[F.sum(v).alias(k) for k, v in _moments().items()])
    drawn = _estimated(sums, "h", 1.0, "_group", "_start", "n").withColumns({"logdet": F.lit(float("inf")), "done": F.lit(False)})
    drawn = materialize(drawn, "mcd")
    for _ in range(FIRST_STEPS):
        drawn = _advance(sample.drop("n"), drawn)
    best = Window.partitionBy("_group").orderBy("logdet", "_start")  # a row a start
    drawn = drawn.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= KEPT).drop("_rank", "done")
    # Determinants of samples don't compare with those of whole groups.
    return medians.unionByName(drawn.withColumn("logdet", F.lit(float("inf"))))


def _concentrate(vectors: DataFrame, now: DataFrame) -> DataFrame:
    """One concentration step of each start: mean and covariance of its group's closest SUPPORT.

    Rows are summed by group and distance level before the exchange; only those sums are
    ordered by level.  Of the level where the support ends the needed share is taken.
    """
    far = _with_estimates(vectors, now).select("_group", "_start", *NAMES, _levels(distance()).alias("_far"))
    sums = _moments()
    level = far.groupBy("_group", "_start", "_far").agg(F.count(F.lit(1)).alias("h"), *[F.sum(v).alias(k) for k, v in sums.items()])
    group = Window.partitionBy("_group", "_start")
    level = level.withColumn("_before", F.sum("h").over(group.orderBy("_far")) - F.col("h")).withColumn("_most", F.ceil(F.sum("h").over(group) * F.lit(SUPPORT)))
    whole = F.col("_before") + F.col("h") <= F.col("_most")
    share = F.max(F.when(~whole, (F.col("_most") - F.col("_before")) / F.col("h")))  # of one level at most
    part = lambda k: F.coalesce(F.sum(F.when(whole, F.col(k))), F.lit(0)) + F.coalesce(F.max(F.when(~whole, F.col(k))) * share, F.lit(0.0))
    near = level.where(F.col("_before") < F.col("_most")).groupBy("_group", "_start").agg(F.max("_most").alias("h"), *[part(k).alias(k) for k in sums])
    return _estimated(near, "h", CONSISTENCY, "_group", "_start")


def _advance(vectors: DataFrame, now: DataFrame) -> DataFrame:
    """``now`` after a step of the starts that still move; a step that doesn't lower the determinant is not taken and ends its start."""
    new = _concentrate(vectors, now.where("NOT done").select("_group", "_start", *_STATE))
    both = now.join(new.select("_group", "_start", *[F.col(c).alias(f"_{c}") for c in _STATE]), ["_group", "_start"], "left")
    lower = F.coalesce(F.col("_logdet") < F.col("logdet") - 1e-9, F.lit(False))
    return materialize(both.select("_group", "_start", "n", *[F.when(lower, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in _STATE], (~lower).alias("done")), "mcd")


def fit(vectors: DataFrame) -> DataFrame:
    """(_group, n, centre m0.., factor l_i_j, logdet) of each group of rows (_group, _draw, x1..): the best start's, after its last step that helped."""
    now = materialize(_starts(vectors).withColumn("done", F.lit(False)), "mcd")
    for _ in range(FIRST_STEPS):
        now = _advance(vectors, now)
    best = Window.partitionBy("_group").orderBy("logdet", "_start")  # a row a start
    now = materialize(now.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank"), "mcd")
    for _ in range(MORE_STEPS):
        if now.where("NOT done").isEmpty():
            break
        now = _advance(vectors, now)
    return now.drop("_start", "done")


def estimates(stats: DataFrame) -> DataFrame:
    """One row a language and source: the estimate that judges it, its own or its language's or that of all documents.

    Only rows that pass the base rule count; _draw, a hash of the row, draws the starts.  No
    row where even all are fewer than LEAST.
    """
    passed = stats.where(~F.col("base_failed"))
    vectors = passed.select(F.explode(F.array("_group", "_lang", F.lit(_ALL))).alias("_group"), "_draw", *NAMES)
    small = passed.groupBy("_group", "_lang").agg(F.count(F.lit(1)).alias("n"))
    by_lang = small.groupBy("_lang").agg(F.sum("n").alias("n_lang"))
    judge = F.when(F.col("n") >= LEAST, F.col("_group")).when(F.col("n_lang") >= LEAST, F.col("_lang")).otherwise(F.lit(_ALL))
    found = fit(vectors).where(F.col("n") >= LEAST).withColumnRenamed("_group", "_judge").drop("n")
    return small.join(by_lang, "_lang").select("_group", judge.alias("_judge")).join(found, "_judge")


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Statistics, ``distance2`` and ``kept`` for each row of ``docs`` (doc_id, text, lang, source; others are left out).

    kept is false where the base rule fails (under 50 words, or over half of the words in
    repeated windows) or distance2 exceeds ``cutoff``.  Null languages and sources form
    groups of their own.  Where fewer than LEAST documents pass at all there is no distance
    and all of them are kept.  Repeated rows and null doc_ids are judged like others; an
    empty table gives none.
    """
    stats = materialize(statistics(docs).withColumn("_draw", F.xxhash64("doc_id", "n_words", "word_chars")), "stats")
    found = _with_estimates(stats, materialize(estimates(stats), "mcd"), "left")
    return found.withColumn("distance2", F.when(~F.col("base_failed"), distance())).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cutoff)).alias("kept"),
        "distance2",
    )
