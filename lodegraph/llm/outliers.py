r"""Quality rules: robust multivariate outliers.

Every text becomes a vector of transformed statistics. For each group (language and source) a minimum-covariance-
determinant estimate gives a centre and a scatter matrix: two deterministic starts (coordinate-wise medians with
scaled deviations, and the half of the texts nearest the median in them), then concentration steps: keep the share
SUPPORT of texts with the least Mahalanobis distances, take their mean and covariance, again, until no determinant
changes; of the starts, the one with the smaller determinant stays. The estimate of n texts is drawn to that of all texts
as PRIOR further texts would draw it, so small groups lean on the whole, at every size by the same rule. A text is
rejected where its squared distance, scaled by the group's median distance, exceeds CUTOFF times what a normal
distribution has. In the distance the statistics of ONE_SIDED count from the centre upwards only: a text isn't rejected for
having fewer symbols or repeats than others.

All of it is DataFrame functions: sums of products are pre-aggregated before each shuffle, quantiles come from counts in
bins, so a hot group costs no more than others; estimates are one row a group and are broadcast where they are few, and
met by a salted join where they are many.

Null and empty texts have no words and fail the base rules; texts of any length are taken whole. Null language or source
is a group of its own; null ids are passed on. Repeated rows are judged each, alike, and ties of distances fall alike. An
empty table gives none; without any text that passes the base rules nothing is kept. Other columns but the text pass
unchanged; those named like the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import SPACES, Scratch, set_aside, text_or_empty, words

SYMBOLS = "#*$%&|<>"
#: STEPS at most, if determinants (their logarithms) still change by more than SETTLED.
SUPPORT, STEPS, SETTLED, PRIOR = 0.75, 6, 0.05, 50.0
#: Estimates of so many groups are broadcast (some 200 bytes each); beyond it rows meet them by a join of SALT parts a group.
BROADCAST_GROUPS, SALT = 50_000, 64
#: Squared distance beyond which a text is out, as a multiple of the dimension's median distance. Of 3,243 labelled clean
#: texts the farthest is at 26, of 318 bad ones that pass the base rules the nearest at 44 (in groups of a few texts; else 180).
CUTOFF = 35.0
FEATURES = ("f_len", "f_word", "f_symbol", "f_line", "f_repeat")
ONE_SIDED = ("f_symbol", "f_line", "f_repeat")
P = len(FEATURES)
#: Median of chi-square with 5 degrees of freedom.
CHI_MEDIAN = 4.351


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    df, restored = set_aside(df, ("__w", "__p", "__d", "__l"))
    t = text_or_empty(text)
    squeezed = F.translate(t, SPACES, "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    out = df.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = out.withColumns({"__w": words(text), "word_chars": F.length(squeezed).cast("long"), "n_symbols": (F.length(squeezed) - F.length(F.translate(squeezed, SYMBOLS, ""))).cast("long"), "__l": lines})
    out = out.withColumns({"n_words": F.size("__w").cast("long"), "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")}).drop("__l")
    room = "cast(greatest(n_words, 1) as bigint)"
    window = "xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2))"
    high = f"shiftrightunsigned({window}, 2)"
    out = out.withColumn("__p", F.expr(f"sort_array(transform(if(n_words < 3, cast(array() as array<int>), sequence(0, cast(n_words as int) - 3)), i -> {high} - pmod({high}, {room}) + i))"))
    place = lambda x: f"cast(pmod({x}, {room}) as int)"

    def equal(a: str, b: str) -> str:
        i, j = place(a), place(b)
        return f"({a} div {room} = {b} div {room} and get(__w, {i}) = get(__w, {j}) and get(__w, {i} + 1) = get(__w, {j} + 1) and get(__w, {i} + 2) = get(__w, {j} + 2))"

    after, before = equal("x", "get(__p, k + 1)"), equal("x", "get(__p, k - 1)")
    found = f"filter(__p, (x, k) -> coalesce({after}, false) or coalesce({before}, false))"
    out = out.withColumn("__d", F.expr(f"sort_array(transform({found}, x -> {place('x')}))"))
    covered = "aggregate(transform(__d, (x, k) -> if(k + 1 < size(__d), least(3, get(__d, k + 1) - x), 3)), 0, (a, x) -> a + x)"
    out = out.withColumn("n_repeat_words", F.expr(covered).cast("long")).drop("__w", "__p", "__d")
    return restored(out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))


def transformed() -> dict[str, Column]:
    """Logarithms that make the statistics of clean texts about normal; the constants keep single events small, as one line
    that a short text repeats."""
    n = F.greatest("n_words", F.lit(1))
    return {
        "f_len": F.log1p("n_words"),
        "f_word": F.log((F.col("word_chars") + 1) / n),
        "f_symbol": F.log(0.02 + F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "f_line": F.log(1 + F.col("n_dup_lines") / 10),
        "f_repeat": F.log(0.1 + F.col("n_repeat_words") / (n + 200)),
    }


def _moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each group: count, means and covariances of the features, ridged so that constant ones do no harm."""
    sums = [F.count(F.lit(1)).cast("double").alias("m")] + [F.avg(f).alias(f"c_{i}") for i, f in enumerate(FEATURES)]
    cross = [F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"x_{i}{j}") for i in range(P) for j in range(i + 1)]
    got = df.groupBy(*keys).agg(*sums, *cross)
    cov = {f"s_{i}{j}": F.greatest(F.col(f"x_{i}{j}") - F.col(f"c_{i}") * F.col(f"c_{j}"), F.lit(0.0)) + 0.01 if i == j else F.col(f"x_{i}{j}") - F.col(f"c_{i}") * F.col(f"c_{j}") for i in range(P) for j in range(i + 1)}
    return got.select(*keys, "m", *(f"c_{i}" for i in range(P)), *(v.alias(k) for k, v in cov.items()))


def _cholesky(df: DataFrame) -> DataFrame:
    """Adds the lower factor's entries l_ij of the covariances s_ij, and the log determinant."""
    out = df
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"s_{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            out = out.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l_{j}{j}"))
    return out.withColumn("logdet", sum((2 * F.log(f"l_{i}{i}") for i in range(1, P)), 2 * F.log("l_00")))


def _meet(df: DataFrame, few: DataFrame, keys: list[str], groups: int, how: str = "inner") -> DataFrame:
    """Rows with their group's row of `few`; no group's rows go to one task."""
    if groups <= BROADCAST_GROUPS:
        return df.join(F.broadcast(few), keys, how)
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return df.withColumn("__salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALT)).cast("int")).join(salted, [*keys, "__salt"], how).drop("__salt")


def _squared(df: DataFrame, one_sided: tuple[str, ...] = ()) -> DataFrame:
    """Adds the squared Mahalanobis distance d2 to rows that met their estimate, by forward substitution."""
    out = df
    for i in range(P):
        rest = F.col(FEATURES[i]) - F.col(f"c_{i}")
        rest = F.greatest(rest, F.lit(0.0)) if FEATURES[i] in one_sided else rest
        for k in range(i):
            rest = rest - F.col(f"l_{i}{k}") * F.col(f"z_{k}")
        out = out.withColumn(f"z_{i}", rest / F.col(f"l_{i}{i}"))
    out = out.withColumn("d2", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, P)), F.col("z_0") * F.col("z_0")))
    return out.drop(*(f"z_{i}" for i in range(P)))


def _quantiles(binned: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, q): of rows (keys, bin) the least bins that hold these shares of a key's rows with those below. Counts in
    bins are pre-aggregated; a key has as many bins as its values' range has steps."""
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy(*keys)
    upto = counts.withColumns({"upto": F.sum("n").over(over.orderBy("bin")), "all": F.sum("n").over(over)})
    return upto.groupBy(*keys).agg(F.array(*(F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))) for share in shares)).alias("q"))


#: Steps to 1 of the bins of statistics, and of distances' logarithms.
FINE, LOG_FINE = 200.0, 64.0
LOG_BIN = f"cast(floor(ln(d2 + 1e-9) * {LOG_FINE}) as int)"


def estimates(points: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """Minimum-covariance-determinant estimate of each group of points (m, c_i, s_ij, l_ij), and the number of groups.

    Both starts run side by side, as a further key. Every step's estimates are one row a group and are written.
    """
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.floor(F.col(f) * FINE).cast("int").alias("bin")) for i, f in enumerate(FEATURES)))).alias("x")
    middle = _quantiles(points.select(*keys, values).select(*keys, "x.f", "x.bin"), [*keys, "f"], [0.25, 0.5, 0.75])
    of = lambda i, k: F.max(F.when(F.col("f") == i, (F.get("q", k) + 0.5) / FINE))
    start = middle.groupBy(*keys).agg(*(of(i, 1).alias(f"c_{i}") for i in range(P)), *((F.greatest((of(i, 2) - of(i, 0)) / 1.349, F.lit(0.1)) if i == j else F.lit(0.0)).alias(f"l_{i}{j}") for i in range(P) for j in range(i + 1)))
    now, run = scratch.save(start.withColumn("start", F.explode(F.array(F.lit(0.5), F.lit(SUPPORT)))), "start"), [*keys, "start"]
    groups = now.count()
    twice = points.withColumn("start", F.explode(F.array(F.lit(0.5), F.lit(SUPPORT))))
    before = None
    for step in range(STEPS):
        placed = _meet(twice, now, run, groups).transform(_squared).select(*run, *FEATURES, F.expr(LOG_BIN).alias("bin"))
        share = F.get("q", F.when(F.col("start") == 0.5, F.lit(0)).otherwise(F.lit(1))) if step == 0 else F.get("q", F.lit(1))
        edges = scratch.save(_quantiles(placed.select(*run, "bin"), run, [0.5, SUPPORT]).select(*run, share.alias("edge")), f"edges{step}")
        now = scratch.save(_cholesky(_moments(_meet(placed, edges, run, groups).where("bin <= edge"), run)), f"estimates{step}")
        if before is not None:
            moved = now.select(*run, "logdet").join(before.select(*run, F.col("logdet").alias("was")), run).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
            if moved is None or moved <= SETTLED:
                break
        before = now
    cells = [c for c in now.columns if c not in run]
    best = now.groupBy(*keys).agg(F.min_by(F.struct(*cells), F.struct("logdet", "start")).alias("best")).select(*keys, "best.*")
    return scratch.save(best, "best"), groups


def with_verdicts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", row: str = "doc_id") -> DataFrame:
    """Adds the base statistics, base_failed, distance (squared, scaled) and kept. Extra columns pass."""
    scratch = Scratch(df.sparkSession)
    keys = ["__g", "__h"]
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
    inner = [*keys, "__salt", "m", "med", "d2", *FEATURES, *(f"{x}_{i}" for x in "cz" for i in range(P)), *(f"{x}_{i}{j}" for x in "slx" for i in range(P) for j in range(i + 1))]
    df, restored = set_aside(df.drop(*new), inner)
    stats = with_statistics(df, text)
    stats = stats.withColumns({"__g": F.coalesce(F.col(lang).cast("string"), F.lit("\u0000")), "__h": F.coalesce(F.col(source).cast("string"), F.lit("\u0000"))})
    stats = scratch.save(stats.drop(text).withColumns(transformed()), "statistics")
    clean = stats.where(~F.col("base_failed")).select(*keys, *FEATURES)
    pooled = [F.lit("").alias("__g"), F.lit("").alias("__h")]
    points = clean.unionByName(clean.select(*pooled, *FEATURES))
    best, groups = estimates(points, keys, scratch)
    numbers = ["m", *(f"c_{i}" for i in range(P)), *(f"s_{i}{j}" for i in range(P) for j in range(i + 1))]
    whole = best.where("__g = '' and __h = ''").select(*(F.col(c).alias(f"w_{c}") for c in numbers))
    drawn = best.join(F.broadcast(whole))
    drawn = drawn.select(*keys, "m", *(((F.col("m") * F.col(c) + PRIOR * F.col(f"w_{c}")) / (F.col("m") + PRIOR)).alias(c) for c in numbers[1:]))
    drawn = scratch.save(_cholesky(drawn), "drawn")
    far = _meet(points, drawn, keys, groups).transform(_squared, ONE_SIDED)
    medians = scratch.save(_quantiles(far.select(*keys, F.expr(LOG_BIN).alias("bin")), keys, [0.5]).select(*keys, F.exp((F.get("q", 0) + 0.5) / LOG_FINE).alias("own")), "medians")
    overall = medians.where("__g = '' and __h = ''").select(F.col("own").alias("whole"))
    scale = drawn.join(medians, keys).join(F.broadcast(overall)).withColumn("med", (F.col("m") * F.col("own") + PRIOR * F.col("whole")) / (F.col("m") + PRIOR))
    scale = scratch.save(scale.select(*keys, "med", *(f"c_{i}" for i in range(P)), *(f"l_{i}{j}" for i in range(P) for j in range(i + 1))), "scale")
    judged = _meet(stats, scale, keys, groups, "left").transform(_squared, ONE_SIDED)
    judged = judged.withColumn("distance", F.round(F.col("d2") / F.greatest(F.col("med"), F.lit(0.5)) * CHI_MEDIAN, 6))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF * CHI_MEDIAN))
    return restored(judged.select(*(c for c in df.columns if c != text), *new))
