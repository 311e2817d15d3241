"""Tables behind profile, heatmap and ranking charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayloom.functions.text import finite_or_null
from assayloom.operators.screening import category_scores, paginate, with_group
from assayloom.rules import CATEGORIES, PHYSICOCHEMICAL, flag_score
from assayloom.session import cut

PROPERTIES = ("MW", "LogP", "HBD", "HBA")


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with every listed column present."""
    return df.dropna(subset=cols)


def _wide_scores(flags: DataFrame) -> DataFrame:
    cats = [c for c in CATEGORIES if c != PHYSICOCHEMICAL]
    return category_scores(flags).groupBy("ligand").pivot("category", cats).agg(F.first("score"))


def combined_profile(stats: DataFrame, lipinski: DataFrame, flags: DataFrame) -> DataFrame:
    """Per ligand the row of its best receptor, with the four properties and the category scores; incomplete rows left out."""
    rows = stats.join(lipinski.select("ligand", *PROPERTIES), "ligand").join(_wide_scores(flags), "ligand")
    criteria = ["affinity_best", *PROPERTIES, *[c for c in CATEGORIES if c != PHYSICOCHEMICAL]]
    rows = complete_cases(rows, criteria).select("ligand", "receptor", *criteria)
    row = F.struct(*rows.columns)
    return rows.groupBy("ligand").agg(F.min_by(row, F.struct("affinity_best", "receptor")).alias("r")).select("r.*")


def group_profile(stats: DataFrame, lipinski: DataFrame, flags: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean of every criterion per group; only groups having all of them, and only when there are at least two."""
    best = stats.groupBy("ligand").agg(F.min("affinity_best").alias("affinity_best")).where("affinity_best is not null")
    criteria = ["affinity_best", *PROPERTIES, *[c for c in CATEGORIES if c != PHYSICOCHEMICAL]]
    rows = best.join(lipinski.select("ligand", *PROPERTIES), "ligand", "left").join(_wide_scores(flags), "ligand", "left")
    means = with_group(rows, groups).groupBy("group").agg(*[F.avg(c).alias(c) for c in criteria]).dropna(subset=criteria)
    enough = means.agg((F.count(F.lit(1)) >= 2).alias("ok")).scalar()
    return means.where(enough)


def zscore_properties(df: DataFrame, props: list[str], key: str = "ligand") -> DataFrame:
    """Per-property z values over the complete rows; a constant property becomes 0."""
    rows = complete_cases(df, props).select(key, *props)
    one = rows.agg(F.struct(*[F.struct(F.avg(p).alias("m"), F.stddev_pop(p).alias("s")).alias(p) for p in props]).alias("x")).scalar()
    rows = rows.withColumn("_x", one)
    z = lambda p: ((F.col(p) - F.col("_x")[p]["m"]) / F.when(F.col("_x")[p]["s"] == 0, 1.0).otherwise(F.col("_x")[p]["s"])).alias(p)
    return rows.select(key, *[z(p) for p in props])


def profile_minmax(df: DataFrame, criteria: list[str], lower_is_better: set[str] = frozenset(), absolute: set[str] = frozenset(),
                   key: str = "ligand") -> DataFrame:
    """Criteria on 0..1, inverted where lower is better; a constant one is 0.5; absolute ones are only clipped."""
    rows = complete_cases(df, criteria)
    one = rows.agg(F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in criteria]).alias("x")).scalar()
    rows = rows.withColumn("_x", one)

    def scaled(c: str) -> Column:
        v = F.col(c)
        if c in absolute:
            v = 1 - v if c in lower_is_better else v
            return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).alias(c)
        lo, hi = F.col("_x")[c]["lo"], F.col("_x")[c]["hi"]
        part = (hi - v) if c in lower_is_better else (v - lo)
        return F.when(hi > lo, part / (hi - lo)).otherwise(0.5).alias(c)

    keep = [c for c in rows.columns if c not in criteria and c != "_x"]
    return rows.select(*keep, *[scaled(c) for c in criteria])


def value_range(df: DataFrame, value: str = "value") -> DataFrame:
    """Smallest and largest finite value; equal ends are widened by one."""
    v = finite_or_null(value)
    return (df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).where("lo is not null")
            .withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1.0).otherwise(F.col("hi"))))


def rank_profiles(profile: DataFrame, criteria: list[str], rank_by: str | None = None, per_page: int = 8,
                  pinned: list[str] = (), max_pages: int | None = None, max_pinned: int | None = None, key: str = "ligand", ord_col: str = "ord") -> DataFrame:
    """Rows by criterion or mean, split into pages; pinned rows are repeated on every page.

    All pages and pins are given; ``max_pages`` (5 makes a report of charts) and ``max_pinned`` (3) keep the first ones only.
    """
    score = F.col(rank_by) if rank_by in criteria else reduce(lambda a, c: a + F.col(c), criteria[1:], F.col(criteria[0])) / len(criteria)
    # one small row per profile is kept: the ranking below reads it several times
    rows = cut(profile.select(key, ord_col, score.alias("score")).withColumn("_down", -F.col("score")))
    shown = rows.where(F.col(key).isin(list(pinned))) if pinned else None
    if shown is not None and max_pinned is not None:
        shown = shown.orderBy("_down", ord_col).limit(max_pinned)
    n_pinned = shown.count() if shown is not None else 0
    rest = rows if shown is None else rows.join(shown.select(key), key, "left_anti")
    paged = paginate(rest, ["_down", ord_col], max(1, per_page - n_pinned))
    paged = paged if max_pages is None else paged.where(F.col("page") <= max_pages)
    out = paged.select(key, "score", "page", F.lit(False).alias("pinned"))
    if n_pinned:
        pages = F.sequence(F.lit(1).cast("long"), paged.agg(F.coalesce(F.max("page"), F.lit(1)).cast("long").alias("n")).scalar())
        out = out.unionByName(shown.select(key, "score", F.explode(pages).alias("page"), F.lit(True).alias("pinned")))
    return out


def top_variance_axes(flags: DataFrame, category: str, max_axes: int = 12) -> DataFrame:
    """Parameters of a category whose scores vary most over the ligands; a missing score counts 0.5; report order kept."""
    rows = flags.where((F.col("category") == category) & (F.col("rule_type") != "descriptive"))
    var = rows.groupBy("label", "rule_ord").agg(F.var_pop(F.coalesce(flag_score(F.col("flag")), F.lit(0.5))).alias("variance"))
    return var.orderBy(F.round("variance", 12).desc(), "rule_ord").limit(max_axes).orderBy("rule_ord")


def top_variance_group_axes(scores_by_group: DataFrame, max_axes: int = 12) -> DataFrame:
    """The same over group means."""
    var = scores_by_group.groupBy("label", "rule_ord").agg(F.var_pop(F.coalesce("score", F.lit(0.5))).alias("variance"))
    return var.orderBy(F.round("variance", 12).desc(), "rule_ord").limit(max_axes).orderBy("rule_ord")


def volcano_flags(univariate: DataFrame, q_limit: float = 0.05, fold: float = 1.0) -> DataFrame:
    """Fold change against -log10 q with the significance flag; rows without either are dropped."""
    df = univariate.dropna(subset=["log2_fold_change", "q_welch"])
    q = F.least(F.greatest(F.col("q_welch"), F.lit(1e-300)), F.lit(1.0))
    return df.select("feature", F.col("log2_fold_change").alias("x"), (-F.log10(q)).alias("y"),
                     ((F.col("q_welch") < q_limit) & (F.abs("log2_fold_change") >= fold)).alias("significant"))


def top_labels(df: DataFrame, metric: str, n: int, tie: str = "feature") -> DataFrame:
    """The n rows with the largest metric."""
    return df.orderBy(F.col(metric).desc(), tie).limit(n)


def top_per_group(df: DataFrame, group: str, metric: str, n: int, tie: str) -> DataFrame:
    """The n rows with the largest metric in every group.

    Ranked first inside salted slices of a group, then among the survivors, so that a hot group never meets in one task.
    """
    from pyspark.sql import Window
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(tie, metric), F.lit(256)))
    by = [F.col(metric).desc(), F.col(tie)]
    first = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*by))).where(F.col("_rn") <= n)
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col("rank") <= n)
            .drop("_salt", "_rn"))


def preview(df: DataFrame, rows: int = 200, cols: int = 60, order: list[str] | None = None) -> tuple[DataFrame, bool]:
    """First rows and columns with non-finite numbers as null, and whether anything was cut."""
    names = df.columns[:cols]
    kinds = dict(df.dtypes)
    ordered = df.orderBy(*order) if order else df
    part = ordered.limit(rows + 1).select(*[finite_or_null(c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in names])
    return part.limit(rows), part.count() > rows or len(df.columns) > cols
