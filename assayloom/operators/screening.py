"""Docking scores, groups against the native reference, compound keys and report rows.

Tables keep one row per fact. Lists that could hold most of the input (values of a group, members of a key) stay long tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayloom.functions.text import NATIVE_GROUP, NO_GROUP, compound_key, group_label
from assayloom.ordered import matrix_cells, numbered, quantiles
from assayloom.rules import CATEGORIES, DEFAULT_RULES, PHYSICOCHEMICAL, Rule, flag_score, wide_category_scores, wide_flag_counts


def _groups(groups: DataFrame, key: str = "ligand") -> DataFrame:
    return groups.select(F.col("ligand").alias(key), F.col("group").alias("_group"))


# ---- projections -----------------------------------------------------------------------------------------

def with_group(df: DataFrame, groups: DataFrame, key: str = "ligand") -> DataFrame:
    """Put ``group`` right after the key column; rows of unknown ligands get the no-group label."""
    joined = df.drop("group").join(_groups(groups, key), key, "left")
    out = []
    for c in df.columns:
        if c != "group":
            out.append(F.col(f"`{c}`"))
        if c == key:
            out.append(group_label("_group").alias("group"))
    return joined.select(*out)


def lipinski_ro5(df: DataFrame) -> DataFrame:
    """Rule-of-five violations and the pass flag (at most one)."""
    over = lambda c, limit: F.coalesce((F.col(c) > limit).cast("int"), F.lit(0))
    violations = over("MW", 500) + over("LogP", 5) + over("HBD", 5) + over("HBA", 10)
    return df.withColumn("violations", violations).withColumn("Lolos_Ro5", F.col("violations") <= 1)


def best_affinity(poses: str = "poses") -> Column:
    return F.try_element_at(F.col(poses), F.lit(1))["affinity"]


def succeeded() -> Column:
    return F.col("error").isNull() & (F.coalesce(F.size("poses"), F.lit(0)) > 0)


def docking_rows(runs: DataFrame) -> DataFrame:
    """One report row per run: best affinity, number of poses, status."""
    return runs.select(
        "ligand", "receptor", "replicate", "seed", best_affinity().alias("affinity_best"),
        F.greatest(F.coalesce(F.size("poses"), F.lit(0)), F.lit(0)).alias("n_poses"),
        F.when(succeeded(), "sukses").otherwise("gagal").alias("status"))


def ligand_summary(ligands: DataFrame, prepared: DataFrame, natives: DataFrame | None = None) -> DataFrame:
    """Every compound with its preparation status, native ligands appended."""
    done = prepared.select("safe_name").distinct().withColumn("_done", F.lit(True))
    rows = ligands.join(done, "safe_name", "left").select(
        "name", "safe_name", "smiles", F.coalesce("group", F.lit("")).alias("group"), F.lit("uji").alias("type"),
        F.when(F.col("_done"), "siap").otherwise("gagal").alias("status"))
    if natives is None:
        return rows
    return rows.unionByName(natives.select(
        "name", "safe_name", "smiles", F.lit(NATIVE_GROUP).alias("group"), F.lit("native").alias("type"), F.lit("siap").alias("status")))


# ---- replicate statistics and the native reference -------------------------------------------------------

def replicate_stats(runs: DataFrame) -> DataFrame:
    """Count, mean, population deviation and best affinity of the successful runs per ligand and receptor."""
    a = best_affinity()
    return (runs.where(succeeded()).groupBy("ligand", "receptor").agg(
        F.count(F.lit(1)).alias("n_replicates_success"), F.round(F.avg(a), 3).alias("affinity_mean"),
        F.round(F.stddev_pop(a), 3).alias("affinity_std"), F.round(F.min(a), 3).alias("affinity_best")))


def affinities_by_group(stats: DataFrame, groups: DataFrame, include_native: bool = False) -> DataFrame:
    """Best values with receptor and group, one row per value."""
    rows = with_group(stats.where(F.col("affinity_best").isNotNull()), groups)
    if not include_native:
        rows = rows.where(F.col("group") != NATIVE_GROUP)
    return rows.select("receptor", "group", "ligand", "affinity_best")


def native_affinity(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """Best value of the native reference per receptor.

    An inner join stays above the aggregation of the runs, so callers that join the same statistics read one exchange.
    """
    native = groups.where(F.col("group") == NATIVE_GROUP).select("ligand").distinct()
    return (stats.join(native, "ligand").where(F.col("affinity_best").isNotNull())
            .groupBy("receptor").agg(F.min("affinity_best").alias("native_affinity")))


def fraction_better_than_native(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """Percent of a group's ligands at or below the native value; receptors without a native are left out."""
    per_value = affinities_by_group(stats, groups).groupBy("receptor", "group", "affinity_best").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("affinity_best") <= F.col("native_affinity"), F.col("n")).otherwise(0)
    return (per_value.join(native_affinity(stats, groups), "receptor")
            .groupBy("receptor", "group").agg((100.0 * F.sum(hit) / F.sum("n")).alias("percent_better")))


def add_delta_vs_native(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """Best value minus the native value of the receptor; null for the natives themselves."""
    rows = with_group(stats, groups).join(native_affinity(stats, groups), "receptor", "left")
    delta = F.when(F.col("group") != NATIVE_GROUP, F.round(F.col("affinity_best") - F.col("native_affinity"), 3))
    return rows.withColumn("delta_vs_native", delta).drop("native_affinity")


def summarize_docking_by_group(stats: DataFrame, groups: DataFrame, digits: int = 3) -> DataFrame:
    """Per receptor and group: n, mean, deviation, best, native value and percent better than native.

    Ties of ``digits`` are decided on six digits more, so the order of summation does not show.
    """
    to = lambda c: F.round(F.round(c, digits + 6), digits)
    rows = affinities_by_group(stats, groups, include_native=True)
    native = native_affinity(stats, groups)
    per_group = rows.join(native, "receptor", "left").groupBy("receptor", "group").agg(
        F.count(F.lit(1)).alias("n_ligands"),
        to(F.avg("affinity_best")).alias("affinity_mean"), to(F.stddev_pop("affinity_best")).alias("affinity_std"),
        to(F.min("affinity_best")).alias("affinity_best"),
        F.min("native_affinity").alias("native_affinity"),
        (100.0 * F.avg(F.when(F.col("affinity_best") <= F.col("native_affinity"), 1.0)
                       .when(F.col("native_affinity").isNotNull(), 0.0))).alias("_better"))
    return per_group.withColumn("percent_better", F.when(F.col("group") != NATIVE_GROUP, F.round("_better", 1))).drop("_better")


def best_run_per_pair(runs: DataFrame) -> DataFrame:
    """The successful run with the lowest best affinity per pair, first in input order on ties."""
    row = F.struct(*[F.col(c) for c in runs.columns])
    best = runs.where(succeeded()).groupBy("ligand", "receptor").agg(
        F.min_by(row, F.struct(best_affinity().alias("a"), F.col("ord").alias("o"))).alias("_row"))
    return best.select("_row.*")


def rmsd_summary(poses: DataFrame) -> DataFrame:
    """Per receptor the pose with the smallest (rmsd, replicate, mode), plus the best-affinity pose beside it.

    Expects receptor, replicate, mode, rmsd, affinity and ``status``; receptors without any rmsd are kept as failed.
    """
    key = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c), F.col("replicate"), F.col("mode")))
    pose = F.struct("replicate", "mode", "rmsd", "affinity", "status")
    out = poses.groupBy("receptor").agg(F.min_by(pose, key("rmsd")).alias("b"), F.min_by(pose, key("affinity")).alias("a"))
    ok = F.col("b.rmsd").isNotNull()
    return out.select(
        "receptor", F.col("b.replicate").alias("replicate"), F.col("b.mode").alias("mode"), F.col("b.rmsd").alias("rmsd"),
        F.col("b.affinity").alias("affinity"), F.when(ok, F.col("b.status")).otherwise("gagal").alias("status"),
        F.when(ok, F.col("a.rmsd")).alias("rmsd_affinity_best"), F.when(ok, F.col("a.replicate")).alias("affinity_best_replicate"),
        F.when(ok, F.col("a.mode")).alias("affinity_best_mode"))


def affinity_matrix(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """Receptor by ligand values as (receptor, column, value), with the native reference as its own column."""
    test = affinities_by_group(stats, groups).groupBy("receptor", F.col("ligand").alias("column")).agg(
        F.min("affinity_best").alias("value"))
    native = native_affinity(stats, groups).select("receptor", F.lit("Native (ref)").alias("column"), F.col("native_affinity").alias("value"))
    return test.unionByName(native)


def affinity_group_matrix(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """Receptor by group mean values as (receptor, column, value), native column included."""
    means = affinities_by_group(stats, groups).groupBy("receptor", F.col("group").alias("column")).agg(F.avg("affinity_best").alias("value"))
    native = native_affinity(stats, groups).select("receptor", F.lit("Native (ref)").alias("column"), F.col("native_affinity").alias("value"))
    return means.unionByName(native)


# ---- flags and properties by group -----------------------------------------------------------------------

def _scored(flags: DataFrame, category: str | None) -> DataFrame:
    rows = flags.where(F.col("flag").isin("green", "yellow", "red"))
    return rows if category is None else rows.where(F.col("category") == category)


def _counted(flags: DataFrame, by: list[str], category: str | None) -> DataFrame:
    """Cells per flag, from flags or straight from the wide property table."""
    if "flag" not in flags.columns:
        return wide_flag_counts(flags, by, category)
    counts = [F.count_if(F.col("flag") == n).alias(n) for n in ("green", "yellow", "red")]
    return _scored(flags, category).groupBy(*by, "category", "label", "rule_ord").agg(*counts)


def _share_columns() -> list[Column]:
    return [(100.0 * F.col(n) / (F.col("green") + F.col("yellow") + F.col("red"))).alias(n) for n in ("green", "yellow", "red")]


def flag_scores_by_group(flags: DataFrame, groups: DataFrame, category: str | None = None) -> DataFrame:
    """Mean flag score per group and parameter; na and info do not count. ``flags`` may be the wide property table."""
    counts = _counted(with_group(flags, groups), ["group"], category)
    mean = (F.col("green") + 0.5 * F.col("yellow")) / (F.col("green") + F.col("yellow") + F.col("red"))
    return counts.select("group", "category", "label", "rule_ord", mean.alias("score"))


def flag_shares_by_group(flags: DataFrame, groups: DataFrame, category: str | None = None) -> DataFrame:
    """Percent green, yellow and red per group and parameter; ``flags`` may be the wide property table."""
    return _counted(with_group(flags, groups), ["group"], category).select("group", "category", "label", "rule_ord", *_share_columns())


def flag_shares(flags: DataFrame, category: str | None = None) -> DataFrame:
    """Percent green, yellow and red per parameter over all ligands; ``flags`` may be the wide property table."""
    return _counted(flags, [], category).select("category", "label", "rule_ord", *_share_columns())


def category_scores(flags: DataFrame) -> DataFrame:
    """Mean score per ligand and category, the physicochemical one left out; from flags, or straight from the wide property table."""
    if "flag" not in flags.columns:
        return wide_category_scores(flags)
    rows = _scored(flags, None).where(F.col("category") != PHYSICOCHEMICAL)
    return rows.groupBy("ligand", "category").agg(F.avg(flag_score(F.col("flag"))).alias("score"))


def category_scores_by_group(flags: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean of the members' category scores per group."""
    return with_group(category_scores(flags), groups).groupBy("group", "category").agg(F.avg("score").alias("score"))


def group_flag_matrix(flags: DataFrame, groups: DataFrame) -> DataFrame:
    """Group by category score matrix, columns in category order (physicochemical left out)."""
    cats = [c for c in CATEGORIES if c != PHYSICOCHEMICAL]
    return category_scores_by_group(flags, groups).groupBy("group").pivot("category", cats).agg(F.first("score"))


def group_parameter_matrix(flags: DataFrame, groups: DataFrame, category: str, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Group by parameter score matrix of one category, columns in report order."""
    labels = [r.label for r in rules if r.category == category and r.rule_type != "descriptive"]
    return flag_scores_by_group(flags, groups, category).groupBy("group").pivot("label", labels).agg(F.first("score"))


def property_distribution(df: DataFrame, groups: DataFrame, props: list[str], blocks: int | None = None) -> DataFrame:
    """Box numbers per group and property: quartiles, whiskers within 1.5 interquartile ranges, mean and count."""
    long = with_group(df, groups).select("group", *props).unpivot(["group"], props, "property", "value").where(F.col("value").isNotNull())
    q = quantiles(long, ["group", "property"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, blocks)
    spread = F.col("q3") - F.col("q1")
    inside_lo, inside_hi = F.col("value") >= F.col("q1") - 1.5 * spread, F.col("value") <= F.col("q3") + 1.5 * spread
    return (long.join(q, ["group", "property"]).groupBy("group", "property").agg(
        F.count(F.lit(1)).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside_lo, F.col("value"))).alias("whisker_low"), F.max(F.when(inside_hi, F.col("value"))).alias("whisker_high")))


def summarize_groups(lipinski: DataFrame, flags: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: ligand count, percent passing the rule of five, mean properties and category scores."""
    size = groups.groupBy(group_label("group").alias("group")).agg(F.count(F.lit(1)).alias("n_ligands"))
    props = with_group(lipinski, groups).groupBy("group").agg(
        F.round(100.0 * F.avg(F.col("Lolos_Ro5").cast("int")), 1).alias("ro5_percent"),
        *[F.round(F.avg(c), 2).alias(f"{c}_mean") for c in ("MW", "LogP", "HBD", "HBA")])
    cats = [c for c in CATEGORIES if c != PHYSICOCHEMICAL]
    scores = category_scores_by_group(flags, groups).groupBy("group").pivot("category", cats).agg(F.round(F.first("score"), 3))
    scores = scores.withColumnsRenamed({c: f"score_{c}" for c in cats})
    return size.join(props, "group", "left").join(scores, "group", "left")


# ---- compounds and keys ----------------------------------------------------------------------------------

def group_order(groups: DataFrame, native_last: bool = False) -> DataFrame:
    """Groups in order of first appearance, the native group first or last."""
    seen = groups.groupBy(group_label("group").alias("group")).agg(F.min("ord").alias("first_ord"))
    end = F.when(F.col("group") == NATIVE_GROUP, F.lit(1 if native_last else -1)).otherwise(0)
    return numbered(seen.withColumn("_end", end), [], ["_end", "first_ord"], "position").select("group", "position")


def multi_group_compounds(ligands: DataFrame) -> DataFrame:
    """Compound names (case folded) that occur in more than one group, one row per group."""
    pairs = ligands.select(F.lower(F.trim("name")).alias("compound"), group_label("group").alias("group")).distinct()
    many = pairs.groupBy("compound").agg(F.count(F.lit(1)).alias("n_groups")).where("n_groups > 1")
    return pairs.join(many, "compound")


def with_key(ligands: DataFrame) -> DataFrame:
    return ligands.withColumn("key", compound_key("smiles", "name"))


def group_by_key(ligands: DataFrame) -> DataFrame:
    """One row per distinct compound: first occurrence, member count and its slot in first-occurrence order."""
    keys = with_key(ligands).groupBy("key").agg(
        F.min("ord").alias("first_ord"), F.min_by("name", "ord").alias("name"), F.min_by("smiles", "ord").alias("smiles"),
        F.count(F.lit(1)).alias("n_members"))
    return numbered(keys, [], ["first_ord"], "slot").withColumn("n_duplicates", F.col("n_members") - 1)


def describe_duplicates(ligands: DataFrame, limit: int = 5) -> DataFrame:
    """The first few compounds given more than once, one row per group with its member count.

    ``n_more`` tells how many such compounds there are beyond those shown.
    """
    keyed = with_key(ligands)
    several = (keyed.groupBy("key").agg(F.min("ord").alias("first_ord"), F.min_by("name", "ord").alias("first_name"),
                                        F.count(F.lit(1)).alias("n_members")).where("n_members > 1"))
    first = several.orderBy("first_ord").limit(limit)
    beyond = several.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("n")).scalar()
    return (keyed.join(first, "key").withColumn("n_more", beyond).groupBy("first_ord", "n_more", F.col("first_name").alias("name"),
                                            F.coalesce(F.nullif("group", F.lit("")), F.lit(NO_GROUP.lower())).alias("group"))
            .agg(F.count(F.lit(1)).alias("n_members")))


def fan_out(unique_rows: DataFrame, ligands: DataFrame) -> DataFrame:
    """Copy the result row of each key to every compound that shares the key."""
    source = unique_rows.drop("ligand", "group")
    members = with_key(ligands).select("key", F.col("name").alias("ligand"), F.coalesce("group", F.lit("")).alias("group"), "ord")
    return members.join(source, "key").drop("key")


def _positions(df: DataFrame, out: str) -> DataFrame:
    return numbered(df, [], ["ord"], out)


def join_by_position(ligands: DataFrame, properties: DataFrame) -> DataFrame:
    """Give the n-th property row to the n-th ligand, or to the n-th distinct compound when those counts agree."""
    n_rows, n_ligands = properties.count(), ligands.count()
    rows = _positions(properties, "_pos").drop("ord")
    if n_rows == n_ligands:
        return _positions(ligands, "_pos").join(rows, "_pos").drop("_pos")
    unique = group_by_key(ligands).select("key", F.col("slot").alias("_pos"))
    n_unique = unique.count()
    if n_rows != n_unique:
        raise ValueError(f"{n_rows} property rows do not fit {n_ligands} ligands ({n_unique} distinct compounds)")
    return with_key(ligands).join(unique, "key").join(rows, "_pos").drop("key", "_pos")


def structure_mismatches(joined: DataFrame, returned: str = "raw_smiles") -> DataFrame:
    """Rows whose returned structure text differs from the one sent."""
    a, b = F.trim(F.coalesce("smiles", F.lit(""))), F.trim(F.coalesce(returned, F.lit("")))
    return joined.where((a != "") & (b != "") & (a != b)).select("ord", "name", "smiles", returned)


def map_batches(sent: DataFrame, returned: DataFrame) -> DataFrame:
    """Match returned rows to sent keys batch by batch.

    ``sent`` has batch, pos and key; ``returned`` has batch, pos, raw_smiles and values. Equal counts match by position; otherwise
    by structure when every sent key came back (first row per structure); otherwise the batch is dropped.
    """
    count = lambda df, name: df.groupBy("batch").agg(F.count(F.lit(1)).alias(name))
    by_key = returned.groupBy("batch", F.col("raw_smiles").alias("key")).agg(
        F.min_by(F.struct(*[c for c in returned.columns if c != "batch"]), "pos").alias("_row"))
    found = sent.join(by_key, ["batch", "key"], "left_semi").groupBy("batch").agg(F.count(F.lit(1)).alias("n_found"))
    plan = (count(sent, "n_sent").join(count(returned, "n_back"), "batch", "left").join(found, "batch", "left")
            .select("batch", F.when(F.col("n_sent") == F.col("n_back"), "position")
                    .when(F.col("n_sent") == F.col("n_found"), "structure").alias("how")).where("how is not null"))
    positional = sent.join(plan.where("how = 'position'"), "batch").join(returned, ["batch", "pos"])
    values = [c for c in returned.columns if c not in ("batch", "pos")]
    structural = (sent.join(plan.where("how = 'structure'"), "batch").join(by_key, ["batch", "key"])
                  .select("batch", "pos", "key", "how", *[F.col(f"_row.{c}").alias(c) for c in values]))
    return positional.select("batch", "pos", "key", "how", *values).unionByName(structural)


def docking_tasks(ligands: DataFrame, targets: DataFrame, n_replicates: int = 3, base_seed: int = 42, slices: int | None = None) -> DataFrame:
    """The task list: every ligand with every target and replicate.

    The product is the result itself. Ligands are spread over ``slices`` and each slice meets the whole target list by an
    equal-key join, so that neither side has to fit one task.
    """
    return (matrix_cells(ligands.select("ligand"), targets.select("receptor"), "ligand", slices)
            .withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n_replicates))))
            .withColumn("seed", (F.lit(base_seed) + F.col("replicate") - 1).cast("long")))


def pending_keys(all_keys: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Keys that have no result yet."""
    return all_keys.join(done.select(*on).distinct(), on, "left_anti")


def pending_complexes(complexes: DataFrame, done: DataFrame) -> DataFrame:
    """Complexes still to do, the native one first within each receptor."""
    todo = pending_keys(complexes, done, ["receptor", "complex"])
    return todo.orderBy("receptor", F.col("is_native").desc(), "complex")


def missing_keys(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Expected keys without a row."""
    return expected.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def report_union(screen: DataFrame, native: DataFrame) -> DataFrame:
    """Screened and native rows with columns aligned by name."""
    return screen.unionByName(native, allowMissingColumns=True)


# ---- ranking and paging ----------------------------------------------------------------------------------

def rank_affinity(stats: DataFrame, groups: DataFrame, top_n: int | None = None) -> DataFrame:
    """Pairs from the strongest affinity down, with a label and the native flag."""
    several = stats.agg((F.count_distinct("receptor") > 1).alias("several")).scalar()
    native = groups.where(F.col("group") == NATIVE_GROUP).select("ligand").distinct().withColumn("is_native", F.lit(True))
    rows = stats.join(native, "ligand", "left").select(
        F.when(several, F.concat_ws("", "ligand", F.lit(" ("), "receptor", F.lit(")"))).otherwise(F.col("ligand")).alias("label"),
        "affinity_best", F.coalesce("is_native", F.lit(False)).alias("is_native"))
    rows = rows.orderBy("affinity_best", "label")
    return rows if top_n is None else rows.limit(top_n)


def paginate(df: DataFrame, order: list[str], max_items: int, blocks: int | None = None) -> DataFrame:
    """Balanced pages along numeric order columns; pages differ by at most one row, larger pages first."""
    n = df.count()
    pages = max(1, -(-n // max_items))
    small, extra = divmod(n, pages)
    at, head = F.col("position") - 1, extra * (small + 1)
    page = F.when(at < head, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - head) / max(small, 1))) + 1
    ranked = numbered(df, [], order, "position", blocks)
    return ranked.withColumns({"n_pages": F.lit(pages).cast("long"), "page": page.cast("long")})


def paginate_grid(cells: DataFrame, max_rows: int, max_cols: int, n_rows: int, n_cols: int) -> DataFrame:
    """Tile number (row-major) of matrix cells addressed by 0-based ``row`` and ``col``."""
    def page_of(at: Column, n: int, limit: int) -> tuple[Column, int]:
        pages = max(1, -(-n // limit))
        small, extra = divmod(n, pages)
        head = extra * (small + 1)
        return F.when(at < head, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - head) / max(small, 1))), pages
    r, _ = page_of(F.col("row"), n_rows, max_rows)
    c, across = page_of(F.col("col"), n_cols, max_cols)
    return cells.withColumn("tile", (r * across + c + 1).cast("long"))
