"""The full feature table, from a recipe.

A recipe is a plain dict naming the feature families to build and their columns,
windows, aggregates and templates. The rows are stored once with a number. Every family
of measures is made on the columns it reads: the entity windows share one shuffle, the
per-race measures another, statistics are broadcast when small. The families meet by
the number, so that a wide row is shuffled once, however many families there are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceflow import skew
from raceflow.functions import bands
from raceflow.operators import ingroup, selection, stats, timeline
from raceflow.plans import learning
from raceflow.session import cut_lineage, release

# Columns that a race's result brings; those of the race itself are never features.
RESULT_COLUMNS = ["finish_position", "finish_time_seconds", "last_3f_time", "passing_order_1", "passing_order_2",
                  "passing_order_3", "passing_order_4", "is_win", "prize_money", "odds", "win_odds", "popularity",
                  "margin_seconds", "finish_time_str", "margin_str"]

# The default recipe.
DEFAULT_RECIPE: dict = {
    "basic_features": {"one_hot_encoding": [{"column": "sex", "prefix": "sex"}, {"column": "track_surface", "prefix": "track"}],
                       "bracket": {"bracket_is_inner": [1, 2, 3], "bracket_is_middle": [4, 5, 6], "bracket_is_outer": [7, 8]}},
    "career_stats": ["career_starts", "career_wins", "prize_total", "career_win_rate"],
    "past_performance": {"columns": ["finish_position", "margin_seconds", "last_3f_time", "passing_order_1", "passing_order_4"],
                         "windows": [1, 3, 5, 10], "aggregations": ["mean", "median", "std", "max"]},
    "change_flags": ["jockey_id", "trainer_id"],
    "entity_stats": [
        {"id_column": "jockey_id", "target": "is_win", "agg": "mean", "feature_name": "jockey_win_rate"},
        {"id_column": "trainer_id", "target": "is_win", "agg": "mean", "feature_name": "trainer_win_rate"},
        {"id_column": "sire_id", "target": "prize_money", "agg": "mean", "feature_name": "sire_avg_prize"},
        {"id_column": "damsire_id", "target": "prize_money", "agg": "mean", "feature_name": "damsire_avg_prize"}],
    "interaction_features": [
        {"id_column": "jockey_id", "context_column": "venue", "target": "is_win", "agg": "mean", "feature_template": "jockey_{context}_win_rate"},
        {"id_column": "jockey_id", "context_column": "distance_category", "target": "is_win", "agg": "mean", "feature_template": "jockey_{context}_win_rate"},
        {"id_column": "jockey_id", "context_column": "track_surface", "target": "is_win", "agg": "mean", "feature_template": "jockey_{context}_win_rate"},
        {"id_column": "sire_id", "context_column": "track_surface", "target": "finish_position", "agg": "mean", "feature_template": "sire_{context}_avg_finish"},
        {"id_column": "sire_id", "context_column": "distance_category", "target": "finish_position", "agg": "mean", "feature_template": "sire_{context}_avg_finish"},
        {"id_column": "trainer_id", "context_column": "venue", "target": "is_win", "agg": "mean", "feature_template": "trainer_{context}_win_rate"},
    ],
    "z_score": ["horse_weight", "basis_weight", "age", "prize_total", "career_win_rate"],
    "course": True, "trend_windows": [3, 5, 10], "improvement_windows": [3, 5, 10], "sire": True,
    "running_style": True, "conditions": True, "relative": True,
    "imputation": {"numeric_strategy": "median", "default_numeric_value": 0.0},
    "exclude_patterns": [".*_name$", ".*_id$", "^race_id$", "^sex$", "^track_surface$", "^bracket_number$",
                         "is_target_race", "is_win", "prev_jockey_id", "prev_trainer_id", "^morning_odds$",
                         "^morning_popularity$", "^win_odds$", "^popularity$"],
}


def career(recipe: Mapping, columns: Sequence[str]) -> timeline.Spec:
    """The per-horse part of the recipe as one specification."""
    spec, wanted = timeline.Spec(), recipe.get("career_stats", [])
    if "career_starts" in wanted:
        spec += timeline.start_count()
    if "career_wins" in wanted:
        spec += timeline.prior_sum("career_wins", F.col("is_win"))
    if "prize_total" in wanted and "prize_money" in columns:
        spec += timeline.prior_sum("prize_total", F.col("prize_money"))
    if "career_win_rate" in wanted:
        spec += timeline.prior_rate("career_win_rate", F.col("is_win"))
    past = recipe.get("past_performance")
    if past:
        spec += timeline.rolling([c for c in past["columns"] if c in columns], past["windows"], past["aggregations"])
        spec += timeline.days_since_previous("race_date")
    changed = [c for c in recipe.get("change_flags", []) if c in columns]
    return spec + timeline.previous(changed) if changed else spec


def target_rows(results: DataFrame, entries: DataFrame | Column, key: Sequence[str]) -> DataFrame:
    """All rows with ``is_target_race``: entries are a condition on the results, or a table of their own.

    Entries that have results already are flagged in place; others come without any
    result column, whatever the entry table holds.
    """
    if isinstance(entries, Column):
        return results.withColumn("is_target_race", F.coalesce(entries, F.lit(False)).cast("int"))
    known = entries.select(*key).distinct().withColumn("is_target_race", F.lit(1))
    flagged = skew.attach(results, known, key).na.fill(0, ["is_target_race"])
    fresh = selection.without_leakage(entries, RESULT_COLUMNS).withColumn("is_target_race", F.lit(1))
    ahead = fresh.join(results.select(*key), list(key), "left_anti")
    return flagged.unionByName(ahead, allowMissingColumns=True)


def build(entries: DataFrame | Column, results: DataFrame, key: Sequence[str], order: Sequence[str],
          recipe: Mapping = DEFAULT_RECIPE, entity: str = "horse_id", race: str = "race_id",
          hot: Mapping[str, list] | None = None, as_of: str = "first_day") -> DataFrame:
    """Features of ``entries`` (unique on ``key``) knowing only earlier ``results``.

    Rolling features use each entity's rows before the entry. Entity, pair and course
    statistics use, by ``as_of``: the results before the first entry's day
    (``first_day``), all results (``all``: the documented aggregate, which sees the races
    themselves), or those of strictly earlier days than each entry (``row``). Result
    columns of the race itself leave the rows before any other measure is made.
    """
    return families(entries, results, key, order, recipe, entity, race, hot, as_of)[0]


def families(entries: DataFrame | Column, results: DataFrame, key: Sequence[str], order: Sequence[str],
             recipe: Mapping = DEFAULT_RECIPE, entity: str = "horse_id", race: str = "race_id",
             hot: Mapping[str, list] | None = None, as_of: str = "first_day") -> tuple[DataFrame, Callable[[], list[DataFrame]]]:
    """The table of ``build`` and a function giving the parts it is put together from: together they have its columns, each part for
    all of its rows. What is asked of each column alone (``imputed``) need not wait for the wide rows."""
    if as_of not in ("first_day", "all", "row"):
        raise ValueError(f"unknown as_of {as_of}")
    hot = dict(hot or {})
    if "distance_m" in results.columns:
        band = bands.distance_right_closed(F.col("distance_m"))
        results = results.withColumn("distance_category", band)
        if isinstance(entries, DataFrame):
            entries = entries.withColumn("distance_category", band)
    rows = skew.numbered(target_rows(results, entries, key))
    if isinstance(entries, Column):
        results = rows.drop(skew.ROW, "is_target_race")  # the same rows, which are stored by now
    release(rows.sparkSession)
    first_day = rows.filter("is_target_race = 1").agg(F.min("race_date")).scalar()
    past = results if as_of in ("all", "row") else results.filter(F.col("race_date") < first_day)

    spec = career(recipe, rows.columns)
    lived = timeline.with_history(rows, [entity], order, spec, hot=hot.get(entity)).filter("is_target_race = 1")
    lived = selection.without_leakage(lived, [*RESULT_COLUMNS, "is_target_race"])
    df = selection.without_leakage(rows.filter("is_target_race = 1"), [*RESULT_COLUMNS, "is_target_race"])
    pieces, small = [lived.drop(*[c for c in df.columns if c != skew.ROW])], []

    def in_race(part: DataFrame, own) -> DataFrame:
        part = ingroup.z_score(part, race, z, own) if z else part
        return relative_measures(part, race, own) if recipe.get("relative") else part

    z = [c for c in recipe.get("z_score", []) if c in lived.columns]
    if z or recipe.get("relative"):
        read = [c for c in (*z, "morning_odds", "basis_weight") if c in lived.columns]
        narrow = lived.select(skew.ROW, race, *dict.fromkeys(read))
        measured = skew.by_part(narrow, [race], hot.get(race), in_race)
        pieces.append(measured.drop(*[c for c in narrow.columns if c != skew.ROW]))

    if as_of != "row":
        wanted = [(keys, t) for keys, t in statistics(past, recipe, entity, order) if set(keys) <= set(df.columns)]
        for (keys, _), table in zip(wanted, skew.stored_all([t for _, t in wanted])):
            own = {"nige_ratio": F.avg("nige_rate"), "senko_ratio": F.avg("senko_rate")} if (
                recipe.get("running_style") and "nige_rate" in table.columns) else {}
            if own:
                style = table.select(*keys, "nige_rate", "senko_rate")
                found = skew.lookup(df.select(skew.ROW, race, *keys), style, keys, _hot_for(keys, hot), stored=True)
                found = skew.over_group(found, [race], own, hot.get(race))
                pieces.append(found.select(skew.ROW, *own))
            if skew.fits_broadcast(table):
                small.append((keys, table))
            else:
                found = skew.lookup(df.select(skew.ROW, *keys), table, keys, _hot_for(keys, hot), stored=True)
                pieces.append(found.drop(*keys))
    def finished(df: DataFrame) -> DataFrame:
        for keys, table in small:
            df = skew.lookup(df, table, keys, _hot_for(keys, hot), stored=True)

        basic = recipe.get("basic_features", {})
        for r in basic.get("one_hot_encoding", []):
            if r["column"] in df.columns:
                df = learning.one_hot(df, r["column"], r["prefix"], stats.context_values(results, r["column"]))
        if basic.get("bracket") and "bracket_number" in df.columns:
            df = df.withColumns(bands.membership(F.col("bracket_number"), basic["bracket"]))

        if as_of == "row":
            specs = [x for x in statistics_specs(past, recipe, entity) if set(x[0]) <= set(df.columns)]
            keys_used = sorted({k for keys, _, _ in specs for k in keys} | {"race_date"})
            asked = cut_lineage(rows.filter("is_target_race = 1").select(*keys_used).distinct())
            for keys, spec_of, least in specs:
                df = stats.strictly_before(df, past, keys, "race_date", spec_of, least, asked)
        return race_conditions(df) if recipe.get("conditions") else df

    out = finished(skew.assembled(df, pieces))
    names = selection.feature_columns(out, recipe.get("exclude_patterns", []))
    names = [c for c in names if c not in key and c != "race_date"]
    return out.select(*key, "race_date", *names), lambda: [finished(df), *pieces]


def statistics(past: DataFrame, recipe: Mapping, entity: str, order: Sequence[str]) -> list[tuple[list[str], DataFrame]]:
    """(keys, table) of all statistics over ``past``, one table per key combination."""
    tables = stats.entity_statistics(past, recipe.get("entity_stats", []))
    for k, t in stats.interaction_statistics(past, recipe.get("interaction_features", [])).items():
        tables[k] = tables[k].join(t, k, "full_outer") if k in tables else t
    if recipe.get("sire") and {"sire_id", "finish_position", "distance_m"} <= set(past.columns):
        t = stats.sire_statistics(past.filter("sire_id IS NOT NULL"), "sire_id")
        tables["sire_id"] = tables["sire_id"].join(t, "sire_id", "full_outer") if "sire_id" in tables else t
    own = []
    if recipe.get("trend_windows"):
        own.append(timeline.recent_summary(past, entity, order, recipe["trend_windows"]))
    if recipe.get("improvement_windows"):
        own.append(timeline.improvement_rate(past, entity, order, recipe["improvement_windows"]))
    if recipe.get("running_style") and "passing_order_1" in past.columns:
        style = bands.running_style(F.col("passing_order_1"))
        own.append(stats.grouped(past, [entity], {f"{name}_rate": F.avg((style == name).cast("int")) for name in ("nige", "senko")}))
    for t in own:
        tables[entity] = tables[entity].join(t, entity, "full_outer") if entity in tables else t
    return [([k], t) for k, t in tables.items()] + (course_statistics(past, entity) if recipe.get("course") else [])


def statistics_specs(past: DataFrame, recipe: Mapping, entity: str) -> list[tuple[list[str], dict, int]]:
    """(keys, {name: (aggregate, column)}, least rows) of the same statistics for strictly
    earlier days; an interaction is given for the row's own context."""
    have, found = set(past.columns), {}

    def add(keys, name, agg, column, least=0):
        if {*keys, column} <= have:
            found.setdefault((tuple(keys), least), {})[name] = (agg, column)

    for r in recipe.get("entity_stats", []):
        add([r["id_column"]], r["feature_name"], r["agg"], r["target"])
    for r in recipe.get("interaction_features", []):
        name = selection.template_name(r["feature_template"], f"own_{r['context_column']}")
        add([r["id_column"], r["context_column"]], name, r["agg"], r["target"])
    if recipe.get("sire"):
        add(["sire_id"], "sire_avg_finish", "mean", "finish_position")
        add(["sire_id"], "sire_std_finish", "std", "finish_position")
        add(["sire_id"], "sire_avg_distance", "mean", "distance_m")
    if recipe.get("course"):
        course = ["venue", "distance_category", "track_surface"]
        add([*course, "bracket_number"], "bracket_avg_finish", "mean", "finish_position")
        add(["sire_id", *course], "sire_course_avg_finish", "mean", "finish_position")
        add(["sire_id", *course], "sire_course_avg_odds", "mean", "morning_odds")
        for name, agg, column in (("combo_avg_finish", "mean", "finish_position"), ("combo_races", "count", "finish_position"),
                                  ("combo_avg_popularity", "mean", "popularity")):
            add(["jockey_id", "trainer_id"], name, agg, column)
        add(["jockey_id", "trainer_id"], "combo_avg_odds", "mean", "morning_odds")
        for name, agg in (("nicks_avg_finish", "mean"), ("nicks_count", "count"), ("nicks_std_finish", "std")):
            add(["sire_id", "damsire_id"], name, agg, "finish_position", 5)
        add(["sire_id", "damsire_id"], "nicks_avg_odds", "mean", "morning_odds", 5)
        for context, prefix in (("venue", "venue"), ("distance_category", "dist"), ("track_surface", "surface")):
            add([entity, context], f"{prefix}_avg_finish", "mean", "finish_position")
            add([entity, context], f"{prefix}_races", "count", "finish_position")
    return [(list(keys), spec, least) for (keys, least), spec in found.items()]


def imputed(df: DataFrame, keep: Sequence[str], recipe: Mapping = DEFAULT_RECIPE, parts: Sequence[DataFrame] | None = None) -> DataFrame:
    """Fill the NULLs of every numeric feature by the recipe's strategy. The values come from ``df``, or from the
    ``families`` it is put together from, one at a time, so that the wide rows are not moved for them."""
    rule = recipe.get("imputation", {})
    names = [c for c in selection.feature_columns(df, []) if c not in keep]
    strategy, default = rule.get("numeric_strategy", "median"), rule.get("default_numeric_value", 0.0)
    if parts is None or strategy != "median":
        fills = learning.fill_values(df, names, strategy, default)
    else:
        found = skew.part_quantiles(parts, dict.fromkeys(names, [0.5]))
        fills = {c: default if q[0] is None else q[0] for c, q in found.items()}
    return learning.impute(df, fills)


def _hot_for(keys: Sequence[str], hot: Mapping[str, list]):
    """A combination cannot be hot when one of its parts is known to have no hot value."""
    if len(keys) == 1:
        return hot.get(keys[0])
    return [] if any(hot.get(k) == [] for k in keys) else None


def course_statistics(past: DataFrame, entity: str) -> list[tuple[list[str], DataFrame]]:
    """(keys, table) for bracket bias, jockey × trainer, sire × dam's sire, sire × course
    and course affinity, as far as the results have the columns."""
    course, have = ["venue", "distance_category", "track_surface"], set(past.columns)
    odds = "morning_odds" if "morning_odds" in have else None  # the odds at the start would tell the result
    found: list[tuple[list[str], DataFrame]] = []
    if {*course, "bracket_number"} <= have:
        found.append(([*course, "bracket_number"], stats.mean_by(past, [*course, "bracket_number"], "bracket_avg_finish")))
    if {"jockey_id", "trainer_id"} <= have:
        found.append((["jockey_id", "trainer_id"], stats.pair_synergy(past, "jockey_id", "trainer_id", odds=odds)))
    if {"sire_id", "damsire_id"} <= have:
        found.append((["sire_id", "damsire_id"], stats.nicks(past, "sire_id", "damsire_id", odds=odds)))
    if {"sire_id", *course} <= have:
        found.append((["sire_id", *course], stats.sire_course(past, ["sire_id", *course], odds=odds)))
    for context, prefix, extra in (("venue", "venue", {}), ("distance_category", "dist", {"dist_avg_time": "finish_time_seconds"}),
                                   ("track_surface", "surface", {"surface_avg_last3f": "last_3f_time"})):
        if {context, *extra.values()} <= have:
            found.append(([entity, context], stats.course_affinity(past, entity, context, prefix, extra)))
    return found


def race_conditions(df: DataFrame) -> DataFrame:
    """Field size, month, season and importance by the first prize of the race's prize list, which is known
    before the race; without such a column every race is medium. The prize won is a result and has no say."""
    month = F.month("race_date")
    importance = bands.importance(F.col("prize_1st")) if "prize_1st" in df.columns else F.lit("medium")
    return df.withColumns({"field_size_category": bands.field_size(F.col("head_count")), "race_month": month,
                           "race_season": bands.season(month), "race_importance": importance})


def relative_measures(df: DataFrame, race: str, hot=None) -> DataFrame:
    """Pre-race measures relative to the field: odds rank and weight against the mean."""
    if "morning_odds" in df.columns:
        df = skew.rank_within(df, [race], "morning_odds", "odds_rank", hot=hot)
    if "basis_weight" in df.columns:
        df = ingroup.gap_and_ratio_to_mean(df, race, "basis_weight", "weight_diff_from_avg", "_ratio", hot).drop("_ratio")
    return df
