"""Tunable rules: defaults, reading as one row, validation, changes and their audit."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The keys of all rules with their defaults.
DEFAULTS: dict[str, float] = {
    "GPS_CERO_HOY_CRITICA": 22,
    "GPS_PORC_HOY_CRITICA": 90,
    "GPS_TOTAL_HOY_CRITICA": 10,
    "GPS_RACHA_CRITICA": 784,
    "GPS_CERO_HOY_ALTA": 6,
    "GPS_CERO_HOY_ALTA_MAX": 21,
    "GPS_PORC_HOY_ALTA": 66.67,
    "GPS_TOTAL_HOY_ALTA": 5,
    "GPS_RACHA_ALTA": 306,
    "GPS_CERO_HOY_ADV": 1,
    "GPS_CERO_HOY_ADV_MAX": 5,
    "GPS_CERO_HIST_ADV": 113,
    "GPS_PORC_HIST_ADV": 16.43,
    "BAT_CAIDA_MIN_DETECTAR": 20,
    "BAT_CAIDA_MAX_HORAS": 2,
    "BAT_CAIDA_HOY_CRITICA": 50,
    "BAT_CAIDA_HOY_CRITICA_CON_HIST": 30,
    "BAT_CAIDAS_HOY_CRITICA": 3,
    "BAT_CERO_HOY_CRITICA": 10,
    "BAT_CAIDA_HOY_ALTA": 20,
    "BAT_CAIDAS_HIST_ALTA": 3,
    "BAT_CAIDA_MAX_HIST_ALTA": 50,
    "BAT_CERO_HOY_ALTA_MIN": 3,
    "BAT_CERO_HOY_ALTA_MAX": 9,
    "BAT_CERO_HOY_ADV_MIN": 1,
    "BAT_CERO_HOY_ADV_MAX": 2,
    "BAT_CERO_HIST_ADV": 12,
}
DETECTION = ("BAT_CAIDA_MIN_DETECTAR", "BAT_CAIDA_MAX_HORAS")

#: A set that makes more branches fire on sparse data.
SPARSE: dict[str, float] = DEFAULTS | {
    "GPS_CERO_HOY_CRITICA": 4,
    "GPS_PORC_HOY_CRITICA": 75,
    "GPS_TOTAL_HOY_CRITICA": 3,
    "GPS_RACHA_CRITICA": 5,
    "GPS_CERO_HOY_ALTA": 3,
    "GPS_CERO_HOY_ALTA_MAX": 3,
    "GPS_PORC_HOY_ALTA": 60,
    "GPS_TOTAL_HOY_ALTA": 2,
    "GPS_RACHA_ALTA": 3,
    "GPS_CERO_HOY_ADV_MAX": 2,
    "GPS_CERO_HIST_ADV": 9,
    "GPS_PORC_HIST_ADV": 20,
    "BAT_CAIDA_MAX_HORAS": 6,
    "BAT_CERO_HOY_CRITICA": 3,
    "BAT_CAIDAS_HIST_ALTA": 6,
    "BAT_CAIDA_MAX_HIST_ALTA": 65,
    "BAT_CERO_HOY_ALTA_MIN": 2,
    "BAT_CERO_HOY_ALTA_MAX": 2,
    "BAT_CERO_HOY_ADV_MAX": 1,
    "BAT_CERO_HIST_ADV": 6,
}


def rules_table(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    rows = [(k, Decimal(str(v)), 1, "DETECCION" if k in DETECTION else "CLASIFICACION") for k, v in values.items()]
    return spark.createDataFrame(rows, "key string, value decimal(12,4), active int, type string")


def load_rules(rules: DataFrame, expected: Sequence[str] = tuple(DEFAULTS)) -> DataFrame:
    """The known rules; raises if one of them is missing."""
    known = rules.where(F.col("key").isin(*expected))
    missing = sorted(set(expected) - {r["key"] for r in known.select("key").distinct().collect()})  # at most as many as there are rules
    if missing:
        raise ValueError(f"missing rules: {', '.join(missing)}")
    return known


def rules_row(rules: DataFrame, by: Sequence[str] = (), defaults: dict[str, float] | None = None) -> DataFrame:
    """One row (for each of ``by``) with a column for each rule: the active value, else the default."""
    defaults = DEFAULTS if defaults is None else defaults
    columns = [F.coalesce(F.max(F.when((F.col("key") == k) & (F.col("active") == 1), F.col("value").cast("double"))), F.lit(float(v))).alias(k) for k, v in defaults.items()]
    return rules.groupBy(*by).agg(*columns)


def _ordered(row: Column, *steps: str) -> Column:
    """Keys with ``<=`` or ``<`` between them, all holding."""
    ok = F.lit(True)
    for a, op, b in zip(steps[::2], steps[1::2], steps[2::2], strict=False):
        ok &= row[a] <= row[b] if op == "<=" else row[a] < row[b]
    return ok


def violations(rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by`` and ``code`` of every check that fails; an empty result means that the rules are valid."""
    active = (F.col("active") == 1) & F.col("value").isNotNull()
    value = {k: F.max(F.when(active & (F.col("key") == k), F.col("value").cast("double"))).alias(k) for k in DEFAULTS}
    known = F.col("key").isin(*DEFAULTS)
    row = rules.groupBy(*by).agg(
        F.count_if(active & known).alias("n_active"),
        F.count_if((F.col("active") == 1) & (F.col("value") < 0)).alias("n_negative"),
        F.count_if((F.col("active") == 1) & F.col("key").startswith("GPS_PORC_") & ((F.col("value") < 0) | (F.col("value") > 100))).alias("n_percent"),
        F.struct(*value.values()).alias("r"),
    )
    r = F.col("r")
    checks = {
        "COUNT": F.col("n_active") == len(DEFAULTS),
        "NEGATIVE": F.col("n_negative") == 0,
        "PERCENT": F.col("n_percent") == 0,
        "GPS_RANGES": _ordered(r, "GPS_CERO_HOY_ADV", "<=", "GPS_CERO_HOY_ADV_MAX", "<", "GPS_CERO_HOY_ALTA", "<=", "GPS_CERO_HOY_ALTA_MAX", "<", "GPS_CERO_HOY_CRITICA"),
        "GPS_LEVELS": _ordered(r, "GPS_PORC_HOY_ALTA", "<=", "GPS_PORC_HOY_CRITICA") & _ordered(r, "GPS_TOTAL_HOY_ALTA", "<=", "GPS_TOTAL_HOY_CRITICA") & _ordered(r, "GPS_RACHA_ALTA", "<=", "GPS_RACHA_CRITICA"),
        "BATTERY_RANGES": _ordered(r, "BAT_CERO_HOY_ADV_MIN", "<=", "BAT_CERO_HOY_ADV_MAX", "<", "BAT_CERO_HOY_ALTA_MIN", "<=", "BAT_CERO_HOY_ALTA_MAX", "<", "BAT_CERO_HOY_CRITICA"),
        "DETECTION": (r["BAT_CAIDA_MIN_DETECTAR"] > 0) & (r["BAT_CAIDA_MAX_HORAS"] > 0),
        "DROP_LEVELS": _ordered(r, "BAT_CAIDA_HOY_ALTA", "<=", "BAT_CAIDA_HOY_CRITICA_CON_HIST", "<=", "BAT_CAIDA_HOY_CRITICA"),
    }
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(code)) for code, ok in checks.items())))
    return row.select(*by, F.explode(failed).alias("code"))


def require_valid(rules: DataFrame) -> DataFrame:
    """The rules as they are; raises if a check fails."""
    failed = [r["code"] for r in violations(rules).collect()]  # one row for each kind of check at most
    if failed:
        raise ValueError(f"invalid rules: {', '.join(sorted(failed))}")
    return rules


def _sorted_side(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One side of a join of rules. Those of many fleets can come from few bytes, which Spark's size check takes for a table that fits the driver: joined by order, on all shuffle partitions."""
    return rules.repartition(int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).hint("merge")


def key_difference(rules: DataFrame, expected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keys on one side only, with the side."""
    keys = [*by, "key"]
    both = rules.select(*keys, F.lit("extra").alias("side")).unionByName(expected.select(*keys, F.lit("missing").alias("side")))
    one = both.groupBy(*keys).agg(F.min("side").alias("side"), F.max("side").alias("other")).where(F.col("side") == F.col("other"))
    return one.select(*keys, "side")


def rule_changes(rules: DataFrame, requested: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requested values (text) that differ from the current ones as decimals, so that 2.00 is 2; unknown keys and unreadable values are marked ``rejected``."""
    wanted = requested.select(*by, "key", F.trim("value").try_cast("decimal(12,4)").alias("new_value"))
    both = wanted.join(_sorted_side(rules.select(*by, "key", F.col("value").alias("old_value"), "type"), [*by, "key"]), [*by, "key"], "left")
    rejected = F.col("type").isNull() | F.col("new_value").isNull()
    differs = ~F.col("old_value").eqNullSafe(F.col("new_value"))
    return both.where(rejected | differs).select(*by, "key", "old_value", "new_value", "type", rejected.alias("rejected"))


def recompute_mode(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``full`` if a detection rule changes, ``fast`` if only others do, ``none`` without a valid change."""
    valid = ~F.col("rejected")
    mode = F.when(F.count_if(valid & (F.col("type") == "DETECCION")) > 0, "full").when(F.count_if(valid) > 0, "fast").otherwise("none")
    return changes.groupBy(*by).agg(mode.alias("mode"))


def changed_rules(rules: DataFrame, requested: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rules with the accepted new values."""
    accepted = rule_changes(rules, requested, by).where(~F.col("rejected")).select(*by, "key", "new_value")
    return rules.join(_sorted_side(accepted, [*by, "key"]), [*by, "key"], "left").withColumn("value", F.coalesce("new_value", "value")).select(*rules.columns)


def guarded_changes(rules: DataFrame, requested: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``outcome`` of a request (for each of ``by``): ``none``, ``fast`` or ``full``, or ``rejected`` with the ``reasons``.

    A request is refused as a whole if a key is unknown, a value unreadable, or the rules would not be valid with it.
    """
    changes = rule_changes(rules, requested, by)
    asked = requested.select(*by).distinct() if by else requested.sparkSession.range(1).select()
    mode = recompute_mode(changes, by)
    refused = changes.where("rejected").select(*by, F.concat(F.lit("KEY "), "key").alias("reason"))
    broken = violations(changed_rules(rules, requested, by), by).select(*by, F.col("code").alias("reason"))
    broken = broken.join(mode.where("mode <> 'none'").select(*by), list(by), "left_semi") if by else broken
    reasons = refused.unionByName(broken).groupBy(*by).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    joined = asked.join(mode, list(by), "left").join(reasons, list(by), "left") if by else mode.crossJoin(reasons)  # one row each
    found = F.coalesce("reasons", F.array().cast("array<string>"))
    return joined.select(*by, F.when(F.size(found) > 0, "rejected").otherwise(F.coalesce("mode", F.lit("none"))).alias("outcome"), found.alias("reasons"))


def rule_history(old: DataFrame, new: DataFrame, user: str, as_of: Column, by: Sequence[str] = ()) -> DataFrame:
    """Audit rows of the rules whose value or active flag changes."""
    keys = [*by, "key"]
    before = old.select(*keys, F.col("value").alias("old_value"), F.col("active").alias("old_active"))
    both = new.select(*keys, F.col("value").alias("new_value"), F.col("active").alias("new_active"), "type").join(_sorted_side(before, keys), keys)
    changed = ~F.col("old_value").eqNullSafe(F.col("new_value")) | (F.col("old_active") != F.col("new_active"))
    return both.where(changed).select(*keys, "old_value", "new_value", "old_active", "new_active", "type", F.lit(user).alias("changed_by"), as_of.alias("changed_at"))
