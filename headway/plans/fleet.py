"""Schedule and drive cycles to the scenario table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.operators import energy as e
from headway.session import stage


def cycle_stage(cycles: DataFrame, veh: e.Vehicle, scenarios=None, t="time_s", speed="mps", grade="grade") -> DataFrame:
    """Consumption and energy returned per trip for the distinct cycle settings.

    Seconds are never multiplied: each is read once for all settings, and a trip's sums
    are made side by side. The drive-cycle factor is applied when the cycle is made, so
    a frame that holds one cycle per factor carries it as a column; without one all
    factors share the cycle.
    """
    variants = [params for _, params in e.cycle_variants(scenarios)]
    own = "acc_dec_factor" in cycles.columns
    if own:
        cycles = cycles.filter(F.col("acc_dec_factor").isin([float(v["acc_dec_factor"]) for v in variants]))
    keys = ["trip_id", *(["acc_dec_factor"] if own else [])]
    loads = list(dict.fromkeys((float(v["passenger_load"]), float(v["aux_power_kw"])) for v in variants))
    sums = e.road_load_settings(cycles, keys, t, speed, grade, loads, veh)
    rows = [
        F.struct(
            *[F.lit(float(v[p])).alias(p) for p in e.CYCLE_PARAMS],
            F.col("by_load")[loads.index((float(v["passenger_load"]), float(v["aux_power_kw"])))].alias("of"),
        )
        for v in variants
    ]
    out = sums.withColumnRenamed("acc_dec_factor", "_f") if own else sums
    out = out.select("trip_id", *(["_f"] if own else []), F.inline(F.array(*rows)))
    if own:
        out = out.filter(F.col("_f") == F.col("acc_dec_factor"))
    return out.select("trip_id", *e.CYCLE_PARAMS, F.col("of.electric_kwh_per_mi").alias("consumption_kwh_mi"), F.col("of.regen_kwh").alias("cyc_regen_kwh"))


def sensitivity(
    trips: DataFrame, cycles: DataFrame, network: str = "network_id", area_km2: float = e.AREA_KM2, veh: e.Vehicle = e.Vehicle(),
    scenarios=None,
) -> DataFrame:
    """Named metrics of every scenario, with the cycle stage run once."""
    scenarios = scenarios or e.scenario_list()
    cycle_kwh = stage(cycle_stage(cycles, veh, scenarios), "cycles")
    return e.run_scenarios(trips, [network], scenarios, cycle_kwh, area_km2=area_km2)
