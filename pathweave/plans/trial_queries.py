"""Queries on the outcomes of trials: fact rows, rates, confidence intervals and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions import prefix as px
from pathweave.operators import outcomes as oc
from pathweave.plans.views import load, oracle


def attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per trial, with prefixes as arrays."""
    prefixes = {c: F.transform(F.split(c, ","), px.parse) for c in ("attacker_prefixes", "victim_prefixes")}
    return load(spark, sf_dir, "trial_attacks").withColumns(prefixes)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oc.trial_facts(attacks(spark, sf_dir), load(spark, sf_dir, "trial_segments"), load(spark, sf_dir, "trial_forwarding"))


def _shown(df: DataFrame) -> DataFrame:
    """Prefix arrays as text."""
    return df.withColumns({c: F.array_join(F.transform(c, px.to_text), ",") for c in ("attacker_prefixes", "victim_prefixes")})


def _rounded(df: DataFrame, names: list[str], digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


_VIEWS = ("trial_attacks", "trial_forwarding", "trial_segments")
_COUNTS = {
    "trace_hijacked": "o and e.next = 64513", "trace_nothijacked": "o and e.next = 64514", "trace_blackholed": "o and e.next = 64512",
    "c_plane_has_attacker_prefix_origin": "o and f.origin = t.attacker_asn", "c_plane_has_only_victim_prefix_origin": "o and f.origin = t.victim", "c_plane_has_bhole": "o and f.origin = 64512",
    "no_rib": "o and f.asn is null", "visible_hijacks": "v.asn is not null",
}
_SIDE = {"adopting": "s.implement", "collateral": "not s.implement"}
_EXTRA = {
    "traced": "select trial, asn as start, received_from_asn as nxt, 1 as n from trial_forwarding union all select t.trial, t.start, f.received_from_asn, t.n + 1 from traced t join trial_forwarding f on f.trial = t.trial and f.asn = t.nxt where t.n < 64",
    "ended": "select trial, start as asn, max_by(nxt, n) as next from traced group by trial, start",
    "seen": "select f.trial, f.asn from trial_forwarding f join trial_forwarding h on h.trial = f.trial and h.asn = f.received_from_asn join trial_attacks t on t.trial = f.trial where h.origin = t.attacker_asn and contains(',' || t.attacker_prefixes || ',', case h.len when 24 then ',172.20.9.0/24,' else ',172.20.0.0/16,' end)",
    "ases": "select s.trial, s.subtable_name, " + ", ".join(f"({_SIDE[side]}) and ({case.replace('o and', 's.asn <> t.attacker_asn and s.asn <> t.victim and')}) as {name}_{side}" for name, case in _COUNTS.items() for side in oc.SIDES)
    + " from trial_segments s join trial_attacks t on t.trial = s.trial left join trial_forwarding f on f.trial = s.trial and f.asn = s.asn left join ended e on e.trial = s.trial and e.asn = s.asn left join seen v on v.trial = s.trial and v.asn = s.asn",
    "counted": "select trial, subtable_name, " + ", ".join(f"count(*) filter ({name}_{side}) as {name}_{side}" for name in _COUNTS for side in oc.SIDES) + " from ases group by trial, subtable_name",
    "facts": "select c.*, " + ", ".join(f"trace_hijacked_{s} + trace_nothijacked_{s} + trace_blackholed_{s} + no_rib_{s} as trace_total_{s}" for s in oc.SIDES) + ", " + ", ".join(f"t.{c}" for c in oc.TRIAL_INFO) + " from counted c join trial_attacks t on t.trial = c.trial",
    "rates": "select " + ", ".join(oc.RESULT_KEYS) + ", " + ", ".join(
        f"cast({' + '.join(f'{c}_{side}' for c in plus)}{''.join(f' - {c}_{side}' for c in minus)} as double) / trace_total_{side} as {name}_{side}" for side in oc.SIDES for name, (plus, minus) in oc.RATES.items()
    ) + " from facts where trace_total_adopting > 0 and trace_total_collateral > 0",
    "means": "select " + ", ".join(oc.RESULT_KEYS) + ", " + ", ".join(f"avg({m}) as {m}_mean, 1.96 * stddev_samp({m}) / sqrt(count(*)) as {m}_ci95" for m in oc.MEASURES) + " from rates group by " + ", ".join(oc.RESULT_KEYS),
}


def _sql(body: str, last: str) -> str:
    names = list(_EXTRA)
    sql = oracle(body, *_VIEWS, extra={n: _EXTRA[n] for n in names[: names.index(last) + 1]})
    return "with recursive " + sql.removeprefix("with ").removeprefix("recursive ")


_SERIES = " union all ".join(f"select {', '.join(k for k in oc.RESULT_KEYS if k != 'percent')}, percent as x, '{m}' as measure, round({m}_mean * 100, 6) as y, round({m}_ci95 * 100, 6) as error from means where percent in (0, 30, 60) and adopt_pol in ('rov', 'rov_v1') and extra_bash_arg_2 is null" for m in oc.MEASURES)
_MEASURED = [f"{m}_{x}" for m in oc.MEASURES for x in ("mean", "ci95")]

QUERIES = {
    "trial_facts": (lambda s, d: _shown(facts(s, d)), _sql("select * from facts", "facts")),
    "trial_rates": (lambda s, d: _rounded(oc.trial_rates(facts(s, d)), list(oc.MEASURES)), _sql("select " + ", ".join(oc.RESULT_KEYS) + ", " + ", ".join(f"round({m}, 9) as {m}" for m in oc.MEASURES) + " from rates", "rates")),
    "mean_ci95": (lambda s, d: _rounded(oc.mean_ci95(oc.trial_rates(facts(s, d))), _MEASURED), _sql("select " + ", ".join(oc.RESULT_KEYS) + ", " + ", ".join(f"round({m}, 9) as {m}" for m in _MEASURED) + " from means", "means")),
    "plot_series": (
        lambda s, d: _rounded(oc.plot_series(oc.mean_ci95(oc.trial_rates(facts(s, d))), "percent", [0, 30, 60], {"extra_bash_arg_2": None}, ["rov", "rov_v1"]), ["y", "error"], 6),
        _sql(_SERIES, "means")),
    "rates_over": (
        lambda s, d: oc.rates_over(load(s, d, "trials").select("attack_type", "adopt_pol", "percent", "trial", "hijacked", "total"), ["hijacked"], "total"),
        oracle("select attack_type, adopt_pol, percent, trial, cast(hijacked as double) / total as hijacked_rate from trials where total > 0", "trials")),
    "check_percent_index": (
        lambda s, d: oc.check_percent_index(load(s, d, "trials")),
        oracle("select percent, count(*) as n from (select distinct percent, percent_iter from trials) x group by percent having count(*) <> 1", "trials")),
    "require_percent_index": (
        lambda s, d: oc.require_percent_index(load(s, d, "trial_attacks")).groupBy("percent", "percent_iter").agg(F.count(F.lit(1)).alias("n")),
        oracle("select percent, percent_iter, count(*) as n from trial_attacks group by percent, percent_iter", "trial_attacks")),
}
