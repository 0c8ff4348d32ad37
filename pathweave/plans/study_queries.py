"""Queries on what-if analysis, trial outcomes, events and served results."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathweave.functions import prefix as px
from pathweave.functions.scalars import array_edit_distance, trunc2
from pathweave.operators import events as ev
from pathweave.operators import outcomes as oc
from pathweave.operators import topology as tp
from pathweave.operators import validation as va
from pathweave.operators import whatif as wi
from pathweave.plans.routing_queries import _inside, _pc, _strictly, _validity
from pathweave.plans.views import flat, load, oracle
from pathweave.sources.sinks import envelope
from pathweave.streaming.incremental import interval_counts, merged_events, new_files

#: The cut in time of J16's queries; some announcements stand before it, at it and after it in every given table.
_CUT = 3000
_CODES = {"asn": "(3, 4)", "length": "(2)", "rov": "(2, 3, 4)"}
_SAME = "{a}.net = {b}.net and {a}.len = {b}.len and {a}.origin = {b}.origin"


def _same(a, b):
    return _SAME.format(a=a, b=b)


def _pairs(s, d):
    return va.distinct_pairs(load(s, d, "announcements"))


def _split(s, d):
    return wi.split_validity(_validity(s, d), load(s, d, "hijacks"))


def _hijacks(s, d):
    return load(s, d, "hijacks")


def _inverse(s, d):
    return load(s, d, "inverse_results")


def _numbered(s, d):
    ann = load(s, d, "announcements")
    return wi.interesting_announcements(ann, wi.hijacked_invalid(_pairs(s, d), _validity(s, d), _hijacks(s, d), "rov"), "monitor_asn")


def _alternatives(s, d, policy):
    return wi.alternative_pairs(_pairs(s, d), _validity(s, d), policy)


def _totals(s, d, policy):
    return wi.category_totals(_split(s, d), _inverse(s, d), policy)


def _table(s, d, policy):
    if policy == "rov":
        return wi.rov_table(_split(s, d), _inverse(s, d))
    return wi.policy_table(_totals(s, d, policy))


def _answer(s, d):
    return wi.policy_answer(_split(s, d), _inverse(s, d), load(s, d, "as_rank").where("asn in (3, 500, 501)").select("asn"), tp.stub_parents(*_pc(s, d)))


def _asked(s, d):
    return load(s, d, "as_rank").where("asn < 6").select("asn")


_BAD = {p: f"select net, len, origin from validity where validity in {c}" for p, c in _CODES.items()}
_HIJ = {p: f"select distinct b.net, b.len, b.origin, h.url from ({q}) b join hijacks h on " + _same("b", "h") for p, q in _BAD.items()}
_NOT = {p: f"select b.net, b.len, b.origin from ({q}) b where not exists (select 1 from hijacks h where " + _same("b", "h") + ")" for p, q in _BAD.items()}
#: Strict ancestors of prefixes; given prefixes have 8 bits at least.
_UP = "select net, len, net - net % cast(power(2, 32 - up_len) as bigint) as up_net, up_len from (select net, len, unnest(range(8, len)) as up_len from (select distinct net, len from {t}) x) y"


def _near(b, g, columns):
    """Rows of g with the same prefix and another origin, or with a strictly covering prefix, for rows of b."""
    return f"select {columns} from {b} b join {g} g on b.net = g.net and b.len = g.len and b.origin <> g.origin union all select {columns} from {b} b join up u on b.net = u.net and b.len = u.len join {g} g on g.net = u.up_net and g.len = u.up_len"


_ALT = {p: {"up": _UP.format(t="validity"), "bad": f"select * from validity where validity in {c}", "good": f"select * from validity where validity not in {c}"} for p, c in _CODES.items()}
_ALT_SQL = "select distinct * from (" + _near("bad", "good", "b.net, b.len, b.origin, g.net as extra_net, g.len as extra_len, g.origin as extra_origin") + ") x"
_NUM = {"num": "select net, len, origin, time, monitor_asn, row_number() over (order by net, len, origin, time) - 1 as ann_id from (select net, len, origin, time, min(monitor_asn) as monitor_asn from announcements a where exists (select 1 from hj h where " + _same("a", "h") + ") group by net, len, origin, time) x"}
_NUM = {"hj": _HIJ["rov"]} | _NUM
_NEAR = _NUM | {"up": _UP.format(t="num"), "near": _near("num", "num", "b.ann_id, b.net, b.len, b.origin, b.time, g.ann_id as extra_id, g.net as extra_net, g.len as extra_len, g.origin as extra_origin, g.time as extra_time")}
_NEAR_IDS = "select n.ann_id, n.extra_id from near n join validity v on n.net = v.net and n.len = v.len and n.origin = v.origin and v.validity = 2 join validity w on n.extra_net = w.net and n.extra_len = w.len and n.extra_origin = w.origin and w.validity <> 2"
_BLOCKS = {"asn": "coalesce(blocked_by = 'asn', false)", "length": "coalesce(blocked_by = 'length', false)", "rov": "blocked_by is not null"}


def _category_sql(policy):
    label = f"case when {_BLOCKS[policy]} then 'b' else 'n' end || case when hijacked then 'h' else 'n' end"
    return {
        f"lab_{policy}": f"select distinct net, len, origin, {label} as c from split",
        f"tot_{policy}": "select i.asn, " + ", ".join(
            f"(select count(*) from lab_{policy} where c = '{k}') - count(case when l.c = '{k}' then 1 end) as {n}"
            for k, n in (("bh", "blocked_hijacked"), ("nh", "not_blocked_hijacked"), ("bn", "blocked_not_hijacked"), ("nn", "not_blocked_not_hijacked"))
        ) + f" from inverse_results i left join lab_{policy} l on " + _same("i", "l") + " group by i.asn",
    }


def _trunc_sql(x):
    return f"case when {x} >= 0 then floor({x} * 100) else ceil({x} * 100) end / 100"


def _policy_sql(source):
    h = "(blocked_hijacked + not_blocked_hijacked)"
    n = "(blocked_not_hijacked + not_blocked_not_hijacked)"
    p = lambda a, b: _trunc_sql(f"({a} * 100.0::double / nullif({b}, 0))")
    return f"select asn, blocked_hijacked, not_blocked_hijacked, blocked_not_hijacked, not_blocked_not_hijacked, {p('blocked_hijacked', h)} as percent_blocked_hijacked, {p('not_blocked_hijacked', h)} as percent_not_blocked_hijacked, {p('blocked_not_hijacked', n)} as percent_blocked_not_hijacked from {source}"


_ROV = {
    "tot_rov2": "select a.asn, a.blocked_hijacked + b.blocked_hijacked as blocked_hijacked, a.not_blocked_hijacked - b.blocked_hijacked as not_blocked_hijacked, a.blocked_not_hijacked + b.blocked_not_hijacked as blocked_not_hijacked, a.not_blocked_not_hijacked - b.blocked_not_hijacked as not_blocked_not_hijacked from tot_asn a join tot_length b on a.asn = b.asn",
}
_ALLTOT = _category_sql("asn") | _category_sql("length") | _ROV
_TABLES = _ALLTOT | {"t_asn": _policy_sql("tot_asn"), "t_length": _policy_sql("tot_length"), "t_rov": _policy_sql("tot_rov2")}
_METRICS = ("blocked_hijacked", "not_blocked_hijacked", "blocked_not_hijacked", "not_blocked_not_hijacked", "percent_blocked_hijacked", "percent_not_blocked_hijacked", "percent_blocked_not_hijacked")
_AVG = {p: "select '" + p + "' as policy, " + ", ".join(f"{_trunc_sql(f'(sum({m})::double / count(*))')} as {m}" for m in _METRICS) + f" from t_{p}" for p in _CODES}
_STUBS = {"stubs": "select customer_as as stub_asn, min(provider_as) as parent_asn from provider_customers where customer_as not in (select provider_as from provider_customers union select peer_as_1 from peers union select peer_as_2 from peers) group by customer_as"}
_PARTS = {"asn": ("asn",), "length": ("length",), "rov": ("asn", "length")}
_ASKED_SQL = _STUBS | {"asked": "select coalesce(parent_asn, r.asn) as asn from as_rank r left join stubs on r.asn = stub_asn where r.asn in (3, 500, 501)"}
_NEIGH = "select peer_as_1 as asn, peer_as_2 as neighbour, 'peer' as kind from peers union all select peer_as_2, peer_as_1, 'peer' from peers union all select provider_as, customer_as, 'customer' from provider_customers union all select customer_as, provider_as, 'provider' from provider_customers"


def _fwd(s, d):
    return load(s, d, "forwarding")


_TRACED = {"traced": "select asn as start, asn, received_from_asn as nxt, 1 as n from forwarding union all select t.start, f.asn, f.received_from_asn, t.n + 1 from traced t join forwarding f on f.asn = t.nxt where t.n < 64",
           "ended": "select start as asn, max_by(nxt, n) as next from traced group by start"}


def _rec(body):
    sql = oracle(body, "forwarding", extra=_TRACED)
    return sql.replace("with ", "with recursive ", 1) if not sql.startswith("with recursive") else sql


_COND = "case next when 64512 then 'blackholed' when 64513 then 'hijacked' when 64514 then 'not_hijacked' end"


def _looped(s, d):
    """Forwarding with loops: ASes 50 and 100, 150 and 200, ... receive from each other."""
    back = F.col("asn") + F.when(F.col("asn") % 100 == 50, 50).otherwise(-50)
    return _fwd(s, d).withColumn("received_from_asn", F.when(F.col("asn") % 50 == 0, back).otherwise(F.col("received_from_asn")))


_LOOPS = _rec("select start as asn, nxt as next, path from (select start, max_by(nxt, n) as nxt, max_by(path, n) as path from walked group by start) w where nxt not in (64512, 64513, 64514)").replace(
    "traced as (", "looped as (select asn, case when asn % 100 = 50 then asn + 50 when asn % 50 = 0 then asn - 50 else received_from_asn end as nxt from forwarding), walked as (select asn as start, asn, nxt, 1 as n, cast(asn as varchar) as path from looped union all select w.start, f.asn, f.nxt, w.n + 1, w.path || ',' || f.asn from walked w join looped f on f.asn = w.nxt where w.n < 64), traced as (", 1)


def _segments(s, d):
    return load(s, d, "as_rank").select("asn", F.when(F.col("asn") % 5 == 0, "edge").otherwise("etc").alias("segment"), (F.col("asn") % 3 == 0).alias("implement"))


_Q4 = "select p.net, p.len, p.origin, a.asn from (select distinct net, len, origin from announcements x where exists (select 1 from roas r where " + _inside("x", "r") + ")) p cross join (select distinct asn from asked) a where not exists (select 1 from inverse_results i where i.asn = a.asn and " + _same("i", "p") + ")"


def _covered(s, d):
    return px.containment_join(_pairs(s, d), load(s, d, "roas").select("prefix"), how="left_semi")


def _events(s, d):
    return load(s, d, "hijack_events").withColumn("id", F.col("event_number")).withColumn("event_number", F.col("event_number") % 500)


_EVENTS = {"e": "select event_number as id, event_number % 500 as event_number, start_time, end_time, origin, url, net, len from hijack_events"}


def _q(run, sql=None):
    return run, sql


QUERIES = {
    "active_hijacks": _q(lambda s, d: flat(wi.active_hijacks(load(s, d, "hijack_events"), F.lit(20000), F.lit(100000))), oracle("select net, len, event_number, start_time, end_time, origin, url from hijack_events where start_time <= 100000 and (end_time is null or end_time >= 20000)", "hijack_events")),
    **{f"hijacked_invalid_{p}": _q(lambda s, d, p=p: flat(wi.hijacked_invalid(_pairs(s, d), _validity(s, d), _hijacks(s, d), p)), oracle(_HIJ[p], "validity", "hijacks")) for p in _CODES},
    **{f"not_hijacked_invalid_{p}": _q(lambda s, d, p=p: flat(wi.not_hijacked_invalid(_pairs(s, d), _validity(s, d), _hijacks(s, d), p)), oracle(_NOT[p], "validity", "hijacks")) for p in _CODES},
    **{f"alternative_pairs_{p}": _q(lambda s, d, p=p: flat(_alternatives(s, d, p)), oracle(_ALT_SQL, "validity", extra=_ALT[p])) for p in _CODES},
    "interesting_pairs": _q(lambda s, d: flat(wi.interesting_pairs(wi.hijacked_invalid(_pairs(s, d), _validity(s, d), _hijacks(s, d), "asn"), wi.not_hijacked_invalid(_pairs(s, d), _validity(s, d), _hijacks(s, d), "length"), wi.hijacked_invalid(_pairs(s, d), _validity(s, d), _hijacks(s, d), "length"))), oracle(f"select net, len, origin from ({_HIJ['asn']}) a union select net, len, origin from ({_NOT['length']}) b union select net, len, origin from ({_HIJ['length']}) c", "validity", "hijacks")),
    "interesting_announcements": _q(lambda s, d: flat(_numbered(s, d)), oracle("select net, len, origin, time, monitor_asn, ann_id from num", "announcements", "validity", "hijacks", extra=_NUM)),
    "announcement_ids": _q(lambda s, d: wi.announcement_ids(_numbered(s, d), wi.hijacked_invalid(_pairs(s, d), _validity(s, d), _hijacks(s, d), "asn")), oracle("select ann_id from num n where exists (select 1 from validity v where validity in (3, 4) and " + _same("n", "v") + ")", "announcements", "validity", "hijacks", extra=_NUM)),
    "alternative_ids": _q(lambda s, d: wi.alternative_ids(_numbered(s, d), wi.alternative_pairs(_numbered(s, d).select("prefix", "origin").distinct(), _validity(s, d), "length")), oracle(_NEAR_IDS, "announcements", "validity", "hijacks", extra=_NEAR)),
    "ids_after": _q(lambda s, d: wi.ids_after(_numbered(s, d), _numbered(s, d).select("ann_id"), _CUT), oracle(f"select ann_id from num where time > {_CUT}", "announcements", "validity", "hijacks", extra=_NUM)),
    "older_alternatives": _q(lambda s, d: wi.older_alternatives(_numbered(s, d), wi.alternative_pairs(_numbered(s, d).select("prefix", "origin").distinct(), _validity(s, d), "length"), _CUT), oracle(_NEAR_IDS + f" where n.time > {_CUT} and n.extra_time < {_CUT}", "announcements", "validity", "hijacks", extra=_NEAR)),
    "alternatives_by_prefix": _q(lambda s, d: wi.alternatives_by_prefix(_numbered(s, d), _numbered(s, d).where("ann_id % 3 = 0").select("ann_id")), oracle("select distinct ann_id, extra_id from near where ann_id % 3 = 0", "announcements", "validity", "hijacks", extra=_NEAR)),
    "union_ids": _q(lambda s, d: wi.union_ids(_numbered(s, d).where("ann_id % 2 = 0"), _numbered(s, d).where("ann_id % 3 = 0")), oracle("select ann_id from num where ann_id % 2 = 0 or ann_id % 3 = 0", "announcements", "validity", "hijacks", extra=_NUM)),
    "split_validity": _q(lambda s, d: flat(_split(s, d)), oracle("select net, len, origin, blocked_by, hijacked, url from split", "split")),
    **{f"hijacks_{'' if b else 'not_'}blocked_by_{p}": _q(lambda s, d, p=p, b=b: flat(wi.hijack_table(_split(s, d), p, b)), oracle(f"select net, len, origin, url from split where hijacked and {'' if b else 'not '}({_BLOCKS[p]})", "split")) for p in ("asn", "length") for b in (True, False)},
    "all_hijacks": _q(lambda s, d: flat(wi.all_hijacks(_split(s, d))), oracle("select net, len, origin, url from split where hijacked", "split")),
    "local_rib": _q(lambda s, d: flat(wi.local_rib(_covered(s, d), _inverse(s, d), _asked(s, d))), oracle(_Q4, "announcements", "roas", "inverse_results", "as_rank", extra={"asked": "select asn from as_rank where asn < 6"})),
    **{f"hijacks_held_{p}": _q(lambda s, d, p=p: flat(wi.hijacks_held(_split(s, d), _inverse(s, d), _asked(s, d), p)), oracle(f"select h.net, h.len, h.origin, h.url, a.asn, '{p}' as policy from (select distinct net, len, origin, url from split where hijacked and not ({_BLOCKS[p]})) h cross join (select asn from as_rank where asn < 6) a where not exists (select 1 from inverse_results i where i.asn = a.asn and " + _same("i", "h") + ")", "split", "inverse_results", "as_rank")) for p in _CODES},
    "kept_totals": _q(lambda s, d: wi.kept_totals(_covered(s, d), _inverse(s, d)), oracle("select asn, (select count(*) from pairs x where exists (select 1 from roas r where " + _inside("x", "r") + ")) - count(*) as total_kept from inverse_results group by asn", "pairs", "roas", "inverse_results")),
    **{f"category_totals_{p}": _q(lambda s, d, p=p: _totals(s, d, p), oracle(f"select * from tot_{p}", "split", "inverse_results", extra=_category_sql(p))) for p in ("asn", "length")},
    **{f"policy_table_{p}": _q(lambda s, d, p=p: _table(s, d, p), oracle(f"select * from t_{p}", "split", "inverse_results", extra=_TABLES)) for p in _CODES},
    "averages": _q(lambda s, d: wi.averages(wi.policy_tables(_split(s, d), _inverse(s, d))), oracle(" union all ".join(_AVG.values()), "split", "inverse_results", extra=_TABLES)),
    "average_over": _q(lambda s, d: wi.average_over(_table(s, d, "asn"), load(s, d, "as_rank").where("asn % 7 = 0")).select(*[F.round(m, 6).alias(m) for m in _METRICS]), oracle("select " + ", ".join(f"round(avg({m}), 6) as {m}" for m in _METRICS) + " from t_asn where asn % 7 = 0 and asn in (select asn from as_rank)", "split", "inverse_results", "as_rank", extra=_TABLES)),
    "policy_stats": _q(lambda s, d: wi.policy_stats(wi.policy_tables(_split(s, d), _inverse(s, d)), load(s, d, "as_rank").where("asn % 5 = 0").select("asn"), tp.stub_parents(*_pc(s, d))), oracle(" union all ".join(f"select *, '{p}' as policy from t_{p} where asn in (select coalesce(parent_asn, r.asn) from as_rank r left join stubs on r.asn = stub_asn where r.asn % 5 = 0)" for p in _CODES), "split", "inverse_results", "as_rank", "provider_customers", "peers", extra=_TABLES | _STUBS)),
    "policy_answer_hijacks": _q(lambda s, d: flat(_answer(s, d)["hijacks"]), oracle(" union all ".join(f"select h.net, h.len, h.origin, h.url, a.asn, '{p}' as policy, '{part}' as part, coalesce(h.blocked_by = '{part}', false) as blocked from (select distinct net, len, origin, url, blocked_by from split where hijacked) h cross join (select distinct asn from asked) a where not exists (select 1 from inverse_results i where i.asn = a.asn and " + _same("i", "h") + ")" for p, parts in _PARTS.items() for part in parts), "split", "inverse_results", "as_rank", "provider_customers", "peers", extra=_ASKED_SQL)),
    "policy_answer_stats": _q(lambda s, d: _answer(s, d)["stats"], oracle(" union all ".join(f"select *, '{p}' as policy from t_{p} where asn in (select asn from asked)" for p in _CODES), "split", "inverse_results", "as_rank", "provider_customers", "peers", extra=_TABLES | _ASKED_SQL)),
    "policy_answer_averages": _q(
        lambda s, d: _answer(s, d)["averages"].withColumns({m: F.round(m, 6) for m in _METRICS}),
        oracle("select policy, " + ", ".join(f"round(avg({m}), 6) as {m}" for m in _METRICS) + " from (" + " union all ".join(f"select *, '{p}' as policy from t_{p} where asn in (select asn from asked)" for p in _CODES) + ") q group by policy", "split", "inverse_results", "as_rank", "provider_customers", "peers", extra=_TABLES | _ASKED_SQL)),
    "rib_of": _q(lambda s, d: flat(wi.rib_of(_covered(s, d), _inverse(s, d), load(s, d, "as_rank").where("asn in (3, 500, 501)").select("asn"), tp.stub_parents(*_pc(s, d)))), oracle(_Q4, "announcements", "roas", "inverse_results", "as_rank", "provider_customers", "peers", extra=_STUBS | {"asked": "select coalesce(parent_asn, r.asn) as asn from as_rank r left join stubs on r.asn = stub_asn where r.asn in (3, 500, 501)"})),
    "relationships_of": _q(lambda s, d: wi.relationships_of(*_pc(s, d), load(s, d, "as_rank").where("asn % 9 = 0").select("asn"), tp.stub_parents(*_pc(s, d))), oracle(f"select distinct asn, neighbour, kind from ({_NEIGH}) n where asn in (select coalesce(parent_asn, r.asn) from as_rank r left join stubs on r.asn = stub_asn where r.asn % 9 = 0)", "as_rank", "provider_customers", "peers", extra=_STUBS)),
    "roa_table": _q(lambda s, d: flat(wi.roa_table(load(s, d, "roas"))), oracle("select asn, net, len, max_length from roas", "roas")),
    "validity_table": _q(lambda s, d: flat(wi.validity_table(_validity(s, d))).withColumn("validity", F.col("validity").cast("int")), oracle("select net, len, origin, validity, case validity when 0 then 'VALID' when 1 then 'UNKNOWN' when 2 then 'INVALID_BY_LENGTH' when 3 then 'INVALID_BY_ORIGIN' else 'INVALID_BY_ALL' end as validity_name from validity", "validity")),
    "id_policy_stats": _q(
        lambda s, d: (lambda n: wi.id_policy_stats(n.select(F.col("monitor_asn").alias("asn"), "ann_id"), n.where("ann_id % 2 = 0").select("ann_id"), n.where("ann_id % 2 = 1").select("ann_id"), wi.alternatives_by_prefix(n, n.select("ann_id"))))(_numbered(s, d)),
        oracle("select n.monitor_asn as asn, cast(sum(case when n.ann_id % 2 = 0 then 1 else 0 end) as bigint) as hijacked, cast(sum(case when n.ann_id % 2 = 1 then 1 else 0 end) as bigint) as not_hijacked, cast(sum(case when b.ann_id is null then 1 else 0 end) as bigint) as no_alternative from num n left join (select distinct x.ann_id from near x join num m on m.ann_id = x.extra_id join num o on o.ann_id = x.ann_id where o.monitor_asn = m.monitor_asn) b on b.ann_id = n.ann_id group by n.monitor_asn", "announcements", "validity", "hijacks", extra=_NEAR)),
    "trunc2": _q(lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", trunc2(F.col("c_acctbal").cast("double") / 7).alias("v")), "select c_custkey, case when c_acctbal >= 0 then floor(c_acctbal::double / 7 * 100) else ceil(c_acctbal::double / 7 * 100) end / 100 as v from customer"),
    "array_edit_distance": _q(lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", array_edit_distance(F.split(F.col("c_name"), ""), F.split(F.reverse(F.col("c_name")), "")).alias("v")), "select c_custkey, cast(levenshtein(c_name, reverse(c_name)) as int) as v from customer"),
    # Outcomes
    "trace_back": _q(lambda s, d: oc.trace_back(_fwd(s, d)), _rec(f"select asn, next, {_COND} as condition from ended")),
    "loop_report": _q(lambda s, d: oc.loop_report(_looped(s, d)).withColumn("path", F.array_join("path", ",")), _LOOPS),
    "data_plane_counts": _q(lambda s, d: oc.data_plane_counts(oc.trace_back(_fwd(s, d)).join(_fwd(s, d).select("asn", "implement"), "asn")), _rec(f"select implement, cast(sum(case when c = 'hijacked' then 1 else 0 end) as bigint) as hijacked, cast(sum(case when c = 'not_hijacked' then 1 else 0 end) as bigint) as not_hijacked, cast(sum(case when c = 'blackholed' then 1 else 0 end) as bigint) as blackholed, cast(count(c) as bigint) as total from (select f.implement, {_COND} as c from ended e join forwarding f on e.asn = f.asn) x group by implement")),
    "control_plane_counts": _q(lambda s, d: oc.control_plane_counts(_fwd(s, d), 3, 4), oracle("select implement, cast(sum(case when origin = 3 then 1 else 0 end) as bigint) as c_hijacked, cast(sum(case when origin = 4 then 1 else 0 end) as bigint) as c_not_hijacked, cast(sum(case when origin = 64512 then 1 else 0 end) as bigint) as c_blackholed from forwarding where asn not in (3, 4) group by implement", "forwarding")),
    "segment_forwarding": _q(lambda s, d: flat(oc.segment_forwarding(_fwd(s, d).drop("implement"), _segments(s, d))), oracle("select f.asn, f.received_from_asn, f.net, f.len, f.origin, case when f.asn % 5 = 0 then 'edge' else 'etc' end as segment, f.asn % 3 = 0 as implement from forwarding f join as_rank r on f.asn = r.asn", "forwarding", "as_rank")),
    "no_rib_counts": _q(lambda s, d: oc.no_rib_counts(_segments(s, d), _fwd(s, d).where("asn % 4 <> 0"), (8, 12)), oracle("select asn % 3 = 0 as implement, count(*) as no_rib from as_rank where asn not in (8, 12) and asn not in (select asn from forwarding where asn % 4 <> 0) group by asn % 3 = 0", "as_rank", "forwarding")),
    "visible_hijacks": _q(lambda s, d: oc.visible_hijacks(_fwd(s, d), _fwd(s, d).where("asn % 50 = 3").select("prefix", "origin")), oracle("select implement, count(*) as visible_hijacks from forwarding f where received_from_asn in (select asn from forwarding g where exists (select 1 from forwarding h where h.asn % 50 = 3 and h.net = g.net and h.len = g.len and h.origin = g.origin)) group by implement", "forwarding")),
    "percent_sample": _q(lambda s, d: oc.percent_sample(_segments(s, d).drop("implement"), 30, 7)),
    "percent_sample_sizes": _q(lambda s, d: oc.percent_sample(_segments(s, d).drop("implement"), 30, 7).groupBy("segment").agg(F.sum(F.col("implement").cast("long")).alias("n")), oracle("select segment, cast(floor(count(*) * 30 / 100) as bigint) as n from (select case when asn % 5 = 0 then 'edge' else 'etc' end as segment from as_rank where asn <> 7) x group by segment", "as_rank")),
    "apply_policy": _q(lambda s, d: oc.apply_policy(_segments(s, d), 3), oracle("select asn, case when asn % 5 = 0 then 'edge' else 'etc' end as segment, asn % 3 = 0 as implement, case when asn % 3 = 0 then 3 else 0 end as as_type from as_rank", "as_rank")),
    "series_order": _q(lambda s, d: oc.series_order(load(s, d, "trials"), "percent", [10, 20]), oracle("select * from trials where percent in (10, 20)", "trials")),
    "attribute_values": _q(lambda s, d: oc.attribute_values(load(s, d, "trials"), ["attack_type", "adopt_pol"]).select(F.array_join("attack_type", ",").alias("attack_type"), F.array_join("adopt_pol", ",").alias("adopt_pol")), oracle("select (select string_agg(x, ',' order by x) from (select distinct attack_type as x from trials) a) as attack_type, (select string_agg(x, ',' order by x) from (select distinct adopt_pol as x from trials) a) as adopt_pol", "trials")),
    "attribute_grid": _q(lambda s, d: oc.attribute_grid(oc.attribute_values(load(s, d, "trials"), ["attack_type", "adopt_pol", "percent"]), ["attack_type", "adopt_pol", "percent"]), oracle("select a.attack_type, b.adopt_pol, c.percent from (select distinct attack_type from trials) a, (select distinct adopt_pol from trials) b, (select distinct percent from trials) c", "trials")),
    "compare_policies": _q(lambda s, d: oc.compare_policies(load(s, d, "trials").groupBy("attack_type", "adopt_pol", "percent").agg(F.sum("hijacked").alias("h")), ["attack_type", "percent"], "adopt_pol", "O", "F", "h"), oracle("select a.attack_type, a.percent, a.h as value_a, b.h as value_b, a.h - b.h as difference from t a join t b on a.attack_type = b.attack_type and a.percent = b.percent and a.adopt_pol = 'O' and b.adopt_pol = 'F'", "trials", extra={"t": "select attack_type, adopt_pol, percent, cast(sum(hijacked) as bigint) as h from trials group by attack_type, adopt_pol, percent"})),
    # Events and increments
    "latest_by_event": _q(lambda s, d: flat(ev.latest_by_event(_events(s, d))), oracle("select id, event_number, start_time, end_time, origin, url, net, len from (select *, row_number() over (partition by event_number order by id desc) as n from e) x where n = 1", "hijack_events", extra=_EVENTS)),
    "known_events": _q(lambda s, d: ev.known_events(_events(s, d)), oracle("select event_number, start_time, end_time from (select *, row_number() over (partition by event_number order by id desc) as n from e) x where n = 1", "hijack_events", extra=_EVENTS)),
    "changed_events": _q(lambda s, d: flat(ev.changed_events(_events(s, d), ev.known_events(_events(s, d).where("id % 3 > 0")))), oracle("select e.id, e.event_number, e.start_time, e.end_time, e.origin, e.url, e.net, e.len from e left join (select event_number, start_time, end_time from (select *, row_number() over (partition by event_number order by id desc) as n from e where id % 3 > 0) x where n = 1) k on e.event_number = k.event_number where k.event_number is null or e.start_time is distinct from k.start_time or e.end_time is distinct from k.end_time", "hijack_events", extra=_EVENTS)),
    "merged_events": _q(lambda s, d: flat(merged_events(_events(s, d).where("id % 2 = 0"), _events(s, d).where("id % 2 = 1"))), oracle("select id, event_number, start_time, end_time, origin, url, net, len from (select *, row_number() over (partition by event_number order by id desc) as n from e) x where n = 1", "hijack_events", extra=_EVENTS)),
    "clean_text": _q(lambda s, d: ev.clean_text(load(s, d, "hijack_events").withColumn("u", F.concat(F.lit('"'), F.when(F.col("origin") % 2 == 0, F.col("url")).otherwise(""), F.lit('" '))), ["u"], ["event_number", "u"]), oracle("select event_number, case when origin % 2 = 0 then url end as u from hijack_events", "hijack_events")),
    "subintervals": _q(lambda s, d: ev.subintervals(load(s, d, "hijack_events").where("end_time is not null").select("event_number", "start_time", "end_time"), F.col("start_time"), F.col("end_time"), 300), oracle("select event_number, start_time, end_time, start_time + 300 * k as interval_start, least(start_time + 300 * (k + 1), end_time) as interval_end from hijack_events, (select unnest([0, 1]) as k) i where end_time is not null and start_time + 300 * k < end_time", "hijack_events")),
    "tag_intervals": _q(lambda s, d: flat(ev.tag_intervals(load(s, d, "announcements"), F.lit(100), 900)), oracle("select net, len, origin, monitor_asn, time, time - ((time - 100) % 900 + 900) % 900 as interval_start, time - ((time - 100) % 900 + 900) % 900 + 900 as interval_end from announcements", "announcements")),
    "interval_counts": _q(lambda s, d: interval_counts(load(s, d, "announcements").withColumn("update_type", F.when(F.col("origin") % 2 == 0, "+").otherwise("-")), 900), oracle("select time - time % 900 as interval_start, time - time % 900 + 900 as interval_end, case when origin % 2 = 0 then '+' else '-' end as update_type, count(*) as n from announcements group by 1, 2, 3", "announcements")),
    "new_files": _q(lambda s, d: new_files(load(s, d, "hijack_events").select(F.col("url").alias("file")), load(s, d, "hijack_events").where("origin % 2 = 0").select(F.col("url").alias("file"))), oracle("select url as file from hijack_events where url not in (select url from hijack_events where origin % 2 = 0)", "hijack_events")),
    "envelope": _q(lambda s, d: envelope(load(s, d, "hijack_events").select("origin", "url"), {"source": "events"}, "https://example.org"), oracle("select '{\"data\":{\"origin\":' || origin || ',\"url\":\"https://example.org' || url || '\"},\"metadata\":{\"source\":\"events\"}}' as json from hijack_events", "hijack_events")),
}
