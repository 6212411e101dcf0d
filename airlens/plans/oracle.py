"""The registered queries again, as DuckDB SQL over the same tables."""

from __future__ import annotations

from airlens import adapter
from airlens.functions.trees import TREES, tree_sql
from airlens import schema as S

QUIET_US = adapter.BASE_US + 8_000_000
CALIB_MS = 5_000
RELABEL_KEEP_S = 1.5
FEATURES = ", ".join(S.WINDOW_FEATURES)
D = "::double"

CTES: dict[str, str] = adapter.duck_ctes()

CTES["ranked_packets"] = """
select *, gen_us - gen_us % 100000 as window_us,
  row_number() over (partition by capture_id, gen_us - gen_us % 100000 order by gen_us, pkt_id) as rn,
  row_number() over (partition by capture_id, gen_us - gen_us % 100000 order by gen_us desc, pkt_id desc) as rd
from packets"""
CTES["window_types"] = """
select capture_id, window_us, attack_type,
  row_number() over (partition by capture_id, window_us order by count(*) desc, min(rn)) as k
from ranked_packets where attack_type not in ('', 'NONE', 'nan') group by capture_id, window_us, attack_type"""
_OK = "rssi between -100 and 0"
CTES["windows"] = f"""
select a.*, coalesce(t.attack_type, 'NONE') as attack_type from (
select capture_id, window_us,
  coalesce(floor(max(win_pkts)), count(*))::double as total_packets,
  coalesce(max(win_dens), coalesce(floor(max(win_pkts)), count(*))::double / 0.1::double) as packet_density,
  count(*) filter (subtype = 'BEACON')::double as beacon_packets,
  count(*) filter (subtype in ('DEAUTH', 'DISASSOC'))::double as deauth_packets,
  count(*) filter (deauth_tgt >= 1)::double as deauth_targeted,
  count(*) filter (subtype like 'PROBE%')::double as probe_packets,
  count(*) filter (subtype = 'AUTH')::double as auth_packets,
  count(*) filter (seq_jump >= 1)::double as seq_jump,
  coalesce(sum(rssi) filter ({_OK}) / count(*) filter ({_OK}), 0)::double as rssi_mean,
  case when count(*) filter ({_OK}) > 1 then greatest(sum(rssi * rssi) filter ({_OK}) / count(*) filter ({_OK})
    - (sum(rssi) filter ({_OK}) / count(*) filter ({_OK})) * (sum(rssi) filter ({_OK}) / count(*) filter ({_OK})), 0)
    else 0 end::double as rssi_var,
  coalesce(sum(snr) filter ({_OK}) / count(*) filter ({_OK}), 0)::double as snr_mean,
  max(heap) filter (rd = 1)::double as heap, max(minheap) filter (rd = 1)::double as minheap,
  max(reconn) filter (rd = 1)::double as reconn, max(qpeak) filter (rd = 1)::double as qpeak,
  max(udpfail) filter (rd = 1)::double as udpfail, max(backlog) filter (rd = 1)::double as backlog,
  max(gw_flip) filter (rd = 1)::int as gw_mac_flip, max(label)::int as label,
  case when max(win_pkts) is not null then 'sensor' else 'rows' end as density_source
from ranked_packets group by capture_id, window_us) a
left join (select * from window_types where k = 1) t on a.capture_id = t.capture_id and a.window_us = t.window_us"""
CTES["quiet"] = f"""
select * replace (case when window_us < {QUIET_US} then 0 else label end as label,
  case when window_us < {QUIET_US} then 'NONE' else attack_type end as attack_type) from windows"""
CTES["scored"] = f"""
select *, {tree_sql(TREES['deployed'])} as raw_prob, ({tree_sql(TREES['deployed'], 'pred')})::int as raw_pred,
  {tree_sql(TREES['phase_a'])} as host_prob, ({tree_sql(TREES['phase_a'], 'pred')})::int as host_pred from quiet"""
CTES["tree_scores"] = " union all ".join(
    f"select capture_id, window_us, label, attack_type, '{n}' as tree, {tree_sql(t)} as score,"
    f" ({tree_sql(t, 'pred')})::int as pred from windows" for n, t in TREES.items()
)
CTES["fused"] = """
select *, greatest(raw_pred, host_pred) as or_pred, greatest(raw_prob, host_prob) as or_score,
  (raw_pred = 1 or host_prob >= 0.85)::int as gated_pred,
  case when raw_pred = 1 then greatest(raw_prob, host_prob) when host_prob >= 0.85 then host_prob else raw_prob end as gated_score
from scored"""

CTES["boots"] = """
select *, sum(boot) over (partition by capture_id order by arrival_us, pkt_id) as boot_id from (
select *, case when uptime_ms * 1000 < lag(uptime_ms * 1000) over (partition by capture_id order by arrival_us, pkt_id) - 5000000
  or lag(uptime_ms) over (partition by capture_id order by arrival_us, pkt_id) is null then 1 else 0 end as boot from packets)"""
CTES["aligned"] = """
select *, min(arrival_us - uptime_ms * 1000) over (partition by capture_id, boot_id order by arrival_us, pkt_id) as min_offset_us,
  min(arrival_us - uptime_ms * 1000) over (partition by capture_id, boot_id order by arrival_us, pkt_id) + uptime_ms * 1000 as aligned_us
from boots"""
CTES["messages"] = """
select *, case when payload like '%"START"%' or payload = 'START' then 'START'
  when payload like '%"STOP"%' or payload = 'STOP' then 'STOP' end as status,
  case when payload = 'START' then 'GENERIC_ATTACK' when payload like '%"START"%' then
  coalesce(nullif(regexp_extract(payload, '"attack_type":"([^"]*)"', 1), ''), 'UNKNOWN') end as kind from control"""
CTES["spans"] = """
select capture_id, seq_no, arrival_us as start_us, case when nxt = 'STOP' then nxt_us end as end_us,
  case when nxt = 'START' then nxt_us end as valid_until_us, kind as attack_type,
  case when nxt = 'STOP' then 'closed' when nxt = 'START' then 'lost' else 'open' end as state from (
select *, lead(status) over w as nxt, lead(arrival_us) over w as nxt_us from messages where status is not null
window w as (partition by capture_id order by arrival_us, seq_no)) where status = 'START'"""
CTES["labelled"] = """
select p.capture_id, p.pkt_id, p.arrival_us, p.aligned_us, (arg_min(s.attack_type, s.start_us) is not null)::int as label,
  coalesce(arg_min(s.attack_type, s.start_us), 'NONE') as attack_type
from aligned p left join spans s on p.capture_id = s.capture_id and p.aligned_us >= s.start_us
  and p.aligned_us <= coalesce(s.end_us, 9000000000000000000) and p.arrival_us < coalesce(s.valid_until_us, 9000000000000000000)
group by p.capture_id, p.pkt_id, p.arrival_us, p.aligned_us"""

_LOUD = "(deauth_packets > 0.5 or deauth_targeted > 0.5)"
CTES["arm_points"] = f"""
select capture_id, min(window_us) as armed_us from (
select capture_id, window_us, window_us - min(window_us) over (partition by capture_id) as age,
  count(*) filter (not {_LOUD}) over (partition by capture_id order by window_us) as quiet_n from scored)
where age >= {CALIB_MS} * 1000 and quiet_n >= 32 group by capture_id"""
CTES["rings"] = f"""
select capture_id, armed_us, count(*) as n_samples, list_sort(list(total_packets))[((count(*) - 1) * 9 // 10 + 1)::int] as p90 from (
select s.capture_id, a.armed_us, total_packets, row_number() over (partition by s.capture_id order by window_us desc) as rn
from scored s join arm_points a on s.capture_id = a.capture_id and s.window_us <= a.armed_us where not {_LOUD})
where rn <= 128 group by capture_id, armed_us"""
CTES["candidates"] = f"""
select s.*, coalesce(s.window_us >= r.armed_us, false) as armed, greatest(2 * r.p90, 1) as threshold,
  (coalesce(s.window_us >= r.armed_us, false) and raw_pred <> 0 and ({_LOUD} or total_packets > greatest(2 * r.p90, 1)))::int as candidate,
  case when {_LOUD} then 1 else 3 end as need
from scored s left join rings r on s.capture_id = r.capture_id"""
CTES["runs"] = """
select *, row_number() over (partition by capture_id, candidate, isle order by window_us) as run from (
select *, row_number() over (partition by capture_id order by window_us)
  - row_number() over (partition by capture_id, candidate order by window_us) as isle from candidates)"""
CTES["alerts"] = """
select *, coalesce(last_value(event ignore nulls) over (partition by capture_id order by window_us rows unbounded preceding), 0) as alert,
  case when armed then 'ARMED' else 'CALIB' end as calib, case when armed then threshold else 1 end::double as calib_thr from (
select *, case when candidate = 1 and run >= need then 1 when candidate = 0 and run >= 2 then 0 end as event from runs)"""
CTES["idle_ranks"] = """
select capture_id, window_us, total_packets, deauth_packets, row_number() over (partition by capture_id order by window_us) as idle_no,
  row_number() over (partition by capture_id order by window_us)
    <= greatest(1, floor(count(*) over (partition by capture_id) * 0.3::double)) as is_calib
from quiet where attack_type = 'NONE'"""
CTES["baseline"] = """
select capture_id, count(*) as n_idle, avg(total_packets) as total_mean, count(*) filter (is_calib) as n_calib,
  quantile_cont(total_packets, 0.9) as total_p90, quantile_cont(total_packets, 0.5) filter (is_calib) as calib_p50,
  quantile_cont(total_packets, 0.9) filter (is_calib) as calib_p90,
  greatest(2 * quantile_cont(total_packets, 0.9) filter (is_calib), 1) as threshold
from idle_ranks group by capture_id"""
CTES["detected"] = """
select q.*, b.threshold, (deauth_packets > 0.5 or total_packets > 27.5)::int as absolute,
  (deauth_packets > 0.5 or total_packets > coalesce(b.threshold, 1))::int as relative,
  q.attack_type = 'NONE' and q.window_us > e.calib_end as held
from quiet q left join baseline b on q.capture_id = b.capture_id
left join (select capture_id, max(window_us) filter (is_calib) as calib_end from idle_ranks group by 1) e on q.capture_id = e.capture_id"""
CTES["early"] = """
select q.*, f.first_us from quiet q join (select capture_id, min(window_us) as first_us from quiet where label = 1 group by 1) f
on q.capture_id = f.capture_id where label = 0 and window_us < first_us"""
CTES["peaks"] = """
select capture_id, arg_min(window_us, k) as peak_us from (
select capture_id, window_us, row_number() over (partition by capture_id order by dens_roll desc, window_us) as k, n from (
select capture_id, window_us, count(*) over (partition by capture_id) as n,
  case when count(*) over w >= 5 then sum(packet_density) over w / count(*) over w end as dens_roll from early
window w as (partition by capture_id order by window_us rows between 19 preceding and current row)) where dens_roll is not null)
where n >= 20 group by capture_id"""
CTES["split"] = """
select *, row_number() over (partition by label order by h) <= floor(0.3::double * count(*) over (partition by label) + 0.5) as is_test
from (select *, md5(concat('42|', capture_id, '|', window_us)) as h from windows)"""
# The greedy chains, one step per recursion.
CTES["starts"] = """
select capture_id, min(gen_us) as t from packets group by capture_id union all
select s.capture_id, min(p.gen_us) from starts s join packets p on p.capture_id = s.capture_id and p.gen_us >= s.t + 100000
group by s.capture_id, s.t"""
CTES["actions"] = """
select capture_id, min(window_us) as action_us from alerts_m where alert = 1 group by capture_id union all
select s.capture_id, min(p.window_us) from actions s join alerts_m p on p.capture_id = s.capture_id and p.alert = 1
  and p.window_us >= s.action_us + 2000000 group by s.capture_id, s.action_us"""
CTES["alerts_m"] = "select * from alerts"



def _needs(sql: str) -> list[str]:
    import re

    return [n for n in CTES if re.search(rf"\b(?:from|join)\s+{n}\b", sql)]


def with_ctes(body: str, changed: dict[str, str] | None = None) -> str:
    """``body`` with the table expressions it uses, in order of dependence; ``changed`` ones take their place."""
    order: list[str] = []
    ctes = {**CTES, **(changed or {})}

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _needs(ctes[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for name in _needs(body):
        visit(name)
    parts = ", ".join(f"{n} as ({ctes[n].strip()})" for n in order)
    recursive = "recursive " if {"starts", "actions"} & set(order) else ""
    return f"with {recursive}{parts} {body.strip()}" if order else body.strip()
