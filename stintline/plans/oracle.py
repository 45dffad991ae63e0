"""Independent SQL for the registered queries: shared relations as CTEs, one SELECT a query."""

from __future__ import annotations

import re

from stintline.functions.random import PHILOX_MULTIPLIERS, PHILOX_ROUNDS, PHILOX_WEYL, WORD
from stintline.rules import COMPONENT_LIVES, COMPONENTS, INCIDENT, MECHANICAL, PRIORS, RACE_POINTS, SPRINT_POINTS

STINT = "partition by season, round, driver, stint"


def latest(column: str) -> str:
    """The last known value by date; of one day the one with the greatest values, nulls first."""
    return f"arg_max({column}, (date, coalesce(team, -1), coalesce(lap_s, -1), coalesce(standing, -1))) filter ({column} is not null)"


#: Added before rounding to other than eight places: sums in another order differ by some 1e-15, which breaks exact ties.
NUDGE = 3e-11


def rounded(x: str, places: int = 8) -> str:
    return f"(round({x if places == 8 else f'{x} + {NUDGE}::DOUBLE'}, {places}) + 0.0::DOUBLE)"


def points_of(pos: str, table: dict[int, int]) -> str:
    return "(case " + pos + " " + " ".join(f"when {k} then {v}.0::DOUBLE" for k, v in table.items()) + " else 0.0::DOUBLE end)"


def unit(what: str, *key: str, seed: int = 42) -> str:
    parts = " || ':' || ".join(f"({k})::VARCHAR" for k in key)
    return f"((('0x' || substr(md5('{seed}:{what}:' || {parts}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def normal(what: str, *key: str) -> str:
    return f"(sqrt(-2 * ln({unit(what + '1', *key)})) * cos(2 * pi() * {unit(what + '2', *key)}))"


def counter(c0: str, c1: str, driver: str) -> str:
    """The words of a block: simulation, race, and the two halves of the driver's number."""
    return f"({c0})::UBIGINT as w0, ({c1})::UBIGINT as w1, ({driver})::UBIGINT & 4294967295 as w2, ({driver})::UBIGINT >> 32 as w3"


def blocks(rows: str, keep: str, stream: int, seed: int = 42) -> str:
    """Rows whose words w0 to w3 went through the rounds of Philox 4x32, as nested selects."""
    k0, k1 = seed, stream
    for _ in range(PHILOX_ROUNDS):
        (m0, m1), low = PHILOX_MULTIPLIERS, "& 4294967295"
        rows = (
            f"select {keep}, xor(xor((w2 * {m1}::UBIGINT) >> 32, w1), {k0}::UBIGINT) as w0, (w2 * {m1}::UBIGINT) {low} as w1, "
            f"xor(xor((w0 * {m0}::UBIGINT) >> 32, w3), {k1}::UBIGINT) as w2, (w0 * {m0}::UBIGINT) {low} as w3 from ({rows})"
        )
        k0, k1 = (k0 + PHILOX_WEYL[0]) & WORD, (k1 + PHILOX_WEYL[1]) & WORD
    return rows


def unit_of(word: str) -> str:
    return f"(({word} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def normal_of(a: str, b: str) -> str:
    return f"(sqrt(-2 * ln({unit_of(a)})) * cos(2 * pi() * {unit_of(b)}))"


def status_kind(s: str) -> str:
    low = f"trim(lower({s}))"
    return (
        f"(case when {low} = 'finished' or starts_with({low}, '+') then 'finished' when regexp_matches({low}, '{'|'.join(MECHANICAL)}') then 'mechanical' "
        f"when regexp_matches({low}, '{'|'.join(INCIDENT)}') then 'incident' else 'other' end)"
    )


def beta(k: str, n: str, kind: str) -> str:
    a, b = PRIORS[kind]
    return rounded(f"({k} + {a}::DOUBLE) / ({n} + {a + b}::DOUBLE)")


SD = "case when count(*) >= 2 then greatest(stddev_samp(speed) / sqrt(count(*)), 0.01::DOUBLE) else 2.0::DOUBLE end"
#: name: (relations it uses, SQL)
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "laps": ((), """select year(l_shipdate) as season, year(l_shipdate) - 1994 as round, l_suppkey as driver, l_suppkey // 2 as team, (l_suppkey // 2) % 5 as engine,
        s_nationkey as nation_team, l_returnflag || l_linestatus as stint, l_linenumber as lap_number, 60 + l_extendedprice / 10000 as lap_s, l_linenumber as tyre_life,
        case when l_returnflag = 'R' then '4' else '1' end as track_status, l_linestatus = 'F' as is_accurate, l_shipdate::DATE as date, l_orderkey as order_key, l_partkey as part_key
        from lineitem join supplier on l_suppkey = s_suppkey"""),
    "valid": (("laps",), "select * from laps where is_accurate and track_status = '1' and lap_s > 60"),
    "long": (("valid",), f"select * from (select *, count(lap_s) over ({STINT}) as n from valid) where n >= 5"),
    "fuel": (("long",), f"select *, lap_s - greatest(max(tyre_life) over ({STINT}) - tyre_life, 0) * 1.6::DOUBLE * 0.035::DOUBLE as corrected_s from long"),
    "iqr": (("fuel",), f"select * from (select *, quantile_cont(corrected_s, 0.75) over ({STINT}) * 4 - quantile_cont(corrected_s, 0.25) over ({STINT}) * 3 as bound from fuel) where corrected_s <= bound"),
    "long_run": (("iqr",), "select season, round, driver, min(team) as team, median(corrected_s) as long_run_pace_s, count(*) as long_run_n from iqr group by season, round, driver"),
    "best": (("laps",), "select season, round, driver, min(lap_s) as fp_best_lap_s from laps where is_accurate and lap_s > 60 group by season, round, driver"),
    "quali": (("laps",), "select season, round, driver, min(lap_s) as quali_pace_s from laps where not is_accurate and lap_s > 60 group by season, round, driver"),
    "teams": (("laps",), "select season, round, driver, min(team) as any_team from laps where is_accurate group by season, round, driver"),
    "pace": (("long_run", "best", "quali", "teams"), """select season, round, driver, coalesce(team, any_team) as team, long_run_pace_s, long_run_n, fp_best_lap_s, quali_pace_s
        from long_run full join best using (season, round, driver) left join quali using (season, round, driver) left join teams using (season, round, driver)"""),
    "suspects": (("pace",), """select *, coalesce(count(long_run_pace_s) over w = 2 and max(long_run_pace_s) over w - min(long_run_pace_s) over w > 0.5 and long_run_pace_s = max(long_run_pace_s) over w, false) as long_run_suspect,
        coalesce(count(quali_pace_s) over w = 2 and max(quali_pace_s) over w - min(quali_pace_s) over w > 0.5 and quali_pace_s = max(quali_pace_s) over w, false) as quali_suspect
        from pace window w as (partition by season, round, team)"""),
    "signal": (("suspects",), """select season, round, driver, team, case when long_run_pace_s <= min(long_run_pace_s) over (partition by round) + 10.0::DOUBLE and not long_run_suspect then long_run_pace_s end as x from suspects"""),
    "within": (("signal",), """select * from (select *, count(*) over w as mates, avg(x) over w - x as speed from signal where x is not null window w as (partition by season, round, team)) where mates >= 2"""),
    "driver_raw": (("within",), "select driver, avg(speed) as mean, stddev_samp(speed) as std, count(*) as n_obs from within group by driver"),
    "driver_strength": (("driver_raw",), "select driver, mean - avg(mean) over () as mean, case when n_obs >= 2 then greatest(std / sqrt(n_obs), 0.01::DOUBLE) else 2.0::DOUBLE end as sd, n_obs from driver_raw"),
    "team_round": (("signal",), "select season, round, team, avg(x) as pace from signal where x is not null group by season, round, team"),
    "team_speed": (("team_round",), "select *, avg(pace) over (partition by round) - pace as speed from team_round"),
    "team_strength": (("team_speed",), """select team, avg(speed) as mean, case when count(*) >= 2 then greatest(stddev_samp(speed) / sqrt(count(*)), 0.01::DOUBLE) else 2.0::DOUBLE end as sd, count(*) as n_obs from team_speed group by team"""),
    "engine_of": (("laps",), "select distinct team, engine from laps"),
    "engine_mean": (("team_strength", "engine_of"), "select engine, sum(n_obs * mean) / sum(n_obs) as centre, sum(n_obs) as w, max(n_obs) as most, count(*) as n_teams from team_strength join engine_of using (team) group by engine"),
    "engine_strength": (("engine_mean",), """select e.engine, any_value(e.centre) as mean, case when any_value(e.n_teams) >= 2 then greatest(sqrt(sum(t.n_obs * pow(t.mean - e.centre, 2)) / any_value(e.w)) / sqrt(any_value(e.w) / any_value(e.most)), 0.01::DOUBLE)
        else 2.0::DOUBLE end as sd, any_value(e.n_teams) as n_teams from engine_mean e join engine_of o on e.engine = o.engine join team_strength t on t.team = o.team group by e.engine"""),
    "signal_rounds": (("signal",), "select distinct round as as_of_round from signal where x is not null"),
    "walk_driver": (("within", "signal_rounds"), f"select as_of_round, driver, avg(speed) as mean, {SD} as sd, count(*) as n_obs from within join signal_rounds on round <= as_of_round group by as_of_round, driver"),
    "walk_team": (("team_speed", "signal_rounds"), f"select as_of_round, team, avg(speed) as mean, {SD} as sd, count(*) as n_obs from team_speed join signal_rounds on round <= as_of_round group by as_of_round, team"),
    "raw_results": ((), "select (day(ts) - 1) // 3 + 1 as round, user_id as driver, round(sum(value), 6) as v, arg_max(event_type, event_id) as event_type from events group by 1, 2"),
    "results": (("raw_results",), f"""select 2024 as season, round, driver, driver % 11 as team, driver % 11 % 4 as engine, v,
        case event_type when 'error' then 'Engine' when 'signup' then 'Collision damage' when 'click' then '+1 Lap' when 'purchase' then 'Retired' when 'view' then 'Finished' end as status,
        position, {points_of('position', RACE_POINTS)} as points, row_number() over (partition by round order by (driver * 7919) % 1009, driver) as grid, date '2024-01-01' + ((round - 1) * 3)::INTEGER as date
        from (select *, row_number() over (partition by round order by v desc, driver) as position from raw_results)"""),
    "usage": ((), """select o_custkey as driver, case o_orderpriority when '1-URGENT' then 'ICE' when '2-HIGH' then 'TC' when '3-MEDIUM' then 'EX' when '4-NOT SPECIFIED' then 'MGU_K' when '5-LOW' then 'ES' end as component,
        count(*) as used, 2 as allowed from orders group by 1, 2"""),
    "standings": ((), "select driver, points, row_number() over (order by points desc, driver) as position from (select s_suppkey as driver, floor(greatest(s_acctbal, 0) / 100)::DOUBLE as points from supplier)"),
    "schedule": (("laps",), "select season, round, min(date) as first_practice, max(date) as date, round % 2 = 0 as has_sprint from laps group by season, round"),
    "field": (("standings",), """select driver, points / 20 as mean, 0.3::DOUBLE + (driver % 5) / 10.0::DOUBLE as sd, 0.05::DOUBLE + (driver % 4) * 0.05::DOUBLE as dnf,
        case when driver % 6 = 0 then 10 when driver % 10 = 1 then 20 else 0 end as penalty_positions, driver % 10 = 1 as pit_lane from standings"""),
    "penalised": (("field",), "select *, mean - penalty_positions * 0.02::DOUBLE * (case when pit_lane then 1.5::DOUBLE else 1.0::DOUBLE end) as eff, avg(mean) over () as field_mean from field"),
    "orders_raw": (("penalised",), f"""select s.sim_id, 'race' as race, driver, eff + -ln(-ln({unit('order', 'sim_id', "'race'", 'driver')})) * 0.5::DOUBLE as speed,
        {unit('dnf', 'sim_id', "'race'", 'driver')} < dnf as dnf_flag from (select unnest(range(1000)) as sim_id) s, penalised"""),
    "sims": (("orders_raw",), f"""select *, case when dnf_flag then 0.0::DOUBLE else {points_of('pos', RACE_POINTS)} end as points from
        (select *, row_number() over (partition by sim_id, race order by dnf_flag, round(speed, 9) desc, driver) as pos from orders_raw)"""),
    "chaos_flags": (("penalised",), f"select *, {unit('car', 'sim_id', chr(39) + 'race' + chr(39))} < 0.55 as car, {unit('rain', 'sim_id', chr(39) + 'race' + chr(39))} < 0.1 as rain from (select unnest(range(1000)) as sim_id) s, penalised"),
    "chaos_raw": (("chaos_flags",), f"""select sim_id, driver, car, rain, (case when rain then field_mean + (eff - field_mean) * 0.65::DOUBLE else eff end)
        + -ln(-ln({unit('order', 'sim_id', "'race'", 'driver')})) * (0.5::DOUBLE * (case when car then 1.35::DOUBLE else 1.0::DOUBLE end) * (case when rain then 1.25::DOUBLE else 1.0::DOUBLE end)) as speed,
        {unit('dnf', 'sim_id', "'race'", 'driver')} < least(greatest(dnf + 0.02::DOUBLE, 0), 1) as dnf_flag from chaos_flags"""),
    "chaos_sims": (("chaos_raw",), f"""select *, case when dnf_flag then 0.0::DOUBLE else {points_of('pos', RACE_POINTS)} end as points from
        (select *, row_number() over (partition by sim_id order by dnf_flag, round(speed, 9) desc, driver) as pos from chaos_raw)"""),
    "races": (("schedule",), "select round, false as is_sprint, round::VARCHAR || 'r' as race from schedule union all select round, true, round::VARCHAR || 's' from schedule where has_sprint"),
    "season_dev": (("field",), "select sim_id, driver, mean, sd, dnf, " + normal_of("w0", "w1") + " as dev from (" + blocks("select sim_id, driver, mean, sd, dnf, " + counter("sim_id", "0", "driver") + " from (select unnest(range(1000)) as sim_id) s, field", "sim_id, driver, mean, sd, dnf", 1) + ")"),
    "season_blocks": (("races", "season_dev"), blocks("select sim_id, race, is_sprint, driver, mean, sd, dnf, dev, " + counter("sim_id", "round * 2 + is_sprint::INTEGER", "driver") + " from races, season_dev", "sim_id, race, is_sprint, driver, mean, sd, dnf, dev", 0)),
    "season_raw": (("season_blocks",), f"""select sim_id, race, is_sprint, driver, mean + {normal_of('w2', 'w3')} * greatest(sd, 1e-9) + dev * 0.4::DOUBLE + -ln(-ln({unit_of('w0')})) * 0.5::DOUBLE as speed,
        {unit_of('w1')} < dnf as dnf_flag from season_blocks"""),
    "season": (("season_raw", "standings"), f"""select p.sim_id, p.driver, p.driver // 2 as team, s.position as standing, s.points as start_points, p.sim_points from (
        select sim_id, driver, sum(case when dnf_flag then 0.0::DOUBLE when is_sprint then {points_of('pos', SPRINT_POINTS)} else {points_of('pos', RACE_POINTS)} end) as sim_points
        from (select *, row_number() over (partition by sim_id, race order by dnf_flag, round(speed, 9) desc, driver) as pos from season_raw) group by sim_id, driver) p join standings s on p.driver = s.driver"""),
    "scores": (("results",), "select round + 1 as round, driver, v / 100 as score from results"),
    "win": (("scores",), "select round, driver, e / sum(e) over (partition by round) as p from (select *, exp(score - max(score) over (partition by round)) as e from scores)"),
    "winy": (("win", "results"), "select w.round, w.driver, w.p, coalesce((r.position = 1)::INTEGER, 0) as y from win w left join results r on w.round = r.round and w.driver = r.driver where w.round in (select round from results where position = 1)"),
    "canon_raw": (("scores",), f"""select sim_id, round, driver, row_number() over (partition by sim_id, round order by round(score + -ln(-ln({unit('order', 'sim_id', 'round', 'driver')})) * 0.5::DOUBLE, 9) desc, driver) as pos
        from (select unnest(range(1000)) as sim_id) s, scores"""),
    "canon": (("canon_raw",), """select g.round, g.driver, p.pos as finish_pos, coalesce(n, 0) / 1000.0::DOUBLE as probability from (select distinct round, driver from canon_raw) g
        join (select distinct round, pos from canon_raw) p on g.round = p.round left join (select round, driver, pos, count(*) as n from canon_raw group by 1, 2, 3) c on c.round = g.round and c.driver = g.driver and c.pos = p.pos"""),
    "bins": (("winy",), """select i::INTEGER as bin, i * (1 / 10.0::DOUBLE) as lo, (i + 1) * (1 / 10.0::DOUBLE) as hi from (select unnest(range(10)) as i)"""),
    "pairs": (("winy", "results"), "select p, y from winy where driver in (select driver from results)"),
    "diagram": (("bins", "pairs"), "select bin, lo, hi, avg(p) as mp, avg(y) as mo, count(p) as n from bins left join pairs on p >= lo and (p < hi or (bin = 9 and p <= 1)) group by bin, lo, hi"),
    "ranks": (("win", "results"), """select round, driver, rank() over (partition by round order by round(p, 12) desc) + (count(*) over (partition by round, round(p, 12)) - 1) / 2.0::DOUBLE as a,
        rank() over (partition by round order by position) as b from (select w.round, w.driver, w.p, r.position from win w join results r on w.round = r.round and w.driver = r.driver)"""),
    "rho": (("ranks",), "select round, case when count(*) >= 2 then 1 - 6 * sum(pow(a - b, 2)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)) end as rank_corr from ranks group by round"),
    "top3": (("canon",), "select round, driver, sum(probability) as p from canon where finish_pos <= 3 group by round, driver"),
    "people": ((), "select c_custkey as key, c_mktsegment || ' Customer_' || split_part(c_name, '#', 2) as full_name from customer"),
    "ids": ((), "select lower(replace(s_name, '#', '_')) as id from supplier"),
}

# the same relations over features whose missing teams were filled
CTE["filled"] = (("pace",), """select season, round, driver, coalesce(last_value(hole ignore nulls) over (w rows between unbounded preceding and current row), first_value(hole ignore nulls) over (w rows between current row and unbounded following)) as team,
    long_run_pace_s, long_run_n, fp_best_lap_s, quali_pace_s from (select *, case when (driver + round) % 3 <> 0 then team end as hole from pace) window w as (partition by driver order by season, round)""")
_OVER_FILLED = {"pace": "filled"} | {n: f"filled_{n}" for n in ("suspects", "signal", "within", "team_round", "team_speed", "signal_rounds", "walk_driver", "walk_team")}
for _name in list(_OVER_FILLED)[1:]:
    _uses, _sql = CTE[_name]
    _sql = re.sub(r"\b(from|join) (\w+)", lambda m: f"{m[1]} {_OVER_FILLED.get(m[2], m[2])}", _sql)
    CTE[_OVER_FILLED[_name]] = (tuple(_OVER_FILLED.get(u, u) for u in _uses), _sql)


def query(select: str, *names: str) -> str:
    """The SELECT behind the CTEs it needs, in order of use."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in CTE[name][0]:
                visit(n)
            order.append(name)

    for n in names:
        visit(n)
    return ("with " + ",\n".join(f"{n} as ({CTE[n][1]})" for n in order) + "\n" if order else "") + select


def _risk() -> str:
    life = "case component " + " ".join(f"when '{c}' then {v}::DOUBLE" for c, v in COMPONENT_LIVES.items()) + " end"
    terms = "1 + rate + rate * rate / 2"  # at most two units are left
    cdf = f"least(exp(-rate) * (case rest when 0 then 1 when 1 then 1 + rate else {terms} end), 1)"
    return f"""select driver, {rounded('1 - ok')} as penalty_risk_season, {rounded('least((1 - ok) / 5, 1)')} as penalty_risk_next_race, {rounded('10 + greatest(round_even(extra, 0) - 1, 0) * 5')} as expected_penalty_pos from (
      select driver, product(1 - p) as ok, sum(greatest(rate - rest, 0) * p) as extra from (select *, 1 - {cdf} as p from (
        select *, 290.0::DOUBLE / ({life}) as rate, greatest(allowed - used, 0) as rest from usage)) group by driver)"""


def _penalties() -> str:
    own = ", ".join(
        f"coalesce(max(case when component = '{c}' then used end), 0)::BIGINT as {c}_used, coalesce(max(case when component = '{c}' then greatest(allowed - used, 0) end), 0)::BIGINT as {c}_remaining"
        for c in COMPONENTS
    )
    lost = "sum(case when used <= allowed then 0 else 10 + (used - allowed - 1) * 5 end)"
    return f"select driver, {own}, {lost}::BIGINT as penalty_positions_total, {lost} > 15 as starts_from_pit_lane from usage group by driver"


def _reliability(key: str, full: bool) -> str:
    k = status_kind("status")
    parts = [f"{key}", "count(*)::BIGINT as starts", f"count(*) filter ({k} = 'mechanical')::BIGINT as mechanical_dnfs"]
    if full:
        parts += [f"count(*) filter ({k} = 'incident')::BIGINT as incident_dnfs", f"count(*) filter ({k} = 'other')::BIGINT as other_dnfs"]
    parts += [f"count(*) filter ({k} <> 'finished')::BIGINT as total_dnfs", beta(f"count(*) filter ({k} = 'mechanical')", "count(*)", "mechanical") + " as mechanical_dnf_rate"]
    if full:
        parts.append(beta(f"count(*) filter ({k} = 'incident')", "count(*)", "incident") + " as incident_dnf_rate")
    parts.append(beta(f"count(*) filter ({k} <> 'finished')", "count(*)", "total") + " as total_dnf_rate")
    return f"select {', '.join(parts)} from results group by {key}"


def _gaps(team: str, relation: str) -> str:
    return f"""select season, round, {team}, driver, {rounded('case when n = 2 then long_run_pace_s - o1 end')} as gap_race, {rounded('case when n = 2 then quali_pace_s - o2 end')} as gap_quali from (
      select *, count(*) over (partition by season, round, {team}) as n, coalesce(lead(long_run_pace_s) over w, lag(long_run_pace_s) over w) as o1, coalesce(lead(quali_pace_s) over w, lag(quali_pace_s) over w) as o2
      from (select *, row_number() over (partition by season, round, {team} order by driver) as rn from {relation}) where rn <= 2 window w as (partition by season, round, {team} order by driver))"""


def _base() -> dict[str, str]:
    q = query
    mean_pts = lambda c: rounded(f"avg({c})")
    summary = f"""select driver, {rounded('avg((pos = 1)::INTEGER)')} as win_prob, {rounded('avg((pos <= 3)::INTEGER)')} as podium_prob, {rounded('avg((pos <= 10)::INTEGER)')} as top10_prob,
        {rounded('avg(dnf_flag::INTEGER)')} as dnf_prob, {mean_pts('points')} as expected_points from {{}} group by driver"""
    bs = "select round, {} as bs_win from winy group by round".format(rounded("avg(pow(p - y, 2))"))
    return {
        "scan_project_filter": q(f"select season::BIGINT as season, round::BIGINT as round, driver, stint, lap_number::BIGINT as lap_number, {rounded('lap_s')} as lap_s from valid", "valid"),
        "lap_units": q(f"select order_key, part_key, driver, lap_number::BIGINT as lap_number, {rounded('lap_s')} as from_ns, {rounded('lap_s')} as from_interval, {rounded('lap_s')} as from_text, null::DOUBLE as from_bad from laps", "laps"),
        "long_stints": q(f"select season::BIGINT as season, round::BIGINT as round, driver, stint, lap_number::BIGINT as lap_number, {rounded('lap_s')} as lap_s from long", "long"),
        "fuel_corrected": q(f"select season::BIGINT as season, round::BIGINT as round, driver, stint, lap_number::BIGINT as lap_number, {rounded('lap_s')} as lap_s, {rounded('corrected_s')} as corrected_s from fuel", "fuel"),
        "fuel_corrected_rank": q(f"""select season::BIGINT as season, round::BIGINT as round, driver, stint, lap_number::BIGINT as lap_number, order_key, part_key,
            {rounded(f"lap_s - greatest(count(*) over ({STINT}) - row_number() over ({STINT} order by lap_number, order_key, part_key, lap_s), 0) * 1.6::DOUBLE * 0.035::DOUBLE")} as corrected_s from long""", "long"),
        "stint_iqr_filter": q(f"select season::BIGINT as season, round::BIGINT as round, driver, stint, lap_number::BIGINT as lap_number, {rounded('corrected_s')} as corrected_s from iqr", "iqr"),
        "long_run_pace": q(f"select season::BIGINT as season, round::BIGINT as round, driver, team, {rounded('long_run_pace_s')} as long_run_pace_s, long_run_n::BIGINT as long_run_n from long_run", "long_run"),
        "session_best": q(f"select season::BIGINT as season, round::BIGINT as round, driver, {rounded('fp_best_lap_s')} as fp_best_lap_s from best", "best"),
        "pace_features": q(f"""select season::BIGINT as season, round::BIGINT as round, driver, team, {rounded('long_run_pace_s')} as long_run_pace_s, long_run_n::BIGINT as long_run_n,
            {rounded('fp_best_lap_s')} as fp_best_lap_s, {rounded('quali_pace_s')} as quali_pace_s from pace""", "pace"),
        "trimmed_mean_pace": q(f"""select driver, team, {rounded('avg(case when n < 3 or lap_s <= bound then lap_s end)')} as testing_long_run_s, count(*)::BIGINT as testing_laps_n from (
            select *, count(*) over (partition by driver, team) as n, quantile_cont(lap_s, 0.9) over (partition by driver, team) as bound from (
              select *, count(*) over (partition by driver, season, stint) as k from laps) where k >= 5) group by driver, team""", "laps"),
        "sprint_pace": q(f"""select season::BIGINT as season, round::BIGINT as round, driver, min(team) as team, {rounded('median(lap_s)')} as sprint_pace_s, count(*)::BIGINT as n from
            (select *, max(lap_number) over (partition by season, round) as last from laps) where lap_s > 0 and lap_number > 1 and lap_number < last group by season, round, driver having count(*) >= 3""", "laps"),
        "teammate_gaps": q(_gaps("team", "pace").replace("select season, round,", "select season::BIGINT as season, round::BIGINT as round,", 1), "pace"),
        "teammate_gaps_nation": q(_gaps("nation_team", "pn").replace("select season, round,", "select season::BIGINT as season, round::BIGINT as round,", 1).replace("nation_team, driver,", "nation_team::BIGINT as nation_team, driver,", 1)
            .replace("from pn)", "from (select pace.*, s_nationkey as nation_team from pace join supplier on s_suppkey = driver))"), "pace"),
        "intra_team_suspects": q("select season::BIGINT as season, round::BIGINT as round, driver, team, long_run_suspect, quali_suspect from suspects", "suspects"),
        "team_ffill_bfill": q("""select round::BIGINT as round, driver, coalesce(last_value(t ignore nulls) over (partition by driver order by round rows between unbounded preceding and current row),
            first_value(t ignore nulls) over (partition by driver order by round rows between current row and unbounded following)) as team from (select round, driver, case when (driver + round) % 3 <> 0 then team end as t from pace)""", "pace"),
        "field_outliers": q(f"select season::BIGINT as season, round::BIGINT as round, driver, {rounded('case when quali_pace_s <= min(quali_pace_s) over (partition by round) + 1.0::DOUBLE then quali_pace_s end')} as quali_pace_s from pace", "pace"),
        "driver_strength": q(f"select driver, {rounded('mean')} as mean, {rounded('sd')} as sd, n_obs::BIGINT as n_obs from driver_strength", "driver_strength"),
        "team_strength": q(f"select team, {rounded('mean')} as mean, {rounded('sd')} as sd, n_obs::BIGINT as n_obs, engine from team_strength left join engine_of using (team)", "team_strength", "engine_of"),
        "engine_strength": q(f"select engine, {rounded('mean')} as mean, {rounded('sd')} as sd, n_teams::BIGINT as n_teams from engine_strength", "engine_strength", "engine_of", "team_strength"),
        "strength_long": q(" union all ".join(f"select 7::BIGINT as as_of_round, '{k}' as entity_type, {k}::VARCHAR as entity_id, {rounded('mean')} as mean, {rounded('sd')} as sd from {k}_strength" for k in ("driver", "team", "engine")),
            "driver_strength", "team_strength", "engine_strength"),
        "strength_walk": q(f"""select as_of_round::BIGINT as as_of_round, entity_type, entity_id, {rounded('mean', 10)} as mean, {rounded('sd', 10)} as sd, n_obs::BIGINT as n_obs from (
            select as_of_round, 'driver' as entity_type, driver::VARCHAR as entity_id, mean - avg(mean) over (partition by as_of_round) as mean, sd, n_obs from walk_driver
            union all select as_of_round, 'team', team::VARCHAR, mean, sd, n_obs from walk_team
            union all select m.as_of_round, 'engine', m.engine::VARCHAR, any_value(m.centre), case when count(*) >= 2 then greatest(sqrt(sum(t.n_obs * pow(t.mean - m.centre, 2)) / any_value(m.w)) / sqrt(any_value(m.w) / any_value(m.most)), 0.01::DOUBLE)
                else 2.0::DOUBLE end, count(*) from walk_team t join engine_of o on t.team = o.team join (
                    select as_of_round, engine, sum(n_obs * mean) / sum(n_obs) as centre, sum(n_obs) as w, max(n_obs) as most from walk_team join engine_of using (team) group by as_of_round, engine
                ) m on m.as_of_round = t.as_of_round and m.engine = o.engine group by m.as_of_round, m.engine)""", "walk_driver", "walk_team", "engine_of"),
        "streamed_teams": q("select season::BIGINT as season, round::BIGINT as round, driver::BIGINT as driver, team::BIGINT as team from filled", "filled"),
        "streamed_strengths": q(f"""select as_of_round::BIGINT as as_of_round, entity_type, entity_id, {rounded('mean', 10)} as mean, {rounded('sd', 10)} as sd, n_obs::BIGINT as n_obs from (
            select as_of_round, 'driver' as entity_type, driver::VARCHAR as entity_id, mean - avg(mean) over (partition by as_of_round) as mean, sd, n_obs from filled_walk_driver
            union all select as_of_round, 'team', team::VARCHAR, mean, sd, n_obs from filled_walk_team)""", "filled_walk_driver", "filled_walk_team"),
        "known_at_cutoffs": q(f"""select a.season::BIGINT as season, a.round::BIGINT as round, a.driver, a.cutoff::VARCHAR as cutoff, {latest('team')} as team, {rounded(latest('lap_s'))} as lap_s, {latest('standing')}::BIGINT as standing
            from (select * from (select distinct driver from laps), (select season, round, first_practice as cutoff from schedule)) a left join (
                select driver, date, case when order_key % 5 <> 0 then team end as team, round(lap_s, 6) as lap_s, null::BIGINT as standing from laps
                union all select driver, max(date), null, null, floor(min(lap_s) * 10)::BIGINT from laps group by season, round, driver
            ) f on f.driver = a.driver and f.date < a.cutoff group by all""", "laps", "schedule"),
        "weather_at_laps": f"""select day(e.ts)::BIGINT as day, e.user_id as driver, e.event_id as lap, {rounded('arg_max(round(w.value, 6), (w.ts, w.event_id))')} as air_temp
            from events e left join events w on w.event_type = 'view' and day(w.ts) = day(e.ts) and w.ts <= e.ts group by day(e.ts), e.user_id, e.event_id""",
        "messages_in_laps": """select l.day::BIGINT as day, l.driver, l.lap, count(*)::BIGINT as messages, min(m.event_id) as low, max(m.event_id) as high
            from (select day(ts) as day, user_id as driver, event_id as lap, ts as a, lead(ts) over (partition by day(ts), user_id order by ts, event_id) as b from events) l
            join events m on m.event_type = 'error' and day(m.ts) = l.day and m.ts >= l.a and m.ts < l.b group by l.day, l.driver, l.lap""",
        "race_of_a_checked_field": q(f"""select driver, {rounded('avg((pos = 1)::INTEGER)')} as win_prob, {rounded('avg((pos <= 3)::INTEGER)')} as podium_prob, {rounded('avg((pos <= 10)::INTEGER)')} as top10_prob,
            {rounded('avg(dnf_flag::INTEGER)')} as dnf_prob, {rounded('avg(case when dnf_flag then 0.0::DOUBLE else ' + points_of('pos', RACE_POINTS) + ' end)')} as expected_points
            from (select *, row_number() over (partition by sim_id order by dnf_flag, round(speed, 9) desc, driver) as pos from orders_raw where driver in (select driver from standings where position <= 22)) group by driver""", "orders_raw", "standings"),
        "calendar_checks": q("""select 'rounds without gaps' as "constraint", '2026/' || round as subject from (select round, row_number() over (order by round) as nth from schedule) where round <> nth
            union all select 'circuits once', '2026/c' || round % 3 from schedule group by round % 3 having count(*) > 1
            union all select 'overtaking', '2026/' || round from schedule where round % 4 = 0
            union all select 'sprint rounds', '2026/' || round from schedule where has_sprint <> (round in (2, 5))
            union all select 'number of rounds', '2026' from schedule having count(distinct round) <> 22""", "schedule"),
        "driver_total_strength": q(f"""select d.driver, l.team, {rounded('d.mean + coalesce(t.mean, 0)')} as mean, {rounded('d.sd')} as sd from driver_strength d
            left join (select driver, arg_max(team, season) as team from pace where team is not null group by driver) l on l.driver = d.driver left join team_strength t on t.team = l.team""", "driver_strength", "team_strength", "pace"),
        "grid_modifier": q(f"""select f.round::BIGINT as round, f.driver, {rounded('0.15::DOUBLE * (1 - 2 * (f.grid - 1) / greatest(n - 1, 1)::DOUBLE)')} as move from results f join (select round, count(*) as n from results group by round) c on c.round = f.round""", "results"),
        "status_class": q(f"select round::BIGINT as round, driver, status, {status_kind('status')} as kind from results", "results"),
        "driver_reliability": q(_reliability("driver", True), "results"),
        "team_reliability": q(_reliability("team", False), "results"),
        "engine_reliability": q(_reliability("engine", False), "results"),
        "penalty_positions": q(_penalties(), "usage"),
        "penalty_risk": q(_risk(), "usage"),
        "rookie_flags": q("""select s.round::BIGINT as round, s.car, s.driver, coalesce(s.driver = p.driver, true) as is_regular from (select round, grid as car, driver::VARCHAR as driver from results) s
            left join (select round + 1 as round, grid as car, driver::VARCHAR as driver from results) p on p.round = s.round and p.car = s.car""", "results"),
        "absent_regulars": q("select a.round::BIGINT as round, a.driver from (select distinct round + 1 as round, driver from results where round < (select max(round) from results)) a left join (select * from results where (driver + round) % 7 <> 0) b on a.round = b.round and a.driver = b.driver where b.driver is null", "results"),
        "identity_bridge": q("""select p.key, p.full_name, coalesce(a.id, t.id, c.id) as id, (case when a.id is not null then 1 when t.id is not null then 2 when c.id is not null then 3 end)::BIGINT as rule from
            (select *, string_split_regex(lower(trim(full_name)), '\\s+') as w from people) p left join (select distinct id from ids) a on a.id = w[len(w)]
            left join (select tail, max(id) as id from (select distinct id, split_part(id, '_', -1) as tail from ids where contains(id, '_')) group by tail having count(*) = 1) t on t.tail = w[len(w)]
            left join (select distinct id from ids) c on c.id = array_to_string(w, '_')""", "people", "ids"),
        "upsert_latest": q("""select driver, component, units_used::BIGINT as units_used, batch::BIGINT as batch from (select *, row_number() over (partition by driver, component order by batch desc) as n from (
            select driver, component, used as units_used, 0 as batch from usage union all select driver, component, used + 1, 1 from usage where driver % 3 = 0)) where n = 1""", "usage"),
        "replace_by_round": q(f"""select round::BIGINT as round, driver, {rounded('v')} as v, src from (select round, driver, v, 'old' as src from results where round not in (select round from results where round % 2 = 0)
            union all select round, driver, v + 1, 'new' from results where round % 2 = 0)""", "results"),
        "last_nonnull_per_key": q("select driver, arg_max(status, round) filter (status <> 'Finished') as status, arg_max(position, round) filter (position > 3)::BIGINT as position from results group by driver", "results"),
        "topk_per_round": q(f"select round::BIGINT as round, driver, {rounded('p')} as p, rk::BIGINT as rk from (select *, row_number() over (partition by round order by round(p, 12) desc, driver) as rk from win) where rk <= 3", "win"),
        "next_round": q("select min(round)::BIGINT as next_round from schedule where date > date '1998-06-30'", "schedule"),
        "last_completed": q("select coalesce(arg_max(round, date), 0)::BIGINT as last_round from schedule where date < date '1998-06-30'", "schedule"),
        "points_scoring": q(f"""select round::BIGINT as round, driver, position::BIGINT as position, {rounded(f"case when {status_kind('status')} in ('finished') then {points_of('position', RACE_POINTS)} else 0 end")} as race_points,
            {rounded(f"case when {status_kind('status')} in ('finished') then {points_of('position', SPRINT_POINTS)} else 0 end")} as sprint_points from results""", "results"),
        "grid_penalty_strength": q(f"select driver, {rounded('eff')} as mean from penalised", "penalised"),
        "plackett_luce_orders": q("select sim_id, driver, row_number() over (partition by sim_id order by round(speed, 9) desc, driver)::BIGINT as pos from orders_raw", "orders_raw"),
        "dnf_reorder": q("select sim_id, driver, dnf_flag, pos::BIGINT as pos, (count(*) filter (not dnf_flag) over (partition by sim_id))::BIGINT as n_finishers from sims", "sims"),
        "race_summary": q(summary.format("sims"), "sims"),
        "finish_distribution": q(f"""select d.driver, p.pos::BIGINT as finish_pos, {rounded('coalesce(n, 0) / 1000.0::DOUBLE')} as probability from (select distinct driver from sims) d, (select distinct pos from sims) p
            left join (select driver, pos, count(*) as n from sims group by driver, pos) c on c.driver = d.driver and c.pos = p.pos""", "sims"),
        "race_chaos": q(summary.format("chaos_sims"), "chaos_sims"),
        "season_points": q(f"select sim_id, driver, {rounded('sim_points')} as sim_points from season", "season"),
        "title_probability": q(f"""select driver, {rounded('avg((place = 1)::INTEGER)')} as title_prob, {rounded('avg(total)')} as expected_points, {rounded('avg(sim_points)')} as expected_added from (
            select *, start_points + sim_points as total, row_number() over (partition by sim_id order by start_points + sim_points desc, standing, driver) as place from season) group by driver""", "season"),
        "constructor_title": q(f"""select team, {rounded('avg((place = 1)::INTEGER)')} as title_prob, {rounded('avg(total)')} as expected_points from (
            select *, row_number() over (partition by sim_id order by total desc, standing, team) as place from (select s.sim_id, s.team, sum(s.start_points + s.sim_points) as total, min(s.standing) as standing from season s group by 1, 2)) group by team""", "season"),
        "magic_number": q(f"""select driver, {rounded('points - (case when position = 1 then (select max(points) from standings where position > 1) else (select max(points) from standings) end + 3 * 33)')} as magic_number from standings""", "standings"),
        "win_probs_softmax": q(f"select round::BIGINT as round, driver, {rounded('p')} as p from win", "win"),
        "brier_win": q(bs, "winy"),
        "brier_topk": q(f"""select t.round::BIGINT as round, {rounded('avg(pow(p - coalesce((r.position <= 3)::INTEGER, 0), 2))')} as bs_top3 from top3 t left join results r on r.round = t.round and r.driver = t.driver
            where t.round in (select round from results) group by t.round""", "top3", "results"),
        "brier_full": q(f"""select c.round::BIGINT as round, {rounded('avg(pow(probability - coalesce((r.position = finish_pos)::INTEGER, 0), 2))')} as bs_full from canon c left join results r on r.round = c.round and r.driver = c.driver
            where c.round in (select round from results) group by c.round""", "canon", "results"),
        "log_loss_win": q(f"select round::BIGINT as round, {rounded('-avg(case when y = 1 then ln(least(greatest(p, 1e-6), 1 - 1e-6)) else ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) end)')} as log_loss_win from winy group by round", "winy"),
        "reliability_diagram": q(f"select bin::BIGINT as bin, {rounded('lo')} as bin_lower, {rounded('hi')} as bin_upper, {rounded('(lo + hi) / 2')} as bin_center, {rounded('mp')} as mean_pred, {rounded('mo')} as mean_obs, n::BIGINT as count, {rounded('abs(mp - mo)')} as gap from diagram", "diagram"),
        "ece": q(f"select {rounded('sum(n * abs(mp - mo)) / sum(n)')} as ece from diagram", "diagram"),
        "rank_correlation": q(f"select round::BIGINT as round, {rounded('rank_corr')} as rank_corr from rho", "rho"),
        "eval_per_round": q(f"""select w.round::BIGINT as round, {rounded('avg(pow(p - y, 2))')} as bs_win, {rounded('any_value(rank_corr)')} as rank_corr,
            {rounded('-avg(case when y = 1 then ln(least(greatest(p, 1e-6), 1 - 1e-6)) else ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) end)')} as log_loss_win, {rounded('any_value(bs3)')} as bs_top3 from winy w left join rho on rho.round = w.round
            left join (select w.round, avg(pow(w.p - coalesce((r.position <= 3)::INTEGER, 0), 2)) as bs3 from win w left join results r on r.round = w.round and r.driver = w.driver group by w.round) t on t.round = w.round group by w.round""", "winy", "rho", "win", "results"),
        "accuracy": q("""select w.round::BIGINT as round, x.driver as winner, arg_min(w.driver, rk) as predicted_winner, bool_or(w.driver = x.driver and rk = 1) as top1_hit, bool_or(w.driver = x.driver) as top3_hit
            from (select *, row_number() over (partition by round order by round(p, 12) desc, driver) as rk from win) w join results x on x.round = w.round and x.position = 1 where rk <= 3 group by w.round, x.driver""", "win", "results"),
        "skill_score": q(f"select w.round::BIGINT as round, {rounded('1 - bs / ((n - 1) / (n * n)::DOUBLE)')} as skill from (select round, avg(pow(p - y, 2)) as bs, count(*) as n from winy group by round) w", "winy"),
        "round_cutoffs": q("select season::BIGINT as season, round::BIGINT as round, (case when round % 3 = 0 then date - 2 else first_practice end)::VARCHAR as cutoff from schedule", "schedule"),
        "leakage_violations": q("select l.season::BIGINT as season, l.round::BIGINT as round, (count(*) filter (l.date >= s.first_practice + 180))::BIGINT as leaked, count(*)::BIGINT as rows from laps l join schedule s on s.season = l.season and s.round = l.round group by l.season, l.round", "laps", "schedule"),
        "prior_rounds_snapshot": q(f"select p.season::BIGINT as season, p.round::BIGINT as round, p.driver, {rounded('quali_pace_s')} as quali_pace_s, s.date::VARCHAR as date from pace p join schedule s on s.season = p.season and s.round = p.round where p.round < 5", "pace", "schedule"),
        "replay_status": q("select round::BIGINT as round, case when round % 4 = 0 then 'snapshot_missing' when round <= 3 then 'prediction_frozen' else 'prediction_missing' end as status from (select distinct round from schedule)", "schedule"),
        "coverage": q(f"select season::BIGINT as season, round::BIGINT as round, {rounded('avg((long_run_pace_s is not null)::INTEGER)')} as long_run_pace_s_coverage, {rounded('avg((quali_pace_s is not null)::INTEGER)')} as quali_pace_s_coverage from pace group by season, round", "pace"),
        "export_driver_rows": q(f"""select c.round::BIGINT as round, c.driver, round_even(round(sum(case when finish_pos = 1 then probability else 0 end) * 10000, 6), 0) / 10000.0::DOUBLE as win_prob, round_even(round(sum(case when finish_pos <= 3 then probability else 0 end) * 10000, 6), 0) / 10000.0::DOUBLE as podium_prob,
            round_even(round(sum(case when finish_pos <= 10 then probability else 0 end) * 10000, 6), 0) / 10000.0::DOUBLE as points_prob, round_even(round(sum(probability * {points_of('finish_pos', RACE_POINTS)}) * 100, 6), 0) / 100.0::DOUBLE as expected_points, max(r.position)::BIGINT as actual_position
            from canon c left join results r on r.round = c.round and r.driver = c.driver group by c.round, c.driver""", "canon", "results"),
        "json_props": "select event_type, count(*)::BIGINT as n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT as k_sum, max(json_extract(props, '$.k')::BIGINT)::BIGINT as k_max from events group by event_type",
        "default_cutoff": q("select round::BIGINT as round, arg_min(cutoff, priority) as cutoff from (select round, 'pre-fp1' as cutoff, 3 as priority from schedule union all select round, 'post-sprint', 2 from schedule where has_sprint union all select round, 'post-q', 1 from schedule where round % 3 = 1) group by round", "schedule"),
        "qualifying_best": f"""select 2026::BIGINT as season, year(o_orderdate)::BIGINT as round, o_orderkey as driver, o_custkey as team, substr(o_orderpriority, 1, 1)::BIGINT as quali_pos,
            round_even(round((case when o_orderstatus = 'F' and o_totalprice > 0 then o_totalprice / 8999.7::DOUBLE when o_totalprice > 0 then o_totalprice / 7999.7::DOUBLE end) * 10000, 6), 0) / 10000.0::DOUBLE as best_lap_s from orders""",
        "testing_days": """select season::BIGINT as season, test_number, day::BIGINT as day from (select *, row_number() over (partition by season, test_number order by day) as nth from (
            select distinct year(l_shipdate) as season, l_suppkey as test_number, l_linenumber as day from lineitem)) where nth = day""",
        "pace_session_laps": q(f"""select season::BIGINT as season, round::BIGINT as round, session_type, count(*)::BIGINT as laps, {rounded('min(lap_s)')} as best_s from (
            select *, case when starts_with(stint, 'A') then 'FP1' when starts_with(stint, 'N') then 'FP2' else 'FP3' end as session_type from laps)
            where session_type = case when round % 2 = 0 then 'FP1' else 'FP2' end group by season, round, session_type""", "laps"),
        "allocation_left": q("""select driver, component, used::BIGINT as units_used, (case when component in ('ICE', 'TC', 'EX') then 4 else 3 end)::BIGINT as allowed,
            greatest((case when component in ('ICE', 'TC', 'EX') then 4 else 3 end) - used, 0)::BIGINT as units_left from usage""", "usage"),
        "win_pairs": q(f"select y::BIGINT as y, count(*)::BIGINT as n, {rounded('avg(p)')} as mean_p from pairs group by y", "pairs"),
        "summary_metrics": q(f"""select count(*)::BIGINT as n_rounds, {rounded('round_even(round(avg(bs) * 1000000, 6), 0) / 1000000.0::DOUBLE')} as bs_win, {rounded('round_even(round(avg(ll) * 1000000, 6), 0) / 1000000.0::DOUBLE')} as log_loss_win,
            (select {rounded('round_even(round(sum(n * abs(mp - mo)) / sum(n) * 1000000, 6), 0) / 1000000.0::DOUBLE')} from diagram) as ece from (select round, avg(pow(p - y, 2)) as bs,
            -avg(case when y = 1 then ln(least(greatest(p, 1e-6), 1 - 1e-6)) else ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) end) as ll from winy group by round)""", "winy", "diagram"),
        "results_lookup": q("select round::BIGINT as round, driver, position::BIGINT as position, case when round % 3 <> 0 then 'first' else 'fallback' end as source from results", "results"),
        "season_entrants": q(f"""select driver, position::BIGINT as standing, {rounded('points')} as start_points, {rounded('case when driver % 4 <> 0 then points / 20 else 0 end')} as mean,
            {rounded('case when driver % 4 <> 0 then 0.3::DOUBLE + (driver % 5) / 10.0::DOUBLE else 2.0::DOUBLE end')} as sd, {rounded('case when driver % 3 <> 0 then 0.05::DOUBLE + (driver % 4) * 0.05::DOUBLE else 0.08::DOUBLE end')} as dnf,
            case when driver % 5 <> 0 then driver // 2 end as team from standings""", "standings"),
        "race_posterior": q(summary.format(f"""(select *, case when dnf_flag then 0.0::DOUBLE else {points_of('pos', RACE_POINTS)} end as points from (select *, row_number() over (partition by sim_id order by dnf_flag, round(speed, 9) desc, driver) as pos from (
            select sim_id, driver, dnf_flag, speed + {normal('post', 'sim_id', "'race'", 'driver')} * greatest(sd, 1e-9) as speed from orders_raw join (select driver, sd from field) using (driver))))"""), "orders_raw", "field"),
        "export_with_meta": q(f"""select round::BIGINT as round, r.driver, {rounded('points')} as points, coalesce(s_name, r.driver::VARCHAR) as display_name, coalesce('team_' || s_nationkey, 'unknown') as team
            from results r left join supplier on s_suppkey = r.driver""", "results"),
        "last_completed_inclusive": q("select coalesce(arg_max(round, date), 0)::BIGINT as last_round from schedule where date <= (select max(date) from schedule where round = 4)", "schedule"),
        "streamed_windows": f"""select strftime(time_bucket(interval '6 hours', ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*)::BIGINT as n, {rounded('sum(value)')} as total
            from events group by 1, 2""",
    }


def sql() -> dict[str, str]:
    """SQL of every registered query of the racing domain, by name."""
    q, base = query, _base()
    bare = lambda name: base[name].strip().rstrip(";")
    sd = "case when n_obs >= 2 then greatest(std / sqrt(n_obs), 0.01::DOUBLE) else 2.0::DOUBLE end"
    more = {
        "fuel_corrected_auto": base["fuel_corrected_rank"],
        "strength_as_of": q(f"""select driver, {rounded('mean - avg(mean) over ()')} as mean, {rounded(sd)} as sd, n_obs::BIGINT as n_obs from (
            select driver, avg(speed) as mean, stddev_samp(speed) as std, count(*) as n_obs from within where round <= 4 group by driver)""", "within"),
        "features_full": q(f"""select s.season::BIGINT as season, s.round::BIGINT as round, s.driver, s.team, {rounded('s.long_run_pace_s')} as long_run_pace_s, s.long_run_n::BIGINT as long_run_n, {rounded('s.fp_best_lap_s')} as fp_best_lap_s,
            {rounded('s.quali_pace_s')} as quali_pace_s, s.long_run_suspect, s.quali_suspect, gap_race as gap_to_teammate_race, gap_quali as gap_to_teammate_quali
            from suspects s left join ({_gaps('team', 'pace')}) g on g.season = s.season and g.round = s.round and g.driver = s.driver""", "suspects", "pace"),
        "extra_pace": f"""select season, round, driver, team, null::DOUBLE as long_run_pace_s, 0::BIGINT as long_run_n, null::DOUBLE as fp_best_lap_s, best_lap_s as quali_pace_s, 'post-q' as kind from ({bare('qualifying_best')}) where best_lap_s is not null
            union all select season, round, driver, team, sprint_pace_s, n, null, null, 'post-sprint' from ({bare('sprint_pace')}) where sprint_pace_s is not null""",
        "testing_pace": f"""with t as (select year(l_shipdate) as season, l_suppkey as driver, l_suppkey % 5 as team, l_linestatus as stint, l_linenumber as day, 60 + l_extendedprice / 10000 as lap_s from lineitem where l_tax > 0.01 and l_returnflag = 'N'),
            kept as (select * from (select *, count(*) over (partition by driver, season, day, stint) as laps from t) where laps >= 5),
            bound as (select *, count(*) over w as n, quantile_cont(lap_s, 0.9) over w as most from kept window w as (partition by season, driver, team))
            select season::BIGINT as season, driver, team, {rounded('avg(lap_s) filter (n < 3 or lap_s <= most)')} as testing_long_run_s, count(*)::BIGINT as testing_laps_n from bound group by season, driver, team""",
        "session_map": q("""select 2024::BIGINT as season, r.round::BIGINT as round, k.session_type, case when r.round % 2 = 0 then 'sprint_qualifying' else 'conventional' end as event_format, r.grid::VARCHAR as car_number, 'D' || r.driver as driver,
            'Driver d' || r.driver as full_name, r.team::VARCHAR as team, case when k.session_type = 'FP1' and r.round % 2 = 1 then coalesce(r.driver = b.driver, true) else true end as is_regular
            from results r cross join (values ('FP1'), ('R')) k(session_type) left join results b on b.round = greatest(r.round - 1, 1) and b.grid = r.grid""", "results"),
        "session_identities": q("""select 'D' || driver as driver, 'Driver d' || driver as full_name, arg_max(team, round)::VARCHAR as team, case when driver % 4 <> 0 then 'd' || driver end as id from results group by driver""", "results"),
        "evaluation_bridged": base["eval_per_round"],
        "championship_summary": f"""select 'driver' as entity_type, driver::VARCHAR as entity_id, title_prob, expected_points from ({bare('title_probability')})
            union all select 'constructor', team::VARCHAR, title_prob, expected_points from ({bare('constructor_title')})""",
        "reliability_features": " union all ".join(f"select '{k}' as kind, {k}::VARCHAR as id, starts, total_dnfs, total_dnf_rate from ({bare(k + '_reliability')})" for k in ("driver", "team", "engine")),
        "team_slugs": "select n_nationkey, case lower(trim(n_name)) when 'united states' then 'usa' when 'united kingdom' then 'britain' else replace(lower(trim(n_name)), ' ', '_') end as slug from nation",
        "default_round": q("""select as_of, coalesce(
                arg_min(round, (date, round)) filter (date - as_of::DATE between -1 and 4), arg_max(round, (date, round)) filter (round <= 5 and date <= as_of::DATE),
                arg_min(round, (date, round)) filter (round <= 5 and date > as_of::DATE))::BIGINT as round
            from (select round, max(date) as date from laps group by round), (select unnest(['1990-01-01', '1998-06-30', '2050-01-01']) as as_of union all
                select (max(date) - 3)::VARCHAR from laps where round = 6) group by as_of""", "laps"),
        "streamed_features": bare("pace_features"),
        "streamed_long_runs": bare("long_run_pace"),
        "ledger_titles": bare("title_probability"),
        "streamed_best": q(f"""select l.driver, {rounded('min(l.lap_s)')} as best_lap_s, count(*)::BIGINT as laps from laps l join schedule s on s.season = l.season and s.round = l.round
            where l.date < s.first_practice + 180 and l.lap_s > 60 group by l.driver""", "laps", "schedule"),
        "frozen_replay": q(f"""select r.round::BIGINT as round, case when r.round in (2, 3) then 'prediction_frozen' when r.round = 4 then 'prediction_missing' else 'snapshot_missing' end as status,
            case when r.round between 2 and 4 then (select count(*) from pace p where p.round < r.round) end as rows, (case when r.round between 2 and 4 then r.round - 1 end)::BIGINT as last_round,
            case when r.round in (2, 3) then (select {rounded('1.0::DOUBLE / count(distinct driver)')} from pace p where p.round < r.round) end as mean_chance, true as leak_refused from (select distinct round from laps) r""", "pace", "laps"),
    }
    return base | more
