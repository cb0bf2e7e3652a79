"""What the queries must return, said in SQL by other means: self-joins for windows, recursion for folds."""

from __future__ import annotations

from barsmith.functions.intervals import LENGTH
from barsmith.operators.similarity import WEIGHTS
from barsmith.operators.simulate import Rules
from barsmith.plans.queries import FROM, FUTURE, LOST, MATCHES, PAGE, PATTERN_AT, PATTERN_LENGTH, PRIMARY, RUN_RULES, SEPARATION, THRESHOLD, TO, TRADES
from barsmith.plans.service import ASSUMPTIONS
from barsmith.sources.demo import REGIMES

H = 3_600_000
TICKS = "t as (select event_type as symbol, epoch_us(ts) // 1000 as time, event_id as seq, value as price from events where value > 0)"
LOCAL = "timezone('America/Chicago', to_timestamp({0} / 1000.0))"
DAY_START = "cast(epoch_ms(timezone('America/Chicago', cast(cast(timezone('America/Chicago', to_timestamp({0} / 1000.0)) as date) as timestamp))) as bigint)"


def bucket(name: str, time: str = "time") -> str:
    return DAY_START.format(time) if name == "1d" else f"{time} - {time} % {LENGTH[name]}"


def bars(name: str) -> str:
    return f"select symbol, {bucket(name)} as time, arg_min(price, (time, seq)) as open, max(price) as high, min(price) as low, arg_max(price, (time, seq)) as close, cast(count(*) as double) as volume from t group by all"


BARS = f"with recursive {TICKS}, h as ({bars('1h')}), b as (select *, row_number() over (partition by symbol order by time) - 1 as i from h)"
CLOSED = BARS.replace("h as (", "h0 as (", 1).replace("b as (select", f"h as (select * from h0 where time + {H} <= (select max(time) from t) - 2 * {H}), b as (select")
DIRTY = """d as (select symbol, seq, time - time % 60000 as time, price - 5 as o, price - 6 as h, price - 4 as l, case when seq % 11 = 0 then null else price - 4.5 end as c, case when seq % 5 = 0 then null else cast(seq % 13 - 2 as double) end as v from t),
m as (select *, not coalesce(o > 0 and h > 0 and l > 0 and c > 0, false) as bad from d)"""


KNOWN = "(values ('ES', 'E-mini S&P 500', 0.25::double, 2, 'America/Chicago'), ('NQ', 'E-mini Nasdaq 100', 0.25, 2, 'America/Chicago'), ('YM', 'E-mini Dow', 1.0, 0, 'America/Chicago'))"
#: Requests for all there is, and their pages: as they are, or widened by a bar of four hours on both sides.
WHOLE = f'select symbol, min(time) - min(time) % {H} as start, max(time) as "end" from t group by symbol'
_PAGES = f"""p0 as (select symbol, unnest(range(a, z + 1, {PAGE})) as start, z from w),
p as (select symbol, start, least(start + {PAGE} - 1, z) as "end", strpos('{LOST}', cast(start // {PAGE} % 10 as varchar)) > 0 as lost from p0)"""
FETCH = f"""{TICKS}, w as (select symbol, start as a, "end" as z from ({WHOLE})), {_PAGES}"""
PADDED = f"""{TICKS}, w as (select symbol, start - 4 * {H} as a, "end" + 4 * {H} + (-("end" + 4 * {H}) % {H} + {H}) % {H} as z from ({WHOLE})), {_PAGES}"""


def resampled_from_h(name: str) -> str:
    return f"select symbol, {bucket(name)} as time, arg_min(open, time) as open, max(high) as high, min(low) as low, arg_max(close, time) as close, sum(volume) as volume from h group by symbol, {bucket(name)}"


INTERVALS = f"with {TICKS}, i as (" + " union all ".join(f"select '{n}' as n, sum(c) as bars, sum(e) as estimate from (select count(distinct {bucket(n)}) as c, (max(time) - min(time)) // {LENGTH[n]} as e from t group by symbol)" for n in LENGTH) + """),
v as (select * from (values ('5m', 300000, '5m', true, '5m', '5m'), ('15m', 900000, '15m', true, '5m', '5m'), ('1h', 3600000, '1h', true, '1h', '5m'), ('4h', 14400000, '1h', true, '1h', '5m'), ('6h', 21600000, '1h', true, '1h', '5m'), ('1d', 86400000, '1d', false, '1h', '5m')) t("interval", length, stored_as, intraday, from_two, from_five))
select v.*, cast(i.bars as bigint) as bars, cast(i.estimate as bigint) as estimate from v join i on v."interval" = i.n"""


def resampled(name: str, extra: str = "") -> str:
    return f"""{BARS}, r as (select symbol, {bucket(name)} as k, arg_min(open, time) as open, max(high) as high, min(low) as low, arg_max(close, time) as close, sum(volume) as volume, count(*) as n from h group by all)
select symbol, k as time, open, high, low, close, volume from r {extra}"""


def swings(s: int) -> str:
    side = lambda kind, col, op, tie: f"""select x.symbol, '{kind}' as kind, x.i as "index", x.time, x.{col} as price, e.time as confirmed_time, {s} as strength from b x join b e on e.symbol = x.symbol and e.i = x.i + {s}
where x.i >= {s} and not exists (select 1 from b y where y.symbol = x.symbol and y.i between x.i - {s} and x.i - 1 and not x.{col} {op} y.{col}) and not exists (select 1 from b y where y.symbol = x.symbol and y.i between x.i + 1 and x.i + {s} and not x.{col} {tie} y.{col})"""  # noqa: E731
    return side("high", "high", ">", ">=") + " union all " + side("low", "low", "<", "<=")


GAPS = """g0 as (select z.symbol, case when x.high < z.low then 'bullish' else 'bearish' end as direction, z.i, z.time, x.time as start_time, case when x.high < z.low then x.high else z.high end as bottom, case when x.high < z.low then z.low else x.low end as top
  from b x join b z on z.symbol = x.symbol and z.i = x.i + 2 where x.high < z.low or x.low > z.high),
g as (select *, (top + bottom) / 2 as midpoint, top - bottom as size, (top - bottom) / ((top + bottom) / 2) * 100 as size_percent from g0),
gm as (select g.symbol, g.direction, g.i, min(case when (g.direction = 'bullish' and y.low <= g.top) or (g.direction = 'bearish' and y.high >= g.bottom) then y.time end) as mitigated_time,
  min(case when (g.direction = 'bullish' and y.low <= g.bottom) or (g.direction = 'bearish' and y.high >= g.top) then y.time end) as filled_time,
  case when count(y.i) = 0 then 0.0 else coalesce(greatest(0.0, least(1.0, case g.direction when 'bullish' then (any_value(g.top) - min(y.low)) / any_value(g.size) else (max(y.high) - any_value(g.bottom)) / any_value(g.size) end)), 0.0) end as penetration
  from g left join b y on y.symbol = g.symbol and y.i > g.i group by g.symbol, g.direction, g.i),
gs as (select g.symbol, g.direction, g.i as "index", g.time, g.start_time, coalesce(gm.filled_time, (select max(time) from b where b.symbol = g.symbol)) as end_time, bottom, top, midpoint, size, size_percent, mitigated_time is not null as mitigated, mitigated_time, filled_time is not null as filled, filled_time, penetration
  from g join gm on gm.symbol = g.symbol and gm.direction = g.direction and gm.i = g.i)"""


def smt(invalid: bool, strength: int = 1, references: str = "", last: str = "") -> str:
    close = "abs({0} - e) <= greatest(1e-9, 1e-9 * greatest(abs({0}), abs(e)))"
    edge = lambda price, time: f"exists (select 1 from (select symbol as gs_symbol, time as gt, unnest([bottom, top]) as e from gs) where gs_symbol = k.ref and gt <= {time} and {close.format(price)})"
    return f"""{BARS}, {GAPS}, s as ({swings(strength)}),
p as (select kind, "index" as i, time, price, confirmed_time, lag("index") over w as pi, lag(time) over w as pt, lag(price) over w as pp from s where symbol = '{PRIMARY}' window w as (partition by kind order by "index")),
q as (select p.*, r0.symbol as ref, case p.kind when 'high' then r0.high else r0.low end as rs, case p.kind when 'high' then r1.high else r1.low end as re from p join b r0 on r0.symbol <> '{PRIMARY}' {references} and r0.time = p.pt join b r1 on r1.symbol = r0.symbol and r1.time = p.time where p.i - p.pi between 1 and 120),
k as (select *, case kind when 'high' then price > pp else price < pp end as ptook, case kind when 'high' then re > rs else re < rs end as rtook from q),
f as (select *, exists (select 1 from s where s.symbol = k.ref and s.kind = k.kind and s.time = k.pt) as s0, exists (select 1 from s where s.symbol = k.ref and s.kind = k.kind and s.time = k.time) as s1, {edge('k.rs', 'k.pt')} as e0, {edge('k.re', 'k.time')} as e1,
  (select min(gs.time) from gs where gs.symbol = '{PRIMARY}' and gs.time <= k.time and (gs.filled_time is null or gs.filled_time >= k.time) and k.price between gs.bottom and gs.top) as gt from k where ptook <> rtook),
v as (select *, case when s0 and s1 then 'swing_pair' when (s0 or e0) and (s1 or e1) then 'fvg_edge' else 'unconfirmed' end as validity from f)
select kind, case kind when 'high' then 'bearish' else 'bullish' end as bias, '{PRIMARY}' as primary_symbol, ref as reference_symbol, pt as start_time, time as end_time, pp as primary_start_price, price as primary_end_price, rs as reference_start_price, re as reference_end_price,
  case when ptook then '{PRIMARY}' else ref end as leading_symbol, case when ptook then ref else '{PRIMARY}' end as lagging_symbol, validity, validity <> 'unconfirmed' as valid, confirmed_time, gt is not null as inside_fair_value_gap, gt as fair_value_gap_time,
  {'round(' if last else ''}abs((price - pp) / abs(pp) * 100 - (re - rs) / abs(rs) * 100){', 6)' if last else ''} as strength, i - pi as separation_bars{last} from v {"" if invalid else "where validity <> 'unconfirmed'"}"""


def scores() -> str:
    """Windows in long form: a row for each window and bar, then z-scores and sums over windows of rows."""
    n = PATTERN_LENGTH
    names = [w for w, _ in WEIGHTS]
    z = ", ".join(f"coalesce(case when stddev_pop({c}) over w > 1e-12 then ({c} - avg({c}) over w) / stddev_pop({c}) over w end, 0) * {k} as z{j}" for j, (c, k) in enumerate(WEIGHTS))
    pairs = " + ".join(f"a.z{j} * q.z{j}" for j in range(len(names)))
    norm = lambda t: " + ".join(f"{t}.z{j} * {t}.z{j}" for j in range(len(names)))
    gap = " + ".join(f"(a.z{j} - q.z{j}) * (a.z{j} - q.z{j})" for j in range(len(names)))
    return f"""{BARS},
w0 as (select s.symbol, s.i as k, x.i - s.i as j, x.*exclude(symbol) from b s join b x on x.symbol = s.symbol and x.i between s.i and s.i + {n - 1}),
w1 as (select *, first_value(close) over w as fc, lag(close) over w as pc, count(*) over (partition by symbol, k) as n from w0 window w as (partition by symbol, k order by j)),
w2 as (select *, close / fc - 1 as normalised_close, coalesce((close - pc) / pc, 0) as returns, case when high - low > 1e-12 then (close - open) / (high - low) else 0 end as body, case when high - low > 1e-12 then (high - greatest(open, close)) / (high - low) else 0 end as upper_wick,
  case when high - low > 1e-12 then (least(open, close) - low) / (high - low) else 0 end as lower_wick, ln(1 + volume) as volume_log from w1 where n = {n}),
w3 as (select *exclude(volume), sqrt(greatest(0, (select avg(power(y.returns, 2)) - power(avg(y.returns), 2) from w2 y where y.symbol = w2.symbol and y.k = w2.k and y.j between w2.j - 4 and w2.j))) as volatility, volume_log as volume from w2),
w4 as (select symbol, k, j, time, close, {z} from w3 window w as (partition by symbol, k)),
q as (select * from w4 where symbol = '{PRIMARY}' and k = {PATTERN_AT}),
sc as (select a.symbol, a.k, min(a.time) as start_time, max(a.time) as end_time, arg_max(a.close, a.j) as entry_price, sum({pairs}) / sqrt(sum({norm('a')}) * sum({norm('q')})) as similarity, sqrt(sum({gap})) / sqrt({n * len(names)}) as distance from w4 a join q on q.j = a.j group by a.symbol, a.k)"""


def picked(future: int = FUTURE, where: str = "") -> str:
    return f"""{scores()},
el as (select sc.symbol, k, round(similarity, 8) as sim from sc join (select symbol, max(i) as last from b group by symbol) l on l.symbol = sc.symbol where round(similarity, 8) >= {THRESHOLD} and k + {PATTERN_LENGTH - 1 + future} <= last {where}),
rk as (select *, row_number() over (partition by symbol order by sim desc, k) as r from el),
pick(symbol, n, k, sim, taken) as (
  select symbol, 1, k, sim, [k] from rk where r = 1
  union all
  select p.symbol, p.n + 1, c.k, c.sim, list_append(p.taken, c.k) from pick p join lateral (select rk.k, rk.sim from rk where rk.symbol = p.symbol and not exists (select 1 from unnest(p.taken) u(x) where abs(u.x - rk.k) < {SEPARATION}) order by rk.r limit 1) c on true where p.n < {MATCHES})"""


MATCH = "mt as (select symbol || ':' || i as id, symbol, i - 11 as s, i as e, cast(0.5 as double) as similarity from b where i >= 11)"


def half_up(x: str, digits: int) -> str:
    """Half up at some digits of the number as it is written, so that the last bit of a double does not decide, and zero has no sign."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(38, 20)), {digits}) as double)"


def six(x: str) -> str:
    return half_up(x, 6)


def trades(rules: Rules, head: str = BARS, match: str = MATCH) -> str:
    """Trades of the matches ``mt`` by a range join with the bars that follow."""
    long, nxt = rules.direction == "long", rules.entry == "next_open"
    sign, slip = (1 if long else -1), rules.slippage_percent / 100
    raw = "n.open" if nxt else "x.close"
    entry = f"{raw} * {1 + slip * sign!r}"
    stop = {"percentage": f"en - {sign} * (en * {rules.stop_value} / 100)", "fixed_price": f"cast({rules.stop_value} as double)", "pattern_extreme": "lo" if long else "hi", "atr_multiple": f"case when atr > 0 then en - {sign} * atr * {rules.stop_value} end"}[rules.stop]
    target = {"percentage": f"en + {sign} * (en * {rules.target_value} / 100)", "fixed_price": f"cast({rules.target_value} as double)", "risk_reward": f"en + {sign} * abs(en - st) * {rules.target_value}"}[rules.target]
    none = "no_entry_bar" if nxt else "no_later_bar"
    risk = "when abs(en - st) <= 0 then 'no_risk'" if rules.target == "risk_reward" else ""
    hs, ht = ("y.low <= st", "y.high >= tg") if long else ("y.high >= st", "y.low <= tg")
    worse, better = ("least", "greatest") if long else ("greatest", "least")
    return f"""{head}, {match},
tr as (select b.*, case when i = 0 then high - low else greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) end as tr from b window w as (partition by symbol order by i)),
e0 as (select mt.*, x.time as xt, n.i as ni, n.time as nt, {entry} as en, (select min(low) from b y where y.symbol = mt.symbol and y.i between mt.s and mt.e) as lo, (select max(high) from b y where y.symbol = mt.symbol and y.i between mt.s and mt.e) as hi,
  coalesce((select avg(tr) from tr y where y.symbol = mt.symbol and y.i between greatest(1, mt.e - {rules.atr_period - 1}) and mt.e), 0) as atr from mt join b x on x.symbol = mt.symbol and x.i = mt.e left join b n on n.symbol = mt.symbol and n.i = mt.e + 1),
e1 as (select *, {stop} as st from e0), e2 as (select *, {target} as tg from e1),
e3 as (select *, case when ni is null then '{none}' when st is null then 'no_atr' {risk} when {sign} * (en - st) <= 0 then 'stop_side_{rules.direction}' when {sign} * (tg - en) <= 0 then 'target_side_{rules.direction}' end as skip from e2),
x0 as (select e3.id, count(y.i) as ahead, max(y.i) as last_i, min(case when {hs} or {ht} then y.i end) as hit from e3 left join b y on y.symbol = e3.symbol and y.i between e3.e + 1 and e3.e + {rules.hold} group by e3.id),
x1 as (select e3.*, x0.ahead, y.i as xi, y.time as xtime, x0.hit is not null and {hs} as stopped, x0.hit is not null and {ht} as reached, y.open as xo, y.close as xc from e3 join x0 on x0.id = e3.id left join b y on y.symbol = e3.symbol and y.i = coalesce(x0.hit, x0.last_i)),
x2 as (select *, (case when stopped then {worse}(xo, st) when reached then {better}(xo, tg) else xc end) * {1 - slip * sign!r} as ex, case when stopped then 'stop_loss' when reached then 'take_profit' when ahead >= {rules.hold} then 'timeout' else 'end_of_data' end as why from x1),
tr0 as (select id, symbol, '{rules.direction}' as direction, s as start_index, e as end_index, e + {int(nxt)} as entry_index, xi as exit_index, {"nt" if nxt else "xt"} as entry_time, xtime as exit_time, {six('en')} as entry_price, {six('ex')} as exit_price, {six('st')} as stop_price, {six('tg')} as target_price,
  {six(f'{sign} * (ex - en) / en * 100')} as gross_return, cast({round(rules.fee_percent * 2, 6)} as double) as fees, {six(f'{sign} * (ex - en) / en * 100 - {rules.fee_percent * 2}')} as net_return, why as exit_reason, xi - e as holding_bars, similarity, stopped and reached as same_bar_ambiguity, skip as skip_reason from x2),
tr1 as (select id, symbol, direction, start_index, end_index, entry_index, case when skip_reason is null then exit_index end as exit_index, entry_time, case when skip_reason is null then exit_time end as exit_time, case when skip_reason is null then entry_price end as entry_price, case when skip_reason is null then exit_price end as exit_price,
  case when skip_reason is null then stop_price end as stop_price, case when skip_reason is null then target_price end as target_price, case when skip_reason is null then gross_return end as gross_return, fees, case when skip_reason is null then net_return end as net_return, case when skip_reason is null then exit_reason end as exit_reason,
  case when skip_reason is null then holding_bars end as holding_bars, similarity, case when skip_reason is null then same_bar_ambiguity end as same_bar_ambiguity, skip_reason from tr0)""" + (
        ", tf as (select * from tr1)"
        if rules.overlap
        else """,
od as (select *, row_number() over (partition by symbol order by end_index) as r from tr1 where skip_reason is null),
fold(symbol, r, until, id) as (select symbol, 1, exit_time, id from od where r = 1 union all select o.symbol, o.r, case when o.entry_time < f.until then f.until else o.exit_time end, case when o.entry_time < f.until then null else o.id end from fold f join od o on o.symbol = f.symbol and o.r = f.r + 1),
tf as (select tr1.* replace (case when tr1.skip_reason is null and fold.id is null then 'overlap' else tr1.skip_reason end as skip_reason) from tr1 left join fold on fold.id = tr1.id)"""
    )


RUN = picked(10, f"""and sc.symbol in ('{PRIMARY}', 'view', 'signup') and not (sc.symbol = '{PRIMARY}' and start_time <= (select max(end_time) from sc z where z.symbol = '{PRIMARY}' and z.k = {PATTERN_AT}) and end_time >= (select max(start_time) from sc z where z.symbol = '{PRIMARY}' and z.k = {PATTERN_AT}))""") + f""",
top as (select pick.*, sc.start_time, sc.similarity, row_number() over (order by sc.similarity desc, pick.symbol, pick.k) as rank from pick join sc on sc.symbol = pick.symbol and sc.k = pick.k)"""
RUN_MATCH = f"mt as (select substr(sha256(symbol || '|' || start_time || '|' || {PATTERN_LENGTH}), 1, 32) as id, symbol, k as s, k + {PATTERN_LENGTH - 1} as e, similarity, rank from top where rank <= {MATCHES})"


def done(found: str) -> str:
    return found + ", n as (select *, row_number() over (order by entry_time, symbol, end_index) as k from tf where skip_reason is null)"


def curve(found: str) -> str:
    return done(found) + """, c as (select a.k, any_value(a.exit_time) as time, 100 * product(1 + z.net_return / 100) as e from n a join n z on z.k <= a.k group by a.k),
cv as (select c.k as trade_number, c.time, round(c.e, 6) as equity, round((c.e - greatest(100, p.peak)) / greatest(100, p.peak) * 100, 6) as drawdown from c join (select x.k, max(y.e) as peak from c x join c y on y.k <= x.k group by x.k) p on p.k = c.k)"""


RUNS = """, sg as (select k, sign(net_return) as s, k - row_number() over (partition by sign(net_return) order by k) as run from n), rn as (select s, run, count(*) as c from sg group by s, run)"""
STREAKS = "coalesce((select max(c) from rn where s = 1), 0) as longest_winning_streak, coalesce((select max(c) from rn where s = -1), 0) as longest_losing_streak"


def summary(found: str, more: str = "") -> str:
    """All figures of no trades are zero; the profit factor is null without losses and zero without gains."""
    gain, loss = "coalesce(sum(net_return) filter (net_return > 0), 0)", "coalesce(sum(net_return) filter (net_return < 0), 0)"
    return curve(found) + RUNS + f""" select {more} count(*) as trades_executed, count(*) filter (net_return > 0) as wins, count(*) filter (net_return < 0) as losses, count(*) filter (net_return = 0) as breakeven, count(*) filter (exit_reason = 'timeout') as timeouts, round(coalesce(count(*) filter (net_return > 0) * 100.0 / nullif(count(*), 0), 0), 4) as win_rate,
  round(coalesce(product(1 + gross_return / 100) * 100 - 100, 0), 4) as gross_return, round(coalesce((select arg_max(equity, trade_number) from cv) - 100, 0), 4) as net_return, round(coalesce(avg(net_return), 0), 4) as average_return, round(coalesce(quantile_cont(net_return, 0.5), 0), 4) as median_return, round(coalesce(avg(net_return) filter (net_return > 0), 0), 4) as average_winner, round(coalesce(avg(net_return) filter (net_return < 0), 0), 4) as average_loser,
  round(coalesce(abs(avg(net_return) filter (net_return > 0) / avg(net_return) filter (net_return < 0)), 0), 4) as risk_reward_achieved, round(coalesce(({gain} + {loss}) / nullif(count(*), 0), 0), 4) as expectancy, round(case when {loss} < 0 then {gain} / abs({loss}) end, 4) as profit_factor,
  coalesce((select round(abs(min(least(drawdown, 0))), 4) from cv), 0) as maximum_drawdown, {STREAKS}, round(coalesce(avg(holding_bars), 0), 2) as average_holding_bars, case when count(*) = 0 then 'no trades' when count(*) < 20 then 'only ' || count(*) || ' trades' end as sample_size_warning, count(*) filter (same_bar_ambiguity) as same_bar_ambiguity_count from n"""


NO_OVERLAP = trades(TRADES["trades_no_overlap"])
RUN_TRADES = trades(RUN_RULES, RUN, RUN_MATCH)
FIVE = f"f5 as ({bars('5m')})"
COVER = f"""cov as (select symbol, '1h' as "interval", time as a, time + {H} * (1 + time // {H} % 3) - case when time // {H} % 2 = 0 then 1 else 0 end as z from h where time // {H} % 10 < 6)"""


def islands(reach: int) -> str:
    """A range starts an island if no range that sorts before it reaches it."""
    return f"""{BARS}, {COVER}, c2 as (select *, row_number() over (partition by symbol order by a, z) as r from cov),
hd as (select x.*, not exists (select 1 from c2 y where y.symbol = x.symbol and y.r < x.r and x.a <= y.z + {reach}) as head from c2 x),
isl as (select symbol, "interval", a, z, sum(case when head then 1 else 0 end) over (partition by symbol order by r) as g from hd)
select symbol, "interval", min(a) as start, max(z) as "end" from isl group by symbol, "interval", g"""


TWO = f"""f1 as (select symbol, time, open, high, low, close, volume, '1h' as "interval", 'alpha' as provider, cast(1000 as bigint) as fetched_at from h),
f2 as (select symbol, time, open, high, low, close + 1 as close, volume, '1h' as "interval", case symbol when 'click' then 'zeta' else 'aaron' end as provider, cast(2000 as bigint) as fetched_at from h where time // {H} % 3 = 0),
up as (select * from f2 union all select * from f1 where not exists (select 1 from f2 where f2.symbol = f1.symbol and f2.time = f1.time))"""
POINTS = f"""pt as (select seq as id, symbol, case when seq % 20 = 3 then time - time % {H // 2} when seq % 50 = 13 then time - {40 * 24 * H} when seq % 50 = 33 then time + {40 * 24 * H} else time end as time from t)"""
ENDS = "en as (select symbol, min(time) as f, max(time) as l, count(*) as n from b group by symbol)"
SPACING = "sp as (select symbol, list_sort(list(d))[len(list(d)) // 2 + 1] as spacing from (select symbol, time - lag(time) over (partition by symbol order by time) as d from h) where d > 0 group by symbol)"
NEAR = f"{BARS}, {POINTS}, {ENDS}, {SPACING}, nb as (select pt.*, (select max(i) from b where b.symbol = pt.symbol and b.time <= pt.time) as pi, (select min(i) from b where b.symbol = pt.symbol and b.time >= pt.time) as ni from pt), nn as (select nb.id, nb.symbol, nb.time, p.time as p, p.i as pi, x.time as x, en.f, en.l, en.n, sp.spacing from nb left join b p on p.symbol = nb.symbol and p.i = nb.pi left join b x on x.symbol = nb.symbol and x.i = nb.ni join en on en.symbol = nb.symbol left join sp on sp.symbol = nb.symbol)"
LOGICAL = "case when time < f then (time - f) / cast(spacing as double) when time > l then n - 1 + (time - l) / cast(spacing as double) when p = time then cast(pi as double) else pi + (time - p) / cast(x - p as double) end"
AT = LOCAL.format("time")
IN_SESSION = f"case isodow({AT}) when 6 then false when 7 then hour({AT}) >= 17 when 5 then hour({AT}) < 16 else hour({AT}) <> 16 end"
CYCLE = sum(d for d, _ in REGIMES)
STARTS = [sum(d for d, _ in REGIMES[:k]) for k in range(len(REGIMES))]

RUNS_COUNTED = " union all ".join(f"""select * from ({trades(TRADES[name])} select '{name}' as run, cast({1000 * (k + 1)} as bigint) as created_at, count(*) as matches, count(*) filter (skip_reason is null) as trades, unnest({['[true]', '[true, false]', '[false]'][k]}) as gone from tf)""" for k, name in enumerate(("trades_long_pct", "trades_short_pct", "trades_long_fixed")))

ORACLES = {
    **{f"ohlcv_{n}": f"with {TICKS} {bars(n)}" for n in LENGTH},
    "resample_4h": resampled("4h"),
    "resample_6h": resampled("6h"),
    "resample_1d": resampled("1d"),
    "drop_incomplete_last": resampled("4h", "where n >= 4 or k < (select max(k) from r z where z.symbol = r.symbol)"),
    "daily_benchmark": """select l_returnflag as symbol, strftime(l_shipdate, '%Y-%m-%d') as day, arg_min(l_extendedprice / l_quantity, (l_orderkey, l_partkey, l_suppkey, l_linenumber)) as open, max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_partkey, l_suppkey, l_linenumber)) as close, sum(l_quantity) as volume from lineitem where l_quantity > 0 group by all""",
    "normalize_candles": f"with {TICKS}, {DIRTY}, z as (select *, row_number() over (partition by symbol, time order by seq desc) as r from m where not bad) select symbol, time, o as open, greatest(o, h, l, c) as high, least(o, h, l, c) as low, c as close, greatest(coalesce(v, 0), 0) as volume from z where r = 1",
    "normalize_report": f"""with {TICKS}, {DIRTY}, g as (select *, lag(time) over (partition by symbol order by seq) as before from m where not bad)
select m.symbol, count(*) as received, any_value(k.kept) as kept, count(*) filter (bad) as malformed, count(*) filter (not bad) - any_value(k.kept) as duplicate, any_value(k.reordered) as reordered, count(*) filter (not bad and (h <> greatest(o, h, l, c) or l <> least(o, h, l, c))) as repaired, count(*) filter (not bad and v is null) as missing_volume
from m join (select symbol, count(distinct time) as kept, coalesce(bool_or(time < before), false) as reordered from g group by symbol) k on k.symbol = m.symbol group by m.symbol""",
    "unit_infer_timestamp": f"with {TICKS} select seq, case when seq % 2 = 0 then time // 1000 * 1000 else time end as time, strftime(make_timestamp(time * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as iso from t",
    "session_calendar": f"with {TICKS} select strftime({AT} - interval 17 hour, '%Y-%m-%d') as session_day, count(*) filter ({IN_SESSION}) as in_session, count(*) filter (not {IN_SESSION}) as outside from t group by 1",
    "align_grid": f"with {TICKS} select seq, " + ", ".join(f"time // {LENGTH[n]} * {LENGTH[n]} as down_{n}, (time + {LENGTH[n] - 1}) // {LENGTH[n]} * {LENGTH[n]} as up_{n}" for n in ("5m", "4h", "1d")) + " from t",
    "tick_rounding": f"with {TICKS} select seq, round(round_even(price / 0.25, 0) * 0.25, 2) as quarter, round_even(price, 0) as whole, (price - 50.0) / 50.0 * 100 as change from t",
    "selection_summary": f"{BARS} select symbol, count(*) as bars, (select open from b f where f.symbol = b.symbol and f.i = 0) as open, arg_max(close, i) as close, max(high) as high, min(low) as low, (arg_max(close, i) - arg_min(open, i)) / arg_min(open, i) * 100 as change_percent from b group by symbol",
    "median_spacing": f"{BARS}, {SPACING} select symbol, spacing from sp",
    **{f"swing_points_s{k}": f"{BARS} {swings(k)}" for k in (1, 2, 5)},
    "true_range": f"""{BARS} select x.symbol, x.i as "index", x.time, case when x.i = 0 then x.high - x.low else greatest(x.high - x.low, abs(x.high - p.close), abs(x.low - p.close)) end as true_range from b x left join b p on p.symbol = x.symbol and p.i = x.i - 1""",
    "atr14": f"""{BARS}, r as (select x.symbol, x.i, greatest(x.high - x.low, abs(x.high - p.close), abs(x.low - p.close)) as tr from b x join b p on p.symbol = x.symbol and p.i = x.i - 1) select b.symbol, b.i as "index", round(coalesce((select avg(tr) from r where r.symbol = b.symbol and r.i between b.i - 13 and b.i), 0), 8) as atr from b""",
    "fvg_detect": f"""{BARS}, {GAPS} select symbol, direction, i as "index", time, start_time, bottom, top, midpoint, size, size_percent from g""",
    "fvg_mitigation": f"{BARS}, {GAPS} select * from gs",
    "fvg_open_only": f"{BARS}, {GAPS} select * from gs where not filled",
    "fvg_min_size": f"{BARS}, {GAPS} select * from gs where size_percent >= 50",
    "gap_containing": f"{BARS}, {GAPS}, s as ({swings(2)}) select symbol, kind, time, price, (select min(gs.time) from gs where gs.symbol = s.symbol and gs.time <= s.time and (gs.filled_time is null or gs.filled_time >= s.time) and s.price between gs.bottom and gs.top) as gap_time from s",
    "smt_all": smt(True),
    "smt_valid": smt(False),
    "shared_bars": f"{BARS} select r.symbol as reference_symbol, count(*) as bars, count(*) filter (r.time in (select time from h where symbol = '{PRIMARY}')) as shared from h r where r.symbol <> '{PRIMARY}' group by r.symbol",
    "tail_n": f"{BARS}, s as ({swings(2)}) select symbol, kind, time, price, (select count(*) from s y where y.symbol = s.symbol) > 20 as truncated from s where (select count(*) from s y where y.symbol = s.symbol and (y.time > s.time or (y.time = s.time and y.kind > s.kind))) < 20",
    "pattern_scores": f"{scores()} select symbol, k as start_index, k + {PATTERN_LENGTH - 1} as end_index, start_time, end_time, entry_price, round(similarity, 8) as similarity, round(distance, 8) as distance from sc",
    "pattern_topk_spaced": f"{picked()} select symbol, k as start_index, sim as similarity, n as rank from pick",
    "pattern_topk_global": f"{picked()}, o as (select symbol, k as start_index, sim as similarity, row_number() over (order by sim desc, symbol, k) as rank from pick) select * from o where rank <= 25",
    "resample_linear": f"""{BARS}, c as (select symbol, i // 30 as stretch, list(close order by i) as c from b group by all), p as (select symbol, stretch, c, unnest(range(12)) as point from c), a as (select *, point * (len(c) - 1) / 11.0 as pos from p)
select symbol, stretch, point, round(c[cast(floor(pos) as int) + 1] + (c[least(cast(floor(pos) as int) + 2, len(c))] - c[cast(floor(pos) as int) + 1]) * (pos - floor(pos)), 8) as value from a""",
    **{name: trades(rules) + " select * from tf" for name, rules in TRADES.items()},
    "match_outcomes": NO_OVERLAP + " select id, symbol, end_index, case when skip_reason is null then exit_reason else 'not_traded' end as outcome, case when skip_reason is null then net_return end as net_return from tf",
    "equity_curve": curve(NO_OVERLAP) + " select trade_number, time, round(log10(equity + 1), 6) as log10_equity, round(drawdown, 4) as drawdown from cv",
    "max_drawdown": curve(NO_OVERLAP) + " select abs(coalesce(min(least(drawdown, 0)), 0)) as maximum_drawdown from cv",
    "streaks": done(NO_OVERLAP) + RUNS + f" select {STREAKS}",
    "backtest_summary": summary(NO_OVERLAP),
    "coverage_merge": islands(0),
    "ranges_coalesced": islands(4 * H // 2),
    "coverage_missing": f"""{BARS}, {COVER}, rq as (select symbol, "interval", min(a) - {H} as f, max(z) + {H} as l from cov group by all),
st as (select symbol, "interval", f as s from rq union select c.symbol, c."interval", c.z + 1 from cov c join rq on rq.symbol = c.symbol and c.z < rq.l),
ok as (select * from st where not exists (select 1 from cov c where c.symbol = st.symbol and st.s between c.a and c.z))
select ok.symbol, ok."interval", ok.s as start, least((select l from rq where rq.symbol = ok.symbol), coalesce((select min(a) - 1 from cov c where c.symbol = ok.symbol and c.a > ok.s), 9000000000000000000)) as "end" from ok""",
    "request_chunks": f"""{BARS}, q as (select symbol, min(time) as a, max(time) as z from h group by symbol) select symbol, '1h' as "interval", s as start, least(s + {55 * H}, z) as "end" from (select symbol, z, unnest(range(a, z, {55 * H})) as s from q)""",
    "upsert_latest": f"{BARS}, {TWO} select * from up",
    "latest_provider": f"""{BARS}, {TWO} select symbol, "interval", provider from up u where not exists (select 1 from up v where v.symbol = u.symbol and (v.fetched_at, v.time) > (u.fetched_at, u.time))""",
    "cache_stats": f"""{BARS}, {TWO} select symbol, "interval", count(*) as bars, min(time) as first_time, max(time) as last_time, max(provider) as provider, max(fetched_at) as last_fetch from up group by symbol, "interval" union all select null, null, count(*), min(time), max(time), max(provider), max(fetched_at) from up""",
    "provider_priority": f"{BARS}, {TWO} select symbol, time, close, provider from up",
    "quality_flags": f"{BARS} select symbol, time, case when volume > 5 then 'partial' when volume <= 2 then 'cached' else 'delayed' end as quality from h",
    "nearest_bar": f"{NEAR} select id, symbol, time, case when p is null then x when x is null then p when time - p <= x - time then p else x end as nearest, case when time between f and l then case when time - p <= x - time then p else x end end as snapped, case when p = time then pi else -1 end as exact from nn",
    "logical_index": f"{NEAR} select id, symbol, time, round({LOGICAL}, 8) as logical from nn",
    "time_round_trip": f"{NEAR} select id, symbol, time from nn",
    "regime_days": f"with {TICKS}, d as (select distinct date_diff('day', date '1970-01-01', cast({AT} - interval 17 hour as date)) as day_index from t) select day_index, case " + " ".join(f"when day_index % {CYCLE} < {s + d} then cast({v} as double)" for (d, v), s in zip(REGIMES, STARTS)) + " end as volatility from d",
    "knn_embeddings": """with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
s as (select q.vec_id as query_id, e.vec_id, list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)) as c from e q join e on e.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by c desc, vec_id) as rank from s) select query_id, vec_id, round(c, 6) as similarity, rank from r where rank <= 10""",
    "vendor_rows": f"{BARS} select symbol, time, open, high, low, close, case when time // 86400000 % 4 = 2 then 0 else volume end as volume from h",
    "edge_at_price": f"""{BARS}, {GAPS}, s as ({swings(1)}), a as (select *, price * 1000 * (1 + "index" % 4 * 4e-10) as p from s), e as (select symbol as gs, time as gt, unnest([bottom * 1000, top * 1000]) as e from g)
select symbol, kind, "index", time, exists (select 1 from e where gs = a.symbol and gt <= a.time and abs(e - a.p) <= greatest(1e-9, 1e-9 * greatest(abs(e), abs(a.p)))) as on_edge from a""",
    "bars_range": f"with {TICKS}, h as ({bars('1h')}) select symbol, {bucket('4h')} as time, arg_min(open, time) as open, max(high) as high, min(low) as low, arg_max(close, time) as close, sum(volume) as volume from h where symbol = '{PRIMARY}' group by all having {bucket('4h')} between {FROM} and {TO}".replace("having time - time % 14400000", "having min(time) - min(time) % 14400000"),
    "bars_range_5m": f"with {TICKS}, {FIVE} select * from f5 where symbol = '{PRIMARY}' and time between {FROM} and {TO}",
    "cached_range": f"{BARS}, {TWO} select symbol, time, open, high, low, close, volume from up where symbol = '{PRIMARY}' and time between {FROM} and {TO}",
    "cache_cleared": f"""{BARS}, {COVER}, c2 as (select *, row_number() over (partition by symbol order by a, z) as r from cov), hd as (select x.*, not exists (select 1 from c2 y where y.symbol = x.symbol and y.r < x.r and x.a <= y.z) as head from c2 x),
isl as (select symbol, a, z, sum(case when head then 1 else 0 end) over (partition by symbol order by r) as g from hd), m as (select symbol, max(z) - min(a) as w from isl group by symbol, g), n as (select symbol, count(*) as bars from h group by symbol)
select n.symbol, n.bars, cast(sum(m.w) as bigint) as covered from n left join m on m.symbol = n.symbol where n.symbol <> '{PRIMARY}' group by n.symbol, n.bars""",
    "missing_of_many": f"""{BARS}, {COVER}, en2 as (select symbol, "interval", min(a) as f, max(z) as l from cov group by all), rq as (select symbol, "interval", f, (f + l) // 2 as l from en2 union all select symbol, "interval", (f + l) // 2 + {H}, l from en2),
st as (select symbol, "interval", f, l, f as s from rq union select rq.symbol, rq."interval", rq.f, rq.l, c.z + 1 from cov c join rq on rq.symbol = c.symbol and c.z >= rq.f and c.z < rq.l),
ok as (select * from st where not exists (select 1 from cov c where c.symbol = st.symbol and st.s between c.a and c.z))
select ok.symbol, ok."interval", ok.s as start, least(ok.l, coalesce((select min(a) - 1 from cov c where c.symbol = ok.symbol and c.a > ok.s), 9000000000000000000)) as "end" from ok""",
    "structure_swings": f"{BARS}, s as ({swings(2)}) select *, false as truncated from s where symbol = '{PRIMARY}' and kind = 'high'",
    "structure_gaps": f"{BARS}, {GAPS} select * replace (round(size_percent, 6) as size_percent, round(penetration, 6) as penetration), false as truncated from gs where symbol = '{PRIMARY}'",
    "structure_open_gaps": f"{BARS}, {GAPS} select * replace (round(size_percent, 6) as size_percent, round(penetration, 6) as penetration), false as truncated from gs where symbol = '{PRIMARY}' and not filled",
    "structure_divergences": smt(False, 2, "and r0.symbol in ('view', 'signup')", ", false as truncated"),
    "structure_warnings": f"select 'view' as reference_symbol, 'mixed_source' as code, 'mixed-source: view is from demo, {PRIMARY} from vendor; do not rely on their divergences' as warning union all select 'signup', 'no_shared_bars', 'signup and {PRIMARY} have no bar time in common'",
    "run_matches": RUN_TRADES + f""" select mt.id, mt.symbol, mt.s as start_index, mt.e as end_index, round(mt.similarity, 8) as similarity, mt.rank, case when tf.skip_reason is null then tf.exit_reason else 'not_traded' end as outcome, case when tf.skip_reason is null then tf.net_return end as net_return,
  round((select sum(round((b.close / f.close - 1) * 100, 4)) from b join b f on f.symbol = b.symbol and f.i = mt.s where b.symbol = mt.symbol and b.i between mt.s and mt.e), 4) as path from mt join tf on tf.id = mt.id""",
    "run_trades": done(RUN_TRADES) + " select k as trade_number, id, symbol, entry_time, exit_time, entry_price, exit_price, net_return, exit_reason from n",
    "run_summary": summary(RUN_TRADES, "(select count(*) from mt) as total_matches, (select count(*) from tf where skip_reason is not null) as skipped_matches,"),
    "run_notes": f"""{BARS} select 0 as place, 'source: demo, vendor' as note union all select 1, 'demo bars are made up from a seed; they are no market data' union all select 2, symbol || ': searched ' || count(*) || ' bars of 1h' from h where symbol in ('{PRIMARY}', 'view', 'signup') group by symbol
union all select 3, 'contracts are strung together without adjustment, so prices may jump where they change' union all select 4, 'a match that begins before the last trade ends is left out' union all select * from (values """ + ", ".join(f"({5 + k}, '{a.replace(chr(39), chr(39) * 2)}')" for k, a in enumerate(ASSUMPTIONS)) + """) t(place, note)""",
    "runs_listed": " union all ".join(f"""select * from ({trades(TRADES[name])} select '{name}' as run, cast({1000 * (k + 1)} as bigint) as created_at, '{PRIMARY}' as primary_symbol, '1h' as "interval", 'done' as status, count(*) as trades_executed, round(count(*) filter (net_return > 0) * 100.0 / count(*), 4) as win_rate, round(avg(net_return), 4) as net_return from tf where skip_reason is null)""" for k, name in enumerate(("trades_long_pct", "trades_short_pct", "trades_long_fixed")) if k),
    "interval_table": INTERVALS,
    "instruments": f"with {TICKS}, h as ({bars('1h')}), l as (select symbol, case symbol when 'click' then ' nq ' when 'view' then 'Es' when 'signup' then 'YM' when 'purchase' then 'btc' else '' end as label, arg_max(close, time) as last from h group by all), i as (select * from {KNOWN} t(_s, name, tick, digits, zone)) select symbol, label, _s is not null as known, name, tick, digits, zone, round_even(last / tick, 0) * tick as last from l left join i on upper(trim(label)) = _s",
    "instruments_upsert": f"with {TICKS}, n as (select case when symbol = '{PRIMARY}' then 'YM' else upper(symbol) end as symbol, 'ticks of ' || symbol as name, case when max(price) > 99 then 0.01::double else 0.25::double end as tick, 2 as digits, 'UTC' as zone from t group by all) select * from n union all select * from {KNOWN} t(symbol, name, tick, digits, zone) where symbol not in (select symbol from n)",
    "parse_times": f"with {TICKS} select seq, case seq % 6 when 3 then time // 1000 * 1000 - 7200000 when 5 then null else time // 1000 * 1000 end as time from t",
    "trust_flags": f"with {TICKS}, h as ({bars('1h')}), q as (select *, case when volume > 5 then 'partial' when volume <= 2 then 'cached' when symbol = 'view' then 'demo' else 'delayed' end as quality from h) select symbol, time, quality, quality not in ('demo', 'partial') as trusted, volume > 5 or symbol <> '{PRIMARY}' as fallback from q",
    "chart_series": f"with {TICKS}, h as ({bars('1h')}) select symbol, time // 1000 as time, open, high, low, close, volume, close >= open as up from h",
    "display_texts": f"with {TICKS}, h as ({bars('1h')}) select symbol, time, format('{{:,.2f}}', close * 1000) as price, coalesce(case when volume > 1 then case when change > 0 then '+' else '' end || format('{{:.2f}}', change) || '%' end, '-') as change from (select *, {half_up('(close - open) / open * 100', 1)} as change from h)",
    "display_more": f"""with {TICKS}, h as ({bars('1h')}), v as (select *, round(close * power(10.0::double, time // {H} % 13), 2) as v, case when volume > 1 then round(close / open, 1) end as r from h),
u as (select *, case when abs(round(v / 1e9, 1)) >= 1000 then 1e12 when abs(round(v / 1e6, 1)) >= 1000 then 1e9 when abs(round(v / 1e3, 1)) >= 1000 then 1e6 when abs(round(v, 1)) >= 1000 then 1e3 else 1 end::double as size from v)
select symbol, time, strftime(timezone('America/Chicago', to_timestamp(time / 1000.0)), '%d %b %Y, %H:%M') as moment, strftime(epoch_ms(time), '%d %b %Y') as day,
  regexp_replace(format('{{:,.1f}}', round(v / size, 1)), '[.]0$', '') || case size when 1e12 then 'T' when 1e9 then 'B' when 1e6 then 'M' when 1e3 then 'K' else '' end as compact, format('{{:,.1f}}', round(v, 1)) as number,
  coalesce(format('{{:.2f}}x', r), '-') as ratio, cast(volume as bigint) || case when volume = 1 then ' bar' else ' bars' end || ' (1h)' as duration,
  case when volume >= 9 then 'never' when {TO} - time < 60000 then 'just now' when {TO} - time < {H} then (({TO} - time) // 60000) || 'm ago' when {TO} - time < 86400000 then (({TO} - time) // {H}) || 'h ago' else (({TO} - time) // 86400000) || 'd ago' end as ago from u""",
    "column_list_json": f"with {TICKS}, h as ({bars('1h')}) select * from h",
    "paged_scan": f"with {TICKS}, h as ({bars('5m')}) select * from h where time between {FROM} and {TO} and symbol <> 'view'",
    "chain_fallback": f"with {FETCH}, h as ({bars('1h')}) select h.symbol, h.time, h.close, h.volume, case when p.lost then 'third' else 'first' end as provider from h join p on h.symbol = p.symbol and h.time between p.start and p.end",
    "chain_outcomes": f"with {FETCH} select symbol, start, \"end\", case when lost then 'third' else 'first' end as provider, case when lost then 'live' else 'delayed' end as quality, case when lost then 'first: page lost' end as reason, false as failed from p",
    "bars_read_through": f"with {TICKS}, h as ({bars('1h')}), w as ({WHOLE}), b as ({resampled_from_h('4h')}) select b.* from b join w using (symbol) where b.time between w.start and w.\"end\"",
    "bars_recent": f"with {TICKS}, h as ({bars('1h')}), n as (select max(time) as now from t), r as (select now - now % {H} + {H} - 10 * 86400000 as a, now - now % {H} + {H} as z from n) select h.* from h, r where time between a and z",
    "read_through_state": f"with {PADDED}, o as (select symbol, count(*) as ranges, count(*) filter (where lost) as failed from p group by symbol) select symbol, 'first' as provider, case when failed > 0 then 'partial' else 'delayed' end as quality, failed = ranges as cached, case when failed > 0 then failed || ' of ' || ranges || ' missing ranges could not be fetched: first: page lost' end as reason, ranges, failed, failed = 0 as trusted, failed > 0 as fallback from o",
    "read_through_coverage": f"with {PADDED}, c as (select symbol, start, least(\"end\", (select max(time) from t) - 2 * {H}) as z from p where not lost), k as (select * from c where start <= z), n as (select *, start > coalesce(lag(z) over (partition by symbol order by start), -1) as new from k), g as (select *, sum(cast(new as int)) over (partition by symbol order by start) as i from n) select symbol, '1h' as \"interval\", min(start) as start, max(z) as \"end\" from g group by symbol, i",
    "runs_counted": RUNS_COUNTED,
    "demo_checked": f"with {TICKS}, n as (select count(distinct time - time % 300000) as n from t where {IN_SESSION}) select unnest(['ES', 'NQ']) as symbol, n as bars, n as times, true as sound from n",
    "stream_cached": f"with {TICKS} {bars('1h')}",
    "stream_swings": f"{CLOSED} {swings(2)}",
    "stream_gaps": f"{CLOSED}, {GAPS} select * from gs",
    "stream_closed_bars": f"with {TICKS}, h as ({bars('1h')}) select * from h where time + {H} <= (select max(time) from t) - 2 * {H}",
}
ORACLES["run_saved"] = ORACLES["run_trades"]
