"""DuckDB SQL for the queries of ``problems``. None stands for a query without one."""

from __future__ import annotations

#: The names that the test tables' bar messages use for one quantity, read off the tables and independent of the operator's alias table.
BAR_NAMES = {
    "open_time": ["openTime", "t_open"],
    "close_time": ["closeTime"],
    "volume": ["base_volume", "vol"],
    "quote_volume": ["q_vol", "quoteVolume", "quote_asset_volume"],
    "number_of_trades": ["numTrades", "trade_count"],
    "taker_buy_base_volume": ["takerBuyBase", "taker_base_vol"],
    "taker_buy_quote_volume": ["taker_quote_vol"],
    "is_closed": ["closed", "is_final"],
}


def _ingest(column: str = "ingest_time") -> str:
    return f"(case when regexp_matches(trim({column}), '([zZ]|[+-][0-9]{{2}}:[0-9]{{2}})$') then try_cast(trim({column}) as timestamptz) else try_cast(trim({column}) || 'Z' as timestamptz) end)"


COUNTED = f"""
first_copies as (select symbol, trade_id, min(epoch_us({_ingest()})) a, arg_min(epoch_us(trade_time), epoch_us({_ingest()})) t
  from processed_trades where trade_time is not null and {_ingest()} is not null group by 1, 2),
placed as (select symbol, cast(floor(t / 3600000000.0) as bigint) * 3600 hour_epoch, a from first_copies)"""

_LOADS = f"""
cells as (
  select 'processed_trades' table_name, 'price' column_name, symbol, cast(floor(epoch_us({_ingest()}) / 3600000000.0) as bigint) * 3600 load_epoch, price v from processed_trades
  union all select 'processed_trades', 'qty', symbol, cast(floor(epoch_us({_ingest()}) / 3600000000.0) as bigint) * 3600, qty from processed_trades
  union all select 'processed_klines', 'volume', symbol, cast(floor(epoch_us({_ingest()}) / 3600000000.0) as bigint) * 3600, volume from processed_klines where "interval" = '1m'),
freq as (select table_name, column_name, symbol, load_epoch, v, count(*) n from cells where load_epoch is not null group by 1, 2, 3, 4, 5),
prof as (select table_name, column_name, symbol, load_epoch, cast(sum(n) as bigint) n_rows, cast(coalesce(sum(n) filter (v is null), 0) as bigint) nulls, cast(coalesce(sum(n) filter (v <= 0), 0) as bigint) nonpositive, count(v) n_distinct, cast(coalesce(max(n) filter (v is not null), 0) as bigint) n_top from freq group by 1, 2, 3, 4),
med as (select table_name, column_name, symbol, load_epoch, median(cast(v as double)) median from cells where v is not null and load_epoch is not null group by 1, 2, 3, 4),
loads as (select * from prof left join med using (table_name, column_name, symbol, load_epoch))"""

_STATUS = """
read as (select order_id, event_time, source_offset, regexp_replace(regexp_replace(upper(trim(order_status)), '[\\s-]+', '_', 'g'), '^CANCELLED$', 'CANCELED') s,
  regexp_replace(regexp_replace(regexp_replace(upper(trim(event_type)), '[\\s-]+', '_', 'g'), '^ORDER_', ''), '^CANCELLED$', 'CANCELED') e from staging_orders),
feed as (select order_id, event_time, source_offset, case when s in ('NEW', 'PARTIALLY_FILLED', 'FILLED', 'CANCELED', 'DELETED') then s when e in ('NEW', 'PARTIALLY_FILLED', 'FILLED', 'CANCELED', 'DELETED') then e end st from read),
ranked as (select order_id, epoch_ms(event_time) event_ms, st, row_number() over (partition by order_id order by event_time, case st when 'NEW' then 1 when 'PARTIALLY_FILLED' then 2 when 'DELETED' then 4 else 3 end, source_offset nulls first, st) rn
  from feed where order_id is not null and event_time is not null and st is not null)"""

_STATUS_ALL = (
    _STATUS.replace("select order_id, event_time, source_offset, regexp", "select *, regexp")
    .replace("select order_id, event_time, source_offset, case", "select *, case")
    .replace("select order_id, epoch_ms(event_time) event_ms, st,", "select *, epoch_ms(event_time) event_ms,")
)

_ALIASES = ", ".join(f"('{alias}', '{own}')" for own, others in BAR_NAMES.items() for alias in [own, *others])

#: Messages of raw_klines one by one, their fields with types, and where each field stood before and stands next.
_FIELDS = f"""
alias(name, quantity) as (values {_ALIASES}),
msg as (select kafka_partition p, kafka_offset o, cast(min(message_value) as json) j from raw_klines where json_valid(message_value) and json_type(message_value) = 'OBJECT' and kafka_partition is not null and kafka_offset is not null group by 1, 2),
line as (select *, lag(o) over (partition by p order by o) before, lead(o) over (partition by p order by o) after from msg),
each as (select p, o, before, after, j, unnest(json_keys(j)) k from line),
typed as (select p, o, before, after, k, case json_type(j, '$."' || k || '"') when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then null else 'number' end t from each),
span as (select *, lag(o) over (partition by p, k order by o) was, lead(o) over (partition by p, k order by o) next, last_value(t ignore nulls) over (partition by p, k order by o rows between unbounded preceding and 1 preceding) known from typed),
event as (
  select p, o, k, 'added' kind from span where before is not null and was is distinct from before
  union all select p, after, k, 'removed' from span where after is not null and next is distinct from after
  union all select p, o, k, 'retyped' from span where before is not null and was = before and t is not null and known is not null and t <> known),
numbered as (select e.*, coalesce(a.quantity, e.k) quantity, row_number() over (partition by p, o, coalesce(a.quantity, e.k), kind order by k) nth from event e left join alias a on a.name = e.k),
paired as (select *, kind <> 'retyped' and count(*) filter (kind <> 'retyped') over (partition by p, o, quantity, nth) = 2 moved from numbered)"""



def _read(column: str) -> str:
    names = ", ".join(f"""j->>'$."{n}"'""" for n in [column, *BAR_NAMES.get(column, [])])
    return f"nullif(trim(coalesce({names}, null)), '')"


_DECIMALS = ", ".join(f'cast(try_cast({_read(c)} as decimal({p},8)) as double) "{c}"' for c, p in (("open", 20), ("high", 20), ("low", 20), ("close", 20), ("volume", 20), ("quote_volume", 24)))
_BAR_VALUES = f"""select coalesce(nullif(upper(trim({_read('symbol')})), ''), nullif(upper(trim(split_part(message_key, '_', 1))), '')) symbol,
  coalesce({_read('interval')}, case when contains(message_key, '_') then split_part(message_key, '_', -1) end) kline_interval,
  try_cast({_read('open_time')} as bigint) open_time, try_cast({_read('close_time')} as bigint) close_time, {_DECIMALS}, try_cast({_read('number_of_trades')} as bigint) number_of_trades,
  case lower({_read('is_closed')}) when 'true' then true when 'false' then false end is_closed, kafka_topic source_topic, kafka_partition source_partition, kafka_offset source_offset, ingest_time
  from (select *, case when json_valid(message_value) then cast(message_value as json) end j from raw_klines)"""

ORACLES = {
    "p1_found": f"""with {COUNTED}, counted as (select symbol, hour_epoch, count(*) n from placed where a <= (hour_epoch + 25200) * 1000000 group by 1, 2),
  published as (select symbol, cast(epoch(summary_hour) as bigint) hour_epoch, arg_max(coalesce(trade_count, 0), updated_at) n from market_hourly_summary group by 1, 2)
  select coalesce(c.symbol, p.symbol) symbol, coalesce(c.hour_epoch, p.hour_epoch) hour_epoch from counted c full join published p on c.symbol = p.symbol and c.hour_epoch = p.hour_epoch where coalesce(c.n, 0) <> coalesce(p.n, 0)""",
    "p1_corrected_hours": f"""with {COUNTED} select symbol, hour_epoch, count(*) filter (a <= (hour_epoch + 25200) * 1000000) counted, count(*) filter (a > (hour_epoch + 25200) * 1000000) diverted from placed group by 1, 2""",
    "p1_closings": f"""with stamps as (select distinct concat_ws('-', source_topic, source_partition) s, epoch_us({_ingest()}) a from processed_trades where {_ingest()} is not null),
  hours as (select distinct cast(floor(epoch_us(trade_time) / 3600000000.0) as bigint) * 3600 h from processed_trades where trade_time is not null and {_ingest()} is not null),
  sources as (select distinct s from stamps), bounds as (select h, (h + 25200) * 1000000 b from hours),
  first_after as (select b.h, b.b, s.s, (select min(a) from stamps x where x.s = s.s and x.a > b.b) a from bounds b cross join sources s),
  by_hour as (select h, b, count(*) n, count(*) filter (a - b <= 3600000000) passed, max(a) filter (a - b <= 3600000000) latest, arg_max(s, {{'a': a, 's': s}}) filter (a - b <= 3600000000) last_source from first_after group by 1, 2),
  closed as (select *, case when passed < n then greatest(coalesce(latest, b + 3600000000), b + 3600000000) else latest end c from by_hour)
  select h hour_epoch, case when c <= (select max(a) from stamps) then c end closed_us, passed sources_passed, n - passed sources_excused, last_source from closed""",
    "p4_grid": """with steps as (select symbol, "interval" kline_interval, epoch_us(open_time) t, source_offset o, epoch_us(updated_at) u, cast("close" as double) v,
    cast(regexp_extract("interval", '^[0-9]+') as bigint) * case right("interval", 1) when 'm' then 60 when 'h' then 3600 when 'd' then 86400 when 's' then 1 end * 1000000 w from processed_klines where symbol is not null and open_time is not null and "interval" is not null),
  once as (select * exclude (rn) from (select *, row_number() over (partition by symbol, kline_interval, t order by o desc nulls last, u desc nulls last, v desc nulls last) rn from steps) where rn = 1),
  held as (select *, cast(floor(t / w::double) as bigint) * w own, lead(t) over (partition by symbol, kline_interval order by t) nxt from once),
  ended as (select *, case when nxt is not null and cast(floor(nxt / w::double) as bigint) * w - own <= 86400000000 then nxt else own + w end e from held),
  cells as (select *, unnest(generate_series(own, cast(floor(greatest(e - 1, t) / w::double) as bigint) * w, w)) cell from ended),
  parts as (select *, least(e, cell + w) - greatest(t, cell) len, greatest(least(e, cell + w, t + w) - greatest(t, cell), 0) fresh from cells)
  select symbol, kline_interval, cast(cell // 1000000 as bigint) slot_epoch, cast(count(*) filter (cell = own) as bigint) readings, round(sum(len * v) / nullif(sum(len) filter (v is not null), 0) + 1e-9, 6) mean, round(sum(fresh) / any_value(w) + 1e-9, 6) coverage,
    case when count(*) filter (cell = own) > 0 then 'observed' else 'filled' end marked from parts group by symbol, kline_interval, w, cell""",
    "p2_found": """with typed as (select 'processed_trades' table_name, symbol, trade_id from processed_trades where trade_id is not null),
  ok as (select message_key k, cast(message_value as json) j from raw_trades where json_valid(message_value)),
  raw as (select 'raw_trades' table_name, coalesce(nullif(upper(trim(j->>'symbol')), ''), nullif(upper(trim(k)), '')) symbol, try_cast(trim(j->>'trade_id') as bigint) trade_id from ok where json_type(j) = 'OBJECT')
  select table_name, symbol, trade_id from (select * from typed union all select * from raw where trade_id is not null) group by 1, 2, 3 having count(*) > 1""",
    "p2_trades_once": f"""select * exclude (rn, price, qty, quote_qty, trade_time), cast(price as double) price, cast(qty as double) qty, cast(quote_qty as double) quote_qty, epoch_us(trade_time) trade_us from (select *, row_number() over (partition by symbol, trade_id order by {_ingest()} nulls first, source_partition nulls first, source_offset nulls first, trade_time nulls first, price nulls first, qty nulls first, quote_qty nulls first, is_buyer_maker nulls first, is_best_match nulls first) rn from processed_trades) where rn = 1""",
    "p3_found": f"""with {_FIELDS} select p kafka_partition, o kafka_offset, k field_name, case when moved then 'renamed' else kind end change_kind from paired where not (moved and kind = 'added')""",
    "p3_bars_values": _BAR_VALUES,
    "p2_raw_once": f"""with rows_ as (select *, case when json_valid(message_value) then cast(message_value as json) end j from raw_trades),
  ided as (select *, case when json_type(j) = 'OBJECT' then try_cast(trim(j->>'trade_id') as bigint) end tid, coalesce(case when json_type(j) = 'OBJECT' then nullif(upper(trim(j->>'symbol')), '') end, nullif(upper(trim(message_key)), '')) sym from rows_),
  ranked as (select *, row_number() over (partition by sym, tid order by {_ingest()} nulls first, kafka_partition nulls first, kafka_offset nulls first, md5(message_value) nulls first) rn from ided)
  select kafka_topic, kafka_partition, kafka_offset, kafka_timestamp, message_key, message_value, ingest_time, ingest_date from ranked where rn = 1 or tid is null""",
    "p4_found": """with series as (select distinct symbol, "interval" kline_interval, w, cast(floor(epoch_us(open_time) / 1e6 / w) as bigint) * w slot
    from (select *, cast(regexp_extract("interval", '^[0-9]+') as bigint) * case right("interval", 1) when 'm' then 60 when 'h' then 3600 when 'd' then 86400 when 's' then 1 end w from processed_klines where symbol is not null and open_time is not null and "interval" is not null)),
  gaps as (select *, lead(slot) over (partition by symbol, kline_interval order by slot) nxt from series)
  select symbol, kline_interval, unnest(generate_series(slot + w, nxt - w, w)) slot_epoch from gaps where nxt - slot > w and nxt - slot <= 86400""",
    "p5_found": f"""with {_LOADS}, big as (select *, n_rows - nulls vals from loads where n_rows >= 30)
  select table_name, column_name, symbol, load_epoch, 'null_share' finding from big where nulls * 10 > n_rows
  union all select table_name, column_name, symbol, load_epoch, 'nonpositive_share' from big where nonpositive * 100 > vals * 8
  union all select table_name, column_name, symbol, load_epoch, 'dominant_value' from big where vals >= 20 and n_top * 10 > vals * 4
  union all select b.table_name, b.column_name, b.symbol, b.load_epoch, 'median_shift' from big b join big p on b.table_name = p.table_name and b.column_name = p.column_name and b.symbol = p.symbol and p.load_epoch + 3600 = b.load_epoch
    where b.vals >= 20 and p.vals >= 20 and b.median > 0 and p.median > 0 and greatest(b.median, p.median) > 5 * least(b.median, p.median)""",
    "p5_profile_counts": f"""with {_LOADS} select table_name, column_name, symbol, load_epoch, n_rows, nulls, nonpositive, n_distinct, n_top, round(median, 9) median from loads""",
    "p5_drift": f"""with {_LOADS}, bins as (select table_name, column_name, symbol, load_epoch, case when v = 0 then 0 when v > 0 then floor((floor(log2(cast(v as double)) * 16) + 20000) / 16) else floor(-(floor(log2(-cast(v as double)) * 16) + 20000) / 16) end b, sum(n) n from freq where v is not null group by 1, 2, 3, 4, 5),
  sides as (select table_name, column_name, symbol, load_epoch, b, n now, 0 was from bins union all select table_name, column_name, symbol, load_epoch + 3600, b, 0, n from bins),
  pair as (select table_name, column_name, symbol, load_epoch, b, cast(sum(now) as double) now, cast(sum(was) as double) was from sides group by 1, 2, 3, 4, 5),
  tot as (select *, sum(now) over w n1, sum(was) over w n0 from pair window w as (partition by table_name, column_name, symbol, load_epoch)),
  part as (select *, greatest(now, 0.5) / n1 p, greatest(was, 0.5) / n0 q, (now + was) * n1 / (n1 + n0) e1, (now + was) * n0 / (n1 + n0) e0 from tot where n1 > 0 and n0 > 0)
  select table_name, column_name, symbol, load_epoch, round(sum((p - q) * ln(p / q)) + 1e-9, 6) psi, round(sum((now - e1) * (now - e1) / e1 + (was - e0) * (was - e0) / e0) + 1e-9, 6) chi_square, count(*) bins from part group by 1, 2, 3, 4""",
    "p5_patterns": """with c as (select 'symbol' column_name, symbol load, symbol v, '^[A-Z]+USQ$' p from processed_trades union all select 'source_topic', symbol, source_topic, '^trades$' from processed_trades union all select 'ingest_time', symbol, ingest_time, '^\\d{4}-\\d\\d-\\d\\d[T ]' from processed_trades)
  select column_name, load symbol, count(*) n_rows, count(*) - count(v) nulls, count(distinct v) n_distinct, count(*) filter (v is not null and not regexp_matches(v, p)) violations, min(v) low_text, max(v) high_text from c group by 1, 2""",
    "p6_orders_values": f"""with {_STATUS_ALL}, state as (select order_id, max(rn) last_rn, coalesce(max(rn) filter (st = 'NEW'), 0) born, coalesce(max(rn) filter (st = 'DELETED'), 0) dead from ranked group by 1)
  select r.order_id, r.st order_status, r.event_ms, client_id, symbol, side, order_type, cast(order_price as double) order_price, cast(order_qty as double) order_qty, cast(filled_qty as double) filled_qty, cast(avg_fill_price as double) avg_fill_price, source_offset
  from state s join ranked r on s.order_id = r.order_id and s.last_rn = r.rn where dead = 0 or born > dead""",
    "p6_found": f"""with {_STATUS}, state as (select order_id, max(rn) last_rn, coalesce(max(rn) filter (st = 'NEW'), 0) born, coalesce(max(rn) filter (st = 'DELETED'), 0) dead from ranked group by 1)
  select r.order_id, r.st order_status, r.event_ms from state s join ranked r on s.order_id = r.order_id and s.last_rn = r.rn where dead = 0 or born > dead""",
}
