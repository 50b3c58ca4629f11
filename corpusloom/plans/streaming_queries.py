"""Queries of event streams over the supplied events as tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.sources import fixtures as x
from corpusloom.streaming import events as e

_ev = lambda f: lambda s, d: f(x.file_events(s, d))


def _starts(df):
    return df.withColumn("start", F.unix_timestamp("start"))


QUERIES = {
    "str01_debounce": _ev(lambda v: e.debounce_batch(v, 86400)),
    "str02_settle": _ev(lambda v: e.settle(v, "1 day")),
    "str03_coalesce": _ev(lambda v: _starts(e.coalesce(v, "1 day"))),
    "str04_state_table": _ev(e.state_table),
    "str05_split_moves": _ev(e.split_moves),
    "str06_payloads": _ev(e.payloads),
    "str11_counters": _ev(lambda v: _starts(e.counters(v, "1 hour"))),
    "str12_latest_beat": _ev(lambda v: e.latest_beat(v.withColumn("node", F.substring_index("path", "/", 1)))),
    "str07_dead_letters": _ev(lambda v: e.normalise(v.withColumn("kind", F.when(F.col("event_id") % 7 == 0, "odd").otherwise(F.col("kind"))))[1].select("event_id")),
}
_v = f"with {x.FILE_EVENTS_SQL}"
SQL = {
    "str01_debounce": f"with recursive {x.FILE_EVENTS_SQL}, n as (select *, row_number() over (partition by kind, path order by ts, event_id) as i from file_events), f as (select kind, path, i, event_id, ts as last, true as let from n where i = 1 union all select n.kind, n.path, n.i, n.event_id, case when epoch_ms(n.ts) - epoch_ms(f.last) >= 86400000 then n.ts else f.last end, epoch_ms(n.ts) - epoch_ms(f.last) >= 86400000 from f join n on n.kind = f.kind and n.path = f.path and n.i = f.i + 1) select event_id, kind, path from f where let",
    "str02_settle": f"{_v}, g as (select *, case when ts - lag(ts) over (partition by path order by ts, event_id) < interval 1 day then 0 else 1 end as new from file_events), s as (select *, sum(new) over (partition by path order by ts, event_id rows unbounded preceding) as nth from g) select path, arg_max(event_id, (ts, event_id)) as event_id, count(*) as n from s group by path, nth",
    "str03_coalesce": f"{_v} select cast(epoch(date_trunc('day', ts)) as bigint) as start, path, event_id, kind from file_events qualify row_number() over (partition by date_trunc('day', ts), path order by ts desc, event_id desc) = 1",
    "str04_state_table": f"{_v} select path, kind, event_id from file_events qualify row_number() over (partition by path order by ts desc, event_id desc) = 1",
    "str05_split_moves": f"{_v} select event_id, kind, path from file_events where kind <> 'moved' union all select event_id, 'moved_out', path from file_events where kind = 'moved' union all select event_id, 'moved_in', 'lib/' || path from file_events where kind = 'moved'",
    "str06_payloads": f"{_v} select event_id, 'ledger' as payload from file_events union all select event_id, 'classify' from file_events where kind <> 'deleted' union all select event_id, 'profile' from file_events where kind in ('created', 'moved') union all select event_id, 'hash' from file_events where kind = 'created'",
    "str11_counters": f"{_v} select cast(epoch(date_trunc('hour', ts)) as bigint) as start, kind, count(*) as n from file_events group by 1, 2",
    "str12_latest_beat": f"{_v} select string_split(path, '/')[1] as node, arg_max(event_id, (ts, event_id)) as event_id from file_events group by 1",
    "str07_dead_letters": f"{_v} select event_id from file_events where event_id % 7 = 0",
}
