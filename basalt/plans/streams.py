"""Queries that run a stream over a table to its end and return what it has made or kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.lineage import shared_path
from basalt.plans import tables as tb
from basalt.plans.catalog import CACHE_SQL, query
from basalt.streaming import live, state, timers


def _stream(s: SparkSession, d: str, table: str) -> DataFrame:
    # As a pattern, since a stream's path is a folder or a pattern, and the table may be one file.
    return s.readStream.schema(s.read.parquet(f"{d}/{table}.parquet").schema).parquet(f"{d}/{table}.parque[t]")


def _changes(s, d):
    ref = F.concat("event_type", F.col("user_id").cast("string"))
    op = F.when(F.col("event_id") % 3 == 0, "removed").otherwise("added")
    return _stream(s, d, "events").select(F.lit("kg").alias("tool_id"), F.col("event_id").alias("seq"), op.alias("op"), F.lit("entity").alias("kind"), ref.alias("ref_id"))


@query("select 'kg' as tool_id, 'entity' as kind, event_type || user_id as ref_id from events group by user_id, event_type having max(event_id) % 3 <> 0")
def r16_late_joiner(s, d):
    """Read from the state of the stream that has folded all events."""
    cp = shared_path(s, "fold")
    state.run(state.folded(_changes(s, d)), cp).awaitTermination()
    return state.present(s, cp)


@query("select 'kg' as tool_id, event_id as seq from events where event_id % 5 = 1 and event_id > 1")
def r16_gaps_met(s, d):
    cp = shared_path(s, "met")
    state.run(state.met(_changes(s, d).filter("seq % 5 <> 0")), cp, "append").awaitTermination()
    return state.gaps_met(s, cp)


def _cached(s, d) -> str:
    """The checkpoint of a stream that has kept a cache for each of 40 owners."""
    cp = shared_path(s, "cache")
    event = F.when(F.col("event_type") == "view", "deliver").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "request").otherwise("get")
    ev = _stream(s, d, "events").select((F.col("user_id") % 40).cast("string").alias("owner"), F.col("user_id").cast("string").alias("key"), event.alias("event"), F.col("event_id").cast("string").alias("value"), F.col("event_id").cast("double").alias("t"), F.col("event_id").alias("ord"))
    state.run(state.cached(ev, None), cp, "append").awaitTermination()
    return cp


@query(f"""with {CACHE_SQL}, m as (select key, arg_max(event, ord) as event, arg_max(value, ord) as value, max(t) as t from ev where event in ('deliver', 'fail') group by key)
select (key::bigint % 40)::varchar as owner, key, case when event = 'deliver' then value end as value, case when event = 'deliver' then 'value' else 'failed' end as state from m where event = 'deliver' or t + 60 > (select max(event_id) from events)""")
def r06_live_cache(s, d):
    now = tb.table(s, d, "events").agg(F.max("event_id")).first()[0]
    return state.kept_entries(s, _cached(s, d), float(now or 0))


@query(f"""with {CACHE_SQL}, last as (select key, max(ord) filter (event in ('deliver', 'fail')) as told, arg_max(event, ord) filter (event in ('deliver', 'fail')) as how, arg_max(t, ord) filter (event in ('deliver', 'fail')) as told_at from ev group by key)
select distinct (key::bigint % 40)::varchar as owner, key from ev join last using (key) where event = 'request' and (told is null or (ord > told and how = 'fail' and t >= told_at + 60))""")
def r17_live_in_flight(s, d):
    """What is waited for: the first request after a failure is forgotten starts work, one that finds a value starts none."""
    return state.keys_in_flight(s, _cached(s, d))


@query("""with t as (select o_orderkey as notification_id, 'C' || o_custkey as owner_name, o_orderdate + to_hours(left(o_orderpriority, 1)::int) as fire_at from orders)
select notification_id, owner_name, epoch_ms(fire_at) as fire_at_ms from t where epoch_ms(fire_at) <= (select epoch_ms(max(o_orderdate)) from orders)""")
def r02_ticks(s, d):
    """Every order sets a timer; the time of the stream is that of the newest order."""
    hours = F.substring("o_orderpriority", 1, 1).cast("int")
    asked = _stream(s, d, "orders").select(
        F.col("o_orderkey").alias("notification_id"), F.lit("schedule").alias("kind"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("owner_name"), F.col("o_orderstatus").alias("content"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=hours)).cast("timestamp").alias("fire_at"), F.col("o_orderdate").cast("timestamp").alias("ts"),
    )
    out = shared_path(s, "ticks")
    live.supervised(live.ticking(timers.deliveries(asked), live.to_folder(out), shared_path(s, "timers"), None))
    return s.read.parquet(out).select("notification_id", "owner_name", "fire_at_ms")


@query("select notification_id, count(*) as sent from (select o_orderkey as notification_id from orders) group by 1")
def r03_sent_once(s, d):
    """Every order is sent twice, an hour apart, and handed on once."""
    o = _stream(s, d, "orders").select(F.col("o_orderkey").alias("notification_id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    twice = o.select("notification_id", F.explode(F.array("at", F.col("at") + F.make_dt_interval(hours=F.lit(1)))).alias("at"))
    out = shared_path(s, "sent")
    live.supervised(live.ticking(live.once(twice, "at", "4000 days", "notification_id"), live.to_folder(out), shared_path(s, "once"), None))
    return s.read.parquet(out).groupBy("notification_id").agg(F.count("*").alias("sent"))


@query("""with e as (select user_id::varchar as agent_id, event_type as kind, event_id, ts, case when ts < lag(ts) over w + interval 12 hours then 0 else 1 end as begins from events window w as (partition by user_id order by ts, event_id)),
n as (select *, sum(begins) over (partition by agent_id order by ts, event_id rows between unbounded preceding and current row) as part from e)
select agent_id, epoch_us(min(ts)) // 1000000 as start, epoch_us(max(ts)) // 1000000 as last, count(*) as n, array_to_string(list_sort(list(distinct kind)), ',') as kinds from n group by agent_id, part""")
def r05_sessions(s, d):
    ev = tb.table(s, d, "events").select(F.col("user_id").cast("string").alias("agent_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return live.sessions(ev, "12 hours").select("agent_id", F.unix_seconds("start").alias("start"), F.unix_seconds("last").alias("last"), "n", F.array_join("kinds", ",").alias("kinds"))


RENDERED_SQL = """with o as (select 'C' || o_custkey as provider, case when o_custkey % 3 = 0 then o_orderstatus else 'orders' end as kind, o_orderpriority as state, o_orderkey as ord, o_orderkey % 4 as batch from orders),
n as (select provider, batch, arg_max(kind, ord) as kind, arg_max(state, ord) as state from o group by all),
l as (select *, lag(kind) over w as b_kind, lag(state) over w as b_state from n window w as (partition by provider order by batch)),
c as (select *, b_kind is null or b_kind <> kind as is_full from l where b_kind is null or b_kind <> kind or b_state <> state)
"""


def _rendered(s: SparkSession, d: str) -> live.Baselines:
    """Orders come in four batches, each a snapshot of its customers; the third is rendered twice."""
    o = tb.table(s, d, "orders")
    kind = F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderstatus")).otherwise("orders")
    rows = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("provider"), kind.alias("kind"), F.col("o_orderpriority").alias("state"), F.col("o_orderkey").alias("ord"))
    kept = live.Baselines(s, shared_path(s, "baselines"))
    for batch in (0, 1, 2, 2, 3):
        kept.render(rows.filter(F.col("ord") % 4 == batch), batch)
    return kept


@query(RENDERED_SQL + "select provider, batch::int as batch, case when is_full then 'full' else 'delta' end as mode, state, row_number() over (partition by provider order by batch) as number from c")
def r13_rendered_updates(s, d):
    return _rendered(s, d).updates().select("provider", "batch", "mode", "state", "number")


@query(RENDERED_SQL + "select provider, arg_max(kind, batch) as kind, arg_max(state, batch) as state, count(*) as number from c group by provider")
def r14_kept_baselines(s, d):
    return _rendered(s, d).before()


@query(RENDERED_SQL + """, e as (select provider, arg_max(kind, batch) as kind, arg_max(state, batch) as state, count(*) as number from c group by provider)
select provider, 'full' as mode, 1::bigint as number, state from e where provider[2:]::bigint % 2 = 0""")
def r15_after_reset(s, d):
    """Half of the providers are reset and then shown what they have: in full, counted from one again; the others have nothing new."""
    kept = _rendered(s, d)
    now = kept.before()
    kept.reset(now.filter("cast(substr(provider, 2) as long) % 2 = 0"), 4)
    kept.render(now.withColumn("ord", F.lit(1)), 5)
    return kept.updates().filter("batch = 5").select("provider", "mode", "number", "state")
