"""Streams with several state variables a key: jobs and their outputs, folded from the events of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query, read

#: What an event of the driver's table stands for.
EVENT = {"signup": "queue", "view": "start", "click": "output", "purchase": "finish", "error": "fail"}
LEASE_S = 86_400
_CASE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in EVENT.items()) + " end"
_LEASE_US = LEASE_S * 1_000_000


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import events

    rows = events.file_stream(spark, sf_dir, "events", read(spark, sf_dir, "events").schema)
    kinds = F.create_map(*[F.lit(x) for pair in EVENT.items() for x in pair])
    return rows.select("event_id", "user_id", "ts", kinds[F.col("event_type")].alias("event"), F.floor("value").cast("long").alias("size"))


@query(f"""
with recursive e as (select user_id, epoch_us(ts) t, {_CASE} ev, floor(value)::bigint size, row_number() over (partition by user_id order by epoch_us(ts), event_id) i from events),
m as (select max(epoch_us(ts)) - 3600000000 mark from events),
s as (select user_id, 0::bigint i, null::varchar st, 0 n, 0::bigint started, null::varchar err, null::bigint out_t, 0::bigint out_n from (select distinct user_id from e)
  union all select user_id, i, case when go is null then st1 else go end, n + coalesce((go = 'processing')::int, 0), case when go = 'processing' then t else started end,
    case when go is null then err1 when go = 'failed' and ev = 'fail' then 'failed' when go = 'failed' then 'no_output' end, case when ev = 'output' then t else out_t end, case when ev = 'output' then size else out_n end
  from (select *, case when ev = 'queue' and (st1 is null or st1 = 'failed') then 'queued' when ev = 'start' and st1 = 'queued' then 'processing' when ev = 'fail' and st1 = 'processing' then 'failed'
      when ev = 'finish' and st1 = 'processing' then case when out_t >= started and out_n > 0 then 'done' else 'failed' end end go
    from (select e.user_id, e.i, e.t, e.ev, e.size, s.n, s.started, s.out_t, s.out_n,
        case when st = 'processing' and e.t >= started + {_LEASE_US} then 'queued' else st end st1, case when st = 'processing' and e.t >= started + {_LEASE_US} then 'worker_lost' else err end err1
      from s join e on e.user_id = s.user_id and e.i = s.i + 1) x) y),
l as (select * from s qualify row_number() over (partition by user_id order by i desc) = 1)
select user_id, case when st = 'processing' and started + {_LEASE_US} <= mark then 'queued' else st end status, n attempts, case when st = 'processing' and started + {_LEASE_US} <= mark then 'worker_lost' else err end error_code
from l, m where st is not null""")
def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event is delivered twice; the states are those of single delivery."""
    from ..streaming import events, jobs

    rows = _jobs(jobs.state_session(spark), sf_dir)
    again = rows.unionByName(rows.where("event_id % 5 = 0"))
    states = events.drain(jobs.job_states(again, "user_id", "ts", LEASE_S, "1 hour"), "append")
    return jobs.latest(states, "user_id")


@query(f"""
with e as (select user_id, event_id, epoch_us(ts) t, {_CASE} ev, floor(value)::bigint size from events)
select f.user_id, f.event_id finish_id, o.event_id output_id, o.size from e f join e o on f.ev = 'finish' and o.ev = 'output' and o.user_id = f.user_id and o.t <= f.t and o.t >= f.t - {_LEASE_US}""")
def stream_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import events, jobs

    done, written = _jobs(spark, sf_dir).where("event = 'finish'"), _jobs(spark, sf_dir).where("event = 'output'")
    return events.drain(jobs.verified(done, written, "user_id", "ts", f"{LEASE_S} seconds", "1 hour"), "append")
