"""Whole-track stabilisation and region deviation on the driver's tables: a user's days are frames of a track, orders are frames of shots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import tracks
from .catalogue import query, r6, read

FPS, JUMP, MAX_GAP, FADE = 0.5, 60.0, 16.0, 12.0
EURO = (0.05, 0.002, 0.05)


def _low(dt: str, cutoff: str) -> str:
    turned = f"({dt} * ({cutoff}) * {2 * math.pi!r})"
    return f"({turned} / ({turned} + 1))"


def _pass_sql(out: str, no: str) -> str:
    """One pass of the filter along the runs of ``e``."""
    dt = "greatest(abs(e.t - w.t), 1e-6)"
    return f"""{out} as (select track, run, frame, {no} i, t, value v, value y, 0.0::double speed from e where {no} = 1
  union all select track, run, frame, i, t, v, y + {_low("dt", f"{EURO[0]} + {EURO[1]} * abs(sp)")} * (v - y), sp from (
    select e.track, e.run, e.frame, e.{no} i, e.t, e.value v, w.y, {dt} dt, w.speed + {_low(dt, repr(EURO[2]))} * ((e.value - w.y) / {dt} - w.speed) sp
    from {out} w join e on e.track = w.track and e.run = w.run and e.{no} = w.i + 1))"""


@query(f"""
with recursive d as (select user_id track, floor(epoch_us(ts) / 86400000000.0)::bigint frame, value from events where value is not null),
o as (select track, frame - (select min(frame) from d) frame, min(value) "value" from d group by track, frame),
b as (select *, lag(frame) over w bf, lag(value) over w bv from o window w as (partition by track order by frame)),
c as (select *, coalesce(frame - bf = 1 and abs(value - bv) > {JUMP}, false) cut from b),
f as (select *, bf is null or cut or (frame - bf) / {FPS}::double > {MAX_GAP} + 1e-9 fresh from c),
r as (select *, sum(cut::int) over w shot, sum(fresh::int) over w run from f window w as (partition by track order by frame)),
u as (select track, shot, run, frame, value, 'tracked' source from r
  union all select track, shot, run, bf + i, bv + (value - bv) * i / (frame - bf), 'interpolated' from r, lateral (select unnest(range(1, frame - bf)) i) where not fresh and frame - bf > 1),
e as (select *, frame / {FPS}::double t, row_number() over (partition by track, run order by frame) a, row_number() over (partition by track, run order by frame desc) z from u),
{_pass_sql("fw", "a")},
{_pass_sql("bw", "z")},
n as (select track, max(frame) + 1 n from u group by 1),
g as (select track, shot, run, min(frame) lo, max(frame) hi from u group by all),
s as (select track, shot, frame st from r where cut),
q as (select g.*, n.n, coalesce(s.st, 0) st, coalesce(x.st, n.n) nx from g join n using (track) left join s using (track, shot) left join s x on x.track = g.track and x.shot = g.shot + 1)
select u.track user_id, u.shot::bigint shot, u.frame, source, round(u.value, 6) "value", round((fw.y + bw.y) / 2, 6) smooth,
  round(least(1.0, greatest(0.0, least(case when lo > st then (u.frame - lo + 1) / {FPS}::double / {FADE} else 1 end, case when hi < nx - 1 then (hi - u.frame + 1) / {FPS}::double / {FADE} else 1 end))), 6) weight
from u join q using (track, shot, run) join fw on fw.track = u.track and fw.run = u.run and fw.frame = u.frame join bw on bw.track = u.track and bw.run = u.run and bw.frame = u.frame""")
def stabilised_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "events").where("value is not null").select("user_id", F.floor(names.micros(F.col("ts")) / 86_400_000_000).cast("long").alias("day"), "value")
    start = days.agg(F.min("day").alias("start"))
    frames = days.join(F.broadcast(start), F.lit(True)).select("user_id", (F.col("day") - F.col("start")).alias("frame"), "value")
    found = tracks.stabilised(frames, "user_id", "frame", "value", FPS, JUMP, MAX_GAP, FADE, None, *EURO)
    return found.select("user_id", "shot", "frame", "source", *[r6(c).alias(c) for c in ("value", "smooth", "weight")])


ON = 1.4


def _deviation_sql(passes: int = 3) -> str:
    kept = lambda c: f"case when keep then {c} end"
    med = lambda c: f"quantile_cont({c}, 0.5)"
    xs = ("x0", "x1", "x2", "x3")
    parts = ["""m as (select l_orderkey frame, l_linenumber region, max(l_quantity) q, max(l_discount) d, max(l_tax) t, max(l_extendedprice) e from lineitem group by 1, 2),
p0 as (select frame // 512 shot, frame, region, 50 * ln(greatest(q, 1e-3)) x0, d * 100 x1, case when t < 0.005 then null else t * 100 end x2, ln(greatest(e / 1000, 1e-3)) x3, t >= 0.005 ok from m),
t0 as (select *, ok keep, null::double score, false stopped from p0)"""]
    for i in range(passes):
        parts.append(f"""n{i} as (select shot, region, {", ".join(f"{med(kept(c))} m{c}" for c in xs)} from t{i} group by 1, 2),
d{i} as (select t.*, {", ".join(f"{c} - m{c} d{c}" for c in xs)} from t{i} t join n{i} using (shot, region)),
k{i} as (select *, row_number() over (partition by shot, frame order by round(sqrt(dx0 * dx0 + dx1 * dx1 + dx2 * dx2), 9), region) i from d{i} where keep),
c{i} as (select shot, frame, {", ".join(f"{med('d' + c)} c{c}" for c in xs)} from k{i} where i <= {tracks.COMMON_REGIONS} group by 1, 2),
e{i} as (select d.*, sqrt(power(dx0 - coalesce(cx0, 0), 2) + power(dx1 - coalesce(cx1, 0), 2) + power(dx2 - coalesce(cx2, 0), 2)) dev_c, abs(dx3 - coalesce(cx3, 0)) dev_t from d{i} d left join c{i} using (shot, frame)),
g{i} as (select shot, region, {med(kept("dev_c"))} mc, {med(kept("dev_t"))} mt, count(*) filter (keep) n from e{i} group by 1, 2),
h{i} as (select shot, region, {med(kept("abs(dev_c - mc)"))} sc, {med(kept("abs(dev_t - mt)"))} st from e{i} join g{i} using (shot, region) group by 1, 2),
s{i} as (select e.shot, e.frame, e.region, x0, x1, x2, x3, ok, keep, stopped, case when stopped or n < 3 then score else greatest(dev_c / greatest(1.4826 * sc, {tracks.COLOUR_FLOOR}), dev_t / greatest(1.4826 * st, {tracks.TEXTURE_FLOOR})) end score
  from e{i} e join g{i} using (shot, region) join h{i} using (shot, region)),
w{i} as (select shot, min(n) < 3 few from (select shot, region, count(*) filter (ok and coalesce(score, 'inf'::double) < {ON}) n from s{i} group by 1, 2) group by 1),
t{i + 1} as (select s.shot, frame, region, x0, x1, x2, x3, ok, case when stopped or few then keep else ok and coalesce(score, 'inf'::double) < {ON} end keep, score, stopped or few stopped from s{i} s join w{i} using (shot))""")
    return "with " + ",\n".join(parts) + f"\nselect shot, frame, region, round(case when ok then score end, 6) score from t{passes}"


@query(_deviation_sql())
def region_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("region"))
    most = each.agg(F.max("l_quantity").alias("light"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"), F.max("l_extendedprice").alias("e"))
    stats = most.select(
        F.expr("frame div 512").alias("shot"), "frame", "region", "light", (F.col("d") * 100).alias("a"), F.when(F.col("t") >= 0.005, F.col("t") * 100).alias("b"), (F.col("e") / 1000).alias("texture")
    )
    return tracks.region_deviation(stats, "shot", "frame", "region", ON).withColumn("score", r6("score"))
