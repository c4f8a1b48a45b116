"""Gates, drift, evidence, undo and macros on the driver's tables: parts are frames and jobs, orders are images of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advice, jobs
from .catalogue import LAB_SQL, _lab, query, r6, read


@query("""
with p as (select p_partkey, p_size / 50.0 c, case when p_partkey % 4 = 0 then null else (p_partkey % 97) / 96.0 end s, case when p_partkey % 5 = 0 then null else p_retailprice / 2000 end m, p_partkey % 11 = 0 o from part),
l as (select p_partkey, least(greatest(coalesce(c, 0), 0), greatest(coalesce(s, 1), 0), greatest(coalesce(m, 1), 0), 1) v, o from p),
f as (select p_partkey, case when o then least(v, 0.35) else v end::double v from l), a as (select *, case when v >= 0.85 then 'apply' when v >= 0.65 then 'dampen' when v >= 0.4 then 'review' else 'skip' end "action" from f)
select p_partkey, round(v, 6) confidence, "action", case "action" when 'apply' then 1.0 when 'dampen' then 0.5 else 0.0 end::double scale from a""")
def safe_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    stability, model = F.when(key % 4 != 0, (key % 97) / 96), F.when(key % 5 != 0, F.col("p_retailprice") / 2000)
    found = advice.mask_confidence(F.col("p_size") / 50, stability, model, key % 11 == 0)
    rows = read(spark, sf_dir, "part").select("p_partkey", found.alias("confidence"))
    action, scale = advice.safe_auto(F.col("confidence"))
    return rows.select("p_partkey", r6("confidence").alias("confidence"), action.alias("action"), scale.alias("scale"))


@query(LAB_SQL + """, s as (select l_orderkey // 64 shoot, l_orderkey k, avg(a) a, avg(b) b, count(*) * 30 n from lab group by 1, 2),
r as (select shoot, arg_min(a, k) ra, arg_min(b, k) rb, arg_min(n >= 100, k) rv from s where k % 64 in (3, 5) group by 1),
d as (select s.shoot, k, coalesce(n >= 100 and rv, false) ok, a - ra da, b - rb db from s left join r using (shoot))
select shoot, k, round(case when ok then db * 50 else 0 end, 5) kelvin_delta, round(case when ok then least(sqrt(da * da + db * db) / 15, 1) else 0 end, 6) confidence, round(case when ok then sqrt(da * da + db * db) else 0 end, 6) drift from d""")
def shot_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = _lab(spark, sf_dir).groupBy(F.expr("l_orderkey div 64").alias("shoot"), F.col("l_orderkey").alias("k")).agg(F.avg("a").alias("a"), F.avg("b").alias("b"), (F.count(F.lit(1)) * 30).alias("n"))
    found = advice.shot_consistency(shots, "shoot", "k", (F.col("k") % 64).isin(3, 5))
    return found.select("shoot", "k", r6("kelvin_delta", 5).alias("kelvin_delta"), r6("confidence").alias("confidence"), r6("drift").alias("drift"))


@query(LAB_SQL + f""", z as (select l_orderkey // 512 image, li l0, a a0, b b0, li * 0.97 l1, a + (l_orderkey // 512 % 5) * 4 a1, b - (l_orderkey // 512 % 3) * 2 b1 from lab),
p as (select *, sqrt(a0 * a0 + b0 * b0) q0, sqrt(a1 * a1 + b1 * b1) q1 from z), q as (select *, 0.5 * (1 - sqrt(power((q0 + q1) / 2, 7) / (power((q0 + q1) / 2, 7) + power(25.0, 7)))) g from p),
s as (select *, sqrt(power(a0 * (1 + g), 2) + b0 * b0) c1, sqrt(power(a1 * (1 + g), 2) + b1 * b1) c2, (degrees(atan2(b0, a0 * (1 + g))) + 360) % 360 h1, (degrees(atan2(b1, a1 * (1 + g))) + 360) % 360 h2 from q),
t as (select *, case when c1 * c2 = 0 then 0 when abs(h2 - h1) <= 180 then h2 - h1 when h2 - h1 > 180 then h2 - h1 - 360 else h2 - h1 + 360 end dh,
  case when c1 * c2 = 0 then h1 + h2 when abs(h2 - h1) <= 180 then (h1 + h2) / 2 when h1 + h2 < 360 then (h1 + h2 + 360) / 2 else (h1 + h2 - 360) / 2 end hm, (c1 + c2) / 2 cm, (l0 + l1) / 2 lm from s),
u as (select *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)) tt from t),
v as (select *, (l1 - l0) / (1 + 0.015 * power(lm - 50, 2) / sqrt(20 + power(lm - 50, 2))) x, (c2 - c1) / (1 + 0.045 * cm) y, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * cm * tt) w,
  -2 * sqrt(power(cm, 7) / (power(cm, 7) + power(25.0, 7))) * sin(radians(60 * exp(-power((hm - 275) / 25, 2)))) rt from u),
e as (select image, sqrt(greatest(x * x + y * y + w * w + rt * y * w, 0)) de, q0, least(q0, q1) c, abs((degrees(atan2(b1, a1)) - degrees(atan2(b0, a0)) + 540 + 360) % 360 - 180) turn from v),
m as (select image, greatest(0.5 * median(q0), 1) lowest from e group by 1), k as (select e.*, case when c >= lowest then turn end h from e join m using (image)),
fin as (select image, avg(de) de, avg(h) hm, quantile_cont(h, 0.95) hp, count(h) k, count(*) n from k group by 1)
select image, case when k < {advice.LEAST_PIXELS} then 'not-run' when hm > 6 or hp > 20 then 'checked-flagged' else 'checked-pass' end status, round(de, 5) delta_e, round(case when k >= {advice.LEAST_PIXELS} then hm end, 5) hue_mean,
  round(case when k >= {advice.LEAST_PIXELS} then hp end, 5) hue_p95, round(k / n, 6) kept, round(case when k >= {advice.LEAST_PIXELS} then least(1, greatest(hp / 40, hm / 12)) end, 6) score from fin""")
def colour_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.expr("l_orderkey div 512")
    pairs = _lab(spark, sf_dir).select(
        image.alias("image"), F.col("li").alias("l0"), F.col("a").alias("a0"), F.col("b").alias("b0"), (F.col("li") * 0.97).alias("l1"), (F.col("a") + image % 5 * 4).alias("a1"), (F.col("b") - image % 3 * 2).alias("b1")
    )
    found = advice.colour_drift(pairs, "image", ("l0", "a0", "b0"), ("l1", "a1", "b1"))
    return found.select("image", "status", *[r6(c, 5).alias(c) for c in ("delta_e", "hue_mean", "hue_p95")], r6("kept").alias("kept"), r6("score").alias("score"))


DETECTORS = ["banding", "seam", "clipping", "drift", "texture"]


@query(f"""
with d as (select unnest({DETECTORS}) detector, unnest(range(1, {len(DETECTORS) + 1})) no),
r as (select l_partkey job, {DETECTORS}[(l_suppkey % {len(DETECTORS)} + 1)::int] detector, l_orderkey * 10 + l_linenumber o, case when l_quantity < 4 then false when l_quantity < 8 then null else true end available, l_tax > 0.005 measured, l_discount > 0.07 flagged, l_discount score, l_extendedprice e from lineitem),
l as (select job, detector, arg_max({{'v': available, 'm': measured, 'f': flagged, 's': score}}, (o, e)) x from r group by 1, 2),
s as (select p_partkey job, d.detector, x, case when x is null or (coalesce(x.v, true) and not coalesce(x.m, true)) then 'not-run' when not coalesce(x.v, true) then 'unavailable' when coalesce(x.f, false) then 'checked-flagged' else 'checked-pass' end status from part cross join d left join l on l.job = p_partkey and l.detector = d.detector)
select job, detector, status, case when starts_with(status, 'checked') then x.s end score from s""")
def qa_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, DETECTORS)), (F.col("l_suppkey") % len(DETECTORS) + 1).cast("int"))
    available = F.when(F.col("l_quantity") < 4, False).when(F.col("l_quantity") >= 8, True)
    results = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("job"), name.alias("detector"), available.alias("available"), (F.col("l_tax") > 0.005).alias("measured"), (F.col("l_discount") > 0.07).alias("flagged"),
        F.col("l_discount").alias("score"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), "l_extendedprice").alias("order"),
    )
    return advice.evidence(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("job")), results, "job", DETECTORS)


MOVES_SQL = """with m as (select 'in/' || (p_partkey % 37) || '/' || (p_partkey // 2) source, case when p_partkey % 13 = 0 then 'in/' || (p_partkey % 37) || '/' || (p_partkey // 2) else 'sets/' || (p_partkey // 3) || '/' || p_partkey end destination, p_partkey k from part),
e as (select distinct path from (select source path from m where k % 5 = 0 union all select destination from m where k % 4 <> 0)),
j as (select distinct m.source, m.destination, s.path is not null s, d.path is not null d from m left join e s on s.path = m.source left join e d on d.path = m.destination),
v as (select source, destination, case when source = destination then 'nothing' when not d and not s then 'missing' when not d then 'nothing' when s then 'exists again' else 'restore' end v from j),
f as (select source, min(destination) lowest from v where v = 'restore' group by 1),
w as (select v.source, v.destination, case when v = 'restore' and v.destination <> lowest then 'exists again' else v end verdict from v left join f using (source))
"""


def _moves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("p_partkey")
    source = F.concat(F.lit("in/"), key % 37, F.lit("/"), F.expr("p_partkey div 2"))
    moved = F.when(key % 13 == 0, source).otherwise(F.concat(F.lit("sets/"), F.expr("p_partkey div 3"), F.lit("/"), key))
    moves = read(spark, sf_dir, "part").select(source.alias("source"), moved.alias("destination"), key.alias("k"))
    existing = moves.where("k % 5 = 0").select(F.col("source").alias("path")).unionByName(moves.where("k % 4 != 0").select(F.col("destination").alias("path")))
    return advice.undo_plan(moves, existing)


@query(MOVES_SQL + "select * from w")
def undo_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir)[0]


@query(MOVES_SQL + r""", l as (select path from e where path not in (select destination from w where verdict = 'restore') union all select source from w where verdict = 'restore')
select distinct regexp_replace(destination, '/[^/]*$', '') folder from w where regexp_replace(destination, '/[^/]*$', '') not in (select regexp_replace(path, '/[^/]*$', '') from l)""")
def undo_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir)[1]


@query("""
with w as (select n_nationkey % 7 macro, n_nationkey parameter, 40.0 + n_nationkey positive, case when n_nationkey % 3 <> 0 then -30.0 - n_nationkey end negative, n_nationkey % 4 = 0 crossing, case when n_nationkey % 5 <> 0 then -25.0 end low, case when n_nationkey % 6 <> 0 then 45.0 end high, n_nationkey % 2 = 0 whole from nation),
a as (select p_partkey frame, p_partkey % 7 macro, round((p_size - 25.5) / 24, 4) amount, case when p_partkey % 17 <> 0 then (p_partkey % 61) - 30.0 end base from part),
m as (select frame, w.*, amount, base, case when amount = 0 then base else base + abs(amount) * (case when amount > 0 then positive else negative end - base) end moved from a join w using (macro)),
q as (select *, case when base is null then 'no base' when abs(amount) > 1 then 'amount' when amount < 0 and negative is null then 'one-sided' when sign(base) * sign(moved) < 0 and not crossing then 'crosses zero' end problem,
  least(greatest(moved, coalesce(low, moved)), coalesce(high, greatest(moved, coalesce(low, moved)))) inside from m)
select frame, macro, parameter, round(case when problem is null then case when amount = 0 then base when whole then round_even(inside, 0) else inside end end, 6)::double "value", problem from q""")
def macro_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    number = lambda c: c.cast("double")
    nation = read(spark, sf_dir, "nation")
    writes = nation.select((n % 7).alias("macro"), n.alias("parameter"), number(n + 40).alias("positive"), F.when(n % 3 != 0, number(-30 - n)).alias("negative"), (n % 4 == 0).alias("crossing"))
    parameters = nation.select(n.alias("parameter"), F.when(n % 5 != 0, F.lit(-25.0)).alias("low"), F.when(n % 6 != 0, F.lit(45.0)).alias("high"), (n % 2 == 0).alias("whole"))
    key = F.col("p_partkey")
    parts = read(spark, sf_dir, "part")
    amounts = parts.select(key.alias("frame"), (key % 7).alias("macro"), F.round((F.col("p_size") - 25.5) / 24, 4).alias("amount"))
    base = amounts.join(writes.select("macro", "parameter"), "macro").where("frame % 17 != 0").select("frame", "parameter", number(F.col("frame") % 61 - 30).alias("base"))
    found = advice.macro_values(amounts, writes, parameters, base)
    return found.select("frame", "macro", "parameter", r6("value").alias("value"), "problem")


@query("""
with b as (select p_partkey id, p_size % 3 attempts, p_name status from part where p_partkey % 7 <> 0), l as (select p_partkey id, p_size % 3 + p_partkey % 2 attempts, case when p_partkey % 5 = 0 then 'local' else p_name end status from part where p_partkey % 11 <> 0),
i as (select p_partkey id, p_size % 3 + p_partkey % 3 attempts, case when p_partkey % 3 = 0 then 'incoming' else p_name end status from part where p_partkey % 13 <> 0)
select coalesce(l.id, i.id) id, (case when i.id is null then l.attempts when l.id is null then i.attempts else greatest(case when l.attempts is not distinct from b.attempts then i.attempts else l.attempts end, i.attempts) end)::bigint attempts,
  case when i.id is null then l.status when l.id is null then i.status when l.status is not distinct from b.status then i.status else l.status end status from l full join i on i.id = l.id left join b on b.id = coalesce(l.id, i.id)""")
def job_merge_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    parts = read(spark, sf_dir, "part")
    rows = lambda keep, attempts, status: parts.where(keep).select(key.alias("id"), attempts.cast("long").alias("attempts"), status.alias("status"))
    base = rows(key % 7 != 0, size % 3, F.col("p_name"))
    local = rows(key % 11 != 0, size % 3 + key % 2, F.when(key % 5 == 0, "local").otherwise(F.col("p_name")))
    incoming = rows(key % 13 != 0, size % 3 + key % 3, F.when(key % 3 == 0, "incoming").otherwise(F.col("p_name")))
    return jobs.merge_jobs(base, local, incoming, "id", ["attempts", "status"])
