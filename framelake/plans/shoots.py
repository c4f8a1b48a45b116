"""More of the catalogue: jobs, recipes, corpora, task graphs and faces on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import corpus, faces, graph, jobs, planning, recipes
from .catalogue import query, r6, read

# --- jobs ---------------------------------------------------------------------------------------

STATUS_SQL = "['pending', 'queued', 'processing', 'done', 'failed'][({0})::int + 1]"
RANK_SQL = "case {0} when 'queued' then 1 when 'processing' then 2 when 'done' then 3 when 'failed' then 3 else 0 end"


def _status(n):
    return F.element_at(F.array(*map(F.lit, ("pending", "queued", "processing", "done", "failed"))), (n + 1).cast("int"))


_PICK = "case when i.k is null then l.{0} when l.k is null then i.{0} when l.{0} is not distinct from b.{0} then i.{0} when i.{0} is not distinct from b.{0} then l.{0} else {1} end {0}"


@query(f"""
with b as (select o_orderkey k, {STATUS_SQL.format("o_orderkey % 5")} status, (o_orderkey % 3)::int attempts, o_orderpriority error from orders where o_orderkey % 7 <> 0),
l as (select o_orderkey k, {STATUS_SQL.format("case when o_totalprice > 150000 then o_custkey % 5 else o_orderkey % 5 end")} status, (o_orderkey % 4)::int attempts,
  case when o_custkey % 4 = 0 then null else o_orderpriority end error from orders where o_orderkey % 3 <> 0),
i as (select o_orderkey k, {STATUS_SQL.format("case when o_totalprice < 250000 then (o_custkey + 1) % 5 else o_orderkey % 5 end")} status, (o_custkey % 4)::int attempts,
  case when o_custkey % 5 = 0 then 'retry' else o_orderpriority end error from orders where o_orderkey % 5 <> 0)
select coalesce(l.k, i.k) k, {_PICK.format("status", "case when " + RANK_SQL.format("i.status") + " > " + RANK_SQL.format("l.status") + " then i.status else l.status end")},
  {_PICK.format("attempts", "greatest(l.attempts, i.attempts)")}, {_PICK.format("error", "l.error")}
from l full join i on l.k = i.k left join b on b.k = coalesce(l.k, i.k)""")
def job_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    k, c, price, priority = F.col("k"), F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderpriority")
    base = orders.where("k % 7 != 0").select("k", _status(k % 5).alias("status"), (k % 3).cast("int").alias("attempts"), priority.alias("error"))
    local = orders.where("k % 3 != 0").select(
        "k", _status(F.when(price > 150000, c % 5).otherwise(k % 5)).alias("status"), (k % 4).cast("int").alias("attempts"), F.when(c % 4 != 0, priority).alias("error")
    )
    incoming = orders.where("k % 5 != 0").select(
        "k", _status(F.when(price < 250000, (c + 1) % 5).otherwise(k % 5)).alias("status"), (c % 4).cast("int").alias("attempts"), F.when(c % 5 == 0, "retry").otherwise(priority).alias("error")
    )
    return jobs.merge_records(base, local, incoming, "k", ["status", "attempts", "error"])


@query("""
with j as (select o_orderkey, case when o_orderstatus = 'O' then 'processing' else 'done' end status,
  case when o_orderkey % 50 = 0 then 'yesterday' when o_orderkey % 51 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d') end started_at from orders),
s as (select *, status = 'processing' and started_at <> '' and (try_cast(started_at as timestamp) is null or try_cast(started_at as timestamp) <= timestamp '1998-07-01') recovered from j)
select o_orderkey, case when recovered then 'queued' else status end status, case when recovered then 'worker_lost' end error_code, case when not recovered then started_at end started_at, recovered from s""")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    started = F.when(key % 50 == 0, "yesterday").when(key % 51 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", "processing").otherwise("done").alias("status"), F.lit(None).cast("string").alias("error_code"), started.alias("started_at")
    )
    return jobs.recover_stale(rows, F.to_timestamp(F.lit("1998-08-01")), 31 * 86400)


JOBS_SQL = """
with r as (select c_name path, c_mktsegment kind, sha256(concat_ws(chr(31), c_custkey::varchar, c_mktsegment, 'v2')) job_id from customer),
o as (select c_name path, c_mktsegment kind, sha256(concat_ws(chr(31), c_custkey::varchar, c_mktsegment, case when c_custkey % 2 = 0 then 'v2' else 'v1' end)) job_id,
  case when c_custkey % 3 = 0 then 'queued' else 'done' end status from customer where c_custkey % 4 < 2)
"""


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    ready = rows.select(F.col("c_name").alias("path"), F.col("c_mktsegment").alias("kind"), jobs.job_key(key, F.col("c_mktsegment"), F.lit("v2")).alias("job_id"))
    there = rows.where("c_custkey % 4 < 2").select(
        F.col("c_name").alias("path"), F.col("c_mktsegment").alias("kind"), jobs.job_key(key, F.col("c_mktsegment"), F.when(key % 2 == 0, "v2").otherwise("v1")).alias("job_id"),
        F.when(key % 3 == 0, "queued").otherwise("done").alias("status"),
    )
    return ready, there


@query(JOBS_SQL + "select * from r anti join o on o.job_id = r.job_id order by path, kind limit 25")
def job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_jobs(*_jobs(spark, sf_dir), 25)[0].select("path", "kind", "job_id")


@query(JOBS_SQL + "select distinct o.* from o join r on r.path = o.path and r.kind = o.kind where o.status = 'queued' and r.job_id <> o.job_id")
def job_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_jobs(*_jobs(spark, sf_dir), 25)[1].select("path", "kind", "job_id", "status")


@query("select o_orderkey path, 'failed' status from orders where o_orderstatus = 'O' and o_orderkey not in (select l_orderkey from lineitem where l_linenumber = 2)")
def vanished_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "O", "processing").otherwise("done").alias("status"))
    listing = read(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("path"))
    return jobs.vanished(records, listing)


@query("""
with j as (select doc_id job_id, sha256(text) h from documents), o as (select doc_id job_id, case when quality = 0 then 0 else 10 end "size", case when toxic = 1 then 'x' else (select sha256(text) from documents d where d.doc_id = labels.doc_id) end h from labels),
e as (select j.job_id, case when "size" is null then 'output_missing' when "size" <= 0 then 'output_empty' when j.h is distinct from o.h then 'output_changed' end error_code from j left join o using (job_id))
select job_id, error_code, case when error_code is null then 'done' else 'failed' end status from e""")
def verified_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.sha2("text", 256).alias("sha256"))
    labels = read(spark, sf_dir, "labels").join(ran, F.col("doc_id") == F.col("job_id"), "left")
    outputs = labels.select(F.col("doc_id").alias("job_id"), F.when(F.col("quality") == 0, 0).otherwise(10).alias("size"), F.when(F.col("toxic") == 1, "x").otherwise(F.col("sha256")).alias("sha256"))
    return jobs.verified(ran, outputs).select("job_id", "error_code", "status")


@query("""
with recursive n as (select user_id, event_id, case when event_id % 3 = 0 then 'undo' when event_id % 7 = 0 then 'redo' else 'push' end a, row_number() over (partition by user_id order by event_id) i from events),
w as (select user_id, i, case when a = 'push' then [event_id] else []::bigint[] end held, case when a = 'push' then 1 else 0 end pos from n where i = 1
  union all select user_id, i, case when a = 'push' then kept else held end, case when a = 'push' then len(kept) when a = 'undo' then greatest(pos - 1, least(len(held), 1)) else least(pos + 1, len(held)) end from (
    select n.user_id, n.i, n.a, w.held, w.pos, list_append(w.held[1:w.pos], n.event_id) grown, grown[greatest(len(grown) - 7, 1):] kept from w join n on n.user_id = w.user_id and n.i = w.i + 1))
select user_id, case when pos > 0 then held[pos] end event_id, pos > 1 can_undo, pos < len(held) can_redo from w qualify row_number() over (partition by user_id order by i desc) = 1""")
def undo_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(key % 3 == 0, "undo").when(key % 7 == 0, "redo").otherwise("push").alias("a"))
    return jobs.undo_redo(rows.withColumn("o", key), "user_id", "o", "a", "event_id", 8)


# --- recipes ------------------------------------------------------------------------------------

PARAMS = [("p0", "a.x", "percent", 10.0, 0.0, 100.0), ("p1", "a.y", "flag", 0.0, 0.0, 1.0), ("p2", "b", "inverse", 0.5, 0.0, 1.0), ("p3", "c.d.e", "plain", 7.0, -50.0, 50.0)]
PARAMS_SQL = "(values " + ", ".join(str(p) for p in PARAMS) + ") p(name, recipe_key, conversion, \"default\", min_val, max_val)"


def _params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARAMS, "name string, recipe_key string, conversion string, default double, min_val double, max_val double")


VALUES_SQL = """
with v as (select c_custkey recipe, ['a.x', 'a.y', 'b', 'c.d.e'][c_custkey % 4 + 1] path, c_acctbal / 10000 "value" from customer),
o as (select c_custkey recipe, ['p0', 'p1', 'p2', 'p3'][c_nationkey % 4 + 1] name, case when c_custkey % 5 <> 0 then c_acctbal / 50 end "value" from customer where c_custkey % 3 = 0)
"""


def _values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "customer")
    at = lambda choices, n: F.element_at(F.array(*map(F.lit, choices)), (n % 4 + 1).cast("int"))
    key = F.col("c_custkey")
    values = rows.select(key.alias("recipe"), at(("a.x", "a.y", "b", "c.d.e"), key).alias("path"), (F.col("c_acctbal") / 10000).alias("value"))
    overrides = rows.where("c_custkey % 3 = 0").select(key.alias("recipe"), at(("p0", "p1", "p2", "p3"), F.col("c_nationkey")).alias("name"), F.when(key % 5 != 0, F.col("c_acctbal") / 50).alias("value"))
    return values, overrides


@query(VALUES_SQL + f"""
select c_custkey recipe, p.name, round(least(greatest(coalesce(o."value", case conversion when 'percent' then v."value" * 100 when 'flag' then case when v."value" > 0 then 1.0 when v."value" <= 0 then 0.0 end
    when 'inverse' then 1 - v."value" else v."value" end, "default"), min_val), max_val), 6) "value",
  case when o."value" is not null then 'override' when v."value" is not null then 'recipe' else 'default' end origin
from customer cross join {PARAMS_SQL} left join v on v.recipe = c_custkey and v.path = p.recipe_key left join o on o.recipe = c_custkey and o.name = p.name""")
def param_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, overrides = _values(spark, sf_dir)
    names_ = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("recipe"))
    return recipes.resolved(_params(spark), names_, values, overrides).withColumn("value", r6("value"))


@query("""
with b as (select c_custkey recipe, unnest(['a', 'b.c', 'b.d.e', 'f.g']) path, c_nationkey::varchar "value" from customer),
o as (select c_custkey recipe, ['a.x', 'b', 'b.d', 'f.g', 'h', 'b.d.e.z'][c_custkey % 6 + 1] path, c_mktsegment "value" from customer where c_custkey % 7 <> 0)
select recipe, path, "value" from o union all
select recipe, path, "value" from b where not exists (select 1 from o where o.recipe = b.recipe and (o.path = b.path or starts_with(o.path, b.path || '.') or starts_with(b.path, o.path || '.')))""")
def deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer")
    base = rows.select(F.col("c_custkey").alias("recipe"), F.explode(F.array(*map(F.lit, ("a", "b.c", "b.d.e", "f.g")))).alias("path"), F.col("c_nationkey").cast("string").alias("value"))
    path = F.element_at(F.array(*map(F.lit, ("a.x", "b", "b.d", "f.g", "h", "b.d.e.z"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    override = rows.where("c_custkey % 7 != 0").select(F.col("c_custkey").alias("recipe"), path.alias("path"), F.col("c_mktsegment").alias("value"))
    return recipes.deep_merge(base, override, "recipe")


@query(f"""
with v as (select p_partkey, ['a.x', 'a.y', 'b', 'zz'][p_size % 4 + 1] path, case when p_size % 6 = 0 then 'high' else (p_retailprice / 20)::decimal(10, 3)::varchar end "value" from part)
select p_partkey, path, case when recipe_key is null then 'unknown' when try_cast("value" as double) is null then 'not_a_number' else 'out_of_range' end problem
from v left join {PARAMS_SQL} on recipe_key = path where recipe_key is null or try_cast("value" as double) is null or try_cast("value" as double) not between min_val and max_val""")
def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, ("a.x", "a.y", "b", "zz"))), (F.col("p_size") % 4 + 1).cast("int"))
    value = F.when(F.col("p_size") % 6 == 0, "high").otherwise((F.col("p_retailprice") / 20).cast("decimal(10,3)").cast("string"))
    return recipes.schema_errors(read(spark, sf_dir, "part").select("p_partkey", path.alias("path"), value.alias("value")), _params(spark), "p_partkey")


@query("select p_partkey, p_name from part where contains(lower(p_name), 're') or contains(lower(p_type), 're')")
def recipe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.search(read(spark, sf_dir, "part"), "RE", "p_name", "p_type").select("p_partkey", "p_name")


@query("""
with m as (select p_partkey, ['mole', 'freckle', 'scar'][p_size % 3 + 1] mark_class, (p_partkey % 10) / 10.0 confidence, p_size % 2 = 0 on_body from part),
k as (select *, case when confidence >= 0.3 then mark_class else 'unknown' end c from m)
select p_partkey, case when on_body and c = 'mole' then 'soften' when c = 'mole' then 'preserve' when c = 'freckle' then 'remove' else 'review' end "action",
  case when on_body and c = 'mole' then 0.4 when c = 'mole' then 1.0 when c = 'freckle' then 0.8 else 0.1 end::double mark_strength from k""")
def mark_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(True, "mole", "soften", 40.0), (False, "mole", "preserve", None), (False, "freckle", "remove", 80.0), (False, "unknown", "review", 10.0)]
    policy = spark.createDataFrame(rules, "on_body boolean, mark_class string, action string, strength double")
    kind = F.element_at(F.array(*map(F.lit, ("mole", "freckle", "scar"))), (F.col("p_size") % 3 + 1).cast("int"))
    marks = read(spark, sf_dir, "part").select("p_partkey", kind.alias("mark_class"), ((F.col("p_partkey") % 10) / 10).alias("confidence"), (F.col("p_size") % 2 == 0).alias("on_body"))
    return recipes.mark_action(marks, policy, 0.3).select("p_partkey", "action", "mark_strength")


# --- corpora and reports ------------------------------------------------------------------------

ASSETS_SQL = """
with a as (select c_custkey asset_id, 'p' || (c_custkey % 997) path, md5((c_custkey % 1200)::varchar) sha256, ['dev', 'calibration', 'locked_test', 'holdout'][(c_custkey % 13) % 4 + 1] split,
  'g' || (c_custkey // 40) group_id, ['u' || (c_custkey // 25), 'u' || (c_custkey // 30)] person_ids, [c_mktsegment, case when c_acctbal > 5000 then 'bright' else 'dark' end] tags from customer)
"""


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    part = lambda c, n: F.concat(F.lit(c), F.floor(key / n).cast("string"))
    return read(spark, sf_dir, "customer").select(
        key.alias("asset_id"), F.concat(F.lit("p"), key % 997).alias("path"), F.md5((key % 1200).cast("string")).alias("sha256"),
        F.element_at(F.array(*map(F.lit, ("dev", "calibration", "locked_test", "holdout"))), (key % 13 % 4 + 1).cast("int")).alias("split"),
        part("g", 40).alias("group_id"), F.array(part("u", 25), part("u", 30)).alias("person_ids"),
        F.array(F.col("c_mktsegment"), F.when(F.col("c_acctbal") > 5000, "bright").otherwise("dark")).alias("tags"),
    )


REQUIRED = [("dev", "bright", 30), ("calibration", "rainy", 1), ("locked_test", "dark", 100_000)]


@query(ASSETS_SQL + f"""
, q as (select 'repeated_asset_id' problem, asset_id::varchar subject, count(*)::varchar detail from a group by asset_id having count(*) > 1
  union all select 'repeated_path', path, count(*)::varchar from a group by path having count(*) > 1
  union all select 'repeated_sha256', sha256, count(*)::varchar from a group by sha256 having count(*) > 1
  union all select 'unknown_split', asset_id::varchar, split from a where split not in ('dev', 'calibration', 'locked_test')
  union all select 'group_in_several_splits', group_id, string_agg(distinct split, ',' order by split) from a group by 2 having count(distinct split) > 1
  union all select 'person_in_several_splits', p, string_agg(distinct split, ',' order by split) from (select split, unnest(person_ids) p from a) group by 2 having count(distinct split) > 1
  union all select 'missing_coverage', r.split || '/' || r.tag, coalesce(s.n, 0) || ' of ' || r.n from (values {", ".join(map(str, REQUIRED))}) r(split, tag, n)
    left join (select split, tag, count(*) n from (select split, unnest(tags) tag from a) group by 1, 2) s on s.split = r.split and s.tag = r.tag where coalesce(s.n, 0) < r.n)
select * from q""")
def manifest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.manifest_errors(_assets(spark, sf_dir), spark.createDataFrame(REQUIRED, "split string, tag string, n long"))


@query(ASSETS_SQL + """
select split, count(*) n_assets, (select count(distinct p) from (select split s, unnest(person_ids) p from a) x where x.s = a.split) n_persons,
  (select string_agg(t || '=' || n, ',' order by t || '=' || n) from (select split s, tag t, count(*) n from (select split, unnest(tags) tag from a) group by 1, 2) y where y.s = a.split) tags from a group by split""")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split_report(_assets(spark, sf_dir))


@query("""
select p_partkey, case when abs(w - h) > 0.03 * greatest(w, h) then 'different_aspect' when c > 12 then 'different_colour' when s < 0.9 then 'different_composition' when m > 0.04 then 'pose_changed' else 'same_pose_and_framing' end reason
from (select p_partkey, 1.5 w, 1.5 + (p_partkey % 5) / 100.0 h, p_size / 4.0 c, 1 - (p_partkey % 17) / 100.0 s, (p_partkey % 7) / 100.0 m from part)""")
def pair_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    why = corpus.pair_reason(F.lit(1.5), 1.5 + (key % 5) / 100, 1 - (key % 17) / 100, F.col("p_size") / 4, (key % 7) / 100, 0.9, 0.04, 12.0)
    return read(spark, sf_dir, "part").select("p_partkey", why.alias("reason"))


COPIES_SQL = "with d as (select doc_id k, sha256(text) g, n_chars % 97 score, doc_id * 10 t from documents where text is not null)"


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("text is not null").select(
        F.col("doc_id").alias("k"), F.sha2("text", 256).alias("g"), (F.col("n_chars") % 97 + 0).alias("score"), (F.col("doc_id") * 10).alias("t")
    )


@query(COPIES_SQL + """
, n as (select g, count(*) n, arg_max(k, (score, -k)) keeper, max(t) - min(t) span, list_sort(list(k)) every from d group by g having count(*) > 1),
e as (select g, min(1 - (k % 10) / 100.0) s, max((k % 7) / 100.0) m from d group by g)
select g, n, keeper, span, round(s, 6) least_similarity, round(m, 6) most_changed, array_to_string(list_filter(every, lambda x: x <> keeper), ',') extras from n join e using (g)""")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _copies(spark, sf_dir)
    pairs = members.select("g", (1 - F.col("k") % 10 / 100).alias("similarity"), (F.col("k") % 7 / 100).alias("changed"))
    found = corpus.duplicate_report(members, pairs, "g", "k", "score", "t")
    return found.select("g", "n", "keeper", "span", r6("least_similarity").alias("least_similarity"), r6("most_changed").alias("most_changed"), F.array_join(F.col("extras").cast("array<string>"), ",").alias("extras"))


@query(COPIES_SQL + "select k, g from d qualify row_number() over (partition by g order by score desc, k) > 1")
def duplicate_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.extras(_copies(spark, sf_dir), "g", "k", "score").select("k", "g")


@query("""
with r as (select c_custkey, c_custkey % 12 n, case when c_custkey % 9 <> 0 then c_acctbal / 10000 end d, (c_custkey % 12) * 0.7 p, c_nationkey % 4 g, 20 c, case when c_custkey % 8 <> 0 then 1 + c_nationkey / 20.0 end t, 1.1 m from customer)
select c_custkey, case when (n = 10 and d < 0.1) or (n > 0 and p / nullif(n, 0) < 0.8 and n > 10) or coalesce(n > 0 and p / nullif(n, 0) < 0.6, false) or g / 20.0 > 0.1 or coalesce(t > 1.9, false) then 'FAIL'
  when n <> 10 or d is null or t is null then 'INCONCLUSIVE' else 'PASS' end verdict
from (select * replace (case when n > 10 then n * 0.9 else p end as p) from r)""")
def experiment_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    n = key % 12
    run = read(spark, sf_dir, "customer").select(
        "c_custkey", n.alias("n"), F.when(key % 9 != 0, F.col("c_acctbal") / 10000).alias("median_delta"), F.when(n > 10, n * 0.9).otherwise(n * 0.7).alias("positive"),
        (F.col("c_nationkey") % 4).alias("regressed"), F.lit(20).alias("checks"), F.when(key % 8 != 0, 1 + F.col("c_nationkey") / 20).alias("time_ratio"), F.lit(1.1).alias("ram_ratio"),
    )
    return corpus.experiment_verdict(run, F.lit(10), 0.1, 0.6, 0.1, 1.9, 2.0).select("c_custkey", "verdict")


@query("""
with t as (select count(*) n from events), c as (select event_type kind, count(*) c from events group by 1)
select kind, round(coalesce(c, 0) / n, 3) actual, target::double target, round(coalesce(c, 0) / n, 3) >= target + 0.05 warned from (values ('view', 0.4), ('click', 0.25), ('error', 0.0), ('idle', 0.1)) p(kind, target) left join c using (kind), t""")
def portfolio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.portfolio(read(spark, sf_dir, "events").select(F.col("event_type").alias("kind")), {"view": 0.4, "click": 0.25, "error": 0.0, "idle": 0.1}, 0.05)


@query("""
with c as (select p_partkey id, [split_part(p_name, ' ', 1), case when p_size % 4 = 0 then 'skin' else 'hair' end] tags from part)
select id from c where list_has_any(tags, ['skin', 'light'])""")
def case_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.substring_index("p_name", " ", 1), F.when(F.col("p_size") % 4 == 0, "skin").otherwise("hair"))
    cases = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tags.alias("tags"))
    changed = spark.createDataFrame([("lib/skin/tone.py",), ("lib/io.py",), ("docs/a.md",)], "path string")
    rules = [("lib/skin/", ["skin", "light"]), ("lib/", ["none"]), ("docs/", ["none"])]
    return corpus.selected_cases(cases, changed, rules, ["face"]).select("id")


@query("""
select p_partkey, p_name || '::' || p_brand item, 'asset-' || substr(sha256(encode(p_name) || '\\x00'::blob || encode(p_brand)), 1, 24) asset from part""")
def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    return rows.select("p_partkey", corpus.review_ids(F.col("p_name"), F.col("p_brand")).alias("item"), corpus.asset_ids(F.col("p_name"), F.col("p_brand")).alias("asset"))


@query("""
with c as (select p_partkey, sha256('{"item_id":"' || p_partkey || '","output":"out","seed":"s1","source":"' || p_name || '"}') h from part)
select p_partkey, 'p2-' || substr(h, 1, 24) || case when substr(h, 64, 1) in ('0', '2', '4', '6', '8', 'a', 'c', 'e') then '-a' else '-b' end left_id,
  'p2-' || substr(h, 1, 24) || case when substr(h, 64, 1) in ('0', '2', '4', '6', '8', 'a', 'c', 'e') then '-b' else '-a' end right_id from c""")
def blinded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = corpus.blinded(F.col("p_partkey"), F.col("p_name"), F.lit("out"), "s1")
    return read(spark, sf_dir, "part").select("p_partkey", left.alias("left_id"), right.alias("right_id"))


# --- task graphs --------------------------------------------------------------------------------

#: Tasks need others: most point down, some form cycles, some point nowhere.
EDGES_SQL = """
with n as (select c_custkey id from customer),
e as (select id, case when id % 10 = 3 then id + 4 when id % 10 = 7 then id - 4 when id % 10 = 9 then id else id // 2 end needs from n where id % 10 <> 5 union all select id, id * 1000000 from n where id % 40 = 1)
"""


def _tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    key, last = F.col("id"), F.col("id") % 10
    needs = F.when(last == 3, key + 4).when(last == 7, key - 4).when(last == 9, key).otherwise(F.floor(key / 2).cast("long"))
    return nodes, nodes.where(last != 5).select("id", needs.alias("needs")).unionByName(nodes.where("id % 40 = 1").select("id", (key * 1_000_000).alias("needs")))


CYCLE_SQL = EDGES_SQL.replace("with n", "with recursive n", 1) + """
, k as (select e.id, e.needs from e join n on n.id = e.needs), r as (select id, needs, 1 d from k union select r.id, k.needs, d + 1 from r join k on k.id = r.needs where d < 24), y as (select distinct id from r where id = needs)
"""


@query(CYCLE_SQL + "select id node from y")
def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _tasks(spark, sf_dir)
    return graph.cycle_nodes(edges.join(nodes.withColumnRenamed("id", "needs").hint("merge"), "needs", "left_semi"), "id", "needs")


@query(CYCLE_SQL + "select id node, 'missing_dependency' problem, needs::varchar detail from e where needs not in (select id from n) union all select id, 'cycle', null from y")
def graph_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _tasks(spark, sf_dir)
    return graph.graph_problems(nodes, edges, "id", "needs")


QUEUE_SQL = """
with t as (select event_id id, user_id queue, (event_id % 4)::int priority, epoch_us(ts) heartbeat, event_type = 'purchase' live,
  list_distinct(['s' || (event_id % 9), 's' || (event_id % 5)]) subsystems from events),
m as (select *, case when x in ('s0', 's1') then 'EXCLUSIVE' when x in ('s2', 's3', 's4') then 'CAUTION' else 'SHARED' end "mode" from (select id, unnest(subsystems) x, heartbeat from t where live)),
h as (select x subsystem, arg_max(id, ("mode" = 'EXCLUSIVE', "mode" = 'CAUTION', -id)) holder, arg_max("mode", ("mode" = 'EXCLUSIVE', "mode" = 'CAUTION', -id)) "mode" from m
  where heartbeat + 86400000000::bigint * 5 >= (select max(heartbeat) from t) group by 1)
"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    tag = lambda n: F.concat(F.lit("s"), key % n)
    return read(spark, sf_dir, "events").select(
        key.alias("id"), F.col("user_id").alias("queue"), (key % 4).cast("int").alias("priority"), names.micros(F.col("ts")).alias("heartbeat"), (F.col("event_type") == "purchase").alias("live"),
        F.array_distinct(F.array(tag(9), tag(5))).alias("subsystems"),
    )


def _leases(tasks: DataFrame) -> DataFrame:
    mode = F.when(F.col("subsystem").isin("s0", "s1"), "EXCLUSIVE").when(F.col("subsystem").isin("s2", "s3", "s4"), "CAUTION").otherwise("SHARED")
    now = tasks.agg(F.max("heartbeat").alias("now")).first()["now"] or 0
    return graph.leases(tasks.where("live"), mode, F.lit(now), 120)


@query(QUEUE_SQL + "select * from h")
def active_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leases(_queue(spark, sf_dir))


@query(QUEUE_SQL + "select a.id, h.* from (select id, unnest(subsystems) subsystem from t) a join h using (subsystem) where holder <> a.id and \"mode\" <> 'SHARED'")
def lease_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _queue(spark, sf_dir)
    return graph.lease_conflicts(tasks, _leases(tasks))


@query(QUEUE_SQL + "select x subsystem, count(*) n from m group by 1")
def subsystem_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pressure(_queue(spark, sf_dir).where("live"))


@query(QUEUE_SQL.replace("with t", "with recursive t", 1) + """
, n as (select queue, id, list_filter(subsystems, lambda x: x in ('s0', 's1', 's2', 's3')) ex, row_number() over (partition by queue order by priority, id) i from t),
w as (select queue, id, i, 'batch' decision, 1 c, ex taken from n where i = 1
  union all select queue, id, i, decision, c + (decision = 'batch')::int, case when decision = 'batch' then list_distinct(list_concat(taken, ex)) else taken end from (
    select n.queue, n.id, n.i, w.c, w.taken, n.ex, case when w.c >= 5 then 'batch full' when list_has_any(w.taken, n.ex) then 'overlaps' else 'batch' end decision from w join n on n.queue = w.queue and n.i = w.i + 1))
select queue, id, decision from w""")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    exclusive = F.filter("subsystems", lambda x: x.isin("s0", "s1", "s2", "s3"))
    return graph.batch_plan(_queue(spark, sf_dir).select("queue", "id", "priority", exclusive.alias("exclusive")), "queue", 5)


@query(QUEUE_SQL.replace("with t", "with recursive t", 1) + """
, y as (select id, queue, priority, list_filter(subsystems, lambda x: x in ('s0', 's1')) ex, id % 3 = 0 chore, live, id % 11 = 0 running from t),
b as (select queue, list_distinct(flatten(list(ex))) held from y where live and running group by 1),
n as (select y.*, coalesce(held, []) held, row_number() over (partition by queue order by priority, id) i from y left join b using (queue) where not live),
w as (select queue, null::bigint id, 0::bigint i, null::varchar decision, 0 c, 0 k, []::varchar[] taken from (select distinct queue from n)
  union all select queue, id, i, decision, c + (decision = 'batch')::int, k + (decision = 'batch' and chore)::int, case when decision = 'batch' then list_distinct(list_concat(taken, ex)) else taken end from (
    select n.queue, n.id, n.i, n.ex, n.chore, w.c, w.k, w.taken, case when w.c >= 4 then 'batch full' when list_has_any(w.taken, n.ex) or list_has_any(n.held, n.ex) then 'overlaps'
      when n.chore and w.k >= 1 and w.c >= 3 then 'reserved' else 'batch' end decision from w join n on n.queue = w.queue and n.i = w.i + 1))
select queue, id, decision from w where i > 0""")
def batch_plan_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    exclusive = F.filter("subsystems", lambda x: x.isin("s0", "s1")).alias("exclusive")
    rows = _queue(spark, sf_dir).select("queue", "id", "priority", exclusive, (F.col("id") % 3 == 0).alias("housekeeping"), "live")
    return graph.batch_plan(rows.where("not live"), "queue", 4, active=rows.where("live and id % 11 = 0").select("queue", "exclusive"))


@query("""
with t as (select p_partkey id, list_distinct(string_split(lower(p_name), ' ')) k, p_size % 2 = 0 live from part), c as (select p_partkey candidate, list_distinct(string_split(lower(p_name), ' ')) o from part where p_partkey <= 40),
m as (select candidate, list_intersect(k, o) h, least(len(k), len(o)) s from t, c where live and list_has_any(k, o)),
f as (select candidate, count(*) n, max(round(len(h) / greatest(1, s), 2)) best from m where len(h) >= 2 or len(list_filter(h, lambda w: length(w) >= 8)) > 0 group by 1)
select candidate, case when best >= 0.8 then 'DUPLICATE' when n > 0 then 'POSSIBLE_OVERLAP' else 'UNIQUE' end verdict, coalesce(n, 0) n_matches from c left join f using (candidate)""")
def title_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_distinct(F.split(F.lower("p_name"), " ")).alias("tokens"), (F.col("p_size") % 2 == 0).alias("live"))
    return graph.overlap_verdicts(tasks.where("id <= 40").select(F.col("id").alias("candidate"), "tokens"), tasks)


# --- faces and frames ---------------------------------------------------------------------------

FACES_SQL = """with f as (select l_orderkey img, l_linenumber k, (min(l_partkey) % 300)::double x, (min(l_suppkey) % 200)::double y, max(l_quantity) * 4 w, (l_linenumber - 1) * 30.0 h
  from lineitem group by l_orderkey, l_linenumber)"""


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("img"), F.col("l_linenumber").alias("k"))
    return each.agg(
        (F.min("l_partkey") % 300).cast("double").alias("x"), (F.min("l_suppkey") % 200).cast("double").alias("y"), (F.max("l_quantity") * 4).alias("w")
    ).withColumn("h", (F.col("k") - 1) * 30.0)


@query(FACES_SQL + "select img, k from f where w > 0 and h > 0 qualify w * h >= 0.35 * max(w * h) over (partition by img)")
def subject_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.subject_faces(_faces(spark, sf_dir), "img", "w", "h").select("img", "k")


@query(FACES_SQL + """
select img, round(sum(greatest(least(x + w, 50 + 150) - greatest(x, 50), 0) * greatest(least(y + h, 20 + 180) - greatest(y, 20), 0)) / nullif(sum(w * h), 0), 6) kept from f group by img""")
def crop_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = {"cx": 50.0, "cy": 20.0, "cw": 150.0, "ch": 180.0}
    rows = _faces(spark, sf_dir).withColumns({k: F.lit(v) for k, v in crop.items()})
    return faces.kept_share(rows, "img", ("x", "y", "w", "h"), tuple(crop)).withColumn("kept", r6("kept"))


@query(FACES_SQL.replace("with f", "with recursive f", 1) + """
, l as (select *, row_number() over (partition by img order by k) i from f), r as (select img, list({'k': k, 'x': x + 9, 'y': y + 4, 'w': w * 0.9, 'h': h} order by k) e from f where k % 3 <> 0 group by img),
b as (select l.*, coalesce(r.e, []) e from l left join r using (img)),
s as (select img, i, k, list_transform(e, lambda q: {'q': q, 's': coalesce(greatest(least(x + w, q.x + q.w) - greatest(x, q.x), 0) * greatest(least(y + h, q.y + q.h) - greatest(y, q.y), 0)
  / nullif(w * h + q.w * q.h - greatest(least(x + w, q.x + q.w) - greatest(x, q.x), 0) * greatest(least(y + h, q.y + q.h) - greatest(y, q.y), 0), 0), 0)}) c from b),
w as (select img, 0 i, null::int "left", null::int "right", []::int[] used from b group by img
  union all select img, i, k, hit, case when hit is null then used else list_append(used, hit) end from (
    select s.img, s.i, s.k, w.used, list_last(list_sort(list_transform(list_filter(s.c, lambda z: z.s >= 0.3 and not list_contains(w.used, z.q.k)), lambda z: {'s': z.s, 'k': z.q.k}))).k hit from w join s on s.img = w.img and s.i = w.i + 1))
select img, "left", "right" from w where i > 0""")
def face_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _faces(spark, sf_dir)
    right = left.where("k % 3 != 0").select("img", "k", (F.col("x") + 9).alias("x"), (F.col("y") + 4).alias("y"), (F.col("w") * 0.9).alias("w"), "h")
    return faces.matched_faces(left, right, "img", ("x", "y", "w", "h"), "k")


@query(FACES_SQL + "select img, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h from f group by img")
def window_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.window_union(_faces(spark, sf_dir), ["img"], ("x", "y", "w", "h"))


@query("select event_id, case when count(value) over w >= 2 then round(max(value) over w, 6) end baseline from events window w as (partition by user_id, event_type)")
def track_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", r6(faces.track_baseline(None, ["user_id", "event_type"], "value")).alias("baseline"))


@query("""
select l_orderkey img, round(case when count(*) filter (l_discount > 0.02) <= 2 then avg(l_quantity) else avg(l_quantity) filter (l_discount > 0.02) end, 6) mean_s,
  round(case when count(*) filter (l_discount > 0.02) <= 2 then avg(l_tax) else avg(l_tax) filter (l_discount > 0.02) end, 6) mean_v from lineitem group by 1""")
def hsv_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("img"), "l_quantity", "l_tax", (F.col("l_discount") * 5).alias("m"))
    found = faces.hsv_means(pixels, "img", "l_quantity", "l_tax", "m", 2)
    return found.select("img", r6("mean_s").alias("mean_s"), r6("mean_v").alias("mean_v"))


@query("""
select c_mktsegment board, round(sum(greatest(c_acctbal, 0) * c_nationkey) / nullif(sum(greatest(c_acctbal, 0)), 0), 6) a,
  round(sum(greatest(c_acctbal, 0) * b) / nullif(sum(greatest(c_acctbal, 0)) filter (b is not null), 0), 6) b from (select *, case when c_custkey % 4 <> 0 then c_custkey % 10 end b from customer) group by 1""")
def look_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    looks = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("board"), "c_acctbal", F.col("c_nationkey").alias("a"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 10).alias("b"))
    found = faces.look_board(looks, "board", "c_acctbal", ["a", "b"])
    return found.select("board", r6("a").alias("a"), r6("b").alias("b"))


@query("""
select l_orderkey, l_linenumber, greatest(d, t) either, round(d * t, 6) "both", round(d * (1 - t), 6) first_only from (select *, l_discount * 10 d, l_tax * 12.5 t from lineitem)""")
def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = [F.col("l_discount") * 10, F.col("l_tax") * 12.5]
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", faces.combined_mask(pair, "union").alias("either"), r6(faces.combined_mask(pair, "intersection")).alias("both"),
        r6(faces.combined_mask(pair, "difference")).alias("first_only"),
    )


@query("""
with f as (select l_orderkey clip, l_linenumber n, max(l_quantity) a, case when l_linenumber % 4 <> 0 then max(l_quantity) + max(l_discount) * 50 end b from lineitem where l_partkey % 5 <> 0 group by 1, 2),
s as (select *, abs(b - a) c, case when n - lag(n) over w = 1 then abs(b - lag(b) over w) end mb, case when n - lag(n) over w = 1 then abs(a - lag(a) over w) end ma from f window w as (partition by clip order by n))
select clip, count(*) n, round(count(b) / count(*), 6) coverage, round(avg(c), 6) mean_change, round(quantile_cont(c, 0.95), 6) p95_change, round(avg(mb) - avg(ma), 6) added_flicker from s group by 1""")
def temporal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "lineitem").where("l_partkey % 5 != 0").groupBy(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("frame"))
    rendered = F.when(F.col("frame") % 4 != 0, F.max("l_quantity") + F.max("l_discount") * 50)
    found = faces.temporal_report(each.agg(F.max("l_quantity").alias("a"), rendered.alias("b")), ["clip"], "frame", "a", "b")
    return found.select("clip", "n", *[r6(c).alias(c) for c in ("coverage", "mean_change", "p95_change", "added_flicker")])


# --- names and joins ----------------------------------------------------------------------------


@query("""
select page_id, regexp_replace('at /home/u/' || split_part(url, '/', 4) || '/x.jpg in ' || split_part(url, '/', 3), '/home/u/[^ ]*', '<redacted-path>') shown from pages""")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: F.coalesce(F.try_element_at(F.split("url", "/"), F.lit(n)), F.lit(""))
    text = F.concat(F.lit("at /home/u/"), part(4), F.lit("/x.jpg in "), part(3))
    return read(spark, sf_dir, "pages").select("page_id", names.redacted(text).alias("shown"))


@query("""
with v as (select p_partkey, (p_size % 3) a, (p_partkey % 5) b, (p_partkey % 4) c from part)
select p_partkey, (a, b, c) >= (1, 2, 0) and (a, b, c) < (2, 3, 0) "within", a = 1 and b = 3 starred, a = 1 and (a, b, c) >= (1, 2, 0) and b = 2 compatible from v""")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (F.col("p_partkey") % 5).cast("string"), (F.col("p_partkey") % 4).cast("string"))
    return read(spark, sf_dir, "part").select(
        "p_partkey", names.version_satisfies(version, ">=1.2,<2.3").alias("within"), names.version_satisfies(version, "==1.3.*").alias("starred"),
        names.version_satisfies(version, "~=1.2.0").alias("compatible"),
    )


@query("""
with s as (select *, sum(case when g is null or g > 86400000000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) n from (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) g from events))
select user_id, lpad(n::bigint::varchar, 3, '0') || '_' || strftime(min(ts), '%Y%m%d_%H%M') set_name, count(*) n from s group by user_id, s.n""")
def set_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import sessions

    cut = sessions.gap_sets(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 86400)
    found = cut.groupBy("user_id", "set_no").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"))
    return found.select("user_id", names.set_name(F.col("set_no"), F.col("start")).alias("set_name"), "n")


@query("""
with s as (select event_id, user_id, epoch_us(ts) a, epoch_us(ts) + 86400000000 b from events where event_type = 'purchase')
select s.event_id span, e.event_id inside from s join events e on e.user_id = s.user_id and epoch_us(e.ts) > s.a and epoch_us(e.ts) <= s.b""")
def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("us", names.micros(F.col("ts")))
    day = 86_400_000_000
    spans = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span"), (F.col("us") + 1).alias("low"), (F.col("us") + day).alias("high"))
    return planning.in_range(spans, rows.select("user_id", F.col("event_id").alias("inside"), "us"), ["user_id"], "low", "high", "us", day).select("span", "inside")
