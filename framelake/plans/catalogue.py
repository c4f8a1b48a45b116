"""The query catalogue: operators of this package on the driver's tables.

The tables are no photo shoots, so each query uses an operator on columns of the same shape: ``events`` are captures
of a user's camera, ``documents`` are files, ``part`` and ``lineitem`` are measured frames. Doubles are rounded, since
engines add up in different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, names
from ..operators import planning, ranking, review, robust, sessions, similarity, temporal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Microseconds of a timestamp in DuckDB.
US = "epoch_us(ts)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(c, digits: int = 6):
    return F.round(c, digits)


# --- sessions -----------------------------------------------------------------------------------

BURST_SQL = """
with o as (select *, epoch_us(ts) us,
    (epoch_us(ts) - lag(epoch_us(ts)) over w) / 1e6 g, lag(event_type) over w pt
  from events window w as (partition by user_id order by ts, event_id)),
f as (select *, case when g <= 21600 and pt = event_type then 0 else 1 end s from o),
n as (select *, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding) burst_no from f),
c as (select *, count(*) over (partition by user_id, burst_no) burst_size,
    (us - lag(us) over (partition by user_id, burst_no order by ts, event_id)) / 1e6 gap from n),
b as (select * from c where burst_size > 1)
"""


def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.bursts(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 6 * 3600, ["event_type"])


@query(BURST_SQL + """
select user_id, burst_no::bigint burst_no, count(*) n, round(max(gap), 6) max_gap,
  round(greatest(least(0.45 * (1 - max(gap) / 21600) + 0.35 + 0.20, 1.0), 0.0), 6) confidence
from b group by user_id, burst_no""")
def burst_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.burst_summary(_bursts(spark, sf_dir), ["user_id"], 6 * 3600)
    return found.select("user_id", "burst_no", "n", r6("max_gap").alias("max_gap"), r6("confidence").alias("confidence"))


@query(BURST_SQL + """
, m as (select *, min(value) over (partition by user_id, burst_no) lo, max(value) over (partition by user_id, burst_no) hi from b),
s as (select *, case when hi <= lo then 1.0 else (value - lo) / (hi - lo) end v from m),
q as (select user_id, burst_no, event_id, greatest(least(0.50 * v + 0.25 * 0.5 + 0.15 * 1.0 + 0.10 * v, 1.0), 0.0) score from s)
select user_id, burst_no::bigint burst_no, event_id, round(score, 6) score,
  row_number() over (partition by user_id, burst_no order by score desc, event_id) "rank" from q""")
def burst_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bursts(spark, sf_dir).withColumns({"exposure": F.lit(0.5), "clipping": F.lit(1.0)})
    scored = ranking.burst_scores(rows, ["user_id", "burst_no"], "value", "exposure", "clipping", "value")
    return ranking.rank_in_group(scored, ["user_id", "burst_no"], "score", "event_id").select("user_id", "burst_no", "event_id", r6("score").alias("score"), "rank")


@query("""
with o as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) g from events),
n as (select *, sum(case when g is null or g > 86400000000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) set_no from o)
select user_id, set_no::bigint set_no, count(*) n, min(epoch_us(ts)) start_us, max(epoch_us(ts)) end_us from n group by 1, 2""")
def gap_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sessions.gap_sets(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 86400)
    us = names.micros(F.col("ts"))
    return cut.groupBy("user_id", "set_no").agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("start_us"), F.max(us).alias("end_us"))


def _calendar(unit: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cut = sessions.calendar_sets(read(spark, sf_dir, "events"), "ts", unit)
        return cut.groupBy("user_id", "set_start").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 4).alias("total"))

    return run


for _unit, _width in (("hour", 3_600_000_000), ("day", 86_400_000_000)):
    QUERIES[f"{_unit}_sets"] = _calendar(_unit)
    SQL[f"{_unit}_sets"] = (
        f"select user_id, (epoch_us(ts) // {_width}::bigint) * {_width}::bigint set_start, count(*) n, round(sum(value), 4) total from events group by 1, 2"
    )


# --- names and files ----------------------------------------------------------------------------


@query("""
select doc_id, (case when n_chars > 2000 then 'Portrait' else 'Scenic' end) || ' (' || (case when length(text) < 900 then 'Dark' else 'Bright' end)
  || '/' || (case when lang = 'en' then 'Colorful' else 'Muted' end) || ')' label from documents""")
def classify_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(
        F.when(F.col("n_chars") > 2000, "Portrait").otherwise("Scenic"), F.lit(" ("), F.when(F.length("text") < 900, "Dark").otherwise("Bright"),
        F.lit("/"), F.when(F.col("lang") == "en", "Colorful").otherwise("Muted"), F.lit(")"),
    )
    return read(spark, sf_dir, "documents").select("doc_id", label.alias("label"))


@query("""
with s as (select doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) stem from documents)
select min(doc_id) first_id, max(doc_id) last_id, count(*) n, sha256(stem) stem_hash from s group by stem having count(*) > 1""")
def stem_pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = read(spark, sf_dir, "documents").select("doc_id", F.sha2(names.folded_text(F.col("text")), 256).alias("stem_hash"))
    pairs = stems.groupBy("stem_hash").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    return pairs.where("n > 1").select("first_id", "last_id", "n", "stem_hash")


@query("select sha256(text) content_hash, count(*) n, min(doc_id) keeper from documents group by 1 having count(*) > 1")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper")).where("n > 1")


@query("""
with d as (select page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1)) destination from pages)
select destination, count(*) n, min(page_id) first_source from d group by 1 having count(*) > 1""")
def dest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]*)/?$", 1)
    return planning.conflicts(read(spark, sf_dir, "pages"), "page_id", tail)


@query("""
with f as (select p_partkey, lower(split_part(p_name, ' ', 1)) stem, case when p_size % 2 = 0 then 'raf' else 'jpg' end ext from part),
a as (select *, stem || '.jpeg' base, count(*) over (partition by stem || '.jpeg') n1 from f),
b as (select *, case when n1 = 1 then base else stem || '_' || ext || '.jpeg' end o from a),
c as (select *, count(*) over (partition by o) n2 from b)
select p_partkey, case when n2 = 1 then o else stem || '_' || ext || '_' || substr(sha256(p_partkey::varchar), 1, 8) || '.jpeg' end output from c""")
def output_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_partkey").cast("string").alias("path"), F.lower(F.substring_index("p_name", " ", 1)).alias("stem"),
        F.when(F.col("p_size") % 2 == 0, "raf").otherwise("jpg").alias("ext"),
    )
    return planning.output_plan(files, "path", "stem", "ext", F.lit("jpeg")).select("p_partkey", "output")


@query("""
with p as (select p_partkey, lower(split_part(p_name, ' ', 1)) stem, p_size % 2 = 0 is_raw from part),
w as (select *, bool_or(is_raw) over (partition by stem) and bool_or(not is_raw) over (partition by stem) paired from p)
select p_partkey, paired, case when paired and not is_raw then 'excluded' else 'selected' end status from w""")
def raw_pair_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "part").select("p_partkey", F.lit("").alias("folder"), F.substring_index("p_name", " ", 1).alias("stem"), "p_size")
    return planning.pair_policy(files, "folder", "stem", F.col("p_size") % 2 == 0, "raw-only").select("p_partkey", "paired", "status")


# --- robust statistics --------------------------------------------------------------------------


@query("""
with r as (select l_returnflag, l_extendedprice v, row_number() over (partition by l_returnflag order by l_extendedprice, l_orderkey * 10 + l_linenumber) i,
  count(*) over (partition by l_returnflag) n from lineitem),
k as (select *, case when n < 5 then 0 else greatest(1, floor(n * 0.1)) end c from r)
select l_returnflag, round(avg(v), 4) trimmed_mean, count(*) n_kept, max(n) n from k where i > c and i <= n - c group by 1""")
def trimmed_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robust.trimmed_mean(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return found.withColumn("trimmed_mean", r6("trimmed_mean", 4)).withColumn("n_kept", F.col("n_kept").cast("long"))


@query("""
with e as (select l_returnflag, quantile_cont(l_extendedprice, 0.05) lo, quantile_cont(l_extendedprice, 0.95) hi from lineitem group by 1)
select l_returnflag, round(avg(l_quantity), 6) band_mean, count(*) n_in_band from lineitem join e using (l_returnflag)
where l_extendedprice between lo and hi group by 1""")
def percentile_band_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robust.band_mean(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", 0.05, 0.95)
    return found.withColumn("band_mean", r6("band_mean"))


PERCENTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)


@query("select l_linestatus, " + ", ".join(f"round(quantile_cont(l_quantity, {p}), 6) p{round(p * 100):02d}" for p in PERCENTILES) + " from lineitem group by 1")
def l_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robust.percentiles(read(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity", PERCENTILES)
    return found.select("l_linestatus", *[r6(c).alias(c) for c in found.columns if c != "l_linestatus"])


@query("""
with m as (select l_shipmode_, median(l_extendedprice) med from (select l_returnflag || l_linestatus l_shipmode_, l_extendedprice from lineitem) group by 1),
o as (select l_returnflag || l_linestatus g, abs(l_extendedprice - med) d, med from lineitem join m on l_shipmode_ = l_returnflag || l_linestatus)
select g, round(med, 6) "median", round(greatest(1.4826 * median(d), 1.0), 6) spread from o group by g, med""")
def mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("g"), "l_extendedprice")
    return robust.spread(lines, ["g"], "l_extendedprice", 1.0).select("g", r6("median").alias("median"), r6("spread").alias("spread"))


@query("""
with b as (select p_brand, least(greatest(floor(p_size / 51.0 * 4), 0), 3)::int light, least(greatest(floor((p_retailprice - 900) / 1200 * 10), 0), 9)::int a from part),
c as (select p_brand, light, a, count(*) n from b group by 1, 2, 3), t as (select *, sum(n) over (partition by p_brand) tot from c)
select p_brand, light, a, n, round(n / tot, 6) share from t where tot >= 10""")
def hist_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = {"light": (F.col("p_size") / 51.0, 4), "a": ((F.col("p_retailprice") - 900) / 1200, 10)}
    return robust.joint_histogram(read(spark, sf_dir, "part"), ["p_brand"], bins, 10).withColumn("share", r6("share"))


@query("""
select l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) mean,
  round(sqrt(greatest(sum(l_quantity * l_extendedprice * l_extendedprice) / sum(l_quantity) - power(sum(l_quantity * l_extendedprice) / sum(l_quantity), 2), 0)), 2) std
from lineitem group by 1""")
def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robust.weighted_moments(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return found.select("l_returnflag", r6("mean", 4).alias("mean"), r6("std", 2).alias("std"))


# --- similarity ---------------------------------------------------------------------------------


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings)
select q.vec_id query, r.vec_id "match", round(list_cosine_similarity(q.e, r.e), 6) cosine from v q join v r on q.vec_id <> r.vec_id
where q.vec_id % 20 = 0 and list_cosine_similarity(q.e, r.e) >= 0.30""")
def cosine_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return similarity.cosine_search(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", 0.30).withColumn("cosine", r6("cosine"))


@query("""
with l as (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings),
m as (select label, i, avg(abs(x)) x from l group by 1, 2), s as (select label, i, x / sum(x) over (partition by label) x from m),
u as (select i, avg(abs(x)) x from l group by 1), t as (select i, x / sum(x) over () x from u)
select label, round(sqrt(greatest(1 - sum(sqrt(s.x * t.x)), 0)), 6) distance from s join t using (i) group by 1""")
def hellinger_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    own = similarity.mean_histogram(rows, ["label"], "embedding").withColumn("one", F.lit(1))
    every = similarity.mean_histogram(rows.withColumn("one", F.lit(1)), ["one"], "embedding").withColumnRenamed("histogram", "mean")
    return own.join(F.broadcast(every), "one").select("label", r6(similarity.hellinger(F.col("histogram"), F.col("mean"))).alias("distance"))


JACCARD_SQL = """
with s as (select doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) t from documents),
c as (select *, min(doc_id) over (partition by t) class_id from s), h as (select distinct class_id, t from c)
"""


@query(JACCARD_SQL + """
, x as (select class_id, len(t) n, unnest(t) w from h),
p as (select a.class_id l, b.class_id r, a.n an, b.n bn, count(*) k from x a join x b on a.w = b.w and a.class_id < b.class_id
  and a.n >= 0.75 * b.n and b.n >= 0.75 * a.n group by 1, 2, 3, 4)
select l left_id, r right_id, round(k / (an + bn - k), 6) jaccard from p where k / (an + bn - k) >= 0.75""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sets = similarity.token_classes(read(spark, sf_dir, "documents"), "doc_id", names.token_set(F.col("text")))
    return similarity.jaccard_join(sets, 0.75).withColumn("jaccard", r6("jaccard"))


@query(JACCARD_SQL + "select doc_id, class_id from c")
def jaccard_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.token_classes(read(spark, sf_dir, "documents"), "doc_id", names.token_set(F.col("text")))[0]


# --- plans, splits, state -----------------------------------------------------------------------


@query("""
select o_custkey, count(distinct o_orderstatus) n_splits, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) splits
from orders group by 1 having count(distinct o_orderstatus) > 1""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.leakage(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("select o_orderstatus, o_orderpriority, count(*) n from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())")
def coverage_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.coverage(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("""
with r as (select n_nationkey, s.segment from nation, (select distinct c_mktsegment segment from customer) s),
o as (select distinct c_nationkey, c_mktsegment from customer where c_acctbal > 9000)
select r.n_nationkey, r.segment from r anti join o on o.c_nationkey = r.n_nationkey and o.c_mktsegment = r.segment""")
def missing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    segments = customers.agg(F.collect_set("c_mktsegment").alias("s"))
    nations = read(spark, sf_dir, "nation").select("n_nationkey", F.lit(1).alias("one"))
    required = nations.join(F.broadcast(segments.withColumn("one", F.lit(1))), "one").select("n_nationkey", F.explode("s").alias("segment"))
    seen = customers.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"))
    return planning.missing(required, seen, ["n_nationkey", "segment"])


@query("""
with s as (select c_name, row_number() over (order by sha256('11:' || c_name)) i, count(*) over () n from (select distinct c_name from customer)),
k as (select *, greatest(2, round_even(n * 0.2, 0)) h, greatest(1, round_even(n * 0.2, 0)) v from s)
select c_name, case when n < 6 then 'development' when i > n - h then 'holdout' when i > n - h - v then 'validation' else 'development' end split from k""")
def subject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.subject_split(read(spark, sf_dir, "customer"), "c_name", "11")


RESUME_PLAN = "select o_orderkey k, o_orderstatus a, o_orderpriority b from orders"


@query(f"""
with p as ({RESUME_PLAN}), d as (select o_orderkey k, case when o_totalprice > 200000 then 'X' else o_orderstatus end a, o_orderpriority b from orders where o_orderstatus <> 'P')
select p.k, case when d.k is null then 'run:new' when p.a = d.a and p.b = d.b then 'skip:verified' else 'run:changed' end resume_action from p left join d using (k)""")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    plan = orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    done = orders.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderstatus")).alias("a"), F.col("o_orderpriority").alias("b")
    )
    return planning.resume(plan, done, "k", ["a", "b"]).select("k", "resume_action")


@query("""
with a as (select doc_id, quality::varchar c, case when toxic = 1 then 'reject' else 'keep' end d from labels),
b as (select doc_id, case when n_chars > 1500 then '1' else '0' end c from documents)
select coalesce(b.doc_id, a.doc_id) doc_id,
  case when b.doc_id is null then a.d when a.doc_id is null then 'undecided' when b.c = a.c then a.d else 'hold' end decision,
  case when b.doc_id is null then 'absent' when a.doc_id is null then 'new' when b.c = a.c then 'same' else 'changed' end change
from b full join a on a.doc_id = b.doc_id""")
def upsert_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("c"), F.when(F.col("toxic") == 1, "reject").otherwise("keep").alias("d"))
    seen = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1500, "1").otherwise("0").alias("c"))
    return planning.observe(prior, seen, "doc_id", "c", "d")


STATUSES = ["OPEN", "RESOLVED", "ACCEPTED", "SUPPRESSED", "PLANNED"]


@query("""
with a as (select s_suppkey id, ['OPEN', 'RESOLVED', 'ACCEPTED', 'SUPPRESSED', 'PLANNED'][s_suppkey % 5 + 1] s, s_acctbal m, s_nationkey % 2 = 0 e from supplier),
f as (select c_custkey id, c_acctbal metric from customer)
select coalesce(f.id, a.id) id, case when a.id is null then 'OPEN'
  when f.id is null then case when a.s in ('RESOLVED', 'ACCEPTED', 'SUPPRESSED') then a.s else 'RESOLVED' end
  when a.s = 'RESOLVED' then 'REGRESSED'
  when a.s in ('ACCEPTED', 'SUPPRESSED') and (a.e or coalesce(a.m > 0 and f.metric >= 1.5 * a.m, false)) then 'OPEN' else a.s end status,
  coalesce(f.metric, a.m) metric
from f full join a on a.id = f.id""")
def finding_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    prior = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), status.alias("status"), F.col("s_acctbal").alias("metric"), (F.col("s_nationkey") % 2 == 0).alias("expired"))
    found = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("metric"))
    return planning.reconcile(prior, found)


@query("""
with recursive up as (select n_name nm, n_name cur, 0 l from nation union all select r_name, r_name, 0 from region
  union all select up.nm, p.parent, up.l + 1 from up join (select n_name nm, r_name parent from nation join region on n_regionkey = r_regionkey) p on p.nm = up.cur where up.l < 32),
v as (select r_name nm, 'grade' path, 'r' || r_regionkey val from region union all select r_name, 'tone', 'warm' from region
  union all select n_name, 'grade', 'n' || n_nationkey from nation where n_nationkey % 2 = 0),
j as (select up.nm, v.path, v.val, up.l, row_number() over (partition by up.nm, v.path order by up.l) i from up join v on v.nm = up.cur)
select nm "name", path, val "value", l::int "level" from j where i = 1""")
def recipe_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    parents = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    lit = lambda x: F.lit(x)
    values = (
        region.select(F.col("r_name").alias("name"), lit("grade").alias("path"), F.concat(lit("r"), F.col("r_regionkey")).alias("value"))
        .unionByName(region.select(F.col("r_name").alias("name"), lit("tone").alias("path"), lit("warm").alias("value")))
        .unionByName(nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), lit("grade").alias("path"), F.concat(lit("n"), F.col("n_nationkey")).alias("value")))
    )
    return planning.inherit(values, parents)


@query("""
with l as (select n_nationkey task, n_regionkey * 5 needs from nation)
select task, needs from l where needs not in (select n_nationkey from nation where n_nationkey % 3 = 0)""")
def dependency_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    links = nation.select(F.col("n_nationkey").alias("task"), (F.col("n_regionkey") * 5).alias("needs"))
    return planning.blocked(nation.withColumnRenamed("n_nationkey", "task"), links, "task", "needs", F.col("task") % 3 == 0)


# --- review and triage --------------------------------------------------------------------------


@query("""
with f as (select conv_id item, role reviewer, min(case when length(text) % 2 = 0 then 'pass' else 'fail' end) o, max(case when length(text) > 400 then 1 else 0 end) c
  from conversations group by 1, 2),
g as (select item, count(*) n_reviews, count(distinct o) n_outcomes, max(c)::int critical, min(o) outcome from f group by 1),
h as (select *, case when n_reviews < 2 then 'incomplete' when (n_outcomes > 1 or critical = 1) and n_reviews < 3 then 'needs_third'
  when n_outcomes > 1 or critical = 1 then 'adjudicate' else 'settled' end state from g)
select item, n_reviews, n_outcomes, critical, case when state = 'settled' then outcome end outcome, state from h""")
def review_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("item"), F.col("role").alias("reviewer"), F.when(F.length("text") % 2 == 0, "pass").otherwise("fail").alias("outcome"),
        (F.length("text") > 400).alias("critical"),
    )
    return review.consensus(rows, "item", "reviewer", "outcome", F.col("critical")).select("item", "n_reviews", "n_outcomes", "critical", "outcome", "state")


LIMITS_SQL = "(values " + ", ".join(f"('{c}', {w}, {r}, '{d}')" for c, w, r, d in review.THRESHOLDS) + ") t(\"check\", warn, regress, direction)"


@query(f"""
with m as (select l_orderkey, unnest([{{'c': 'luminance_drift', 'v': l_quantity / 4}}, {{'c': 'edge_preservation', 'v': 1 - l_discount * 4}},
    {{'c': 'shadow_clip_delta', 'v': l_tax * 40}}]) x from lineitem),
k as (select l_orderkey, case when (direction = 'high' and x.v > regress) or (direction = 'low' and x.v < regress) then 2
    when (direction = 'high' and x.v > warn) or (direction = 'low' and x.v < warn) then 1 else 0 end l from m join {LIMITS_SQL} on "check" = x.c)
select l_orderkey, ['PASS', 'REVIEW', 'REGRESSION'][max(l) + 1] verdict, count(*) filter (l > 0) n_findings from k group by 1""")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"luminance_drift": F.col("l_quantity") / 4, "edge_preservation": 1 - F.col("l_discount") * 4, "shadow_clip_delta": F.col("l_tax") * 40}
    long = read(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("value")) for k, v in checks.items()])).alias("x"))
    found = review.findings(long.select("l_orderkey", "x.check", "x.value"), review.thresholds(spark))
    return found.groupBy("l_orderkey").agg(review.worst().alias("verdict"), F.count(F.when(F.col("level") != "PASS", 1)).alias("n_findings"))


@query("""
with a as (select l_orderkey, l_quantity / 4 t, l_extendedprice / 1000 m from lineitem where l_linenumber = 2), b as (select l_orderkey, l_quantity / 4 t, l_extendedprice / 1000 m from lineitem where l_linenumber = 1),
a1 as (select l_orderkey, max(t) t, max(m) m from a group by 1), b1 as (select l_orderkey, max(t) t, max(m) m from b group by 1),
j as (select l_orderkey, b1.t < 2 f, case when b1.t >= 2 then a1.t / greatest(b1.t, 1e-6) end tr, case when b1.t >= 2 then a1.m / greatest(b1.m, 1e-6) end mr from a1 join b1 using (l_orderkey))
select l_orderkey, round(tr, 6) time_ratio, round(mr, 6) ram_ratio, case when f then 'PASS' when tr > 1.75 or mr > 2.0 then 'REGRESSION' when tr > 1.25 or mr > 1.25 then 'REVIEW' else 'PASS' end verdict, f skipped from j""")
def perf_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    side = lambda n: lines.where(F.col("l_linenumber") == n).groupBy("l_orderkey").agg(F.max(F.col("l_quantity") / 4).alias("time_s"), F.max(F.col("l_extendedprice") / 1000).alias("ram_mb"))
    found = review.compare_perf(side(2), side(1), ["l_orderkey"])
    return found.withColumns({"time_ratio": r6("time_ratio"), "ram_ratio": r6("ram_ratio")})


ATTENTION_SQL = """
with s as (select event_id id, user_id desk, event_type kind, case event_type when 'error' then 'error' when 'purchase' then 'warning' when 'signup' then 'critical' when 'view' then 'notice' else 'success' end severity,
  (event_id % 3)::int blocking, (event_id % 4)::int priority, (5 + event_id % 17)::int as "minutes" from events),
l as (select *, case when severity in ('success', 'info') then 'A0' when severity = 'critical' then 'A5' when severity = 'error' and blocking > 0 then 'A4' when severity = 'error' then 'A3'
  when blocking > 0 then 'A3' when severity = 'warning' then 'A2' else 'A1' end level from s)
"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    severity = F.when(kind == "error", "error").when(kind == "purchase", "warning").when(kind == "signup", "critical").when(kind == "view", "notice").otherwise("success")
    rows = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("desk"), kind.alias("kind"), severity.alias("severity"), (F.col("event_id") % 3).cast("int").alias("blocking"),
        (F.col("event_id") % 4).cast("int").alias("priority"), (5 + F.col("event_id") % 17).cast("int").alias("minutes"),
    )
    level = planning.attention_level(F.col("severity"), F.col("blocking"), F.lit(False))
    rows = rows.withColumn("level", level)
    return rows.withColumn("score", planning.attention_score(F.col("level"), F.col("blocking"), F.col("priority")).cast("long"))


@query(ATTENTION_SQL + "select desk, kind, count(*) n, max(level) max_level, sum(\"minutes\")::bigint as \"minutes\" from l group by 1, 2")
def attention_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.batches(_signals(spark, sf_dir), ["desk", "kind"])


@query(ATTENTION_SQL.replace("with s", "with recursive s", 1) + """
, o as (select desk, id, level, (substr(level, 2)::int * 100 + least(blocking, 10) * 20 + (4 - priority) * 5)::bigint score, "minutes" from l),
n as (select *, row_number() over (partition by desk order by score desc, id) i, level in ('A4', 'A5') sure from o),
w as (select *, sure or "minutes" <= 90 selected, case when sure or "minutes" <= 90 then "minutes" else 0 end spent from n where i = 1
  union all select n.*, n.sure or w.spent + n."minutes" <= 90, w.spent + case when n.sure or w.spent + n."minutes" <= 90 then n."minutes" else 0 end from w join n on n.desk = w.desk and n.i = w.i + 1)
select desk, id, level, score, "minutes", selected from w""")
def budget_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.route(_signals(spark, sf_dir), "desk", 90)


# --- ranking ------------------------------------------------------------------------------------


@query("""
with p as (select p_partkey, p_retailprice q, p_size::double s, length(p_name)::double l from part)
select p_partkey from p a where not exists (select 1 from p b where b.q >= a.q and b.s <= a.s and b.l <= a.l and (b.q > a.q or b.s < a.s or b.l < a.l))""")
def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("q"), F.col("p_size").cast("double").alias("s"), F.length("p_name").cast("double").alias("l"))
    return ranking.frontier(rows, ["q"], ["s", "l"], "p_partkey").select("p_partkey")


@query("""
with f as (select *, row_number() over (partition by p_name order by p_partkey) i from part),
s as (select p_name, p_partkey, round(case when p_size = 1 then 0.0 else least(p_retailprice / 2000, 1.0) * (p_size / 50.0) end, 6) q, round((p_retailprice - 1000) / 1000 * 100, 6) pct from f where i = 1)
select p_name, p_partkey, q quality_score, pct runtime_pct, row_number() over (order by q desc, p_name) "rank" from s""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    effect = F.least(F.col("p_retailprice") / 2000, F.lit(1.0))
    rows = read(spark, sf_dir, "part")
    first = ranking.leaderboard(rows, "p_name", ["p_partkey"], F.round(effect * (F.col("p_size") / 50.0), 6), F.lit(1.0), F.col("p_size") == 1, F.col("p_retailprice"), F.lit(1000.0))
    return first.select("p_name", "p_partkey", "quality_score", r6("runtime_pct").alias("runtime_pct"), "rank")


COVER_SQL = """
with c as (select p_partkey, p_name, case when p_size % 7 = 0 then null else p_size / 50.0 end photo, (p_partkey % 11) / 10.0 crop, case when p_size % 5 = 0 then null else 0.5 end costume,
  (p_partkey % 3) / 2.0 colour, case when p_size % 2 = 0 then null else 1.0 end light, case when p_size % 9 = 0 then 0.6 else 1.0 end gate, p_size % 2 = 0 tight from part),
w as (select *, (case when photo is null then 0 else 30 end) + 25 + (case when costume is null then 0 else 20 end) + 15 + (case when light is null then 0 else 10 end) weight from c),
s as (select p_partkey, tight, weight::int checked_weight, round(100.0 * gate * (coalesce(photo, 0) * 30 + crop * 25 + coalesce(costume, 0) * 20 + colour * 15 + coalesce(light, 0) * 10) / weight, 4) score from w)
"""


def _covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    checks = {
        "photo": F.when(size % 7 == 0, None).otherwise(size / 50.0), "crop": (key % 11) / 10.0, "costume": F.when(size % 5 == 0, None).otherwise(0.5),
        "colour": (key % 3) / 2.0, "light": F.when(size % 2 == 0, None).otherwise(1.0),
    }
    score, weight = ranking.cover_score(checks, F.when(size % 9 == 0, 0.6).otherwise(1.0))
    return read(spark, sf_dir, "part").select("p_partkey", (size % 2 == 0).alias("tight"), weight.cast("int").alias("checked_weight"), F.round(score, 4).alias("score"))


@query(COVER_SQL + "select * from s")
def cover_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covers(spark, sf_dir)


@query(COVER_SQL + """
, t as (select * from s order by score desc, p_partkey limit 12), n as (select *, row_number() over (order by score desc, p_partkey) i from t),
x as (select *, coalesce(min(case when i > 1 and tight <> (select tight from n where i = 1) then i end) over (), 2) s2 from n)
select p_partkey, tight, score, case when i = 1 then 'cover' when i = s2 then 'slide_2' else 'slide_3' end slot from x where i = 1 or i = s2 or i = (case when s2 = 2 then 3 else 2 end)""")
def topk_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.suggest(_covers(spark, sf_dir), "score", "p_partkey", "tight").select("p_partkey", "tight", "score", "slot")


@query("""
with p as (select p_partkey, (1000 + p_size * 40)::bigint w, floor(p_retailprice)::bigint h from part),
c as (select *, case when w * 5 >= h * 4 then least(w, round_even(h * 4 / 5, 0)::bigint) else w end cw, case when w * 5 >= h * 4 then h else least(h, round_even(w * 5 / 4, 0)::bigint) end ch from p)
select p_partkey, ((w - cw) // 2)::bigint x, ((h - ch) // 2)::bigint y, cw, ch from c""")
def crop_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = read(spark, sf_dir, "part").select("p_partkey", (1000 + F.col("p_size") * 40).cast("long").alias("w"), F.floor("p_retailprice").cast("long").alias("h"))
    x, y, cw, ch = ranking.crop_plan(F.col("w"), F.col("h"), (4, 5))
    return sized.select("p_partkey", x.alias("x"), y.alias("y"), cw.alias("cw"), ch.alias("ch"))


@query("""
select event_id, case when lag(value, 2) over w is null then 'INSUFFICIENT_DATA' when lag(value, 2) over w < lag(value) over w and lag(value) over w < value then 'WORSENING'
  when lag(value, 2) over w > lag(value) over w and lag(value) over w > value then 'IMPROVING' else 'STABLE' end trend
from events window w as (partition by user_id order by ts, event_id)""")
def trend3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", ranking.trend("value", ["user_id"], ["ts", "event_id"]).alias("trend"))


@query("""
select doc_id, case when n_chars <= 0 then 'unknown' when lang = 'de' then 'pair' when n_chars / 20000.0 < 0.04 then 'wide' when n_chars / 20000.0 < 0.12 then 'full-body'
  when n_chars / 20000.0 < 0.20 then 'three-quarter' when n_chars / 20000.0 < 0.33 then 'half-body' else 'close-up' end framing from documents""")
def framing_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = F.when(F.col("n_chars") <= 0, 0).when(F.col("lang") == "de", 2).otherwise(1)
    return read(spark, sf_dir, "documents").select("doc_id", ranking.framing(F.col("n_chars") / 20000.0, faces).alias("framing"))


# --- time ---------------------------------------------------------------------------------------


@query("""
select user_id, round(coalesce(sum(value) filter (event_type <> 'purchase'), 0) * sum(event_id % 50) filter (event_type = 'purchase')
  / nullif(sum(value) filter (event_type = 'purchase') * 2, 0), 4) eta_seconds, round(coalesce(sum(value) filter (event_type <> 'purchase'), 0), 4) left_mp from events group by 1""")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("seconds", F.col("event_id") % 50)
    found = temporal.eta(rows, ["user_id"], F.col("event_type") == "purchase", "value", "seconds", 2)
    return found.select("user_id", r6("eta_seconds", 4).alias("eta_seconds"), r6("left_mp", 4).alias("left_mp"))


@query("""
with n as (select max(epoch_us(ts)) now from events), l as (select user_id, max(epoch_us(ts)) last_us from events group by 1)
select user_id, last_us, round((now - last_us) / 1e6, 6) idle_seconds from l, n where (now - last_us) / 1e6 > 43200""")
def stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    now = rows.agg(F.max(names.micros(F.col("ts"))).alias("now")).first()["now"] or 0
    return temporal.stalled(rows, ["user_id"], "ts", F.lit(now), 43200).withColumn("idle_seconds", r6("idle_seconds"))


@query("select user_id, arg_max(event_type, (ts, event_id)) event_type, round(arg_max(value, (ts, event_id)), 6) \"value\", count(*) n_events from events group by 1")
def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.latest(read(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], ["event_type", "value"])
    return found.withColumn("value", r6("value"))


@query("""
with m as (select event_id, user_id, ts, case when value > 60 then true when value < 20 then false end m from events)
select event_id, coalesce(last_value(m ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), false) state from m""")
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", temporal.hysteresis(F.col("value"), 60, 20, ["user_id"], ["ts", "event_id"]).alias("state"))


@query("""
with l as (select event_id, value, (select quantile_cont(b.value, 0.5) from events b where b.user_id = a.user_id and epoch_us(b.ts) between epoch_us(a.ts) - 432000000000 and epoch_us(a.ts) - 1) lv from events a)
select event_id, round(value, 6) "value", round(lv, 6) "level" from l where lv is not null and value >= 8 and value >= 4 * greatest(lv, 1e-6)""")
def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.cuts(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "value", 5 * 86400)
    return found.select("event_id", r6("value").alias("value"), r6("level").alias("level"))


@query("""
with d as (select user_id, abs(value - lag(value) over (partition by user_id order by ts, event_id)) d from events)
select user_id, round(avg(d), 6) mean_change, round(quantile_cont(d, 0.95), 6) p95_change, count(*) n from d where d is not null group by 1""")
def flicker(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.flicker(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return found.withColumns({"mean_change": r6("mean_change"), "p95_change": r6("p95_change")})


@query("""
with d as (select user_id, abs(lead(value) over w - 2 * value + lag(value) over w) j from events window w as (partition by user_id order by ts, event_id))
select user_id, round(avg(j), 6) jitter, count(*) n from d where j is not null group by 1""")
def landmark_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.jitter(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").withColumn("jitter", r6("jitter"))


@query("""
with m as (select event_id, user_id, epoch_us(ts) / 1e6 s, case when value > 90 then epoch_us(ts) / 1e6 end k from events),
g as (select event_id, least(s - last_value(k ignore nulls) over (partition by user_id order by s rows unbounded preceding),
  first_value(k ignore nulls) over (partition by user_id order by s rows between current row and unbounded following) - s) g from m)
select event_id, round(coalesce(least(greatest(1 - (g - 3600) / 86400, 0.0), 1.0), 0.0), 6) weight from g""")
def cover_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    weight = temporal.ramp(rows, ["user_id"], names.micros(F.col("ts")) / 1e6, F.col("value") > 90, 3600, 86400)
    return rows.select("event_id", r6(weight).alias("weight"))


@query("""
with d as (select user_id, epoch_us(ts) // 86400000000::bigint dy, round(sum(value), 4) demand from events group by 1, 2),
s as (select *, count(*) filter (demand > 60) over (partition by user_id order by dy range between 2 preceding and current row) n from d)
select user_id, dy "day", demand from s where n = 3""")
def overload(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(names.micros(F.col("ts")) / 86_400_000_000).cast("long")
    daily = read(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg(r6(F.sum("value"), 4).alias("demand"))
    return temporal.overload(daily, ["user_id"], "day", "demand", 60.0)


def _euro_sql(order: str, out: str, v: str) -> str:
    """One pass of the filter over the numbered series ``n``; ``order``: the number that counts the pass."""
    turned = lambda dt, cut: f"({dt} * ({cut}) * {2 * math.pi!r})"
    low = lambda dt, cut: f"({turned(dt, cut)} / ({turned(dt, cut)} + 1))"
    dt = "greatest(abs(n.t - w.t), 1e-6)"
    return f"""{out} as (select user_id, event_id, {order} i, t, v, v y, 0.0::double speed from n where {order} = 1
  union all select user_id, event_id, i, t, v, y + {low("dt", "1e-5 + 1e-4 * abs(sp)")} * (v - y), sp from (
    select n.user_id, n.event_id, n.{order} i, n.t, n.v, w.y, {dt} dt, w.speed + {low(dt, "1e-5")} * ((n.v - w.y) / {dt} - w.speed) sp from {out} w join n on n.user_id = w.user_id and n.{order} = w.i + 1))"""


@query("""
with recursive n as (select user_id, event_id, epoch_us(ts) / 1e6 t, value v, row_number() over (partition by user_id order by ts, event_id) a, row_number() over (partition by user_id order by ts desc, event_id desc) z from events),
""" + _euro_sql("a", "fw", "v") + ",\n" + _euro_sql("z", "bw", "v") + """
select user_id, event_id, round((fw.y + bw.y) / 2, 6) smooth from fw join bw using (user_id, event_id)""")
def one_euro(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.one_euro(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", min_cutoff=1e-5, beta=1e-4, d_cutoff=1e-5, zero_lag=True)
    return found.withColumn("smooth", r6("smooth"))


@query("""
with o as (select o_orderkey, o_custkey % 15 u, epoch_us(o_orderdate) + 1 + (o_orderkey % 1000) * 86400000000 * 12 t from orders),
e as (select user_id % 15 u, epoch_us(ts) t, event_id, row_number() over (partition by user_id % 15, epoch_us(ts) order by event_id desc) i from events)
select o_orderkey, e.t matched_t, e.event_id matched_event_id from o asof left join (select * from e where i = 1) e on o.u = e.u and o.t >= e.t""")
def asof_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = 1 + (F.col("o_orderkey") % 1000) * 86_400_000_000 * 12
    left = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 15).alias("u"), (names.micros(F.col("o_orderdate")) + shift).alias("t0"))
    right = read(spark, sf_dir, "events").select((F.col("user_id") % 15).alias("u"), names.micros(F.col("ts")).alias("t"), "event_id")
    found = temporal.as_of(left, right, ["u"], "t0", "t", ["event_id"], "event_id", slice_width=86_400_000_000)
    return found.select("o_orderkey", "matched_t", "matched_event_id")


# --- colour -------------------------------------------------------------------------------------

RGB_SQL = "with c as (select l_orderkey, l_linenumber, l_quantity / 50 r, l_discount * 10 g, l_tax * 12.5 b from lineitem)"
LIN = "case when {0} <= 0.04045 then {0} / 12.92 else power(({0} + 0.055) / 1.055, 2.4) end"
LIN_SQL = RGB_SQL + ", n as (select *, " + ", ".join(f"{LIN.format(f'least(greatest({c}, 0), 1)')} l{c}" for c in "rgb") + " from c)"


def _rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("r"), (F.col("l_discount") * 10).alias("g"), (F.col("l_tax") * 12.5).alias("b")
    )


@query(LIN_SQL + " select l_orderkey, l_linenumber, round(lr, 6) lr, round(lg, 6) lg, round(lb, 6) lb from n")
def srgb_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", *[r6(colour.srgb_to_linear(F.col(c))).alias(f"l{c}") for c in "rgb"])


def _mat(m: tuple, names_: tuple, out: tuple) -> str:
    return ", ".join("(" + " + ".join(f"({k}) * {v}" for k, v in zip(row, names_, strict=True)) + f") {o}" for row, o in zip(m, out, strict=True))


OKLAB_SQL = LIN_SQL + f""", m as (select *, {_mat(colour.OKLAB_M1, ("lr", "lg", "lb"), ("ml", "mm", "ms"))} from n),
k as (select *, cbrt(greatest(ml, 0)) k1, cbrt(greatest(mm, 0)) k2, cbrt(greatest(ms, 0)) k3 from m),
o as (select l_orderkey, l_linenumber, {_mat(colour.OKLAB_M2, ("k1", "k2", "k3"), ("okl", "oka", "okb"))} from k)"""


def _oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rgb(spark, sf_dir)
    light, a, b = colour.srgb_to_oklab(F.col("r"), F.col("g"), F.col("b"))
    return rows.select("l_orderkey", "l_linenumber", light.alias("okl"), a.alias("oka"), b.alias("okb"))


@query(OKLAB_SQL + " select l_orderkey, l_linenumber, round(okl, 6) okl, round(oka, 6) oka, round(okb, 6) okb from o")
def oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oklab(spark, sf_dir).select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in ("okl", "oka", "okb")])


@query(OKLAB_SQL + " select l_orderkey, l_linenumber, round(sqrt(oka * oka + okb * okb), 6) chroma from o")
def oklch(spark: SparkSession, sf_dir: str) -> DataFrame:
    chroma, _ = colour.to_polar(F.col("oka"), F.col("okb"))
    return _oklab(spark, sf_dir).select("l_orderkey", "l_linenumber", r6(chroma).alias("chroma"))


FLAB = "case when {0} > 216.0 / 24389 then cbrt({0}) else (24389.0 / 27 * {0} + 16) / 116 end"
LAB_SQL = LIN_SQL + f""", x as (select *, {_mat(colour.SRGB_TO_XYZ, ("lr", "lg", "lb"), ("xx", "xy", "xz"))} from n),
f as (select *, {FLAB.format("(xx / 0.95047)")} fx, {FLAB.format("xy")} fy, {FLAB.format("(xz / 1.08883)")} fz from x),
lab as (select l_orderkey, l_linenumber, 116 * fy - 16 li, 500 * (fx - fy) a, 200 * (fy - fz) b from f)"""


def _lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    light, a, b = colour.linear_to_lab(*(colour.srgb_to_linear(F.col(c)) for c in "rgb"))
    return _rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", light.alias("li"), a.alias("a"), b.alias("b"))


@query(LAB_SQL + " select l_orderkey, l_linenumber, round(sqrt(power(li - 50, 2) + power(a - 10, 2) + power(b - 15, 2)), 6) de from lab")
def delta_e76(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = (F.lit(50.0), F.lit(10.0), F.lit(15.0))
    return _lab(spark, sf_dir).select("l_orderkey", "l_linenumber", r6(colour.delta_e_76((F.col("li"), F.col("a"), F.col("b")), anchor)).alias("de"))


@query(LAB_SQL + """, p as (select *, sqrt(a * a + b * b) c1o, sqrt(325.0) c2o from lab),
q as (select *, 0.5 * (1 - sqrt(power((c1o + c2o) / 2, 7) / (power((c1o + c2o) / 2, 7) + power(25.0, 7)))) g from p),
r as (select *, a * (1 + g) a1, 10.0 * (1 + g) a2 from q),
s as (select *, sqrt(a1 * a1 + b * b) c1, sqrt(a2 * a2 + 225.0) c2, (degrees(atan2(b, a1)) + 360) % 360 h1, (degrees(atan2(15.0, a2)) + 360) % 360 h2 from r),
t as (select *, case when c1 * c2 = 0 then 0 when abs(h2 - h1) <= 180 then h2 - h1 when h2 - h1 > 180 then h2 - h1 - 360 else h2 - h1 + 360 end dh,
  case when c1 * c2 = 0 then h1 + h2 when abs(h2 - h1) <= 180 then (h1 + h2) / 2 when h1 + h2 < 360 then (h1 + h2 + 360) / 2 else (h1 + h2 - 360) / 2 end hm, (c1 + c2) / 2 cm, (li + 50) / 2 lm from s),
u as (select *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)) tt from t),
v as (select *, (50 - li) / (1 + 0.015 * power(lm - 50, 2) / sqrt(20 + power(lm - 50, 2))) x, (c2 - c1) / (1 + 0.045 * cm) y, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * cm * tt) z,
  -2 * sqrt(power(cm, 7) / (power(cm, 7) + power(25.0, 7))) * sin(radians(60 * exp(-power((hm - 275) / 25, 2)))) rt from u)
select l_orderkey, l_linenumber, round(sqrt(greatest(x * x + y * y + z * z + rt * y * z, 0)), 5) de from v""")
def delta_e2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = (F.lit(50.0), F.lit(10.0), F.lit(15.0))
    de = colour.delta_e_2000((F.col("li"), F.col("a"), F.col("b")), anchor)
    return _lab(spark, sf_dir).select("l_orderkey", "l_linenumber", r6(de, 5).alias("de"))


@query(LAB_SQL + """, i as (select l_orderkey, l_linenumber, degrees(atan2(li - 50, b)) ita from lab)
select l_orderkey, l_linenumber, case when ita > 55 then 'I' when ita > 41 then 'II' when ita > 28 then 'III' when ita > 10 then 'IV' when ita > -30 then 'V' else 'VI' end phototype from i""")
def fitzpatrick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lab(spark, sf_dir).select("l_orderkey", "l_linenumber", colour.fitzpatrick(F.col("li"), F.col("b")).alias("phototype"))


GAIN_SQL = LIN_SQL + """, s as (select l_orderkey % 97 frame, avg(lr) r, avg(lg) g, avg(lb) b from n group by 1), h as (select avg(lr) hr, avg(lg) hg, avg(lb) hb from n),
y as (select *, 0.2126 * r + 0.7152 * g + 0.0722 * b yf, 0.2126 * hr + 0.7152 * hg + 0.0722 * hb yh from s, h),
w as (select *, least(greatest(log2(yh / yf), -1.0), 1.0) ev, least(greatest((hr / yh) / (r / yf), 0.9), 1 / 0.9) wr, least(greatest((hg / yh) / (g / yf), 0.9), 1 / 0.9) wg, least(greatest((hb / yh) / (b / yf), 0.9), 1 / 0.9) wb from y),
z as (select *, greatest((0.2126 * wr * r + 0.7152 * wg * g + 0.0722 * wb * b) / yf, 1e-6) nn from w)
select frame, round(ev, 6) ev, round(wr / nn * power(2, ev), 6) gr, round(wg / nn * power(2, ev), 6) gg, round(wb / nn * power(2, ev), 6) gb from z"""


@query(GAIN_SQL)
def set_match_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    linear = _rgb(spark, sf_dir).select((F.col("l_orderkey") % 97).alias("frame"), *[colour.srgb_to_linear(F.col(c)).alias(c) for c in "rgb"])
    frames = linear.groupBy("frame").agg(*[F.avg(c).alias(c) for c in "rgb"]).withColumn("one", F.lit(1))
    hero = linear.agg(*[F.avg(c).alias(f"h{c}") for c in "rgb"]).withColumn("one", F.lit(1))
    ev, gains = colour.match_gains(tuple(F.col(f"h{c}") for c in "rgb"), tuple(F.col(c) for c in "rgb"))
    return frames.join(F.broadcast(hero), "one").select("frame", r6(ev).alias("ev"), *[r6(g).alias(f"g{c}") for g, c in zip(gains, "rgb", strict=True)])


@query("""
with c as (select l_orderkey, l_linenumber, l_discount * 10 x from lineitem), s as (select *, 1 / (1 + exp(-6 * (x - 0.45))) v from c)
select l_orderkey, l_linenumber, round((v - 1 / (1 + exp(2.7))) / (1 / (1 + exp(-3.3)) - 1 / (1 + exp(2.7))), 6) density from s""")
def film_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(colour.density_curve(F.col("l_discount") * 10, 6.0, 0.45)).alias("density"))


@query("""
with t as (select p_partkey, p_retailprice * 3 k, 1000.0 / (p_retailprice * 3) i from part),
x as (select *, case when k <= 4000 then -0.2661239 * i * i * i - 0.2343580 * i * i + 0.8776956 * i + 0.179910 when k <= 7000 then 0.244063 + 0.09911 * i + 2.9678 * i * i - 4.6070 * i * i * i
  else 0.237040 + 0.24748 * i + 1.9018 * i * i - 2.0064 * i * i * i end x from t)
select p_partkey, round(x, 6) x, round(case when k <= 2222 then -1.1063814 * x * x * x - 1.34811020 * x * x + 2.18555832 * x - 0.20219683
  when k <= 4000 then -0.9549476 * x * x * x - 1.37418593 * x * x + 2.09137015 * x - 0.16748867 else -3.0 * x * x + 2.870 * x - 0.275 end, 6) y from x""")
def kelvin_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = colour.kelvin_to_xy(F.col("p_retailprice") * 3)
    return read(spark, sf_dir, "part").select("p_partkey", r6(x).alias("x"), r6(y).alias("y"))


@query(RGB_SQL + """
select l_orderkey, l_linenumber, round(1 - (1 - r) * (1 - g), 6) screen, round(case when r <= 0.5 then 2 * r * g else 1 - 2 * (1 - r) * (1 - g) end, 6) overlay,
  round((1 - 2 * g) * r * r + 2 * g * r, 6) soft, round(r * (1 - b) + g * b, 6) masked from c""")
def blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return _rgb(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", r6(colour.screen(r, g)).alias("screen"), r6(colour.overlay(r, g)).alias("overlay"),
        r6(colour.soft_light(r, g)).alias("soft"), r6(colour.masked(r, g, b)).alias("masked"),
    )


@query(LIN_SQL + """
, p as (select *, power(lr, 2610.0 / 16384) q from n)
select l_orderkey, l_linenumber, round(power((3424.0 / 4096 + 2413.0 / 128 * q) / (1 + 2392.0 / 128 * q), 2523.0 / 32), 6) pq,
  round(case when lg * 1.5 <= 0.8 then lg * 1.5 else 0.8 + 0.2 * (1 - exp(-(lg * 1.5 - 0.8) / 0.2)) end, 6) rolled, round(lb * 2 / (1 + lb * 2), 6) reinhard from p""")
def tone_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = (colour.srgb_to_linear(F.col(c)) for c in "rgb")
    return _rgb(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", r6(colour.linear_to_pq(r)).alias("pq"), r6(colour.shoulder(g * 1.5)).alias("rolled"), r6(colour.reinhard(b, 2.0)).alias("reinhard")
    )


CUBE_SQL = "(1 - f{0}) * {1} + f{0} * {2}"
CELL_SQL = RGB_SQL + ", i as (select *, " + ", ".join(f"least(floor({c} * 8), 7) i{c}" for c in "rgb") + " from c), f as (select *, " + ", ".join(f"{c} * 8 - i{c} f{c}" for c in "rgb") + " from i)"


@query(CELL_SQL + f"""
select l_orderkey, l_linenumber, round(r + 0.8 * ({CUBE_SQL.format("r", "sqrt(ir / 8)", "sqrt((ir + 1) / 8)")} - r), 6) r, round(g, 6) g,
  round(b + 0.8 * ({CUBE_SQL.format("b", "power(ib / 8, 2)", "power((ib + 1) / 8, 2)")} - b), 6) b from f""")
def lut_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A warm 9-cube applied to all pixels."""
    import numpy as np

    from ..sources import tables

    axis = np.linspace(0, 1, 9)
    b, g, r = np.meshgrid(axis, axis, axis, indexing="ij")
    cube = np.stack([np.sqrt(r), g, b * b], axis=-1)
    graded = tables.apply_lut(_rgb(spark, sf_dir), cube, 0.8)
    return graded.select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in "rgb"])


# --- looks --------------------------------------------------------------------------------------


@query()
def link_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean looks of small sessions (label, ten vectors each), linked within their label."""
    rows = read(spark, sf_dir, "embeddings").withColumn("session", F.floor(F.col("vec_id") / 100).cast("long"))
    looks = similarity.mean_histogram(rows, ["label", "session"], "embedding")
    return similarity.link_looks(looks, "label", "session", "histogram", 0.20)


@query("""
with recursive e as (select label, vec_id, list_transform(embedding, lambda x: abs(x::double)) e from embeddings),
v as (select label, vec_id, list_transform(e, lambda x: x / list_sum(e)) v from e),
n as (select *, row_number() over (partition by label order by vec_id) i, lead(v) over (partition by label order by vec_id) "after" from v),
w as (select label, vec_id, i, [v] recent, false found from n where i = 1
  union all select label, vec_id, i, case when far then [v] else list_append(recent[greatest(len(recent) - 2, 1):], v) end, far from (
    select label, vec_id, i, v, recent, "after", d1 > 0.3 and ("after" is null or d2 > 0.3) far from (
      select *, sqrt(greatest(1 - list_sum(list_transform(list_zip(v, m), lambda z: sqrt(z[1] * z[2]))), 0)) d1, sqrt(greatest(1 - list_sum(list_transform(list_zip("after", m), lambda z: sqrt(z[1] * z[2]))), 0)) d2 from (
        select n.label, n.vec_id, n.i, n.v, n."after", w.recent, list_transform(range(1, len(n.v) + 1), lambda j: list_sum(list_transform(w.recent, lambda q: q[j])) / len(w.recent)) m
        from w join n on n.label = w.label and n.i = w.i + 1))))
select label, vec_id from w where found""")
def costume_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    looks = rows.withColumn("look", F.transform("e", lambda x: x / total))
    return similarity.change_points(looks, "label", "vec_id", "look", 0.30)


@query()
def linkage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy complete linkage over token-set pairs, within connected pairs of one class head."""
    pairs = jaccard_pairs(spark, sf_dir).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.col("jaccard").alias("similarity"))
    return similarity.complete_linkage(similarity.with_components(pairs))


# --- names, files, reports ----------------------------------------------------------------------


@query("""
with f as (select event_id, epoch_us(ts) // 1000000 % 200000 s from events)
select event_id, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' || lpad((s % 60)::varchar, 2, '0') || 's'
  else (s // 3600) || 'h' || lpad((s % 3600 // 60)::varchar, 2, '0') || 'm' end shown,
  (case when s < 60 then s when s < 3600 then s else s // 60 * 60 end)::double parsed from f""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.floor(names.micros(F.col("ts")) / 1_000_000).cast("long") % 200_000
    shown = names.format_duration(seconds)
    return read(spark, sf_dir, "events").select("event_id", shown.alias("shown"), names.parse_duration(shown).alias("parsed"))


@query("""
with h as (select doc_id, substr(sha256(text), 1, 16) f from documents), d as (select b.doc_id, b.f, a.f p from h a join h b on b.doc_id = a.doc_id + 1)
select doc_id, bit_count(xor(('0x' || substr(f, 1, 8))::bigint, ('0x' || substr(p, 1, 8))::bigint)) + bit_count(xor(('0x' || substr(f, 9, 8))::bigint, ('0x' || substr(p, 9, 8))::bigint)) distance
from d where p is not null""")
def fingerprint_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint against that of the document numbered before it."""
    prints = read(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("f"))
    before = prints.select((F.col("doc_id") + 1).alias("doc_id"), F.col("f").alias("p"))
    return prints.join(before, "doc_id").where("f is not null and p is not null").select("doc_id", names.hamming_hex(F.col("f"), F.col("p")).alias("distance"))


@query("""
with f as (select page_id, split_part(split_part(url, '?', 1), '#', 1) u from pages),
k as (select page_id, u, regexp_replace(u, '[^/]*$', '') || lower(split_part(regexp_extract(u, '[^/]*$'), '.', 1)) shot_key, right(lower(u), 5) = '.html' photo from f)
select shot_key, count(*) n_files from k group by 1 having bool_or(photo)""")
def shot_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "pages").select(F.substring_index(F.substring_index("url", "?", 1), "#", 1).alias("path"))
    return sessions.shots(files, "path", ["html"]).select("shot_key", F.size("files").cast("long").alias("n_files"))


@query("select o_custkey, o_orderstatus, count(*) n from orders group by 1, 2")
def status_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status, read back from the run documents that the manifest sink writes."""
    from ..sources import tables

    runs = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderkey").cast("string").alias("path"))
    documents = tables.manifest(runs, "o_custkey", "o_orderstatus", "path")
    parsed = documents.select("o_custkey", F.from_json("document", "schema int, counts map<string,bigint>").alias("d"))
    return parsed.select("o_custkey", F.explode("d.counts").alias("o_orderstatus", "n"))


@query("""
with n as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 i from documents)
select doc_id, (i % 6 * 320)::int x, (i // 6 * 320)::int y from n""")
def contact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import tables

    placed = tables.contact_sheet(read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("set_id")), "doc_id", 6, 320)
    return placed.select("doc_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


@query("""
select p_partkey, sha256('{"p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') digest from part""")
def edit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import tables

    return tables.edit_report(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), ["p_partkey", "p_name", "p_size"]).select("p_partkey", "digest")


@query("""
select p_partkey, case when l is null or r is null then 'uncertain' when least(l, r) < 0.15 then 'no' when least(l, r) >= 0.20 then 'yes' else 'uncertain' end eyes
from (select p_partkey, case when p_size % 10 = 0 then null else p_size / 100.0 end l, 0.1 + (p_partkey % 13) / 50.0 r from part)""")
def eye_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = F.when(F.col("p_size") % 10 != 0, F.col("p_size") / 100.0), 0.1 + (F.col("p_partkey") % 13) / 50.0
    return read(spark, sf_dir, "part").select("p_partkey", ranking.eyes_open(left, right).alias("eyes"))


@query("""
with s as (select c_mktsegment stem, c_custkey "order", c_acctbal a, c_nationkey b from customer),
x as (select stem, arg_max(a, "order") a, arg_max(b, "order") b from s where "order" % 2 = 0 group by 1), y as (select stem, arg_max(a, "order") a, arg_max(b, "order") b from s where "order" % 2 = 1 group by 1)
select stem, round(y.a - x.a, 4) a_delta, y.b - x.b b_delta from x join y using (stem)""")
def style_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("stem"), F.col("c_custkey").alias("order"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("b"))
    found = robust.style_profile(rows.where("order % 2 = 0"), rows.where("order % 2 = 1"), "stem", ["a", "b"])
    return found.select("stem", r6("a_delta", 4).alias("a_delta"), "b_delta")


# --- streams ------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import events

    return events.file_stream(spark, sf_dir, "events", read(spark, sf_dir, "events").schema)


@query("select user_id, arg_max(event_type, (ts, event_id)) event_type, count(*) n_events from events group by 1")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import events

    return events.drain(events.progress(_stream(spark, sf_dir), "user_id", ["ts", "event_id"], ["event_type"]), "complete")


@query("""
with w as (select epoch_us(ts) // 86400000000::bigint * 86400000000::bigint window_us, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2),
m as (select max(epoch_us(ts)) - 3600000000 mark from events)
select window_us, event_type, n, total from w, m where window_us + 86400000000 <= mark""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import events

    found = events.drain(events.windowed(_stream(spark, sf_dir), "ts", "1 day", "1 hour", ["event_type"], "value"), "append")
    return found.withColumn("total", r6("total", 4))


@query("select user_id, event_type, count(*) n from (select distinct user_id, event_type from events) group by 1, 2")
def stream_unique_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import events

    kept = events.drain(events.unique_jobs(_stream(spark, sf_dir), "ts", "400 days", ["user_id", "event_type"]), "append")
    return kept.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
with m as (select event_id, user_id, ts, case when value > 60 then true when value < 20 then false end m from events),
s as (select user_id, coalesce(last_value(m ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), false) state, row_number() over (partition by user_id order by ts desc, event_id desc) i from m)
select user_id, count(*) n, count(*) filter (state) n_on, bool_or(state and i = 1) state from s group by 1""")
def stream_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import events

    return events.drain(events.hysteresis(_stream(spark, sf_dir), "user_id", "ts", "value", 60, 20), "update")
