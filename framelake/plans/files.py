"""Queries over files and documents; their texts are written from the driver's tables and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review
from ..sources import documents, images, tables
from ..streaming import events
from .catalogue import query, r6, read


def _written(lines: DataFrame, value: Column, order: str) -> str:
    """A new folder with the lines as one text file, in order."""
    folder = events.work_dir(lines.sparkSession)
    lines.orderBy(order).select(value.cast("string").alias("value")).coalesce(1).write.text(folder)
    return folder


#: A cube of five steps a channel: the mean colour of the line items of each cell, or the cell's corner where there are none.
CUBE_SQL = """with c as (select least(floor(l_quantity / 50 * 5), 4)::int ir, least(floor(l_discount * 50), 4)::int ig, least(floor(l_tax * 62.5), 4)::int ib, l_quantity / 50 r, l_discount * 10 g, l_tax * 12.5 b from lineitem),
m as (select ir, ig, ib, avg(r) r, avg(g) g, avg(b) b from c group by 1, 2, 3), i as (select (i % 5)::int ir, (i // 5 % 5)::int ig, (i // 25)::int ib from range(125) t(i))
select 5 n, ib, ig, ir, round(coalesce(r, ir / 4.0::double), 7) r, round(coalesce(g, ig / 4.0::double), 7) g, round(coalesce(b, ib / 4.0::double), 7) b from i left join m using (ir, ig, ib)"""


def _cube_lines(spark: SparkSession, sf_dir: str, head: list[str]) -> DataFrame:
    step = lambda v: F.least(F.floor(v * 5), F.lit(4)).cast("int")
    colours = {"r": F.col("l_quantity") / 50, "g": F.col("l_discount") * 10, "b": F.col("l_tax") * 12.5}
    cells = read(spark, sf_dir, "lineitem").groupBy(*[step(v).alias(f"i{c}") for c, v in colours.items()]).agg(*[F.avg(v).alias(c) for c, v in colours.items()])
    i = F.col("id")
    corners = spark.range(125).select(i, (i % 5).cast("int").alias("ir"), (F.floor(i / 5) % 5).cast("int").alias("ig"), F.floor(i / 25).cast("int").alias("ib"))
    values = [F.format_string("%.9f", F.coalesce(c, F.col(f"i{c}") / 4)) for c in "rgb"]
    body = corners.join(cells, ["ir", "ig", "ib"], "left").select((i + 100).alias("at"), F.concat_ws(" ", *values).alias("line"))
    return spark.createDataFrame(list(enumerate(head)), "at long, line string").unionByName(body)


@query(CUBE_SQL)
def cube_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(_cube_lines(spark, sf_dir, ['TITLE "t"', "# made", "LUT_3D_SIZE 5", "DOMAIN_MIN 0 0 0", ""]), F.col("line"), "at")
    cube = tables.read_cube(spark, path)
    return cube.select("n", "ib", "ig", "ir", *[r6(c, 7).alias(c) for c in "rgb"])


@query(CUBE_SQL)
def lut_3dl_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(_cube_lines(spark, sf_dir, ["# made", "TITLE x", "3DLUTSIZE 5", "not a row"]), F.col("line"), "at")
    return documents.read_3dl(documents.texts(spark, path)).select("n", "ib", "ig", "ir", *[r6(c, 7).alias(c) for c in "rgb"])


@query("select (row_number() over (order by p_partkey) - 1)::int \"position\", p_name path from part")
def path_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts' names as documents of 500 keys each, written by many tasks and read back in order."""
    part = F.expr("p_partkey div 500")
    listed = read(spark, sf_dir, "part").groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    document = F.to_json(F.struct(F.lit(1).alias("version"), "part", F.transform("x", lambda x: x["p_name"]).alias("inputs")))
    folder = events.work_dir(spark)
    listed.select(document.alias("value")).write.text(folder)
    return images.path_list(spark, folder)


@query("""
with f as (select page_id, 'in/' || (case when page_id % 9 = 0 then '.' else '' end) || page_id || '.' || ['jpg', 'txt', 'raf', 'png'][page_id % 4 + 1] path, ['jpg', 'txt', 'raf', 'png'][page_id % 4 + 1] ext, case when page_id % 7 = 0 then 0 else 9 end "size" from pages),
r as (select *, case when ext = 'txt' then 'unsupported_extension' when "size" = 0 then 'empty_file' when starts_with(split_part(path, '/', 2), '.') then 'hidden' when path like '%5.%' then 'exclude_pattern' when not contains(path, 'in/') then 'not_included' end reason from f)
select page_id, reason, case when reason is null then 'selected' when reason in ('unsupported_extension', 'empty_file') then 'rejected' else 'excluded' end status from r""")
def input_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "txt", "raf", "png"))), (key % 4 + 1).cast("int"))
    files = read(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("in/"), F.when(key % 9 == 0, ".").otherwise(""), key, F.lit("."), ext).alias("path"), ext.alias("ext"), F.when(key % 7 == 0, 0).otherwise(9).alias("size")
    )
    return images.input_plan(files, include="^in/", exclude=r"5\.").select("page_id", "reason", "status")


@query("""
select p_partkey, (100 + p_size)::bigint width, (7 * p_size)::bigint height, null::varchar capture_source from part""")
def header_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths and heights out of image headers (here of PNG files without pixels)."""
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    head = F.unhex(F.lit("89504E470D0A1A0A0000000D49484452"))
    content = F.concat(head, number(100 + F.col("p_size")), number(7 * F.col("p_size")), F.unhex(F.lit("08020000")))
    files = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"))
    return images.probe(files).select(F.col("path").cast("long").alias("p_partkey"), "width", "height", "capture_source")


@query("select event_id, case when event_id % 4 <> 0 then date_trunc('second', ts) end taken, case event_id % 3 when 0 then 'jpeg' when 1 then 'tiff' else 'png' end format from events")
def capture_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    text = F.when(key % 4 == 0, "unknown").otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    ext = F.when(key % 3 == 0, "jpg").when(key % 3 == 1, "tif").otherwise("bmp")
    return read(spark, sf_dir, "events").select("event_id", images.capture_time(text).alias("taken"), images.output_format(ext, "auto").alias("format"))


@query("""
select c_custkey, 'missing' problem from customer where c_custkey not in (select o_custkey from orders)
union all select distinct o_custkey, 'unexpected' from orders where o_custkey % 10 = 0 and o_custkey not in (select c_custkey from customer where c_custkey % 20 <> 0) and o_custkey not in (select c_custkey from customer where c_custkey not in (select o_custkey from orders))""")
def unmatched_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    expected = read(spark, sf_dir, "customer").join(found.where("c_custkey % 20 = 0"), "c_custkey", "left_anti")
    return review.unmatched(expected, found, "c_custkey")


@query("""
select doc_id, lang || ';' || source labels, '{"n":' || n_chars || '}' evidence from documents where lang is not null and source is not null""")
def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = read(spark, sf_dir, "documents").where("lang is not null and source is not null").select("doc_id", F.array("lang", "source").alias("labels"), "n_chars")
    return tables.review_rows(assets, "labels", F.struct(F.col("n_chars").alias("n"))).select("doc_id", "labels", "evidence")


def _json(rows: DataFrame, **fields: Column) -> DataFrame:
    """One document a row; every tenth is broken off."""
    text = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return rows.select(F.col("key").cast("string").alias("path"), F.when(F.col("key") % 10 == 0, F.substring(text, 1, 12)).otherwise(text).alias("text"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").withColumn("key", F.col("p_partkey"))


@query("select p_name || p_partkey \"name\", case when p_size % 3 = 0 then 1.0 else p_size / 50.0 end::double intensity, op, case op when 'glow' then p_size else p_retailprice end::double amount from part, (values ('glow'), ('warm')) o(op) where p_partkey % 10 <> 0")
def preset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    ops = F.create_map(F.lit("glow"), F.col("p_size").cast("double"), F.lit("warm"), F.col("p_retailprice"))
    return documents.presets(_json(rows, name=F.concat("p_name", "p_partkey"), intensity=F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 50), ops=ops))


RECIPES_SQL = """
with k as (select 'r' || n_nationkey recipe from nation), d as (select p_partkey, 'r' || (p_partkey % 60) own, case when p_size % 4 = 0 then 'r' || p_size end parent from part),
j as (select *, case when p_partkey % 10 = 0 then 'malformed' when own in (select recipe from k) then 'exists' when parent is not null and parent not in (select recipe from k) then 'unknown_parent' end problem from d)
"""


def _recipes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    name = F.concat(F.lit("r"), F.col("p_partkey") % 60)
    texts = _json(_parts(spark, sf_dir), name=name, extends=F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("r"), "p_size")), params=F.create_map(F.lit("a.b"), F.col("p_size").cast("double")))
    return documents.imported_recipes(texts, read(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_nationkey").alias("recipe")))


@query(RECIPES_SQL + "select own recipe, parent, 'a.b' path, p_size::double \"value\" from j join part using (p_partkey) where problem is null")
def recipe_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recipes(spark, sf_dir)[0]


@query(RECIPES_SQL + "select p_partkey::varchar path, problem from j where problem is not null")
def recipe_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recipes(spark, sf_dir)[1]


@query("""
select 'a' || p_partkey asset_instance_id, p_name relative_path, p_brand content_id, 'keep' decision, p_size rating, p_type labels from part where p_partkey % 10 <> 0 and p_partkey % 7 <> 0""")
def review_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset = F.struct(
        F.col("p_name").alias("relative_path"), F.col("p_brand").alias("content_id"), F.lit("keep").alias("decision"), F.col("p_size").alias("rating"), F.array("p_type").alias("labels")
    )
    texts = _json(_parts(spark, sf_dir), schema=F.when(F.col("p_partkey") % 7 == 0, 9).otherwise(1), assets=F.create_map(F.concat(F.lit("a"), "p_partkey"), asset))
    return documents.review_assets(texts)[0].withColumn("labels", F.array_join("labels", ";"))


@query("select p_name stem, round(p_size / 10.0, 4)::double brightness_delta, p_retailprice contrast_delta, null::double saturation_delta from part where p_partkey % 10 <> 0")
def style_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.styles(_json(_parts(spark, sf_dir), stem=F.col("p_name"), brightness_delta=F.round(F.col("p_size") / 10, 4), contrast_delta=F.col("p_retailprice")))


@query("select p_brand || p_partkey \"name\", p_name filename, 'https://example.org/' || p_partkey url, md5(p_name) sha256, p_size::bigint \"size\" from part where p_partkey % 10 <> 0")
def model_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.struct(F.col("p_name").alias("filename"), F.concat(F.lit("https://example.org/"), "p_partkey").alias("url"), F.md5("p_name").alias("sha256"), F.col("p_size").alias("size"))
    return documents.models(_json(_parts(spark, sf_dir), models=F.create_map(F.concat("p_brand", "p_partkey"), model)))


@query("""
with f as (select 'luts/' || p_partkey || '/' || split_part(p_name, ' ', 1) || '.cube' path, lower(split_part(p_name, ' ', 1)) stem, p_size modified from part)
select stem, path, modified from f qualify row_number() over (partition by stem order by modified desc, path) = 1""")
def lut_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("luts/"), "p_partkey", F.lit("/"), F.substring_index("p_name", " ", 1), F.lit(".cube"))
    return documents.registry(read(spark, sf_dir, "part").select(path.alias("path"), F.col("p_size").alias("modified")))


@query("""
select p_partkey, sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || ',"schema":1}') manifest_sha256 from part""")
def render_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.render_manifest(read(spark, sf_dir, "part"), ["p_size", "p_partkey", "p_brand"]).select("p_partkey", "manifest_sha256")


@query("""
with s as (select p_partkey, p_partkey::varchar path, round(p_size * 1.5, 1) s, row_number() over (order by p_size desc, p_partkey) "rank" from part)
select "rank", path, s::decimal(10, 1)::varchar score, '{"size":' || (select p_size from part where part.p_partkey = s.p_partkey) || '}' checks from s""")
def cover_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import ranking

    scored = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") * 1.5).alias("s"), F.col("p_partkey").cast("string").alias("path"))
    return documents.cover_scores(ranking.global_rank(scored, "s", "p_partkey"), "s", "path", F.struct(F.col("p_size").alias("size")))


@query("""
with x as (select p_partkey, '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmp:Rating="' || (p_size % 6) || '"'
  || case when p_size % 2 = 0 then ' xmp:Label="a &amp; &lt;b>"' else '' end || '><dc:subject><rdf:Bag><rdf:li>' || p_brand || '</rdf:li><rdf:li>keep</rdf:li></rdf:Bag></dc:subject></rdf:Description></rdf:RDF></x:xmpmeta>' sidecar from part)
select p_partkey, sidecar from x""")
def xmp_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = documents.xmp(F.col("p_size") % 6, F.when(F.col("p_size") % 2 == 0, "a & <b>"), F.array("p_brand", F.lit("keep"), F.lit("keep")))
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("sidecar"))


@query("""
with m as (select c_name source, case when c_custkey % 11 = 0 then c_name else 'set/' || (c_custkey % 1000) end destination from customer)
select source, destination, case when source = destination then 'done' when count(*) over (partition by lower(destination)) > 1 then 'conflict' else 'move' end "action" from m""")
def move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = F.when(F.col("c_custkey") % 11 == 0, F.col("c_name")).otherwise(F.concat(F.lit("set/"), F.col("c_custkey") % 1000))
    return documents.move_plan(read(spark, sf_dir, "customer").select(F.col("c_name").alias("source"), to.alias("destination")), "source", "destination")


@query("""
with c as (select o_custkey, case o_orderstatus when 'F' then 'done' when 'O' then 'pending' else 'running' end s, count(*) n from orders group by 1, 2)
select o_custkey, sum(n)::bigint total, coalesce(sum(n) filter (s = 'done'), 0)::bigint done, round(coalesce(sum(n) filter (s = 'done'), 0) / sum(n), 4) finished from c group by 1""")
def progress_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    shown = documents.progress_snapshot(read(spark, sf_dir, "orders").select("o_custkey", status.alias("status")), "o_custkey", "status")
    d = F.from_json("snapshot", "counts map<string,bigint>, finished double, total bigint")
    return shown.withColumn("d", d).select("o_custkey", "d.total", F.coalesce(F.col("d.counts")["done"], F.lit(0)).alias("done"), "d.finished")


@query("""
with s as (select user_id path, event_id scan, event_type signature, lag(event_type) over (partition by user_id order by event_id) p from events)
select path::varchar path, signature, case when signature = p then 'ready' else 'settling' end status from s qualify row_number() over (partition by path order by scan desc) = 1""")
def stream_stable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = events.file_stream(spark, sf_dir, "events", read(spark, sf_dir, "events").schema)
    named = scans.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("scan"), F.col("event_type").alias("signature"))
    return events.drain(events.stable_files(named), "update")
