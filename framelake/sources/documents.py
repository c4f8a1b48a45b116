"""JSON documents as dimensions, with what can't be read kept apart; plain-text tables and sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Schemas of the documents that are read here.
PRESET = "name string, intensity double, ops map<string,double>"
RECIPE = "name string, description string, extends string, params map<string,double>"
REVIEW = "schema int, assets map<string,struct<relative_path:string,content_id:string,decision:string,rating:int,labels:array<string>>>"
STYLE = "stem string, brightness_delta double, contrast_delta double, saturation_delta double"
MODELS = "models map<string,struct<filename:string,url:string,sha256:string,size:bigint>>"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parsed(documents: DataFrame, schema: str, required: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with ``d``, the parsed text, and those that can't be read or lack something ``required``, with a ``problem``."""
    kept = f"{schema}, __bad string"
    read = documents.withColumn("d", F.from_json(text, kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    problem = F.when(F.col("d").isNull() | F.col("d.__bad").isNotNull(), "malformed")
    for field in required:
        problem = problem.when(F.col(f"d.{field}").isNull(), f"missing_{field}")
    judged = read.withColumn("problem", problem)
    clean = judged.where("problem is null").withColumn("d", F.col("d").dropFields("__bad")).drop("problem")
    return clean, judged.where("problem is not null").drop("d")


def presets(documents: DataFrame) -> DataFrame:
    """``name, intensity, op, amount``: one row per operation of each preset."""
    rows, _ = parsed(documents, PRESET, ["name"])
    return rows.select("d.name", F.coalesce("d.intensity", F.lit(1.0)).alias("intensity"), F.explode("d.ops").alias("op", "amount"))


def imported_recipes(documents: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``recipe, parent, path, value`` of recipes that can be added, and ``path, problem`` of those that can't: unreadable, without a
    name, named like one of the ``known`` recipes, or with a parent that none of these is."""
    rows, bad = parsed(documents, RECIPE, ["name"])
    names = known.select("recipe").distinct()
    judged = (
        rows.join(names.select(F.col("recipe").alias("__own")), F.col("d.name") == F.col("__own"), "left")
        .join(names.select(F.col("recipe").alias("__parent")), F.col("d.extends") == F.col("__parent"), "left")
        .withColumn("problem", F.when(F.col("__own").isNotNull(), "exists").when(F.col("d.extends").isNotNull() & F.col("__parent").isNull(), "unknown_parent"))
    )
    good = judged.where("problem is null").select(F.col("d.name").alias("recipe"), F.col("d.extends").alias("parent"), F.explode_outer("d.params").alias("path", "value"))
    return good, bad.select("path", "problem").unionByName(judged.where("problem is not null").select("path", "problem"))


def review_assets(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per asset of review manifests of schema 1, and the documents that are malformed or of another schema."""
    rows, bad = parsed(documents, REVIEW, ["schema", "assets"])
    other = rows.where("d.schema != 1").select("path", F.lit("unknown_schema").alias("problem"))
    assets = rows.where("d.schema = 1").select(F.explode("d.assets").alias("asset_instance_id", "a")).select("asset_instance_id", "a.*")
    return assets, bad.select("path", "problem").unionByName(other)


def styles(documents: DataFrame) -> DataFrame:
    rows, _ = parsed(documents, STYLE, ["stem"])
    return rows.select("d.*")


def models(documents: DataFrame) -> DataFrame:
    """``name, filename, url, sha256, size`` of a model manifest; nothing is fetched."""
    rows, _ = parsed(documents, MODELS, ["models"])
    return rows.select(F.explode("d.models").alias("name", "m")).select("name", "m.*")


def read_3dl(documents: DataFrame) -> DataFrame:
    """``path, n, ib, ig, ir, r, g, b`` of .3dl texts: a size line, then triplets with red running fastest. Comments, titles and
    lines that aren't three numbers are skipped; a text whose triplets don't fill the cube gives none."""
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x))
    size = F.regexp_extract("text", r"(?m)^\s*3DLUTSIZE\s+(\d+)", 1).try_cast("int")
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    rows = documents.select("path", size.alias("n"), F.filter(lines, lambda x: x.rlike(rf"^{number}\s+{number}\s+{number}$")).alias("rows")).where(F.size("rows") == F.col("n") * F.col("n") * F.col("n"))
    each = rows.select("path", "n", F.posexplode("rows").alias("i", "row")).withColumn("v", F.transform(F.split("row", r"\s+"), lambda x: x.cast("double")))
    i, n = F.col("i"), F.col("n")
    return each.select(
        "path", "n", F.floor(i / (n * n)).cast("int").alias("ib"), (F.floor(i / n) % n).cast("int").alias("ig"), (i % n).cast("int").alias("ir"),
        *[F.col("v")[k].alias(c) for k, c in enumerate("rgb")],
    )


def registry(files: DataFrame) -> DataFrame:
    """``stem, path, modified``: of the tables of one name (letter case aside) the newest file, ties by path."""
    stem = F.lower(F.regexp_extract("path", r"([^/]+?)\.[^./]+$", 1))
    place = F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("modified"), "path"))
    return files.withColumn("stem", stem).withColumn("__n", place).where("__n = 1").select("stem", "path", "modified")


def render_manifest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Observation of a render without its pixels: sorted JSON with a schema number, and its digest."""
    document = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)], F.lit(1).alias("schema")))
    return rows.withColumn("manifest", document).withColumn("manifest_sha256", F.sha2(document, 256))


def cover_scores(ranked: DataFrame, score: str, path: str, checks: Column) -> DataFrame:
    """Rows of the score file: rank, path, score to one decimal, and the checks as JSON."""
    return ranked.select("rank", path, F.format_string("%.1f", score).alias("score"), F.to_json(checks).alias("checks"))


def xmp(rating: Column, label: Column, keywords: Column) -> Column:
    """Sidecar text with a rating, a label and keywords; what is null is left out, text is escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    attributes = F.concat(
        F.coalesce(F.concat(F.lit(' xmp:Rating="'), rating.cast("string"), F.lit('"')), F.lit("")), F.coalesce(F.concat(F.lit(' xmp:Label="'), safe(label), F.lit('"')), F.lit(""))
    )
    items = F.array_join(F.transform(F.array_distinct(keywords), lambda k: F.concat(F.lit("<rdf:li>"), safe(k), F.lit("</rdf:li>"))), "")
    bag = F.when(F.size(keywords) > 0, F.concat(F.lit("<dc:subject><rdf:Bag>"), items, F.lit("</rdf:Bag></dc:subject>"))).otherwise("")
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description'
    spaces = ' xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    return F.concat(F.lit(head + spaces), attributes, F.lit(">"), bag, F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"))


def move_plan(moves: DataFrame, source: str, destination: str) -> DataFrame:
    """``source, destination, action`` of planned moves: moves onto themselves are done, two sources of one destination (letter case
    aside) conflict. Undoing a plan is the same with both columns exchanged; nothing is moved here."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lower(destination)))
    action = F.when(F.col(source) == F.col(destination), "done").when(n > 1, "conflict").otherwise("move")
    return moves.select(source, destination, action.alias("action"))


def progress_snapshot(images: DataFrame, run: str, status: str) -> DataFrame:
    """``run, snapshot``: counts by status and the share that is finished, as JSON."""
    counts = images.groupBy(run, status).agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy(run).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias("counts"), F.sum("n").alias("total"),
        F.sum(F.when(F.col(status).isin("done", "failed", "skipped"), F.col("n")).otherwise(0)).alias("__finished"),
    )
    share = F.round(F.col("__finished") / F.col("total"), 4).alias("finished")
    return listed.select(run, F.to_json(F.struct("counts", share, "total")).alias("snapshot"))
