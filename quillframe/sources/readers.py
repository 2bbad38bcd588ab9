"""Sources. Schemas are given, never inferred; what cannot be used becomes an issue row, not an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import issues

SIDECAR = "schema_version int, sample string, equation_kind string, scene_case string, error_kind string, symbols array<struct<flattened:string,bbox_px:array<double>>>"
QUOTA = "schema_version int, eval struct<scene_cases:map<string,int>,error_cases:map<string,int>>, train struct<scene_cases:map<string,int>,error_cases:map<string,int>>"
RUN_INDEX = "runs array<struct<run_id:string,stage:string,created_utc:string,metrics:map<string,double>>>"
MANIFEST = "image string, label string, path string, sha256 string"
PNG = "89504E470D0A1A0A"


def relative(path: Column, root: str) -> Column:
    return F.split_part(path, F.lit(root.rstrip("/") + "/"), F.lit(-1))


def asset_pool(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """path, label (first folder), sha256, content_id, width, height and header_ok of the files under a folder.

    Sizes come from the PNG header; pixels are not decoded. Content is read once and does not leave the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    name = relative(F.col("path"), root.rsplit("/", 1)[-1])
    return files.select(
        name.alias("path"), F.split_part(name, F.lit("/"), F.lit(1)).alias("label"), F.sha2("content", 256).alias("sha256"), F.substring(F.sha2("content", 256), 1, 16).alias("content_id"),
        *png_header(F.col("content")),
    )


def png_header(content: Column) -> list[Column]:
    """width, height and header_ok from the first bytes of a file; no pixels are decoded."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    ok = F.hex(F.substring(content, 1, 8)) == PNG
    return [F.when(ok, number(17)).alias("width"), F.when(ok, number(21)).alias("height"), ok.alias("header_ok")]


def asset_issues(assets: DataFrame, width: int = 28, height: int = 28) -> DataFrame:
    """corrupt_image and invalid_size rows."""
    size = F.concat_ws("x", "width", "height")
    return issues(assets, F.col("path"), [(~F.col("header_ok"), "corrupt_image", "no PNG header"), (F.col("header_ok") & ((F.col("width") != width) | (F.col("height") != height)), "invalid_size", size)])


def label_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """One row for each label file: key is the file's stem; symbols stays null where the file has none."""
    df = spark.read.schema(SIDECAR).option("multiLine", True).json(path)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), r"(\.label)?\.json$", "").alias("key"), "*")


def sidecar_symbols(sidecars: DataFrame) -> DataFrame:
    """scene key, has_symbols, and one row for each symbol (one row with nulls where there is none)."""
    long = sidecars.select("key", F.col("symbols").isNotNull().alias("has_symbols"), F.posexplode_outer("symbols").alias("gt_id", "s"))
    return long.select("key", "has_symbols", "gt_id", F.col("s.flattened").alias("label"), *[F.get(F.col("s.bbox_px"), i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def quotas(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Long quota rows (mode, block, key, target), and issues for a wrong version or a missing block."""
    raw = spark.read.schema(QUOTA).option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("path"))
    parts = [raw.select(F.lit(m).alias("mode"), F.lit(b).alias("block"), F.explode(f"{m}.{b}").alias("key", "target")) for m in ("eval", "train") for b in ("scene_cases", "error_cases")]
    long = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    found = issues(raw, F.col("path"), [
        (F.coalesce("schema_version", F.lit(-1)) != version, "invalid_version", F.col("schema_version").cast("string")), (F.col("eval.scene_cases").isNull(), "missing_block", "eval"), (F.col("train.scene_cases").isNull(), "missing_block", "train"),
    ])
    return long, found


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines log: schema header lines and lines that do not parse are left out."""
    df = spark.read.schema(schema + ", record_type string, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return df.where("_corrupt_record is null and coalesce(record_type, '') <> 'schema'").drop("_corrupt_record", "record_type")


def real_samples(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stems with all of .png, .gt.json and .txt (column path), and an issue for each missing companion."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.when(name.endswith(".gt.json"), "gt").when(name.endswith(".png"), "png").when(name.endswith(".txt"), "txt")
    stems = files.select(F.regexp_replace(name, r"\.(gt\.json|png|txt)$", "").alias("stem"), kind.alias("k"), "path").where("k is not null")
    wide = stems.groupBy("stem").pivot("k", ["png", "gt", "txt"]).agg(F.first("path"))
    lack = [(F.col("png").isNotNull() & F.col(k).isNull(), "missing_companion", k) for k in ("gt", "txt")]
    return wide.where("png is not null and gt is not null and txt is not null"), issues(wide, F.col("stem"), lack, "warning")


def box_lines(spark: SparkSession, path: str) -> DataFrame:
    """path and whole text of box-label files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("text"))


def bucketed_box_lines(spark: SparkSession, path: str) -> DataFrame:
    """scene_id as path, and text, of what sinks.write_box_lines wrote."""
    return spark.read.parquet(path).select(F.col("scene_id").cast("string").alias("path"), "text")


def boxes(files: DataFrame, size: float = 512.0) -> DataFrame:
    """Boxes in pixels from box-label texts whose lines are good."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("path", "line_no", F.split(F.trim("line"), r"\s+").alias("f")).where(F.size("f") == 5)
    n = lambda i: F.get("f", i).try_cast("double")
    half = lambda i: n(i) / 2
    return lines.select("path", "line_no", F.get("f", 0).try_cast("int").alias("class_id"), ((n(1) - half(3)) * size).alias("x0"), ((n(2) - half(4)) * size).alias("y0"), ((n(1) + half(3)) * size).alias("x1"), ((n(2) + half(4)) * size).alias("y1"))


def manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A CSV manifest with a header; a header that does not fit the schema fails."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def run_registry(spark: SparkSession, index: str, labels: str | None = None, multi_line: bool = True) -> DataFrame:
    """One row for each run of an index file (or of its lines), with its label where a label file (run_id, label lines) is given."""
    runs = spark.read.schema(RUN_INDEX).option("multiLine", multi_line).json(index).select(F.explode("runs").alias("r")).select("r.*")
    runs = runs.withColumn("created_utc", F.to_timestamp("created_utc", "yyyyMMdd'T'HHmmss'Z'"))
    return runs if labels is None else runs.join(spark.read.schema("run_id string, label string").json(labels), "run_id", "left")


# Fixed value: where pages carry their data.
DATA_SCRIPT = r'(?s)<script type="grading/init-data">(.*?)</script>'


def embedded_data(pages: DataFrame, html_col: str = "html", pattern: str = DATA_SCRIPT) -> DataFrame:
    """Pages with data: the JSON of their data script as VARIANT; null where there is no script or its JSON is broken.

    ``data_issue`` says which: no_script, bad_json, or null. A column of either name is replaced.
    """
    body = F.nullif(F.regexp_extract(html_col, pattern, 1), F.lit(""))
    out = pages.withColumn("__body", body).withColumn("data", F.try_parse_json("__body"))
    return out.withColumn("data_issue", F.when(F.col("__body").isNull(), "no_script").when(F.col("data").isNull(), "bad_json")).drop("__body")


def answer_block(data: Column) -> Column:
    """The first object ``ans`` over all interactions of all elements of a page's view, as VARIANT; null without one."""
    elements = F.try_variant_get(data, "$.view.elements", "array<variant>")
    interactions = F.flatten(F.array_compact(F.transform(elements, lambda e: F.try_variant_get(e, "$.interactions", "array<variant>"))))
    blocks = F.transform(interactions, lambda i: F.try_variant_get(i, "$.ans", "variant"))
    return F.get(F.filter(blocks, lambda x: F.schema_of_variant(x).startswith("OBJECT")), 0)


def solution_tokens(pages: DataFrame, key: str, data: str = "data") -> DataFrame:
    """key, pos, and a column for each field of the tokens in the first interaction's worked solution.

    A page without a solution, and one whose solution is empty, give no rows. A field of another type than expected is null.
    """
    listed = F.try_variant_get(data, "$.view.elements[0].interactions[0].solution", "array<variant>")
    rows = pages.select(key, F.posexplode(listed).alias("pos", "v"))
    get = lambda f, kind: F.try_variant_get("v", f"$.{f}", kind).alias(f)
    return rows.select(key, "pos", get("id", "string"), get("c", "string"), get("x", "int"), get("y", "int"), get("type", "string"), get("tags", "array<string>"))


def page_facts(pages: DataFrame) -> DataFrame:
    """page_id, lang, title and the argument of the tracking call in each page's script."""
    get = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return pages.select("page_id", get(r'<html lang="([a-z]+)"').alias("lang"), get(r"<title>([^<]*)</title>").alias("title"), get(r"track\(([0-9]+)\)").cast("long").alias("track_id"))


def prompt_text(html: Column) -> Column:
    """Plain text of a prompt: tags out, blanks joined, cut at the first colon."""
    text = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))
    return F.substring_index(text, ":", 1)
