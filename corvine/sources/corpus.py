"""Corpus and golden-set sources. Inventory 1-9."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from corvine.functions import text

EXTENSIONS = (".md", ".markdown", ".txt")
HIDDEN = frozenset({".*", "*/.*", "**/.*"})


class CorpusError(RuntimeError):
    """The corpus root is missing."""


class GoldenError(ValueError):
    """A golden record is malformed."""


def excluded(path: Column, patterns: Sequence[str]) -> Column:
    """Shell patterns over the path, with or without a leading slash; those for hidden files hold at any depth."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(fnmatch.translate(p).replace(r"\Z", r"\z")) | F.concat(F.lit("/"), path).rlike(fnmatch.translate(p).replace(r"\Z", r"\z"))
        if p in HIDDEN:
            out = out | F.exists(F.split(path, "/"), lambda part: part.startswith("."))
    return out


def front_matter(raw: str) -> tuple[dict, str]:
    """YAML between ``---`` lines at the top, and the body; malformed YAML leaves the text as it is."""
    lines = raw.splitlines(keepends=True)
    if not raw.startswith("---"):
        return {}, raw
    end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
    if end is None:
        return {}, raw
    body = "".join(lines[end + 1 :])
    try:
        import yaml
    except ImportError:
        return _plain_header(lines[1:end]), body
    try:
        found = yaml.safe_load("".join(lines[1:end]))
    except yaml.YAMLError:
        return {}, raw
    return (found, body) if isinstance(found, dict) else ({}, body)


def _plain_header(lines: list[str]) -> dict:
    """``key: value``, ``key: [a, b]`` and ``- item`` lines, where no YAML reader is installed."""
    out: dict = {}
    key = None
    for line in lines:
        bare = line.strip()
        if bare.startswith("- ") and key is not None:
            out[key] = [*(out[key] if isinstance(out[key], list) else []), bare[2:].strip().strip("'\"")]
        elif ":" in bare:
            key, _, value = (x.strip() for x in bare.partition(":"))
            listed = value.startswith("[") and value.endswith("]")
            out[key] = [v.strip().strip("'\"") for v in value[1:-1].split(",") if v.strip()] if listed else value.strip("'\"") or None
    return out


@F.arrow_udf(StructType([StructField("title", StringType()), StructField("tags", ArrayType(StringType())), StructField("body", StringType())]))
def parse_page(raw: pa.Array) -> pa.Array:
    rows = []
    for r in raw.to_pylist():
        meta, body = front_matter(r or "")
        title, tags = meta.get("title"), meta.get("tags")
        named = str(title).strip() if title else None
        parts = tags.split(",") if isinstance(tags, str) else tags if isinstance(tags, list | tuple) else []
        rows.append({"title": named or None, "tags": [t for x in parts if (t := str(x).strip())], "body": body})
    return pa.array(rows, pa.struct([("title", pa.string()), ("tags", pa.list_(pa.string())), ("body", pa.string())]))


def documents_from_files(files: DataFrame) -> DataFrame:
    """files(path relative to the root, value whole text) -> source_path, text, title, source, tags; empty ones go."""
    stem = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    page = files.withColumn("source_path", text.normal_path(F.col("path"))).withColumn("page", parse_page("value"))
    body = F.col("page.body")
    title = F.coalesce("page.title", text.first_h1(body), stem)
    out = page.select("source_path", text.strip(body).alias("text"), title.alias("title"), text.source_of(F.col("source_path")).alias("source"), F.col("page.tags").alias("tags"))
    return out.where("text <> ''")


def read_corpus(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS, exclude: Sequence[str] = ()) -> DataFrame:
    """Every ingestible text file under ``root``; nothing but Spark's readers touches the path."""
    base = root.rstrip("/")
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    except AnalysisException as e:
        raise CorpusError(f"no corpus at {root}") from e
    jvm = spark.sparkContext._jvm
    full = jvm.org.apache.hadoop.fs.Path(base)
    fs = full.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(full) or not fs.getFileStatus(full).isDirectory():
        raise CorpusError(f"no corpus directory at {root}")
    prefix = fs.makeQualified(full).toUri().getPath() + "/"
    path = F.col("path")
    at = F.instr(path, prefix)
    files = files.select(F.substr(path, at + len(prefix)).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("value"))
    dot = F.regexp_extract(F.lower("path"), r"[^/](\.[^./]+)$", 1)
    wanted = dot.isin([e.lower() for e in extensions]) & ~excluded(text.normal_path(F.col("path")), exclude)
    return documents_from_files(files.where(wanted))


GOLDEN = "id string, question string, expected_source_paths array<string>, category string, answerable boolean, notes string, filters map<string,string>, rare_token string"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases from JSON lines; blank lines and lines that start with # are skipped, malformed ones are an error."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id() + 1).where(~F.col("value").rlike(r"^\s*(#|$)"))
    rows = lines.select("line", F.from_json("value", GOLDEN, {"mode": "PERMISSIVE"}).alias("r")).select("line", "r.*")
    bad = rows.where(F.coalesce(F.col("id"), F.lit("")).eqNullSafe("") | F.coalesce(text.strip(F.col("question")), F.lit("")).eqNullSafe("") | F.col("expected_source_paths").isNull())
    first = bad.orderBy("line").select("line", "id").first()
    if first:
        raise GoldenError(f"golden line {first['line']}: id, question and expected_source_paths are needed")
    return rows.drop("line").withColumn("expected_source_paths", F.transform("expected_source_paths", text.normal_path))


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """id, target_rank, mode from a rank fixture."""
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "items map<string,struct<target_rank:string,mode:string>>")["items"]
    return whole.select(F.explode(items).alias("id", "x")).select("id", F.col("x.target_rank").try_cast("int").alias("target_rank"), "x.mode")
