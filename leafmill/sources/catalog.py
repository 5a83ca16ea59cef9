"""Catalogs: a row for each file, with repo_id, relative_path, filename, extension, size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import paths

#: Documents of one repository: 11 directories times 7 names tell them apart.
REPO_FILES = 77


def from_paths(files: DataFrame) -> DataFrame:
    """Adds filename and extension to (repo_id, relative_path, size, ...)."""
    out = files.withColumn("filename", paths.filename(F.col("relative_path")))
    return out.withColumn("extension", paths.extension(F.col("filename")))


def document_path() -> Column:
    """A made-up path of a document, by its id."""
    i = F.col("doc_id")
    dirs = ["", "docs/", "docs/guide/", "web/node_modules/pkg/", ".github/", "Build/site/", ".hidden/", "a/", "a-b/", "/".join(f"d{k}" for k in range(1, 11)) + "/"]
    folder = F.coalesce(F.get(F.array(*map(F.lit, dirs)), (i % 11).cast("int")), F.concat(F.col("source"), F.lit("/")))
    name = (
        F.when(i % 7 == 0, F.lit("README"))
        .when(i % 7 == 1, F.concat(F.lit("guide_"), i % 20, F.lit(".md")))
        .when(i % 7 == 2, F.concat(F.lit("NOTES_"), i, F.lit(".RST")))
        .when(i % 7 == 3, F.concat(F.lit("main_"), i, F.lit(".rs")))
        .when(i % 7 == 4, F.lit("LICENSE"))
        .when(i % 7 == 5, F.concat(F.col("lang"), F.lit(".txt")))
        .otherwise(F.concat(F.lit("page_"), i, F.lit(".tar.adoc")))
    )
    return F.concat(folder, name)


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as files of repositories; a text is a file's content."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.expr(f"doc_id div {REPO_FILES}").alias("repo_id"), document_path().alias("relative_path"), F.octet_length("text").cast("long").alias("size"))
    return from_paths(rows)


def repositories(catalog: DataFrame) -> DataFrame:
    """A dimension row for each repository of a catalog, where nothing else tells of it."""
    name = F.concat(F.lit("repo"), F.col("repo_id"))
    return catalog.select("repo_id").distinct().select(
        "repo_id", F.lit("owner").alias("owner"), name.alias("name"), F.concat(F.lit("https://github.com/owner/"), name).alias("url"),
        F.lit("main").alias("default_branch"), (F.col("repo_id") * 3 + 1).alias("total_commits"), F.lit(False).alias("is_empty"),
    )
