"""Projects on disk or in any store that Spark reads: files, packages, environment files, API routes, configuration."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths as P

SOURCE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
IGNORED = r"(^|/)(node_modules|\.next|\.git|dist|build|coverage|out)/"
SENSITIVE = r"(?i)(key|secret|token|password|private|auth|credential)"
def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (below root), content, ext of the text files of a tree; folders of dependencies and builds are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    full = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    inside = F.regexp_replace(full, "^" + re.escape(root.split("://")[-1].rstrip("/")) + "/?", "")
    rows = raw.select(inside.alias("path"), F.decode("content", "UTF-8").alias("content"))
    if glob == "*":
        rows = rows.union(environment_files(spark, root))
    return rows.where(~F.col("path").rlike(IGNORED)).withColumn("ext", P.extension(F.col("path"))).dropDuplicates(["path"])


def environment_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content of the .env files at the root. Spark's readers pass over names with a leading dot, so these few are read by the
    file system's own interface."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/.env*")
    fs = pattern.getFileSystem(conf)
    found = []
    for status in fs.globStatus(pattern) or []:
        stream = fs.open(status.getPath())
        found.append((status.getPath().getName(), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        stream.close()
    return spark.createDataFrame(found, "path string, content string")


def sources(all_files: DataFrame) -> DataFrame:
    """Source files that are no tests."""
    return all_files.where(P.extension(F.col("path")).isin(*SOURCE_EXTENSIONS) & ~F.col("path").rlike(r"\.(test|spec)\.[jt]sx?$|(^|/)__tests__/"))


def packages(all_files: DataFrame) -> DataFrame:
    """path, name, version, dev: the dependencies that package files declare."""
    own = all_files.where(P.basename(F.col("path")) == "package.json")
    kind = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"
    parsed = own.select("path", F.from_json("content", kind).alias("p"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    entry = lambda column, dev: parsed.select("path", F.explode(F.coalesce(column, none)).alias("name", "version"), F.lit(dev).alias("dev"))
    return entry("p.dependencies", False).union(entry("p.devDependencies", True))


def package_category(name: Column) -> Column:
    return (
        F.when(name.rlike(r"^(react|react-dom|next|vue|svelte)$|^@(remix-run|angular)/"), "framework").when(name.rlike(r"redux|zustand|jotai|recoil|mobx|query|swr"), "state")
        .when(name.rlike(r"jest|vitest|mocha|cypress|playwright|testing-library"), "testing").when(name.rlike(r"eslint|prettier|typescript|webpack|vite|babel|^@types/"), "tooling")
        .when(name.rlike(r"auth|jwt|bcrypt|crypto|passport"), "security").when(name.rlike(r"prisma|mongoose|pg|mysql|knex|sequelize"), "database")
        .when(name.rlike(r"tailwind|styled|emotion|sass|mui|chakra|radix"), "ui").otherwise("other")
    )


def project_type(declared: DataFrame) -> DataFrame:
    """One row: framework, version, router ('app' from Next 13.4 on)."""
    version = F.max(F.when(F.col("name") == "next", F.col("version")))
    react = F.max(F.when(F.col("name") == "react", F.col("version")))
    row = declared.agg(version.alias("next"), react.alias("react"))
    major, minor = (F.coalesce(F.regexp_extract("next", r"(\d+)\.(\d+)", i).try_cast("int"), F.lit(0)) for i in (1, 2))
    app = (major > 13) | ((major == 13) & (minor >= 4))
    return row.select(
        F.when(F.col("next").isNotNull(), "next").when(F.col("react").isNotNull(), "react").otherwise("unknown").alias("framework"), F.coalesce("next", "react").alias("version"),
        F.when(F.col("next").isNotNull(), F.when(app, "app").otherwise("pages")).alias("router"),
    )


def environment(all_files: DataFrame) -> DataFrame:
    """path, name, sensitive: variables of environment files, without their values."""
    own = all_files.where(P.basename(F.col("path")).rlike(r"^\.env(\.|$)"))
    lines = own.select("path", F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").contains("=") & ~F.btrim("line").startswith("#"))
    name = F.btrim(F.substring_index("line", "=", 1))
    return lines.select("path", name.alias("name"), name.rlike(SENSITIVE).alias("sensitive"))
