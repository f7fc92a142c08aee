"""Readers and writers: source files, seeds, name lists; modules, symbols, rename maps and reports."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.identifiers import strip_shebang
from factloom.operators import text as texts
from factloom.plans.scratch import bound_batches


def read_sources(spark: SparkSession, path: str, glob: str = "*.{js,mjs,cjs}") -> DataFrame:
    """key (the path), text of all files below ``path``, or of one file; a first line with ``#!`` goes."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("key"), strip_shebang(F.col("value")).alias("text"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """mangled, semantic of a JSON object; a file that is no such object gives no rows."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("mangled", "semantic"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """name, ordinal of a JSON array of strings."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("ordinal", "name")).select("name", "ordinal")


def rename_json(renames: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """key, json: ``{total, map}`` of each source, with ``stats`` where given."""
    pairs = F.array_sort(F.collect_list(F.struct("mangled", "semantic")))
    maps = renames.groupBy("key").agg(F.count("*").alias("total"), F.map_from_entries(pairs).alias("map"))
    if stats is None:
        return maps.select("key", F.to_json(F.struct("total", "map")).alias("json"))
    told = stats.select("key", F.struct(*(c for c in stats.columns if c != "key")).alias("stats"))
    return maps.join(told, "key").select("key", F.to_json(F.struct("total", "stats", "map")).alias("json"))


def report(sources: DataFrame, renames: DataFrame, modules: DataFrame, symbols: DataFrame, tool: str = "factloom", version: str = "", passes: list[str] = (), began: datetime | None = None) -> DataFrame:
    """One row for each source: lines, renamed, modules, bundler, symbols; tool, version, passes and times of the run."""
    from factloom.functions.identifiers import detect_format, line_count

    found = sources.select("key", line_count(F.col("text")).alias("lines"), detect_format(F.col("text")).alias("bundler"))
    for name, part in (("renamed", renames), ("modules", modules), ("symbols", symbols)):
        found = found.join(part.groupBy("key").agg(F.count("*").alias(name)), "key", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    now = datetime.now(timezone.utc)
    began = began or now
    told = {"tool": tool, "version": version, "started_at": began.isoformat(), "completed_at": now.isoformat(), "duration_ms": int((now - began).total_seconds() * 1000)}
    return found.withColumns({k: F.lit(v) for k, v in told.items()} | {"passes": F.array(*map(F.lit, passes)).cast("array<string>")})


def report_json(reports: DataFrame) -> DataFrame:
    """key, json: each source's report as one object, counts under ``stats``."""
    counts = F.struct("lines", "renamed", "modules", "bundler", "symbols").alias("stats")
    whole = F.struct(F.col("key").alias("input"), "tool", "version", F.col("started_at").alias("startedAt"), F.col("completed_at").alias("completedAt"), "passes", counts, F.col("duration_ms").alias("durationMs"))
    return reports.select("key", F.to_json(whole).alias("json"))


def summary(reports: DataFrame, stats: DataFrame) -> str:
    """A few lines of counts over all sources, for the console."""
    r = reports.agg(F.count("*").alias("sources"), F.sum("lines").alias("lines"), F.sum("renamed").alias("renamed"), F.sum("modules").alias("modules"), F.sum("symbols").alias("symbols"), F.max("duration_ms").alias("ms")).first()
    origins = ("static", "late", "seed", "llm", "graph", "uncertain")
    s = stats.agg(*(F.sum(c).alias(c) for c in origins)).first()
    named = " ".join(f"{c}:{s[c] or 0}" for c in origins)
    return f"{r['sources']} sources, {r['lines'] or 0} lines in {(r['ms'] or 0) / 1000:.1f} s\n{r['renamed'] or 0} renames [{named}]\n{r['modules'] or 0} modules, {r['symbols'] or 0} symbols"


def last_modules(modules: DataFrame) -> DataFrame:
    """Of modules of one name the last stays, as files of one name would."""
    last = F.max(F.struct("ordinal", "code"))
    return modules.groupBy("key", "name").agg(last.alias("b")).select("key", "name", "b.ordinal", "b.code")


def documents(renamed: DataFrame, maps: DataFrame, modules: DataFrame, index: DataFrame, reports: DataFrame) -> DataFrame:
    """path, content of the files of a run, below a folder named after each source."""
    stem = F.regexp_replace(F.element_at(F.split("key", "/"), -1), r"\.[^.]*$", "")
    each = [
        renamed.select(F.concat(stem, F.lit("/"), stem, F.lit(".renamed.js")).alias("path"), F.col("text").alias("content")),
        maps.select(F.concat(stem, F.lit("/"), stem, F.lit(".rename-map.json")).alias("path"), F.col("json").alias("content")),
        modules.select(F.concat(stem, F.lit("/modules/"), F.regexp_replace("name", r"[^A-Za-z0-9_.$-]", "_"), F.when(F.col("name").endswith(".js"), "").otherwise(".js")).alias("path"), F.col("code").alias("content")),
        index.select(F.concat(stem, F.lit("/symbols.json")).alias("path"), F.col("json").alias("content")),
        index.select(F.concat(stem, F.lit("/symbols.md")).alias("path"), F.col("markdown").alias("content")),
        reports.select(F.concat(stem, F.lit("/report.json")).alias("path"), F.col("json").alias("content")),
    ]
    found = each[0]
    for more in each[1:]:
        found = found.unionByName(more)
    return found


def write_files(docs: DataFrame, out: str) -> None:
    """Each row (path, content) as one file below ``out``, a folder that executors and driver share.

    Files are written by the tasks, first under a name of the attempt and then
    renamed, so that a task that runs again leaves one whole file.
    """
    import uuid

    def run(frames):
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(out) if "://" in out else (pafs.LocalFileSystem(), out)
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                whole = f"{root}/{path}"
                fs.create_dir(whole.rsplit("/", 1)[0], recursive=True)
                part = f"{whole}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write((content or "").encode())
                fs.move(part, whole)
            yield frame[["path"]]

    bound_batches(docs.sparkSession)
    docs.select("path", "content").mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """name, context, ordinal of JSON arrays of names to ask about, each with its contexts or none."""
    raw = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<struct<name:string,context:array<string>>>")
    return raw.select(F.posexplode(items).alias("ordinal", "i")).select("i.name", F.coalesce("i.context", F.array().cast("array<string>")).alias("context"), "ordinal")


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """key, value of JSON objects of names that are given already; of several files for one key the smallest value."""
    return read_seeds(spark, path).groupBy(F.col("mangled").alias("key")).agg(F.min("semantic").alias("value"))


def read_property_rules(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """(property, type, score) of a JSON object ``{property: [type, score]}``: a table of rules, whose size the caller answers for."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("p", "told")).orderBy("p").collect()
    return [(r["p"], r["told"][0], int(r["told"][1])) for r in rows]


def names_json(names: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """json: one object of all names, for exchange."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return names.agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def batch_json(batched: DataFrame) -> DataFrame:
    """batch, json: each batch of (batch, name, context) as an array."""
    items = F.array_sort(F.collect_list(F.struct("name", "context")))
    return batched.groupBy("batch").agg(F.to_json(items).alias("json"))


def add_seeds(seeds: DataFrame, more: DataFrame) -> DataFrame:
    """Seeds (mangled, semantic) with those names of ``more`` (key, value) that they lack."""
    new = more.select(F.col("key").alias("mangled"), F.col("value").alias("semantic")).join(seeds.select("mangled"), "mangled", "left_anti")
    return seeds.select("mangled", "semantic").unionByName(new)


def write_outputs(out: str, **tables: DataFrame) -> None:
    """Each table as Parquet in a folder of its name below ``out``."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")


def symbol_documents(symbols: DataFrame) -> DataFrame:
    """key, json, markdown: the symbol index of each source."""
    return texts.symbols_json(symbols, "key", "ordinal").join(texts.markdown_table(symbols, "key", "ordinal"), "key")
