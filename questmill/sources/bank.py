"""Reading question banks, papers and listings; writing them back by key. Files are listed and read by Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import paper_id, session_name
from ..operators.match import anti_any
from ..operators.merge import replace_by


def scan_papers(spark: SparkSession, path: str, unit_patterns: list[str], pattern: str = "*.pdf", content: bool = True) -> DataFrame:
    """One row per paper file under ``path``: role (qp, ms), unit number, variant, year, session, and a hash of the bytes.

    ``unit_patterns`` are tried in order on the lower-case file name; group 1 is the unit number, group 2 a variant letter. The
    series is the folder name with a year in it, at any depth.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    parts = F.split(F.url_decode("path"), "/")
    name = F.lower(F.element_at(parts, -1))
    series = F.coalesce(F.element_at(F.filter(parts, lambda x: x.rlike(r"(^|\D)20\d\d(\D|$)")), -1), F.try_element_at(parts, F.lit(-2)))
    if not content:
        files = files.drop("content")
    digest = F.sha2("content", 256) if content else F.lit(None).cast("string")
    out = files.select("path", "length", name.alias("file"), series.alias("series"), digest.alias("hash"))
    return out.select("*", role(F.lower("path"), F.col("file")).alias("role"), *unit_and_variant(F.col("file"), unit_patterns), *year_and_session(F.col("series")))


def role(path: Column, file: Column) -> Column:
    """qp or ms by a folder that says so, else by the file name; null if neither says."""
    by_folder = F.when(path.rlike("question-?paper"), "qp").when(path.rlike("mark-?scheme"), "ms")
    by_name = F.when(file.rlike("que|[_-]qp"), "qp").when(file.rlike("[_-](rms|msc|ms)"), "ms")
    return F.coalesce(by_folder, by_name)


def unit_and_variant(file: Column, patterns: list[str]) -> list[Column]:
    unit = F.coalesce(*(F.nullif(F.regexp_extract(file, p, 1), F.lit("")) for p in patterns)).try_cast("int")
    letter = F.coalesce(*(F.when(F.regexp_extract(file, p, 1) != "", F.regexp_extract(file, p, 2)) for p in patterns), F.lit(""))
    return [unit.alias("unit_num"), F.when(file.contains("unused"), "UNUSED").otherwise(F.upper(letter)).alias("variant")]


def year_and_session(series: Column) -> list[Column]:
    """2025 and June where a folder does not tell."""
    sample = F.lower(F.trim(series)).startswith("sample")
    year = F.when(sample, 2025).otherwise(F.coalesce(F.regexp_extract(series, r"(?:^|\D)(20\d\d)(?:\D|$)", 1).try_cast("int"), F.lit(2025)))
    rest = F.trim(F.regexp_replace(series, r"20\d\d", ""))
    return [year.alias("year"), F.when(sample | (rest == ""), "June").otherwise(session_name(rest)).alias("session")]


def pair_papers(files: DataFrame, fall_back_to_base: bool = False) -> DataFrame:
    """Question papers with their mark schemes, by series, unit and variant; unpaired papers are left out.

    Files with the same bytes in a folder count once, the base variant first. With ``fall_back_to_base`` a variant without a mark
    scheme of its own takes the base one's.
    """
    same = Window.partitionBy("series", "role", F.coalesce("hash", "path")).orderBy("unit_num", F.col("variant") != "", "path")
    files = files.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    keys = ["series", "unit_num", "variant"]
    qp = files.where("role = 'qp'").select(*keys, "year", "session", F.col("path").alias("que_path"), F.col("hash").alias("que_hash"))
    ms = files.where("role = 'ms'").groupBy(*keys).agg(F.min("path").alias("rms_path"))
    out = qp.join(ms, keys, "left")
    if fall_back_to_base:
        base = ms.where("variant = ''").select("series", "unit_num", F.col("rms_path").alias("base_path"))
        out = out.join(base, ["series", "unit_num"], "left").withColumn("rms_path", F.coalesce("rms_path", "base_path")).drop("base_path")
    return out.where("rms_path is not null").withColumn("paper_id", paper_id(F.concat(F.lit("unit"), F.col("unit_num").cast("string")), F.col("variant"), F.col("year"), F.col("session")))


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A bank stored as JSON arrays of objects, under a fixed schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table, or none of its rows where it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def first_existing(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """The first of several places that holds a table."""
    for path in paths:
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)


def latest_of_many(spark: SparkSession, glob: str, schema: StructType, key: str) -> DataFrame:
    """Union of many JSON files; of a key in several, the one in the file with the last name wins."""
    rows = spark.read.schema(schema).json(glob, multiLine=True).select("*", F.input_file_name().alias("__file"))
    values = [c for c in rows.columns if c not in (key, "__file")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "__file").alias("v")).select(key, "v.*")


def cached_pages(pages: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Pages whose analysis is cached, and those without: the key is a hash of paper, page and version."""
    keyed = pages.withColumn("key", F.sha2(F.concat_ws("_", "paper_id", F.lit(version), F.col("page").cast("string")), 256))
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti")


def list_assets(spark: SparkSession, path: str, pattern: str = "*", under: str = r"(crops_[a-z]+/.*)$") -> DataFrame:
    """(key, path, size) of asset files, one a key; the key is what ``under`` finds in the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("size"))
    keyed = files.withColumn("key", F.regexp_extract("path", under, 1)).where("key <> ''")
    return keyed.groupBy("key").agg(F.min(F.struct("path", "size")).alias("v")).select("key", "v.*")


def upload_plan(local: DataFrame, remote: DataFrame, force: bool = False) -> DataFrame:
    """Local assets that the remote side lacks or has at another size."""
    return local if force else local.join(remote.select("key", "size"), ["key", "size"], "left_anti")


def orphans(listing: DataFrame, used: DataFrame, key: str = "key") -> DataFrame:
    """Listed files that nothing refers to; a list to look at, nothing is deleted."""
    return listing.join(used.select(key).distinct(), key, "left_anti")


def unfinished(papers: DataFrame, manifest: DataFrame, bank: DataFrame) -> DataFrame:
    """Papers still to process: not completed under their id, content hash or path, or completed but absent from the bank."""
    done = manifest.where("status = 'completed'").join(bank.select("paper_id").distinct(), "paper_id", "left_semi")
    return anti_any(papers, done.select("paper_id", "que_hash", "que_path"), [["paper_id"], ["que_hash"], ["que_path"]])


def write_bank(bank: DataFrame, path: str, by: tuple[str, ...] = ("subject", "unit_code")) -> None:
    """Replace the partitions that occur in ``bank``; others stay."""
    bank.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def manifest_rows(bank: DataFrame) -> DataFrame:
    """What a manifest would say of the questions at hand: ids and counts of each paper."""
    return bank.groupBy("paper_id").agg(F.count(F.lit(1)).cast("int").alias("question_count"), F.array_sort(F.collect_list("id")).alias("question_ids")).withColumn("status", F.lit("completed"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], path: str) -> None:
    """Write old rows without the new ones' keys, and the new ones, to a new folder."""
    replace_by(old, new, keys).write.mode("errorifexists").parquet(path)


def send_in_batches(rows: DataFrame, send: Callable[[list], None], size: int = 50) -> None:
    """Hand rows to ``send`` in lists of at most ``size``, on the executors."""

    def partition(it) -> None:
        batch: list = []
        for row in it:
            batch.append(row.asDict(recursive=True))
            if len(batch) == size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    rows.foreachPartition(partition)
