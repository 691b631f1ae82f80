"""Record stores: one JSON document a record, append-only logs, snapshots and series files.

Writes commit by publishing the number of a finished version folder, so readers see the old table or
the new one.  All paths may lie on any file system Spark can reach.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.text import iso_date
from loomwright.functions.urls import absolute, normalize_url


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON files, one record in each, under an explicit schema; a missing folder is an empty table.

    ``_stem`` is the file's name without extension, ``_broken`` the text of a file that is no JSON.
    A byte order mark at the start of a file is left out by the reader.
    """
    full = f"{schema}, _broken string"
    if not exists(spark, path):
        return spark.createDataFrame([], full).withColumn("_stem", F.lit("").cast("string"))
    read = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "*.json").json(path)
    return read.withColumn("_stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of one JSON file; only a missing file is an empty table, a broken one is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """Rows of (stem, body) as one file each, named after the stem.

    Each task writes the files of its rows through the file system the path lies on, as whole files; a
    task that runs again replaces them.  For stores of single documents; tables go to Parquet.
    """
    local = path.removeprefix("file://").removeprefix("file:")
    if "://" in local:
        raise ValueError("documents can be written where executors mount the folder; use a table elsewhere")

    def run(batches):
        import os

        import pyarrow as pa

        os.makedirs(local, exist_ok=True)
        for batch in batches:
            for stem, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                staged = os.path.join(local, f".{stem}.{uuid.uuid4().hex}")
                with open(staged, "w", encoding="utf-8") as out:
                    out.write(body)
                os.replace(staged, os.path.join(local, f"{stem}.json"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("stem", "body").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON lines; a missing path is an empty table."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_lines(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    rows.write.mode("append").json(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions of a table."""
    fs, marks = _fs(spark, f"{path.rstrip('/')}/published")
    return sorted(int(m.getPath().getName()) for m in fs.listStatus(marks)) if fs.exists(marks) else []


def write_snapshot(rows: DataFrame, path: str, form: str = "parquet", keep: int = 2) -> str:
    """Replaces a table: writes a version folder of its own, then publishes its number; returns the folder.

    Publishing creates one empty file, which a file system does at once or not at all, so readers find
    the old version or the new one at any time, and a write that fails leaves the old one.  Two writers
    cannot publish one number: the later one fails.  The last ``keep`` versions stay for readers that
    have begun with them.
    """
    spark = rows.sparkSession
    root = path.rstrip("/")
    done = _versions(spark, root)
    number = done[-1] + 1 if done else 1
    folder = f"{root}/version-{number}-{uuid.uuid4().hex}"
    rows.write.format(form).mode("errorifexists").save(folder)
    fs, _ = _fs(spark, root)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    target = path_of(f"{root}/published/{number}")
    out = fs.create(target, False)
    out.write(bytearray(folder.rsplit("/", 1)[1].encode()))
    out.close()
    for old in done[: len(done) + 1 - keep] if keep else []:
        fs.delete(path_of(f"{root}/{_name(spark, root, old)}"), True)
        fs.delete(path_of(f"{root}/published/{old}"), False)
    return folder


def _name(spark: SparkSession, root: str, number: int) -> str:
    return spark.read.text(f"{root}/published/{number}").first()[0]


def read_snapshot(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """The published version of a table; an empty table where none was published yet."""
    root, done = path.rstrip("/"), _versions(spark, path)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.format(form).schema(schema).load(f"{root}/{_name(spark, root, done[-1])}")


class RunLock:
    """One run at a time on a store: a file that only one of several writers can create.

    The holder deletes it at the end, also of a failed run.  A run that died leaves the file; it names
    its holder, and ``force`` takes it over.
    """

    def __init__(self, spark: SparkSession, path: str, holder: str = "run", force: bool = False):
        self.spark, self.path, self.holder, self.force = spark, f"{path.rstrip('/')}/.lock", holder, force

    def __enter__(self) -> RunLock:
        fs, target = _fs(self.spark, self.path)
        if self.force:
            fs.delete(target, False)
        try:
            out = fs.create(target, False)
        except Exception as problem:
            raise RuntimeError(f"another run holds {self.path}") from problem
        out.write(bytearray(self.holder.encode()))
        out.close()
        return self

    def __exit__(self, *_) -> None:
        fs, target = _fs(self.spark, self.path)
        fs.delete(target, False)


def overlay(base: DataFrame, update: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the update, and those rows of the base whose key the update does not have."""
    return base.join(update.select(*key).distinct(), key, "left_anti").unionByName(update)


def slim_index(documents: DataFrame) -> DataFrame:
    """The six columns of the index, by id."""
    return documents.select("id", "url", "title", "column_ids", "list_date", "content_status").orderBy("id")


def series(spark: SparkSession, path: str, point: str) -> DataFrame:
    """The points of a curated series file: an object with an array ``series`` of ``point`` structs; a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], point.replace(":", " "))
    return spark.read.schema(f"series array<struct<{point}>>").option("multiLine", True).json(path).select(F.inline("series"))


def json_list(pages: DataFrame, body: str, url: str) -> DataFrame:
    """(page, link, title, list_date, list_date_raw) of list pages that are JSON with a ``datasource`` array.

    Titles lose their markup; without a link of its own an entry takes the first one in its title.
    Links come out absolute and in their canonical form; entries without a public one are left out.
    """
    item = "array<struct<publishUrl:string,showTitle:string,title:string,publishTime:string>>"
    rows = pages.select(url, F.explode(F.from_json(body, f"datasource {item}")["datasource"]).alias("e"))
    shown = F.coalesce(F.nullif(F.col("e.showTitle"), F.lit("")), F.col("e.title"), F.lit(""))
    inner = F.nullif(F.regexp_extract(shown, r"href\s*=\s*[\"']([^\"']+)", 1), F.lit(""))
    bare = F.regexp_replace(shown, "<[^>]+>", "")
    given = F.coalesce(F.nullif(F.col("e.publishUrl"), F.lit("")), inner)
    raw = F.col("e.publishTime")
    return rows.select(url, normalize_url(absolute(F.col(url), given)).alias("link"), unescaped(bare).alias("title"), iso_date(raw).alias("list_date"), raw.alias("list_date_raw")).where("link IS NOT NULL")


def unescaped(col: Column) -> Column:
    """The five predefined entities and the no-break space as characters."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def encoded(text: Column, charset: str) -> Column:
    """Text as bytes of a charset Spark does not know, in Arrow batches."""
    @F.pandas_udf("binary")
    def one(s):
        return s.map(lambda x: x.encode(charset), na_action="ignore")

    return one(text)


def decoded(content: Column, declared: Column) -> Column:
    """Bytes as text: the declared charset if it is UTF-8 or a Chinese one and fits, else UTF-8 if valid, else GB18030; null if nothing fits."""
    import codecs

    @F.pandas_udf("string")
    def sniff(bodies, names):
        def one(body, name):
            if body is None:
                return None
            tried = [name] if name else []
            for charset in [*tried, "utf-8", "gb18030"]:
                try:
                    return codecs.decode(bytes(body), charset)
                except (LookupError, UnicodeDecodeError):
                    continue
            return None

        return bodies.combine(names, one)

    charset = F.nullif(F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1)), F.lit(""))
    plain = F.try_validate_utf8(F.decode(F.when(F.is_valid_utf8(content.cast("string")), content), "UTF-8"))
    return F.when((charset.isNull() | charset.isin("utf-8", "utf8")) & plain.isNotNull(), plain).otherwise(sniff(content, charset))
