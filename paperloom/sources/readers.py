"""Scans.  Layout and file discovery are Spark's; every reader returns a lazy DataFrame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import vocab as v
from paperloom.functions.text import blank_to_null, clean_document_text, float_or_null, split_reference, strip
from paperloom.session import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal an input out before heavy per-row text work, unless its rows already lie in enough splits.

    A row group is read by one task, so a file of few large ones has most of its splits empty.  Rows are counted per split,
    which reads no column, and the input is dealt out when one split holds more than twice a core's share.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    splits, enough = df.rdd.getNumPartitions(), min(wanted, 64)
    if splits < enough:
        return df.repartition(wanted)
    rows = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return df.repartition(max(wanted, splits)) if (rows["most"] or 0) * enough > 2 * (rows["all"] or 0) else df


def distinct_rows(df: DataFrame, most: int = 500_000, by: list[str] | None = None) -> DataFrame:
    """The distinct rows of an input that repeats few of them.

    Rows are dealt out by their content before they are compared, ``most`` to a task on average, however large the input is.
    Otherwise every reading task keeps a table of nearly all its rows, and adaptive execution joins tasks by their packed size.
    Rows are counted from the files' footers.  ``by`` names columns of even values to deal by, so that a join on them that
    follows shuffles these rows no second time.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most))
    return df.repartition(parts, *(by or df.columns)).distinct()


def fewer_tasks(files: DataFrame, at_most: int = 32) -> DataFrame:
    """Small files as fewer, longer tasks, since every task needs a Python worker; up to ``at_most`` splits share one."""
    splits = files.rdd.getNumPartitions()
    wanted = max(16 * files.sparkSession.sparkContext.defaultParallelism, splits // at_most)
    return files.coalesce(wanted) if splits > wanted else files


# fixed values: encodings tried in turn; the third accepts every byte string
ENCODINGS = ("utf-8", "gbk", "latin1")


def _decode(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return None


@F.pandas_udf(T.StringType())
def decode_fallback(raw: pd.Series) -> pd.Series:
    """Bytes that are not UTF-8, decoded batch by batch."""
    return raw.map(_decode)


def decode_text(raw: Column) -> Column:
    """UTF-8 stays in the JVM; only other rows reach Python."""
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), decode_fallback(F.when(~F.is_valid_utf8(raw.cast("string")), raw)))


def scan_documents(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """Every ``.md`` and ``.txt`` file below a folder as one row; files without text are dropped."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{md,txt}")
        .load(path)
    )
    read = fewer_tasks(files).select(decode_text(F.col("content")).alias("_text"), *_file_columns(path))
    text = clean_document_text(F.col("_text")) if clean else F.col("_text")
    # a filter on a column would be tested below the projection that makes it, which decodes and cleans every text twice
    rows = read.select("*", F.posexplode_outer(F.array(text)).alias("_pos", "content"))
    kept = rows.filter(F.length(strip(F.col("content"))) > 0)
    return kept.select("content", *[c for c in read.columns if c != "_text"])


def _file_columns(root: str) -> list[Column]:
    path, name = F.col("path"), F.element_at(F.split("path", "/"), -1)
    below = F.substring_index(path, root.rstrip("/") + "/", -1)
    return [
        path.alias("source"),
        name.alias("filename"),
        F.col("length").alias("file_size"),
        F.concat(F.lit("."), F.substring_index(name, ".", -1)).alias("extension"),
        F.col("modificationTime").alias("modified"),
        below.alias("relative_path"),
    ]


def corpus_stats(df: DataFrame, text: str, kind: str) -> DataFrame:
    """Documents, characters and mean size, in total (NULL kind) and per kind."""
    return df.rollup(kind).agg(
        F.count("*").alias("total_documents"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("total_characters"),
        F.bround(F.avg(F.length(text)), 6).alias("avg_document_size"),
    )


def standard_questions(df: DataFrame) -> DataFrame:
    """Known header spellings become standard names; missing answer columns read 'N/A'; null questions go."""
    for target, spellings in v.QUESTION_HEADERS.items():
        present = [c for c in spellings if c in df.columns]
        if present and target not in df.columns:
            df = df.withColumnRenamed(present[0], target)
    if "question" not in df.columns:
        raise ValueError("a question column is required")
    for missing in ("expected_answer", "paper_reference"):
        if missing not in df.columns:
            df = df.withColumn(missing, F.lit("N/A"))
    return df.dropna(subset=["question"])


def _encoding(data: bytes) -> str:
    """The first of ``ENCODINGS`` that fits all bytes."""
    for name in ENCODINGS:
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    raise AssertionError("the last encoding fits all bytes")


@F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("header", T.StringType())]))
def _encoding_and_header(raw: pd.Series) -> pd.DataFrame:
    names = [_encoding(x) for x in raw]
    first = [(x.decode(n).splitlines() or [""])[0] for x, n in zip(raw, names)]
    return pd.DataFrame({"encoding": names, "header": first})


def question_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, header) of every file of questions; one encoding fits a file as a whole."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    return files.select("path", _encoding_and_header("content").alias("e")).select("path", "e.encoding", "e.header")


def load_questions(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Questions of one or many CSV files.

    Without a given encoding every file's own is found from its bytes.  Files in another one than UTF-8 are written anew in
    UTF-8, each as one file.  Files of one header are then read together, and the parts are united by the standard names of
    their columns.  One row per file reaches the driver.
    """
    def read(paths: str | list[str], **options: str) -> DataFrame:
        found = spark.read.options(header="true", multiLine="true", escape='"', **options).csv(paths)
        return standard_questions(found)

    if encoding:
        return read(path, encoding=encoding)
    groups: dict[tuple[bool, str], list[str]] = {}
    for r in question_files(spark, path).orderBy("path").collect():
        groups.setdefault((r["encoding"] == ENCODINGS[0], r["header"]), []).append(r["path"])
    if not groups:
        raise ValueError(f"no questions in {path}")
    out = None
    for (plain, _), paths in groups.items():
        if not plain:
            rows = spark.read.format("binaryFile").load(paths).select(decode_text(F.col("content")).alias("value"))
            paths = new_path(spark, "questions")
            rows.write.option("maxRecordsPerFile", 1).text(paths)
        part = read(paths)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_reference_parts(df: DataFrame) -> DataFrame:
    """Reference columns plus ``ground_truth``: the excerpt if there is one, else the expected answer."""
    parts = split_reference(F.col("paper_reference"))
    df = df.withColumn("_r", parts)
    return df.select(
        "*", "_r.*", F.coalesce(F.nullif(F.col("_r.excerpt"), F.lit("")), F.col("expected_answer")).alias("ground_truth")
    ).drop("_r")


def select_tests(df: DataFrame, how: str, key: str, n: int | None = None, seed: int = 0) -> DataFrame:
    """The first n by key, n in a seeded random order, or all."""
    if how == "all" or n is None:
        return df
    if how == "first_n":
        return df.orderBy(key).limit(n)
    if how == "random":
        return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)
    raise ValueError(f"unknown selection {how!r}")


KNOWLEDGE_SCHEMA = (
    "paper_id string, paper_title string, source_file string, knowledge_points array<struct<category string, "
    "content string, evidence string, complexity string, keywords array<string>>>, "
    "token_usage struct<prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, error string>, "
    "_corrupt_record string"
)
QA_SCHEMA = (
    "paper_id string, paper_title string, qa_pairs array<struct<question string, answer string, category string, "
    "source_title string, difficulty string, reasoning_type string>>, "
    "token_usage struct<prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, error string>, "
    "_corrupt_record string"
)


def _json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per file; unreadable files keep a row with ``_corrupt_record`` set."""
    return (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    )


def scan_knowledge_files(spark: SparkSession, path: str) -> DataFrame:
    return _json_files(spark, path, KNOWLEDGE_SCHEMA)


def scan_qa_files(spark: SparkSession, path: str) -> DataFrame:
    return _json_files(spark, path, QA_SCHEMA)


def explode_items(df: DataFrame, column: str) -> DataFrame:
    """One row per item of readable files, with its position; the cross-document file is not a paper."""
    good = df.filter(F.col("_corrupt_record").isNull())
    return good.select("paper_id", "paper_title", F.posexplode(column).alias("pos", "_i")).select(
        "paper_id", "paper_title", "pos", "_i.*"
    )


RESULT_SCHEMA = (
    "qa_results array<struct<question_id string, question string, ground_truth string, generated_answer string, "
    "contexts array<string>, response_time double, iterations int, quality_score double, category string, "
    "difficulty string, reasoning_type string, error string, ragas_scores map<string,double>>>"
)


def scan_result_tree(spark: SparkSession, root: str, files: str = "results.json", json_lines: bool = False) -> DataFrame:
    """``<root>/<model>/<category>/<mode>/results.json`` as one row per answer, with the path parts as columns.

    Folders may be named ``key=value``; the key is dropped.
    """
    reader = spark.read.schema(RESULT_SCHEMA).option("multiLine", str(not json_lines).lower())
    df = reader.json(f"{root.rstrip('/')}/*/*/*/{files}")
    parts = F.split(F.input_file_name(), "/")

    def folder(i: int) -> Column:
        return F.url_decode(F.substring_index(F.element_at(parts, i), "=", -1))

    return df.select(
        folder(-4).alias("model"), folder(-3).alias("category_dir"), folder(-2).alias("mode"),
        F.explode("qa_results").alias("r"),
    ).select("model", "category_dir", "mode", "r.*")


def result_inventory(results: DataFrame) -> DataFrame:
    """Which models, categories and modes have results."""
    return results.groupBy("model", "category", "mode").agg(F.count("*").alias("answers"))


def device_records(df: DataFrame, numbers: list[str], key: str = "record_id") -> DataFrame:
    """Blank strings and unreadable numbers become NULL; records without an id are dropped."""
    cols = {c: (float_or_null(F.col(c)) if c in numbers else blank_to_null(F.col(c))) for c, t in df.dtypes if t == "string"}
    return df.withColumns(cols).filter(F.col(key).isNotNull())


def load_device_records(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    return device_records(spark.read.option("header", "true").csv(path), numbers)
