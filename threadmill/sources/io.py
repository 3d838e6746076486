"""Files in and out (A1-A10): parquet stores, delimited label files, the
labelling sheet, the corpus text file, vocabulary, predictions, metrics and
the fitted label mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def scan_posts(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A1: the saved post table (parquet, or JSON lines with a schema)."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(fmt).load(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    (df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def scan_delimited(spark: SparkSession, path: str, schema: str, id_col: str = "tweet_id", sep: str = "\t") -> DataFrame:
    """A2: tab-separated table with a header; the id column is a string."""
    df = spark.read.option("header", True).option("sep", sep).option("escape", '"').schema(schema).csv(path)
    return df.withColumn(id_col, F.col(id_col).cast("string"))


def _escape(c):
    """Line breaks, NUL and the backslash as backslash sequences, so that a record is one line."""
    for sign, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0")):
        c = F.replace(c, F.lit(sign), F.lit(code))
    return c


def _unescape(c):
    """Back from ``_escape``: what lies between two double backslashes is decoded on its own."""
    def plain(p):
        for sign, code in (("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0")):
            p = F.replace(p, F.lit(code), F.lit(sign))
        return p

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")


def write_sheet(df: DataFrame, path: str, index_col: str = "id") -> None:
    """Sheet for people: the row id first, every field quoted, line breaks
    escaped. Every task writes its own file, and every record is one line, so
    the files can be split again when they are read."""
    cols = [index_col] + [c for c in df.columns if c != index_col]
    strings = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    (df.select(*[_escape(F.col(c)).alias(c) if c in strings else F.col(c) for c in cols])
     .write.mode("overwrite").option("header", True)
     .option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def scan_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A3: a labelling sheet; the first column is the row id (not a new index)."""
    df = (spark.read.option("header", True).option("escape", '"')
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .option("inferSchema", False).csv(path))
    first, *rest = df.columns
    return df.select(F.col(first).cast("bigint").alias("id"), *[_unescape(F.col(c)).alias(c) for c in rest])


def sink_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A4: a cleaned / labelled / hydrated table as parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def sink_label_sheet(sheet: DataFrame, path: str, order_col: str = "rank") -> None:
    """A5: shuffled sheet of (id, text) for labelling. The order is kept as a
    column, and a range sort deals it out over many files."""
    write_sheet(sheet.select("id", "text", order_col).orderBy(order_col), path)


def sink_corpus_text(df: DataFrame, path: str, text: str = "text") -> None:
    """One post per line; line breaks inside a post become blanks."""
    flat = F.regexp_replace(F.col(text), "[\\n\\r]", " ")
    df.select(flat.alias("value")).write.mode("overwrite").text(path)


def sink_vocab(vocab: DataFrame, path: str) -> None:
    """The vocabulary, replacing an older one: ``vocab.txt`` (one token
    per line, line number = id; the table is bounded by the vocabulary size,
    so one ordered file is cheap) and a (token, id) parquet table."""
    vocab.write.mode("overwrite").parquet(f"{path}/table")
    vocab.orderBy("id").select("token").coalesce(1).write.mode("overwrite").text(f"{path}/text")


def scan_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/table")


def sink_predictions(encoded: DataFrame, predictions: DataFrame, key_cols, path: str) -> None:
    """Encoded rows with their ``prediction`` (key join)."""
    encoded.join(predictions, list(key_cols), "left").write.mode("overwrite").parquet(path)


def sink_metrics(metrics: DataFrame, path: str) -> None:
    """Append (run, metric, step, value)."""
    metrics.select("run", "metric", "step", "value").write.mode("append").parquet(path)


def load_or_fit_encoder(spark: SparkSession, path: str, fit) -> DataFrame:
    """A10: reuse a stored label mapping; fit and store a new one if absent."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        fit().write.parquet(path)
        return spark.read.parquet(path)
