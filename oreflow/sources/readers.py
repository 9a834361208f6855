"""Sources: explicit schemas, never inferred; malformed records fail instead of turning into nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REVIEW = "user_id string, business_id string, stars double, date string, text string"
BUSINESS = "business_id string, categories string, state string, city string"
USER_BUSINESS = "user_id string, business_id string"
SIMILARITY = "id1 string, id2 string, sim double"


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON object per line; a line that is none fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def text_tokens(spark: SparkSession, path: str, column: str = "word") -> DataFrame:
    """One token per line."""
    return spark.read.text(path).select(F.col("value").alias(column))


def csv_with_header(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def csv_without_repeated_header(spark: SparkSession, path: str, names: list[str], header: str) -> DataFrame:
    """Comma-separated lines, without every line equal to ``header``, wherever it stands."""
    cells = F.split("value", ",")
    return spark.read.text(path).filter(F.col("value") != header).select(*(F.btrim(F.get(cells, i)).alias(n) for i, n in enumerate(names)))


def numeric_points(spark: SparkSession, path: str) -> DataFrame:
    """(id long, vec array<double>, chunk string) of lines ``id,x1,...,xd``; the chunk is the file's path, in name order."""
    cells = F.split("value", ",")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("chunk"))
    return lines.select(cells[0].cast("long").alias("id"), F.transform(F.slice(cells, F.lit(2), F.size(cells)), lambda x: x.cast("double")).alias("vec"), "chunk")


def local_rows(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """Rows of the driver; the schema is explicit, so no rows are fine."""
    return spark.createDataFrame(rows, schema)


def model_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(business profiles, user profiles) of a JSON-lines model with a ``type`` of ``b`` or ``u``."""
    schema = "type string, business_id string, business_profile array<string>, user_id string, user_profile array<string>"
    rows = json_lines(spark, path, schema)
    return rows.filter("type = 'b'").select("business_id", "business_profile"), rows.filter("type = 'u'").select("user_id", "user_profile")


def itemset_lines(spark: SparkSession, path: str) -> DataFrame:
    """(itemset) of lines such as ``('a', 'b')`` or ``('a',)``."""
    inner = F.regexp_extract_all("value", F.lit(r"'([^']*)'"), F.lit(1))
    return spark.read.text(path).filter("value LIKE '(%'").select(F.sort_array(inner).alias("itemset"))
