"""Source systems: their files, columns, readers and writers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTIFIERS = ("crm_customer_id", "transaction_id", "marketing_contact_id", "session_id", "support_ticket_id", "portal_user_id", "linked_transaction_id")
IDENTITY = ("first_name", "surname", "full_name", "email", "phone", "address", "postcode", "date_of_birth")
COMMON = ("source_system", "source_record_id", *IDENTIFIERS, *[f"{c}_raw" for c in IDENTITY], *[f"{c}_normalised" for c in IDENTITY])


@dataclass(frozen=True)
class Source:
    system: str
    stem: str
    id_column: str
    fields: dict[str, str]  # identity field -> source column
    required: tuple[str, ...] = ()


# The five systems in union order and where their identity fields are.
SOURCES = (
    Source("CRM", "crm", "crm_customer_id", {"first_name": "first_name", "surname": "surname", "email": "email", "phone": "telephone_number", "address": "address", "postcode": "postcode", "date_of_birth": "date_of_birth"}),
    Source("ECOMMERCE", "ecommerce", "transaction_id", {"first_name": "purchaser_first_name", "surname": "purchaser_surname", "email": "email", "phone": "telephone_number", "address": "billing_address", "postcode": "billing_postcode"}),
    Source("MARKETING", "marketing", "marketing_contact_id", {"full_name": "contact_name", "email": "email", "postcode": "postcode"}),
    Source("ONLINE", "online", "session_id", {}),
    Source("SUPPORT", "support", "support_ticket_id", {"full_name": "requester_name", "email": "requester_email", "phone": "requester_phone"}),
)
BY_SYSTEM = {s.system: s for s in SOURCES}


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as strings, "" for missing.  Without ``columns`` the header alone
    is read for them; types are never inferred from data."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if columns is None:
        columns = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return reader.schema(schema).csv(path).na.fill("")


def typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, small: bool = False) -> None:
    (df.coalesce(1) if small else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def find_input(spark: SparkSession, candidates: list[str], root: str, name: str) -> str:
    """The first candidate that exists, else the only file of that name under root."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    for c in candidates:
        if path(c).getFileSystem(conf).exists(path(c)):
            return c
    fs, found = path(root).getFileSystem(conf), []
    files = fs.listFiles(path(root), True)
    while files.hasNext():
        p = files.next().getPath()
        if p.getName() == name:
            found.append(p.toString())
    if len(found) != 1:
        raise FileNotFoundError(f"{name}: {len(found)} files under {root}")
    return found[0]


def ingest(df: DataFrame, source: Source) -> DataFrame:
    """Bronze: checked columns, source metadata in front."""
    missing = [c for c in (source.id_column, *source.required) if c not in df.columns]
    if missing:
        raise ValueError(f"{source.system}: missing columns {missing}")
    if "source_system" in df.columns and not df.where(F.col("source_system") != source.system).isEmpty():
        raise ValueError(f"{source.system}: rows of another system")
    rest = [c for c in df.columns if c not in ("source_system", "source_record_id")]
    return df.select(F.lit(source.system).alias("source_system"), F.col(source.id_column).alias("source_record_id"), *rest)


def truth(frames: dict[str, DataFrame]) -> DataFrame:
    """Truth maps, one per system, as (source_system, source_record_id, ground_truth_id)."""
    parts = [d.select(F.lit(s).alias("source_system"), F.col(BY_SYSTEM[s].id_column).alias("source_record_id"), "ground_truth_id") for s, d in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def report(spark: SparkSession, sections: dict[str, list[tuple[str, object]]]) -> DataFrame:
    """A metric report: section, metric, value, ord."""
    rows = [(s, m, str(v), i) for i, (s, m, v) in enumerate((s, m, v) for s, ms in sections.items() for m, v in ms)]
    return spark.createDataFrame(rows, "section string, metric string, value string, ord int")
