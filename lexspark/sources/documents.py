"""Readers of documents and side inputs, and table sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "struct<type:string,page:int,bbox:array<double>,text:string,level:int,id:string,clause:string,asset:string,caption:string,rows:array<array<string>>>"
DOCUMENT = (
    "docId string, title string, source string, sourceUrl string, section string, `group` string, pdfUrl string, uploadDate string, sha256 string, bytes bigint, pageCount int, pipelineVersion string, convertedAt string, "
    f"stats struct<chars:bigint,figures:bigint,tables:bigint,ocrPages:array<int>>, warnings array<string>, toc array<struct<id:string,level:int,text:string,page:int>>, blocks array<{BLOCK}>"
)
CHANGE = "generatedAt string, added array<struct<docId:string,title:string,uploadDate:string>>, updated array<struct<docId:string,title:string,uploadDate:string,previousUploadDate:string>>, removed array<struct<docId:string,title:string>>, unchanged int, failed array<struct<docId:string,stage:string,error:string>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents, a JSON file each; broken files have a null docId and are left out."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("docId is not null")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON side input, or no rows where it is missing."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def change_rows(reports: DataFrame) -> DataFrame:
    """doc_id, kind, upload_date, previous_date, detected of daily reports, batch or stream; the day is in the file's name."""
    day = F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})[^/]*$", 1)
    row = lambda kind, date, previous: lambda x: F.struct(x["docId"].alias("doc_id"), F.lit(kind).alias("kind"), (x[date] if date else F.lit(None).cast("string")).alias("upload_date"), (x[previous] if previous else F.lit(None).cast("string")).alias("previous_date"))
    every = F.concat(*[F.transform(F.coalesce(F.col(c), F.array()), row(k, d, p)) for c, k, d, p in (("added", "added", "uploadDate", None), ("updated", "updated", "uploadDate", "previousUploadDate"), ("removed", "removed", None, None))])
    return reports.select(day.alias("detected"), F.explode(every).alias("c")).select("c.*", "detected")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
