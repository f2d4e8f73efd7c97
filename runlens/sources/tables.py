"""Readers of the record lake, landed topics and seed rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import constants as C
from runlens.schemas import ENVELOPE, LAKE

_MISSING = "PATH_NOT_FOUND"


def read_lake(spark: SparkSession, path: str, schema: T.StructType = LAKE) -> DataFrame:
    """Lake records under a fixed schema; a lake that is not there yet is an empty frame."""
    try:
        return spark.read.schema(schema).json(path).select(*schema.fieldNames())
    except AnalysisException as error:
        if error.getCondition() != _MISSING:
            raise
        return spark.createDataFrame([], schema)


def read_landed(spark: SparkSession, path: str, fields: T.StructType | None = None) -> DataFrame:
    """Landed topic files; the schema is inferred unless given.

    Inference reads every file once more, so jobs pass `fields` and keep inference for a look.
    """
    reader = spark.read if fields is None else spark.read.schema(fields)
    return reader.json(path)


def utc_day(moment: Column) -> Column:
    """Day of a timestamp in UTC, whatever the session's zone."""
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd")


def stage_raw_events(landed: DataFrame) -> DataFrame:
    """Typed staging rows of landed events, with the day they happened."""
    moment = F.timestamp_millis(F.col("timestamp"))
    return landed.select(
        *[F.col(field.name).cast(field.dataType) for field in ENVELOPE.fields],
        moment.alias("event_time"), utc_day(moment).alias("dt"))


def seed_rows(spark: SparkSession) -> DataFrame:
    """Hand-made records of both outcomes per archetype, so that no model sees one label only."""
    columns = [field for field in LAKE.fields if field.name != "upgrade_counts"]
    no_upgrades = F.create_map().cast("map<string,int>")
    return spark.createDataFrame(list(C.SEED_ROWS), T.StructType(columns)).withColumn(
        "upgrade_counts", no_upgrades).select(*LAKE.fieldNames())
