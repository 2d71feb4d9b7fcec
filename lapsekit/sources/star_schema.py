"""Encounter, department, patient and screening frames from the star-schema tables.

One encounter is one line item of an order; the customer is the patient, the
part is the department visited, the customer's events are screening answers.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lapsekit.operators.heavy_join import join_unique
from lapsekit.settings import RISK_DOMAINS

TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events")

# Last observed day of this data, customer segment -> portal
# status (a segment not listed has no status), and the answer value above
# which a screening answer counts as a risk.
STAR_OBSERVATION_END = date(1996, 6, 30)
SEGMENT_STATUS = {
    "AUTOMOBILE": "Activated",
    "BUILDING": "Pending Activation",
    "HOUSEHOLD": "Inactivated",
    "FURNITURE": "Patient Declined",
}
RISK_ANSWER_ABOVE = 150


@dataclass(frozen=True)
class JourneyInputs:
    """The frames that journeys are built from."""

    encounters: DataFrame
    departments: DataFrame
    patients: DataFrame
    answers: DataFrame


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def encounters(spark: SparkSession, folder: str) -> DataFrame:
    """One row per visit record, with the keys that order visits of a day."""
    lines = read_table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_shipdate").cast("date").alias("VisitDate"),
        F.col("l_linenumber").alias("EncounterLine"),
        F.col("l_partkey").alias("DepartmentKey"),
        F.col("l_returnflag").alias("DepartmentType"),
        F.col("l_linestatus").alias("JourneyPart"),
    )
    orders = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("EncounterKey"),
        F.col("o_custkey").alias("PatientDurableKey"),
        F.col("o_orderpriority").alias("EncounterType"),
        F.col("o_orderstatus").alias("SmokingStatus"),
    )
    return join_unique(lines, orders, "l_orderkey", "EncounterKey").drop("l_orderkey")


def departments(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("DepartmentKey"),
        F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("FirstVisitTypeDescription"),
        F.col("p_brand").alias("FirstDepartmentSpecialty"),
    )


def patients(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_table(spark, folder, "customer")
    nation = read_table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, folder, "region").select("r_regionkey", "r_name")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("PatientDurableKey"),
        F.floor(F.col("c_acctbal") / 500).cast("string").alias("PatientBirthYearBin"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("SexAssignedAtBirth"),
        F.col("r_name").alias("OmbRace"),
        F.col("n_name").alias("OmbEthnicity"),
        _segment_status(F.col("c_mktsegment")).alias("MyChartStatus"),
    )


def _segment_status(segment: Column) -> Column:
    status = F.lit(None).cast("string")
    for name, value in SEGMENT_STATUS.items():
        status = F.when(segment == name, value).otherwise(status)
    return status


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per screening answer: the domain asked and, if a risk, which one."""
    slot = F.get_json_object("props", "$.k").cast("int") % len(RISK_DOMAINS)
    return read_table(spark, folder, "events").select(
        F.col("user_id").alias("PatientDurableKey"),
        F.col("event_type").alias("Domain"),
        F.when(F.col("value") > RISK_ANSWER_ABOVE, slot).alias("RiskSlot"),
    )


def journey_inputs(spark: SparkSession, folder: str) -> JourneyInputs:
    return JourneyInputs(
        encounters(spark, folder),
        departments(spark, folder),
        patients(spark, folder),
        answers(spark, folder),
    )
