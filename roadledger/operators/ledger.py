"""The ledger of fines: amounts, totals, reports, ingest and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger import schemas
from roadledger.config import Config
from roadledger.functions import names, plates

UNPAID = "unpaid"


def unpaid(status: Column) -> Column:
    """Exactly unpaid; null and anything else are not."""
    return status == UNPAID


def due(amount: str = "amount") -> Column:
    return F.coalesce(F.sum(F.when(unpaid(F.col("status")), F.col(amount))), F.lit(0).cast("bigint"))


def with_amount(rows: DataFrame, amounts: DataFrame, default: int = Config.default_amount) -> DataFrame:
    """rows with the fixed amount of their violation or the default; the dimension is of fixed size."""
    return rows.join(F.broadcast(amounts), "violation", "left").withColumn("amount", F.coalesce("fixed", F.lit(default).cast("bigint"))).drop("fixed")


def accepted(raw: DataFrame, text: str = "body") -> DataFrame:
    """JSON records that have a plate and a violation and an image path; the plate becomes a lookup key."""
    parsed = raw.withColumn("record", F.from_json(text, schemas.INGEST)).select(*(c for c in raw.columns if c != text), "record.*")
    whole = parsed.where("plate is not null and violation is not null and image_path is not null")
    return whole.withColumn("plate", plates.lookup_key(F.col("plate")))


def totals(fines: DataFrame) -> DataFrame:
    return fines.groupBy("plate").agg(due().alias("total"), F.count("*").alias("n_fines"))


def api_view(fines: DataFrame) -> DataFrame:
    """The fields that a lookup shows."""
    return fines.select("id", "plate", "violation", "amount", "status", F.col("timestamp").alias("time"), names.evidence_url(F.col("image_path")).alias("image"))


def fine_list(separator: str = "; ") -> Column:
    """The fines of a group by id, as text."""
    rows = F.sort_array(F.collect_list(F.struct("id", "violation", "amount", "status")))
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["violation"], r["amount"].cast("string"), r["status"])), separator)


def report(fines: DataFrame) -> DataFrame:
    """One line of text for each plate, with what is due."""
    rows = F.sort_array(F.collect_list(F.struct("id", names.report_line(F.col("violation"), F.col("amount"), F.col("status")).alias("line"))))
    out = fines.groupBy("plate").agg(F.array_join(F.transform(rows, lambda r: r["line"]), ", ").alias("lines"), due().alias("total"))
    return out.select("plate", "lines", F.when(F.col("total") > 0, F.concat(F.lit("₹"), F.col("total").cast("string"), F.lit(" due"))).otherwise("all paid").alias("due"))


def lookup(fines: DataFrame, plate: str, states: DataFrame, districts: DataFrame) -> DataFrame:
    """One row for a plate: fines, total and vehicle, also if there are no fines."""
    spark = fines.sparkSession
    key = spark.range(1).select(plates.lookup_key(F.lit(plate)).alias("plate"))
    own = api_view(fines).join(F.broadcast(key), "plate")
    lists = own.agg(F.sort_array(F.collect_list(F.struct("id", "violation", "amount", "status", "time", "image"))).alias("fines"), due().alias("total"))
    vehicle = plates.decode(key, states, districts).select("plate", F.struct("recognized", "clean_plate", "state", "state_code", "rto_code", "rto", "series", "number", "extra").alias("vehicle"))
    return vehicle.crossJoin(lists).select("plate", F.transform("fines", lambda f: f.dropFields("id")).alias("fines"), "total", "vehicle")


def latest_jobs(updates: DataFrame) -> DataFrame:
    """The newest value of each field of each job; updates leave fields null that they don't set."""
    fields = [c for c in updates.columns if c not in ("job_id", "seq")]
    newest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields]
    return updates.groupBy("job_id").agg(*newest)
