"""Number plates: normalising, cleaning and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE_PLATE = r"^([A-Z]{2})([0-9]{1,2})([A-Z]{1,3})([0-9]{1,4})$"
NATIONAL_PLATE = r"^([0-9]{2})BH([0-9]{4})([A-Z]{1,2})$"
NATIONAL_NAME = "Bharat series (nationwide registration)"


def lookup_key(plate: Column) -> Column:
    """Outer white space off, upper case; inner marks stay, so they tell plates apart."""
    return F.upper(F.regexp_replace(plate, r"^\s+|\s+$", ""))


def cleaned(text: Column) -> Column:
    """ASCII letters and digits alone, upper case."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def cleaned_unicode(text: Column) -> Column:
    """Letters and digits of any script; empty text is null."""
    return F.upper(F.regexp_replace(F.nullif(text, F.lit("")), r"[^\p{L}\p{N}]", ""))


def readable(plate: Column) -> Column:
    """Null for a plate without characters: an empty one is no plate."""
    return F.nullif(plate, F.lit(""))


def joined_text(fragments: Column) -> Column:
    """OCR fragments as one cleaned text; null if there are none."""
    return F.when(F.size(fragments) > 0, cleaned(F.array_join(fragments, "")))


def decode(df: DataFrame, states: DataFrame, districts: DataFrame, plate: str = "plate") -> DataFrame:
    """df with recognized, clean_plate, state, state_code, rto_code, rto, series, number and extra.

    The national series is tried before state plates; unknown states make a plate unrecognised,
    unknown districts don't. Both dimensions are of fixed size and broadcast.
    """
    text = cleaned(F.col(plate))
    national, local = text.rlike(NATIONAL_PLATE), text.rlike(STATE_PLATE)
    part = lambda k: F.regexp_extract(text, STATE_PLATE, k)
    piece = lambda k: F.regexp_extract(text, NATIONAL_PLATE, k)
    parsed = df.withColumns(
        {
            "clean_plate": F.when(F.col(plate) != "", text),
            "national": F.coalesce(national, F.lit(False)),
            "state_code": F.when(local, part(1)),
            "rto_code": F.when(local, F.lpad(part(2), 2, "0")),
            "series": F.when(national, piece(3)).when(local, part(3)),
            "number": F.when(national, piece(2)).when(local, part(4)),
            "extra": F.when(national, F.concat(F.lit("Registered 20"), piece(1))),
        }
    )
    dim = F.broadcast(states.select(F.col("state_code").alias("dim_code"), F.col("state").alias("dim_state")))
    rto = F.broadcast(districts.select(F.col("code").alias("dim_rto"), F.col("district")))
    found = parsed.join(dim, parsed["state_code"] == dim["dim_code"], "left").join(rto, F.concat("state_code", "rto_code") == rto["dim_rto"], "left")
    known = F.col("dim_state").isNotNull()
    recognised = F.col("national") | known
    return found.select(
        *df.columns,
        recognised.alias("recognized"),
        "clean_plate",
        F.when(F.col("national"), NATIONAL_NAME).otherwise(F.col("dim_state")).alias("state"),
        F.when(F.col("national"), "BH").when(known, F.col("state_code")).alias("state_code"),
        F.when(known, F.col("rto_code")).alias("rto_code"),
        F.when(known, F.col("district")).alias("rto"),
        F.when(recognised, F.col("series")).alias("series"),
        F.when(recognised, F.col("number")).alias("number"),
        "extra",
    )
