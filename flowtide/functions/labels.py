"""Scalar rules on names, dates and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide import schema as S


def week_label(ts: Column) -> Column:
    """``WEEK-YYYY-NN`` by ISO week; early-January days of the old ISO year are week 00."""
    year = F.year(ts)
    iso_year = F.extract(F.lit("YEAROFWEEK"), ts).cast("int")
    iso_week = F.extract(F.lit("WEEK"), ts).cast("int")
    return F.when(
        iso_year < year, F.concat(F.lit("WEEK-"), year.cast("string"), F.lit("-00"))
    ).otherwise(
        F.concat(
            F.lit("WEEK-"),
            iso_year.cast("string"),
            F.lit("-"),
            F.lpad(iso_week.cast("string"), 2, "0"),
        )
    )


def salted_hash(key: Column, salt: str) -> Column:
    """Hex SHA-1 of salt and key; NULL where the source has no key."""
    return F.when(key.isNotNull(), F.sha1(F.concat(F.lit(salt), key.cast("string"))))


def flag_mask(flags: dict[str, tuple[Column, Column]]) -> Column:
    """Bit set when the forward or the reverse flag column is set."""
    out = F.lit(0)
    for name, (fwd, rev) in flags.items():
        bit = S.FLAG_BITS[name]
        out = out.bitwiseOR(
            F.when(F.coalesce(fwd, F.lit(0)) + F.coalesce(rev, F.lit(0)) > 0, F.lit(bit)).otherwise(
                F.lit(0)
            )
        )
    return out


def file_date(file_name: Column) -> Column:
    """Date in ``flows-YYYYMMDD.csv[.ext]``; any other name raises."""
    digits = F.regexp_extract(file_name, r"^flows-(\d{8})\.csv(\.\w+)?$", 1)
    return F.when(
        digits == "",
        F.raise_error(F.concat(F.lit("not a flow file name: "), file_name)).cast("date"),
    ).otherwise(F.to_date(digits, "yyyyMMdd"))


def run_name_part(name: Column, part: str) -> Column:
    """Part of ``stage-model-variant-split-sSEED`` (stage, group or seed)."""
    pattern = r"^([^-]+)-(.+)-s(\d+)$"
    if part == "stage":
        return F.regexp_extract(name, pattern, 1)
    if part == "seed":
        return F.regexp_extract(name, pattern, 3).cast("bigint")
    return F.regexp_replace(name, r"-s\d+$", "")
