"""Column expressions: coercion, validity tests, frame classes, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens import schema as S


# Fixed value: what counts as white space around a value.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def strip(col: Column) -> Column:
    """Text without white space at either end, line breaks included."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def to_float(col: Column, default: float = 0.0) -> Column:
    """Text to double; anything unreadable becomes ``default`` (P5)."""
    text = strip(col.cast("string"))
    # Java reads "1d" and "2f" as numbers; such text is not a number here.
    readable = F.when(~text.rlike("[0-9.][dDfF]$"), text)
    return F.coalesce(readable.try_cast("double"), F.lit(default))


def to_count(col: Column) -> Column:
    """``to_float`` cut toward zero."""
    return to_float(col).cast("bigint")


def rf_valid(rssi: Column) -> Column:
    """A signal sample that may enter window means: a number in [-100, 0]."""
    return F.coalesce(
        ~F.isnan(rssi) & rssi.between(S.RSSI_VALID_MIN, S.RSSI_VALID_MAX), F.lit(False)
    )


def subtype_class(subtype: Column) -> Column:
    """Frame class counted in windows: beacon, deauth, probe, auth, other."""
    s = strip(F.coalesce(subtype, F.lit("")))
    return (
        F.when(s == "BEACON", "beacon")
        .when(s.isin("DEAUTH", "DISASSOC"), "deauth")
        .when(s.startswith("PROBE"), "probe")
        .when(s == "AUTH", "auth")
        .otherwise("other")
    )


def deauth_targeted(subtype: Column, dst_mac: Column, host_mac: Column) -> Column:
    """1 if a deauth/disassoc frame is aimed at everyone or at the sensor itself."""
    aimed = (F.upper(dst_mac) == "FF:FF:FF:FF:FF:FF") | (F.upper(dst_mac) == F.upper(host_mac))
    return F.coalesce((subtype.isin("DEAUTH", "DISASSOC") & aimed).cast("int"), F.lit(0))


def normalize_label(col: Column) -> Column:
    """Numeric above 0 is 1, all else 0 (P10)."""
    return (to_float(col) > 0).cast("int")


def snr(rssi: Column, noise_floor: Column) -> Column:
    """Signal over noise."""
    return rssi - noise_floor


def parse_time_us(text: Column) -> Column:
    """ISO time text to epoch microseconds; null if it is not a time."""
    return F.unix_micros(F.try_to_timestamp(F.when(F.trim(text) != "", text)))


def with_attack_type(df: DataFrame) -> DataFrame:
    """Add ``attack_type='NONE'`` where the column is absent."""
    return df if "attack_type" in df.columns else df.withColumn("attack_type", F.lit("NONE"))


def fill_features(df: DataFrame, features: Sequence[str] = S.WINDOW_FEATURES) -> DataFrame:
    """Absent or non-numeric features become 0.0."""
    def filled(name: str) -> Column:
        value = to_float(F.col(name))
        return F.when(F.isnan(value), 0.0).otherwise(value)

    return df.withColumns({f: filled(f) if f in df.columns else F.lit(0.0) for f in features})


def clean_window_rf(df: DataFrame) -> DataFrame:
    """Zero the signal features of windows with an impossible mean.

    Both tests read the values as they came in. ``rf_bad`` and ``rf_mirror`` stay as
    columns, so the counts come from any aggregate over the result.
    """
    bad = (F.col("rssi_mean") < S.RSSI_VALID_MIN) | (F.col("rssi_mean") > S.RSSI_VALID_MAX)
    mirror = bad & (F.abs(F.col("snr_mean") - F.col("rssi_mean")) <= 1e-6)
    flagged = df.withColumns({"rf_bad": bad, "rf_mirror": mirror})
    return flagged.withColumns({
        "rssi_mean": F.when(F.col("rf_bad"), 0.0).otherwise(F.col("rssi_mean")),
        "rssi_var": F.when(F.col("rf_bad"), 0.0).otherwise(F.col("rssi_var")),
        "snr_mean": F.when(F.col("rf_mirror"), 0.0).otherwise(F.col("snr_mean")),
    })


def running_variance(mean_of_squares: Column, mean: Column) -> Column:
    """E[x^2] - E[x]^2, never below 0 (A4)."""
    return F.greatest(mean_of_squares - mean * mean, F.lit(0.0))


def is_attack_type(col: Column) -> Column:
    return F.coalesce(~col.isin(*S.NO_ATTACK), F.lit(False))
