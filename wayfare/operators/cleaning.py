"""Row cleaning of the raw tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import labels as L
from wayfare.operators.skew import BROADCAST_ROWS, Size
from wayfare.schemas import BOOKING_KEY, BOOKINGS


def normal_state(state: Column) -> Column:
    low = F.lower(state)
    return F.when(low == L.CANCELLED_SYNONYM, L.CANCELLED).otherwise(low)


def repeated_codes(raw: DataFrame) -> DataFrame:
    """64-bit codes of the values, all but the id, that several bookings share.

    Bookings whose code is not among them have no copy; two different ones may share a code.
    """
    coded = raw.select(F.xxhash64(*BOOKING_KEY).alias("codigo"))
    counts = coded.groupBy("codigo").agg(F.count(F.lit(1)).alias("_n"))
    return counts.where("_n > 1").select("codigo")


def _by_code(raw: DataFrame, codes: DataFrame, size: Size | None, how: str) -> DataFrame:
    small = size is not None and size.within(BROADCAST_ROWS)
    code = F.xxhash64(*BOOKING_KEY) == F.col("codigo")
    return raw.join(F.broadcast(codes) if small else codes, code, how)


def drop_booking_copies(
    raw: DataFrame, codes: DataFrame | None = None, size: Size | None = None
) -> DataFrame:
    """One row per set of bookings equal in everything but the id; the lowest id stays.

    An aggregate instead of a ranking: copies are merged on the map side, so a group of
    copies of any size reaches the shuffle as one row per task. Compares the values as
    delivered, so ``CANCELLED`` and ``cancelada`` are different here. Columns beyond the
    schema come from the row that stays. With ``repeated_codes`` as a written table of the
    given ``size``, only the bookings that have one of them are compared.
    """
    extra = [F.min_by(c, "reserva_id").alias(c) for c in _extra(raw)]
    compared = raw if codes is None else _by_code(raw, codes, size, "left_semi")
    kept = compared.groupBy(*BOOKING_KEY).agg(F.min("reserva_id").alias("reserva_id"), *extra)
    return kept if codes is None else kept.unionByName(_by_code(raw, codes, size, "left_anti"))


def _extra(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c not in BOOKINGS.names]


def booking_copies(
    raw: DataFrame, codes: DataFrame | None = None, size: Size | None = None
) -> DataFrame:
    """The values of bookings that occur more than once, with the id kept and the count."""
    compared = raw if codes is None else _by_code(raw, codes, size, "left_semi")
    return (
        compared.groupBy(*BOOKING_KEY)
        .agg(F.min("reserva_id").alias("reserva_id_original"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )


def clean_bookings(
    raw: DataFrame, codes: DataFrame | None = None, size: Size | None = None
) -> DataFrame:
    return (
        drop_booking_copies(raw, codes, size)
        .withColumns(
            {
                "estado": normal_state(F.col("estado")),
                "personas": F.when(F.col("personas") > 0, F.col("personas")),
            }
        )
        .select(*BOOKINGS.names, *_extra(raw))
    )


def document_key(distinct_nulls: bool = False) -> Column:
    """Document number without case. Missing documents share one key unless told not to."""
    key = F.lower("dni")
    return F.coalesce(key, F.concat(F.lit("\0"), F.col("user_id"))) if distinct_nulls else key


def document_groups(customers: DataFrame, distinct_nulls: bool = False) -> DataFrame:
    """Lowest user id and size of each document group."""
    return customers.groupBy(document_key(distinct_nulls).alias("dni_key")).agg(
        F.min("user_id").alias("user_id_canonico"), F.count(F.lit(1)).alias("_n")
    )


def clean_customers(raw: DataFrame, distinct_nulls: bool = False) -> DataFrame:
    """Rows holding the lowest user id of their document; placeholder birthdates blanked."""
    keep = document_groups(raw, distinct_nulls).select(
        F.col("dni_key").alias("_dni"), F.col("user_id_canonico").alias("_user")
    )
    # the user id in the join key spreads even a document shared by very many customers
    same_document = document_key(distinct_nulls).eqNullSafe(F.col("_dni"))
    kept = raw.join(keep, (F.col("user_id") == F.col("_user")) & same_document, "left_semi")
    born = F.col("fecha_nacimiento")
    return kept.withColumn(
        "fecha_nacimiento", F.when(born != F.lit(L.PLACEHOLDER_BIRTHDATE), born)
    )


def _parse(text: Column, form: tuple[str, str]) -> Column:
    """Timestamp in one format, else NULL; extra spaces are forgiven.

    The shape is looked at first: letting the parser fail throws an exception per row,
    which is slow when half a table is in the other format.
    """
    shape, pattern = form
    text = F.trim(text)
    tidy = F.when(F.instr(text, "  ") > 0, F.regexp_replace(text, " +", " ")).otherwise(text)
    parsed = F.try_to_timestamp(tidy, F.lit(pattern))
    return F.when(tidy.rlike(shape), parsed).cast("timestamp_ntz")


def iso_timestamp(text: Column) -> Column:
    """Year first. Fully padded text, the usual case, takes the faster cast."""
    padded = F.when(text.rlike(L.PADDED_TIMESTAMP), text.try_cast("timestamp_ntz"))
    return F.coalesce(padded, _parse(text, L.ISO_TIMESTAMP))


def day_first_timestamp(text: Column) -> Column:
    return _parse(text, L.DAY_FIRST_TIMESTAMP)


def event_timestamp(text: Column) -> Column:
    """Either of the two formats of the export; NULL for anything else."""
    return F.coalesce(iso_timestamp(text), day_first_timestamp(text))


def normal_device(device: Column, typos: Mapping[str, str] = L.DEVICE_TYPOS) -> Column:
    low = F.lower(device)
    fixed = low
    for wrong, right in typos.items():
        fixed = F.when(low == wrong, right).otherwise(fixed)
    return fixed


def clean_events(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "event_date": event_timestamp(F.col("event_date")),
            "device": normal_device(F.col("device")),
        }
    )


def url_destination(url: Column) -> Column:
    return F.split_part(url, F.lit("/"), F.lit(L.DESTINATION_URL_PART))


def clean_tours(raw: DataFrame, unknown_providers: Sequence[int] = L.ORPHAN_PROVIDERS) -> DataFrame:
    provider = F.col("proveedor_id")
    return raw.withColumns(
        {
            "proveedor_id": F.when(~provider.isin(*unknown_providers), provider),
            "destino": url_destination(F.col("url")),
        }
    )


def orphan_tours(raw_tours: DataFrame, providers: DataFrame) -> DataFrame:
    """Tours that name a provider the provider table does not have."""
    return raw_tours.where(F.col("proveedor_id").isNotNull()).join(
        providers.select("proveedor_id"), "proveedor_id", "left_anti"
    )
