"""Data-quality checks: each returns a small table of counts, or the offending rows."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import labels as L
from wayfare.functions.exprs import days_between, is_state, mean, n_rows, pct, rnd
from wayfare.operators.cleaning import day_first_timestamp, iso_timestamp, orphan_tours
from wayfare.operators.skew import balanced_lookup
from wayfare.plans.business import with_provider_end
from wayfare.schemas import BOOKING_KEY
from wayfare.sources.warehouse import RAW_TABLES, Warehouse


def checks(one_row: DataFrame, items: list[tuple[str, Column, Column]]) -> DataFrame:
    """One aggregated row -> rows (comprobacion, n, total, pct)."""
    rows = [
        F.struct(
            F.lit(name).alias("comprobacion"),
            n.alias("n"),
            total.alias("total"),
            pct(n, total, 2).alias("pct"),
        )
        for name, n, total in items
    ]
    return one_row.select(F.inline(F.array(*rows)))


# --- tracking and identity ---------------------------------------------------


def _tracked_ids(wh: Warehouse) -> DataFrame:
    return (
        wh.events.where(F.col("reserva_id").isNotNull())
        .select("reserva_id")
        .distinct()
        .withColumn("con_evento", F.lit(True))
    )


def tracking_gap(
    wh: Warehouse, since: dt.date | None = None, until: dt.date | None = None
) -> DataFrame:
    """Decided bookings per day, and how many of them no event mentions."""
    day = F.to_date("fecha_reserva")
    decided = wh.bookings_between(since, until).where(is_state(*L.RESOLVED))
    if since is not None:
        decided = decided.where(F.col("fecha_reserva") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        after = F.lit(until + dt.timedelta(days=1)).cast("timestamp_ntz")
        decided = decided.where(F.col("fecha_reserva") < after)
    decided = decided.select("reserva_id", day.alias("dia"))
    untracked = F.count_if(F.col("con_evento").isNull())
    return (
        decided.join(_tracked_ids(wh), "reserva_id", "left")
        .groupBy("dia")
        .agg(
            n_rows().alias("reservas_resueltas"),
            untracked.alias("sin_evento"),
            pct(untracked, n_rows()).alias("pct_sin_evento"),
        )
        .orderBy("dia")
    )


def dq_cookie_user(wh: Warehouse) -> DataFrame:
    """Cookies used by more than one customer, from the identity map: events stay unread."""
    known = (
        wh.identities.where(F.col("user_id_canonico").isNotNull())
        .groupBy("cookie_id")
        .agg(
            (F.min("user_id_canonico") != F.max("user_id_canonico")).alias("compartida"),
        )
    )
    summary = known.agg(F.count_if("compartida").alias("n"), n_rows().alias("total"))
    return checks(summary, [("cookie con varios usuarios", F.col("n"), F.col("total"))])


def dq_client_cookie(wh: Warehouse) -> DataFrame:
    """Client ids used by several customers, or seen under several cookies."""
    # distinct triples first: what is counted then no longer grows with the events
    triples = (
        wh.events.where(~F.col("es_bot"))
        .select("temp_client_id", "cookie_id", "user_id")
        .distinct()
    )
    per_client = triples.groupBy("temp_client_id").agg(
        (F.min("user_id") != F.max("user_id")).alias("varios_usuarios"),
        (F.count_distinct("cookie_id") > 1).alias("varias_cookies"),
    )
    summary = per_client.agg(
        F.count_if("varios_usuarios").alias("u"),
        F.count_if("varias_cookies").alias("c"),
        n_rows().alias("total"),
    )
    return checks(
        summary,
        [
            ("temp_client_id con varios usuarios", F.col("u"), F.col("total")),
            ("temp_client_id en varias cookies", F.col("c"), F.col("total")),
        ],
    )


def identity_recovery(wh: Warehouse) -> DataFrame:
    """Events that got a customer from their cookie, from the counts of the identity map."""
    before, after = F.col("user_id_canonico").isNull(), F.col("user_id_propagado").isNull()
    n = F.col("eventos")

    def events_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0).cast("long"))

    return wh.identities.agg(
        F.sum(n).alias("eventos"),
        events_where(before).alias("anonimos_antes"),
        events_where(after).alias("anonimos_despues"),
        events_where(before & ~after).alias("recuperados"),
    ).select(
        "*",
        pct(F.col("recuperados"), F.col("eventos"), 2).alias("pct_sobre_total"),
        pct(F.col("recuperados"), F.col("anonimos_antes"), 2).alias("pct_sobre_anonimos"),
    )


def bot_candidates(wh: Warehouse, times_average: float = 5.0) -> DataFrame:
    """Cookies far above the average volume with neither a customer nor a booking.

    Works on the identity map, which already holds the counts per cookie and user.
    """
    per_cookie = wh.identities.groupBy("cookie_id").agg(
        F.sum("eventos").alias("eventos"),
        F.max("user_id_propagado").alias("usuario"),
        F.sum("con_reserva").alias("con_reserva"),
    )
    average = per_cookie.agg(F.avg("eventos")).scalar()
    quiet = F.col("usuario").isNull() & (F.col("con_reserva") == 0)
    return per_cookie.where(quiet & (F.col("eventos") > F.lit(times_average) * average)).select(
        "cookie_id", "eventos"
    )


def dq_event_date_formats(wh: Warehouse) -> DataFrame:
    """Rows per timestamp format; what fits neither is listed too."""
    text = F.col("event_date")
    iso = iso_timestamp(text).isNotNull()
    day_first = day_first_timestamp(text).isNotNull()
    summary = wh.raw_events.agg(
        F.count_if(iso).alias("iso"),
        F.count_if(~iso & day_first).alias("day_first"),
        F.count_if(~iso & ~day_first).alias("neither"),
        n_rows().alias("total"),
    )
    return checks(
        summary,
        [
            ("aaaa-mm-dd hh:mm:ss", F.col("iso"), F.col("total")),
            ("dd/mm/aaaa hh:mm", F.col("day_first"), F.col("total")),
            ("sin interpretar", F.col("neither"), F.col("total")),
        ],
    )


def dq_session_keys(wh: Warehouse) -> DataFrame:
    """Sessions seen under several cookies or on several devices.

    A value is taken as two independent codes of 64 bits. Values differ where the least and
    the greatest of either code differ; equal ones have one code each. Codes are as wide
    whatever the text, so that a session's are kept in place while events are read, and one
    row for each session and task is shuffled.
    """

    def several(column: str) -> Column:
        codes = [F.xxhash64(column), F.xxhash64(F.lit(1), F.reverse(column))]
        present = [F.when(F.col(column).isNotNull(), code) for code in codes]
        differ = [F.min(code) != F.max(code) for code in present]
        return F.coalesce(differ[0] | differ[1], F.lit(False))

    per_session = wh.events.groupBy("session_id").agg(
        several("cookie_id").alias("cookies"), several("device").alias("devices")
    )
    summary = per_session.agg(
        F.count_if("cookies").alias("c"), F.count_if("devices").alias("d"), n_rows().alias("total")
    )
    return checks(
        summary,
        [
            ("sesion con varias cookies", F.col("c"), F.col("total")),
            ("sesion con varios dispositivos", F.col("d"), F.col("total")),
        ],
    )


# --- bookings ----------------------------------------------------------------


def dq_duplicate_bookings(wh: Warehouse) -> DataFrame:
    """Each dropped copy with the booking it repeats.

    ``mismos_digitos``: the last four digits of both ids agree; ``sin_evento``: no web event
    mentions the copy. The list of repeated values is stored and as a rule small, so the
    bookings are read without a shuffle; should it be large, a group of copies of any size
    is spread over salts.
    """
    repeated = wh.booking_copies
    copies = (
        balanced_lookup(
            wh.raw_bookings,
            repeated.drop("_n"),
            on=BOOKING_KEY,
            spread_by="reserva_id",
            counts=repeated.select(*BOOKING_KEY, "_n"),
            size=wh.size("reservas_repetidas"),
        )
        .where(F.col("reserva_id") != F.col("reserva_id_original"))
        .select("reserva_id", "reserva_id_original")
    )
    return copies.join(_tracked_ids(wh), "reserva_id", "left").select(
        "reserva_id",
        "reserva_id_original",
        (F.col("reserva_id") % 10000 == F.col("reserva_id_original") % 10000).alias(
            "mismos_digitos"
        ),
        F.col("con_evento").isNull().alias("sin_evento"),
    )


def dq_campaign_missing(wh: Warehouse) -> DataFrame:
    missing = F.count_if(F.col("campana").isNull())
    return (
        wh.bookings.groupBy("canal")
        .agg(
            n_rows().alias("reservas"),
            missing.alias("sin_campana"),
            pct(missing, n_rows()).alias("pct_sin_campana"),
        )
        .orderBy("canal")
    )


def dq_provider_after_end(wh: Warehouse) -> DataFrame:
    """Bookings made, or activities held, after the provider left; share confirmed."""
    bookings = wh.bookings.select(
        "reserva_id", "proveedor_id", "fecha_reserva", "fecha_actividad", "estado"
    )
    booked = F.to_date("fecha_reserva") > F.col("fecha_baja")
    held = F.to_date("fecha_actividad") > F.col("fecha_baja")
    confirmed = is_state(L.CONFIRMED)
    summary = with_provider_end(wh, bookings).agg(
        F.count_if(booked).alias("bn"),
        F.count_if(booked & confirmed).alias("bk"),
        F.count_if(held).alias("hn"),
        F.count_if(held & confirmed).alias("hk"),
    )
    rows = [
        F.struct(
            F.lit(name).alias("comprobacion"),
            F.col(n).alias("reservas"),
            F.col(k).alias("confirmadas"),
            pct(F.col(k), F.col(n)).alias("pct_confirmadas"),
        )
        for name, n, k in (
            ("reserva posterior a la baja", "bn", "bk"),
            ("actividad posterior a la baja", "hn", "hk"),
        )
    ]
    return summary.select(F.inline(F.array(*rows)))


def dq_orphan_provider(wh: Warehouse) -> DataFrame:
    """Providers named by tours but missing from the provider table; bookings affected."""
    per_tour = (
        wh.bookings.where(F.col("tour_id").isNotNull())
        .groupBy("tour_id")
        .agg(n_rows().alias("reservas"))
    )
    return (
        orphan_tours(wh.raw_tours, wh.providers)
        .select("tour_id", "proveedor_id")
        .join(per_tour, "tour_id", "left")
        .groupBy("proveedor_id")
        .agg(
            n_rows().alias("tours"),
            F.coalesce(F.sum("reservas"), F.lit(0).cast("long")).alias("reservas"),
        )
    )


def dq_party_size(wh: Warehouse) -> DataFrame:
    """Are impossible party sizes tied to one provider or tour?

    Bookings are counted per provider and tour once; totals by provider, by tour and
    overall are grouping sets over those counts.
    """
    per_pair = wh.raw_bookings.groupBy("proveedor_id", "tour_id").agg(
        n_rows().alias("n"), F.count_if(F.col("personas") <= 0).alias("k")
    )
    provider, tour = F.col("proveedor_id"), F.col("tour_id")
    levels = per_pair.groupingSets([[provider], [tour], []], provider, tour).agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n"), F.sum("k").alias("k")
    )
    by_provider = (F.col("level") == 1) & provider.isNotNull() & (F.col("k") > 0)
    by_tour = (F.col("level") == 2) & tour.isNotNull() & (F.col("k") > 0)
    overall = F.col("level") == 3
    invalid = F.col("invalidas")
    return levels.agg(
        F.max(F.when(overall, F.col("k"))).alias("invalidas"),
        F.max(F.when(overall, F.col("n"))).alias("total"),
        F.count_if(by_provider).alias("proveedores"),
        F.count_if(by_tour).alias("tours"),
        F.max(F.when(by_provider, F.col("k"))).alias("max_proveedor"),
        F.max(F.when(by_tour, F.col("k"))).alias("max_tour"),
    ).select(
        "invalidas",
        "total",
        pct(invalid, F.col("total")).alias("pct"),
        "proveedores",
        "tours",
        pct(F.col("max_proveedor"), invalid).alias("pct_mayor_proveedor"),
        pct(F.col("max_tour"), invalid).alias("pct_mayor_tour"),
    )


def dq_booking_id(wh: Warehouse) -> DataFrame:
    """Booking ids that occur more than once in the raw table."""
    per_id = wh.raw_bookings.groupBy("reserva_id").agg(n_rows().alias("n"))
    summary = per_id.agg(F.count_if(F.col("n") > 1).alias("n"), n_rows().alias("total"))
    return checks(summary, [("reserva_id repetido", F.col("n"), F.col("total"))])


# --- customers ---------------------------------------------------------------


def dq_customer_dates(wh: Warehouse, today: dt.date | None = None) -> DataFrame:
    """Sign-ups and exits in the future, length of membership, placeholder birthdates.

    Without a date, today is the last booking day.
    """
    if today is None:
        now = wh.bookings.agg(F.max(F.to_date("fecha_reserva"))).scalar()
    else:
        now = F.lit(today)
    joined, gone = F.col("fecha_alta"), F.col("fecha_baja")
    length = days_between(joined, gone)
    return wh.raw_customers.agg(
        n_rows().alias("clientes"),
        F.count_if(joined > now).alias("alta_futura"),
        F.count_if(gone > now).alias("baja_futura"),
        F.min(length).alias("dias_min"),
        F.max(length).alias("dias_max"),
        rnd(mean(F.sum(length), F.count(length)), 1).alias("dias_media"),
        F.count_if(F.col("fecha_nacimiento") == F.lit(L.PLACEHOLDER_BIRTHDATE)).alias(
            "nacimiento_1900"
        ),
        F.count_if(F.col("dni").isNull()).alias("sin_dni"),
    )


def dq_malformed_lines(wh: Warehouse) -> DataFrame:
    """Lines delivered for each raw table, and those among them that could not be read.

    Both are counted while a table is staged; a table that is read where it lies is counted
    there, which reads no column of it.
    """
    counted = []
    for name, table in RAW_TABLES.items():
        lines, malformed, unread = wh.lines(name)
        columns = [lines.cast("long").alias("lineas"), malformed.cast("long").alias("malformadas")]
        if unread is None:
            one_row = wh.spark.range(1).select(*columns)
        else:
            one_row = unread.agg(*columns)
        counted.append(one_row.select(F.lit(table).alias("tabla"), "lineas", "malformadas"))
    return reduce(DataFrame.unionByName, counted)
