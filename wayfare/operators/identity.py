"""Customer identity: document crosswalk, id translation, propagation by cookie, bots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare import labels as L
from wayfare.operators.cleaning import document_groups, document_key
from wayfare.operators.skew import Size, balanced_lookup, key_counts


def customer_crosswalk(
    raw_customers: DataFrame,
    distinct_nulls: bool = False,
    groups: DataFrame | None = None,
    size: Size | None = None,
) -> DataFrame:
    """Original user id -> lowest user id with the same document number.

    ``groups`` are the document groups as a written table of the given ``size``, which tells
    whether they can be broadcast; customers are then read once.
    """
    people = raw_customers.select(
        F.col("user_id").alias("user_id_original"), document_key(distinct_nulls).alias("dni_key")
    )
    written = groups is not None
    groups = groups if written else document_groups(raw_customers, distinct_nulls)
    return balanced_lookup(
        people,
        groups.select("dni_key", "user_id_canonico"),
        on=["dni_key"],
        spread_by="user_id_original",
        counts=groups.select("dni_key", "_n"),
        broadcast_rows=None if written else 0,
        size=size,
    ).select("user_id_original", "user_id_canonico")


def translate_users(
    facts: DataFrame,
    crosswalk: DataFrame,
    spread_by: str,
    counts: DataFrame | None = None,
    keep_unknown: bool = False,
    size: Size | None = None,
) -> DataFrame:
    """Replace ``user_id`` by its canonical id; ids the crosswalk lacks become NULL."""
    known = crosswalk.where(F.col("user_id_original").isNotNull()).select(
        F.col("user_id_original").alias("user_id"), "user_id_canonico"
    )
    joined = balanced_lookup(
        facts, known, on=["user_id"], spread_by=spread_by, counts=counts, size=size
    )
    canonical = F.col("user_id_canonico")
    user = F.coalesce(canonical, F.col("user_id")) if keep_unknown else canonical
    return joined.withColumn("user_id", user).select(*facts.columns)


def cookie_users(events: DataFrame) -> DataFrame:
    """Events, and events with a booking id, per cookie and delivered user id."""
    return events.groupBy("cookie_id", "user_id").agg(
        F.count(F.lit(1)).alias("eventos"), F.count("reserva_id").alias("con_reserva")
    )


def identity_map(
    pairs: DataFrame,
    crosswalk: DataFrame,
    keep_unknown: bool = False,
    size: Size | None = None,
) -> DataFrame:
    """``cookie_users`` with the canonical user id and the id its cookie belongs to.

    Translation and propagation work on one row per cookie and user instead of on events.
    """
    known = translate_users(
        pairs.where(F.col("user_id").isNotNull())
        .select("cookie_id", "user_id", F.col("user_id").alias("delivered")),
        crosswalk,
        spread_by="cookie_id",
        keep_unknown=keep_unknown,
        size=size,
    ).where(F.col("user_id").isNotNull())
    owner = known.groupBy("cookie_id").agg(F.max("user_id").alias("user_id_propagado"))
    translation = known.select(
        F.col("cookie_id").alias("_cookie"),
        F.col("delivered").alias("_user"),
        F.col("user_id").alias("user_id_canonico"),
    )
    # a pair occurs once, so this key cannot be hot
    same_cookie = F.col("cookie_id").eqNullSafe(F.col("_cookie"))
    same_pair = same_cookie & (F.col("user_id") == F.col("_user"))
    translated = pairs.join(translation, same_pair, "left").select(
        *pairs.columns, "user_id_canonico"
    )
    return balanced_lookup(
        translated,
        owner,
        on=["cookie_id"],
        spread_by="user_id",
        counts=key_counts(pairs, ["cookie_id"]),
        broadcast_rows=0,
    )


def identify_events(
    events: DataFrame, identities: DataFrame, size: Size | None = None
) -> DataFrame:
    """Translate ``user_id`` and add ``user_id_propagado`` with one join per event."""
    pair = ["cookie_id", "user_id"]
    resolved = identities.where(F.col("user_id_propagado").isNotNull()).select(
        *pair, "user_id_canonico", "user_id_propagado"
    )
    joined = balanced_lookup(
        events,
        resolved,
        on=pair,
        spread_by="event_id",
        counts=identities.select(*pair, F.col("eventos").alias("_n")),
        size=size,
    )
    return joined.withColumn("user_id", F.col("user_id_canonico")).select(
        *events.columns, "user_id_propagado"
    )


def flag_bots(events: DataFrame, bot_ids: Sequence[str] = L.BOT_CLIENT_IDS) -> DataFrame:
    is_bot = F.col("temp_client_id").isin(*bot_ids)
    return events.withColumn("es_bot", F.coalesce(is_bot, F.lit(False)))


def canonical_bookings(
    clean: DataFrame,
    raw: DataFrame,
    crosswalk: DataFrame,
    keep_unknown: bool = False,
    size: Size | None = None,
) -> DataFrame:
    """Cleaned bookings under canonical user ids.

    Hot users are counted on the raw column: a one-column scan, and an upper bound of what
    is left after the copies are gone.
    """
    return translate_users(
        clean,
        crosswalk,
        spread_by="reserva_id",
        counts=key_counts(raw, ["user_id"]),
        keep_unknown=keep_unknown,
        size=size,
    )


def with_destination(
    bookings: DataFrame, tours: DataFrame, raw: DataFrame, size: Size | None = None
) -> DataFrame:
    """Add the tour's destination and price; ``tour_conocido`` tells an inner join's rows."""
    catalogue = tours.where(F.col("tour_id").isNotNull()).select(
        "tour_id", "destino", "precio_por_persona_eur", F.lit(True).alias("tour_conocido")
    )
    joined = balanced_lookup(
        bookings,
        catalogue,
        on=["tour_id"],
        spread_by="reserva_id",
        counts=key_counts(raw, ["tour_id"]),
        size=size,
    )
    return joined.withColumn("tour_conocido", F.coalesce("tour_conocido", F.lit(False)))
