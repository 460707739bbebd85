"""Clean tables and shared roll-ups, written once as parquet and read by every metric."""

from __future__ import annotations

import datetime as dt
import json
import threading
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.operators.cleaning import (
    booking_copies,
    clean_bookings,
    clean_customers,
    clean_events,
    clean_tours,
    document_groups,
    repeated_codes,
)
from wayfare.operators.cohort import (
    booking_days,
    cohort,
    factors,
    first_bookings,
    hot_users,
    mature,
    user_histories,
)
from wayfare.operators.identity import (
    canonical_bookings,
    cookie_users,
    customer_crosswalk,
    flag_bots,
    identify_events,
    identity_map,
    with_destination,
)
from wayfare.operators.rates import repeat_cells
from wayfare.operators.sessions import (
    interest_days,
    session_bookings,
    session_days,
    session_numbers,
    sessions,
    usual_device,
)
from wayfare.operators.skew import Size
from wayfare.session import file_system, read_text, shared_folder, write_text
from wayfare.sources.layout import overlapping, write_ranges
from wayfare.sources.raw import CORRUPT, RawTables

# properties of a Warehouse in the order they build on each other
TABLES = (
    "document_groups",
    "crosswalk",
    "tours",
    "providers",
    "customers",
    "booking_codes",
    "bookings",
    "cookie_users",
    "identities",
    "events",
    "booking_days",
    "hot_users",
    "histories",
    "firsts",
    "firsts_with_tour",
    "repeat_cells",
    "session_days",
    "sessions",
    "session_numbers",
    "interest_days",
    "session_bookings",
    "usual_device",
    "booking_copies",
)
# raw tables by the name of their file
RAW_TABLES = {
    "bookings": "reservas",
    "customers": "clientes",
    "providers": "proveedores",
    "tours": "tours",
    "events": "ga_eventos",
}
# Tables in files by ranges of a column, and what spreads the rows that are equal in it.
LAYOUT = {
    "reservas": ("fecha_reserva", ["reserva_id"]),
    "ga_eventos": ("event_date", ["event_id"]),
    "sesiones_dia": ("dia", ["session_id"]),
    "reservas_dia": ("dia", ["canal", "destino", "estado", "antelacion"]),
}
# Tables that others look up; their size decides whether they are broadcast.
LOOKUPS = (
    "grupos_documento",
    "crosswalk_clientes",
    "identidades",
    "tours",
    "proveedores",
    "codigos_repetidos",
    "reservas_repetidas",
    "sesiones_reservas",
)
# How copies of raw tables are called.
STAGED = "raw_"
# what the dashboard reads, besides the events: property and folder
DASHBOARD_TABLES = {
    "bookings": "reservas",
    "booking_days": "reservas_dia",
    "tours": "tours",
    "firsts_with_tour": "primeras_reservas_con_tour",
    "session_days": "sesiones_dia",
    "usual_device": "dispositivo_habitual",
}

# What the dashboard needs of an event.
SLIM_EVENT_COLUMNS = (
    "session_id",
    "event_name",
    "event_date",
    "device",
    "user_id",
    "user_id_propagado",
    "es_bot",
    "reserva_id",
)


def slim_events(events: DataFrame) -> DataFrame:
    return events.select(*SLIM_EVENT_COLUMNS)


def _watched(name: str, df: DataFrame) -> list[Column]:
    """What is counted of a table while it is written."""
    if name in LOOKUPS:
        texts = [F.octet_length(f.name) for f in df.schema.fields if f.dataType == T.StringType()]
        text = sum((F.coalesce(F.sum(x), F.lit(0)) for x in texts), F.lit(0).cast("long"))
        return [F.count(F.lit(1)).alias("rows"), text.alias("text")]
    if name.startswith(STAGED):
        bad = F.count_if(F.col(CORRUPT).isNotNull()) if CORRUPT in df.columns else F.sum(F.lit(0))
        return [F.count(F.lit(1)).alias("rows"), bad.alias("malformed")]
    return []


class Warehouse:
    """Tables under one folder: built on first use from ``raw``, or read as they are without.

    Writing cuts the lineage: a lost executor costs the tasks it held, never a rebuild from
    raw, and the metrics see plain column-pruned scans.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        raw: RawTables | None = None,
        keep_unknown: bool = False,
        distinct_nulls: bool = False,
    ):
        """``keep_unknown`` leaves users the crosswalk lacks their id; ``distinct_nulls``
        keeps customers without a document apart."""
        self.spark = spark
        self._keep_unknown = keep_unknown
        self._distinct_nulls = distinct_nulls
        self.folder = folder.rstrip("/")
        self._raw = raw
        self._ready: dict[str, DataFrame] = {}
        self._notes: dict[str, dict[str, Any]] = {}
        self._lock = threading.RLock()

    @classmethod
    def scratch(cls, spark: SparkSession, raw: RawTables, **options: bool) -> Warehouse:
        """In a new folder, which ``close`` deletes, and the end of the application at last."""
        folder = f"{shared_folder(spark)}/wayfare-{uuid.uuid4().hex}"
        files, path = file_system(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        return cls(spark, folder, raw, **options)

    def close(self) -> None:
        """Delete the folder with all its tables; what was read from them cannot be used on."""
        with self._lock:
            files, path = file_system(self.spark, self.folder)
            files.delete(path, True)
            self._ready.clear()
            self._notes.clear()

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        with self._lock:
            if name not in self._ready:
                reader = self.spark.read
                if self._raw is not None:
                    df = build()
                    self._write(name, df)
                    reader = reader.schema(df.schema)
                self._ready[name] = reader.parquet(self.path(name))
            return self._ready[name]

    def _write(self, name: str, df: DataFrame, columns: Sequence[str] | None = None) -> None:
        """Write a table, and beside it what was seen of it on the way."""
        counted, seen = _watched(name, df), Observation()
        watched = df.observe(seen, *counted) if counted else df
        known: dict[str, Any] = {}
        if name in LAYOUT:
            key, spread_by = LAYOUT[name]
            chosen = list(columns or df.columns)
            known["files"] = write_ranges(watched, self.path(name), key, spread_by, chosen)
        else:
            watched.write.mode("overwrite").parquet(self.path(name))
        known |= {k: int(v or 0) for k, v in seen.get.items()} if counted else {}
        write_text(self.spark, self.path(f"notas/{name}.json"), json.dumps(known))
        self._notes[name] = known

    def notes(self, name: str) -> dict[str, Any]:
        """What is known of a written table, read without a job."""
        with self._lock:
            if name not in self._notes:
                text = read_text(self.spark, self.path(f"notas/{name}.json"))
                self._notes[name] = json.loads(text) if text else {}
            return self._notes[name]

    def size(self, name: str) -> Size | None:
        """Rows and bytes of text of a table that is looked up, as counted when it was written."""
        seen = self.notes(name)
        return Size(seen["rows"], seen["text"]) if "text" in seen else None

    def _between(
        self, name: str, table: DataFrame, since: dt.date | None, until: dt.date | None
    ) -> DataFrame:
        """The files of a table that overlap a range of the column it is laid out by."""
        listed = self.notes(name).get("files")
        chosen = None if listed is None else overlapping(listed, since, until)
        if chosen is None or len(chosen) == len(listed):
            return table
        if not chosen:
            return table.limit(0)
        reader = self.spark.read.schema(table.schema)
        return reader.parquet(*[f"{self.path(name)}/{file}" for file in chosen])

    def bookings_between(self, since: dt.date | None, until: dt.date | None) -> DataFrame:
        """Bookings without those in files wholly outside the days; the rest is not filtered."""
        return self._between("reservas", self.bookings, since, until)

    def booking_days_between(self, since: dt.date | None, until: dt.date | None) -> DataFrame:
        return self._between("reservas_dia", self.booking_days, since, until)

    def events_between(self, since: dt.date | None, until: dt.date | None) -> DataFrame:
        return self._between("ga_eventos", self.events, since, until)

    def session_days_between(self, since: dt.date | None, until: dt.date | None) -> DataFrame:
        return self._between("sesiones_dia", self.session_days, since, until)

    # --- raw tables, staged where their source is costly to read again ---------

    def _delivered(self, name: str) -> DataFrame:
        """A raw table with all lines, also those that could not be read."""
        if self._raw is not None and name not in self._raw.staged:
            return getattr(self._raw, name)
        return self._stored(f"{STAGED}{name}", lambda: getattr(self._raw, name))

    def _raw_table(self, name: str) -> DataFrame:
        """A raw table without malformed lines; those are in ``rejected``."""
        df = self._delivered(name)
        return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT) if CORRUPT in df.columns else df

    def rejected(self, name: str) -> DataFrame:
        """The malformed lines of a raw table, as they were delivered."""

        def build() -> DataFrame:
            df = self._delivered(name)
            line = F.col(CORRUPT) if CORRUPT in df.columns else F.lit(None).cast("string")
            return df.select(line.alias("linea")).where(F.col("linea").isNotNull())

        return self._stored(f"rechazados/{RAW_TABLES[name]}", build)

    def lines(self, name: str) -> tuple[Column, Column, DataFrame | None]:
        """How many lines a raw table was delivered with, and how many are malformed: counted
        while it was staged, else, of a table that is read where it is, to be counted there."""
        df = self._delivered(name)
        seen = self.notes(f"{STAGED}{name}")
        if "malformed" in seen:
            return F.lit(seen["rows"]), F.lit(seen["malformed"]), None
        bad = F.count_if(F.col(CORRUPT).isNotNull()) if CORRUPT in df.columns else F.lit(0)
        return F.count(F.lit(1)), bad, df

    @property
    def raw_bookings(self) -> DataFrame:
        return self._raw_table("bookings")

    @property
    def raw_customers(self) -> DataFrame:
        return self._raw_table("customers")

    @property
    def raw_providers(self) -> DataFrame:
        return self._raw_table("providers")

    @property
    def raw_tours(self) -> DataFrame:
        return self._raw_table("tours")

    @property
    def raw_events(self) -> DataFrame:
        return self._raw_table("events")

    # --- the six clean tables --------------------------------------------------

    @property
    def document_groups(self) -> DataFrame:
        return self._stored(
            "grupos_documento", lambda: document_groups(self.raw_customers, self._distinct_nulls)
        )

    @property
    def crosswalk(self) -> DataFrame:
        return self._stored(
            "crosswalk_clientes",
            lambda: customer_crosswalk(
                self.raw_customers,
                self._distinct_nulls,
                self.document_groups,
                self.size("grupos_documento"),
            ),
        )

    @property
    def tours(self) -> DataFrame:
        return self._stored("tours", lambda: clean_tours(self.raw_tours))

    @property
    def providers(self) -> DataFrame:
        return self._stored("proveedores", lambda: self.raw_providers)

    @property
    def customers(self) -> DataFrame:
        return self._stored(
            "clientes", lambda: clean_customers(self.raw_customers, self._distinct_nulls)
        )

    @property
    def booking_codes(self) -> DataFrame:
        """Codes of the values that several raw bookings share, to look for copies only there."""
        return self._stored("codigos_repetidos", lambda: repeated_codes(self.raw_bookings))

    @property
    def clean_bookings(self) -> DataFrame:
        """The bookings without copies, under the users as delivered; not written."""
        codes = self.booking_codes
        return clean_bookings(self.raw_bookings, codes, self.size("codigos_repetidos"))

    @property
    def bookings(self) -> DataFrame:
        """Clean bookings under canonical users, next to their tour's destination and price.

        In files by time of booking, so that a period opens only its own.
        """

        def build() -> DataFrame:
            raw = self.raw_bookings
            crosswalk, tours = self.crosswalk, self.tours
            canonical = canonical_bookings(
                self.clean_bookings,
                raw,
                crosswalk,
                self._keep_unknown,
                self.size("crosswalk_clientes"),
            )
            return with_destination(canonical, tours, raw, self.size("tours"))

        return self._stored("reservas", build)

    @property
    def events(self) -> DataFrame:
        """Clean events with identity and bot flag, in files by time."""

        def build() -> DataFrame:
            clean = clean_events(self.raw_events)
            identities = self.identities
            flagged = flag_bots(identify_events(clean, identities, self.size("identidades")))
            return flagged.withColumn("dia", F.to_date("event_date"))

        return self._stored("ga_eventos", build)

    # --- roll-ups several metrics share ----------------------------------------

    @property
    def cookie_users(self) -> DataFrame:
        return self._stored("cookies_usuarios", lambda: cookie_users(self.raw_events))

    @property
    def identities(self) -> DataFrame:
        return self._stored(
            "identidades",
            lambda: identity_map(
                self.cookie_users,
                self.crosswalk,
                self._keep_unknown,
                self.size("crosswalk_clientes"),
            ),
        )

    @property
    def booking_copies(self) -> DataFrame:
        def build() -> DataFrame:
            codes = self.booking_codes
            return booking_copies(self.raw_bookings, codes, self.size("codigos_repetidos"))

        return self._stored("reservas_repetidas", build)

    @property
    def booking_days(self) -> DataFrame:
        return self._stored("reservas_dia", lambda: booking_days(self.bookings))

    @property
    def hot_users(self) -> DataFrame:
        return self._stored("usuarios_frecuentes", lambda: hot_users(self.bookings))

    @property
    def histories(self) -> DataFrame:
        return self._stored(
            "historial_usuarios", lambda: user_histories(self.bookings, self.hot_users)
        )

    @property
    def firsts(self) -> DataFrame:
        return self._stored("primeras_reservas", lambda: first_bookings(self.histories))

    @property
    def firsts_with_tour(self) -> DataFrame:
        return self._stored(
            "primeras_reservas_con_tour",
            lambda: first_bookings(self.histories, with_tour_only=True),
        )

    @property
    def repeat_cells(self) -> DataFrame:
        """The mature cohort counted by every factor of the report, in one pass over it."""
        return self._stored(
            "tasas_repeticion", lambda: repeat_cells(mature(cohort(self.firsts)), factors())
        )

    @property
    def session_days(self) -> DataFrame:
        return self._stored("sesiones_dia", lambda: session_days(self.events))

    @property
    def sessions(self) -> DataFrame:
        """All sessions; without a named event a session counts as having reached no stage."""
        return self._stored("sesiones", lambda: sessions(self.session_days).fillna(0))

    @property
    def session_numbers(self) -> DataFrame:
        """Written, as the numbers are given once; a later reading would give others."""
        return self._stored("numeros_sesion", lambda: session_numbers(self.session_days))

    @property
    def interest_days(self) -> DataFrame:
        return self._stored(
            "interes_dia", lambda: interest_days(self.events, self.session_numbers)
        )

    @property
    def session_bookings(self) -> DataFrame:
        return self._stored("sesiones_reservas", lambda: session_bookings(self.events))

    @property
    def usual_device(self) -> DataFrame:
        return self._stored("dispositivo_habitual", lambda: usual_device(self.events))

    def write_all(self) -> Warehouse:
        for name in RAW_TABLES:
            self.rejected(name)
        for name in TABLES:
            getattr(self, name)
        return self

    def write_slim(self, folder: str) -> Warehouse:
        """Copy for the dashboard: the tables that it reads, events with eight columns.

        A ``Warehouse`` of that folder answers every query that takes ``Filters``.
        """
        copy = Warehouse(self.spark, folder)
        for name, table in DASHBOARD_TABLES.items():
            copy._write(table, getattr(self, name))
        copy._write("ga_eventos", self.events, (*SLIM_EVENT_COLUMNS, "dia"))
        return copy
