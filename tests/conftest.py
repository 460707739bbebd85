from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wayfare import schemas  # noqa: E402
from wayfare.session import local_session  # noqa: E402
from wayfare.sources.raw import RawTables  # noqa: E402
from wayfare.sources.warehouse import Warehouse  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session("4", shuffle_partitions=4, memory="4g", shared=shared)
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def when(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


class Maker:
    """Small raw tables from keyword rows; what a row leaves out gets a harmless default."""

    DEFAULTS = {
        "bookings": dict(
            user_id=1, tour_id=1, proveedor_id=1, fecha_reserva=when("2025-01-01 10:00:00"),
            fecha_actividad=day("2025-01-10"), estado="confirmada", personas=2, importe_eur=100,
            campana="C1", canal="SEO",
        ),
        "customers": dict(
            email="x", fecha_nacimiento=day("1980-06-15"), fecha_alta=day("2020-01-01")
        ),
        "providers": dict(nombre="p"),
        "tours": dict(
            proveedor_id=1, url="https://h/es/madrid/t/", descripcion="d",
            precio_por_persona_eur=20,
        ),
        "events": dict(
            cookie_id="c1", session_id="s1", temp_client_id="T1", event_name="view_item",
            event_date="2025-01-01 10:00:00", device="mobile", url="https://h/es/madrid/t/",
        ),
    }
    SCHEMAS = {
        "bookings": schemas.BOOKINGS,
        "customers": schemas.CUSTOMERS,
        "providers": schemas.PROVIDERS,
        "tours": schemas.TOURS,
        "events": schemas.EVENTS,
    }
    IDS = {"bookings": "reserva_id", "events": "event_id"}

    def __init__(self, spark):
        self.spark = spark

    def table(self, name: str, *rows: dict):
        schema = self.SCHEMAS[name]
        full = []
        for i, row in enumerate(rows, 1):
            values = {**self.DEFAULTS[name], **row}
            if name in self.IDS:
                values.setdefault(self.IDS[name], i)
            for money in ("importe_eur", "precio_por_persona_eur"):
                if values.get(money) is not None:
                    values[money] = Decimal(str(values[money])).quantize(Decimal("0.01"))
            full.append(tuple(values.get(c) for c in schema.names))
        return self.spark.createDataFrame(full, schema)

    def warehouse(self, **tables) -> Warehouse:
        tables.setdefault("customers", [dict(user_id=u, dni=f"D{u}") for u in range(1, 30)])
        tables.setdefault("providers", [dict(proveedor_id=1)])
        tables.setdefault("tours", [dict(tour_id=1)])
        raw = {n: self.table(n, *tables.get(n, ())) for n in self.SCHEMAS}
        return Warehouse.scratch(self.spark, RawTables(**raw))


@pytest.fixture(scope="session")
def make(spark):
    return Maker(spark)


def rows(df) -> list[tuple]:
    """Rows as sorted tuples, NULLs first."""
    return sorted(
        (tuple(r) for r in df.collect()), key=lambda t: [(v is not None, str(v)) for v in t]
    )


def dicts(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def by(df, key: str) -> dict:
    return {r[key]: r.asDict() for r in df.collect()}
