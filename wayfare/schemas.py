"""Columns and types of the five raw tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


BOOKINGS = _struct(
    reserva_id=T.LongType(),
    user_id=T.LongType(),
    tour_id=T.LongType(),
    proveedor_id=T.LongType(),
    fecha_reserva=T.TimestampNTZType(),
    fecha_actividad=T.DateType(),
    estado=T.StringType(),
    personas=T.IntegerType(),
    importe_eur=MONEY,
    campana=T.StringType(),
    canal=T.StringType(),
)
CUSTOMERS = _struct(
    user_id=T.LongType(),
    dni=T.StringType(),
    email=T.StringType(),
    fecha_nacimiento=T.DateType(),
    fecha_alta=T.DateType(),
    fecha_baja=T.DateType(),
)
PROVIDERS = _struct(
    proveedor_id=T.LongType(),
    nombre=T.StringType(),
    fecha_baja=T.DateType(),
)
TOURS = _struct(
    tour_id=T.LongType(),
    proveedor_id=T.LongType(),
    url=T.StringType(),
    descripcion=T.StringType(),
    precio_por_persona_eur=MONEY,
)
# event_date stays text: the export mixes two timestamp formats.
EVENTS = _struct(
    event_id=T.LongType(),
    cookie_id=T.StringType(),
    session_id=T.StringType(),
    temp_client_id=T.StringType(),
    user_id=T.LongType(),
    event_name=T.StringType(),
    event_date=T.StringType(),
    device=T.StringType(),
    url=T.StringType(),
    reserva_id=T.LongType(),
)

# file name of each raw table -> its schema
RAW = {
    "reservas": BOOKINGS,
    "clientes": CUSTOMERS,
    "proveedores": PROVIDERS,
    "tours": TOURS,
    "ga_eventos": EVENTS,
}

# Everything but the id: two bookings equal in all of these are copies.
BOOKING_KEY = [name for name in BOOKINGS.names if name != "reserva_id"]
