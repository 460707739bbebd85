"""The five raw tables: from CSV files, or derived from the benchmark's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.schemas import MONEY, RAW
from wayfare.session import scan_bytes

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class RawTables:
    """The raw tables. Those named in ``staged`` are worth a parquet copy before use: text
    that would be parsed again in every pass, or the result of a join."""

    bookings: DataFrame
    customers: DataFrame
    providers: DataFrame
    tours: DataFrame
    events: DataFrame
    staged: tuple[str, ...] = ()

    def scan_bytes(self) -> int:
        """Bytes of input behind all five tables, by the columns read."""
        tables = (self.bookings, self.customers, self.providers, self.tours, self.events)
        return sum(map(scan_bytes, tables))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a CSV with header under a fixed schema, whatever its column order.

    Only the header is looked at to put the types in file order. Columns the schema does
    not know stay as text; a malformed line keeps its text in ``_corrupt_record``. In a folder
    of parts all headers must agree: one that differs stops the job.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = set(schema.names) - set(header) - {"event_id"}
    if missing:
        raise ValueError(f"{path} lacks columns {sorted(missing)}")
    kinds = {f.name: f.dataType for f in schema.fields}
    in_file_order = T.StructType(
        [T.StructField(name, kinds.get(name, T.StringType()), True) for name in header]
        + [T.StructField(CORRUPT, T.StringType(), True)]
    )
    df = (
        spark.read.schema(in_file_order)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("enforceSchema", False)
        .csv(path)
    )
    if "event_id" in schema.names and "event_id" not in header:
        # It only spreads rows, it identifies nothing. Equal lines differ by the file and the
        # block that they are in; what is in one block is read by one task anyway.
        block = [F.col(f"_metadata.{part}") for part in ("file_path", "file_block_start")]
        df = df.withColumn("event_id", F.xxhash64(*header, *block))
    extra = [c for c in header if c not in kinds]
    return df.select(*schema.names, *extra, CORRUPT)


def from_csv(spark: SparkSession, folder: str) -> RawTables:
    tables = {
        name: read_csv(spark, f"{folder.rstrip('/')}/{name}.csv", schema)
        for name, schema in RAW.items()
    }
    return RawTables(
        bookings=tables["reservas"],
        customers=tables["clientes"],
        providers=tables["proveedores"],
        tours=tables["tours"],
        events=tables["ga_eventos"],
        staged=("bookings", "customers", "providers", "tours", "events"),
    )


def _tours(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    return part.select(
        key.alias("tour_id"),
        F.when(key % 65 == 8, F.lit(1099).cast("long")).otherwise(key % 10).alias("proveedor_id"),
        F.concat(
            F.lit("https://www.example.com/es/"),
            F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))),
            F.lit("/"),
            F.replace("p_name", F.lit(" "), F.lit("-")),
            F.lit("/"),
        ).alias("url"),
        F.col("p_name").alias("descripcion"),
        F.col("p_retailprice").cast(MONEY).alias("precio_por_persona_eur"),
    )


def _providers(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        key.alias("proveedor_id"),
        F.col("s_name").alias("nombre"),
        F.when(key % 10 == 3, F.to_date(F.lit("1998-06-30"))).alias("fecha_baja"),
    )


def _customers(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    dni = F.when(key % 100 == 1, F.concat(F.lit("dni"), key - 1)).otherwise(
        F.concat(F.lit("DNI"), key)
    )
    born = F.date_add(F.to_date(F.lit("1950-01-01")), (key * 37 % 18000).cast("int"))
    return customer.select(
        key.alias("user_id"),
        F.when(key % 70 != 3, dni).alias("dni"),
        F.concat(F.lit("u"), key, F.lit("@example.com")).alias("email"),
        F.when(key % 145 == 0, F.to_date(F.lit("1900-01-01")))
        .otherwise(born)
        .alias("fecha_nacimiento"),
        F.date_add(F.to_date(F.lit("1994-01-01")), (key % 365).cast("int")).alias("fecha_alta"),
        F.when(key % 100 == 5, F.to_date(F.lit("2002-01-01"))).alias("fecha_baja"),
    )


def _bookings(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    first_line = lineitem.groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("tour_id"), F.min("l_suppkey").alias("proveedor_id")
    )
    key = F.col("o_orderkey")
    status, urgency = F.col("o_orderstatus"), F.col("o_orderpriority")
    state = (
        F.when(status == "F", "confirmada")
        .when((status == "P") & (key % 6 == 0), "CANCELLED")
        .when((status == "P") & (key % 3 == 0), "cancelada")
        .when((status == "O") & (key % 4 == 0), "Pendiente")
        .otherwise("Confirmada")
    )
    channel = (
        F.when(key % 11 == 0, "Afiliados")
        .when(urgency == "1-URGENT", "Directo")
        .when(urgency == "2-HIGH", "SEO")
        .when(urgency == "3-MEDIUM", "SEM")
        .when(urgency == "4-NOT SPECIFIED", "Social")
        .otherwise("Email")
    )
    # every 333rd booking comes a second time under an id 500,000 higher
    shifts = F.when(key % 333 == 0, F.array(F.lit(0), F.lit(500000))).otherwise(F.array(F.lit(0)))
    free = key % 6 == 0
    return (
        orders.join(first_line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .withColumn("shift", F.explode(shifts))
        .select(
            (key + 900001 + F.col("shift")).alias("reserva_id"),
            F.when(key % 397 == 5, F.lit(9999999).cast("long"))
            .otherwise(F.col("o_custkey"))
            .alias("user_id"),
            "tour_id",
            "proveedor_id",
            F.col("o_orderdate").alias("fecha_reserva"),
            F.date_add(F.to_date("o_orderdate"), (key % 121 - 2).cast("int")).alias(
                "fecha_actividad"
            ),
            state.alias("estado"),
            (key % 7 - 1).cast("int").alias("personas"),
            F.when(free, F.lit(0.0)).otherwise(F.col("o_totalprice")).cast(MONEY).alias(
                "importe_eur"
            ),
            F.when(key % 5 != 0, F.concat(F.lit("C"), key % 8)).alias("campana"),
            channel.alias("canal"),
        )
    )


def _events(events: DataFrame) -> DataFrame:
    key, user, kind, ts = (F.col(c) for c in ("event_id", "user_id", "event_type", "ts"))
    cookie = F.concat(F.lit("ck"), user, F.lit("-"), key % 3)
    bot = user % 50 == 7
    device = (
        F.when((key % 3 == 0) & (key % 4 == 0), "desktp")
        .when(key % 3 == 0, "Desktop")
        .when((key % 3 == 1) & (key % 2 == 0), "MOBILE")
        .when(key % 3 == 1, "mobile")
        .otherwise("Tablet")
    )
    name = (
        F.when(kind == "view", "view_item")
        .when(kind == "signup", "begin_checkout")
        .when(kind == "purchase", "purchase")
        .when(kind == "click", "page_view")
        .otherwise("scroll")
    )
    page = F.concat(F.lit("https://www.example.com/es/brand-"), key % 30, F.lit("/x/"))
    return events.select(
        "event_id",
        cookie.alias("cookie_id"),
        F.concat(cookie, F.lit("-"), F.date_format(ts, "yyyyMMdd")).alias("session_id"),
        F.when(bot, "Tbot0000000").otherwise(F.concat(F.lit("T"), user)).alias("temp_client_id"),
        F.when((key % 12 == 0) & ~bot, user).alias("user_id"),
        name.alias("event_name"),
        F.when(key % 20 == 0, F.date_format(ts, "dd/MM/yyyy HH:mm"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .alias("event_date"),
        device.alias("device"),
        F.when(kind == "error", "https://www.example.com/").otherwise(page).alias("url"),
        F.when((kind == "purchase") & (key % 12 == 0), key + 900001).alias("reserva_id"),
    )


def from_benchmark(spark: SparkSession, sf_dir: str) -> RawTables:
    """Raw tables derived from the benchmark's parquet tables (see FIXTURES.md)."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    return RawTables(
        bookings=_bookings(table("orders"), table("lineitem")),
        customers=_customers(table("customer")),
        providers=_providers(table("supplier")),
        tours=_tours(table("part")),
        events=_events(table("events")),
        staged=("bookings",),
    )
