"""Fixed values of the domain: codes found in the data, thresholds and result labels.

Results are compared by label, so every label a result can carry is listed here.
"""

from __future__ import annotations

import datetime as dt

# --- Fixed values: booking states -------------------------------------------
CONFIRMED = "confirmada"
CANCELLED = "cancelada"
PENDING = "pendiente"
CANCELLED_SYNONYM = "cancelled"
RESOLVED = (CONFIRMED, CANCELLED)

# --- Fixed values: cleaning --------------------------------------------------
DEVICE_TYPOS = {"desktp": "desktop"}
BOT_CLIENT_IDS = ("Tbot0000000",)
ORPHAN_PROVIDERS = (1099,)
PLACEHOLDER_BIRTHDATE = dt.date(1900, 1, 1)
# the two timestamp formats of the event export: shape of the text, how to read it
ISO_TIMESTAMP = (r"^\d{1,4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "y-M-d H:m:s")
DAY_FIRST_TIMESTAMP = (r"^\d{1,2}/\d{1,2}/\d{1,4} \d{1,2}:\d{1,2}$", "d/M/y H:m")
PADDED_TIMESTAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
DESTINATION_URL_PART = 5

# --- Fixed values: web events ------------------------------------------------
VIEW_ITEM = "view_item"
BEGIN_CHECKOUT = "begin_checkout"
PURCHASE = "purchase"

# --- Fixed values: thresholds ------------------------------------------------
MATURE_DAYS = 180
SAME_TRIP_DAYS = 14
EARLY_REPEAT_DAYS = 90
Z_95 = 1.96
MIN_GROUP_REPORT = 25
MIN_GROUP_DASHBOARD = 20
MIN_RESOLVED_PER_PERIOD = 15
MIN_BOOKINGS_PER_MONTH = 20
AMOUNT_EDGES = (50, 100, 200)
SALES_START = dt.date(2024, 7, 1)
EXCLUDED_CHANNEL = "Email"

# --- Fixed values: result labels ---------------------------------------------
SAME_TRIP = "mismo viaje (<=14d)"
REAL_REPEAT = "recompra real (>14d)"
REPEATS = "recompra"
SINGLE = "una sola vez"
FREE, PAID = "free", "pago"
FIRST_FREE, FIRST_PAID = "1a = free tour", "1a = de pago"
DASH_FREE, DASH_PAID = "free tour", "de pago"
AMOUNT_ZERO = "0 (free)"
NULL_GROUP = "(nulo)"
NO_CAMPAIGN = "(sin campana)"
DASH_NO_CAMPAIGN = "Sin campaña"
HAD_CANCELLATION = "sufrio una cancelacion"
NO_CANCELLATION = "sin cancelaciones"
IDENTIFIED, ANONYMOUS = "identificada", "anonima"
DASH_ANONYMOUS = "anónima"
TOTAL = "TOTAL"
LEAD_FACTOR = ("0-7d", "8-30d", "31-90d", "90+d")
LEAD_REPORT = ("0-7 d", "8-30 d", "31-90 d", "90+ d")
LEAD_DASHBOARD = ("0-7 días", "8-30 días", "31-90 días", "90+ días")
LEAD_NEGATIVE = "negativo"
PARTY_SIZES = ("1", "2", "3-4", "5+")
GROSS_RATE = "Bruto (todas las sesiones)"
IDENTIFIED_RATE = "Entre sesiones identificadas"
PRESETS = (
    "con_volumen",
    "todo",
    "ultimos_365_dias",
    "ultimos_182_dias",
    "ultimos_90_dias",
)
PRESET_DAYS = (365, 182, 90)
GRAINS = ("day", "week", "month")
