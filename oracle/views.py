"""Named subqueries the statements start from, each with the ones it needs.

``raw_*`` derive the domain tables from the benchmark's tables, the others clean and
connect them in the plainest way SQL offers; nothing here is tuned.
"""

from __future__ import annotations

KEY = (
    "user_id, tour_id, proveedor_id, fecha_reserva, fecha_actividad, estado, personas, "
    "importe_eur, campana, canal"
)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_tours": (
        (),
        """
        SELECT p_partkey AS tour_id,
               CASE WHEN p_partkey % 65 = 8 THEN 1099 ELSE p_partkey % 10 END AS proveedor_id,
               'https://www.example.com/es/' || lower(replace(p_brand, '#', '-')) || '/'
                 || replace(p_name, ' ', '-') || '/' AS url,
               p_name AS descripcion,
               CAST(p_retailprice AS DECIMAL(18,2)) AS precio_por_persona_eur
        FROM part
        """,
    ),
    "raw_providers": (
        (),
        """
        SELECT s_suppkey AS proveedor_id, s_name AS nombre,
               CASE WHEN s_suppkey % 10 = 3 THEN DATE '1998-06-30' END AS fecha_baja
        FROM supplier
        """,
    ),
    "raw_customers": (
        (),
        """
        SELECT c_custkey AS user_id,
               CASE WHEN c_custkey % 70 = 3 THEN NULL
                    WHEN c_custkey % 100 = 1 THEN 'dni' || (c_custkey - 1)
                    ELSE 'DNI' || c_custkey END AS dni,
               'u' || c_custkey || '@example.com' AS email,
               CASE WHEN c_custkey % 145 = 0 THEN DATE '1900-01-01'
                    ELSE DATE '1950-01-01' + CAST(c_custkey * 37 % 18000 AS INTEGER)
               END AS fecha_nacimiento,
               DATE '1994-01-01' + CAST(c_custkey % 365 AS INTEGER) AS fecha_alta,
               CASE WHEN c_custkey % 100 = 5 THEN DATE '2002-01-01' END AS fecha_baja
        FROM customer
        """,
    ),
    "raw_bookings": (
        (),
        """
        SELECT o_orderkey + 900001 + shift AS reserva_id,
               CASE WHEN o_orderkey % 397 = 5 THEN 9999999 ELSE o_custkey END AS user_id,
               tour_id, proveedor_id, o_orderdate AS fecha_reserva,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 121 - 2 AS INTEGER) AS fecha_actividad,
               CASE WHEN o_orderstatus = 'F' THEN 'confirmada'
                    WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0
                      THEN CASE WHEN o_orderkey % 2 = 0 THEN 'CANCELLED' ELSE 'cancelada' END
                    WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'Pendiente'
                    ELSE 'Confirmada' END AS estado,
               CAST(o_orderkey % 7 - 1 AS INTEGER) AS personas,
               CAST(CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_totalprice END
                    AS DECIMAL(18,2)) AS importe_eur,
               CASE WHEN o_orderkey % 5 <> 0 THEN 'C' || (o_orderkey % 8) END AS campana,
               CASE WHEN o_orderkey % 11 = 0 THEN 'Afiliados'
                    WHEN o_orderpriority = '1-URGENT' THEN 'Directo'
                    WHEN o_orderpriority = '2-HIGH' THEN 'SEO'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'SEM'
                    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Social'
                    ELSE 'Email' END AS canal
        FROM orders
        LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS tour_id, min(l_suppkey) AS proveedor_id
                   FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
        JOIN (VALUES (0), (500000)) AS copies(shift) ON shift = 0 OR o_orderkey % 333 = 0
        """,
    ),
    "raw_events": (
        (),
        """
        SELECT event_id,
               'ck' || user_id || '-' || (event_id % 3) AS cookie_id,
               'ck' || user_id || '-' || (event_id % 3) || '-' || strftime(ts, '%Y%m%d')
                 AS session_id,
               CASE WHEN user_id % 50 = 7 THEN 'Tbot0000000' ELSE 'T' || user_id END
                 AS temp_client_id,
               CASE WHEN event_id % 12 = 0 AND user_id % 50 <> 7 THEN user_id END AS user_id,
               CASE event_type WHEN 'view' THEN 'view_item' WHEN 'signup' THEN 'begin_checkout'
                    WHEN 'purchase' THEN 'purchase' WHEN 'click' THEN 'page_view'
                    ELSE 'scroll' END AS event_name,
               CASE WHEN event_id % 20 = 0 THEN strftime(ts, '%d/%m/%Y %H:%M')
                    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS event_date,
               CASE event_id % 3
                    WHEN 0 THEN CASE WHEN event_id % 4 = 0 THEN 'desktp' ELSE 'Desktop' END
                    WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'MOBILE' ELSE 'mobile' END
                    ELSE 'Tablet' END AS device,
               CASE WHEN event_type = 'error' THEN 'https://www.example.com/'
                    ELSE 'https://www.example.com/es/brand-' || (event_id % 30) || '/x/' END AS url,
               CASE WHEN event_type = 'purchase' AND event_id % 12 = 0
                    THEN 900001 + event_id END AS reserva_id
        FROM events
        """,
    ),
    "xw": (
        ("raw_customers",),
        """
        SELECT c.user_id AS original, g.lowest AS canonical
        FROM raw_customers c
        JOIN (SELECT lower(dni) AS doc, min(user_id) AS lowest FROM raw_customers GROUP BY 1) g
          ON lower(c.dni) IS NOT DISTINCT FROM g.doc
        """,
    ),
    "customers": (
        ("raw_customers", "xw"),
        """
        SELECT user_id, dni, email,
               NULLIF(fecha_nacimiento, DATE '1900-01-01') AS fecha_nacimiento,
               fecha_alta, fecha_baja
        FROM raw_customers JOIN xw ON original = user_id AND canonical = user_id
        """,
    ),
    "tours": (
        ("raw_tours",),
        """
        SELECT tour_id, NULLIF(proveedor_id, 1099) AS proveedor_id, url, descripcion,
               precio_por_persona_eur, split_part(url, '/', 5) AS destino
        FROM raw_tours
        """,
    ),
    "unique_bookings": (
        ("raw_bookings",),
        f"""
        SELECT min(reserva_id) AS reserva_id, {KEY}
        FROM raw_bookings GROUP BY {KEY}
        """,
    ),
    "clean": (
        ("unique_bookings",),
        """
        SELECT * REPLACE (
            replace(lower(estado), 'cancelled', 'cancelada') AS estado,
            CASE WHEN personas > 0 THEN personas END AS personas)
        FROM unique_bookings
        """,
    ),
    "bk": (
        ("clean", "xw"),
        """
        SELECT clean.* REPLACE (canonical AS user_id)
        FROM clean LEFT JOIN xw ON original = clean.user_id
        """,
    ),
    "bkt": (
        ("bk", "tours"),
        """
        SELECT bk.*, destino, precio_por_persona_eur FROM bk JOIN tours USING (tour_id)
        """,
    ),
    "ev_clean": (
        ("raw_events",),
        """
        SELECT * REPLACE (
            CASE WHEN event_date LIKE '____-__-__ %' THEN TRY_CAST(event_date AS TIMESTAMP)
                 ELSE try_strptime(event_date, '%d/%m/%Y %H:%M') END AS event_date,
            replace(lower(device), 'desktp', 'desktop') AS device)
        FROM raw_events
        """,
    ),
    "ev": (
        ("ev_clean", "xw"),
        """
        SELECT t.*, o.owner AS user_id_propagado,
               coalesce(t.temp_client_id = 'Tbot0000000', false) AS es_bot
        FROM (SELECT e.* REPLACE (canonical AS user_id)
              FROM ev_clean e LEFT JOIN xw ON original = e.user_id) t
        LEFT JOIN (SELECT cookie_id, max(canonical) AS owner
                   FROM ev_clean JOIN xw ON original = user_id GROUP BY 1) o
          ON o.cookie_id IS NOT DISTINCT FROM t.cookie_id
        """,
    ),
    "web": (("ev",), "SELECT * FROM ev WHERE NOT es_bot"),
    "ses": (
        ("web",),
        """
        SELECT session_id, min(device) AS device,
               CAST(bool_or(user_id_propagado IS NOT NULL) AS INTEGER) AS ident,
               CAST(coalesce(bool_or(event_name = 'view_item'), false) AS INTEGER) AS vi,
               CAST(coalesce(bool_or(event_name = 'begin_checkout'), false) AS INTEGER) AS bc,
               CAST(coalesce(bool_or(event_name = 'purchase'), false) AS INTEGER) AS pu,
               CAST(bool_or(reserva_id IS NOT NULL) AS INTEGER) AS linked
        FROM web GROUP BY session_id
        """,
    ),
    "device_of": (
        ("web",),
        """
        SELECT user_id, list(device ORDER BY n DESC, device)[1] AS device
        FROM (SELECT user_id, device, count(DISTINCT session_id) AS n
              FROM web WHERE user_id IS NOT NULL GROUP BY ALL)
        GROUP BY user_id
        """,
    ),
    "ranked": (
        ("bk",),
        """
        SELECT *, CAST(fecha_reserva AS DATE) AS fr, CAST(fecha_actividad AS DATE) AS fa,
               row_number() OVER (PARTITION BY user_id
                                  ORDER BY fecha_reserva NULLS LAST, reserva_id) AS pos
        FROM bk WHERE estado = 'confirmada'
        """,
    ),
    "cohort": (
        ("ranked", "bk"),
        """
        SELECT f.*, n.fr AS next_fr, last_day - f.fa AS exposure,
               CAST(coalesce(n.fr > f.fa, false) AS INTEGER) AS back
        FROM ranked f
        JOIN (SELECT CAST(max(fecha_reserva) AS DATE) AS last_day FROM bk) ON f.fa <= last_day
        LEFT JOIN ranked n ON n.user_id = f.user_id AND n.pos = 2
        WHERE f.pos = 1
        """,
    ),
    "ripe": (("cohort",), "SELECT * FROM cohort WHERE exposure >= 180"),
    "ripe_t": (
        ("ripe", "tours"),
        "SELECT ripe.*, destino FROM ripe JOIN tours USING (tour_id)",
    ),
    "sel": (
        ("bkt",),
        """
        SELECT * FROM bkt
        WHERE CAST(fecha_reserva AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
          AND canal IN ('Afiliados', 'Directo', 'SEM', 'SEO', 'Social')
          AND destino IN (SELECT 'brand-' || i FROM range(1, 16) r(i))
        """,
    ),
    "dash_ranked": (
        ("bkt",),
        """
        SELECT *, CAST(fecha_reserva AS DATE) AS fr, CAST(fecha_actividad AS DATE) AS fa,
               row_number() OVER (PARTITION BY user_id
                                  ORDER BY fecha_reserva NULLS LAST, reserva_id) AS pos
        FROM bkt WHERE estado = 'confirmada'
        """,
    ),
    "dash": (
        ("dash_ranked",),
        """
        SELECT f.user_id, f.canal, f.campana, f.importe_eur, f.tour_id, f.destino, f.fa AS fa1,
               coalesce(n.fr > f.fa, false) AS recurrente,
               CAST((SELECT max(fr) FROM dash_ranked) - f.fa AS INTEGER) AS dias_exposicion
        FROM dash_ranked f
        LEFT JOIN dash_ranked n ON n.user_id = f.user_id AND n.pos = 2
        WHERE f.pos = 1 AND f.fa BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'
          AND f.canal IN ('Afiliados', 'Directo', 'SEM', 'SEO', 'Social')
          AND f.destino IN (SELECT 'brand-' || i FROM range(1, 16) r(i))
        """,
    ),
    "dash_ripe": (
        ("dash",),
        "SELECT * FROM dash WHERE dias_exposicion >= 180",
    ),
    "dash_ses": (
        ("web",),
        """
        SELECT session_id, CAST(date_trunc('week', min(event_date)) AS DATE) AS periodo,
               CAST(bool_or(user_id_propagado IS NOT NULL) AS INTEGER) AS ident,
               CAST(bool_or(event_name = 'view_item') AS INTEGER) AS vi,
               CAST(bool_or(event_name = 'begin_checkout') AS INTEGER) AS bc,
               CAST(bool_or(event_name = 'purchase') AS INTEGER) AS pu,
               min(device) AS device
        FROM web
        WHERE CAST(event_date AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'
        GROUP BY session_id
        """,
    ),
}


def _needed(names: tuple[str, ...], seen: dict[str, None]) -> dict[str, None]:
    for name in names:
        if name not in seen:
            _needed(VIEWS[name][0], seen)
            seen[name] = None
    return seen


def over(names: str, body: str) -> str:
    """``body`` with the subqueries it reads, and theirs, in front."""
    order = _needed(tuple(names.split()), {})
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1].strip()})" for name in order)
    return f"WITH {ctes}\n{body.strip()}"
