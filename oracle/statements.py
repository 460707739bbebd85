"""One DuckDB statement per registered query."""

from __future__ import annotations

from oracle.views import KEY, over


def pct(part: str, whole: str, digits: int = 1) -> str:
    return f"ROUND(100.0 * CAST({part} AS DOUBLE) / NULLIF({whole}, 0), {digits})"


def rate(part: str, whole: str) -> str:
    return f"100.0 * CAST({part} AS DOUBLE) / NULLIF({whole}, 0)"


def whole(total: str, digits: int = 0) -> str:
    return f"ROUND(CAST({total} AS DOUBLE), {digits})"


def count_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def eur(condition: str) -> str:
    return f"sum(importe_eur) FILTER (WHERE {condition})"


def wald() -> str:
    p, n = "(CAST(sum(back) AS DOUBLE) / count(*))", "count(*)"
    half = f"1.96 * sqrt({p} * (1.0 - {p}) / {n})"
    return (
        f"ROUND(100.0 * ({p} - {half}), 1) AS ic95_low, "
        f"ROUND(100.0 * ({p} + {half}), 1) AS ic95_high"
    )


N = "count(*) AS clientes"
BACK = "ROUND(100.0 * avg(back), 1) AS pct_recompra"
CONF, CANC, PEND = "estado = 'confirmada'", "estado = 'cancelada'", "estado = 'pendiente'"
DONE = "estado IN ('confirmada', 'cancelada')"
LEAD = "(CAST(fecha_actividad AS DATE) - CAST(fecha_reserva AS DATE))"
CANCEL_RATE = rate(count_if(CANC), count_if(DONE))
TICKET = (
    f"CAST({eur(CONF + ' AND importe_eur > 0')} AS DOUBLE)"
    f" / NULLIF({count_if(CONF + ' AND importe_eur > 0')}, 0)"
)
BOOKING = (
    "reserva_id, user_id, tour_id, proveedor_id, fecha_reserva, fecha_actividad, estado, "
    "personas, CAST(importe_eur AS DOUBLE) AS importe_eur, campana, canal"
)
PRICE = "CAST(precio_por_persona_eur AS DOUBLE) AS precio_por_persona_eur"
EVENT = (
    "event_id, cookie_id, session_id, temp_client_id, user_id, event_name, event_date, device, "
    "url, reserva_id"
)


def by_factor(expression: str, minimum: int = 25) -> str:
    return over(
        "ripe",
        f"""
        SELECT {expression} AS grupo, {N}, {BACK}
        FROM ripe GROUP BY 1 HAVING count(*) >= {minimum}
        """,
    )


def dash_factor(expression: str) -> str:
    return over(
        "dash_ripe",
        f"""
        SELECT {expression} AS factor, {N},
               CAST({count_if('recurrente')} AS DOUBLE) / count(*) AS pct_retencion
        FROM dash_ripe GROUP BY 1 HAVING count(*) >= 20
        """,
    )


def standardised(group: str, stratum: str, label: str) -> str:
    """Each customer weighs as many of the stratum as there are customers of the group in it."""
    return over(
        "ripe_t",
        f"""
        , weighed AS (
          SELECT {group}, back,
                 CASE WHEN {stratum} IS NOT NULL
                      THEN CAST(count(*) OVER (PARTITION BY {stratum}) AS DOUBLE)
                           / count(*) OVER (PARTITION BY {group}, {stratum}) END AS w
          FROM ripe_t WHERE canal <> 'Email')
        SELECT {group}, ROUND(100.0 * avg(back), 1) AS pct_crudo,
               ROUND(100.0 * sum(back * w) / sum(w), 1) AS {label}
        FROM weighed WHERE {group} IS NOT NULL GROUP BY 1 HAVING sum(w) > 0
        """,
    )


def check_rows(*items: tuple[str, str, str]) -> str:
    """SELECT list items (label, n, total) of one-row source ``q`` as rows."""
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS comprobacion, CAST({n} AS BIGINT) AS n, "
        f"CAST({total} AS BIGINT) AS total, {pct(n, total, 2)} AS pct FROM q"
        for name, n, total in items
    )


def cleaning() -> dict[str, str]:
    return {
        "clean_bookings": over("clean", f"SELECT {BOOKING} FROM clean"),
        "bookings_stored": over(
            "bk tours",
            f"""
            SELECT {BOOKING.replace("tour_id", "bk.tour_id").replace("proveedor_id", "bk.proveedor_id")},
                   destino, {PRICE}, tours.tour_id IS NOT NULL AS tour_conocido
            FROM bk LEFT JOIN tours ON bk.tour_id = tours.tour_id
            """,
        ),
        "clean_customers": over("customers", "SELECT * FROM customers"),
        "clean_events": over("ev_clean", f"SELECT {EVENT} FROM ev_clean"),
        "clean_tours": over("tours", f"SELECT * REPLACE ({PRICE}) FROM tours"),
        "customer_crosswalk": over(
            "xw", "SELECT original AS user_id_original, canonical AS user_id_canonico FROM xw"
        ),
        "customer_crosswalk_distinct_nulls": over(
            "raw_customers",
            """
            SELECT user_id AS user_id_original,
                   if(dni IS NULL, user_id, min(user_id) OVER (PARTITION BY lower(dni)))
                     AS user_id_canonico
            FROM raw_customers
            """,
        ),
        "bookings_canonical": over("bk", f"SELECT {BOOKING} FROM bk"),
        "bookings_canonical_keep_unknown": over(
            "clean xw",
            f"""
            SELECT {BOOKING}
            FROM (SELECT clean.* REPLACE (coalesce(canonical, user_id) AS user_id)
                  FROM clean LEFT JOIN xw ON original = clean.user_id)
            """,
        ),
        "events_identified": over("ev", f"SELECT {EVENT}, user_id_propagado, es_bot FROM ev"),
        "events_slim": over(
            "ev",
            """
            SELECT session_id, event_name, event_date, device, user_id, user_id_propagado,
                   es_bot, reserva_id FROM ev
            """,
        ),
    }


def repeat() -> dict[str, str]:
    any_rule = over(
        "ripe ranked",
        f"""
        , later AS (SELECT user_id, max(fr) AS last_fr FROM ranked WHERE pos > 1 GROUP BY 1),
        j AS (SELECT CAST(coalesce(last_fr > fa, false) AS INTEGER) AS back
              FROM ripe LEFT JOIN later USING (user_id))
        SELECT count(*) AS clientes_elegibles, CAST(sum(back) AS BIGINT) AS recompran,
               {pct('sum(back)', 'count(*)')} AS pct_recompra FROM j
        """,
    )
    lead = "fa - fr"
    age = "date_sub('year', fecha_nacimiento, fr)"
    return {
        "repeat_global": over(
            "ripe",
            f"""
            SELECT count(*) AS clientes_elegibles, CAST(sum(back) AS BIGINT) AS recompran,
                   {pct('sum(back)', 'count(*)')} AS pct_recompra
            FROM ripe
            """,
        ),
        "repeat_global_any": any_rule,
        "repeat_by_cohort": over(
            "cohort",
            f"""
            SELECT CAST(date_trunc('quarter', fa) AS DATE) AS cohorte_1a_actividad, {N},
                   CAST(min(exposure) AS INTEGER) AS exposicion_min, {BACK}
            FROM cohort GROUP BY 1
            """,
        ),
        "trip_stacking": over(
            "ranked",
            """
            SELECT CASE WHEN n.fr - f.fr <= 14 THEN 'mismo viaje (<=14d)'
                        ELSE 'recompra real (>14d)' END AS tipo,
                   count(*) AS clientes, ROUND(avg(n.fr - f.fr)) AS dias_medios,
                   ROUND(CAST(median(n.fr - f.fr) AS DOUBLE)) AS dias_mediana
            FROM ranked f JOIN ranked n ON n.user_id = f.user_id AND f.pos = 1 AND n.pos = 2
            GROUP BY 1
            """,
        ),
        "customer_value": over(
            "ripe bk",
            f"""
            , spent AS (SELECT user_id, sum(importe_eur) AS eur FROM bk WHERE {CONF} GROUP BY 1)
            SELECT if(back = 1, 'recompra', 'una sola vez') AS tipo, {N},
                   {whole('sum(eur)')} AS revenue,
                   ROUND(CAST(sum(eur) AS DOUBLE) / count(eur), 1) AS revenue_medio_cliente
            FROM ripe JOIN spent USING (user_id) GROUP BY 1
            """,
        ),
        "repeat_by_channel": over(
            "ripe",
            f"""
            SELECT canal, {N}, {BACK}, {wald()} FROM ripe
            WHERE importe_eur > 0 AND canal <> 'Email' GROUP BY canal
            """,
        ),
        "repeat_channel_by_free": over(
            "ripe",
            f"""
            SELECT canal, if(importe_eur = 0, 'free', 'pago') AS tipo_primera, {N}, {BACK}
            FROM ripe WHERE canal <> 'Email' GROUP BY ALL
            """,
        ),
        "repeat_channel_std": standardised("canal", "destino", "pct_estandarizado_a_destino"),
        "destination_std": standardised("destino", "canal", "pct_estandarizado_a_canal"),
        "repeat_by_free": over(
            "ripe",
            f"""
            SELECT if(importe_eur = 0, '1a = free tour', '1a = de pago') AS primera_reserva,
                   {N}, {BACK}, {wald()} FROM ripe GROUP BY 1
            """,
        ),
        "repeat_by_destination": over(
            "ripe_t", f"SELECT destino, {N}, {BACK}, {wald()} FROM ripe_t GROUP BY destino"
        ),
        "factor_amount": by_factor(
            "CASE WHEN importe_eur = 0 THEN '0 (free)' WHEN importe_eur < 50000 THEN '<50000' "
            "WHEN importe_eur < 100000 THEN '50000-100000' "
            "WHEN importe_eur < 200000 THEN '100000-200000' ELSE '200000+' END"
        ),
        "factor_party_size": by_factor(
            "CASE WHEN personas IS NULL THEN '(nulo)' WHEN personas >= 5 THEN '5+' "
            "WHEN personas >= 3 THEN '3-4' ELSE CAST(personas AS VARCHAR) END"
        ),
        "factor_lead_time": by_factor(
            f"CASE WHEN {lead} <= 7 THEN '0-7d' WHEN {lead} <= 30 THEN '8-30d' "
            f"WHEN {lead} <= 90 THEN '31-90d' ELSE '90+d' END"
        ),
        "factor_campaign": by_factor("coalesce(campana, '(sin campana)')"),
        "factor_device": over(
            "ripe device_of",
            f"""
            SELECT d.device AS grupo, {N}, {BACK}
            FROM ripe JOIN device_of d USING (user_id) GROUP BY 1
            """,
        ),
        "factor_age": over(
            "ripe customers",
            f"""
            SELECT CASE WHEN {age} IS NULL THEN '(nulo)' WHEN {age} < 30 THEN '<30'
                        WHEN {age} < 45 THEN '30-44' WHEN {age} < 60 THEN '45-59'
                        ELSE '60+' END AS grupo, {N}, {BACK}
            FROM ripe JOIN customers USING (user_id) GROUP BY 1 HAVING count(*) >= 25
            """,
        ),
        "churn_cancelled_flag": over(
            "ripe bk",
            f"""
            SELECT if(user_id IN (SELECT user_id FROM bk WHERE {CANC} AND user_id IS NOT NULL),
                      'sufrio una cancelacion', 'sin cancelaciones') AS grupo, {N}, {BACK}
            FROM ripe GROUP BY 1
            """,
        ),
        "churn_return_after_cancel": over(
            "bk",
            f"""
            , opened AS (
              SELECT user_id, first(estado ORDER BY fecha_reserva NULLS LAST, reserva_id) AS s,
                     first(CAST(fecha_reserva AS DATE)
                           ORDER BY fecha_reserva NULLS LAST, reserva_id) AS d
              FROM bk WHERE {DONE} GROUP BY user_id)
            SELECT count(*) AS clientes_cancelan_su_1a,
                   ROUND(100.0 * avg(CAST(EXISTS (
                        SELECT 1 FROM bk WHERE bk.user_id = opened.user_id
                          AND bk.estado = 'confirmada'
                          AND CAST(bk.fecha_reserva AS DATE) > opened.d) AS INTEGER)), 1)
                     AS pct_compra_confirmada_despues
            FROM opened WHERE s = 'cancelada'
            """,
        ),
        "repeat_timing": over(
            "ripe",
            f"""
            SELECT count(*) AS recompran, {count_if('next_fr - fa <= 90')} AS recompran_pronto,
                   {pct(count_if('next_fr - fa <= 90'), 'count(*)')} AS pct_pronto
            FROM ripe WHERE back = 1
            """,
        ),
        "free_same_trip": over(
            "ranked",
            f"""
            , p AS (SELECT n.importe_eur AS paid
                    FROM ranked f LEFT JOIN ranked n
                      ON n.user_id = f.user_id AND n.pos = 2 AND n.fr - f.fr <= 14
                         AND n.importe_eur > 0
                    WHERE f.pos = 1 AND f.importe_eur = 0 AND f.user_id IS NOT NULL)
            SELECT count(*) AS clientes_free, count(paid) AS segunda_de_pago,
                   {pct('count(paid)', 'count(*)')} AS pct_segunda_de_pago,
                   ROUND(CAST(sum(paid) AS DOUBLE) / NULLIF(count(paid), 0), 1) AS ticket_medio
            FROM p
            """,
        ),
    }


def destinations() -> dict[str, str]:
    return {
        "report_destinations": over(
            "bkt",
            f"""
            , d AS (SELECT destino, count(*) AS n, CAST(sum(importe_eur) AS DOUBLE) AS e,
                           ROUND(CAST(sum(personas) AS DOUBLE) / count(personas), 2) AS people
                    FROM bkt WHERE {CONF} GROUP BY 1)
            SELECT destino, n AS reservas, ROUND(e) AS revenue, people AS personas_medias,
                   {pct('n', '(SELECT sum(n) FROM d)')} AS pct_reservas
            FROM d
            """,
        ),
        "destination_volume": over(
            "bkt",
            f"""
            , d AS (SELECT destino, count(*) AS reservas, CAST(sum(importe_eur) AS DOUBLE) AS e
                    FROM bkt WHERE {CONF} GROUP BY 1)
            SELECT destino, reservas, ROUND(e) AS revenue,
                   {pct('reservas', '(SELECT sum(reservas) FROM d)')} AS pct_reservas,
                   {pct('e', '(SELECT sum(e) FROM d)')} AS pct_revenue
            FROM d
            """,
        ),
        "destination_demand": over(
            "bkt web",
            f"""
            , seen AS (SELECT split_part(url, '/', 5) AS destino,
                              count(DISTINCT session_id) AS sesiones_interes
                       FROM web WHERE event_name = 'view_item' GROUP BY 1),
            sold AS (SELECT destino, count(*) AS reservas FROM bkt WHERE {CONF} GROUP BY 1),
            d AS (SELECT * FROM seen JOIN sold USING (destino) WHERE destino <> '')
            SELECT destino, sesiones_interes, reservas,
                   {pct('sesiones_interes', '(SELECT sum(sesiones_interes) FROM d)')}
                     AS pct_interes,
                   {pct('reservas', '(SELECT sum(reservas) FROM d)')} AS pct_reservas,
                   {pct('reservas', 'sesiones_interes')} AS reservas_por_100_sesiones
            FROM d
            """,
        ),
        "destination_ticket": over(
            "bkt",
            f"""
            SELECT destino, count(*) AS reservas, {whole('sum(importe_eur)')} AS revenue,
                   ROUND(CAST(sum(importe_eur) AS DOUBLE) / count(importe_eur), 1)
                     AS ticket_medio,
                   ROUND(CAST(sum(personas) AS DOUBLE) / count(personas), 2) AS personas_medias,
                   ROUND(CAST(sum(precio_por_persona_eur) AS DOUBLE)
                         / count(precio_por_persona_eur), 1) AS precio_pp_medio
            FROM bkt WHERE {CONF} GROUP BY 1
            """,
        ),
        "cancel_by_destination": over(
            "bkt",
            f"""
            SELECT destino, count(*) AS reservas_resueltas,
                   {pct(count_if(CANC), 'count(*)')} AS pct_cancelacion
            FROM bkt WHERE {DONE} GROUP BY 1
            """,
        ),
    }


def business() -> dict[str, str]:
    semesters = f"""
        , sem AS (
          SELECT strftime(fecha_reserva, '%Y-H') || if(quarter(fecha_reserva) <= 2, 1, 2)
                   AS semestre,
                 {count_if(CONF)} AS reservas, {whole(eur(CONF))} AS venta
          FROM bk WHERE fecha_reserva >= TIMESTAMP '1995-07-01 00:00:00' GROUP BY 1)
        """
    return {
        "business_summary": over(
            "bk",
            f"""
            SELECT {whole(eur(CONF))} AS venta_confirmada,
                   {count_if(CONF)} AS reservas_confirmadas,
                   {count_if(CONF + ' AND importe_eur = 0')} AS free_tours,
                   {whole(eur(PEND))} AS pipeline_pendiente,
                   {whole(eur(CANC))} AS ingreso_perdido_cancelacion,
                   {pct(eur(CANC), f'CAST({eur(CONF)} AS DOUBLE)')} AS pct_cancelado_sobre_venta
            FROM bk
            """,
        ),
        "sales_by_semester": over("bk", semesters + "SELECT * FROM sem"),
        "sales_growth": over(
            "bk",
            semesters
            + """
            SELECT a.semestre AS primer_semestre, b.semestre AS ultimo_semestre,
                   a.venta AS venta_primero, b.venta AS venta_ultimo,
                   ROUND(100.0 * (b.venta - a.venta) / NULLIF(a.venta, 0), 1) AS pct_crecimiento
            FROM sem a, sem b
            WHERE a.semestre = (SELECT min(semestre) FROM sem)
              AND b.semestre = (SELECT max(semestre) FROM sem)
            """,
        ),
        "sales_sensitivity": over(
            "bk",
            f"""
            SELECT {whole(eur(CONF))} AS a_solo_confirmada,
                   {whole(eur("estado IN ('confirmada', 'pendiente')"))} AS b_mas_pendiente,
                   {pct(eur(PEND), f'CAST({eur(CONF)} AS DOUBLE)')} AS pct_extra_pendiente,
                   {count_if(CONF + ' AND importe_eur > 0')} AS n_confirmada_de_pago,
                   {count_if(CONF + ' AND importe_eur = 0')} AS n_free_tours
            FROM bk
            """,
        ),
        "cancel_by_lead": over(
            "bk",
            f"""
            SELECT CASE WHEN {LEAD} <= 7 THEN '0-7 d' WHEN {LEAD} <= 30 THEN '8-30 d'
                        WHEN {LEAD} <= 90 THEN '31-90 d' ELSE '90+ d' END AS antelacion,
                   count(*) AS reservas_resueltas,
                   {pct(count_if(CANC), 'count(*)')} AS pct_cancelacion,
                   {whole(eur(CANC))} AS eur_cancelado
            FROM bk WHERE {DONE} GROUP BY 1
            """,
        ),
        "cancel_by_channel": over(
            "bk",
            f"""
            SELECT canal, {count_if(DONE)} AS reservas_resueltas,
                   {pct(count_if(CANC), count_if(DONE))} AS pct_cancelacion
            FROM bk GROUP BY canal
            """,
        ),
        "terminated_provider_risk": over(
            "bk raw_providers",
            f"""
            , risk AS (SELECT bk.proveedor_id, fecha_baja, importe_eur
                       FROM bk JOIN raw_providers p ON p.proveedor_id = bk.proveedor_id
                         AND CAST(fecha_reserva AS DATE) > fecha_baja
                       WHERE {CONF})
            SELECT coalesce(CAST(proveedor_id AS VARCHAR), 'TOTAL') AS proveedor_id,
                   CAST(fecha_baja AS VARCHAR) AS fecha_baja,
                   count(*) AS reservas_confirmadas,
                   {whole('sum(importe_eur)')} AS importe_en_riesgo
            FROM risk GROUP BY GROUPING SETS ((proveedor_id, fecha_baja), ())
            """,
        ),
    }


def traffic() -> dict[str, str]:
    kind = "if(ident = 1, 'identificada', 'anonima') AS tipo_sesion, count(*) AS sesiones"
    return {
        "sessions_known": over(
            "ses",
            f"""
            SELECT {kind}, {pct('count(*)', '(SELECT count(*) FROM ses)')} AS pct
            FROM ses GROUP BY 1
            """,
        ),
        "funnel_by_session_type": over(
            "ses",
            f"""
            SELECT {kind}, {pct('sum(vi)', 'count(*)')} AS pct_view_item,
                   {pct('sum(bc)', 'count(*)')} AS pct_begin_checkout,
                   {pct('sum(pu)', 'count(*)')} AS pct_purchase
            FROM ses GROUP BY 1
            """,
        ),
        "funnel_by_device": over(
            "ses",
            f"""
            SELECT device, count(*) AS sesiones,
                   {pct('count(*)', '(SELECT count(*) FROM ses)')} AS pct_trafico,
                   ROUND(100.0 * avg(ident), 1) AS pct_identificada,
                   ROUND(100.0 * avg(ident) FILTER (vi = 1), 1) AS pct_ident_si_interes,
                   ROUND(100.0 * avg(pu) FILTER (vi = 1), 1) AS pct_compra_si_interes,
                   ROUND(100.0 * avg(pu) FILTER (ident = 1), 1) AS pct_compra_si_identificada,
                   {pct('sum(pu)', 'sum(bc)')} AS pct_checkout_a_compra
            FROM ses GROUP BY device
            """,
        ),
        "conversion_gross": over(
            "ses",
            f"""
            SELECT count(*) AS sesiones, CAST(sum(linked) AS BIGINT) AS sesiones_con_reserva,
                   {pct('sum(linked)', 'count(*)')} AS pct_conversion_bruta
            FROM ses
            """,
        ),
        "conversion_net": over(
            "web bk",
            f"""
            , s AS (SELECT session_id, bool_or(reserva_id IN (
                             SELECT reserva_id FROM bk WHERE {CONF})) AS kept
                    FROM web WHERE reserva_id IS NOT NULL GROUP BY 1)
            SELECT count(*) AS sesiones_con_reserva, {count_if('kept')} AS sesiones_confirmadas,
                   {pct(count_if('kept'), 'count(*)')} AS pct_conversion_neta
            FROM s
            """,
        ),
    }


def dashboard() -> dict[str, str]:
    month = "CAST(date_trunc('month', fecha_reserva) AS DATE)"
    start = f"""(SELECT min(m) FROM (SELECT {month} AS m FROM bk GROUP BY 1
                 HAVING count(*) >= 20))"""
    return {
        "date_bounds": over(
            "bk",
            """
            SELECT CAST(min(fecha_reserva) AS DATE) AS desde,
                   CAST(max(fecha_reserva) AS DATE) AS hasta FROM bk
            """,
        ),
        "volume_start": over("bk", f"SELECT {start} AS inicio"),
        "date_presets": over(
            "bk",
            f"""
            , b AS (SELECT CAST(min(fecha_reserva) AS DATE) AS lo,
                           CAST(max(fecha_reserva) AS DATE) AS hi FROM bk)
            SELECT 'con_volumen' AS rango, {start} AS desde, hi AS hasta FROM b
            UNION ALL SELECT 'todo', lo, hi FROM b
            UNION ALL SELECT 'ultimos_365_dias', greatest(lo, hi - 365), hi FROM b
            UNION ALL SELECT 'ultimos_182_dias', greatest(lo, hi - 182), hi FROM b
            UNION ALL SELECT 'ultimos_90_dias', greatest(lo, hi - 90), hi FROM b
            """,
        ),
        "filter_domains": over(
            "bk tours",
            """
            SELECT 'canal' AS filtro, canal AS valor FROM bk
            UNION SELECT 'destino', destino FROM tours
            """,
        ),
        "bookings_filtered": over(
            "sel", f"SELECT {BOOKING}, destino, {PRICE} FROM sel"
        ),
        "period_kpis": over(
            "sel",
            f"""
            SELECT CAST({eur(CONF)} AS DOUBLE) AS venta, {count_if(CONF)} AS n_confirmada,
                   CAST({eur(CANC)} AS DOUBLE) AS cancelado, {count_if(CANC)} AS n_cancelada,
                   CAST({eur(PEND)} AS DOUBLE) AS pendiente, {TICKET} AS ticket_medio,
                   coalesce({CANCEL_RATE}, 0) AS tasa_cancelacion
            FROM sel
            """,
        ),
        "kpi_vs_previous": over(
            "sel bk",
            f"""
            , a AS (SELECT CAST({eur(CONF)} AS DOUBLE) AS v, {count_if(CONF)} AS n
                    FROM sel WHERE year(fecha_reserva) = 1997),
            p AS (SELECT CAST({eur(CONF)} AS DOUBLE) AS v, {count_if(CONF)} AS n FROM sel
                  WHERE CAST(fecha_reserva AS DATE) BETWEEN DATE '1996-01-02' AND DATE '1996-12-31'),
            g AS (SELECT coalesce(DATE '1996-01-02' >= {start}, false) AS ok)
            SELECT a.v AS venta, a.n AS n_confirmada, p.v AS venta_previa,
                   p.n AS n_confirmada_previa, ok AS comparable,
                   if(ok, ROUND(100.0 * (a.v - p.v) / NULLIF(p.v, 0), 1), NULL) AS delta_venta,
                   if(ok, ROUND(100.0 * CAST(a.n - p.n AS DOUBLE) / NULLIF(p.n, 0), 1), NULL)
                     AS delta_n
            FROM a, p, g
            """,
        ),
        "amount_series": over(
            "sel",
            f"""
            SELECT {month} AS periodo, estado, CAST(sum(importe_eur) AS DOUBLE) AS importe,
                   count(*) AS reservas
            FROM sel GROUP BY ALL
            """,
        ),
        "cancel_series": over(
            "sel",
            f"""
            SELECT {month} AS periodo, {CANCEL_RATE} AS pct_cancelacion
            FROM sel WHERE {DONE} GROUP BY 1 HAVING count(*) >= 15
            """,
        ),
        "cancel_by_lead_filtered": over(
            "sel",
            f"""
            SELECT CASE WHEN {LEAD} < 0 THEN 'negativo' WHEN {LEAD} <= 7 THEN '0-7 días'
                        WHEN {LEAD} <= 30 THEN '8-30 días' WHEN {LEAD} <= 90 THEN '31-90 días'
                        ELSE '90+ días' END AS antelacion,
                   {CANCEL_RATE} AS pct_cancelacion, {count_if(DONE)} AS reservas
            FROM sel GROUP BY 1
            """,
        ),
        "cancel_by_channel_filtered": over(
            "sel",
            f"""
            SELECT canal, {CANCEL_RATE} AS pct_cancelacion, {count_if(DONE)} AS reservas
            FROM sel GROUP BY 1
            """,
        ),
        "cohort_filtered": over(
            "dash",
            "SELECT * REPLACE (CAST(importe_eur AS DOUBLE) AS importe_eur) FROM dash",
        ),
        "cohort_kpis": over(
            "dash",
            """
            SELECT count(*) AS clientes,
                   CAST(count_if(recurrente) AS DOUBLE) / NULLIF(count(*), 0) AS pct,
                   CAST(count_if(dias_exposicion < 180) AS BIGINT) AS censurados,
                   CAST(count_if(recurrente AND dias_exposicion >= 180) AS DOUBLE)
                     / NULLIF(count_if(dias_exposicion >= 180), 0) AS pct_maduros,
                   CAST(count_if(dias_exposicion >= 180) AS BIGINT) AS n_maduros
            FROM dash
            """,
        ),
        "cohort_factor_channel": dash_factor("canal"),
        "cohort_factor_free": dash_factor("if(importe_eur = 0, 'free tour', 'de pago')"),
        "cohort_factor_destination": dash_factor("destino"),
        "cohort_factor_campaign": dash_factor("coalesce(campana, 'Sin campaña')"),
        "cohort_factor_device": over(
            "dash_ripe device_of",
            f"""
            SELECT d.device AS factor, {N},
                   100.0 * avg(CAST(recurrente AS INTEGER)) AS pct_retencion
            FROM dash_ripe JOIN device_of d USING (user_id) GROUP BY 1
            """,
        ),
        "destination_table": over(
            "sel dash_ripe",
            f"""
            , v AS (SELECT destino, {count_if(CONF)} AS reservas,
                           CAST({eur(CONF)} AS DOUBLE) AS revenue, {TICKET} AS ticket_medio,
                           avg(personas) FILTER (WHERE {CONF}) AS personas_medias
                    FROM sel GROUP BY 1),
            r AS (SELECT destino, {N}, 100.0 * avg(CAST(recurrente AS INTEGER)) AS pct_retencion
                  FROM dash_ripe GROUP BY 1)
            SELECT v.*, clientes, pct_retencion FROM v LEFT JOIN r USING (destino)
            """,
        ),
        "destination_table_one_filter": over(
            "sel dash_ripe",
            f"""
            , v AS (SELECT destino, {count_if(CONF)} AS reservas,
                           CAST({eur(CONF)} AS DOUBLE) AS revenue, {TICKET} AS ticket_medio,
                           avg(personas) FILTER (WHERE {CONF}) AS personas_medias
                    FROM sel GROUP BY 1),
            r AS (SELECT destino, {N}, 100.0 * avg(CAST(recurrente AS INTEGER)) AS pct_retencion
                  FROM dash_ripe WHERE fa1 >= DATE '1996-01-01' GROUP BY 1)
            SELECT v.*, clientes, pct_retencion FROM v LEFT JOIN r USING (destino)
            """,
        ),
        "sessions_filtered": over("dash_ses", "SELECT * FROM dash_ses"),
        "traffic_kpis": over(
            "dash_ses",
            f"""
            SELECT count(*) AS sesiones, {pct('sum(ident)', 'count(*)')} AS pct_identificadas,
                   {pct('coalesce(sum(pu), 0)', 'sum(ident)')} AS pct_conversion_identificadas,
                   CAST(coalesce(sum(pu), 0) AS BIGINT) AS compras
            FROM dash_ses
            """,
        ),
        "sessions_series": over(
            "dash_ses",
            """
            SELECT periodo, if(ident = 1, 'identificada', 'anónima') AS tipo,
                   count(*) AS sesiones
            FROM dash_ses GROUP BY ALL
            """,
        ),
        "device_conversion": over(
            "dash_ses",
            f"""
            SELECT device, 'Bruto (todas las sesiones)' AS medida,
                   {rate('coalesce(sum(pu), 0)', 'count(*)')} AS pct
            FROM dash_ses WHERE device IS NOT NULL GROUP BY 1
            UNION ALL
            SELECT device, 'Entre sesiones identificadas', {rate('coalesce(sum(pu), 0)', 'sum(ident)')}
            FROM dash_ses WHERE device IS NOT NULL GROUP BY 1
            """,
        ),
        "funnel_long": over(
            "dash_ses",
            "\nUNION ALL\n".join(
                f"SELECT '{stage}' AS etapa, '{kind}' AS tipo, "
                f"100.0 * avg({flag}) FILTER (WHERE ident = {value}) AS pct FROM dash_ses"
                for flag, stage in (
                    ("vi", "view_item"), ("bc", "begin_checkout"), ("pu", "purchase")
                )
                for value, kind in ((1, "identificada"), (0, "anónima"))
            ),
        ),
    }


def quality() -> dict[str, str]:
    def distinct_over(column: str, key: str, source: str) -> str:
        return (
            f"(SELECT count(*) FROM (SELECT {key} FROM {source} GROUP BY {key} "
            f"HAVING count(DISTINCT {column}) > 1))"
        )

    def keys(key: str, source: str) -> str:
        return f"(SELECT count(*) FROM (SELECT DISTINCT {key} FROM {source}))"

    return {
        "tracking_gap": over(
            "bk ev",
            f"""
            , r AS (SELECT CAST(fecha_reserva AS DATE) AS dia,
                           reserva_id NOT IN (SELECT reserva_id FROM ev
                                              WHERE reserva_id IS NOT NULL) AS lost
                    FROM bk WHERE {DONE} AND CAST(fecha_reserva AS DATE)
                      BETWEEN DATE '1996-03-10' AND DATE '1996-03-15')
            SELECT dia, count(*) AS reservas_resueltas, {count_if('lost')} AS sin_evento,
                   {pct(count_if('lost'), 'count(*)')} AS pct_sin_evento
            FROM r GROUP BY dia
            """,
        ),
        "dq_cookie_user": over(
            "ev",
            f"""
            , k AS (SELECT * FROM ev WHERE user_id IS NOT NULL),
            q AS (SELECT {distinct_over('user_id', 'cookie_id', 'k')} AS n,
                         {keys('cookie_id', 'k')} AS total)
            {check_rows(('cookie con varios usuarios', 'n', 'total'))}
            """,
        ),
        "dq_client_cookie": over(
            "web",
            f"""
            , q AS (SELECT {distinct_over('user_id', 'temp_client_id', 'web')} AS u,
                           {distinct_over('cookie_id', 'temp_client_id', 'web')} AS c,
                           {keys('temp_client_id', 'web')} AS total)
            {check_rows(('temp_client_id con varios usuarios', 'u', 'total'),
                        ('temp_client_id en varias cookies', 'c', 'total'))}
            """,
        ),
        "identity_recovery": over(
            "ev",
            f"""
            , q AS (SELECT count(*) AS eventos, count(*) - count(user_id) AS anonimos_antes,
                           count(*) - count(user_id_propagado) AS anonimos_despues
                    FROM ev)
            SELECT *, anonimos_antes - anonimos_despues AS recuperados,
                   {pct('(anonimos_antes - anonimos_despues)', 'eventos', 2)} AS pct_sobre_total,
                   {pct('(anonimos_antes - anonimos_despues)', 'anonimos_antes', 2)}
                     AS pct_sobre_anonimos
            FROM q
            """,
        ),
        "bot_candidates": over(
            "ev",
            """
            , c AS (SELECT cookie_id, count(*) AS eventos, count(user_id_propagado) AS u,
                           count(reserva_id) AS r FROM ev GROUP BY 1)
            SELECT cookie_id, eventos FROM c
            WHERE u = 0 AND r = 0 AND eventos > 1.5 * (SELECT avg(eventos) FROM c)
            """,
        ),
        "dq_event_date_formats": over(
            "raw_events",
            f"""
            , q AS (SELECT count(try_strptime(event_date, '%Y-%m-%d %H:%M:%S')) AS iso,
                           count(try_strptime(event_date, '%d/%m/%Y %H:%M')) AS dmy,
                           count(*) AS total FROM raw_events)
            {check_rows(('aaaa-mm-dd hh:mm:ss', 'iso', 'total'),
                        ('dd/mm/aaaa hh:mm', 'dmy', 'total'),
                        ('sin interpretar', '(total - iso - dmy)', 'total'))}
            """,
        ),
        "dq_session_keys": over(
            "ev",
            f"""
            , q AS (SELECT {distinct_over('cookie_id', 'session_id', 'ev')} AS c,
                           {distinct_over('device', 'session_id', 'ev')} AS d,
                           {keys('session_id', 'ev')} AS total)
            {check_rows(('sesion con varias cookies', 'c', 'total'),
                        ('sesion con varios dispositivos', 'd', 'total'))}
            """,
        ),
        "dq_duplicate_bookings": over(
            "raw_bookings unique_bookings raw_events",
            f"""
            , pair AS (SELECT r.reserva_id, min(r.reserva_id) OVER (PARTITION BY {KEY}) AS kept
                       FROM raw_bookings r)
            SELECT reserva_id, kept AS reserva_id_original,
                   right(CAST(reserva_id AS VARCHAR), 4) = right(CAST(kept AS VARCHAR), 4)
                     AS mismos_digitos,
                   reserva_id NOT IN (SELECT reserva_id FROM raw_events
                                      WHERE reserva_id IS NOT NULL) AS sin_evento
            FROM pair WHERE reserva_id <> kept
            """,
        ),
        "dq_campaign_missing": over(
            "bk",
            f"""
            SELECT canal, count(*) AS reservas, count(*) - count(campana) AS sin_campana,
                   {pct('(count(*) - count(campana))', 'count(*)')} AS pct_sin_campana
            FROM bk GROUP BY canal
            """,
        ),
        "dq_provider_after_end": over(
            "bk raw_providers",
            "\nUNION ALL\n".join(
                f"""
                SELECT '{name}' AS comprobacion, count(*) AS reservas,
                       {count_if(CONF)} AS confirmadas,
                       {pct(count_if(CONF), 'count(*)')} AS pct_confirmadas
                FROM bk JOIN raw_providers USING (proveedor_id)
                WHERE CAST({day} AS DATE) > fecha_baja
                """
                for name, day in (
                    ("reserva posterior a la baja", "fecha_reserva"),
                    ("actividad posterior a la baja", "fecha_actividad"),
                )
            ),
        ),
        "dq_orphan_provider": over(
            "raw_tours raw_providers bk",
            """
            SELECT t.proveedor_id, count(DISTINCT t.tour_id) AS tours,
                   count(bk.reserva_id) AS reservas
            FROM raw_tours t LEFT JOIN bk USING (tour_id)
            WHERE t.proveedor_id NOT IN (SELECT proveedor_id FROM raw_providers)
            GROUP BY 1
            """,
        ),
        "dq_party_size": over(
            "raw_bookings",
            f"""
            , bad AS (SELECT * FROM raw_bookings WHERE personas <= 0),
            p AS (SELECT proveedor_id, count(*) AS k FROM bad
                  WHERE proveedor_id IS NOT NULL GROUP BY 1),
            t AS (SELECT tour_id, count(*) AS k FROM bad WHERE tour_id IS NOT NULL GROUP BY 1),
            q AS (SELECT (SELECT count(*) FROM bad) AS invalidas,
                         (SELECT count(*) FROM raw_bookings) AS total,
                         (SELECT count(*) FROM p) AS proveedores, (SELECT count(*) FROM t) AS tours)
            SELECT invalidas, total, {pct('invalidas', 'total')} AS pct, proveedores, tours,
                   {pct('(SELECT max(k) FROM p)', 'invalidas')} AS pct_mayor_proveedor,
                   {pct('(SELECT max(k) FROM t)', 'invalidas')} AS pct_mayor_tour
            FROM q
            """,
        ),
        "dq_malformed_lines": over(
            "raw_bookings raw_customers raw_providers raw_tours raw_events",
            " UNION ALL ".join(
                f"SELECT '{table}' AS tabla, count(*) AS lineas, CAST(0 AS BIGINT) AS malformadas "
                f"FROM raw_{name}"
                for name, table in (
                    ("bookings", "reservas"),
                    ("customers", "clientes"),
                    ("providers", "proveedores"),
                    ("tours", "tours"),
                    ("events", "ga_eventos"),
                )
            ),
        ),
        "dq_booking_id": over(
            "raw_bookings",
            f"""
            , q AS (SELECT count(*) FILTER (WHERE n > 1) AS n, count(*) AS total
                    FROM (SELECT reserva_id, count(*) AS n FROM raw_bookings GROUP BY 1))
            {check_rows(('reserva_id repetido', 'n', 'total'))}
            """,
        ),
        "dq_customer_dates": over(
            "raw_customers bk",
            """
            , t AS (SELECT CAST(max(fecha_reserva) AS DATE) AS today FROM bk)
            SELECT count(*) AS clientes, CAST(count_if(fecha_alta > today) AS BIGINT) AS alta_futura,
                   CAST(count_if(fecha_baja > today) AS BIGINT) AS baja_futura,
                   CAST(min(fecha_baja - fecha_alta) AS INTEGER) AS dias_min,
                   CAST(max(fecha_baja - fecha_alta) AS INTEGER) AS dias_max,
                   ROUND(avg(fecha_baja - fecha_alta), 1) AS dias_media,
                   CAST(count_if(fecha_nacimiento = DATE '1900-01-01') AS BIGINT)
                     AS nacimiento_1900,
                   count(*) - count(dni) AS sin_dni
            FROM raw_customers, t
            """,
        ),
    }


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    for block in (cleaning, repeat, destinations, business, traffic, dashboard, quality):
        out.update(block())
    return out
