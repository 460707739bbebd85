"""The report: every metric by business question, and every data check, as one table each."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from functools import partial

from pyspark.sql import DataFrame

from wayfare.plans import business, destinations, quality, repeat, traffic
from wayfare.sources.warehouse import Warehouse

Metric = Callable[[Warehouse], DataFrame]

QUESTIONS: dict[str, dict[str, Metric]] = {
    "repeticion": {
        "repeat_global": repeat.repeat_global,
        "repeat_by_cohort": repeat.repeat_by_cohort,
        "trip_stacking": repeat.trip_stacking,
        "customer_value": repeat.customer_value,
        "repeat_by_channel": repeat.repeat_by_channel,
        "repeat_channel_by_free": repeat.repeat_channel_by_free,
        "repeat_channel_std": repeat.repeat_channel_std,
        "repeat_by_free": repeat.repeat_by_free,
        "repeat_by_destination": repeat.repeat_by_destination,
        "churn_cancelled_flag": repeat.churn_cancelled_flag,
        "churn_return_after_cancel": repeat.churn_return_after_cancel,
    },
    "destinos": {
        "destination_volume": destinations.destination_volume,
        "destination_demand": destinations.destination_demand,
        "destination_ticket": destinations.destination_ticket,
        "destination_std": repeat.destination_std,
    },
    "negocio": {
        "business_summary": business.business_summary,
        "sales_by_semester": business.sales_by_semester,
        "sales_sensitivity": business.sales_sensitivity,
        "cancel_by_lead": business.cancel_by_lead,
        "cancel_by_channel": business.cancel_by_channel,
        "terminated_provider_risk": business.terminated_provider_risk,
    },
    "trafico": {
        "sessions_known": traffic.sessions_known,
        "funnel_by_session_type": traffic.funnel_by_session_type,
        "funnel_by_device": traffic.funnel_by_device,
    },
    "factores_sin_efecto": {
        "factor_amount": repeat.factor_amount,
        "factor_party_size": repeat.factor_party_size,
        "factor_lead_time": repeat.factor_lead_time,
        "factor_campaign": repeat.factor_campaign,
        "factor_device": repeat.factor_device,
    },
    "documentadas": {
        "repeat_global_any": partial(repeat.repeat_global, rule="any"),
        "repeat_timing": repeat.repeat_timing,
        "free_same_trip": repeat.free_same_trip,
        "factor_age": repeat.factor_age,
        "cancel_by_destination": destinations.cancel_by_destination,
        "sales_growth": business.sales_growth,
        "conversion_gross": traffic.conversion_gross,
        "conversion_net": traffic.conversion_net,
    },
}

CHECKS: dict[str, Metric] = {
    "dq_malformed_lines": quality.dq_malformed_lines,
    "tracking_gap": quality.tracking_gap,
    "dq_cookie_user": quality.dq_cookie_user,
    "dq_client_cookie": quality.dq_client_cookie,
    "identity_recovery": quality.identity_recovery,
    "bot_candidates": quality.bot_candidates,
    "dq_event_date_formats": quality.dq_event_date_formats,
    "dq_session_keys": quality.dq_session_keys,
    "dq_duplicate_bookings": quality.dq_duplicate_bookings,
    "dq_campaign_missing": quality.dq_campaign_missing,
    "dq_provider_after_end": quality.dq_provider_after_end,
    "dq_orphan_provider": quality.dq_orphan_provider,
    "dq_party_size": quality.dq_party_size,
    "dq_booking_id": quality.dq_booking_id,
    "dq_customer_dates": quality.dq_customer_dates,
}


def metrics() -> dict[str, Metric]:
    return {key: fn for block in QUESTIONS.values() for key, fn in block.items()}


def _write(wh: Warehouse, folder: str, tables: Mapping[str, Metric]) -> list[str]:
    paths = []
    for key, fn in tables.items():
        path = f"{folder.rstrip('/')}/{key}"
        fn(wh).write.mode("overwrite").parquet(path)
        paths.append(path)
    return paths


def write_report(
    wh: Warehouse,
    folder: str,
    overrides: Mapping[str, Metric] | None = None,
    questions: Collection[str] = tuple(QUESTIONS),
) -> list[str]:
    """Write each metric to ``folder/question/key``; returns the paths in report order.

    ``overrides`` replaces a metric, for instance by one with other thresholds. The metrics
    read roll-ups; those by a factor of the first booking share one pass over the cohort.
    """
    chosen = overrides or {}
    paths = []
    for question, block in QUESTIONS.items():
        if question not in questions:
            continue
        tables = {key: chosen.get(key, fn) for key, fn in block.items()}
        paths += _write(wh, f"{folder.rstrip('/')}/{question}", tables)
    return paths


def write_checks(wh: Warehouse, folder: str) -> list[str]:
    """Write each data check to ``folder/key``."""
    return _write(wh, folder, CHECKS)
