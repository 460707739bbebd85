from __future__ import annotations

from tests.conftest import rows
from wayfare.operators.cleaning import clean_events
from wayfare.operators.identity import flag_bots
from wayfare.streaming.events import append_clean, read_event_files

HEADER = (
    "event_id,cookie_id,session_id,temp_client_id,user_id,event_name,event_date,device,url,"
    "reserva_id\n"
)
LINES = [
    "1,c,s,T1,,view_item,2025-01-01 10:00:00,Desktp,u,\n",
    "2,c,s,Tbot0000000,,view_item,02/01/2025 10:00,MOBILE,u,\n",
    "3,d,t,T2,7,purchase,2025-01-02 11:00:00,mobile,u,900001\n",
]


def test_files_arriving_in_two_runs_equal_one_batch(spark, tmp_path):
    arriving, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i, lines in enumerate((LINES[:2], LINES[2:])):
        (tmp_path / "in" / f"{i}.csv").write_text(HEADER + "".join(lines))
        append_clean(read_event_files(spark, arriving), out, state).awaitTermination(120)
    streamed = spark.read.parquet(out).drop("dia")
    raw = spark.read.schema(read_event_files(spark, arriving).schema).option("header", True).csv(arriving)
    assert rows(streamed) == rows(flag_bots(clean_events(raw)))
    assert streamed.count() == 3
