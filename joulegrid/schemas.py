"""Explicit schemas. Times are BIGINT nanoseconds of one capture; unsigned fields are one size wider."""

SAMPLES = "capture_id string, seq bigint, t_ns bigint, current_ua int, voltage_uv bigint"
EVENTS = "capture_id string, seq bigint, t_ns bigint, id int, value bigint"
GPIO = "capture_id string, seq bigint, t_ns bigint, state int"
SYNC_ROWS = "capture_id string, host_send_ns bigint, host_recv_ns bigint, device_ticks bigint"
EVENT_DEFS = "name string, start_id int, stop_id int, category string, value_units string, latency_compensation_ns bigint"
GAPS = "capture_id string, start_ns bigint, end_ns bigint, cause string, lost_estimate bigint"
RULES = "event string, metric string, comparison string, limit double"

#: Used where samples carry no voltage and nothing else is said.
DEFAULT_SUPPLY_UV = 3_300_000
