"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

PACKET = """seq long, ingest_ts timestamp, source_callsign string, dest_callsign string, digipeaters array<string>,
 body string, timestamp long, latitude double, longitude double, altitude double, speed double, comment string"""
PARTIAL = "count long, sum_sig long, sum_crc long, sum_gap long, max_sig int, min_alt int, min_alt_sig int, min_agl int"
STATION_COVERAGE = "h3 long, min_agl int, min_alt int, min_alt_sig int, max_sig int, avg_sig int, avg_crc int, count long, avg_gap int"
GLOBAL_COVERAGE = STATION_COVERAGE + ", stations string, expected_gap int, num_stations int"
STATION = "id int, station string, lat double, lng double, last_packet long, last_beacon long, status string, moved boolean, valid boolean"
METADATA = """start long, start_utc string, current_accumulator int,
 accumulators map<string, struct<bucket:int, file:string, effective_start:long>>, all_starts array<struct<start:long, start_utc:string>>"""
