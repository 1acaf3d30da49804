"""Schemas of the inputs and tables, as DDL."""

POSITION_REPORT = "MessageType STRING, MetaData STRUCT<MMSI: LONG, ShipName: STRING, time_utc: STRING>, Message STRUCT<PositionReport: STRUCT<Latitude: DOUBLE, Longitude: DOUBLE, Sog: DOUBLE, Cog: DOUBLE, TrueHeading: DOUBLE>, ShipStaticData: STRUCT<Name: STRING, CallSign: STRING, Type: INT, ImoNumber: LONG, MaximumStaticDraught: DOUBLE, Destination: STRING, Dimension: STRUCT<A: INT, B: INT, C: INT, D: INT>>>"
HUB_SHIP = "MMSI STRING, NAME STRING, CALLSIGN STRING, TYPE STRING, IMO STRING, A STRING, B STRING, C STRING, D STRING, DRAUGHT STRING, DEST STRING, LATITUDE STRING, LONGITUDE STRING, SOG STRING, COG STRING, HEADING STRING, TIME STRING"
AIRCRAFT = "hex STRING, flight STRING, r STRING, t STRING, alt_baro STRING, gs DOUBLE, track DOUBLE, lat DOUBLE, lon DOUBLE, squawk STRING, nav_altitude_mcp DOUBLE, nav_heading DOUBLE, nav_qnh DOUBLE, baro_rate DOUBLE"
SNAPSHOT = f"t STRING, aircraft ARRAY<STRUCT<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in AIRCRAFT.split(', '))}>>"
CAPTURE = "index INT, timestamp STRING, channel STRING, detectorType STRING, durationSec DOUBLE, rms DOUBLE, activeRatio DOUBLE, normalizeGain DOUBLE, text STRING"
CHUNK = "id LONG, time TIMESTAMP, channel STRING, text STRING, corrected STRING, live_vessel STRING, live_mmsi STRING, live_seen TIMESTAMP, callsign STRING"
COMMENT = "conversation_id STRING, truth STRING, note STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
OBSERVATION = "arrival LONG, mmsi STRING, name STRING, callsign STRING, type INT, imo LONG, length DOUBLE, beam DOUBLE, draught DOUBLE, destination STRING, latitude DOUBLE, longitude DOUBLE, sog DOUBLE, cog DOUBLE, heading DOUBLE, observed_at TIMESTAMP, source STRING"
