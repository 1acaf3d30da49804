"""Small projections of records for display, worksheets and prompts (P9-P16, P20), replies of a language model (T26, T27, F20) and input checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import great_circle_km
from .text import wer_tokens

#: The marks and facts of a candidate (P9), the fields of an aircraft's state.
CANDIDATE_MARKS = ("via_callsign", "via_live_match", "via_partial_callsign")
CANDIDATE_FACTS = ("latitude", "longitude", "draught", "destination", "last_seen")
STATE_FIELDS = ("flight", "t", "r", "alt_baro", "nav_altitude_mcp", "nav_heading", "track")
#: Airband in MHz, low end included, high end not.
AIRBAND = (118.0, 137.0)


#: The phrases of evidence (P15) and of a system line (X14), and what gives away a reply that isn't one.
READ_FROM, HEARD, NOT_THERE, BY_HAND, NO_CLUE = 'callsign %s read from "%s"', " heard", " heard, not in ADS-B", "moved by hand", "no clue"
ECHO_AMBIGUOUS, ECHO_NO_DATA, ECHO_PENDING = "autopilot: several aircraft changed to that number", "autopilot: no ADS-B data for that moment", "autopilot: not checked yet"
NOT_IDENTIFIED = "not identified  "
REPLY_LABEL = r"(?i)^\s*(corrected\s+transcript|corrected|output|transcript)\s*:\s*"
THINKING_ALOUD = r"(?i)^\s*(we need to|the user|okay,? (so|let)|first,? |i (should|need))"


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _joined(separator: str, *parts: Column) -> Column:
    """The parts that aren't null."""
    return F.concat_ws(separator, *parts)


def vessel_tag(vessel: Column, vessel_type: Column, mmsi: Column, callsign: Column, text: Column) -> Column:
    """P11: '[VESSEL/type] (MMSI:number) text', or the call sign where no number is known; what is unknown is left out."""
    named = F.concat(F.lit("["), _filled(vessel), F.coalesce(F.concat(F.lit("/"), _filled(vessel_type)), F.lit("")), F.lit("]"))
    number = F.coalesce(F.concat(F.lit("(MMSI:"), _filled(mmsi), F.lit(")")), F.concat(F.lit("("), _filled(callsign), F.lit(")")))
    return _joined(" ", named, number, _filled(text))


def flight_tag(flight: Column, aircraft_type: Column, text: Column) -> Column:
    """P12, X2: '[FLIGHT/TYPE] text'; the text as it is where no flight was found."""
    tag = F.concat(F.lit("["), _filled(flight), F.coalesce(F.concat(F.lit("/"), _filled(aircraft_type)), F.lit("")), F.lit("] "))
    return F.concat(F.coalesce(tag, F.lit("")), text)


def compact_candidates(candidates: Column) -> Column:
    """An array of candidate structs cut to name, number, marks (null is false) and facts."""
    marks = lambda c: [F.coalesce(c[m], F.lit(False)).alias(m) for m in CANDIDATE_MARKS]
    return F.transform(candidates, lambda c: F.struct(c["name"].alias("name"), c["mmsi"].alias("mmsi"), *marks(c), *[c[f].alias(f) for f in CANDIDATE_FACTS]))


def particulars(imo: Column, length: Column, beam: Column, draught: Column, destination: Column, sog: Column, cog: Column, lat: Column, lon: Column) -> Column:
    """P16 as plain text: the bits that are known, between middle dots. 0 counts as unknown for number, length and beam."""
    some = lambda c: F.nullif(c, F.lit(0))
    whole = lambda c: c.cast("long").cast("string")
    size = F.coalesce(F.concat(whole(some(length)), F.lit(" × "), whole(some(beam)), F.lit(" m")), F.concat(whole(some(length)), F.lit(" m")))
    known = lambda form, *values: F.when(sum((v.isNull().cast("int") for v in values), F.lit(0)) == 0, F.format_string(form, *values))
    return _joined(
        " · ", F.concat(F.lit("IMO "), some(imo).cast("string")), size, known("draught %.1f m", draught.cast("double")), F.concat(F.lit("→ "), _filled(destination)),
        known("%.1f kn", sog.cast("double")), F.concat(whole(cog), F.lit("°")), known("%.4f, %.4f", lat.cast("double"), lon.cast("double")),
    )


def evidence(moved: Column, clue: Column, echo: Column) -> Column:
    """Why a transmission lies where it does. clue: struct flight, candidate, repaired_from; echo: struct status, flight, hex, kind, value, delay_s."""
    heard = (
        F.when(clue["flight"].isNotNull() & clue["repaired_from"].isNotNull(), F.format_string(READ_FROM, clue["flight"], clue["repaired_from"]))
        .when(clue["flight"].isNotNull(), F.concat(F.lit("callsign "), clue["flight"], F.lit(HEARD)))
        .when(clue["candidate"].isNotNull(), F.concat(F.lit("callsign "), clue["candidate"], F.lit(NOT_THERE)))
    )
    unit = F.when(echo["kind"] == "altitude", "ft").otherwise("°")
    delay = F.bround(F.coalesce(echo["delay_s"], F.lit(0.0))).cast("long").cast("string")
    selected = _joined(" ", F.coalesce(echo["flight"], echo["hex"]), F.lit("selected"), echo["value"].cast("string"), unit, delay, F.lit("s later"))
    seen = (
        F.when(echo["status"] == "match", selected).when(echo["status"] == "ambiguous", ECHO_AMBIGUOUS)
        .when(echo["status"] == "no_snapshots", ECHO_NO_DATA).when(echo["status"].isNull(), ECHO_PENDING)
    )
    parts = F.nullif(_joined("; ", heard, seen), F.lit(""))
    return F.when(F.coalesce(moved, F.lit(False)), BY_HAND).otherwise(F.coalesce(parts, F.lit(NO_CLUE)))


def strip_label(key: Column, flight: Column) -> Column:
    """What a strip is called."""
    return (
        F.when(key == "review", "Needs review").when(key == "unassigned", "Unassigned").when(key.startswith("heard:"), F.substring(key, 7, 80))
        .otherwise(F.coalesce(_filled(flight), F.upper(key)))
    )


def valid_key(key: Column) -> Column:
    """F16: a key that a transmission can be moved to."""
    return F.coalesce(key.rlike(r"^(unassigned|review|heard:[A-Z0-9]{1,12}|[0-9A-Fa-f]{6})$"), F.lit(False))


def is_airband(channel: Column) -> Column:
    """A frequency of the airband, with a decimal point or comma; false for what is no number."""
    mhz = F.replace(channel, F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce((mhz >= AIRBAND[0]) & (mhz < AIRBAND[1]), F.lit(False))


def is_named_aircraft(flight: Column, hex_: Column) -> Column:
    """a call sign to pick by and six hexadecimal digits."""
    return F.coalesce((F.trim(flight) != "") & hex_.rlike("^[0-9A-Fa-f]{6}$"), F.lit(False))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """F29, X47."""
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def aircraft_state(aircraft: Column, hex_: Column) -> Column:
    """The fields of the first aircraft of an array with this hex; null if it isn't there."""
    found = F.get(F.filter(aircraft, lambda a: F.lower(a["hex"]) == F.lower(hex_)), F.lit(0))
    airline = F.nullif(F.upper(F.substring(F.trim(found["flight"]), 1, 3)), F.lit(""))
    return F.when(found.isNotNull(), F.struct(*[found[f].alias(f) for f in STATE_FIELDS], airline.alias("airline")))


def aircraft_listing(aircraft: Column, lat: float, lon: float) -> Column:
    """The named aircraft of a snapshot, nearest first, unknown distances last, then by flight. The array is one snapshot's, of bounded size."""
    named = F.filter(aircraft, lambda a: is_named_aircraft(a["flight"], a["hex"]))
    km = lambda a: great_circle_km(F.lit(lat), F.lit(lon), a["lat"], a["lon"])
    row = lambda a: F.struct(
        km(a).isNull().alias("far"), F.coalesce(km(a), F.lit(0.0)).alias("near"), F.trim(a["flight"]).alias("flight"), F.lower(a["hex"]).alias("hex"),
        a["t"].alias("type"), a["r"].alias("reg"), a["alt_baro"].alias("alt"),
    )
    ordered = F.array_sort(F.transform(named, row))
    return F.transform(ordered, lambda r: F.struct(r["hex"], r["flight"], r["type"], r["reg"], r["alt"], F.when(~r["far"], r["near"]).alias("km")))


def resolver_lines(turns: Column, candidates: Column) -> Column:
    """Numbered lines of what was said, and a bullet per candidate name."""
    said = F.array_join(F.transform(turns, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(t, F.lit("")))), "\n")
    return F.concat_ws("\n\n", said, F.nullif(F.array_join(F.transform(candidates, lambda c: F.concat(F.lit("- "), c)), "\n"), F.lit("")))


def strip_enrichment(text: Column) -> Column:
    """Without the leading tag of vessel_tag; a parenthesis that names no MMSI goes only after a tag."""
    bare = F.regexp_replace(text, r"^\s*\[[^\]]*\]\s*", "")
    numbered, any_paren = r"^\s*\(MMSI:[^)]*\)\s*", r"^\s*\([^)]*\)\s*"
    return F.when(bare.rlike(numbered), F.regexp_replace(bare, numbered, "")).when(bare != text, F.regexp_replace(bare, any_paren, "")).otherwise(bare)


def system_line(tag: Column, candidate: Column) -> Column:
    """What the system made of a transmission."""
    extracted = F.concat(F.lit(NOT_IDENTIFIED + "(extracted "), candidate, F.lit(", no match)"))
    return F.coalesce(F.concat(F.lit("identified "), tag), extracted, F.lit(NOT_IDENTIFIED + "(no callsign extracted)"))


def parsed_system(line: Column) -> Column:
    """Struct tag, candidate of a system line."""
    tag = F.nullif(F.regexp_extract(F.trim(line), r"^identified ([^/]*)", 1), F.lit(""))
    return F.struct(F.trim(tag).alias("tag"), F.nullif(F.trim(F.regexp_extract(line, r"\(extracted ([^,]*),", 1)), F.lit("")).alias("candidate"))


def read_label(raw: Column, blank_means: str = "NONE") -> Column:
    """A label in upper case; one that ends in '?' is UNSURE, an empty one what the caller says."""
    value = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(value == "", blank_means).when(value.endswith("?"), "UNSURE").otherwise(value)


def reference_text(heard: Column) -> Column:
    """A worksheet's heard field as a reference: each '?' is something inaudible, tabs become spaces, an empty field is none."""
    return F.nullif(F.replace(F.replace(F.trim(heard), F.lit("?"), F.lit("[inaudible]")), F.lit("\t"), F.lit(" ")), F.lit(""))


def strip_fence(text: Column) -> Column:
    """What stands inside a code fence, else the text, trimmed."""
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"
    return F.trim(F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text))


def clean_reply(raw: Column) -> Column:
    """A reply without thoughts, a fence all around, a label and quotes."""
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<think>.*?</think>", ""))
    fence = r"(?s)^```[a-zA-Z]*\n(.*?)\n?```$"
    text = F.when(text.rlike(fence), F.trim(F.regexp_extract(text, fence, 1))).otherwise(text)
    text = F.trim(F.regexp_replace(text, REPLY_LABEL, ""))
    quoted = (F.length(text) >= 2) & text.startswith('"') & text.endswith('"')
    return F.when(quoted, F.trim(F.regexp_extract(text, r'(?s)^"(.*)"$', 1))).otherwise(text)


def is_malformed(raw: Column, output: Column, hypothesis: Column) -> Column:
    """unknown-token marks, thinking aloud, or more than three times the words and ten."""
    aloud = F.coalesce(output, F.lit("")).rlike(THINKING_ALOUD)
    return F.coalesce(raw.contains("<unk>"), F.lit(False)) | aloud | (F.size(wer_tokens(output)) > F.size(wer_tokens(hypothesis)) * 3 + 10)


def redacted(reason: Column, secret: Column) -> Column:
    """X32."""
    return F.when(F.coalesce(secret, F.lit("")) == "", reason).otherwise(F.replace(reason, secret, F.lit("***")))


def effective_prompt(client: Column, override: Column, default: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(F.nullif(F.trim(client), F.lit("")), F.nullif(F.trim(override), F.lit("")), default)


def worksheet_block(index: Column, time: Column, channel: Column, seconds: Column, text: Column, system: Column) -> Column:
    """A block of the labelling worksheet: what was heard by machine and what the system made of it, with two lines to fill in."""
    number = F.lpad(index.cast("string"), F.greatest(F.lit(4), F.length(index.cast("string"))), "0")
    head = F.format_string("--- %s %s\naudio    : %s_sent.wav   (raw: %s_raw.wav)", number, F.lit("-" * 55), number, number)
    when = F.format_string("time     : %s   channel: %s   %.1fs", F.coalesce(time, F.lit("")), F.coalesce(channel, F.lit("")), F.coalesce(seconds.cast("double"), F.lit(0.0)))
    said = F.coalesce(text, F.lit(""))
    return F.concat(head, F.lit("\n"), when, F.lit("\nmachine  : "), said, F.lit("\nsystem   : "), system, F.lit("\n\nheard    : "), said, F.lit("\naircraft :\n"))
