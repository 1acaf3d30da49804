"""Archive states as pure functions: insert if absent (K4, K5), imports (K7), upsert (K6), latest override and moves (J10, K10), late updates (K9), new columns (X44), day merges (U5), exports (K13, K17), logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conversation_id(start: Column, channel: Column) -> Column:
    """N14: 'start|channel', nulls as ''."""
    return F.concat(F.coalesce(start, F.lit("")), F.lit("|"), F.coalesce(channel, F.lit("")))


def first_in_batch(batch: DataFrame, key: str, ordinal: str) -> DataFrame:
    """K5: of rows with one key in a batch the first counts."""
    return batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), ordinal).alias("__row")).select("__row.*")


def insert_if_absent(stored: DataFrame, batch: DataFrame, key: str, ordinal: str) -> DataFrame:
    """K4: the rows to append; what the archive holds stays."""
    return first_in_batch(batch, key, ordinal).join(stored.select(key), key, "left_anti")


def one_line(text: Column) -> Column:
    """CRLF, CR and LF become one space each."""
    return F.regexp_replace(text, "\r\n|\r|\n", " ")


def upsert_comments(stored: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """K6: stored (key, truth, note, created_at, updated_at) after edits (key, truth, note, at), one per key. Empty truth and note delete the
    comment; created_at survives an update; truth loses its line breaks."""
    edits = edits.select(key, F.nullif(F.trim(one_line(F.col("truth"))), F.lit("")).alias("__truth"), F.nullif(F.col("note"), F.lit("")).alias("__note"), F.col("at").alias("__at"))
    merged = stored.join(edits, key, "full_outer")
    edited = F.col("__at").isNotNull()
    pick = lambda new, old: F.when(edited, F.col(new)).otherwise(F.col(old))
    kept = merged.filter(~edited | F.col("__truth").isNotNull() | F.col("__note").isNotNull())
    return kept.select(
        key, pick("__truth", "truth").alias("truth"), pick("__note", "note").alias("note"), F.coalesce("created_at", "__at").alias("created_at"),
        pick("__at", "updated_at").alias("updated_at"),
    )


def latest_override(rows: DataFrame, moves: DataFrame, key: str, move_key: str, move_id: str, fields: list[str]) -> DataFrame:
    """Rows with the fields (prefixed moved_) of the move with the greatest id; null where never moved. The moves shrink to one per row first."""
    last = moves.groupBy(F.col(move_key).alias(key)).agg(F.max_by(F.struct(*fields), move_id).alias("__last"))
    return rows.join(last, key, "left").select(*[rows[c] for c in rows.columns], *[F.col(f"__last.{f}").alias(f"moved_{f}") for f in fields])


def late_update(rows: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """K9: a field takes the update's value where it has one."""
    renamed = updates.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    return rows.join(renamed, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def merge_days(stored: DataFrame, fetched: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Fetched values replace, absent days stay; change says added, updated or kept."""
    new = fetched.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__new"))
    merged = stored.withColumn("__old", F.lit(True)).join(new, keys, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "kept").otherwise("updated")
    return merged.select(*keys, *[F.when(F.col("__new"), F.col(f"__{v}")).otherwise(F.col(v)).alias(v) for v in values], change.alias("change"))


def labels_text(conversations: DataFrame, comments: DataFrame, day: str | None = None) -> DataFrame:
    """Reviewed conversations of a day as label lines (start, end, truth, note; tabs between, none at the end), with their start."""
    joined = conversations.join(comments, conversations["id"] == comments["conversation_id"]).filter(
        F.col("truth").isNotNull() & (F.coalesce(F.col("end"), F.lit("")) != "")
    )
    if day:
        joined = joined.filter(F.col("start").startswith(day))
    note = F.nullif(F.trim(one_line(F.coalesce(F.col("note"), F.lit("")))), F.lit(""))
    return joined.select("start", F.concat_ws("\t", "start", "end", one_line(F.col("truth")), note).alias("line"))


def keep_newest(rows: DataFrame, arrival: str, most: int = 300) -> DataFrame:
    """The newest rows by arrival: a ring of fixed size."""
    return rows.orderBy(F.col(arrival).desc()).limit(most)


def prune_days(rows: DataFrame, day: str, today: Column, keep: int) -> DataFrame:
    """Without the days older than today - keep."""
    return rows.filter(F.col(day) >= F.date_sub(today, keep))


def add_moves(moves: DataFrame, asked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The log with the moves asked for (key, move_id, to_key, state): each remembers the key that was in force, the last move's or the row's own.
    One move per row at a time; nothing is overwritten."""
    last = moves.groupBy(key).agg(F.max_by("to_key", "move_id").alias("__last"))
    new = asked.join(rows.select(key, F.col("outcome_key").alias("__own")), key).join(last, key, "left")
    return moves.unionByName(new.select(key, "move_id", F.coalesce("__last", "__own").alias("from_key"), "to_key", "state"))


def import_records(spark, paths: list[str], schema: str, stored: DataFrame, key: str) -> DataFrame:
    """K7: records of JSON files to append, each file a list of them; a file of another shape raises. Of equal keys the first file's first record counts."""
    read = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    listed = F.from_json("value", f"ARRAY<STRUCT<{schema}>>", {"mode": "FAILFAST"})
    is_list = F.coalesce(F.trim(F.col("value")).startswith("["), F.lit(False))
    checked = read.select("file", F.when(is_list, listed).otherwise(F.raise_error(F.concat(F.lit("not a list of records: "), F.col("file")))).alias("records"))
    rows = checked.select("file", F.posexplode("records").alias("place", "r")).select("r.*", F.struct("file", "place").alias("__ordinal"))
    return insert_if_absent(stored, rows, key, "__ordinal").drop("__ordinal")


def with_new_columns(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Old and new rows together; a column that only one side has is null on the other."""
    return stored.unionByName(rows, allowMissingColumns=True)


def draft_references(captures: DataFrame, files: DataFrame) -> DataFrame:
    """Captures (day, clip, channel, text) whose recording exists, as reference lines to be corrected by ear, with the number of their channel."""
    there = captures.join(files.select("day", "clip").distinct(), ["day", "clip"], "left_semi")
    counts = there.groupBy("channel").agg(F.count("*").alias("n_channel"))
    return there.join(counts, "channel").select("channel", "n_channel", "day", "clip", F.concat_ws("\t", "clip", F.coalesce("text", F.lit(""))).alias("line"))


def latest_log(names: DataFrame, name: str, prefix: str) -> DataFrame:
    """The greatest name with the prefix; one row, null if there is none."""
    return names.filter(F.col(name).startswith(prefix)).agg(F.max(name).alias("latest"))
