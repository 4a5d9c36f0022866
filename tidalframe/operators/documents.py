"""Recordings and sessions as keyed tables: upserts, imports without doubles, names, exports.

A recording is (id, name, date, blob), a session's recordings are rows (session, pos,
recording). Contents are compared by SHA-256, so blobs are hashed where they lie and
only hashes are shuffled.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.operators.ranges import joined, ranked
from tidalframe.operators.sampling import positions
from tidalframe.sources.work import written


def upsert(table: DataFrame, changes: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """table with the rows of changes put in place of those with their keys.

    Of several changes to one key the one with the largest `order` counts (a column of
    changes), or, without it, the largest row by its columns from left to right, so there
    is one row per changed key. A null key replaces nothing and is put in as it is, once.
    """
    columns = [F.col(c) for c in table.columns]
    last = F.max_by(F.struct(*columns), F.struct(*([F.col(order)] if order else []), *columns)).alias("_last")
    chosen = changes.groupBy(F.col(key).alias("_key")).agg(last).select("_last.*")
    return table.join(chosen.select(key), key, "left_anti").select(*table.columns).unionByName(chosen)


def deleted(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def inserted(table: DataFrame, rows: DataFrame, order: list[str | Column], key: str = "id") -> DataFrame:
    """table and rows, these under keys of their own: the numbers after the largest, in the given order.

    Equal rows get a key each; a key that rows bring is not looked at. Keys of an empty table start at 1.
    """
    top = F.broadcast(table.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_top")))  # one row
    placed = positions(rows.drop(key), order, "_n").join(top).withColumn(key, F.col("_top") + F.col("_n") + 1)
    return table.unionByName(placed.drop("_n", "_top"))


def without(refs: DataFrame, removed: DataFrame) -> DataFrame:
    """refs (session, pos, recording) without the (session, recording) pairs of removed; what stays moves up, counted from 0."""
    return _places(refs.join(removed.select("session", "recording").distinct(), ["session", "recording"], "left_anti").select("session", "pos", "recording"))


def digest(blob: Column) -> Column:
    return F.sha2(blob.cast("binary"), 256)


def content_groups(recordings: DataFrame) -> DataFrame:
    """id -> kept: the smallest id among recordings with the same bytes."""
    marked = recordings.select("id", digest(F.col("blob")).alias("h"))
    return marked.join(marked.groupBy("h").agg(F.min("id").alias("kept")), "h").select("id", "kept")


def marks(recordings: DataFrame, *keys: str) -> DataFrame:
    """keys, part: one hash for the name, date and bytes of a recording."""
    part = F.sha2(F.concat_ws("|", F.coalesce("name", F.lit("")), F.coalesce(F.col("date").cast("string"), F.lit("")), digest(F.col("blob"))), 256)
    return recordings.select(*keys, part.alias("part"))


def fingerprints(entries: DataFrame) -> DataFrame:
    """(session, name, date, blob), or (session, part) of marks(), -> session, fingerprint: equal for the same
    recordings in any order.

    It rests on the number of recordings and two sums of 60 bits of each one's hash, which
    merge in any order, so a session's rows are added up where they lie.
    """
    bits = lambda at: F.sum(F.conv(F.substring("part", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    parts = entries if "part" in entries.columns else marks(entries, "session")
    rows = parts.groupBy("session").agg(F.count("*").alias("n"), bits(1).alias("a"), bits(16).alias("b"))
    return rows.select("session", F.sha2(F.concat_ws("|", F.col("n").cast("string"), "a", "b"), 256).alias("fingerprint"))


def import_map(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, blob) of both -> old_id, new_id, is_new.

    Content that is there already keeps the id it has; of equal incoming contents the
    smallest id is taken in, and an id that is in use by other content is numbered on.
    """
    have = existing.select("id", digest(F.col("blob")).alias("h"))
    known = have.groupBy("h").agg(F.min("id").alias("known"))
    new = incoming.select(F.col("id").alias("old_id"), digest(F.col("blob")).alias("h"))
    joined = new.join(known, "h", "left")
    fresh = joined.where("known is null").groupBy("h").agg(F.min("old_id").alias("first"))
    taken = have.select(F.col("id").alias("first")).distinct().withColumn("taken", F.lit(True))
    fresh = fresh.join(taken, "first", "left")
    clashing = numbered(fresh.where("taken"), "first", "n")
    top = have.agg(F.max("id").alias("a")).join(new.agg(F.max("old_id").alias("b"))).select(F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("top"))
    ids = fresh.where("taken is null").select("h", F.col("first").alias("fresh")).unionByName(clashing.join(F.broadcast(top)).select("h", (F.col("top") + F.col("n")).alias("fresh")))
    return joined.join(ids, "h", "left").select("old_id", F.coalesce("known", "fresh").alias("new_id"), F.col("known").isNull().alias("is_new"))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with a gapless number from 1 in the order of a unique column, without one task for all rows."""
    return positions(df, [order], name).withColumn(name, F.col(name) + 1)


def remapped(refs: DataFrame, mapping: DataFrame, column: str = "recording") -> DataFrame:
    """refs with old ids replaced; ids the mapping hasn't stay."""
    m = mapping.select(F.col("old_id").alias("_old"), "new_id")
    return refs.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("new_id", column)).drop("_old", "new_id")


def new_sessions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming (session, name, date, blob) or (session, part) rows of sessions whose fingerprint is neither known nor that of an earlier incoming one."""
    prints = fingerprints(incoming)
    first = prints.groupBy("fingerprint").agg(F.min("session").alias("session"))
    chosen = first.join(fingerprints(existing).select("fingerprint"), "fingerprint", "left_anti")
    return incoming.join(chosen.select("session"), "session", "left_semi")


def pool_join_typed(pool: DataFrame, recordings: DataFrame) -> DataFrame:
    """(pos, rec_id) with the recordings of that id; ids of another type than the recordings' meet none."""
    same = pool.schema["rec_id"].dataType == recordings.schema["id"].dataType
    return pool.join(recordings, F.col("rec_id") == F.col("id") if same else F.lit(False))


def import_backup(existing: DataFrame, existing_refs: DataFrame, incoming: DataFrame, incoming_refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recordings (id, name, blob) and refs (session, pos, recording) of both -> what to add: recordings under
    their new ids, and refs with those ids.

    Content that is there already is not added; its refs lead to it. Sessions that are there
    already, or earlier among the incoming ones, are passed over; unmapped refs stay.
    """
    mapping = import_map(existing, incoming)
    new = incoming.join(mapping.where("is_new").select(F.col("old_id").alias("id"), "new_id"), "id")
    added = new.groupBy("new_id").agg(F.min_by(F.struct("name", "blob"), "id").alias("r")).select(F.col("new_id").alias("id"), "r.name", "r.blob")
    # recordings are hashed where they lie, so sessions meet hashes instead of bytes
    marked = lambda recs: marks(recs.select(F.col("id").alias("recording"), "name", F.lit(None).cast("string").alias("date"), "blob"), "recording")
    entries = lambda refs, recs: refs.join(marked(recs), "recording").select("session", "part")
    fresh = new_sessions(entries(existing_refs, existing), entries(incoming_refs, incoming)).select("session").distinct()
    return added, remapped(incoming_refs.join(fresh, "session", "left_semi"), mapping)


def trimmed_copies(recordings: DataFrame, trimmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """recordings (id, name) and trimmed (rec_id, idx, v) -> the copies to add (id, name) and their samples.

    Copies take the ids after the largest; their names are the next free '<base> Trimmed N',
    those of one base in the order of their ids.
    """
    base = F.regexp_replace("name", "(?i)\\s+trimmed(?:\\s+\\d+)?$", "")
    mine = recordings.join(trimmed.select(F.col("rec_id").alias("id")).distinct(), "id", "left_semi").withColumn("k", F.lower(base))
    placed = numbered(mine, "id", "n")
    top = F.broadcast(recordings.agg(F.max("id").alias("top")))  # one row
    free = next_trimmed_name(recordings).select(F.lower("base").alias("k"), "base", F.regexp_extract("next_name", "(\\d+)$", 1).cast("long").alias("free"))
    new = ranked(placed, ["k"], ["id"], "nth", "_of").join(top).join(free, "k").select("id", (F.col("top") + F.col("n")).alias("new_id"), F.concat("base", F.lit(" Trimmed "), (F.col("free") + F.col("nth")).cast("string")).alias("name"))
    samples = trimmed.join(new.select(F.col("id").alias("rec_id"), "new_id"), "rec_id").select(F.col("new_id").alias("rec_id"), "idx", "v")
    return new.select(F.col("new_id").alias("id"), "name"), samples


def _rounded(places: int, kind: str):
    """An Arrow function: numbers as text, the exact binary value rounded half away from zero."""

    def text(x: float | None) -> str | None:
        if x is None or not math.isfinite(x):
            return x if x is None else "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
        if x == 0:  # a zero has no exponent of its own, and no sign
            return f"{0:.{places}f}" + ("e+0" if kind == "e" else "")
        return f"{Decimal(x):.{places}{kind}}"

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        # the digits of any double fit in the precision
        with localcontext(prec=1200, rounding=ROUND_HALF_UP, Emax=2000, Emin=-2000):
            return pa.array([text(x) for x in values.to_pylist()], pa.string())

    return run


def fixed(x: Column, places: int) -> Column:
    """Digits with `places` decimals; of two equally near numbers the one farther from zero. "NaN" and "Infinity" as such."""
    return _rounded(places, "f")(x.cast("double"))


def exponential(x: Column, places: int) -> Column:
    """d.dde+n, the exponent without leading zeros; rounded as fixed() does."""
    return _rounded(places, "e")(x.cast("double"))


def pool_join(pool: DataFrame, recordings: DataFrame) -> DataFrame:
    """(pos, rec_id) with the first recording of that id as text, in pool order (column pos); ids without one are dropped."""
    first = recordings.withColumn("_r", F.row_number().over(Window.partitionBy(F.col("id").cast("string")).orderBy("id"))).where("_r = 1").drop("_r")
    return pool.join(first.withColumn("_key", F.col("id").cast("string")), F.col("rec_id").cast("string") == F.col("_key")).drop("_key")


def pool_set(pool: DataFrame) -> DataFrame:
    """(pos, rec_id) without nulls and repeats: the first place of each id counts; pos is renumbered from 0."""
    first = pool.where("rec_id is not null").groupBy("rec_id").agg(F.min("pos").alias("pos"))
    return numbered(first, "pos", "_n").select((F.col("_n") - 1).alias("pos"), "rec_id")


def named(rows: DataFrame, recordings: DataFrame) -> DataFrame:
    """rows (rec_id, ...) with `name`: the recording's, or its id where that is missing or empty."""
    names = recordings.select(F.col("id").alias("_id"), F.nullif("name", F.lit("")).alias("_name"))
    return rows.join(names, F.col("rec_id") == F.col("_id"), "left").withColumn("name", F.coalesce("_name", F.col("rec_id").cast("string"))).drop("_id", "_name")


def next_trimmed_name(recordings: DataFrame) -> DataFrame:
    """base -> next_name: '<base> Trimmed N', N one above the largest in use in any case of letters; a bare 'Trimmed' counts 1."""
    tail = "(?i)\\s+trimmed(?:\\s+(\\d+))?$"
    base = F.regexp_replace(F.col("name"), tail, "")
    found = F.regexp_extract("name", tail, 1)
    used = F.when(F.col("name").rlike(tail), F.when(found == "", 1).otherwise(F.try_to_number(found, F.lit("999999999")).cast("long"))).otherwise(0)
    per = recordings.select(F.lower(base).alias("k"), base.alias("base"), used.cast("long").alias("n")).groupBy("k").agg(F.min("base").alias("base"), F.max("n").alias("n"))
    return per.select("base", F.concat("base", F.lit(" Trimmed "), (F.col("n") + 1).cast("string")).alias("next_name"))


_RUN = 4096


def _places(refs: DataFrame) -> DataFrame:
    """refs (session, pos, recording) with pos counted from 0 without gaps in each session.

    Runs of _RUN positions are numbered apart and moved by the rows before them, so a long
    session isn't one task's.
    """
    rows = refs.withColumn("_run", F.coalesce(F.floor(F.col("pos") / _RUN), F.lit(-1)))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("session", "_run").orderBy("pos", "recording")) - 1)
    before = F.sum("count").over(Window.partitionBy("session").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("session", "_run").count().select("session", "_run", F.coalesce(before, F.lit(0)).alias("_before"))
    return joined(rows, offsets, ["session", "_run"]).select("session", (F.col("_before") + F.col("_n")).cast("int").alias("pos"), "recording")


def export_sessions(sessions: DataFrame, refs: DataFrame, recordings: DataFrame) -> DataFrame:
    """session, pos, json: a line with the name and without pos for each session, and one for each of its
    recordings in order, with its content in base64; dangling references are dropped."""
    rec = recordings.select(F.col("id").alias("recording"), "name", base64(F.col("blob")).alias("blob64"))
    placed = _places(refs.select("session", "pos", "recording").join(rec.select("recording"), "recording", "left_semi").join(sessions.select("session"), "session", "left_semi"))
    entry = F.to_json(F.struct(F.col("recording").alias("id"), "name", F.col("blob64").alias("blobBase64")))
    lines = placed.join(rec, "recording").select("session", "pos", entry.alias("json"))
    return sessions.select("session", F.lit(None).cast("int").alias("pos"), F.to_json(F.struct("name")).alias("json")).unionByName(lines)


ENTRY_JSON = "id bigint, name string, blobBase64 string"


def import_sessions(exported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session, pos, json) -> session names, and (session, pos, id, name, blob) rows."""
    names = exported.where("pos is null").select("session", F.from_json("json", "name string")["name"].alias("name"))
    rows = exported.where("pos is not null").select("session", "pos", F.from_json("json", ENTRY_JSON).alias("r"))
    return names, rows.select("session", "pos", "r.id", "r.name", F.unbase64("r.blobBase64").alias("blob"))


def split_embedded(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session, recordings array<struct<id, name, blob>>) -> refs (session, pos, recording) of entries
    without a blob, and the embedded (session, pos, name, blob) that need ids of their own."""
    rows = sessions.select("session", F.posexplode("recordings").alias("pos", "r"))
    embedded = F.col("r.blob").isNotNull()
    return rows.where(~embedded).select("session", "pos", F.col("r.id").alias("recording")), rows.where(embedded).select("session", "pos", "r.name", "r.blob")


def migrated(recordings: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """recordings (id, name, blob) and sessions as split_embedded() reads them -> the recordings with the embedded
    ones among them, and refs (session, pos, recording) of all sessions.

    Embedded ones get the numbers after the largest id, in the order of session and place; a
    missing name becomes empty. Entries with neither content nor id are dropped and places
    close up. A content's row moves once, to be numbered.
    """
    plain, embedded = split_embedded(sessions)
    top = F.broadcast(recordings.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top")))  # one row
    placed = written(positions(embedded, ["session", "pos"], "_n").join(top).select("session", "pos", (F.col("_top") + F.col("_n") + 1).alias("id"), F.coalesce("name", F.lit("")).alias("name"), "blob"), "migrated")
    refs = plain.where("recording is not null").unionByName(placed.select("session", "pos", F.col("id").alias("recording")))
    return recordings.select("id", "name", "blob").unionByName(placed.select("id", "name", "blob")), _places(refs)


def base64(blob: Column) -> Column:
    """One line, whatever the length."""
    return F.regexp_replace(F.base64(blob.cast("binary")), "[\\r\\n]", "")


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def file_name(name: Column) -> Column:
    return F.regexp_replace(name, "\\s+", "_")


def title_of_file(name: Column) -> Column:
    """Without the last extension."""
    return F.regexp_replace(name, "\\.[^/.]+$", "")


def shown_date(text: Column) -> Column:
    """DD/MM/YYYY HH:mm:ss, or the text as it is if it is no date."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "dd/MM/yyyy HH:mm:ss"), text)
