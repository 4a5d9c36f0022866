"""Queries that write files and read them back: recordings as WAV files, a backup as one JSON document."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidalframe.operators import documents
from tidalframe.plans.adapters import RATE, SIG, signal, sql, table
from tidalframe.plans.document_queries import recordings
from tidalframe.sources import backup, wav_chunks
from tidalframe.sources.work import work_path


def wav_round_trip(spark, sf_dir):
    """Each user's signal, written as WAV files and read in ranges of them."""
    path = work_path(spark, "wav")
    chunks = wav_chunks.chunked(signal(spark, sf_dir)).withColumn("sample_rate", F.lit(int(RATE)))
    wav_chunks.write_recordings(chunks, path)
    return wav_chunks.samples(wav_chunks.read_recordings(spark, path))


def _backup(spark, sf_dir):
    """All documents as recordings and all turns as entries of sessions, written as one document; its path."""
    text = lambda blob: documents.base64(blob).alias("blobBase64")
    r = recordings(spark, sf_dir).where("blob is not null").select("id", F.to_json(F.struct("id", "name", text(F.col("blob")))).alias("json"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.col("role").alias("name"), text(F.encode("text", "utf-8")))
    s = turns.select("session", "pos", F.to_json(F.struct("*")).alias("json"))
    path = work_path(spark, "backup")
    backup.write_backup(path, {"recordings": (r, ["id"]), "sessions": (s, ["session", "pos"])}, {"version": 1})
    return path


RECORD = "id bigint, session bigint, pos bigint, name string, blobBase64 string"


def _restored(spark, sf_dir):
    rows = backup.read_backup(spark, _backup(spark, sf_dir), ["recordings", "sessions"])
    return rows.select("section", F.from_json("json", RECORD).alias("r")).select("section", "r.*").withColumn("blob", F.unbase64("blobBase64")).drop("blobBase64")


def backup_document(spark, sf_dir):
    """Every recording and every turn as the document gives them back."""
    return _restored(spark, sf_dir).select("section", "id", "session", "pos", "name", F.decode("blob", "utf-8").alias("text"))


def backup_id_map(spark, sf_dir):
    """The document's recordings, imported where those with even ids are there already."""
    r = recordings(spark, sf_dir)
    return documents.import_map(r.where("id % 2 = 0"), _restored(spark, sf_dir).where("section = 'recordings'").select("id", "blob"))


SQL = {
    "backup_document": "select 'recordings' as section, doc_id as id, null::bigint as session, null::bigint as pos, source as name, text from documents where text is not null "
    "union all select 'sessions', null, conv_id, turn, role, text from conversations",
    "backup_id_map": sql(
        "r as (select doc_id as id, sha256(text) as h from documents where text is not null)", "known as (select h, min(id) as known from r where id % 2 = 0 group by h)", "fresh as (select h, min(id) as first from r group by h)",
        select="select id as old_id, coalesce(known, first) as new_id, known is null as is_new from r left join known using (h) join fresh using (h)",
    ),
    "wav_round_trip": sql(SIG, "c as (select rec_id, idx, greatest(-1, least(1, coalesce(v, 0))) as c from sig)", select="select rec_id, idx, trunc(c * case when c < 0 then 32768 else 32767 end) / 32768 as v from c"),
}

QUERIES = {name: globals()[name] for name in SQL}
