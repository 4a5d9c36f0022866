"""Recordings and sessions: documents stand for recordings, conversations for sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidalframe.functions.signal import hex_to_rgba
from tidalframe.operators import documents
from tidalframe.plans.adapters import sql, table


def recordings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.encode("text", "utf-8").alias("blob"))


def _entries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.col("role").alias("name"), F.lit(None).cast("string").alias("date"), F.encode("text", "utf-8").alias("blob"))


def content_dedup(spark, sf_dir):
    return documents.content_groups(recordings(spark, sf_dir))


def session_fingerprint(spark, sf_dir):
    return documents.fingerprints(_entries(spark, sf_dir))


def import_sessions_dedup(spark, sf_dir):
    e = _entries(spark, sf_dir)
    incoming = e.withColumn("session", F.col("session") + 100_000)
    return documents.new_sessions(e.where("session % 3 = 0"), incoming).select("session", "pos")


def import_id_map(spark, sf_dir):
    r = recordings(spark, sf_dir)
    # even ids are there, odd ones come in, half of them under ids that are in use
    incoming = r.where("id % 2 = 1").withColumn("id", F.when(F.col("id") % 4 == 1, F.col("id") - 1).otherwise(F.col("id")))
    return documents.import_map(r.where("id % 2 = 0"), incoming)


def upsert_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    changes = c.where("id % 3 = 0").select((F.col("id") + 500).alias("id"), F.upper("name").alias("name"))
    return documents.upsert(c, changes)


def delete_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return documents.deleted(c, c.where("id % 5 = 2"))


def insert_rows(spark, sf_dir):
    """Suppliers put in among the customers, under ids that the table gives them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return documents.inserted(c, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), ["name"])


def session_removals(spark, sf_dir):
    """Orders as sessions, their parts as recordings; the parts of every third supplier go."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("recording"), "l_suppkey")
    return documents.without(items.drop("l_suppkey"), items.where("l_suppkey % 3 = 0"))


def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey = 42").select("c_custkey", "c_name")


def pool_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") * 2).alias("rec_id"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return documents.pool_join(o, c)


def pool_unique(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("rec_id"))
    return documents.pool_set(o)


def pool_lookup_typed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("rec_id"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    as_text = documents.pool_join_typed(o.withColumn("rec_id", F.col("rec_id").cast("string")), c)  # meets none
    return documents.pool_join_typed(o, c).select("pos", "id", "name").unionByName(as_text.select("pos", "id", "name"))


def number_formats(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x = F.col("p_retailprice").cast("double") / 8192
    return p.select("p_partkey", documents.fixed(x, 3).alias("fixed"), documents.exponential(x * F.when(F.col("p_partkey") % 2 == 0, 1e-14).otherwise(1e9), 2).alias("exponential"))


def name_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("rec_id"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("name"))
    return documents.named(o, c)


def next_trimmed_name(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 4
    name = F.concat("p_brand", F.when(kind == 0, F.lit("")).when(kind == 1, F.lit(" Trimmed")).otherwise(F.concat(F.lit(" tRimmed "), F.col("p_size").cast("string"))))
    return documents.next_trimmed_name(p.select(name.alias("name")))


def export_session_json(spark, sf_dir):
    e = _entries(spark, sf_dir)
    rec = e.select((F.col("session") * 1000 + F.col("pos")).alias("id"), "name", "blob")
    refs = e.select("session", "pos", (F.col("session") * 1000 + F.col("pos")).alias("recording"))
    sessions = e.select("session", F.concat(F.lit("s"), F.col("session").cast("string")).alias("name")).distinct()
    names, rows = documents.import_sessions(documents.export_sessions(sessions, refs, rec))
    return rows.join(names.withColumnRenamed("name", "session_name"), "session").select("session", "session_name", F.col("pos").cast("long").alias("pos"), "id", "name", F.decode("blob", "utf-8").alias("text"))


def backup_counts(spark, sf_dir):
    r, e = recordings(spark, sf_dir), _entries(spark, sf_dir)
    parts = r.where("blob is not null").agg(F.count("*").alias("recordings"), F.sum(F.length("blob")).alias("bytes"))
    return parts.join(e.agg(F.count_distinct("session").alias("sessions")))


def base64_text(spark, sf_dir):
    return recordings(spark, sf_dir).select("id", documents.base64(F.col("blob")).alias("b64"))


def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", documents.escape_html(F.col("html")).alias("html"))


def file_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", documents.file_name(F.col("html")).alias("file_name"), documents.title_of_file(F.col("url")).alias("title"))


def date_format(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("no date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", documents.shown_date(text).alias("shown"))


def hex_rgba(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0")).alias("h"))
    return p.select("p_partkey", hex_to_rgba(F.concat(F.lit("#"), F.col("h")), 0.5).alias("rgba"))


def session_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    # dates repeat: the key makes the order total
    order = F.struct((-F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("t"), "o_orderkey")
    return documents.numbered(o.withColumn("order", order), "order", "place").select("o_orderkey", "place")


ENT = "en as (select conv_id as session, turn as pos, role as name, text from conversations)"
FP = (
    "select session, sha256(concat_ws('|', count(*), sum(('0x' || h[1:15])::bigint), sum(('0x' || h[16:30])::bigint))) as fingerprint "
    "from (select session, sha256(concat_ws('|', coalesce(name, ''), '', sha256(text))) as h from {0}) group by session"
)
TRIMMED = "(?i)\\s+trimmed(?:\\s+(\\d+))?$"

SQL = {
    "content_dedup": sql("h as (select doc_id as id, sha256(text) as h from documents)", select="select id, min(id) over (partition by h) as kept from h"),
    "session_fingerprint": sql(ENT, select=FP.format("en")),
    "import_sessions_dedup": sql(
        ENT, f"fp as ({FP.format('en')})", "ok as (select min(session) as session from fp where fingerprint not in (select fingerprint from fp where session % 3 = 0) group by fingerprint)",
        select="select session + 100000 as session, pos from en where session in (select session from ok)",
    ),
    "import_id_map": sql(
        "hv as (select doc_id as id, sha256(text) as h from documents where doc_id % 2 = 0)", "nw as (select case when doc_id % 4 = 1 then doc_id - 1 else doc_id end as old_id, sha256(text) as h from documents where doc_id % 2 = 1)",
        "j as (select old_id, h, (select min(id) from hv where hv.h = nw.h) as known from nw)", "f as (select h, min(old_id) as first from j where known is null group by h)",
        "g as (select h, first, first in (select id from hv) as taken from f)", "k as (select h, row_number() over (order by first) + greatest((select max(id) from hv), (select max(old_id) from nw)) as fresh from g where taken union all select h, first from g where not taken)",
        select="select old_id, coalesce(known, fresh) as new_id, known is null as is_new from j left join k using (h)",
    ),
    "upsert_rows": "with ch as (select c_custkey + 500 as id, upper(c_name) as name from customer where c_custkey % 3 = 0) select c_custkey as id, c_name as name from customer where c_custkey not in (select id from ch) union all select id, name from ch",
    "delete_rows": "select c_custkey as id, c_name as name from customer where c_custkey % 5 <> 2",
    "insert_rows": "select c_custkey as id, c_name as name from customer union all select (select max(c_custkey) from customer) + row_number() over (order by s_name), s_name from supplier",
    "session_removals": sql(
        "r as (select distinct l_orderkey, l_partkey from lineitem where l_suppkey % 3 = 0)", "k as (select l_orderkey, l_linenumber, l_partkey from lineitem anti join r using (l_orderkey, l_partkey))",
        select="select l_orderkey as session, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as pos, l_partkey as recording from k",
    ),
    "point_lookup": "select c_custkey, c_name from customer where c_custkey = 42",
    "pool_lookup": "select o_orderkey as pos, o_custkey * 2 as rec_id, c_custkey as id, c_name as name from orders join customer on o_custkey * 2 = c_custkey",
    "pool_unique": "select row_number() over (order by min(o_orderkey)) - 1 as pos, o_custkey as rec_id from orders where o_custkey % 7 <> 0 group by o_custkey",
    "pool_lookup_typed": "select o_orderkey as pos, c_custkey as id, c_name as name from orders join customer on o_custkey = c_custkey",
    # forty more digits than are shown, so that the rounding is by the exact value and ties go up
    "number_formats": sql(
        "p as (select p_partkey, p_retailprice::double / 8192 as x, p_retailprice::double / 8192 * case when p_partkey % 2 = 0 then 1e-14 else 1e9 end as y from part)",
        "d as (select p_partkey, printf('%.43f', x) as f, printf('%.42e', y) as e from p)",
        "n as (select p_partkey, (f[:-45] || f[-43:-41])::bigint + (f[-40] >= '5')::bigint as f, (e[1] || e[3:4])::bigint + (e[5] >= '5')::bigint as m, regexp_extract(e, 'e(.*)', 1)::bigint as e from d)",
        select="select p_partkey, (f // 1000) || '.' || lpad((f % 1000)::varchar, 3, '0') as fixed, case when m = 1000 then '1.00' else (m // 100) || '.' || lpad((m % 100)::varchar, 2, '0') end "
        "|| 'e' || case when e + (m = 1000)::bigint < 0 then '-' else '+' end || abs(e + (m = 1000)::bigint) as exponential from n",
    ),
    "name_lookup": "select o_orderkey, o_custkey * 2 as rec_id, coalesce(case when c_custkey % 4 = 0 then null else c_name end, (o_custkey * 2)::varchar) as name from orders left join customer on o_custkey * 2 = c_custkey",
    "next_trimmed_name": sql(
        "n as (select p_brand || case p_partkey % 4 when 0 then '' when 1 then ' Trimmed' else ' tRimmed ' || p_size end as name from part)",
        f"u as (select regexp_replace(name, '{TRIMMED}', '') as base, case when regexp_matches(name, '{TRIMMED}') then coalesce(try_cast(regexp_extract(name, '{TRIMMED}', 1) as bigint), 1) else 0 end as n from n)",
        select="select min(base) as base, min(base) || ' Trimmed ' || (max(n) + 1) as next_name from u group by lower(base)",
    ),
    "export_session_json": sql(ENT, "k as (select session, 's' || session as session_name, session * 1000 + pos as id, pos, name, text from en)", select="select session, session_name, row_number() over (partition by session order by pos) - 1 as pos, id, name, text from k"),
    "backup_counts": "select count(*) as recordings, sum(octet_length(encode(text)))::bigint as bytes, (select count(distinct conv_id) from conversations) as sessions from documents where text is not null",
    "base64_text": "select doc_id as id, base64(encode(text)) as b64 from documents",
    "html_escape": "select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as html from pages",
    "file_names": "select page_id, regexp_replace(html, '\\s+', '_', 'g') as file_name, regexp_replace(url, '\\.[^/.]+$', '') as title from pages",
    "date_format": "select o_orderkey, case when o_orderkey % 5 = 0 then 'no date' else strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') end as shown from orders",
    "hex_rgba": "select p_partkey, 'rgba(' || (n // 65536) || ',' || (n // 256 % 256) || ',' || (n % 256) || ',0.5)' as rgba from (select p_partkey, p_partkey * 7919 % 16777216 as n from part)",
    "session_order": "select o_orderkey, row_number() over (order by epoch(o_orderdate)::bigint desc, o_orderkey) as place from orders",
}

QUERIES = {name: globals()[name] for name in SQL}
