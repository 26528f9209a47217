"""The registered queries over the driver's tables, each beside the DuckDB SQL that gives the same rows.

Names begin with the operator's place in the survey (f7 is the search filter, w2 the speech regions, ...).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scribelake.functions import text as X
from scribelake.functions import vectors as V
from scribelake.operators import jobs, library, mutations, signal, speakers, text
from scribelake.operators.agglomerate import cluster_turns
from scribelake.operators.decoding import decode_sounds
from scribelake.sources import adapters as A
from scribelake.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function by its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lib(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return A.notes(spark, d), A.folders(spark, d)


_BRIEF = ("id", "title", "created", "updated", "source", "duration", "starred", "trashed", "folder_id", "folder")
_BRIEF_SQL = "n.id, n.title, n.created, n.updated, n.source, n.duration, n.starred, n.trashed, n.folder_id, f.name AS folder"
_VIEW_SQL = f"WITH {A.NOTES_SQL} SELECT {_BRIEF_SQL} FROM notes n LEFT JOIN folders f ON f.id = n.folder_id WHERE "


def _listed(view: str, q: str = "") -> Query:
    return lambda spark, d: library.list_notes(*_lib(spark, d), view, q).select(*_BRIEF)


# ---- scans, views and search -----------------------------------------------------------------------------------------
_SEARCH, _WILD = "Tion er", "the_%LY"
for _name, _view, _q, _sql in (
    ("f1_view_all", "all", "", "n.trashed IS NULL"),
    ("f2_view_trash", "trash", "", "n.trashed IS NOT NULL"),
    ("f3_view_starred", "starred", "", "n.trashed IS NULL AND n.starred"),
    ("f4_view_live", "live", "", "n.trashed IS NULL AND n.source = 'live'"),
    ("f5_view_folder", "folder:5", "", "n.trashed IS NULL AND n.folder_id = 5"),
    ("f7_search", "all", _SEARCH, f"n.trashed IS NULL AND ({X.like_sql('n.title', f'%{_SEARCH}%')} OR {X.like_sql('n.transcript', f'%{_SEARCH}%')})"),
    ("f7_search_wildcards", "starred", _WILD, f"n.trashed IS NULL AND n.starred AND ({X.like_sql('n.title', f'%{_WILD}%')} OR {X.like_sql('n.transcript', f'%{_WILD}%')})"),
):
    QUERIES[_name], ORACLES[_name] = _listed(_view, _q), _VIEW_SQL + _sql


@query(f"WITH {A.NOTES_SQL} SELECT id, title, created, updated, source, duration, folder_id, starred, trashed, length(transcript)::INTEGER AS size FROM notes")
def s2_scan_notes(spark, d):
    return A.notes(spark, d).select("id", "title", "created", "updated", "source", "duration", "folder_id", "starred", "trashed", F.length("transcript").alias("size"))


@query(f"WITH {A.NOTES_SQL} SELECT * FROM notes WHERE id = 42")
def s3_get_note(spark, d):
    return A.notes(spark, d).where("id = 42").drop("audio")


@query(f"WITH {A.NOTES_SQL} SELECT id, name FROM folders")
def s4_list_folders(spark, d):
    return A.folders(spark, d).orderBy("name")


@query("""SELECT event_id, array_to_string(regexp_extract_all('"mic ' || user_id || '" (audio) "cam" (video)' || chr(10) || '"' || event_type || '" (audio)', '"([^"]+)" \\(audio\\)', 1), '|') AS devices FROM events""")
def s9_input_devices(spark, d):
    listing = F.concat(F.lit('"mic '), F.col("user_id").cast("string"), F.lit('" (audio) "cam" (video)\n"'), F.col("event_type"), F.lit('" (audio)'))
    return A.table(spark, d, "events").select("event_id", F.array_join(X.audio_devices(listing), "|").alias("devices"))


@query("""WITH names AS (SELECT event_id, [event_type || '.' || (event_id % 3), 'CPU', event_type || '.9'] AS devices FROM events)
SELECT event_id, devices[1] AS first, array_to_string(list_sort(list_distinct(list_transform(devices, lambda x: split_part(x, '.', 1)))), ',') AS kinds FROM names""")
def s11_device_kinds(spark, d):
    first = F.concat_ws(".", "event_type", (F.col("event_id") % 3).cast("string"))
    rows = A.table(spark, d, "events").select("event_id", first.alias("first"), F.array(first, F.lit("CPU"), F.concat("event_type", F.lit(".9"))).alias("devices"))
    return rows.select("event_id", "first", F.array_join(X.device_kinds(F.col("devices")), ",").alias("kinds"))


@query(f"WITH {A.NOTES_SQL} SELECT to_json({{'id': id, 'source': source, 'starred': starred, 'folder_id': folder_id}})::VARCHAR AS body FROM notes")
def k5_json_response(spark, d):
    return A.notes(spark, d).select(F.to_json(F.struct("id", "source", "starred", "folder_id")).alias("body"))


@query(f"WITH {A.NOTES_SQL} SELECT id, source, '1700000000-' || id || '.wav' AS audio FROM notes WHERE id % 4 = 0")
def k4_attach_audio(spark, d):
    notes = A.notes(spark, d).withColumn("audio", F.when(F.col("id") % 2 == 1, "kept.wav"))
    recordings = notes.where("id % 4 = 0 or id % 4 = 1").select(F.col("id").alias("note_id"), F.concat(F.lit("C:\\rec\\"), F.col("id").cast("string"), F.lit(".wav")).alias("path"))
    events = mutations.attach_audio(notes, recordings, 1.7e9)
    return notes.join(events, notes["id"] == events["note_id"]).select("id", notes["source"], F.element_at("fields", "audio").alias("audio"))


@query(f"WITH {A.NOTES_SQL}, top AS (SELECT id, transcript, title, created, updated, source, duration, starred, trashed, folder_id FROM notes WHERE trashed IS NULL) SELECT {_BRIEF_SQL} FROM top n LEFT JOIN folders f ON f.id = n.folder_id WHERE n.source = 'live' AND n.folder_id = 10")
def f10_folder_in_view(spark, d):
    return library.list_notes(*_lib(spark, d), "live").where("folder_id = 10").select(*_BRIEF)


@query(f"WITH {A.NOTES_SQL} SELECT id, source = 'live' AND id <> 30 AS interrupted FROM notes")
def f11_interrupted(spark, d):
    return library.interrupted(A.notes(spark, d), 30).select("id", "interrupted")


@query(f"WITH {A.BLOCKS_SQL} SELECT recording_id, idx FROM blocks WHERE sqrt(energy) >= 64")
def f15_live_gate(spark, d):
    return signal.gate_live(A.blocks(spark, d).withColumn("sum_sq", F.col("energy") * 3200).withColumn("n", F.lit(3200))).select("recording_id", "idx")


@query("SELECT event_id FROM events WHERE floor(value) % 8 / 32768.0 >= 1e-4")
def f14_file_gate(spark, d):
    return signal.gate_file(A.table(spark, d, "events").withColumn("peak", F.floor("value") % 8)).select("event_id")


# ---- joins -----------------------------------------------------------------------------------------------------------
@query(f"WITH {A.NOTES_SQL} SELECT n.id, n.folder_id, f.name AS folder FROM notes n LEFT JOIN folders f ON f.id = n.folder_id")
def j1_notes_folders(spark, d):
    return library.with_folder(A.notes(spark, d), A.folders(spark, d)).select("id", "folder_id", "folder")


@query(f"WITH {A.NOTES_SQL} SELECT id, CASE WHEN folder_id IN (SELECT id FROM folders) THEN folder_id END AS folder_id FROM notes")
def j2_folder_check(spark, d):
    return library.checked_folder(A.notes(spark, d), A.folders(spark, d)).select("id", "folder_id")


@query(f"WITH {A.NOTES_SQL} SELECT id, updated, CASE WHEN folder_id % 4 <> 0 THEN folder_id END AS folder_id FROM notes")
def j3_set_null(spark, d):
    return library.without_folders(A.notes(spark, d), A.folders(spark, d).where("id % 4 = 0")).select("id", "updated", "folder_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j4_missing(spark, d):
    return library.missing(A.table(spark, d, "documents").select("doc_id"), A.table(spark, d, "labels"), "doc_id")


# Squares, so that few fragments are as far from the turn before as from the one after. Where some are, the last bits decide,
# and those of the JVM's cosine and sine aren't always those of the C library, so the values are looked up.
_V_SQL = "[cos((event_id * event_id % 1009)::DOUBLE), sin((event_id * event_id % 1009)::DOUBLE)]"


def _v(c="event_id"):
    place = (F.col(c) * F.col(c) % 1009).cast("int")
    known = [F.split(F.lit(" ".join(repr(f(x)) for x in range(1009))), " ").cast("array<double>") for f in (math.cos, math.sin)]
    return F.array(*(F.get(values, place) for values in known))


@query(f"""WITH {A.SPANS_SQL}, s AS (SELECT recording_id, start, label, event_id, {_V_SQL} AS v FROM spans WHERE n > 0),
f AS (SELECT * FROM s WHERE event_id % 7 = 3), t AS (SELECT * FROM s WHERE event_id % 7 <> 3),
b AS (SELECT f.*, t.label AS la, t.v AS va FROM f ASOF LEFT JOIN t ON f.recording_id = t.recording_id AND f.start > t.start),
n AS (SELECT b.*, t.label AS lb, t.v AS vb FROM b ASOF LEFT JOIN t ON b.recording_id = t.recording_id AND b.start <= t.start)
SELECT recording_id, start, CASE WHEN la IS NULL OR list_dot_product(v, vb) > list_dot_product(v, va) THEN lb ELSE la END AS label FROM n""")
def j5_nearest_turn(spark, d):
    rows = A.spans(spark, d).where("n > 0").withColumn("v", _v())
    return speakers.nearest_turn(rows.where("event_id % 7 = 3"), rows.where("event_id % 7 <> 3"), ["recording_id"])


@query("""WITH s AS (SELECT user_id, event_id % 50 AS tile_idx, event_id, (value * 60)::INTEGER AS x, ((event_id * 7919) % 60001 - 30000)::INTEGER AS y FROM events)
SELECT user_id, tile_idx, event_id, (x + y) // 2 AS a, (y - x) // 2 AS b FROM (SELECT user_id, tile_idx, event_id, floor(x / 1.0)::INTEGER AS x, y FROM s) WHERE (x + y) % 2 = 0 AND (y - x) % 2 = 0
UNION ALL SELECT user_id, tile_idx, event_id, floor((x + y) / 2.0)::INTEGER, floor((y - x) / 2.0)::INTEGER FROM s WHERE NOT ((x + y) % 2 = 0 AND (y - x) % 2 = 0)""")
def j7_mix_streams(spark, d):
    x, y = F.rint(F.col("value") * 60).cast("int"), ((F.col("event_id") * 7919) % 60001 - 30000).cast("int")
    rows = A.table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 50).alias("tile_idx"), x.alias("x"), y.alias("y"))
    left = rows.select("user_id", "event_id", "tile_idx", F.array(F.col("x"), -F.col("x"), F.lit(5)).alias("samples"))
    right = rows.select("user_id", "event_id", "tile_idx", F.array("y", "y").alias("samples"))
    return signal.mix(left, right, ["user_id", "event_id"]).select("user_id", "tile_idx", "event_id", F.get("samples", F.lit(0)).cast("int").alias("a"), F.get("samples", F.lit(1)).cast("int").alias("b"))


@query("""WITH u AS (SELECT vec_id // 200 AS recording, label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) AS x FROM embeddings),
s AS (SELECT recording, label, dim, sum(x) AS x, count(*) AS n FROM u GROUP BY ALL)
SELECT a.recording, a.label AS a, b.label AS b, round(sum(a.x * b.x) / any_value(a.n * b.n), 6) + 0.0::DOUBLE AS cosine FROM s a JOIN s b ON a.recording = b.recording AND a.dim = b.dim AND a.label < b.label GROUP BY 1, 2, 3""")
def j8_pairwise_cosine(spark, d):
    # Two hundred turns a recording, clustered by label.
    rows = A.table(spark, d, "embeddings").withColumn("recording", F.floor(F.col("vec_id") / 200))
    return speakers.cluster_similarity(rows, "embedding", "label", ["recording"]).withColumn("cosine", F.round("cosine", 6) + F.lit(0.0))


@query("SELECT event_id, coalesce(m.text, event_type) AS message FROM events LEFT JOIN (VALUES ('error', '오류'), ('click', '클릭')) m(code, text) ON code = event_type")
def j9_messages(spark, d):
    messages = spark.createDataFrame([("error", "오류"), ("click", "클릭")], "event_type string, text string")
    return A.table(spark, d, "events").join(F.broadcast(messages), "event_type", "left").select("event_id", F.coalesce("text", "event_type").alias("message"))


@query("SELECT DISTINCT user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)")
def j10_semi_lookup(spark, d):
    events = A.table(spark, d, "events")
    return events.join(events.where("event_type = 'error' and value > 200").select("user_id"), "user_id", "left_semi").select("user_id", "event_type").distinct()


# ---- aggregates ------------------------------------------------------------------------------------------------------
def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_KEYWORDS_SQL = f"""words AS (SELECT id, unnest(regexp_extract_all(transcript, '{X.WORD}')) AS w, generate_subscripts(regexp_extract_all(transcript, '{X.WORD}'), 1) AS pos FROM texts),
stems AS (SELECT id, pos, CASE WHEN length(w) > 2 THEN regexp_replace(w, '({"|".join(X.PARTICLES)})$', '') ELSE w END AS s FROM words),
counts AS (SELECT id, s, count(*) AS c, min(pos) AS first FROM stems WHERE length(s) >= 2 AND s NOT IN ({_sql_list(X.STOPWORDS)}) AND NOT regexp_matches(s, '({"|".join(X.ENDINGS)})$') GROUP BY id, s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, first) AS r FROM counts),
top AS (SELECT id, string_agg(s, ',' ORDER BY r) AS keywords FROM ranked WHERE r <= 3 GROUP BY id)"""


@query(f"WITH texts AS (SELECT doc_id AS id, text AS transcript FROM documents), {_KEYWORDS_SQL} SELECT t.id, coalesce(keywords, '') AS keywords FROM texts t LEFT JOIN top USING (id)")
def a1_keywords(spark, d):
    return text.keywords(A.table(spark, d, "documents"), "doc_id", "text").select("id", F.array_join("keywords", ",").alias("keywords"))


@query(f"""WITH {A.NOTES_SQL}, texts AS (SELECT * FROM notes WHERE trashed IS NULL AND ({X.like_sql('title', '%the%')} OR {X.like_sql('transcript', '%the%')})), {_KEYWORDS_SQL}
SELECT n.id, n.title, n.created, n.source, n.duration, f.name AS folder, coalesce(keywords, '') AS keywords FROM texts n LEFT JOIN folders f ON f.id = n.folder_id LEFT JOIN top ON top.id = n.id""")
def main_screen(spark, d):
    rows = library.list_with_keywords(*_lib(spark, d), "all", "the")
    return rows.select("id", "title", "created", "source", "duration", "folder", F.array_join("keywords", ",").alias("keywords"))


@query(f"WITH {A.BLOCKS_SQL} SELECT recording_id, median(energy) AS median, greatest(1024.0::DOUBLE, 0.08::DOUBLE * median(energy)) AS threshold FROM blocks GROUP BY recording_id")
def a2_a3_quiet_threshold(spark, d):
    blocks = A.blocks(spark, d)
    return blocks.groupBy("recording_id").agg(F.median("energy").alias("median")).join(signal.quiet_threshold(blocks, ["recording_id"]), "recording_id")


@query("SELECT user_id, count(*) * 160 AS total, count(*) * 160 / 16000.0::DOUBLE AS seconds, max((floor(value))::INTEGER) AS peak, round(sqrt(sum(floor(value) * floor(value) * 160)::DOUBLE / (count(*) * 160)), 6) AS rms FROM events GROUP BY user_id")
def a4_a13_recording_totals(spark, d):
    v = F.floor("value")
    tiles = A.table(spark, d, "events").select("user_id", F.lit(160).cast("long").alias("n"), (v * v * 160).cast("double").alias("sum_sq"), v.cast("int").alias("peak"))
    return signal.totals(tiles, ["user_id"]).withColumn("rms", F.round("rms", 6))


@query(f"WITH {A.NOTES_SQL} SELECT count(*) AS live FROM notes WHERE trashed IS NULL AND source = 'live'")
def a5_live_count(spark, d):
    return library.live_count(A.notes(spark, d))


@query(f"WITH {A.NOTES_SQL} SELECT NOT coalesce(bool_and(starred), false) AS target FROM notes WHERE id % 3 = 0")
def a6_star_target(spark, d):
    notes = A.notes(spark, d)
    return library.star_target(notes, notes.where("id % 3 = 0").select("id"))


@query("""WITH r AS (SELECT event_id, event_type AS name, (user_id % 7)::VARCHAR AS version, 'L' || event_id % 4 AS license, 'p' || event_id % 50 AS place FROM events),
e AS (SELECT name, version, place, min(event_id) AS seq, arg_min(license, event_id) AS license FROM r GROUP BY 1, 2, 3)
SELECT name, version, arg_min(license, seq) AS license, string_agg(place, ', ' ORDER BY seq) AS places FROM e GROUP BY 1, 2""")
def a8_group_packages(spark, d):
    n = F.col("event_id")
    text_ = lambda mark, x: F.concat(F.lit(mark), x.cast("string"))
    rows = A.table(spark, d, "events").select(n.alias("seq"), F.col("event_type").alias("name"), (F.col("user_id") % 7).cast("string").alias("version"), text_("L", n % 4).alias("license"), text_("p", n % 50).alias("place"))
    return text.group_packages(rows)


_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


@query(f"SELECT sha256(trim(text, {_SPACES})) AS sha256, count(*) AS copies, min(doc_id) AS first_owner FROM documents GROUP BY 1")
def a9_content_groups(spark, d):
    return text.group_by_content(A.table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH t AS (SELECT doc_id, sha256(trim(text, {_SPACES})) AS sha256 FROM documents) SELECT min(doc_id) OVER w AS first_owner, doc_id AS owner, sha256, count(*) OVER w AS copies FROM t WINDOW w AS (PARTITION BY sha256)")
def a9_content_owners(spark, d):
    return text.content_owners(A.table(spark, d, "documents"), "doc_id", "text")


_PHRASES = {"license": "General Public License", "cc": "CC BY-NC", "token": "token = ", "none": "no such phrase at all"}


@query("SELECT name, coalesce((SELECT min(doc_id) FROM documents WHERE contains(text, phrase))::VARCHAR, '?') AS example FROM (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in _PHRASES.items()) + ") t(name, phrase)")
def a10_phrase_examples(spark, d):
    return text.first_with_phrase(A.table(spark, d, "documents"), _PHRASES, "doc_id", "text")


@query("SELECT doc_id::VARCHAR AS path, doc_id % 9 <> 0 AND doc_id % 10 <> 0 AS ok FROM documents")
def a11_verify_digests(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    manifest = docs.select("path", F.when(F.col("doc_id") % 9 == 0, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return text.verify_digests(docs.where("doc_id % 10 <> 0"), manifest)


@query("SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'size' WHEN doc_id % 9 = 0 THEN 'digest' ELSE 'ok' END AS state FROM documents")
def s12_verify_assets(spark, d):
    n = F.col("doc_id")
    docs = A.table(spark, d, "documents").select(n, n.cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"), F.octet_length("text").cast("long").alias("length"))
    wanted = docs.select("path", (F.col("length") + F.when(n % 7 == 0, 1).otherwise(0)).alias("size"), F.when(n % 9 == 0, "0").otherwise(F.upper(F.sha2("content", 256))).alias("sha256"))
    return text.verify_assets(wanted, docs.where("doc_id % 10 <> 0").drop("doc_id"))


@query(f"WITH {A.PARTS_SQL} SELECT conv_id, count(DISTINCT label) AS speakers FROM parts GROUP BY conv_id")
def a12_distinct_labels(spark, d):
    return A.parts(spark, d).groupBy("conv_id").agg(F.count_distinct("label").alias("speakers"))


@query("SELECT label, (dim - 1)::INTEGER AS dim, round(sum(x) / count(*), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim")
def a14_centroids(spark, d):
    return speakers.centroids(A.table(spark, d, "embeddings"), ["label"], "embedding").withColumn("mean", F.round("mean", 6))


# ---- windows ---------------------------------------------------------------------------------------------------------
@query("""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tile_idx, floor(value) * floor(value) * 160 AS s FROM events)
SELECT user_id, tile_idx // 20 AS idx, round(sum(s) / 3200.0, 6) AS energy FROM t GROUP BY 1, 2 HAVING count(*) = 20""")
def w1_block_energy(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.floor("value")
    tiles = A.table(spark, d, "events").select("user_id", (F.row_number().over(order) - 1).alias("tile_idx"), F.lit(160).alias("n"), (v * v * 160).cast("double").alias("sum_sq"))
    return signal.block_energy(tiles, ["user_id"]).withColumn("energy", F.round("energy", 6))


_REGIONS_SQL = f"""WITH {A.BLOCKS_SQL}, q AS (SELECT *, greatest(1024.0::DOUBLE, 0.08::DOUBLE * median(energy) OVER (PARTITION BY recording_id)) AS thr, max(idx) OVER (PARTITION BY recording_id) AS last_block FROM blocks),
h AS (SELECT *, coalesce(max(CASE WHEN energy < thr / 8 THEN idx + 1 END) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heard FROM q),
v AS (SELECT *, CASE WHEN idx - lag(idx) OVER w <= 3 THEN 0 ELSE 1 END AS new FROM h WHERE energy >= thr WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
i AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY idx) AS island FROM v),
g AS (SELECT recording_id, island, min(idx) AS first, max(idx) AS last, arg_min(heard, idx) AS heard, max(last_block) AS last_block FROM i GROUP BY 1, 2),
e AS (SELECT *, CASE WHEN last_block - last < 3 THEN (last_block + 1) * 3200 + 1000 ELSE (last + 1) * 3200 END AS stop FROM g),
r AS (SELECT recording_id, greatest(coalesce(lag(stop) OVER (PARTITION BY recording_id ORDER BY first) // 3200, 0), least(heard, first)) * 3200 AS start, stop FROM e)
SELECT recording_id, (start + k * 960000)::BIGINT AS start, least(stop, start + (k + 1) * 960000)::BIGINT AS "end" FROM r, LATERAL (SELECT unnest(range(0, greatest(1, ceil((stop - start) / 960000.0)::BIGINT))) AS k)"""


@query(_REGIONS_SQL)
def w2_w4_speech_regions(spark, d):
    blocks = A.blocks(spark, d)
    totals = blocks.groupBy("recording_id").agg((F.count("*") * signal.BLOCK + 1000).alias("total"))
    return signal.speech_regions(blocks.join(signal.quiet_threshold(blocks, ["recording_id"]), "recording_id"), totals, ["recording_id"])


@query("""WITH v AS (SELECT user_id, event_id AS frame_idx, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value >= 5)
, u AS (SELECT user_id, n, generate_series AS k FROM (SELECT DISTINCT user_id, n FROM v), generate_series(0, 1000) WHERE generate_series = 0 OR n - generate_series * 99 >= 99)
SELECT v.user_id, k AS window, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS frames FROM v JOIN u ON v.user_id = u.user_id AND p >= k * 99 AND p < k * 99 + 198 GROUP BY 1, 2""")
def w8_embedding_windows(spark, d):
    return speakers.embedding_windows(A.table(spark, d, "events").where("value >= 5").select("user_id", F.col("event_id").alias("frame_idx")), ["user_id"])


_TILED_SQL = f"""WITH {A.SPANS_SQL}, tot AS (SELECT recording_id, sum(n) + 5000 AS total FROM spans GROUP BY 1),
tiled AS (SELECT recording_id, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE start END::BIGINT AS start, coalesce(lead(start) OVER w, total)::BIGINT AS "end", label FROM spans JOIN tot USING (recording_id) WHERE n > 0 WINDOW w AS (PARTITION BY recording_id ORDER BY start))"""


def _tiled(spark, d):
    spans = A.spans(spark, d)
    totals = spans.groupBy("recording_id").agg((F.sum("n") + 5000).alias("total"))
    return speakers.tile_spans(spans.where("n > 0"), totals, ["recording_id"])


@query(_TILED_SQL + " SELECT * FROM tiled")
def w10_tile_spans(spark, d):
    return _tiled(spark, d)


_MERGED_SQL = _TILED_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start) AS nth, max("end") OVER (PARTITION BY recording_id) AS final FROM tiled),
c AS (SELECT *, lag(label) OVER (PARTITION BY recording_id ORDER BY start) AS before FROM k WHERE nth = 1 OR "end" - start >= 16000),
merged AS (SELECT recording_id, start, coalesce(lead(start) OVER (PARTITION BY recording_id ORDER BY start), final) AS "end", label FROM c WHERE before IS NULL OR before <> label)"""


@query(_MERGED_SQL + " SELECT * FROM merged")
def w11_merge_spans(spark, d):
    return speakers.merge_spans(_tiled(spark, d), ["recording_id"])


@query(_MERGED_SQL + """, f AS (SELECT *, min(start) OVER (PARTITION BY recording_id, label) AS first FROM merged)
SELECT recording_id, start, "end", (dense_rank() OVER (PARTITION BY recording_id ORDER BY first) - 1)::INTEGER AS label FROM f""")
def w12_number_speakers(spark, d):
    return text.first_appearance(speakers.merge_spans(_tiled(spark, d), ["recording_id"]), ["recording_id"], "label", "start")


@query(f"""WITH {A.PARTS_SQL}, s AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY conv_id ORDER BY seq) IS NOT DISTINCT FROM label AND row_number() OVER (PARTITION BY conv_id ORDER BY seq) > 1 THEN 0 ELSE 1 END AS new FROM parts),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY seq) AS run0, (SELECT count(DISTINCT label) FROM parts p WHERE p.conv_id = s.conv_id) AS speakers FROM s),
g AS (SELECT conv_id, CASE WHEN speakers < 2 THEN seq ELSE run0 END AS run, any_value(speakers) AS speakers, any_value(label) AS label, string_agg(text, ' ' ORDER BY seq) AS text FROM r GROUP BY 1, 2)
SELECT conv_id, string_agg(CASE WHEN speakers < 2 THEN text ELSE '화자 ' || (label + 1) || ': ' || text END, chr(10) || chr(10) ORDER BY run) AS transcript FROM g GROUP BY conv_id""")
def w13_render(spark, d):
    return text.render(A.parts(spark, d), ["conv_id"])


@query("SELECT event_id, CASE WHEN expected - event_id - 160 > 1600 THEN expected - event_id - 160 ELSE 0 END AS padding FROM (SELECT event_id, event_id + (value * 40)::BIGINT AS expected FROM events)")
def w14_padding(spark, d):
    rows = A.table(spark, d, "events").select("event_id", F.col("event_id").alias("produced"), F.lit(160).cast("long").alias("n"), (F.col("event_id") + F.rint(F.col("value") * 40).cast("long")).alias("expected"))
    return signal.padding(rows).select("event_id", "padding")


@query("""WITH RECURSIVE c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id % 5 * 400 AS n, (sum(floor(value)::BIGINT * 20) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS expected FROM events),
f AS (SELECT user_id, event_id, i, n, 0::BIGINT AS start, CASE WHEN expected - n > 1600 THEN expected - n ELSE 0 END AS padding FROM c WHERE i = 1
 UNION ALL SELECT c.user_id, c.event_id, c.i, c.n, f.start + f.n + f.padding, CASE WHEN c.expected - (f.start + f.n + f.padding) - c.n > 1600 THEN c.expected - (f.start + f.n + f.padding) - c.n ELSE 0 END FROM f JOIN c ON c.user_id = f.user_id AND c.i = f.i + 1)
SELECT user_id, event_id, start, padding, (n + padding)::INTEGER AS size, (n * (event_id % 100))::BIGINT AS total FROM f""")
def w14_pad_chunks(spark, d):
    """Every user's events as chunks of a stream that should have come as far as the sum of their values says."""
    n, order = F.col("event_id") % 5 * 400, Window.partitionBy("user_id").orderBy("event_id")
    rows = A.table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.sum(F.floor("value") * 20).over(order).alias("expected"), F.array_repeat((F.col("event_id") % 100).cast("smallint"), n.cast("int")).alias("samples"))
    out = signal.pad_chunks(rows, "user_id")
    return out.select("user_id", F.col("seq").alias("event_id"), F.col("offset").alias("start"), "padding", F.size("samples").alias("size"), F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT user_id, event_id, pct FROM (SELECT *, lag(pct) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM (SELECT user_id, event_id, event_id * 100 // 20000 AS pct FROM events)) WHERE b IS DISTINCT FROM pct")
def w15_progress(spark, d):
    rows = A.table(spark, d, "events").select("user_id", "event_id", F.floor(F.col("event_id") * 100 / 20000).alias("pct"))
    return text.changed(rows, ["user_id"], "event_id", "pct")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def w16_latest(spark, d):
    rows = A.table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return text.latest(rows, ["user_id"], "event_id")


# ---- orders ----------------------------------------------------------------------------------------------------------
_POSITION_SQL = f"WITH {A.NOTES_SQL} SELECT n.id, n.source, row_number() OVER (PARTITION BY n.source, n.starred ORDER BY :order NULLS LAST, n.created DESC, n.id DESC) AS position FROM notes n LEFT JOIN folders f ON f.id = n.folder_id WHERE n.trashed IS NULL"


def _positions(key: str, descending: bool) -> Query:
    """Each note's place in the order, among those of its source and star, so that no order is of everything in one task."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        listed = library.list_notes(*_lib(spark, d))
        order = Window.partitionBy("source", "starred").orderBy(*library.sort_columns(key, descending))
        return listed.select("id", "source", F.row_number().over(order).alias("position"))

    return run


for _name, _key, _down, _sql in (
    ("o2_sort_duration", "duration", False, "duration ASC"), ("o2_sort_title", "title", False, "n.title COLLATE ko ASC"), ("o2_sort_title_down", "title", True, "n.title COLLATE ko DESC"),
    ("o2_sort_folder", "folder", False, "f.name COLLATE ko ASC"), ("o2_sort_folder_down", "folder", True, "f.name COLLATE ko DESC"), ("o1_newest_first", "created", True, "created DESC"),
):
    QUERIES[_name], ORACLES[_name] = _positions(_key, _down), _POSITION_SQL.replace(":order", _sql)


@query(f"WITH {A.BLOCKS_SQL} SELECT recording_id, arg_min(idx, (energy, idx)) AS quietest, max(CASE WHEN energy < 1024 THEN idx END) AS last_quiet FROM blocks GROUP BY 1")
def o5_quiet_places(spark, d):
    return A.blocks(spark, d).groupBy("recording_id").agg(F.min(F.struct("energy", "idx"))["idx"].alias("quietest"), F.max(F.when(F.col("energy") < 1024, F.col("idx"))).alias("last_quiet"))


# ---- scalar functions ------------------------------------------------------------------------------------------------
@query("""SELECT doc_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration,
 strftime(make_timestamp((1700000000 + doc_id * 60) * 1000000), '%Y.%m.%d %H:%M') AS date, printf('%d:%02d', n_chars // 600, n_chars // 10 % 60) AS clock,
 CASE WHEN n_chars >= 1024 THEN printf('%.1f GB', round(n_chars / 1024.0::DOUBLE, 1)) ELSE n_chars || ' MB' END AS size FROM (SELECT *, floor(n_chars / 10.0::DOUBLE + 0.5)::BIGINT AS s FROM documents)""")
def x5_x8_formats(spark, d):
    seconds = F.col("n_chars") / 10.0
    return A.table(spark, d, "documents").select("doc_id", X.format_duration(seconds).alias("duration"), X.format_date(F.lit(1700000000) + F.col("doc_id") * 60).alias("date"), X.live_clock(seconds).alias("clock"), X.format_mib(F.col("n_chars")).alias("size"))


@query("""SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) / 3)::INTEGER AS found, CASE WHEN instr(substr(text, 50), 'the') > 0 THEN instr(substr(text, 50), 'the') + 49 ELSE instr(text, 'the') END::INTEGER AS next,
 sha256(replace(text, 'the', 'THE')) AS replaced, CASE WHEN substr(text, 5, 3) = 'the' THEN substr(text, 1, 4) || '<>' || substr(text, 8) ELSE text END AS one FROM documents""")
def x9_x12_find_replace(spark, d):
    t, n = F.col("text"), F.lit("the")
    return A.table(spark, d, "documents").select("doc_id", X.count_occurrences(t, n).alias("found"), X.find_next(t, n, F.lit(50)).cast("int").alias("next"), F.sha2(X.replace_all(t, n, F.lit("THE")), 256).alias("replaced"), X.replace_one(t, n, F.lit("<>"), F.lit(5)).alias("one"))


@query("""SELECT page_id, string_split(path, '/')[-1] AS base, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem, '.wav' AS ext, '1700000000-' || string_split(path, '/')[-1] AS audio FROM (SELECT page_id, split_part(url, '?', 1) || '.take.WAV' AS path FROM pages)""")
def x13_x15_names(spark, d):
    path = F.concat(F.split_part("url", F.lit("?"), F.lit(1)), F.lit(".take.WAV"))
    return A.table(spark, d, "pages").select("page_id", X.basename(path).alias("base"), X.file_stem(path).alias("stem"), X.extension(path).alias("ext"), X.audio_name(F.lit(1.7e9), path).alias("audio"))


@query(f"SELECT doc_id, coalesce(nullif(trim(t, {_SPACES}), ''), '제목 없음') AS title FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr(160) || ' ' ELSE chr(8232) || substr(text, 1, 20) || ' ' END AS t FROM documents)")
def x14_titles(spark, d):
    title = F.when(F.col("doc_id") % 3 == 0, "\u00a0 ").otherwise(F.concat(F.lit("\u2028"), F.substring("text", 1, 20), F.lit(" ")))
    return A.table(spark, d, "documents").select("doc_id", X.title_or_default(title).alias("title"))


@query("SELECT event_id, round(value / 32768.0::DOUBLE, 12) AS scaled, floor((event_id - 5001) / 2.0)::INTEGER AS average, round(event_id * 100.0::DOUBLE / 10000, 6) AS percent, event_id / 16000.0::DOUBLE AS seconds FROM events")
def x17_x19_arithmetic(spark, d):
    n = F.col("event_id")
    return A.table(spark, d, "events").select("event_id", F.round(F.col("value") / 32768.0, 12).alias("scaled"), F.shiftright((n - 5001).cast("int"), 1).alias("average"), F.round(n * 100.0 / 10000, 6).alias("percent"), (n / 16000.0).alias("seconds"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings")
def x20_normalise(spark, d):
    return A.table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.round(F.get(V.normalise(F.col("embedding")), F.lit(0)), 5).alias("first"))


@query("""WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_id % 10))) AS chosen FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(CASE WHEN list_contains(chosen, 4) THEN list_filter(chosen, lambda x: x <> 4) ELSE list_append(chosen, 4) END), ',') AS one,
 array_to_string(list_sort(CASE WHEN list_has_all(chosen, [1, 2, 3]) THEN list_filter(chosen, lambda x: NOT list_contains([1, 2, 3], x)) ELSE list_distinct(list_concat(chosen, [1, 2, 3])) END), ',') AS every FROM s""")
def x24_toggles(spark, d):
    chosen = A.table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.col("event_id") % 10).alias("c"))
    one, everything = F.lit(4).cast("long"), F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))
    text_ = lambda c: F.array_join(F.array_sort(c).cast("array<string>"), ",")
    return chosen.select("user_id", text_(X.toggle(F.col("c"), one)).alias("one"), text_(X.toggle_all(F.col("c"), everything)).alias("every"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_type IN ('view', 'click') THEN event_type ELSE 'view' END AS device FROM events")
def x25_pick_device(spark, d):
    available = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("view"), F.lit("click")))
    return A.table(spark, d, "events").select("event_id", X.pick_device(F.col("event_type"), available).alias("device"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 4 = 1 THEN '{user} ' || event_type || ' {x} {kind}' WHEN event_id % 4 > 1 THEN event_type END, '') || ' of ' || user_id || ', {} {a b} ' || coalesce(CASE WHEN event_id % 4 = 1 THEN '{user} ' || event_type || ' {x} {kind}' WHEN event_id % 4 > 1 THEN event_type END, '') AS message FROM events")
def x16_template(spark, d):
    """Some values hold places of the template themselves, and one is null."""
    braces = F.concat(F.lit("{user} "), F.col("event_type"), F.lit(" {x} {kind}"))
    kind = F.when(F.col("event_id") % 4 == 1, braces).when(F.col("event_id") % 4 > 1, F.col("event_type"))
    return A.table(spark, d, "events").select("event_id", X.fill_template(F.lit("{kind} of {user}, {}{gone} {a b} {kind}"), {"kind": kind, "user": F.col("user_id")}).alias("message"))


@query(f"""WITH t AS (SELECT source AS owner, trim(CASE doc_id % 3 WHEN 0 THEN text ELSE chr(10) || text || chr(9) || chr(160) || chr(10) END, {_SPACES}) AS text FROM documents)
SELECT min(owner) AS first_owner, sha256('### ' || array_to_string(list_sort(list_distinct(list(owner))), ', ') || chr(10) || chr(10) || '```' || chr(10) || text || chr(10) || '```') AS block FROM t GROUP BY text""")
def k6_notice_blocks(spark, d):
    """Texts as licences of their sources, two thirds of them between line ends and other white space."""
    text_ = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("\n"), "text", F.lit("\t\u00a0\n")))
    blocks = sinks.notice_blocks(A.table(spark, d, "documents").select(F.col("source").alias("owner"), text_.alias("text")))
    return blocks.select("first_owner", F.sha2("value", 256).alias("block"))


@query("""SELECT page_id, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS source, CASE WHEN page_id::BIGINT % 3 = 0 THEN 'a b' END AS q FROM pages""")
def x23_parse_query(spark, d):
    url = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("q="), F.when(F.col("page_id").cast("long") % 3 == 0, "a+b&q=second").otherwise(""))
    return A.table(spark, d, "pages").select("page_id", X.parse_query(url, "utm_source").alias("source"), X.parse_query(url, "q").alias("q"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, event_type AS name, event_id % 2 = 0 AS speakers FROM events")
def x23_parse_body(spark, d):
    body = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "name": "'), F.col("event_type"), F.lit('", "speakers": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit("}"))
    return A.table(spark, d, "events").select("event_id", X.parse_body(body, "k long, name string, speakers boolean").alias("b")).select("event_id", "b.*")


@query(f"""WITH {A.BLOCKS_SQL}, t AS (SELECT recording_id, greatest(1024.0::DOUBLE, 0.08::DOUBLE * median(energy)) AS threshold FROM blocks GROUP BY 1) SELECT recording_id, idx AS frame_idx FROM blocks JOIN t USING (recording_id) WHERE sqrt(energy) >= sqrt(threshold)""")
def f16_voiced_frames(spark, d):
    blocks = A.blocks(spark, d)
    frames = blocks.select("recording_id", F.col("idx").alias("frame_idx"), F.sqrt("energy").alias("rms")).join(signal.quiet_threshold(blocks, ["recording_id"]), "recording_id")
    return signal.voiced(frames).select("recording_id", "frame_idx")


_CUT_SQL = f"""WITH {A.BLOCKS_SQL}, b AS (SELECT *, greatest(1024.0::DOUBLE, 0.08::DOUBLE * median(energy) OVER (PARTITION BY recording_id)) AS thr, count(*) OVER (PARTITION BY recording_id) AS n FROM blocks)
SELECT recording_id, CASE WHEN any_value(n) >= 30 THEN coalesce(max(CASE WHEN idx >= 30 AND energy < thr THEN idx END), CASE WHEN any_value(n) >= 100 THEN arg_min(idx, (energy, idx)) FILTER (WHERE idx >= 30) END) * 3200 + 1600 END::BIGINT AS cut FROM b GROUP BY 1"""


@query(_CUT_SQL)
def w6_split_point(spark, d):
    """Where each recording would be cut if all its blocks were a live buffer."""
    held = A.blocks(spark, d).groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "energy"))), lambda x: x["energy"]).alias("energies"))
    return held.select("recording_id", signal.live_cut(F.col("energies")).alias("cut"))


@query(f"""WITH RECURSIVE {A.BLOCKS_SQL}, r AS (SELECT recording_id, list(energy ORDER BY idx) AS e, count(*) * 3200 AS total FROM blocks GROUP BY 1),
spans AS (SELECT recording_id, e, total, unnest(range((total + 959999) // 960000)) AS label FROM r),
starts AS (SELECT recording_id, label, e, least((label + 1) * 960000, total) AS stop, (label * 960000)::BIGINT AS a FROM spans
 UNION ALL SELECT recording_id, label, e, stop, a + 192000 + 1600 + 3200 * coalesce(list_max(list_filter(range(40), lambda k: w[k + 1] < greatest(1024.0::DOUBLE, 0.08::DOUBLE * list_aggregate(w, 'median')))), list_position(w, list_min(w)) - 1)::BIGINT
  FROM (SELECT *, list_transform(range(40), lambda k: CASE WHEN a % 3200 = 0 THEN e[(a + 192000) // 3200 + k + 1] ELSE (e[(a + 192000) // 3200 + k + 1] + e[(a + 192000) // 3200 + k + 2]) / 2 END) AS w FROM starts WHERE a + 320000 < stop))
SELECT recording_id, label::INTEGER AS label, a AS start, coalesce(lead(a) OVER (PARTITION BY recording_id, label ORDER BY a), stop)::BIGINT AS "end" FROM starts""")
def w5_chunks(spark, d):
    """Each block of a recording as twenty tiles, cut within spans of a minute."""
    blocks = A.blocks(spark, d)
    tiles = blocks.select("recording_id", F.explode(F.sequence(F.col("idx") * 20, F.col("idx") * 20 + 19)).alias("tile_idx"), (F.col("energy") * 160).alias("sum_sq"))
    totals = blocks.groupBy("recording_id").agg((F.count("*") * signal.BLOCK).alias("end")).withColumn("start", F.lit(0).cast("long"))
    spans = signal.split_long(totals, ["recording_id"]).withColumn("label", (F.col("start") / signal.MAX_REGION).cast("int"))
    return signal.chunks(tiles, spans, "recording_id")


# ---- mutations and jobs ----------------------------------------------------------------------------------------------
_FIELDS_SQL = """ev AS (SELECT event_id AS seq, user_id AS note_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS first FROM events),
ops AS (SELECT *, CASE WHEN first OR seq % 11 = 0 THEN 'create' WHEN seq % 13 = 0 THEN 'delete' ELSE 'update' END AS op FROM ev),
hist AS (SELECT *, op = 'create' OR (op = 'update' AND kind = 'click') AS has_title, op = 'create' OR (op = 'update' AND kind IN ('view', 'signup')) AS has_folder, op = 'update' AND kind = 'purchase' AS has_star, op = 'update' AND kind = 'error' AND seq % 5 <> 0 AS has_trash FROM ops),
lives AS (SELECT note_id, max(CASE WHEN op = 'create' THEN seq END) AS born, max(CASE WHEN op = 'delete' THEN seq END) AS gone FROM hist GROUP BY 1),
alive AS (SELECT h.* FROM hist h JOIN lives l USING (note_id) WHERE born IS NOT NULL AND (gone IS NULL OR born > gone) AND seq >= born AND op <> 'delete'),
fold AS (SELECT note_id, min(seq) AS created, max(CASE WHEN op = 'create' OR kind <> 'error' OR has_trash THEN seq END) AS updated, max(CASE WHEN has_trash THEN seq END) AS trash_at, 't' || max(CASE WHEN has_title THEN seq END) AS title,
  max(CASE WHEN has_folder THEN seq END) AS filed_at, arg_max(CASE WHEN op = 'create' OR kind = 'view' THEN seq % 5 END::BIGINT, CASE WHEN has_folder THEN seq END) FILTER (WHERE has_folder AND NOT (op = 'update' AND kind = 'signup')) AS f0,
  max(CASE WHEN has_folder AND op = 'update' AND kind = 'signup' THEN seq END) AS nulled_at, arg_max(seq % 2 = 0, seq) FILTER (WHERE has_star) AS starred FROM alive GROUP BY 1),
gone AS (SELECT (seq // 200) % 5 AS folder_id, max(seq) AS deleted_at FROM ev WHERE seq % 200 = 0 AND seq >= 5 GROUP BY 1)"""


@query(f"""WITH {_FIELDS_SQL}, f AS (SELECT *, CASE WHEN nulled_at = filed_at THEN NULL ELSE f0 END AS folder FROM fold)
SELECT note_id AS id, title, created::DOUBLE AS created, updated::DOUBLE AS updated, CASE WHEN deleted_at IS NULL OR deleted_at < filed_at THEN folder END AS folder_id, coalesce(starred, false) AS starred, CASE WHEN trash_at % 2 = 0 THEN trash_at::DOUBLE END AS trashed FROM f LEFT JOIN gone ON gone.folder_id = f.folder""")
def m1_m7_current_notes(spark, d):
    return mutations.current_notes(A.note_events(spark, d), A.folder_events(spark, d)).select("id", "title", "created", "updated", "folder_id", "starred", "trashed")


@query("""SELECT id, arg_max(name, seq) AS name FROM (SELECT event_id AS seq, 'f' || event_id AS name, CASE WHEN event_id < 5 THEN event_id % 5 ELSE (event_id // 200) % 5 END::BIGINT AS id, event_id % 200 = 0 AND event_id >= 5 AS gone FROM events WHERE event_id % 200 IN (0, 1) OR event_id < 5) GROUP BY id HAVING NOT arg_max(gone, seq)""")
def m6_current_folders(spark, d):
    return mutations.current_folders(A.folder_events(spark, d))


@query(f"""WITH {A.JOB_EVENTS_SQL}, f AS (SELECT job_id, coalesce(max(CASE WHEN kind = 'phase' AND value = 'finishing' THEN seq END), -2) AS fin, coalesce(max(seq) FILTER (WHERE kind = 'phase'), -2) AS phase_at, arg_max(value, seq) FILTER (WHERE kind = 'phase') AS phase,
  coalesce(max(seq) FILTER (WHERE kind IN ('file', 'ready')), -1) AS forced_at, arg_max(kind, seq) FILTER (WHERE kind IN ('file', 'ready')) AS forced, arg_max(CASE WHEN kind = 'file' THEN value || ' 내려받는 중' ELSE value END, seq) FILTER (WHERE kind IN ('stage', 'file')) AS stage,
  arg_max(value, seq) FILTER (WHERE kind = 'file') AS file, string_agg(value, ',' ORDER BY seq) FILTER (WHERE kind = 'ready') AS ready,
  arg_max(value, seq) FILTER (WHERE kind = 'progress')::DOUBLE AS percent, arg_max(value, seq) FILTER (WHERE kind IN ('text', 'preview', 'done')) AS text, arg_max(value, seq) FILTER (WHERE kind = 'text') AS saved,
  arg_max(kind, seq) FILTER (WHERE kind IN ('done', 'error', 'cancelled')) AS ek, arg_max(value, seq) FILTER (WHERE kind IN ('done', 'error', 'cancelled')) AS ev FROM job_events GROUP BY 1)
SELECT job_id, CASE WHEN ek IS NULL THEN 'running' WHEN ek = 'done' THEN 'done' ELSE 'error' END AS state, CASE WHEN fin > forced_at THEN 'finishing' WHEN phase_at > forced_at THEN phase WHEN forced = 'file' THEN 'downloading' WHEN forced = 'ready' THEN 'checking' ELSE 'loading' END AS phase,
  coalesce(stage, '준비 중') AS stage, CASE WHEN ek = 'done' THEN 100.0::DOUBLE ELSE coalesce(percent, 0.0::DOUBLE) END AS percent, coalesce(text, '') AS text, coalesce(saved, '') AS saved, coalesce(file, '') AS file, coalesce(ready, '') AS ready,
  CASE WHEN ek IN ('error', 'cancelled') THEN ev END AS error, CASE ek WHEN 'cancelled' THEN 'cancelled' WHEN 'error' THEN 'failed' END AS code FROM f""")
def st6_st7_job_fold(spark, d):
    return jobs.fold(A.job_events(spark, d)).select("job_id", "state", "phase", "stage", "percent", "text", "saved", "file", "ready", "error", "code")


@query(f"""WITH {A.JOB_EVENTS_SQL}, c AS (SELECT job_id, min(CASE WHEN kind = 'phase' AND value = 'recording' THEN ts END) AS since, min(CASE WHEN kind IN ('done', 'error', 'cancelled') OR kind = 'phase' AND value = 'finishing' THEN ts END) AS until FROM job_events GROUP BY 1)
SELECT job_id, coalesce(greatest(0.0::DOUBLE, coalesce(until, 1.8e9::DOUBLE) - since), 0.0::DOUBLE) AS recorded_seconds FROM c""")
def st8_clock(spark, d):
    return jobs.clock(A.job_events(spark, d), 1.8e9)


@query(f"""WITH {A.JOB_EVENTS_SQL}, f AS (SELECT job_id, arg_max(value, seq) FILTER (WHERE kind = 'text') AS transcript, arg_max(kind, seq) FILTER (WHERE kind IN ('done', 'error', 'cancelled')) AS ek FROM job_events GROUP BY 1)
SELECT job_id, transcript FROM f WHERE ek IN ('error', 'cancelled') AND transcript IS NOT NULL""")
def m9_salvage(spark, d):
    return jobs.salvage(jobs.fold(A.job_events(spark, d)))


@query(f"""WITH {A.BLOCKS_SQL}, v AS (SELECT recording_id, idx, CASE WHEN idx - lag(idx) OVER (PARTITION BY recording_id ORDER BY idx) <= 3 THEN 0 ELSE 1 END AS new FROM blocks WHERE energy >= 1024),
g AS (SELECT recording_id, idx, sum(new) OVER (PARTITION BY recording_id ORDER BY idx) AS s FROM v)
SELECT recording_id, min(idx) AS first, max(idx) AS last, count(*) AS voiced FROM g GROUP BY recording_id, s""")
def st3_pause_sessions(spark, d):
    from scribelake.streaming.live import pause_sessions

    voiced = A.blocks(spark, d).where("energy >= 1024")
    rows = pause_sessions(voiced.withColumn("ts", F.timestamp_millis(F.col("idx") * 200)), ["recording_id"])
    return rows.select("recording_id", (F.unix_millis("start") / 200).cast("long").alias("first"), (F.unix_millis("last") / 200).cast("long").alias("last"), "voiced")


# ---- without SQL: sequential rules and patterns with back-references ---------------------------------------------------
@query()
def x4_collapse_repeats(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.sha2(X.collapse_repeats(F.col("text")), 256).alias("collapsed"))


@query()
def u5_cluster(spark, d):
    """All vectors: each twenty that follow one another, by id, are one recording's turns. A recording has a bounded number of
    turns, so its group's size is part of this query's mapping, not a cut."""
    rows = A.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("recording"), F.col("vec_id").alias("id"), V.normalise(F.col("embedding")).alias("v"))
    return cluster_turns(rows, "recording").select("recording", F.col("id").alias("vec_id"), F.col("label").cast("long").alias("speaker"))


class _Spelling:
    """A step model without learning: the nth token it wants is the nth sample modulo the vocabulary, then the end; of those
    that may not come, the next one that may."""

    prompt, end, limit, vocabulary = (46, 47, 48, 49), 45, 40, 50
    suppressed, suppressed_first = (3, 7, 11, 12), (0, 1, 2, 45)

    def start(self, sounds, lengths):
        return {"sounds": sounds, "lengths": lengths}

    def step(self, state, tokens, position):
        import numpy as np

        nth = position - len(self.prompt) + 1
        wanted = np.rint(state["sounds"][:, nth] * 32768).astype(int) % self.vocabulary if 0 <= nth < state["sounds"].shape[1] else np.full(len(tokens), self.end)
        wanted = np.where(state["lengths"] > nth, wanted, self.end)
        return -((np.arange(self.vocabulary)[None, :] - wanted[:, None]) % self.vocabulary).astype(np.float32)

    def keep(self, state, rows):
        return {k: v[rows] for k, v in state.items()}

    def text(self, tokens):
        return " ".join(f"t{t}" for t in tokens)


@query(f"""WITH {A.BLOCKS_SQL}, sounds AS (SELECT recording_id, idx // 48 AS piece, idx % 48 AS nth, floor(sqrt(energy))::BIGINT % 20000 AS x FROM blocks WHERE idx % 48 <> 47 OR idx // 48 % 2 = 0),
lengths AS (SELECT recording_id, piece, count(*) AS n FROM sounds GROUP BY 1, 2),
wanted AS (SELECT recording_id, piece, nth, x % 50 AS w FROM sounds WHERE nth < 36 UNION ALL SELECT recording_id, piece, n, 45 FROM lengths WHERE n < 36),
vocabulary AS (SELECT t FROM (SELECT unnest(range(46)) AS t) WHERE t NOT IN (3, 7, 11, 12)),
best AS (SELECT recording_id, piece, nth, arg_min(t, (t - w + 50) % 50) AS token FROM wanted, vocabulary WHERE nth > 0 OR t NOT IN (0, 1, 2, 45) GROUP BY recording_id, piece, nth),
ends AS (SELECT recording_id, piece, min(nth) AS e FROM best WHERE token = 45 GROUP BY 1, 2),
made AS (SELECT l.recording_id, l.piece, coalesce(e, 36) AS tokens, e IS NULL AS truncated FROM lengths l LEFT JOIN ends USING (recording_id, piece)),
texts AS (SELECT recording_id, piece, m.tokens, truncated, coalesce(string_agg('t' || token, ' ' ORDER BY nth) FILTER (WHERE nth < m.tokens), '') AS text FROM made m JOIN best USING (recording_id, piece) GROUP BY ALL),
counts AS (SELECT recording_id, piece, m.tokens, p * 4 AS upto FROM made m, (SELECT unnest(range(1, 10)) AS p) WHERE p * 4 <= m.tokens),
early AS (SELECT c.recording_id, c.piece, upto, string_agg('t' || token, ' ' ORDER BY nth) FILTER (WHERE nth < upto) AS text FROM counts c JOIN best USING (recording_id, piece) GROUP BY ALL)
SELECT recording_id, piece, 'text' AS kind, tokens::INTEGER AS tokens, text, truncated FROM texts UNION ALL SELECT recording_id, piece, 'preview', upto::INTEGER, text, FALSE FROM early""")
def u1_greedy_decode(spark, d):
    """All recordings, 47 or 48 blocks a sound, decoded by a model that needs no learning: suppressed tokens, ends, the limit and
    previews as for any."""
    rows = A.blocks(spark, d).where("idx % 48 <> 47 or floor(idx / 48) % 2 = 0").select("recording_id", F.floor(F.col("idx") / 48).alias("piece"), F.struct("idx", (F.floor(F.sqrt("energy")) % 20000).cast("smallint").alias("x")).alias("s"))
    sounds = rows.groupBy("recording_id", "piece").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]).alias("samples"))
    return decode_sounds(sounds, _Spelling, ["recording_id", "piece"])


@query("""WITH v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, floor(value)::BIGINT AS x, count(*) OVER (PARTITION BY user_id) * 200 AS total FROM events),
frames AS (SELECT user_id, unnest(range((total - 400) // 160 + 1)) AS f FROM (SELECT DISTINCT user_id, total FROM v) WHERE total >= 400),
met AS (SELECT user_id, f, unnest(range(160 * f // 200, (160 * f + 399) // 200 + 1)) AS i FROM frames)
SELECT user_id, f AS frame_idx, round(sqrt(sum((least(200 * i + 200, 160 * f + 400) - greatest(200 * i, 160 * f)) * x * x) / 400.0::DOUBLE)::FLOAT::DOUBLE, 2) AS rms FROM met JOIN v USING (user_id, i) GROUP BY user_id, f""")
def x21_frame_loudness(spark, d):
    """Every user's events as runs of 200 samples of one height: how loud each frame of the whole is, by ``frame_features``."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    runs = A.table(spark, d, "events").select("user_id", (place * 200).cast("long").alias("offset"), F.array_repeat(F.floor("value").cast("smallint"), 200).alias("samples"))
    return speakers.frame_features(runs, "user_id").select("user_id", "frame_idx", F.round(F.col("rms").cast("double"), 2).alias("rms"))


@query("""WITH v AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 200 AS o, floor(value)::BIGINT AS x FROM events)
SELECT user_id, greatest(o, 1050) AS "offset", (least(o + 200, 3333) - greatest(o, 1050))::INTEGER AS size, x * (least(o + 200, 3333) - greatest(o, 1050))::BIGINT AS total FROM v WHERE o < 3333 AND o + 200 > 1050""")
def s6_pcm_slice(spark, d):
    """Samples 1,050 to 3,333 of every user's recording, from runs of 200."""
    from scribelake.sources.audio import samples_between

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    runs = A.table(spark, d, "events").select("user_id", (place * 200).cast("long").alias("offset"), F.array_repeat(F.floor("value").cast("smallint"), 200).alias("samples"))
    rows = samples_between(runs, 1050, 3333)
    return rows.select("user_id", "offset", F.size("samples").alias("size"), F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
