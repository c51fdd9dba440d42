"""All queries by name over the adapted test tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger import schemas, storage
from roadledger.config import Config
from roadledger.functions import geometry, names, plates, speed
from roadledger.operators import confirm, detections, ledger
from roadledger.plans import video
from roadledger.sources import dims, files, fixtures
from roadledger.sources import ledger as ledger_table
from roadledger.streaming import frames as frame_program

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CALIBRATED = Config(pixels_per_metre=20.0)
#: The columns of detections that the plans of videos read.
VIDEO = ("video_id", "frame_idx", "det_id", "label", *geometry.SIDES, "ocr_texts")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL over the adapted tables."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = f"WITH {fixtures.ctes()}{', ' if sql.lstrip().upper().startswith('WITH ') else ' '}{sql.lstrip()[5:] if sql.lstrip().upper().startswith('WITH ') else sql}"
        return fn

    return register


def _values(rows: list[tuple[str, str]], name: str, *columns: str) -> str:
    body = ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


_AMOUNT = "CAST(CASE violation WHEN 'no_helmet' THEN 500 WHEN 'triple_riding' THEN 1000 WHEN 'overspeed' THEN 700 ELSE 300 END AS BIGINT)"
_DUE = "CAST(coalesce(sum(amount) FILTER (WHERE status = 'unpaid'), 0) AS BIGINT)"
_IOU_PARTS = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_IOU = f"CASE WHEN {_IOU_PARTS} = 0 THEN 0.0e0 ELSE CAST({_IOU_PARTS} AS DOUBLE) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_IOU_PARTS}) END"
_CLASS = "CASE WHEN label IN ('Plate', 'WithoutHelmet', 'TripleRiding') THEN label ELSE 'WithHelmet' END"
_TEXT = "CASE WHEN len(ocr_texts) > 0 THEN upper(regexp_replace(array_to_string(ocr_texts, ''), '[^A-Za-z0-9]', '', 'g')) END"
_FREE = f"free AS (SELECT a.* FROM detections a WHERE a.label = 'WithoutHelmet' AND NOT EXISTS (SELECT 1 FROM detections b WHERE {_CLASS.replace('label', 'b.label')} = 'WithHelmet' AND a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND {_IOU} > 0.1e0))"
_NEAR = """near AS (SELECT video_id, frame_idx, det_id, label, near_id, near_lane, distance FROM (SELECT v.video_id, v.frame_idx, v.det_id, v.label, p.det_id AS near_id, p.lane AS near_lane,
 sqrt(((v.x1 + v.x2) / 2.0e0 - (p.x1 + p.x2) / 2.0e0) * ((v.x1 + v.x2) / 2.0e0 - (p.x1 + p.x2) / 2.0e0) + ((v.y1 + v.y2) / 2.0e0 - (p.y1 + p.y2) / 2.0e0) * ((v.y1 + v.y2) / 2.0e0 - (p.y1 + p.y2) / 2.0e0)) AS distance,
 row_number() OVER (PARTITION BY v.video_id, v.frame_idx, v.det_id ORDER BY sqrt(((v.x1 + v.x2) / 2.0e0 - (p.x1 + p.x2) / 2.0e0) * ((v.x1 + v.x2) / 2.0e0 - (p.x1 + p.x2) / 2.0e0) + ((v.y1 + v.y2) / 2.0e0 - (p.y1 + p.y2) / 2.0e0) * ((v.y1 + v.y2) / 2.0e0 - (p.y1 + p.y2) / 2.0e0)), p.det_id) AS k
 FROM (SELECT * FROM free UNION ALL SELECT * FROM detections WHERE label = 'TripleRiding') v JOIN detections p ON p.label = 'Plate' AND p.video_id = v.video_id AND p.frame_idx = v.frame_idx) WHERE k = 1)"""
_LANES = f"""lane_plates AS (SELECT video_id, frame_idx, lane, max(CASE WHEN plate <> '' THEN plate END) AS plate, min(x1) AS x1, min(x2) AS x2 FROM (SELECT *, {_TEXT} AS plate FROM detections WHERE label = 'Plate') GROUP BY video_id, frame_idx, lane)"""
_STREAK = """seen AS (SELECT video_id, near_lane AS track_id, CASE label WHEN 'WithoutHelmet' THEN 'no_helmet' ELSE 'triple_riding' END AS violation, frame_idx, count(*) AS seen FROM near GROUP BY ALL),
island AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, track_id, violation ORDER BY frame_idx) AS island FROM seen),
streaks AS (SELECT video_id, track_id, violation, frame_idx, CAST(seen AS BIGINT) AS seen, CAST(sum(seen) OVER (PARTITION BY video_id, track_id, violation, island ORDER BY frame_idx) AS BIGINT) AS streak FROM island)"""
_SPEED = """moved AS (SELECT video_id, frame_idx, lane, CAST(floor((x1 + x2) / 2.0e0) AS BIGINT) AS cx FROM lane_plates),
was AS (SELECT *, lag(cx) OVER w AS last_cx, lag(frame_idx) OVER w AS last_frame FROM moved WINDOW w AS (PARTITION BY video_id, lane ORDER BY frame_idx)),
speeds AS (SELECT video_id, frame_idx, lane, CASE WHEN last_frame IS NULL THEN 0 ELSE CAST(floor(abs(cx - last_cx) / 20.0e0 / ((frame_idx - last_frame) / 25.0e0) * 3.6e0) AS BIGINT) END AS speed_kmh FROM was)"""
#: With one plate a lane and frame, plates move by 52 pixels at most and lanes are 300 apart: a lane is a track until it pauses for over 10 frames.
_TRACKED = f"""plate_of AS (SELECT *, {_TEXT} AS plate FROM detections WHERE label = 'Plate' QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx, lane ORDER BY det_id) = 1),
pause AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY video_id, lane ORDER BY frame_idx) - 1 > 10 THEN 1 ELSE 0 END AS cut FROM plate_of),
part AS (SELECT *, sum(cut) OVER (PARTITION BY video_id, lane ORDER BY frame_idx) AS part FROM pause),
number AS (SELECT video_id, lane, part, CAST(row_number() OVER (PARTITION BY video_id ORDER BY min(frame_idx), arg_min(det_id, frame_idx)) - 1 AS BIGINT) AS track_id FROM part GROUP BY video_id, lane, part),
tracked AS (SELECT * FROM part JOIN number USING (video_id, lane, part))"""
_TRACK_NEAR = _NEAR.replace("p.lane AS near_lane", "p.track_id AS near_lane").replace("JOIN detections p ON p.label = 'Plate' AND", "JOIN tracked p ON").replace(", p.det_id) AS k", ", p.track_id) AS k")
_TRACK_STREAK = """seen AS (SELECT video_id, track_id, violation, frame_idx, count(*) AS seen FROM (
 SELECT video_id, near_lane AS track_id, CASE label WHEN 'WithoutHelmet' THEN 'no_helmet' ELSE 'triple_riding' END AS violation, frame_idx FROM near
 UNION ALL SELECT video_id, track_id, 'overspeed', frame_idx FROM speeds WHERE speed_kmh > 40) GROUP BY ALL)""" + _STREAK[_STREAK.index(",\nisland AS") :]
_TRACK_FINES = f"""{_TRACKED}, {_FREE}, {_TRACK_NEAR}, {_SPEED.replace("lane_plates", "tracked").replace("lane", "track_id")}, {_TRACK_STREAK},
held AS (SELECT s.*, p.plate, row_number() OVER (PARTITION BY s.video_id, s.track_id, s.violation ORDER BY s.frame_idx) AS k FROM streaks s JOIN tracked p ON p.video_id = s.video_id AND p.frame_idx = s.frame_idx AND p.track_id = s.track_id WHERE streak >= 5 AND plate <> ''),
told AS (SELECT video_id, frame_idx, track_id, violation, plate, {_AMOUNT} AS amount FROM held WHERE k = 1)"""
_DECODE = rf"""WITH {_values(dims.state_rows(), "st", "code", "state")}, {_values(dims.district_rows(), "rt", "code", "district")},
c AS (SELECT DISTINCT plate, CASE WHEN plate <> '' THEN upper(regexp_replace(plate, '[^A-Za-z0-9]', '', 'g')) END AS clean_plate, upper(regexp_replace(plate, '[^A-Za-z0-9]', '', 'g')) AS t FROM raw),
m AS (SELECT *, coalesce(regexp_matches(t, '^[0-9]{{2}}BH[0-9]{{4}}[A-Z]{{1,2}}$'), false) AS bh, coalesce(regexp_matches(t, '^[A-Z]{{2}}[0-9]{{1,2}}[A-Z]{{1,3}}[0-9]{{1,4}}$'), false) AS std,
 '^([A-Z]{{2}})([0-9]{{1,2}})([A-Z]{{1,3}})([0-9]{{1,4}})$' AS re FROM c),
d AS (SELECT m.*, CASE WHEN std THEN regexp_extract(t, re, 1) END AS sc, CASE WHEN std THEN lpad(regexp_extract(t, re, 2), 2, '0') END AS rc FROM m),
j AS (SELECT d.*, st.state AS st_name, rt.district FROM d LEFT JOIN st ON st.code = d.sc LEFT JOIN rt ON rt.code = d.sc || d.rc)
SELECT plate, bh OR st_name IS NOT NULL AS recognized, clean_plate, CASE WHEN bh THEN 'Bharat series (nationwide registration)' ELSE st_name END AS state,
 CASE WHEN bh THEN 'BH' WHEN st_name IS NOT NULL THEN sc END AS state_code, CASE WHEN st_name IS NOT NULL THEN rc END AS rto_code, CASE WHEN st_name IS NOT NULL THEN district END AS rto,
 CASE WHEN bh THEN regexp_extract(t, '^([0-9]{{2}})BH([0-9]{{4}})([A-Z]{{1,2}})$', 3) WHEN st_name IS NOT NULL THEN regexp_extract(t, re, 3) END AS series,
 CASE WHEN bh THEN regexp_extract(t, '^([0-9]{{2}})BH([0-9]{{4}})([A-Z]{{1,2}})$', 2) WHEN st_name IS NOT NULL THEN regexp_extract(t, re, 4) END AS number,
 CASE WHEN bh THEN 'Registered 20' || substr(t, 1, 2) END AS extra FROM j"""
_IMAGES = f"""img AS (SELECT *, CASE WHEN label = 'Helmet?' AND det_id % 2 = 0 THEN 'WithHelmet' ELSE label END AS lab FROM detections WHERE conf >= 0.25e0),
bare AS (SELECT DISTINCT a.video_id, a.frame_idx FROM img a WHERE a.lab = 'WithoutHelmet' AND NOT EXISTS (SELECT 1 FROM img b WHERE b.lab = 'WithHelmet' AND a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND {_IOU} > 0.1e0)),
agg AS (SELECT video_id, frame_idx, bool_or(lab = 'TripleRiding') AS triple, count(*) AS n FROM img GROUP BY ALL),
pl AS (SELECT video_id, frame_idx, max_by(ocr_texts, det_id) AS ocr_texts FROM img WHERE lab = 'Plate' GROUP BY ALL)"""
_RAW = "CASE id % 9 WHEN 0 THEN lower(plate) WHEN 1 THEN concat(' ', substr(plate, 1, 2), '-', substr(plate, 3), ' ') WHEN 2 THEN concat('22bh', substr(plate, 7, 4), 'aa') WHEN 3 THEN concat('MH', CAST(id % 10 AS STRING), 'A1') WHEN 4 THEN '***' WHEN 5 THEN concat('22BH', substr(plate, 7, 4), 'AAA') WHEN 6 THEN '' ELSE plate END"
_SEQUENCE = "id % 7"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fines(spark, sf_dir).selectExpr("id", f"{_RAW} AS plate")


def _lane_plates(dets: DataFrame) -> DataFrame:
    """One plate a lane and frame: lanes stand in for tracks where the oracle can't track."""
    text = plates.readable(plates.joined_text(F.col("ocr_texts")))
    return dets.where("label = 'Plate'").groupBy("video_id", "frame_idx", "lane").agg(F.max(text).alias("plate"), F.min("x1").alias("x1"), F.min("x2").alias("x2"))


def _near(dets: DataFrame) -> DataFrame:
    helmet = detections.video_class(F.col("label")) == "WithHelmet"
    free = detections.uncontradicted(dets.where("label = 'WithoutHelmet'"), dets.where(helmet))
    boxes = free.unionByName(dets.where("label = 'TripleRiding'")).select("video_id", "frame_idx", "det_id", "label", *geometry.SIDES)
    return detections.nearest(boxes, dets.where("label = 'Plate'"), "det_id")


def _lane_streaks(dets: DataFrame) -> DataFrame:
    plates_of = dets.where("label = 'Plate'").withColumn("track_id", F.col("lane"))
    kind = F.when(F.col("label") == "WithoutHelmet", "no_helmet").otherwise("triple_riding")
    seen = detections.attributed(dets, plates_of, "det_id", "track_id").withColumn("violation", kind)
    return confirm.streaks(seen, "track_id", "violation")


def _images(spark: SparkSession, sf_dir: str, dets: DataFrame | None = None) -> DataFrame:
    """Each frame as an image of its own. dets: the table of detections, if there is one already."""
    dets = _dets(spark, sf_dir) if dets is None else dets
    label = F.when((F.col("label") == "Helmet?") & (F.col("det_id") % 2 == 0), "WithHelmet").otherwise(F.col("label"))
    return detections.image_summary(dets.withColumn("label", label), fixtures.frames(spark, sf_dir))


def _dets(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Detections, or some of their columns, as a table of their own, as they are in production, for plans with several branches."""
    dets = fixtures.detections(spark, sf_dir)
    return storage.written(dets.select(*columns) if columns else dets, "detections")


# --- the ledger ---


@query("SELECT id, plate, violation, amount, image_path, timestamp, status FROM fines")
def fines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fines(spark, sf_dir).select(*ledger_table.COLUMNS)


@query(f"""SELECT plate, count(*) AS n_fines, {_DUE} AS total, string_agg(concat_ws(':', violation, CAST(amount AS STRING), status), '; ' ORDER BY id) AS fines FROM fines GROUP BY plate""")
def fines_by_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fines(spark, sf_dir).groupBy("plate").agg(F.count("*").alias("n_fines"), ledger.due().alias("total"), ledger.fine_list().alias("fines"))


@query("SELECT id, plate, violation, amount, status, timestamp AS time, concat('/evidence/', split_part(image_path, '/', 2)) AS image FROM fines WHERE plate = 'MH01AB0000' OR plate = (SELECT min(plate) FROM fines)")
def fines_of_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    fines = fixtures.fines(spark, sf_dir)
    first = fines.agg(F.min("plate").alias("plate")).union(spark.sql("SELECT 'MH01AB0000'")).distinct()
    return ledger.api_view(fines.join(F.broadcast(first), "plate", "left_semi"))


@query()
def fine_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested answer to one lookup, as JSON."""
    fines = fixtures.fines(spark, sf_dir)
    answer = ledger.lookup(fines, " dl02ab0001 ", dims.states(spark), dims.districts(spark))
    return answer.select("plate", F.to_json(F.struct("fines", "total", "vehicle")).alias("answer"))


@query(f"""WITH own AS (SELECT *, concat('/evidence/', split_part(image_path, '/', 2)) AS image FROM fines WHERE plate = upper(trim(' dl02ab0001 '))),
total AS (SELECT {_DUE} AS total, count(*) AS n_fines FROM own)
SELECT 'DL02AB0001' AS plate, total, n_fines, true AS recognized, 'Delhi' AS state, '02' AS rto_code, 'AB' AS series, '0001' AS number, violation, amount, status, timestamp AS time, image FROM total LEFT JOIN own ON true""")
def fine_lookup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to one lookup with a row for each fine, and one row if there is none."""
    answer = ledger.lookup(fixtures.fines(spark, sf_dir), " dl02ab0001 ", dims.states(spark), dims.districts(spark))
    vehicle = [F.col(f"vehicle.{c}") for c in ("recognized", "state", "rto_code", "series", "number")]
    rows = answer.select("plate", "total", F.size("fines").cast("bigint").alias("n_fines"), *vehicle, F.explode_outer("fines").alias("fine"))
    return rows.select("*", "fine.*").drop("fine")


@query(f"SELECT id, violation, {_AMOUNT} AS amount FROM fines")
def fine_amount_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.with_amount(fixtures.fines(spark, sf_dir).select("id", "violation"), dims.amounts(spark)).select("id", "violation", "amount")


@query(f"SELECT plate, {_DUE} AS total, count(*) AS n_fines FROM fines GROUP BY plate")
def unpaid_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.totals(fixtures.fines(spark, sf_dir))


@query("SELECT id, plate, amount FROM fines WHERE status = 'unpaid'")
def unpaid_fines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fines(spark, sf_dir).where(ledger.unpaid(F.col("status"))).select("id", "plate", "amount")


@query(f"""SELECT plate, string_agg(replace(violation, '_', ' ') || ' ₹' || amount || ' (' || status || ')', ', ' ORDER BY id) AS lines, CASE WHEN {_DUE} > 0 THEN '₹' || {_DUE} || ' due' ELSE 'all paid' END AS due FROM fines GROUP BY plate""")
def fine_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.report(fixtures.fines(spark, sf_dir))


@query(_DECODE.replace("FROM raw)", f"FROM (SELECT {_RAW} AS plate FROM fines))"))
def decode_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plates.decode(_raw(spark, sf_dir).select("plate").distinct(), dims.states(spark), dims.districts(spark))


@query(f"SELECT id, upper(regexp_replace(p, '^\\s+|\\s+$', '', 'g')) AS key FROM (SELECT id, concat(' ', {_RAW}, chr(9)) AS p FROM fines)")
def plate_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("id", plates.lookup_key(F.concat(F.lit(" "), "plate", F.lit("\t"))).alias("key"))


@query(f"SELECT id, upper(regexp_replace(p, '[^A-Za-z0-9]', '', 'g')) AS clean, upper(regexp_replace(nullif(p, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS clean_unicode FROM (SELECT id, CASE WHEN id % 9 = 6 THEN '' ELSE concat({_RAW}, 'é²') END AS p FROM fines)")
def plate_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("id") % 9 == 6, "").otherwise(F.concat("plate", F.lit("é²")))
    return _raw(spark, sf_dir).select("id", plates.cleaned(text).alias("clean"), plates.cleaned_unicode(text).alias("clean_unicode"))


@query(f"SELECT id, {_RAW} <> '' AS has_plate FROM fines WHERE nullif({_RAW}, '') IS NOT NULL")
def nonempty_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).where(plates.readable(F.col("plate")).isNotNull()).select("id", (F.col("plate") != "").alias("has_plate"))


@query(f"SELECT id, upper(trim(plate)) AS plate, violation, image_path, {_AMOUNT} AS amount FROM fines WHERE id % 7 NOT IN (1, 2, 3)")
def ingest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records: 1 lacks a plate, 2 has a null one, 3 is no JSON."""
    full = F.to_json(F.struct(F.concat(F.lit("  "), F.lower("plate"), F.lit(" ")).alias("plate"), "violation", "image_path"))
    body = F.when(F.expr(_SEQUENCE) == 1, F.to_json(F.struct("violation", "image_path"))).when(F.expr(_SEQUENCE) == 2, F.concat(F.lit('{"plate":null,"violation":"x","image_path":"y"}'))).when(F.expr(_SEQUENCE) == 3, F.lit("{not json")).otherwise(full)
    good = ledger.accepted(fixtures.fines(spark, sf_dir).select("id", body.alias("body")))
    return ledger.with_amount(good, dims.amounts(spark)).select("id", "plate", "violation", "image_path", "amount")


@query(f"SELECT plate, violation, {_AMOUNT} AS amount, image_path, 'unpaid' AS status, TIMESTAMP '2024-01-02 03:04:05' AS timestamp FROM fines WHERE id % 5 = 0")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger made, added to twice with defaults, and read back."""
    import datetime

    path = storage.new_path(spark, "ledger")
    ledger_table.create(spark, path)
    rows = ledger.with_amount(fixtures.fines(spark, sf_dir).where("id % 5 = 0").select("id", "plate", "violation", "image_path"), dims.amounts(spark))
    for part in ("id % 10 = 0", "id % 10 <> 0"):
        ledger_table.append(rows.where(part).drop("id"), path, datetime.datetime(2024, 1, 2, 3, 4, 5))
    return ledger_table.read(spark, path).drop("id")


@query("SELECT id, to_json({'id': id, 'plate': plate, 'violation': violation, 'amount': amount, 'status': status}) AS body FROM fines")
def fines_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fines(spark, sf_dir).select("id", F.to_json(F.struct("id", "plate", "violation", "amount", "status")).alias("body"))


@query("SELECT id, split_part(image_path, '/', 2) AS name, '/evidence/' || split_part(image_path, '/', 2) AS url, '.jpg' AS suffix, '.mp4' AS fallback FROM fines")
def evidence_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("image_path")
    bare = F.regexp_replace(path, r"\.[a-z]+$", "")
    return fixtures.fines(spark, sf_dir).select("id", names.basename(path).alias("name"), names.evidence_url(path).alias("url"), names.extension(path).alias("suffix"), names.extension(bare, ".mp4").alias("fallback"))


@query("""SELECT plate, violation, amount, status, strftime(TIMESTAMP '2024-03-10 12:00:00' - to_days(CAST(days_ago AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS timestamp
 FROM (SELECT plate, unnest([{'violation': 'no_helmet', 'amount': CAST(500 AS BIGINT), 'status': 'unpaid', 'days_ago': id % 20}, {'violation': 'overspeed', 'amount': CAST(700 AS BIGINT), 'status': status, 'days_ago': 1}], recursive := true) FROM fines WHERE id % 11 = 0 AND plate IS NOT NULL AND violation <> 'view')""")
def demo_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested demo records to rows with times counted back from a given now; those without a plate or photo are skipped."""
    big = lambda n: F.lit(n).cast("bigint")
    entry = lambda v, a, s, d: F.struct(F.lit(v).alias("violation"), big(a).alias("amount"), s.alias("status"), d.alias("days_ago"))
    rows = fixtures.fines(spark, sf_dir).where("id % 11 = 0").where(F.col("plate").isNotNull() & (F.col("violation") != "view"))
    each = rows.select("plate", F.inline(F.array(entry("no_helmet", 500, F.lit("unpaid"), F.col("id") % 20), entry("overspeed", 700, F.col("status"), big(1)))))
    ago = F.expr("TIMESTAMP_NTZ '2024-03-10 12:00:00' - make_interval(0, 0, 0, CAST(days_ago AS INT))")
    return each.select("plate", "violation", "amount", "status", F.date_format(ago, "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


@query("""SELECT job_id, max_by(status, seq) FILTER (WHERE status IS NOT NULL) AS status, max_by(done, seq) FILTER (WHERE done IS NOT NULL) AS done, max_by(total, seq) FILTER (WHERE total IS NOT NULL) AS total
 FROM (SELECT id % 50 AS job_id, id AS seq, CASE WHEN id % 3 = 0 THEN status END AS status, CASE WHEN id % 3 > 0 THEN id END AS done, CASE WHEN id % 3 = 1 THEN amount END AS total FROM fines) GROUP BY job_id""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = fixtures.fines(spark, sf_dir).selectExpr("id % 50 AS job_id", "id AS seq", "CASE WHEN id % 3 = 0 THEN status END AS status", "CASE WHEN id % 3 > 0 THEN id END AS done", "CASE WHEN id % 3 = 1 THEN amount END AS total")
    return ledger.latest_jobs(updates)


# --- boxes ---


@query(f"SELECT video_id, frame_idx, count(*) FILTER (WHERE k = 'Plate') AS plates, count(*) FILTER (WHERE k = 'WithoutHelmet') AS without_helmet, count(*) FILTER (WHERE k = 'TripleRiding') AS triple_riding, count(*) FILTER (WHERE k = 'WithHelmet') AS with_helmet FROM (SELECT *, {_CLASS} AS k FROM detections) GROUP BY video_id, frame_idx")
def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = detections.video_class(F.col("label"))
    counts = {"plates": "Plate", "without_helmet": "WithoutHelmet", "triple_riding": "TripleRiding", "with_helmet": "WithHelmet"}
    return fixtures.detections(spark, sf_dir).groupBy("video_id", "frame_idx").agg(*(F.count_if(kind == k).alias(n) for n, k in counts.items()))


@query("SELECT label, count(*) AS n FROM detections WHERE label IN ('Plate', 'WithHelmet', 'WithoutHelmet', 'TripleRiding') GROUP BY label")
def label_split_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.detections(spark, sf_dir).where(F.col("label").isin(*dims.CLASSES)).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT video_id, frame_idx, det_id, CASE l_class WHEN 0 THEN 'Plate' WHEN 1 THEN 'WithHelmet' WHEN 2 THEN 'WithoutHelmet' ELSE 'TripleRiding' END AS label FROM (SELECT *, det_id % 5 AS l_class FROM detections) WHERE l_class < 4")
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = fixtures.detections(spark, sf_dir).select("video_id", "frame_idx", "det_id", (F.col("det_id") % 5).alias("class_id"))
    return detections.class_names(numbered, dims.classes(spark)).select("video_id", "frame_idx", "det_id", "label")


@query("SELECT video_id, frame_idx, det_id, conf FROM detections WHERE conf >= 0.25e0")
def conf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.confident(fixtures.detections(spark, sf_dir), Config.image_confidence).select("video_id", "frame_idx", "det_id", "conf")


@query("WITH cand AS (SELECT video_id, frame_idx, det_id, pos, concat('T', CAST(pos AS STRING), '-', CAST(lane AS STRING)) AS text, ((x1 * (pos + 1)) % 100) / 100.0e0 AS prob FROM detections CROSS JOIN (SELECT unnest(range(3)) AS pos) WHERE label = 'Plate') SELECT video_id, frame_idx, det_id, min_by(text, pos) AS text FROM cand WHERE prob > 0.4e0 GROUP BY video_id, frame_idx, det_id")
def ocr_first_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fixtures.detections(spark, sf_dir).where("label = 'Plate'")
    cand = boxes.select("video_id", "frame_idx", "det_id", "x1", "lane", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    cand = cand.select("video_id", "frame_idx", "det_id", "pos", F.concat(F.lit("T"), F.col("pos").cast("string"), F.lit("-"), F.col("lane").cast("string")).alias("text"), ((F.col("x1") * (F.col("pos") + 1)) % 100 / F.lit(100.0)).alias("prob"))
    return detections.first_sure_text(cand)


@query("SELECT video_id, frame_idx, det_id, CAST(trunc(x1 * 1.37e0 - 500) AS BIGINT) AS x, CAST(trunc(y1 * -0.71e0) AS BIGINT) AS y FROM detections")
def coordinate_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = fixtures.detections(spark, sf_dir)
    return dets.select("video_id", "frame_idx", "det_id", geometry.whole(F.col("x1") * F.lit(1.37) - 500).alias("x"), geometry.whole(F.col("y1") * F.lit(-0.71)).alias("y"))


@query("SELECT video_id, frame_idx, det_id, (x1 + x2) / 2.0e0 AS cx, (y1 + y2) / 2.0e0 AS cy FROM detections")
def centroid_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.detections(spark, sf_dir).select("video_id", "frame_idx", "det_id", geometry.centre(F.col("x1"), F.col("x2")).alias("cx"), geometry.centre(F.col("y1"), F.col("y2")).alias("cy"))


@query("SELECT video_id, frame_idx, det_id, CAST(floor((x1 - 700 + x2) / 2.0e0) AS BIGINT) AS cx, CAST(floor((y1 + y2) / 2.0e0) AS BIGINT) AS cy FROM detections")
def centroid_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.detections(spark, sf_dir).select("video_id", "frame_idx", "det_id", geometry.centre_floor(F.col("x1") - 700, F.col("x2")).alias("cx"), geometry.centre_floor(F.col("y1"), F.col("y2")).alias("cy"))


@query("SELECT video_id, frame_idx, det_id, greatest(0, x1 - 300) AS left_side, greatest(0, y1 - 103) AS top_side FROM detections")
def crop_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.detections(spark, sf_dir).select("video_id", "frame_idx", "det_id", geometry.crop_origin(F.col("x1") - 300).alias("left_side"), geometry.crop_origin(F.col("y1") - 103).alias("top_side"))


@query(f"""WITH l AS (SELECT video_id, frame_idx, list(struct_pack(det_id, x1, y1, x2, y2)) AS l FROM detections GROUP BY ALL), p AS (SELECT video_id, frame_idx, l, unnest(l) AS a FROM l), q AS (SELECT video_id, frame_idx, a, unnest(l) AS b FROM p)
SELECT video_id, frame_idx, a.det_id AS det_id, b.det_id AS other_id, round({_IOU}, 9) AS iou FROM q WHERE a.det_id < b.det_id""")
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = _dets(spark, sf_dir, "video_id", "frame_idx", "det_id", *geometry.SIDES)
    other = dets.select(F.col("video_id").alias("v"), F.col("frame_idx").alias("f"), F.col("det_id").alias("other_id"), *(F.col(s).alias(f"b_{s}") for s in geometry.SIDES))
    pairs = dets.join(other, (F.col("video_id") == F.col("v")) & (F.col("frame_idx") == F.col("f")) & (F.col("det_id") < F.col("other_id")))
    return pairs.select("video_id", "frame_idx", "det_id", "other_id", F.round(geometry.overlap(geometry.box(), geometry.box("b_")), 9).alias("iou"))


@query("""WITH b AS (SELECT video_id, frame_idx, lane, list(struct_pack(det_id, x1, y1)) AS l FROM detections WHERE label = 'Plate' GROUP BY ALL),
n AS (SELECT *, lead(frame_idx) OVER w AS next_frame, lead(l) OVER w AS m FROM b WINDOW w AS (PARTITION BY video_id, lane ORDER BY frame_idx)),
p AS (SELECT video_id, frame_idx, m, unnest(l) AS a FROM n WHERE next_frame = frame_idx + 1), q AS (SELECT video_id, frame_idx, a, unnest(m) AS b FROM p)
SELECT video_id, frame_idx, a.det_id AS det_id, b.det_id AS other_id, round(sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.y1 - b.y1) * (a.y1 - b.y1)), 9) AS distance FROM q""")
def box_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _dets(spark, sf_dir, "video_id", "frame_idx", "det_id", "label", "lane", "x1", "y1").where("label = 'Plate'").drop("label")
    later = boxes.select(F.col("video_id").alias("v"), (F.col("frame_idx") - 1).alias("f"), F.col("lane").alias("l"), F.col("det_id").alias("other_id"), F.col("x1").alias("bx"), F.col("y1").alias("by"))
    pairs = boxes.join(later, (F.col("video_id") == F.col("v")) & (F.col("frame_idx") == F.col("f")) & (F.col("lane") == F.col("l")))
    return pairs.select("video_id", "frame_idx", "det_id", "other_id", F.round(geometry.distance(F.col("x1"), F.col("y1"), F.col("bx"), F.col("by")), 9).alias("distance"))


@query(f"WITH {_FREE} SELECT video_id, frame_idx, det_id FROM free")
def helmet_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = _dets(spark, sf_dir)
    kind = detections.video_class(F.col("label"))
    return detections.uncontradicted(dets.where(kind == "WithoutHelmet"), dets.where(kind == "WithHelmet")).select("video_id", "frame_idx", "det_id")


@query(f"WITH {_FREE}, {_NEAR} SELECT video_id, frame_idx, det_id, near_id, round(distance, 9) AS distance FROM near")
def nearest_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(_dets(spark, sf_dir)).select("video_id", "frame_idx", "det_id", "near_id", F.round("distance", 9).alias("distance"))


@query(f"""WITH {_IMAGES}
SELECT f.video_id, f.frame_idx, {_TEXT} AS plate, concat_ws(',', CASE WHEN bare.video_id IS NOT NULL THEN 'no_helmet' END, CASE WHEN triple THEN 'triple_riding' END) AS violations, coalesce(n, 0) AS n_detections
FROM frames f LEFT JOIN agg USING (video_id, frame_idx) LEFT JOIN bare USING (video_id, frame_idx) LEFT JOIN pl USING (video_id, frame_idx)""")
def image_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).withColumn("violations", F.array_join("violations", ","))


@query(f"""WITH {_IMAGES},
s AS (SELECT f.video_id, f.frame_idx, {_TEXT} AS plate, unnest(list_value(CASE WHEN bare.video_id IS NOT NULL THEN 'no_helmet' END, CASE WHEN triple THEN 'triple_riding' END)) AS violation
 FROM frames f LEFT JOIN agg USING (video_id, frame_idx) LEFT JOIN bare USING (video_id, frame_idx) LEFT JOIN pl USING (video_id, frame_idx))
SELECT video_id, frame_idx, plate, violation, {_AMOUNT} AS amount, concat('evidence/', plate, '_', violation, '_', video_id, '_', frame_idx, '_', 0, '.jpg') AS image_path FROM s WHERE violation IS NOT NULL AND plate <> ''""")
def image_fines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fines of single images: none without a readable plate."""
    return _image_fines(spark, sf_dir)


def _image_fines(spark: SparkSession, sf_dir: str, dets: DataFrame | None = None) -> DataFrame:
    fined = ledger.with_amount(detections.image_fines(_images(spark, sf_dir, dets)), dims.amounts(spark))
    path = names.evidence_path(F.col("plate"), F.col("violation"), F.col("video_id"), F.col("frame_idx"), F.lit(0))
    return fined.select("video_id", "frame_idx", "plate", "violation", "amount", path.alias("image_path"))


@query(f"""WITH {_IMAGES}, {_FREE}, {_NEAR}, {_STREAK}, {_LANES},
s AS (SELECT f.video_id, f.frame_idx, {_TEXT} AS plate, unnest(list_value(CASE WHEN bare.video_id IS NOT NULL THEN 'no_helmet' END, CASE WHEN triple THEN 'triple_riding' END)) AS violation
 FROM frames f LEFT JOIN agg USING (video_id, frame_idx) LEFT JOIN bare USING (video_id, frame_idx) LEFT JOIN pl USING (video_id, frame_idx)),
held AS (SELECT s.*, p.plate, row_number() OVER (PARTITION BY s.video_id, s.track_id, s.violation ORDER BY s.frame_idx) AS k FROM streaks s JOIN lane_plates p ON p.video_id = s.video_id AND p.frame_idx = s.frame_idx AND p.lane = s.track_id WHERE streak >= 5 AND plate <> ''),
told AS (SELECT plate, violation, video_id, frame_idx, 0 AS place FROM s WHERE violation IS NOT NULL AND plate <> '' UNION ALL SELECT plate, violation, video_id, frame_idx, track_id FROM held WHERE k = 1)
SELECT upper(trim(plate)) AS plate, violation, {_AMOUNT} AS amount, 'unpaid' AS status, TIMESTAMP '2024-01-02 03:04:05' AS time, concat('/evidence/', plate, '_', violation, '_', video_id, '_', frame_idx, '_', place, '.jpg') AS image, true AS own_id FROM told""")
def record_fines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of images and of videos recorded in one ledger, and shown as a lookup does; lanes stand in for tracks."""
    import datetime

    path, now = storage.new_path(spark, "ledger"), datetime.datetime(2024, 1, 2, 3, 4, 5)
    ledger_table.create(spark, path)
    amounts = dims.amounts(spark)
    dets = _dets(spark, sf_dir, *VIDEO, "lane", "conf")
    texts = _lane_plates(dets).select("video_id", "frame_idx", F.col("lane").alias("track_id"), "plate")
    held = _lane_streaks(dets).where(F.col("streak") >= Config.streak).join(texts, ["video_id", "frame_idx", "track_id"])
    evidence = names.evidence_path(*(F.col(c) for c in ("plate", "violation", "video_id", "frame_idx", "track_id")))
    for found in (_image_fines(spark, sf_dir, dets), confirm.first_reports(held, "track_id", "violation").withColumn("image_path", evidence)):
        video.record(found, path, amounts, now)
    fines = ledger_table.read(spark, path)
    once = fines.groupBy("id").agg((F.count("*") == 1).alias("own_id"))
    return ledger.api_view(fines).join(once, "id").drop("id")


@query(f"WITH pl AS (SELECT video_id, frame_idx, max_by(ocr_texts, det_id) AS ocr_texts FROM detections WHERE label = 'Plate' GROUP BY ALL) SELECT video_id, frame_idx, {_TEXT} AS plate FROM pl")
def last_plate_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.image_plates(fixtures.detections(spark, sf_dir))


# --- sequences ---


@query(f"WITH {_LANES}, {_SPEED} SELECT video_id, frame_idx, lane, speed_kmh FROM speeds")
def speed_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confirm.speeds(_lane_plates(fixtures.detections(spark, sf_dir)), "lane", CALIBRATED).select("video_id", "frame_idx", "lane", "speed_kmh")


@query(f"WITH {_LANES}, {_SPEED} SELECT video_id, frame_idx, lane, speed_kmh FROM speeds WHERE speed_kmh > 40")
def overspeed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speed_estimate(spark, sf_dir).where(F.col("speed_kmh") > Config.speed_limit)


@query("SELECT id, amount / CAST(1 + id % 9 AS DOUBLE) AS per_metre FROM fines")
def pixels_per_metre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fines(spark, sf_dir).select("id", speed.pixels_per_metre(F.col("amount"), (1 + F.col("id") % 9).cast("double")).alias("per_metre"))


@query(f"WITH {_FREE}, {_NEAR}, {_STREAK} SELECT * FROM streaks")
def violation_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lane_streaks(_dets(spark, sf_dir))


@query(f"""WITH {_FREE}, {_NEAR}, {_STREAK}, {_LANES},
held AS (SELECT s.*, p.plate, row_number() OVER (PARTITION BY s.video_id, s.track_id, s.violation ORDER BY s.frame_idx) AS k FROM streaks s JOIN lane_plates p ON p.video_id = s.video_id AND p.frame_idx = s.frame_idx AND p.lane = s.track_id WHERE streak >= 5 AND plate <> '')
SELECT video_id, track_id, violation, frame_idx, plate, {_AMOUNT} AS amount FROM held WHERE k = 1""")
def first_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = _dets(spark, sf_dir)
    texts = _lane_plates(dets).select("video_id", "frame_idx", F.col("lane").alias("track_id"), "plate")
    held = _lane_streaks(dets).where(F.col("streak") >= Config.streak).join(texts, ["video_id", "frame_idx", "track_id"])
    return ledger.with_amount(confirm.first_reports(held, "track_id", "violation"), dims.amounts(spark)).select("video_id", "track_id", "violation", "frame_idx", "plate", "amount")


@query(f"""WITH {_LANES}, {_SPEED}, {_FREE}, {_NEAR} SELECT violation, count(*) AS n FROM (SELECT 'overspeed' AS violation FROM speeds WHERE speed_kmh > 40 UNION ALL SELECT CASE label WHEN 'WithoutHelmet' THEN 'no_helmet' ELSE 'triple_riding' END FROM near) GROUP BY violation""")
def violation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = _dets(spark, sf_dir)
    fast = confirm.speeds(_lane_plates(dets), "lane", CALIBRATED).where(F.col("speed_kmh") > Config.speed_limit)
    near = _near(dets).withColumnRenamed("near_id", "track_id")
    both = confirm.united(("overspeed", fast.withColumnRenamed("lane", "track_id")), ("no_helmet", near.where("label = 'WithoutHelmet'")), ("triple_riding", near.where("label = 'TripleRiding'")))
    return both.groupBy("violation").agg(F.count("*").alias("n"))


@query(f"WITH {_LANES} SELECT a.video_id, a.frame_idx, a.lane FROM lane_plates a WHERE NOT EXISTS (SELECT 1 FROM lane_plates b WHERE b.video_id = a.video_id AND b.lane = a.lane AND b.frame_idx = a.frame_idx + 1)")
def unmatched_next_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference: lanes whose plate isn't in the next frame."""
    lanes = storage.written(_lane_plates(fixtures.detections(spark, sf_dir)).select("video_id", "frame_idx", "lane"), "lanes")
    return lanes.join(lanes.select("video_id", (F.col("frame_idx") - 1).alias("frame_idx"), "lane"), ["video_id", "frame_idx", "lane"], "left_anti")


@query("SELECT video_id, frame_idx, least(CAST(300 AS BIGINT), total) AS total FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS total FROM frames) WHERE frame_idx <= 300")
def frame_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fixtures.frames(spark, sf_dir)
    total = frames.groupBy("video_id").agg(F.least(F.lit(300).cast("bigint"), F.count("*")).alias("total"))
    return detections.capped(frames, 300).join(total, "video_id").select("video_id", "frame_idx", "total")


@query("SELECT video_id, frame_idx, total FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS total FROM frames) WHERE frame_idx % 5 = 0 OR frame_idx = total")
def progress_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fixtures.frames(spark, sf_dir)
    total = frames.groupBy("video_id").agg(F.count("*").alias("total"))
    return frames.join(total, "video_id").where("frame_idx % 5 = 0 OR frame_idx = total").select("video_id", "frame_idx", "total")


@query("SELECT video_id, frame_idx, CASE WHEN w > 1280 THEN 1280 ELSE w END AS width, CASE WHEN w > 1280 THEN CAST(floor(h * (1280.0e0 / w)) AS BIGINT) ELSE h END AS height FROM (SELECT video_id, frame_idx, 640 + (frame_idx % 7) * 331 AS w, 360 + (frame_idx % 5) * 217 AS h FROM frames)")
def frame_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = fixtures.frames(spark, sf_dir).selectExpr("video_id", "frame_idx", "640 + (frame_idx % 7) * 331 AS w", "360 + (frame_idx % 5) * 217 AS h")
    return sized.select("video_id", "frame_idx", geometry.scaled_width(F.col("w"), Config.max_width).alias("width"), geometry.scaled_height(F.col("w"), F.col("h"), Config.max_width).alias("height"))


@query("SELECT video_id, frame_idx, round_even(coalesce(nullif(f, 0), 25.0e0), 1) AS fps FROM (SELECT video_id, frame_idx, CASE WHEN frame_idx % 4 = 0 THEN 0.0e0 ELSE (frame_idx % 13) * 4.37e0 END AS f FROM frames)")
def source_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.when(F.col("frame_idx") % 4 == 0, F.lit(0.0)).otherwise((F.col("frame_idx") % 13) * F.lit(4.37))
    return fixtures.frames(spark, sf_dir).select("video_id", "frame_idx", F.bround(speed.source_fps(rate), 1).alias("fps"))


@query(f"WITH {_LANES} SELECT video_id, frame_idx, concat('evidence/', plate, '_', 'no_helmet', '_', video_id, '_', frame_idx, '_', lane, '.jpg') AS path FROM lane_plates WHERE plate IS NOT NULL")
def evidence_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = _lane_plates(fixtures.detections(spark, sf_dir)).where(F.col("plate").isNotNull())
    return lanes.select("video_id", "frame_idx", names.evidence_path(F.col("plate"), F.lit("no_helmet"), F.col("video_id"), F.col("frame_idx"), F.col("lane")).alias("path"))


# --- tracking, videos and streams: no SQL can follow the greedy assignment ---


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with one plate a lane and frame, on which SQL can follow the tracker."""
    dets = _dets(spark, sf_dir, *VIDEO, "lane")
    first = dets.where("label = 'Plate'").groupBy("video_id", "frame_idx", "lane").agg(F.min("det_id").alias("det_id"))
    return dets.where("label <> 'Plate'").unionByName(dets.join(first, ["video_id", "frame_idx", "lane", "det_id"], "left_semi"))


@query(f"WITH {_TRACKED} SELECT video_id, frame_idx, track_id, det_id, plate FROM tracked")
def centroid_tracker_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.tracks(_single(spark, sf_dir)).select("video_id", "frame_idx", "track_id", "det_id", "plate")


@query(f"WITH {_TRACK_FINES} SELECT *, concat('evidence/', plate, '_', violation, '_', video_id, '_', frame_idx, '_', track_id, '.jpg') AS image_path FROM told")
def video_violations_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.violations(storage.written(_single(spark, sf_dir), "single"), dims.amounts(spark), CALIBRATED)


@query(f"""WITH {_TRACK_FINES}, ends AS (SELECT video_id, max(frame_idx) AS frames FROM frames GROUP BY video_id),
alive AS (SELECT video_id, count(*) AS n FROM (SELECT video_id, track_id, max(frame_idx) AS last FROM tracked GROUP BY ALL) JOIN ends USING (video_id) WHERE frames - last <= 10 GROUP BY video_id),
fined AS (SELECT video_id, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM told GROUP BY video_id)
SELECT video_id, frames, coalesce(alive.n, 0) AS plates_tracked, coalesce(fined.n, 0) AS violations, coalesce(fined.amount, 0) AS amount FROM ends LEFT JOIN alive USING (video_id) LEFT JOIN fined USING (video_id)""")
def run_summary_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.summary(storage.written(_single(spark, sf_dir), "single"), fixtures.frames(spark, sf_dir), dims.amounts(spark), CALIBRATED)


@query()
def centroid_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.tracks(_dets(spark, sf_dir, *VIDEO)).select("video_id", "frame_idx", "track_id", "det_id", "plate")


@query()
def video_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = _dets(spark, sf_dir, *VIDEO)
    tracked = storage.written(video.tracks(dets, CALIBRATED), "tracks")
    return video.violations(dets, dims.amounts(spark), CALIBRATED, tracked)


@query()
def cli_video_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the plate text of the other front end: the first fragment read with confidence, letters and digits of any script."""
    dets = _dets(spark, sf_dir, *VIDEO, "ocr_confs")
    sure = F.filter(F.arrays_zip("ocr_texts", "ocr_confs"), lambda f: f["ocr_confs"] > Config.ocr_confidence)
    text = plates.cleaned_unicode(F.get(sure, F.lit(0))["ocr_texts"])
    tracked = storage.written(video.tracks(dets, CALIBRATED, text), "tracks")
    return video.violations(dets, dims.amounts(spark), CALIBRATED, tracked)


@query()
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.summary(_dets(spark, sf_dir, *VIDEO), fixtures.frames(spark, sf_dir), dims.amounts(spark), CALIBRATED)


def _streamed(spark: SparkSession, sf_dir: str, dets: DataFrame) -> str:
    """The folder of fines that the stateful stream program recorded from the frames of dets."""
    one = F.struct("det_id", "label", *geometry.SIDES, "ocr_texts")
    packed = dets.groupBy("video_id", "frame_idx").agg(F.collect_list(one).alias("detections"))
    frames = fixtures.frames(spark, sf_dir).select("video_id", "frame_idx").join(packed, ["video_id", "frame_idx"], "left")
    whole = frames.withColumn("detections", F.coalesce("detections", F.array().cast(packed.schema["detections"].dataType)))
    source, sink, marks = (storage.new_path(spark, x) for x in ("frames", "reports", "marks"))
    whole.repartition("video_id").sortWithinPartitions("video_id", "frame_idx").write.parquet(source)
    frame_program.run_to_end(files.frame_stream(spark, source, 1000), sink, marks, CALIBRATED)
    return sink


@query()
def stream_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames through the stateful stream program and the ledger sink."""
    sink = _streamed(spark, sf_dir, fixtures.detections(spark, sf_dir))
    return spark.read.schema(schemas.VIOLATIONS).parquet(sink).select("video_id", "frame_idx", "track_id", "violation", "plate", "amount")


@query(f"WITH {_TRACK_FINES} SELECT plate, violation, amount, concat('/evidence/', plate, '_', violation, '_', video_id, '_', frame_idx, '_', track_id, '.jpg') AS image, 'unpaid' AS status FROM told")
def stream_fines_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream recorded in the ledger, as a lookup shows it."""
    return ledger.api_view(ledger_table.read(spark, _streamed(spark, sf_dir, _single(spark, sf_dir)))).drop("id", "time")


@query("SELECT id, plate, violation, amount, image_path, status, timestamp FROM fines WHERE id % 3 = 0")
def ledger_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows added with their own ids, times and states."""
    path = storage.new_path(spark, "ledger")
    ledger_table.create(spark, path)
    ledger_table.append(fixtures.fines(spark, sf_dir).where("id % 3 = 0"), path)
    return ledger_table.read(spark, path)


@query("SELECT id, plate, violation, amount, image_path, status, timestamp FROM fines WHERE id % 7 = 0")
def ledger_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger whose rows were all replaced."""
    path = storage.new_path(spark, "ledger")
    fines = fixtures.fines(spark, sf_dir)
    ledger_table.create(spark, path)
    ledger_table.append(fines.where("id % 2 = 0"), path)
    ledger_table.replace(fines.where("id % 7 = 0"), path)
    return ledger_table.read(spark, path)


@query(f"WITH {_LANES}, {_SPEED} SELECT true AS calibrated, count(*) AS n FROM speeds WHERE speed_kmh > 40 UNION ALL SELECT false, 0")
def calibration_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a calibration there are no speeds to exceed."""
    lanes = _lane_plates(fixtures.detections(spark, sf_dir)).withColumn("track_id", F.col("lane"))
    rows = [video.overspeeds(lanes, config).agg(F.lit(config.calibrated()).alias("calibrated"), F.count("*").alias("n")) for config in (CALIBRATED, Config())]
    return rows[0].unionAll(rows[1])


@query("SELECT count(*) AS n, count(*) AS different, count(*) AS well_formed FROM fines")
def job_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random ids of jobs: none twice."""
    ids = storage.written(fixtures.fines(spark, sf_dir).select(names.job_id().alias("job_id")), "jobs")
    shape = F.col("job_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return ids.agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("different"), F.count_if(shape).alias("well_formed"))
