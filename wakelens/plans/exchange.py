"""Source and sink plans: data goes through files and comes back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder
from ..sources import readers as rd
from ..sources import writers as wr
from .bindings import KEYWORD, STAR_SQL, TEXT_SQL, UTTERANCES_SQL, WINDOWS_SQL, clips, recognised, table, utterances, windows, with_ctes
from .labelling import LEAK_SQL, MAPPED_SQL, mapped
from .registry import plan

U = with_ctes(UTTERANCES_SQL)


@plan(
    "src1_jsonl_state",
    U
    + """SELECT CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (WHERE status = 'failed' AND split = 'other' OR speaker = 'src0') AS BIGINT) AS corrupt,
  CAST(count(*) FILTER (WHERE status = 'failed' AND split = 'clean' AND speaker <> 'src0') AS BIGINT) AS failed,
  CAST(count(*) FILTER (WHERE status = 'success' AND speaker <> 'src0') AS BIGINT) AS completed_ids FROM run_a""",
)
def _src1(spark, sf_dir):
    """SRC1: JSON lines with blank, broken and id-less lines."""
    run = recognised(utterances(spark, sf_dir))
    whole = F.to_json(F.struct(F.when(F.col("speaker") != "src0", F.col("id")).alias("id"), "status", "hypothesis"))
    broken = (F.col("status") == "failed") & (F.col("split") == "other")
    line = F.when(broken, F.concat(F.lit('{"id": "'), "id")).otherwise(whole)
    path = shared_folder(spark)
    lines = run.select(F.explode(F.array(line, F.lit(""))).alias("value"))
    lines.write.text(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "status", "hypothesis")])
    return rd.prediction_state(rd.read_jsonl(spark, path, schema), "id", retry_failed=True)


@plan(
    "src2_csv_catalogue",
    """SELECT p_partkey AS prompt_id, p_name AS expected_transcript, p_size AS repetitions, p_size > 25 AS contains_keyword FROM part""",
)
def _src2(spark, sf_dir):
    """SRC2: a CSV catalogue with truthy strings."""
    flag = F.when(F.col("p_size") > 40, " Yes ").when(F.col("p_size") > 30, "TRUE").when(F.col("p_size") > 25, "1").when(F.col("p_size") > 10, "no").otherwise("")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("prompt_id"), F.col("p_name").alias("expected_transcript"), F.col("p_size").alias("repetitions"), flag.alias("contains_keyword"))
    path = shared_folder(spark)
    wr.write_csv(rows, path)
    schema = T.StructType(
        [
            T.StructField("prompt_id", T.LongType()),
            T.StructField("expected_transcript", T.StringType()),
            T.StructField("repetitions", T.IntegerType()),
            T.StructField("contains_keyword", T.StringType()),
        ]
    )
    return rd.read_csv(spark, path, schema, flags=["contains_keyword"])


@plan(
    "src3_canonical_files",
    with_ctes(STAR_SQL)
    + """, f AS (SELECT DISTINCT 'audio_raw/' || clip_id || '.webm' AS path FROM clips WHERE storage_id > 5 UNION SELECT DISTINCT 'audio_raw/' || clip_id || '.wav' FROM clips WHERE label = 1
UNION SELECT DISTINCT 'rec/' || session_id || '.webm' FROM clips WHERE auto_qc_status = 'auto_accepted' UNION SELECT DISTINCT 'old/' || clip_id || '.m4a' FROM clips WHERE prompt_group = ''),
c AS (SELECT DISTINCT clip_id, 'rec/' || session_id || '.webm' AS raw_audio_path FROM clips),
a AS (SELECT regexp_extract(path, 'audio_raw/([^.]+)', 1) AS clip_id, count(*) AS n, min(path) AS p FROM f WHERE path LIKE 'audio_raw/%' GROUP BY 1),
s AS (SELECT regexp_extract(path, '/([^/]*)\\.(webm|m4a|wav)$', 1) AS clip_id, min(path) AS p FROM f GROUP BY 1)
SELECT c.clip_id, coalesce(CASE WHEN a.n = 1 THEN a.p END, r.path, s.p) AS member, CASE WHEN a.n = 1 THEN 'unique_prefix' WHEN r.path IS NOT NULL THEN 'recorded_path' WHEN s.p IS NOT NULL THEN 'suffix' END AS member_rule
FROM c LEFT JOIN a USING (clip_id) LEFT JOIN f r ON r.path = c.raw_audio_path LEFT JOIN s ON s.clip_id = c.clip_id""",
)
def _src3(spark, sf_dir):
    """SRC3: one canonical file per clip by three rules."""
    rows = clips(spark, sf_dir)
    session = F.concat(F.lit("rec/"), F.col("session_id").cast("string"), F.lit(".webm"))

    def named(where, prefix, suffix):
        return rows.where(where).select(F.concat(F.lit(prefix), "clip_id", F.lit(suffix)).alias("path"))

    files = (
        named(F.col("storage_id") > 5, "audio_raw/", ".webm")
        .unionByName(named(F.col("label") == 1, "audio_raw/", ".wav"))
        .unionByName(rows.where(F.col("auto_qc_status") == "auto_accepted").select(session.alias("path")))
        .unionByName(named(F.col("prompt_group") == "", "old/", ".m4a"))
        .distinct()
    )
    wanted = rows.select("clip_id", session.alias("raw_audio_path")).distinct()
    return rd.canonical_members(wanted, files).select("clip_id", "member", "member_rule")


INVENTORY_SQL = """WITH f AS (SELECT 'audio_raw/s' || s_suppkey || '.webm' AS path FROM supplier WHERE s_suppkey % 3 <> 0 UNION SELECT 'audio_raw/s' || s_suppkey || '.wav' FROM supplier WHERE s_suppkey % 5 = 0
UNION SELECT 'rec/n' || s_nationkey || '.webm' FROM supplier WHERE s_nationkey % 2 = 0 UNION SELECT 'old/s' || s_suppkey || '.m4a' FROM supplier WHERE s_suppkey % 7 = 0),
a AS (SELECT regexp_extract(path, '^audio_raw/([^/.]+)', 1) AS clip_id, count(*) AS files, min(path) AS first_file, max(path) AS last_file FROM f WHERE path LIKE 'audio_raw/%' GROUP BY 1)
"""


def inventory(spark, sf_dir):
    """A folder of recordings, one for each supplier and rule, and its listing."""
    s = table(spark, sf_dir, "supplier")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")

    def named(where, folder, stem, number, suffix):
        return F.when(where, F.struct(F.lit(folder).alias("dir"), F.concat(F.lit(stem), number.cast("string"), F.lit(suffix)).alias("name")))

    files = F.array_compact(
        F.array(
            named(key % 3 != 0, "audio_raw", "s", key, ".webm"),
            named(key % 5 == 0, "audio_raw", "s", key, ".wav"),
            named(nation % 2 == 0, "rec", "n", nation, ".webm"),
            named(key % 7 == 0, "old", "s", key, ".m4a"),
        )
    )
    path = shared_folder(spark)
    members = s.select(F.inline(files)).distinct().withColumn("value", F.lit("sound"))
    members.repartition("dir", "name").write.partitionBy("dir", "name").text(path)
    return rd.member_paths(rd.list_files(spark, path))


@plan(
    "src3_scanned_inventory",
    INVENTORY_SQL
    + """, s AS (SELECT regexp_extract(path, '/([^/]*)\\.(webm|m4a|wav)$', 1) AS clip_id, min(path) AS p FROM f GROUP BY 1),
c AS (SELECT 's' || s_suppkey AS clip_id, 'rec/n' || s_nationkey || '.webm' AS raw_audio_path FROM supplier)
SELECT c.clip_id, coalesce(CASE WHEN files = 1 THEN first_file END, r.path, s.p) AS member, CASE WHEN files = 1 THEN 'unique_prefix' WHEN r.path IS NOT NULL THEN 'recorded_path' WHEN s.p IS NOT NULL THEN 'suffix' END AS member_rule
FROM c LEFT JOIN a USING (clip_id) LEFT JOIN f r ON r.path = c.raw_audio_path LEFT JOIN s ON s.clip_id = c.clip_id""",
)
def _src3_scan(spark, sf_dir):
    """SRC3: the canonical files of a folder that is written and scanned."""
    recorded = F.concat(F.lit("rec/n"), F.col("s_nationkey").cast("string"), F.lit(".webm"))
    wanted = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("clip_id"), recorded.alias("raw_audio_path"))
    return rd.canonical_members(wanted, inventory(spark, sf_dir)).select("clip_id", "member", "member_rule")


@plan("src3_ambiguous_prefixes", INVENTORY_SQL + "SELECT * FROM a WHERE files > 1")
def _src3_ambiguous(spark, sf_dir):
    """SRC3: ids of the scanned folder with more than one file of their name."""
    return rd.ambiguous_prefixes(inventory(spark, sf_dir))


@plan(
    "src4_duplicate_ids",
    U
    + """, l AS (SELECT id, reference FROM run_a WHERE status <> 'failed' UNION ALL SELECT id, reference FROM run_a WHERE status <> 'failed' AND length(reference) % 10 = 0
UNION ALL SELECT id, reference || ' again' FROM run_a WHERE status <> 'failed' AND length(reference) % 15 = 0),
t AS (SELECT id, trim(reference) AS r, count(*) AS n FROM l WHERE len(string_split(id, '-')) = 3 AND trim(reference) <> '' GROUP BY ALL)
SELECT id, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS texts FROM t GROUP BY id HAVING sum(n) > 1""",
)
def _src4_duplicates(spark, sf_dir):
    """SRC4: utterance ids that occur in several transcript lines."""
    run = recognised(utterances(spark, sf_dir)).where(F.col("status") != "failed")
    line = F.concat_ws(" ", "id", "reference")
    size = F.length("reference")
    lines = F.array_compact(F.array(line, F.when(size % 10 == 0, line), F.when(size % 15 == 0, F.concat(line, F.lit(" again")))))
    path = shared_folder(spark)
    run.select(F.explode(lines).alias("value")).write.text(path)
    return rd.duplicate_transcripts(rd.read_transcripts(spark, path))


@plan(
    "src4_transcript_lines",
    U
    + """SELECT CASE WHEN status = 'failed' THEN 'malformed_id' WHEN reference LIKE 'zz%' THEN 'empty_text' END AS problem, count(*) AS n, count(DISTINCT speaker) AS speakers, CAST(sum(length(reference)) AS BIGINT) AS characters
FROM run_a GROUP BY 1""",
)
def _src4(spark, sf_dir):
    """SRC4: transcript lines with malformed ids."""
    run = recognised(utterances(spark, sf_dir))
    name = F.when(F.col("status") == "failed", F.concat("speaker", F.lit("-x"))).otherwise(F.col("id"))
    path = shared_folder(spark)
    run.select(F.concat_ws(" ", name, "reference").alias("value")).write.text(path)
    parsed = rd.read_transcripts(spark, path)
    return parsed.groupBy("problem").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("speaker_id").alias("speakers"), F.sum(F.length("reference")).alias("characters")
    )


@plan("src6_ordered_scan", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey")
def _src6(spark, sf_dir):
    """SRC6: relational scan in key order."""
    return rd.read_table(spark, f"{sf_dir}/orders.parquet", ["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderstatus"])


@plan(
    "snk1_split_manifests",
    with_ctes(WINDOWS_SQL) + "SELECT split, count(*) AS windows, count(DISTINCT clip_id) AS clips, CAST(sum(label) AS BIGINT) AS positives FROM w GROUP BY split",
)
def _snk1(spark, sf_dir):
    """SNK1: sorted manifests per split, read back."""
    rows = windows(spark, sf_dir).select("split", "clip_id", "window_index", "label", "content_hash")
    paths = wr.write_split_manifests(rows, shared_folder(spark))
    back = spark.read.schema("clip_id string, window_index long, label int, content_hash string, split string").json(paths["all"])
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("windows"), F.count_distinct("clip_id").alias("clips"), F.sum("label").cast("long").alias("positives")
    )


MANIFEST_SQL = f"""mm AS (SELECT *, CASE WHEN lang = 'en' THEN 'train' WHEN lang = 'de' THEN 'val' ELSE 'test' END AS split FROM m WHERE len(reasons) = 0)"""


def accepted(spark, sf_dir):
    """Accepted labelled texts; splits follow the language."""
    rows = mapped(spark, sf_dir).where(F.size("reasons") == 0)
    split = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "de", "val").otherwise("test")
    audio = F.concat(F.lit("audio_raw/"), "clip_id", F.lit(".webm"))
    return rows.select(
        "clip_id",
        "label",
        F.col("mapped_group").alias("prompt_group"),
        "phrase_id",
        F.col("mapped_transcript").alias("transcript"),
        "participant_id",
        split.alias("split"),
        audio.alias("audio_path"),
    )


@plan(
    "snk2_recognition_rows",
    with_ctes(TEXT_SQL)
    + f""", {MAPPED_SQL}, {MANIFEST_SQL} SELECT split, 'audio_raw/' || clip_id || '.webm' AS audio, sha256('language English<asr_text>' || said) AS target FROM mm""",
)
def _snk2(spark, sf_dir):
    """SNK2: recognition projection of the manifest."""
    rows = wr.asr_rows(accepted(spark, sf_dir), KEYWORD, audio="audio_path", transcript="transcript")
    return rows.select("split", "audio", F.sha2("text", 256).alias("target"))


@plan(
    "snk2_recognition_violations",
    with_ctes(TEXT_SQL) + f", {MAPPED_SQL}, {MANIFEST_SQL}, x AS (SELECT split, said || ' ' || mapped_group AS x FROM mm) SELECT split, count(*) AS violations FROM x WHERE {LEAK_SQL} GROUP BY split",
)
def _snk2_violations(spark, sf_dir):
    """SNK2: recognition rows that leak a label, per split."""
    tagged = accepted(spark, sf_dir).withColumn("transcript", F.concat_ws(" ", "transcript", "prompt_group"))
    rows = wr.asr_rows(tagged, KEYWORD, audio="audio_path", transcript="transcript")
    return wr.asr_violations(rows).groupBy("split").agg(F.count(F.lit(1)).alias("violations"))


@plan(
    "snk2_keyword_rows",
    with_ctes(TEXT_SQL)
    + f""", {MAPPED_SQL}, {MANIFEST_SQL} SELECT split, label, mapped_group AS prompt_group, count(*) AS rows, count(DISTINCT participant_id) AS participants, count(DISTINCT phrase_id) AS phrases FROM mm GROUP BY ALL""",
)
def _snk2_keyword(spark, sf_dir):
    """SNK2: keyword projection, written by split, counted per label and prompt."""
    rows = wr.keyword_rows(accepted(spark, sf_dir), KEYWORD, audio="audio_path", transcript="transcript", alias="participant_id")
    path = shared_folder(spark)
    wr.write_partitioned(rows, path, ["split"], "json")
    kinds = "audio string, transcript string, label int, prompt_group string, phrase_id string, participant_alias string, clip_id string, split string"
    back = spark.read.schema(kinds).json(path)
    return back.groupBy("split", "label", "prompt_group").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("participant_alias").alias("participants"),
        F.count_distinct("phrase_id").alias("phrases"),
    )


@plan(
    "snk3_union_report",
    """SELECT c_custkey AS id, 'customer' AS kind, c_mktsegment AS segment, NULL AS nation FROM customer UNION ALL SELECT s_suppkey, 'supplier', NULL, s_nationkey FROM supplier""",
)
def _snk3(spark, sf_dir):
    """SNK3: CSV whose header is the union of the rows' keys."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    path = shared_folder(spark)
    report = wr.union_report([a, b])
    wr.write_csv(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)
