"""Queries over the given tables for what else is shown on constants: labels, addresses, origins, demo rows, probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.store import ReviewStore
from ..schema import ISSUE_TYPES, STATUSES, status_label, type_label
from ..sources.files import work_folder
from ..sources.tables import readiness_of, table
from . import review
from .catalogue import DEMO_FINDINGS, DEMO_NOW, query, sql_case, sql_values, values

#: Events as states; one is unheard and shows as pending.
SHOWN = {"signup": "pending", "click": "processing", "view": "completed", "error": "failed", "purchase": "archived"}


@query(f"""SELECT event_id, {sql_case('s', STATUSES, repr('Pending'))} AS label, upper(s[1]) || s[2:] AS capital FROM (SELECT event_id, {sql_case('event_type', SHOWN, 'event_type')} AS s FROM events)""", views=False)
def event_status_labels(spark, sf_dir) -> DataFrame:
    """The state of each event as a card shows it."""
    state = F.element_at(F.create_map(*(F.lit(x) for pair in SHOWN.items() for x in pair)), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", status_label(state).alias("label"), F.initcap(state).alias("capital"))


#: Database addresses by the supplier's key: the managed host, its pooler in both modes, another host.
ADDRESSES = (
    "postgresql+asyncpg://u:p@db.a%s.supabase.co:5432/x",
    "postgresql+psycopg://u:p@eu%s.pooler.supabase.com:5432/x",
    "postgresql+psycopg://u:p@eu%s.pooler.supabase.com:6543/x",
    "postgresql://u:p@localhost:6543/x%s?o=+asyncpg+asyncpg",
)


@query(f"""WITH given AS (SELECT s_suppkey, replace(([{', '.join(repr(a) for a in ADDRESSES)}])[s_suppkey % {len(ADDRESSES)} + 1], '%s', s_suppkey::VARCHAR) AS u FROM supplier),
told AS (SELECT *, contains(u, 'supabase.co') OR contains(u, 'pooler.supabase.com') AS managed, contains(u, 'pooler.supabase.com') AND contains(u, ':6543') AS mode FROM given)
SELECT s_suppkey, managed, contains(u, 'pooler.supabase.com') AS pooler, mode AS transaction_mode, regexp_matches(u, '@db\\.[a-z0-9]+\\.supabase\\.co') AS direct, regexp_replace(u, '\\+asyncpg', '+psycopg') AS driver,
  'connect_timeout=10' || CASE WHEN managed THEN ',sslmode=require' ELSE '' END || CASE WHEN mode THEN ',prepare_threshold=none' ELSE '' END AS args FROM told""", views=False)
def supplier_addresses(spark, sf_dir) -> DataFrame:
    """An address for each supplier: what it says of its host, the installed driver, the connection's settings."""
    pattern = F.element_at(F.array(*map(F.lit, ADDRESSES)), (F.col("s_suppkey") % len(ADDRESSES) + 1).cast("int"))
    u = F.replace(pattern, F.lit("%s"), F.col("s_suppkey").cast("string"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", u.alias("url")).withColumn("d", X.describe_url(F.col("url")))
    args = F.array_join(F.transform(F.map_entries(X.connect_args(F.col("url"))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.select("s_suppkey", "d.*", X.installed_driver(F.col("url")).alias("driver"), args.alias("args"))


@query("""SELECT c_custkey, x AS origin, regexp_full_match(x, 'https://(.*\\.onrender\\.com|.*\\.vercel\\.app)') AS allowed FROM (SELECT c_custkey, unnest(list_filter(list_transform(string_split(
  CASE c_custkey % 3 WHEN 0 THEN ' https://' || lower(c_mktsegment) || '.onrender.com, ,http://c' || c_custkey || '.example ,' WHEN 1 THEN '' ELSE 'https://c' || c_custkey || '.vercel.app,https://vercel.app,  https://x.onrender.com.evil' END, ','),
  lambda x: trim(x)), lambda x: x <> '')) AS x FROM customer)""", views=False)
def customer_origins(spark, sf_dir) -> DataFrame:
    """A list of origins for each customer, trimmed, with whether a site there may call the service."""
    key, segment = F.col("c_custkey").cast("string"), F.lower("c_mktsegment")
    given = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" https://"), segment, F.lit(".onrender.com, ,http://c"), key, F.lit(".example ,")))
        .when(F.col("c_custkey") % 3 == 1, "")
        .otherwise(F.concat(F.lit("https://c"), key, F.lit(".vercel.app,https://vercel.app,  https://x.onrender.com.evil")))
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(X.origins(given)).alias("origin"))
    return rows.withColumn("allowed", X.origin_allowed(F.col("origin")))


@query(f"""WITH d AS (SELECT *, sha256('demo/' || filename || '|0') AS document_id FROM (SELECT s_suppkey AS i, s_name || '.pdf' AS filename, 4 + s_suppkey % 3 AS pages FROM supplier)),
f AS (SELECT * FROM ({sql_values(*DEMO_FINDINGS)}) v(page_number, issue_type, severity, location_hint))
SELECT filename, pages::INT AS page_count, TIMESTAMP '{DEMO_NOW}' - to_hours((i * 3 + 1)::INT) AS uploaded_at, TIMESTAMP '{DEMO_NOW}' - to_hours((i * 3)::INT) AS analyzed_at, sha256(document_id || '|0|' || page_number || '|' || issue_type) AS id,
  page_number::INT AS page_number, issue_type, severity, {sql_case("issue_type", ISSUE_TYPES, "issue_type")} || ': ' || location_hint AS description, location_hint FROM d CROSS JOIN f""", views=False)
def seed_suppliers(spark, sf_dir) -> DataFrame:
    """A reviewed demo document for each supplier, hours apart, each with the five demo findings: through the store with its checks, and read back."""
    store, now = ReviewStore(spark, f"{work_folder(spark)}/store"), F.lit(DEMO_NOW).cast("timestamp_ntz")
    ago = lambda hours: now - F.make_dt_interval(F.lit(0), hours.cast("int"))
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.concat("s_name", F.lit(".pdf")).alias("filename"))
    path = F.concat(F.lit("demo/"), "filename")
    review.add(store, docs.select(
        X.row_id(path, F.lit(0)).alias("id"), "filename", path.alias("file_path"), (4 + F.col("i") % 3).cast("int").alias("page_count"), F.lit("completed").alias("status"),
        ago(F.col("i") * 3 + 1).alias("uploaded_at"), ago(F.col("i") * 3).alias("analyzed_at")))
    found = values(spark, "page_number int, issue_type string, severity string, location_hint string", *DEMO_FINDINGS)
    rows = store.documents().select(F.col("id").alias("document_id")).crossJoin(F.broadcast(found))  # five fixed findings
    store.append_issues(rows.select(
        X.row_id(F.col("document_id"), F.lit(0), F.col("page_number"), F.col("issue_type")).alias("id"), "document_id", "page_number", "issue_type", "severity",
        F.concat(type_label(F.col("issue_type")), F.lit(": "), "location_hint").alias("description"), "location_hint", F.lit(None).cast("string").alias("raw_ocr_text"), now.alias("created_at"), F.lit(0).alias("run_id")))
    shown = store.documents().select(F.col("id").alias("document_id"), "filename", "page_count", "uploaded_at", "analyzed_at")
    return store.issues().join(shown, "document_id").drop("raw_ocr_text", "run_id", "document_id", "created_at")


PROBED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, CASE WHEN count(*) >= 0 THEN 'ready' END AS status, 'ok' AS error FROM {t}" for t in PROBED) + " UNION ALL SELECT 'absent', 'unavailable', 'AnalysisException'", views=False)
def readiness_tables(spark, sf_dir) -> DataFrame:
    """A probe of each table, and of one that is not there: ready, or unavailable with the error's class (its text follows in what ``readiness_of`` gives)."""
    rows = [(name, *readiness_of(lambda name=name: table(spark, sf_dir, name))) for name in (*PROBED, "absent")]
    return spark.createDataFrame([(n, s, e.split(":")[0]) for n, s, e in rows], "name string, status string, error string")
