"""Every query of the review engine, and the SQL that an independent engine checks it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import listing as L
from ..operators import replies as R
from ..operators import store as S
from ..schema import ISSUE_TYPES, MAX_PAGES, MAX_UPLOAD_BYTES, OCR_PREFIX, SEVERITY_COLOURS, STATUSES, severity_colour, severity_rank, status_label, type_label
from ..sources.tables import WITH_SQL, review_documents, review_issues, table, text_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (WITH_SQL if views else "") + sql
        return f

    return add


def values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def sql_values(*rows: tuple) -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def sql_case(col: str, names: dict[str, str], other: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + f" ELSE {other} END"


# Lists and details

#: What a document shows of itself in lists and details.
DOCUMENT = ("id", "filename", "file_path", "page_count", "status", "uploaded_at", "analyzed_at", "issue_count")


@query("""SELECT d.*, coalesce(c.cnt, 0)::BIGINT AS issue_count, row_number() OVER (ORDER BY uploaded_at DESC NULLS LAST, d.id)::BIGINT AS pos
FROM docs d LEFT JOIN (SELECT document_id, count(id) AS cnt FROM issues GROUP BY 1) c ON c.document_id = d.id""")
def document_list(spark, sf_dir):
    """Documents, newest first, with the number of their issues. ``pos`` shows the order: days are counted from the documents alone, places are inside a day."""
    docs = review_documents(spark, sf_dir).withColumn("day", F.to_date("uploaded_at"))
    days = docs.groupBy(F.col("day").alias("of")).agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc_nulls_last("of")).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = days.select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("later"))
    in_day = F.row_number().over(Window.partitionBy("day").orderBy(F.desc_nulls_last("uploaded_at"), "id"))
    rows = L.with_issue_count(docs, review_issues(spark, sf_dir).select("id", "document_id"))
    placed = rows.withColumn("_in", in_day).join(days, F.col("day").eqNullSafe(F.col("of")))
    return placed.select(*DOCUMENT, (F.col("_in") + F.col("later")).cast("long").alias("pos"))


DETAIL_ID = 42


@query(f"""SELECT d.*, (SELECT count(id) FROM issues WHERE document_id = {DETAIL_ID})::BIGINT AS issue_count FROM docs d WHERE d.id = {DETAIL_ID}""")
def document_detail(spark, sf_dir):
    issues = review_issues(spark, sf_dir).where(F.col("document_id") == DETAIL_ID).select("id", "document_id")
    return L.with_issue_count(review_documents(spark, sf_dir).where(F.col("id") == DETAIL_ID), issues).select(*DOCUMENT)


@query("SELECT count(*)::BIGINT AS total FROM docs")
def document_total(spark, sf_dir):
    return review_documents(spark, sf_dir).agg(F.count("*").alias("total"))


@query(f"SELECT * FROM issues WHERE document_id = {DETAIL_ID}")
def issues_for_document(spark, sf_dir):
    return review_issues(spark, sf_dir).where(F.col("document_id") == DETAIL_ID)


@query("SELECT i.* FROM issues i WHERE EXISTS (SELECT 1 FROM docs d WHERE d.id = i.document_id AND d.status <> 'processing')")
def issues_guarded(spark, sf_dir):
    """Lines meet the documents that may start before their texts are made, so the shuffle has no texts."""
    return review_issues(spark, sf_dir, review_documents(spark, sf_dir).where(S.may_start()))


@query("SELECT document_id, count(id)::BIGINT AS cnt FROM issues GROUP BY 1")
def issue_counts(spark, sf_dir):
    return L.issue_counts(review_issues(spark, sf_dir))


@query("""SELECT d.id, d.status, d.page_count, count(i.id)::BIGINT AS issues, count(i.id) FILTER (i.severity = 'high')::BIGINT AS high,
  string_agg(page_number || ':' || i.id || ':' || issue_type || ':' || description, '; ' ORDER BY page_number, i.id) AS listed
FROM docs d LEFT JOIN issues i ON i.document_id = d.id GROUP BY 1, 2, 3""")
def detail_page(spark, sf_dir):
    """Document, its issues by page and summary put together; a document without issues has zeros."""
    shown = F.concat_ws(":", F.col("page_number").cast("string"), "id", "issue_type", "description")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "id", shown.alias("shown")))), lambda x: x["shown"]), "; ")
    found = review_issues(spark, sf_dir).groupBy(F.col("document_id").alias("of")).agg(F.count("id").alias("issues"), F.count_if(F.col("severity") == "high").alias("high"), listed.alias("listed"))
    return review_documents(spark, sf_dir).select("id", "status", "page_count").join(found, F.col("id") == F.col("of"), "left").drop("of").na.fill(0, ["issues", "high"])


@query("""SELECT json_object('id', id, 'filename', filename, 'file_path', file_path, 'page_count', page_count, 'status', status, 'uploaded_at', strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S'),
  'analyzed_at', strftime(analyzed_at, '%Y-%m-%dT%H:%M:%S'), 'issue_count', (SELECT count(*) FROM issues i WHERE i.document_id = docs.id))::VARCHAR AS body FROM docs""")
def document_json(spark, sf_dir):
    """All fields of the documents as JSON, times in ISO form, null where there is none."""
    rows = L.with_issue_count(review_documents(spark, sf_dir), review_issues(spark, sf_dir).select("id", "document_id"))
    shown = rows.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in ("uploaded_at", "analyzed_at")})
    return shown.select(F.to_json(F.struct(*DOCUMENT), {"ignoreNullFields": "false"}).alias("body"))


@query("SELECT 1 AS ready", views=False)
def readiness(spark, sf_dir):
    return spark.sql("SELECT 1 AS ready")


# Summaries


@query("""SELECT document_id, 'total' AS kind, '' AS value, count(*)::BIGINT AS n FROM issues GROUP BY 1
UNION ALL SELECT document_id, 'severity', severity, count(*) FROM issues GROUP BY 1, 3 UNION ALL SELECT document_id, 'type', issue_type, count(*) FROM issues GROUP BY 1, 3""")
def issue_summary(spark, sf_dir):
    return L.summary(review_issues(spark, sf_dir))


@query("SELECT count(*)::BIGINT AS total FROM issues WHERE document_id = -1")
def issue_total_empty(spark, sf_dir):
    """A total over no rows is one row with 0."""
    return L.total(review_issues(spark, sf_dir).where("document_id = -1"))


@query("""SELECT document_id, p AS place, s AS severity, count(*) FILTER (severity = s)::BIGINT AS n
FROM issues, (VALUES (0::BIGINT, 'high'), (1, 'medium'), (2, 'low')) v(p, s) GROUP BY 1, 2, 3""")
def severity_zero_fill(spark, sf_dir):
    return L.zero_filled(review_issues(spark, sf_dir))


@query("SELECT issue_type, n, row_number() OVER (ORDER BY n DESC, issue_type)::BIGINT AS pos FROM (SELECT issue_type, count(*)::BIGINT AS n FROM issues GROUP BY 1)")
def type_histogram_ranked(spark, sf_dir):
    return L.type_histogram(review_issues(spark, sf_dir))


@query("SELECT document_id, issue_type, row_number() OVER (PARTITION BY document_id ORDER BY issue_type)::BIGINT AS pos FROM (SELECT DISTINCT document_id, issue_type FROM issues)")
def distinct_types(spark, sf_dir):
    kinds = review_issues(spark, sf_dir).select("document_id", "issue_type").distinct()
    return kinds.withColumn("pos", F.row_number().over(Window.partitionBy("document_id").orderBy("issue_type")).cast("long"))


@query("""SELECT document_id, string_agg(severity || '=' || n, ',' ORDER BY severity) AS by_severity FROM (SELECT document_id, severity, count(*) AS n FROM issues GROUP BY 1, 2) GROUP BY 1""")
def severity_map(spark, sf_dir):
    """The histogram as one map per document, shown as text."""
    counts = review_issues(spark, sf_dir).groupBy("document_id", "severity").agg(F.count("*").alias("n"))
    maps = counts.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("m"))
    return maps.select("document_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("by_severity"))


# Filters and sorts

SEVERITY, KIND = "high", "missing_tag"


@query(f"SELECT document_id, count(*)::BIGINT AS n FROM issues WHERE severity = '{SEVERITY}' AND issue_type = '{KIND}' GROUP BY 1")
def issues_filtered(spark, sf_dir):
    return L.filtered(review_issues(spark, sf_dir), SEVERITY, KIND).groupBy("document_id").agg(F.count("*").alias("n"))


@query("SELECT severity, count(*)::BIGINT AS n FROM issues GROUP BY 1")
def issues_unfiltered(spark, sf_dir):
    return L.filtered(review_issues(spark, sf_dir), "all", "all").groupBy("severity").agg(F.count("*").alias("n"))


@query(f"SELECT document_id, count(*) FILTER (severity = '{SEVERITY}')::BIGINT AS shown, count(*)::BIGINT AS total FROM issues GROUP BY 1")
def filtered_of_total(spark, sf_dir):
    return L.filtered_of_total(review_issues(spark, sf_dir), SEVERITY, "all")


def _sorted(by: str, first: str) -> str:
    return f"SELECT id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY {first}, page_number, id)::BIGINT AS pos FROM issues"


@query(_sorted("severity", "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"))
def issues_sorted_severity(spark, sf_dir):
    return L.sorted_position(review_issues(spark, sf_dir), "severity").select("id", "document_id", "pos")


@query(_sorted("page", "page_number"))
def issues_sorted_page(spark, sf_dir):
    return L.sorted_position(review_issues(spark, sf_dir), "page").select("id", "document_id", "pos")


@query(_sorted("type", "issue_type"))
def issues_sorted_type(spark, sf_dir):
    return L.sorted_position(review_issues(spark, sf_dir), "type").select("id", "document_id", "pos")


# Display


@query(f"""SELECT id, {sql_case("issue_type", ISSUE_TYPES, "issue_type")} AS label, {sql_case("severity", SEVERITY_COLOURS, "'green'")} AS colour, upper(severity) AS badge,
  CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END::INT AS rank FROM issues""")
def labels_and_badges(spark, sf_dir):
    rows = review_issues(spark, sf_dir)
    return rows.select("id", type_label(F.col("issue_type")).alias("label"), severity_colour(F.col("severity")).alias("colour"), F.upper("severity").alias("badge"), severity_rank(F.col("severity")).alias("rank"))


_ODD = (("processing",), ("failed",), ("unheard",), ("completed",), ("pending",))


@query(f"SELECT s AS status, {sql_case('s', STATUSES, repr('Pending'))} AS label, upper(s[1]) || s[2:] AS capital FROM ({sql_values(*_ODD)}) v(s)", views=False)
def status_labels(spark, sf_dir):
    """Unknown states show as pending."""
    return values(spark, "status string", *_ODD).select("status", status_label(F.col("status")).alias("label"), F.initcap("status").alias("capital"))


@query("""SELECT id, CASE WHEN n > 0 THEN n || ' issue' || CASE WHEN n <> 1 THEN 's' ELSE '' END WHEN status = 'completed' THEN 'No issues' ELSE '' END AS card, n > 0 AS can_export,
  CASE status WHEN 'completed' THEN 'rerun' WHEN 'failed' THEN 'retry' WHEN 'pending' THEN 'run' END AS action
FROM (SELECT d.id, d.status, count(i.id) AS n FROM docs d LEFT JOIN issues i ON i.document_id = d.id GROUP BY 1, 2)""")
def card_text(spark, sf_dir):
    rows = L.with_issue_count(review_documents(spark, sf_dir), review_issues(spark, sf_dir).select("id", "document_id"))
    return rows.select("id", L.card_text().alias("card"), (F.col("issue_count") > 0).alias("can_export"), S.action().alias("action"))


@query("SELECT event_id, strftime(ts, '%b %-d, %Y, %I:%M %p') AS short, strftime(ts, '%B %-d, %Y at %I:%M %p') AS long FROM events", views=False)
def dates_display(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.short_date(F.col("ts")).alias("short"), X.long_date(F.col("ts")).alias("long"))


# Export


@query("""SELECT document_id, id || ',' || page_number || ',' || issue_type || ',' || severity || ',"' || replace(description, '"', '""') || '","' || replace(coalesce(location_hint, ''), '"', '""') || '"' AS line FROM issues""")
def csv_lines(spark, sf_dir):
    return review_issues(spark, sf_dir).select("document_id", L.csv_line().alias("line"))


@query("""SELECT document_id, 'id,page_number,issue_type,severity,description,location_hint' || chr(10) || string_agg(line, chr(10) ORDER BY page_number, id, line) AS csv
FROM (SELECT document_id, page_number, id, id || ',' || page_number || ',' || issue_type || ',' || severity || ',"' || replace(description, '"', '""') || '","' || replace(coalesce(location_hint, ''), '"', '""') || '"' AS line FROM issues) GROUP BY 1""")
def csv_files(spark, sf_dir):
    return L.csv_files(review_issues(spark, sf_dir))


@query("SELECT id, regexp_replace(filename, '(?i)\\.pdf$', '') || '_issues.csv' AS name FROM docs")
def export_name(spark, sf_dir):
    return review_documents(spark, sf_dir).select("id", X.export_name(F.col("filename")).alias("name"))


# Pages


@query(f"SELECT doc_id, nullif(substr(text, 1, {OCR_PREFIX}), '') AS raw_ocr_text FROM documents", views=False)
def ocr_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.empty_to_null(F.substring("text", 1, OCR_PREFIX)).alias("raw_ocr_text"))


@query("SELECT document_id, page_number, count(*) OVER (PARTITION BY document_id)::BIGINT AS total_pages, length(ocr_text)::BIGINT AS n_chars FROM pages_")
def page_cap(spark, sf_dir):
    pages = text_pages(table(spark, sf_dir, "documents"), cap=MAX_PAGES)
    return pages.select("document_id", "page_number", F.count("*").over(Window.partitionBy("document_id")).alias("total_pages"), F.length("ocr_text").cast("long").alias("n_chars"))


@query("SELECT document_id, max(page_number)::BIGINT AS page_count FROM pages_ GROUP BY 1")
def page_count(spark, sf_dir):
    """Pages processed, not pages of the file."""
    return text_pages(table(spark, sf_dir, "documents"), cap=MAX_PAGES).groupBy("document_id").agg(F.max("page_number").alias("page_count"))


@query("""SELECT document_id, page_number, 'Review page ' || page_number || ' of ' || count(*) OVER (PARTITION BY document_id) || ' of a drawing set. Text found on the page:' || chr(10)
  || coalesce(nullif(ocr_text, ''), '(no text extracted)') || chr(10) || 'Answer with JSON: {"issues": [...]}.' AS prompt FROM all_pages""")
def prompt_text(spark, sf_dir):
    pages = text_pages(table(spark, sf_dir, "documents"))
    total = F.count("*").over(Window.partitionBy("document_id"))
    return pages.select("document_id", "page_number", X.prompt(F.col("page_number"), total, F.col("ocr_text")).alias("prompt"))


@query("SELECT document_id, page_number, base64(encode(ocr_text)) AS body FROM all_pages")
def page_base64(spark, sf_dir):
    pages = text_pages(table(spark, sf_dir, "documents"))
    return pages.select("document_id", "page_number", F.replace(F.base64(F.encode("ocr_text", "UTF-8")), F.lit("\r\n"), F.lit("")).alias("body"))


# Uploads, names, addresses

_UPLOADS = (("A.B.PDF", "text/plain", 52428800), ("a.txt", "application/octet-stream", 10), ("pdf", None, 1), ("x.", "text/html", 5), ("b.pdf", "application/pdf", 52428801), (None, "application/pdf", 7), ("dir/c.Pdf", "image/png", 0))


@query(f"""SELECT f AS filename, n AS n_bytes, (coalesce(t, '') IN ('application/pdf', 'application/octet-stream') OR list_extract(string_split(lower(coalesce(f, '')), '.'), -1) = 'pdf') AND n <= {MAX_UPLOAD_BYTES} AS accepted,
  coalesce(lower(f) LIKE '%.pdf' AND n <= {MAX_UPLOAD_BYTES}, false) AS by_client, list_extract(string_split(lower(f), '.'), -1) AS extension FROM ({sql_values(*_UPLOADS)}) v(f, t, n)""", views=False)
def type_check(spark, sf_dir):
    f, n = F.col("filename"), F.col("n_bytes")
    return values(spark, "filename string, content_type string, n_bytes int", *_UPLOADS).select(
        f, n, X.accepted_upload(F.col("content_type"), f, n, MAX_UPLOAD_BYTES).alias("accepted"), F.coalesce(X.accepted_by_client(f, n, MAX_UPLOAD_BYTES), F.lit(False)).alias("by_client"), X.extension(f).alias("extension"))


@query("""SELECT doc_id, filename, strlen(text) <= 4000 AND (kind = 'application/pdf' OR filename LIKE '%.pdf') AS accepted FROM (SELECT doc_id, text,
  doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' ELSE '.doc' END AS filename, CASE doc_id % 2 WHEN 0 THEN 'application/pdf' ELSE 'text/plain' END AS kind FROM documents)""", views=False)
def upload_filter(spark, sf_dir):
    """Every text as an upload, by name, content type and size."""
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".doc"))
    kind = F.when(F.col("doc_id") % 2 == 0, "application/pdf").otherwise("text/plain")
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("filename"), X.accepted_upload(kind, name, F.octet_length("text"), 4000).alias("accepted"))


@query("SELECT id, id || '_' || regexp_extract('up/' || filename, '[^/]*$') AS name FROM docs")
def blob_name(spark, sf_dir):
    return review_documents(spark, sf_dir).select("id", X.blob_name(F.col("id"), F.concat(F.lit("up/"), F.col("filename"))).alias("name"))


@query("SELECT document_id, page_number, sha256(document_id || '|' || 1 || '|' || page_number) AS id FROM all_pages")
def hash_id(spark, sf_dir):
    pages = text_pages(table(spark, sf_dir, "documents"))
    return pages.select("document_id", "page_number", X.row_id(F.col("document_id"), F.lit(1), F.col("page_number")).alias("id"))


_URLS = (
    ("postgresql+asyncpg://u:p@db.abc1.supabase.co:5432/x",),
    ("postgresql+psycopg://u:p@eu.pooler.supabase.com:5432/x",),
    ("postgresql+psycopg://u:p@eu.pooler.supabase.com:6543/x",),
    ("postgresql://u:p@localhost:6543/x?o=+asyncpg+asyncpg",),
)


@query(f"""SELECT u AS url, contains(u, 'supabase.co') OR contains(u, 'pooler.supabase.com') AS managed, contains(u, 'pooler.supabase.com') AS pooler,
  contains(u, 'pooler.supabase.com') AND contains(u, ':6543') AS transaction_mode, regexp_matches(u, '@db\\.[a-z0-9]+\\.supabase\\.co') AS direct, regexp_replace(u, '\\+asyncpg', '+psycopg') AS driver,
  (1 + (contains(u, 'supabase.co') OR contains(u, 'pooler.supabase.com'))::INT + (contains(u, 'pooler.supabase.com') AND contains(u, ':6543'))::INT)::INT AS n_args FROM ({sql_values(*_URLS)}) v(u)""", views=False)
def url_describe(spark, sf_dir):
    u = F.col("url")
    rows = values(spark, "url string", *_URLS).withColumn("d", X.describe_url(u))
    return rows.select("url", "d.*", X.installed_driver(u).alias("driver"), F.size(X.connect_args(u)).alias("n_args"))


_ORIGINS = ((" https://a.onrender.com, ,http://b.example ,",), ("",), ("https://x.vercel.app,https://vercel.app",))


@query(f"""SELECT o AS given, x AS origin, regexp_full_match(x, 'https://(.*\\.onrender\\.com|.*\\.vercel\\.app)') AS allowed
FROM (SELECT o, unnest(list_filter(list_transform(string_split(o, ','), lambda x: trim(x)), lambda x: x <> '')) AS x FROM ({sql_values(*_ORIGINS)}) v(o))""", views=False)
def origin_list(spark, sf_dir):
    rows = values(spark, "given string", *_ORIGINS).select("given", F.explode(X.origins(F.col("given"))).alias("origin"))
    return rows.withColumn("allowed", X.origin_allowed(F.col("origin")))


_SPACES = (("\t  a b  \n", "a b"), ("\x1c\x1fx\x1d", "x"), ("　", ""), ("plain", "plain"), ("​z", "​z"))


@query("SELECT * FROM (" + sql_values(*((a.encode().hex(), b) for a, b in _SPACES)) + ") v(given, stripped)", views=False)
def unicode_strip(spark, sf_dir):
    rows = values(spark, "given string, expected string", *_SPACES)
    return rows.select(F.lower(F.hex(F.encode("given", "UTF-8"))).alias("given"), X.strip(F.col("given")).alias("stripped"))


_PADS = tuple(" \t\n\x1c\u00a0\u3000")


@query("SELECT p_partkey, p_name AS name, 'a b' AS inner_ FROM part", views=False)
def strip_column(spark, sf_dir):
    """Names with white space put around them, stripped again; white space inside stays."""
    pads = F.array(*map(F.lit, _PADS))
    pad = lambda n: F.element_at(pads, (F.pmod(F.col("p_partkey") * n, F.lit(len(_PADS))) + 1).cast("int"))
    around = lambda c: F.concat(pad(1), pad(5), c, pad(7), pad(3))
    return table(spark, sf_dir, "part").select("p_partkey", X.strip(around(F.col("p_name"))).alias("name"), X.strip(around(F.lit("a b"))).alias("inner_"))


# Replies

_ITEM = '{"issue_type":"Missing Tag","severity":" HIGH ","description":"d %s","location_hint":"grid"}'
#: (template with the event's id as %s, expected state)
_REPLIES = (
    ('{"issues":[' + _ITEM + "]}", "ok"),
    ('```json\n{"issues":[' + _ITEM + "]}\n```", "ok"),
    ("[" + _ITEM + ', {"severity":"critical","issue_type":"missing_tag","description":"x"}, 7, "s", null]', "ok"),
    ("not json %s", "unparseable"),
    ('{"issues":null, "n":%s}', "failed"),
    ('{"other":%s}', "ok"),
    ("%s", "wrong_type"),
    ('```\n{"issues":[{"issue_type":"missing_scale","severity":"low","description":" s%s ","location_hint":0}]}', "ok"),
)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    R.allow_repeated_keys(spark)
    raw = F.lit(None).cast("string")
    for i, (text, _) in enumerate(_REPLIES):
        raw = F.when(F.col("event_id") % len(_REPLIES) == i, F.replace(F.lit(text), F.lit("%s"), F.col("event_id").cast("string"))).otherwise(raw)
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


@query("""SELECT event_id, 0::BIGINT AS pos, CASE event_id % 8 WHEN 7 THEN 'low' ELSE 'high' END AS severity, CASE event_id % 8 WHEN 7 THEN 'missing_scale' ELSE 'missing_tag' END AS issue_type,
  CASE event_id % 8 WHEN 7 THEN 's' || event_id ELSE 'd ' || event_id END AS description, CASE event_id % 8 WHEN 7 THEN NULL ELSE 'grid' END AS location_hint FROM events WHERE event_id % 8 IN (0, 1, 2, 7)""", views=False)
def reply_parse(spark, sf_dir):
    return R.second_check(R.findings(replies(spark, sf_dir)))


@query("""SELECT event_id, CASE event_id % 8 WHEN 3 THEN 'unparseable' WHEN 4 THEN 'failed' ELSE 'wrong_type' END AS state,
  CASE event_id % 8 WHEN 3 THEN 'not json ' || event_id WHEN 4 THEN '{"issues":null, "n":' || event_id || '}' ELSE event_id::VARCHAR END AS start FROM events WHERE event_id % 8 IN (3, 4, 6)""", views=False)
def reply_rejects(spark, sf_dir):
    return R.rejects(replies(spark, sf_dir))


# States


@query("SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS state, count(*)::BIGINT AS changes FROM events GROUP BY 1", views=False)
def current_state(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("changes"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1", views=False)
def latest_rows(spark, sf_dir):
    return S.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts").select("user_id", "event_id", "event_type")


@query("SELECT i.id, i.document_id FROM issues i WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.id = i.document_id AND d.status = 'pending')")
def deleted_anti(spark, sf_dir):
    gone = review_documents(spark, sf_dir).where("status = 'pending'").select(F.col("id").alias("document_id"))
    return S.without(review_issues(spark, sf_dir), gone, "document_id").select("id", "document_id")


@query("SELECT id, status <> 'processing' AS may_start FROM docs")
def conflict_409(spark, sf_dir):
    return review_documents(spark, sf_dir).select("id", S.may_start().alias("may_start"))


@query("""SELECT document_id, count(*)::BIGINT AS listed, count(*) FILTER (run_id = 2)::BIGINT AS new FROM (SELECT document_id, 1 AS run_id FROM issues UNION ALL SELECT document_id, 2 FROM issues WHERE severity = 'high') GROUP BY 1""")
def rerun_appends(spark, sf_dir):
    """A second run adds its findings to the first run's; the number shown for the run counts only its own."""
    first = review_issues(spark, sf_dir).select("document_id", "severity", F.lit(1).alias("run_id"))
    both = first.unionByName(first.where("severity = 'high'").withColumn("run_id", F.lit(2)))
    return both.groupBy("document_id").agg(F.count("*").alias("listed"), F.count_if(F.col("run_id") == 2).alias("new"))


@query("SELECT id, 'completed' AS status FROM docs WHERE id % 3 = 0 UNION ALL SELECT id, status FROM docs WHERE id % 3 <> 0 UNION ALL SELECT -id - 1, 'pending' FROM docs WHERE id % 100 = 0")
def upsert(spark, sf_dir):
    rows = review_documents(spark, sf_dir).select("id", "status")
    changed = rows.where("id % 3 = 0").withColumn("status", F.lit("completed"))
    new = rows.where("id % 100 = 0").select((-F.col("id") - 1).alias("id"), F.lit("pending").alias("status"))
    return S.upsert(rows, changed.unionByName(new), "id")


# Demo rows

DEMO_FILES = ((0, "tower_level_two.pdf", 4), (1, "pump_room_pipes.pdf", 6))
DEMO_FINDINGS = (
    (1, "missing_tag", "high", "beside the stair, axis 4"),
    (1, "dimension_mismatch", "high", "lift lobby, west wall"),
    (2, "missing_scale", "medium", "title field"),
    (2, "unlabeled_element", "medium", "valve group near the tank"),
    (3, "inconsistent_annotation", "low", "general notes, line 3"),
)
DEMO_NOW = "2024-01-05 15:07:00"


@query(f"""SELECT i::INT AS i, filename, page_count::INT AS page_count, page_number::INT AS page_number, issue_type, severity, location_hint, TIMESTAMP '{DEMO_NOW}' - to_hours(i * 3 + 1) AS uploaded_at, TIMESTAMP '{DEMO_NOW}' - to_hours(i * 3) AS analyzed_at
FROM ({sql_values(*DEMO_FILES)}) d(i, filename, page_count) CROSS JOIN ({sql_values(*DEMO_FINDINGS)}) f(page_number, issue_type, severity, location_hint)""", views=False)
def seed_cross(spark, sf_dir):
    """Two documents with five findings each: fixed rows, so a product of constants."""
    docs = values(spark, "i int, filename string, page_count int", *DEMO_FILES)
    found = values(spark, "page_number int, issue_type string, severity string, location_hint string", *DEMO_FINDINGS)
    now = F.lit(DEMO_NOW).cast("timestamp_ntz")
    ago = lambda n: now - F.make_dt_interval(F.lit(0), n)
    rows = docs.crossJoin(F.broadcast(found))
    return rows.select("i", "filename", "page_count", "page_number", "issue_type", "severity", "location_hint", ago(F.col("i") * 3 + 1).alias("uploaded_at"), ago(F.col("i") * 3).alias("analyzed_at"))
