"""Column functions of document review. All are built-in expressions; none runs Python on rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters that count as white space at the ends of a text.
SPACES = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())


def strip(col: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(col, F.lit(SPACES))


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it.

    The optimizer copies an expression to each place that uses it when it merges projections or pushes
    filters down; a lambda's variable is not copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def without_fence(col: Column) -> Column:
    """A reply without a surrounding code fence; an opening fence need not be closed."""

    def opened(text: Column) -> Column:
        return let(F.slice(F.split(text, "\n"), 2, 1_000_000_000), inner)

    def inner(lines: Column) -> Column:
        closed = (F.size(lines) > 0) & (strip(F.try_element_at(lines, F.lit(-1))) == "```")
        return strip(F.array_join(F.when(closed, F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines), "\n"))

    return let(strip(F.coalesce(col, F.lit(""))), lambda text: F.when(F.startswith(text, F.lit("```")), opened(text)).otherwise(text))


def extension(filename: Column) -> Column:
    """After the last dot, in lower case; the whole name if it has none."""
    return F.element_at(F.split(F.lower(filename), "[.]"), -1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def accepted_upload(content_type: Column, filename: Column, n_bytes: Column, limit: int) -> Column:
    """By content type or extension, and of at most ``limit`` bytes."""
    kind = F.coalesce(content_type, F.lit("")).isin("application/pdf", "application/octet-stream") | (extension(F.coalesce(filename, F.lit(""))) == "pdf")
    return kind & (n_bytes <= limit)


def accepted_by_client(filename: Column, n_bytes: Column, limit: int) -> Column:
    return F.endswith(F.lower(filename), F.lit(".pdf")) & (n_bytes <= limit)


def blob_name(doc_id: Column, filename: Column) -> Column:
    return F.concat_ws("_", doc_id.cast("string"), base_name(F.coalesce(empty_to_null(filename), F.lit("upload.pdf"))))


def export_name(filename: Column) -> Column:
    return F.concat(F.regexp_replace(filename, r"(?i)\.pdf$", ""), F.lit("_issues.csv"))


def quoted(col: Column) -> Column:
    """A CSV field that is always quoted, quotes doubled; null is the empty text."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(col, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n != 1, "s").otherwise(""))


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy, hh:mm a")


def long_date(ts: Column) -> Column:
    return F.date_format(ts, "MMMM d, yyyy 'at' hh:mm a")


def row_id(*parts: Column) -> Column:
    """An id that a retry of the task gives again, unlike a random one."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def origins(col: Column) -> Column:
    """A comma-separated list, trimmed, without empty items."""
    return F.filter(F.transform(F.split(col, ","), lambda x: F.trim(x)), lambda x: x != "")


def origin_allowed(col: Column) -> Column:
    """Hosting domains whose sites may call the service."""
    return F.regexp_like(col, F.lit(r"^https://(.*\.onrender\.com|.*\.vercel\.app)$"))


def describe_url(url: Column) -> Column:
    """Whether a database URL is of the managed host, its pooler, and the pooler's transaction mode.

    Fixed values: the host names and the port that tell them apart.
    """
    pooler = F.contains(url, F.lit("pooler.supabase.com"))
    return F.struct(
        (F.contains(url, F.lit("supabase.co")) | pooler).alias("managed"),
        pooler.alias("pooler"),
        (pooler & F.contains(url, F.lit(":6543"))).alias("transaction_mode"),
        F.regexp_like(url, F.lit(r"@db\.[a-z0-9]+\.supabase\.co")).alias("direct"),
    )


def installed_driver(url: Column) -> Column:
    """The first ``+asyncpg`` becomes ``+psycopg``."""
    at = F.instr(url, "+asyncpg")
    return F.when(at > 0, F.concat(F.substring(url, F.lit(1), at - 1), F.lit("+psycopg"), F.substring(url, at + 8, F.length(url)))).otherwise(url)


def connect_args(url: Column) -> Column:
    """Connection settings that follow from the URL."""
    u = describe_url(url)
    base = F.create_map(F.lit("connect_timeout"), F.lit("10"))
    ssl = F.when(u["managed"], F.create_map(F.lit("sslmode"), F.lit("require"))).otherwise(F.create_map().cast("map<string,string>"))
    prepare = F.when(u["transaction_mode"], F.create_map(F.lit("prepare_threshold"), F.lit("none"))).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(base, ssl, prepare)


#: The request for one page; ``%s`` take the page, the number of pages and the page's text.
PROMPT = "Review page %s of %s of a drawing set. Text found on the page:\n%s\nAnswer with JSON: {\"issues\": [...]}."


def prompt(page: Column, pages: Column, ocr_text: Column) -> Column:
    return F.format_string(PROMPT, page.cast("string"), pages.cast("string"), F.coalesce(empty_to_null(ocr_text), F.lit("(no text extracted)")))
