"""Model replies to findings: fence removal, JSON repair, validation. Expressions and ``LATERAL variant_explode`` only.

A reply is parsed once, its items come out as rows of a table-valued function, and each field is a typed path of its item; nothing runs as an
interpreted lambda over lists. Values that JSON does not know but models write (``NaN``, ``Infinity``) are marked before the parse, outside strings only, so they lose nothing
but themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import ISSUE_TYPES, LOG_PREFIX, SEVERITIES

#: Stands before the name of a bare value that JSON does not know, in a string of its own.
MARK = "\u0001"
BARE = {"NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"}
FIELDS = ("severity", "issue_type", "description", "location_hint")
#: A table that is planned below so many bytes for each core is dealt to all cores before it is parsed, whatever its files.
SMALL = 64 << 20


def allow_repeated_keys(spark: SparkSession) -> None:
    """In JSON objects of replies, the last of equal keys counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores if they are few bytes by the plan's own measure: parsing is bound by cores, and one file may be one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size <= SMALL * cores else rows


def marked(text: Column) -> Column:
    """A text with bare ``NaN`` and ``Infinity`` as marked strings; strings are passed over as a whole."""
    skipped = r'\G((?:[^"NI-]++|"(?:[^"\\]++|\\.)*+"|-(?!Infinity))*+)(NaN|-?Infinity)'
    return F.when(text.contains("NaN") | text.contains("Infinity"), F.regexp_replace(text, skipped, r'$1"\\u0001$2"')).otherwise(text)


def get(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """A VARIANT's type by name."""
    return F.schema_of_variant(value)


def parsed(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Replies with ``items`` (a VARIANT list, or null) and ``state``: ok, unparseable, wrong_type, failed.

    A reply is its one JSON value; text after it makes it unparseable. A list, or the list under ``issues`` of an object, has the items.
    """
    text = replies.withColumn("_text", X.without_fence(F.col(raw)))
    read = text.withColumn("_every", F.try_parse_json(F.concat(F.lit("["), marked(F.col("_text")), F.lit("]"))))
    read = read.withColumns({"_one": F.when(get(F.col("_every"), "$[1]").isNull(), get(F.col("_every"), "$[0]")), "_first": F.substring("_text", 1, 1)})
    read = read.withColumn("_issues", F.when(F.col("_first") == "{", get(F.col("_one"), "$.issues")))
    issues = F.col("_issues")
    listed = get(issues, "$[0]").isNotNull() | F.startswith(F.coalesce(F.when(issues.isNotNull(), kind(issues)), F.lit("")), F.lit("ARRAY"))
    state = (
        F.when(F.col("_one").isNull(), "unparseable")
        .when(F.col("_first") == "[", "ok")
        .when(F.col("_first") != "{", "wrong_type")
        .when(issues.isNull() | listed, "ok")
        .when(F.startswith(kind(issues), F.lit("OBJECT")) | ((kind(issues) == "STRING") & ~F.startswith(F.try_variant_get(issues, "$", "string"), F.lit(MARK))), "ok")
        .otherwise("failed")
    )
    items = F.when(F.col("_first") == "[", F.col("_one")).when(listed, issues)
    return read.withColumns({"state": state, "items": F.when(F.col("_one").isNotNull(), items)}).drop("_text", "_every", "_one", "_first", "_issues")


def float_text(number: Column) -> Column:
    """A double as a script writes it: the shortest digits, an exponent below -4 and from 16 on."""
    shown = F.abs(number).cast("string")
    mantissa, e = F.split(shown, "E")[0], F.coalesce(F.try_element_at(F.split(shown, "E"), F.lit(2)).cast("int"), F.lit(0))
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=.)0+$", "")
    many = F.length(digits)
    plain = F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)).when(many > e + 1, F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, many))).otherwise(F.concat(F.rpad(digits, e + 1, "0"), F.lit(".0")))
    mark = F.concat(F.when(many > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), many))).otherwise(digits), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    text = F.when(~shown.contains("E"), shown).when((e >= -4) & (e < 16), plain).otherwise(mark)
    return F.concat(F.when(number < 0, "-").otherwise(""), text)


def nested_text(json: Column) -> Column:
    """An object or a list as a script shows it, from its JSON text (keys in alphabetical order)."""

    def token(t: Column) -> Column:
        inner = F.try_variant_get(F.try_parse_json(t), "$", "string")
        body = F.replace(F.replace(F.replace(F.replace(inner, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
        quoted = F.when(inner.contains("'") & ~inner.contains('"'), F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
        words = F.when(t == "true", "True").when(t == "false", "False").when(t == "null", "None").when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)
        return F.when(F.startswith(inner, F.lit(MARK)), bare_text(inner)).when(F.startswith(t, F.lit('"')), quoted).otherwise(words)

    return F.array_join(F.transform(F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*"|[,:\[\]{}]|[^",:\[\]{}]+'), F.lit(0)), token), "")


def bare_text(marked: Column) -> Column:
    out = marked
    for name, shown in BARE.items():
        out = F.when(marked == MARK + name, shown).otherwise(out)
    return out


def as_text(field: Column) -> Column:
    """A field as text: missing is empty, JSON null the word None, truth values and numbers as a script writes them.

    What is no string is rare and takes many steps; these stand in a function of their own, so that the code made for strings stays small.
    """

    def rare(v: Column) -> Column:
        what, text = kind(v), F.try_variant_get(v, "$", "string")
        return (
            F.when(F.is_variant_null(v), "None")
            .when(F.startswith(text, F.lit(MARK)), bare_text(text))
            .when(what == "BOOLEAN", F.initcap(text))
            .when((what == "DOUBLE") | F.rlike(what, F.lit(r"^DECIMAL\(\d+,[1-9]|^DECIMAL\(\d,0|^DECIMAL\(1\d,0")), float_text(F.try_variant_get(v, "$", "double")))
            .when(F.startswith(what, F.lit("OBJECT")) | F.startswith(what, F.lit("ARRAY")), nested_text(F.to_json(v)))
            .otherwise(text)
        )

    text = F.try_variant_get(field, "$", "string")
    plain = (kind(field) == "STRING") & ~F.startswith(text, F.lit(MARK))
    return F.when(field.isNull(), "").when(plain, text).otherwise(X.let(field, rare))


def findings(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """One row for each valid item: the replies' columns, ``pos``, and the four fields.

    Items that are no objects have no fields; those, and items whose severity, type or description is not valid, are left out.
    """
    keep = [c for c in replies.columns if c != raw]
    read = parsed(spread(replies), raw)  # no filter on items, which would be copied below with the whole parse: a null list has no rows
    rows = read.lateralJoin(read.sparkSession.tvf.variant_explode(F.col("items").outer())).where("key IS NULL")
    fields = rows.select(*keep, F.col("pos").cast("long").alias("pos"), *(get(F.col("value"), f"$.{c}").alias(f"_{c}") for c in FIELDS))
    severity, kind_, description = (X.strip(as_text(F.col(f"_{c}"))) for c in FIELDS[:3])
    severity, kind_ = F.lower(severity), F.replace(F.lower(kind_), F.lit(" "), F.lit("_"))
    valid = severity.isin(*SEVERITIES) & kind_.isin(*ISSUE_TYPES) & (F.length(description) > 0)
    # valid items are exploded from a list of one, and outer: filters on them would be copied below with all that they compute
    shown = F.struct(severity.alias("severity"), kind_.alias("issue_type"), description.alias("description"), location(F.col("_location_hint")).alias("location_hint"))
    return fields.select(*keep, "pos", F.inline_outer(F.when(valid, F.array(shown)))).where("severity IS NOT NULL")


def location(field: Column) -> Column:
    """The hint as text; null where it is missing, null, 0, false, an empty list or object, or blank."""
    text = as_text(field)
    empty = field.isNull() | F.is_variant_null(field) | (text.isin("0", "0.0", "-0.0", "False", "[]", "{}") & (kind(field) != "STRING"))
    return F.when(~empty, X.empty_to_null(X.strip(text)))


def rejects(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Replies that are no list and no object of findings, with the start of their text for a log."""
    keep = [c for c in replies.columns if c != raw]
    bad = parsed(spread(replies), raw).where("state <> 'ok'")
    return bad.select(*keep, "state", F.substring(X.without_fence(F.col(raw)), 1, LOG_PREFIX).alias("start"))


def second_check(rows: DataFrame) -> DataFrame:
    """The check before storing: unknown types go, unknown severities become low. After ``findings`` it changes nothing."""
    known = rows.where(F.col("issue_type").isin(*ISSUE_TYPES))
    return known.withColumn("severity", F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("low"))
