"""Odd documents: nulls, empty and very long texts, repeated rows, and columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, salt int, label string, node long, `_id` long"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, None, "en", "src1", 0),
    (2, "", None, None, 0),
    (3, "   \n\t ", "en", "src1", 5),
    (4, "one", "en", "src2", 3),
    (5, "one", "en", "src2", 3),
    (5, "one", "en", "src2", 3),
    (6, "one two three four five six seven eight nine ten", None, "odd", 10),
    (7, "one two three four five six seven eight nine ten", "en", "src0", 10),
    (8, LONG, "en", "src0", len(LONG)),
    (9, LONG + " more", "en", "src0", len(LONG)),
    (None, "no id here at all", "de", "src3", 1),
    (10, "日本語 \U0001f600 \u0000 x", "ja", "src4", 1),
    (11, "12345 67890 !!! ###", "en", "src4", 1),
]


def documents(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, 0.5, 1, "x", 3, 4) for r in rows], SCHEMA)


def labels(spark, rows=((4, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (4, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


