"""CSV text flattened to ``Row n: column: value`` lines, inside the row.

``spark.read.csv`` pads ragged rows and drops blank lines, which changes the
flattened text, so records and cells are cut with quote-aware expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.functions.once import named
from docwarden.functions.text import first_chars

SAMPLE_CHARS = 2_048
DELIMITERS = (",", ";", "\t", "|")

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'


def infer_delimiter(text: Column, chars: int | None = SAMPLE_CHARS) -> Column:
    """The delimiter of the header line that most sample lines agree on.

    A delimiter gets one vote per sample line that holds it as often as the
    header does. Most votes win, then the higher count, then the order
    ``, ; tab |``; when the header holds none the answer is a comma. Quoted
    stretches do not count, nor does a last line that the sample of the first
    ``chars`` characters (None: the whole text) cuts off.
    """
    sample = F.regexp_replace(first_chars(text, chars), r'"[^"]*"', "")
    lines = F.filter(F.split(sample, r"\r\n|\n|\r", -1), lambda s: s != "")
    cut = F.lit(False) if chars is None else F.length(text) > chars

    def whole(found: Column) -> Column:
        return F.when(cut & (F.size(found) > 1), F.slice(found, 1, F.size(found) - 1)).otherwise(found)

    def vote(found: Column, delimiter: str, rank: int) -> Column:
        counts = F.transform(
            found,
            lambda s: F.length(s) - F.length(F.replace(s, F.lit(delimiter), F.lit(""))),
        )

        def headed(counts: Column) -> Column:
            return F.struct(
                counts.alias("counts"),
                F.coalesce(F.try_element_at(counts, F.lit(1)), F.lit(0)).alias("head"),
            )

        def voted(x: Column) -> Column:
            agree = F.size(F.filter(x["counts"], lambda n: n == x["head"]))
            return F.struct(
                F.when(x["head"] > 0, agree).otherwise(0).alias("votes"), x["head"].alias("n"),
                F.lit(-rank).alias("rank"), F.lit(delimiter).alias("d"),
            )

        return named(named(counts, headed), voted)

    def elected(found: Column) -> Column:
        best = F.array_max(F.array(*[vote(found, d, i) for i, d in enumerate(DELIMITERS)]))
        return named(best, lambda b: F.when(b["votes"] > 0, b["d"]).otherwise(","))

    # Each step is named: a lambda would work out what it uses anew for every element.
    return named(named(lines, whole), elected)


def _class(delimiter: Column, extra: str) -> Column:
    return F.concat(F.lit("[^"), _escaped(delimiter), F.lit(extra + "]"))


def _escaped(delimiter: Column) -> Column:
    return F.concat(F.lit("\\"), F.when(delimiter == "\t", F.lit("t")).otherwise(delimiter))


def _field(delimiter: Column) -> Column:
    """Regex of one cell: quoted (with anything up to the delimiter after it) or plain."""
    rest = _class(delimiter, r"\r\n")
    return F.concat(
        F.lit(f'(?:{_QUOTED}(?:"'), rest, F.lit(r'*+|\z)|(?!")'), rest, F.lit("*+)")
    )


def csv_records(text: Column, delimiter: Column) -> Column:
    """array<string>: raw records; newlines inside quotes do not end a record."""
    field = _field(delimiter)
    record = F.concat(
        F.lit("("), field, F.lit("(?:"), _escaped(delimiter), field, F.lit(r")*+)(?:\r\n|\n|\r|\z)")
    )
    found = F.regexp_extract_all(text, record)
    # The end of the text always matches once more as an empty record.
    return F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))


def csv_cells(record: Column, delimiter: Column) -> Column:
    """array<string>: unquoted cells; a blank record has none."""
    # With a delimiter in front of every cell no match is empty.
    raw = F.regexp_extract_all(
        F.concat(delimiter, record),
        F.concat(_escaped(delimiter), F.lit("("), _field(delimiter), F.lit(")")),
    )

    def unquote(cell: Column) -> Column:
        inner = F.replace(
            F.regexp_extract(cell, f"^({_QUOTED})", 1).substr(F.lit(2), F.length(cell)),
            F.lit('""'), F.lit('"'),
        )
        after = F.regexp_extract(cell, f'(?s)^{_QUOTED}"(.*)\\z', 1)
        return F.when(F.startswith(cell, F.lit('"')), F.concat(inner, after)).otherwise(cell)

    return F.when(record == "", F.array().cast("array<string>")).otherwise(
        F.transform(raw, unquote)
    )


def flatten_csv(text: Column, delimiter: Column) -> Column:
    """struct<text, rows, columns, lines>: one labelled line per data row."""
    records = F.transform(
        csv_records(text, delimiter), lambda r: F.struct(csv_cells(r, delimiter).alias("cells"))
    )

    def build(rows: Column) -> Column:
        header = F.element_at(rows, 1)["cells"]

        def line(row: Column, n: Column) -> Column:
            pairs = F.transform(
                row["cells"],
                lambda v, i: F.concat(
                    F.coalesce(
                        F.nullif(F.try_element_at(header, i + 1), F.lit("")),
                        F.concat(F.lit("column_"), (i + 1).cast("string")),
                    ),
                    F.lit(": "), v,
                ),
            )
            return F.concat(
                F.lit("Row "), (n + 1).cast("string"), F.lit(": "), F.array_join(pairs, "; ")
            )

        body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
        lines = F.when(F.size(rows) == 1, F.array(F.array_join(header, "; "))).otherwise(body)
        return named(lines, lambda listed: F.struct(
            F.array_join(listed, "\n").alias("text"), (F.size(rows) - 1).alias("rows"),
            F.size(header).alias("columns"), listed.alias("lines"),
        ))

    empty = F.struct(
        F.lit("").alias("text"), F.lit(0).alias("rows"), F.lit(0).alias("columns"),
        F.array().cast("array<string>").alias("lines"),
    )
    return F.element_at(
        F.transform(
            F.array(records), lambda rows: F.when(F.size(rows) > 0, build(rows)).otherwise(empty)
        ), 1,
    )


def csv_row_documents(files: DataFrame) -> DataFrame:
    """One document per CSV row, for files too long to scan as one text.

    ``files``: doc_id, content_text. Opt-in: a pattern that would run across a
    row end cannot match here.
    """
    flat = files.withColumn("_d", infer_delimiter(F.col("content_text"))).withColumn(
        "_flat", flatten_csv(F.col("content_text"), F.col("_d"))
    )
    rows = flat.select("doc_id", F.posexplode_outer("_flat.lines").alias("i", "text"))
    return rows.where(F.col("text").isNotNull()).select(
        "doc_id", (F.col("i") + 1).alias("row_no"), "text"
    )
