"""Delimited text files: dialect detection over a folder, and an all-text reader."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.fixed_values import FILE_NULL_TOKENS
from tidemark.sources.records import quoted_records

DELIMITERS = [",", ";", "\t", "|"]

# Bytes 0x80-0x9F as Windows-1252 reads them; five of them it leaves undefined.
_HIGH = [bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)]
_LATIN = "".join(chr(0x80 + i) for i, c in enumerate(_HIGH) if c)
_WINDOWS = "".join(c for c in _HIGH if c)
_UNDEFINED = "[" + "".join(chr(0x80 + i) for i, c in enumerate(_HIGH) if not c) + "]"

_NEVER = "\x00"


def csv_dialects(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, sep) of each file below ``path``, as :func:`_files` finds them."""
    return _files(spark, path).select("path", "encoding", "sep")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, sep, header, broken) of each file below ``path``.

    Encoding: a byte-order mark, else UTF-8 if every line is, else Windows-1252 if no line holds a
    byte it leaves undefined, else Latin-1. All lines of a file are looked at, in splits, so a
    large file is not read by one task. Separator: the one found equally often, and most often, in
    each of the first ten lines that are not blank; else the most frequent in the first line.
    Header: the first line that is not blank, as Latin-1. Broken: whether a line leaves a quote open.
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    opening = (F.col("block") == 0) & (F.trim(F.col("value")) != "")
    start = F.struct(F.col("at"), F.hex(F.substring(F.col("value").cast("binary"), 1, 3)).alias("b"))
    files = raw.groupBy("path").agg(
        F.min(F.when(F.col("block") == 0, start))["b"].alias("mark"),
        F.min(F.is_valid_utf8("value").cast("int")).alias("utf8"),
        F.max(latin.rlike(_UNDEFINED).cast("int")).alias("undefined"),
        F.max((F.length(latin) - F.length(F.replace(latin, F.lit('"'), F.lit("")))) % 2 == 1).alias("broken"),
    )
    mark = F.col("mark")
    encoding = (
        F.when(mark.startswith("EFBBBF"), "utf-8-sig")
        .when(mark.startswith("FFFE"), "utf-16-le")
        .when(mark.startswith("FEFF"), "utf-16-be")
        .when(F.col("utf8") == 1, "utf-8-sig")
        .when(F.col("undefined") == 0, "cp1252")
        .otherwise("latin-1")
    )
    line = Window.partitionBy("path").orderBy("at")
    head = raw.where(opening).withColumn("n", F.row_number().over(line)).where("n <= 10")
    bare = F.regexp_replace(latin, '"[^"]*"', "")

    def times(sep: str) -> Column:
        return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))

    counted = head.groupBy("path").agg(
        F.max(F.when(F.col("n") == 1, latin)).alias("header"),
        *[
            fold(value).alias(f"{name}{i}")
            for i, sep in enumerate(DELIMITERS)
            for name, fold, value in (
                ("lo", F.min, times(sep)),
                ("hi", F.max, times(sep)),
                ("head", F.max, F.when(F.col("n") == 1, times(sep))),
            )
        ]
    )
    steady = [
        F.struct(
            F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise(0).alias("n"),
            F.lit(-i).alias("first"),
            F.lit(sep).alias("sep"),
        )
        for i, sep in enumerate(DELIMITERS)
    ]
    frequent = [
        F.struct(F.col(f"head{i}").alias("n"), F.lit(-i).alias("first"), F.lit(sep).alias("sep"))
        for i, sep in enumerate(DELIMITERS)
    ]
    sep = F.when(F.greatest(*steady)["n"] > 0, F.greatest(*steady)["sep"]).otherwise(
        F.greatest(*frequent)["sep"]
    )
    return files.join(counted, "path", "left").select(
        "path", encoding.alias("encoding"), F.coalesce(sep, F.lit(",")).alias("sep"), "header", "broken"
    )


def csv_source(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    encoding: str = "utf-8-sig",
    multiline: bool = False,
) -> DataFrame:
    """Every column as text. Short lines are padded with null, longer ones than the header skipped.

    Windows-1252 is read as Latin-1 and its own characters are then mapped, which needs no session
    setting. Undecodable bytes become the replacement character. With ``multiline``, values in
    quotes may hold line breaks, and large files are still read in splits; only UTF-16 files are
    then read whole. :func:`csv_line_counts` says how many lines were skipped.
    """
    names, rows = _parsed(spark, path, sep, encoding, multiline)
    plain = _plain(encoding)
    return rows.where("_fits").select(
        *[_present(_decoded(F.col(f"c{i}"), plain)).alias(name) for i, name in enumerate(names)]
    )


def csv_line_counts(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    encoding: str = "utf-8-sig",
    multiline: bool = False,
) -> DataFrame:
    """One row: records below the headers, and of them read, padded and skipped for their length."""
    _, rows = _parsed(spark, path, sep, encoding, multiline)
    return rows.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("_fits").alias("read"),
        F.count_if(F.col("_fits") & F.col("_line").isNotNull()).alias("padded"),
        F.count_if(~F.col("_fits")).alias("skipped"),
    )


def _plain(encoding: str) -> str:
    return encoding.lower().replace("_", "-")


def _parsed(
    spark: SparkSession, path: str | list[str], sep: str, encoding: str, multiline: bool
) -> tuple[list[str], DataFrame]:
    """The column names, and all lines as c0, c1, ... with ``_line`` (text of a line of the wrong length) and ``_fits``.

    The separators outside quotes tell long lines from short ones.
    """
    plain = _plain(encoding)
    charset = {
        "cp1252": "ISO-8859-1",
        "latin-1": "ISO-8859-1",
        "iso-8859-1": "ISO-8859-1",
        "utf-16-le": "UTF-16LE",
        "utf-16-be": "UTF-16BE",
    }.get(plain, "UTF-8")
    wide = charset.startswith("UTF-16")
    options = {
        "sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line",
        "nullValue": _NEVER, "emptyValue": "",
        "columnPruning": False,  # a line of the wrong length shows only if all of it is parsed
    }

    def reader():
        return spark.read.options(**options, encoding=charset, header=True, multiLine=multiline or wide)

    found = reader().option("inferSchema", False).csv(path).columns
    names = [_decoded_name(name, plain) for name in found]
    schema = ", ".join(f"c{i} string" for i in range(len(names))) + ", _line string"
    if multiline and not wide:
        record = F.col("record")
        trimmed = F.when(F.substring(record, -1, 1) == F.lit(b"\r"), F.substring(record, 1, F.length(record) - 1))
        record = F.coalesce(trimmed, record)
        text = F.decode(record, charset) if charset != "UTF-8" else F.make_valid_utf8(record.cast("string"))
        records = quoted_records(spark, path, sep).where("not first")
        rows = records.select(F.from_csv(text, schema, options).alias("r")).select("r.*")
    else:
        rows = reader().option("enforceSchema", True).schema(schema).csv(path)
    line, last = F.col("_line"), F.col(f"c{len(names) - 1}")
    bare = F.regexp_replace(line, '"[^"]*"', "")
    separators = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))
    return names, rows.withColumn("_fits", line.isNull() | (last.isNull() & (separators < len(names))))


def _decoded_name(name: str, encoding: str) -> str:
    """A header name without a byte-order mark, however the reader saw it."""
    name = name.removeprefix("\ufeff").removeprefix("\u00ef\u00bb\u00bf").strip()
    return name.translate(str.maketrans(_LATIN, _WINDOWS)) if encoding == "cp1252" else name


def _decoded(text: Column, encoding: str) -> Column:
    return F.translate(text, _LATIN, _WINDOWS) if encoding == "cp1252" else text


def _present(text: Column) -> Column:
    return F.when(~text.isin(FILE_NULL_TOKENS), text)


def csv_folder(spark: SparkSession, path: str) -> DataFrame:
    """All files below ``path``, each read in its own dialect and under its own header, as one table.

    Files are grouped by dialect and header, so there are as many reads as kinds of files, however
    many files there are. All are read in splits but for UTF-16 files with line breaks inside
    quotes. Columns are matched by name; those that a file lacks are null. The driver learns the
    paths, which it lists for every read anyway, and nothing else of the files.
    """
    kinds: dict[tuple, list[str]] = {}
    for row in _files(spark, path).collect():
        kinds.setdefault((row["encoding"], row["sep"], row["header"] or "", row["broken"]), []).append(row["path"])
    parts = [
        csv_source(spark, sorted(paths), sep, encoding, multiline=broken)
        for (encoding, sep, _, broken), paths in sorted(kinds.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
