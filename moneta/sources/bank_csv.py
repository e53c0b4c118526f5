"""Bank-statement CSV import.

Rules, per file: UTF-8 if every line is valid UTF-8, else Latin-1; separator
',', ';' or TAB (first giving more than one column); column names lower-cased and trimmed; first alias present wins; amount text with ','
-> '.', 'R$' removed, trimmed, parsed; > 0 is a credit, otherwise a debit (0
too); value = |amount|; category 'outros'; a missing description column gives
'Sem descrição'.  Unparseable amounts do not fail the load: those rows go to a
rejects frame.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES — column aliases, first present wins
DATE_ALIASES = ["data", "date", "dt", "data_lancamento"]
DESC_ALIASES = ["descricao", "description", "historico", "desc", "lancamento"]
VALUE_ALIASES = ["valor", "value", "amount", "vlr"]
SEPARATORS = [",", ";", "\t"]
NO_DESCRIPTION = "Sem descrição"


@dataclass
class CsvImport:
    rows: DataFrame     # data, descricao, valor, tipo, categoria_sugerida, date (parsed)
    rejects: DataFrame  # rows whose amount text did not parse


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines that aren't blank: file, bytes, and the line's number in the scan."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("_bytes"), F.is_valid_utf8("value").alias("_valid"),
        # a file's first block lies in one partition, whose rows count upwards
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("_at"),
        (F.btrim("value") == "").alias("_blank")).filter(~F.col("_blank")).drop("_blank")


def file_layouts(lines: DataFrame, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """One row per file: encoding, sep, header and the header's line number.  The lines are reduced
    per file before the shuffle; a file without lines has no layout."""
    files = lines.groupBy("file").agg(F.every("_valid").alias("_valid"), F.min(
        F.when(F.col("_at").isNotNull(), F.struct("_at", "_bytes"))).alias("_first"))
    enc = F.lit(encoding) if encoding else F.when(F.col("_valid"), "UTF-8").otherwise("ISO-8859-1")
    files = files.select("file", enc.alias("encoding"), F.col("_first._at").alias("header_at"), _decoded(F.col("_first._bytes"), enc, encoding).alias("header"))
    found = F.lit(SEPARATORS[0])
    for x in reversed(SEPARATORS):
        found = F.when(F.contains("header", F.lit(x)), F.lit(x)).otherwise(found)
    return files.withColumn("sep", F.lit(sep) if sep else found)


def _decoded(data: Column, enc: Column, given: str | None) -> Column:
    if given:
        return F.decode(data, given)
    return F.when(enc == "UTF-8", F.decode(data, "UTF-8")).otherwise(F.decode(data, "ISO-8859-1"))


def _fields(line: Column, sep: Column, separators: list[str], width: int) -> Column:
    """The first ``width`` fields of a CSV line as an array of strings."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    out = F.lit(None).cast("array<string>")
    for x in separators:
        c = F.from_csv(line, schema, {"sep": x})
        out = F.when(sep == x, F.array(*[c[f"c{i}"] for i in range(width)])).otherwise(out)
    return out


def parse_amount(text: Column, locale: str | None = None) -> Column:
    """'R$ 35,50' -> 35.5.  Default: every ',' becomes '.', so '1.234,56' fails
    (rejected) as in the original; ``locale='pt_BR'`` strips thousands dots first."""
    t = text
    if locale == "pt_BR":
        t = F.regexp_replace(t, r"\.(?=\d{3}(\D|$))", "")
    t = F.trim(F.replace(F.replace(t, F.lit(","), F.lit(".")), F.lit("R$"), F.lit("")))
    return t.try_cast("double")


def parse_date(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("dd/MM/yyyy")).cast("date"),
                      F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def read_bank_csv(spark: SparkSession, path: str | list[str], sep: str | None = None, encoding: str | None = None,
                  locale: str | None = None) -> CsvImport:
    """Statement files under ``path`` (any mix of layouts).  ``sep`` and ``encoding`` set them for all files.

    Layouts are data: the lines of all files are read by one reader and joined to their file's layout, which says
    how to decode and split a line and at which positions the fields stand.  No list of files or
    layouts reaches the driver, only the width of the widest header.  Of columns with one name the first counts."""
    lines = _lines(spark, path)
    layouts = file_layouts(lines, sep, encoding)
    separators = [sep] if sep else SEPARATORS
    count = lambda x: F.char_length("header") - F.char_length(F.replace("header", F.lit(x)))
    width = (layouts.agg(F.max(F.greatest(*[count(x) for x in separators], F.lit(0)))).first()[0] or 0) + 1
    names = F.transform(_fields(F.col("header"), F.col("sep"), separators, width), lambda x: F.lower(F.btrim(x)))
    layouts = layouts.withColumn("_names", names)
    for name, aliases in (("_d", DATE_ALIASES), ("_c", DESC_ALIASES), ("_v", VALUE_ALIASES)):
        at = [F.nullif(F.array_position("_names", a), F.lit(0)) for a in aliases]
        layouts = layouts.withColumn(name, F.coalesce(*at))
    layouts = layouts.select("file", "encoding", "sep", "header_at", "_d", "_c", "_v")

    body = lines.join(layouts, "file").filter(~F.coalesce(F.col("_at") == F.col("header_at"), F.lit(False)))
    body = body.withColumn("_f", _fields(_decoded(F.col("_bytes"), F.col("encoding"), encoding), F.col("sep"), separators, width))

    def field(at: str, missing: str) -> Column:
        return F.when(F.col(at).isNull(), F.lit(missing)).otherwise(F.get("_f", F.col(at).cast("int") - 1))

    staged = body.select(field("_d", "").alias("data"), field("_c", NO_DESCRIPTION).alias("descricao"), field("_v", "0").alias("_vtext"))
    staged = staged.withColumn("_amount", parse_amount(F.col("_vtext"), locale))
    ok = staged.filter(F.col("_amount").isNotNull())
    rows = ok.select(
        "data", "descricao", F.abs("_amount").alias("valor"),
        F.when(F.col("_amount") > 0, "credito").otherwise("debito").alias("tipo"),
        F.lit("outros").alias("categoria_sugerida"), parse_date(F.col("data")).alias("date"))
    rejects = staged.filter(F.col("_amount").isNull()).select("data", "descricao", F.col("_vtext").alias("valor_texto"))
    return CsvImport(rows, rejects)


def render_bank_csv_lines(tx: DataFrame) -> DataFrame:
    """Transactions rendered as statement lines (fixture for the importer):
    'dd/MM/yyyy;description;R$ -12,31' — credits positive, debits negative."""
    signed = F.when(F.col("transaction_type") == "credito", F.col("amount")).otherwise(-F.col("amount"))
    val = F.concat(F.lit("R$ "), F.replace(F.format_string("%.2f", signed), F.lit("."), F.lit(",")))
    return tx.select(F.concat_ws(";", F.date_format("date", "dd/MM/yyyy"),
                                 F.regexp_replace(F.coalesce("description", F.lit("")), ";", " "), val).alias("value"))
