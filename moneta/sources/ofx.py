"""OFX statements as a bulk text job: statement transactions are cut out with
a regular expression and their tags read with ``regexp_extract``.

Each account statement gives movements: date dd/MM/yyyy, description = memo,
else payee, else 'Sem descrição'; value = |amount|; credit when amount > 0;
category 'outros'.  Header: organisation, account id, period and closing
balance.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_DESCRIPTION = "Sem descrição"


def _tag(doc: Column, tag: str) -> Column:
    v = F.regexp_extract(doc, rf"<{tag}>([^<\r\n]*)", 1)
    return F.when(v == "", F.lit(None)).otherwise(F.trim(v))


def _ofx_date(v: Column) -> Column:
    return F.date_format(F.to_date(F.substring(v, 1, 8), "yyyyMMdd"), "dd/MM/yyyy")


def read_ofx(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """One row per statement transaction.  ``whole_files=True`` reads each file
    as one document; otherwise every line is one document."""
    docs = (spark.read.text(path, wholetext=True) if whole_files else spark.read.text(path))
    return parse_ofx(docs.withColumn("doc_path", F.input_file_name()), "value")


def parse_ofx(docs: DataFrame, text: str = "value") -> DataFrame:
    d = F.col(text)
    hdr = docs.select(
        "*",
        F.coalesce(_tag(d, "ORG"), F.lit("Desconhecido")).alias("banco"),
        F.coalesce(_tag(d, "ACCTID"), F.lit("")).alias("conta"),
        _ofx_date(_tag(d, "DTSTART")).alias("periodo_inicio"),
        _ofx_date(_tag(d, "DTEND")).alias("periodo_fim"),
        _tag(d, "BALAMT").try_cast("double").alias("saldo_final"),
        F.regexp_extract_all(d, F.lit(r"(?s)<STMTTRN>(.*?)</STMTTRN>"), 1).alias("_trn"))
    ex = hdr.select(*[c for c in hdr.columns if c not in (text, "_trn")],
                    F.posexplode("_trn").alias("pos", "_t"))
    t = F.col("_t")
    amt = _tag(t, "TRNAMT").try_cast("double")
    return ex.select(
        *[c for c in ex.columns if c not in ("_t",)],
        _tag(t, "FITID").alias("fitid"),
        _ofx_date(_tag(t, "DTPOSTED")).alias("data"),
        F.coalesce(_tag(t, "MEMO"), _tag(t, "NAME"), F.lit(NO_DESCRIPTION)).alias("descricao"),
        F.abs(amt).alias("valor"),
        F.when(amt > 0, "credito").otherwise("debito").alias("tipo"),
        F.lit("outros").alias("categoria_sugerida"))


def render_ofx_docs(tx: DataFrame) -> DataFrame:
    """Fixture: one single-line OFX statement per user and day (bounded size)."""
    amt = F.when(F.col("transaction_type") == "credito", F.col("amount")).otherwise(-F.col("amount"))
    trn = F.concat(
        F.lit("<STMTTRN><TRNTYPE>"), F.when(amt > 0, "CREDIT").otherwise("DEBIT"),
        F.lit("<DTPOSTED>"), F.date_format("timestamp", "yyyyMMddHHmmss"),
        F.lit("<TRNAMT>"), F.format_string("%.2f", amt),
        F.lit("<FITID>"), F.col("id").cast("string"),
        F.when(F.col("id") % 4 != 0, F.concat(F.lit("<MEMO>"), F.col("description"))).otherwise(F.lit("")),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("<NAME>"), F.col("merchant"))).otherwise(F.lit("")),
        F.lit("</STMTTRN>"))
    g = tx.groupBy("user_id", "date").agg(
        F.concat_ws("", F.array_sort(F.collect_list(F.struct("timestamp", "id", trn.alias("t")))).getField("t"))
        .alias("trns"),
        F.sum(amt).alias("bal"))
    doc = F.concat(
        F.lit("OFXHEADER:100<OFX><BANKMSGSRSV1><STMTTRNRS><STMTRS><CURDEF>BRL<BANKACCTFROM><BANKID>0341<ACCTID>"),
        F.col("user_id").cast("string"), F.lit("</BANKACCTFROM><BANKTRANLIST><DTSTART>"),
        F.date_format("date", "yyyyMMdd"), F.lit("<DTEND>"), F.date_format("date", "yyyyMMdd"),
        F.col("trns"), F.lit("</BANKTRANLIST><LEDGERBAL><BALAMT>"), F.format_string("%.2f", F.col("bal")),
        F.lit("</LEDGERBAL></STMTRS></STMTTRNRS></BANKMSGSRSV1><SIGNONMSGSRSV1><SONRS><FI><ORG>Banco Teste"),
        F.lit("</FI></SONRS></SIGNONMSGSRSV1></OFX>"))
    return g.select(doc.alias("value"))
