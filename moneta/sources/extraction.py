"""Structured documents returned by an extraction model (receipts, card bills,
bank statements): fence handling, JSON parsing with the raw text kept on
failure, flattening and merging of multi-page documents.

Fence rule: the text inside a ```json fence; else inside the first plain ```
fence; else the whole text; trimmed.  Text that is not valid JSON for the
schema keeps ``raw_text`` and no fields.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType([T.StructField("descricao", T.StringType()), T.StructField("valor", T.DoubleType()),
                     T.StructField("quantidade", T.DoubleType())])
RECEIPT = T.StructType([
    T.StructField("data", T.StringType()), T.StructField("valor_total", T.DoubleType()),
    T.StructField("estabelecimento", T.StringType()), T.StructField("cnpj", T.StringType()),
    T.StructField("endereco", T.StringType()), T.StructField("forma_pagamento", T.StringType()),
    T.StructField("categoria_sugerida", T.StringType()), T.StructField("itens", T.ArrayType(ITEM))])
BILL_TX = T.StructType([
    T.StructField("data", T.StringType()), T.StructField("descricao", T.StringType()),
    T.StructField("valor", T.DoubleType()), T.StructField("parcela", T.StringType()),
    T.StructField("categoria_sugerida", T.StringType())])
BILL = T.StructType([
    T.StructField("banco", T.StringType()), T.StructField("mes_referencia", T.StringType()),
    T.StructField("vencimento", T.StringType()), T.StructField("valor_total", T.DoubleType()),
    T.StructField("valor_minimo", T.DoubleType()), T.StructField("transacoes", T.ArrayType(BILL_TX))])
MOV = T.StructType([
    T.StructField("data", T.StringType()), T.StructField("descricao", T.StringType()),
    T.StructField("valor", T.DoubleType()), T.StructField("tipo", T.StringType()),
    T.StructField("categoria_sugerida", T.StringType())])
STATEMENT = T.StructType([
    T.StructField("banco", T.StringType()), T.StructField("agencia", T.StringType()),
    T.StructField("conta", T.StringType()),
    T.StructField("periodo", T.StructType([T.StructField("inicio", T.StringType()),
                                           T.StructField("fim", T.StringType())])),
    T.StructField("saldo_inicial", T.DoubleType()), T.StructField("saldo_final", T.DoubleType()),
    T.StructField("movimentacoes", T.ArrayType(MOV))])


def json_payload(text: Column) -> Column:
    """The JSON part of a model answer (fence rule above)."""
    after_json = F.substring_index(text, "```json", -1)
    in_json = F.substring_index(after_json, "```", 1)
    in_plain = F.substring_index(F.substring_index(text, "```", 2), "```", -1)
    # strip every kind of surrounding whitespace (trim() alone removes only spaces)
    return F.btrim(F.when(F.instr(text, "```json") > 0, in_json)
                   .when(F.instr(text, "```") > 0, in_plain).otherwise(text), F.lit(" \t\r\n\f\x0b"))


def parse_extraction(df: DataFrame, schema: T.StructType, text: str = "content") -> DataFrame:
    """Adds ``parsed`` (struct or null) and ``raw_text`` (the answer when parsing
    failed).  Only JSON objects count as parsed."""
    payload = json_payload(F.col(text))
    parsed = F.when(F.substring(payload, 1, 1) == "{",
                    F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_c"}))
    ok = F.coalesce(F.get_json_object(payload, "$").isNotNull() & parsed.isNotNull(), F.lit(False))
    return (df.withColumn("parsed", F.when(ok, parsed))
            .withColumn("raw_text", F.when(~ok, F.col(text))))


def flatten_receipt(df: DataFrame, id_col: str = "doc_id", text: str = "content") -> DataFrame:
    """One row per receipt item (receipts without items keep one row)."""
    p = parse_extraction(df, RECEIPT, text)
    return p.select(id_col, "raw_text", "parsed.data", "parsed.valor_total", "parsed.estabelecimento",
                    "parsed.cnpj", "parsed.endereco", "parsed.forma_pagamento", "parsed.categoria_sugerida",
                    F.posexplode_outer("parsed.itens").alias("item_pos", "item")).select(
        id_col, "raw_text", "data", "valor_total", "estabelecimento", "cnpj", "endereco", "forma_pagamento",
        "categoria_sugerida",
        "item_pos", F.col("item.descricao").alias("item_descricao"), F.col("item.valor").alias("item_valor"),
        F.col("item.quantidade").alias("item_quantidade"))


def _merge_pages(pages: DataFrame, schema: T.StructType, header: list[str], list_field: str,
                 id_col: str, page_col: str, text: str) -> DataFrame:
    p = parse_extraction(pages, schema, text).filter(F.col("parsed").isNotNull())
    # one parse: a page's items travel with it; a document's pages meet once
    p = p.select(id_col, page_col, F.struct(*[F.col(f"parsed.{h}").alias(h) for h in header]).alias("_h"),
                 F.col(f"parsed.{list_field}").alias("_l"))
    d = p.groupBy(id_col).agg(F.min_by("_h", page_col).alias("_h"),
                              F.collect_list(F.struct(F.col(page_col).alias("_p"), "_l")).alias("_pages"))
    each = F.flatten(F.transform("_pages", lambda g: F.transform(
        F.coalesce(g["_l"], F.array().cast(p.schema["_l"].dataType)),
        lambda x, i: F.struct(g["_p"].alias(page_col), i.alias("pos"), x.alias("_x")))))
    # a document whose pages hold no items keeps one row with its header
    j = d.select(id_col, "_h", F.explode_outer(each).alias("_e"))
    return j.select(id_col, F.col(f"_e.{page_col}").alias(page_col), F.col("_e.pos").alias("pos"),
                    *[F.col(f"_h.{h}").alias(h) for h in header], "_e._x.*")


def merge_bill_pages(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page",
                     text: str = "content") -> DataFrame:
    """Header from the first page that parsed; transactions of every parsed page
    in page and position order (unparsed pages are skipped)."""
    return _merge_pages(pages, BILL, ["banco", "mes_referencia", "vencimento", "valor_total", "valor_minimo"],
                        "transacoes", id_col, page_col, text)


def merge_statement_pages(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page",
                          text: str = "content") -> DataFrame:
    return _merge_pages(pages, STATEMENT, ["banco", "agencia", "conta", "periodo", "saldo_inicial", "saldo_final"],
                        "movimentacoes", id_col, page_col, text)


# ------------------------------------------------------------- fixtures
def _fence(body: Column, k: Column) -> Column:
    """k % 3: 0 -> ```json fence, 1 -> plain fence, 2 -> bare JSON; k % 17 = 0 -> not JSON."""
    fenced = (F.when(k % 3 == 0, F.concat(F.lit("Aqui está:\n```json\n"), body, F.lit("\n```\nFim.")))
              .when(k % 3 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```")))
              .otherwise(body))
    return F.when(k % 17 == 0, F.lit("Não consegui ler o documento.")).otherwise(fenced)


def render_receipts(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Receipts: one per order, items = its line items (at most 7 per order)."""
    items = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("l_linenumber").alias("n"),
        F.concat(F.lit("Item "), F.col("l_partkey").cast("string")).alias("descricao"),
        F.col("l_extendedprice").alias("valor"), F.col("l_quantity").alias("quantidade")))).alias("_it"))
    j = orders.join(items, orders.o_orderkey == items.l_orderkey, "left")
    body = F.to_json(F.struct(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("data"), F.col("o_totalprice").alias("valor_total"),
        F.concat(F.lit("Loja "), F.col("o_custkey").cast("string")).alias("estabelecimento"),
        F.lit("cartão").alias("forma_pagamento"), F.lit("compras").alias("categoria_sugerida"),
        F.transform(F.coalesce("_it", F.array()), lambda x: x.dropFields("n")).alias("itens")))
    return j.select(F.col("o_orderkey").alias("doc_id"), _fence(body, F.col("o_orderkey")).alias("content"))


def render_bill_pages(orders: DataFrame) -> DataFrame:
    """Card bills: one bill per customer and month, a page per block of order keys."""
    base = orders.select(
        F.col("o_custkey"), F.date_format("o_orderdate", "yyyyMM").alias("ym"),
        (F.col("o_orderkey") % 3).alias("page"),
        F.struct(F.date_format("o_orderdate", "dd/MM/yyyy").alias("data"),
                 F.concat(F.lit("Pedido "), F.col("o_orderkey").cast("string")).alias("descricao"),
                 F.col("o_totalprice").alias("valor"), F.lit(None).cast("string").alias("parcela"),
                 F.lit("compras").alias("categoria_sugerida"), F.col("o_orderkey").alias("k")).alias("t"))
    g = base.groupBy("o_custkey", "ym", "page").agg(F.array_sort(F.collect_list("t")).alias("ts"),
                                                   F.sum("t.valor").alias("tot"), F.min("t.k").alias("k"))
    body = F.to_json(F.struct(
        F.lit("Cartão Teste").alias("banco"),
        F.concat(F.substring("ym", 5, 2), F.lit("/"), F.substring("ym", 1, 4)).alias("mes_referencia"),
        F.concat(F.lit("10/"), F.substring("ym", 5, 2), F.lit("/"), F.substring("ym", 1, 4)).alias("vencimento"),
        F.col("tot").alias("valor_total"), (F.col("tot") * 0.15).alias("valor_minimo"),
        F.transform("ts", lambda x: x.dropFields("k")).alias("transacoes")))
    return g.select((F.col("o_custkey") * 1000000 + F.col("ym").cast("long")).alias("doc_id"), "page",
                    _fence(body, F.col("k")).alias("content"))


def render_statement_pages(tx: DataFrame) -> DataFrame:
    """Bank statements: one per user and month, one page per 10-day slice."""
    day = F.dayofmonth("date")
    base = tx.select(
        "user_id", F.date_format("date", "yyyyMM").alias("ym"),
        F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2).alias("page"),
        F.struct(F.date_format("date", "dd/MM/yyyy").alias("data"), F.col("description").alias("descricao"),
                 F.col("amount").alias("valor"), F.col("transaction_type").alias("tipo"),
                 F.coalesce("category", F.lit("outros")).alias("categoria_sugerida"), F.col("id").alias("k")).alias("t"))
    g = base.groupBy("user_id", "ym", "page").agg(
        F.array_sort(F.collect_list("t")).alias("ts"), F.min("t.k").alias("k"),
        F.sum(F.when(F.col("t.tipo") == "credito", F.col("t.valor")).otherwise(-F.col("t.valor"))).alias("net"))
    body = F.to_json(F.struct(
        F.lit("Banco Teste").alias("banco"), F.lit("0001").alias("agencia"),
        F.col("user_id").cast("string").alias("conta"),
        F.struct(F.concat(F.lit("01/"), F.substring("ym", 5, 2), F.lit("/"), F.substring("ym", 1, 4)).alias("inicio"),
                 F.lit(None).cast("string").alias("fim")).alias("periodo"),
        F.lit(0.0).alias("saldo_inicial"), F.col("net").alias("saldo_final"),
        F.transform("ts", lambda x: x.dropFields("k")).alias("movimentacoes")))
    return g.select((F.col("user_id") * 1000000 + F.col("ym").cast("long")).alias("doc_id"), "page",
                    _fence(body, F.col("k")).alias("content"))
