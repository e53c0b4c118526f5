import os

from pyspark.sql import functions as F

from moneta.plans.catalog import scratch
from moneta.sources import bank_csv, extraction, ofx, report_csv, sinks


def _write(path, text):
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "statement.csv"), "w", encoding="utf-8") as f:
        f.write(text)


def test_bank_csv_golden(spark):
    p = scratch(spark, "t_csv")
    _write(p, "Data;Descricao;Valor\n01/01/2024;Salário;5000,00\n02/01/2024;Mercado;-250,00\n"
              "03/01/2024;Padaria;-35,50\n04/01/2024;Pix;R$ 35,50\n05/01/2024;Zero;0\n06/01/2024;Big;1.234,56\n")
    imp = bank_csv.read_bank_csv(spark, p)
    rows = [(r.descricao, r.valor, r.tipo) for r in imp.rows.orderBy("data").collect()]
    assert rows == [("Salário", 5000.0, "credito"), ("Mercado", 250.0, "debito"), ("Padaria", 35.5, "debito"),
                    ("Pix", 35.5, "credito"), ("Zero", 0.0, "debito")]
    assert [r.valor_texto for r in imp.rejects.collect()] == ["1.234,56"]
    assert imp.rows.filter(F.col("date").isNull()).count() == 0
    br = bank_csv.read_bank_csv(spark, p, locale="pt_BR").rows.filter("descricao = 'Big'").first()
    assert br.valor == 1234.56


def test_bank_csv_folder_with_mixed_layouts(spark):
    p = scratch(spark, "t_csv_mixed").removeprefix("file:")
    os.makedirs(p)
    for name, enc, text in [("a.csv", "utf-8", "Data;Descricao;Valor\n01/02/2024;Pão;-10,50\n"),
                            ("b.csv", "latin-1", "amount,date,Historico\n\"20,00\",2024-02-02,Açougue\n"),
                            ("c.csv", "utf-8", "DESC\tVLR\tDT\nÔnibus\t-3,00\t03/02/2024\n"), ("d.csv", "utf-8", ""),
                            ("e.csv", "utf-8", "Data;Descricao;Valor\n04/02/2024;Luz;x\n")]:
        with open(os.path.join(p, name), "w", encoding=enc) as f:
            f.write(text)
    imp = bank_csv.read_bank_csv(spark, p)
    assert sorted((r.descricao, r.valor, r.tipo, str(r.date)) for r in imp.rows.collect()) == [
        ("Açougue", 20.0, "credito", "2024-02-02"), ("Pão", 10.5, "debito", "2024-02-01"),
        ("Ônibus", 3.0, "debito", "2024-02-03")]
    assert [tuple(r) for r in imp.rejects.collect()] == [("04/02/2024", "Luz", "x")]
    os.makedirs(p + "/none")
    open(p + "/none/empty.csv", "w").close()
    assert bank_csv.read_bank_csv(spark, p + "/none").rows.count() == 0


def test_bank_csv_aliases_and_missing_description(spark):
    p = scratch(spark, "t_csv2")
    _write(p, "date,amount\n2024-01-05,10.5\n")
    r = bank_csv.read_bank_csv(spark, p).rows.first()
    assert (r.descricao, r.valor, r.tipo, str(r.date)) == ("Sem descrição", 10.5, "credito", "2024-01-05")


def test_ofx_parse(spark):
    doc = ("OFXHEADER:100\n<OFX><SIGNONMSGSRSV1><SONRS><FI><ORG>Meu Banco</FI></SONRS></SIGNONMSGSRSV1>\n"
           "<BANKMSGSRSV1><STMTTRNRS><STMTRS><BANKACCTFROM><ACCTID>123\n</BANKACCTFROM><BANKTRANLIST>"
           "<DTSTART>20240101<DTEND>20240131\n"
           "<STMTTRN><TRNTYPE>DEBIT\n<DTPOSTED>20240105120000\n<TRNAMT>-42.10\n<FITID>1\n<MEMO>Farmacia\n</STMTTRN>\n"
           "<STMTTRN><TRNTYPE>CREDIT<DTPOSTED>20240110<TRNAMT>100.00<FITID>2<NAME>Empresa</STMTTRN>\n"
           "<STMTTRN><TRNAMT>0<FITID>3</STMTTRN></BANKTRANLIST><LEDGERBAL><BALAMT>57.90</LEDGERBAL></STMTRS></OFX>")
    df = spark.createDataFrame([(doc,)], "value string")
    rows = ofx.parse_ofx(df).orderBy("pos").collect()
    assert [(r.data, r.descricao, r.valor, r.tipo) for r in rows] == [
        ("05/01/2024", "Farmacia", 42.1, "debito"), ("10/01/2024", "Empresa", 100.0, "credito"),
        (None, "Sem descrição", 0.0, "debito")]
    assert (rows[0].banco, rows[0].conta, rows[0].saldo_final) == ("Meu Banco", "123", 57.9)


def test_extraction_fences(spark):
    body = '{"data": "01/02/2024", "valor_total": 10.5, "itens": [{"descricao": "a", "valor": 10.5, "quantidade": 1}]}'
    texts = [f"texto\n```json\n{body}\n```\nfim", f"```\n{body}\n```", body, "sem json aqui", "```json\n[1, 2]\n```"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    out = {r.doc_id: r for r in extraction.flatten_receipt(df).collect()}
    for i in (0, 1, 2):
        assert out[i].valor_total == 10.5 and out[i].item_descricao == "a" and out[i].raw_text is None
    assert out[3].raw_text == "sem json aqui" and out[3].valor_total is None
    assert out[4].raw_text is not None


def test_merge_pages_header_from_first_parsed(spark):
    p1 = '{"banco": "B1", "transacoes": [{"descricao": "x", "valor": 1.0}, {"descricao": "y", "valor": 2.0}]}'
    p2 = '{"banco": "B2", "transacoes": [{"descricao": "z", "valor": 3.0}]}'
    df = spark.createDataFrame([(1, 0, "falhou"), (1, 1, p1), (1, 2, p2)], "doc_id long, page int, content string")
    rows = extraction.merge_bill_pages(df).orderBy("page", "pos").collect()
    assert [r.descricao for r in rows] == ["x", "y", "z"] and {r.banco for r in rows} == {"B1"}


REPORT_LINES = """categoria,tipo,1_10_valor,11_20_valor,21_31_valor,total_valor
KPI,RECEBIMENTOS,1000.00,50.00,300.50,1350.50
KPI,PAGAMENTOS,400.00,0,100.25,500.25
LOJA,PAGAMENTOS,40.00,x,10.25,50.25
MES,ENTRADAS_DIA,100,0,25.5
MES,SAIDAS_DIA,0,60,5.25
MES,SALDO_INICIAL,900.25,,,,
"""


def test_report_goldens(spark):
    p = scratch(spark, "t_report").removeprefix("file:")
    os.makedirs(p)
    with open(os.path.join(p, "report.csv"), "w", encoding="utf-8") as f:
        f.write(REPORT_LINES)
    rep = report_csv.read_report(spark, p)
    kpi = {r.tipo: r for r in rep.rows.filter("categoria = 'KPI'").collect()}
    assert (kpi["RECEBIMENTOS"].v_1_10, kpi["RECEBIMENTOS"].v_11_20, kpi["RECEBIMENTOS"].v_21_31) == (1000.0, 50.0, 300.5)
    assert kpi["PAGAMENTOS"].total == 500.25
    assert rep.rows.filter("categoria = 'LOJA'").first().v_11_20 is None  # not a number
    assert [tuple(r) for r in report_csv.daily_balance(rep).select("day", "balance").orderBy("day").collect()] == [
        (1, 1000.25), (2, 940.25), (3, 960.5)]
    sums = rep.daily.groupBy("serie").agg(F.round(F.sum("value"), 2).alias("s")).collect()
    assert {r.serie: r.s for r in sums} == {"ENTRADAS_DIA": 125.5, "SAIDAS_DIA": 65.25}
    assert report_csv.report_long(rep.rows).filter("tipo = 'PAGAMENTOS'").count() == 6


def test_store_roundtrip_and_pruning(spark):
    import datetime as dt
    p = scratch(spark, "t_store")
    tx = spark.createDataFrame([(1, 1, dt.date(2024, 1, 5), 10.0, "delivery"), (2, 1, dt.date(2024, 2, 5), 20.0, "delivery")],
                               "id long, user_id long, date date, amount double, category string")
    sinks.append_transactions(tx, p)
    s = sinks.scan_transactions(spark, p, start="2024-02-01", category="delivery")
    assert [r.id for r in s.collect()] == [2]
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year_month" in plan
    r = spark.read.parquet(p).filter("id = 1").first()
    assert (r.transaction_type, r.source, r.risk_score, r.is_night) == ("debito", "import", 0, False)
