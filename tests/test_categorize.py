import pytest
from pyspark.sql import functions as F

from moneta.functions.text import normalize_text
from moneta.operators import categorize as cz


@pytest.mark.parametrize("desc,merchant,cat,conf", [
    ("Supermercado Extra", "", "alimentação", 1.0),
    ("Carrefour", "", "alimentação", 1 / 3),
    ("Uber do Brasil", "", "transporte", 2 / 3),
    ("Posto Shell", "", "transporte", 2 / 3),
    ("iFood", "", "delivery", 1 / 3),
    ("Uber Eats", "", "delivery", 1 / 3),
    ("XYZ Desconhecido 123", "", "outros", 0.3),
    ("99 Táxi", "", "outros", 0.3),
    ("Salário", "", "outros", 0.3),
    ("Pagamento", "", "jogos", 1 / 3),
    ("Pagamento Netflix", "Netflix", "lazer", 1 / 3),
    ("Compra", "Supermercado Extra", "alimentação", 1.0),
])
def test_rules_goldens(spark, desc, merchant, cat, conf):
    df = spark.createDataFrame([(1, desc, merchant)], "id long, description string, merchant string")
    r = cz.categorize_rules(df, "description", "merchant").first()
    assert r.rule_category == cat and abs(r.rule_confidence - conf) < 1e-9


def test_normalize(spark):
    df = spark.createDataFrame([("  Pão-de-Açúcar 123!!  ok_1 ",)], "t string")
    assert df.select(normalize_text("t")).first()[0] == "pão de açúcar ok_"


@pytest.mark.parametrize("text,expected", [
    ("uber", ["delivery", "transporte"]),
    ("mercado", ["alimentação", "compras"]),
    ("", ["alimentação", "delivery", "transporte", "moradia", "saúde"]),
    ("zzzz", ["outros"]),
])
def test_suggestions(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    assert cz.category_suggestions(df).first().suggestions == expected


def test_naive_bayes_separates_languages(spark):
    from conftest import SF_SMALL
    from moneta.sources import testdata as td
    d = td.table(spark, SF_SMALL, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    m = cz.nb_train(d)
    assert m.vocab.count() <= 1000
    acc = cz.nb_accuracy(cz.nb_predict(m, d), d).first().accuracy
    assert acc > 0.9
    # probabilities per document sum to one -> confidence in (0, 1]
    c = cz.nb_predict(m, d).agg(F.min("confidence"), F.max("confidence")).first()
    assert 0 < c[0] <= c[1] <= 1.0 + 1e-9


def test_class_count_does_not_change_the_answer(spark, monkeypatch):
    rows = [(1, "gato preto gato", "a"), (2, "gato preto", "a"), (3, "carro azul", "b"), (4, "carro azul azul", "b"),
            (5, "", None), (6, None, None), (7, "gato azul", None), (7, "gato azul", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, label string")
    run = lambda: sorted(map(tuple, cz.nb_predict(cz.nb_train(d), d).collect()))
    broadcast = run()
    monkeypatch.setattr(cz, "BROADCAST_CLASSES", 0)
    shuffled = run()
    assert [r[:2] for r in broadcast] == [r[:2] for r in shuffled]
    assert all(abs(x[2] - y[2]) < 1e-12 for x, y in zip(broadcast, shuffled))
    got = {r[0]: r[1:] for r in broadcast}
    assert len(broadcast) == 8 and got[1][0] == "a" and got[3][0] == "b"
    assert got[5] == got[6] == ("a", 0.5)  # no term: the priors alone, ties to the smaller name


def test_categorize_reads_the_merchant(spark):
    d = spark.createDataFrame([(1, "Compra", "Supermercado Extra"), (2, "Compra", None)],
                              "doc_id long, text string, merchant string")
    r = {x.doc_id: x for x in cz.categorize(d, None, merchant="merchant").collect()}
    assert r[1].category == "alimentação" and r[1].confidence == 1.0 and r[1].method == "rules"
    assert r[2].category == "outros"


def _plain_vocabulary(texts, max_features):
    from collections import Counter
    tf, df = Counter(), Counter()
    for t in texts:
        w = [x for x in t.split(" ") if len(x) >= 2]
        terms = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        tf.update(terms)
        df.update(set(terms))
    return sorted((t for t in tf if df[t] >= 2), key=lambda t: (-tf[t], t.encode()))[:max_features], tf, df


@pytest.mark.parametrize("second_words", [50_000, 0])
@pytest.mark.parametrize("max_features", [3, 12, 1000])
def test_vocabulary_of_pruned_bigrams_is_the_whole_one(spark, monkeypatch, second_words, max_features):
    monkeypatch.setattr(cz, "SECOND_WORDS", second_words)
    texts = ["ab cd ab cd x ab zz", "ab cd ef", "gh ab cd gh", "éf gh éf gh", "zz yy", "zz yy ab", "", "once once once twice"]
    d = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    want, tf, df = _plain_vocabulary(texts, max_features)
    got = cz.fit_vocabulary(d, d.agg(F.count(F.lit(1)).alias("_N")), max_features=max_features).collect()
    assert {(r.term, r.df, r.tf_total) for r in got} == {(t, df[t], tf[t]) for t in want}


def test_rows_with_equal_ids_are_one_document(spark):
    rows = [(1, "gato preto gato", "a"), (2, "carro azul", "b"), (2, "azul carro azul", "a"), (3, "gato azul", "b"),
            (None, "gato preto", "a"), (None, "carro preto", None), (4, None, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, label string")
    vocab = spark.createDataFrame([(t,) for t in ("azul", "carro azul", "gato", "preto", "preto gato")], "term string")
    got = sorted(((r.doc_id, r.label, list(zip(r._t, r._n))) for r in cz.term_counts(d, vocab, keep=["label"]).collect()), key=repr)
    both = [(0, 3), (1, 2)]  # azul 3, carro azul 2
    assert got == sorted([(1, "a", [(2, 2), (3, 1), (4, 1)]), (2, "b", both), (2, "a", both), (3, "b", [(0, 1), (2, 1)]),
                          (None, "a", [(2, 1), (3, 1)]), (None, None, [(3, 1)]), (4, "a", [])], key=repr)
    m = cz.nb_train(d)
    by = {(r.doc_id, r.predicted, round(r.confidence, 9)) for r in cz.nb_predict(m, d).filter("doc_id is null").collect()}
    assert len(by) == 1  # rows without an id get the priors alone


def test_terms_are_counted_before_any_shuffle(spark):
    d = spark.createDataFrame([(1, "gato preto gato", "a"), (2, "gato preto", "b")], "doc_id long, text string, label string")
    plan = cz.nb_predict(cz.nb_train(d), d)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_keywords_are_searched_once_for_each_category(spark):
    from moneta.functions.text import KEYWORD_RULES
    texts = ["uber", "ub", "", None, "zzz", "o mercado livre e o supermercado extra pago por pix no bar", "c&a", "cxa", "pro-labore",
             "plano de saude unimed amil", "x" * 40 + "zé delivery", "ã", "a b", "net", "99 táxi", "dia a dia", "a"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sug = cz.category_suggestions(d)
    got = {r.id: r.suggestions for r in sug.collect()}
    for i, t in enumerate(texts):
        found = [n for n, kws in KEYWORD_RULES.items() if t is not None and any(k in t or t in k for k in kws)]
        assert got[i] == (found[:5] or ["outros"]), t
    rules = cz.categorize_rules(d, "text")
    for r in rules.collect():
        t = cz_norm(texts[r.id])
        n = {name: sum(k in t for k in kws) for name, kws in KEYWORD_RULES.items()}
        assert r.rule_matches == max(n.values())
        assert r.rule_category == (max(n, key=n.get) if max(n.values()) else "outros")
    for df in (sug, rules):  # the plan names no keyword: the texts are not read again for each of them
        assert "supermercado" not in df._jdf.queryExecution().optimizedPlan().toString()


def cz_norm(t):
    import re
    return re.sub(r"(?:[^\w]|\d)+", " ", (t or "").lower()).strip()
