"""Transaction categorisation: keyword rules, category suggestions and a
multinomial naive Bayes over TF-IDF of uni- and bigrams, built from DataFrame
aggregates over per-batch counts (so every number has an exact SQL twin).

Model size is at most ``max_features`` terms times the number of classes; the model
tables are broadcast where a check of the class count allows it.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moneta import params as P
from moneta.session import checkpoint_dir
from moneta.functions.common import attach_one_row, spread
from moneta.functions.text import KEYWORD_RULES, keyword_counts, normalize_text, suggest_categories

# ----------------------------------------------------------------- rules


def categorize_rules(df: DataFrame, text: Column | str = "description", merchant: Column | str | None = None,
                     prefix: str = "rule") -> DataFrame:
    """Adds ``{prefix}_category`` and ``{prefix}_confidence``.  The text is
    ``description + ' ' + merchant`` normalised, as in the original."""
    t = F.col(text) if isinstance(text, str) else text
    if merchant is not None:
        m = F.col(merchant) if isinstance(merchant, str) else merchant
        t = F.concat_ws(" ", F.coalesce(t, F.lit("")), F.coalesce(m, F.lit("")))
    norm = normalize_text(F.coalesce(t, F.lit("")))
    names = list(KEYWORD_RULES)
    tmp = spread(df).withColumn("_kc", keyword_counts(norm))
    cols = [F.get("_kc", F.lit(i)) for i in range(len(names))]
    best = F.greatest(*cols)
    cat = None
    for name, c in zip(names, cols):
        cat = F.when(c == best, F.lit(name)) if cat is None else cat.when(c == best, F.lit(name))
    out = (tmp.withColumn(f"{prefix}_category", F.when(best > 0, cat).otherwise(F.lit("outros")))
           .withColumn(f"{prefix}_confidence",
                       F.when(best > 0, F.least(best / 3.0, F.lit(1.0))).otherwise(F.lit(0.3)))
           .withColumn(f"{prefix}_matches", best))
    return out.drop("_kc")


def category_suggestions(df: DataFrame, text: str = "text", limit: int = 5) -> DataFrame:
    """Suggestions for a partial text (lower-cased only, no other cleaning)."""
    return spread(df).withColumn("suggestions", suggest_categories(F.lower(F.col(text)), limit))


# ----------------------------------------------------------- naive Bayes

# Model tables of at most this many classes (x max_features terms) are broadcast;
# beyond it the same joins shuffle.  Results do not depend on it.
BROADCAST_CLASSES = 1_000


# A second word of bigrams is looked up among at most this many frequent words; beyond it all are
# counted.  Results do not depend on it.
SECOND_WORDS = 50_000


def _normal(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns and ``_text``, the normalised text."""
    return spread(docs.select(*keep, text)).select(*keep, normalize_text(F.col(text)).alias("_text"))


def _flat_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of 2+ characters of normalised texts, in order: each one's row and its place
    in the array of different words."""
    split = pc.split_pattern(text, " ")
    row = pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.dictionary_encode(pc.list_flatten(split))
    code, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
    long = np.asarray(pc.greater_equal(pc.utf8_length(words), 2).to_numpy(zero_copy_only=False), dtype=bool)
    keep = long[code]
    return row[keep], code[keep], words


def _slices(batches, rows: int = 1_000):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _places(words: pa.Array, known: list[str]) -> np.ndarray:
    """Each word's place in ``known``, -1 if it is not there."""
    at = pc.index_in(words, value_set=pa.array(known, words.type))
    return pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and how often each occurs (a plain sort: quicker than ``np.unique``)."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:keys.size])
    return keys[at], np.diff(np.r_[at, keys.size])


def _tally(row: np.ndarray, code: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
    """Documents and occurrences of the terms that occur."""
    n = len(terms)
    tf = np.bincount(code, minlength=n)
    df = np.bincount(_runs(row * n + code)[0] % max(n, 1), minlength=n)
    at = np.flatnonzero(tf)
    return pa.RecordBatch.from_arrays([terms.take(pa.array(at)), pa.array(df[at], pa.int64()), pa.array(tf[at], pa.int64())],
                                      ["term", "df", "tf_total"])


def _word_tallies(batches):
    for b in _slices(batches):
        yield _tally(*_flat_words(b.column(0)))


def _bigram_tallies(firsts: list[str], seconds: list[str] | None):
    """Tallies of bigrams whose first word is in ``firsts`` and whose second is in ``seconds`` (None: any)."""
    def run(batches):
        for b in _slices(batches):
            row, code, words = _flat_words(b.column(0))
            first = _places(words, firsts) >= 0
            second = np.ones(len(words), dtype=bool) if seconds is None else _places(words, seconds) >= 0
            at = np.flatnonzero((row[:-1] == row[1:]) & first[code[:-1]] & second[code[1:]])
            n = max(len(words), 1)
            pair = code[at] * n + code[at + 1]
            pairs = _runs(pair)[0]
            terms = pc.binary_join_element_wise(words.take(pa.array(pairs // n)), words.take(pa.array(pairs % n)), " ")
            yield _tally(row[at], np.searchsorted(pairs, pair), terms)
    return run


def fit_vocabulary(docs: DataFrame, n_docs: DataFrame, text: str = "text", min_df: int = P.NB_MIN_DF,
                   max_features: int = P.NB_MAX_FEATURES) -> DataFrame:
    """Terms in at least ``min_df`` documents; the ``max_features`` most frequent
    over the corpus (ties: term ascending); smooth idf = ln((1+N)/(1+df)) + 1
    with N from the one-row frame ``n_docs`` (column ``_N``).

    Words are counted first, bigrams after them.  A bigram occurs at most as often, and in at most as
    many documents, as either of its words, and it sorts behind its first word.  So one among the
    ``max_features`` has its first word among the best ``max_features`` words and a second word
    no rarer than the last of these.  All other bigrams are dropped before any shuffle."""
    checkpoint_dir(docs.sparkSession)
    schema = "term string, df long, tf_total long"
    texts = _normal(docs, [], text)

    def counted(tally) -> DataFrame:
        return (texts.mapInArrow(tally, schema).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf_total").alias("tf_total"))
                .filter(F.col("df") >= min_df))

    def best(terms: DataFrame) -> DataFrame:
        return terms.orderBy(F.col("tf_total").desc(), F.col("term")).limit(max_features)

    words = counted(_word_tallies).checkpoint(eager=True)
    firsts = best(words).collect()  # at most max_features rows
    least = firsts[-1]["tf_total"] if firsts and len(firsts) == max_features else 0
    frequent = words.filter(F.col("tf_total") >= least)
    seconds = [r["term"] for r in frequent.select("term").limit(SECOND_WORDS + 1).collect()]
    bigrams = counted(_bigram_tallies([r["term"] for r in firsts], seconds if len(seconds) <= SECOND_WORDS else None))
    return (attach_one_row(best(frequent.unionByName(bigrams)), n_docs)
            .withColumn("idf", F.log((1.0 + F.col("_N")) / (1.0 + F.col("df"))) + 1.0).drop("_N"))


def _term_lists(terms: list[str], kept: int):
    """Adds each document's terms, as ascending places in ``terms``, and how often each occurs."""
    at = {t: i for i, t in enumerate(terms)}
    of = sorted((t.split(" "), i) for t, i in at.items() if t.count(" ") == 1)
    firsts, seconds = sorted({w[0] for w, _ in of}), sorted({w[1] for w, _ in of})
    key = np.array([firsts.index(w[0]) * len(seconds) + seconds.index(w[1]) for w, _ in of], dtype=np.int64)
    order = np.argsort(key)
    key, place = np.r_[key[order], -1], np.array([i for _, i in of], dtype=np.int64)[order]

    def run(batches):
        for b in _slices(batches):
            row, code, words = _flat_words(b.column(kept))
            word = _places(words, terms)[code]
            one = word >= 0
            first, second = _places(words, firsts)[code], _places(words, seconds)[code]
            pair = np.flatnonzero((row[:-1] == row[1:]) & (first[:-1] >= 0) & (second[1:] >= 0))
            wanted = first[pair] * len(seconds) + second[pair + 1]
            found = np.searchsorted(key[:-1], wanted)
            hit = key[found] == wanted
            n = max(len(terms), 1)
            cells, times = _runs(np.r_[row[one], row[pair[hit]]] * n + np.r_[word[one], place[found[hit]]])
            ends = pa.array(np.searchsorted(cells // n, np.arange(b.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:kept], pa.ListArray.from_arrays(ends, pa.array(cells % n, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))],
                [*b.schema.names[:kept], "_t", "_n"])
    return run


def term_counts(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text: str = "text",
                keep: Sequence[str] = ()) -> DataFrame:
    """(id, ``keep``, _t, _n) for every row of ``docs``: the vocabulary terms of its document, as places in
    the vocabulary sorted by term, and how often each occurs.  Rows with equal ids are one
    document (nulls are not equal): only these are shuffled and added up."""
    terms = sorted(r["term"] for r in vocab.select("term").collect())  # at most max_features rows
    cols = [id_col, *keep]
    schema = T.StructType([*docs.select(*cols).schema.fields, T.StructField("_t", T.ArrayType(T.IntegerType())),
                           T.StructField("_n", T.ArrayType(T.LongType()))])
    rows = _normal(docs, cols, text).mapInArrow(_term_lists(terms, len(cols)), schema)
    again = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    if again.isEmpty():
        return rows
    checkpoint_dir(docs.sparkSession)
    rows = rows.join(again, id_col, "left").checkpoint(eager=True)  # read three times
    many = rows.filter(F.col("_rows").isNotNull())
    sums = (many.select(id_col, F.inline(F.arrays_zip("_t", "_n"))).groupBy(id_col, "_t").agg(F.sum("_n").alias("_n"))
            .groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_t", "_n"))).alias("_h")))  # at most max_features entries
    added = many.drop("_t", "_n").join(sums, id_col, "left").withColumn("_h", F.coalesce("_h", F.array()))
    added = added.select(*cols, F.transform("_h", lambda x: x["_t"]).alias("_t"), F.transform("_h", lambda x: x["_n"]).alias("_n"))
    return rows.filter(F.col("_rows").isNull()).select(*cols, "_t", "_n").unionByName(added)


def _flat(lists: pa.Array) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False)


def _row_of(lists: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tf-idf weights of ``term_counts``: ``_w`` array<double> (at most max_features entries) in
    place of _n, to be divided by its length ``_l2``."""
    idf = np.array([r["idf"] for r in sorted(vocab.select("term", "idf").collect())], dtype=float)  # at most max_features rows
    kept = counts.columns[:-2]
    schema = T.StructType([*counts.drop("_n").schema.fields, T.StructField("_w", T.ArrayType(T.DoubleType())),
                           T.StructField("_l2", T.DoubleType())])

    def run(batches):
        for b in batches:
            t, row = b.column(len(kept)), _row_of(b.column(len(kept)))
            w = _flat(b.column(len(kept) + 1)) * idf[_flat(t)]
            ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            l2 = np.sqrt(np.bincount(row, w * w, minlength=b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(w)), pa.array(l2)],
                                             [*kept, "_t", "_w", "_l2"])

    return counts.mapInArrow(run, schema)


def _dots(rows: DataFrame, log_probs: np.ndarray) -> DataFrame:
    """(id, _l2, _dots): each class's sum of weight x log-probability over the document's terms, null without terms."""
    schema = T.StructType([*rows.drop("_t", "_w").schema.fields, T.StructField("_dots", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            row, t, w = _row_of(b.column(1)), _flat(b.column(1)), _flat(b.column(2))
            sums = np.zeros((b.num_rows, log_probs.shape[1]))
            for c, p in enumerate(log_probs.T):
                sums[:, c] = np.bincount(row, w * p[t], minlength=b.num_rows)
            ends = pa.array(np.arange(b.num_rows + 1) * log_probs.shape[1], pa.int32())
            none = pa.array(np.bincount(row, minlength=b.num_rows) == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.ListArray.from_arrays(ends, pa.array(sums.ravel()), mask=none)],
                                             [b.schema.names[0], "_l2", "_dots"])

    return rows.mapInArrow(run, schema)


@dataclass
class NBModel:
    vocab: DataFrame      # term, df, tf_total, idf
    priors: DataFrame     # label, n_docs, log_prior
    log_probs: DataFrame  # label, term, log_prob
    n_classes: int

    def persist(self, path: str, mode: str = "overwrite") -> None:
        """Model tables as Parquet (no pickled objects)."""
        self.vocab.write.mode(mode).parquet(f"{path}/vocab")
        self.priors.write.mode(mode).parquet(f"{path}/priors")
        self.log_probs.write.mode(mode).parquet(f"{path}/log_probs")

    @staticmethod
    def load(spark, path: str) -> "NBModel":
        priors = spark.read.parquet(f"{path}/priors")
        return NBModel(spark.read.parquet(f"{path}/vocab"), priors,
                       spark.read.parquet(f"{path}/log_probs"), priors.count())

    def small(self, df: DataFrame) -> DataFrame:
        """A model table with its broadcast hint, if the class count allows one."""
        return F.broadcast(df) if self.n_classes <= BROADCAST_CLASSES else df


def class_priors(docs: DataFrame, label: str = "label") -> DataFrame:
    """(label, n_docs, log_prior) of the labelled documents."""
    labelled = docs.filter(F.col(label).isNotNull())
    counts = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n_docs"))
    return (attach_one_row(counts, labelled.agg(F.count(F.lit(1)).alias("_N")))
            .select(label, "n_docs", F.log(F.col("n_docs") / F.col("_N")).alias("log_prior")))


def nb_train(docs: DataFrame, label: str = "label", id_col: str = "doc_id", text: str = "text",
             alpha: float = P.NB_ALPHA) -> NBModel:
    """Multinomial naive Bayes: prior ln(n_c/N); ln P(t|c) = ln((S_ct + a) / (S_c + a V)),
    S = summed tf-idf weights of class c.  Three passes over the documents: two eager
    ones for the vocabulary (words, then bigrams; checkpointed) and one for the weights
    of its terms, which runs with the first use of ``log_probs``."""
    checkpoint_dir(docs.sparkSession)
    labelled = docs.filter(F.col(label).isNotNull()).select(id_col, label, text)
    n_total = labelled.agg(F.count(F.lit(1)).alias("_N"))
    priors = class_priors(labelled, label).checkpoint(eager=True)
    vocab = fit_vocabulary(labelled, n_total, text).checkpoint(eager=True)
    v_list = vocab.agg(F.array_sort(F.collect_list("term"))).scalar()
    weights = (tfidf(term_counts(labelled.filter(F.col(id_col).isNotNull()), vocab, id_col, text, [label]), vocab)
               .select(label, "_l2", F.inline(F.arrays_zip("_t", "_w"))))
    s_ct = (weights.groupBy(label, "_t").agg(F.sum(F.col("_w") / F.col("_l2")).alias("s_ct"))
            .select(label, F.get(v_list, F.col("_t")).alias("term"), "s_ct"))
    # every (class, term) pair of the bounded vocabulary, zero when unseen
    grid = priors.select(label).withColumn("term", F.explode(v_list))
    full = grid.join(s_ct, [label, "term"], "left").withColumn("s_ct", F.coalesce("s_ct", F.lit(0.0)))
    of_class = Window.partitionBy(label)  # at most max_features rows a class
    v_size = vocab.agg(F.count(F.lit(1)).alias("_V"))
    log_probs = (attach_one_row(full.withColumn("s_c", F.sum("s_ct").over(of_class)), v_size)
                 .select(label, "term",
                         F.log((F.col("s_ct") + alpha) / (F.col("s_c") + alpha * F.col("_V"))).alias("log_prob")))
    return NBModel(vocab, priors, log_probs, priors.count())


def nb_predict(model: NBModel, docs: DataFrame, id_col: str = "doc_id", text: str = "text",
               label: str = "label") -> DataFrame:
    """(id, predicted, confidence): argmax of prior + sum w * ln P(t|c), ties to
    the smaller class name; confidence = its softmax probability.  Documents
    without any vocabulary term get the prior alone.

    The classes' log-probabilities are one array per term (classes in name order), and
    a document is one row that adds the arrays of its terms: up to ``BROADCAST_CLASSES`` classes
    in Arrow batches that know the whole table, beyond it by a join."""
    by_term = model.log_probs.groupBy("term").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(label).alias("c"), F.col("log_prob").alias("p")))),
        lambda x: x["p"]).alias("_lp"))
    table = model.vocab.select("term").join(by_term, "term", "left")
    rows = tfidf(term_counts(docs, model.vocab, id_col, text), model.vocab)
    if model.n_classes <= BROADCAST_CLASSES:  # the table goes to the tasks
        of = np.array([r["_lp"] for r in sorted(table.collect(), key=lambda r: r["term"])], dtype=float)
        scored = _dots(rows, of.reshape(len(of), model.n_classes))
    else:
        terms = model.vocab.agg(F.array_sort(F.collect_list("term"))).scalar()
        hits = (rows.withColumn("_row", F.monotonically_increasing_id()).select(id_col, "_row", "_l2", F.inline_outer(F.arrays_zip("_t", "_w")))
                .withColumn("term", F.get(terms, F.col("_t"))).join(table, "term", "left")
                .groupBy("_row").agg(F.first(id_col).alias(id_col), F.first("_l2").alias("_l2"),
                                     F.collect_list(F.when(F.col("_w").isNotNull(), F.struct("_w", "_lp"))).alias("_h")))
        dots = F.aggregate("_h", F.transform(F.get("_h", F.lit(0))["_lp"], lambda p: F.lit(0.0)),
                           lambda acc, x: F.zip_with(acc, x["_lp"], lambda a, p: a + x["_w"] * p))
        scored = hits.select(id_col, "_l2", dots.alias("_dots"))
    scored = scored.withColumn("_dots", F.when(F.col(id_col).isNotNull(), F.col("_dots")))
    classes = model.priors.agg(F.array_sort(F.collect_list(
        F.struct(F.col(label).alias("c"), F.col("log_prior").alias("p")))).alias("_classes"))
    j = attach_one_row(scored, classes)
    prior = F.transform("_classes", lambda x: x["p"])
    jll = F.when(F.col("_dots").isNull(), prior).otherwise(F.zip_with(prior, F.col("_dots"), lambda p, d: p + d / F.col("_l2")))
    j = j.select(id_col, "_classes", jll.alias("_jll")).withColumn("_m", F.array_max("_jll"))
    lse = F.aggregate("_jll", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_m")))
    best = F.array_position("_jll", F.col("_m")).cast("int")
    return j.select(id_col, F.get("_classes", best - 1)["c"].alias("predicted"), (F.lit(1.0) / lse).alias("confidence"))


def nb_accuracy(pred: DataFrame, docs: DataFrame, id_col: str = "doc_id", label: str = "label") -> DataFrame:
    j = pred.join(docs.select(id_col, label), id_col)
    return j.agg(F.avg(F.when(F.col("predicted") == F.col(label), 1.0).otherwise(0.0)).alias("accuracy"),
                 F.count(F.lit(1)).alias("n_docs"))


def categorize(df: DataFrame, model: NBModel | None, id_col: str = "doc_id", text: str = "text",
               merchant: str | None = None) -> DataFrame:
    """Rules first when their confidence reaches 0.7; else the model when it is
    strictly more confident; else the rules.  With ``merchant`` the rules read
    description and merchant, the model the description."""
    r = categorize_rules(df, F.col(text), merchant)
    if model is None:
        return r.select(id_col, F.col("rule_category").alias("category"),
                        F.col("rule_confidence").alias("confidence"), F.lit("rules").alias("method"))
    m = nb_predict(model, df, id_col, text)
    j = r.select(id_col, "rule_category", "rule_confidence").join(m, id_col, "left")
    use_rules = F.col("rule_confidence") >= P.RULES_HIGH_CONFIDENCE
    use_ml = ~use_rules & F.col("confidence").isNotNull() & (F.col("confidence") > F.col("rule_confidence"))
    return j.select(
        id_col,
        F.when(use_ml, F.col("predicted")).otherwise(F.col("rule_category")).alias("category"),
        F.when(use_ml, F.col("confidence")).otherwise(F.col("rule_confidence")).alias("confidence"),
        F.when(use_ml, F.lit("ml")).otherwise(F.lit("rules")).alias("method"),
    )
