"""The pipeline's run on a small planted table, against a plain version of each stage."""
from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np

NOTICE = "This very line is a licence notice that many documents happen to share, as it goes."
PASSAGE = " ".join(f"passage{i}" for i in range(40))
BASE = " ".join(f"w{i}" for i in range(200))
TEXTS = {
    1: "You are an idiot.", 2: "She is not an idiot.", 3: "They wrote idiot here", 4: "Fine.\nWhat an idiot. Bye", 5: None, 6: "",
    **{10 + i: f"start of text {i} and more of it\n{NOTICE}\nthe end is {i}" for i in range(5)},
    15: f"You moron.\n{NOTICE}",  # toxic: goes before it could keep the line
    20: BASE, 21: BASE, 22: BASE.replace("w100 ", "x "), 23: " ".join(f"v{i}" for i in range(200)),
    24: BASE.replace("w3 ", "y ").replace("w90 ", "z "), 25: " ".join(BASE.split()[:100] + [f"u{i}" for i in range(100)]),
    30: "before it all " + PASSAGE + " after", 31: "some " + " ".join(PASSAGE.upper().split()[5:15]) + " others",
    32: "only " + " ".join(PASSAGE.split()[5:14]) + " nine", 40: " ".join(f"long{i}" for i in range(3000)),
}
INSULTS, NEGATED, QUOTED = {"idiot", "moron"}, {"not"}, {"wrote"}


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def is_toxic(t):
    """An insult in a clause, not within three words of a negation, nor after reported speech."""
    for clause in re.split(r"[.!?;:\n|]+", lower(t)):
        w = clause.split()
        for p, x in enumerate(w):
            if x in INSULTS and not NEGATED & set(w[max(0, p - 3):p]) and not QUOTED & set(w[:p]):
                return True
    return False


def plain_lines(docs):
    held = defaultdict(set)
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            if len(key := lower(line).strip(" \t\n\x0b\f\r")) >= 40:
                held[key].add(i)
    gone = {(i, key) for key, ids in held.items() if len(ids) >= 5 for i in ids if i != max(ids)}
    return {i: "\n".join(x for x in (t or "").split("\n") if (i, lower(x).strip(" \t\n\x0b\f\r")) not in gone) for i, t in docs.items()}


def plain_near(docs):
    def shingles(t):
        w = lower(t).split()
        return {tuple(w[p:p + 5]) for p in range(max(1, len(w) - 4))} if w else set()

    sets, label = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return {i: t for i, t in docs.items() if label[i] == i}


def plain_clean(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    def windows(t, n):
        w = words(t)
        return {tuple(w[p:p + n]) for p in range(len(w) - n + 1)}

    return {i: t for i, t in docs.items() if not any(
        windows(t, n) & windows(s, n) for s in items for n in [min(10, len(words(s)))] if n)}


def test_run_against_plain_stages(spark, tmp_path):
    import corpus_pipeline as C
    import public_tokenizers
    from tokenizers import Tokenizer
    items = [PASSAGE, "nowhere to be found"]
    rows = [(i, t, "en", "a", None if t is None else len(t)) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    # no labels: the fixed insults and weights hold
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {i: t for i, t in TEXTS.items() if not is_toxic(t)}
    want = {"toxicity": left}
    want["line_dedup"] = plain_lines(left)
    want["near_dedup"] = plain_near(want["line_dedup"])
    want["decontamination"] = plain_clean(want["near_dedup"], items)
    assert set(TEXTS) - set(left) == {1, 4, 15} and NOTICE in want["line_dedup"][14] and NOTICE not in want["line_dedup"][13]
    assert {21, 22, 24}.isdisjoint(want["near_dedup"]) and {20, 23, 25} <= set(want["near_dedup"])
    assert {30, 31}.isdisjoint(want["decontamination"]) and 32 in want["decontamination"]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, str(tmp_path)), name)
        got = docs.collect()
        assert {r["doc_id"]: r["text"] or "" for r in got} == {i: t or "" for i, t in want[name].items()}, name
        assert len(got) == len(want[name]) and all((r["n_chars"] or 0) == len(r["text"] or "") for r in got)
        assert all(r["lang"] == "en" and r["source"] == "a" for r in got)

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: own.encode(t or "", add_special_tokens=False).ids + [0] for i, t in want["decontamination"].items()}
    assert len(ids[40]) > 2048
    parts, places = defaultdict(list), defaultdict(list)
    for r in C.run(spark, str(tmp_path)).collect():
        piece = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        parts[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, ends in [(parts[i], len(x)) for i, x in ids.items()] + [(p, None) for p in places.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == ends if ends else at <= 2048
    assert set(parts) == set(ids)
