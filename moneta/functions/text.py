"""Text expressions: normalisation and the keyword rules."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES — keyword rules, in dictionary order (category order breaks ties)
KEYWORD_RULES: dict[str, list[str]] = {
    "alimentação": [
        "supermercado", "mercado", "açougue", "padaria", "hortifruti",
        "carrefour", "extra", "pao de acucar", "assai", "atacadao",
        "dia", "minuto pao", "swift",
    ],
    "delivery": [
        "ifood", "rappi", "uber eats", "zé delivery", "aiqfome",
        "delivery", "entrega", "pizzaria", "hamburgueria", "sushi",
    ],
    "transporte": [
        "uber", "99", "cabify", "taxi", "combustivel", "gasolina",
        "etanol", "posto", "shell", "ipiranga", "br", "pedagio",
        "estacionamento", "parking", "bilhete unico", "metro", "onibus",
    ],
    "moradia": [
        "aluguel", "condominio", "iptu", "luz", "energia", "enel",
        "cemig", "agua", "sabesp", "gas", "comgas", "internet",
        "telefone", "vivo", "claro", "tim", "oi",
    ],
    "saúde": [
        "farmacia", "drogaria", "droga", "raia", "pacheco", "drogasil",
        "hospital", "clinica", "medico", "consulta", "exame", "laboratorio",
        "plano de saude", "unimed", "amil", "bradesco saude",
    ],
    "lazer": [
        "cinema", "teatro", "show", "ingresso", "netflix", "spotify",
        "amazon prime", "disney", "hbo", "globoplay", "youtube premium",
        "bar", "restaurante", "lanchonete", "cafe", "starbucks",
    ],
    "jogos": [
        "steam", "playstation", "xbox", "nintendo", "epic games",
        "riot", "blizzard", "ea sports", "ubisoft", "game", "jogo",
        "bet", "aposta", "loteria", "mega sena",
    ],
    "assinaturas": [
        "assinatura", "mensalidade", "anual", "recorrente",
        "academia", "smart fit", "bio ritmo", "gympass",
    ],
    "educação": [
        "escola", "faculdade", "universidade", "curso", "udemy",
        "coursera", "alura", "livro", "livraria", "saraiva", "cultura",
    ],
    "compras": [
        "amazon", "mercado livre", "magalu", "magazine luiza",
        "americanas", "shopee", "aliexpress", "shein", "renner",
        "c&a", "riachuelo", "zara", "shopping",
    ],
    "transferência": [
        "pix", "ted", "doc", "transferencia", "deposito",
    ],
    "salário": [
        "salario", "pagamento", "folha", "remuneracao", "pro-labore",
    ],
    "investimentos": [
        "investimento", "aplicacao", "cdb", "tesouro", "acao",
        "fundo", "corretora", "xp", "rico", "clear", "nuinvest",
    ],
}

# Character classes spelled out so the JVM and the SQL oracle (RE2) agree:
# letters, numbers and underscore are word characters.
# The rules "non-word -> space", "digit run -> space" and "collapse whitespace" in one class: white
# space is no word character and \p{N} is \p{Nd}, \p{Nl} and \p{No}.
GAPS = r"[^\p{L}\p{Nl}\p{No}_]+"


def normalize_text(c) -> Column:
    """lower; non-word characters -> space; digit runs -> space; collapse
    whitespace; trim.  Accented letters stay (no accent folding)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), GAPS, " "))


def _category_hits(text: pa.Array) -> np.ndarray:
    """(rows, categories): does the text contain one of the category's keywords?  One pass of an
    automaton over a batch's bytes for each category, whatever the number of keywords."""
    text = text.cast(pa.binary())
    return np.stack([pc.fill_null(pc.match_substring_regex(text, "|".join(map(re.escape, kws))), False).to_numpy(zero_copy_only=False)
                     for kws in KEYWORD_RULES.values()], axis=1)


def keyword_counts(text: Column) -> Column:
    """Per category, in order, the number of its keywords that occur in ``text`` as a
    substring (presence, not occurrences).  Single keywords are looked up only in the
    texts that contain one of the category's."""
    @F.arrow_udf("array<int>")
    def count(t: pa.Array) -> pa.Array:
        hits = _category_hits(t)
        n, raw = hits.astype(np.int32), t.cast(pa.binary())
        for c, kws in enumerate(KEYWORD_RULES.values()):
            of, at = [k.encode() for k in kws], np.flatnonzero(hits[:, c])
            n[at, c] = [sum(k in b for k in of) for b in (raw[int(i)].as_py() for i in at)]
        ends = pa.array(np.arange(len(n) + 1) * n.shape[1], pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(n.ravel()))
    return count(text)


def suggest_categories(t: Column, limit: int = 5) -> Column:
    """Categories with a keyword containing the text or contained in it, in
    dictionary order, first ``limit``; none -> [outros].  ``t`` must already be
    lower-cased.  Only a text no longer than the longest keyword can lie inside one."""
    names = pa.array([*KEYWORD_RULES, "outros"])
    rules = [[k.encode() for k in kws] for kws in KEYWORD_RULES.values()]
    longest = max(len(k) for kws in rules for k in kws)

    @F.arrow_udf("array<string>")
    def suggest(t: pa.Array) -> pa.Array:
        hits = _category_hits(t)
        raw = t.cast(pa.binary())
        short = np.flatnonzero(pc.fill_null(pc.less_equal(pc.binary_length(raw), longest), False).to_numpy(zero_copy_only=False))
        parts = pc.dictionary_encode(raw.take(pa.array(short)))
        inside = [[any(p in k for k in kws) for kws in rules] for p in parts.dictionary.to_pylist()]
        if inside:
            hits[short] |= np.array(inside)[parts.indices.to_numpy(zero_copy_only=False)]
        first = hits & (np.cumsum(hits, axis=1) <= limit)
        row, place = np.nonzero(np.column_stack([first, ~hits.any(axis=1)]))
        ends = pa.array(np.searchsorted(row, np.arange(len(hits) + 1)), pa.int32())
        return pa.ListArray.from_arrays(ends, names.take(pa.array(place)))
    return suggest(t)
