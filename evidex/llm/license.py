"""License scans by a positional rare-token index.

Each licence notice is a template of words with an inverse document frequency
over the templates.  The index posts, for every template, its rarest words only:
as many as needed that no alignment can reach the accepted share without one of
them.  A file's words that the index knows propose template alignments (file
position less template position); an alignment counts when the aligned words
hold ACCEPT per cent of the template's weight and its mandatory key phrase
stands word for word at its place.  DataFrame functions only, one narrow pass.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases and labels that a scan reports at least.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Label, notice as lower-case words, key phrase that must stand in it.
NOTICES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", "lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "affero general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    ("cc-by", "creative commons attribution 4 0 international license", "commons attribution 4 0 international"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0 universal"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]

#: Share of a template's weight, in per cent, that an alignment must hold.
ACCEPT = 75
#: Words are runs of digits, letters and characters beyond ASCII; this matches what stands between them.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def templates() -> list[dict]:
    """Label, words, whole weights, their total, and where the key phrase starts and ends (inclusive)."""
    texts = [n.split() for _, n, _ in NOTICES]
    df = {w: sum(w in t for t in texts) for t in texts for w in t}
    out = []
    for (label, _, key), words in zip(NOTICES, texts, strict=True):
        k = key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        weights = [round(1000 * math.log(1 + len(texts) / df[w])) for w in words]
        out.append({"label": label, "words": words, "weights": weights, "total": sum(weights), "k0": at, "k1": at + len(k) - 1})
    return out


def rare_postings() -> dict[str, list[dict]]:
    """Word -> (template, position), for each template's rarest words: without them less than ACCEPT per cent is left."""
    index: dict[str, list[dict]] = {}
    for t, x in enumerate(templates()):
        places = sorted(range(len(x["words"])), key=lambda i: (-x["weights"][i], i))
        taken = 0
        for i in places:
            if (x["total"] - taken) * 100 < ACCEPT * x["total"]:
                break
            taken += x["weights"][i]
            index.setdefault(x["words"][i], []).append({"t": t, "p": i})
    return index


def ascii_lower(text: Column) -> Column:
    """Lower case such that no letter beyond ASCII turns into an ASCII one (Kelvin sign, dotted capital I)."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue001")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, and matches (label, first word, share) of every row.

    Base: places where a BASE phrase's words stand consecutively; their labels are
    always among `labels`.  score: highest share of an accepted alignment, else 0.
    A null text is an empty one: no words, no labels.  Repeated rows are scanned
    alike; equal alignments of several templates of one label give one label; extra
    columns have no effect; an empty table gives an empty result.
    """
    index, phrases = rare_postings(), [(p.split(), label) for p, label in BASE]
    known = sorted({*index, *(max(p, key=len) for p, _ in phrases)})
    tpl = F.from_json(F.lit(json.dumps(templates())), "array<struct<label:string,words:array<string>,weights:array<bigint>,total:bigint,k0:int,k1:int>>")
    posts = F.from_json(F.lit(json.dumps(index)), "map<string,array<struct<t:int,p:int>>>")

    split = docs.select(F.col(id_col).alias("_id"), F.split(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), BETWEEN).alias("_s"))
    ends = (F.get("_s", F.lit(0)) == "").cast("bigint") + ((F.size("_s") > 1) & (F.element_at("_s", -1) == "")).cast("bigint")
    counted = split.select("_id", (F.size("_s") - ends).alias("n_words"), F.when(F.arrays_overlap("_s", F.array(*map(F.lit, known))), F.filter("_s", lambda w: w != "")).alias("_w"))

    def places(words: list[str]) -> Column:
        at = lambda i, k: F.get("_w", (i + k).cast("int")) == words[k]

        def here(i):
            ok = at(i, 0)
            for k in range(1, len(words)):
                ok = ok & at(i, k)
            return F.coalesce(ok, F.lit(False))

        return F.when(F.size("_w") >= len(words), F.filter(F.sequence(F.lit(0), F.size("_w") - len(words)), here)).otherwise(F.array().cast("array<int>"))

    base = counted.select("*", *[places(p).alias(f"_b{k}") for k, (p, _) in enumerate(phrases)], posts.alias("_posts"), tpl.alias("_tpl"))
    proposed = """
        array_distinct(flatten(transform(
            filter(transform(_w, (x, i) -> struct(x AS w, i AS i)), a -> map_contains_key(_posts, a.w)),
            a -> transform(_posts[a.w], p -> struct(p.t AS t, a.i - p.p AS o)))))"""
    share = """
        transform(_c, c -> struct(_tpl[c.t].label AS label, c.o AS first_word,
            forall(sequence(_tpl[c.t].k0, _tpl[c.t].k1), j -> get(_w, c.o + j) <=> _tpl[c.t].words[j]) AS key,
            aggregate(sequence(0, size(_tpl[c.t].words) - 1), 0L, (s, j) -> s + if(get(_w, c.o + j) <=> _tpl[c.t].words[j], _tpl[c.t].weights[j], 0L)) AS have,
            _tpl[c.t].total AS total))"""
    found = (
        base.withColumn("_c", F.when(F.col("_w").isNotNull(), F.expr(proposed)))
        .withColumn("_m", F.expr(f"transform(filter({share}, m -> m.key AND m.have * 100 >= {ACCEPT} * m.total), m -> struct(m.label AS label, m.first_word AS first_word, m.have / m.total AS share))"))
    )
    all_places = F.flatten(F.array(*[F.coalesce(f"_b{k}", F.array().cast("array<int>")) for k in range(len(phrases))]))
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"_b{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]))
    matched = F.coalesce("_m", F.expr("cast(array() as array<struct<label:string,first_word:int,share:double>>)"))
    done = found.select("_id", "n_words", all_places.alias("_p"), base_labels.alias("_l"), matched.alias("matches"))
    return done.select(
        F.col("_id").alias(id_col),
        F.col("n_words").cast("bigint"),
        F.size("_p").cast("bigint").alias("n_base"),
        F.array_min("_p").cast("bigint").alias("first_word"),
        F.array_max("_p").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_l")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_l", F.transform("matches", lambda m: m["label"])))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
        "matches",
    )


def license_sql() -> str:
    """The same by brute force in SQL: every alignment of every template."""
    rows = ", ".join(f"({t}, '{x['label']}', {x['total']}, {i}, '{w}', {x['weights'][i]}, {int(x['k0'] <= i <= x['k1'])}, {x['k1'] - x['k0'] + 1})" for t, x in enumerate(templates()) for i, w in enumerate(x["words"]))
    base = " UNION ALL ".join("SELECT a.doc_id, a.i, '{}' AS label FROM w a {} WHERE a.w = '{}'".format(label, " ".join(f"JOIN w b{k} ON b{k}.doc_id = a.doc_id AND b{k}.i = a.i + {k} AND b{k}.w = '{x}'" for k, x in enumerate(p.split()) if k), p.split()[0]) for p, label in BASE)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS a FROM documents),
w AS (SELECT doc_id, unnest(a) AS w, unnest(range(len(a))) AS i FROM d),
t(t, label, total, p, w, weight, key, keys) AS (VALUES {rows}),
m AS (SELECT doc_id, label, sum(weight) / any_value(total) AS share FROM w JOIN t USING (w) GROUP BY doc_id, t.t, label, i - p HAVING sum(weight) * 100 >= {ACCEPT} * any_value(total) AND sum(key) = any_value(keys)),
b AS ({base}),
bl AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION SELECT doc_id, label FROM b) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS score FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN bl USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""
