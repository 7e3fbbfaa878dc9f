import re

from pyspark.sql import functions as F

from evidex.llm.license import ACCEPT, BASE, rare_postings, scan_licenses, templates


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    base = [(i, label) for p, label in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found, score = {x for _, x in base}, 0.0
    for t in templates():
        n = len(t["words"])
        for o in range(-n, len(w)):
            hit = [0 <= o + j < len(w) and w[o + j] == t["words"][j] for j in range(n)]
            have = sum(x for x, h in zip(t["weights"], hit) if h)
            if have * 100 >= ACCEPT * t["total"] and all(hit[t["k0"] : t["k1"] + 1]):
                found.add(t["label"])
                score = max(score, have / t["total"])
    places = sorted(i for i, _ in base)
    return (len(w), len(base), places[0] if places else None, places[-1] if places else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(found)), score)


TEXTS = [
    None, "", "   ", "!!", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0.",
    "x Licensed under CC BY-NC 4.0. y", "This work is licensed under the GNU General Public License, version 3.", "UNDER THE MIT LICENKE under the mİt license",
    "licensed under the gnu affero public license version 3", "license " * 500, "under the mit license " * 200, "é" * 10 + " cc by sa 4 0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and all documentation files",
    "hereby granted free of charge", "mit license", "the " * 30_000 + "cc by nc",
]


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("labels", F.lit("x")).withColumn("_w", F.lit(1))
    got = scan_licenses(df).drop("matches").collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((i, *brute(t))) for i, t in rows)
    assert scan_licenses(df.limit(0)).count() == 0


def test_index_posts_what_acceptance_needs():
    index = rare_postings()
    for t, x in enumerate(templates()):
        posted = {p["p"] for ps in index.values() for p in ps if p["t"] == t}
        rest = sum(w for i, w in enumerate(x["weights"]) if i not in posted)
        assert rest * 100 < ACCEPT * x["total"]
