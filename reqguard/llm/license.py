"""Operator 2: licence scans. MinHash bands over overlapping text windows retrieve templates, and the exact containment
of word shingles verifies them."""

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqguard.llm.text import let, lower_ascii, text_or_empty, window_hashes, words

#: Notices of public licences, as they stand in files.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD-clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and "
                  "the following disclaimer.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Windows of WINDOW words start at every STEP words, so each run of WINDOW - STEP + 1 = 9 words lies whole in one.
WINDOW, STEP = 16, 8
#: Words in a shingle: for retrieval, and for verification.
SKETCH_SHINGLE, SHINGLE = 3, 5
#: A window's MinHash is its BANDS smallest shingle hashes; each is a band of one row.
BANDS = 11
CONTAINED = 0.75


def missed(template_words: int) -> float:
    """The probability that a window which holds so many words of a template in a row shares no band with it: all its
    shingles of the template are among the largest hashes, which the bands leave out."""
    n, own = WINDOW - SKETCH_SHINGLE + 1, template_words - SKETCH_SHINGLE + 1
    return comb(n - own, BANDS) / comb(n, BANDS) if n - own >= BANDS else 0.0


def windows(hashes: Column) -> Column:
    """The sorted smallest hashes of each window, from the hashes of all shingles; the last window may be shorter."""
    n = WINDOW - SKETCH_SHINGLE + 1
    starts = F.when(F.size(hashes) > 0, F.sequence(F.lit(1), F.size(hashes), F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(F.sort_array(F.slice(hashes, i, n)), 1, BANDS))


def shingles(w: Column, width: int = SHINGLE) -> Column:
    """Distinct runs of words as text; a shorter text is one shingle, an empty one none."""
    n = F.size(w)
    starts = F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1)))
    return F.array_distinct(F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(w, i, width), " ")))
                            .otherwise(F.array().cast("array<string>")))


def template_table(spark, templates: dict[str, str]) -> list[tuple[str, list[int], list[str]]]:
    """Name, shingle hashes for retrieval and shingles for verification of each template. Every shingle hash of a template
    can be among the bands of a window on it, so all are keys. Templates are a parameter of the operator and few."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    rows = rows.select("name", let(words(lower_ascii(F.col("text"))), lambda w: F.struct(
        window_hashes(w, SKETCH_SHINGLE).alias("keys"), shingles(w).alias("shingles"))).alias("t"))
    return [(r["name"], list(r["t"]["keys"]), list(r["t"]["shingles"])) for r in rows.collect()]


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """Every row of docs (doc_id, text, others) -> a row per template found: doc_id, license, n_found, n_template,
    containment.

    Containment is the share of the template's distinct five-word shingles that the text has; words are lower-cased.
    Templates need three words or more. Null and empty texts match nothing; long texts are scanned whole; repeated rows
    give repeated results; a null id passes through; an empty table gives an empty result; other columns are not read.
    There is no shuffle and no join: templates are literals of the plan.
    """
    found = template_table(docs.sparkSession, templates)
    if any(not keys for _, keys, _ in found):
        raise ValueError(f"templates need {SKETCH_SHINGLE} words or more")
    all_keys = F.lit(sorted({k for _, keys, _ in found for k in keys}))

    def scan(w):
        hits = lambda h: F.flatten(F.transform(windows(h), lambda band: F.array_intersect(band, all_keys)))

        def verify(s, hit):
            def of(name, keys, own):
                n = F.size(F.array_intersect(F.lit(own), s))
                row = F.struct(F.lit(name).alias("license"), n.cast("long").alias("n_found"), F.lit(len(own)).cast("long").alias("n_template"))
                return F.when(F.arrays_overlap(hit, F.lit(keys)) & (n >= contained * len(own)), row)
            return F.filter(F.array(*[of(*t) for t in found]), lambda x: x.isNotNull())

        none = F.array().cast("array<struct<license:string,n_found:bigint,n_template:bigint>>")
        return let(let(window_hashes(w, SKETCH_SHINGLE), hits),
                   lambda hit: F.when(F.size(hit) == 0, none).otherwise(let(shingles(w), lambda s: verify(s, hit))))

    matches = docs.select("doc_id", let(words(lower_ascii(text_or_empty(docs["text"]))), scan).alias("m"))
    return matches.select("doc_id", F.explode("m").alias("m")).select(
        "doc_id", "m.license", "m.n_found", "m.n_template", (F.col("m.n_found") / F.col("m.n_template")).alias("containment"))
