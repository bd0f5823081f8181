"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies.

Words are runs of letters and digits in lower case; shingles are five words. A template of ``t`` shingles
is looked for in windows of ``t + stride - 1`` shingles, ``stride`` a quarter of ``t``, so every run of
``t`` shingles lies whole in one of them. A window that holds 0.8 of a template then has a Jaccard
similarity of at least 0.8 / 1.45 with it, and ``BANDS`` bands of one row collide with probability
``1 - 0.45 ** 12``, over 0.9999. Windows that collide are held against the template's shingles themselves.

A band's value is the hash of one of the window's shingles, so a window without any shingle of a template
can't collide with it. Only windows around shared shingles are laid out, each with its words alone; the
hash of every shingle of a text is a row that lives within the scan and is never stored. Only DataFrame
functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table

SHINGLE, BANDS, CONTAINED = 5, 12, 0.8

# Notices and paragraphs of public licenses.
TEMPLATES = {
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "BSD-disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"
    ),
    "CC-BY-4.0": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-long": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-long": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "waived all copyright and related or neighboring rights to this work",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-disclaimer": (
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "MIT-notice": "Licensed under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in "
        "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(w: str) -> Column:
    parts = ", ".join(f"{w}[i + {k}]" for k in range(SHINGLE))
    return F.expr(f"case when size({w}) < {SHINGLE} then cast(array() as array<bigint>) else transform(sequence(0, size({w}) - {SHINGLE}), i -> xxhash64({parts})) end")


def _shingles(w: Column) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")))


def _bands(h: Column) -> Column:
    """``BANDS`` MinHash values of an array of hashes."""
    return F.array(*(F.array_min(F.transform(h, _seeded(n))) for n in range(BANDS)))


def _seeded(n: int):
    return lambda x: F.xxhash64(x, F.lit(n))


def stride(t: int) -> int:
    return max(1, t // 4)


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """``license, t, shingles, h`` of every template."""
    rows = spark.createDataFrame(sorted(texts.items()), "license string, text string").select("license", words(F.col("text")).alias("w"))
    rows = rows.select("license", _shingles(F.col("w")).alias("shingles"), _hashes("w").alias("h"))
    return rows.select("license", F.size("h").alias("t"), "shingles", "h")


def _around(at: Column, t: Column) -> Column:
    """The first words of the windows for templates of ``t`` shingles that hold the shingle at ``at``."""
    step = F.greatest(F.lit(1), F.floor(t / 4))
    low = F.ceil(F.greatest(F.lit(0), at - t - step + 2) / step)
    return F.transform(F.sequence(low, F.floor(at / step)), lambda k: k * step)


def scan(docs: DataFrame, texts: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """``doc_id, license, containment, first_word``: every document and template that one of its windows holds.

    ``containment`` is the share of the template's different shingles in the best window, at least
    ``contained``; ``first_word`` is where that window starts, the first of equals. Whole texts are read,
    each row's on its own; of rows with the same id, null included, the best window of any comes out.
    Null and empty texts hold nothing. Templates of fewer words than a shingle are refused. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = TEMPLATES if texts is None else texts
    known = templates(spark, texts)
    listed = known.collect()  # the templates given, not data
    if short := [r.license for r in listed if not r.t]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    marks = spark.createDataFrame(sorted({(x, r.t) for r in listed for x in r.h}), "h long, t int")
    # a row is known by its id and a hash of its text; equal ones have the same windows
    split = docs.select("doc_id", F.xxhash64("text").alias("row"), words(F.col("text")).alias("w"))
    places = F.when(F.size("w") >= SHINGLE, F.sequence(F.lit(0), F.size("w") - SHINGLE))
    shingles = split.select("doc_id", "row", "w", F.explode(places).alias("at"))
    hashed = shingles.select("doc_id", "row", "w", "at", F.xxhash64(*(F.get("w", F.col("at") + k) for k in range(SHINGLE))).alias("h"))
    hits = hashed.join(F.broadcast(marks), "h")  # a row for each shingle of the templates
    first, size = F.col("first_word"), F.col("t") + F.greatest(F.lit(1), F.floor(F.col("t") / 4)) - 1
    laid = hits.select("doc_id", "row", "w", "t", F.explode(_around(F.col("at"), F.col("t"))).alias("first_word"))
    laid = laid.select("doc_id", "row", "t", "first_word", F.slice("w", (first + 1).cast("int"), (size + SHINGLE - 1).cast("int")).alias("w"))
    windows = laid.groupBy("doc_id", "row", "t", "first_word").agg(F.first("w").alias("w"))
    banded = windows.select("*", F.posexplode(_bands(_hashes("w"))).alias("band", "value"))
    asked = known.select("license", "t", "shingles", F.posexplode(_bands(F.col("h"))).alias("band", "value"))
    near = banded.join(F.broadcast(asked), ["t", "band", "value"])  # BANDS rows a template
    one = near.groupBy("doc_id", "row", "t", "first_word", "license").agg(F.first("w").alias("w"), F.first("shingles").alias("shingles"))
    share = F.size(F.array_intersect("shingles", _shingles(F.col("w")))) / F.size("shingles")
    held = one.select("doc_id", "license", "first_word", share.alias("containment")).where(F.col("containment") >= contained)
    best = held.groupBy("doc_id", "license").agg(F.max(F.struct("containment", (-first).alias("before"))).alias("best"))
    return best.select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.before")).cast("long").alias("first_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _words_sql(column: str) -> str:
    return f"string_split(trim(regexp_replace(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"


def _shingles_sql(table_: str, key: str) -> str:
    """``key, pos, shingle`` for every shingle of the words ``w``."""
    return (
        f"SELECT {key}, unnest(range(0, len(w) - {SHINGLE - 1})) AS pos, "
        f"unnest(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))) AS shingle, len(w) - {SHINGLE - 1} AS n "
        f"FROM {table_} WHERE len(w) >= {SHINGLE}"
    )


_VALUES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in sorted(TEMPLATES.items()))
#: All windows, by the shingles they share with a template; the bands miss fewer than one in 10,000 at the lowest containment.
ORACLE_SQL = f"""
WITH given AS (SELECT license, {_words_sql("text")} AS w FROM (VALUES {_VALUES}) v(license, text)),
template AS ({_shingles_sql("given", "license")}),
sized AS (SELECT license, any_value(n) AS t, count(DISTINCT shingle) AS kinds, greatest(1, any_value(n) // 4) AS step FROM template GROUP BY license),
split AS (SELECT doc_id, row_number() OVER () AS nr, {_words_sql("text")} AS w FROM documents),
shingles AS ({_shingles_sql("split", "doc_id, nr")}),
shared AS (SELECT DISTINCT doc_id, nr, license, pos, shingle, n FROM shingles JOIN (SELECT DISTINCT license, shingle FROM template) USING (shingle)),
placed AS (
    SELECT doc_id, nr, license, shingle, kinds, step * unnest(range(greatest(0, (pos - t - step + 2 + step - 1) // step), pos // step + 1)) AS first_word
    FROM shared JOIN sized USING (license)
),
windows AS (SELECT doc_id, nr, license, first_word, count(DISTINCT shingle) / any_value(kinds) AS containment FROM placed GROUP BY ALL HAVING containment >= {CONTAINED}),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, first_word) AS place FROM windows)
SELECT doc_id, license, containment, CAST(first_word AS BIGINT) AS first_word FROM best WHERE place = 1
"""
