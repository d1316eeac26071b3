"""Operator 4: licence scans by Dice coefficient over word bigrams, in DataFrame functions only.

A document is scanned in units: its whole text, its paragraphs and its lines; then in runs of words that stand anywhere in it,
which find licences that share a unit with other text or spread over several.  Units and templates are normalised
(lower case, copyright notices with a year left out, anything but a-z and 0-9 a space) and compared by
2 * |A & B| / (|A| + |B|) over their distinct word bigrams.  A pair can reach the threshold t only if the smaller set has
at least t / (2 - t) of the larger one's size, so each unit meets only templates within those bounds, and most units none.
The templates are a fixed list sent along with the plan; nothing is shuffled.

Cases: null and empty texts, and units of fewer than two words, match nothing; of templates with equal scores the
first by name wins; repeated rows each come back; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Licence names and the texts or notices that state them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause without disclaimer": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause without disclaimer": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC without liability": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "MIT notice": "Released under the MIT License.",
    "MIT without disclaimer": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "Unlicense first paragraphs": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
# the complete standard texts, each in a file of its licence's name
TEMPLATES |= {path.stem: path.read_text() for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
NOTICE = r"copyright +(\(c\) *)?[0-9]{4}[^\n]*"


def words_of(text: str) -> list[str]:
    """The normalised words of a template."""
    return re.sub(r"[^a-z0-9]+", " ", re.sub(NOTICE, " ", text.lower())).split()


@lru_cache(maxsize=256)
def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def normalised(text: Column) -> Column:
    """The normalised words as an array; of a text without any, one empty word."""
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), NOTICE, " "), "[^a-z0-9]+", " ")), " ")


def all_words(text: Column) -> Column:
    """As ``normalised``, with the copyright notices; in a text without line breaks one would take what follows it."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def bigrams(words: Column) -> Column:
    """The bigrams in their order, with repeats."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def listed_bigrams(template: list[str]) -> Column:
    """A template's bigrams as one constant."""
    return F.split(F.lit("|".join(template)), "[|]")


def units(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, unit, place, raw, pairs, own): the bigrams of the whole text, of paragraphs and of lines where there are several; raw and pairs (in order, with copyright notices) of the whole text alone."""
    t = F.coalesce(F.col(text), F.lit(""))
    listed = lambda name, parts, raw: F.transform(parts, lambda x, i: F.struct(F.lit(name).alias("unit"), i.cast("long").alias("place"), raw(x).alias("raw"), normalised(x).alias("words")))
    some = lambda parts: F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))
    none = lambda x: F.lit(None).cast("string")
    every = F.concat(listed("text", F.array(t), lambda x: x), listed("paragraph", some(F.split(t, r"\n\n+")), none), listed("line", some(F.split(t, r"\n")), none))
    # what explode() makes is computed once, however many expressions use it
    split = docs.select(F.col(doc_id).alias("doc_id"), F.explode(every).alias("u"))
    split = split.select("doc_id", "u.unit", "u.place", "u.raw", F.explode(F.array(bigrams(F.col("u.words")))).alias("pairs"))
    noticed = F.lower("raw").contains("copyright")
    pairs = F.when(noticed, bigrams(all_words(F.col("raw")))).when(F.col("raw").isNotNull(), F.col("pairs"))
    return split.select("doc_id", "unit", "place", "raw", F.explode(F.array(F.struct(pairs.alias("pairs"), F.array_distinct("pairs").alias("own")))).alias("b")).select("doc_id", "unit", "place", "raw", "b.*")


def dice_of(own: Column, template: list[str]) -> Column:
    return 2.0 * F.size(F.array_intersect(own, listed_bigrams(template))) / (F.size(own) + len(template))


def runs(name: str, template: list[str], n_pairs: int, threshold: float) -> Column:
    """The runs of words in ``pairs`` that reach the threshold with a template, as structs (dice, license, start, stop) of pairs.

    A shared bigram adds 2 - t and another one takes t: a run reaches t exactly if its sum is t times the template's size
    (bigrams that repeat within it aside), so runs of highest sum are found in one pass over the shared bigrams.  A run ends where
    its sum is used up, or where what is left of the template can't make up for the loss since its highest point.
    """
    gain, share = 2 - threshold, threshold / (2 - threshold)
    listed, kept = ", ".join(f"'{b}'" for b in template), f"{share * len(template)!r}D"
    ended = f"if(s.shared >= {kept}, array_append(s.done, struct(s.start as start, s.stop as stop, s.shared as shared)), s.done)"
    low = f"(s.sum - {threshold!r}D * (p - s.last - 1))"
    closed = f"(s.hits = 0 or {low} <= 0 or (p - s.last > 1 and s.best - {low} >= {gain!r}D * ({n_pairs} - s.hits)))"
    higher = f"({closed} or {low} + {gain!r}D > s.best)"
    # SQL, as building it from columns for every template takes the driver many seconds
    found = f"""aggregate(
      filter(transform(pairs, (x, i) -> if(x in ({listed}), i, null)), x -> x is not null),
      struct(0D as sum, 0 as hits, 0 as start, 0 as last, 0D as best, 0 as stop, 0 as shared, cast(array() as array<struct<start: int, stop: int, shared: int>>) as done),
      (s, p) -> struct(
        if({closed}, {gain!r}D, {low} + {gain!r}D) as sum, if({closed}, 1, s.hits + 1) as hits, if({closed}, p, s.start) as start, p as last,
        case when {closed} then {gain!r}D when {higher} then {low} + {gain!r}D else s.best end as best, if({higher}, p, s.stop) as stop,
        case when {closed} then 1 when {higher} then s.hits + 1 else s.shared end as shared, if({closed}, {ended}, s.done) as done),
      s -> {ended})"""
    own, whole = "array_distinct(slice(pairs, r.start + 1, r.stop - r.start + 1))", f"split('{"|".join(template)}', '[|]')"
    dice = f"round(2D * size(array_intersect({own}, {whole})) / (size({own}) + {len(template)}), 9)"
    scored = f"transform({found}, r -> struct({dice} as dice, {chr(39) + name + chr(39)} as license, r.start as start, r.stop as stop))"
    return F.expr(f"filter({scored}, r -> r.dice >= {threshold!r}D)")


def same_place(a: Column, b: Column) -> Column:
    """Whether two runs of pairs overlap in half of either or more."""
    both = F.least(a["stop"], b["stop"]) - F.greatest(a["start"], b["start"]) + 1
    return 2 * both >= F.greatest(a["stop"] - a["start"], b["stop"] - b["start"]) + 1


def unit_places(raw: Column) -> Column:
    """The units of a text as structs (start, stop, own): where they stand in its pairs, and their bigrams."""

    def placed(parts: Column) -> Column:
        sizes = F.transform(parts, lambda x: F.size(F.filter(all_words(x), lambda w: w != "")))
        ends = F.aggregate(sizes, F.array(F.lit(0)), lambda s, n: F.array_append(s, F.element_at(s, -1) + n))
        owns = F.transform(parts, lambda x: F.array_distinct(bigrams(normalised(x))))
        return F.transform(F.arrays_zip(ends.alias("a"), sizes.alias("n"), owns.alias("own")), lambda u: F.struct(u["a"].alias("start"), (u["a"] + u["n"] - 2).alias("stop"), u["own"].alias("own")))

    return F.filter(F.concat(placed(F.array(raw)), placed(F.split(raw, r"\n\n+")), placed(F.split(raw, r"\n"))), lambda u: u["stop"] >= u["start"])


def _scan(docs: DataFrame, doc_id: str, text: str, templates: dict[str, str], threshold: float, with_runs: bool) -> DataFrame:
    known = {name: b for name, x in sorted(templates.items()) if (b := bigrams_of(x))}
    if not known:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit("").alias("unit"), F.lit(0).cast("long").alias("place"), F.lit("").alias("license"), F.lit(0.0).alias("dice")).where("false")
    share = threshold / (2 - threshold)
    sizes = sorted({len(b) for b in known.values()})
    n = F.size("own")
    near = [(n >= share * s) & (n * share <= s) for s in sizes]
    wide = near[0]
    for one in near[1:]:
        wide = wide | one
    found = units(docs, doc_id, text)
    if with_runs:
        every = ", ".join(f"'{b}'" for b in sorted({b for x in known.values() for b in x}))
        found = found.withColumn("hits", F.explode(F.array(F.expr(f"case when raw is not null then filter(pairs, x -> x in ({every})) end"))))
        wide = wide | (F.size("hits") >= share * sizes[0])
    found = found.where(wide)

    def compared(name: str, template: list[str]) -> Column:
        dice = dice_of(F.col("own"), template)
        inside = (n >= share * len(template)) & (n * share <= len(template))
        return F.when(inside, F.struct(F.round(dice, 9).alias("dice"), F.lit(name).alias("license")))

    scores = F.filter(F.array(*[compared(k, v) for k, v in known.items()]), lambda x: x["dice"] >= threshold)
    if with_runs:
        # a run shares at least share of a template's bigrams, and so does its text
        nothing = F.array().cast("array<struct<dice: double, license: string, start: int, stop: int>>")

        def enough(template: list[str]) -> Column:
            return (F.size("hits") >= share * len(template)) & (F.size(F.array_intersect("hits", listed_bigrams(template))) >= share * len(template))

        run = F.flatten(F.array(*[F.when(enough(v), runs(k, v, len(words_of(templates[k])) - 1, threshold)).otherwise(nothing) for k, v in known.items()]))
        found = found.withColumn("run", F.explode(F.array(F.when(F.col("raw").isNotNull(), run).otherwise(nothing))))
        better = lambda a, b: (a["dice"] > b["dice"]) | ((a["dice"] == b["dice"]) & (a["license"] < b["license"]))
        found = found.withColumn("run", F.explode(F.array(F.filter("run", lambda a: ~F.exists("run", lambda b: same_place(a, b) & better(b, a))))))
        found = found.withColumn("units", F.explode(F.array(F.when(F.size("run") > 0, unit_places(F.col("raw"))))))
        named = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), listed_bigrams(v))])

        def shown(r: Column) -> Column:
            """Whether a unit in the run's place reaches the threshold as well."""
            template = F.element_at(named, r["license"])
            dice = lambda own: F.round(2.0 * F.size(F.array_intersect(own, template)) / (F.size(own) + F.size(template)), 9)
            return F.exists("units", lambda u: same_place(u, r) & (dice(u["own"]) >= F.least(r["dice"], F.lit(threshold))))

        left = F.transform(F.filter("run", lambda r: ~shown(r)), lambda r: F.struct(F.lit("run").alias("unit"), r["start"].cast("long").alias("place"), r["license"].alias("license"), r["dice"].alias("dice")))
    # the order of the array is that of the names; the first of the highest wins
    best = F.try_element_at(F.filter("scores", lambda x: x["dice"] == F.array_max(F.transform("scores", lambda y: y["dice"]))), F.lit(1))
    found = found.withColumn("scores", F.explode(F.array(scores)))
    if not with_runs:
        found = found.where(F.size("scores") > 0).withColumn("best", best)
        return found.select("doc_id", "unit", "place", F.col("best.license").alias("license"), F.col("best.dice").alias("dice"))
    one = F.array(F.struct("unit", "place", best["license"].alias("license"), best["dice"].alias("dice")))
    out = F.concat(F.filter(one, lambda x: x["dice"].isNotNull()), left)
    return found.where((F.size("scores") > 0) | (F.size("run") > 0)).select("doc_id", F.explode(out).alias("o")).select("doc_id", "o.*")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, unit, place, license, dice): the best template of every text, paragraph and line that reaches the threshold."""
    return _scan(docs, doc_id, text, templates, threshold, False)


def scan_with_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``scan``, and as unit "run" the runs of words where no unit in their place reaches the threshold with the same licence; place: the run's first word."""
    return _scan(docs, doc_id, text, templates, threshold, True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every licence text or notice in the documents."""
    return scan_with_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(TEMPLATES.items()))}) AS v(license, body)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT doc_id, 'text' AS unit, 0::BIGINT AS place, text AS body FROM d
  UNION ALL SELECT doc_id, 'paragraph', (i - 1)::BIGINT, p[i] FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\n+') AS p FROM d) WHERE len(p) > 1)
  UNION ALL SELECT doc_id, 'line', (i - 1)::BIGINT, p[i] FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM d) WHERE len(p) > 1)
),
w AS (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(lower(body), '{NOTICE}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM (SELECT doc_id, unit, place, body FROM u UNION ALL SELECT NULL, license, -1, body FROM t)),
b AS (SELECT doc_id, unit, place, list_distinct(list_transform(generate_series(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1])) AS own FROM w WHERE len(words) > 1),
s AS (
  SELECT x.doc_id, x.unit, x.place, y.unit AS license, round(2.0 * len(list_intersect(x.own, y.own)) / (len(x.own) + len(y.own)), 9) AS dice
  FROM b x JOIN b y ON x.place >= 0 AND y.place = -1
)
SELECT doc_id, unit, place, license, dice FROM s WHERE dice >= {THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY dice DESC, license) = 1
"""
