"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from random import Random

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.llm.frames import quoted

UNKNOWN, GRAMS = "unknown", (1, 2, 3)
# A family needs this probability, and this share of the three-word shingles of one of its templates or of the paragraph.
LEAST_PROBABILITY, LEAST_ALIKE = 0.5, 0.6
# Variants of each text in the training set.
VARIANTS = 12
# Words that a line of a wrapped notice has at least in the training set.
LEAST_WRAPPED = 6

# Wording of licence notices, a family's notices one per line.
TEMPLATES = {
    "MIT": """MIT License
License: MIT
Released under the MIT License
The MIT License (MIT)
Licensed under the MIT license
This project is licensed under the terms of the MIT license
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software""",
    "Apache-2.0": """Apache License
License: Apache
Apache License 2.0
Licensed under the Apache License, Version 2.0
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License
Apache License Version 2.0, January 2004
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS""",
    "GPL-3.0": """GPLv3 License
License: GPLv3
This work is licensed under the GNU General Public License, version 3
Licensed under the GNU General Public License v3.0
GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version""",
    "GPL-2.0": """GPLv2 License
License: GPLv2
This work is licensed under the GNU General Public License, version 2
Licensed under the GNU General Public License v2.0
GNU GENERAL PUBLIC LICENSE Version 2, June 1991
it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version""",
    "LGPL": """LGPL License
License: LGPL
Licensed under the GNU Lesser General Public License, version 3
GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999
it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation""",
    "AGPL-3.0": """AGPL License
License: AGPL
Licensed under the GNU Affero General Public License, version 3
it under the terms of the GNU Affero General Public License as published by the Free Software Foundation""",
    "BSD": """BSD License
License: BSD
Licensed under the BSD 3-Clause License
Released under the BSD license
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer""",
    "MPL-2.0": """Mozilla License
License: MPL
Licensed under the Mozilla Public License, version 2.0
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0""",
    "ISC": """ISC License
License: ISC
Released under the ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted""",
    "public-domain": """Public Domain
License: CC0
This is free and unencumbered software released into the public domain
This work is dedicated to the public domain under CC0 1.0
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work""",
    "CC-BY": """CC BY
Licensed under CC BY 4.0
This work is licensed under a Creative Commons Attribution 4.0 International License""",
    "CC-BY-SA": """Licensed under CC BY-SA 4.0
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License""",
    "CC-BY-NC": """Licensed under CC BY-NC 4.0
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License""",
    "proprietary": """All rights reserved
Copyright 2020 Example Company. All rights reserved
No part of this publication may be reproduced without the prior written permission of the copyright holder""",
}
# Paragraphs that speak of licences and rights without being a notice.
OTHERS = """The driver had no licence and lost the car
She renewed her driving license at the public office
A fishing licence is needed at the lake under the law of the state
The license of the restaurant was withdrawn by the city
The warranty of the camera ended after two years
Copyright is a field of law that protects works of art
The book discusses copyright and the rights of authors in general
The apache helicopter flew over the hills
Apache is the name of several peoples of the south west
The gnu is an antelope that lives in large herds
The public library is open to all citizens, version 2 of the plan says
He was licensed to practise medicine in three states
All seats reserved for guests of the hotel
Table reserved for eight persons with all rights to the terrace
The software company published version 3 of its report
The committee reserved all questions of license fees for its next meeting
The commission granted permission to build a house on the land
They asked for permission and a copy of the documentation
The university licensed the patent to a firm in the region
The creative commons room is open for students and their works""".split("\n")
# A paragraph without any of these, in lower case, and without an opening of TEMPLATES is of the unknown class without being scored.
ANCHORS = ("licen", "copyright", "rights reserved", "apache", "gnu ", "lesser general", "mozilla", "creative commons", "cc by", "cc-by", "cc0",
           "public domain", "hereby granted", "redistribut", "permission", "required by applicable law", "extent possible under law")


def _words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _grams(words: Column, n: int) -> Column:
    places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))


def _plain_grams(line: str, n: int) -> list[str]:
    """What `_grams` gives for a constant text."""
    words = "".join(c.lower() if c.isalnum() else " " for c in line).split()
    return list(dict.fromkeys(" ".join(words[i:i + n]) for i in range(len(words) - n + 1)))


def _opening() -> str:
    """A regular expression for lower case that finds something in every text that can agree with a template: three of
    its words in a row, or all of one that has fewer. A tree of their letters, so that a place is looked at once."""
    tree: dict = {}
    for line in "\n".join(TEMPLATES.values()).split("\n"):
        words = _plain_grams(line, 1)
        for gram in _plain_grams(line, 3) or [" ".join(order) for order in permutations(words)]:
            at = tree
            for c in gram + "$":
                at = at.setdefault(c, {})

    def written(at):
        ways = [(r"(?![\p{L}\p{N}])" if c == "$" else r"[^\p{L}\p{N}]++" if c == " " else c) + written(after) for c, after in sorted(at.items())]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")" if ways else ""

    return r"(?<![\p{L}\p{N}])" + written(tree)


def _featured(df: DataFrame) -> DataFrame:
    """Adds words, grams and the sparse vector of the one- to three-word grams of `paragraph` that the notices have."""
    df = df.withColumn("words", _words(F.col("paragraph")))
    df = df.withColumn("grams", F.array_distinct(F.concat(*[_grams(F.col("words"), n) for n in GRAMS])))
    vocabulary = sorted({g for text in [*"\n".join(TEMPLATES.values()).split("\n"), *OTHERS] for n in GRAMS for g in _plain_grams(text, n)})
    return CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features", binary=True).transform(df)


def _examples() -> list[tuple[str, str, bool]]:
    """(text, family, for calibration): notices as they are, with words lost, in other company or wrapped; other paragraphs, and
    notices with their words shuffled, as unknown."""
    random, rows = Random(11), []
    syllables = "an er in on re ti es or te at en ha th ou ng le ro mi la so".split()

    def noise(most):
        return " ".join("".join(random.choices(syllables, k=random.randint(1, 4))) for _ in range(random.randint(0, most)))

    def variants(text):
        yield text
        for _ in range(VARIANTS):
            words = [w for w in text.split() if len(text.split()) < 6 or random.random() > 0.08]
            yield f"{noise(8)} {' '.join(words)} {noise(30)}"

    sources = [(text, family) for family, texts in TEMPLATES.items() for text in texts.split("\n")] + [(text, UNKNOWN) for text in OTHERS]
    for text, family in sources:
        rows += [(v, family) for v in variants(text)]
        words = text.split()
        for _ in range(VARIANTS if len(words) > LEAST_WRAPPED and family != UNKNOWN else 0):
            size = random.randint(LEAST_WRAPPED, len(words) - 1)
            first = random.randint(0, len(words) - size)
            part = " ".join(words[first:first + size])
            shared = any(part.replace(";", ",") in other for name, texts in TEMPLATES.items() if name != family for other in texts.replace(";", ",").split("\n"))
            rows.append((f"{noise(4)} {part} {noise(4)}", UNKNOWN if shared else family))  # several families have it
        for _ in range(VARIANTS // 2 if len(words) > 2 else 0):  # the order of two says nothing
            random.shuffle(words)
            rows.append((f"{noise(8)} {' '.join(words[:random.randint(1, len(words))])} {noise(20)}", UNKNOWN))
    rows += [(noise(60), UNKNOWN) for _ in range(100)]
    return [(text, family, i % 4 == 3) for i, (text, family) in enumerate(rows)]


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A constant table."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


@dataclass
class LicenceModel:
    model: LogisticRegressionModel
    families: list[str]
    temperature: float


def _softmax(raw: Column, temperature: Column) -> Column:
    scaled = F.transform(vector_to_array(raw), lambda x: x / temperature)
    powers = F.transform(scaled, lambda x: F.exp(x - F.array_max(scaled)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def fit_licences(spark: SparkSession) -> LicenceModel:
    """Sparse multinomial logistic regression on the notices above, of fixed size; its probabilities are calibrated by
    the temperature that fits a quarter of the examples best that the regression hasn't seen."""
    families = [*TEMPLATES, UNKNOWN]
    rows = [(text, float(families.index(family)), held) for text, family, held in _examples()]
    examples = _featured(_table(spark, rows, ["paragraph", "label", "held"])).select("features", "label", "held").cache()
    fit = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=0.5, maxIter=80, tol=1e-5, standardization=False)
    model = fit.fit(examples.filter("not held").coalesce(1))
    steps = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    held = model.transform(examples.filter("held")).select("label", "rawPrediction", F.explode(F.array(*map(F.lit, steps))).alias("t"))
    own = F.get(_softmax(F.col("rawPrediction"), F.col("t")), F.col("label").cast("int"))
    losses = held.groupBy("t").agg(F.sum(-F.log(F.greatest(own, F.lit(1e-12)))).alias("loss")).orderBy("loss", "t")
    best = losses.first()["t"]
    examples.unpersist()
    return LicenceModel(model, families, best)


def scan_licences(df: DataFrame, model: LicenceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each paragraph that may be a licence notice: key, place (its line), paragraph, family, probability,
    alike (agreement with the nearest template of that family) and confirmed.

    Paragraphs are the lines of a text. `family` is the likeliest, or "unknown"; it is confirmed if it is likely
    enough and shares enough three-word shingles with a template; one of one or two words shares words with a template
    as short, of the longer of both. Lines that can't agree with a template are only scored if they have one of ANCHORS. Null and empty texts
    give no rows; rows that repeat give theirs again; other columns are not looked at.
    """
    opening = _opening()

    def any_of(column):
        out = F.lit(False)
        for a in ANCHORS:
            out = out | column.contains(a)
        return out | column.rlike(opening)

    texts = df.select(quoted(key).alias("key"), quoted(text).alias("text")).filter(any_of(F.lower("text")))
    lines = texts.select("key", F.posexplode(F.split("text", "\n")).alias("place", "paragraph")).filter(any_of(F.lower("paragraph")))
    scored = model.model.transform(_featured(lines))
    chances = _softmax(F.col("rawPrediction"), F.lit(model.temperature))
    scored = scored.select("key", "place", "paragraph", "words", chances.alias("chances"))
    top = F.array_position("chances", F.array_max("chances")).cast("int") - 1
    scored = scored.select("key", "place", "paragraph", "words", F.get(F.array(*map(F.lit, model.families)), top).alias("likely"), F.array_max("chances").alias("probability"))

    def shingles(words):
        return F.when(F.size(words) >= 3, F.array_distinct(_grams(words, 3))).otherwise(F.array_distinct(words))

    own = shingles(F.col("words"))
    templates = F.create_map(*[x for family, lines in TEMPLATES.items() for x in (
        F.lit(family), F.array(*[F.array(*map(F.lit, _plain_grams(line, 3) or _plain_grams(line, 1))) for line in lines.split("\n")]))])
    alike = F.array_max(F.transform(F.element_at(templates, F.col("likely")), lambda t: F.size(F.array_intersect(F.col("own"), t))
                                    / F.greatest(F.lit(1), F.when(F.size("words") < 3, F.greatest(F.size(t), F.size(F.col("own"))))
                                                .otherwise(F.least(F.size(t), F.size(F.col("own")))))))
    scored = scored.withColumn("own", own).withColumn("alike", F.when(F.col("likely") != UNKNOWN, F.coalesce(alike, F.lit(0.0))).otherwise(F.lit(0.0)))
    confirmed = (F.col("likely") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY) & (F.col("alike") >= LEAST_ALIKE)
    return scored.select(F.col("key").alias(key), "place", "paragraph", F.col("likely").alias("family"), "probability", "alike", confirmed.alias("confirmed"))


def document_licences(df: DataFrame, model: LicenceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key with licences (confirmed families in order, joined by a space; empty if none), n_notices and
    n_unconfirmed (paragraphs that a family is likely for, but no template confirms). A key that repeats has one row."""
    found = scan_licences(df, model, key, text).withColumnRenamed(key, "key")
    by_key = found.groupBy("key").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), " ").alias("licences"),
        F.count_if("confirmed").alias("n_notices"), F.count_if(~F.col("confirmed") & (F.col("family") != UNKNOWN)).alias("n_unconfirmed"))
    keys = df.select(quoted(key).alias("key"))
    none = keys.select("key", F.lit("").alias("licences"), F.lit(0).cast("long").alias("n_notices"), F.lit(0).cast("long").alias("n_unconfirmed"))
    return (none.unionByName(by_key).groupBy("key").agg(F.max("licences").alias("licences"), F.max("n_notices").alias("n_notices"),
                                                       F.max("n_unconfirmed").alias("n_unconfirmed")).withColumnRenamed("key", key))
