"""Licence scan by a trained paragraph classifier, in DataFrame functions and spark.ml (JVM) alone.

Sparse word n-grams (1 and 2 words, hashed) feed a multinomial logistic regression over licence families, ``other`` (licence
wording of no listed family) and ``none``. It is trained on the notices below in several wordings and on at most ``BACKGROUND`` paragraphs
of as many documents (of a hash-picked sample of texts, paragraphs of at most ``BACKGROUND_CHARS`` signs), which the corpus's size doesn't change.

Calibration. A first fit leaves out every fourth notice with all its wordings and a quarter of the background. On those, it finds the
temperature of least log loss and the bound on 1 - p(none) that at most 1% of the background passes. The model in use is fitted on all.

Verdict on a paragraph. Its most probable family is confirmed if p reaches the bound and at least ``CONTAINED`` of the word triples of one of the
family's notices occur in it and nothing of ``BARRED`` does, so that a text with NoDerivatives is never passed as one without, nor version 1.1 as 2.0. Else it is ``unknown`` if 1 - p(none) reaches the bound, or if it holds so much of any notice: a licence, but none that the
templates confirm. Each paragraph is scored by the model's weights of all its words and pairs. ``most_some`` sums, per word and pair, the weight of the class
that it speaks for most, and so is never below the margin of any class over ``none``: where 13 classes of that margin don't reach the bound, 1 - p(none)
can't, and the paragraph is ``none``. All others go through the whole model, and so do those with a word of ``LEXICON``, which may hold ``CONTAINED`` of a
notice whatever the model says: in each notice, more than 1 - CONTAINED of the triples have a word of the lexicon (held by a test).
``n_near`` counts the paragraphs with an anchor word.

Defined results: null or empty texts have no paragraphs; repeated rows and ids are separate rows; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BACKGROUND = 2000
BACKGROUND_CHARS = 2000
FEATURES = 1 << 13
CONTAINED = 0.6
LEAST = 0.5

# Notices by family, in the words in which works state them.
NOTICES = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "spdx license identifier mit",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "spdx license identifier apache 2 0",
    ],
    "gpl": [
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "spdx license identifier gpl 3 0",
        "spdx license identifier gpl 2 0",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license",
        "under the terms of the gnu lesser general public license as published by the free software foundation",
        "spdx license identifier lgpl 2 1",
    ],
    "agpl": [
        "licensed under the gnu affero general public license",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        "spdx license identifier agpl 3 0",
    ],
    "bsd": [
        "licensed under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "spdx license identifier bsd 3 clause",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "licensed under the mozilla public license version 2 0",
        "spdx license identifier mpl 2 0",
    ],
    "cc-by": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc0": ["dedicated to the public domain under the cc0 1 0 universal license", "licensed under cc0 1 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense license"],
}
# Wording of licences of no listed family, and of their usual clauses.
OTHER_NOTICES = [
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "this program and the accompanying materials are made available under the terms of the eclipse public license",
    "this font software is licensed under the sil open font license",
    "licensed under the european union public licence",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability and fitness for a particular purpose",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability arising from the use of the software",
    "all rights reserved no part of this work may be reproduced or distributed without the prior written permission of the copyright owner",
    "this product may only be used under the terms of the license agreement that comes with it by using it you accept the license",
    "the licensor grants you a worldwide royalty free non exclusive license to use reproduce modify and distribute the work",
    "you may copy and redistribute the software freely provided that this notice is not removed or altered from any source distribution",
    "permission is granted to use copy and sublicense this software without charge subject to the conditions of this license",
]
_ND, _NC, _SA = r"no ?deriv[a-z]*|by(?: nc| sa)* nd", r"non ?commercial|by(?: nd| sa)* nc", r"share ?alike|by(?: nc| nd)* sa"
#: By family, what tells a stricter, an older or another licence of its name apart, in a paragraph's words: where it is there, the family isn't confirmed.
BARRED = {
    "mit": r"mit(?: license)? 0|mit no attribution",
    "apache-2.0": r"apache(?: [a-z]+){0,4} (?:[013-9]|2 [1-9])",
    "mpl-2.0": r"(?:mozilla(?: [a-z]+){0,4}|mpl) (?:[013-9]|2 [1-9])",
    "gpl": r"lesser|library general|affero|lgpl|agpl",
    "lgpl": r"affero|agpl",
    "agpl": r"lesser|library general|lgpl",
    "bsd": r"advertising materials",
    "cc-by": f"{_ND}|{_NC}|{_SA}",
    "cc-by-sa": f"{_ND}|{_NC}",
    "cc-by-nc": f"{_ND}|{_SA}",
}
#: A paragraph that holds enough of a notice has one of these words.
LEXICON = [
    "license", "licenses", "licensed", "licence", "licences", "licenced", "licensing", "licensor", "licensee", "sublicense", "unlicense", "unencumbered", "software", "redistribution",
    "redistributions", "redistribute", "redistributed", "warranty", "warranties", "merchantability", "noninfringement", "liable", "copyright", "hereby", "obtaining", "compliance",
    "modification", "permitted", "binary", "spdx", "identifier", "apache", "mozilla", "gnu", "gpl", "lgpl", "agpl", "mpl", "bsd", "mit", "code", "cc", "cc0", "universal", "creative", "commons", "royalty",
]
ANCHORS = ["license", "licence", "licensed", "licenced", "software", "redistribution"]
#: Openings and endings that notices stand between.
AROUND = [("", ""), ("this work is", ""), ("this project is", "see the license file for details"), ("copyright 2020 the authors", "all rights reserved"), ("the contents of this page are", "unless stated otherwise"), ("all files here are", "")]
OTHER = [
    "the driver s license was issued in the spring and had to be renewed",
    "the software was released in march and the developers answered questions",
    "they applied for a license to sell food at the market",
    "the institute released a report about public health and general policy",
    "a licence to fish in the river costs ten pounds",
    "redistribution of income was the subject of the debate",
    "the licensed trade and public houses in the city",
    "free software and open data were discussed at the conference",
    "version 3 of the device has a general purpose port",
    "permission is required to enter the building after six",
    "the code of the door was changed and the mit students were permitted to enter",
    "the creative team met at the commons before the show",
    "the copyright dispute between the two authors went to court",
    "the driver lost the licence after the accident and was held liable",
    "the warranty of the washing machine ends after two years",
    "she works at a software company and writes code",
    "in compliance with the rules the team was permitted to play",
    "binary stars and their universal law of motion",
    "the report mentions the software twice",
    "modification of the building is hereby announced to the neighbours",
]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def paragraphs(text: Column) -> Column:
    """Cut at blank lines and at line ends after a sentence's end; lines that a notice is wrapped into stay together."""
    return F.filter(F.split(text, r"\n[ \t\r]*\n|(?<=[.!?:])[ \t\r]*\n"), lambda p: F.length(F.trim(p)) > 0)


def triples(w: Column) -> Column:
    made = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda k: F.array_join(F.slice(w, k, 3), " "))
    # one pass over an array that holds w, so that w isn't computed anew for each k
    return F.array_distinct(F.element_at(F.transform(F.array(w), made), 1))


def noticed(notice: str) -> list[str]:
    """The word triples of a notice, as constants."""
    w = notice.split(" ")
    return sorted({" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))})


TRIPLES = {k: [noticed(n) for n in v] for k, v in NOTICES.items()}
ALL_TRIPLES = sorted({t for v in TRIPLES.values() for n in v for t in n})
CLASSES = ["none", *NOTICES, "other"]


def has_word(text: Column, of: list[str]) -> Column:
    """Whether a lower-case text has one of these words, words being runs of a-z and 0-9."""
    begins = "".join(sorted({w[0] for w in of}))
    return text.rlike(f"(?<![a-z0-9])(?=[{begins}])(?:{'|'.join(of)})(?![a-z0-9])")


def features(w: Column) -> Column:
    """(ones, pairs): 32-bit codes of a paragraph's words and of its pairs of words."""
    n = lambda c: F.greatest(F.size(c) - 1, F.lit(0))
    made = lambda c: F.struct(c.alias("ones"), F.zip_with(F.slice(c, 1, n(c)), F.slice(c, 2, n(c)), lambda x, y: F.hash(x, y)).alias("pairs"))
    return F.element_at(F.transform(F.array(F.transform(w, lambda x: F.hash(x))), made), 1)


def classified(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows.withColumn("_f", features(F.col("words"))).withColumn("ones", F.col("_f.ones")).withColumn("pairs", F.col("_f.pairs")))


def most_some(model: PipelineModel, w: Column) -> Column:
    """At least the largest margin of any class over none that the model gives to a paragraph's words, to rounding."""
    fit = model.stages[-1]
    margin, start = fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()
    weights = F.split(F.lit(",".join(map(repr, (margin - margin[0])[1:].max(axis=0).tolist()))), ",").cast("array<double>")  # a constant, computed once
    bucket = lambda c, base: F.transform(c, lambda x: F.pmod(F.hash(x), F.lit(FEATURES)) + F.lit(base))  # noqa: E731  as HashingTF deals integers
    at = lambda f: F.array_distinct(F.concat(bucket(f["ones"], 0), bucket(f["pairs"], FEATURES)))
    summed = lambda f: F.aggregate(at(f), F.lit(float((start - start[0])[1:].max())), lambda s, k: s + F.get(weights, k))
    return F.element_at(F.transform(F.array(features(w)), summed), 1)


def _fitted(rows: DataFrame) -> PipelineModel:
    lr = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-3, standardization=False, featuresCol="features", labelCol="label", weightCol="weight")
    return Pipeline(stages=[
        HashingTF(binary=True, numFeatures=FEATURES, inputCol="ones", outputCol="f1"),
        HashingTF(binary=True, numFeatures=FEATURES, inputCol="pairs", outputCol="f2"),
        VectorAssembler(inputCols=["f1", "f2"], outputCol="features"),
        lr,
    ]).fit(rows)


def background(docs: DataFrame, text: str) -> DataFrame:
    """(p, h) of at most BACKGROUND paragraphs without an anchor word or a notice's triple: one of each text, of the texts of smallest hash among those that a rate picks."""
    body = F.col(f"`{text}`").cast("string")
    n = docs.count()
    rate = int(min(1.0, 4 * BACKGROUND / max(1, n)) * (1 << 32))
    picked = docs.select(body.alias("t"), F.xxhash64(body).alias("h")).where(F.col("t").isNotNull() & (F.pmod(F.col("h"), F.lit(1 << 32)) < rate))
    picked = picked.dropDuplicates(["h"])
    fit = lambda p: (F.length(p) <= BACKGROUND_CHARS) & ~has_word(F.lower(p), ANCHORS) & ~F.arrays_overlap(triples(words(p)), F.lit(ALL_TRIPLES))
    p = F.explode_outer(F.slice(F.filter(paragraphs(F.col("t")), fit), 1, 1)).alias("p")  # outer: no filter that computes it twice
    return picked.select(p, "h").where("p is not null").orderBy("h").limit(BACKGROUND)


def train(spark: SparkSession, docs: DataFrame, text: str = "text") -> tuple[PipelineModel, float, float]:
    """The model, its temperature and the least calibrated 1 - p(none) of a licence."""
    stated = [(n, CLASSES.index(k)) for k, v in NOTICES.items() for n in v] + [(n, CLASSES.index("other")) for n in OTHER_NOTICES]
    own = [(f"{a} {n} {b}".strip(), k, 1.0, at % 4 == 1) for at, (n, k) in enumerate(stated) for a, b in AROUND]
    own += [(n, 0, 3.0, at % 4 == 1) for at, n in enumerate(OTHER)]
    back = background(docs, text).select("p", F.lit(0).alias("label"), F.lit(1.0).alias("weight"), (F.pmod(F.xxhash64("p", F.lit(11)), F.lit(4)) == 0).alias("held"))
    rows = spark.createDataFrame(own, "p string, label int, weight double, held boolean").unionByName(back)
    rows = rows.select(words(F.col("p")).alias("words"), F.col("label").cast("double").alias("label"), "weight", "held").coalesce(2)
    rows = rows.select("*", features(F.col("words")).alias("_f")).select("words", "label", "weight", "held", "_f.*").cache()
    first = _fitted(rows.where("not held"))
    held = first.transform(rows.where("held")).select(vector_to_array("rawPrediction").alias("z"), F.col("label").cast("int").alias("y")).collect()  # a part of the bounded training rows
    model = _fitted(rows)
    rows.unpersist()

    def prob(z: list[float], t: float) -> list[float]:
        e = [math.exp((a - max(z)) / t) for a in z]
        return [a / sum(e) for a in e]

    loss = lambda t: sum(-math.log(max(1e-12, prob(r.z, t)[r.y])) for r in held)
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss) if held else 1.0
    wrong = sorted(1 - prob(r.z, temperature)[0] for r in held if r.y == 0)
    least = max(LEAST, wrong[int(0.99 * (len(wrong) - 1))] + 0.01) if wrong else LEAST
    return model, temperature, min(least, 0.9)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row a document: the confirmed families, how sure, and paragraphs that are licences of none of them."""
    model, temperature, least = train(docs.sparkSession, docs, text)
    kept = [doc_id] if keep is None else keep
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), F.coalesce(paragraphs(body), F.array().cast("array<string>")).alias("ps"))
    enough = temperature * (math.log(least / (1 - least)) - math.log(len(CLASSES) - 1)) - 1e-6
    asked = F.filter("ps", lambda p: has_word(F.lower(p), LEXICON) | (most_some(model, words(p)) >= enough))
    rows = rows.select("_row", "_doc", F.size("ps").alias("n_paragraphs"), F.explode_outer(asked).alias("p"))
    rows = rows.withColumn("words", F.coalesce(words(F.col("p")), F.array().cast("array<string>")))
    made = classified(model, rows).select("_row", "_doc", "n_paragraphs", "p", "words", vector_to_array("rawPrediction").alias("z"), F.col("prediction").cast("int").alias("k"))
    top = F.array_max("z")
    e = F.transform("z", lambda a: F.exp((a - top) / F.lit(temperature)))
    share_of = lambda n: F.size(F.array_intersect(F.lit(n), F.col("own"))) / len(n)
    contained = F.create_map(*[x for k, v in TRIPLES.items() for x in (F.lit(k), F.greatest(*[share_of(n) for n in v], F.lit(0.0)))])
    some = F.arrays_overlap("own", F.lit(ALL_TRIPLES))
    made = made.withColumn("e", e).withColumn("family", F.element_at(F.lit(CLASSES), F.col("k") + 1)).withColumn("own", triples(F.col("words")))
    made = made.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).withColumn("shares", F.when(some, contained))
    p_some = 1 - F.element_at("e", 1) / F.col("total")
    sure = F.element_at("e", F.col("k") + 1) / F.col("total")
    share = F.coalesce(F.try_element_at("shares", F.col("family")), F.lit(0.0))
    said = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    barred = F.coalesce(reduce(lambda c, k: c.when(F.col("family") == k, said.rlike(f" (?:{BARRED[k]}) ")), list(BARRED)[1:], F.when(F.col("family") == list(BARRED)[0], said.rlike(f" (?:{BARRED[list(BARRED)[0]]}) "))), F.lit(False))
    held = F.coalesce(F.array_max(F.map_values("shares")), F.lit(0.0)) >= CONTAINED
    there = F.col("p").isNotNull()
    known = there & ~F.col("family").isin("none", "other") & (sure >= least) & (share >= CONTAINED) & ~barred
    unknown = there & ((p_some >= least) | held) & ~known
    near = F.coalesce(has_word(F.lower("p"), ANCHORS), F.lit(False))
    made = made.select("_row", "_doc", "n_paragraphs", "family", sure.alias("sure"), near.alias("near"), known.alias("known"), unknown.alias("unknown"))
    known, unknown = F.col("known"), F.col("unknown")
    return made.groupBy("_row").agg(
        F.first("_doc").alias("_doc"), F.max("n_paragraphs").alias("n_paragraphs"), F.sum(F.when(F.col("near"), 1).otherwise(0)).alias("n_near"),
        F.array_join(F.array_sort(F.collect_set(F.when(known, F.col("family")))), ",").alias("licenses"),
        F.sum(F.when(known, 1).otherwise(0)).alias("n_confirmed"), F.sum(F.when(unknown, 1).otherwise(0)).alias("n_unknown"),
        F.round(F.max(F.when(known, F.col("sure"))), 6).alias("confidence"),
    ).select("_doc.*", "n_paragraphs", "n_near", "licenses", "n_confirmed", "n_unknown", "confidence")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
