"""Licence scans: a trained n-gram classifier of paragraphs, an unknown class and templates.

The unit is the paragraph, a run of non-blank lines; a paragraph may hold several notices, so its sentences, over
line ends, and its lines are candidates too, and of those within each other the ones that say most are reported.
Candidates are described by the sets of their word pairs and triples. A multinomial logistic
regression over these (spark.ml) learns the families from the templates and their parts,
and the class of ordinary writing from a bounded sample of the corpus itself; so the model
is a small table of n-gram weights. Scoring is a join of a candidate's n-grams with that
table; a candidate without any word pair that the weights of a notice need cannot be likely and is not described. A candidate is taken for a licence notice if the probability of ordinary writing is
lower than for nearly all candidates of the corpus that resemble no template: their
probabilities are counted in fixed steps over all texts, each distinct one once. One that resembles
no template must be more likely a notice than not, besides. The predicted family stands, whatever
the threshold, if ordinary writing is less likely and the candidate agrees with a template of the
family; if it agrees with none or the prediction is not clear, the notice is of ``unknown`` family.

Defined results: null and empty texts have no notices; repeated rows are treated alike; a
notice that occurs several times in a text is counted each time; with few texts
the threshold is near the second highest of ordinary writing. Texts are read whole. Only the named id column is
kept beside the results.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import batched, pairwise

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recordmill.llm.common import written

#: Candidates of ordinary writing that train, at most. All of them calibrate.
SAMPLE = 4000
#: Share of a template's word pairs in a sentence that confirms it, and that keeps it out of the sample.
CONFIRMED, SUSPECT = 0.6, 0.3
#: Least probability of a family among the families; share of ordinary candidates below the threshold.
CLEAR, ORDINARY_SHARE = 0.5, 0.9995
ORDINARY, UNKNOWN = "ordinary", "unknown"
#: Blanks inside a line.
BLANK = r"\x20\t\x0B\f\xA0"
#: What names a candidate beside its text.
PLACE = ("_paragraph", "_at", "_level", "_within")
#: Least probability of a notice, for candidates that resemble a template and for others; steps of its log-odds by unit.
LEAST_LIKE, LEAST, STEPS = 0.01, 0.5, 20

# Notices by which public licences are usually named.
TEMPLATES = {
    "agpl": ("This program is free software under the GNU Affero General Public License, version 3.", "Licensed under the AGPL 3.0."),
    "apache": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license.", "You may not use this file except in compliance with the Apache License."),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright to this work."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL 3.0.", "You can redistribute it and/or modify it under the terms of the GNU General Public License."),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL 3.0."),
    "mit": ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    "mpl": ("This file is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the MPL 2.0."),
    "reserved": ("All rights reserved.", "No part of this publication may be reproduced without written permission of the publisher."),
}
CLASSES = (ORDINARY, *sorted(TEMPLATES))


def _tokens(sentence: str) -> str:
    """Words and numbers in lower case, with marks at both ends; inner dots, plus and minus signs stay."""
    return f"concat(array('^'), regexp_extract_all(lower({sentence}), r'[\\p{{L}}\\p{{N}}]+(?:[.+-][\\p{{L}}\\p{{N}}]+)*', 0), array('$'))"


def _grams(tokens: str, n: int) -> str:
    shifted = [f"slice({tokens}, {k + 1}, greatest(size({tokens}) - {n - 1}, 0))" for k in range(n)]
    return f"array_distinct(zip_with({shifted[0]}, {shifted[1]}, (a, b) -> concat(a, ' ', b)))" if n == 2 else \
        f"array_distinct(zip_with(zip_with({shifted[0]}, {shifted[1]}, (a, b) -> concat(a, ' ', b)), {shifted[2]}, (a, b) -> concat(a, ' ', b)))"


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """``_row``, the other columns of ``df``, and all that may be a notice; every text has at least one row.

    Blank lines end a paragraph. In it, blanks are collapsed and its sentences run on over line ends. ``_level`` is 2 for a
    paragraph of several sentences, 1 for a sentence, 0 for a line of a sentence that runs over several. ``_paragraph``
    numbers the paragraphs, ``_at`` the rows of one, ``_within`` the sentences of one.
    """
    run_on = r"replace({}, '\n', ' ')"
    one = "named_struct('_level', {}, '_within', {}, '_sentence', {})"
    whole = f"if(size(_s) > 1, array({one.format(2, -1, run_on.format('_p'))}), array())"
    parts = f"transform(split(s, '\\n', -1), l -> {one.format(0, 'j', 'l')})"
    sentence = f"if(instr(s, '\\n') = 0, array({one.format(1, 'j', 's')}), concat(array({one.format(1, 'j', run_on.format('s'))}), {parts}))"
    found = f"concat({whole}, flatten(transform(_s, (s, j) -> {sentence})))"
    out = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_t", F.coalesce(F.col(text), F.lit(""))).drop(text)
    kept = [c for c in out.columns if c != "_t"]
    # a pattern is run only over texts that have what it replaces; as columns of their own, the steps are computed once
    t = F.col("_t")
    out = out.withColumn("_t", F.when(t.contains("\r"), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t))
    # a lone space stays as it is; once blanks are collapsed, at most one stands on either side of a line's end
    blanks = reduce(Column.__or__, (t.contains(b) for b in ("\x20\x20", "\t", "\x0B", "\f", "\xA0")))
    out = out.withColumn("_t", F.when(blanks, F.regexp_replace(t, rf"\x20[{BLANK}]+|[\t\x0B\f\xA0][{BLANK}]*", " ")).otherwise(t))
    out = out.withColumn("_t", F.expr(r"replace(replace(_t, ' \n', '\n'), '\n ', '\n')"))
    # no paragraph but the first begins, and none but the last ends with such a mark
    edges = reduce(Column.__or__, (end(F.lit(b)) for end in (t.startswith, t.endswith) for b in ("\x20", "\n")))
    out = out.withColumn("_t", F.when(edges, F.expr(r"trim(BOTH ' \n' FROM _t)")).otherwise(t))
    paragraphs = F.when(t.contains("\n\n"), F.split(t, r"\n\n+", -1)).when(t != "", F.array(t))
    cut = out.select(*kept, F.posexplode_outer(paragraphs).alias("_paragraph", "_p"))
    cut = cut.withColumn("_s", F.expr(r"split(coalesce(_p, ''), r'[\x20\n](?<=[.!?][\x20\n])', -1)"))
    cut = cut.select(*kept, F.coalesce("_paragraph", F.lit(0)).alias("_paragraph"), F.posexplode_outer(F.expr(found)).alias("_at", "_x"))
    return cut.select(*kept, "_paragraph", "_at", "_x.*")


def described(df: DataFrame, text: str = "_sentence") -> DataFrame:
    """Adds ``_pairs``, the word pairs of a sentence, and ``_grams``, pairs and triples."""
    out = df.withColumn("_tokens", F.expr(_tokens(text)))
    out = out.withColumn("_pairs", F.expr(_grams("_tokens", 2)))
    return out.withColumn("_grams", F.expr(f"concat(_pairs, {_grams('_tokens', 3)})")).drop("_tokens")


def _constants(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """A table of a few constants, without a detour over Python workers."""
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("family"), F.lit(b).alias("text")) for a, b in rows))).alias("x")).select("x.*")


def _examples() -> list[tuple[str, str]]:
    """Templates, and the parts of each that keep at least two thirds of its words."""
    rows = []
    for family, notices in TEMPLATES.items():
        for notice in notices:
            words = notice.split()
            least = max(3, -(-2 * len(words) // 3))
            rows += [(family, " ".join(words[a:b])) for a in range(len(words)) for b in range(a + least, len(words) + 1)] + [(family, notice)] * 3
    return rows


def _agreement(pairs: str, template: Column) -> Column:
    """Share of a template's word pairs that a sentence has; what else the sentence says does not matter."""
    return F.size(F.array_intersect(F.col(pairs), template)) / F.size(template)


class Model:
    """Weights of n-grams by class and pairs of the templates."""

    def __init__(self, weights: dict[str, list[float]], intercepts: list[float], templates: dict[str, list[list[str]]]):
        self.weights, self.intercepts, self.templates = weights, intercepts, templates
        self.words: list[str] | None = None

    def telling(self, common: list[str], by: int = 1) -> list[str] | None:
        """Words (``by`` 1) or word pairs (2) one of which is in every candidate that may be more than ``LEAST_LIKE`` likely; None if there are no such.

        An n-gram adds to the log-odds of a notice at most what it gives the best family over ordinary writing. Those of
        ``common`` are left out, in order, as long as all n-grams that consist of no others cannot reach the limit together.
        """
        families = sum(math.exp(b - max(self.intercepts)) for b in self.intercepts[1:])
        room = math.log(LEAST_LIKE / (1 - LEAST_LIKE)) - (math.log(families) + max(self.intercepts) - self.intercepts[0]) - 1e-6
        gain: dict[frozenset[str], float] = {}
        for g, w in self.weights.items():
            words = g.split(" ")
            own = frozenset(words) - {"^", "$"} if by == 1 else frozenset(map(" ".join, pairwise(words)))
            gain[own] = gain.get(own, 0.0) + max(0.0, max(w[1:]) - w[0])
        left: set[str] = set()
        for unit in [None, *common]:
            more = left | ({unit} if unit else set())
            if sum(x for units, x in gain.items() if units <= more) <= room:
                left = more
            elif unit is None:
                return None
        return sorted(set().union(*gain) - left)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per n-gram of the templates and their parts; the empty one stands for the row itself."""
        lines = "\n".join("\t".join([g, *(f"{x:.17g}" for x in w)]) for g, w in {"": [0.0] * len(CLASSES), **self.weights}.items())
        rows = spark.range(1).select(F.explode(F.split(F.lit(lines), "\n")).alias("x")).select(F.split("x", "\t").alias("x"))
        return rows.select(F.col("x")[0].alias("_gram"), *(F.col("x")[i + 1].cast("double").alias(f"w{i}") for i in range(len(CLASSES))))

    def classify(self, cut: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of ``candidates`` that share an n-gram with the model, and the first of every text, with probabilities.

        Adds ``p_notice``, one less the probability of ordinary writing, ``family`` and ``p_family`` among families. Rows
        without a telling word or pair, which are not likely, are left out, and of the first of a text the sentence.
        """
        first = (F.col("_paragraph") == 0) & (F.col("_at") == 0)
        if self.words is not None:
            cut = cut.withColumn("_sentence", F.when(_holds("_sentence", self.words), F.col("_sentence")))
            cut = cut.filter(first | F.col("_sentence").isNotNull())
        cut = described(cut)
        grams = F.coalesce("_grams", F.array().cast("array<string>"))
        own = F.when(first, F.concat(grams, F.array(F.lit("")))).otherwise(grams)
        exploded = cut.select(*keys, *PLACE, "_sentence", F.explode(own).alias("_gram"))
        # the weights are bounded by the size of the training sample
        met = exploded.join(F.broadcast(self.weight_table), "_gram")
        logits = met.groupBy(*keys, *PLACE, "_sentence").agg(*(F.sum(f"w{i}").alias(f"w{i}") for i in range(len(CLASSES))))
        logits = logits.withColumns({f"w{i}": F.col(f"w{i}") + F.lit(float(b)) for i, b in enumerate(self.intercepts)})
        logits = logits.withColumn("_most", F.greatest(*(F.col(f"w{i}") for i in range(len(CLASSES)))))
        logits = logits.withColumns({f"w{i}": F.exp(F.col(f"w{i}") - F.col("_most")) for i in range(len(CLASSES))})
        families = [F.col(f"w{i}") for i in range(1, len(CLASSES))]
        total = sum(families[1:], families[0])
        best = F.greatest(*families)
        name = F.coalesce(*(F.when(c == best, F.lit(k)) for c, k in zip(families, CLASSES[1:])))
        return logits.select(*keys, *PLACE, "_sentence", (total / (total + F.col("w0"))).alias("p_notice"), name.alias("family"), (best / total).alias("p_family"))


def _holds(sentence: str, units: list[str]) -> Column:
    """Whether one of the words or word pairs, by their first letters, stands between other marks than letters and digits.

    Of a pair, ``^`` is the beginning and ``$`` the end of a sentence. May hold of more, as an inner dot parts words here.
    """
    mark, end = r"[^a-z\p{L}\p{N}]", r"(?![a-z\p{L}\p{N}])"

    def any_of(words: dict[str, str]) -> str:
        by: dict[str, list[str]] = {}
        for word, then in words.items():
            by.setdefault(word[0], []).append("".join("\\" + c if c in ".+-" else c for c in word[1:]) + then)
        # alternatives are tried one after the other, so first letters are told apart by groups of a few
        groups = batched(sorted(by), 6)
        return "|".join(f"(?=[{''.join(g)}])(?:" + "|".join(f"{first}(?:{'|'.join(by[first])})" for first in g) + ")" for g in groups) or "(?!)"

    after: dict[str, list[str]] = {}
    for unit in units:
        word, _, then = unit.partition(" ")
        after.setdefault(word, []).append(then)
    begins = any_of(dict.fromkeys(after.pop("^", []), end))
    tails = {}
    for word, then in after.items():
        pairs = any_of(dict.fromkeys([x for x in then if x not in ("", "$")], end))
        tails[word] = end if "" in then else f"(?:{mark}+(?:{pairs})" + (rf"|{mark}*\z)" if "$" in then else ")")
    return F.concat(F.lit(" "), F.lower(sentence)).rlike(f"{mark}(?:{any_of(tails)})|^{mark}+(?:{begins})")


def _nearest(pairs: str, templates: dict[str, list[list[str]]], family: str | None = None) -> Column:
    """Greatest agreement with any template, or with those of the family named by a column."""
    found = [_agreement(pairs, F.array(*map(F.lit, t))) if family is None else F.when(F.col(family) == k, _agreement(pairs, F.array(*map(F.lit, t))))
             for k, own in templates.items() for t in own]
    return F.coalesce(F.greatest(*found), F.lit(0.0))


def _distinct_sample(df: DataFrame, most: int, column: str) -> DataFrame:
    """The ``most`` distinct values with the smallest hashes, written; copies are combined before they are exchanged.

    Were it not written, what is computed next would move below the limit, and all rows be sorted by ranges instead, with values as samples on the driver.
    """
    different = df.select(F.approx_count_distinct(F.xxhash64(column)).alias("n")).first()["n"]
    share = min(1.0, (2 * most + 1000) / max(different, 1))
    near = df.select(column, F.xxhash64(column).alias("_hash")).filter(F.col("_hash") <= F.lit(min(int(-(2**63) + share * 2**64), 2**63 - 1)))
    return written(near.dropDuplicates([column]).orderBy("_hash", column).limit(most).drop("_hash"), "sample")


def train(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """A model from the templates and at most ``sample`` candidates out of as many texts, those with the smallest hashes.

    Those that resemble a template are left out of the sample. Half of it trains, the rest is not seen.
    """
    spark = df.sparkSession
    templates: dict[str, list[list[str]]] = {}
    for row in described(_constants(spark, [(k, n) for k, own in TEMPLATES.items() for n in own]), "text").collect():
        templates.setdefault(row.family, []).append(row["_pairs"])
    texts = _distinct_sample(df.select(text).filter(F.length(text) > 0), sample, text)
    chosen = _distinct_sample(written(candidates(texts, text).filter("_sentence rlike '[^ ]'").select("_sentence"), "sentences"), sample, "_sentence")
    ordinary = described(chosen).filter(_nearest("_pairs", templates) < SUSPECT)
    ordinary = written(ordinary.withColumn("_part", F.pmod(F.xxhash64("_sentence", F.lit(1)), F.lit(2))), "ordinary")
    positive = written(described(_constants(spark, _examples()), "text"), "positive")
    label = F.coalesce(*(F.when(F.col("family") == k, F.lit(float(i))) for i, k in enumerate(CLASSES)))
    rows = written(positive.select(label.alias("label"), "_grams").union(ordinary.filter("_part = 0").select(F.lit(0.0), "_grams")), "examples")
    # n-grams of ordinary writing alone would only raise the ordinary class, where a sentence without n-grams is anyway
    counter = CountVectorizer(inputCol="_grams", outputCol="vector", binary=True, vocabSize=1 << 17).fit(positive.select("_grams"))
    fitted = LogisticRegression(featuresCol="vector", labelCol="label", family="multinomial", regParam=1e-4, maxIter=60).fit(counter.transform(rows))
    matrix = fitted.coefficientMatrix.toArray()
    weights = {g: matrix[:, i].tolist() for i, g in enumerate(counter.vocabulary)}
    intercepts = fitted.interceptVector.toArray().tolist()
    if not ordinary.filter("_part = 0").take(1):
        intercepts[0] = min(intercepts[1:])  # nothing is known of ordinary writing
    model = Model(weights, intercepts, templates)
    # word pairs of the sample, the commonest first; they only decide how many candidates have to be described
    known = {" ".join(p) for g in weights for p in pairwise(g.split(" "))}
    seen = ordinary.select(F.explode("_pairs").alias("p")).filter(F.col("p").isin(*known))
    model.words = model.telling([r["p"] for r in seen.groupBy("p").count().orderBy(F.desc("count"), "p").collect()], 2)
    model.weight_table = written(model.table(spark), "weights")
    return model


def _settled(found: DataFrame, keys: list[str]) -> DataFrame:
    """``notices`` of every text, each notice once: of candidates within each other those that say most.

    A confirmed line stands. A sentence is reported in place of its unknown lines, unless a line already says
    as much. So is a paragraph in place of unknown sentences that it explains, if it adds a family or is all there is.
    """
    known = f"x.family <> '{UNKNOWN}'"
    # lines of one sentence, sentences of one paragraph and paragraphs of one text are bounded by its length
    of = found.groupBy(*keys, "_paragraph", "_within").agg(F.collect_list("_n").alias("_n"))
    of = of.withColumn("_said", F.expr(f"array_distinct(transform(filter(_n, x -> x.level = 0 and {known}), x -> x.family))"))
    of = of.withColumn("_longer", F.expr(f"filter(_n, x -> x.level = 2 or x.level = 1 and if({known}, not array_contains(_said, x.family), size(_said) = 0))"))
    of = of.withColumn("_n", F.expr(f"concat(_longer, filter(_n, x -> x.level = 0 and ({known} or size(_longer) = 0)))"))
    of = of.groupBy(*keys, "_paragraph").agg(F.flatten(F.collect_list("_n")).alias("_n"))
    of = of.withColumn("_said", F.expr(f"array_distinct(transform(filter(_n, x -> x.level < 2 and {known}), x -> x.family))"))
    of = of.withColumn("_parts", F.expr("filter(_n, x -> x.level < 2)"))
    of = of.withColumn("_longer", F.expr(f"filter(_n, x -> x.level = 2 and if({known}, not array_contains(_said, x.family), size(_parts) = 0))"))
    of = of.withColumn("_n", F.expr(f"concat(_longer, filter(_parts, x -> {known} or not exists(_longer, w -> w.family = x.guess)))"))
    kept = "transform(array_sort(flatten(_n)), x -> named_struct('place', x.place, 'sentence', x.sentence, 'family', x.family, 'p_notice', x.p_notice, 'agreement', x.agreement))"
    return of.groupBy(*keys).agg(F.collect_list("_n").alias("_n")).select(*keys, F.expr(kept).alias("notices"))


def _step(p: str) -> Column:
    """The step of a probability by its log-odds, as far as a double tells it from one."""
    return F.floor(F.log(F.greatest(F.col(p), F.lit(1e-16)) / F.greatest(1.0 - F.col(p), F.lit(1e-16))) * STEPS).cast("int")


def _sizes(cut: DataFrame) -> tuple[DataFrame, Observation]:
    """``cut``, and the number of its distinct candidates by kind, which is known once it was read."""
    seen = Observation()
    whole, hashed = F.col("_level") == 2, F.xxhash64("_sentence")
    return cut.observe(seen, *(F.approx_count_distinct(F.when(kind, hashed)).alias(name) for kind, name in ((whole, "whole"), (~whole, "parts")))), seen


def _limits(sizes: dict[bool, int], likely: DataFrame) -> dict[bool, int]:
    """The last step of ordinary writing, for paragraphs of several sentences (True) and for shorter candidates.

    All distinct candidates count, ``sizes`` of either kind; those of ``likely`` that resemble a template are no ordinary
    writing. Of the others at most one less ``ORDINARY_SHARE``, or a single one, lies above.
    """
    whole = (F.col("_level") == 2).alias("whole")
    odd = likely.filter(F.col("_like") < SUSPECT).groupBy(whole, F.xxhash64("_sentence").alias("_hash")).agg(F.max("_step").alias("_step"))
    limits = {}
    # the steps between LEAST_LIKE and one are a few hundred
    steps = sorted(((r["whole"], r["_step"], r["n"]) for r in odd.groupBy("whole", "_step").agg(F.count("*").alias("n")).collect()), reverse=True)
    for kind in (True, False):
        left = max(1, int((1 - ORDINARY_SHARE) * sizes.get(kind, 0)))
        limits[kind] = -(10**6)
        for step, n in ((step, n) for k, step, n in steps if k == kind):
            left -= n
            if left < 0:
                limits[kind] = step
                break
    return limits


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``notices``: ``array<struct<place, sentence, family, p_notice, agreement>>`` of every text, in order.

    ``place`` is the number of the paragraph; ``sentence`` is the notice, a paragraph or a part of one, on one line.
    """
    model = train(df, text)
    cut, seen = _sizes(candidates(df.select(key, text), text))
    scored = model.classify(cut, ["_row", key])
    likely = F.col("p_notice") > LEAST_LIKE
    first = (F.col("_paragraph") == 0) & (F.col("_at") == 0)
    kept = scored.filter(likely | first).withColumn("_sentence", F.when(likely, F.col("_sentence")))
    kept = described(kept).select("_row", key, *PLACE, "_sentence", "p_notice", "family", "p_family", _step("p_notice").alias("_step"), *(
        F.when(likely, c).alias(n) for c, n in ((_nearest("_pairs", model.templates, "family"), "agreement"), (_nearest("_pairs", model.templates), "_like"))))
    stored = written(kept, "likely")
    # every text has a row; if there is none, Spark may leave out the count, and there is nothing to judge
    sizes = seen.get if stored.take(1) else {"whole": 0, "parts": 0}
    limits = _limits({True: sizes["whole"], False: sizes["parts"]}, stored)
    unlikely = F.col("_step") <= F.when(F.col("_level") == 2, F.lit(limits[True])).otherwise(F.lit(limits[False]))
    likely = F.col("p_notice") > F.when(F.col("_like") >= SUSPECT, LEAST_LIKE).otherwise(LEAST)
    confirmed = (F.col("p_notice") > LEAST) & (F.col("p_family") >= CLEAR) & (F.col("agreement") >= CONFIRMED)
    family = F.when(confirmed, F.col("family")).otherwise(F.lit(UNKNOWN))
    judged = stored.withColumn("agreement", F.when(confirmed | likely & ~unlikely, F.col("agreement")))
    notice = F.when(F.col("agreement").isNotNull(), F.struct(
        F.col("_paragraph").alias("place"), F.col("_at").alias("at"), F.col("_level").alias("level"), F.col("_sentence").alias("sentence"),
        family.alias("family"), F.col("family").alias("guess"), "p_notice", "agreement"))
    return _settled(judged.withColumn("_n", notice), ["_row", key]).drop("_row")
