"""Licence scans by a trained paragraph classifier.

Paragraphs (lines of a text, and runs of lines without a blank one between)
are counted as sparse vectors of word 1- to 3-grams; a multinomial logistic regression (Spark ML) names a licence family or
``unknown``.  It is trained on notices made from templates and, for the unknown
class, on the corpus' own paragraphs: all lines that hold no template, a half
of them (by a hash of the line).  The probability a family needs is calibrated
on the other half, so that at most one in a thousand of its paragraphs would
pass.  A prediction counts only if the paragraph also holds most words of one
of the family's templates, in runs of three.

For these two steps the lines are cut down to the words that the templates know
(the rest of a line has no feature) and counted; equal ones are one row with a
weight.  So no text is shuffled, and the fit reads rows of a few words.

A run of lines counts if it holds a family's template and no shorter run in it
does (the first, where such runs of a family overlap), so a notice is found
however it is wrapped, at the line its template begins in, and one on a line of
its own at that line; a notice with several templates gives a row for each run.
Comment marks aren't words.

Paragraphs without any of a few long words can't hold enough of any template
(``needed_words`` derives them from the templates), so they aren't scored; this
changes no result.  Two passes over the texts without a shuffle of texts;
DataFrame and Spark ML operations only.

Edge cases: a null or empty text has no paragraphs and no licence; very long
texts are cut into paragraphs like others; repeated rows are repeated in the
result; a null id is kept as null (and not trained on); with no paragraphs the
bar is ``MIN_BAR``; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.core import q
from tabsmith.ml.metrics import cumulative_sums
from tabsmith.session import cut_lineage

UNKNOWN = 7.0          # weight of all the corpus' paragraphs against that of the notices made from templates
PASSING = 0.001        # share of the paragraphs without a template that may pass
MIN_BAR = 0.5          # least probability of a family
HOLDS = 0.75           # share of a template's 3-grams that a paragraph must hold
GRAMS = (1, 2, 3)

# Notices as they are commonly written, by family (public licence texts).
TEMPLATES = {
    "mit": ["released under the mit license", "licensed under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "apache-2.0": ["licensed under the apache license version 2.0", "released under the apache license version 2.0",
                   "you may not use this file except in compliance with the license",
                   "you may obtain a copy of the license at http www.apache.org licenses license-2.0"],
    "gpl-3.0": ["licensed under the gnu general public license version 3", "released under the gnu general public license version 3",
                "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
                "either version 3 of the license or at your option any later version"],
    "lgpl": ["licensed under the gnu lesser general public license", "under the terms of the gnu lesser general public license"],
    "agpl-3.0": ["licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license"],
    "bsd": ["released under the bsd license", "licensed under the 3-clause bsd license",
            "redistribution and use in source and binary forms with or without modification are permitted"],
    "mpl-2.0": ["licensed under the mozilla public license version 2.0",
                "this source code form is subject to the terms of the mozilla public license"],
    "cc-by": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc0": ["released under cc0 1.0 universal", "to the extent possible under law the author has waived all copyright"],
    "all-rights-reserved": ["all rights reserved", "copyright all rights reserved", "all rights reserved no part may be reproduced"],
}
COMMENT = r"(?i)^\s*(?:rem|dnl)\s"  # comment marks that are made of letters
LEADS = ["", "this work is", "this file is", "this software is", "the code is", "this document is", "note"]


def word_list(text):
    """Lower-case words of a column: letters, digits, dots and hyphens inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def grams(words, n: int):
    """n-grams of a column of words, space-joined."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)),
                                                  lambda k: F.array_join(F.slice(words, k, n), " "))).otherwise(
        F.array().cast("array<string>"))


def features(words):
    return F.concat(*[grams(words, n) for n in GRAMS])


def template_table(spark) -> DataFrame:
    """``family, text`` of all templates."""
    rows = [F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, ts in TEMPLATES.items() for t in ts]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def paragraphs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns of ``docs`` with one row per line that has a word, as ``place``, ``line`` and ``words``.

    The words are made before the rows are spread, so that no later expression computes them again."""
    lines = F.transform(F.split(F.col(q(text_col)), "\n"), lambda line: F.struct(line.alias("line"), word_list(line).alias("words")))
    return (docs.select("*", F.posexplode(lines).alias("place", "__p")).drop(q(text_col))
            .filter(F.size("__p.words") > 0).select("*", "__p.line", "__p.words").drop("__p"))


def runs(docs: DataFrame, text_col: str) -> DataFrame:
    """The other columns of ``docs`` with one row per run of lines that may hold a template, as ``place`` (first
    line), ``last`` (line) and ``words``, and the words without those of its last and of its first line as ``less`` (empty for a line).

    Lines without words end runs.  The lines between the first and the last have at most as many words as the
    longest template, which loses no run that needs all its lines to hold one."""
    longest = max(len(t.split()) for t in itertools.chain(*TEMPLATES.values()))
    none = F.array().cast("array<string>")

    def tails(lines):  # per line, it and those after it that a run from it can reach
        return F.transform(lines, lambda line, k: F.struct(k.alias("place"), F.slice(lines, k + 1, longest + 2).alias("lines")))

    near = docs.select("*", F.inline(tails(F.split(F.col(q(text_col)), "\n")))).drop(q(text_col))
    near = near.filter(may_hold(F.array_join("lines", "\n")))
    near = once(near.withColumn("lines", F.transform("lines", lambda x: word_list(F.regexp_replace(x, COMMENT, "")))), "lines")
    blank = F.array_position(F.transform("lines", F.size), 0).cast("int")
    near = near.withColumn("lines", F.when(blank > 0, F.slice("lines", 1, blank - 1)).otherwise(F.col("lines")))
    near = once(near.filter(F.size("lines") > 0), "lines")

    def run(n):
        return F.flatten(F.slice("lines", 1, n))

    def less(n):
        return F.when(n > 1, F.array(run(n - 1), F.flatten(F.slice("lines", 2, n - 1)))).otherwise(F.array(none, none))

    sizes = F.sequence(F.lit(1), F.size("lines"))
    sizes = F.filter(sizes, lambda n: (n < 3) | (F.size(F.flatten(F.slice("lines", 2, F.greatest(n - 2, F.lit(0))))) <= longest))
    others = [c for c in near.columns if c != "lines"]
    return (near.select(*[F.col(q(c)) for c in others], F.inline(F.transform(sizes, lambda n: F.struct((F.col("place") + n - 1).alias("last"), run(n).alias("words"), less(n).alias("less")))))
            .filter(F.arrays_overlap("words", F.array(*[F.lit(w) for w in needed_words()]))))


def once(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with these columns computed once per row, however often filters and columns after it use them."""
    others = [F.col(q(c)) for c in df.columns if c not in cols]
    return df.select(*others, F.explode(F.array(F.struct(*cols))).alias("__c")).select(*others, *[f"__c.{c}" for c in cols])


def threes_of(template: str) -> list[str]:
    """The distinct 3-grams of a template (all of it, if it has fewer words)."""
    w = template.split()
    return list(dict.fromkeys(" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))))


def needed_words() -> list[str]:
    """Words of which a paragraph must hold one to hold ``HOLDS`` of any template's 3-grams.

    Per template, its longest words until fewer 3-grams are without any of them."""
    needed = set()
    for text in itertools.chain(*TEMPLATES.values()):
        left = total = threes_of(text)
        for word in sorted(text.split(), key=lambda w: (-len(w), w)):
            if len(left) < HOLDS * len(total):
                break
            needed.add(word)
            left = [t for t in left if word not in t.split()]
    return sorted(needed)


def may_hold(text):
    """Whether a text holds one of the needed words."""
    low = F.lower(text)
    return functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in needed_words()])


class Scanner:
    """A fitted classifier: vocabulary, model, bars."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        known = template_table(spark).withColumn("words", word_list(F.col("text")))
        self.families = sorted(TEMPLATES)
        # bounded: the templates' n-grams
        self.vocabulary = sorted(r[0] for r in known.select(F.explode(features(F.col("words")))).distinct().collect())
        self.vectors = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="grams", outputCol="features")
        leads = F.explode(F.array(*[F.lit(x) for x in LEADS]))
        made = known.select("family", "text", leads.alias("lead")).withColumn("line", F.concat_ws(" ", "lead", "text")).withColumn("words", word_list(F.col("line")))
        label = F.array_position(F.array(*[F.lit(f) for f in self.families]), F.col("family")).cast("double")  # 0: unknown
        made = made.select(label.alias("label"), "words")
        own = docs.filter(F.col(q(id_col)).isNotNull()).select(F.col(q(text_col)).alias("text"))
        own = cut_lineage(self.vectorize(self.unknown(own)).select("features", "half", "n"))
        sizes = own.groupBy("half").agg(F.sum("n")).collect()  # two rows
        total = {r[0]: r[1] for r in sizes}
        # the words of templates in another order, and single ones of them, are unknown too
        mixed = made.select(F.lit(0.0).alias("label"), F.array_sort("words").alias("words")).unionByName(
            known.select(F.lit(0.0).alias("label"), F.explode(F.transform("words", lambda w: F.array(w))).alias("words")).distinct())
        made = cut_lineage(made.unionByName(mixed).coalesce(1))  # some hundred rows by the templates
        notices = made.filter("label > 0").count()
        share = UNKNOWN * notices / max(1, total.get(0, 0))
        training = self.vectorize(made).select("label", "features", F.lit(1.0).alias("weight")).unionByName(
            own.filter("half = 0").select(F.lit(0.0).alias("label"), "features", (F.col("n") * share).alias("weight")))
        # one stored table, read by every iteration
        self.model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, weightCol="weight").fit(cut_lineage(training))
        self.bar = self.calibrated(self.probabilities(own.filter("half = 1")), total.get(1, 0))

    def unknown(self, docs: DataFrame) -> DataFrame:
        """``words, half, n``: all lines of ``text`` that have a word and hold no template, counted by their words.

        Words that no template has are empty ones here, and runs of them one: the n-grams in the vocabulary stay the same."""
        singles = [w for w in self.vocabulary if " " not in w]
        lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
        lines = once(lines.withColumn("words", word_list(F.col("line"))), "words").filter(F.size("words") > 0)
        kept = F.array_join(F.transform("words", lambda w: F.when(w.isin(singles), w).otherwise("")), " ")
        lines = lines.select(F.regexp_replace(F.trim(kept), " {2,}", "  ").alias("kept"), F.pmod(F.xxhash64("line", F.lit(7)), F.lit(2)).alias("half"))
        lines = lines.groupBy("kept", "half").agg(F.count(F.lit(1)).alias("n"))
        # only what holds a needed word is held against the templates
        words = F.split("kept", " ")
        lines = lines.select(words.alias("kept"), F.when(may_hold(F.col("kept")), words).otherwise(F.array().cast("array<string>")).alias("words"), "half", "n")
        lines = self.held_templates(lines).filter(F.array_max("held") < HOLDS)
        return lines.select(F.col("kept").alias("words"), "half", "n")

    def calibrated(self, scored: DataFrame, total: int) -> float:
        """The least bar above which at most ``PASSING`` of the ``total`` paragraphs in ``scored`` (``n`` each) lie, of any
        family; ``MIN_BAR`` at least."""
        over = scored.filter((F.col("label") > 0) & (F.col("p") > MIN_BAR)).groupBy("p").agg(F.sum("n").alias("n"))
        over = cut_lineage(over)
        if (over.agg(F.sum("n")).first()[0] or 0) <= PASSING * total:
            return MIN_BAR
        sums = cumulative_sums(over, "p", ["n"], descending=True)
        return sums.filter(F.col("cum_n") > PASSING * total).agg(F.max("p")).first()[0]

    def vectorize(self, df: DataFrame) -> DataFrame:
        return self.vectors.transform(once(df.withColumn("grams", features(F.col("words"))), "grams"))

    def probabilities(self, df: DataFrame) -> DataFrame:
        """``df`` with the likeliest class ``label`` (0: unknown) and its probability ``p``."""
        scored = self.model.transform(df.drop("label") if "label" in df.columns else df)
        # rounded, as the sums of a fit depend on the order in which tasks end
        p = F.round(F.array_max(vector_to_array("probability")), 6)
        best = scored.withColumn("p", p).withColumn("label", F.col("prediction").cast("int"))
        return once(best.drop("rawPrediction", "probability", "prediction", "features", "grams"), "p", "label")

    def held_templates(self, df: DataFrame) -> DataFrame:
        """``df`` with ``held``: per family the largest share of a template's 3-grams that the paragraph's ``words`` hold."""
        own, shares = F.col("__threes"), []
        for name in self.families:
            each = []
            for text in TEMPLATES[name]:
                threes = threes_of(text)
                each.append(F.size(F.array_intersect(own, F.array(*[F.lit(t) for t in threes]))) / F.lit(float(len(threes))))
            shares.append(F.greatest(*each) if len(each) > 1 else each[0])
        df = once(df.withColumn("__threes", F.array_distinct(grams(F.col("words"), 3))), "__threes")
        return df.withColumn("held", F.array(*shares)).drop("__threes")

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``id, place, family, probability`` of every paragraph that a licence is confirmed for."""
        own = docs.select(F.col(q(id_col)).alias(id_col), F.col(q(text_col)).alias("__text"))
        own = own.filter(may_hold(F.col("__text"))).withColumn("__row", F.monotonically_increasing_id())
        found = self.held_templates(runs(own, "__text")).filter(F.array_max("held") >= HOLDS)
        found = once(found, "held")
        for name, k in (("without_last", 0), ("without_first", 1)):
            shorter = found.withColumnsRenamed({"held": "__held", "words": "__words"}).withColumn("words", F.col("less")[k])
            found = once(self.held_templates(shorter).withColumnRenamed("held", name), name).drop("words").withColumnsRenamed({"__held": "held", "__words": "words"})
        # per family, whether the run holds a template that no shorter run in it does
        own_run = F.zip_with("held", F.arrays_zip("without_last", "without_first"),
                             lambda h, x: (h >= HOLDS) & (x["without_last"] < HOLDS) & (x["without_first"] < HOLDS))
        found = once(found.withColumn("own", own_run), "own").filter(F.exists("own", lambda x: x))
        found = found.select(id_col, "__row", "place", "last", "words", "own")
        found = self.probabilities(self.vectorize(found)).filter((F.col("label") > 0) & (F.col("p") > self.bar))
        names = F.array(*[F.lit(f) for f in self.families])
        found = found.filter(F.element_at("own", F.col("label"))).withColumn("family", F.element_at(names, F.col("label")))
        # of runs of a family that overlap in a text, the first
        found = found.groupBy("__row", "family").agg(F.first(id_col).alias(id_col), F.array_sort(F.collect_list(F.struct("place", "last", "p"))).alias("runs"))
        kept = F.aggregate(F.slice("runs", 2, F.size("runs")), F.slice("runs", 1, 1),
                           lambda kept, r: F.when(r["place"] > F.element_at(kept, -1)["last"], F.concat(kept, F.array(r))).otherwise(kept))
        return found.select(id_col, "family", F.inline(kept)).select(id_col, "place", "family", F.col("p").alias("probability"))
