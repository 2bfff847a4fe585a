"""License scans by diagonal voting, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.llm.common import lower_ascii
from quillsift.session import plain_unions

#: Words in a gram; templates have as many or more.
GRAM = 3
#: Diagonals this close to the one before belong to one span: that many words may be put in or left out in one place.
SLACK = 2
#: In a whole span as many words may be put in or left out, or one for so many grams of the template where that is more.
DRIFT = 8
#: Least share of a template's grams that a span must hold.
COVERAGE = 0.8

#: Phrases that count wherever their words stand one after another, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Texts of license notices that count when most of them is there, and their labels.
NOTICES = (
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)


def words_of(text: Column) -> Column:
    """Words of a lower-cased text: runs of digits, a-z and characters beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def gram(words: Column, at: Column) -> list[Column]:
    return [F.get(words, at + k) for k in range(GRAM)]


def positions(spark: SparkSession, base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> DataFrame:
    """One row for each gram of each template, and one, of template -1, for the end of a document."""
    rows = [(k, label, k < len(base), text.split()) for k, (text, label) in enumerate((*base, *notices))]
    if any(len(words) < GRAM for *_, words in rows):
        raise ValueError(f"a template has {GRAM} words or more")
    plain_unions(spark)
    table = spark.createDataFrame(rows, "template int, label string, base boolean, words array<string>")
    grams = table.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - GRAM)).alias("at"))
    grams = grams.select("template", "label", "base", (F.size("words") - GRAM + 1).alias("grams"), "at", F.xxhash64(*gram(F.col("words"), F.col("at"))).alias("gram_hash"), F.array(*gram(F.col("words"), F.col("at"))).alias("gram_words"))
    end = spark.range(1).select(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("grams"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("gram_hash"), F.lit(None).cast("array<string>").alias("gram_words"))
    return grams.union(end)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[tuple[str, str], ...] = BASE, notices: tuple[tuple[str, str], ...] = NOTICES, slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """id, n_words, spans: one row for each row of docs, with the places of license phrases and notices in it.

    Every gram of GRAM words of every text is joined by its hash (and its words, so a collision counts for nothing) to
    the places where templates hold it. Matches on one diagonal, of equal difference between the word in the text and
    the word in the template, vote together. A base phrase stands where all of its grams share a diagonal. Of a notice,
    diagonals at most `slack` from the one before are merged, as far as the drift goes: from a span's first diagonal to
    its last it is at most `slack`, or an eighth of the notice's grams where that is more, so a span is at most that much
    longer or shorter than the notice and no word stands further from its place. The span is kept if it holds `coverage`
    of the notice's grams; of such spans whose first diagonals are that close the one with most grams stays, of equal
    ones the first. spans: array of (label, base, start, coverage), start the word, from 0, at which the template begins.

    The templates, a fixed parameter, are broadcast; no text is shuffled, only matches and one row for each document.
    Null and empty texts have no words and no spans. Rows are told apart even if they share an id or have none. An
    empty table gives no rows; other columns are not read.
    """
    places = positions(docs.sparkSession, base, notices)
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    read = read.select("row", "id", "words", F.size("words").alias("n_words"))
    # one entry more than there are words: the end, which every document has
    each = read.select("row", "id", "n_words", "words", F.explode(F.sequence(F.lit(0), F.col("n_words"))).alias("pos"))
    hashed = F.when(F.col("pos") <= F.col("n_words") - GRAM, F.xxhash64(*gram(F.col("words"), F.col("pos")))).when(F.col("pos") == F.col("n_words"), F.lit(0).cast("long"))
    each = each.withColumn("hash", hashed)
    same = (F.col("template") == -1) == (F.col("pos") == F.col("n_words"))
    for k in range(GRAM):
        same &= (F.col("template") == -1) | (F.get("words", F.col("pos") + k) == F.get("gram_words", F.lit(k)))
    votes = each.join(F.broadcast(places), (F.col("hash") == F.col("gram_hash")) & same)
    votes = votes.select("row", "id", "n_words", "template", "label", "base", "grams", "at", (F.col("pos") - F.col("at")).alias("diagonal")).repartition("row")
    # from here on everything stays in the partition of its document
    key = ["row", "id", "n_words", "template", "label", "base", "grams"]
    lines = votes.groupBy(*key, "diagonal").agg(F.collect_set("at").alias("held"))
    window = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when((F.col("diagonal") - F.lag("diagonal").over(window) <= slack) & ~F.col("base"), 0).otherwise(1)
    chains = lines.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(window))
    # in units of the drift, which differs from template to template; half a diagonal more keeps rounding out of the frames
    half = 0.5 / max(slack, 1, *(len(text.split()) // DRIFT for text, _ in notices))
    chains = chains.withColumn("place", F.col("diagonal") / F.greatest(F.lit(slack), F.lit(1), F.floor(F.col("grams") / DRIFT)))
    frame = "OVER (PARTITION BY row, template, chain ORDER BY place RANGE BETWEEN"
    spans = chains.withColumn("held", F.expr(f"array_distinct(flatten(collect_list(held) {frame} CURRENT ROW AND {1 + half}D FOLLOWING)))"))
    spans = spans.withColumn("share", F.when(F.col("grams") > 0, F.size("held") / F.col("grams")))
    spans = spans.withColumn("best", F.expr(f"max(share) {frame} {1 + half}D PRECEDING AND {1 + half}D FOLLOWING)"))
    spans = spans.withColumn("before", F.expr(f"max(share) {frame} {1 + half}D PRECEDING AND {half}D PRECEDING)"))
    first = (F.col("share") == F.col("best")) & (F.col("share") > F.coalesce("before", F.lit(0.0)))
    good = (F.col("template") >= 0) & F.when(F.col("base"), F.col("share") == 1).otherwise((F.col("share") >= coverage) & first)
    found = F.collect_list(F.when(good, F.struct("label", "base", F.greatest("diagonal", F.lit(0)).cast("long").alias("start"), F.col("share").alias("coverage"))))
    return spans.groupBy("row", "id", "n_words").agg(F.array_sort(found).alias("spans")).select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "spans")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scan_licenses() finds in every document, summed up."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("on", F.filter("spans", lambda s: s["base"]))
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform("on", lambda s: s["start"])
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("on").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(F.col("on")).alias("base_labels"), names(F.col("spans")).alias("labels"), score.alias("score"))
