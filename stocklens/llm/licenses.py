"""License scans: find license notices in documents, wherever they stand.

Texts are cut into overlapping windows of five-word shingles.  MinHash bands of a
window retrieve the notices that may be in it, and an exact count of shingles decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import bind, five_word_hashes, word_hashes

# Usual wordings of public license notices.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at"),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation"),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "rights-reserved": "All rights reserved. No part of this publication may be reproduced",
}
CONTAINMENT = 0.8
WORD_BREAK = r"[^\p{L}\p{N}]+"
BANDS = 64              # of one row each: a notice that is a 13th of a window is missed in 0.6 % of the windows
MAX_TEMPLATE_SHINGLES = 100_000


def shingles(text: Column) -> Column:
    """Hashes of the five-word runs of a text, lower case, letters and digits only."""
    words = F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")
    return five_word_hashes(word_hashes(words))


def templates(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    """(license, shingles) of the notices: distinct shingle hashes."""
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("notice")) for k, v in notices.items()])
    listed = spark.range(1).select(F.explode(rows).alias("t"))
    return listed.select("t.license", F.array_distinct(shingles(F.col("t.notice"))).alias("shingles"))


def minhashes(values: Column, bands: int = BANDS) -> Column:
    """One smallest salted hash per band."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.array_min(
        F.transform(values, lambda v: F.xxhash64(v, b))))


def band_rows(df: DataFrame, values: str) -> DataFrame:
    columns = [c for c in df.columns]
    return df.select(*columns, F.posexplode(minhashes(F.col(values))).alias("band", "mark"))


def scan(docs: DataFrame, notices: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Rows (doc_id, license, first_shingle, containment): a notice found in a document.

    ``containment`` is the largest share of the notice's shingles in one window and
    ``first_shingle`` the position of the first of its shingles in the first window
    that reaches the threshold.  Windows are twice as long as the longest notice and
    overlap by half, so every notice lies wholly in one.  Shingles that no notice has
    cannot add to a containment and are left out of a window before it is hashed.

    The notices are a bounded list (refused above MAX_TEMPLATE_SHINGLES shingles), so
    their shingles go into the plan and their bands into a small table.  Null and empty
    texts have no rows; rows of equal doc_id and text count once; null doc_ids are kept.
    """
    spark = docs.sparkSession
    listed = [(r["license"], r["shingles"]) for r in templates(spark, notices or NOTICES).collect()]
    known = sorted({h for _, hs in listed for h in hs})
    if len(known) > MAX_TEMPLATE_SHINGLES:
        raise ValueError(f"{len(known)} template shingles, at most {MAX_TEMPLATE_SHINGLES}")
    stride = max((len(hs) for _, hs in listed), default=1)

    def hits(hashes: Column) -> Column:
        places = F.transform(hashes, lambda h, i: F.when(h.isin(known), F.struct(i.alias("at"), h.alias("hash"))))
        return F.filter(places, lambda p: p.isNotNull())

    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), hits(shingles(F.col("text"))).alias("hits"))
    found = found.filter(F.size("hits") > 0).dropDuplicates(["doc_id", "text_key"])

    def windows_of(at: Column) -> Column:
        own = F.floor(at / stride).cast("int")
        return F.filter(F.array(own - 1, own), lambda w: w >= 0)

    # Each hit goes to its two windows, so a long text's windows are worked on apart and in linear time.
    places = found.select("doc_id", "text_key", F.explode("hits").alias("p"))
    places = places.select("doc_id", "text_key", "p", F.explode(windows_of(F.col("p.at"))).alias("window"))
    rows = places.groupBy("doc_id", "text_key", "window").agg(F.sort_array(F.collect_list("p")).alias("hits"))
    rows = rows.withColumn("values", F.array_distinct(F.transform("hits", lambda p: p["hash"])))
    marks = templates(spark, notices or NOTICES)
    marks = band_rows(marks, "shingles").select("license", "shingles", "band", "mark")
    pairs = band_rows(rows, "values").join(marks, ["band", "mark"])
    pairs = pairs.dropDuplicates(["doc_id", "text_key", "window", "license"])
    share = F.size(F.array_intersect("values", "shingles")) / F.size("shingles")
    first = F.array_min(F.transform(F.filter("hits", lambda p: F.array_contains("shingles", p["hash"])),
                                    lambda p: p["at"]))
    checked = pairs.select("doc_id", "license", share.alias("share"), first.alias("first"))
    return (checked.filter(F.col("share") >= containment).groupBy("doc_id", "license")
                   .agg(F.min("first").cast("long").alias("first_shingle"), F.max("share").alias("containment")))
