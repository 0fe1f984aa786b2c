"""License scans: fixed phrases, and notices found by diagonal voting.

All rolling hashes of GRAM words of all texts are joined with the positions that they have in the notices. A hit votes for
the diagonal (place in the text less place in the notice). Diagonals that are few words apart are one match with words added or
left out; the words of its span are compared with the notice's, by edit distance over words, and count if they are alike enough.
Hashing and the join with the notices, which are a bounded parameter, run inside the scan; only hits are exchanged, keyed by
document, so a notice that a third of all documents hold makes no hot key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices in common use, by label; matched by their words alone.
NOTICES = {
    "agpl": ["licensed under the GNU Affero General Public License, version 3"],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License", "Licensed under the BSD License",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["licensed under the GNU Lesser General Public License, version 3"],
    "mit": [
        "Released under the MIT License", "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Words of a rolling hash; diagonals up to NEAR words apart are one match.
GRAM = 3
NEAR = 4
#: Share of the words of a span and its notice that must agree.
ALIKE = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of notices that a task may hold.
NOTICE_BYTES = 1_000_000
#: Characters that stand for the words of a notice, which has at most as many.
LETTERS = "".join(chr(0x4E00 + i) for i in range(5000))


def _lower(text: Column) -> Column:
    """Whole texts with A-Z lower-cased, and no other letter; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(_lower(text), F.lit(f"({WORD})"), F.lit(1))


def _split(notice: str) -> list[str]:
    return re.findall(WORD, notice.translate(str.maketrans(_UPPER, _LOWER)))


def _base(w: str, phrases: dict[str, str]) -> Column:
    """Places of the phrases in an array of words, as (start, label), by start."""

    def at(i: Column) -> Column:
        found = None
        for phrase, label in phrases.items():
            parts = _split(phrase)
            here = F.get(w, i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                here = here & (F.get(w, i + k) == part)
            found = F.when(here, label) if found is None else found.when(here, label)
        return F.struct(i.alias("start"), found.alias("label"))

    places = F.transform(F.sequence(F.lit(0), F.size(w) - 1), at)
    return F.filter(places, lambda p: p["label"].isNotNull())


def _grams(w: Column, k: int) -> Column:
    """(hash, place) of each run of k words."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(F.xxhash64(*(F.get(w, i + j) for j in range(k))).alias("hash"), i.alias("place")))


def _notices(df: DataFrame, notices: dict[str, list[str]]) -> DataFrame:
    """(notice, label, of): each notice's number, label and words. A parameter: too large a one is an error."""
    rows = [(i, label, _split(text)) for i, (label, text) in enumerate((label, text) for label in sorted(notices) for text in notices[label])]
    if sum(len(w) for _, _, of in rows for w in of) > NOTICE_BYTES:
        raise ValueError(f"notices of more than {NOTICE_BYTES} bytes")
    if any(len(of) > len(LETTERS) for _, _, of in rows):
        raise ValueError(f"a notice of more than {len(LETTERS)} words")
    return df.sparkSession.createDataFrame([r for r in rows if len(r[2]) >= GRAM], "notice int, label string, of array<string>")


def spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", notices: dict[str, list[str]] | None = None, near: int = NEAR, alike: float = ALIKE) -> DataFrame:
    """(id, h1, h2, label, start, end, alike): verified spans of notices, in words; h1 and h2 tell texts that share an id apart.

    Of spans that overlap in a text, those stay that no other one surpasses. Repeated rows give their spans once.
    """
    known = _notices(df, NOTICES if notices is None else notices)
    keyed = df.select(F.col(id_col).alias("id"), *_keys(text), F.col(text).alias("text"))
    # votes: the rolling hashes of the texts meet those of the notices within the scan
    rolled = keyed.select("id", "h1", "h2", words(F.col("text")).alias("w"))
    rolled = rolled.select("id", "h1", "h2", F.explode(F.when(F.size("w") >= GRAM, _grams(F.col("w"), GRAM))).alias("g"))
    rolled = rolled.select("id", "h1", "h2", "g.hash", F.col("g.place").alias("at"))
    sizes = known.select("notice", "label", "of", F.size("of").alias("n"))
    placed = sizes.select("notice", "n", F.explode(_grams(F.col("of"), GRAM)).alias("g")).select("notice", "n", "g.hash", F.col("g.place").alias("place"))
    doc = ["id", "h1", "h2"]
    hits = rolled.join(F.broadcast(placed), "hash").select(*doc, "notice", "n", (F.col("at") - F.col("place")).alias("diagonal"), "at").distinct()
    lines = hits.groupBy(*doc, "notice", "n", "diagonal").agg(F.count("*").alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    # neighbouring diagonals: a chain of them is one match, cut where it drifts farther than words of the notice can be added
    order = Window.partitionBy(*doc, "notice").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > near, F.lit(True)).cast("int")
    chained = lines.withColumn("far", far).withColumn("chain", F.sum("far").over(order))
    first = F.min("diagonal").over(Window.partitionBy(*doc, "notice", "chain"))
    chained = chained.withColumn("part", F.floor((F.col("diagonal") - first) / F.greatest(F.lit(2 * near + 1), F.floor(F.col("n") / 2))))
    merged = chained.groupBy(*doc, "notice", "chain", "part").agg(
        F.sum("votes").alias("votes"), F.min_by("diagonal", F.struct("lo", "diagonal")).alias("from"), F.max_by("diagonal", F.struct("hi", "diagonal")).alias("to")
    )
    # a span that is alike enough has most of the notice's hashes: each edit costs GRAM of them at most
    edits = F.floor(F.col("n") * (1 - alike) / alike + 1e-9)
    likely = merged.join(F.broadcast(sizes), "notice").where(F.col("votes") >= F.col("n") - GRAM + 1 - GRAM * edits)
    # words added or left out before the first hit or after the last one move the ends by as many at most
    room = F.least(edits, F.lit(near)).cast("int").alias("room")
    span = F.struct("label", "of", room, F.col("from").cast("int").alias("lo"), (F.col("to") + F.col("n")).cast("int").alias("hi"))
    likely = likely.groupBy(*doc).agg(F.collect_list(span).alias("spans"))  # a text's own
    return _verified(keyed, likely, doc, alike)


def _keys(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2")]


def _verified(keyed: DataFrame, likely: DataFrame, doc: list[str], alike: float) -> DataFrame:
    """Spans whose words are alike to their notice's: 1 - edits / the longer one's words."""
    same = likely.select(F.col("id").alias("id_"), F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), "spans")
    on = keyed["id"].eqNullSafe(same["id_"]) & (keyed["h1"] == same["h1_"]) & (keyed["h2"] == same["h2_"])
    found = keyed.join(same, on).select(*doc, words(F.col("text")).alias("w"), "spans")
    low = lambda s: F.greatest(s["lo"] - s["room"], F.lit(0))
    high = lambda s: F.least(s["hi"] + s["room"], F.size("w"))
    part = lambda s: F.slice("w", low(s) + 1, F.greatest(high(s) - low(s), F.lit(0))).alias("part")
    cut = F.transform("spans", lambda s: F.struct(s["label"].alias("label"), s["of"].alias("of"), s["room"].alias("room"), s["lo"].alias("lo"), s["hi"].alias("hi"), low(s).alias("at"), part(s)))
    found = found.select(*doc, F.explode(cut).alias("s")).select(*doc, "s.*")

    def spelt(c: str) -> Column:  # a character for each word, so that the edits of two strings are those of words
        letter = lambda v: F.substr(F.lit(LETTERS), F.array_position("of", v).cast("int"), F.lit(1))
        return F.array_join(F.transform(c, lambda v: F.when(F.array_contains("of", v), letter(v)).otherwise("?")), "")

    found = found.select(*doc, "label", "room", "lo", "hi", "at", F.size("of").alias("n"), spelt("part").alias("part"), spelt("of").alias("of"))
    around = lambda c: F.sequence(F.col(c) - F.col("room"), F.col(c) + F.col("room"))

    def alike_from(start: Column) -> Column:
        def upto(end: Column) -> Column:
            size = end - start
            own = F.substr("part", start - F.col("at") + 1, size)
            share = F.when((start >= F.col("at")) & (size > 0) & (F.length(own) == size), 1 - F.levenshtein(own, F.col("of")) / F.greatest(size, F.col("n")))
            return F.struct(share.alias("alike"), (-start).alias("start"), (-end).alias("end"))

        return F.transform(around("hi"), upto)

    best = F.array_max(F.flatten(F.transform(around("lo"), alike_from)))  # of ties the first and shortest
    good = found.select(*doc, "label", best.alias("b")).where(F.col("b.alike") >= alike)
    good = good.select(*doc, "label", (-F.col("b.start")).alias("start"), (-F.col("b.end")).alias("end"), "b.alike").distinct()
    # spans that overlap: only the best ones of a place stay
    order = Window.partitionBy(*doc).orderBy("start", "end")
    good = good.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    good = good.withColumn("place", F.sum((F.coalesce(F.col("start") >= F.col("reach"), F.lit(True))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max("alike").over(Window.partitionBy(*doc, "place"))
    return good.withColumn("best", best).where("alike = best").select(*doc, "label", "start", "end", "alike")


def scan(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None,
    near: int = NEAR, alike: float = ALIKE,
) -> DataFrame:
    """(id_col, n_words, base, labels, score): the words of each whole text, its phrases, and all labels.

    base is an array of (start, label) by start, in words from 0; base labels are always among the labels, which are distinct
    and sorted. score is the share of words that the best notice has in common with its span, 1 where a phrase stands, 0 where
    there is nothing. A row per row: a null text is an empty one, without words; repeated rows are scanned once and
    returned each; rows that share an id are told apart by their texts. Of ties all labels count. Other columns aren't
    read, whatever their names. An empty table gives none.
    """
    phrases = PHRASES if phrases is None else phrases
    lowered = df.select(F.col(id_col).alias("id"), *_keys(text), words(F.col(text)).alias("w"))
    starts = [_split(p)[0] for p in phrases]
    none = F.array().cast("array<struct<start:int,label:string>>")
    places = F.when(F.arrays_overlap("w", F.array(*map(F.lit, starts))), _base("w", phrases)).otherwise(none) if phrases else none
    facts = lowered.select("id", "h1", "h2", F.size("w").cast("long").alias("n_words"), places.alias("base"))
    more = spans(df, id_col, text, notices, near, alike).groupBy("id", "h1", "h2").agg(F.collect_set("label").alias("found"), F.max("alike").alias("best"))
    more = more.select(F.col("id").alias("id_"), F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), "found", "best")
    joined = facts.join(more, facts["id"].eqNullSafe(more["id_"]) & (facts["h1"] == more["h1_"]) & (facts["h2"] == more["h2_"]), "left")
    own = F.transform("base", lambda p: p["label"])
    labels = F.array_sort(F.array_distinct(F.concat(own, F.coalesce("found", F.array().cast("array<string>")))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(F.col("id").alias(id_col), "n_words", "base", labels.alias("labels"), score.alias("score"))
