"""License scans: Dice coefficient of word bigrams between normalised text and license templates.

Units of a document are its lines, the whole text, and windows of words in it, which may cross lines. A unit and a
template can only reach the least coefficient if their numbers of bigrams are close, so units that fit no template by
size are dropped before anything is joined; and only if they share enough bigrams, so texts without a template's anchor
words go no further, and windows are formed only of texts that hold enough of a template's bigrams somewhere.
Templates are short notices and, in the folder ``licenses``, full texts.
All of it is DataFrame expressions; what is broadcast is the templates, whose number is a fixed list.
"""

from __future__ import annotations

import re
from itertools import accumulate
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, settled

#: Short notices and headers by which works state their license.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Full license texts, which come after the notices in the templates' numbers.
FULL = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]

#: Words that texts of all kinds hold, which are the last to be chosen as anchors, as are single letters and digits.
COMMON = frozenset("about after all also an and any are as at be been but by can do each first for from had has have he her his if in into is it its made make many may more most must no not of on one only or other our out over shall she should so some such than that the their them then there these they this those time to two under up use was we were what when where which who will with would you your".split())
#: Bigrams of a template for each further anchor word that a text must hold, and such words at most.
SHORT, MOST = 30, 7


def normal_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(text: str) -> list[str]:
    w = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def _words(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def anchors(grams: list[str], least: float) -> tuple[list[str], int]:
    """Words of the template of these bigrams, and how many of them a unit must hold to reach ``least`` with it.

    Such a unit has least / (2 - least) of the template's bigrams or more, as it has no fewer of its own. Each bigram is
    counted for one chosen word only, so a unit without k of the words lacks at least the sum of the k smallest counts.
    Common words come last; of others those in most bigrams come first. Longer templates have more words chosen.
    """
    t = len(grams)
    may_lack = int(t - least / (2 - least) * t + 1e-9)
    of: dict[str, set] = {}
    for g in grams:
        for w in g.split():
            of.setdefault(w, set()).add(g)
    chosen, counts, met, need = [], [], set(), 0
    for w in sorted(of, key=lambda w: (w in COMMON or len(w) < 2, -len(of[w]), -len(w), w)):
        if need > min(1 + t // SHORT, MOST):
            break
        if of[w] - met:
            chosen.append(w)
            counts.append(len(of[w] - met))
            met |= of[w]
            absent = sum(x <= may_lack for x in accumulate(sorted(counts)))
            need = len(chosen) - absent
    return chosen, need


def _pairs(words: str) -> Column:
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b))


def _windows(held: DataFrame, table: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(doc_id, row, template, license, dice, begin, end, line, last) of windows of words at ``least`` or more.

    held: (doc_id, row, lines); begin and end are numbers of the text's bigrams, line and last the lines of the ends.
    A window has at most (2 - least) / least as many bigrams as the template has, repeats included. Neighbours that
    the template has never lower the coefficient, so windows that begin where a run of the template's bigrams begins
    are enough; of the windows with one beginning the best is given. A window within that of a template of twice the
    size or more is left out.
    """
    texts = held.dropDuplicates(["doc_id", "row"])
    at = F.flatten(F.transform("lines", lambda w, i: F.array_repeat(i + 1, F.size(w))))
    flat = settled(texts, words=F.flatten("lines"), at=at).where(F.size("words") > 1)
    places = flat.select("doc_id", "row", F.posexplode(F.arrays_zip(_pairs("words").alias("gram"), F.expr("slice(at, 1, size(at) - 1)").alias("line"), F.expr("slice(at, 2, size(at) - 1)").alias("last"))).alias("pos", "x"))
    places = places.select("doc_id", "row", "pos", "x.gram", "x.line", "x.last")
    enough = F.col("n") * (2 - least) >= F.col("t_size") * least - 1e-9
    near = places.join(F.broadcast(table), "gram").groupBy("doc_id", "row", "template", "license", "t_size", "t_span").agg(F.size(F.collect_set("gram")).alias("n")).where(enough).drop("n")
    before = F.lag("pos").over(Window.partitionBy("doc_id", "row", "gram").orderBy("pos"))
    near = scratch.put(near.withColumnsRenamed({"doc_id": "n_id", "row": "n_row"}))
    same = F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("row") == F.col("n_row"))
    some = places.join(near.select("n_id", "n_row").distinct(), same, "left_semi").withColumn("before", F.coalesce(before, F.lit(-1)))
    every = some.join(near, same).drop("n_id", "n_row")
    marks = table.select(F.col("template").alias("m_template"), F.col("gram").alias("m_gram"), F.lit(True).alias("hit"))
    every = every.join(F.broadcast(marks), (F.col("template") == F.col("m_template")) & (F.col("gram") == F.col("m_gram")), "left")
    each = F.struct("pos", "before", F.coalesce("hit", F.lit(False)).alias("hit"), "line", "last")
    texts = every.groupBy("doc_id", "row", "template", "license", "t_size", "t_span").agg(F.array_sort(F.collect_list(each)).alias("a"))
    begins = F.expr("filter(sequence(0, size(a) - 1), i -> a[i].hit and not (i > 0 and a[greatest(i - 1, 0)].hit))")
    starts = texts.withColumn("begin", F.explode(begins)).withColumn("w", F.expr("slice(a, begin + 1, t_span)")).drop("a")
    starts = starts.withColumn("n", F.size(F.filter("w", lambda x: x["hit"]))).where(enough)

    def step(acc, x):
        new = x["before"] < F.col("begin")
        s, n = acc["s"] + new.cast("int"), acc["n"] + (new & x["hit"]).cast("int")
        dice = 2 * n / (s + F.col("t_size"))
        better = x["hit"] & (dice > acc["dice"])
        return F.struct(s.alias("s"), n.alias("n"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, x["pos"]).otherwise(acc["end"]).alias("end"), F.when(better, x["last"]).otherwise(acc["last"]).alias("last"))

    zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("n"), F.lit(0.0).alias("dice"), F.lit(-1).alias("end"), F.lit(0).alias("last"))
    best = starts.withColumn("line", F.col("w")[0]["line"]).withColumn("x", F.aggregate("w", zero, step))
    best = best.where(F.col("x.dice") >= least).select("doc_id", "row", F.struct("template", "license", "t_size", "x.dice", "begin", "x.end", "line", "x.last").alias("x"))
    # a window within that of a template at least twice as large is a part of that text
    part = lambda x, o: (o["t_size"] >= 2 * x["t_size"]) & (o["begin"] <= x["begin"]) & (o["end"] >= x["end"])
    own = best.groupBy("doc_id", "row").agg(F.collect_list("x").alias("all"))
    own = own.select("doc_id", "row", F.explode(F.filter("all", lambda x: ~F.exists("all", lambda o: part(x, o)))).alias("x"))
    return own.select("doc_id", "row", "x.template", "x.license", "x.dice", "x.begin", "x.end", "x.line", "x.last")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + FULL, least: float = 0.8) -> DataFrame:
    """(doc_id, n_units, license, dice, template, unit, licenses) for each row of ``docs`` (doc_id, text).

    n_units counts the units with a template at ``least`` or more; license and dice are of the best match (ties: the
    smaller template number, then the smaller unit), template its number, unit its line's number (0: the whole text
    of several lines; of a window, the line where it begins), licenses all names found, sorted. Overlapping windows
    count once, and a window doesn't count if it is within a matched line, or if a line that it meets or the whole
    text is matched with its license. Without a match these are 0, null and an empty array.
    Bigrams are sets; units and templates of fewer than two words match nothing. Null and empty texts match
    nothing. Rows that repeat a doc_id with equal text share a result. Other columns are ignored.
    """
    spark = docs.sparkSession
    grams = [bigrams(t) for _, t in templates]
    lo, hi = least / (2 - least), (2 - least) / least  # bounds of unit size / template size
    sizes = [len(g) for g in grams if g] or [0]
    spans = [int((len(normal_words(t)) - 1) * hi + 1e-9) for _, t in templates]
    table = spark.createDataFrame([(i, templates[i][0], len(g), spans[i], x) for i, g in enumerate(grams) for x in g], "template int, license string, t_size int, t_span int, gram string")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    # a text without enough anchor words of any template has no unit that reaches the least coefficient
    kinds = [(len(g), *anchors(g, least)) for g in grams if g]
    every = sorted({w for _, words, _ in kinds for w in words})
    words = F.array_intersect(F.split(F.lower("text"), "[^a-z0-9]+"), F.array(*map(F.lit, every)))

    def enough(hit: Column) -> Column:
        out = F.lit(False)
        for t, chosen, need in kinds:
            # a unit has this share of the template's bigrams at least, each of a character and a separator or more
            out = out | ((F.length("text") >= int(2 * lo * t)) & (F.size(F.array_intersect(hit, F.array(*map(F.lit, chosen)))) >= need))
        return (F.size(hit) > 0) & out

    # bound to a lambda's variable, the words of a text are found once and not for each template
    hold = F.exists(F.array(words), enough)
    lines = F.transform(F.split("text", "\\r\\n|\\n|\\r"), _words)
    with Scratch(spark) as scratch:
        found = scratch.keep(_found(scratch.put(rows.where(hold).select("doc_id", "row", lines.alias("lines"))), table, sizes, least, scratch))
    best = F.max_by(F.struct("license", "dice", "template", "unit"), F.struct("dice", -F.col("template"), -F.col("unit"))).alias("x")
    windows = F.array_sort(F.collect_set(F.when(F.col("begin").isNotNull(), F.struct("begin", "end"))))
    apart = F.aggregate(windows, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")), lambda acc, x: F.struct((acc["n"] + (x["begin"] > acc["end"]).cast("int")).alias("n"), F.greatest(acc["end"], x["end"]).alias("end")))["n"]
    n_units = F.count_distinct(F.when(F.col("begin").isNull(), F.col("unit"))) + apart
    by_doc = found.groupBy(F.col("doc_id").alias("f_id"), F.col("row").alias("f_row")).agg(n_units.alias("n_units"), best, F.array_sort(F.collect_set("license")).alias("licenses"))
    out = rows.drop("text").join(by_doc, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("row") == F.col("f_row")), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), "x.license", "x.dice", "x.template", "x.unit", F.coalesce("licenses", none).alias("licenses"))


def _found(held: DataFrame, table: DataFrame, sizes: list[int], least: float, scratch: Scratch) -> DataFrame:
    """(doc_id, row, unit, template, license, dice, begin, end) of units at ``least`` or more; begin and end are of windows only."""
    lo, hi = least / (2 - least), (2 - least) / least
    whole = F.when(F.size("lines") > 1, F.flatten("lines"))
    units = held.select("doc_id", "row", F.posexplode(F.concat(F.array(whole), F.col("lines"))).alias("unit", "words"))
    # distinct words are at most one more than distinct bigrams
    units = units.where((F.size("words") > 1) & (F.size(F.array_distinct("words")) - 1 <= F.lit(max(sizes) * hi)))
    units = settled(units, grams=F.array_distinct(_pairs("words"))).withColumn("size", F.size("grams"))
    units = units.where(F.col("size").between(min(sizes) * lo, max(sizes) * hi))
    shared = units.select("doc_id", "row", "unit", "size", F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")
    shared = shared.where(F.col("size").between(F.col("t_size") * lo, F.col("t_size") * hi))
    # repeated rows share a key: their bigrams come once for each, so the set of them is counted
    found = shared.groupBy("doc_id", "row", "unit", "template", "license", "t_size", "size").agg(F.size(F.collect_set("gram")).alias("n"))
    found = found.withColumn("dice", 2 * F.col("n") / (F.col("size") + F.col("t_size"))).where(F.col("dice") >= least)
    found = scratch.put(found.select("doc_id", "row", "unit", "template", "license", "dice", F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("end")))
    met = found.groupBy(F.col("doc_id").alias("f_id"), F.col("row").alias("f_row")).agg(F.collect_set(F.struct("unit", "license")).alias("met"))
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("row") == F.col("f_row"))
    told = F.exists("met", lambda u: ((u["unit"] == 0) | u["unit"].between(F.col("line"), F.col("last"))) & ((u["license"] == F.col("license")) | ((u["unit"] > 0) & (F.col("line") == F.col("last")))))
    more = _windows(held, table, least, scratch).join(met, same, "left").where(~F.coalesce(told, F.lit(False)))
    return found.unionByName(more.select("doc_id", "row", F.col("line").alias("unit"), "template", "license", "dice", "begin", "end"))
