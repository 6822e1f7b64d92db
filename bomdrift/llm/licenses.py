"""Licence recognition by sentences, in DataFrame functions only and without a shuffle.

A text is cut into sentences (at a mark before a blank or the end, or at an empty line); a sentence that is not
known is tried line by line. Sentences are normalised: lower case of A-Z, marks as blanks, runs of blanks as one.
Known sentences give a sequence of identifiers in the order of the text. Licence rules, longest first, are
ordered lists of identifiers that must occur in this order, others between them allowed; a rule consumes what
it matches.

Null and empty texts have no sentences and no licence. Texts of any length are judged whole, in time that grows with
their sentences. Repeated rows are judged alike; an empty table gives an empty result. Columns named sentence_ids and
licenses are replaced; all others are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of public licences and notices, and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "spdx license identifier mit": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-asis",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-ref",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2-ref",
    "spdx license identifier apache 2 0": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-asis",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "spdx license identifier gpl 3 0 only": "gpl3-ref",
    "spdx license identifier gpl 3 0 or later": "gpl3-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "licensed under cc by nc 4 0": "ccbync4-ref",
    "licensed under cc by 4 0": "ccby4-ref",
    "licensed under cc by sa 4 0": "ccbysa4-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all rights reserved": "reserved",
}
#: Licence and the identifiers that state it, in order.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-copy", "apache2-asis")),
    ("Apache-2.0", ("apache2-ref", "apache2-copy", "apache2-asis")),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl2-grant", "gpl-warranty")),
    ("MIT", ("mit-ref",)),
    ("Apache-2.0", ("apache2-ref",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("GPL-2.0-or-later", ("gpl2-grant",)),
    ("CC-BY-NC-4.0", ("ccbync4-ref",)),
    ("CC-BY-4.0", ("ccby4-ref",)),
    ("CC-BY-SA-4.0", ("ccbysa4-ref",)),
    ("all-rights-reserved", ("reserved",)),
)
#: Every known sentence has one of these; texts without any are not cut.
HINT = "licen|warrant|copyright|permission|redistribut|reserved"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = ",:'\"()[]{}-/*#<>|_"
ENDS = r"[.!?;]+(?:[ \t\r\n]+|$)|\n[ \t\r]*\n"
BETWEEN = r"[ \t\r\n.!?;]+"


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, BETWEEN, " "))


def recognised(docs: DataFrame) -> DataFrame:
    """docs with sentence_ids (array<string>) and licenses (array<string>, in the order of RULES, each once)."""
    known = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    plain = F.translate(F.col("text"), UPPER + MARKS, LOWER + " " * len(MARKS))
    hinted = F.when(plain.rlike(HINT), plain)
    named = lambda s: F.element_at(known, _normal(s))
    lines = lambda s: F.transform(F.split(s, "\n"), named)
    found = F.transform(F.split(hinted, ENDS), lambda s: F.when(named(s).isNotNull(), F.array(named(s))).otherwise(lines(s)))
    ids = F.coalesce(F.array_compact(F.flatten(found)), _none())
    rows = docs.withColumn("sentence_ids", ids)
    return rows.withColumn("licenses", F.when(F.size("sentence_ids") > 0, _matched(F.col("sentence_ids"))).otherwise(_none()))


def _none() -> Column:
    return F.array().cast("array<string>")


def _matched(ids: Column) -> Column:
    """The licences whose rules match, each rule on what the rules before it have left.

    A rule is one pass over the identifiers with one number as its state: how many it has met in its order, over and
    over. What belongs to a whole match is consumed; a match begun and not ended consumes nothing.
    """
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, own)).alias("own")) for name, own in RULES))

    def step(state: Column, rule: Column) -> Column:
        wanted = lambda met: F.get(rule["own"], met % F.size(rule["own"]))
        met = F.aggregate(state["left"], F.lit(0), lambda n, x: n + (x == wanted(n)).cast("int"))
        whole = _let(met, lambda n: n - n % F.size(rule["own"]))
        return _let(whole, lambda n: F.when(n > 0, F.struct(
            _unused(state["left"], n, wanted).alias("left"), F.concat(state["found"], F.array(rule["name"])).alias("found"))).otherwise(state))

    begin = F.struct(ids.alias("left"), _none().alias("found"))
    return F.array_distinct(F.aggregate(rules, begin, step)["found"])


#: Identifiers handled at once: arrays that grow by one are copied, so they are kept short.
PIECE = 256


def _unused(ids: Column, consumed: Column, wanted: Callable[[Column], Column]) -> Column:
    """The identifiers without the first `consumed` ones that a rule meets."""

    def one(state: Column, x: Column) -> Column:
        hit = (state["met"] < consumed) & (x == wanted(state["met"]))
        return F.when(hit, F.struct((state["met"] + 1).alias("met"), state["left"].alias("left"))).otherwise(
            F.struct(state["met"].alias("met"), F.concat(state["left"], F.array(x)).alias("left")))

    def piece(state: Column, part: Column) -> Column:
        after = F.aggregate(part, F.struct(state["met"].alias("met"), _none().alias("left")), one)
        return _let(after, lambda s: F.struct(s["met"].alias("met"), F.concat(state["left"], F.array(s["left"])).alias("left")))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / PIECE).cast("int")), lambda i: F.slice(ids, i * PIECE + 1, PIECE))
    begin = F.struct(F.lit(0).alias("met"), F.array().cast("array<array<string>>").alias("left"))
    return F.flatten(F.aggregate(pieces, begin, piece)["left"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]
