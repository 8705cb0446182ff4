"""Licence scan: known sentences become identifiers, sequences of identifiers meet ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import ascii_lower

# Normalised sentences of licence notices and texts, each with its identifier.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2_notice",
    "licensed under the apache license version 2 0 the license": "apache2_notice",
    "this work is licensed under the apache license version 2 0": "apache2_notice",
    "you may not use this file except in compliance with the license": "apache2_compliance",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_as_is",
    "see the license for the specific language governing permissions and limitations under the license": "apache2_see",
    "released under the mit license": "mit_notice",
    "licensed under the mit license": "mit_notice",
    "this work is licensed under the mit license": "mit_notice",
    "mit license": "mit_title",
    "the mit license": "mit_title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_keep",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_as_is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit_liability",
    "this work is licensed under the gnu general public license version 3": "gpl3_notice",
    "licensed under the gnu general public license version 3": "gpl3_notice",
    "this work is licensed under the gnu general public license version 2": "gpl2_notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_or_later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_or_later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_hope",
    "see the gnu general public license for more details": "gpl_see",
    "licensed under cc by nc 4 0": "cc_by_nc4_notice",
    "licensed under cc by 4 0": "cc_by4_notice",
    "licensed under cc by sa 4 0": "cc_by_sa4_notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc_by4_notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc_by_nc4_notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc_by_sa4_notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_as_is",
    "all rights reserved": "all_rights_reserved",
}
# Name of the rule, licence it proves, identifiers in their order.
RULES = (
    ("apache2_header", "Apache-2.0", ("apache2_notice", "apache2_compliance", "apache2_as_is")),
    ("apache2_line", "Apache-2.0", ("apache2_notice",)),
    ("mit_text", "MIT", ("mit_grant", "mit_keep", "mit_as_is")),
    ("mit_line", "MIT", ("mit_notice",)),
    ("gpl3_header", "GPL-3.0-or-later", ("gpl3_or_later", "gpl_hope")),
    ("gpl3_line", "GPL-3.0-only", ("gpl3_notice",)),
    ("gpl2_header", "GPL-2.0-or-later", ("gpl2_or_later", "gpl_hope")),
    ("gpl2_line", "GPL-2.0-only", ("gpl2_notice",)),
    ("cc_by_line", "CC-BY-4.0", ("cc_by4_notice",)),
    ("cc_by_sa_line", "CC-BY-SA-4.0", ("cc_by_sa4_notice",)),
    ("cc_by_nc_line", "CC-BY-NC-4.0", ("cc_by_nc4_notice",)),
    ("bsd3_text", "BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is")),
    ("bsd2_text", "BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is")),
    ("reserved_line", "LicenseRef-all-rights-reserved", ("all_rights_reserved",)),
)
#: Marks and blanks at the start of a line (indents, comment marks) say nothing; a line of marks alone is blank.
LINE_START = r"(?<![^\n])[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
#: A known sentence never goes on past these ...
SENTENCE_END = r"\n(?:\x20?\n)+|[.!?]+(?=[\x20\x09-\x0D]|$)"
#: ... but it may go on past these: texts are wrapped, and some sentences have a colon or semicolon inside.
PIECE_END = r"\n+|[;:]+(?=[\x20\x09-\x0D]|$)"
NOT_PLAIN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Sentences without any of these words are not looked up.
HINT = "licen|copy|permi|redistribut|reserved|warrant|software|creative|version|basis|name of"


def sentences(text: Column) -> Column:
    """Normalised pieces as structs (unit, s): lower-cased A-Z, marks and white space as one blank, trimmed, none empty.

    A piece ends at every line, colon and semicolon; pieces of one ``unit`` may belong to one sentence.
    """
    units = F.split(F.regexp_replace(ascii_lower(text), LINE_START, " "), SENTENCE_END, -1)

    def pieces(unit: Column, i: Column) -> Column:
        plain = F.transform(F.split(unit, PIECE_END, -1), lambda s: F.trim(F.regexp_replace(s, NOT_PLAIN, " ")))
        return F.transform(F.filter(plain, lambda s: s != ""), lambda s: F.struct(i.alias("unit"), s.alias("s")))

    return F.flatten(F.transform(units, pieces))


def known_runs(pieces: str, table: dict[str, str]) -> Column:
    """Known sentences as structs (at, id): the longest run of whole pieces of one unit from each place, none within another."""
    known = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    keys = F.array(*[F.lit(k) for k in table])
    most = max(len(k.split()) for k in table)  # a piece has a word at least

    def longest(x: Column, i: Column) -> Column:
        rest = F.transform(F.filter(F.slice(pieces, i + 1, F.lit(most)), lambda y: y["unit"] == x["unit"]), lambda y: y["s"])
        runs = F.transform(F.sequence(F.lit(1), F.size(rest)), lambda n: F.struct(n.alias("n"), F.element_at(known, F.array_join(F.slice(rest, F.lit(1), n), " ")).alias("id")))
        hits = F.filter(runs, lambda r: r["id"].isNotNull())
        return F.get(hits, F.size(hits) - 1)

    def at_place(x: Column, i: Column) -> Column:
        goes_on = F.exists(keys, lambda k: k.startswith(F.concat(x["s"], F.lit(" "))))
        alone = F.when(x["s"].rlike(HINT), F.element_at(known, x["s"]))
        run = F.when(goes_on, longest(x, i)).otherwise(F.struct(F.lit(1).alias("n"), alone.alias("id")))
        return F.struct(i.alias("at"), run.alias("run"))

    hits = F.filter(F.transform(pieces, at_place), lambda h: h["run"]["id"].isNotNull())
    nothing = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<at:int,id:string>>").alias("found"))

    def add(a: Column, h: Column) -> Column:
        more = F.concat(a["found"], F.array(F.struct(h["at"].alias("at"), h["run"]["id"].alias("id"))))
        return F.when(h["at"] >= a["free"], F.struct((h["at"] + h["run"]["n"]).alias("free"), more.alias("found"))).otherwise(a)

    return F.aggregate(hits, nothing, add, lambda a: a["found"])


def licence_hits(docs: DataFrame, table: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """One row per document: doc_id, n_sentences, identifiers, matches (rule, licence, first, last), licences.

    ``identifiers`` are structs (at, id) of the known sentences in the order of the text, wrapped or not; ``at``
    counts pieces from 0 (see ``sentences``), as ``n_sentences`` does, and is that of the sentence's first. A rule matches if its identifiers occur in their order, other known sentences between
    them allowed; the earliest place counts, and a rule whose identifiers are the beginning or a subset of a
    longer rule that matches for the same licence is not listed again. ``licences`` are the distinct licences,
    sorted. Null and empty texts have no sentences; ids may be null or repeated; an empty table gives no rows;
    other columns are not read. Table and rules are parameters of the job, a few hundred entries.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentences(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("s"))
    found = texts.select("doc_id", F.size("s").cast("long").alias("n_sentences"), known_runs("s", table).alias("identifiers"))

    def first_place(ids: tuple[str, ...]) -> Column:
        """Array of the places at which the identifiers, taken greedily in order, stand."""
        wanted = F.array(*[F.lit(i) for i in ids])
        none = F.array().cast("array<int>")
        return F.aggregate(
            "identifiers", none, lambda a, x: F.when((F.size(a) < len(ids)) & (F.get(wanted, F.size(a)) == x["id"]), F.concat(a, F.array(x["at"]))).otherwise(a)
        )

    tried = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.lit(lic).alias("licence"), F.lit(len(ids)).alias("size"), first_place(ids).alias("places")) for n, lic, ids in rules]
    )
    found = found.withColumn("tried", F.when(F.size("identifiers") > 0, F.filter(tried, lambda r: F.size(r["places"]) == r["size"])).otherwise(F.array().cast("array<struct<rule:string,licence:string,size:int,places:array<int>>>")))
    kept = F.filter("tried", lambda r: ~F.exists("tried", lambda o: (o["licence"] == r["licence"]) & (o["size"] > r["size"])))
    matches = F.transform(kept, lambda r: F.struct(r["rule"].alias("rule"), r["licence"].alias("licence"), F.element_at(r["places"], 1).alias("first"), F.element_at(r["places"], -1).alias("last")))
    found = found.withColumn("matches", matches)
    return found.select("doc_id", "n_sentences", "identifiers", "matches", F.array_sort(F.array_distinct("matches.licence")).alias("licences"))
