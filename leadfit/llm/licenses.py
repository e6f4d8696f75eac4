"""Licence scans by sentence rules: known sentences become identifiers, sequences of identifiers become licences.

A text is brought to a normal form and searched for the known sentences, each on one line or wrapped over several, also
behind comment marks; what is found, in order, is a sequence of identifiers. Ordered rules name the sequences that make a licence; each rule takes its
sequences out before the next one looks, so a long licence isn't also counted by one of its sentences. All of it is one
expression over the text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadfit.llm.common import texts_of

# Known licence sentences in normal form (lower case, other characters than letters, digits, + and . as
# blanks, no stop at the end), by identifier
SENTENCES: dict[str, tuple[str, ...]] = {
    "MITref": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "mit license", "the mit license", "the mit license mit"),
    "MITgrant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "MITnotice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "MITwarranty": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "Apache2ref": ("licensed under the apache license version 2.0", "released under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "this project is licensed under the apache license version 2.0", "apache license version 2.0", "apache license 2.0"),
    "Apache2comply": ("you may not use this file except in compliance with the license",),
    "Apache2copy": ("you may obtain a copy of the license at",),
    "Apache2warranty": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "GPL3ref": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "gnu general public license version 3", "licensed under gpl 3.0", "licensed under the gplv3"),
    "GPL2ref": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2", "gnu general public license version 2", "licensed under the gplv2"),
    "GPLgrant2+": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "GPLgrant3+": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "GPLwarranty": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "LGPL3ref": ("licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"),
    "AGPL3ref": ("licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"),
    "CCBYref": ("licensed under cc by 4.0", "this work is licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "CCBYSAref": ("licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    "CCBYNCref": ("licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    "CC0ref": ("licensed under cc0 1.0", "released under cc0 1.0", "this work is dedicated to the public domain"),
    "BSDredistribute": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "BSDsource": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "BSDbinary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "BSDendorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "BSD3ref": ("licensed under the bsd 3 clause license", "released under the bsd 3 clause license"),
    "BSD2ref": ("licensed under the bsd 2 clause license", "released under the bsd 2 clause license"),
    "MPL2ref": ("this source code form is subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license version 2.0"),
    "ISCgrant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "Rights": ("all rights reserved",),
}

# Rules in the order in which they apply, longer sequences of a family first
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("MITgrant", "MITnotice", "MITwarranty")),
    ("MIT", ("MITgrant", "MITnotice")),
    ("Apache-2.0", ("Apache2ref", "Apache2comply", "Apache2copy", "Apache2warranty")),
    ("Apache-2.0", ("Apache2ref", "Apache2comply", "Apache2copy")),
    ("GPL-3.0-or-later", ("GPLgrant3+", "GPLwarranty")),
    ("GPL-2.0-or-later", ("GPLgrant2+", "GPLwarranty")),
    ("BSD-3-Clause", ("BSDredistribute", "BSDsource", "BSDbinary", "BSDendorse")),
    ("BSD-2-Clause", ("BSDredistribute", "BSDsource", "BSDbinary")),
    ("GPL-3.0-or-later", ("GPLgrant3+",)),
    ("GPL-2.0-or-later", ("GPLgrant2+",)),
    ("MIT", ("MITref",)),
    ("MIT", ("MITgrant",)),
    ("Apache-2.0", ("Apache2ref",)),
    ("GPL-3.0-only", ("GPL3ref",)),
    ("GPL-2.0-only", ("GPL2ref",)),
    ("LGPL-3.0-only", ("LGPL3ref",)),
    ("AGPL-3.0-only", ("AGPL3ref",)),
    ("CC-BY-NC-4.0", ("CCBYNCref",)),
    ("CC-BY-SA-4.0", ("CCBYSAref",)),
    ("CC-BY-4.0", ("CCBYref",)),
    ("CC0-1.0", ("CC0ref",)),
    ("BSD-3-Clause", ("BSD3ref",)),
    ("BSD-2-Clause", ("BSD2ref",)),
    ("MPL-2.0", ("MPL2ref",)),
    ("ISC", ("ISCgrant",)),
)

# each known sentence holds one of these, so a text without them needs no sentences
TRIGGERS = "licens|permission|redistribut|warrant|copyright|public[^a-z0-9]++domain|gpl|apache|rights[^a-z0-9]++reserved|free[^a-z0-9]++software|cc0"
# one break of a line, with blanks and comment marks at the start of the next one
LINE = r"(?:^|\r\n|\r|\n)[^a-z0-9+.\r\n]*+(?:\.\\\"[^a-z0-9+.\r\n]*+)?"
# steps to the normal form: \x01 stands where a sentence must end (blank lines, . ! ? before white space or the end), \n
# where it may end or go on (single line breaks, ; and : before white space or the end)
STEPS = (
    (LINE, "\n"), (r"\n{2,}+", "\x01"), (r"(?<![.!?;:])[;:]++(?=[\s\x01]|$)", "\n"), (r"(?<![.!?;:])[.!?;:]++(?=[\s\x01]|$)", "\x01"),
    (r"[^a-z0-9+.\n\x01]+", " "), (r" ?\n[ \n]*+", "\n"), (r"[ \n]?\x01[ \n\x01]*+", "\x01"),
)


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order; an empty array where there is none.

    A sentence begins and ends at a line break, at . ! ? ; : before white space, or with the text. Single line breaks, and
    ; or : inside it, count as blanks; of sentences that begin at one place the longest is taken.
    """
    known = {s: name for name, forms in SENTENCES.items() for s in forms}
    table = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair))
    forms = "|".join(s.replace(".", r"\.").replace("+", r"\+").replace(" ", r"[ \n]") for s in sorted(known, key=lambda s: (-len(s), s)))
    line = F.translate(F.lower(text), "\x01", "\x02")
    for pattern, to in STEPS:
        line = F.regexp_replace(line, pattern, to)
    hits = F.regexp_extract_all(F.trim(line), F.lit(rf"(?<![^\n\x01])(?:{forms})(?![^\n\x01])"), F.lit(0))
    found = F.transform(hits, lambda s: F.try_element_at(table, F.translate(s, "\n", " ")))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.lower(text).rlike(TRIGGERS), F.lit(False)), found).otherwise(none)


def applied(ids: Column, rules: Sequence[tuple[str, tuple[str, ...]]]) -> tuple[Column, Column]:
    """(licences, rest): the licences that rules find in a sequence of identifiers, in the order of the rules, and the
    identifiers that no rule took."""
    # one blank on either side of each identifier, so that neighbours don't share one
    line = F.array_join(F.transform(ids, lambda x: F.concat(F.lit(" "), x, F.lit(" "))), "")
    found = []
    for licence, sequence in rules:
        pattern = "".join(f" {x} " for x in sequence)
        found.append(F.when(F.contains(line, F.lit(pattern)), F.lit(licence)))
        line = F.replace(line, F.lit(pattern), F.lit(" | "))
    rest = F.filter(F.split(line, r"[ |]+"), lambda x: x != "")
    return F.filter(F.array_distinct(F.array(*found)), lambda x: x.isNotNull()), rest


def scan_licences(docs: DataFrame, rules: Sequence[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """(doc_id, sentence_ids, licences, unmatched) of every row of docs, from its whole text.

    sentence_ids are the known sentences in order; licences are distinct, in the order of the rules; unmatched are
    identifiers that no rule took. A null or empty text has none; a null doc_id stays null; repeated rows give repeated
    rows; an empty table gives an empty one; other columns are ignored. No shuffle.
    """
    found = texts_of(docs).select("doc_id", identifiers(F.col("text")).alias("sentence_ids"))
    licences, rest = applied(F.col("sentence_ids"), rules)
    return found.select("doc_id", "sentence_ids", licences.alias("licences"), rest.alias("unmatched"))
