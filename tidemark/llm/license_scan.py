"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences at line ends and after closing punctuation; a sentence is normalised to
lower-case ASCII letters and digits, single-spaced. Wrapped sentences count too: a known sentence is
found wherever it begins and ends at a cut and only single line ends, with the comment marks after
them, lie inside; blank lines and closing punctuation part it. Known sentences become their
identifiers, in order, and a rule fires when its identifiers follow one another in that sequence or
in the sequence of single lines (unknown sentences in between don't matter, nor do known ones that
the rule names as optional). Each row is worked on
alone: no shuffle, no broadcast; the tables are part of the plan.

Null or empty text has no sentences. Null or repeated ids and repeated rows go through row for row;
only the id and text columns are read. An empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import field, unicode_text

# Sentences of public licence texts and notices, normalised.
SENTENCES = {
    "mit_notice": "released under the mit license",
    "mit_notice_licensed": "licensed under the mit license",
    "mit_project": "this project is licensed under the mit license",
    "mit_spdx": "spdx license identifier mit",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache_notice": "licensed under the apache license version 2 0",
    "apache_notice_the_license": "licensed under the apache license version 2 0 the license",
    "apache_spdx": "spdx license identifier apache 2 0",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3_notice": "this work is licensed under the gnu general public license version 3",
    "gpl3_licensed": "licensed under the gnu general public license version 3",
    "gpl3_spdx_only": "spdx license identifier gpl 3 0 only",
    "gpl3_spdx_later": "spdx license identifier gpl 3 0 or later",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_free_part": "this program is free software",
    "gpl_redistribute_3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl_hope_part": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc_by_nc_4_notice": "licensed under cc by nc 4 0",
    "cc_by_4_notice": "licensed under cc by 4 0",
    "cc_by_sa_4_notice": "licensed under cc by sa 4 0",
    "cc0_notice": "released under cc0 1 0",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_no_endorsement": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_as_is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2_notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "unlicense_anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "unlicense_dedicate": "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    "unlicense_spdx": "spdx license identifier unlicense",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
    "bsd_liability_loss": "loss of use data or profits",
    "bsd_liability_cause": "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd2_spdx": "spdx license identifier bsd 2 clause",
    "bsd3_spdx": "spdx license identifier bsd 3 clause",
    "isc_disclaim": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc_liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "isc_spdx": "spdx license identifier isc",
    "gpl_redistribute_2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_details": "see the gnu general public license for more details",
    "gpl_received": "you should have received a copy of the gnu general public license along with this program",
    "gpl2_spdx_only": "spdx license identifier gpl 2 0 only",
    "gpl2_spdx_later": "spdx license identifier gpl 2 0 or later",
    "agpl_redistribute_3": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl_spdx_only": "spdx license identifier agpl 3 0 only",
    "agpl_spdx_later": "spdx license identifier agpl 3 0 or later",
    "lgpl_free_part": "this library is free software",
    "lgpl_redistribute_21": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl_redistribute_3": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21_spdx_only": "spdx license identifier lgpl 2 1 only",
    "lgpl21_spdx_later": "spdx license identifier lgpl 2 1 or later",
    "mpl2_obtain": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "mpl2_spdx": "spdx license identifier mpl 2 0",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib_spdx": "spdx license identifier zlib",
    "bsl_notice": "distributed under the boost software license version 1 0",
    "bsl_spdx": "spdx license identifier bsl 1 0",
    "cc0_dedicated": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0_spdx": "spdx license identifier cc0 1 0",
    "cc_by_4_work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc_by_sa_4_work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc_by_nc_4_work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "all_rights": "all rights reserved",
}

#: (licence, identifiers in order[, identifiers that may stand between]). Every rule that fires counts.
#: "All rights reserved." is a known sentence but no licence: it stands in many licence texts and books.
RULES = [
    ("MIT", ["mit_notice"]),
    ("MIT", ["mit_notice_licensed"]),
    ("MIT", ["mit_project"]),
    ("MIT", ["mit_spdx"]),
    ("MIT", ["mit_grant", "mit_keep", "mit_warranty"]),
    ("Apache-2.0", ["apache_notice"]),
    ("Apache-2.0", ["apache_spdx"]),
    ("Apache-2.0", ["apache_notice_the_license", "apache_use", "apache_copy", "apache_basis"]),
    ("Apache-2.0", ["apache_notice_the_license", "apache_use"]),
    ("GPL-3.0", ["gpl3_notice"]),
    ("GPL-3.0", ["gpl3_licensed"]),
    ("GPL-3.0", ["gpl3_spdx_only"]),
    ("GPL-3.0-or-later", ["gpl3_spdx_later"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope"]),
    ("GPL-3.0-or-later", ["gpl_free_part", "gpl_redistribute_3"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_4_notice"]),
    ("CC-BY-4.0", ["cc_by_4_notice"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_4_notice"]),
    ("CC0-1.0", ["cc0_notice"]),
    ("BSD-3-Clause", ["bsd_redistribution", "bsd_no_endorsement", "bsd_as_is"], ["bsd_source", "bsd_binary"]),
    ("BSD-2-Clause", ["bsd_redistribution", "bsd_as_is"], ["bsd_source", "bsd_binary"]),
    ("ISC", ["isc_grant"]),
    ("MPL-2.0", ["mpl2_notice"]),
    ("Unlicense", ["unlicense_free"]),
    ("Unlicense", ["unlicense_anyone", "unlicense_dedicate"]),
    ("Unlicense", ["unlicense_spdx"]),
    ("BSD-2-Clause", ["bsd2_spdx"]),
    ("BSD-3-Clause", ["bsd3_spdx"]),
    ("ISC", ["isc_spdx"]),
    ("GPL-2.0", ["gpl2_spdx_only"]),
    ("GPL-2.0-or-later", ["gpl2_spdx_later"]),
    ("GPL-2.0-or-later", ["gpl_free_part", "gpl_redistribute_2"]),
    ("AGPL-3.0", ["agpl_spdx_only"]),
    ("AGPL-3.0-or-later", ["agpl_spdx_later"]),
    ("AGPL-3.0-or-later", ["gpl_free_part", "agpl_redistribute_3"]),
    ("LGPL-2.1", ["lgpl21_spdx_only"]),
    ("LGPL-2.1-or-later", ["lgpl21_spdx_later"]),
    ("LGPL-2.1-or-later", ["lgpl_free_part", "lgpl_redistribute_21"]),
    ("LGPL-3.0-or-later", ["lgpl_free_part", "lgpl_redistribute_3"]),
    ("LGPL-3.0-or-later", ["gpl_free_part", "lgpl_redistribute_3"]),
    ("MPL-2.0", ["mpl2_spdx"]),
    ("Zlib", ["zlib_as_is", "zlib_grant"], ["zlib_liability"]),
    ("Zlib", ["zlib_spdx"]),
    ("BSL-1.0", ["bsl_notice"]),
    ("BSL-1.0", ["bsl_spdx"]),
    ("CC0-1.0", ["cc0_dedicated"]),
    ("CC0-1.0", ["cc0_spdx"]),
    ("CC-BY-4.0", ["cc_by_4_work"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_4_work"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_4_work"]),
]

#: Rules for notices that are no licence by themselves; ``op7_license_scan`` and its SQL report them too.
NOTICES = [("Proprietary", ["all_rights"])]


def pattern(ids: list[str], between: tuple | list = ()) -> str:
    """A rule over a sequence with a space before and after each identifier."""
    gap = f"(?: (?:{'|'.join(between)}))*" if between else ""
    return f" {f'{gap} '.join(ids)} "


def sentences(text: Column) -> Column:
    """Normalised sentences, in order, empty ones left out."""
    parted = F.regexp_replace(text, r"([.!?;:])[ \t-\r]+", "$1\n")
    plain = F.lower(F.regexp_replace(parted, r"[^A-Za-z0-9\n]+", " "))
    return F.filter(F.transform(F.split(plain, "\n"), lambda s: F.trim(s)), lambda s: s != "")


#: White space after closing punctuation, but not in "v. 2.0" or an SPDX tag.
_CLOSED = r"(?<=[.!?;:])(?!(?<=\b[Vv]\.)[ \t\n]+[0-9])(?<!SPDX-License-Identifier:)[ \t\n]+"


def wrapped(text: Column, known: list[str]) -> Column:
    """The known sentences of a text, wrapped or not, in order; the longer one where two begin."""
    lines = F.regexp_replace(text, r"\r\n?|[\x0B\f]", "\n")
    bare = F.regexp_replace(lines, r"(^|\n)[^A-Za-z0-9\n]*+(?:(?:dnl|rem|REM)[ \t]+)?", "\n")
    plain = F.lower(F.regexp_replace(F.regexp_replace(bare, _CLOSED, "\n\n"), r"[^A-Za-z0-9\n]+", " "))
    # "#" for a cut, "|" for a single line end
    marked = F.regexp_replace(F.regexp_replace(plain, r" *\n *\n[ \n]*", "#"), r" *\n *", "|")
    one_of = "|".join(re.escape(s).replace(r"\ ", "[ |]") for s in sorted(known, key=len, reverse=True)) or "(?!)"
    found = F.regexp_extract_all(F.concat(F.lit("#"), F.trim(marked), F.lit("#")), F.lit(f"(?<=[#|])(?:{one_of})(?=[#|])"), F.lit(0))
    return F.transform(found, lambda s: F.translate(s, "|", " "))


def recognise(docs: DataFrame, sentence_ids: dict[str, str] | None = None, rules: list | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_sentences``, ``sentence_ids`` (known ones, in order) and
    ``licences`` (distinct, sorted)."""
    known, rules = SENTENCES if sentence_ids is None else sentence_ids, RULES if rules is None else rules
    table = F.create_map(*[F.lit(x) for name, text in known.items() for x in (text, name)])
    text = unicode_text(text_col)
    rows = docs.select(field(id_col).alias(id_col), sentences(text).alias("sentence"), wrapped(text, list(known.values())).alias("whole"))
    ids = lambda c: F.filter(F.transform(c, lambda s: F.try_element_at(table, s)), lambda i: i.isNotNull())
    rows = rows.select(field(id_col), F.size("sentence").cast("long").alias("n_sentences"), ids("whole").alias("sentence_ids"), ids("sentence").alias("line_ids"))
    # both sequences; "/" is in no identifier
    sequence = F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" / "), F.array_join("line_ids", " "), F.lit(" "))
    has = lambda ids, between=(): sequence.rlike(pattern(ids, between)) if between else F.contains(sequence, F.lit(pattern(ids)))
    fired = [F.when(has(*rule), F.lit(name)) for name, *rule in rules]
    return rows.withColumn("licences", F.array_sort(F.array_distinct(F.array_compact(F.array(*fired))))).drop("line_ids")


def digest(recognised: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return recognised.select(
        field(id_col),
        "n_sentences",
        F.size("sentence_ids").cast("long").alias("n_known"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
    )
