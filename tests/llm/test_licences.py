"""Whole public licence texts (fixed values), written out here and not taken from the operator's tables."""

import textwrap

from tidemark.llm import license_scan

MIT = """MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Copyright (c) 2021, Some Body. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
NOTICE = """This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{sep2} either version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""


def notice(what: str, name: str, version: str, sep: str = ";", sep2: str = ",") -> str:
    return NOTICE.format(what=what, name=name, version=version, sep=sep, sep2=sep2)


WHOLE = [
    ("MIT", MIT), ("BSD-2-Clause", BSD.format("")), ("BSD-3-Clause", BSD.format(THIRD)), ("ISC", ISC), ("Unlicense", UNLICENSE), ("Zlib", ZLIB),
    ("GPL-2.0-or-later", notice("program", "General Public License", "2")), ("GPL-3.0-or-later", notice("program", "General Public License", "3", ":")),
    ("AGPL-3.0-or-later", notice("program", "Affero General Public License", "3", ":")), ("LGPL-2.1-or-later", notice("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0-or-later", notice("program", "Lesser General Public License", "3", ":")),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
]


def test_whole_texts_at_several_widths(spark):
    rows = []
    for name, text in WHOLE:
        for width in (50, 76, 3000):
            lines = [part for line in text.split("\n") for part in (textwrap.wrap(line, width) or [""])]
            for prefix in ("", "# ", " * "):
                rows.append((name, "\n".join(prefix + line for line in lines)))
    # a reserved right is no licence, alone or beside one on a line of its own
    rows += [("", "It was a dark night. All rights reserved."), ("", "All rights reserved."), ("BSD-3-Clause", BSD.format(THIRD).replace(". All rights", "\nAll rights"))]
    # a clause is missing, or comes too late: no licence
    rows += [("", MIT.split("\n\n")[4]), ("", "\n\n".join(BSD.format("").split("\n\n")[2:]))]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "`doc.id` long, `a text` string")
    both = docs.unionByName(docs.limit(5))
    found = license_scan.digest(license_scan.recognise(both, id_col="doc.id", text_col="a text"), "doc.id").collect()
    assert len(found) == len(rows) + 5
    wrong = [(rows[r["doc.id"]][0], r.licences, rows[r["doc.id"]][1][:80]) for r in found if r.licences != rows[r["doc.id"]][0]]
    assert wrong == []


def test_query_reports_reserved_rights(spark, tmp_path):
    """The registered query names a reserved right, as its SQL does; the licence rules alone don't."""
    from tidemark.llm import queries

    docs = spark.createDataFrame([(1, "It was a dark night. All rights reserved."), (2, "Released under the MIT License.\nAll rights reserved."), (3, "No notice."), (4, None)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.licences for r in queries.op7_license_scan(spark, str(tmp_path)).collect()}
    assert found == {1: "Proprietary", 2: "MIT,Proprietary", 3: "", 4: ""}
    assert "'Proprietary'" in queries.ORACLES["op7_license_scan"]
