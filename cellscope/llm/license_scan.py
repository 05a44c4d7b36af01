"""Licence scan by canonical digest: normalise whole texts, hash-join them to known digests.

Two kinds of unit are looked up: the entire text of a document, and, as entire texts of their
own, its lines that name a licence. DataFrame functions only.

Defined results: a null text counts as empty and has the digest of the empty string, which is no
known licence; repeated rows are scanned one by one; texts of any length are read whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (strings of which one must occur, pattern, replacement), for lower-case text.
SPELLINGS = (
    (("licenc",), r"\b(sub|re)?licenc(e|ed|ee|es|ing|or)\b", r"$1licens$2"),
    (("organis", "authoris", "recognis", "utilis", "capitalis"), r"\b(organi|authori|recogni|utili|capitali)s(e|ed|es|ing|ation|ations)\b", r"$1z$2"),
    (("favour", "honour", "labour", "behaviour"), r"\b(fav|hon|lab|behavi)our", r"$1or"),
    (("whilst",), r"\bwhilst\b", "while"),
    (("acknowledgement",), r"\backnowledgement", "acknowledgment"),
    (("non-infringement",), r"\bnon-infringement\b", "noninfringement"),
    (("https:",), r"\bhttps:", "http:"),
    (("(c)", "©"), r"\(c\)|©", "copyright"),
)
#: A line that starts so holds names and years only.
COPYRIGHT_LINE = r"(?m)^[ \t]*copyright\b[^\n]*$"
NOTICE_LINE = r"(?i)licen[cs]|copyright|spdx"

# Names and texts of well-known licences and notices.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_UNLICENSE = "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
_GNU_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {0} of the License, or (at your option) any later version."
#: Identifiers whose tag line is known.
SPDX = (
    "Apache-2.0", "MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "MPL-2.0", "EPL-2.0", "WTFPL",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
)
KNOWN = (
    ("Unlicense", _UNLICENSE + "For more information, please refer to <http://unlicense.org/>"),
    ("Unlicense", _UNLICENSE + "For more information, please refer to <http://unlicense.org>"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST),
    ("BSL-1.0", _BOOST),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("GPL-2.0-or-later", _GNU_NOTICE.format(2)),
    ("GPL-3.0-or-later", _GNU_NOTICE.format(3)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", f"MIT License\n{_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"),
    ("MIT", f"{_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"),
    ("MIT-0", f"MIT No Attribution\n{_GRANT}.\n{_AS_IS}"),
    ("ISC", f"ISC License\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0BSD", f"{_ISC}.\n{_ISC_END}"),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_NAME + _BSD_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _guarded(text: Column, needles, pattern: str, to: str) -> Column:
    """A replacement that runs only where one of the plain strings occurs."""
    return _let(text, lambda t: F.when(reduce(or_, [F.contains(t, F.lit(n)) for n in needles]), F.regexp_replace(t, F.lit(pattern), F.lit(to))).otherwise(t))


def canonical(text: Column) -> Column:
    """Lower case, one spelling, no copyright lines, words joined by single spaces."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for needles, pattern, to in (*SPELLINGS, (("copyright",), COPYRIGHT_LINE, "")):
        out = _guarded(out, needles, pattern, to)
    return F.trim(F.regexp_replace(out, F.lit(r"[^\p{L}\p{N}]+"), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license): one row per digest; a fixed table whatever the corpus."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("license"), F.lit(t).alias("t")) for i, t in known])).alias("k")
    return spark.range(1, numPartitions=1).select(rows).select(digest(F.col("k.t")).alias("digest"), F.col("k.license").alias("license")).groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known=KNOWN) -> DataFrame:
    """(doc_id, digest, license, notices, n_notices) for each row of ``docs`` (doc_id, text).

    ``license`` names the licence whose text the document is, else null. ``notices`` holds, sorted
    and comma-joined, the licences its notice lines are the entire texts of; n_notices counts such
    lines. The known table is a fixed literal, so it is broadcast.
    """
    table = F.broadcast(known_digests(docs.sparkSession, known))
    lookup = F.broadcast(known_digests(docs.sparkSession, known).agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("__known")))
    text = F.coalesce(F.col("text"), F.lit(""))
    # the cheap test on the whole text spares most documents the splitting
    hinted = F.contains(F.lower(text), F.lit("licen")) | F.contains(F.lower(text), F.lit("copyright")) | F.contains(F.lower(text), F.lit("spdx"))
    lines = F.when(hinted, F.filter(F.split(text, "\n"), lambda s: s.rlike(NOTICE_LINE))).otherwise(F.array().cast("array<string>"))
    units = docs.select("doc_id", digest(text).alias("digest"), F.transform(lines, digest).alias("__lines"))
    hits = F.filter(F.transform(F.col("__lines"), lambda d: F.try_element_at(F.col("__known"), d)), lambda x: x.isNotNull())
    found = units.join(table, "digest", "left").crossJoin(lookup).select("doc_id", "digest", "license", hits.alias("__hits"))
    return found.select("doc_id", "digest", "license", F.array_join(F.array_sort(F.array_distinct("__hits")), ",").alias("notices"), F.size("__hits").cast("bigint").alias("n_notices"))
