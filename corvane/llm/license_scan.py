"""2. Licence scan by canonical digest lookup.

A text is brought to a canonical form - lower case, lines of a copyright notice dropped, equivalent
spellings made one, punctuation and white space made one space - and its SHA-256 digest is hash-joined
to the digests of known licence texts. The same digests of single lines find known notices.

All of it is DataFrame expressions. Defined results: a null, empty or all-punctuation text has the
digest of '' and no licence; of two known texts with one canonical form the smallest id counts; rows
that repeat get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import narrow

# Lines that state a copyright: the word with a sign, a year, a holder's place or "by", or a sign alone.
COPYRIGHT_LINE = r"(^|\n)[ \t\r]*((portions )?copyright:?[ \t]*(\(c\)|©|[0-9]{4}|<|\[|by )|\(c\)[ \t]*(copyright|[0-9]{4}|<|\[)|©)[^\n]*"
# Spellings that licence-matching guidelines treat as equal; the left becomes the right.
EQUIVALENT = (
    ("all rights reserved", ""),
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("http:", "https:"),
    ("&", " and "),
)
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_UNLICENSE = 'This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <https://unlicense.org>'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
# Short public licence texts. More come as a table.
LICENSES = {
    "MIT": f"{_MIT_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_WARRANTY}",
    "MIT-0": f"{_MIT_GRANT}.\n{_WARRANTY}",
    "ISC": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}",
    "0BSD": f"{_ISC_GRANT}.\n{_ISC_WARRANTY}",
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": _BSD_START + _BSD_NAME + _BSD_END,
    "Unlicense": _UNLICENSE,
    "Zlib": _ZLIB,
}
# Titles that stand above a licence's text in many files, or don't.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MIT-0": ["MIT No Attribution"],
    "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"],
    "Unlicense": ["The Unlicense"],
    "Zlib": ["zlib License"],
}
# SHA-256 of the canonical form of long public licence texts, as they are distributed.
DIGESTS = {
    "7dc0ccfedfe9cf9e59c97a3e43eea7b035a0e7a7be84d714acef36eb5c9fb4bc": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f": "GFDL-1.2",
    "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986": "MPL-1.1",
    "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13": "MPL-2.0",
}
# One-line notices and the licence that each names.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
    "SPDX-License-Identifier: CC-BY-NC-4.0": "CC-BY-NC-4.0",
}
#: A table of known digests up to this many rows is broadcast (under 100 bytes each); a larger one is shuffled.
MAX_BROADCAST = 100_000


def canonical_lines(text: Column) -> Column:
    """The canonical text with its line ends kept (a space at each end of a line may be left)."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    for left, right in EQUIVALENT:
        out = F.replace(out, F.lit(left), F.lit(right))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def titled(texts: dict[str, str], titles: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(id, text) of each text, alone and under each of its titles."""
    return [(k, head + text) for k, text in texts.items() for head in ("", *(f"{t}\n" for t in titles.get(k, ())))]


def known_digests(spark: SparkSession, texts: dict[str, str] | DataFrame | None = None, digests: dict[str, str] | None = None) -> DataFrame:
    """(license_digest, license_id), one row a digest. texts: id -> text, or a table (license_id, text);
    digests: digest -> id, besides. Without either: those of this module, with titles."""
    rows = titled(LICENSES, TITLES) if texts is None else [*texts.items()] if isinstance(texts, dict) else []
    more = DIGESTS if texts is None and digests is None else digests or {}
    table = texts if isinstance(texts, DataFrame) else spark.createDataFrame(rows, "license_id string, text string")
    own = narrow(table, license_id="license_id:string", text="text:string").withColumn("canonical", one_line(canonical_lines(F.col("text")))).filter("canonical <> ''")
    found = own.select(digest(F.col("canonical")).alias("license_digest"), "license_id").unionByName(spark.createDataFrame([*more.items()], "license_digest string, license_id string"))
    return found.groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_sha256, license_id (null: the whole text is no known licence) and notices
    (licences that single lines name, each once, sorted, comma-joined)."""
    spark, notices = docs.sparkSession, NOTICES if notices is None else notices
    names = sorted(set(notices.values()))
    own = narrow(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string").select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    own = own.select("doc_id", digest(one_line(F.col("lines"))).alias("canonical_sha256"), F.transform(F.split("lines", "\n"), lambda x: F.trim(x)).alias("each"))
    if notices:  # a parameter, so a bounded literal
        from_lines = spark.createDataFrame([*notices.items()], "text string, license_id string").select(one_line(canonical_lines(F.col("text"))).alias("line"), "license_id")
        forms = {r["line"]: r["license_id"] for r in from_lines.collect()}
        kinds = F.create_map(*(F.lit(x) for pair in forms.items() for x in pair))
        hits = F.array_intersect("each", F.array(*map(F.lit, forms)))
        found = F.array_join(F.sort_array(F.array_distinct(F.transform(hits, lambda x: F.element_at(kinds, x)))), ",")
    else:
        found = F.lit("")
    own = own.select("doc_id", "canonical_sha256", found.alias("notices"))
    small = known.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    right = known.select(F.col("license_digest").alias("canonical_sha256"), "license_id")
    return own.join(F.broadcast(right) if small else right, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id", "notices")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_digests(spark))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(COPYRIGHT_LINE)}, '\\1', 'g')"
    for left, right in EQUIVALENT:
        out = f"replace({out}, {_quoted(left)}, {_quoted(right)})"
    return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def _sql_values(pairs: dict[str, str] | list[tuple[str, str]]) -> str:
    return ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in (pairs.items() if isinstance(pairs, dict) else pairs))


OP2_SQL = f"""
WITH l AS (SELECT * FROM (VALUES {_sql_values(titled(LICENSES, TITLES))}) AS v(license_id, text)),
k AS (SELECT canonical_sha256, min(license_id) AS license_id FROM (
  SELECT sha256(trim(regexp_replace({_sql_lines('text')}, '[ \\n]+', ' ', 'g'))) AS canonical_sha256, license_id FROM l
  UNION ALL VALUES {_sql_values(DIGESTS)}) GROUP BY 1),
n AS (SELECT trim(regexp_replace({_sql_lines('v.line')}, '[ \\n]+', ' ', 'g')) AS line, license FROM (VALUES {_sql_values(NOTICES)}) AS v(line, license)),
d AS (SELECT doc_id, {_sql_lines('text')} AS lines FROM documents),
s AS (SELECT doc_id, trim(unnest(string_split(lines, chr(10)))) AS line FROM d),
f AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM s JOIN n USING (line) GROUP BY doc_id),
c AS (SELECT doc_id, sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'))) AS canonical_sha256 FROM d)
SELECT c.doc_id, c.canonical_sha256, k.license_id, coalesce(f.notices, '') AS notices
FROM c LEFT JOIN k USING (canonical_sha256) LEFT JOIN f ON c.doc_id = f.doc_id
"""
