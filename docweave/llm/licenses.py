"""Licence scan: digests of canonical texts, met in a hash join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that licence texts spell in two ways, as pairs from, to.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("favour", "favor"), ("organisation", "organization"),
    ("authorise", "authorize"), ("authorised", "authorized"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("per cent", "percent"), ("whilst", "while"), ("judgement", "judgment"), ("fulfil", "fulfill"),
]

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_DENIAL = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_DENIAL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_DENIAL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Texts of known licences, by SPDX identifier; add rows to the table for more.
LICENSES = {
    "MIT": f"MIT License\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_DENIAL}",
    "MIT-0": f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_MIT_DENIAL}",
    "BSD-2-Clause": f"{_BSD_HEAD}\n\n{_BSD_DENIAL}",
    "BSD-3-Clause": f"{_BSD_HEAD}\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD_DENIAL}",
    "ISC": f"ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_DENIAL}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_DENIAL}",
    "Zlib": """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}


_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to"""

#: Titles that these texts are found under; each is known without a title too.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"],
    "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "Zlib": ["zlib License", "The zlib License"],
    "Unlicense": ["The Unlicense"],
}
#: Texts beside LICENSES.
MORE = {"Unlicense": f"{_UNLICENSE} <https://unlicense.org/>"}
#: Digests of canonical() of whole texts, with and without their titles.
DIGESTS = [
    ("Apache-2.0", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),
    ("Apache-2.0", "deb545743ba2ee484c58a92230d43f8b6a39185ee86d9256ffdfefdb82b1dc6d"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("Artistic-1.0-Perl", "09298ea5f55a44867296b42e98842579815a99e2b295c0aa24cf234134c9ebeb"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("CC0-1.0", "13a06619caac563ef75dbb6b16c7b185cd8a7255a4c7134aecf15ed03eeb0b9e"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.2", "aa8e67692652aa0ece49069f2f9dffde6690debb563e627bab22508062ff269c"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GFDL-1.3", "5b967c12b95f7d93d6f6004b6a40e177bcc0e67173d4cd222531f389cda0d765"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "4a0d740eb4453dafe0e6d04e2d2e4f04c7c85bc1fbef96bc056ea93e7c1c36bc"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "c50bb15c5f5e96b27d60ee792a7db1637c2e416eb98869999aab5af68506cd64"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "aa06ce7f6e464e73e65ec0efa0bc575ef5bb7059ae0137ab610c2e57b32ca95c"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("LGPL-3.0", "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-1.1", "3a6a0fe0030e6e755a04923126594a93aa582cc0213fe0e705392a915b23ee31"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("MPL-2.0", "c0f855aacb6ac1c86bcdd1334db61014d14898798ae14888fea5446cbb9d32e3"),
]


def _variants() -> list[tuple[str, str]]:
    """Each built-in text as it stands, without its title and under each of its titles."""
    out = []
    for k, text in (LICENSES | MORE).items():
        bare = next((text[len(t) :] for t in TITLES.get(k, ()) if text.startswith(t + "\n")), text)
        out += [(k, text), (k, bare), *((k, f"{t}\n\n{bare}") for t in TITLES.get(k, ()))]
    return out + [(k, t.replace("<https://unlicense", "<http://unlicense")) for k, t in out if k == "Unlicense"]


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words of ASCII letters and digits only, one spelling each.

    A copyright line begins, after comment marks, with "copyright" or a copyright sign and
    holds a year or sign; lines of "all rights reserved" alone go too.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"(?m)^[ \t*#/;%-]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©)[^\n]*$", " ")
    t = F.regexp_replace(t, r"(?m)^[ \t*#/;%-]*all rights reserved\.?[ \t]*$", " ")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " ")), F.lit(" "))
    # Twice: of two adjacent words, the blank between them serves one at a time.
    t = reduce(lambda c, p: F.replace(c, F.lit(f" {p[0]} "), F.lit(f" {p[1]} ")), [q for p in SPELLINGS for q in (p, p)], t)
    return F.trim(t)


def license_table(spark: SparkSession) -> DataFrame:
    """license_id, text of the known licences."""
    return spark.createDataFrame(_variants(), "license_id string, text string")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """The licence whose text a whole document is, up to canonical().

    Returns one row per row of ``docs``: doc_id, digest (SHA-256 of the canonical text) and
    license_id, null where no licence has that digest. ``known`` has license_id and text; of
    licences that share a digest, the first by name counts. Only digests are joined; Spark
    broadcasts the licences when they are small and shuffles on the digest when not.

    Null text counts as empty; a text without letters or digits has no licence, even if a
    known text is empty too. Repeated rows give repeated rows, an empty table an empty result.
    """
    spark = docs.sparkSession
    texts = known if known is not None else license_table(spark)
    table = texts.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("d"), canonical(F.col("text")).alias("c")).filter("c <> ''").select("license_id", "d")
    if known is None:
        table = table.unionByName(spark.createDataFrame(DIGESTS, "license_id string, d string"))
    table = table.groupBy("d").agg(F.min("license_id").alias("license_id"))
    seen = docs.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    return seen.join(table, F.col("digest") == F.col("d"), "left").select("doc_id", "digest", "license_id")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, digest and license_id of every document, as scan_licenses() defines them."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_canonical(text: str) -> str:
    """The same steps for DuckDB."""
    t = f"lower(coalesce({text}, ''))"
    t = rf"regexp_replace({t}, '(?m)^[ \t*#/;%-]*(copyright|\(c\)|©)[^\n]*([0-9]{{4}}|\(c\)|©)[^\n]*$', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?m)^[ \t*#/;%-]*all rights reserved\.?[ \t]*$', ' ', 'g')"
    t = f"' ' || trim(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g')) || ' '"
    for a, b in [q for p in SPELLINGS for q in (p, p)]:
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return f"trim({t})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The rows of the operator's own table, texts and digests.
OP4_SQL = f"""
WITH known(license_id, text) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in _variants())}),
whole(license_id, d) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(d)})" for k, d in DIGESTS)}),
every AS (SELECT license_id, sha256(c) AS d FROM (SELECT license_id, {_sql_canonical("text")} AS c FROM known) WHERE c <> '' UNION ALL FROM whole),
digests AS (SELECT min(license_id) AS license_id, d FROM every GROUP BY d)
SELECT doc_id, digest, license_id FROM (SELECT doc_id, sha256({_sql_canonical("text")}) AS digest FROM documents) LEFT JOIN digests ON digest = d
"""
