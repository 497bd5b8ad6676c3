"""License scans by canonical digest lookup, DataFrame functions only.

A text is normalised (case, copyright lines, punctuation and white space, equivalent spellings) and
its digest is looked up among the digests of known license texts and notices. Both whole documents
and every single line of a document, each as an entire text, are looked up. The known texts pass
through the same expression, so that any change of a rule holds for both sides; they are a fixed list
in this file, broadcast, and no text is compared other than by digest. Long texts are kept as digests only
(``license_table``); these and the notices built from names and identifiers are not in the SQL.

Defined cases: a null or empty text has the digest of the empty text, which no license has; null ids
and repeated rows are rows of their own (rows with equal id and text get equal results); ties between
several notices are reported together, sorted; an empty table gives an empty result; only doc_id and
text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, text_of
from .license_table import DIGESTS, IDENTIFIERS

# Spellings that count as the same word (left becomes right), whole words only.
EQUIVALENT = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licensor s", "licensors"),
    ("sub license", "sublicense"), ("sub licence", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("copyright owner", "copyright holder"), ("emphasised", "emphasized"), ("favor", "favour"), ("fulfil", "fulfill"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelled", "labeled"), ("merchantability", "merchantability"),
    ("modelled", "modeled"), ("noninfringement", "non infringement"), ("organisation", "organization"),
    ("organised", "organized"), ("owner", "holder"), ("per cent", "percent"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]

WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution.\n\n")
MIT_TERMS = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software.\n\n")
ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.")

# Known license texts and notices, as (SPDX id, text).
KNOWN = [
    ("MIT", MIT_TERMS + WARRANTY),
    ("MIT", "MIT License\n\n" + MIT_TERMS + WARRANTY),
    ("MIT", "The MIT License (MIT)\n\n" + MIT_TERMS + WARRANTY),
    ("BSD-2-Clause", BSD_TERMS + BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_TERMS + BSD_WARRANTY),
    ("BSD-3-Clause", BSD_TERMS + "3. Neither the name of the copyright holder nor the names of its contributors may be used "
     "to endorse or promote products derived from this software without specific prior written permission.\n\n" + BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_TERMS + "3. Neither the name of the copyright holder nor the names of "
     "its contributors may be used to endorse or promote products derived from this software without specific prior written "
     "permission.\n\n" + BSD_WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + ISC_WARRANTY),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without "
     "fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
     + ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted.\n\n" + ISC_WARRANTY),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
     "held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this "
     "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
     "the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you "
     "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
     "would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not "
     "be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source "
     "distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n"
     'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an '
     '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
     "specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

# Names of licenses, and the sentences of a one-line notice.
NAMES = [
    ("MIT", ["MIT License", "MIT"]), ("ISC", ["ISC License"]), ("0BSD", ["Zero-Clause BSD License", "0BSD License"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"]),
    ("Zlib", ["zlib License"]), ("Unlicense", ["Unlicense"]), ("WTFPL", ["WTFPL"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0"]),
    ("BSL-1.0", ["Boost Software License, Version 1.0", "Boost Software License 1.0"]),
    ("CC0-1.0", ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"]),
    *((f"{short}-{v}", [f"{name}, version {v}", f"{name} {v}", f"{name} v{v}", f"{short} {v}"]) for short, name, v in (
        ("MPL", "Mozilla Public License", "1.1"), ("MPL", "Mozilla Public License", "2.0"),
        ("EPL", "Eclipse Public License", "1.0"), ("EPL", "Eclipse Public License", "2.0"))),
    *((f"{short}-{v if '.' in v else v + '.0'}{end}", [f"{name}{at}{later}" for name, at in (
        (f"GNU {kind} Public License", f", version {v}"), (f"GNU {kind} Public License", f" v{v}"), (f"GNU {short}", f" v{v}"),
        (f"GNU {short}", f", version {v}"), (short, f" version {v}"), (short, f" v{v}"), (short, f"v{v}"))
        for later in (("",) if not end else (" or later", " or any later version", ", or (at your option) any later version"))])
      for short, kind, versions in (("GPL", "General", ("1", "2", "2.0", "3", "3.0")), ("LGPL", "Lesser General", ("2.1", "3", "3.0")),
                                    ("LGPL", "Library General", ("2", "2.0")), ("AGPL", "Affero General", ("3", "3.0")))
      for v in versions for end in ("", "-or-later")),
    *((f"CC-{kind}-{v}", [f"CC {kind} {v}", f"Creative Commons {name} {v} {place} License"]) for kind, name in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
        ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
        ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v, place in (("3.0", "Unported"), ("4.0", "International"))),
]
SENTENCES = [f"{start} under {the}" for start in (
    "Licensed", "Released", "Distributed", "Available", *(f"This {thing} is licensed" for thing in (
        "work", "project", "software", "program", "library", "file", "document"))) for the in ("", "the ")]

COPYRIGHT = r"(?m)^[ \t#*/;%-]*(?:(?:copyright|\(c\)|©)[^\n]*(?:\(c\)|©|[0-9]{4}|<year>|\[yyyy\])[^\n]*|all rights reserved\.?[ \t]*)$"
BREAKS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The normalised text: words of letters and digits with one space around each."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, " "), BREAKS, " ")
    out = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(docs: DataFrame) -> DataFrame:
    """license and digest of the known texts: a fixed, small table."""
    spark = docs.sparkSession
    lines = [(name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS.split()] + [
        (name, f"{start}{spelling}") for name, spellings in NAMES for spelling in spellings for start in SENTENCES]
    texts = [(at, *row) for at, row in enumerate([*KNOWN, *lines])]
    rows = spark.createDataFrame(texts, "_at int, license string, _known string").select(
        "_at", "license", digest(F.col("_known")).alias("_digest"))
    stored = spark.createDataFrame([(len(texts), *line.split()) for line in DIGESTS.split("\n") if line],
                                   rows.schema)
    # one license a digest: the texts of KNOWN come first
    return F.broadcast(store(rows.unionByName(stored).groupBy("_digest").agg(F.min_by("license", "_at").alias("license"))
                             .select("license", "_digest"), "license-digests"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_digest, whole_license, notices (sorted, comma-separated) and n_notices of every row."""
    texts = docs.select("doc_id", text_of().alias("_text"))
    found = known(docs)
    key = F.md5(F.col("_text").cast("binary"))
    lines = texts.select("doc_id", key.alias("_key"), F.explode(F.split("_text", "\n")).alias("_line")).select(
        "doc_id", "_key", digest(F.col("_line")).alias("_digest"))
    notices = lines.join(found, "_digest").groupBy("doc_id", "_key", "license").agg(F.count("*").alias("_n")).groupBy(
        F.col("doc_id").alias("_id"), F.col("_key").alias("_text_key")).agg(
        F.array_join(F.sort_array(F.collect_list("license")), ",").alias("notices"), F.sum("_n").alias("_n"))
    repeats = texts.select("doc_id", key.alias("_key")).groupBy("doc_id", "_key").agg(F.count("*").alias("_rows"))
    counted = notices.join(repeats, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_text_key") == F.col("_key"))).select(
        "_id", "_text_key", "notices", (F.col("_n") / F.col("_rows")).cast("long").alias("_n"))
    rows = texts.select("doc_id", key.alias("_key"), digest(F.col("_text")).alias("text_digest"))
    whole = rows.join(found.withColumnsRenamed({"license": "whole_license", "_digest": "text_digest"}), "text_digest", "left")
    return whole.join(counted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text_key")), "left").select(
        "doc_id", "text_digest", "whole_license", F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_notices"))


def oracle_sql() -> str:
    """The same scan in SQL."""
    def normal(x: str) -> str:
        out = (f"' ' || trim(regexp_replace(regexp_replace(lower({x}), '{COPYRIGHT}', ' ', 'g'), '{BREAKS}', ' ', 'g')) || ' '")
        for old, new in EQUIVALENT:
            out = f"replace({out}, ' {old} ', ' {new} ')"
        return f"sha256({out})"

    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT license, {normal('t')} AS d FROM (VALUES {values}) v(license, t)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT r, {normal('l')} AS d FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM docs)),
hits AS (SELECT r, string_agg(license, ',' ORDER BY license) AS notices, sum(n) AS n
         FROM (SELECT r, license, count(*) AS n FROM lines JOIN known USING (d) GROUP BY r, license) GROUP BY r),
whole AS (SELECT r, doc_id, {normal('t')} AS d FROM docs)
SELECT w.doc_id, w.d AS text_digest, k.license AS whole_license, coalesce(h.notices, '') AS notices,
       CAST(coalesce(h.n, 0) AS BIGINT) AS n_notices
FROM whole w LEFT JOIN known k ON k.d = w.d LEFT JOIN hits h ON h.r = w.r
"""
