"""Licence texts by canonical digest (DataFrame functions only).

A text is lower-cased, lines of copyright notice go, equivalent spellings become one, what isn't a letter or
digit becomes one space; SHA-256 of the result is looked up, whole, among the digests of known texts.

Null text: no digest, no licence. A text of which nothing is left: the digest of "", no licence.
Repeated rows are judged alike; a digest that a table of licences has twice gives the smallest name.
Empty table: empty result. Other columns are ignored by the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, as in the public licence matching guidelines: fixed values.
SPELLINGS = {"licence": "license", "licenced": "licensed", "sublicence": "sublicense", "merchantibility": "merchantability", "noninfringement": "non infringement", "organisation": "organization", "favour": "favor", "honour": "honor", "programme": "program", "authorisation": "authorization", "modelled": "modeled", "whilst": "while", "per cent": "percent", "copyright owner": "copyright holder"}
_MARK = r"(?:copyright|\(c\)|©)"
#: Words that follow "copyright" in running text, as opposed to a holder's name: fixed values.
RUNNING = "a act all an and any are as assignment at be claim claims disclaimer doctrines for from has have if in information infringement interest interests is it its law laws licence license licensed licenses licensing material may notice notices of on or owner owners ownership holder holders permission protection right rights shall statement statements status such than that this to treaties treaty under unless when where which will with work works you your".split()
#: "copyright" at the start of a line of running text, which canonical() sets apart from the next word by a sign.
WRAPPED = rf"(?m)^([^\p{{L}}\p{{N}}\n]*copyright)[ \t]+((?:{'|'.join(RUNNING)})\b)"
#: A line of notice, lower-cased: marks of copyright with an open place or a year after them, the word with the sign
#: or with a name, or a reservation of rights alone. Lines of wrapped text that merely start with "copyright" are none.
NOTICE = rf"(?m)^[^\p{{L}}\p{{N}}\n]*?(?:(?:{_MARK}[ \t:,]*)+(?:[<\[{{][^\n]*|[^\n]{{0,60}}?(?:1[89]|20)[0-9]{{2}}[^\n]*)|copyright[ \t]*(?:\(c\)|©)[^\n]*|copyright[ \t:]+(?:by[ \t]+)?\p{{L}}[^\n]{{0,100}}|all rights reserved[^\p{{L}}\p{{N}}\n]*)$"
#: Known texts below this size in bytes, all together, are sent to every executor; larger tables are hash-joined.
SENT_BYTES = 8 << 20

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Public licence texts: fixed values.
KNOWN = {
    "MIT": "MIT License\n\nCopyright (c) <year> <holders>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY,
    "MIT-0": "MIT No Attribution\n\nCopyright <year> <holders>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n" + _WARRANTY,
    "ISC": "ISC License\n\nCopyright <year> <holders>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) <year>, <holders>\n\n" + _BSD + _BSD_END,
    "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) <year>, <holders>\n\n" + _BSD + _BSD_3 + _BSD_END,
    "Zlib": "zlib License\n\nCopyright (c) <year> <holders>\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
}
#: Canonical digests of long licence texts: fixed values.
DIGESTS = {
    "Apache-2.0": "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",
    "GFDL-1.3": "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",
}


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    t = F.lower(text)
    t = F.regexp_replace(t, WRAPPED, "$1 -$2")
    t = F.regexp_replace(t, NOTICE, "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for a, b in SPELLINGS.items():
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def known(spark: SparkSession) -> DataFrame:
    """The built-in table: license_id, text; without the title line each has a second form."""
    rows = [(k, v) for k, v in KNOWN.items()] + [(k, v.partition("\n\n")[2]) for k, v in KNOWN.items()]
    return spark.createDataFrame(rows, "license_id string, text string")


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, digest, license_id (null: none known)."""
    table = known(docs.sparkSession) if licenses is None else licenses
    texts = table.select(F.col("license_id").cast("string").alias("license_id"), F.sha2(canonical(F.col("text")), 256).alias("digest")).where(F.col("digest") != F.sha2(F.lit(""), 256))
    if licenses is None:
        texts = texts.unionByName(docs.sparkSession.createDataFrame(list(DIGESTS.items()), "license_id string, digest string"))
    digests = texts.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return rows.join(F.broadcast(digests) if size <= SENT_BYTES else digests, "digest", "left").select("doc_id", "digest", "license_id")
