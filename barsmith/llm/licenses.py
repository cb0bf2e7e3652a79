"""Licence scans by canonical digest lookup.

A text is made canonical: lower case; copyright lines dropped; every run of what is not a letter or digit, line breaks
among it, made one space; equivalent spellings, whole words or phrases, made one. The MD5 of the whole canonical
text is its digest, and the same is done for each line of it. Digests are hash-joined with those of known licence
texts and notices: a table (digest, license) that :func:`scan` takes, by default the fixed one of this module. Equal
digests mean the entire text (or line) is that licence, not that it mentions one. Lines are joined as digests, and
only those that hit are brought together by row; texts are not shuffled.

The fixed table has the whole texts of the short licences, the digests of the standard texts of the long ones, and
one-line notices. Not in it: MPL-2.0 notices of other versions, EPL, EUPL, CDDL, BSL, CC texts but CC0, and GNU texts
in other layouts than the published ones; :func:`digests` makes a table of any texts.

Only DataFrame functions. Nulls: a null text is the empty text, which no licence is; a null id stays null. Rows that
repeat get the same answer each. Very long texts are folded and hashed whole. The table of known digests must have a digest once: two rows
of one digest give two rows for each text that has it. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.common import table

#: Spellings that mean the same.
SPELLINGS = (("licence", "license"), ("sublicence", "sublicense"), ("licences", "licenses"), ("licenced", "licensed"), ("organisation", "organization"), ("organisations", "organizations"), ("recognise", "recognize"), ("merchantibility", "merchantability"), ("https", "http"), ("version", "v"), ("the software is provided as is", "software provided as is"))
#: A line that says whose the text is; not one that only begins with the word, as lines of wrapped licences do.
COPYRIGHT = r"(^|\n)[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|[0-9]|[<\[{]|:|by )|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"
#: Texts of well-known licences, without copyright lines.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD3 = BSD2.replace("\n\nTHIS SOFTWARE", "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE")
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
WHOLE = (("MIT", MIT), ("ISC", ISC), ("0BSD", ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")), ("BSD-2-Clause", BSD2), ("BSD-3-Clause", BSD3), ("Unlicense", UNLICENSE), ("Zlib", ZLIB))
TITLES = {"MIT": "MIT License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Unlicense": "The Unlicense", "Zlib": "zlib License"}
NOTICES = (
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, v. 2.0."), ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
KNOWN = (*WHOLE, *((name, f"{TITLES[name]}\n\n{text}") for name, text in WHOLE), *NOTICES)
#: Digests of the canonical standard texts of long licences, as their publishers lay them out.
STANDARD = {
    "2557a89e551039e4147eb202a6747479": "Apache-2.0",
    "24ee7e427aab29371ff225dd9ab841a7": "Artistic-1.0-Perl",
    "75ab50d1b17fa1766bf6b4bf801145c3": "CC0-1.0",
    "790b25ae55d8c660dfa1d5eed99c366e": "GFDL-1.2",
    "3b7cb245f916875067b42662ba3e0c9c": "GFDL-1.3",
    "134429ad73318d99a8f6b9d00fc5c17d": "GPL-1.0",
    "ba9c2a2073ffdbb343d789639f206618": "GPL-2.0",
    "eef8e32398f61d5d9207b4b655858052": "GPL-3.0",
    "9acbead8038ae7bbdbb8bfff581ed354": "LGPL-2.0",
    "6ff65381498aed1682bd504d72b1ac29": "LGPL-2.1",
    "fdc10443c5a1e68178d8300ca10bcdc1": "LGPL-3.0",
    "83be7dc04868cd87c8f372cbdf3dc917": "MPL-1.1",
    "80c27efd9a9e033b1a70314bab844ba4": "MPL-2.0",
}


def _replaced(words: Column) -> Column:
    """Spellings made one in words parted by single spaces. Spaces are doubled meanwhile, so that neighbours do not share one."""
    text = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.replace(text, F.lit("  "), F.lit(" ")))


def _without_owner(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), COPYRIGHT, "$1")


def canonical(text: Column) -> Column:
    """The canonical whole text, one line."""
    return _replaced(F.trim(F.regexp_replace(_without_owner(text), r"[^\p{L}\p{N}]+", " ")))


def canonical_lines(text: Column) -> Column:
    """array<string>: each line made canonical; lines may be empty."""
    lines = F.split(F.regexp_replace(_without_owner(text), r"[^\p{L}\p{N}\n]+", " "), "\n")
    return F.transform(lines, lambda x: _replaced(F.trim(x)))


def canonical_text(text: str) -> str:
    """The whole canonical text in plain Python, for the table of known texts."""
    text = re.sub(r"(?:[^\w]|_)+", " ", re.sub(COPYRIGHT, r"\1", text.lower())).strip(" ")
    text = f" {text.replace(' ', '  ')} "
    for old, new in SPELLINGS:
        text = text.replace(f" {old.replace(' ', '  ')} ", f" {new.replace(' ', '  ')} ")
    return text.replace("  ", " ").strip(" ")


def known() -> dict[str, str]:
    """digest -> licence, fixed size."""
    return {hashlib.md5(canonical_text(t).encode()).hexdigest(): name for name, t in KNOWN} | STANDARD


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(known().items()), "digest string, license string")


def _digest(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def digests(texts: DataFrame, *, license: str = "license", text: str = "text") -> DataFrame:
    """(digest, license) of a table of licence texts, to be given to :func:`scan`; of equal texts the smallest name."""
    return texts.where(F.col(text).isNotNull()).groupBy(_digest(canonical(F.col(text))).alias("digest")).agg(F.min(license).alias("license"))


def scan(docs: DataFrame, listed: DataFrame | None = None, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_digest, license, line_licenses, n_license_lines): one row for each row of ``docs``.

    ``license`` is that of the entire text; ``line_licenses`` those of its lines, sorted. ``listed``: (digest, license)
    with one row a digest; a table of any size, as Spark picks the join by its size.
    """
    spark = docs.sparkSession
    known_ = F.broadcast(known_table(spark)) if listed is None else listed.select("digest", "license")  # the module's own table has a fixed size
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumns({"_i": F.xxhash64(F.col("doc_id").isNull(), "doc_id"), "_h": F.xxhash64("t")})
    lines = rows.select("_i", "_h", F.posexplode(canonical_lines(F.col("t"))).alias("_at", "line")).where("line <> ''")
    hits = lines.select("_i", "_h", "_at", _digest(F.col("line")).alias("digest")).join(known_, "digest")
    # rows of one id and text have the same lines, so a line counts once for all of them
    hits = hits.groupBy("_i", "_h").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"), F.count_distinct("_at").alias("n"))
    whole = rows.select("doc_id", "_i", "_h", _digest(canonical(F.col("t"))).alias("text_digest"))
    found = whole.join(known_.withColumnRenamed("digest", "text_digest"), "text_digest", "left").join(hits, ["_i", "_h"], "left")
    return found.select("doc_id", "text_digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_license_lines"))


def op2_licenses(spark, sf_dir):
    """All ``documents`` against the known texts and notices."""
    return scan(table(spark, sf_dir, "documents"))


def planted() -> list[str]:
    """Licence texts in other guises: with an owner, in capitals, wrapped anew, as a comment."""
    out = []
    for k, (name, text) in enumerate(WHOLE):
        words = text.split(" ")
        wrapped = "\n".join(" ".join(words[i : i + 9 + k]) for i in range(0, len(words), 9 + k))
        comment = "\n".join("# " + line for line in wrapped.split("\n"))
        out += [f"{TITLES[name]}\n\nCopyright (c) 2021 Someone\n\n{wrapped}", re.sub(r"\bLICENSE", "LICENCE", text.upper()), comment]
    return out


def licenses_planted(spark, sf_dir):
    """All ``documents``, every seventh of which is put in the place of a licence text in one of the guises of :func:`planted`."""
    guises = F.array(*map(F.lit, planted()))
    at = (F.pmod(F.floor(F.col("doc_id") / 7), F.lit(len(planted()))) + 1).cast("int")
    return scan(table(spark, sf_dir, "documents").withColumn("text", F.when(F.pmod("doc_id", F.lit(7)) == 3, F.element_at(guises, at)).otherwise(F.col("text"))))


def _sql(text: str) -> str:
    """Words of single spaces with spellings made one."""
    text = f"(' ' || replace({text}, ' ', '  ') || ' ')"
    for old, new in SPELLINGS:
        text = f"replace({text}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"trim(replace({text}, '  ', ' '), ' ')"


def _oracle(documents: str) -> str:
    return f"""
with k(digest, license) as (values {", ".join(f"('{d}', '{n}')" for d, n in known().items())}),
i as ({documents}),
c as (select row_number() over () as r, doc_id, regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT}', '\\1', 'g') as t from i),
d as (select r, doc_id, t, md5({_sql("trim(regexp_replace(t, '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')")}) as text_digest from c),
l as (select r, unnest(string_split(t, chr(10))) as line from d),
n as (select r, {_sql("trim(regexp_replace(line, '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')")} as line from l),
m as (select n.r, string_agg(distinct k.license, ',' order by k.license) as line_licenses, count(*) as n from n join k on k.digest = md5(n.line) where n.line <> '' group by n.r)
select d.doc_id, d.text_digest, k.license, coalesce(m.line_licenses, '') as line_licenses, coalesce(m.n, 0) as n_license_lines
from d left join k on k.digest = d.text_digest left join m on m.r = d.r
"""


ORACLE = _oracle("select doc_id, text from documents")
_GUISES = "[" + ", ".join("'" + g.replace("'", "''") + "'" for g in planted()) + "]"
PLANTED_ORACLE = _oracle(f"select doc_id, case when doc_id % 7 = 3 then ({_GUISES})[cast(doc_id // 7 % {len(planted())} as int) + 1] else text end as text from documents")
