"""Licence scan by canonical digests (operator 8), DataFrame functions only.

A text is brought to a canonical form: lower case, copyright lines dropped (but not the
wrapped lines of a licence that begin with the word or with item (c)), punctuation
and blanks as single spaces, equivalent spellings as one.  Its SHA-256 is then looked up,
by a hash join, among the digests of known licences.  The digests of its lines are looked up
in the same list, so that a one-line notice inside a document is found too; lines whose
canonical length no known text has are left out, which loses nothing.  The known side is the
list below, so its size is fixed: it is broadcast, and no text moves.

Defined results: null texts count as empty, and no known text is empty; a licence found
on several lines counts once; of a digest that several licences have, all are named, in
order, with commas; texts of any length are read whole; rows that repeat an id, or have none,
each have their own result; an empty table gives no rows; of the caller's columns only id and
text are read, so others may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEXTS

#: Fixed values: (pattern, replacement) in the order they are applied to lower-case text. \\1 is the first group.
RULES = (
    # A wrapped line of a licence that begins with this word is set apart from copyright lines, by a sign that goes later.
    (r"(^|\n)([ \t*/#;-]*copyright([a-z]+|[ \t]*(\n|$)|[ \t,;]+(and|are|disclaimer|doctrines|holders?|if|interests?|in|laws?|licen[cs]es?|notices?|of|on|or|owners?|ownership|permission|rights?|statements?|the (software|library|program|work)|treat(y|ies))\b))", r"\1.\2"),
    (r"(^|\n)[ \t*/#;-]*(copyright|\(c\)[ \t,]*(copyright|©|[12][0-9]{3}\b)|©|all rights reserved)[^\n]*", "\n"),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r" *\n[ \n]*", "\n"),
    (r"licenc", "licens"),
    (r"\bsub licens", "sublicens"),
    (r"isation", "ization"),
    (r"\b(author|organ|recogn|util)is(e|ed|es|ing)\b", r"\1iz\2"),
    (r"\b(behavi|col|fav|hon)our", r"\1or"),
    (r"\b(judg|acknowledg)ement", r"\1ment"),
    (r"\bnon commercial", "noncommercial"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bver(sion|\.)? ([0-9])", r"version \2"),
)

_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Fixed values: (licence, text) of short licences and of one-line notices.
_SHORT = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", _BSD + _WARRANTY_BSD),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _WARRANTY_BSD),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_WARRANTY),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Titles that short licences are published under.
_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License", "MIT-0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "The 2-Clause BSD License", "Simplified BSD License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "The 3-Clause BSD License", "New BSD License", "Revised BSD License", "BSD License", "The BSD License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "Zero Clause BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
}


def _forms() -> list[tuple[str, str]]:
    """The licences in the forms that they are published in: with a title, with bullets for numbers, without the appendix, older addresses."""
    mit, regents = _SHORT[0][1], "the University"
    notice = mit[mit.index(", subject to the following") : mit.index("THE SOFTWARE IS")]
    short = [*_SHORT, ("MIT-0", mit.replace(notice, ".\n"))]
    out = []
    for name, text in short:
        own = [text]
        if name.startswith("BSD") or name == "Zlib":
            own.append(re.sub(r"(?m)^[1-3]\. ", "* ", text))
        if name.startswith("BSD-3"):
            own += [t.replace("the copyright holder nor", f"{other} nor") for t in own for other in (regents, "the author", "the copyright holders")]
        if name in ("ISC", "0BSD"):
            own.append(text.replace("modify, and/or", "modify, and"))
        out += [(name, t) for t in own]
        if len(text) > 300:
            out += [(name, f"{title}\n\n{t}") for title in _TITLES.get(name, ()) for t in own]
    for name, text in TEXTS:
        own = {text, *(text[: at.start()] for at in re.finditer(r"(?m)^ *(How to Apply|APPENDIX: How|Appendix: How|ADDENDUM: How)", text))}
        own |= {t[: t.index("END OF TERMS AND CONDITIONS")] for t in own if "END OF TERMS AND CONDITIONS" in t}
        own |= {t.replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", old).replace("51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA", old) for t in own for old in ("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA")}
        own |= {t.replace("http://", "https://") for t in own}
        own |= {re.sub(r"<?https?://fsf\.org/>?", "<https://fsf.org/>", t) for t in own}
        out += [(name, t) for t in sorted(own)]
    return list(dict.fromkeys(out))


KNOWN = tuple(_forms())


def by_line(text: Column) -> Column:
    """The canonical form with its lines kept apart."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, made in RULES:
        out = F.regexp_replace(out, pattern, made.replace("\\", "$"))
    return F.trim(F.regexp_replace(out, "^\n|\n$", ""))


def entire(lines: Column) -> Column:
    return F.replace(lines, F.lit("\n"), F.lit(" "))


def known(spark: SparkSession, texts=KNOWN) -> list[tuple[str, str, int]]:
    """(digest, licences, length) of the known texts, as many as the list has: a small job, so that plans hold digests and not the texts."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in texts])
    canon = spark.range(1).select(F.inline(rows)).select("license", entire(by_line(F.col("text"))).alias("canon"))
    listed = canon.groupBy(F.sha2("canon", 256).alias("digest"), F.length("canon").alias("length")).agg(F.array_sort(F.collect_set("license")).alias("names"))
    return sorted((r.digest, ",".join(r.names), r.length) for r in listed.collect())


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", texts=KNOWN) -> DataFrame:
    """doc_id, text_digest, license (of the entire text, or null) and notices (licences of single lines, in order of name)."""
    spark = df.sparkSession
    found = known(spark, texts)
    listed = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(names).alias("license")) for d, names, _ in found])))
    by_digest = F.create_map(*[F.lit(x) for d, names, _ in found for x in (d, names)])
    lengths = sorted({n for _, _, n in found})
    canon = df.select(F.col(doc_id).alias("doc_id"), by_line(F.col(text)).alias("lines"))
    possible = F.filter(F.split("lines", "\n"), lambda x: F.length(x).isin(*lengths))
    names = F.array_compact(F.transform(possible, lambda x: F.try_element_at(by_digest, F.sha2(x, 256))))
    notices = F.array_sort(F.array_distinct(F.flatten(F.transform(names, lambda n: F.split(n, ",")))))
    digests = canon.select("doc_id", F.sha2(entire(F.col("lines")), 256).alias("text_digest"), F.array_join(notices, ",").alias("notices"))
    joined = digests.join(F.broadcast(listed), F.col("text_digest") == F.col("digest"), "left")
    return joined.select("doc_id", "text_digest", "license", "notices")


def sql(texts=KNOWN) -> str:
    """The same over table ``documents``, for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    canon = "lower(coalesce(text, ''))"
    for pattern, made in RULES:
        newline = quote(made) if "\n" not in made else "chr(10)"
        canon = f"regexp_replace({canon}, {quote(pattern)}, {newline}, 'g')"
    canon = f"trim(regexp_replace({canon}, {quote(chr(94) + chr(92) + 'n|' + chr(92) + 'n$')}, '', 'g'), ' ')"
    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in texts)
    return f"""
WITH given(license, text) AS (VALUES {values}),
known AS (SELECT DISTINCT license, sha256(replace({canon}, chr(10), ' ')) AS digest FROM given),
named AS (SELECT digest, string_agg(license, ',' ORDER BY license) AS license FROM known GROUP BY digest),
canon AS (SELECT doc_id, {canon} AS lines FROM documents),
hits AS (SELECT DISTINCT l.doc_id, k.license
         FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM canon) l
         JOIN known k ON sha256(l.line) = k.digest),
notices AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM hits GROUP BY doc_id)
SELECT c.doc_id, sha256(replace(lines, chr(10), ' ')) AS text_digest, k.license, coalesce(n.notices, '') AS notices
FROM canon c LEFT JOIN named k ON sha256(replace(lines, chr(10), ' ')) = k.digest LEFT JOIN notices n ON n.doc_id = c.doc_id"""
