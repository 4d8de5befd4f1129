"""Licence scan by canonical digests: whole texts that are a known licence.

A text is lowered, freed of copyright statements and of punctuation, equivalent spellings are
made one, and its SHA-256 is joined to the digests of known licences, made by the same
expressions. Nothing is compared beyond the digest.

Defined results: a null or empty text, and one of copyright lines alone, has no digest and no licence;
where two known texts have one digest the first name counts; repeated rows are joined each. Only
DataFrame functions are used. ``ORACLE`` holds ``KNOWN`` and drops whole copyright lines; it agrees on texts
without the word copyright and without one of the further licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.scratch import without

#: Spellings that count as the same, after case and punctuation are gone.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("while", "whilst"),
    ("wilful", "willful"),
]

#: Known licences and notices as whole texts.
KNOWN = [
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-notice", "Released under the MIT License."),
]

#: The patterns of both engines, on lowered text.
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: Copyright statements alone. One that a licence follows in the same line ends where
#: that begins; a line of the terms that begins with the word, as "copyright notice", is none.
OPENING = r"(?:permission is hereby granted|permission to use|redistribution and use|this software is provided|everyone is permitted|licensed under|released under|this work is licensed)"
STATEMENT = r"(?:copyright[ \t]*(?:\(c\)|©|\d{4})|\(c\)[ \t]*\d{4}|©)[^\n]{0,300}?(?=\b" + OPENING + r"\b)"
TERMS = r"(?:notices?|holders?|owners?|licen[sc]es?|laws?|treat(?:y|ies)|interests?|rights?|statements?|disclaimers?|protection|permission|status|control|and|or|in|on|is|of|to|for|the (?:software|library))\b"
STATEMENT_LINE = r"(?m)^[ \t]*(copyright(?![ \t]+" + TERMS + r")|\(c\)(?=[ \t]*(?:copyright|©|\d|\[y|$))|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The words that count, each between spaces of its own; null where there is none."""
    t = F.lower(F.replace(text, F.lit("\r"), F.lit("")))
    stated = F.regexp_replace(F.regexp_replace(t, STATEMENT, " "), STATEMENT_LINE, "")
    t = F.when(t.contains("copyright") | t.contains("©") | t.contains("(c)"), stated).otherwise(F.regexp_replace(t, COPYRIGHT_LINE, ""))
    t = F.concat(F.lit("  "), F.regexp_replace(t, NOT_WORD, "  "), F.lit("  "))
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    t = F.trim(F.regexp_replace(t, " +", " "))
    return F.when(t != "", t)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


#: Texts of a known list, at most: the side that is broadcast.
MOST = 100_000


def table_of(spark: SparkSession, path: str) -> DataFrame:
    """A known list (license, text) kept as a Parquet table."""
    return spark.read.parquet(path).select("license", "text")


def known(docs: DataFrame, licences: list[tuple[str, str]] | DataFrame, most: int = MOST) -> DataFrame:
    """(digest, license): one row for each digest. ValueError beyond ``most`` texts."""
    if isinstance(licences, DataFrame):
        if licences.count() > most:
            raise ValueError(f"a list of more than {most} texts")
        table = licences
    else:
        rows = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in licences])
        table = docs.sparkSession.range(1).select(F.inline(rows))
    return table.select(digest(F.col("text")).alias("digest"), "license").where("digest IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licences: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """``docs`` with digest and license (null: not a known one), by default of ``licence_list``; a DataFrame
    (license, text) takes its place. The known list is counted before it is broadcast."""
    from vectide.llm.licence_list import listed

    own = docs.select(*without(docs.columns, "digest", "license"))
    return own.withColumn("digest", digest(F.col("text"))).join(F.broadcast(known(docs, listed() if licences is None else licences)), "digest", "left")


def query(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "digest", "license")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql(text: str) -> str:
    t = f"regexp_replace(lower(replace({text}, chr(13), '')), {_quoted(COPYRIGHT_LINE)}, '', 'g')"
    t = f"'  ' || regexp_replace({t}, {_quoted(NOT_WORD)}, '  ', 'g') || '  '"
    for a, b in EQUIVALENT:
        t = f"replace({t}, {_quoted(' ' + a.replace(' ', '  ') + ' ')}, {_quoted(' ' + b.replace(' ', '  ') + ' ')})"
    return f"nullif(trim(regexp_replace({t}, ' +', ' ', 'g')), '')"


ORACLE = f"""
WITH known AS (
  SELECT sha256({_sql('text')}) AS digest, min(license) AS license
  FROM (VALUES {', '.join(f'({_quoted(n)}, {_quoted(t)})' for n, t in KNOWN)}) AS v(license, text) GROUP BY 1
)
SELECT d.doc_id, d.digest, k.license
FROM (SELECT doc_id, sha256({_sql('text')}) AS digest FROM documents) d LEFT JOIN known k ON d.digest = k.digest
"""
