"""Licence texts by canonical digest, with DataFrame functions only.

A text is normalised (case, copyright lines, punctuation and white space, equivalent spellings), and the digest of the whole
normalised text is joined to the digests of known licences, which are normalised in the same way. So a document matches that
is a licence and nothing else, however it is wrapped, punctuated or spelt, and whoever holds the copyright.

The known licences are a table (license_id, text) and may be any; `KNOWN` has short public ones, the folder license_texts longer
ones, and `variants` gives each with and without its title, its appendix and unfilled notices. They are broadcast where they are few; a document that repeats matches each time; two ids with one canonical text give the smaller id.

Defined cases: null and empty texts, and texts without a word after normalisation, match nothing and have a null digest;
repeated rows agree; an empty table gives an empty result; other columns stay, those named like new ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import foreign_kept, join_checked, written

#: Spellings that mean the same, in the order in which they are replaced (after lower-casing, between spaces).
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"),
    ("catalogue", "catalog"), ("centre", "center"), ("colour", "color"), ("favour", "favor"), ("fulfil", "fulfill"), ("judgement", "judgment"),
    ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("organisation", "organization"), ("per cent", "percent"),
    ("programme", "program"), ("recognised", "recognized"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("http", "https"),
)
#: The beginnings of lines that only say whose a text is.
NOTICE = r"(?m)^[^\p{L}\n]*(?:copyright(?:ed)?\b[^\n]*(?:\d{4}|\(c\)|©|\[year\]|<year>)[^\n]*|\(c\)[^\n]*|©[^\n]*|all rights reserved\.?)[^\n]*$"
#: Short public licence texts.
KNOWN = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: The title lines that are usual above a text which is kept without one.
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "BSD License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"),
    "BSL-1.0": ("Boost Software License 1.0",),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "(The MIT License)"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng license"),
}
#: Where a kept text's own title ends and, for those with one, what comes before its appendix.
FIRST = {
    "Apache-2.0": ("TERMS AND CONDITIONS FOR USE", "1. Definitions."), "BSL-1.0": ("Permission is hereby granted",), "CC0-1.0": ("CC0 1.0 Universal", "Statement of Purpose"), "MPL-2.0": ("1. Definitions",),
    "GPL-1.0": ("Preamble",), "GPL-2.0": ("Preamble",), "GPL-3.0": ("Preamble",), "LGPL-2.0": ("Preamble",), "LGPL-2.1": ("Preamble",), "LGPL-3.0": ("This version of the GNU Lesser",),
}
END = "END OF TERMS AND CONDITIONS"
UNFILLED = re.compile(r"(?mi)^.*copyright (?:\(c\) )?[\[{<]y[^\n]*$")


def variants() -> list[tuple[str, str]]:
    """(license_id, text) of the known licences with their usual beginnings and ends; a repeated text is harmless."""
    texts = KNOWN | {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    out = []
    for name, text in sorted(texts.items()):
        starts = [text, *[f"{t}\n\n{text}" for t in TITLES.get(name, ())], *[text[text.index(f) :] for f in FIRST.get(name, ())]]
        if name == "ISC" or name == "0BSD":
            starts += [t.replace("modify, and/or distribute", "modify, and distribute") for t in starts]
        ends = [e for t in starts for e in ((t, t[: t.index(END)], t[: t.index(END) + len(END)]) if END in t else (t,))]
        out += [(name, e) for t in ends for e in dict.fromkeys((t, UNFILLED.sub("", t)))]
    return out


def canonical(text: Column) -> Column:
    """The normalised text: words with single spaces between and around them; empty where there are none."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, NOTICE, " ")
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    t = F.regexp_replace(t, " +", " ")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def canonical_digest(text: Column) -> Column:
    t = canonical(text)
    return F.when(t != "", F.sha2(t, 256))


def known_digests() -> list[tuple[str, str]]:
    """(canonical digest, license_id) of the known texts, made without Spark; of a text of several licences the first."""
    import regex  # for classes of Unicode

    out: dict[str, str] = {}
    for name, text in variants():
        t = regex.sub(r"[^\p{L}\p{N}]+", " ", regex.sub(NOTICE, " ", text.lower()))
        t = re.sub(" +", " ", f" {t} ")
        for a, b in SPELLINGS:
            t = t.replace(f" {a} ", f" {b} ")
        d = hashlib.sha256(t.strip().encode()).hexdigest()
        out[d] = min(name, out.get(d, name))
    return sorted(out.items())


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(variants(), "license_id string, text string")


@foreign_kept
def scan(docs: DataFrame, licenses: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """docs with canonical_sha256, license_id (null: none) and is_license."""
    spark = docs.sparkSession
    known = (known_licenses(spark) if licenses is None else licenses).select("license_id", canonical_digest(F.col("text")).alias("__digest"))
    known = written(known.where("__digest is not null").groupBy("__digest").agg(F.min("license_id").alias("__license")), "licenses")
    keep = [c for c in docs.columns if c not in ("canonical_sha256", "license_id", "is_license")]
    keyed = docs.select(*keep, canonical_digest(F.col(text_col)).alias("canonical_sha256"))
    out = join_checked(keyed, known, F.col("canonical_sha256") == F.col("__digest"), "left")
    return out.select(*keep, "canonical_sha256", F.col("__license").alias("license_id"), F.col("__license").isNotNull().alias("is_license"))
