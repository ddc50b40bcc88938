"""Licence scans by canonical digest lookup."""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as the same word in a licence, as (written, canonical).
EQUIVALENT_SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("optimise", "optimize"), ("organisation", "organization"), ("owner", "holder"), ("owners", "holders"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]

#: Licence notices and short licences by identifier.
KNOWN_LICENSES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    (
        "MIT",
        "MIT License\n\nCopyright (c) <year> <copyright holders>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
]

#: Title lines that whole texts are published under, by identifier; "" stands for none.
TITLES = {
    "MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["", "ISC License", "The ISC License"],
    "BSD-2-Clause": ["", "BSD 2-Clause License", "The 2-Clause BSD License"], "BSD-3-Clause": ["", "BSD 3-Clause License", "The 3-Clause BSD License"], "Zlib": ["", "zlib License", "The zlib License"],
    "0BSD": ["", "BSD Zero Clause License", "Zero-Clause BSD"], "BSL-1.0": ["", "Boost Software License 1.0"],
}


def whole_texts() -> list[tuple[str, str]]:
    """Whole licences by identifier, as published: with and without title, end-of-licence appendix and bullets for numbers."""
    folder = files("fieldtrace.llm") / "license_texts"
    found = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in folder.iterdir() if f.name.endswith(".txt")]
    found += [(i, re.sub(r"^MIT License\n+", "", t)) for i, t in KNOWN_LICENSES if i in ("MIT", "ISC") and len(t) > 500]
    out = []
    for i, text in sorted(found):
        bodies = [text]
        if "END OF TERMS AND CONDITIONS" in text:
            bodies += [text[: text.index("END OF TERMS AND CONDITIONS")], text[: text.index("END OF TERMS AND CONDITIONS") + 27]]
        if i.startswith("BSD"):
            bodies += [re.sub(r"(?m)^[123]\. ", "* ", t) for t in bodies]
            bodies += ["All rights reserved.\n" + t for t in bodies]
        out += [(i, f"{title}\n\n{body}") for title in TITLES.get(i, [""]) for body in bodies]
    return out


#: Words after "copyright" or "(c)" at the start of a line by which it is a sentence of a licence, not a notice of a work.
_PROSE = "and|or|in|of|on|to|if|is|are|as|by|for|from|under|that|which|with|within|this|these|you|your|any|all|such|must|may|shall|not|no|notices?|holders?|owners?|owned|laws?|licen[cs]es?|licensed|interests?|rights?|statements?|disclaimers?|protection|permission|claims?|treaty|treaties|ownership|status"
#: A line that begins with "copyright", "(c)" or the sign, and a year, sign or holder after it; what it says differs with each work.
COPYRIGHT_LINE = rf"(^|\n)[ \t]*((copyright(?!ed\b|able\b|s\b)|\(c\))(?![.;)])(?![ \t]*(\n|$))(?![ \t,]+({_PROSE})\b)|©)[^\n]*"
#: Control characters but the line feed, space and ASCII punctuation, the typographic quotes and dashes, the fixed space.
PUNCTUATION = "".join(chr(c) for c in range(1, 128) if c != 10 and not chr(c).isalnum()) + "“”‘’–—\xa0"


def plain(low: Column) -> Column:
    """Lower-case text without copyright lines and punctuation: words parted by one space, lines by line feeds."""
    cited = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©"))
    x = F.when(cited, F.regexp_replace(low, COPYRIGHT_LINE, "$1")).otherwise(low)
    return F.regexp_replace(F.translate(x, PUNCTUATION, " " * len(PUNCTUATION)), " {2,}", " ")


def one_line(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(x, F.lit("\n"), F.lit(" ")), " {2,}", " "))


def n_words(x: Column) -> Column:
    """Words of a text that has one space between words."""
    return F.size(F.split(x, " "))


def spelled(x: Column) -> Column:
    """Equivalent spellings made one; each replaces a word by a word, so counts of words stay."""
    x = F.concat(F.lit(" "), F.replace(x, F.lit(" "), F.lit("  ")), F.lit(" "))
    for written, same in EQUIVALENT_SPELLINGS:
        x = F.replace(x, F.lit(f" {written} "), F.lit(f" {same} "))
    return F.trim(F.replace(x, F.lit("  "), F.lit(" ")))


def digest(unit: Column) -> Column:
    return F.sha2(spelled(unit), 256)


def known_digests(spark: SparkSession, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digest, license_id, n_words`` of known licence texts; of texts with one digest the first identifier counts."""
    rows = spark.createDataFrame(licenses or KNOWN_LICENSES + whole_texts(), "license_id string, license_text string")
    unit = one_line(plain(F.lower("license_text")))
    return rows.select(digest(unit).alias("digest"), "license_id", n_words(unit).alias("n_words")).groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("n_words").alias("n_words"))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Licences that are the entire text, or an entire line, of a document.

    ``docs`` has ``doc_id, text``; other columns are ignored. ``known`` has ``digest, license_id, n_words``: a
    registry whose size does not depend on the documents. One row per doc_id: ``doc_id, text_license`` (null if the
    entire text is no known licence) and ``line_licenses`` (identifiers found as entire lines, sorted, comma between;
    '' if none). Null and empty texts have no licence. An empty table gives an empty table; rows that share a doc_id
    count as one document. Only texts and lines with as many words as a known licence are spelled and digested: no
    other can have its digest.
    """
    sizes = [r["n_words"] for r in known.select("n_words").distinct().collect()]  # a handful, whatever the documents
    # explode() of one value keeps the text from being computed once for each use
    low = docs.select("doc_id", F.explode(F.array(F.lower(F.coalesce("text", F.lit(""))))).alias("low"))
    text = low.select("doc_id", F.explode(F.array(plain(F.col("low")))).alias("x"))
    lines = F.transform(F.array_distinct(F.split("x", "\n")), lambda x: F.struct(F.lit(False).alias("whole"), F.trim(x).alias("unit")))
    whole = F.array(F.struct(F.lit(True).alias("whole"), one_line(F.col("x")).alias("unit")))
    units = text.select("doc_id", F.explode_outer(F.filter(F.concat(whole, lines), lambda u: n_words(u["unit"]).isin(sizes))).alias("u"))
    units = units.select("doc_id", "u.whole", F.when(F.col("u").isNotNull(), digest(F.col("u.unit"))).alias("digest"))
    return (
        units.join(F.broadcast(known.drop("n_words")), "digest", "left").groupBy("doc_id")
        .agg(F.min(F.when(F.col("whole"), F.col("license_id"))).alias("text_license"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id"))))).alias("line_licenses"))
    )
