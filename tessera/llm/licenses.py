"""License scans: canonical digest lookup of entire texts.

A text is canonical once case, copyright lines, list marks, punctuation, white space and equivalent spellings are gone; its
SHA-256 then meets the digests of known licences in a hash join. Only copyright notices depend on where a line begins, and a
line counts as one only with a year, a symbol or a holder, so wrapping a licence in another width leaves its digest as it is.
Everything is DataFrame code.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence matching treats as equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "noncommercial": "non commercial",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "wilfull", "https": "http",
}

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO '
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

#: Short licence texts; whole texts of longer ones are in the folder texts, more come from a table (license, text).
LICENSES = {
    "MIT": "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell '
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission "
    "notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY,
    "ISC": "ISC License\n\nCopyright (c) <year> <holder>\n\n" + _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC,
    "0BSD": "BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\n" + _GRANT + ".\n\n" + _ISC,
    "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) <year>, <holder>\n\n" + _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) <year>, <holder>\n\n" + _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL,
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}

#: Titles that stand above a text or not; the first is the one in LICENSES.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause Simplified License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause New or Revised License", "New BSD License"],
}
#: Wordings that stand for one another, and the line that ends the terms of texts with an appendix.
WORDINGS = {"ISC": ("and/or distribute", "and distribute"), "BSD-3-Clause": ("its contributors may", "contributors may")}
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
#: Spellings of several words.
PHRASES = {"copyright owner": "copyright holder", "copyright owners": "copyright holders", "sub license": "sublicense", "per cent": "percent", "all rights reserved": ""}
#: What follows "copyright" within a sentence, so that a line that begins so names no holder.
FOLLOWS = "notice|notices|holder|holders|owner|owners|law|laws|license|licenses|licence|licences|statement|statements|interest|interests|and|or|in|is|of|on|treaty|treaties|disclaimer"
_BEGIN = r"^[^\p{L}\p{N}\n(©]*"
#: Lower-case lines that are copyright notices: with a year, sign or blank to fill in; or else with a holder.
NOTICE = rf"{_BEGIN}(?:©|(?:copyright|\(c\))[^\n]*\b(?:19|20)[0-9]{{2}}\b|copyright[^\n]*(?:\(c\)|©|<[a-z]|\[[a-z]|\{{[a-z]))"
HOLDER = rf"{_BEGIN}copyright:? +(?:by +)?[\p{{L}}\p{{N}}]"
IN_SENTENCE = rf"{_BEGIN}copyright:? +(?:{FOLLOWS})\b"
#: A list mark, whole between white space.
MARK = r"\(?(?:[0-9]{1,2}|[a-z])[.)]"
_COPYRIGHT = rf"(?m)(?:{NOTICE}|(?!{IN_SENTENCE}){HOLDER})[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines and list marks, letters and digits in single-spaced words, one spelling; null is an empty text."""
    out = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _COPYRIGHT, "")
    out = F.regexp_replace(out, rf"(?<![^\x20\x09-\x0D]){MARK}(?![^\x20\x09-\x0D])", " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))  # two spaces: each word has its own
    for odd, usual in (SPELLINGS | PHRASES).items():
        out = F.replace(out, F.lit(f" {odd.replace(' ', '  ')} "), F.lit(f" {usual.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def texts() -> list[tuple[str, str]]:
    """(license, text) of every built-in text, each with the titles, wordings and ends that it is known with."""
    out = []
    for name, text in LICENSES.items():
        first, *others = TITLES.get(name, [""])
        body = text.removeprefix(first)
        bodies = [body, body.replace(*WORDINGS[name])] if name in WORDINGS else [body]
        out += [(name, title + b) for title in (first, *others, "") for b in bodies]
    for path in sorted((Path(__file__).parent / "texts").glob("*.txt")):
        text = path.read_text("utf-8")
        out.append((path.stem, text))
        if END_OF_TERMS in text:
            out.append((path.stem, text[: text.index(END_OF_TERMS) + len(END_OF_TERMS)]))
    return out


def known(spark: SparkSession, licenses: DataFrame | None = None) -> DataFrame:
    """(digest, license) of the built-in texts and of licenses(license, text); of texts that agree the least name stays."""
    table = spark.createDataFrame(texts(), "license string, text string")
    if licenses is not None:
        table = table.unionByName(licenses.select("license", "text"))
    return table.where(canonical(F.col("text")) != "").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """doc_id, digest and license (null unless the entire text is a known licence) for every row of docs(doc_id, text).

    A licence that is only part of a document, or named in it, is not found. Null text has the digest of the empty text,
    which is no licence. Repeated rows come out repeated, texts may be of any length, of licences with one digest the least
    name is given, other columns are not read, and an empty table gives no rows. The table of digests is joined by hash; Spark
    sends it to the executors only while it is below autoBroadcastJoinThreshold.
    """
    digests = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return digests.join(known(docs.sparkSession, licenses), "digest", "left").select("doc_id", "digest", "license")
