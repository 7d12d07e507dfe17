"""License scans: the digest of a text's canonical form, joined with the digests of known licence texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as the same word.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "noncommercial": "non-commercial", "percent": "per cent", "owner": "holder", "owners": "holders", "http": "https",
}
SPELLINGS = {a: b.replace("-", " ") for a, b in SPELLINGS.items()}
# Punctuation beyond ASCII that counts as a space.
PUNCTUATION = " ©«®·»‐‑‒–—―‘’“”„•…™"

# Words after "copyright" where a licence's own sentence was wrapped, and no holder is named.
SENTENCE = "holders?|owners?|notices?|licen[cs]es?|laws?|interests?|statements?|disclaimers?|acts?|treaty|status|protection|and|or|in|on|of|to|the|for|by law|is|are|permission"
_WHO = rf"copyright(?![ \t:]+(?:{SENTENCE})\b)[ \t:(]|©|all rights reserved"
_COPYRIGHT = re.compile(rf"^[ \t*#/;>-]*({_WHO}|\(c\))[^\n]*$", re.M)
# A text with an item (b) has an item (c), which is no sign unless a year follows.
_ITEM = re.compile(r"^[ \t]*\(b\)[ \t]", re.M)
_COPYRIGHT_LISTED = re.compile(rf"^[ \t*#/;>-]*({_WHO}|\(c\)[ \t]*\d{{4}}\b)[^\n]*$", re.M)
_UPPER = str.maketrans({c: c + 32 for c in range(65, 91)})
_SPACES = str.maketrans({c: " " for c in [*range(128), *map(ord, PUNCTUATION)] if not (48 <= c <= 57 or 97 <= c <= 122)})

# Texts of short public licences, and the notices that stand for one.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004
Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}

# Licences whose whole text is a file beside this one, and the usual titles of licences.
FILES = ("Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")
TITLES = {
    "MIT": ["MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License", "The BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License", "The BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "WTFPL": ["WTFPL"],
    "Unlicense": ["The Unlicense", "Unlicense", "Unlicense (Public Domain)"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal", "Creative Commons Legal Code"],
    "GPL-2.0": ["GNU General Public License Version 2, June 1991"],
    "GPL-3.0": ["GNU General Public License Version 3, 29 June 2007"],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
}
_NUMBER = re.compile(r"^[ \t]*[0-9]\.[ \t]", re.M)
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_END = " end of terms and conditions"


def canonical(text: str | None) -> str:
    """A-Z lower-cased; copyright lines (with a sign, a year or a holder) gone; words apart by one space, in one spelling, without punctuation.

    Characters beyond ASCII other than PUNCTUATION belong to words.
    """
    lowered = (text or "").translate(_UPPER)
    words = (_COPYRIGHT_LISTED if _ITEM.search(lowered) else _COPYRIGHT).sub("", lowered).translate(_SPACES).split(" ")
    return " ".join([SPELLINGS.get(w, w) for w in words if w])


def digest(text: str | None) -> str:
    return hashlib.sha256(canonical(text).encode(errors="surrogatepass")).hexdigest()


def whole_texts() -> list[tuple[str, str]]:
    """Name and text of the licences in FILES, and of usual wordings of those in KNOWN."""
    out = [(name, (resources.files("loomwright.llm") / "licenses" / f"{name}.txt").read_text()) for name in FILES]
    bsd = KNOWN["BSD-2-Clause"]
    out.append(("BSD-3-Clause", bsd.replace("THIS SOFTWARE IS", _THIRD + "THIS SOFTWARE IS", 1)))
    out += [(name, KNOWN[name].replace("and/or distribute", "and distribute")) for name in ("ISC", "0BSD")]
    return out


def forms(name: str, text: str) -> set[str]:
    """Canonical texts of a licence: with and without its titles, numbers of clauses, and what follows its terms."""
    found = {canonical(text), canonical(_NUMBER.sub("", text))} if "BSD" in name or name == "Zlib" else {canonical(text)}
    found |= {c[: c.index(_END) + k] for c in list(found) if _END in c for k in (0, len(_END))}
    titles = [canonical(t) for t in TITLES.get(name, [])]
    found |= {c.removeprefix(f"{t} ") for c in found for t in titles}
    return found | {f"{t} {c}" for c in found for t in titles if not c.startswith(t)}


def known_digests(known: dict[str, str] = KNOWN) -> dict[str, str]:
    """digest: name; of licences with one canonical form the first in order. KNOWN comes with whole_texts() and the forms of
    all of them; other texts stand as they are."""
    first: dict[str, str] = {}
    for name, text in sorted(known.items()):
        if canonical(text):
            first.setdefault(digest(text), name)
    if known is KNOWN:
        for name, text in [*sorted((k, t) for k, t in known.items() if len(canonical(t).split()) > 30), *whole_texts()]:
            for form in sorted(forms(name, text)):
                first.setdefault(hashlib.sha256(form.encode()).hexdigest(), name)
    return first


def known_licenses(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    """license_id, digest of known_digests."""
    return spark.createDataFrame([(name, d) for d, name in known_digests(known).items()], "license_id string, digest string")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, license_id (null: none known) for each row of docs.

    The text as a whole has to be a known one, up to what the canonical form leaves out. Null and empty texts, and those
    of nothing but punctuation and copyright lines, have the digest of the empty text, which is never known. known has a
    license_id for each digest; of several the first in order. Repeated rows are looked up each for itself; other
    columns are not read. Spark picks the join by the size of known.
    """
    src = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                got = [digest(t) for t in b.column(1).slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 512), pa.array(got, pa.string())], ["_id", "digest"])

    one = known.where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id")).where(F.col("digest") != digest(""))
    out = src.mapInArrow(run, f"`_id` {kind}, digest string").join(one, "digest", "left")
    return out.select(F.col("_id").alias(id_col), "digest", "license_id")


def oracle(documents: str = "documents", known: dict[str, str] = KNOWN) -> str:
    """The same in DuckDB's SQL, with all known digests. Its patterns have no look-ahead, so that copyright lines are told
    line by line: what begins like one, unless a sentence of the licence goes on there."""
    rows = ", ".join(f"('{name}', '{d}')" for d, name in known_digests(known).items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pairs = ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS.items())
    mark = r"^[ \t*#/;>-]*"
    sentence = rf"{mark}copyright[ \t:]+({SENTENCE})\b"
    return rf"""
WITH known(license_id, digest) AS (VALUES {rows}),
l AS (SELECT doc_id, string_split(translate(coalesce(text, ''), '{upper}', '{lower}'), chr(10)) AS lines FROM {documents}),
i AS (SELECT doc_id, lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*\(b\)[ \t]'))) > 0 AS listed FROM l),
k AS (SELECT doc_id, list_filter(lines, lambda x: NOT (regexp_matches(x, '{mark}copyright[ \t:(]') AND NOT regexp_matches(x, '{sentence}')
  OR regexp_matches(x, '{mark}(©|all rights reserved)') OR regexp_matches(x, CASE WHEN listed THEN '{mark}\(c\)[ \t]*\d{{4}}\b' ELSE '{mark}\(c\)' END))) AS lines FROM i),
w AS (SELECT doc_id, list_filter(string_split(regexp_replace(array_to_string(lines, chr(10)), '[\x00-\x2F\x3A-\x60\x7B-\x7F{PUNCTUATION}]', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM k),
d AS (SELECT doc_id, sha256(array_to_string(list_transform(words, lambda x: coalesce((MAP {{{pairs}}})[x], x)), ' ')) AS digest FROM w)
SELECT d.doc_id, d.digest, known.license_id FROM d LEFT JOIN known USING (digest)
"""
