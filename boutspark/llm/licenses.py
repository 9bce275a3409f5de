"""Licence scan by canonical digests, in DataFrame functions only.

A text is made canonical: lower case, copyright lines dropped, equivalent spellings made
one, everything but letters, digits and new lines a space. The digest of its words is
hash-joined to the digests of known licence texts; so is every line by itself, as notices
usually are one line of a document. No text is compared with another.

Defined results: null and empty texts, and texts without letters or digits, have the
digest of "" and match nothing; of several known texts with one digest the least name
counts; repeated rows with repeated or null ids give one row each, with the notices of
their own text (no id is a key of a group or join); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutspark.llm.sides import few
from boutspark.staging import stage

#: Whole licence texts, one file each, named by identifier; read on the driver.
TEXTS = Path(__file__).resolve().parent / "license_texts"
#: Known texts up to this number are joined by broadcast (their digests take some 100 bytes each).
BROADCAST_ROWS = 20_000

# Spellings that licence matching treats as equal.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("favour", "favor"),
    ("https://", "http://"),
)

# A line that names a right holder and no terms.
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\p{N}\n]*(?:\(c\)|©|[0-9]{4})|\(c\)[^\p{L}\p{N}\n]*[0-9]{4}|©"
    r"|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*"
)

# Short notices and short licence texts, by name.
SHORT = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    (
        "MIT",
        """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    ),
    (
        "ISC",
        """ISC License

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    ),
)

# Identifiers that stand in SPDX lines, beside those above.
SPDX = (
    "0BSD", "AFL-3.0", "Artistic-2.0", "BSD-2-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "OFL-1.1",
    "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "Zlib",
)
# Families with three forms of identifier: bare, -only and -or-later.
FAMILIES = (
    "AGPL-3.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0",
)
#: Where the terms of a long text end; what follows tells how to apply them and is often left out.
END = "END OF TERMS AND CONDITIONS"


def _forms(text: str) -> set[str]:
    """A text, the same without its appendix, without its title, and without the blank of a right holder."""
    forms = {text}
    if END in text:
        forms.add(text[: text.index(END) + len(END)])
        forms.add(text[: text.index(END)])
    title, _, rest = text.partition("\n\n")
    if "\n" not in title and title.endswith("License") and rest:
        forms |= {rest, f"The {title}\n\n{rest}"}
    return forms | {re.sub(r"(?m)^.*Copyright \[yyyy\].*$", "", x) for x in forms}


def _known() -> tuple[tuple[str, str], ...]:
    """(name, text) of the short ones above, of the SPDX lines and of the whole texts in `license_texts`."""
    names = [(x, x) for x in SPDX]
    for x in FAMILIES:
        names += [(x, x), (x, f"{x}-only"), (f"{x}-or-later", f"{x}-or-later")]
    lines = [(name, f"SPDX-License-Identifier: {x}") for name, x in names]
    whole = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    whole += [(name, text) for name, text in SHORT if "\n" in text]
    forms = [(name, form) for name, text in whole for form in sorted(_forms(text))]
    return tuple(dict.fromkeys([*SHORT, *lines, *forms]))


KNOWN = _known()


def canonical(text: Column) -> Column:
    """Canonical lines of a text, joined by new lines."""
    c = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    for other, one in SPELLINGS:
        c = F.replace(c, F.lit(other), F.lit(one))
    return F.regexp_replace(c, r"[^\p{L}\p{N}\n]+", " ")


def words_digest(lines: Column) -> Column:
    """Digest of canonical text, whatever its line breaks."""
    return F.sha2(F.trim(F.regexp_replace(lines, r"[ \n]+", " ")), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "license string, text string")


def scan(
    docs: DataFrame, known: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, digest, license, n_notices, notices) of every row.

    `license` is the known text that the whole document is; `notices` are the names of
    the known texts that are lines of it, sorted and joined by ", ", with `n_notices` such lines.
    """
    spark = docs.sparkSession
    known = known_licenses(spark) if known is None else known.select("license", "text")
    empty = F.sha2(F.lit(""), 256)
    digests = (
        known.select("license", words_digest(canonical(F.col("text"))).alias("digest"))
        .where(F.col("license").isNotNull() & (F.col("digest") != empty))
        .groupBy("digest")
        .agg(F.min("license").alias("license"))
    )
    side = few(digests, BROADCAST_ROWS)
    lines = canonical(F.col(text_col))
    # rows of one canonical text have the same notices, so these are found once per text, by its digest
    marks = (
        docs.select(lines.alias("lines"))
        .select(F.sha2("lines", 256).alias("lines_digest"), F.posexplode(F.split("lines", "\n")).alias("at", "line"))
        .where(F.length(F.trim("line")) > 0)
        .select("lines_digest", "at", F.sha2(F.trim("line"), 256).alias("digest"))
        .join(side, "digest")
        .select("lines_digest", "at", "license")
        .distinct()
    )
    notices = stage(
        marks.groupBy("lines_digest").agg(
            F.count("*").alias("n_notices"),
            F.array_join(F.sort_array(F.collect_set("license")), ", ").alias("notices"),
        ),
        "notices",
    )
    rows = docs.select(F.col(id_col), lines.alias("lines")).select(
        id_col, words_digest(F.col("lines")).alias("digest"), F.sha2("lines", 256).alias("lines_digest")
    )
    found = rows.join(side, "digest", "left").join(few(notices, BROADCAST_ROWS), "lines_digest", "left")
    return found.select(
        id_col,
        "digest",
        "license",
        F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"),
        F.coalesce("notices", F.lit("")).alias("notices"),
    )
