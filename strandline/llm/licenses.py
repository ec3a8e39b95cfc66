"""Licences by known sentences and ordered rules, in DataFrame functions alone.

A text is cut into sentences; those with a licence word are normalised and looked
up among known licence sentences.  The identifiers of a document, in order, are
matched against rules that each name a sequence; rules are tried in order (whole
licences before single sentences), and a matched stretch is used up.  All of it
happens inside a row: nothing is shuffled, and texts without a licence word
cost one pattern test.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import text_of

# Known sentences, normalised as ``normal`` does, and their identifiers.
SENTENCES = {
    "mit-short": "released under the mit license",
    "mit-short-2": "licensed under the mit license",
    "mit-work": "this work is licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights to use "
    "copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software "
    "is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in "
    "an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in "
    "the software",
    "apache-short": "licensed under the apache license version 2 0",
    "apache-work": "this work is licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
    "on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-short": "licensed under the gnu general public license version 3",
    "gpl2-work": "this work is licensed under the gnu general public license version 2",
    "gpl-3-plus": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-plus": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl3-work": "this work is licensed under the gnu lesser general public license version 3",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission",
    "bsd-short": "licensed under the bsd license",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-nc-sa-4": "licensed under cc by nc sa 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 only",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
}
# Rules, in the order in which they are tried.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("GPL-3.0-or-later", ("gpl-3-plus", "gpl-hope", "gpl-details", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl-2-plus", "gpl-hope", "gpl-details", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-3-plus",)),
    ("GPL-2.0-or-later", ("gpl-2-plus",)),
    ("MIT", ("mit-grant",)),
    ("Apache-2.0", ("apache-header",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-short-2",)),
    ("MIT", ("mit-work",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-work",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-3.0-only", ("spdx-gpl3",)),
    ("GPL-2.0-only", ("gpl2-work",)),
    ("LGPL-3.0-only", ("lgpl3-work",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("BSD", ("bsd-short",)),
    ("MPL-2.0", ("mpl2",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-work",)),
)
# Further forms of published texts: sentences and identifiers.  The registered SQL
# holds the tables above and takes a text line by line; on it the two agree.
FORMS = {
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy",
    "if not see http www gnu org licenses": "gnu-see",
    "if not see https www gnu org licenses": "gnu-see",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not "
    "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or "
    "consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
    "business interruption however caused and on any theory of liability whether in contract strict liability or tort including "
    "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such "
    "damage": "bsd-liability",
}
#: What follows a lead-in: licence, its name as the tables have it, and a pattern of its names in normal form.
NAMES = [
    ("MIT", "the mit license", "mit(?: license)?"),
    ("Apache-2.0", "the apache license version 2 0", "apache(?: license)?(?: version| ?v)? ?2 0(?: license)?"),
    ("BSD-2-Clause", "the bsd 2 clause license", "(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?"),
    ("BSD-3-Clause", "the bsd 3 clause license", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: license)?"),
    ("BSD", "the bsd license", "bsd license"),
    ("ISC", "the isc license", "isc(?: license)?"),
    ("MPL-2.0", "the mozilla public license version 2 0", "(?:mozilla public license|mpl)(?: version| ?v)? ?2 0"),
    ("CC-BY-4.0", "a creative commons attribution 4 0 international license", "creative commons attribution 4 0(?: international)?(?: license)?"),
]
for _short, _long, _versions in (("gpl", "general public license", "23"), ("lgpl", "lesser general public license", "3")):
    for _v in _versions:
        _name, _pattern = f"the gnu {_long} version {_v}", f"(?:gnu )?(?:{_long}|{_short})(?: version| ?v)? ?{_v}(?: 0)?"
        _later = r"(?: or(?: at your option)?(?: any)? later(?: version)?|\+)"
        NAMES.append((f"{_short.upper()}-{_v}.0-or-later", f"{_name} or later", _pattern + _later))
        NAMES.append((f"{_short.upper()}-{_v}.0-only", _name, f"{_pattern}(?: only)?"))
for _kind, _long in (("by", ""), ("by sa", " sharealike"), ("by nc", " noncommercial"), ("by nc sa", " noncommercial sharealike")):
    _pattern = f"(?:cc|creative commons) {_kind} 4 0(?: international)?(?: license)?"
    if _long:
        _long = _long.replace(" sharealike", " share ?alike").replace(" noncommercial", " non ?commercial")
        _pattern += f"|creative commons attribution{_long} 4 0(?: international)?(?: license)?"
    NAMES.append((f"CC-{_kind.upper().replace(' ', '-')}-4.0", f"cc {_kind} 4 0", _pattern))
LEADS = ("released under", "licensed under", "this work is licensed under")
#: Names that SPDX has given up, beside those of the rules.
OLD_TAGS = {f"{n}-{v}.0{x}": f"{n}-{v}.0-{y}" for n, v in (("GPL", 2), ("GPL", 3), ("LGPL", 3)) for x, y in (("", "only"), ("+", "or-later"))}


def _generated() -> dict[str, str]:
    """Every lead-in with every name, and every tag; identifiers by licence."""
    out = {f"{lead} {name}": f"named-{licence}" for licence, name, _ in NAMES for lead in LEADS}
    tags = {licence: licence for licence, _, _ in NAMES if licence != "BSD"} | OLD_TAGS
    return out | {"spdx license identifier " + re.sub("[^a-z0-9+]+", " ", t.lower()): f"named-{licence}" for t, licence in tags.items()}


KNOWN = _generated() | {s: k for k, s in SENTENCES.items()} | FORMS
ALL_RULES = (*RULES, *((licence, (f"named-{licence}",)) for licence in dict.fromkeys(n[0] for n in NAMES)))
#: Every known sentence has one of these words, so that other sentences need no look-up.
ANCHOR = "licen[sc]e|copyright|warrant|redistribut"

# How a text is cut, in patterns that SQL engines share.
COMMENT = r"(^|\n)[ \t]*(//+|#+|\*+|--+|;+)[ \t]*"
WRAPPED = r"\n([a-z(])"
ENDED = r"([.!?;])[ \t\r\n]+"
BREAK = "\u0001"


def normal(s: Column) -> Column:
    """Lower case, one spelling, words of letters and digits, one form of \"this work is\"."""
    s = F.regexp_replace(F.lower(s), "licence", "license")
    s = F.trim(F.regexp_replace(s, "[^a-z0-9+]+", " "))
    return F.regexp_replace(
        s, "^(this|the) (work|file|software|project|code|library|package|document|repository) is (licensed|released)", "this work is licensed"
    )


def _wherever_wrapped(normal_form: str) -> str:
    """A pattern for a known sentence as it is in texts, over lines and with any punctuation."""
    pattern = normal_form.replace("license", "licen[sc]e").replace(" ", "(?:[^A-Za-z0-9+]+)")
    return f"(?i)(?<![A-Za-z0-9+]){pattern}(?![A-Za-z0-9+])"


def unwrapped(text: Column) -> Column:
    """Known sentences and named licences in their normal form, on one line and without the marks that sentences are cut at; blanks before a joined line off.

    The parts of an unknown sentence in indented lines are joined, but a line that
    begins or ends with a known sentence stays apart from its indented neighbour.
    """
    pairs = [(f"(licensed|released) under (?:(?:the|an?) )?(?:{p})", f"\u0002$1 under {name}\u0003") for _, name, p in NAMES]
    pairs += [(s, f"\u0002{s}\u0003") for s in (*SENTENCES.values(), *FORMS) if s not in _generated()]
    known = F.array(*[F.struct(F.lit(_wherever_wrapped(p)).alias("p"), F.lit(s).alias("s")) for p, s in pairs])
    text = F.aggregate(known, text, lambda t, k: F.regexp_replace(t, k["p"], k["s"]))
    text = F.regexp_replace(text, r"(?i)(spdx-licen[sc]e-identifier:[^\n]*)\n", "$1" + BREAK)  # a tag ends with its line
    text = F.regexp_replace(text, "\n[ \t]+\u0002+", BREAK)
    text = F.regexp_replace(text, "\u0003[ \t]*\n[ \t]+", BREAK)
    return F.regexp_replace(F.regexp_replace(text, "[\u0002\u0003]", ""), r"\n[ \t]+([a-z(])", " $1")


def sentences(text: Column) -> Column:
    """Sentences in order: cut after closing punctuation and at line ends, wrapped lines joined, comment marks off."""
    text = unwrapped(F.regexp_replace(text, COMMENT, "\n"))
    text = F.regexp_replace(text, WRAPPED, " $1")
    text = F.regexp_replace(text, ENDED, "$1" + BREAK)
    return F.split(F.regexp_replace(text, "\n", BREAK), BREAK)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with a licence sentence, known or not.

    id, licenses (names in the order of the rules, comma-joined; empty if no rule
    matched), known and unknown (numbers of licence sentences), sequence (their
    identifiers in order, ``<?>`` for an unknown one).  NULL and empty texts have no
    sentence; rows that repeat are scanned each.
    """
    anchored = f"(?i){ANCHOR}"
    lookup = F.create_map(*[F.lit(x) for s, k in KNOWN.items() for x in (s, f"<{k}>")])
    maybe = rf"{anchored}|released\s+under"  # a name without one of the words can follow
    rows = docs.select(F.col(id_col), text_of(text_col).alias("__text")).filter(F.col("__text").rlike(maybe))
    found = rows.select(id_col, F.filter(sentences(F.col("__text")), lambda s: s.rlike(maybe)).alias("__cut"))

    def identifier(s: Column) -> Column:
        return F.coalesce(F.element_at(lookup, normal(s)), F.when(s.rlike(anchored), F.lit("<?>")))

    found = found.select(id_col, F.array_compact(F.transform("__cut", identifier)).alias("__ids")).filter(F.size("__ids") > 0)
    unknown = F.size(F.filter("__ids", lambda x: x == "<?>"))
    found = found.select(
        id_col, (F.size("__ids") - unknown).alias("known"), unknown.alias("unknown"), F.array_join("__ids", "").alias("sequence")
    )
    left = F.col("sequence")
    names = []
    for k, (name, ids) in enumerate(ALL_RULES):
        stretch = "".join(f"<{i}>" for i in ids)
        found = found.withColumn(f"__rule{k}", F.when(F.contains(left, F.lit(stretch)), F.lit(name)))
        found = found.withColumn("__left", F.replace(left, F.lit(stretch), F.lit("<>")))
        left = F.col("__left")
        names.append(f"__rule{k}")
    licenses = F.array_join(F.array_distinct(F.array_compact(F.array(*names))), ",")
    return found.select(id_col, licenses.alias("licenses"), "known", "unknown", "sequence")


def sql() -> str:
    """The same over ``documents`` in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    text = f"regexp_replace(coalesce(text, ''), {q(COMMENT)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {q(WRAPPED)}, ' \\1', 'g')"
    text = f"regexp_replace({text}, {q(ENDED)}, '\\1' || chr(1), 'g')"
    text = f"string_split(replace({text}, chr(10), chr(1)), chr(1))"
    norm = "trim(regexp_replace(replace(lower(s), 'licence', 'license'), '[^a-z0-9+]+', ' ', 'g'))"
    norm = (
        f"regexp_replace({norm}, '^(this|the) (work|file|software|project|code|library|package|document|repository) is "
        "(licensed|released)', 'this work is licensed')"
    )
    case = "CASE n " + " ".join(f"WHEN {q(s)} THEN {q(f'<{k}>')}" for k, s in SENTENCES.items()) + " ELSE '<?>' END"
    rules, left = [], "sequence"
    for k, (name, ids) in enumerate(RULES):
        stretch = q("".join(f"<{i}>" for i in ids))
        rules.append(f"CASE WHEN contains({left}, {stretch}) THEN {q(name)} END AS rule{k}, replace({left}, {stretch}, '<>') AS left{k}")
        left = f"left{k}"
    names = ", ".join(f"rule{k}" for k in range(len(RULES)))
    first = " ".join(
        f"WHEN x = {q(n)} THEN {min(k for k, r in enumerate(RULES) if r[0] == n)}" for n in dict.fromkeys(r[0] for r in RULES)
    )
    return f"""
WITH cut AS (
  SELECT doc_id, list_filter({text}, lambda s: regexp_matches(s, {q('(?i)' + ANCHOR)})) AS cut
  FROM documents WHERE regexp_matches(coalesce(text, ''), {q('(?i)' + ANCHOR)})),
ids AS (
  SELECT doc_id, list_transform(list_transform(cut, lambda s: {norm}), lambda n: {case}) AS ids FROM cut WHERE len(cut) > 0),
seq AS (
  SELECT doc_id, CAST(len(list_filter(ids, lambda x: x <> '<?>')) AS INTEGER) AS known,
         CAST(len(list_filter(ids, lambda x: x = '<?>')) AS INTEGER) AS unknown, array_to_string(ids, '') AS sequence FROM ids),
ruled AS (SELECT *, {", ".join(rules)} FROM seq),
named AS (
  SELECT doc_id, known, unknown, sequence, list_distinct(list_filter([{names}], lambda x: x IS NOT NULL)) AS names FROM ruled)
SELECT doc_id, known, unknown, sequence,
       coalesce((SELECT string_agg(x, ',' ORDER BY CASE {first} END) FROM (SELECT unnest(names) AS x)), '') AS licenses
FROM named"""
