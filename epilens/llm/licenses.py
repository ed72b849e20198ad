"""License scan by ordered signature rules.

A rule is a regular expression over a text's words (A-Z lower-cased, one space
between words), a label, a priority and keywords. A rule is tried only on texts
that have all its keywords: their words are found by 64-bit hashes, whole blocks
of texts at a time, and most texts have none. The matches of all rules are
intervals of words. A match that lies within another one is suppressed if that
one has a better priority, or the same and is longer, or stems from an earlier
rule for the same interval; so a full notice hides the license names in it, and
`gpl 2.0 or later` hides `gpl 2.0`. Matches that only overlap both stay. Matches
of base rules are never suppressed.

Rules never look further than a bounded number of words, so a scan takes time in
proportion to a text's length.

Cases: null or empty texts have no words and no matches; texts of any length are
scanned whole; rows with the same or a null doc_id stay rows of their own; an
empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.llm.common import ship
from epilens.llm.textbytes import ALNUM, LOWER, blocks, span_hash, utf8, words

NOTICE, VERSION, NAME, HINT = 1, 2, 3, 4
#: How sure a kept match of each priority is.
SURE = {NOTICE: 0.95, VERSION: 0.85, NAME: 0.7, HINT: 0.3}

#: Base rules: their labels and places count whatever the other rules say.
BASE = """
gpl: <gnu> general public license
apache: <apache> license
cc-by: <cc> by
mit: <mit> license
"""

# In a signature <word> is a keyword and ... stands for up to six words.
#: Wordings of whole notices.
NOTICES = """
mit: permission is <hereby> granted free of charge to any person <obtaining> a copy of this software
mit: the above copyright notice and this permission notice shall be <included> in all copies or substantial portions
mit: subject to the following conditions the above copyright notice and this <permission> notice
mit-0: permission is <hereby> granted free of charge to any person <obtaining> a copy ... without restriction including without <limitation> the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
x11: except as contained in this notice the name of ... shall not be used in <advertising> or otherwise to promote
bsd-2-clause: <redistribution> and use in source and binary forms with or without modification are permitted
bsd-2-clause: <redistributions> of source code must <retain> the above copyright notice
bsd-2-clause: <redistributions> in binary form must <reproduce> the above copyright notice
bsd-3-clause: neither the name of ... nor the names of (?:its|any|the) <contributors> may be used to <endorse> or promote products
bsd-3-clause: the name of the author may not be used to <endorse> or promote products derived from this software
bsd-4-clause: all <advertising> materials mentioning features or use of this software must display
isc: permission to use copy modify and (?:or )?distribute this software for any purpose with or without <fee> is <hereby> granted
0bsd: permission to use copy modify and (?:or )?distribute this software for any purpose with or without <fee> is <hereby> granted the software is provided
apache-2.0: licensed under the <apache> license version 2 0 the license
apache-2.0: you may not use this file except in <compliance> with the license
apache-2.0: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is <basis>
gpl-3.0-or-later: either version 3 of the license or at your option any later <version>
gpl-2.0-or-later: either version 2 of the license or at your option any later <version>
lgpl-2.1-or-later: either version 2 1 of the license or at your option any later <version>
gpl: this program is <free> software you can <redistribute> it and or modify it under the terms of the <gnu> general public license
lgpl: this library is <free> software you can <redistribute> it and or modify it under the terms of the <gnu> lesser general public license
gpl: this program is distributed in the hope that it will be useful but without any <warranty>
gpl: you should have received a copy of the <gnu> general public license
lgpl: you should have received a copy of the <gnu> lesser general public license
agpl: you should have received a copy of the <gnu> <affero> general public license
gpl-2.0-only: under the terms of the <gnu> general public license version 2 as published by the free software foundation
mpl-2.0: this source code form is subject to the terms of the <mozilla> public license v 2 0
mpl-2.0: if a copy of the <mpl> was not distributed with this file you can obtain one at
mpl-1.1: the contents of this file are subject to the <mozilla> public license version 1 1
epl-2.0: this program and the accompanying materials are made available under the terms of the <eclipse> public license 2 0
epl-1.0: this program and the accompanying materials are made available under the terms of the <eclipse> public license v1 0
cddl-1.0: the contents of this file are subject to the terms of the <common> development and distribution license
zlib: this software is provided as is without any express or implied <warranty> in no event will the authors be held liable
zlib: altered source versions must be plainly marked as such and must not be <misrepresented>
unlicense: this is free and <unencumbered> software released into the public domain
wtfpl: everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is <changed>
bsl-1.0: boost software license version 1 0 august 17th <2003>
artistic-2.0: this is free software you can redistribute it ... under the terms of the <artistic> license 2 0
ofl-1.1: this font software is licensed under the <sil> open font license version 1 1
python-2.0: <psf> is making python available to licensee on an as is basis
openssl: this product includes software developed by the <openssl> project
cc-by-4.0: this work is licensed under (?:a|the) <creative> commons attribution 4 0 international license
cc-by-sa-4.0: this work is licensed under (?:a|the) <creative> commons attribution share ?alike 4 0 international license
cc-by-nc-4.0: this work is licensed under (?:a|the) <creative> commons attribution non ?commercial 4 0 international license
cc-by-nd-4.0: this work is licensed under (?:a|the) <creative> commons attribution no ?derivatives 4 0 international license
cc-by-nc-sa-4.0: this work is licensed under (?:a|the) <creative> commons attribution non ?commercial share ?alike 4 0 international license
cc-by-nc-nd-4.0: this work is licensed under (?:a|the) <creative> commons attribution non ?commercial no ?derivatives 4 0 international license
cc-by-sa-3.0: text is available under the <creative> commons attribution share ?alike license
cc0-1.0: the person who associated a work with this <deed> has dedicated the work to the public domain
cc0-1.0: to the extent possible under law ... has <waived> all copyright and related or neighboring rights
proprietary: no part of this (?:publication|book|document|work) may be <reproduced> ... without (?:the )?(?:prior )?(?:written )?permission
proprietary: this (?:software|document) contains <confidential> and proprietary information
proprietary: <unauthorized> (?:copying|use|reproduction|distribution) of this (?:file|software|document|material) ... is strictly prohibited
"""

#: Names with versions.
VERSIONS = """
gpl-1.0: <gnu> general public license (?:version |v ?)1(?: 0)?
gpl-2.0: <gnu> general public license (?:version |v ?)2(?: 0)?
gpl-3.0: <gnu> general public license (?:version |v ?)3(?: 0)?
gpl-2.0: version 2 of the <gnu> general public license
gpl-3.0: version 3 of the <gnu> general public license
gpl-2.0-or-later: <gnu> general public license (?:version |v ?)2(?: 0)? or (?:any )?(?:later|newer)
gpl-3.0-or-later: <gnu> general public license (?:version |v ?)3(?: 0)? or (?:any )?(?:later|newer)
gpl-2.0: <gpl> (?:version |v ?)?2(?: 0)?
gpl-3.0: <gpl> (?:version |v ?)?3(?: 0)?
gpl-2.0: <gplv2>
gpl-3.0: <gplv3>
gpl-2.0-or-later: <gpl> (?:version |v ?)?2(?: 0)? or (?:any )?later
gpl-3.0-or-later: <gpl> (?:version |v ?)?3(?: 0)? or (?:any )?later
lgpl-2.0: <gnu> library general public license (?:version |v ?)2(?: 0)?
lgpl-2.1: <gnu> lesser general public license (?:version |v ?)2 1
lgpl-3.0: <gnu> lesser general public license (?:version |v ?)3(?: 0)?
lgpl-2.1: <lgpl> (?:version |v ?)?2 1
lgpl-3.0: <lgpl> (?:version |v ?)?3(?: 0)?
lgpl-3.0: <lgplv3>
agpl-3.0: <gnu> <affero> general public license (?:version |v ?)3(?: 0)?
agpl-3.0: <agpl> (?:version |v ?)?3(?: 0)?
agpl-3.0: <agplv3>
gfdl-1.2: <gnu> free <documentation> license version 1 2
gfdl-1.3: <gnu> free <documentation> license version 1 3
apache-1.1: <apache> (?:software )?license (?:version |v ?)?1 1
apache-2.0: <apache> (?:software )?license (?:version |v ?)?2(?: 0)?
apache-2.0: <apache> 2 0
mpl-1.1: <mozilla> public license (?:version |v ?)?1 1
mpl-2.0: <mozilla> public license (?:version |v ?)?2 0
mpl-2.0: <mpl> (?:version |v ?)?2 0
epl-1.0: <eclipse> public license (?:version |v ?)?1 0
epl-2.0: <eclipse> public license (?:version |v ?)?2 0
epl-2.0: <epl> (?:version |v ?)?2 0
eupl-1.2: <european> union public licen[cs]e (?:version |v ?)?1 2
eupl-1.2: <eupl> (?:version |v ?)?1 2
cddl-1.0: <cddl> (?:version |v ?)?1 0
artistic-1.0: <artistic> license (?:version |v ?)?1 0
artistic-2.0: <artistic> license (?:version |v ?)?2 0
bsl-1.0: <boost> software license (?:version |v ?)?1 0
bsl-1.1: <business> source license (?:version |v ?)?1 1
sspl-1.0: <server> side public license (?:version |v ?)?1
elastic-2.0: <elastic> license (?:version |v ?)?2(?: 0)?
ofl-1.1: <sil> open font license (?:version |v ?)?1 1
ofl-1.1: <ofl> 1 1
afl-3.0: <academic> free license (?:version |v ?)?3 0
osl-3.0: <open> software license (?:version |v ?)?3 0
zpl-2.1: <zope> public license (?:version |v ?)?2 1
php-3.01: <php> license (?:version |v ?)?3 01
python-2.0: <python> software foundation license (?:version |v ?)?2
unicode-3.0: <unicode> license (?:version |v ?)?3
blueoak-1.0.0: <blue> <oak> model license (?:version )?1 0 0
bsd-2-clause: <bsd> 2 clause
bsd-3-clause: <bsd> 3 clause
bsd-4-clause: <bsd> 4 clause
bsd-2-clause: (?:2|two) clause <bsd>
bsd-3-clause: (?:3|three) clause <bsd>
bsd-4-clause: (?:4|four) clause <bsd>
bsd-2-clause: <simplified> <bsd>
bsd-3-clause: (?:new|revised|modified) <bsd>
odbl-1.0: <open> <database> license (?:version |v ?)?1 0
odc-by-1.0: <open> <data> commons attribution license
openrail-m: <openrail> m
llama-2: <llama> 2 community license
llama-3: <llama> 3 community license
cc-pdm-1.0: <creative> commons public domain <mark> 1 0
cc0-1.0: <cc0> (?:version )?1 0
cc0-1.0: <creative> commons <zero> (?:v )?1 0
"""

#: Names.
NAMES = """
gpl: <gpl>
gpl: <gnu> gpl
lgpl: <lgpl>
lgpl: <gnu> (?:lesser|library) general public license
agpl: <agpl>
agpl: <gnu> <affero> general public license
gfdl: <gfdl>
gfdl: <gnu> free <documentation> license
apache: <apache> (?:software )?licen[cs]e
apache: <apache> licen[cs]ed
apache: <asl> 2
mit: <mit> licen[cs]ed
mit: (?:under|the) <mit> (?:x11|expat)
mit: <expat> license
bsd: <bsd> (?:style )?licen[cs]e
bsd: <berkeley> software distribution license
isc: <isc> licen[cs]e
zlib: <zlib> (?:libpng )?licen[cs]e
mpl: <mozilla> public licen[cs]e
epl: <eclipse> public licen[cs]e
cpl: <common> public license
cddl: <common> <development> and distribution license
eupl: <european> union public licen[cs]e
artistic: <artistic> licen[cs]e
perl: same terms as <perl> itself
boost: <boost> software licen[cs]e
unlicense: the <unlicense>
wtfpl: <wtfpl>
wtfpl: do what the fuck you want to public <license>
beerware: <beerware> license
beerware: <beer> ware license
psf: <python> software foundation license
php: <php> license
ruby: <ruby> license
openssl: <openssl> license
postgresql: <postgresql> licen[cs]e
ms-pl: <microsoft> public license
ms-rl: <microsoft> reciprocal license
ncsa: university of <illinois> (?:ncsa )?open source license
ofl: <sil> open font licen[cs]e
vim: <vim> license
json: the software shall be used for good not <evil>
sspl: <server> side public license
busl: <business> source license
commons-clause: <commons> clause
odbl: <open> <database> licen[cs]e
pddl: public domain dedication and <license>
ogl-uk: open <government> licen[cs]e
etalab: <licence> ouverte
openrail: <openrail>
bigscience-rail: <bigscience> rail license
fair-use: fair <use>
cc-by: <creative> commons attribution
cc-by: <attribution> license
cc-by-sa: <cc> by sa
cc-by-nc: <cc> by nc
cc-by-nd: <cc> by nd
cc-by-nc-sa: <cc> by nc sa
cc-by-nc-nd: <cc> by nc nd
cc-by-sa: <creative> commons attribution share ?alike
cc-by-nc: <creative> commons attribution non ?commercial
cc-by-nd: <creative> commons attribution no ?deriv(?:ative|atives|s)?
cc-by-nc-sa: <creative> commons attribution non ?commercial share ?alike
cc-by-nc-nd: <creative> commons attribution non ?commercial no ?deriv(?:ative|atives|s)?
cc0: <cc0>
cc0: <creative> commons <zero>
cc: <creative> commons licen[cs]e
public-domain: (?:in|into|to) the <public> domain
public-domain: <public> domain (?:work|software|dedication|mark)
copyleft: <copyleft>
gpl: licence <publique> générale gnu
cc: licence <creative> commons
cc: licencia <creative> commons
cc: <creative> commons lizenz
gpl: licencia <pública> general (?:de )?gnu
public-domain: domaine <public>
public-domain: dominio <público>
public-domain: <gemeinfrei>
"""

#: Wordings that speak of rights without a license.
HINTS = """
all-rights-reserved: all <rights> reserved
all-rights-reserved: tous droits <réservés>
all-rights-reserved: todos los <derechos> reservados
all-rights-reserved: alle <rechte> vorbehalten
license-mention: <licensed> under (?:the )?(?:terms|conditions) of
license-mention: released under (?:the|a|an) ... <license>
license-mention: distributed under (?:the|a|an) ... <license>
license-mention: see (?:the )?<license> (?:file|txt|md) for (?:more )?details
license-mention: <spdx> license identifier
license-mention: subject to the <license> terms
license-mention: under the terms of (?:the|this) <license>
license-mention: end user <license> agreement
license-mention: open source <license>
license-mention: free software <license>
license-mention: non ?exclusive <license>
license-mention: royalty free <license>
license-mention: <sublicense>
copyright: <copyright> (?:c )?(?:19|20)[0-9][0-9]
copyright: <copyright> c
proprietary: <proprietary> (?:and confidential|software|license)
non-commercial: for non ?commercial (?:use|purposes) <only>
non-commercial: personal and <noncommercial> use
terms-of-use: <terms> of (?:use|service)
trademark: registered <trademark>
"""

#: Identifiers: each one makes rules for a tag, a field, a mention and two addresses.
IDENTIFIERS = """
0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0
CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC0-1.0 CDDL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-1.0
GPL-2.0-only GPL-2.0-or-later GPL-2.0 GPL-3.0-only GPL-3.0-or-later GPL-3.0 ISC LGPL-2.0 LGPL-2.1-only LGPL-2.1-or-later LGPL-2.1 LGPL-3.0-only LGPL-3.0-or-later LGPL-3.0 MIT MIT-0
MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL Python-2.0 Ruby SSPL-1.0 Unlicense Vim W3C WTFPL Zlib ZPL-2.1
"""
_BY_IDENTIFIER = ["<spdx> license identifier {0}", "<license> {0}", "licen[cs]ed <under> (?:the )?{0}", "<opensource> org licenses {0}", "<spdx> org licenses {0}"]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    pattern: str
    keywords: tuple[str, ...]
    base: bool = False


def rules_of(lines: str, priority: int, base: bool = False) -> list[Rule]:
    """Rules in the order of the lines `label: signature`."""
    found = []
    for line in lines.strip().splitlines():
        label, signature = line.split(": ", 1)
        pattern = re.sub(r"<([^<>]+)>", r"\1", signature).replace(" ... ", "(?: [^ ]+){0,6}? ")
        found.append(Rule(label, priority, pattern, tuple(re.findall(r"<([^<>]+)>", signature)), base))
    return found


def identifier_rules(identifiers: str) -> list[Rule]:
    lines = [f"{name.lower()}: {form.format(re.sub('[^a-z0-9]+', ' ', name.lower()))}" for name in identifiers.split() for form in _BY_IDENTIFIER]
    return rules_of("\n".join(lines), VERSION)


def creative_commons_rules() -> list[Rule]:
    kinds, versions = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")
    return rules_of("\n".join(f"cc-{k}-{v}: <cc> {k.replace('-', ' ')} (?:version |v )?{v.replace('.', ' ')}" for k in kinds for v in versions), VERSION)


RULES = (*rules_of(BASE, NAME, base=True), *rules_of(NOTICES, NOTICE), *identifier_rules(IDENTIFIERS), *creative_commons_rules(), *rules_of(VERSIONS, VERSION), *rules_of(NAMES, NAME), *rules_of(HINTS, HINT))


@cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(f" (?:{pattern})(?= )".encode())


def suppress(found: list[tuple[int, int, int, int, bool]]) -> list[tuple[int, int, int, int, bool]]:
    """found: (start, end, priority, place of the rule, base). What is left, by start.

    Of intervals that start no later, the furthest end seen so far is kept for each priority.
    """
    left, far = [], {}
    for m in sorted(found, key=lambda m: (m[0], -m[1], m[2], m[3])):
        start, end, priority, _, base = m
        if base or not any(far.get(p, -1) >= end for p in far if p <= priority):
            left.append(m)
        far[priority] = max(end, far.get(priority, -1))
    return left


class Scanner:
    """The rules with their keywords' hashes."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        spelled = sorted({k for r in rules for k in r.keywords})
        raw, bounds = utf8(pa.array(spelled, pa.large_string()))
        h = span_hash(raw, bounds[:-1], bounds[1:])
        order = np.argsort(h)
        self.hashes, self.spelled = h[order], [spelled[k] for k in order]

    def scan(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> Iterator[list[tuple[int, int, int, int, bool]]]:
        """The matches that stay, for each text whose words are those from at[k] to at[k + 1]."""
        h = span_hash(low, starts, ends)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[place] == h) if len(h) else np.zeros(0, np.int64)
        first = np.searchsorted(hit, at)
        for k in range(len(at) - 1):
            here = {self.spelled[i] for i in set(place[hit[first[k] : first[k + 1]]].tolist())}
            tried = [(n, r) for n, r in enumerate(self.rules) if here.issuperset(r.keywords)] if here else []
            if not tried:
                yield []
                continue
            s, e = starts[at[k] : at[k + 1]], ends[at[k] : at[k + 1]]
            data = low.tobytes() if len(at) == 2 else low[s[0] : e[-1]].tobytes()
            base = 0 if len(at) == 2 else int(s[0])
            text = b" ".join([b"", *(data[a - base : b - base] for a, b in zip(s.tolist(), e.tolist(), strict=True)), b""])
            gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
            found = []
            for n, r in tried:
                for m in _compiled(r.pattern).finditer(text):
                    a, b = np.searchsorted(gaps, m.span())
                    found.append((int(a), int(b), r.priority, n, r.base))
            yield suppress(found)


_MATCHES = "doc_id long, n_words long, matches array<struct<start:long,end:long,label:string,priority:int,rule:int,base:boolean>>"
_MATCH = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("rule", pa.int32()), ("base", pa.bool_())]))


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch, raw, bounds in blocks(batches):
            low = LOWER[raw]
            starts, ends, at = words(low, bounds, ALNUM)
            rows = [[{"start": a, "end": b, "label": rules[n].label, "priority": p, "rule": n, "base": base} for a, b, p, n, base in m] for m in scanner.scan(low, starts, ends, at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(rows, _MATCH)], ["doc_id", "n_words", "matches"])

    return run


def find_licenses(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, matches (word intervals, end excluded, by start) of every document."""
    ship(spark)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(rules), _MATCHES)


def _labels(matches: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"])))


def license_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one less the product of what the
    surest match of each label leaves open."""
    base = F.filter("matches", lambda m: m["base"])
    places = F.transform(base, lambda m: m["start"])
    sure = F.create_map(*[F.lit(x) for kv in SURE.items() for x in kv])
    best = F.transform("names", lambda name: F.array_min(F.transform(F.filter("matches", lambda m: m["label"] == name), lambda m: m["priority"])))
    score = F.round(1 - F.aggregate(best, F.lit(1.0), lambda a, p: a * (1 - sure[p])), 6)
    return found.withColumn("names", _labels(F.col("matches"))).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), F.array_join(_labels(base), ",").alias("base_labels"), F.array_join("names", ",").alias("labels"), score.alias("score")
    )
