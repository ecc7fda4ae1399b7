"""License scan: ordered signature rules over whole texts.

A rule is a label, a priority and a regular expression, gated by keywords: an Aho-Corasick automaton runs once over the
lower-cased text, and only rules with a keyword in it are tried. Of overlapping detections, an interval that lies within
one of the same or higher priority is suppressed. The base phrases ("cc by", "general public license", "all rights
reserved", as consecutive words) always count; rules add labels, they never remove base ones.

Words are runs of characters outside ASCII punctuation, space and control, after lower-casing A-Z. Nulls count as empty:
n_words 0, n_base 0, null positions, no labels, score 0. Repeated rows are scanned alike, a row each; other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.base import prepare

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# One licence a line: label | SPDX identifier | title, as a pattern over lower-cased text | address, as a pattern.
# Each of the last three makes a rule of its own, with priority title > address > identifier.
_FAMILIES = r"""
0bsd | 0BSD | (?:bsd zero[ -]clause|zero[ -]clause bsd) license | opensource\.org/licenses?/0bsd
aal | AAL | attribution assurance license | opensource\.org/licenses?/aal
afl | AFL-[123]\.[0-9] | academic free license(?:,? (?:version|v\.?) ?[123]\.[0-9])? | opensource\.org/licenses?/afl-[0-9.]+
agpl | AGPL-3\.0(?:-only|-or-later)? | (?:gnu )?affero general public licen[sc]e | gnu\.org/licenses/agpl
apache | Apache-(?:1\.[01]|2\.0) | apache(?: software)? licen[sc]e(?:,? (?:version|v\.?) ?[12]\.[0-9])? | apache\.org/licenses/license-[0-9.]+
apl | APL-1\.0 | adaptive public license | opensource\.org/licenses?/apl-1\.0
apsl | APSL-[12]\.[0-9] | apple public source license | opensource\.apple\.com/apsl
artistic | Artistic-[12]\.0 | artistic license(?: [12]\.0)? | opensource\.org/licenses?/artistic-license
beerware | Beerware | beer[- ]?ware license | people\.freebsd\.org/~phk
blueoak | BlueOak-1\.0\.0 | blue oak model license | blueoakcouncil\.org/license
bsd-2 | BSD-2-Clause(?:-[a-z]+)? | (?:simplified bsd|bsd 2[ -]clause|2[ -]clause bsd|freebsd) license | opensource\.org/licenses?/bsd-2-clause
bsd-3 | BSD-3-Clause(?:-[a-z]+)? | (?:new bsd|modified bsd|bsd 3[ -]clause|3[ -]clause bsd) license | opensource\.org/licenses?/bsd-3-clause
bsd-4 | BSD-4-Clause(?:-[a-z]+)? | (?:original bsd|bsd 4[ -]clause|4[ -]clause bsd) license | spdx\.org/licenses/bsd-4-clause
bsl | BSL-1\.0 | boost software license | boost\.org/license_1_0
busl | BUSL-1\.1 | business source license | mariadb\.com/bsl11
cal | CAL-1\.0 | cryptographic autonomy license | opensource\.org/licenses?/cal-1\.0
catosl | CATOSL-1\.1 | computer associates trusted open source license | opensource\.org/licenses?/catosl-1\.1
cc0 | CC0-1\.0 | (?:cc0 1\.0|cc0 universal|creative commons zero)(?: 1\.0)?(?: universal)? | creativecommons\.org/publicdomain/zero
cc-by | CC-BY-[1234]\.[0-9] | creative commons attribution(?: [1234]\.0)?(?: international| unported)?(?: licen[sc]e)? | creativecommons\.org/licenses/by/[0-9.]+
cc-by-sa | CC-BY-SA-[1234]\.[0-9] | creative commons attribution[- ]share[- ]?alike | creativecommons\.org/licenses/by-sa
cc-by-nd | CC-BY-ND-[1234]\.[0-9] | creative commons attribution[- ]no[- ]?deriv(?:ative)?s? | creativecommons\.org/licenses/by-nd
cc-by-nc | CC-BY-NC-[1234]\.[0-9] | creative commons attribution[- ]non[- ]?commercial | creativecommons\.org/licenses/by-nc/
cc-by-nc-sa | CC-BY-NC-SA-[1234]\.[0-9] | creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike | creativecommons\.org/licenses/by-nc-sa
cc-by-nc-nd | CC-BY-NC-ND-[1234]\.[0-9] | creative commons attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:ative)?s? | creativecommons\.org/licenses/by-nc-nd
cddl | CDDL-1\.[01] | common development and distribution license | opensource\.org/licenses?/cddl
cdla | CDLA-(?:Permissive|Sharing)-[12]\.0 | community data license agreement | cdla\.(?:dev|io)/
cecill | CECILL-[0-9.]+(?:-[bc])? | cecill(?:-[bc])? (?:free software )?license | cecill\.info/licen[cs]es
clartistic | ClArtistic | clarified artistic license | gianluca\.dellavedova\.org
cnri | CNRI-Python | cnri (?:open source )?license agreement | opensource\.org/licenses?/cnripython
cpal | CPAL-1\.0 | common public attribution license | opensource\.org/licenses?/cpal
cpl | CPL-1\.0 | common public license(?: version 1\.0)? | opensource\.org/licenses?/cpl1?
cua | CUA-OPL-1\.0 | cua office public license | opensource\.org/licenses?/cua-opl
curl | curl | curl (?:and libcurl )?license | curl\.(?:se|haxx\.se)/docs/copyright
dfsl | D-FSL-1\.0 | deutsche freie software lizenz | dipp\.nrw\.de/d-fsl
ecl | ECL-[12]\.0 | educational community license | opensource\.org/licenses?/ecl
efl | EFL-[12]\.0 | eiffel forum license | opensource\.org/licenses?/(?:ver2_)?eiffel
elastic | Elastic-2\.0 | elastic license(?: 2\.0)? | elastic\.co/licensing/elastic-license
entessa | Entessa | entessa public license | opensource\.org/licenses?/entessa
epl | EPL-[12]\.0 | eclipse public license(?:,? (?:version|v\.?) ?[12]\.0)? | eclipse\.org/legal/epl
eudatagrid | EUDatagrid | eu datagrid software license | opensource\.org/licenses?/eudatagrid
eupl | EUPL-1\.[0-9] | european union public licen[sc]e | joinup\.ec\.europa\.eu/.{0,40}eupl
fair | Fair | fair license | opensource\.org/licenses?/fair
frameworx | Frameworx-1\.0 | frameworx open license | opensource\.org/licenses?/frameworx
fsfap | FSFAP | gnu all[- ]permissive license | gnu\.org/prep/maintain/html_node/license-notices
ftl | FTL | freetype (?:project )?license | freetype\.org/license
fdl | GFDL-1\.[123](?:-only|-or-later)? | (?:gnu )?free documentation licen[sc]e | gnu\.org/licenses/(?:old-licenses/)?fdl
gpl | GPL-[123]\.0(?:-only|-or-later|\+)? | (?:gnu )?general public licen[sc]e | gnu\.org/licenses/(?:old-licenses/)?gpl
hpnd | HPND(?:-sell-variant)? | historical permission notice and disclaimer | opensource\.org/licenses?/hpnd
icu | ICU | icu license | source\.icu-project\.org/.{0,40}license
ijg | IJG | independent jpeg group(?:'s)? (?:license|software) | ijg\.org/files/readme
imagemagick | ImageMagick | imagemagick (?:studio )?license | imagemagick\.org/script/license
intel | Intel | intel open source license | opensource\.org/licenses?/intel
ipa | IPA | ipa font license | opensource\.org/licenses?/ipafont
ipl | IPL-1\.0 | ibm public license | opensource\.org/licenses?/ibmpl
isc | ISC | isc license | opensource\.org/licenses?/isc
jasper | JasPer-2\.0 | jasper license | ece\.uvic\.ca/~mdadams/jasper
json | JSON | shall be used for good, not evil | json\.org/license
lal | LAL-1\.[23] | (?:free art license|licence art libre) | artlibre\.org/licence
latex | LPPL-1\.[0-9][a-c]? | latex project public license | latex-project\.org/lppl
lgpl | LGPL-(?:2\.[01]|3\.0)(?:-only|-or-later|\+)? | (?:gnu )?(?:lesser|library) general public licen[sc]e | gnu\.org/licenses/(?:old-licenses/)?lgpl
libpng | libpng-2\.0 | (?:png reference library|libpng) license | libpng\.org/pub/png/src/libpng-license
libtiff | libtiff | libtiff license | libtiff\.org/misc
liliq | LiLiQ-(?:P|R|Rplus)-1\.1 | licence libre du qu[eé]bec | forge\.gouv\.qc\.ca/licence
lpl | LPL-1\.0(?:2)? | lucent public license | opensource\.org/licenses?/lucent
miros | MirOS | miros licen[cs]e | opensource\.org/licenses?/miros
mit | MIT | (?:the )?mit licen[sc]e | opensource\.org/licenses?/mit
mit-0 | MIT-0 | mit no attribution | opensource\.org/licenses?/mit-0
motosoto | Motosoto | motosoto open source license | opensource\.org/licenses?/motosoto
mpl | MPL-[12]\.[01](?:-no-copyleft-exception)? | mozilla public licen[sc]e(?:,? (?:version|v\.?) ?[12]\.[01])? | mozilla\.org/(?:en-us/)?mpl
mspl | MS-PL | microsoft public license | opensource\.org/licenses?/ms-pl
msrl | MS-RL | microsoft reciprocal license | opensource\.org/licenses?/ms-rl
mulan | MulanPSL-[12]\.0 | mulan permissive software license | license\.coscl\.org\.cn/mulanpsl
multics | Multics | multics license | opensource\.org/licenses?/multics
nasa | NASA-1\.3 | nasa open source agreement | opensource\.org/licenses?/nasa1\.3
naumen | Naumen | naumen public license | opensource\.org/licenses?/naumen
ncsa | NCSA | (?:university of illinois/)?ncsa open source license | opensource\.org/licenses?/(?:uoi-)?ncsa
netcdf | NetCDF | netcdf license | unidata\.ucar\.edu/software/netcdf/copyright
ngpl | NGPL | nethack general public license | opensource\.org/licenses?/nethack
nokia | Nokia | nokia open source license | opensource\.org/licenses?/nokia
nosl | NOSL | netizen open source license | bits\.netizen\.com\.au/licenses
npl | NPL-1\.[01] | netscape public license | mozilla\.org/mpl/npl
npol | NPOSL-3\.0 | non-profit open software license | opensource\.org/licenses?/nposl
ntp | NTP | ntp license | opensource\.org/licenses?/ntp
oclc | OCLC-2\.0 | oclc research public license | opensource\.org/licenses?/oclc2
odbl | ODbL-1\.0 | open database license | opendatacommons\.org/licenses/odbl
odc-by | ODC-By-1\.0 | open data commons attribution license | opendatacommons\.org/licenses/by
ofl | OFL-1\.[01] | sil open font license | scripts\.sil\.org/ofl
ogl | OGL-UK-[123]\.0 | open government licen[sc]e | nationalarchives\.gov\.uk/doc/open-government-licence
ogtsl | OGTSL | open group test suite license | opensource\.org/licenses?/opengroup
oldap | OLDAP-[0-9.]+ | openldap public license | openldap\.org/software/release/license
openssl | OpenSSL | (?:openssl license|openssl toolkit) | openssl\.org/source/license
opl | OPL-1\.0 | open publication license | opencontent\.org/openpub
osl | OSL-[123]\.[0-9] | open software license(?:,? (?:version|v\.?) ?[123]\.[0-9])? | opensource\.org/licenses?/osl
pddl | PDDL-1\.0 | public domain dedication (?:and|&) license | opendatacommons\.org/licenses/pddl
php | PHP-3\.0[1]? | php license(?:,? version 3\.[0-9]+)? | php\.net/license
polyform | PolyForm-[a-z]+(?:-[a-z]+)*-1\.0\.0 | polyform (?:noncommercial|small business|strict|shield) license | polyformproject\.org/licenses
postgres | PostgreSQL | postgresql licen[sc]e | postgresql\.org/about/licence
psf | (?:PSF|Python)-2\.0 | python software foundation license | docs\.python\.org/.{0,12}license
qpl | QPL-1\.0 | q public license | opensource\.org/licenses?/qtpl
rpl | RPL-1\.[15] | reciprocal public license | opensource\.org/licenses?/rpl
rpsl | RPSL-1\.0 | realnetworks public source license | opensource\.org/licenses?/real
rscpl | RSCPL | ricoh source code public license | opensource\.org/licenses?/ricoh
ruby | Ruby | (?:the )?ruby license | ruby-lang\.org/.{0,12}license
saxpath | Saxpath | saxpath license | fedoraproject\.org/wiki/licensing/saxpath
sgi | SGI-B-[12]\.[01] | sgi free software license b | oss\.sgi\.com/projects/freeb
simpl | SimPL-2\.0 | simple public license | opensource\.org/licenses?/simpl
sissl | SISSL(?:-1\.2)? | sun industry standards source license | opensource\.org/licenses?/sisslpl
sleepycat | Sleepycat | sleepycat (?:public )?license | opensource\.org/licenses?/sleepycat
spl | SPL-1\.0 | sun public license | opensource\.org/licenses?/sunpublic
sspl | SSPL-1\.0 | server side public license | mongodb\.com/licensing/server-side-public-license
tcl | TCL | tcl/tk license | tcl\.tk/software/tcltk/license
unicode | Unicode-(?:DFS-201[56]|TOU|3\.0) | unicode (?:license agreement|terms of use) | unicode\.org/(?:copyright|license)
unlicense | Unlicense | free and unencumbered software released into the public domain | unlicense\.org
upl | UPL-1\.0 | universal permissive license | opensource\.org/licenses?/upl
vim | Vim | vim license | vimhelp\.org/uganda
vsl | VSL-1\.0 | vovida software license | opensource\.org/licenses?/vovidapl
w3c | W3C(?:-[0-9]+)? | w3c software (?:notice and )?(?:and document )?license | w3\.org/consortium/legal/.{0,20}copyright-software
watcom | Watcom-1\.0 | sybase open watcom public license | opensource\.org/licenses?/watcom
wtfpl | WTFPL | do what the f[u*]ck you want to public license | wtfpl\.net
x11 | X11 | x11 license | xfree86\.org/.{0,12}license
xnet | Xnet | x\.net license | opensource\.org/licenses?/xnet
zend | Zend-2\.0 | zend (?:engine )?license | zend\.com/license
zlib | Zlib | zlib(?:/libpng)? license | zlib\.net/zlib_license
zpl | ZPL-[12]\.[01] | zope public license | opensource\.org/licenses?/zpl
"""

# Rules of a single pattern: label | priority | pattern.
_SINGLE = r"""
reserved | 2 | all rights? reserved
reserved | 1 | (?:tous droits r[eé]serv[eé]s|todos los derechos reservados|alle rechte vorbehalten|tutti i diritti riservati)
copyright | 1 | copyright (?:\(c\)|©)? ?(?:[12][0-9]{3}(?: ?[-–,] ?[12][0-9]{3})*)
copyright | 1 | © ?[12][0-9]{3}
copyright | 1 | \(c\) [12][0-9]{3}
public-domain | 2 | (?:released|placed|dedicated) (?:in)?to the public domain
public-domain | 1 | (?:is|are) (?:in )?the public domain
mit | 3 | permission is hereby granted, free of charge, to any person obtaining a copy
bsd-3 | 3 | redistribution and use in source and binary forms, with or without modification
isc | 3 | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee
gpl | 3 | this program is free software[;:,] you can redistribute it and/or modify it
lgpl | 3 | this library is free software[;:,] you can redistribute it and/or modify it
apache | 3 | licensed under the apache license
mpl | 3 | this source code form is subject to the terms of the mozilla public license
zlib | 3 | this software is provided 'as-is', without any express or implied warranty
proprietary | 2 | (?:confidential and proprietary|proprietary and confidential)
proprietary | 1 | unauthori[sz]ed (?:copying|reproduction|use|distribution) .{0,60}(?:prohibited|forbidden)
proprietary | 1 | may not be (?:reproduced|copied|redistributed|republished)
noncommercial | 1 | for (?:personal|non[- ]?commercial|educational) use only
license | 0 | spdx-license-identifier: ?[a-z0-9.+-]+
license | 0 | licensed under (?:the )?(?:terms of )?[a-z0-9 .-]{2,40}licen[sc]e
license | 0 | (?:see|under) the license for (?:more|specific) (?:details|language)
cc-by | 2 | \b(?:cc by|cc-by)(?:[ -][1-4]\.[0-9])?\b
cc-by-sa | 3 | \b(?:cc by|cc-by)[ -]sa\b
cc-by-nc | 3 | \b(?:cc by|cc-by)[ -]nc\b
cc-by-nd | 3 | \b(?:cc by|cc-by)[ -]nd\b
"""


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    pattern: re.Pattern
    keywords: tuple[str, ...]


def _plain(pattern: str) -> str:
    """The longest run of plain characters that every match must hold: what lies outside groups, classes and optional parts."""
    p = re.sub(r"\\([./*-])", lambda m: "\x01" if m[1] == "." else m[1] if m[1] != "*" else "\x00", re.sub(r"\\[()b?]", "\x00", pattern))
    while (q := re.sub(r"\([^()]*\)[?*+]?|\[[^\]]*\](?:[?*+]|\{[^}]*\})?|[^\x00)\]]\?|\.\{[^}]*\}", "\x00", p)) != p:
        p = q
    return max((x.replace("\x01", ".") for x in re.split(r"[\x00{}|+*?^$\\]", p)), key=len).strip()


def _keywords(pattern: str) -> tuple[str, ...]:
    """Keywords of which each match holds at least one: a run outside groups, or else one for each branch of the first group."""
    if len(key := _plain(pattern)) >= 4:
        return (key,)
    group = re.search(r"\(\?:([^()]*)\)", pattern)
    branches = tuple(_plain(x) for x in group[1].split("|")) if group else ()
    return branches if branches and min(map(len, branches)) >= 3 else (key,)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules: first those of the families, then the single ones."""
    made: list[tuple[str, int, str]] = []
    for line in _FAMILIES.strip().splitlines():
        label, spdx, title, address = (x.strip() for x in line.split(" | "))
        made += [(label, 4, rf"\b{title}"), (label, 2, address), (label, 1, rf"spdx-license-identifier: ?{spdx.lower()}\b")]
    for line in _SINGLE.strip().splitlines():
        label, priority, pattern = (x.strip() for x in line.split(" | ", 2))
        made.append((label, int(priority), pattern))
    return tuple(Rule(label, priority, re.compile(p), _keywords(p)) for label, priority, p in made)


@cache
def _gate() -> tuple[ahocorasick.Automaton, tuple[int, ...]]:
    auto, by, always = ahocorasick.Automaton(), {}, []
    for i, r in enumerate(rules()):
        if min(map(len, r.keywords)) < 3:
            always.append(i)
        else:
            for k in r.keywords:
                by.setdefault(k, []).append(i)
    for k, found in by.items():
        auto.add_word(k, tuple(found))
    auto.make_automaton()
    return auto, tuple(always)


def suppress(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(start, end, priority, label): without those that lie within another of at least their priority (the earlier of equals stays).

    By falling priority, each is kept unless one kept before it begins no later and ends no earlier; a tree of the furthest
    ends by start answers that, so the time grows with n log n.
    """
    starts = sorted({x[0] for x in found})
    furthest = [-1] * (len(starts) + 1)
    kept: list[tuple[int, int, int, str]] = []
    for x in sorted(found, key=lambda x: (-x[2], x[0], -x[1], x[3])):
        place = i = bisect_left(starts, x[0]) + 1
        end = -1
        while i > 0:
            end = max(end, furthest[i])
            i &= i - 1
        if end >= x[1]:
            continue
        kept.append(x)
        while place <= len(starts):
            furthest[place] = max(furthest[place], x[1])
            place += place & -place
    return sorted(kept)


def detections(text: str) -> list[tuple[int, int, int, str]]:
    """Spans that the rules find in a text, after suppression."""
    low = " ".join(text.lower().split())
    auto, always = _gate()
    due = set(always)
    for _, found in auto.iter(low):
        due.update(found)
    return suppress([(m.start(), m.end(), rules()[i].priority, rules()[i].label) for i in sorted(due) for m in rules()[i].pattern.finditer(low)])


_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def base_places(text: str) -> tuple[int, list[tuple[int, str]]]:
    """Number of words, and (first word, label) of each place of a base phrase."""
    plain = text.encode("utf-8", "replace").translate(_WORDS)
    words = plain.split()
    joined = None
    places = []
    for phrase, label in BASE:
        want = phrase.encode().split()
        if not all(w in plain for w in want):
            continue
        if joined is None:
            joined = b" " + b" ".join(words) + b" "
        needle = b" " + b" ".join(want) + b" "
        at, word, seen = joined.find(needle), 0, 0
        while at >= 0:
            word += joined.count(b" ", seen, at)
            seen = at
            places.append((word, label))
            at = joined.find(needle, at + 1)
    return len(words), sorted(places)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:start-end over the
    lower-cased text with white space folded): one row for each input row. score: 1 - 0.5**(evidence), where a base place
    or a detection of priority p adds 1 or (p + 1) / 2; 0 without any."""

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                n, places = base_places(t or "")
                spans = detections(t or "")
                base = sorted({label for _, label in places})
                evidence = len(places) + sum((p + 1) / 2 for _, _, p, _ in spans)
                out.append((n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(sorted({*base, *(x[3] for x in spans)})), 1 - 0.5**evidence, " ".join(f"{x[3]}:{x[0]}-{x[1]}" for x in spans)))
            frame = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    prepare(docs.sparkSession)
    return docs.select("doc_id", scan("text").alias("_s")).select("doc_id", "_s.*")
