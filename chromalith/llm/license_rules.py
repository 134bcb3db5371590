"""Signatures of licences: ordered rules, written by hand over normalised words.

A line is `label priority regex`. A regex runs over words of [a-z0-9] (A-Z lower-cased) and other letters with one space
between; it starts with a plain word, or a choice of plain words, which is its anchor, and ends at the end of a word. Every repetition is
bounded. Priority 4: tags and grants, 3: names with a version, 2: names, 1: short names and mentions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

CONFIDENCE = {4: 0.95, 3: 0.85, 2: 0.7, 1: 0.4}
#: No signature is longer, in words.
WINDOW = 40

#: Phrases whose every place counts, with their labels.
BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))

SIGNATURES = r"""
gpl-1.0 4 spdx license identifier gpl 1 0( only| or later)?
gpl-2.0 4 spdx license identifier gpl 2 0( only| or later)?
gpl-3.0 4 spdx license identifier gpl 3 0( only| or later)?
gpl-2.0 4 (?:licensed|released|distributed|available) under( the terms of)? the gnu general public licen[cs]e (version |v )?2( 0)?
gpl-3.0 4 (?:licensed|released|distributed|available) under( the terms of)? the gnu general public licen[cs]e (version |v )?3( 0)?
gpl 4 (?:licensed|released|distributed|available) under( the terms of)? the (gnu )?(gpl|general public licen[cs]e)
gpl 4 redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation
gpl-2.0-or-later 4 redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
gpl-3.0-or-later 4 redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
gpl 4 received a copy of the gnu general public licen[cs]e along with( [^ ]+){1,3}
gpl-1.0 3 gnu general public licen[cs]e (version |v )?1( 0)?
gpl-2.0 3 gnu general public licen[cs]e (version |v )?2( 0)?
gpl-3.0 3 gnu general public licen[cs]e (version |v )?3( 0)?
gpl-2.0 3 gnu gpl (version |v )?2( 0)?
gpl-3.0 3 gnu gpl (version |v )?3( 0)?
gpl-2.0 3 gpl (version |v )?2( 0)?( only| or later)?
gpl-3.0 3 gpl (version |v )?3( 0)?( only| or later)?
gpl-2.0 3 (?:gplv2|gpl2)( only| or later)?
gpl-3.0 3 (?:gplv3|gpl3)( only| or later)?
gpl 2 gnu general public licen[cs]e
gpl 2 general public licen[cs]e
gpl 1 gnu gpl
gpl 1 gpl( compatible)?( licensed?)?
gpl-exception 3 gpl( with)?( [^ ]+){0,2} (linking|classpath|runtime) exception
gpl-exception 3 classpath exception 2 0
gpl-exception 2 gcc runtime library exception
lgpl-2.0 4 spdx license identifier lgpl 2 0( only| or later)?
lgpl-2.1 4 spdx license identifier lgpl 2 1( only| or later)?
lgpl-3.0 4 spdx license identifier lgpl 3 0( only| or later)?
lgpl 4 (?:licensed|released|distributed|available) under( the terms of)? the (gnu )?(lgpl|(lesser|library) general public licen[cs]e)
lgpl 4 redistribute it and or modify it under the terms of the gnu (lesser|library) general public licen[cs]e as published by the free software foundation
lgpl-2.1 3 gnu (lesser|library) general public licen[cs]e (version |v )?2 1
lgpl-2.0 3 gnu (lesser|library) general public licen[cs]e (version |v )?2( 0)?
lgpl-3.0 3 gnu (lesser|library) general public licen[cs]e (version |v )?3( 0)?
lgpl-2.1 3 lgpl (version |v )?2 1( only| or later)?
lgpl-3.0 3 lgpl (version |v )?3( 0)?( only| or later)?
lgpl-2.1 3 lgplv2 1
lgpl-3.0 3 (?:lgplv3|lgpl3)
lgpl 2 (?:lesser|library) general public licen[cs]e
lgpl 2 gnu (lesser|library) general public licen[cs]e
lgpl 1 lgpl
agpl-3.0 4 spdx license identifier agpl 3 0( only| or later)?
agpl 4 (?:licensed|released|distributed|available) under( the terms of)? the (gnu )?(agpl|affero general public licen[cs]e)
agpl-3.0 4 redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation either version 3
agpl-3.0 3 gnu affero general public licen[cs]e (version |v )?3( 0)?
agpl-3.0 3 agpl (version |v )?3( 0)?
agpl-3.0 3 (?:agplv3|agpl3)
agpl 2 gnu affero general public licen[cs]e
agpl 2 affero general public licen[cs]e
agpl 1 agpl
gfdl-1.2 3 gnu free documentation licen[cs]e (version |v )?1 2
gfdl-1.3 3 gnu free documentation licen[cs]e (version |v )?1 3
gfdl 4 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl 2 gnu free documentation licen[cs]e
gfdl 1 gfdl
gnu-all-permissive 4 copying and distribution of this file with or without modification are permitted in any medium without royalty
apache-2.0 4 spdx license identifier apache 2 0
apache-1.1 4 spdx license identifier apache 1 1
apache-2.0 4 licensed under the apache licen[cs]e (version |v )?2( 0)?
apache-2.0 4 licensed under the apache licen[cs]e version 2 0 the license you may not use this file except in compliance with the license
apache 4 (?:licensed|released|distributed|available) under( the terms of)? the apache( software)? licen[cs]e
apache-2.0 4 apache org licenses license 2 0
apache-2.0 3 apache( software)? licen[cs]e (version |v )?2( 0)?
apache-1.1 3 apache( software)? licen[cs]e (version |v )?1 1
apache-1.0 3 apache( software)? licen[cs]e (version |v )?1 0
apache-2.0 3 apache (v )?2 0( licen[cs]ed?)?
apache-2.0 3 asl 2 0
apache 2 apache software licen[cs]e
apache 2 apache licen[cs]e
apache 1 apache licensed
mit 4 spdx license identifier mit
mit-0 4 spdx license identifier mit 0
mit 4 (?:licensed|released|distributed|available|published) under( the terms of)?( the)? (mit|expat) licen[cs]e
mit 4 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 4 above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 4 opensource org licenses mit( license)?
mit-0 3 mit no attribution( licen[cs]e)?
mit 2 mit licen[cs]e
mit 2 expat licen[cs]e
mit 2 mit x11 licen[cs]e
mit 1 mit (licensed|style|compatible)
x11 4 spdx license identifier x11
x11 2 x11 licen[cs]e
isc 4 spdx license identifier isc
isc 4 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 4 (?:licensed|released|distributed|available) under( the terms of)? the isc licen[cs]e
isc 2 isc licen[cs]e
bsd-2-clause 4 spdx license identifier bsd 2 clause
bsd-3-clause 4 spdx license identifier bsd 3 clause
bsd-4-clause 4 spdx license identifier bsd 4 clause
0bsd 4 spdx license identifier 0bsd
bsd 4 redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd 4 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 4 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause 4 neither the name of( [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause 4 advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd 4 (?:licensed|released|distributed|available) under( the terms of)? (the|a) bsd( style)? licen[cs]e
bsd-2-clause 3 bsd 2 clause( licen[cs]e)?
bsd-3-clause 3 bsd 3 clause( licen[cs]e)?
bsd-4-clause 3 bsd 4 clause( licen[cs]e)?
bsd-2-clause 3 (?:2|two) clause bsd( licen[cs]e)?
bsd-3-clause 3 (?:3|three) clause bsd( licen[cs]e)?
bsd-2-clause 2 (?:simplified|freebsd) bsd licen[cs]e
bsd-3-clause 2 (?:new|modified|revised) bsd licen[cs]e
0bsd 2 zero clause bsd( licen[cs]e)?
bsd 2 bsd licen[cs]e
bsd 1 bsd (licensed|style)
mpl-1.0 4 spdx license identifier mpl 1 0
mpl-1.1 4 spdx license identifier mpl 1 1
mpl-2.0 4 spdx license identifier mpl 2 0
mpl-2.0 4 subject to the terms of the mozilla public licen[cs]e (version |v )?2 0
mpl-1.1 4 subject to the mozilla public licen[cs]e version 1 1
mpl-2.0 4 mozilla org mpl 2 0
mpl-2.0 3 mozilla public licen[cs]e (version |v )?2( 0)?
mpl-1.1 3 mozilla public licen[cs]e (version |v )?1 1
mpl-2.0 3 mpl (version |v )?2 0
mpl 2 mozilla public licen[cs]e
epl-1.0 4 spdx license identifier epl 1 0
epl-2.0 4 spdx license identifier epl 2 0
epl-1.0 3 eclipse public licen[cs]e (version |v )?1( 0)?
epl-2.0 3 eclipse public licen[cs]e (version |v )?2( 0)?
edl-1.0 3 eclipse distribution licen[cs]e( version| v)?( 1 0)?
epl 2 eclipse public licen[cs]e
cddl-1.0 4 spdx license identifier cddl 1 0
cddl-1.1 4 spdx license identifier cddl 1 1
cddl-1.0 3 common development and distribution licen[cs]e (version |v )?1 0
cddl-1.1 3 common development and distribution licen[cs]e (version |v )?1 1
cddl 2 common development and distribution licen[cs]e
cddl 1 cddl
cpl-1.0 2 common public licen[cs]e( version| v)?( 1 0)?
eupl-1.1 4 spdx license identifier eupl 1 1
eupl-1.2 4 spdx license identifier eupl 1 2
eupl-1.2 3 european union public licen[cs]e (version |v )?1 2
eupl 2 european union public licen[cs]e
eupl 1 eupl
osl-3.0 3 open software licen[cs]e (version |v )?3( 0)?
osl 2 open software licen[cs]e
afl-3.0 3 academic free licen[cs]e (version |v )?3( 0)?
afl 2 academic free licen[cs]e
artistic-1.0 3 artistic licen[cs]e (version |v )?1( 0)?
artistic-2.0 3 artistic licen[cs]e (version |v )?2( 0)?
artistic-2.0 4 spdx license identifier artistic 2 0
artistic 2 artistic licen[cs]e
perl 4 terms as perl( 5)?( itself)?
ruby 2 ruby s? ?licen[cs]e
php-3.01 3 php licen[cs]e (version |v )?3 01
php 2 php licen[cs]e
psf-2.0 4 spdx license identifier psf 2 0
psf 2 python software foundation licen[cs]e( version 2)?
zlib 4 spdx license identifier zlib
zlib 4 altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib 4 provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising
zlib 2 zlib( libpng)? licen[cs]e
bsl-1.0 4 spdx license identifier bsl 1 0
bsl-1.0 4 distributed under the boost software licen[cs]e( version 1 0)?
bsl-1.0 2 boost software licen[cs]e( version 1 0| v1 0)?
unlicense 4 spdx license identifier unlicense
unlicense 4 unencumbered software released into the public domain
unlicense 2 unlicense
wtfpl 4 spdx license identifier wtfpl
wtfpl 4 fuck you want to public licen[cs]e
wtfpl 1 wtfpl
beerware 2 beer ?ware licen[cs]e
ncsa 4 spdx license identifier ncsa
ncsa 2 ncsa( open source)? licen[cs]e
ncsa 2 university of illinois( ncsa)? open source licen[cs]e
postgresql 2 postgresql licen[cs]e
upl-1.0 3 universal permissive licen[cs]e( version| v)?( 1 0)?
ms-pl 2 microsoft public licen[cs]e
ms-rl 2 microsoft reciprocal licen[cs]e
openssl 2 openssl licen[cs]e
ofl-1.1 4 licensed under the sil open font licen[cs]e( version 1 1)?
ofl-1.1 4 spdx license identifier ofl 1 1
ofl-1.1 2 sil open font licen[cs]e( version 1 1)?
ofl-1.1 2 open font licen[cs]e
cc0-1.0 4 spdx license identifier cc0 1 0
cc0-1.0 4 creativecommons org publicdomain zero 1 0
cc0-1.0 3 cc0 1 0( universal)?
cc0-1.0 2 creative commons zero( v1 0| 1 0)?
cc0-1.0 1 cc0
cc-by-3.0 4 creativecommons org licenses by 3 0
cc-by-4.0 4 creativecommons org licenses by 4 0
cc-by-sa-3.0 4 creativecommons org licenses by sa 3 0
cc-by-sa-4.0 4 creativecommons org licenses by sa 4 0
cc-by-nc-4.0 4 creativecommons org licenses by nc 4 0
cc-by-nd-4.0 4 creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 4 creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 4 creativecommons org licenses by nc nd 4 0
cc-by-3.0 3 cc by (v )?3 0
cc-by-4.0 3 cc by (v )?4 0
cc-by-sa-3.0 3 cc by sa (v )?3 0
cc-by-sa-4.0 3 cc by sa (v )?4 0
cc-by-nc-3.0 3 cc by nc (v )?3 0
cc-by-nc-4.0 3 cc by nc (v )?4 0
cc-by-nd-4.0 3 cc by nd (v )?4 0
cc-by-nc-sa-3.0 3 cc by nc sa (v )?3 0
cc-by-nc-sa-4.0 3 cc by nc sa (v )?4 0
cc-by-nc-nd-4.0 3 cc by nc nd (v )?4 0
cc-by 4 (?:licensed|released|distributed|available|published) under( a| the)? (cc by|creative commons attribution( licen[cs]e)?)
cc-by-sa 2 cc by sa
cc-by-nc 2 cc by nc
cc-by-nd 2 cc by nd
cc-by-nc-sa 2 cc by nc sa
cc-by-nc-nd 2 cc by nc nd
cc-by 1 cc by
cc-by-sa 3 creative commons attribution share ?alike( licen[cs]e)?( 3 0| 4 0)?( international| unported)?
cc-by-nc-sa 3 creative commons attribution non ?commercial share ?alike( licen[cs]e)?( 3 0| 4 0)?( international| unported)?
cc-by-nc-nd 3 creative commons attribution non ?commercial no ?deriv(ative)?s( licen[cs]e)?( 3 0| 4 0)?( international| unported)?
cc-by-nc 3 creative commons attribution non ?commercial( licen[cs]e)?( 3 0| 4 0)?( international| unported)?
cc-by-nd 3 creative commons attribution no ?deriv(ative)?s( licen[cs]e)?( 3 0| 4 0)?( international| unported)?
cc-by 2 creative commons attribution( licen[cs]e)?( 3 0| 4 0)?( international| unported)?
cc 1 creative commons( licen[cs]e)?
odbl-1.0 3 open (data commons open )?database licen[cs]e( v1 0| 1 0)?
odc-by-1.0 3 open data commons attribution licen[cs]e( v1 0| 1 0)?
pddl-1.0 3 (?:open|odc) (data commons )?public domain dedication and licen[cs]e
ogl-uk-3.0 3 open government licen[cs]e v?3( 0)?
ogl 2 open government licen[cs]e
etalab-2.0 2 licence ouverte( version 2 0| 2 0)?
cecill-2.1 3 cecill (version |v )?2 1
cecill 1 cecill
dl-de-by-2.0 3 datenlizenz deutschland namensnennung( version)? 2 0
public-domain 4 (?:released|placed|dedicated) (into|in|to) the public domain
public-domain 2 public domain dedication
public-domain 1 public domain
sspl-1.0 4 spdx license identifier sspl 1 0
sspl-1.0 2 server side public licen[cs]e( version 1| v1)?
busl-1.1 4 spdx license identifier busl 1 1
busl-1.1 2 business source licen[cs]e( version)?( 1 1)?
elastic-2.0 2 elastic licen[cs]e( version| v)?( 2 0)?
commons-clause 2 commons clause( licen[cs]e condition)?
polyform 2 polyform (noncommercial|small business|strict|perimeter|shield) licen[cs]e
openrail 2 (?:bigscience|creativeml) (open ?rail|rail)( [^ ]+)?( licen[cs]e)?
llama 2 llama( 2| 3)? community licen[cs]e( agreement)?
blueoak-1.0.0 2 blue oak model licen[cs]e( 1 0 0)?
vim 2 vim licen[cs]e
curl 2 curl licen[cs]e
json 4 software shall be used for good not evil
json 2 json licen[cs]e
w3c 2 w3c software( and document)?( notice and)? licen[cs]e
unicode 2 unicode( data files and software)? licen[cs]e
ipl-1.0 2 ibm public licen[cs]e( version)?( 1 0)?
ibm-pibs 1 ibm licensed materials
sleepycat 2 sleepycat licen[cs]e
qpl-1.0 2 q public licen[cs]e( version)?( 1 0)?
npl-1.1 2 netscape public licen[cs]e( version)?( 1 1)?
apsl-2.0 2 apple public source licen[cs]e( version)?( 2 0)?
lppl-1.3c 2 latex project public licen[cs]e( version)?( 1 3c?)?
proprietary 4 rights reserved( [^ ]+){0,4} unauthori[sz]ed (copying|use|reproduction)( [^ ]+){0,8} (is )?(strictly )?prohibited
proprietary 2 (?:proprietary|confidential) and (confidential|proprietary)
proprietary 1 rights reserved
commercial 2 commercial licen[cs]e( agreement)?
eula 2 end user licen[cs]e agreement
non-commercial 2 noncommercial (use|purposes) only
non-commercial 2 non commercial (use|purposes) only
research-only 2 research (use|purposes) only
free-unknown 1 free software licen[cs]e
open-unknown 1 open source licen[cs]e
unknown-reference 1 (?:licensed|released|distributed) under( the terms of)? (the|a|an)( [^ ]+){1,5}? licen[cs]e
unknown-reference 1 accompanying licen[cs]e( file| txt| md)?
"""


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    priority: int
    regex: str
    anchors: tuple[str, ...]
    keyword: str
    base: bool = False


def make_rule(number: int, label: str, priority: int, regex: str, base: bool = False) -> Rule:
    """Anchors are the words that a match can start with; the keyword is the longest word that every match has."""
    start = re.match(r"\(\?:([a-z0-9|]+)\)(?= |$|\()|([a-z0-9]+)(?= |$|\()", regex)
    if not start:
        raise ValueError(f"{regex!r} does not start with plain words")
    plain, before = re.sub(r"[^ ]+ \?[^ ]+", "?", regex), ""  # words that may stand together
    while plain != before:
        plain, before = re.sub(r"\([^()]*\)", "?", plain), plain
    certain = [w for w in plain.split(" ") if re.fullmatch("[a-z0-9]+", w)]
    anchors = tuple((start[1] or start[2]).split("|"))
    return Rule(number, label, priority, regex, anchors, max(certain, key=lambda w: (w not in anchors, len(w)), default=""), base)


def _rules() -> tuple[Rule, ...]:
    lines = [line.split(" ", 2) for line in SIGNATURES.strip().splitlines()]
    table = [(label, 1, phrase, True) for label, phrase in BASE] + [(label, int(p), regex, False) for label, p, regex in lines]
    return tuple(make_rule(n, *row) for n, row in enumerate(table))


RULES = _rules()
