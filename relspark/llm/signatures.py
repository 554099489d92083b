"""The signatures of the license scan, in their order: rules of one priority that find the same place are decided by it.

A line is: label, score, priority, pattern. A space in a pattern is a run of separators (anything but
digits, a-z and bytes beyond ASCII), so a statement may stand on several lines of a comment. A match
begins and ends at the edge of a word. {grant} is a way of putting something under a license. Priorities:
90 tags, 80 sentences of the licenses themselves, 70 grants, 60 names with a version, 50 names, 30 mentions.
"""

from __future__ import annotations

#: Ways of putting something under a license, up to the license's name.
GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided|offered|shared|used|copied|covered|governed|code|made|is|are|it|dual) (?:under|by) (?:either )?(?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?(?:an? )?"

SIGNATURES = r"""
mit             1.0 80 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit             0.9 80 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit             0.7 80 the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit             1.0 70 {grant}mit(?: x11)? licen[cs]e
mit             1.0 70 {grant}mit
mit             1.0 70 {grant}expat licen[cs]e
mit             0.9 60 licen[cs]e mit
mit             0.8 50 (?:the )?mit(?: expat)? licen[cs]e
mit             0.8 50 (?:the )?expat licen[cs]e
mit             0.6 30 mit licensed
mit-0           1.0 60 mit no attribution
x11             0.9 50 (?:the )?x11 licen[cs]e
x11             0.8 80 except as contained in this notice the name of the x consortium shall not be used in advertising
apache-2        1.0 80 licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2        0.9 80 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2        0.9 80 apache license version 2 0 january 2004
apache-2        1.0 70 {grant}apache(?: software)? licen[cs]e,? v(?:ersion|\.)? ?2(?: 0)?
apache-2        1.0 70 {grant}apache ?2(?: 0)?
apache-2        0.8 60 apache(?: software)? licen[cs]e v(?:ersion)? ?2(?: 0)?
apache-2        0.8 60 apache(?: software)? licen[cs]e 2(?: 0)?
apache-2        0.8 60 apache ?2(?: 0)? licen[cs]e
apache-2        0.6 60 asl 2 0
apache-2        0.7 50 www apache org licenses license 2 0
apache-1.1      0.9 60 apache(?: software)? licen[cs]e v(?:ersion)? ?1 1
apache-1.1      0.9 80 this product includes software developed by the apache software foundation
apache-1        0.9 60 apache(?: software)? licen[cs]e v(?:ersion)? ?1 0
apache          0.5 50 apache(?: software)? licen[cs]e
bsd             0.9 80 redistribution and use in source and binary forms with or without modification are permitted
bsd-2           0.8 80 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd-3           1.0 80 neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4           1.0 80 all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2           1.0 60 (?:2|two) clause bsd(?: licen[cs]e)?
bsd-2           1.0 60 bsd (?:2|two) clause(?: licen[cs]e)?
bsd-2           0.9 60 simplified bsd(?: licen[cs]e)?
bsd-2           0.9 60 freebsd licen[cs]e
bsd-3           1.0 60 (?:3|three) clause bsd(?: licen[cs]e)?
bsd-3           1.0 60 bsd (?:3|three) clause(?: licen[cs]e)?
bsd-3           0.9 60 (?:new|revised|modified) bsd(?: licen[cs]e)?
bsd-4           0.9 60 (?:4|four) clause bsd(?: licen[cs]e)?
bsd-4           0.9 60 bsd (?:4|four) clause(?: licen[cs]e)?
0bsd            1.0 60 (?:zero|0) clause bsd(?: licen[cs]e)?
0bsd            0.9 60 bsd zero clause(?: licen[cs]e)?
bsd             1.0 70 {grant}(?:a )?bsd(?: style)?(?: licen[cs]e)?
bsd             0.7 50 bsd(?: style)? licen[cs]e
bsd             0.6 50 licen[cs]e bsd
bsd             0.4 30 bsd licensed
bsd-patent      0.9 50 bsd 2 clause plus patent licen[cs]e
isc             1.0 80 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc             1.0 70 {grant}isc licen[cs]e
isc             0.8 50 isc licen[cs]e
isc             0.8 50 licen[cs]e isc
zlib            1.0 80 this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib            0.9 80 altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib            0.8 50 zlib(?: libpng)? licen[cs]e
zlib            0.8 50 licen[cs]e zlib
libpng          0.8 50 libpng licen[cs]e
gpl             0.8 80 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl             0.7 80 you should have received a copy of the gnu general public license along with this program
gpl-1           0.9 60 gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? \(?v(?:ersion)? ?1
gpl-2           1.0 60 gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?2(?: 0)?
gpl-3           1.0 60 gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?3(?: 0)?
gpl-2           0.9 80 gnu general public license version 2 june 1991
gpl-3           0.9 80 gnu general public license version 3 29 june 2007
gpl-2           0.9 60 gnu gpl v(?:ersion)? ?2(?: 0)?
gpl-3           0.9 60 gnu gpl v(?:ersion)? ?3(?: 0)?
gpl-2           0.9 60 gplv2(?: 0)?(?:\+)?
gpl-3           0.9 60 gplv3(?: 0)?(?:\+)?
gpl-2           0.8 60 gpl v(?:ersion)? ?2(?: 0)?
gpl-3           0.8 60 gpl v(?:ersion)? ?3(?: 0)?
gpl             0.7 50 (?:gnu )?general public licen[cs]e
gpl             0.9 70 {grant}(?:gnu )?gpl
gpl             0.6 50 gnu gpl
gpl             0.6 50 gpl licen[cs]e
gpl             0.5 30 gpl licensed
gpl-2           0.8 30 linux syscall note gpl 2
lgpl            0.8 80 you should have received a copy of the gnu lesser general public license along with this library
lgpl-2          0.9 60 gnu library general public licen[cs]e v(?:ersion)? ?2(?: 0)?
lgpl-2.1        1.0 60 gnu lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?2 1
lgpl-3          1.0 60 gnu lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?3(?: 0)?
lgpl-2.1        0.9 60 lgplv2 1(?:\+)?
lgpl-3          0.9 60 lgplv3(?: 0)?(?:\+)?
lgpl-2.1        0.9 60 lgpl v(?:ersion)? ?2 1
lgpl-3          0.9 60 lgpl v(?:ersion)? ?3
lgpl            0.9 70 {grant}(?:gnu )?lgpl
lgpl            0.7 50 gnu (?:lesser|library) general public licen[cs]e
lgpl            0.6 50 gnu lgpl
lgpl            0.6 50 lgpl licen[cs]e
agpl-3          1.0 60 gnu affero general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?3(?: 0)?
agpl-3          0.9 60 agplv3(?: 0)?(?:\+)?
agpl-3          0.9 60 agpl v(?:ersion)? ?3
agpl            0.9 70 {grant}(?:gnu )?agpl
agpl            0.7 50 gnu affero general public licen[cs]e
agpl            0.6 50 affero general public licen[cs]e
mpl-2           1.0 80 this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2           0.9 60 mozilla public licen[cs]e v(?:ersion|\.)? ?2(?: 0)?
mpl-2           0.9 60 mozilla public licen[cs]e 2 0
mpl-1.1         1.0 80 the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1         0.9 60 mozilla public licen[cs]e v(?:ersion|\.)? ?1 1
mpl-2           0.8 60 mplv2(?: 0)?
mpl             0.6 50 mozilla public licen[cs]e
epl-2           1.0 80 this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl-2           0.9 60 eclipse public licen[cs]e v(?:ersion|\.)? ?2(?: 0)?
epl-2           0.9 60 eclipse public licen[cs]e 2 0
epl-1           1.0 80 this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-1           0.9 60 eclipse public licen[cs]e v(?:ersion|\.)? ?1(?: 0)?
epl-1           0.9 60 eclipse public licen[cs]e 1 0
epl             0.6 50 eclipse public licen[cs]e
edl-1           0.9 50 eclipse distribution licen[cs]e
eupl-1.2        0.9 60 european union public licen[cs]e v(?:ersion|\.)? ?1 2
eupl-1.2        0.8 60 eupl v(?:ersion)? ?1 2
eupl            0.7 50 european union public licen[cs]e
cddl-1          0.9 80 the contents of this file are subject to the terms of the common development and distribution license
cddl-1          0.9 60 common development and distribution licen[cs]e(?: v(?:ersion|\.)? ?1 [01])?
cddl-1          0.8 50 cddl licen[cs]e
cpl-1           0.9 60 common public licen[cs]e(?: v(?:ersion|\.)? ?1(?: 0)?)?
ipl-1           0.9 60 ibm public licen[cs]e(?: v(?:ersion|\.)? ?1(?: 0)?)?
artistic-2      1.0 60 artistic licen[cs]e v(?:ersion|\.)? ?2(?: 0)?
artistic-2      1.0 60 artistic licen[cs]e 2 0
artistic-1      0.9 60 artistic licen[cs]e v(?:ersion|\.)? ?1(?: 0)?
artistic        0.6 50 artistic licen[cs]e
perl            0.8 80 you can redistribute it and or modify it under the same terms as perl itself
perl            0.7 50 same terms as perl itself
python-2        1.0 80 python software foundation license version 2
python-2        0.8 60 python software foundation licen[cs]e
python-2        0.7 50 psf licen[cs]e
ruby            0.7 50 ruby licen[cs]e
ruby            0.6 50 (?:under )?the same terms as ruby
php-3           0.9 60 php licen[cs]e v(?:ersion|\.)? ?3(?: 0[01])?
php-3           0.6 50 the php licen[cs]e
postgresql      0.9 80 permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
postgresql      0.8 50 postgresql licen[cs]e
unlicense       1.0 80 this is free and unencumbered software released into the public domain
unlicense       0.8 50 (?:the )?unlicense
wtfpl           1.0 80 do what the f[a-z*]* you want to public licen[cs]e
wtfpl           0.8 50 wtfpl
boost-1         1.0 80 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
boost-1         0.9 60 boost software licen[cs]e(?: v(?:ersion)? ?1 0)?
boost-1         0.8 50 www boost org license 1 0 txt
cc0             1.0 80 the person who associated a work with this deed has dedicated the work to the public domain
cc0             0.9 60 creative commons zero(?: v?1 0)?(?: universal)?
cc0             0.9 60 (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0             0.9 60 creativecommons org publicdomain zero 1 0
cc-pdm          0.8 60 creativecommons org publicdomain mark 1 0
cc-by           0.9 60 cc by(?! (?:sa|nc|nd)(?![0-9a-z]))(?: [1234] [05])?
cc-by-sa        0.9 60 cc by sa(?: [1234] [05])?
cc-by-nd        0.9 60 cc by nd(?: [1234] [05])?
cc-by-nc        0.9 60 cc by nc(?! (?:sa|nd)(?![0-9a-z]))(?: [1234] [05])?
cc-by-nc-sa     0.9 60 cc by nc sa(?: [1234] [05])?
cc-by-nc-nd     0.9 60 cc by nc nd(?: [1234] [05])?
cc-by           0.9 60 creative commons attribution(?! (?:share|non|no))(?: [1234] [05])?
cc-by-sa        0.9 60 creative commons attribution share ?alike(?: [1234] [05])?
cc-by-nd        0.9 60 creative commons attribution no ?deriv[a-z]*(?: [1234] [05])?
cc-by-nc        0.9 60 creative commons attribution non ?commercial(?! (?:share|no))(?: [1234] [05])?
cc-by-nc-sa     0.9 60 creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
cc-by-nc-nd     0.9 60 creative commons attribution non ?commercial no ?deriv[a-z]*(?: [1234] [05])?
cc-by           0.9 60 creativecommons org licenses by [1234] [05]
cc-by-sa        0.9 60 creativecommons org licenses by sa [1234] [05]
cc-by-nd        0.9 60 creativecommons org licenses by nd [1234] [05]
cc-by-nc        0.9 60 creativecommons org licenses by nc [1234] [05]
cc-by-nc-sa     0.9 60 creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd     0.9 60 creativecommons org licenses by nc nd [1234] [05]
cc              0.4 30 creative commons licen[cs]e
odbl            0.9 60 open (?:data commons )?(?:open )?database licen[cs]e
odbl            0.9 60 opendatacommons org licenses odbl
odc-by          0.9 60 open data commons attribution licen[cs]e
pddl            0.9 60 (?:open data commons )?public domain dedication and licen[cs]e
cdla-permissive 0.9 60 community data license agreement permissive
cdla-sharing    0.9 60 community data license agreement sharing
gfdl            1.0 80 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl            0.9 60 gnu free documentation licen[cs]e(?: v(?:ersion)? ?1 [123])?
ofl-1.1         0.9 80 this font software is licensed under the sil open font license version 1 1
ofl-1.1         0.9 60 (?:sil )?open font licen[cs]e(?: v(?:ersion)? ?1 1)?
openssl         0.9 80 this product includes software developed by the openssl project for use in the openssl toolkit
openssl         0.7 50 openssl licen[cs]e
ijg             0.9 80 this software is based in part on the work of the independent jpeg group
ftl             0.8 50 freetype (?:project )?licen[cs]e
w3c             0.8 50 w3c software (?:notice and )?licen[cs]e
unicode         0.8 50 unicode (?:inc )?licen[cs]e agreement
ms-pl           0.9 60 microsoft public licen[cs]e
ms-rl           0.9 60 microsoft reciprocal licen[cs]e
ncsa            0.9 60 university of illinois ncsa open source licen[cs]e
afl-3           0.9 60 academic free licen[cs]e(?: v(?:ersion|\.)? ?3(?: 0)?)?
osl-3           0.9 60 open software licen[cs]e(?: v(?:ersion|\.)? ?3(?: 0)?)?
upl-1           0.9 60 universal permissive licen[cs]e(?: v(?:ersion|\.)? ?1(?: 0)?)?
blueoak-1       0.9 60 blue oak model licen[cs]e(?: 1 0 0)?
cecill-2.1      0.9 60 cecill(?: free software)? licen[cs]e
mulan-2         0.9 60 mulan (?:permissive software licen[cs]e|psl) v(?:ersion)? ?2
zpl-2           0.9 60 zope public licen[cs]e(?: v(?:ersion|\.)? ?2(?: [01])?)?
sleepycat       0.9 50 sleepycat licen[cs]e
lppl-1.3        0.9 60 latex project public licen[cs]e(?: v(?:ersion|\.)? ?1 3c?)?
vim             0.8 50 vim licen[cs]e
beerware        0.9 80 if we meet some day and you think this stuff is worth it you can buy me a beer in return
beerware        0.8 50 beer ?ware licen[cs]e
json            0.9 80 the software shall be used for good not evil
busl-1.1        0.9 60 business source licen[cs]e(?: v?(?:ersion)? ?1 1)?
sspl-1          0.9 60 server side public licen[cs]e(?: v(?:ersion|\.)? ?1)?
elastic-2       0.9 60 elastic licen[cs]e(?: v(?:ersion|\.)? ?2(?: 0)?)?
commons-clause  0.9 80 the license does not grant to you the right to sell the software
commons-clause  0.8 50 commons clause
openrail        0.9 60 (?:creativeml |bigscience |bigcode )?open ?rail(?:\+\+)?(?: ?m)? licen[cs]e
openrail        0.8 60 responsible ai licen[cs]e
proprietary     0.6 30 unauthorized copying of this file via any medium is strictly prohibited
proprietary     0.6 30 this software is the confidential and proprietary information of
public-domain   0.7 30 (?:released|placed|dedicated) (?:in|into|to) the public domain
"""  # noqa: E501

#: SPDX identifiers by label; a trailing -only, -or-later or + is read with them.
IDENTIFIERS = """
mit: mit | mit-0: mit-0 | x11: x11 | apache-2: apache-2.0 | apache-1.1: apache-1.1 | apache-1: apache-1.0 | bsd-2: bsd-2-clause | bsd-3: bsd-3-clause
bsd-4: bsd-4-clause | 0bsd: 0bsd | bsd-patent: bsd-2-clause-patent | isc: isc | zlib: zlib | libpng: libpng-2.0 | gpl-1: gpl-1.0 | gpl-2: gpl-2.0 | gpl-3: gpl-3.0
lgpl-2: lgpl-2.0 | lgpl-2.1: lgpl-2.1 | lgpl-3: lgpl-3.0 | agpl-3: agpl-3.0 | mpl-1.1: mpl-1.1 | mpl-2: mpl-2.0 | epl-1: epl-1.0 | epl-2: epl-2.0
eupl-1.2: eupl-1.2 | cddl-1: cddl-1.0 cddl-1.1 | cpl-1: cpl-1.0 | ipl-1: ipl-1.0 | artistic-1: artistic-1.0 | artistic-2: artistic-2.0 | python-2: python-2.0 psf-2.0
ruby: ruby | php-3: php-3.0 php-3.01 | postgresql: postgresql | unlicense: unlicense | wtfpl: wtfpl | boost-1: bsl-1.0 | cc0: cc0-1.0
cc-by: cc-by-3.0 cc-by-4.0 | cc-by-sa: cc-by-sa-3.0 cc-by-sa-4.0 | cc-by-nd: cc-by-nd-4.0 | cc-by-nc: cc-by-nc-3.0 cc-by-nc-4.0 | cc-by-nc-sa: cc-by-nc-sa-4.0
cc-by-nc-nd: cc-by-nc-nd-4.0 | odbl: odbl-1.0 | odc-by: odc-by-1.0 | pddl: pddl-1.0 | gfdl: gfdl-1.1 gfdl-1.2 gfdl-1.3 | ofl-1.1: ofl-1.1 | openssl: openssl
ijg: ijg | ftl: ftl | w3c: w3c | ms-pl: ms-pl | ms-rl: ms-rl | ncsa: ncsa | afl-3: afl-3.0 | osl-3: osl-3.0 | upl-1: upl-1.0 | blueoak-1: blueoak-1.0.0
cecill-2.1: cecill-2.1 | mulan-2: mulanpsl-2.0 | zpl-2: zpl-2.0 zpl-2.1 | sleepycat: sleepycat | lppl-1.3: lppl-1.3c | vim: vim | beerware: beerware | json: json
busl-1.1: busl-1.1 | sspl-1: sspl-1.0 | elastic-2: elastic-2.0 | openrail: openrail | bsd: bsd | gpl: gpl | lgpl: lgpl | agpl: agpl
"""

#: How an identifier may stand: score, priority, pattern. The last holds only for identifiers with a version.
TAGS = [
    (1.0, 90, "spdx license identifier {id}"),
    (1.0, 70, GRANT + "{id}"),
    (0.9, 60, "licen[cs]e {id}"),
    (0.8, 50, "{id}"),
]
