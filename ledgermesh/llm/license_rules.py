"""Ordered licence signature rules over a text's words, lower-cased and joined by one space.

Each rule has a label, a priority, a regex, and keywords derived from it: sets of alternatives, of each of which every match
holds one, so that the regex is only tried where they occur. `{name}` rules come from the families below, one for each kind of mention; the
notices are written out one by one.
"""

from __future__ import annotations

import re
import re._parser as parser
from dataclasses import dataclass

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# label | name as words | SPDX identifier as words | address as words
FAMILIES = """
mit | (?:mit|expat) | mit | opensource org licenses? mit
mit-0 | mit no attribution | mit 0 | opensource org licenses? mit 0
apache-1 | apache(?: software)? license(?: version)? 1(?: [01])? | apache 1 [01] | apache org licenses license 1 [01]
apache-2 | apache(?: software)?(?: license)?(?: version)? 2(?: 0)? | apache 2 0 | apache org licenses license 2 0
gpl-1 | gpl(?: version)? v?1 | gpl 1 0(?: only| or later)? | gnu org licenses gpl 1 0
gpl-2 | gpl(?: version)? v?2(?: 0)? | gpl 2 0(?: only| or later)? | gnu org licenses(?: old licenses)? gpl 2 0
gpl-3 | gpl(?: version)? v?3(?: 0)? | gpl 3 0(?: only| or later)? | gnu org licenses gpl 3 0
lgpl-2 | lgpl(?: version)? v?2(?: [01])? | lgpl 2 [01](?: only| or later)? | gnu org licenses(?: old licenses)? lgpl 2 [01]
lgpl-3 | lgpl(?: version)? v?3(?: 0)? | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl 3 0
agpl-3 | agpl(?: version)? v?3(?: 0)? | agpl 3 0(?: only| or later)? | gnu org licenses agpl 3 0
gfdl-1 | gfdl(?: version)? 1 [123] | gfdl 1 [123](?: only| or later)? | gnu org licenses fdl 1 [123]
bsd-1 | (?:1|one) clause bsd | bsd 1 clause | opensource org licenses? bsd 1 clause
bsd-2 | (?:(?:2|two) clause|simplified|freebsd) bsd | bsd 2 clause | opensource org licenses? bsd 2 clause
bsd-3 | (?:(?:3|three) clause|new|modified|revised) bsd | bsd 3 clause | opensource org licenses? bsd 3 clause
bsd-4 | (?:(?:4|four) clause|original) bsd | bsd 4 clause | opensource org licenses? bsd 4 clause
bsd-0 | (?:0|zero) clause bsd | 0bsd | opensource org licenses? 0bsd
isc | isc | isc | opensource org licenses? isc
mpl-1 | mozilla public license(?: version)? 1(?: [01])? | mpl 1 [01] | mozilla org mpl 1 [01]
mpl-2 | mozilla public license(?: version)? 2(?: 0)? | mpl 2 0 | mozilla org mpl 2 0
epl-1 | eclipse public license(?: version)? 1(?: 0)? | epl 1 0 | eclipse org legal epl v10
epl-2 | eclipse public license(?: version)? 2(?: 0)? | epl 2 0 | eclipse org legal epl (?:v20|2 0)
cddl-1 | (?:cddl|common development and distribution license)(?: version)? 1(?: [01])? | cddl 1 [01] | opensource org licenses? cddl 1 0
cpl-1 | common public license(?: version)? 1(?: 0)? | cpl 1 0 | opensource org licenses? cpl 1 0
eupl-1 | european union public licen[cs]e(?: version)? 1 [012] | eupl 1 [012] | joinup ec europa eu \\S* eupl
artistic-1 | artistic license(?: version)? 1(?: 0)? | artistic 1 0 | opensource org licenses? artistic 1 0
artistic-2 | artistic license(?: version)? 2(?: 0)? | artistic 2 0 | opensource org licenses? artistic 2 0
zlib | zlib(?: libpng)? | zlib | opensource org licenses? zlib
libpng | (?:the )?libpng | libpng(?: 2 0)? | libpng org pub png src libpng license
boost-1 | boost software license(?: version)? 1(?: 0)? | bsl 1 0 | boost org license 1 0
unlicense | unlicense | unlicense | unlicense org
wtfpl | wtfpl | wtfpl | wtfpl net
cc0-1 | cc0(?: 1 0)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
cc-by | cc by(?: [1234] [05])? | cc by [1234] [05] | creativecommons org licenses by [1234] [05]
cc-by-sa | cc by sa(?: [1234] [05])? | cc by sa [1234] [05] | creativecommons org licenses by sa [1234] [05]
cc-by-nd | cc by nd(?: [1234] [05])? | cc by nd [1234] [05] | creativecommons org licenses by nd [1234] [05]
cc-by-nc | cc by nc(?: [1234] [05])? | cc by nc [1234] [05] | creativecommons org licenses by nc [1234] [05]
cc-by-nc-sa | cc by nc sa(?: [1234] [05])? | cc by nc sa [1234] [05] | creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd | cc by nc nd(?: [1234] [05])? | cc by nc nd [1234] [05] | creativecommons org licenses by nc nd [1234] [05]
odbl-1 | open database license(?: version)? 1(?: 0)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by-1 | open data commons attribution | odc by 1 0 | opendatacommons org licenses by
pddl-1 | (?:pddl|public domain dedication and license) | pddl 1 0 | opendatacommons org licenses pddl
ofl-1 | (?:sil )?ofl(?: version)? 1 [01] | ofl 1 [01] | scripts sil org ofl
python-2 | python software foundation license(?: version)? 2 | (?:psf|python) 2 0 | python org psf license
php-3 | php license(?: version)? 3(?: 0 ?1?)? | php 3 0 1? | php net license 3 0
ruby | ruby | ruby | ruby lang org en about license
perl | perl | perl | dev perl org licenses
postgresql | postgresql | postgresql | postgresql org about licen[cs]e
openssl | openssl | openssl | openssl org source license
curl | curl | curl | curl se docs copyright
ntp | ntp | ntp | opensource org licenses? ntp
ncsa | (?:university of illinois )?ncsa | ncsa | opensource org licenses? ncsa
afl-3 | academic free license(?: version)? [123] \\d | afl [123] \\d | opensource org licenses? afl 3 0
osl-3 | open software license(?: version)? [123] \\d | osl [123] \\d | opensource org licenses? osl 3 0
apsl-2 | apple public source license(?: version)? [12] \\d | apsl [12] \\d | opensource apple com apsl
ms-pl | microsoft public | ms pl | opensource org licenses? ms pl
ms-rl | microsoft reciprocal | ms rl | opensource org licenses? ms rl
sspl-1 | (?:sspl|server side public license)(?: version)? 1 | sspl 1 0 | mongodb com licensing server side public license
busl-1 | business source license(?: version)? 1 1 | busl 1 1 | mariadb com bsl11
elastic-2 | elastic license(?: version)? 2(?: 0)? | elastic 2 0 | elastic co licensing elastic license
upl-1 | universal permissive license(?: version)? 1 0 | upl 1 0 | opensource org licenses? upl
qpl-1 | q public license(?: version)? 1 0 | qpl 1 0 | opensource org licenses? qpl 1 0
vim | vim | vim | vimdoc sourceforge net
x11 | x11 | x11 | x org releases
blueoak-1 | blue oak model license(?: version)? 1 0 0 | blueoak 1 0 0 | blueoakcouncil org license 1 0 0
mulan-2 | mulan permissive software license(?: v2)? | mulanpsl 2 0 | license coscl org cn mulanpsl2
"""

# {n}: the family's name; kinds in falling order of priority
MENTIONS = {
    90: "spdx license identifier {s}",
    80: "{u}",
    60: "(?:licensed|released|distributed|available|published|provided|covered) (?:to you )?(?:under|by) (?:the )?(?:terms of the )?{n}(?: licen[cs]e)?",
    50: "(?:under|governed by) (?:the )?(?:terms of )?(?:the )?{n} licen[cs]e",
    40: "licen[cs]e (?:is )?(?:the )?{n}",
    30: "(?:the )?{n} licen[cs]e",
}

# label | priority | regex
NOTICES = """
mit | 70 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 68 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | 70 | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
bsd-2 | 66 | redistribution and use in source and binary forms with or without modification are permitted
bsd-3 | 70 | neither the names? of .{1,120}? nor the names of (?:its|their) contributors may be used to endorse or promote products
bsd-4 | 70 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2 | 70 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | 66 | apache license version 2
gpl-2 | 70 | redistribute it and or modify it under the terms of the gnu general public license .{0,60}?version 2
gpl-3 | 70 | redistribute it and or modify it under the terms of the gnu general public license .{0,60}?version 3
lgpl-2 | 70 | gnu (?:lesser|library) general public license .{0,60}?version 2
lgpl-3 | 70 | gnu lesser general public license .{0,60}?version 3
agpl-3 | 70 | gnu affero general public license .{0,60}?version 3
gpl | 28 | gnu general public licen[cs]e
lgpl | 28 | gnu (?:lesser|library) general public licen[cs]e
agpl | 28 | gnu affero general public licen[cs]e
gfdl | 28 | gnu free documentation licen[cs]e
mpl-2 | 70 | this source code form is subject to the terms of the mozilla public license v 2 0
epl-1 | 70 | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2 | 70 | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
zlib | 70 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost-1 | 70 | distributed under the boost software license version 1 0
unlicense | 70 | this is free and unencumbered software released into the public domain
wtfpl | 70 | do what the fuck you want to public license
cc0-1 | 70 | (?:has waived|waives?) all copyright and related (?:or|and) neighbou?ring rights
ofl-1 | 70 | this font software is licensed under the sil open font license version 1 1
cc-by | 62 | creative commons attribution(?: [1234] [05])?(?: international)? licen[cs]e
cc-by-sa | 64 | creative commons attribution share ?alike(?: [1234] [05])?
cc-by-nd | 64 | creative commons attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-nc | 64 | creative commons attribution non ?commercial(?: [1234] [05])?
cc-by-nc-sa | 66 | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | 66 | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
public-domain | 40 | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
proprietary | 40 | all rights reserved
proprietary | 44 | (?:confidential and proprietary|proprietary and confidential)
proprietary | 42 | unauthori[sz]ed (?:copying|use|distribution|reproduction) .{0,60}?strictly prohibited
copyright-notice | 20 | copyright(?: c)? (?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?
no-warranty | 15 | provided as is without warranty of any kind
gpl-1 | 71 | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?v(?:ersion)? ?1(?: 0)?
gpl-2 | 71 | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?v(?:ersion)? ?2(?: 0)?
gpl-3 | 71 | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?v(?:ersion)? ?3(?: 0)?
gpl-2 | 72 | version 2 of the (?:gnu general public licen[cs]e|gpl)
gpl-3 | 72 | version 3 of the (?:gnu general public licen[cs]e|gpl)
gpl-2-or-later | 74 | (?:gnu general public licen[cs]e|gpl) .{0,80}?version 2 (?:of the licen[cs]e )?or (?:at your option )?any later version
gpl-3-or-later | 74 | (?:gnu general public licen[cs]e|gpl) .{0,80}?version 3 (?:of the licen[cs]e )?or (?:at your option )?any later version
gpl-2 | 58 | gplv2
gpl-3 | 58 | gplv3
gpl | 57 | gpl compatible
gpl-2-classpath | 75 | linking this library statically or dynamically with other modules is making a combined work
gpl-gcc-exception | 75 | gcc runtime library exception
gpl-bison-exception | 75 | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
gpl-font-exception | 75 | if you create a document which uses this font and embed this font or unaltered portions of this font into the document
gpl-openssl-exception | 75 | permission to link (?:the code of (?:this program|portions of this program) )?with the openssl (?:project s )?(?:library|toolkit)
gpl | 45 | you should have received a copy of the gnu general public licen[cs]e along with (?:this|the) [a-z]{1,20}
lgpl | 45 | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
agpl | 45 | you should have received a copy of the gnu affero general public licen[cs]e
gpl | 44 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
lgpl | 46 | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
agpl | 46 | interacting with it remotely through a computer network .{0,80}?opportunity to receive the corresponding source
lgpl-2-1 | 72 | (?:lgpl|gnu lesser general public licen[cs]e) v(?:ersion)? ?2 1
lgpl-3 | 72 | (?:lgpl|gnu lesser general public licen[cs]e) v(?:ersion)? ?3
lgpl-2-1-or-later | 74 | gnu lesser general public licen[cs]e .{0,60}?version 2 1 (?:of the licen[cs]e )?or (?:at your option )?any later version
agpl-3 | 72 | (?:agpl|agplv3|gnu affero general public licen[cs]e) v?(?:ersion )?3
gfdl-1-3 | 72 | gnu free documentation licen[cs]e version 1 3
gfdl-1-2 | 72 | gnu free documentation licen[cs]e version 1 2
gfdl | 60 | with no invariant sections no front cover texts and no back cover texts
gpl | 18 | free software foundation inc (?:51 franklin st(?:reet)?|59 temple place|675 mass ave)
mit | 61 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-0 | 73 | permission is hereby granted .{0,400}?to permit persons to whom the software is furnished to do so the software is provided
mit-x11 | 62 | except as contained in this notice the name of the x consortium shall not be used in advertising
mit | 36 | mit style licen[cs]e
mit | 34 | dual licensed under (?:the )?mit
mit-or-apache-2 | 73 | licensed under either of apache licen[cs]e version 2 0 .{0,80}?or mit licen[cs]e
mit-or-apache-2 | 72 | (?:mit|apache 2 0) or (?:apache 2 0|mit)
mit-or-gpl | 72 | dual licensed under the mit (?:and|or) gpl(?: version 2)? licen[cs]es?
hpnd | 70 | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
hpnd-sell | 71 | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
ntp | 71 | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
isc | 66 | the software is provided as is and (?:the author|isc|internet systems consortium) disclaims all warranties
bsd-0 | 72 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd-2 | 58 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2 | 57 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3 | 69 | (?:neither )?the name of (?:the )?.{1,80}? may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-3 | 68 | neither the name of the university nor the names of its contributors
bsd-3-clear | 76 | no express or implied licenses to any party s patent rights are granted by this licen[cs]e
bsd-4 | 69 | this product includes software developed by the university of california berkeley and its contributors
bsd-4 | 60 | this product includes software developed by
bsd-patent | 72 | bsd (?:2 clause )?plus patent(?: licen[cs]e)?
bsd-protection | 72 | bsd protection licen[cs]e
bsd | 38 | bsd style licen[cs]e
bsd | 35 | berkeley software distribution licen[cs]e
bsd | 30 | use of this source code is governed by a bsd (?:style )?licen[cs]e
apache-2 | 69 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | 67 | you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0
apache-2 | 65 | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2 | 59 | apache v2(?: 0)?
apache-2-llvm | 77 | apache licen[cs]e v(?:ersion )?2 0 with llvm exceptions?
apache-1-1 | 70 | the end user documentation included with the redistribution if any must include the following acknowledge?ment
apache-1 | 66 | products derived from this software may not be called apache nor may apache appear in their names
apache | 33 | apache software foundation licen[cs]e
mpl-1-1 | 72 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1 | 71 | the contents of this file are subject to the mozilla public license version 1 0
mpl-2-no-copyleft | 75 | this source code form is incompatible with secondary licenses as defined by the mozilla public license
mpl-gpl-lgpl | 76 | alternatively the contents of this file may be used under the terms of either the gnu general public license
npl-1 | 70 | netscape public license version 1 [01]
sissl | 70 | sun industry standards source license
cddl-1 | 70 | subject to the terms of the common development and distribution license
cddl-gpl | 76 | common development and distribution license cddl .{0,80}?gnu general public license version 2
epl-2 | 72 | this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0
edl-1 | 70 | eclipse distribution license v ?1 0
cpl-1 | 70 | this program and the accompanying materials are made available under the terms of the common public license v1 0
ipl-1 | 70 | ibm public license version 1 0
eupl-1-2 | 72 | licensed under the eupl version 1 2
eupl | 60 | european union public licen[cs]e
cecill-2 | 70 | this software is governed by the cecill license under french law
cecill-b | 72 | governed by the cecill b license under french law
cecill-c | 72 | governed by the cecill c license under french law
artistic-1 | 70 | you may distribute under the terms of either the gnu general public license or the artistic license
perl | 71 | you can redistribute it and or modify it under the same terms as perl (?:5 )?itself
zlib | 68 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 66 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | 70 | the png reference library is supplied as is
ijg | 70 | this software is based in part on the work of the independent jpeg group
libtiff | 70 | the names of sam leffler and silicon graphics may not be used in any advertising
freetype | 70 | portions of this software are copyright .{0,40}?the freetype project
bzip2 | 70 | the origin of this software must not be misrepresented .{0,120}?bzip2
curl | 70 | copyright c 1996 (?:20\\d\\d )?daniel stenberg
openssl | 70 | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 70 | this product includes cryptographic software written by eric young
postgresql | 70 | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
python-2 | 70 | psf is making python available to licensee on an as is basis
python-2 | 69 | python software foundation license version 2
python-cnri | 70 | cnri open source license agreement
php-3-01 | 70 | this product includes php software freely available from
zend-2 | 70 | the zend engine license version 2
ruby | 70 | you can redistribute it and or modify it under either the terms of the 2 clause bsdl
tcl | 70 | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
vim | 70 | vim is charityware
unicode | 70 | unicode inc license agreement data files and software
w3c | 70 | w3c software (?:and document )?notice and license
icu | 70 | icu license icu 1 8 1 and later
ofl-1 | 68 | the fonts and derivatives however cannot be released under any other type of license
bitstream-vera | 70 | fonts are c bitstream .{0,40}?bitstream vera is a trademark
ubuntu-font | 70 | ubuntu font licen[cs]e(?: version)? 1 0
unlicense | 68 | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | 68 | you just do what the fuck you want to
beerware | 70 | if we meet some day and you think this stuff is worth it you can buy me a beer
json | 70 | the software shall be used for good not evil
cc0-1 | 68 | to the extent possible under law .{0,120}?waived all copyright and related (?:or|and) neighbou?ring rights
cc0-1 | 66 | cc0 1 0 universal
cc-by-4 | 72 | creative commons attribution 4 0(?: international)?
cc-by-3 | 72 | creative commons attribution 3 0(?: unported)?
cc-by-2-5 | 72 | creative commons attribution 2 5(?: generic)?
cc-by-sa-4 | 73 | creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3 | 73 | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-nc-4 | 73 | creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nd-4 | 73 | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-nc-sa-4 | 74 | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-nd-4 | 74 | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
cc-public-domain | 66 | creative commons public domain (?:mark|dedication)
cc | 26 | creative commons licen[cs]e
odbl-1 | 70 | made available under the open database licen[cs]e
odc-by-1 | 70 | made available under the open data commons attribution licen[cs]e
ogl-uk-3 | 70 | contains public sector information licensed under the open government licen[cs]e v3 0
ogl-uk | 50 | open government licen[cs]e
etalab-2 | 60 | licence ouverte(?: open licen[cs]e)? v(?:ersion)? ?2(?: 0)?
cdla-permissive | 60 | community data licen[cs]e agreement permissive(?: version)? [12] 0
cdla-sharing | 60 | community data licen[cs]e agreement sharing(?: version)? 1 0
sspl-1 | 70 | offering the program as a service .{0,60}?service source code
busl-1 | 70 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
elastic-2 | 70 | you may not provide the software to third parties as a hosted or managed service
commons-clause | 72 | commons clause licen[cs]e condition v ?1 0
polyform-nc | 70 | polyform noncommercial licen[cs]e 1 0 0
polyform-small | 70 | polyform small business licen[cs]e 1 0 0
prosperity | 70 | prosperity public licen[cs]e(?: version)? 3 0 0
rail | 60 | responsible ai licen[cs]e
openrail-m | 64 | (?:creativeml )?open ?rail m
llama-2 | 66 | llama 2 community licen[cs]e(?: agreement)?
llama-3 | 66 | (?:meta )?llama 3(?: [123])? community licen[cs]e(?: agreement)?
gemma | 60 | gemma terms of use
oracle-bcl | 70 | oracle binary code licen[cs]e agreement
sun-bcl | 70 | sun microsystems inc binary code licen[cs]e agreement
ms-eula | 60 | microsoft software licen[cs]e terms
intel-simplified | 70 | intel simplified software licen[cs]e
nvidia | 60 | nvidia (?:software|cuda toolkit) (?:end user )?licen[cs]e agreement
proprietary | 46 | trade secrets? .{0,60}?(?:may not be|shall not be) disclosed
proprietary | 43 | no part of this (?:publication|work|document|book) may be reproduced
proprietary | 41 | for internal use only
proprietary | 41 | end user licen[cs]e agreement
proprietary | 39 | licensed material property of
no-redistribution | 46 | redistribution (?:is )?(?:strictly )?(?:prohibited|forbidden|not permitted)
no-commercial-use | 46 | (?:for )?non ?commercial (?:use|purposes) only
no-commercial-use | 45 | not for commercial (?:use|purposes)
research-only | 46 | for (?:academic )?research (?:use|purposes) only
no-ai-training | 60 | (?:may not|must not|shall not) be used (?:to train|for training) (?:any )?(?:artificial intelligence|ai|machine learning|large language) (?:systems?|models?)
public-domain | 48 | (?:has|have) been (?:placed|released|dedicated) (?:in|into|to) the public domain
public-domain | 47 | works? of the united states government
public-domain | 44 | no copyright is claimed
shareware | 30 | shareware
freeware | 30 | freeware
royalty-free | 25 | royalty free licen[cs]e
dual-license | 24 | (?:dual|multi) licensed
see-license | 16 | see (?:the )?(?:file )?licen[cs]e(?: (?:txt|md|file))? for (?:the )?(?:details|more information|licen[cs]e (?:details|terms))
see-license | 15 | licensed under the terms (?:found )?in the licen[cs]e file
copyright-notice | 21 | copyright(?: c)? (?:by )?[a-z]{2,30} (?:19|20)\\d\\d
copyright-notice | 19 | spdx filecopyrighttext
no-warranty | 14 | without even the implied warranty of merchantability or fitness for a particular purpose
no-warranty | 13 | in no event shall the (?:authors?|copyright holders?|copyright owners?|regents) (?:or (?:contributors|copyright holders) )?be liable
no-warranty | 12 | use at your own risk
"""


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    priority: int
    keywords: tuple[frozenset[bytes], ...]
    regex: re.Pattern
    base: bool = False


#: Shorter pieces are keywords only of rules that have no longer ones.
LEAST_KEYWORD = 3


def _required(parts: list) -> list[frozenset[str]]:
    """Sets of pieces of words; every match of the parsed regex holds a piece of each set."""
    out: list[frozenset[str]] = []
    run = ""
    for op, value in [*parts, (None, None)]:
        if op is parser.LITERAL:
            run += chr(value)
            continue
        out += [frozenset([x]) for x in run.split()]
        run = ""
        if op is parser.SUBPATTERN:
            out += _required(value[-1])
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0:
            out += _required(value[2])
        elif op is parser.BRANCH:
            ways = [_required(x) for x in value[1]]
            if all(ways):
                out.append(frozenset().union(*(max(w, key=lambda s: min(map(len, s))) for w in ways)))
    return out


def keywords_of(regex: str) -> tuple[frozenset[bytes], ...]:
    found = set(_required(list(parser.parse(regex))))
    long = [s for s in found if min(map(len, s)) >= LEAST_KEYWORD]
    return tuple(frozenset(x.encode() for x in s) for s in sorted(long or found, key=sorted))


def rules() -> list[Rule]:
    """All rules, in falling order of priority, the base phrases first."""
    found: list[tuple[int, str, str, bool]] = [(100, label, phrase, True) for phrase, label in BASE.items()]
    for line in FAMILIES.strip().splitlines():
        label, name, spdx, url = (x.strip().replace("\\\\", "\\") for x in line.split(" | "))
        found += [(priority, label, shape.format(n=f"(?:{name})", s=f"(?:{spdx})", u=url), False) for priority, shape in MENTIONS.items()]
    for line in NOTICES.strip().splitlines():
        label, priority, regex = (x.strip().replace("\\\\", "\\") for x in line.split(" | "))
        found.append((int(priority), label, regex, False))
    found.sort(key=lambda x: -x[0])
    return [Rule(k, label, p, keywords_of(regex), re.compile(f"(?<= )(?:{regex})(?= )".encode()), base) for k, (p, label, regex, base) in enumerate(found)]
