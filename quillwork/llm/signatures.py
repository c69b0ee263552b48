"""Hand-written signature rules of licences: label, priority, keyword, pattern, one rule a line.

A pattern is read over lower-case words with one blank between them (a word is a run of ASCII letters and
digits or of other characters beyond ASCII, so ``CC BY-NC 4.0`` is ``cc by nc 4 0``). The keyword is a
run of words that every match holds; the pattern is tried only on texts that have it. Rules of a
smaller priority number go first: 1 wording of a licence itself, 2 identifiers and grants, 3 names with a
version, 4 names without one, 5 words that speak of some licence.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


#: How sure a detection of each priority makes us that the text is under the licence.
WEIGHTS = {1: 0.98, 2: 0.95, 3: 0.85, 4: 0.6, 5: 0.3}

_LINES = r"""
mit | 1 | free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 1 | shall be included | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | 1 | without restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
isc | 1 | with or without fee | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | 1 | with or without fee | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd-2-clause | 1 | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause | 1 | binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | 1 | endorse or promote | neither the name of (?:\S+ ){1,12}(?:nor the names of (?:its|their) contributors )?may be used to endorse or promote products derived from this software
bsd-4-clause | 1 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-1-clause | 1 | source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
zlib | 1 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 1 | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1.0 | 1 | free of charge | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense | 1 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 1 | what the fuck | you just do what the fuck you want to
apache-2 | 1 | terms and conditions | apache license version 2 0 january 2004 (?:https? www apache org licenses )?terms and conditions for use reproduction and distribution
apache-2 | 1 | you may not use this file | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2 | 1 | as is basis | distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-1.1 | 1 | apache software foundation | this product includes software developed by the apache software foundation
gpl-2-or-later | 1 | gnu general public license | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-3-or-later | 1 | gnu general public license | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
gpl-2 | 1 | gnu general public license | redistribute it and or modify it under the terms of the gnu general public license (?:version 2 )?as published by the free software foundation version 2
lgpl-2.1-or-later | 1 | gnu lesser general public license | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
lgpl-3-or-later | 1 | gnu lesser general public license | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
lgpl-2-or-later | 1 | gnu library general public license | under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
agpl-3-or-later | 1 | gnu affero general public license | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
gpl-3 | 1 | free copyleft license | the gnu general public license is a free copyleft license for software and other kinds of works
agpl-3 | 1 | free copyleft license | the gnu affero general public license is a free copyleft license for software and other kinds of works
gfdl-1.3 | 1 | gnu free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
gfdl-1.2 | 1 | gnu free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
mpl-2 | 1 | mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | 1 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
epl-2 | 1 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
epl-1 | 1 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
cddl-1 | 1 | common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
ofl-1.1 | 1 | font software | this font software is licensed under the sil open font license version 1 1
artistic-2 | 1 | standard version | you may charge a distributor fee for any distribution of the standard version
cc0-1 | 1 | to the extent possible under law | to the extent possible under law (?:\S+ ){1,12}has waived all copyright and related or neighboring rights
odbl-1 | 1 | open database license | this (?:\S+ ){1,6}is made available under the open database license
pddl-1 | 1 | public domain dedication and license | made available under the public domain dedication and license
ms-pl | 1 | accept this license | this license governs use of the accompanying software if you use the software you accept this license
sspl-1 | 1 | make the functionality | if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 | 1 | additional use grant | additional use grant
commons-clause | 1 | right to sell | the license does not grant to you the right to sell the software
proprietary | 1 | express written permission | may (?:not )?be (?:reproduced|copied|distributed|used) (?:\S+ ){0,10}without (?:the )?(?:prior )?express written permission
proprietary | 1 | confidential and proprietary | (?:is|are) (?:the )?confidential and proprietary
mit | 2 | spdx license identifier | spdx license identifier mit
mit-0 | 2 | spdx license identifier | spdx license identifier mit 0
isc | 2 | spdx license identifier | spdx license identifier isc
0bsd | 2 | spdx license identifier | spdx license identifier 0bsd
apache-2 | 2 | spdx license identifier | spdx license identifier apache 2 0
bsd-2-clause | 2 | spdx license identifier | spdx license identifier bsd 2 clause
bsd-3-clause | 2 | spdx license identifier | spdx license identifier bsd 3 clause
bsd-4-clause | 2 | spdx license identifier | spdx license identifier bsd 4 clause
zlib | 2 | spdx license identifier | spdx license identifier zlib
bsl-1.0 | 2 | spdx license identifier | spdx license identifier bsl 1 0
unlicense | 2 | spdx license identifier | spdx license identifier unlicense
gpl-2 | 2 | spdx license identifier | spdx license identifier gpl 2 0(?: only)?
gpl-2-or-later | 2 | spdx license identifier | spdx license identifier gpl 2 0 or later
gpl-3 | 2 | spdx license identifier | spdx license identifier gpl 3 0(?: only)?
gpl-3-or-later | 2 | spdx license identifier | spdx license identifier gpl 3 0 or later
lgpl-2.1 | 2 | spdx license identifier | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | 2 | spdx license identifier | spdx license identifier lgpl 2 1 or later
lgpl-3 | 2 | spdx license identifier | spdx license identifier lgpl 3 0(?: only)?
lgpl-3-or-later | 2 | spdx license identifier | spdx license identifier lgpl 3 0 or later
agpl-3 | 2 | spdx license identifier | spdx license identifier agpl 3 0(?: only)?
agpl-3-or-later | 2 | spdx license identifier | spdx license identifier agpl 3 0 or later
mpl-2 | 2 | spdx license identifier | spdx license identifier mpl 2 0
epl-2 | 2 | spdx license identifier | spdx license identifier epl 2 0
cddl-1 | 2 | spdx license identifier | spdx license identifier cddl 1 0
ofl-1.1 | 2 | spdx license identifier | spdx license identifier ofl 1 1
cc0-1 | 2 | spdx license identifier | spdx license identifier cc0 1 0
cc-by-4 | 2 | spdx license identifier | spdx license identifier cc by 4 0
cc-by-sa-4 | 2 | spdx license identifier | spdx license identifier cc by sa 4 0
eupl-1.2 | 2 | spdx license identifier | spdx license identifier eupl 1 2
artistic-2 | 2 | spdx license identifier | spdx license identifier artistic 2 0
mit | 2 | mit licen[cs]e | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit licen[cs]e
mit-x11 | 2 | x11 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:mit )?x11 licen[cs]e
isc | 2 | isc licen[cs]e | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?isc licen[cs]e
apache-2 | 2 | apache | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache (?:software )?licen[cs]e (?:version )?(?:v )?2(?: 0)?
apache-1.1 | 2 | apache | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache (?:software )?licen[cs]e (?:version )?1 1
bsd-2-clause | 2 | bsd | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[cs]e
bsd-3-clause | 2 | bsd | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[cs]e
bsd | 2 | bsd | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?bsd(?: style)? licen[cs]e
gpl-2 | 2 | gnu general public licen[cs]e | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu general public licen[cs]e (?:version )?(?:v )?2(?: 0)?
gpl-3 | 2 | gnu general public licen[cs]e | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu general public licen[cs]e (?:version )?(?:v )?3(?: 0)?
gpl-2 | 2 | gplv2 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gplv2
gpl-3 | 2 | gplv3 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gplv3
gpl | 2 | gpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl
lgpl-2.1 | 2 | gnu lesser general public licen[cs]e | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu lesser general public licen[cs]e (?:version )?(?:v )?2 1
lgpl-3 | 2 | gnu lesser general public licen[cs]e | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu lesser general public licen[cs]e (?:version )?(?:v )?3(?: 0)?
lgpl | 2 | lgpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?lgpl
agpl-3 | 2 | gnu affero general public licen[cs]e | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu affero general public licen[cs]e (?:version )?(?:v )?3(?: 0)?
agpl | 2 | agpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?agpl
mpl-2 | 2 | mozilla public licen[cs]e | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mozilla public licen[cs]e (?:version )?(?:v )?2(?: 0)?
epl-2 | 2 | eclipse public licen[cs]e | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?eclipse public licen[cs]e (?:version )?(?:v )?2(?: 0)?
cc0-1 | 2 | cc0 | (?:licensed|released|distributed|available|dedicated) under (?:the )?(?:terms of the )?(?:creative commons )?cc0(?: 1 0)?
cc-by-nc-nd-4 | 2 | cc by nc nd | (?:licensed|released|distributed|available) under (?:the )?(?:a )?(?:creative commons )?cc by nc nd(?: licen[cs]e)? 4 0
cc-by-nc-sa-4 | 2 | cc by nc sa | (?:licensed|released|distributed|available) under (?:the )?(?:a )?(?:creative commons )?cc by nc sa(?: licen[cs]e)? 4 0
cc-by-nc-4 | 2 | cc by nc | (?:licensed|released|distributed|available) under (?:the )?(?:a )?(?:creative commons )?cc by nc(?: licen[cs]e)? 4 0
cc-by-nc-3 | 2 | cc by nc | (?:licensed|released|distributed|available) under (?:the )?(?:a )?(?:creative commons )?cc by nc(?: licen[cs]e)? 3 0
cc-by-nd-4 | 2 | cc by nd | (?:licensed|released|distributed|available) under (?:the )?(?:a )?(?:creative commons )?cc by nd(?: licen[cs]e)? 4 0
cc-by-sa-4 | 2 | cc by sa | (?:licensed|released|distributed|available) under (?:the )?(?:a )?(?:creative commons )?cc by sa(?: licen[cs]e)? 4 0
cc-by-sa-3 | 2 | cc by sa | (?:licensed|released|distributed|available) under (?:the )?(?:a )?(?:creative commons )?cc by sa(?: licen[cs]e)? 3 0
cc-by-4 | 2 | cc by | (?:licensed|released|distributed|available) under (?:the )?(?:a )?(?:creative commons )?cc by(?: licen[cs]e)? 4 0
cc-by-3 | 2 | cc by | (?:licensed|released|distributed|available) under (?:the )?(?:a )?(?:creative commons )?cc by(?: licen[cs]e)? 3 0
public-domain | 2 | public domain | (?:placed|released|dedicated|put) (?:in|into|to) the public domain
public-domain | 2 | public domain | (?:this|the) (?:work|text|file|document|software|program|book) is in the public domain
proprietary | 2 | all rights reserved | copyright (?:c )?(?:by )?(?:\S+ ){0,12}all rights reserved
apache-2 | 2 | apache org licenses | www apache org licenses license 2 0
gpl-3 | 2 | gnu org licenses | www gnu org licenses gpl 3 0
gpl-2 | 2 | gnu org licenses | www gnu org licenses old licenses gpl 2 0
lgpl-3 | 2 | gnu org licenses | www gnu org licenses lgpl 3 0
agpl-3 | 2 | gnu org licenses | www gnu org licenses agpl 3 0
gpl | 2 | gnu org licenses | www gnu org licenses gpl
mit | 2 | opensource org licenses | opensource org licenses mit(?: license php)?
bsd-3-clause | 2 | opensource org licenses | opensource org licenses bsd 3 clause
bsd-2-clause | 2 | opensource org licenses | opensource org licenses bsd 2 clause
mpl-2 | 2 | mozilla org | mozilla org mpl 2 0
cc-by-4 | 2 | creativecommons org licenses | creativecommons org licenses by 4 0
cc-by-sa-4 | 2 | creativecommons org licenses | creativecommons org licenses by sa 4 0
cc-by-nc-4 | 2 | creativecommons org licenses | creativecommons org licenses by nc 4 0
cc-by-nd-4 | 2 | creativecommons org licenses | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4 | 2 | creativecommons org licenses | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4 | 2 | creativecommons org licenses | creativecommons org licenses by nc nd 4 0
cc-by-3 | 2 | creativecommons org licenses | creativecommons org licenses by 3 0
cc-by-sa-3 | 2 | creativecommons org licenses | creativecommons org licenses by sa 3 0
cc0-1 | 2 | creativecommons org publicdomain | creativecommons org publicdomain zero 1 0
public-domain | 2 | creativecommons org publicdomain | creativecommons org publicdomain mark 1 0
unlicense | 2 | unlicense org | (?:www )?unlicense org
wtfpl | 2 | wtfpl net | (?:www )?wtfpl net
apache-2 | 3 | apache | apache (?:software )?licen[cs]e (?:version )?(?:v )?2(?: 0)?
apache-1.1 | 3 | apache | apache (?:software )?licen[cs]e (?:version )?(?:v )?1 1
apache-2 | 3 | asl | asl 2 0
apache-2 | 3 | apache 2 0 | apache 2 0(?: licen[cs]e)?
gpl-1 | 3 | gnu general public licen[cs]e | gnu general public licen[cs]e (?:version )?(?:v )?1(?: 0)?
gpl-2 | 3 | gnu general public licen[cs]e | gnu general public licen[cs]e (?:version )?(?:v )?2(?: 0)?
gpl-3 | 3 | gnu general public licen[cs]e | gnu general public licen[cs]e (?:version )?(?:v )?3(?: 0)?
gpl-2 | 3 | gpl 2 | gpl 2(?: 0)?
gpl-3 | 3 | gpl 3 | gpl 3(?: 0)?
gpl-2 | 3 | gplv2 | gplv2
gpl-3 | 3 | gplv3 | gplv3
gpl-2-or-later | 3 | gplv2 or later | gplv2 or later
gpl-3-or-later | 3 | gplv3 or later | gplv3 or later
lgpl-2 | 3 | gnu library general public licen[cs]e | gnu library general public licen[cs]e (?:version )?(?:v )?2(?: 0)?
lgpl-2.1 | 3 | gnu lesser general public licen[cs]e | gnu lesser general public licen[cs]e (?:version )?(?:v )?2 1
lgpl-3 | 3 | gnu lesser general public licen[cs]e | gnu lesser general public licen[cs]e (?:version )?(?:v )?3(?: 0)?
lgpl-2.1 | 3 | lgpl 2 1 | lgpl 2 1
lgpl-3 | 3 | lgpl 3 | lgpl 3(?: 0)?
lgpl-2.1 | 3 | lgplv2 1 | lgplv2 1
lgpl-3 | 3 | lgplv3 | lgplv3
agpl-3 | 3 | gnu affero general public licen[cs]e | gnu affero general public licen[cs]e (?:version )?(?:v )?3(?: 0)?
agpl-3 | 3 | agpl 3 | agpl 3(?: 0)?
agpl-3 | 3 | agplv3 | agplv3
gfdl-1.3 | 3 | gnu free documentation licen[cs]e | gnu free documentation licen[cs]e (?:version )?(?:v )?1 3
gfdl-1.2 | 3 | gnu free documentation licen[cs]e | gnu free documentation licen[cs]e (?:version )?(?:v )?1 2
mpl-1.1 | 3 | mozilla public licen[cs]e | mozilla public licen[cs]e (?:version )?(?:v )?1 1
mpl-2 | 3 | mozilla public licen[cs]e | mozilla public licen[cs]e (?:version )?(?:v )?2(?: 0)?
mpl-2 | 3 | mpl 2 | mpl 2(?: 0)?
epl-1 | 3 | eclipse public licen[cs]e | eclipse public licen[cs]e (?:version )?(?:v )?1(?: 0)?
epl-2 | 3 | eclipse public licen[cs]e | eclipse public licen[cs]e (?:version )?(?:v )?2(?: 0)?
cddl-1 | 3 | cddl | cddl (?:version )?(?:v )?1(?: 0)?
cpl-1 | 3 | common public licen[cs]e | common public licen[cs]e (?:version )?(?:v )?1 0
ipl-1 | 3 | ibm public licen[cs]e | ibm public licen[cs]e (?:version )?(?:v )?1 0
eupl-1.1 | 3 | european union public licen[cs]e | european union public licen[cs]e (?:version )?(?:v )?1 1
eupl-1.2 | 3 | european union public licen[cs]e | european union public licen[cs]e (?:version )?(?:v )?1 2
artistic-1 | 3 | artistic licen[cs]e | artistic licen[cs]e (?:version )?(?:v )?1 0
artistic-2 | 3 | artistic licen[cs]e | artistic licen[cs]e (?:version )?(?:v )?2 0
bsl-1.0 | 3 | boost software licen[cs]e | boost software licen[cs]e (?:version )?(?:v )?1 0
osl-3 | 3 | open software licen[cs]e | open software licen[cs]e (?:version )?(?:v )?3 0
afl-3 | 3 | academic free licen[cs]e | academic free licen[cs]e (?:version )?(?:v )?3 0
ofl-1.1 | 3 | open font licen[cs]e | (?:sil )?open font licen[cs]e (?:version )?(?:v )?1 1
odbl-1 | 3 | open database licen[cs]e | open database licen[cs]e (?:version )?(?:v )?1 0
odc-by-1 | 3 | open data commons attribution licen[cs]e | open data commons attribution licen[cs]e (?:version )?(?:v )?1 0
psf-2 | 3 | python software foundation licen[cs]e | python software foundation licen[cs]e (?:version )?(?:v )?2
php-3.01 | 3 | php licen[cs]e | php licen[cs]e (?:version )?(?:v )?3 01
sspl-1 | 3 | server side public licen[cs]e | server side public licen[cs]e (?:version )?(?:v )?1
busl-1.1 | 3 | business source licen[cs]e | business source licen[cs]e (?:version )?(?:v )?1 1
elastic-2 | 3 | elastic licen[cs]e | elastic licen[cs]e (?:version )?(?:v )?2(?: 0)?
w3c | 3 | w3c software | w3c software (?:notice and )?licen[cs]e
bsd-2-clause | 3 | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[cs]e)?
bsd-3-clause | 3 | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd)(?: licen[cs]e)?
bsd-4-clause | 3 | bsd | (?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?
cc-by-4 | 3 | cc by 4 0 | cc by 4 0
cc-by-3 | 3 | cc by 3 0 | cc by 3 0
cc-by-2.5 | 3 | cc by 2 5 | cc by 2 5
cc-by-2 | 3 | cc by 2 0 | cc by 2 0
cc-by-sa-4 | 3 | cc by sa 4 0 | cc by sa 4 0
cc-by-sa-3 | 3 | cc by sa 3 0 | cc by sa 3 0
cc-by-sa-2.5 | 3 | cc by sa 2 5 | cc by sa 2 5
cc-by-nc-4 | 3 | cc by nc 4 0 | cc by nc 4 0
cc-by-nc-3 | 3 | cc by nc 3 0 | cc by nc 3 0
cc-by-nc-sa-4 | 3 | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-sa-3 | 3 | cc by nc sa 3 0 | cc by nc sa 3 0
cc-by-nc-nd-4 | 3 | cc by nc nd 4 0 | cc by nc nd 4 0
cc-by-nc-nd-3 | 3 | cc by nc nd 3 0 | cc by nc nd 3 0
cc-by-nd-4 | 3 | cc by nd 4 0 | cc by nd 4 0
cc-by-4 | 3 | creative commons attribution | creative commons attribution 4 0(?: international)?
cc-by-3 | 3 | creative commons attribution | creative commons attribution 3 0(?: unported)?
cc-by-sa-4 | 3 | creative commons attribution | creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3 | 3 | creative commons attribution | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-nc-4 | 3 | creative commons attribution | creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc-sa-4 | 3 | creative commons attribution | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-nd-4 | 3 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-nd-4 | 3 | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
cc0-1 | 3 | cc0 | cc0 1 0(?: universal)?
mit | 4 | mit licen[cs]e | mit licen[cs]e
mit-x11 | 4 | x11 licen[cs]e | x11 licen[cs]e
expat | 4 | expat licen[cs]e | expat licen[cs]e
isc | 4 | isc licen[cs]e | isc licen[cs]e
apache | 4 | apache | apache (?:software )?licen[cs]e
bsd | 4 | bsd | bsd(?: style)? licen[cs]e
gpl | 4 | gnu general public licen[cs]e | gnu general public licen[cs]e
gpl | 4 | gpl | (?:gnu )?gpl
lgpl | 4 | lgpl | (?:gnu )?lgpl
lgpl | 4 | gnu lesser general public licen[cs]e | gnu lesser general public licen[cs]e
agpl | 4 | agpl | (?:gnu )?agpl
agpl | 4 | gnu affero general public licen[cs]e | gnu affero general public licen[cs]e
gfdl | 4 | gnu free documentation licen[cs]e | gnu free documentation licen[cs]e
gfdl | 4 | gfdl | gfdl
mpl | 4 | mozilla public licen[cs]e | mozilla public licen[cs]e
epl | 4 | eclipse public licen[cs]e | eclipse public licen[cs]e
cddl | 4 | common development and distribution licen[cs]e | common development and distribution licen[cs]e
cpl | 4 | common public licen[cs]e | common public licen[cs]e
eupl | 4 | eupl | eupl
eupl | 4 | european union public licen[cs]e | european union public licen[cs]e
artistic | 4 | artistic licen[cs]e | artistic licen[cs]e
zlib | 4 | zlib licen[cs]e | zlib licen[cs]e
bsd-2-clause | 3 | freebsd licen[cs]e | freebsd licen[cs]e
zlib | 4 | zlib libpng licen[cs]e | zlib libpng licen[cs]e
bsl-1.0 | 4 | boost software licen[cs]e | boost software licen[cs]e
ofl | 4 | open font licen[cs]e | (?:sil )?open font licen[cs]e
odbl | 4 | odbl | odbl
odbl | 4 | open database licen[cs]e | open database licen[cs]e
psf | 4 | python software foundation licen[cs]e | python software foundation licen[cs]e
php | 4 | php licen[cs]e | php licen[cs]e
ruby | 4 | ruby licen[cs]e | ruby licen[cs]e
openssl | 4 | openssl licen[cs]e | openssl licen[cs]e
unlicense | 4 | the unlicense | the unlicense
wtfpl | 4 | wtfpl | wtfpl
sspl | 4 | server side public licen[cs]e | server side public licen[cs]e
busl | 4 | business source licen[cs]e | business source licen[cs]e
elastic | 4 | elastic licen[cs]e | elastic licen[cs]e
cc0 | 4 | cc0 | cc0
cc-by | 4 | cc by | cc by
cc-by-sa | 4 | cc by sa | cc by sa
cc-by-nd | 4 | cc by nd | cc by nd
cc-by-nc | 4 | cc by nc | cc by nc
cc-by-nc-sa | 4 | cc by nc sa | cc by nc sa
cc-by-nc-nd | 4 | cc by nc nd | cc by nc nd
cc-by | 4 | creative commons attribution | creative commons attribution
cc-by-sa | 4 | creative commons attribution | creative commons attribution share ?alike
cc-by-nc | 4 | creative commons attribution | creative commons attribution non ?commercial
cc-by-nc-sa | 4 | creative commons attribution | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | 4 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nd | 4 | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s
public-domain | 4 | public domain | public domain
proprietary | 4 | all rights reserved | all rights reserved
proprietary | 4 | commercial licen[cs]e | commercial licen[cs]e
creative-commons | 5 | creative commons | creative commons
unknown-licence | 5 | licen[cs]ed under | licen[cs]ed under
unknown-licence | 5 | under licen[cs]e | under licen[cs]e from
unknown-licence | 5 | terms of the licen[cs]e | terms of the licen[cs]e
unknown-licence | 5 | open source licen[cs]e | open source licen[cs]e
unknown-licence | 5 | free software licen[cs]e | free software licen[cs]e
unknown-licence | 5 | end user licen[cs]e agreement | end user licen[cs]e agreement
unknown-licence | 5 | permission is granted | permission is granted to
unknown-licence | 5 | with permission | (?:reproduced|reprinted|used) with permission
"""

RULES = [Rule(a, int(b), c, d) for a, b, c, d in (line.split(" | ") for line in _LINES.strip().splitlines())]
