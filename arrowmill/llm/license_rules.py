"""Licence signatures: label, priority, keyword and regex, one a line.

They match lower-cased text whose white space is single spaces. A rule runs
only where its keyword occurs, so every match of the regex must hold it. Priority 4: an identifier or a clause of the
licence text; 3: an explicit grant; 2: the licence's full name; 1: a hint.
"""

_TABLE = r"""
mit 4 permission is hereby granted permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
mit 4 shall be included in all the above copyright notice and this permission notice shall be included in all copies
mit 4 spdx-license-identifier spdx-license-identifier: ?mit\b(?!-)
mit-0 4 spdx-license-identifier spdx-license-identifier: ?mit-0\b
mit 4 opensource.org/licenses/mit opensource\.org/licenses/mit\b
mit 3 mit licen (?:released|licensed|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e\b
mit 3 mit licen under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e\b
mit 3 mit-licensed \bmit-licensed\b
mit 2 mit licen \bmit licen[cs]e\b
mit 2 expat \bexpat licen[cs]e\b
mit 1 licen licen[cs]e ?[:=] ?["']?mit\b
x11 4 spdx-license-identifier spdx-license-identifier: ?x11\b
x11 2 x11 \bx11 licen[cs]e\b
x11 2 mit/x \bmit/x(?:11)? licen[cs]e\b
mit-0 2 mit no attribution \bmit no attribution\b
apache-2.0 4 spdx-license-identifier spdx-license-identifier: ?apache-2\.0\b
apache-2.0 4 apache.org/licenses apache\.org/licenses/license-2\.0
apache-2.0 4 you may not use this file licensed under the apache license, version 2\.0 \(the ["']license["']\); ?you may not use this file
apache-2.0 4 unless required by applicable law unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an ["']as is["'] basis
apache-2.0 3 apache licen licensed under (?:the )?apache licen[cs]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
apache-2.0 3 apache licen (?:released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?apache licen[cs]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
apache-2.0 2 apache licen \bapache licen[cs]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
apache-2.0 2 apache-2 \bapache-2(?:\.0)?\b
apache-2.0 2 asl 2 \basl 2(?:\.0)?\b
apache-1.1 4 spdx-license-identifier spdx-license-identifier: ?apache-1\.1\b
apache-1.1 2 apache \bapache (?:software )?licen[cs]e,? ?(?:version|v\.?)? ?1\.1\b
apache-1.0 4 spdx-license-identifier spdx-license-identifier: ?apache-1\.0\b
apache-1.0 2 apache \bapache (?:software )?licen[cs]e,? ?(?:version|v\.?)? ?1\.0\b
apache 3 apache (?:released|licensed|distributed) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[cs]e\b
apache 2 apache \bapache (?:software )?licen[cs]e\b
gpl 4 general public licen you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e
gpl 4 gnu.org/licenses gnu\.org/licenses/gpl\.html
gpl-2.0 4 spdx-license-identifier spdx-license-identifier: ?gpl-2\.0(?:-only|-or-later|\+)?(?![\w.])
gpl-3.0 4 spdx-license-identifier spdx-license-identifier: ?gpl-3\.0(?:-only|-or-later|\+)?(?![\w.])
gpl-1.0 4 spdx-license-identifier spdx-license-identifier: ?gpl-1\.0(?:-only|-or-later|\+)?(?![\w.])
gpl-2.0 4 gnu.org/licenses gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 4 gnu.org/licenses gnu\.org/licenses/gpl-3\.0
gpl-2.0 3 general public licen licensed under (?:the )?gnu general public licen[cs]e,? ?(?:version|v\.?) ?2\b
gpl-3.0 3 general public licen licensed under (?:the )?gnu general public licen[cs]e,? ?(?:version|v\.?) ?3\b
gpl 3 general public licen licensed under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e\b
gpl 3 general public licen (?:released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e\b
gpl-2.0 2 general public licen \bgnu general public licen[cs]e,? ?(?:\(gpl\),? ?)?(?:version|v\.?) ?2(?:\.0)?\b
gpl-3.0 2 general public licen \bgnu general public licen[cs]e,? ?(?:\(gpl\),? ?)?(?:version|v\.?) ?3(?:\.0)?\b
gpl 2 general public licen \bgnu general public licen[cs]e\b
gpl-2.0 2 gpl \bgplv?-?2(?:\.0)?\+?(?![\w.])
gpl-3.0 2 gpl \bgplv?-?3(?:\.0)?\+?(?![\w.])
gpl-2.0 2 gnu gpl \bgnu gpl,? ?(?:version|v\.?) ?2\b
gpl-3.0 2 gnu gpl \bgnu gpl,? ?(?:version|v\.?) ?3\b
gpl 2 gnu gpl \bgnu gpl\b
gpl 1 gpl-licensed \bgpl-licensed\b
gpl 1 licen licen[cs]e ?[:=] ?["']?gpl\b
lgpl-2.1 4 spdx-license-identifier spdx-license-identifier: ?lgpl-2\.1(?:-only|-or-later|\+)?(?![\w.])
lgpl-2.0 4 spdx-license-identifier spdx-license-identifier: ?lgpl-2\.0(?:-only|-or-later|\+)?(?![\w.])
lgpl-3.0 4 spdx-license-identifier spdx-license-identifier: ?lgpl-3\.0(?:-only|-or-later|\+)?(?![\w.])
lgpl 4 gnu.org/licenses gnu\.org/licenses/lgpl
lgpl-2.1 2 lesser general public \bgnu lesser general public licen[cs]e,? ?(?:version|v\.?) ?2\.1\b
lgpl-3.0 2 lesser general public \bgnu lesser general public licen[cs]e,? ?(?:version|v\.?) ?3\b
lgpl-2.0 2 library general public \bgnu library general public licen[cs]e,? ?(?:version|v\.?) ?2\b
lgpl 3 lesser general public (?:released|licensed|distributed) under (?:the )?(?:terms of )?(?:the )?gnu lesser general public licen[cs]e\b
lgpl 2 lesser general public \b(?:gnu )?lesser general public licen[cs]e\b
lgpl 2 library general public \b(?:gnu )?library general public licen[cs]e\b
lgpl-2.1 2 lgpl \blgplv?-?2\.1\+?(?![\w.])
lgpl-3.0 2 lgpl \blgplv?-?3(?:\.0)?\+?(?![\w.])
lgpl 2 gnu lgpl \bgnu lgpl\b
agpl-3.0 4 spdx-license-identifier spdx-license-identifier: ?agpl-3\.0(?:-only|-or-later|\+)?(?![\w.])
agpl-3.0 4 gnu.org/licenses gnu\.org/licenses/agpl
agpl-3.0 2 affero general public \b(?:gnu )?affero general public licen[cs]e,? ?(?:version|v\.?) ?3\b
agpl 3 affero general public (?:released|licensed|distributed) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public licen[cs]e\b
agpl 2 affero general public \b(?:gnu )?affero general public licen[cs]e\b
agpl-3.0 2 agpl \bagplv?-?3(?:\.0)?\+?(?![\w.])
agpl 2 gnu agpl \bgnu agpl\b
gfdl 4 spdx-license-identifier spdx-license-identifier: ?gfdl-1\.\d
gfdl 4 gnu.org/licenses gnu\.org/licenses/fdl
gfdl 4 free documentation permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl 2 free documentation \bgnu free documentation licen[cs]e\b
bsd-2-clause 4 spdx-license-identifier spdx-license-identifier: ?bsd-2-clause\b
bsd-3-clause 4 spdx-license-identifier spdx-license-identifier: ?bsd-3-clause\b
bsd-4-clause 4 spdx-license-identifier spdx-license-identifier: ?bsd-4-clause\b
0bsd 4 spdx-license-identifier spdx-license-identifier: ?0bsd\b
bsd 4 redistribution and use redistribution and use in source and binary forms, with or without modification, are permitted provided that
bsd 4 redistributions of redistributions of source code must retain the above copyright notice
bsd 4 redistributions in redistributions in binary form must reproduce the above copyright notice
bsd-3-clause 4 endorse or promote neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote
bsd-4-clause 4 all advertising materials all advertising materials mentioning features or use of this software must display
bsd-2-clause 4 opensource.org/licenses/bsd opensource\.org/licenses/bsd-2-clause
bsd-3-clause 4 opensource.org/licenses/bsd opensource\.org/licenses/bsd-3-clause
bsd 3 bsd (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:an? |the )?bsd(?:-style)? licen[cs]e\b
bsd-2-clause 2 simplified bsd \bsimplified bsd licen[cs]e\b
bsd-2-clause 2 bsd \b(?:2|two)-clause bsd\b
bsd-3-clause 2 bsd \b(?:3|three)-clause bsd\b
bsd-3-clause 2 bsd \b(?:new|modified|revised) bsd licen[cs]e\b
bsd-4-clause 2 bsd \b(?:4|four)-clause bsd\b
bsd-2-clause 2 bsd 2-clause \bbsd 2-clause\b
bsd-3-clause 2 bsd 3-clause \bbsd 3-clause\b
0bsd 2 bsd \b(?:zero|0)-clause bsd\b
bsd 2 bsd \bbsd(?:-style)? licen[cs]e\b
bsd 1 bsd-licensed \bbsd-licensed\b
isc 4 spdx-license-identifier spdx-license-identifier: ?isc\b
isc 4 permission to use, copy permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted
isc 4 opensource.org/licenses/isc opensource\.org/licenses/isc
isc 2 isc licen \bisc licen[cs]e\b
zlib 4 spdx-license-identifier spdx-license-identifier: ?zlib\b
zlib 4 origin of this software the origin of this software must not be misrepresented
zlib 2 zlib \bzlib(?:/libpng)? licen[cs]e\b
libpng 2 libpng \blibpng licen[cs]e\b
boost-1.0 4 spdx-license-identifier spdx-license-identifier: ?bsl-1\.0\b
boost-1.0 4 boost.org boost\.org/license_1_0
boost-1.0 2 boost software \bboost software licen[cs]e\b
mpl-2.0 4 spdx-license-identifier spdx-license-identifier: ?mpl-2\.0
mpl-1.1 4 spdx-license-identifier spdx-license-identifier: ?mpl-1\.1
mpl-2.0 4 mozilla this source code form is subject to the terms of the mozilla public licen[cs]e
mpl-2.0 4 mozilla.org/mpl mozilla\.org/mpl/2\.0
mpl-2.0 2 mozilla public \bmozilla public licen[cs]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
mpl-1.1 2 mozilla public \bmozilla public licen[cs]e,? ?(?:version|v\.?)? ?1\.1\b
mpl-1.0 2 mozilla public \bmozilla public licen[cs]e,? ?(?:version|v\.?)? ?1\.0\b
mpl 3 mozilla public (?:released|licensed|distributed) under (?:the )?(?:terms of )?(?:the )?mozilla public licen[cs]e\b
mpl 2 mozilla public \bmozilla public licen[cs]e\b
mpl-2.0 2 mpl \bmpl ?-?v?2\.0\b
epl-1.0 4 spdx-license-identifier spdx-license-identifier: ?epl-1\.0\b
epl-2.0 4 spdx-license-identifier spdx-license-identifier: ?epl-2\.0\b
epl-1.0 4 eclipse.org/legal eclipse\.org/legal/epl-v10
epl-2.0 4 eclipse.org/legal eclipse\.org/legal/epl-(?:2\.0|v20)
epl-2.0 2 eclipse public \beclipse public licen[cs]e,? ?(?:-|version|v\.?) ?2(?:\.0)?\b
epl-1.0 2 eclipse public \beclipse public licen[cs]e,? ?(?:-|version|v\.?) ?1(?:\.0)?\b
epl 2 eclipse public \beclipse public licen[cs]e\b
edl-1.0 2 eclipse distribution \beclipse distribution licen[cs]e\b
cddl-1.0 4 spdx-license-identifier spdx-license-identifier: ?cddl-1\.0\b
cddl-1.1 4 spdx-license-identifier spdx-license-identifier: ?cddl-1\.1\b
cddl 2 common development and dis \bcommon development and distribution licen[cs]e\b
cpl-1.0 4 spdx-license-identifier spdx-license-identifier: ?cpl-1\.0\b
cpl-1.0 2 common public licen \bcommon public licen[cs]e\b
ipl-1.0 2 ibm public \bibm public licen[cs]e\b
eupl 4 spdx-license-identifier spdx-license-identifier: ?eupl-1\.\d
eupl 2 european union public \beuropean union public licen[cs]e\b
eupl 2 eupl \beupl(?: v?|-)1\.\d\b
osl-3.0 4 spdx-license-identifier spdx-license-identifier: ?osl-3\.0\b
osl-3.0 2 open software licen \bopen software licen[cs]e\b
afl-3.0 4 spdx-license-identifier spdx-license-identifier: ?afl-3\.0\b
afl-3.0 2 academic free \bacademic free licen[cs]e\b
artistic-2.0 4 spdx-license-identifier spdx-license-identifier: ?artistic-2\.0\b
artistic-1.0 4 spdx-license-identifier spdx-license-identifier: ?artistic-1\.0
artistic-2.0 2 artistic licen \bartistic licen[cs]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
artistic 2 artistic licen \bartistic licen[cs]e\b
perl 2 same terms as perl \bunder the same terms as perl(?: itself)?\b
psf-2.0 4 spdx-license-identifier spdx-license-identifier: ?(?:psf|python)-2\.0
psf-2.0 2 python software foundation \bpython software foundation licen[cs]e\b
php-3.01 4 spdx-license-identifier spdx-license-identifier: ?php-3\.0
php-3.01 2 php licen \bphp licen[cs]e\b
ruby 2 ruby licen \bruby licen[cs]e\b
zpl-2.1 2 zope public \bzope public licen[cs]e\b
w3c 4 spdx-license-identifier spdx-license-identifier: ?w3c\b
w3c 2 w3c \bw3c(?: software)?(?: notice and)? licen[cs]e\b
ncsa 4 spdx-license-identifier spdx-license-identifier: ?ncsa\b
ncsa 2 university of illinois \buniversity of illinois(?:/ncsa)? open source licen[cs]e\b
openssl 2 openssl licen \bopenssl licen[cs]e\b
ssleay 2 ssleay \bssleay licen[cs]e\b
postgresql 4 spdx-license-identifier spdx-license-identifier: ?postgresql\b
postgresql 2 postgresql licen \bpostgresql licen[cs]e\b
unicode 4 spdx-license-identifier spdx-license-identifier: ?unicode-(?:dfs|tou|3\.0)
unicode 2 unicode \bunicode(?:, inc\.)? licen[cs]e agreement\b
icu 2 icu licen \bicu licen[cs]e\b
curl 2 curl licen \bcurl licen[cs]e\b
vim 2 vim licen \bvim licen[cs]e\b
ofl-1.1 4 spdx-license-identifier spdx-license-identifier: ?ofl-1\.1
ofl-1.1 4 scripts.sil.org scripts\.sil\.org/ofl
ofl-1.1 2 sil open font \bsil open font licen[cs]e\b
ms-pl 4 spdx-license-identifier spdx-license-identifier: ?ms-pl\b
ms-pl 2 microsoft public \bmicrosoft public licen[cs]e\b
ms-rl 4 spdx-license-identifier spdx-license-identifier: ?ms-rl\b
ms-rl 2 microsoft reciprocal \bmicrosoft reciprocal licen[cs]e\b
wtfpl 4 spdx-license-identifier spdx-license-identifier: ?wtfpl\b
wtfpl 2 wtfpl \bwtfpl\b
wtfpl 2 do what the \bdo what the f\S{1,6} you want to public licen[cs]e\b
unlicense 4 spdx-license-identifier spdx-license-identifier: ?unlicense\b
unlicense 4 unencumbered this is free and unencumbered software released into the public domain
unlicense 4 unlicense.org \bunlicense\.org\b
unlicense 2 unlicense \bthe unlicense\b
public-domain 3 public domain (?:released|placed|dedicated|put) (?:in|into|to) the public domain\b
public-domain 2 public domain \bpublic domain dedication\b
public-domain 1 public domain \b(?:is|are) in the public domain\b
cc0-1.0 4 spdx-license-identifier spdx-license-identifier: ?cc0-1\.0\b
cc0-1.0 4 creativecommons.org creativecommons\.org/publicdomain/zero/1\.0
cc0-1.0 2 cc0 \bcc0(?:[- ]1\.0)?\b
cc0-1.0 2 creative commons zero \bcreative commons zero\b
cc-pdm 4 creativecommons.org creativecommons\.org/publicdomain/mark
cc-by-4.0 4 creativecommons.org creativecommons\.org/licenses/by/4\.0
cc-by-3.0 4 creativecommons.org creativecommons\.org/licenses/by/3\.0
cc-by-2.5 4 creativecommons.org creativecommons\.org/licenses/by/2\.5
cc-by-2.0 4 creativecommons.org creativecommons\.org/licenses/by/2\.0
cc-by-sa-4.0 4 creativecommons.org creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 4 creativecommons.org creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-2.5 4 creativecommons.org creativecommons\.org/licenses/by-sa/2\.5
cc-by-sa-2.0 4 creativecommons.org creativecommons\.org/licenses/by-sa/2\.0
cc-by-nd-4.0 4 creativecommons.org creativecommons\.org/licenses/by-nd/4\.0
cc-by-nd-3.0 4 creativecommons.org creativecommons\.org/licenses/by-nd/3\.0
cc-by-nc-4.0 4 creativecommons.org creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-3.0 4 creativecommons.org creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc-sa-4.0 4 creativecommons.org creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-sa-3.0 4 creativecommons.org creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-nd-4.0 4 creativecommons.org creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-nd-3.0 4 creativecommons.org creativecommons\.org/licenses/by-nc-nd/3\.0
cc-by-4.0 3 cc \bcc[- ]by[- ]4\.0\b
cc-by-3.0 3 cc \bcc[- ]by[- ]3\.0\b
cc-by-2.5 3 cc \bcc[- ]by[- ]2\.5\b
cc-by-2.0 3 cc \bcc[- ]by[- ]2\.0\b
cc-by-sa-4.0 3 cc \bcc[- ]by[- ]sa[- ]4\.0\b
cc-by-sa-3.0 3 cc \bcc[- ]by[- ]sa[- ]3\.0\b
cc-by-nd-4.0 3 cc \bcc[- ]by[- ]nd[- ]4\.0\b
cc-by-nd-3.0 3 cc \bcc[- ]by[- ]nd[- ]3\.0\b
cc-by-nc-4.0 3 cc \bcc[- ]by[- ]nc[- ]4\.0\b
cc-by-nc-3.0 3 cc \bcc[- ]by[- ]nc[- ]3\.0\b
cc-by-nc-sa-4.0 3 cc \bcc[- ]by[- ]nc[- ]sa[- ]4\.0\b
cc-by-nc-sa-3.0 3 cc \bcc[- ]by[- ]nc[- ]sa[- ]3\.0\b
cc-by-nc-nd-4.0 3 cc \bcc[- ]by[- ]nc[- ]nd[- ]4\.0\b
cc-by-nc-nd-3.0 3 cc \bcc[- ]by[- ]nc[- ]nd[- ]3\.0\b
cc-by-nc-nd 2 cc \bcc[- ]by[- ]nc[- ]nd\b
cc-by-nc-sa 2 cc \bcc[- ]by[- ]nc[- ]sa\b
cc-by-nc 2 cc \bcc[- ]by[- ]nc\b
cc-by-nd 2 cc \bcc[- ]by[- ]nd\b
cc-by-sa 2 cc \bcc[- ]by[- ]sa\b
cc-by 1 cc \bcc[- ]by\b
cc-by-nc-nd 2 creative commons \bcreative commons attribution-noncommercial-noderiv(?:ative)?s\b
cc-by-nc-sa 2 creative commons \bcreative commons attribution-noncommercial-sharealike\b
cc-by-nc 2 creative commons \bcreative commons attribution-noncommercial\b
cc-by-nd 2 creative commons \bcreative commons attribution-noderiv(?:ative)?s\b
cc-by-sa 2 creative commons \bcreative commons attribution-sharealike\b
cc-by 2 creative commons \bcreative commons attribution\b
creative-commons 1 creative commons \bcreative commons licen[cs]e\b
odbl-1.0 4 spdx-license-identifier spdx-license-identifier: ?odbl-1\.0\b
odbl-1.0 4 opendatacommons.org opendatacommons\.org/licenses/odbl
odbl-1.0 2 open database \bopen database licen[cs]e\b
odc-by-1.0 4 opendatacommons.org opendatacommons\.org/licenses/by
odc-by-1.0 2 open data commons \bopen data commons attribution licen[cs]e\b
pddl-1.0 4 opendatacommons.org opendatacommons\.org/licenses/pddl
cdla-permissive 2 community data \bcommunity data licen[cs]e agreement\b.{0,4}permissive
cdla-sharing 2 community data \bcommunity data licen[cs]e agreement\b.{0,4}sharing
ogl-uk 2 open government \bopen government licen[cs]e\b
openrail 2 rail \b(?:creativeml |bigscience )?open ?rail(?:-m|\+\+-m)?\b
bsl-1.1 4 spdx-license-identifier spdx-license-identifier: ?busl-1\.1\b
bsl-1.1 2 business source \bbusiness source licen[cs]e\b
sspl-1.0 4 spdx-license-identifier spdx-license-identifier: ?sspl-1\.0\b
sspl-1.0 2 server side public \bserver side public licen[cs]e\b
elastic-2.0 2 elastic licen \belastic licen[cs]e(?: 2\.0)?\b
commons-clause 2 commons clause \bcommons clause licen[cs]e condition\b
json 4 shall be used for good the software shall be used for good, not evil
beerware 2 ware licen \bbeer-?ware licen[cs]e\b
proprietary 3 all rights reserved \bproprietary and confidential\b.{0,40}all rights reserved\b
proprietary 1 all rights reserved \ball rights reserved\b
proprietary 3 unauthorized copying \bunauthorized copying of this (?:file|work|document)\b
proprietary 2 licen \bend[- ]user licen[cs]e agreement\b
dual 1 dual \bdual[- ]licensed\b
copyright 1 copyright \bcopyright (?:\(c\)|©)? ?(?:19|20)\d\d\b
"""

STRENGTH = {4: 1.0, 3: 0.9, 2: 0.7, 1: 0.4}


def _parsed() -> list[tuple[str, int, str, str]]:
    """The rules, with the keyword found again as the longest start of the rest after which a regex remains."""
    found = []
    for line in _TABLE.strip().split("\n"):
        label, priority, rest = line.split(" ", 2)
        keyword = next(k for k in KEYWORDS if rest.startswith(k + " "))
        found.append((label, int(priority), keyword, rest[len(keyword) + 1 :]))
    return found


#: Longest first.
KEYWORDS = sorted(
    """permission is hereby granted;shall be included in all;spdx-license-identifier;opensource.org/licenses/mit;mit licen;mit-licensed;expat;x11;mit/x;mit no attribution;apache.org/licenses;you may not use this file;unless required by applicable law;apache licen;apache-2;asl 2;apache;gnu.org/licenses;general public licen;gnu gpl;gpl-licensed;gpl;lesser general public;library general public;gnu lgpl;lgpl;affero general public;gnu agpl;agpl;free documentation;redistribution and use;redistributions of;redistributions in;endorse or promote;all advertising materials;opensource.org/licenses/bsd;simplified bsd;bsd 2-clause;bsd 3-clause;bsd-licensed;bsd;permission to use, copy;opensource.org/licenses/isc;isc licen;origin of this software;zlib;libpng;boost.org;boost software;mozilla.org/mpl;mozilla public;mozilla;mpl;eclipse.org/legal;eclipse public;eclipse distribution;common development and dis;common public licen;ibm public;european union public;eupl;open software licen;academic free;artistic licen;same terms as perl;python software foundation;php licen;ruby licen;zope public;w3c;university of illinois;openssl licen;ssleay;postgresql licen;unicode;icu licen;curl licen;vim licen;scripts.sil.org;sil open font;microsoft public;microsoft reciprocal;wtfpl;do what the;unencumbered;unlicense.org;unlicense;public domain;creativecommons.org;cc0;creative commons zero;creative commons;cc;opendatacommons.org;open database;open data commons;community data;open government;rail;business source;server side public;elastic licen;commons clause;shall be used for good;ware licen;all rights reserved;unauthorized copying;dual;copyright;licen""".split(";"),
    key=lambda k: (-len(k), k),
)
RULES = _parsed()
#: Of these words one stands in whatever a rule matches, or the text holds none.
GATES = ("licen", "permission", "no attribution", "copyright", "apache", "gnu", "gpl", "redistribution", "bsd", "mozilla", "public domain", "creative", "cc by", "cc-by", "cc0", "mpl", "eupl", "asl 2", "endorse", "advertising", "origin of", "boost.org", "eclipse.org", "scripts.sil", "wtfpl", "opendatacommons", "openrail", "rights reserved", "unauthorized", "same terms as perl", "used for good", "unencumbered", "applicable law", "community data", "business source", "pen rail")
