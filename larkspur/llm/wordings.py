"""License wordings, each written by hand: what headers, grants, disclaimers, links and notices say.

A line is `label keyword wording`. In a wording a|b is either word, [a b] may be missing. The keyword is
one of the words that must occur, the rarest of them.
"""

#: Whole sentences that one license or family has alone.
SENTENCES = """
mit hereby permission is hereby granted free of charge to any person obtaining a copy
mit sublicense to use copy modify merge publish distribute sublicense and or sell copies of the software
mit substantial the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions
mit merchantability the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit holders in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit-0 sublicense to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software
x11 consortium except as contained in this notice the name of the x consortium shall not be used
isc distribute permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc disclaims the software is provided as is and the author disclaims all warranties with regard to this software
isc consequential in no event shall the author be liable for any special direct indirect or consequential damages
0bsd distribute permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
ntp permission permission to use copy modify and distribute this software and its documentation for any purpose with or without fee
hpnd supporting both that copyright notice and this permission notice appear in supporting documentation
bsd redistribution redistribution and use in source and binary forms with or without modification [are permitted]
bsd redistributions redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd redistributions redistributions in binary form must reproduce the above copyright notice
bsd contributors this software is provided by the copyright holders|owner and contributors as is
bsd disclaimed the implied warranties of merchantability and fitness for a particular purpose are disclaimed
bsd procurement procurement of substitute goods or services loss of use data or profits or business interruption
bsd-3-clause endorse may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause advertising all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-2-clause-views interpreted the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted
bsd-protection protection the bsd protection license
clear-bsd patent no express or implied licenses to any party s patent rights are granted by this license
apache-2 limitations see the license for the specific language governing permissions and limitations under the license
apache-2 compliance you may not use this file except in compliance with the license
apache-2 obtain you may obtain a copy of the license at [http|https] [www] apache org licenses
apache-2 basis software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2 contributor licensed to the apache software foundation asf under one or more contributor license agreements
apache-2 ownership see the notice file distributed with this work for additional information regarding copyright ownership
apache-2 irrevocable each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2 litigation if you institute patent litigation against any entity including a cross claim or counterclaim in a lawsuit
apache-2 trademarks this license does not grant permission to use the trade names trademarks service marks or product names of the licensor
apache-1.1 developed this product includes software developed by the apache software foundation
apache-1.1 apache products derived from this software may not be called apache
gpl redistribute this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl hope this program is distributed in the hope that it will be useful but without any warranty
gpl merchantability without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl received you should have received a copy of the gnu general public license along with this program
gpl temple free software foundation inc 59 temple place suite 330 boston
gpl franklin free software foundation inc 51 franklin street|st fifth floor boston
gpl verbatim everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-2 freedom the licenses for most software are designed to take away your freedom to share and change it
gpl-3 copyleft the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3 convey you may convey verbatim copies of the program s source code as you receive it
gpl-3 propagate to propagate a work means to do anything with it that without permission would make you directly or secondarily liable
gpl-interactive absolutely comes with absolutely no warranty
gpl-2-or-later option either version 2 of the license or at your option any later version
gpl-3-or-later option either version 3 of the license or at your option any later version
gpl-2-only version under the terms of the gnu general public license version 2 as published by the free software foundation
gpl-3-only version under the terms of the gnu general public license version 3 as published by the free software foundation
classpath-exception linking linking this library statically or dynamically with other modules is making a combined work based on this library
gcc-exception runtime gcc runtime library exception
linux-syscall-note kernel this copyright does not cover user programs that use kernel services by normal system calls
bison-exception skeleton as a special exception you may create a larger work that contains part or all of the bison parser skeleton
autoconf-exception configure as a special exception the free software foundation gives unlimited permission to copy distribute and modify the configure scripts
font-exception embed if you create a document which uses this font and embed this font or unaltered portions of this font into the document
openssl-exception openssl permission to link the code of portions of this program with the openssl library
lgpl redistribute this library is free software you can redistribute it and or modify it under the terms of the gnu lesser|library general public license
lgpl received you should have received a copy of the gnu lesser|library general public license along with this library
lgpl lesser this library is distributed in the hope that it will be useful but without any warranty see the gnu lesser general public license
lgpl-2.1-or-later lesser gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3-or-later lesser gnu lesser general public license as published by the free software foundation either version 3
lgpl-2-or-later library gnu library general public license as published by the free software foundation either version 2
agpl affero you should have received a copy of the gnu affero general public license along with this program
agpl-3 network notwithstanding any other provision of this license if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network
agpl-3-or-later affero gnu affero general public license as published by the free software foundation either version 3
agpl-3-only affero gnu affero general public license version 3 as published by
gfdl invariant with no invariant sections no front cover texts and no back cover texts
gfdl document permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl functional the purpose of this license is to make a manual textbook or other functional and useful document free
mpl subject this source code form is subject to the terms of the mozilla public license
mpl-2.0 obtain if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0-no-copyleft incompatible this source code form is incompatible with secondary licenses
mpl-1.1 mozilla the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 mozilla the contents of this file are subject to the mozilla public license version 1 0
npl netscape the contents of this file are subject to the netscape public license
epl accompanying this program and the accompanying materials are made available under the terms of the eclipse public license
epl-2.0 secondary this source code may also be made available under the following secondary licenses when the conditions for such availability set forth in the eclipse public license
edl eclipse are made available under the terms of the eclipse distribution license
cddl subject the contents of this file are subject to the terms of the common development and distribution license
cddl opensolaris you can obtain a copy of the license at usr src opensolaris license
cpl accompanying the accompanying program is provided under the terms of this common public license
ipl accompanying the accompanying program is provided under the terms of this ibm public license
cpal attribution common public attribution license version 1 0
eupl eupl licensed under the eupl version|v 1 1|2 or as soon they will be approved by the european commission
eupl licence you may not use this work except in compliance with the licence you may obtain a copy of the licence at
cecill abiding this software is governed by the cecill [b] [c] license under french law and abiding by the rules of distribution of free software
artistic artistic this is the artistic license
artistic perl this program is free software you can redistribute it and or modify it under the same terms as perl itself
perl perl this library is free software you can redistribute it and or modify it under the same terms as perl itself
artistic-2.0 standard the standard version of the package
zlib misrepresented the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib altered altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib arising in no event will the authors be held liable for any damages arising from the use of this software
zlib notice this notice may not be removed or altered from any source distribution
libpng png the png reference library is supplied as is
boost-1.0 machine unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
boost-1.0 boost distributed under the boost software license version 1 0
boost-1.0 accompanying see accompanying file license 1 0 txt or copy at
unlicense unencumbered this is free and unencumbered software released into the public domain
unlicense detriment we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
unlicense compile anyone is free to copy modify publish use compile sell or distribute this software
cc0-1.0 waived to the extent possible under law the author|authors|person has|have|who [associated cc0 with this work has] waived all copyright and related or neighboring rights
cc0-1.0 waives affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
cc-pdm known this work has been identified as being free of known restrictions under copyright law
cc-by share you are free to share copy and redistribute the material in any medium or format
cc-by appropriate you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-nc commercial you may not use the material for commercial purposes
cc-by-sa transform if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nd remix if you remix transform or build upon the material you may not distribute the modified material
cc-by licensed licensed under a creative commons attribution [2|3|4] [0|5] [international|unported|generic] license
wtfpl verbatim everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
wtfpl fuck you just do what the fuck you want to
beerware beer if we meet some day and you think this stuff is worth it you can buy me a beer in return
postgresql postgresql postgresql database management system
postgresql california in no event shall the university of california be liable to any party
ncsa illinois developed by the university of illinois
ncsa deal to deal with the software without restriction including without limitation the rights
openssl toolkit this product includes software developed by the openssl project for use in the openssl toolkit
ssleay cryptographic this product includes cryptographic software written by eric young
php php this product includes php software freely available from
zpl zope this software is subject to the provisions of the zope public license
python-2 psf psf is making python available to licensee on an as is basis
python-2 beopen beopen grants the individual or organization
python-cnri cnri cnri open source license agreement
ruby below you can redistribute it and or modify it under either the terms of the 2 clause bsdl|gpl or the conditions below
ruby ruby ruby is copyrighted free software by yukihiro matsumoto
vim vim bram moolenaar vim charityware license
tcl existing the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose provided that existing copyright notices are retained
ofl-1.1 font this font software is licensed under the sil open font license
ofl-1.1 reserved no modified version of the font software may use the reserved font name
ofl-1.1 sold neither the font software nor any of its individual components may be sold by itself
ubuntu-font ubuntu licensed under the ubuntu font licence
bitstream-vera vera bitstream vera is a trademark of bitstream
lppl maintained this work has the lppl maintenance status maintained
lppl latex this work may be distributed and or modified under the conditions of the latex project public license
ms-pl governs this license governs use of the accompanying software if you use the software you accept this license
ms-rl recipients for any file you distribute that contains code from the software you must provide recipients the source code to that file
upl-1.0 larger the larger works to which the software is contributed|either
bsl-1.1 grant additional use grant [none] change date
bsl-1.1 production the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
sspl-1.0 service if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 hosted you may not provide the software to third parties as a hosted or managed service
polyform noncommercial polyform noncommercial license
polyform polyform polyform small business|perimeter|shield|strict license
commons-clause commons the software is provided to you by the licensor under the license as defined below subject to the following condition commons clause
commons-clause sell the grant of rights under the license will not include and the license does not grant to you the right to sell the software
rail responsible open responsible ai license
rail responsible responsible ai license use based restrictions|restriction
llama llama this agreement governs your use of llama materials|community license
jpeg independent this software is based in part on the work of the independent jpeg group
curl stenberg copyright and permission notice copyright c daniel stenberg
freetype freetype portions of this software are copyright the freetype project
imagemagick imagemagick imagemagick studio llc a non profit organization
unicode unicode permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
unicode unicode unicode inc license agreement data files and software
w3c w3c w3c software notice and license
w3c obtaining this work is being provided by the copyright holders under the following license by obtaining using and or copying this work
icu icu icu license icu 1 8 1 and later
jdom jdom this product includes software developed by the jdom project
mulan mulan mulan permissive software license
mulan mulan mulan psl v2
json evil the software shall be used for good not evil
sleepycat accompanied redistributions in any form must be accompanied by information on how to obtain complete source code
blueoak blue blue oak model license
hippocratic hippocratic the hippocratic license
anti-996 996 anti 996 license
odbl-1.0 database this database is made available under the open database license
odbl-1.0 odbl contains information from which is made available here under the open database license odbl
pddl-1.0 dedication public domain dedication and licence|license
ogl open contains public sector information licensed under the open government licence
ogl government you may use and re use this information free of charge in any format or medium under the terms of the open government licence
""".strip("\n")

#: Links and short headers.
HEADERS = """
mit opensource opensource org licenses mit
apache-2 opensource opensource org licenses apache 2 0
bsd opensource opensource org licenses bsd [license|3|2] [clause|php]
isc opensource opensource org licenses isc
gpl opensource opensource org licenses gpl
mpl opensource opensource org licenses mpl
artistic opensource opensource org licenses artistic
zlib opensource opensource org licenses zlib
epl opensource opensource org licenses eclipse
apache-2 apache apache org licenses license 2 0
apache apache apache org licenses
gpl gnu gnu org licenses gpl
gpl gnu gnu org copyleft gpl
lgpl gnu gnu org licenses lgpl
lgpl gnu gnu org copyleft lesser
agpl gnu gnu org licenses agpl
gfdl gnu gnu org licenses fdl
gpl-2 gnu gnu org licenses old licenses gpl 2 0
lgpl-2.1 gnu gnu org licenses old licenses lgpl 2 1
mpl-2.0 mozilla mozilla org mpl 2 0
mpl-1.1 mozilla mozilla org mpl mpl 1 1
mpl mozilla mozilla org mpl
epl eclipse eclipse org legal epl v10|v20|2
edl eclipse eclipse org org documents edl v10
boost-1.0 boost boost org license 1 0 txt
unlicense unlicense unlicense org
wtfpl wtfpl wtfpl net
cc0-1.0 creativecommons creativecommons org publicdomain zero
cc-pdm creativecommons creativecommons org publicdomain mark
ofl-1.1 sil scripts sil org ofl
cecill cecill cecill info
zlib zlib zlib net zlib license
openssl openssl openssl org source license
php php php net license 3|3 [01] [txt]
python psf docs python org license psf
ms-pl microsoft microsoft com opensource licenses
eupl eupl ec europa eu idabc eupl
eupl joinup joinup ec europa eu software page eupl
cddl sun sun com cddl
cddl glassfish glassfish dev java net public cddl gpl
odbl-1.0 opendatacommons opendatacommons org licenses odbl
odc-by-1.0 opendatacommons opendatacommons org licenses by
pddl-1.0 opendatacommons opendatacommons org licenses pddl
artistic perlfoundation perlfoundation org artistic license 2 0
lppl latex latex project org lppl
elastic-2.0 elastic co licensing elastic license
sspl-1.0 mongodb mongodb com licensing server side public license
gpl-2 copying see the file copying gpl version 2
mit license license mit
apache-2 license license apache 2 0
gpl-3 license license gpl 3 [0] [only|later]
gpl-2 license license gpl 2 [0] [only|later]
bsd-3-clause license license bsd 3 clause
bsd-2-clause license license bsd 2 clause
mit osi license osi approved mit license
apache osi license osi approved apache software license
bsd osi license osi approved bsd license
gpl osi license osi approved gnu general public license
gpl-3 gplv3 osi approved gnu general public license v3 gplv3
gpl-2 gplv2 osi approved gnu general public license v2 gplv2
lgpl osi license osi approved gnu lesser general public license
mpl-2.0 osi license osi approved mozilla public license 2 0
isc iscl osi approved isc license iscl
""".strip("\n")

#: What families are called in passing, dedications and reservations.
MENTIONS = """
mit mit under the mit license
mit expat expat license
mit mit mit x11 license
mit mit released under mit
bsd bsd bsd [style] license|licence
bsd-3-clause bsd revised|new|modified bsd license
bsd-2-clause bsd simplified|freebsd bsd license
bsd-3-clause modified the modified bsd license
apache-2 apache apache license [version] 2 [0]
apache-2 asl2 asl2
apache apache apache [software] license|licence
gpl gpl gpl license|licence|licensed
gpl gpl under the [gnu] gpl
gpl gplv2 gplv2 or later
gpl gnu gnu public license
lgpl lgpl lgpl license|licence|licensed
lgpl lgpl under the [gnu] lgpl
lgpl lesser lesser general public license
agpl affero affero general public license
gpl-3-or-later general general public license version 3 or [at your option any] later
gpl-2-or-later general general public license version 2 or [at your option any] later
mpl mpl mpl license|licence|licensed
dual dual dual licensed under
dual either licensed under either of
multi tri tri licensed|license
cddl cddl cddl license|licence
epl eclipse eclipse license|licence
artistic perl same terms as perl
unlicense unlicense the unlicense
public-domain domain released|dedicated|placed|donated [in|to|into] the public domain
public-domain domain this file|work|code|software is in the public domain
public-domain domain public domain no copyright
public-domain domain not copyrighted public domain
government government this is a work of the u|us [s] government
wtfpl fuck do what the fuck you want to
beerware license the beer|beerware [ware] license
copyleft copyleft copyleft all wrongs reserved
proprietary reserved all rights reserved
proprietary proprietary proprietary [and confidential] license|licence
proprietary confidential confidential and proprietary
proprietary strictly unauthorized copying of this file via any medium is strictly prohibited
proprietary disclose shall not disclose such confidential information
proprietary reproduced may not be copied or reproduced without [prior|written|express] permission
proprietary evaluation for evaluation purposes only license
proprietary agreement end user license agreement
proprietary eula eula license
bsd-3-clause neither neither the name of
freeware freeware this is freeware
freeware noncommercial free for noncommercial use
freeware personal free for personal use only
shareware shareware this is shareware
research academic for academic research use only
research educational for research and educational purposes only
trademark registered is a registered trademark of
patent pending patent pending
patents patents protected by u|us [s] patents
no-warranty warranty there is no warranty to the extent permitted by law
no-warranty warranty without warranty of any kind
no-warranty liable in no event shall|will be liable
export export subject to export control laws license
""".strip("\n")
