"""Phrases and hand-written signature rules of license notices, over lower-case words between single spaces.

Priorities: 0 denials, 1 texts of a license, 2 names with a version and identifiers, 3 addresses,
4 plain names, 5 hints. A line is ``priority label score keyword | pattern``.
"""

# The phrases that are found at all their places, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

RULES = r"""
# Denials: what they cover is no license of the text.
0 - 0 not | not (?:be )?(?:licensed|released|distributed|covered|available) under(?: the| a| any)?(?: [^ ]+){1,6}? licen[cs]e
0 - 0 incompatible | incompatible with the(?: [^ ]+){1,5}? licen[cs]e
0 - 0 unlike | unlike the(?: [^ ]+){1,5}? licen[cs]e
0 - 0 instead | instead of the(?: [^ ]+){1,5}? licen[cs]e
0 - 0 formerly | formerly (?:licensed|released|distributed) under(?: the)?(?: [^ ]+){1,6}? licen[cs]e
0 - 0 no | no longer (?:licensed|released|distributed) under(?: the)?(?: [^ ]+){1,6}? licen[cs]e
0 - 0 driver | driver s? ?licen[cs]e (?:number|office|plate)
0 - 0 driving | driving licen[cs]e
0 - 0 marriage | marriage licen[cs]e

# Texts: GNU family.
1 gpl-{v} .95 redistribute | redistribute it and or modify it under the terms of (?:version (?P<v>[123]) of )?the gnu general public license(?: as published by the free software foundation)?
1 gpl-2.0-or-later .98 either | either version 2 of the license or at your option any later version
1 gpl-3.0-or-later .98 either | either version 3 of the license or at your option any later version
1 lgpl-2.1-or-later .98 either | either version 2 1 of the license or at your option any later version
1 gpl .9 merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
1 lgpl .9 merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details
1 agpl .9 merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details
1 gpl .9 received | you should have received a copy of the gnu general public license along with this (?:program|library|file|package)
1 lgpl .9 received | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|file|package)
1 agpl .9 received | you should have received a copy of the gnu affero general public license along with this (?:program|library|file|package)
1 gpl .85 copyleft | the gnu general public license is a free copyleft license for software
1 gfdl-{v} .95 document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license(?: version (?P<v>1 [123]))?
1 lgpl-2.1-or-later .95 redistribute | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
1 lgpl-3.0-or-later .95 redistribute | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3
1 agpl-3.0-or-later .95 redistribute | redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3
# Texts: Apache and other permissive ones.
1 apache-2.0 .97 compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at
1 apache-2.0 .97 licensed | licensed under the apache license version 2 0 the license
1 apache-2.0 .95 licensed | licensed to the apache software foundation asf under one or more contributor license agreements
1 apache-2.0 .9 basis | distributed on an as is basis without warranties or conditions of any kind
1 apache-1.1 .9 apache | this product includes software developed by the apache software foundation
1 mit .97 hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 mit .9 included | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 mit .8 noninfringement | the warranties of merchantability fitness for a particular purpose and noninfringement
1 mit-0 .95 hereby | permission is hereby granted free of charge to any person obtaining a copy(?: [^ ]+){1,60}? to do so the software is provided as is
1 x11 .9 consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
1 isc .95 hereby | permission to use copy modify and or? ?distribute this software for any purpose with or without fee is hereby granted
1 0bsd .9 fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
1 ntp .9 fee | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)?(?: with or)? without fee is hereby granted
1 hpnd .85 fee | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
1 bsd-2-clause .85 binary | redistribution and use in source and binary forms with or without modification are permitted
1 bsd-3-clause .95 endorse | neither the name of(?: [^ ]+){1,16}? may be used to endorse or promote products derived from this software
1 bsd-4-clause .95 acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
1 bsd-3-clause-clear .95 patent | no express or implied licenses to any party s patent rights are granted by this license
1 bsd-protection .9 protection | the bsd protection license
1 zlib .95 origin | the origin of this software must not be misrepresented you must not claim that you wrote the original software
1 zlib .85 altered | altered source versions must be plainly marked as such
1 boost-1.0 .95 accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
1 ncsa .9 with | to deal with the software without restriction including without limitation
1 curl .9 curl | copyright and permission notice copyright c(?: [^ ]+){1,20}? curl
1 openssl .95 openssl | this product includes software developed by the openssl project for use in the openssl toolkit
1 ssleay .95 cryptographic | this product includes cryptographic software written by eric young
1 libpng .9 png | the png reference library is supplied as is
1 ijg .9 jpeg | this software is based in part on the work of the independent jpeg group
1 freetype .9 freetype | portions of this software are copyright(?: c)?(?: [^ ]+){0,6}? the freetype project
1 postgresql .95 documentation | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
1 unicode .9 unicode | any person obtaining a copy of the unicode data files and any associated documentation
1 w3c .9 obtaining | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
1 python-2.0 .9 python | psf is making python(?: [^ ]+){0,4}? available to licensee on an as is basis
1 tcl .9 authors | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
1 sqlite-blessing .95 blessing | the author disclaims copyright to this source code in place of a legal notice here is a blessing
1 json .9 evil | the software shall be used for good not evil
1 beerware .95 beer | you can buy me a beer in return
1 wtfpl .95 fuck | you just do what the fuck you want to
1 unlicense .97 unencumbered | this is free and unencumbered software released into the public domain
1 vim .85 vim | vim is charityware
1 info-zip .9 info | for the purposes of this copyright and license info zip is defined as
1 bzip2 .8 bzip2 | the program bzip2 the associated library libbzip2
1 icu .85 supporting | permission notice appear in all copies of the software and that both the above copyright notice s and this permission notice appear in supporting documentation
1 artistic-2.0 .9 verbatim | everyone is permitted to copy and distribute verbatim copies of this license document(?: [^ ]+){1,40}? artistic
1 perl .95 perl | (?:redistribute it and or modify it )?under the same terms as perl itself
1 ruby .9 ruby | (?:redistribute it and or modify it )?under the same terms as ruby
# Texts: reciprocal, data and content licenses.
1 mpl-2.0 .97 mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
1 mpl-1.1 .95 mozilla | the contents of this file are subject to the mozilla public license version 1 1
1 mpl-1.0 .9 mozilla | the contents of this file are subject to the mozilla public license version 1 0
1 epl-{v} .95 eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license v ?(?P<v>[12] 0)
1 cddl-{v} .95 distribution | subject to the terms of the common development and distribution license(?: version (?P<v>1 [01]))?
1 cpl-1.0 .9 common | made available under the terms of the common public license v ?1 0
1 apsl-2.0 .9 apple | subject to the apple public source license version 2 0
1 eupl-{v} .95 eupl | licensed under the eupl(?: version| v)? ?(?P<v>1 [012])
1 cecill .9 cecill | this software is governed by the cecill(?: [abc])? license
1 osl-3.0 .9 open | licensed under the open software license version 3 0
1 afl-3.0 .9 academic | licensed under the academic free license version 3 0
1 sspl-1.0 .9 server | you can redistribute it and or modify it under the terms of the server side public license version 1
1 busl-1.1 .9 business | use of this software is governed by the business source license
1 elastic-2.0 .9 elastic | licensed under the elastic license 2 0
1 commons-clause .9 hereunder | the license granted hereunder will not include and the license does not grant to you the right to sell the software
1 cc-by-sa-{v} .95 attribution | this work is licensed under (?:a|the) creative commons attribution share ?alike (?P<v>[1-4] [05])(?: [^ ]+)? licen[cs]e
1 cc-by-nc-{v} .95 attribution | this work is licensed under (?:a|the) creative commons attribution non ?commercial (?P<v>[1-4] [05])(?: [^ ]+)? licen[cs]e
1 cc-by-nd-{v} .95 attribution | this work is licensed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s?(?: works)? (?P<v>[1-4] [05])(?: [^ ]+)? licen[cs]e
1 cc-by-{v} .95 attribution | this work is licensed under (?:a|the) creative commons attribution (?P<v>[1-4] [05])(?: [^ ]+)? licen[cs]e
1 cc0-1.0 .95 waived | (?:has|have) waived all copyright and related or neighboring rights
1 cc0-1.0 .9 dedicated | has dedicated the work to the public domain by waiving all of his or her rights
1 public-domain .9 public | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
1 public-domain .85 public | this work is in the public domain
1 odbl-1.0 .95 database | made available under the open database license
1 odc-by-1.0 .95 data | made available under the open data commons attribution license
1 pddl-1.0 .95 dedication | made available under the public domain dedication and license
1 ofl-1.1 .95 font | this font software is licensed under the sil open font license version 1 1
1 bitstream-vera .9 bitstream | bitstream vera is a trademark of bitstream
1 ogl-uk-3.0 .9 government | licensed under the open government licence v ?3 0
1 openrail .9 restrictions | use restrictions set forth in attachment a

# Names with a version, and identifiers.
2 gpl-{v} .9 general | gnu general public licen[cs]e(?: as published by the free software foundation)?(?: v| version) ?(?P<v>[123](?: 0)?)
2 gpl-{v} .85 general | general public licen[cs]e(?: v| version) ?(?P<v>[123](?: 0)?)
2 gpl-2.0 .85 gplv2 | (?:gnu )?gplv2
2 gpl-3.0 .85 gplv3 | (?:gnu )?gplv3
2 gpl-{v} .85 gpl | (?:gnu )?gpl (?:v|version )?(?P<v>[123] 0)(?: only| or later)?
2 gpl-{v} .8 gpl | (?:gnu )?gpl (?:v|version) ?(?P<v>[123])
2 lgpl-{v} .9 lesser | gnu lesser general public licen[cs]e(?: v| version) ?(?P<v>(?:2 1|3 0|3))
2 lgpl-{v} .9 library | gnu library general public licen[cs]e(?: v| version) ?(?P<v>2(?: 0)?)
2 lgpl-2.1 .85 lgplv2 | (?:gnu )?lgplv2(?: 1)?
2 lgpl-3.0 .85 lgplv3 | (?:gnu )?lgplv3
2 lgpl-{v} .85 lgpl | (?:gnu )?lgpl (?:v|version )?(?P<v>2 [01]|3 0)(?: only| or later)?
2 agpl-{v} .9 affero | gnu affero general public licen[cs]e(?: v| version) ?(?P<v>[13](?: 0)?)
2 agpl-3.0 .85 agplv3 | (?:gnu )?agplv3
2 agpl-{v} .85 agpl | (?:gnu )?agpl (?:v|version )?(?P<v>[13] 0)(?: only| or later)?
2 gfdl-{v} .9 documentation | gnu free documentation licen[cs]e(?: v| version) ?(?P<v>1 [123])
2 gfdl-{v} .85 gfdl | gfdl (?:v|version )?(?P<v>1 [123])
2 apache-{v} .9 apache | apache(?: software)? licen[cs]e(?: v| version)? ?(?P<v>[12] [01])
2 apache-{v} .85 apache | apache (?:v|version )?(?P<v>2 0|1 1)(?: licen[cs]e)?
2 apache-2.0 .85 asl | asl (?:v|version )?2 0
2 apache-2.0 .8 apache2 | apache2(?: licen[cs]e)?
2 apache-2.0 .85 alv2 | alv2
2 mit .85 expat | (?:mit )?expat licen[cs]e
2 mit-0 .9 mit | mit 0(?: licen[cs]e)?
2 mit .8 mit | mit x11(?: licen[cs]e)?
2 bsd-{v}-clause .9 bsd | (?:the )?bsd (?P<v>[0-4]) clause(?: licen[cs]e)?
2 bsd-{v}-clause .9 clause | (?P<v>[1-4]) clause bsd(?: licen[cs]e)?
2 bsd-2-clause .85 simplified | simplified bsd licen[cs]e
2 bsd-3-clause .85 bsd | (?:new|modified|revised) bsd licen[cs]e
2 bsd-4-clause .85 bsd | (?:original|old) bsd licen[cs]e
2 0bsd .9 0bsd | 0bsd
2 mpl-{v} .9 mozilla | mozilla public licen[cs]e(?: v| version)? ?(?P<v>[12] [01])
2 mpl-{v} .85 mpl | mpl (?:v|version )?(?P<v>[12] [01])
2 mpl-2.0 .85 mplv2 | mplv2(?: 0)?
2 epl-{v} .9 eclipse | eclipse public licen[cs]e(?: v| version)? ?(?P<v>[12] 0)
2 epl-{v} .85 epl | epl (?:v|version )?(?P<v>[12] 0)
2 edl-1.0 .85 eclipse | eclipse distribution licen[cs]e(?: v| version)? ?1 0
2 cddl-{v} .9 cddl | cddl (?:v|version )?(?P<v>1 [01])
2 cpl-1.0 .85 common | common public licen[cs]e(?: v| version)? ?1 0
2 ipl-1.0 .85 ibm | ibm public licen[cs]e(?: v| version)? ?1 0
2 eupl-{v} .9 union | european union public licen[cs]e(?: v| version)? ?(?P<v>1 [012])
2 eupl-{v} .85 eupl | eupl (?:v|version )?(?P<v>1 [012])
2 artistic-{v} .9 artistic | artistic licen[cs]e(?: v| version)? ?(?P<v>[12] 0)
2 artistic-{v} .85 artistic | artistic (?P<v>[12] 0)
2 osl-{v} .85 open | open software licen[cs]e(?: v| version)? ?(?P<v>[123] [01])
2 afl-{v} .85 academic | academic free licen[cs]e(?: v| version)? ?(?P<v>[123] [012])
2 ecl-2.0 .85 educational | educational community licen[cs]e(?: v| version)? ?2 0
2 upl-1.0 .85 universal | universal permissive licen[cs]e(?: v| version)?(?: 1 0)?
2 rpl-{v} .85 reciprocal | reciprocal public licen[cs]e(?: v| version)? ?(?P<v>1 [135])
2 ms-pl .85 microsoft | microsoft public licen[cs]e(?: ms pl)?
2 ms-rl .85 microsoft | microsoft reciprocal licen[cs]e(?: ms rl)?
2 apsl-{v} .85 apple | apple public source licen[cs]e(?: v| version)? ?(?P<v>[12] [012])
2 boost-1.0 .9 boost | boost software licen[cs]e(?: v| version)?(?: 1 0)?
2 boost-1.0 .8 bsl | bsl 1 0
2 busl-1.1 .85 business | business source licen[cs]e(?: v| version)? ?1 1
2 busl-1.1 .8 busl | busl 1 1
2 sspl-1.0 .85 sspl | sspl (?:v|version )?1(?: 0)?
2 elastic-2.0 .85 elastic | elastic licen[cs]e(?: v| version)? ?2 0
2 polyform-{v} .85 polyform | polyform (?P<v>noncommercial|small business|shield|strict|perimeter|internal use) licen[cs]e(?: 1 0 0)?
2 cecill-{v} .85 cecill | cecill (?P<v>[abc]|[12] [01])
2 zpl-{v} .85 zope | zope public licen[cs]e(?: v| version)? ?(?P<v>[12] [01])
2 php-{v} .85 php | php licen[cs]e(?: v| version)? ?(?P<v>3 0[01]?|3 01)
2 python-2.0 .85 python | python (?:software foundation )?licen[cs]e(?: v| version)? ?2(?: 0)?
2 ofl-{v} .9 font | (?:sil )?open font licen[cs]e(?: v| version)? ?(?P<v>1 [01])
2 ofl-{v} .85 ofl | ofl (?:v|version )?(?P<v>1 [01])
2 odbl-1.0 .85 odbl | odbl(?: v| version)? ?1 0
2 pddl-1.0 .85 pddl | pddl(?: v| version)? ?1 0
2 odc-by-1.0 .85 odc | odc by(?: 1 0)?
2 cc0-1.0 .9 cc0 | cc0(?: v| version)?(?: 1 0)?(?: universal)?
2 cc-by-nc-sa-{v} .9 cc | cc by nc sa(?: v| version)? ?(?P<v>[1-4] [05])
2 cc-by-nc-nd-{v} .9 cc | cc by nc nd(?: v| version)? ?(?P<v>[1-4] [05])
2 cc-by-nc-{v} .9 cc | cc by nc(?: v| version)? ?(?P<v>[1-4] [05])
2 cc-by-nd-{v} .9 cc | cc by nd(?: v| version)? ?(?P<v>[1-4] [05])
2 cc-by-sa-{v} .9 cc | cc by sa(?: v| version)? ?(?P<v>[1-4] [05])
2 cc-by-{v} .9 cc | cc by(?: v| version)? ?(?P<v>[1-4] [05])
2 cc-by-nc-sa-{v} .9 creative | creative commons attribution non ?commercial share ?alike (?P<v>[1-4] [05])
2 cc-by-nc-nd-{v} .9 creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? (?P<v>[1-4] [05])
2 cc-by-nc-{v} .9 creative | creative commons attribution non ?commercial (?P<v>[1-4] [05])
2 cc-by-nd-{v} .9 creative | creative commons attribution no ?deriv(?:ative)?s?(?: works)? (?P<v>[1-4] [05])
2 cc-by-sa-{v} .9 creative | creative commons attribution share ?alike (?P<v>[1-4] [05])
2 cc-by-{v} .9 creative | creative commons attribution (?P<v>[1-4] [05])
2 {v} .9 spdx | spdx license identifier (?P<v>[^ ]+(?: (?:[0-9]+|by|nc|nd|sa|only|clause|or later)){0,5})
2 llama-{v} .85 llama | llama (?P<v>2|3|3 [123]|4) community licen[cs]e(?: agreement)?
2 bigscience-rail-1.0 .85 rail | bigscience (?:bloom )?(?:open )?rail(?: m)?(?: licen[cs]e)?(?: v| version)?(?: 1 0)?
2 creativeml-openrail-m .85 creativeml | creativeml open ?rail m(?: licen[cs]e)?

# Addresses.
3 gpl-{v} .85 gnu | (?:https? )?(?:www )?gnu org (?:copyleft|licen[cs]es(?: old licenses)?) gpl(?: (?P<v>[123] 0))?(?: (?:en )?(?:html|txt))?
3 lgpl-{v} .85 gnu | (?:https? )?(?:www )?gnu org (?:copyleft|licen[cs]es(?: old licenses)?) (?:lesser|lgpl)(?: (?P<v>2 1|3 0))?(?: (?:html|txt))?
3 agpl-3.0 .85 gnu | (?:https? )?(?:www )?gnu org licen[cs]es agpl(?: 3 0)?(?: (?:html|txt))?
3 gfdl .85 gnu | (?:https? )?(?:www )?gnu org licen[cs]es fdl(?: 1 [123])?(?: (?:html|txt))?
3 apache-2.0 .9 apache | (?:https? )?(?:www )?apache org licen[cs]es license 2 0(?: (?:html|txt))?
3 mit .85 opensource | (?:https? )?(?:www )?opensource org licen[cs]es? mit(?: license)?(?: (?:html|php))?
3 bsd-{v}-clause .85 opensource | (?:https? )?(?:www )?opensource org licen[cs]es? bsd (?P<v>[23]) clause
3 isc .85 opensource | (?:https? )?(?:www )?opensource org licen[cs]es? isc(?: license)?
3 mpl-2.0 .85 mozilla | (?:https? )?(?:www )?mozilla org mpl 2 0
3 mpl-2.0 .8 mozilla | (?:https? )?(?:www )?mozilla org mpl
3 epl-{v} .85 eclipse | (?:https? )?(?:www )?eclipse org (?:legal|org documents) epl(?: v| )?(?P<v>[12]0|[12] 0)?(?: html)?
3 cc-{v} .9 creativecommons | (?:https? )?(?:www )?creativecommons org licen[cs]es (?P<v>by(?: nc)?(?: sa| nd)?(?: [1-4] [05])?)
3 cc0-1.0 .9 creativecommons | (?:https? )?(?:www )?creativecommons org publicdomain zero(?: 1 0)?
3 public-domain .85 creativecommons | (?:https? )?(?:www )?creativecommons org publicdomain mark(?: 1 0)?
3 unlicense .9 unlicense | (?:https? )?(?:www )?unlicense org
3 wtfpl .9 wtfpl | (?:https? )?(?:www )?wtfpl net
3 boost-1.0 .85 boost | (?:https? )?(?:www )?boost org license 1 0 txt
3 ofl-1.1 .85 sil | (?:https? )?scripts sil org ofl
3 odbl-1.0 .85 opendatacommons | (?:https? )?(?:www )?opendatacommons org licen[cs]es odbl(?: 1 0)?
3 odc-by-1.0 .85 opendatacommons | (?:https? )?(?:www )?opendatacommons org licen[cs]es by(?: 1 0)?
3 pddl-1.0 .85 opendatacommons | (?:https? )?(?:www )?opendatacommons org licen[cs]es pddl(?: 1 0)?
3 eupl .8 joinup | (?:https? )?joinup ec europa eu(?: [^ ]+){0,4} eupl
3 cecill .8 cecill | (?:https? )?(?:www )?cecill info
3 ogl-uk-3.0 .85 nationalarchives | (?:https? )?(?:www )?nationalarchives gov uk doc open government licence(?: version 3)?

# Plain names.
4 gpl .7 general | gnu general public licen[cs]es?
4 gpl .6 gpl | gnu gpl
4 gpl .6 gpl | gpl licen[cs]ed?
4 gpl .6 gpl | licensed under(?: the)? gpl
4 lgpl .7 lesser | (?:gnu )?lesser general public licen[cs]e
4 lgpl .7 library | gnu library general public licen[cs]e
4 lgpl .6 lgpl | (?:gnu )?lgpl(?: licen[cs]ed?)?
4 agpl .7 affero | (?:gnu )?affero general public licen[cs]e
4 agpl .6 agpl | (?:gnu )?agpl(?: licen[cs]ed?)?
4 gfdl .7 documentation | gnu free documentation licen[cs]e
4 gfdl .6 gfdl | gfdl
4 apache .7 apache | apache (?:software |public )?licen[cs]e
4 mit .7 mit | mit licen[cs]ed?
4 mit .7 massachusetts | massachusetts institute of technology licen[cs]e
4 x11 .65 x11 | x11 licen[cs]e
4 bsd .65 bsd | bsd (?:style )?licen[cs]ed?
4 isc .65 isc | isc licen[cs]e
4 zlib .65 zlib | zlib(?: libpng)? licen[cs]e
4 libpng .65 libpng | libpng licen[cs]e
4 mpl .65 mozilla | mozilla public licen[cs]e
4 epl .65 eclipse | eclipse public licen[cs]e
4 cddl .65 distribution | common development and distribution licen[cs]e
4 cddl .6 cddl | cddl
4 cpl .6 common | common public licen[cs]e
4 eupl .65 union | european union public licen[cs]e
4 artistic .65 artistic | artistic licen[cs]e
4 perl .6 perl | perl licen[cs]e
4 python .65 python | python (?:software foundation )?licen[cs]e
4 python .65 psf | psf licen[cs]e
4 php .6 php | php licen[cs]e
4 ruby .6 ruby | ruby licen[cs]e
4 boost .65 boost | boost (?:software )?licen[cs]e
4 unlicense .65 unlicense | (?:the )?unlicense
4 wtfpl .65 wtfpl | wtfpl
4 beerware .6 beerware | beerware(?: licen[cs]e)?
4 cc0 .65 zero | creative commons zero
4 cc-by-nc-sa .65 cc | cc by nc sa
4 cc-by-nc-nd .65 cc | cc by nc nd
4 cc-by-nc .65 cc | cc by nc
4 cc-by-nd .65 cc | cc by nd
4 cc-by-sa .65 cc | cc by sa
4 cc-by-nc-sa .65 creative | creative commons attribution non ?commercial share ?alike
4 cc-by-nc-nd .65 creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
4 cc-by-nc .65 creative | creative commons attribution non ?commercial
4 cc-by-nd .65 creative | creative commons attribution no ?deriv(?:ative)?s?
4 cc-by-sa .65 creative | creative commons attribution share ?alike
4 cc-by .65 creative | creative commons attribution(?: licen[cs]e)?
4 creative-commons .5 creative | creative commons licen[cs]e
4 odbl .65 database | open database licen[cs]e
4 odbl .6 odbl | odbl
4 ofl .65 font | (?:sil )?open font licen[cs]e
4 ubuntu-font .65 ubuntu | ubuntu font licen[cs]e
4 openssl .65 openssl | openssl licen[cs]e
4 ncsa .65 ncsa | (?:university of illinois )?ncsa open source licen[cs]e
4 w3c .65 w3c | w3c (?:software |document )?(?:notice and )?licen[cs]e
4 unicode .6 unicode | unicode (?:data files )?licen[cs]e
4 postgresql .65 postgresql | postgresql licen[cs]e
4 freetype .65 freetype | freetype (?:project )?licen[cs]e
4 vim .6 vim | vim licen[cs]e
4 tcl .6 tcl | tcl tk licen[cs]e
4 curl .6 curl | curl licen[cs]e
4 sleepycat .65 sleepycat | sleepycat (?:public )?licen[cs]e
4 qpl .6 public | q public licen[cs]e
4 cecill .6 cecill | cecill licen[cs]e
4 ms-pl .6 ms | ms pl
4 ms-rl .6 ms | ms rl
4 sspl .65 server | server side public licen[cs]e
4 busl .65 business | business source licen[cs]e
4 elastic .6 elastic | elastic licen[cs]e
4 commons-clause .65 commons | commons clause
4 hippocratic .65 hippocratic | hippocratic licen[cs]e
4 openrail .65 openrail | (?:creativeml )?openrail(?: m)?
4 llama .6 llama | llama (?:2 |3 )?community licen[cs]e
4 gemma .6 gemma | gemma terms of use
4 ogl-uk .65 government | open government licen[cs]e
4 nasa-1.3 .6 nasa | nasa open source agreement
4 intel .5 intel | intel (?:open source|simplified software) licen[cs]e
4 oracle .5 oracle | oracle (?:binary code|technology network) licen[cs]e(?: agreement)?
4 nvidia .5 nvidia | nvidia (?:software|source code) licen[cs]e(?: agreement)?

# Hints.
5 public-domain .5 public | public domain
5 all-rights-reserved .4 reserved | all rights reserved
5 proprietary .5 proprietary | proprietary and confidential
5 proprietary .5 unauthorized | unauthorized (?:copying|reproduction|distribution) of this (?:file|work|document|material)(?: [^ ]+){0,6}? is (?:strictly )?prohibited
5 eula .5 user | end user licen[cs]e agreement
5 open-source .4 osi | osi approved(?: :)?(?: licen[cs]e)?
5 other .3 permission | reprinted (?:with|by) permission
5 other .3 licensed | licensed under the terms of
"""
