"""Hand-written licence signatures.

They match folded text: lower-case words of letters and digits, one space
between words.  Each family line reads: label | keyword | regex of the name |
regex of the identifier.  From it come two rules, the identifier after an
SPDX tag (priority 1) and the name (priority 2).  ``PLAIN`` lines are rules of
their own: priority | label | confidence | keyword | regex.  A rule's regex is
tried only where its keyword occurs.
"""

from functools import lru_cache

FAMILIES = r"""
mit | mit | (?:the )?mit (?:x11 )?licen[cs]e(?: mit)? | mit
mit-0 | mit | mit no attribution(?: licen[cs]e)? | mit 0
x11 | x11 | (?:mit )?x11 licen[cs]e | x11
isc | isc | isc licen[cs]e | isc
0bsd | bsd | (?:zero clause bsd|bsd zero clause)(?: licen[cs]e)? | 0bsd
bsd-1-clause | bsd | (?:1|one) clause bsd(?: licen[cs]e)? | bsd 1 clause
bsd-2-clause | bsd | (?:(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e)? | bsd 2 clause
bsd-3-clause | bsd | (?:(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)? | bsd 3 clause
bsd-4-clause | bsd | (?:(?:4|four) clause bsd|original bsd|old bsd)(?: licen[cs]e)? | bsd 4 clause
bsd-3-clause-clear | bsd | clear bsd(?: licen[cs]e)? | bsd 3 clause clear
apache-1.0 | apache | apache (?:software )?licen[cs]e (?:version |v ?)?1 0 | apache 1 0
apache-1.1 | apache | apache (?:software )?licen[cs]e (?:version |v ?)?1 1 | apache 1 1
apache-2.0 | apache | apache (?:software )?licen[cs]e (?:version |v ?)?2(?: 0)? | apache 2 0
gpl-1.0 | general public | (?:gnu )?general public licen[cs]e (?:version |v ?)1(?: 0)? | gpl 1 0(?: only| or later)?
gpl-2.0 | general public | (?:gnu )?general public licen[cs]e (?:version |v ?)2(?: 0)? | gpl 2 0(?: only| or later)?
gpl-3.0 | general public | (?:gnu )?general public licen[cs]e (?:version |v ?)3(?: 0)? | gpl 3 0(?: only| or later)?
lgpl-2.0 | general public | (?:gnu )?library general public licen[cs]e(?: (?:version |v ?)2(?: 0)?)? | lgpl 2 0(?: only| or later)?
lgpl-2.1 | general public | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)2 1 | lgpl 2 1(?: only| or later)?
lgpl-3.0 | general public | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)3(?: 0)? | lgpl 3 0(?: only| or later)?
agpl-1.0 | affero | affero general public licen[cs]e (?:version |v ?)1(?: 0)? | agpl 1 0(?: only| or later)?
agpl-3.0 | affero | (?:gnu )?affero general public licen[cs]e (?:version |v ?)3(?: 0)? | agpl 3 0(?: only| or later)?
gfdl-1.1 | documentation | (?:gnu )?free documentation licen[cs]e (?:version |v ?)1 1 | gfdl 1 1(?: only| or later)?
gfdl-1.2 | documentation | (?:gnu )?free documentation licen[cs]e (?:version |v ?)1 2 | gfdl 1 2(?: only| or later)?
gfdl-1.3 | documentation | (?:gnu )?free documentation licen[cs]e (?:version |v ?)1 3 | gfdl 1 3(?: only| or later)?
mpl-1.0 | mozilla | mozilla public licen[cs]e (?:version |v ?)?1 0 | mpl 1 0
mpl-1.1 | mozilla | mozilla public licen[cs]e (?:version |v ?)?1 1 | mpl 1 1
mpl-2.0 | mozilla | mozilla public licen[cs]e (?:version |v ?)?2(?: 0)? | mpl 2 0
epl-1.0 | eclipse | eclipse public licen[cs]e (?:version |v ?)?1(?: 0)? | epl 1 0
epl-2.0 | eclipse | eclipse public licen[cs]e (?:version |v ?)?2(?: 0)? | epl 2 0
edl-1.0 | eclipse | eclipse distribution licen[cs]e(?: (?:version |v ?)?1(?: 0)?)? | edl 1 0
cddl-1.0 | common development | common development and distribution licen[cs]e (?:version |v ?)?1 0 | cddl 1 0
cddl-1.1 | common development | common development and distribution licen[cs]e (?:version |v ?)?1 1 | cddl 1 1
cpl-1.0 | common public | common public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)? | cpl 1 0
cpal-1.0 | common public | common public attribution licen[cs]e(?: (?:version |v ?)?1(?: 0)?)? | cpal 1 0
ipl-1.0 | ibm | ibm public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)? | ipl 1 0
eupl-1.1 | european union | european union public licen[cs]e (?:version |v ?)?1 1 | eupl 1 1
eupl-1.2 | european union | european union public licen[cs]e (?:version |v ?)?1 2 | eupl 1 2
artistic-1.0 | artistic | artistic licen[cs]e (?:version |v ?)?1(?: 0)? | artistic 1 0
artistic-2.0 | artistic | artistic licen[cs]e (?:version |v ?)?2(?: 0)? | artistic 2 0
bsl-1.0 | boost | boost software licen[cs]e(?: (?:version |v ?)?1(?: 0)?)? | bsl 1 0
busl-1.1 | business | business source licen[cs]e(?: (?:version |v ?)?1 1)? | busl 1 1
sspl-1.0 | server side | server side public licen[cs]e(?: (?:version |v ?)?1)? | sspl 1 0
elastic-2.0 | elastic | elastic licen[cs]e (?:version |v ?)?2(?: 0)? | elastic 2 0
unlicense | unlicense | the unlicense | unlicense
wtfpl | public | do what the f\w+ you want to public licen[cs]e | wtfpl
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib
libpng | libpng | libpng licen[cs]e(?: (?:version |v ?)?2)? | libpng(?: 2 0)?
openssl | openssl | openssl licen[cs]e | openssl
ssleay | ssleay | ssleay licen[cs]e | ssleay
python-2.0 | python | python (?:software foundation )?licen[cs]e (?:version |v ?)?2(?: 0)? | python 2 0
psf-2.0 | python | psf licen[cs]e(?: agreement)?(?: for)? python | psf 2 0
php-3.0 | php | php licen[cs]e (?:version |v ?)?3 0 | php 3 0
php-3.01 | php | php licen[cs]e (?:version |v ?)?3 01 | php 3 01
ruby | ruby | ruby licen[cs]e | ruby
postgresql | postgresql | postgresql licen[cs]e | postgresql
ncsa | illinois | university of illinois ncsa open source licen[cs]e | ncsa
w3c | w3c | w3c software (?:notice and )?licen[cs]e | w3c
vim | vim | vim licen[cs]e | vim
tcl | tcl | tcl tk licen[cs]e | tcl
curl | curl | curl licen[cs]e | curl
beerware | beer | beer ?ware licen[cs]e | beerware
afl-2.1 | academic | academic free licen[cs]e (?:version |v ?)?2 1 | afl 2 1
afl-3.0 | academic | academic free licen[cs]e (?:version |v ?)?3(?: 0)? | afl 3 0
osl-2.1 | open software | open software licen[cs]e (?:version |v ?)?2 1 | osl 2 1
osl-3.0 | open software | open software licen[cs]e (?:version |v ?)?3(?: 0)? | osl 3 0
ofl-1.0 | font | (?:sil )?open font licen[cs]e (?:version |v ?)?1 0 | ofl 1 0
ofl-1.1 | font | (?:sil )?open font licen[cs]e (?:version |v ?)?1 1 | ofl 1 1
odbl-1.0 | database | open (?:data commons open )?database licen[cs]e(?: (?:version |v ?)?1(?: 0)?)? | odbl 1 0
odc-by-1.0 | open data | open data commons attribution licen[cs]e(?: (?:version |v ?)?1(?: 0)?)? | odc by 1 0
pddl-1.0 | public domain | public domain dedication and licen[cs]e(?: (?:version |v ?)?1(?: 0)?)? | pddl 1 0
ms-pl | microsoft | microsoft public licen[cs]e | ms pl
ms-rl | microsoft | microsoft reciprocal licen[cs]e | ms rl
apsl-2.0 | apple | apple public source licen[cs]e(?: (?:version |v ?)?2(?: 0)?)? | apsl 2 0
npl-1.1 | netscape | netscape public licen[cs]e(?: (?:version |v ?)?1 1)? | npl 1 1
qpl-1.0 | public | q public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)? | qpl 1 0
sleepycat | sleepycat | sleepycat (?:public )?licen[cs]e | sleepycat
spl-1.0 | sun | sun public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)? | spl 1 0
zpl-2.1 | zope | zope public licen[cs]e(?: (?:version |v ?)?2 1)? | zpl 2 1
lppl-1.3c | latex | latex project public licen[cs]e(?: (?:version |v ?)?1 3c?)? | lppl 1 3c
cecill-2.1 | cecill | cecill (?:free software )?licen[cs]e(?: agreement)?(?: (?:version |v ?)?2 1)? | cecill 2 1
cecill-b | cecill | cecill b(?: free software)? licen[cs]e | cecill b
cecill-c | cecill | cecill c(?: free software)? licen[cs]e | cecill c
upl-1.0 | universal | universal permissive licen[cs]e(?: (?:version |v ?)?1(?: 0)?)? | upl 1 0
ecl-2.0 | educational | educational community licen[cs]e(?: (?:version |v ?)?2(?: 0)?)? | ecl 2 0
blueoak-1.0.0 | blue oak | blue oak model licen[cs]e(?: 1 0 0)? | blueoak 1 0 0
hippocratic-2.1 | hippocratic | hippocratic licen[cs]e(?: (?:version |v ?)?2 1)? | hippocratic 2 1
mulanpsl-2.0 | mulan | mulan (?:psl|permissive software licen[cs]e)(?: (?:version |v ?)?2)? | mulanpsl 2 0
polyform-noncommercial-1.0.0 | polyform | polyform noncommercial licen[cs]e(?: 1 0 0)? | polyform noncommercial 1 0 0
openrail | rail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)? | openrail
llama2 | llama | llama 2 community licen[cs]e(?: agreement)? | llama2
rpl-1.5 | reciprocal | reciprocal public licen[cs]e(?: (?:version |v ?)?1 5)? | rpl 1 5
cc0-1.0 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)? | cc0 1 0
cc-by-1.0 | cc by | cc by 1 0 | cc by 1 0
cc-by-2.0 | cc by | cc by 2 0 | cc by 2 0
cc-by-2.5 | cc by | cc by 2 5 | cc by 2 5
cc-by-3.0 | cc by | cc by 3 0 | cc by 3 0
cc-by-4.0 | cc by | cc by 4(?: 0)? | cc by 4 0
cc-by-sa-2.0 | cc by | cc by sa 2 0 | cc by sa 2 0
cc-by-sa-2.5 | cc by | cc by sa 2 5 | cc by sa 2 5
cc-by-sa-3.0 | cc by | cc by sa 3(?: 0)? | cc by sa 3 0
cc-by-sa-4.0 | cc by | cc by sa 4(?: 0)? | cc by sa 4 0
cc-by-nd-3.0 | cc by | cc by nd 3(?: 0)? | cc by nd 3 0
cc-by-nd-4.0 | cc by | cc by nd 4(?: 0)? | cc by nd 4 0
cc-by-nc-2.0 | cc by | cc by nc 2 0 | cc by nc 2 0
cc-by-nc-3.0 | cc by | cc by nc 3(?: 0)? | cc by nc 3 0
cc-by-nc-4.0 | cc by | cc by nc 4(?: 0)? | cc by nc 4 0
cc-by-nc-sa-3.0 | cc by | cc by nc sa 3(?: 0)? | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc by | cc by nc sa 4(?: 0)? | cc by nc sa 4 0
cc-by-nc-nd-3.0 | cc by | cc by nc nd 3(?: 0)? | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc by | cc by nc nd 4(?: 0)? | cc by nc nd 4 0
"""

PLAIN = r"""
2 | cc-by-4.0 | 0.95 | creative commons | creative commons attribution 4 0(?: international)?(?: public)?(?: licen[cs]e)?
2 | cc-by-3.0 | 0.95 | creative commons | creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?
2 | cc-by-sa-4.0 | 0.95 | creative commons | creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: licen[cs]e)?
2 | cc-by-sa-3.0 | 0.95 | creative commons | creative commons attribution share ?alike 3 0(?: unported)?(?: licen[cs]e)?
2 | cc-by-nd-4.0 | 0.95 | creative commons | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: licen[cs]e)?
2 | cc-by-nc-4.0 | 0.95 | creative commons | creative commons attribution non ?commercial 4 0(?: international)?(?: licen[cs]e)?
2 | cc-by-nc-sa-4.0 | 0.95 | creative commons | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: licen[cs]e)?
2 | cc-by-nc-nd-4.0 | 0.95 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: licen[cs]e)?
3 | cc | 0.6 | creative commons | (?:under )?(?:a |the )?creative commons(?: \w+){0,5} licen[cs]e
3 | cc-by | 0.7 | cc by | (?:licensed under )?cc by
3 | cc-by-sa | 0.7 | cc by sa | (?:licensed under )?cc by sa
3 | cc-by-nc | 0.7 | cc by nc | (?:licensed under )?cc by nc
3 | cc-by-nd | 0.7 | cc by nd | (?:licensed under )?cc by nd
3 | cc-by-nc-sa | 0.7 | cc by nc sa | (?:licensed under )?cc by nc sa
3 | cc-by-nc-nd | 0.7 | cc by nc nd | (?:licensed under )?cc by nc nd
2 | gpl-3.0 | 0.9 | general public | general public licen[cs]e as published by the free software foundation either version 3
2 | gpl-2.0 | 0.9 | general public | general public licen[cs]e as published by the free software foundation either version 2
2 | gpl-2.0 | 0.9 | gpl | gpl ?v ?2(?: 0)?(?: only| or later)?
2 | gpl-3.0 | 0.9 | gpl | gpl ?v ?3(?: 0)?(?: only| or later)?
2 | lgpl-2.1 | 0.9 | lgpl | lgpl ?v ?2 1(?: only| or later)?
2 | lgpl-3.0 | 0.9 | lgpl | lgpl ?v ?3(?: 0)?(?: only| or later)?
2 | agpl-3.0 | 0.9 | agpl | agpl ?v ?3(?: 0)?(?: only| or later)?
3 | gpl | 0.8 | general public | (?:gnu )?general public licen[cs]e
3 | lgpl | 0.8 | general public | (?:gnu )?(?:lesser|library) general public licen[cs]e
3 | agpl | 0.8 | affero | (?:gnu )?affero general public licen[cs]e
3 | gpl | 0.5 | gnu gpl | gnu gpl
3 | lgpl | 0.5 | gnu lgpl | gnu lgpl
3 | gfdl | 0.7 | documentation | (?:gnu )?free documentation licen[cs]e
3 | apache | 0.8 | apache | apache (?:software )?licen[cs]e
3 | bsd | 0.6 | bsd | (?:licensed under (?:the |a )?)?bsd(?: style)? licen[cs]e
3 | mpl | 0.7 | mozilla | mozilla public licen[cs]e
3 | epl | 0.7 | eclipse | eclipse public licen[cs]e
3 | cddl | 0.7 | common development | common development and distribution licen[cs]e
3 | eupl | 0.7 | european union | european union public licen[cs]e
3 | artistic | 0.6 | artistic | (?:perl )?artistic licen[cs]e
3 | python | 0.6 | python | python (?:software foundation )?licen[cs]e
3 | php | 0.6 | php | php licen[cs]e
3 | elastic | 0.6 | elastic | elastic licen[cs]e
3 | ofl | 0.7 | font | (?:sil )?open font licen[cs]e
3 | afl | 0.6 | academic | academic free licen[cs]e
3 | osl | 0.6 | open software | open software licen[cs]e
2 | mit | 0.9 | permission is | permission is hereby granted free of charge to any person obtaining a copy of this software
2 | mit | 0.8 | as is without | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
2 | isc | 0.9 | permission to | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
2 | bsd | 0.8 | redistribution | redistributions? (?:and use )?in source and binary forms with or without modification are permitted
2 | bsd-2-clause | 0.7 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
2 | bsd-3-clause | 0.85 | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
2 | bsd-4-clause | 0.85 | advertising | all advertising materials mentioning features or use of this software must display
2 | apache-2.0 | 0.9 | apache | you may not use this file except in compliance with the licen[cs]e(?: \w+){0,20} apache org licenses licen[cs]e 2 0
2 | zlib | 0.85 | altered source | altered source versions must be plainly marked as such
2 | unlicense | 0.9 | unencumbered | this is free and unencumbered software released into the public domain
2 | bsl-1.0 | 0.9 | boost | distributed under the boost software licen[cs]e
2 | cc0-1.0 | 0.8 | waived | (?:has )?waived all copyright and related or neighboring rights
2 | wtfpl | 0.9 | wtfpl | (?:licensed under (?:the )?)?wtfpl
3 | public-domain | 0.7 | public domain | (?:released |placed |dedicated )(?:in|into|to) the public domain
3 | public-domain | 0.4 | public domain | (?:is |are )in the public domain
3 | all-rights-reserved | 0.6 | rights reserved | all rights reserved
3 | proprietary | 0.7 | proprietary | proprietary and confidential
3 | proprietary | 0.6 | unauthorized | unauthorized (?:copying|use|distribution)(?: \w+){0,6} (?:is )?(?:strictly )?prohibited
3 | eula | 0.7 | end user | end user licen[cs]e agreement
3 | commercial | 0.6 | commercial | commercial licen[cs]e
3 | non-commercial | 0.6 | commercial use | (?:for )?non ?commercial use only
3 | dual | 0.6 | dual | dual licen[cs]ed
3 | copyleft | 0.5 | copyleft | copyleft
3 | spdx | 0.6 | spdx | spdx licen[cs]e identifier
4 | licensed | 0.4 | licensed under | (?:is )?licensed under (?:the )?(?:\w+ ){0,3}licen[cs]e
4 | licensed | 0.4 | released under | (?:is )?released under (?:the )?(?:\w+ ){0,3}licen[cs]e
4 | licensed | 0.4 | distributed under | (?:is )?distributed under (?:the )?(?:terms of (?:the )?)?(?:\w+ ){0,3}licen[cs]e
4 | licensed | 0.3 | see the licen | see the licen[cs]e (?:file )?for (?:more )?(?:details|information)
4 | licensed | 0.3 | licen | licen[cs]e file
4 | open-source | 0.3 | open source | open source licen[cs]e
4 | copyright | 0.3 | copyright | copyright (?:c )?(?:19|20)\d\d
"""


def spellings(regex: str) -> list[str]:
    """Texts that a rule's regex matches: each alternative, repeats at their least and once more."""
    from re import _constants as c
    from re import _parser

    def of(parts) -> list[str]:
        found = [""]
        for op, arg in parts:
            if op is c.LITERAL:
                each = [chr(arg)]
            elif op is c.IN:
                each = [x for o, v in arg for x in ({c.CATEGORY_DIGIT: ["7"], c.CATEGORY_WORD: ["w"]}[v] if o is c.CATEGORY else [chr(v)])]
            elif op is c.BRANCH:
                each = [x for branch in arg[1] for x in of(branch)]
            elif op is c.SUBPATTERN:
                each = of(arg[3])
            elif op is c.MAX_REPEAT:
                once = of(arg[2])
                each = [x * k for k in (arg[0], min(arg[0] + 1, arg[1])) for x in once]
            else:
                raise ValueError(f"{regex}: {op}")
            found = [f + x for f in found for x in dict.fromkeys(each)]
        return found

    return of(_parser.parse(regex))


def gated(keyword: str, regex: str) -> str:
    """The keyword with the spaces around it that all spellings have; they must hold the keyword."""
    texts = [f" {x} " for x in spellings(regex)]
    for k in (f" {keyword} ", f" {keyword}", f"{keyword} ", keyword):
        if all(k in x for x in texts):
            return k
    raise ValueError(f"{regex} matches without its keyword {keyword}")


@lru_cache(maxsize=1)
def rules() -> list[tuple[int, str, float, str, str]]:
    """Priority (1 is highest), label, confidence, keyword and regex of each rule.

    The regexes match whole words of text with a space at either end; the
    space before is looked behind at, the one after looked ahead at.  Keywords
    have a space where a word begins or ends in every spelling.
    """
    whole = lambda r: f"(?<= )(?:{r})(?= )"
    out = []
    for line in filter(None, FAMILIES.strip().splitlines()):
        label, keyword, name, tag = (x.strip() for x in line.split(" | "))
        spdx = rf"spdx licen[cs]e identifier {tag}"
        out.append((1, label, 0.99, gated("spdx", spdx), whole(spdx)))
        out.append((2, label, 0.95, gated(keyword, name), whole(name)))
    for line in filter(None, PLAIN.strip().splitlines()):
        priority, label, confidence, keyword, regex = (x.strip() for x in line.split(" | "))
        out.append((int(priority), label, float(confidence), gated(keyword, regex), whole(regex)))
    return out


#: Rare in other text: what a rule is gated by if all its spellings have one.
RARE = (" licen", "spdx", " gpl", " cc by ", " copyright ", "redistribution")


@lru_cache(maxsize=1)
def gate() -> list[str]:
    """The fewest strings of which every spelling of every rule holds one; a text without any has no detection.

    A rule gives its first of :data:`RARE`, or its keyword.
    """
    keys = set()
    for *_, keyword, regex in rules():
        texts = [f" {x} " for x in spellings(regex.removeprefix("(?<= )").removesuffix("(?= )"))]
        keys.add(next((r for r in RARE if all(r in x for x in texts)), keyword))
    return sorted(k for k in keys if not any(o != k and o in k for o in keys))
