"""Signature rules of the licence scan: names times the forms in which they are cited, and texts of notices.

Patterns are matched against a text's words (A-Z lower-cased), joined by single
blanks. A rule is tried only where all its keywords occur.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# The phrases of the base rules and their labels.
BASE_PHRASES = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Licences by label: (keywords, name in prose, SPDX name in words or "").
NAMES = {
    "mit": (("mit",), r"mit(?: x11)?(?: licen[sc]e)?", "mit"),
    "mit-0": (("mit", "attribution"), r"mit no attribution(?: licen[sc]e)?", "mit 0"),
    "x11": (("x11",), r"x11 licen[sc]e", "x11"),
    "isc": (("isc",), r"isc licen[sc]e", "isc"),
    "apache-1": (("apache",), r"apache (?:software )?licen[sc]e(?: v(?:ersion)?)? 1 0", "apache 1 0"),
    "apache-1.1": (("apache",), r"apache (?:software )?licen[sc]e(?: v(?:ersion)?)? 1 1", "apache 1 1"),
    "apache-2": (("apache",), r"apache(?: software)? licen[sc]e(?: v(?:ersion)?)?(?: 2| v2)(?: 0)?", "apache 2 0"),
    "bsd-0": (("bsd",), r"(?:zero|0) clause bsd(?: licen[sc]e)?", "0bsd"),
    "bsd-2": (("bsd",), r"(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[sc]e)?", "bsd 2 clause"),
    "bsd-3": (("bsd",), r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[sc]e)?", "bsd 3 clause"),
    "bsd-4": (("bsd",), r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[sc]e)?", "bsd 4 clause"),
    "bsd": (("bsd",), r"bsd(?: style)? licen[sc]e", ""),
    "mpl-1.0": (("mozilla",), r"mozilla public licen[sc]e(?: v(?:ersion)?)? 1 0", "mpl 1 0"),
    "mpl-1.1": (("mozilla",), r"mozilla public licen[sc]e(?: v(?:ersion)?)? 1 1", "mpl 1 1"),
    "mpl-2": (("mozilla",), r"mozilla public licen[sc]e(?: v(?:ersion)?)? 2(?: 0)?", "mpl 2 0"),
    "epl-1": (("eclipse",), r"eclipse public licen[sc]e(?: v(?:ersion)?)? 1(?: 0)?", "epl 1 0"),
    "epl-2": (("eclipse",), r"eclipse public licen[sc]e(?: v(?:ersion)?)? 2(?: 0)?", "epl 2 0"),
    "cddl-1.0": (("cddl",), r"cddl(?: v(?:ersion)?)? 1 0", "cddl 1 0"),
    "cddl-1.1": (("cddl",), r"cddl(?: v(?:ersion)?)? 1 1", "cddl 1 1"),
    "eupl-1.1": (("union",), r"european union public licen[sc]e(?: v(?:ersion)?)? 1 1", "eupl 1 1"),
    "eupl-1.2": (("union",), r"european union public licen[sc]e(?: v(?:ersion)?)? 1 2", "eupl 1 2"),
    "artistic-1": (("artistic",), r"artistic licen[sc]e(?: v(?:ersion)?)? 1(?: 0)?", "artistic 1 0"),
    "artistic-2": (("artistic",), r"artistic licen[sc]e(?: v(?:ersion)?)? 2(?: 0)?", "artistic 2 0"),
    "boost-1": (("boost",), r"boost software licen[sc]e(?: v(?:ersion)?)?(?: 1 0)?", "bsl 1 0"),
    "bsl-1.1": (("business",), r"business source licen[sc]e(?: v(?:ersion)?)?(?: 1 1)?", "busl 1 1"),
    "zlib": (("zlib",), r"zlib(?: libpng)? licen[sc]e", "zlib"),
    "libpng": (("libpng",), r"libpng licen[sc]e", "libpng"),
    "unlicense": (("unlicense",), r"unlicense", "unlicense"),
    "wtfpl": (("wtfpl",), r"wtfpl(?: v(?:ersion)?)?(?: 2)?", "wtfpl"),
    "cc0": (("cc0",), r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    "ofl-1.1": (("font",), r"sil open font licen[sc]e(?: v(?:ersion)?)?(?: 1 1)?", "ofl 1 1"),
    "afl-3": (("academic",), r"academic free licen[sc]e(?: v(?:ersion)?)?(?: 3 0)?", "afl 3 0"),
    "osl-3": (("open",), r"open software licen[sc]e(?: v(?:ersion)?)?(?: 3 0)?", "osl 3 0"),
    "ms-pl": (("microsoft",), r"microsoft public licen[sc]e", "ms pl"),
    "ms-rl": (("microsoft",), r"microsoft reciprocal licen[sc]e", "ms rl"),
    "python-2": (("python",), r"python(?: software foundation)? licen[sc]e(?: v(?:ersion)?)?(?: 2)?", "psf 2 0"),
    "php-3": (("php",), r"php licen[sc]e(?: v(?:ersion)?)?(?: 3 0| 3 01)?", "php 3 01"),
    "ruby": (("ruby",), r"ruby licen[sc]e", "ruby"),
    "postgresql": (("postgresql",), r"postgresql licen[sc]e", "postgresql"),
    "ncsa": (("illinois",), r"(?:university of )?illinois(?: ncsa)? open source licen[sc]e", "ncsa"),
    "zpl-2": (("zope",), r"zope public licen[sc]e(?: v(?:ersion)?)?(?: 2 [01])?", "zpl 2 1"),
    "vim": (("vim",), r"vim licen[sc]e", "vim"),
    "odbl-1": (("database",), r"open (?:data commons open )?database licen[sc]e(?: v(?:ersion)?)?(?: 1 0)?", "odbl 1 0"),
    "odc-by-1": (("commons",), r"open data commons attribution licen[sc]e(?: v(?:ersion)?)?(?: 1 0)?", "odc by 1 0"),
    "pddl-1": (("dedication",), r"(?:open data commons )?public domain dedication and licen[sc]e(?: v(?:ersion)?)?(?: 1 0)?", "pddl 1 0"),
    "elastic-2": (("elastic",), r"elastic licen[sc]e(?: v(?:ersion)?)?(?: 2(?: 0)?)?", "elastic 2 0"),
    "sspl-1": (("server",), r"server side public licen[sc]e(?: v(?:ersion)?)?(?: 1)?", "sspl 1 0"),
}

# Families with versions: name with its keyword, short name, versions; the label is the family's and the version, "-or-later" where the text says so.
GNU = {
    "gpl": (r"(?:gnu )?general public licen[sc]e", "general", r"(?:gnu )?gpl", ("1", "2", "3")),
    "lgpl": (r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "general", r"(?:gnu )?lgpl", ("2", "2 1", "3")),
    "agpl": (r"(?:gnu )?affero general public licen[sc]e", "affero", r"(?:gnu )?agpl", ("1", "3")),
    "gfdl": (r"(?:gnu )?free documentation licen[sc]e", "documentation", r"(?:gnu )?gfdl", ("1 1", "1 2", "1 3")),
}
CC_PARTS = {
    "by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s(?: works)?", "by-nc": "attribution non ?commercial",
    "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?",
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Texts of notices: (label, keywords, pattern, priority).
NOTICES = (
    ("mit", ("hereby", "granted"), r"permission is hereby granted free of charge to any person obtaining a copy", 75),
    ("isc", ("hereby", "granted"), r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 75),
    ("bsd", ("redistribution",), r"redistribution and use in source and binary forms with or without modification are permitted", 70),
    ("bsd-3", ("contributors",), r"neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|their) contributors may be used to endorse or promote", 75),
    ("bsd-4", ("advertising",), r"all advertising materials mentioning features or use of this software must display", 75),
    ("apache-2", ("apache",), r"you may not use this file except in compliance with the license", 70),
    ("unlicense", ("unencumbered",), r"this is free and unencumbered software released into the public domain", 75),
    ("zlib", ("misrepresented",), r"the origin of this software must not be misrepresented", 72),
    ("wtfpl", ("fuck",), r"you just do what the fuck you want to", 75),
    ("boost-1", ("hereby",), r"permission is hereby granted free of charge to any person or organization obtaining a copy", 76),
    ("mpl-2", ("mozilla",), r"this source code form is subject to the terms of the mozilla public licen[sc]e", 70),
    ("public-domain", ("public", "domain"), r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 65),
    ("public-domain", ("public", "domain"), r"this work is in the public domain", 65),
    ("proprietary", ("reserved",), r"all rights reserved", 30),
    ("proprietary", ("confidential",), r"(?:proprietary and confidential|confidential and proprietary)", 40),
    ("proprietary", ("prohibited",), r"unauthorized copying of this file via any medium is strictly prohibited", 60),
    ("no-warranty", ("warranty",), r"without any warranty", 20),
    ("no-warranty", ("warranties",), r"the software is provided as is without warrant(?:y|ies) of any kind", 20),
    ("copyright-notice", ("copyright",), r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?", 10),
    ("licence-mention", ("licen",), r"under (?:the|this|a) (?:[^ ]+ ){0,3}licen[sc]e", 5),
)

_GRANT = r"(?:dual )?(?:licen[sc]ed|released|distributed|published|redistributed|provided|(?:made )?available|covered|shared|offered) (?:only )?(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?"


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern
    weight: float
    base: bool = False


def _rule(form: str, label: str, priority: int, keywords: tuple[str, ...], pattern: str, weight: float, base: bool = False) -> Rule:
    return Rule(f"{form}:{label}", label, priority, keywords, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), weight, base)


def _cited(label: str, keywords: tuple[str, ...], name: str, spdx: str, titled: bool = True) -> list[Rule]:
    """A licence's forms: granted under its name, named by SPDX, at its address, in a heading."""
    rules = [_rule("grant", label, 80, keywords, _GRANT + rf"(?:{name})", 0.9)]
    if spdx:
        rules.append(_rule("spdx", label, 90, ("spdx",), rf"spdx licen[sc]e identifier {spdx}(?: only)?", 0.95))
        rules.append(_rule("address", label, 70, ("licenses",), rf"(?:www )?(?:opensource|spdx) org licenses {spdx}", 0.8))
        rules.append(_rule("field", label, 50, ("licen",), rf"licen[sc]e {spdx}", 0.6))
    if titled:
        rules.append(_rule("title", label, 60, keywords, rf"(?:the )?(?:{name})", 0.6))
    return rules


def build_rules() -> list[Rule]:
    """All rules, ordered by priority; the order settles what comes first among equals."""
    rules = [_rule("base", label, 100, tuple(w for w in phrase.split() if w != "the"), phrase, 0.7, base=True) for phrase, label in BASE_PHRASES.items()]
    for label, (keywords, name, spdx) in NAMES.items():
        rules += _cited(label, keywords, name, spdx, titled=label != "mit")
    rules.append(_rule("title", "mit", 60, ("mit", "licen"), r"(?:the )?mit licen[sc]e", 0.6))
    for family, (name, keyword, short, versions) in GNU.items():
        for v in versions:
            label = f"{family}-{v.replace(' ', '.')}"
            number = rf"(?: as published by the free software foundation)?(?: either)?(?: v(?:ersion)?)? ?v?{v}(?: 0)?"
            for suffix, tail, priority in (("", "", 0), ("-or-later", r"(?: of the licen[sc]e)? or (?:at your option )?(?:any )?later(?: version)?", 2)):
                for form, spelled, needs in (("name", name, keyword), ("short", short, family)):
                    rules.append(_rule(f"grant-{form}", label + suffix, 80 + priority, (needs,), _GRANT + rf"(?:{spelled}){number}{tail}", 0.9))
                    rules.append(_rule(form, label + suffix, 60 + priority, (needs,), rf"(?:the )?(?:{spelled}){number}{tail}", 0.7))
            rules.append(_rule("spdx", label, 90, ("spdx",), rf"spdx licen[sc]e identifier {family} {v}(?: 0)?(?: only)?", 0.95))
            rules.append(_rule("spdx", f"{label}-or-later", 91, ("spdx",), rf"spdx licen[sc]e identifier {family} {v}(?: 0)? or later", 0.95))
        rules.append(_rule("name", family, 55, (keyword,), rf"(?:the )?(?:{name})", 0.5))
        rules.append(_rule("short", family, 54, (family,), rf"(?:the )?(?:{short})", 0.4))
    for parts, words in CC_PARTS.items():
        spelled = parts.replace("-", " ")
        for v in CC_VERSIONS:
            label = f"cc-{parts}-{v.replace(' ', '.')}"
            rules.append(_rule("short", label, 62, ("cc",), rf"cc {spelled} {v}", 0.7))
            rules.append(_rule("grant", label, 82, ("cc",), _GRANT + rf"cc {spelled} {v}", 0.9))
            rules.append(_rule("name", label, 84, ("commons",), rf"creative commons {words}(?: licen[sc]e)? {v}(?: international| unported)?", 0.9))
            rules.append(_rule("address", label, 85, ("creativecommons",), rf"creativecommons org licenses {spelled} {v}", 0.95))
        rules.append(_rule("short", f"cc-{parts}", 58, ("cc",), rf"cc {spelled}", 0.5))
        rules.append(_rule("name", f"cc-{parts}", 57, ("commons",), rf"creative commons {words}", 0.6))
    rules += [_rule(f"notice{k}", label, priority, keywords, pattern, priority / 100) for k, (label, keywords, pattern, priority) in enumerate(NOTICES)]
    return sorted(rules, key=lambda r: -r.priority)
