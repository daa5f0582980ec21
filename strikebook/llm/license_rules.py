"""Signature rules of the license scan as data.

A rule is a pattern over words: lower-case text whose words are separated by one space. The constant V stands for
an optional "v" or "version" before a number. Each rule has a keyword that every match contains, a label,
a priority (3 wording of the license itself, 2 explicit identifiers and notices, 1 mentions) and a weight.
Order is rank: of equal intervals with equal priority the earlier rule wins.
"""

from __future__ import annotations

from dataclasses import dataclass

V = "(?:version |v |v)?"


@dataclass(frozen=True)
class LicenseRule:
    name: str
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


# Names of licenses as notices write them. label; identifier words; name words; keyword.
NAMES = (
    ("mit", "mit", "mit", "mit"),
    ("apache-2.0", "apache 2 0", f"apache (?:software )?license {V}2(?: 0)?", "apache"),
    ("apache-1.1", "apache 1 1", f"apache (?:software )?license {V}1 1", "apache"),
    ("gpl-2.0", "gpl 2 0", f"(?:gnu )?(?:general public license|gpl) {V}2(?: 0)?", "g"),
    ("gpl-3.0", "gpl 3 0", f"(?:gnu )?(?:general public license|gpl) {V}3(?: 0)?", "g"),
    ("lgpl-2.1", "lgpl 2 1", f"(?:gnu )?(?:lesser general public license|lgpl) {V}2 1", "l"),
    ("lgpl-3.0", "lgpl 3 0", f"(?:gnu )?(?:lesser general public license|lgpl) {V}3(?: 0)?", "l"),
    ("agpl-3.0", "agpl 3 0", f"(?:gnu )?(?:affero general public license|agpl) {V}3(?: 0)?", "a"),
    ("bsd-2-clause", "bsd 2 clause", "(?:simplified bsd|2 clause bsd|two clause bsd|freebsd)", "bsd"),
    ("bsd-3-clause", "bsd 3 clause", "(?:new bsd|revised bsd|3 clause bsd|three clause bsd)", "bsd"),
    ("bsd-4-clause", "bsd 4 clause", "(?:original bsd|4 clause bsd|four clause bsd)", "bsd"),
    ("isc", "isc", "isc", "isc"),
    ("mpl-1.1", "mpl 1 1", f"(?:mozilla public license|mpl) {V}1 1", "m"),
    ("mpl-2.0", "mpl 2 0", f"(?:mozilla public license|mpl) {V}2(?: 0)?", "m"),
    ("epl-1.0", "epl 1 0", f"(?:eclipse public license|epl) {V}1(?: 0)?", "e"),
    ("epl-2.0", "epl 2 0", f"(?:eclipse public license|epl) {V}2(?: 0)?", "e"),
    ("cddl-1.0", "cddl 1 0", f"(?:common development and distribution license|cddl) {V}1(?: 0)?", "c"),
    ("eupl-1.2", "eupl 1 2", f"(?:european union public licen[cs]e|eupl) {V}1 2", "e"),
    ("cc0-1.0", "cc0 1 0", "(?:cc0|creative commons zero)(?: 1 0)?", "c"),
    ("cc-by-3.0", "cc by 3 0", f"(?:cc by|creative commons attribution(?: license)?) {V}3 0", "c"),
    ("cc-by-4.0", "cc by 4 0", "(?:cc by|creative commons attribution(?: license)?) 4 0", "c"),
    ("cc-by-sa-3.0", "cc by sa 3 0", "(?:cc by sa|creative commons attribution sharealike) 3 0", "c"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "(?:cc by sa|creative commons attribution sharealike) 4 0", "c"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "(?:cc by nc|creative commons attribution noncommercial) 4 0", "c"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "(?:cc by nd|creative commons attribution noderivatives) 4 0", "c"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("bsl-1.0", "bsl 1 0", f"boost software license(?: {V}1 0)?", "b"),
    ("artistic-2.0", "artistic 2 0", f"artistic license {V}2(?: 0)?", "artistic"),
    ("psf-2.0", "psf 2 0", f"python software foundation license(?: {V}2)?", "p"),
    ("ofl-1.1", "ofl 1 1", f"(?:sil )?open font license(?: {V}1 1)?", "o"),
    ("odbl-1.0", "odbl 1 0", f"open database license(?: {V}1 0)?", "o"),
    ("ms-pl", "ms pl", "microsoft public license", "m"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("gfdl-1.3", "gfdl 1 3", f"(?:gnu )?free documentation license(?: {V}1 3)?", "g"),
)

# Ways in which a notice speaks of a license: name, words around it, priority, weight, with identifier or name.
FORMS = (
    ("identifier", "spdx license identifier {}(?: or later| only)?", 2, 1.0, 1),
    ("licensed_under", "licen[cs]ed under (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?", 2, 0.95, 2),
    ("released_under", "(?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?", 2, 0.9, 2),
    ("subject_to", "subject to (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?", 2, 0.85, 2),
    ("license_field", "licen[cs]e {}", 1, 0.8, 1),
    ("under", "under (?:the |a |an )?{} licen[cs]e", 1, 0.7, 2),
    ("named", "{} licen[cs]e", 1, 0.6, 2),
)

# Wording of the licenses themselves and notices that name none: label, keyword, words.
WORDINGS = (
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "software", "the software is provided as is without warranty of any kind"),
    ("apache-2.0", "compliance", "you may not use this (?:file|work) except in compliance with the license"),
    ("apache-2.0", "apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose"),
    ("gpl", "free", "this program is free software you can redistribute it and or modify it"),
    ("gpl", "gnu", "gnu general public license as published by the free software foundation"),
    ("lgpl", "lesser", "gnu lesser general public license as published by the free software foundation"),
    ("agpl", "affero", "gnu affero general public license as published by the free software foundation"),
    ("gpl", "implied", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mpl-2.0", "mozilla", "subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("boost", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("wtfpl", "fuck", "do what the fuck you want to public license"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("public-domain", "public", "(?:dedicated to|in|into|released into) the public domain"),
    ("cc-by", "cc", "cc by"),
    ("gpl", "general", "general public license"),
    ("reserved", "reserved", "all rights reserved"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("no-redistribution", "redistribution", "redistribution (?:is )?(?:prohibited|not permitted)"),
    ("creative-commons", "creative", "creative commons"),
)


def rules() -> tuple[LicenseRule, ...]:
    """All rules in rank order: wordings, then every form of every name."""
    found = [
        LicenseRule(f"wording_{i}", label, keyword, words, 3 if len(words.split()) > 4 else 1, 1.0 if len(words.split()) > 4 else 0.5)
        for i, (label, keyword, words) in enumerate(WORDINGS)
    ]
    for label, identifier, name, keyword in NAMES:
        for form, around, priority, weight, which in FORMS:
            words = around.replace("{}", identifier if which == 1 else name)
            key = keyword if len(keyword) > 1 else {1: "licen", 2: "licen"}[which]
            if form in ("released_under", "subject_to") and key == "licen":
                key = "under" if form == "released_under" else "subject to"
            found.append(LicenseRule(f"{form}_{label}", label, key, words, priority, weight))
    return tuple(found)
