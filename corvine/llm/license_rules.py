"""Signature rules of the license scan: label, priority, keyword, pattern over normalised words.

Patterns run over lower-cased words joined by single spaces, so "Version 2.0" reads "version 2 0".
Every pattern holds its keyword as (the start of) a word, which is what the prefilter relies on.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


#: The contract's phrases. They are never suppressed.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

LIC = "licen[sc]e"
VER = "(?:version |v )?"


def _versioned(stem: str, keyword: str, name: str, versions: tuple[str, ...]) -> list[Rule]:
    """For each version: with it, with it or any later one; and the bare name."""
    out = [Rule(stem, 4, keyword, name)]
    for v in versions:
        words = v.replace(".", " ")
        words = words[:-2] + "(?: 0)?" if words.endswith(" 0") else words
        short = v.removesuffix(".0")
        out.append(Rule(f"{stem}-{short}", 7, keyword, rf"{name} {VER}{words}(?! \d)"))
        out.append(Rule(f"{stem}-{short}-or-later", 8, keyword, rf"{name} (?:as published by the free software foundation )?(?:either )?{VER}{words} (?:of the {LIC} )?or (?:at your option )?(?:any )?later(?: version)?"))
    return out


def _creative_commons() -> list[Rule]:
    words = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
    out = [Rule("cc", 2, "creative", rf"creative commons(?: {LIC})?")]
    for parts in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        label, tail = "cc-" + "-".join(parts), r"(?! (?:sa|nc|nd)(?: |$))"
        out.append(Rule(label, 5, "cc", f"cc {' '.join(parts)}{tail}"))
        out.append(Rule(label, 5, "creative", f"creative commons {' '.join(words[p] for p in parts)}(?: {LIC})?"))
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out.append(Rule(f"{label}-{v}", 7, "cc", rf"cc {' '.join(parts)} {v.replace('.', ' ')}(?! \d)"))
            out.append(Rule(f"{label}-{v}", 7, "creative", rf"creative commons {' '.join(words[p] for p in parts)} {v.replace('.', ' ')}(?: (?:international|unported|generic))?(?: {LIC})?"))
    return out


RULES: tuple[Rule, ...] = (
    # permissive
    Rule("mit", 6, "mit", rf"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit {LIC}"),
    Rule("mit", 5, "mit", rf"(?:the )?mit {LIC}(?: mit)?"),
    Rule("mit", 5, "mit", "spdx license identifier mit"),
    Rule("mit", 8, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Rule("mit-0", 7, "mit", rf"mit (?:no attribution|0)(?: {LIC})?"),
    Rule("x11", 6, "x11", rf"x11 {LIC}"),
    Rule("isc", 6, "isc", rf"(?:the )?isc {LIC}"),
    Rule("isc", 8, "permission", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    Rule("bsd", 4, "bsd", rf"bsd (?:style )?{LIC}"),
    Rule("bsd-2-clause", 6, "bsd", rf"(?:2|two) clause bsd(?: {LIC})?"),
    Rule("bsd-2-clause", 6, "bsd", rf"bsd 2 clause(?: {LIC})?"),
    Rule("bsd-2-clause", 6, "simplified", rf"simplified bsd(?: {LIC})?"),
    Rule("bsd-3-clause", 6, "bsd", rf"(?:3|three) clause bsd(?: {LIC})?"),
    Rule("bsd-3-clause", 6, "bsd", rf"bsd 3 clause(?: clear)?(?: {LIC})?"),
    Rule("bsd-3-clause", 6, "new", rf"new bsd {LIC}"),
    Rule("bsd-3-clause", 6, "modified", rf"modified bsd {LIC}"),
    Rule("bsd-4-clause", 6, "bsd", rf"(?:4|four) clause bsd(?: {LIC})?"),
    Rule("bsd-4-clause", 6, "bsd", rf"bsd 4 clause(?: {LIC})?"),
    Rule("bsd-0-clause", 6, "bsd", rf"(?:0|zero) clause bsd(?: {LIC})?"),
    Rule("bsd", 7, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    Rule("zlib", 6, "zlib", rf"(?:the )?zlib(?: libpng)? {LIC}"),
    Rule("zlib", 7, "altered", "altered source versions must be plainly marked as such"),
    Rule("boost-1.0", 7, "boost", rf"boost software {LIC}(?: {VER}1(?: 0)?)?"),
    Rule("ncsa", 6, "ncsa", rf"(?:university of illinois )?ncsa (?:open source )?{LIC}"),
    Rule("postgresql", 6, "postgresql", rf"postgresql {LIC}"),
    Rule("curl", 6, "curl", rf"curl {LIC}"),
    Rule("libpng", 6, "libpng", rf"libpng {LIC}"),
    Rule("openssl", 6, "openssl", rf"openssl {LIC}"),
    Rule("python-2.0", 6, "python", rf"python software foundation {LIC}(?: {VER}2(?: 0)?)?"),
    Rule("ruby", 6, "ruby", rf"ruby {LIC}"),
    Rule("php-3", 6, "php", rf"php {LIC}(?: {VER}3(?: 0?1)?)?"),
    Rule("perl", 6, "perl", "same terms as perl(?: itself)?"),
    Rule("unlicense", 7, "unlicense", "(?:the )?unlicense"),
    Rule("unlicense", 8, "unencumbered", "this is free and unencumbered software released into the public domain"),
    Rule("wtfpl", 7, "wtfpl", "wtfpl"),
    Rule("wtfpl", 7, "do", "do what the fuck you want to public license"),
    Rule("beerware", 7, "beer", rf"beer ?ware {LIC}"),
    Rule("beerware", 6, "beerware", rf"beerware(?: {LIC})?"),
    Rule("vim", 6, "vim", rf"vim {LIC}"),
    Rule("afl", 5, "academic", rf"academic free {LIC}"),
    Rule("ms-pl", 7, "microsoft", rf"microsoft public {LIC}"),
    Rule("ms-rl", 7, "microsoft", rf"microsoft reciprocal {LIC}"),
    Rule("upl-1.0", 7, "universal", rf"universal permissive {LIC}"),
    Rule("ofl-1.1", 7, "sil", rf"sil open font {LIC}(?: {VER}1 1)?"),
    Rule("ofl-1.1", 6, "ofl", rf"ofl(?: 1 1)?(?: {LIC})?"),
    Rule("public-domain", 5, "public", "(?:in|into|to) the public domain"),
    Rule("public-domain", 6, "dedicated", "dedicated to the public domain"),
    Rule("cc0-1.0", 7, "cc0", "cc0(?: 1 0)?(?: universal)?"),
    Rule("cc0-1.0", 7, "creative", rf"creative commons zero(?: {VER}1 0)?"),
    # copyleft and other families, each with its versions
    *_versioned("apache", "apache", rf"apache(?: software)? {LIC}", ("1.0", "1.1", "2.0")),
    Rule("apache-2", 6, "asl", "asl 2(?: 0)?"),
    Rule("apache-2", 6, "apache", r"apache 2(?: 0)?(?! \d)"),
    *_versioned("gpl", "gnu", rf"gnu general public {LIC}", ("1.0", "2.0", "3.0")),
    *_versioned("gpl", "gpl", "gpl", ("1.0", "2.0", "3.0")),
    *_versioned("gpl", "gplv", "gplv", ()),
    Rule("gpl-2", 7, "gplv2", r"gplv2"),
    Rule("gpl-3", 7, "gplv3", r"gplv3"),
    *_versioned("lgpl", "gnu", rf"gnu (?:lesser|library) general public {LIC}", ("2.0", "2.1", "3.0")),
    *_versioned("lgpl", "lgpl", "lgpl", ("2.0", "2.1", "3.0")),
    Rule("lgpl-2.1", 7, "lgplv2", "lgplv2(?: 1)?"),
    Rule("lgpl-3", 7, "lgplv3", "lgplv3"),
    *_versioned("agpl", "gnu", rf"gnu affero general public {LIC}", ("1.0", "3.0")),
    *_versioned("agpl", "agpl", "agpl", ("1.0", "3.0")),
    Rule("agpl-3", 7, "agplv3", "agplv3"),
    *_versioned("fdl", "gnu", rf"gnu free documentation {LIC}", ("1.1", "1.2", "1.3")),
    *_versioned("fdl", "gfdl", "gfdl", ("1.1", "1.2", "1.3")),
    *_versioned("mpl", "mozilla", rf"mozilla public {LIC}", ("1.0", "1.1", "2.0")),
    *_versioned("mpl", "mpl", "mpl", ("1.0", "1.1", "2.0")),
    *_versioned("epl", "eclipse", rf"eclipse public {LIC}", ("1.0", "2.0")),
    *_versioned("epl", "epl", "epl", ("1.0", "2.0")),
    *_versioned("cddl", "common", rf"common development and distribution {LIC}", ("1.0", "1.1")),
    *_versioned("cddl", "cddl", "cddl", ("1.0", "1.1")),
    *_versioned("cpl", "common", rf"common public {LIC}", ("1.0",)),
    *_versioned("eupl", "european", rf"european union public {LIC}", ("1.0", "1.1", "1.2")),
    *_versioned("eupl", "eupl", "eupl", ("1.0", "1.1", "1.2")),
    *_versioned("osl", "open", rf"open software {LIC}", ("1.0", "2.0", "2.1", "3.0")),
    *_versioned("artistic", "artistic", rf"artistic {LIC}", ("1.0", "2.0")),
    *_versioned("odbl", "open", rf"open database {LIC}", ("1.0",)),
    *_versioned("odc-by", "open", rf"open data commons attribution {LIC}", ("1.0",)),
    *_versioned("pddl", "open", rf"open data commons public domain dedication(?: and {LIC})?", ("1.0",)),
    *_versioned("sspl", "server", rf"server side public {LIC}", ("1.0",)),
    *_versioned("busl", "business", rf"business source {LIC}", ("1.0", "1.1")),
    *_versioned("cecill", "cecill", rf"cecill(?: {LIC})?", ("1.0", "2.0", "2.1")),
    *_versioned("ipl", "ibm", rf"ibm public {LIC}", ("1.0",)),
    *_versioned("lppl", "latex", rf"latex project public {LIC}", ("1.0", "1.1", "1.2", "1.3")),
    *_versioned("qpl", "q", rf"q public {LIC}", ("1.0",)),
    *_versioned("apsl", "apple", rf"apple public source {LIC}", ("1.0", "2.0")),
    *_versioned("zpl", "zope", rf"zope public {LIC}", ("2.0", "2.1")),
    *_creative_commons(),
    # restrictions
    Rule("proprietary", 3, "all", "all rights reserved"),
    Rule("proprietary", 5, "proprietary", "proprietary and confidential"),
    Rule("proprietary", 5, "proprietary", rf"proprietary {LIC}"),
    Rule("proprietary", 5, "unauthorized", "unauthorized (?:copying|reproduction|distribution)(?: of this (?:file|work|software))?"),
    Rule("proprietary", 5, "no", "no part of this (?:publication|work|document) may be reproduced"),
    Rule("non-commercial", 5, "for", "for non ?commercial (?:use|purposes) only"),
    Rule("research-only", 5, "for", "for (?:academic |scientific )?research (?:use|purposes) only"),
    Rule("no-training", 6, "may", "may not be used (?:to train|for training) (?:machine learning|ai|language) models"),
    Rule("copyright", 1, "copyright", r"copyright(?: c)?(?: \d{4})+"),
    Rule("copyright", 1, "c", r"c copyright(?: \d{4})+"),
)
