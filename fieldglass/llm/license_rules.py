"""The license scanner's rules: fixed values, and the table built from them.

A pattern is a row of word patterns. ``word!`` is the keyword that the rule is found by, ``word~`` may be missing,
``a|b`` are alternatives and ``{v}`` stands for a version. Words are lower case, without punctuation: ``GPL-3.0`` is
``gpl 3 0``.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rule: str
    keyword: str
    before: str  # regular expressions over words written " w ", up to and after the keyword
    after: str
    label: str
    base: bool
    priority: int
    weight: float


# Phrases and labels that always count.
BASE = (
    ("gnu general public license!", "gpl"),
    ("apache! license", "apache"),
    ("cc! by", "cc-by"),
    ("mit license!", "mit"),
)

# Licenses with versions (names, label, versions).
VERSIONED = (
    (("gnu~ general public! license|licence", "gnu! gpl", "gpl!"), "gpl", ("1", "2", "3")),
    (("gnu~ lesser|library general public! license|licence", "gnu! lgpl", "lgpl!"), "lgpl", ("2", "2 1", "3")),
    (("gnu~ affero general public! license|licence", "gnu! agpl", "agpl!"), "agpl", ("1", "3")),
    (("gnu~ free documentation! license|licence", "gnu! fdl", "gfdl!"), "gfdl", ("1 1", "1 2", "1 3")),
    (("apache! software~ license|licence", "asl!"), "apache", ("1 0", "1 1", "2 0", "2")),
    (("mozilla! public license|licence", "mpl!"), "mpl", ("1 0", "1 1", "2 0")),
    (("eclipse! public license|licence", "epl!"), "epl", ("1 0", "2 0")),
    (("european union public! license|licence", "eupl!"), "eupl", ("1 0", "1 1", "1 2")),
    (("common development and distribution! license|licence", "cddl!"), "cddl", ("1 0", "1 1")),
    (("academic! free license|licence", "afl!"), "afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    (("open software! license|licence", "osl!"), "osl", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    (("artistic! license|licence",), "artistic", ("1 0", "2 0")),
    (("boost! software license|licence", "bsl!"), "bsl", ("1 0",)),
    (("lucent public! license|licence",), "lpl", ("1 0", "1 02")),
    (("python! software foundation~ license|licence",), "psf", ("2", "2 0")),
    (("zope! public license|licence", "zpl!"), "zpl", ("1 1", "2 0", "2 1")),
    (("latex project public! license|licence", "lppl!"), "lppl", ("1 0", "1 1", "1 2", "1 3")),
    (("sil open font! license|licence", "ofl!"), "ofl", ("1 0", "1 1")),
    (("microsoft public! license|licence",), "ms-pl", ("1 0",)),
    (("server side public! license|licence", "sspl!"), "sspl", ("1",)),
    (("business source! license|licence", "busl!"), "busl", ("1 1",)),
    (("cecill! license~ licence~",), "cecill", ("1 0", "1 1", "2 0", "2 1")),
    (("php! license|licence",), "php", ("3 0", "3 01")),
    (("common public! license|licence",), "cpl", ("1 0",)),
    (("ibm public! license|licence",), "ipl", ("1 0",)),
    (("apple public source! license|licence", "apsl!"), "apsl", ("1 0", "1 1", "1 2", "2 0")),
    (("creative commons! attribution", "cc! by"), "cc-by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    (("creative commons! attribution sharealike", "creative commons! attribution share alike", "cc! by sa"), "cc-by-sa",
     ("1 0", "2 0", "2 5", "3 0", "4 0")),
    (("creative commons! attribution noncommercial", "creative commons! attribution non commercial", "cc! by nc"), "cc-by-nc",
     ("1 0", "2 0", "2 5", "3 0", "4 0")),
    (("creative commons! attribution noderivs|noderivatives", "cc! by nd"), "cc-by-nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    (("creative commons! attribution noncommercial sharealike", "cc! by nc sa"), "cc-by-nc-sa",
     ("1 0", "2 0", "2 5", "3 0", "4 0")),
    (("creative commons! attribution noncommercial noderivs|noderivatives", "cc! by nc nd"), "cc-by-nc-nd",
     ("1 0", "2 0", "2 5", "3 0", "4 0")),
)

# Wordings without a version (pattern, label, weight).
WORDINGS = (
    ("mit license!", "mit", 0.8),
    ("mit licence!", "mit", 0.8),
    ("licensed under! the mit", "mit", 0.9),
    ("spdx license identifier! mit", "mit", 1.0),
    ("spdx license identifier! isc", "isc", 1.0),
    ("spdx license identifier! unlicense", "unlicense", 1.0),
    ("permission is hereby! granted free of charge to any person obtaining a copy", "mit", 0.95),
    ("bsd! licen[sc]e", "bsd", 0.8),
    ("bsd! (2|two) clause", "bsd-2-clause", 0.9),
    ("(2|two) clause bsd!", "bsd-2-clause", 0.9),
    ("bsd! (3|three) clause", "bsd-3-clause", 0.9),
    ("(3|three) clause bsd!", "bsd-3-clause", 0.9),
    ("bsd! (4|four) clause", "bsd-4-clause", 0.9),
    ("(new|modified|revised) bsd! licen[sc]e", "bsd-3-clause", 0.9),
    ("simplified bsd! licen[sc]e", "bsd-2-clause", 0.9),
    ("redistribution! and use in source and binary forms with or without modification are permitted", "bsd", 0.95),
    ("isc! licen[sc]e", "isc", 0.8),
    ("permission to use copy modify and (or~) distribute! this software", "isc", 0.9),
    ("zlib! licen[sc]e", "zlib", 0.8),
    ("wtfpl!", "wtfpl", 0.9),
    ("unlicense!", "unlicense", 0.8),
    ("released into the public! domain", "public-domain", 0.9),
    ("dedicated to the public! domain", "public-domain", 0.9),
    ("in the public! domain", "public-domain", 0.6),
    ("cc0!", "cc0", 0.9),
    ("creative commons! zero", "cc0", 0.9),
    ("all rights! reserved", "proprietary", 0.6),
    ("unauthorized copying! of this", "proprietary", 0.9),
    ("proprietary! and confidential", "proprietary", 0.9),
    ("commercial! licen[sc]e", "commercial", 0.6),
    ("licensed under! the apache", "apache", 0.9),
    ("licensed under! the gnu", "gnu", 0.7),
    ("licensed under! the gpl", "gpl", 0.8),
    ("licensed under! the bsd", "bsd", 0.8),
    ("licensed under! (a~) creative commons", "creative-commons", 0.8),
    ("licensed under! cc", "creative-commons", 0.7),
    ("gnu general public! licen[sc]e", "gpl", 0.8),
    ("gnu lesser general public! licen[sc]e", "lgpl", 0.85),
    ("gnu affero general public! licen[sc]e", "agpl", 0.85),
    ("apache! (software~) licen[sc]e", "apache", 0.8),
    ("mozilla! public licen[sc]e", "mpl", 0.8),
    ("eclipse! public licen[sc]e", "epl", 0.8),
    ("artistic! licen[sc]e", "artistic", 0.8),
    ("creative commons! licen[sc]e", "creative-commons", 0.7),
    ("creative commons! attribution", "cc-by", 0.8),
    ("cc! by", "cc-by", 0.8),
    ("cc! by sa", "cc-by-sa", 0.85),
    ("cc! by nc", "cc-by-nc", 0.85),
    ("cc! by nd", "cc-by-nd", 0.85),
    ("cc! by nc sa", "cc-by-nc-sa", 0.85),
    ("cc! by nc nd", "cc-by-nc-nd", 0.85),
)

# How a name and a version are written together, and what may follow.
FORMS = (("{name} {v}", ""), ("{name} version|v|ver {v}", ""), ("{name} v{v}", ""), ("{name} version~ {v} or later", "-or-later"),
         ("{name} version~ {v} only", "-only"))


def _word(token: str) -> str:
    optional = token.endswith("~")
    inner = token.rstrip("~!")
    if inner.startswith("(") and inner.endswith(")"):
        inner = inner[1:-1]
        if inner.endswith("~"):
            inner, optional = inner[:-1], True
    return f"(?: (?:{inner}) )" + ("?" if optional else "")


def compile_rule(name: str, pattern: str, label: str, base: bool, priority: int, weight: float) -> Rule:
    tokens = pattern.split()
    at = next(i for i, t in enumerate(tokens) if t.endswith("!"))
    before, after = "".join(map(_word, tokens[:at])), "".join(map(_word, tokens[at + 1:]))
    return Rule(name, tokens[at].rstrip("!"), f"({before})$", f"^({after})", label, base, priority, weight)


def rules() -> list[Rule]:
    """All rules, most specific first; a rule's place is its priority."""
    found: list[tuple[str, str, float]] = []
    for names, label, versions in VERSIONED:
        for name in names:
            for v in versions:
                for form, more in FORMS:
                    found.append((form.format(name=name, v=v), f"{label}-{v.replace(' ', '.')}{more}", 0.95 if more else 0.9))
    found += list(WORDINGS)
    found.sort(key=lambda r: (-len(r[0].split()), r[0]))
    out = [compile_rule(f"base-{k}", p, label, True, k, 0.7) for k, (p, label) in enumerate(BASE)]
    return out + [compile_rule(f"rule-{k}", p, label, False, len(out) + k, w) for k, (p, label, w) in enumerate(found)]
