"""License scans with ordered signature rules, in DataFrame operations only.

A text is brought to words (A-Z in lower case; everything else ASCII that is no digit separates) with one space between.
Rules are regexes over that form: names and versioned families of licences in templates, alone (at a lower priority, and
only where the name cannot mean something else), and key sentences of the licences' own wording. A rule is tried only
where its keyword occurs; texts without any gate are not even brought to words. Detections are intervals of words. One is
suppressed where another of the same or a better priority, read before it in order of (start, longer first, priority),
contains it. Labels end in -or-later where the text says so; a family's label (gpl, mpl, bsd) means that no version is
given. A "+" after a version is no word and is not seen.

Base phrases are counted at every place and their labels stay, whatever is suppressed.

Running sums and maxima over the detections of a text go by blocks of about the root of their number, so that appending to
arrays costs little however long the text and however many its detections.

Defined results: null texts are empty: no words, no labels, score 0; repeated rows are scanned each for itself; null
ids stay null. Whole texts are read.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The words of a text before A-Z are in lower case.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases and their labels: fixed values.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label: names of the licence, as words.
NAMES = {
    "mit": ("mit", "expat"),
    "apache-2": ("apache 2 0", "apache license 2 0", "apache license version 2 0", "apache software license 2 0"),
    "apache-1.1": ("apache 1 1", "apache software license version 1 1"),
    "bsd-2": ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"),
    "bsd-3": ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"),
    "bsd-4": ("bsd 4 clause", "4 clause bsd", "original bsd"),
    "0bsd": ("0bsd", "zero clause bsd"),
    "isc": ("isc", "internet systems consortium"),
    "gpl-2": ("gpl 2 0", "gpl v2", "gplv2", "gnu general public license version 2", "gnu gpl version 2"),
    "gpl-3": ("gpl 3 0", "gpl v3", "gplv3", "gnu general public license version 3", "gnu gpl version 3"),
    "lgpl-2.1": ("lgpl 2 1", "lgplv2 1", "gnu lesser general public license version 2 1"),
    "lgpl-3": ("lgpl 3 0", "lgplv3", "gnu lesser general public license version 3"),
    "agpl-3": ("agpl 3 0", "agplv3", "gnu affero general public license version 3"),
    "gfdl": ("gfdl", "gnu free documentation license"),
    "mpl-1.1": ("mpl 1 1", "mozilla public license version 1 1"),
    "mpl-2": ("mpl 2 0", "mozilla public license 2 0", "mozilla public license version 2 0"),
    "epl-1": ("epl 1 0", "eclipse public license 1 0"),
    "epl-2": ("epl 2 0", "eclipse public license 2 0"),
    "cddl-1": ("cddl 1 0", "common development and distribution license"),
    "eupl": ("eupl 1 2", "european union public licence"),
    "unlicense": ("unlicense", "public domain unlicense"),
    "wtfpl": ("wtfpl", "do what the fuck you want to public license"),
    "zlib": ("zlib", "zlib libpng"),
    "boost": ("bsl 1 0", "boost software license 1 0", "boost software license version 1 0"),
    "artistic-1": ("artistic 1 0", "artistic license 1 0"),
    "artistic-2": ("artistic 2 0", "artistic license 2 0"),
    "python": ("python 2 0", "psf 2 0", "python software foundation license"),
    "postgresql": ("postgresql",),
    "ncsa": ("ncsa", "university of illinois ncsa open source license"),
    "openssl": ("openssl",),
    "ms-pl": ("ms pl", "microsoft public license"),
    "ms-rl": ("ms rl", "microsoft reciprocal license"),
    "busl": ("busl 1 1", "business source license 1 1"),
    "sspl": ("sspl 1 0", "server side public license"),
    "elastic-2": ("elastic 2 0", "elastic license 2 0"),
    "ofl": ("ofl 1 1", "sil open font license"),
    "odbl": ("odbl 1 0", "open database license"),
    "cc0": ("cc0 1 0", "cc0", "creative commons zero"),
    "cc-by": ("cc by 4 0", "cc by 3 0", "creative commons attribution 4 0", "creative commons attribution 3 0"),
    "cc-by-sa": ("cc by sa 4 0", "cc by sa 3 0", "creative commons attribution sharealike 4 0"),
    "cc-by-nd": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0"),
    "cc-by-nc": ("cc by nc 4 0", "cc by nc 3 0", "creative commons attribution noncommercial 4 0"),
    "cc-by-nc-sa": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0"),
    "cc-by-nc-nd": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0"),
}
#: Names that mean a licence only beside a word that says so ("mit" is German for "with").
AMBIGUOUS = frozenset((
    "mit", "expat", "apache 2 0", "apache 1 1", "freebsd", "simplified bsd", "new bsd", "modified bsd", "revised bsd", "original bsd", "isc", "internet systems consortium",
    "zlib", "zlib libpng", "python 2 0", "psf 2 0", "postgresql", "ncsa", "openssl", "ms pl", "ms rl", "elastic 2 0", "artistic 1 0", "artistic 2 0", "bsl 1 0",
))

#: family: names in full, short names, versions and their labels, whether "or later" is told apart.
FAMILIES = {
    "gpl": (("gnu general public license", "gnu gpl"), ("gpl",), {"1": "gpl-1", "2": "gpl-2", "3": "gpl-3"}, True),
    "lgpl": (("gnu lesser general public license", "gnu library general public license", "gnu lgpl"), ("lgpl",), {"2": "lgpl-2", "2 1": "lgpl-2.1", "3": "lgpl-3"}, True),
    "agpl": (("gnu affero general public license", "affero general public license", "gnu agpl"), ("agpl",), {"1": "agpl-1", "3": "agpl-3"}, True),
    "gfdl": (("gnu free documentation license", "gnu fdl"), ("gfdl",), {"1 1": "gfdl-1.1", "1 2": "gfdl-1.2", "1 3": "gfdl-1.3"}, True),
    "mpl": (("mozilla public license",), ("mpl",), {"1": "mpl-1", "1 1": "mpl-1.1", "2": "mpl-2"}, False),
    "apache": (("apache license", "apache software license"), (), {"1": "apache-1", "1 1": "apache-1.1", "2": "apache-2"}, False),
    "epl": (("eclipse public license",), ("epl",), {"1": "epl-1", "2": "epl-2"}, False),
    "cpl": (("common public license",), (), {"1": "cpl-1"}, False),
    "cddl": (("common development and distribution license",), ("cddl",), {"1": "cddl-1", "1 1": "cddl-1.1"}, False),
    "eupl": (("european union public licence", "european union public license"), ("eupl",), {"1 1": "eupl-1.1", "1 2": "eupl"}, False),
    "artistic": (("artistic license",), (), {"1": "artistic-1", "2": "artistic-2"}, False),
    "osl": (("open software license",), (), {"3": "osl-3"}, False),
    "afl": (("academic free license",), (), {"3": "afl-3"}, False),
    "boost": (("boost software license",), (), {"1": "boost"}, False),
    "busl": (("business source license",), ("busl",), {"1 1": "busl"}, False),
    "sspl": (("server side public license",), ("sspl",), {"1": "sspl"}, False),
    "elastic": (("elastic license",), (), {"2": "elastic-2"}, False),
    "odbl": (("open database license", "open data commons open database license"), ("odbl",), {"1": "odbl"}, False),
    "ofl": (("sil open font license", "open font license"), ("ofl",), {"1": "ofl", "1 1": "ofl"}, False),
}
#: Creative Commons: label, and its parts after "cc" and after "creative commons".
CREATIVE = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
)
LATER = "(?: or)?(?: at your option)?(?: any)? later(?: versions?)?"
#: Priority (0 is best), weight, template around a name.
UNDER = (
    "(?:(?:(?:re)?licensed|released|(?:re)?distributed|available|published|provided|covered|offered|issued|shared|dedicated) (?:under|by) (?:the )?(?:terms(?: and conditions)? of )?"
    "|under (?:the )?(?:terms(?: and conditions)?|conditions|provisions) of |(?:subject to|governed by) (?:the )?(?:(?:terms(?: and conditions)?|conditions|provisions) of )?)(?:the |an? )?"
)
TEMPLATES = (
    (0, 1.0, "spdx license identifier {0}"),
    (1, 0.95, UNDER + "{0}(?: licen[sc]e)?"),
    (2, 0.7, "(?:the )?{0} licen[sc]ed?"),
    (2, 0.7, "licen[sc]es?(?: is| type| name)? (?:the )?{0}"),
)
#: Priority, weight of a name alone.
ALONE = (3, 0.6)
#: After "license", the German word: "unter der General Public License mit Ausnahme".
GERMAN = "mit(?! (?:de[mnr]|die|das|eine[mnr]?|ein|alle[nrm]?|diese[nrm]?|folgende[nrm]?|ausnahmen?|zusatz|zusätzlich[a-z]*|und|oder|ohne|sich|[a-z]+klauseln?) )"
PERMITS = "redistribution and use in source and binary forms with or without modification are permitted"
#: Key sentences of licences: label, regex, keyword that must occur.
BODIES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this (?:software|font software)(?: and associated documentation files)?(?: the software)?(?! the font)", "permission is hereby granted free of charge"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "permission is hereby granted free of charge"),
    ("ofl", "permission is hereby granted free of charge to any person obtaining a copy of the font software", "permission is hereby granted free of charge"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided", "permission to use copy modify"),
    ("0bsd", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)", "permission to use copy modify"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "permission to use copy modify"),
    ("hpnd", "permission to use copy modify and(?: or)? distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", "permission to use copy modify"),
    ("bsd", PERMITS, "redistribution and use in source and binary forms"),
    ("bsd-2", PERMITS + "(?: (?!advertising |acknowledge?ment |endorse )[^ ]+){0,120}? provided with the distribution(?: [^ ]+){0,3}? this software is provided", "redistribution and use in source and binary forms"),
    ("bsd-3", PERMITS + "(?: (?!advertising |acknowledge?ment )[^ ]+){0,200}? used to endorse or promote products", "redistribution and use in source and binary forms"),
    ("bsd-4", PERMITS + "(?: [^ ]+){0,160}? all advertising materials mentioning(?:(?: [^ ]+){0,80}? used to endorse or promote products)?", "redistribution and use in source and binary forms"),
    ("apache-1.1", PERMITS + "(?: [^ ]+){0,160}? this product includes software developed by the apache (?:software foundation|group)(?:(?: [^ ]+){0,80}? used to endorse or promote products)?", "redistribution and use in source and binary forms"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "permission is granted to anyone to use this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("wtfpl", "you just do what the fuck you want to", "do what the fuck you want to"),
    ("apache-2", "(?:https? )?(?:www )?apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("mit", "opensource org licen[cs]es?(?: licen[cs]es?)? mit", "opensource org"),
    ("cc0", "creativecommons org publicdomain zero 1 0", "creativecommons org publicdomain zero"),
    ("cc0", "waived? all copyright and related or neighboring rights", "copyright and related or neighboring rights"),
    *((label, f"creativecommons org licenses {short}(?: [1-4] [05])?", "creativecommons org licenses") for label, short, _ in CREATIVE),
    ("gpl-3", "gnu general public license is a free copyleft license for software", "gnu general public license is a free copyleft license"),
    ("gpl-2", "gnu general public license is intended to guarantee your freedom to share and change free software", "gnu general public license is intended to guarantee"),
    ("agpl-3", "gnu affero general public license is a free copyleft license", "gnu affero general public license is a free copyleft license"),
    ("mpl-2", "each individual or legal entity that creates contributes to the creation of or owns covered software", "owns covered software"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license", "accompanying program is provided under the terms"),
    ("artistic-1", "the intent of this document is to state the conditions under which a package may be copied", "state the conditions under which a package may be copied"),
    ("ofl", "the goals of the open font license ofl are to stimulate worldwide development", "goals of the open font license"),
)
#: Rules that name no licence of the list.
GENERAL = (
    (4, 0.4, "all-rights-reserved", "all rights reserved", "rights reserved"),
    (4, 0.3, "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", "copyright"),
    (4, 0.3, "gpl", "gnu general public license", "gnu general"),
    (4, 0.3, "gpl", "gpl", "gpl"),
    (4, 0.3, "public-domain", "(?:in|into|to) the public domain", "public domain"),
)


def _versions(name: str, version: str, gnu: bool) -> str:
    """The name with a version after it, before it, or in the notice of the Free Software Foundation."""
    number = version if " " in version else f"{version}(?: 0)?(?! [0-9] )"
    after = f"{name}(?:(?: version| ver| v)? v?|v){number}"
    before = f"(?:version|v) ?{number} of (?:the )?{name}"
    notice = f"|{name} as published by (?:the )?free software foundation (?:either )?(?:version|v) ?{number}(?: of the licen[sc]e)?" if gnu else ""
    return f"(?:{after}|{before}{notice})(?: only)?"


def _names() -> list[tuple[str, str, str, bool]]:
    """Label, regex, keyword, and whether it stands alone."""
    made = [(label, name, f" {name} ", name not in AMBIGUOUS) for label, names in NAMES.items() for name in names]
    for family, (full, short, versions, later) in FAMILIES.items():
        for name in full + short:
            made.append((family, name, f" {name} ", name in full))
            for version, label in versions.items():
                core = _versions(name, version, later)
                made.append((label, core, f" {name}", True))
                if later:
                    made.append((f"{label}-or-later", core + LATER, f" {name}", True))
    for label, short, full in CREATIVE:
        version = "(?: (?:version |v ?)?[1-4] [05])"
        region = "(?: (?:international|unported|generic))?"
        made.append((label, f"cc {short}{version}{'' if short == 'by' else '?'}{region}", f" cc {short} ", True))
        made.append((label, f"cc {short}", f" cc {short} ", False))
        made.append((label, f"creative commons {full}{version}?{region}", " creative commons attribution ", True))
    return made


def rules() -> list[dict]:
    """All rules, in order: priority, weight, label, regex over " word word ", keyword that must occur."""
    made = []
    for label, name, keyword, alone in _names():
        for p, w, t in TEMPLATES:
            made.append((p, w, label, t.format(GERMAN if name == "mit" and t.endswith("{0}") and p == 2 else name), keyword))
        if alone:
            made.append((*ALONE, label, name, keyword))
    made += [(1, 0.9, label, phrase, f" {phrase} ") for phrase, label in BASE]
    made += [(1, 0.9, label, regex, f" {keyword} ") for label, regex, keyword in BODIES]
    made += [(p, w, label, r, f" {k} ") for p, w, label, r, k in GENERAL]
    return [{"priority": p, "weight": w, "label": label, "regex": f" {r}(?= )", "keyword": k} for p, w, label, r, k in sorted(set(made), key=lambda x: (x[0], x[2], x[3], x[4]))]


def by_keyword() -> list[dict]:
    """The rules of each keyword, so that it is looked for once."""
    found: dict[str, list[dict]] = {}
    for r in rules():
        found.setdefault(r["keyword"], []).append({k: v for k, v in r.items() if k != "keyword"})
    return [{"keyword": k, "rules": v} for k, v in found.items()]


#: One of these occurs in the lower-cased text wherever a rule or a base phrase matches.
GATES = (
    "licen", "copyright", "rights", "public", "spdx", "released", "distributed", "available", "published", "permission", "redistribution", "provided", "covered", "governed",
    "subject", "offered", "issued", "shared", "dedicated", "terms", "conditions", "provisions", "gpl", "bsd", "fdl", "clause", "commons", "wtfpl", "fuck", "cddl", "eupl", "sspl", "odbl", "neighboring", "apache",
)
#: Short names that other words contain: at the start of a word only, and "cc" only with what makes it a licence.
SHORT_GATES = r"(?<![0-9a-z])(?:(?:mpl|epl|ofl|busl)(?=v?[0-9]|[^0-9a-z])|cc(?:0(?![0-9a-z])|[\x00-\x2F\x3A-\x60\x7B-\x7F]+by))"


def _n_words(piece: Column) -> Column:
    return F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))


#: What a detection is; neg is its end, negated, so that of equal starts the longer one sorts first.
DETECTION = "struct<start:int,neg:int,priority:int,label:string,weight:double>"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _blocked(items: str) -> str:
    """SQL for an array cut into blocks of about the root of its length."""
    return f"transform(sequence(0, greatest(size({items}) - 1, 0), greatest(1, cast(ceil(sqrt(size({items}))) as int))), b -> slice({items}, b + 1, greatest(1, cast(ceil(sqrt(size({items}))) as int))))"


def _before(numbers: str) -> str:
    """SQL for the sums of the numbers before each one of an array that is not empty."""
    sums = "aggregate({}, named_struct('at', 0, 'd', cast(array() as array<int>)), (acc, x) -> named_struct('at', acc.at + {}, 'd', concat(acc.d, array(acc.at))))"
    inner = f"transform({_blocked('ns')}, block -> {sums.format('block', 'x')})"
    return _let("ns", numbers, _let("inner", inner, f"flatten(zip_with(inner, {sums.format('inner', 'x.at')}.d, (i, base) -> transform(i.d, y -> y + base)))"))


#: Detections of all rules that are tried: each match, with the words before it and its own.
ALL = f"""
flatten(transform(filter(transform(rules, r -> named_struct('r', r, 'm', regexp_extract_all(norm, r.regex, 0), 'p', split(norm, r.regex))), y -> size(y.m) > 0), y ->
 {_let("w", "zip_with(y.m, slice(y.p, 1, size(y.m)), (m, p) -> named_struct('n', length(m) - length(replace(m, ' ', '')), 'p', length(p) - length(replace(p, ' ', ''))))",
  f"zip_with(w, {_before('transform(w, v -> v.n + v.p)')}, (v, at) -> named_struct('start', at + v.p, 'neg', -(at + v.p + v.n), 'priority', y.r.priority, 'label', y.r.label, 'weight', cast(y.r.weight as double)))")}))"""
#: The furthest end by priority (of that and better ones) after a detection.
FURTHER = "transform({}, (e, i) -> IF(i >= x.priority, greatest(e, -x.neg), e))"
#: Of the sorted detections those that no earlier one of the same or a better priority contains. (One that is contained
#: itself may count: what contains it ends no earlier.)
KEPT = _let("blocks", _blocked("`all`"), _let(
    "bases",
    f"aggregate(blocks, named_struct('e', array(0, 0, 0, 0, 0), 'd', cast(array() as array<array<int>>)), (acc, block) -> named_struct('e', aggregate(block, acc.e, (far, x) -> {FURTHER.format('far')}), 'd', concat(acc.d, array(acc.e)))).d",
    f"""flatten(zip_with(blocks, bases, (block, base) -> aggregate(block, named_struct('e', base, 'd', cast(array() as array<{DETECTION}>)), (acc, x) ->
     named_struct('e', {FURTHER.format('acc.e')}, 'd', IF(element_at(acc.e, x.priority + 1) >= -x.neg, acc.d, concat(acc.d, array(x)))), acc -> acc.d)))"""))  # fmt: skip


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections are those that are not suppressed, in order: start and stop (words from 0), priority, label, weight.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("low", F.lower("text"))
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains("low", F.lit(g))
    gate = gate | F.col("low").rlike(SHORT_GATES)
    trimmed = F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), BREAKS, " "))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("n_words"), F.when(gate, F.concat(F.lit(" "), trimmed, F.lit(" "))).alias("norm"))
    # base places: pieces between the phrases give the word at which each place starts
    for k, (phrase, _) in enumerate(BASE):
        rows = rows.withColumn(f"pieces{k}", F.when(F.contains("norm", F.lit(f" {phrase} ")), F.split("norm", f" {phrase}(?= )")))
    places, firsts, lasts, base = F.lit(0).cast("long"), [], [], []
    for k, (phrase, label) in enumerate(BASE):
        pieces, there = F.col(f"pieces{k}"), F.col(f"pieces{k}").isNotNull()
        places = places + F.when(there, F.size(pieces) - 1).otherwise(0)
        firsts.append(F.when(there, _n_words(F.element_at(pieces, 1))))
        # a piece after a place starts with a space and the last one ends with one more than it has words
        lasts.append(F.when(there, F.col("n_words") - (_n_words(F.element_at(pieces, -1)) - 1) - len(phrase.split())))
        base.append(F.when(there, F.lit(label)))
    found = F.filter(F.array(*base), lambda x: x.isNotNull())
    # one literal: the optimizer reads it once
    ordered = F.from_json(F.lit(json.dumps(by_keyword())), "array<struct<keyword:string,rules:array<struct<priority:int,weight:double,label:string,regex:string>>>>")
    tried = F.when(F.col("norm").isNotNull(), F.flatten(F.transform(F.filter(ordered, lambda g: F.contains(F.col("norm"), g["keyword"])), lambda g: g["rules"])))
    rows = rows.withColumn("rules", tried).withColumn("base", found)
    rows = rows.withColumn("n_base", places.cast("long")).withColumn("first_word", F.least(*firsts).cast("long")).withColumn("last_word", F.greatest(*lasts).cast("long"))
    rows = rows.withColumn("all", F.when(F.size("rules") > 0, F.array_sort(F.expr(ALL))))
    rows = rows.withColumn("kept", F.when(F.size("all") > 0, F.expr(KEPT)).otherwise(F.expr(f"cast(array() as array<{DETECTION}>)")))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("kept", lambda x: x["label"]))))
    score = F.greatest(F.coalesce(F.array_max(F.transform("kept", lambda x: x["weight"])), F.lit(0.0)), F.when(F.col("n_base") > 0, 0.9).otherwise(0.0))
    detections = F.transform("kept", lambda x: F.struct(x["start"].alias("start"), (-x["neg"]).alias("stop"), x["priority"].alias("priority"), x["label"].alias("label"), x["weight"].alias("weight")))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), detections.alias("detections"))
