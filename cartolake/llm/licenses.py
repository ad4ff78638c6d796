"""License scans: ordered signature rules, all in DataFrame functions.

A-Z are lower-cased and every run of ASCII non-alphanumerics becomes one space, so a signature is a pattern over words. A rule is
looked for only in texts that hold one of its keywords as a word; every text that its pattern matches has one. Each rule has a
priority, its place in the list. Of overlapping detections, one whose interval lies within another's is suppressed; of equal
intervals the first rule's stays.

A null text is empty: no words, no labels, score 0. Ties of interval are broken by priority; repeated rows are scanned alone.
Texts of any length are scanned whole. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from string import ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_V = r"(?: v| version| ver| v\.)?"
_OR_LATER = r"(?: or(?: \(?at your option\)?)?(?: any)? later(?: version)?| plus)"
_GNU = (("gpl", "general public license", "gpl", ("1", "2", "3")), ("lgpl", "(?:lesser|library) general public license", "lgpl", ("2", "2 1", "3")), ("agpl", "affero general public license", "agpl", ("1", "3")), ("fdl", "free documentation license", "gfdl", ("1 1", "1 2", "1 3")))
_VERSIONED = (
    ("apache", "apache", r"apache(?: software)? license", ("1 0", "1 1", "2 0")), ("mpl", "mozilla", r"mozilla public license", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"eclipse public license", ("1 0", "2 0")), ("cddl", "distribution", r"common development and distribution license", ("1 0", "1 1")),
    ("cpl", "common", r"common public license", ("1 0",)), ("afl", "academic", r"academic free license", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", "open", r"open software license", ("1 0", "1 1", "2 0", "2 1", "3 0")), ("artistic", "artistic", r"artistic license", ("1 0", "2 0")),
    ("bsl", "boost", r"boost software license", ("1 0",)), ("eupl", "european", r"european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("ofl", "sil", r"sil open font license", ("1 0", "1 1")), ("cecill", "cecill cecill1 cecill2", r"cecill(?: free software)?(?: license| licence)?", ("1 0", "1 1", "2 0", "2 1")),
    ("lppl", "latex", r"latex project public license", ("1 0", "1 1", "1 2", "1 3a", "1 3c")), ("ms-pl", "microsoft", r"microsoft public license", ("1 0",)),
    ("qpl", "q", r"q public license", ("1 0",)), ("zpl", "zope", r"zope public license", ("1 1", "2 0", "2 1")), ("psf", "python", r"python software foundation license", ("2",)),
    ("php", "php", r"php license", ("3 0", "3 01")), ("openldap", "openldap", r"openldap public license", ("2 0", "2 7", "2 8")), ("ecl", "educational", r"educational community license", ("1 0", "2 0")),
    ("rpl", "reciprocal", r"reciprocal public license", ("1 1", "1 5")), ("apsl", "apple", r"apple public source license", ("1 0", "1 1", "1 2", "2 0")),
    ("odbl", "database", r"open database license", ("1 0",)), ("ogl", "government", r"open government licen[cs]e", ("1 0", "2 0", "3 0")), ("ssl", "server", r"server side public license", ("1",)),
    ("bsl-business", "business", r"business source license", ("1 0", "1 1")), ("elastic", "elastic", r"elastic license", ("1 0", "2 0")), ("cc-pddl", "dedication", r"public domain dedication and license", ("1 0",)),
)
_CC_PARTS = (("cc-by", r"attribution", "by"), ("cc-by-sa", r"attribution share ?alike", "by sa"), ("cc-by-nd", r"attribution no ?deriv(?:ative)?s?(?: works)?", "by nd"), ("cc-by-nc", r"attribution non ?commercial", "by nc"), ("cc-by-nc-sa", r"attribution non ?commercial share ?alike", "by nc sa"), ("cc-by-nc-nd", r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", "by nc nd"))
_SPDX = (
    "0bsd", "aal", "afl 3 0", "agpl 3 0", "apache 1 1", "apache 2 0", "apsl 2 0", "artistic 1 0", "artistic 2 0", "blueoak 1 0 0", "bsd 1 clause", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause",
    "bsl 1 0", "cc0 1 0", "cc by 3 0", "cc by 4 0", "cc by sa 3 0", "cc by sa 4 0", "cc by nc 4 0", "cc by nd 4 0", "cddl 1 0", "cecill 2 1", "cpl 1 0", "ecl 2 0", "epl 1 0", "epl 2 0", "eupl 1 2",
    "gpl 2 0", "gpl 3 0", "hpnd", "isc", "lgpl 2 0", "lgpl 2 1", "lgpl 3 0", "lppl 1 3c", "mit", "mit 0", "mpl 1 1", "mpl 2 0", "ms pl", "ms rl", "ncsa", "ofl 1 1", "osl 3 0", "php 3 01", "postgresql",
    "psf 2 0", "python 2 0", "qpl 1 0", "unlicense", "upl 1 0", "vim", "w3c", "wtfpl", "x11", "zlib", "zpl 2 1",
)
#: Names and stock sentences: label, keywords, pattern over words, confidence.
_NAMED = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0), ("mit", "mit", r"(?:the )?mit licen[cs]e", 0.9), ("mit", "mit", r"licensed under (?:the )?(?:terms of )?(?:the )?mit", 0.95), ("mit", "mit", r"mit licensed", 0.9),
    ("mit", "expat", r"expat licen[cs]e", 0.9), ("x11", "x11", r"x11 licen[cs]e", 0.9), ("isc", "isc", r"isc licen[cs]e", 0.9), ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", 0.8), ("bsd-2-clause", "bsd freebsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", 0.95), ("bsd-3-clause", "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: licen[cs]e)?", 0.95), ("bsd-4-clause", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e)?", 0.95), ("0bsd", "bsd 0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)", 0.95),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 1.0), ("bsd-3-clause", "endorse", r"neither the name of .{1,80}? may be used to endorse or promote products", 1.0), ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display", 1.0),
    ("unlicense", "unlicense", r"(?:the )?unlicense", 0.9), ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 1.0), ("public-domain", "domain", r"(?:in|into|to) the public domain", 0.7), ("public-domain", "domain", r"public domain dedication", 0.8), ("public-domain", "domain", r"no copyright .{0,40}?public domain", 0.8), ("public-domain", "dedicated", r"dedicated to the public domain", 0.9),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.95), ("cc0-1.0", "waive", r"waive all copyright and related or neighboring rights", 1.0), ("wtfpl", "wtfpl", r"wtfpl", 0.9), ("wtfpl", "fuck", r"do what the fuck you want to public licen[cs]e", 1.0), ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", 0.9), ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 1.0),
    ("libpng", "libpng", r"libpng licen[cs]e", 0.9), ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", 0.9), ("postgresql", "postgresql", r"postgresql licen[cs]e", 0.9), ("openssl", "openssl", r"openssl licen[cs]e", 0.9), ("json", "evil", r"the software shall be used for good not evil", 1.0), ("beerware", "beer", r"(?:the )?beer ware licen[cs]e", 0.9), ("beerware", "beer", r"you can buy me a beer in return", 1.0),
    ("ruby", "ruby", r"ruby licen[cs]e", 0.8), ("perl", "perl", r"same terms as perl(?: itself)?", 0.9), ("vim", "vim", r"vim licen[cs]e", 0.8), ("ijg", "jpeg", r"independent jpeg group licen[cs]e", 0.9), ("curl", "curl", r"curl licen[cs]e", 0.8), ("w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[cs]e", 0.9), ("unicode", "unicode", r"unicode(?: inc)? licen[cs]e(?: agreement)?", 0.8), ("icu", "icu", r"icu licen[cs]e", 0.8),
    ("apache-2.0", "apache", r"licensed under the apache licen[cs]e version 2 0", 1.0), ("apache-2.0", "apache", r"http www apache org licenses license 2 0", 1.0), ("apache", "apache", r"licensed under (?:the )?apache", 0.85), ("gpl", "gnu", r"under the terms of the gnu general public licen[cs]e", 0.95), ("gpl", "gpl", r"(?:gnu )?gpl", 0.6), ("lgpl", "lgpl", r"(?:gnu )?lgpl", 0.6), ("agpl", "agpl", r"(?:gnu )?agpl", 0.6), ("gfdl", "gfdl", r"(?:gnu )?gfdl", 0.6), ("gpl", "copyleft", r"copyleft licen[cs]e", 0.5),
    ("gpl", "gnu", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e", 1.0), ("lgpl", "lesser", r"see the gnu lesser general public licen[cs]e", 1.0), ("agpl", "affero", r"see the gnu affero general public licen[cs]e", 1.0), ("gpl-classpath", "exception", r"gpl .{0,60}?classpath exception", 0.9), ("gpl-font", "exception", r"gpl .{0,60}?font exception", 0.9), ("gpl-linking", "exception", r"gpl .{0,60}?linking exception", 0.9),
    ("cc", "creative", r"creative commons licen[cs]e", 0.7), ("cc", "creative", r"licensed under (?:a )?creative commons", 0.8), ("cc", "creativecommons", r"creativecommons org licenses", 0.8), ("proprietary", "reserved", r"all rights reserved", 0.5), ("proprietary", "proprietary", r"proprietary (?:and confidential|licen[cs]e|software)", 0.7), ("proprietary", "commercial", r"commercial licen[cs]e(?: agreement)?", 0.6), ("proprietary", "evaluation", r"evaluation licen[cs]e", 0.6), ("proprietary", "eula agreement", r"(?:end user licen[cs]e agreement|eula)", 0.7),
    ("source-available", "commons", r"commons clause", 0.8), ("source-available", "sustainable", r"sustainable use licen[cs]e", 0.8), ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter|free trial)(?: licen[cs]e)?", 0.9), ("rail", "rail openrail bigsciencerail", r"(?:open|creativeml open|bigscience) ?rail(?: m)?(?: licen[cs]e)?", 0.9), ("llama", "llama", r"llama (?:2|3|3 1|3 2)? ?community licen[cs]e", 0.9),
    ("intel", "intel", r"intel(?: simplified)?(?: open source)? licen[cs]e", 0.7), ("ibm", "ibm", r"ibm public licen[cs]e", 0.9), ("sun", "sun", r"sun public licen[cs]e", 0.9), ("nokia", "nokia", r"nokia open source licen[cs]e", 0.9), ("netscape", "netscape", r"netscape public licen[cs]e", 0.9), ("jabber", "jabber", r"jabber open source licen[cs]e", 0.9), ("motosoto", "motosoto", r"motosoto licen[cs]e", 0.9), ("sleepycat", "sleepycat", r"sleepycat licen[cs]e", 0.9), ("xfree86", "xfree86", r"xfree86 licen[cs]e", 0.9), ("upl", "universal", r"universal permissive licen[cs]e", 0.9),
    ("bittorrent", "bittorrent", r"bittorrent open source licen[cs]e", 0.9), ("watcom", "watcom", r"(?:sybase )?open watcom public licen[cs]e", 0.9), ("naumen", "naumen", r"naumen public licen[cs]e", 0.9), ("fair", "fair", r"fair licen[cs]e", 0.7), ("mulan", "mulan", r"mulan (?:permissive|public|psl)(?: software)?(?: licen[cs]e)?", 0.9), ("wxwindows", "wxwindows", r"wxwindows library licen[cs]e", 0.9), ("imagemagick", "imagemagick", r"imagemagick licen[cs]e", 0.9), ("tcl", "tcl", r"tcl(?: tk)? licen[cs]e", 0.8), ("bzip2", "bzip2", r"bzip2(?: and libbzip2)? licen[cs]e", 0.9), ("freetype", "freetype", r"freetype(?: project)? licen[cs]e", 0.9), ("hpnd", "historical", r"historical permission notice and disclaimer", 0.9), ("miros", "miros", r"miros licen[cs]e", 0.9), ("ntp", "ntp", r"ntp licen[cs]e", 0.8), ("nasa", "nasa", r"nasa open source agreement", 0.9), ("entessa", "entessa", r"entessa public licen[cs]e", 0.9),
)


def rules() -> list[tuple[str, str, str, float]]:
    """(label, keywords, pattern, confidence), most telling first; the place in the list is the priority."""
    out: list[tuple[str, str, str, float]] = []
    for short, name, label, versions in _GNU:
        for v in versions:
            dotted = v.replace(" ", ".") + ("" if " " in v else ".0")
            number = v if " " in v else f"{v}(?: 0)?"
            out.append((f"{label}-{dotted}-or-later", "later plus", rf"(?:gnu )?{name}{_V} ?{number}{_OR_LATER}", 1.0))
            out.append((f"{label}-{dotted}", "general" if "general" in name else "documentation", rf"(?:gnu )?{name}{_V} ?{number}(?: only)?", 1.0))
            out.append((f"{label}-{dotted}", f"{short} {short}{v[0]}", rf"{short} ?{_V} ?{number}", 0.95))
            out.append((f"{label}-{dotted}", f"{short}v{v[0]}", rf"{short}v{number}", 0.95))
    for label, keyword, name, versions in _VERSIONED:
        for v in versions:
            dotted = v.replace(" ", ".")
            number = v[:-2] + "(?: 0)?" if v.endswith(" 0") else v
            out.append((f"{label}-{dotted}", keyword, rf"{name}{_V} ?{number}", 1.0))
        out.append((label, keyword, name, 0.85))
    for label, name, code in reversed(_CC_PARTS):
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            dotted = v.replace(" ", ".")
            out.append((f"{label}-{dotted}", "creative", rf"creative commons {name}{_V} ?{v}(?: international| unported| generic)?", 1.0))
            out.append((f"{label}-{dotted}", "cc", rf"cc {code} {v}", 1.0))
        out.append((label, "creative", rf"creative commons {name}", 0.85))
        out.append((label, "cc", rf"cc {code}", 0.8))
    for name in _SPDX:
        out.append((name.replace(" ", "-"), "spdx", rf"spdx license identifier {name}", 1.0))
    return out + list(_NAMED)


def _spaces(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def scan(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    table = rules()
    held: dict[str, list[str]] = {}
    for gate in sorted({r[1] for r in table}):
        for k in gate.split():
            held.setdefault(k, []).append(gate)
    keywords = sorted(held)
    gate = "(?:" + "|".join(keywords) + ")"
    rows = ", ".join(f"struct('{k}' AS gate, r'{' (?:' + pattern + ')(?= )'}' AS pattern, '{label}' AS label, {i} AS priority, {conf}D AS confidence)" for i, (label, k, pattern, conf) in enumerate(table))
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_uppercase.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))
    docs = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", flat.alias("flat"))
    docs = docs.withColumn("n_words", F.when(F.col("flat") == "  ", F.lit(0)).otherwise(_spaces(F.col("flat")) - 1).cast("long"))
    parts, counts, firsts, lasts, labels = [], [], [], [], []
    for i, (phrase, label) in enumerate(PHRASES):
        n = phrase.count(" ") + 1
        part = F.when(F.contains("flat", F.lit(f" {phrase} ")), F.split("flat", f" {phrase}(?= )", -1)).alias(f"p{i}")
        parts.append(part)
        c = F.col(f"p{i}")
        counts.append(F.coalesce(F.size(c) - 1, F.lit(0)))
        firsts.append(_spaces(F.element_at(c, 1)).cast("long"))
        lasts.append((F.col("n_words") - (_spaces(F.element_at(c, -1)) - 1) - n).cast("long"))
        labels.append(F.when(c.isNotNull(), F.lit(label)))
    # A first look at the whole text for any keyword; words in full are compared only where it finds one.
    near = F.when(F.col("flat").rlike(f" {gate} "), F.expr(f"array_intersect(split(flat, ' '), array({', '.join(repr(k) for k in keywords)}))"))
    gates = ", ".join(f"'{k}', array({', '.join(repr(g) for g in held[k])})" for k in keywords)
    near = F.flatten(F.transform(near, lambda w: F.element_at(F.expr(f"map({gates})"), w)))
    docs = docs.select("row", "doc_id", "flat", "n_words", near.alias("near"), *parts)
    found = F.expr(f"""flatten(transform(filter(array({rows}), r -> array_contains(near, r.gate) AND flat RLIKE r.pattern), r ->
        transform(arrays_zip(split(flat, r.pattern, -1), regexp_extract_all(flat, r.pattern, 0)), x -> struct(x.`0` AS gap, x.`1` AS hit, r.label AS label, r.priority AS priority, r.confidence AS confidence))))""")
    docs = docs.withColumn("hits", F.when(F.size("near") > 0, found))
    n_base = sum(counts[1:], counts[0])
    base = F.array_sort(F.array_compact(F.array(*labels)))
    docs = docs.select("row", "doc_id", "n_words", n_base.cast("long").alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), base.alias("base"), "hits")
    # A hit starts where the gaps and hits of its rule before it end.
    one = docs.select("*", F.posexplode_outer("hits").alias("at", "h")).drop("hits")
    rule = Window.partitionBy("row", "h.priority").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("end", F.sum(F.length("h.gap") + F.length("h.hit")).over(rule)).withColumn("start", F.col("end") - F.length("h.hit"))
    whole = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "h.priority").rowsBetween(Window.unboundedPreceding, -1)
    real = F.col("h.hit").isNotNull()
    one = one.withColumn("stays", real & ~F.coalesce(F.max(F.when(real, F.col("end"))).over(whole) >= F.col("end"), F.lit(False)))
    per = one.groupBy("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").agg(
        F.collect_set(F.when(F.col("stays"), F.col("h.label"))).alias("more"), F.max(F.when(F.col("stays"), F.col("h.confidence"))).alias("sure"), F.count_if("stays").alias("n_detections")
    )
    return per.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        F.greatest(F.coalesce("sure", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.7)).otherwise(F.lit(0.0))).alias("score"), "n_detections",
    )
