"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Native: DataFrame functions only. A text is read in four ways:

* SPDX tags, by their identifier or expression; one that is not known here is given as written.
* Passages of license texts and headers (the notice or the opening of each), as spans of words wherever the lines end.
* Single lines with a cue word that every line template has at least one of.
* Notices of a few words, as spans inside longer or wrapped lines.

Lines and spans become sparse TF-IDF vectors over their templates' vocabulary; a word that no template has counts with
the largest idf. A vector takes one sort of its words and one pass over them. Lines and spans need certain words (the
license's name and version) and may not have others (those of a sister license), so that a version that has no template
is not given another one's name. A span is as long as its template and laid so that an anchor word falls on the
template's. The best template at or above ``least`` (lines) or
``span_least`` cosine is the text's license; the ways count in the order above, and "all rights reserved" after any
named license. A file named like a license file lends its license to its directory and all below; a file without a
license of its own takes that of its nearest ancestor directory. Ancestors are joined by path, over distinct directories
rather than files.

Edge cases: null and empty texts have no license of their own; a null path inherits nothing; of several license files
in a directory the best score counts, then the first name; equal scores go to the template that sorts first; very long
texts and lines are read whole; repeated rows are each reported; columns of the input named as those made here
(own_license, own_score, license, origin, from_dir) are replaced, as are _dir, _up and _n, others pass through; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: License ids, the words needed and barred in a line (a license's name and version, a sister's name),
#: and their header or title lines, in lower case.
TEMPLATES = [
    ("Apache-2.0", "apache 2.0", "", "licensed under the apache license version 2.0"),
    ("BSD-3-Clause", "redistribution binary", "", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("CC-BY-NC-4.0", "nc 4.0", "sa nd", "licensed under cc by nc 4.0"),
    ("CC0-1.0", "dedicated domain", "", "to the extent possible under law the author has dedicated this work to the public domain"),
    ("GPL-3.0", "gnu general 3", "lesser affero", "this work is licensed under the gnu general public license version 3"),
    ("ISC", "permission fee", "", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "lesser 2.1", "", "licensed under the gnu lesser general public license version 2.1"),
    ("MIT", "mit", "", "released under the mit license"),
    ("MPL-2.0", "mozilla 2.0", "", "this source code form is subject to the terms of the mozilla public license version 2.0"),
    ("Proprietary", "rights reserved", "", "all rights reserved"),
    ("Unlicense", "unencumbered", "", "this is free and unencumbered software released into the public domain"),
]
#: Spans: license, words needed, words barred, anchor, text. Those of PASSAGES are of license texts and headers.
PASSAGES = [
    ("Apache-2.0", "apache 2.0 compliance", "", "apache", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("Apache-2.0", "apache 2.0 reproduction", "", "apache", "apache license version 2.0 january 2004 http www.apache.org licenses terms and conditions for use reproduction and distribution"),
    ("BSD-3-Clause", "redistribution binary neither endorse", "", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-2-Clause", "redistribution binary reproduce provided express", "neither endorse", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("CC-BY-NC-4.0", "noncommercial 4.0 licensed", "sharealike noderivatives noderivs", "licensed", "licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("CC-BY-NC-4.0", "noncommercial 4.0 firm", "sharealike noderivatives noderivs", "noncommercial", "attribution noncommercial 4.0 international creative commons corporation creative commons is not a law firm and does not provide legal services or legal advice"),
    ("CC0-1.0", "waived neighboring", "", "waived", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("CC0-1.0", "purpose jurisdictions exclusive", "", "jurisdictions", "statement of purpose the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights defined below upon the creator and subsequent owner s"),
    ("GPL-3.0", "gnu general redistribute 3", "lesser affero", "gnu", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL-3.0", "gnu general verbatim 29 june 2007", "lesser affero", "general", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc https fsf.org everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("ISC", "fee granted copies", "", "granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("LGPL-2.1", "gnu lesser redistribute 2.1", "", "gnu", "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("LGPL-2.1", "gnu lesser verbatim 2.1 february 1999", "", "lesser", "gnu lesser general public license version 2.1 february 1999 copyright c 1991 1999 free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("MIT", "granted charge sublicense", "", "granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("MPL-2.0", "mozilla mpl 2.0", "", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("MPL-2.0", "mozilla 2.0 covered", "", "mozilla", "mozilla public license version 2.0 1 definitions 1.1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software"),
    ("Unlicense", "unencumbered domain compile", "", "unencumbered", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]
NOTICES = [
    ("Apache-2.0", "apache 2.0", "", "apache", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "apache 2.0", "", "apache", "under the apache license 2.0"),
    ("CC-BY-NC-4.0", "cc nc 4.0", "sa nd", "cc", "licensed under cc by nc 4.0"),
    ("CC0-1.0", "dedicated domain", "", "dedicated", "to the extent possible under law the author has dedicated this work to the public domain"),
    ("GPL-3.0", "gnu general 3", "lesser affero", "gnu", "licensed under the gnu general public license version 3"),
    ("GPL-3.0", "gnu general 3", "lesser affero", "gnu", "gnu general public license version 3"),
    ("GPL-3.0", "gnu general v3", "lesser affero", "gnu", "licensed under the gnu general public license v3"),
    ("LGPL-2.1", "lesser 2.1", "", "lesser", "licensed under the gnu lesser general public license version 2.1"),
    ("LGPL-2.1", "lesser 2.1", "", "lesser", "gnu lesser general public license version 2.1"),
    ("MIT", "mit", "", "mit", "released under the mit license"),
    ("MIT", "granted charge person copy", "", "granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("MIT", "mit under", "", "mit", "under the mit license"),
    ("MPL-2.0", "mozilla 2.0", "", "mozilla", "subject to the terms of the mozilla public license version 2.0"),
    ("MPL-2.0", "mozilla 2.0", "", "mozilla", "licensed under the mozilla public license version 2.0"),
    ("Unlicense", "unencumbered domain", "", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("Proprietary", "all rights reserved", "", "reserved", "all rights reserved"),
]
#: SPDX identifiers in lower case, without "-only", "-or-later" or "+".
SPDX = {name.lower(): name for name, *_ in TEMPLATES if name != "Proprietary"}
TAG = r"(?i)spdx-license-identifier\s*:\s*([(]*[a-z0-9.+-]+[)]*(?:[ \t]+(?:and|or|with)[ \t]+[(]*[a-z0-9.+-]+[)]*)*)"
CUE = "licens|rights reserved|public domain|redistribution and use|hereby granted"
#: Every span has one of these words, on a line of its own or not.
WIDE = "licens|reserved|domain|granted|redistribution|waived|jurisdictions|noncommercial"
SPLIT = "[^a-z0-9.]+"
FILES = "^(license|licence|copying)([.].*)?$"


def tokens(line: str) -> list[str]:
    return [x for x in (t.strip(".") for t in re.split(SPLIT, line.lower())) if x]


def weights(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """(idf, idf of unknown words, unit TF-IDF vector of each template)."""
    n = len(templates)
    df: dict[str, int] = {}
    for _, text in templates:
        for t in set(tokens(text)):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
    out = []
    for name, text in templates:
        v = {t: tokens(text).count(t) * idf[t] for t in tokens(text)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append((name, {t: x / norm for t, x in v.items()}))
    return idf, math.log(1 + n) + 1, out


def as_map(d: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv])


def in_words(line: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(line), SPLIT), lambda t: F.regexp_replace(t, "^[.]+|[.]+$", "")), lambda t: t != "")


def total(words: Column, weight: Callable[[Column], Column]) -> Column:
    """Sum of a weight over all words."""
    return F.aggregate(words, F.lit(0.0), lambda a, t: a + weight(t))


def length(words: Column, idf: Callable[[Column], Column]) -> Column:
    """Norm of the TF-IDF vector of a bag of words, in one pass over the sorted words: the r-th occurrence of a word
    adds (2 r - 1) idf**2, which sums to (n idf)**2."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("r"), F.lit(0.0).alias("sum"))

    def step(a: Column, t: Column) -> Column:
        r = F.when(a["last"] == t, a["r"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), r.alias("r"), (a["sum"] + (2 * r - 1) * idf(t) * idf(t)).alias("sum"))

    return F.sqrt(F.aggregate(F.sort_array(words), start, step, lambda a: a["sum"]))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def in_spans(words: Column, spans: list[tuple[str, str, str, str, str]], rank: int, least: float) -> Column:
    """The best (rank, score, first, license) of the spans laid by an anchor that have the words needed, none of those
    barred, and ``least`` cosine; else null."""
    idf, unknown, vectors = weights([(s[0], s[4]) for s in spans])
    vectors = [(name, {t: x * idf[t] for t, x in v.items()}) for name, v in vectors]
    rows = [{"rank": rank if name != "Proprietary" else 0, "first": -k, "license": name, "need": need.split(), "bar": bar.split(), "anchor": anchor, "at": tokens(text).index(anchor), "size": len(tokens(text)), "v": v} for k, ((name, need, bar, anchor, text), (_, v)) in enumerate(zip(spans, vectors, strict=True))]
    kind = "rank int, first int, license string, need array<string>, bar array<string>, anchor string, at int, size int, v map<string,double>"
    table, idf_map = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>"), F.from_json(F.lit(json.dumps(idf)), "map<string,double>")

    def scored(w: Column, s: Column) -> Column:
        near = total(w, lambda t: F.coalesce(F.try_element_at(s["v"], t), F.lit(0.0)))
        score = F.round(near / length(w, lambda t: F.coalesce(F.try_element_at(idf_map, t), F.lit(unknown))), 6)
        return F.struct(s["rank"].alias("rank"), score.alias("score"), s["first"].alias("first"), s["license"].alias("license"))

    def of(s: Column, words: Column, anchors: Column) -> Column:
        cut = F.transform(F.filter(anchors, lambda a: a["t"] == s["anchor"]), lambda a: F.slice(words, F.greatest(a["i"] - s["at"], F.lit(0)) + 1, s["size"]))
        fit = F.filter(cut, lambda w: F.forall(s["need"], lambda x: F.array_contains(w, x)) & ~F.exists(s["bar"], lambda x: F.array_contains(w, x)))
        return F.transform(fit, lambda w: scored(w, s))

    anchors = F.filter(F.transform(words, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda a: a["t"].isin(sorted({s[3] for s in spans})))
    found = bound(anchors, lambda at: F.flatten(F.transform(table, lambda s: of(s, words, at))))
    return F.array_max(F.filter(found, lambda x: x["score"] >= least))


def tagged(text: Column) -> Column:
    """(rank, score, first, license) of the first SPDX tag, else null. Ids that are known here take their name, others
    stay as written, so that a tagged file never takes another license from its directory; an expression keeps its
    operators, in capitals."""
    known = F.create_map(*[F.lit(x) for kv in sorted(SPDX.items()) for x in kv])
    said = F.try_element_at(F.regexp_extract_all(text, F.lit(TAG), 1), F.lit(1))

    def word(x: Column) -> Column:
        name = F.regexp_replace(F.regexp_extract(x, "^[(]*([^()]*)", 1), "[.]+$", "")
        same = F.try_element_at(known, F.regexp_replace(F.lower(name), "-only$|-or-later$|[+]$", ""))
        shown = F.when(F.upper(name).isin("AND", "OR", "WITH"), F.upper(name)).otherwise(F.coalesce(same, name))
        return F.concat(F.regexp_extract(x, "^([(]*)", 1), shown, F.regexp_extract(x, "([)]*)$", 1))

    # parentheses around the whole, closed or not, say nothing
    name = F.regexp_replace(F.array_join(F.transform(F.split(said, "[ \t]+"), word), " "), "^[(]+([^()]*)[)]*$", "$1")
    return F.when(F.length(name) > 0, F.struct(F.lit(4).alias("rank"), F.lit(1.0).alias("score"), F.lit(0).alias("first"), name.alias("license")))


def detect(df: DataFrame, text: str = "text", least: float = 0.6, templates: list[tuple[str, str]] | None = None, span_least: float = 0.8) -> DataFrame:
    """``df`` with own_license and own_score (null if nothing reaches its least cosine). With ``templates`` (license,
    line) of the caller's own only lines are read, as the passages, notices and tags belong to the fixed licenses."""
    given = [(name, "", "", line) for name, line in templates] if templates else TEMPLATES
    idf, unknown, vectors = weights([(x[0], x[3]) for x in given])
    idf_map = as_map(idf)

    def scored(words: Column) -> Column:
        """The best template of a line's words; each template's sum takes the words that it has, all in one pass each."""
        norm = length(words, lambda t: F.coalesce(F.try_element_at(idf_map, t), F.lit(unknown)))
        known = F.filter(words, lambda t: t.isin(sorted(idf)))

        def each(norm: Column, known: Column) -> Column:
            out = []
            for i, ((name, need, bar, _), (_, v)) in enumerate(zip(given, vectors, strict=True)):
                m = as_map({t: x * idf[t] for t, x in v.items()})
                fits = F.lit(True)
                for t in need.split():
                    fits = fits & F.array_contains(words, t)
                for t in bar.split():
                    fits = fits & ~F.array_contains(words, t)
                score = F.round(total(known, lambda t, m=m: F.coalesce(F.try_element_at(m, t), F.lit(0.0))) / norm, 6)
                # of equal scores the first template has the largest number
                out.append(F.when(fits, F.struct(score.alias("score"), F.lit(-i).alias("first"), F.lit(name).alias("license"))))
            return F.array_max(F.array(*out))

        return bound(F.struct(norm.alias("norm"), known.alias("known")), lambda x: each(x["norm"], x["known"]))

    def best(line: Column) -> Column:
        return bound(in_words(line), scored)

    lines = F.when(F.lower(text).rlike(CUE), F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike(CUE)))
    # all other columns wait in a struct, out of reach of the names used here
    others = [c for c in df.columns if c not in (text, "own_license", "own_score")]
    df = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_rest"), F.col(f"`{text}`").alias(text))
    found_line = F.array_max(F.filter(F.transform(lines, best), lambda b: b["score"] >= least))
    df = df.withColumn("_line", found_line)
    back = [F.col("_rest").getField(c).alias(c) for c in others]
    if templates:
        return df.select(*back, text, F.col("_line.license").alias("own_license"), F.col("_line.score").alias("own_score"))
    rank = F.when(F.col("_line.license") == "Proprietary", 0).otherwise(2)
    line = F.when(F.col("_line").isNotNull(), F.struct(rank.alias("rank"), F.col("_line.score").alias("score"), F.col("_line.first").alias("first"), F.col("_line.license").alias("license")))
    spans = bound(in_words(F.col(text)), lambda w: F.array_max(F.array(in_spans(w, PASSAGES, 3, span_least), in_spans(w, NOTICES, 1, span_least))))
    found = [line, F.when(F.lower(text).rlike(WIDE), F.array_max(F.array(tagged(F.col(text)), spans)))]
    df = df.withColumn("_top", F.array_max(F.array(*found)))
    return df.select(*back, text, F.col("_top.license").alias("own_license"), F.col("_top.score").alias("own_score"))


def directory(path: Column) -> Column:
    """All before the last slash; empty for a file at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(files: DataFrame) -> DataFrame:
    """``files`` (path, own_license, own_score and others) with license, origin (own, inherited, none) and from_dir."""
    files = files.drop("license", "origin", "from_dir", "_dir", "_up", "_n").withColumn("_dir", directory(F.col("path")))
    name = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    lent = files.where(F.col("own_license").isNotNull() & name.rlike(FILES)).groupBy("_dir")
    lent = lent.agg(F.min_by("own_license", F.struct(-F.col("own_score"), "own_license")).alias("_license")).withColumnRenamed("_dir", "_up")
    # each distinct directory with its ancestors, itself included; depth is a property of paths, not of the corpus
    parts = F.split("_dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))
    dirs = files.where("_dir is not null").select("_dir").distinct().withColumn("a", F.explode(up)).select("_dir", F.col("a.k").alias("k"), F.col("a.up").alias("_up"))
    nearest = dirs.join(lent, "_up").groupBy("_dir").agg(F.max_by(F.struct("_license", "_up"), "k").alias("_n"))
    out = files.join(nearest, "_dir", "left")
    origin = F.when(F.col("own_license").isNotNull(), "own").when(F.col("_n").isNotNull(), "inherited").otherwise("none")
    out = out.withColumn("license", F.coalesce("own_license", "_n._license")).withColumn("origin", origin)
    return out.withColumn("from_dir", F.when(origin == "inherited", F.col("_n._up"))).drop("_dir", "_n")


def doc_path(doc: str = "doc_id") -> Column:
    """A place in a tree for each document: eight to a directory, whose first is its license file; every 64th and 512th
    document is the license file one and two levels up."""
    d = F.col(doc)
    top, mid, low = F.floor(d / 512).cast("string"), F.floor(d / 64).cast("string"), F.floor(d / 8).cast("string")
    tree = F.when(d % 512 == 0, F.concat_ws("/", F.lit("r"), top)).when(d % 64 == 0, F.concat_ws("/", F.lit("r"), top, mid)).otherwise(F.concat_ws("/", F.lit("r"), top, mid, low))
    return F.when(d.isNotNull(), F.concat_ws("/", tree, F.when(d % 8 == 0, "LICENSE").otherwise(F.concat(d.cast("string"), F.lit(".txt")))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = detect(docs).select("doc_id", doc_path().alias("path"), "own_license", "own_score")
    return inherit(found).select("doc_id", "path", "own_license", "own_score", "license", "origin", "from_dir")


def oracle() -> str:
    """The same in DuckDB SQL, for texts whose notices stand on lines of their own."""
    idf, unknown, vectors = weights([(x[0], x[3]) for x in TEMPLATES])
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    idf_rows = ", ".join(f"({quoted(t)}, {w!r}::DOUBLE)" for t, w in sorted(idf.items()))
    vec_rows = ", ".join(f"({i}, {quoted(n)}, {quoted(t)}, {w!r}::DOUBLE)" for i, (n, v) in enumerate(vectors) for t, w in sorted(v.items()))
    words_of = lambda at: ", ".join(f"({i}, {quoted(t)})" for i, x in enumerate(TEMPLATES) for t in x[at].split())
    return f"""
WITH idf(t, idf) AS (VALUES {idf_rows}),
vec(i, license, t, w) AS (VALUES {vec_rows}),
need(i, t) AS (VALUES {words_of(1)}),
bar(i, t) AS (VALUES {words_of(2)}),
docs AS (SELECT doc_id, text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
cand AS (SELECT doc_id, row_number() OVER () AS k, line FROM lines WHERE regexp_matches(lower(line), '{CUE}')),
toks AS (SELECT doc_id, k, regexp_replace(x, '^[.]+|[.]+$', '', 'g') AS t FROM (SELECT doc_id, k, unnest(regexp_split_to_array(lower(line), '{SPLIT}')) AS x FROM cand)),
tf AS (SELECT doc_id, k, toks.t, count(*) * coalesce(any_value(idf.idf), {unknown!r}) AS w FROM toks LEFT JOIN idf ON toks.t = idf.t WHERE toks.t <> '' GROUP BY 1, 2, 3),
norm AS (SELECT k, sqrt(sum(w * w)) AS norm FROM tf GROUP BY 1),
score AS (SELECT tf.doc_id, tf.k, vec.i, vec.license, round(sum(tf.w * vec.w) / any_value(norm.norm), 6) AS score FROM tf JOIN vec ON tf.t = vec.t JOIN norm ON norm.k = tf.k GROUP BY 1, 2, 3, 4),
has AS (SELECT s.k, s.i FROM score s JOIN need ON need.i = s.i LEFT JOIN tf ON tf.k = s.k AND tf.t = need.t GROUP BY 1, 2 HAVING count(tf.t) = count(*)),
sister AS (SELECT DISTINCT s.k, s.i FROM score s JOIN bar ON bar.i = s.i JOIN tf ON tf.k = s.k AND tf.t = bar.t),
fit AS (SELECT s.* FROM score s JOIN has ON has.k = s.k AND has.i = s.i ANTI JOIN sister ON sister.k = s.k AND sister.i = s.i WHERE s.score >= 0.6),
own AS (SELECT doc_id, license AS own_license, score AS own_score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rn FROM fit) WHERE rn = 1),
files AS (SELECT d.doc_id, CASE WHEN d.doc_id % 512 = 0 THEN concat_ws('/', 'r', d.doc_id // 512) WHEN d.doc_id % 64 = 0 THEN concat_ws('/', 'r', d.doc_id // 512, d.doc_id // 64) ELSE concat_ws('/', 'r', d.doc_id // 512, d.doc_id // 64, d.doc_id // 8) END AS dir,
  CASE WHEN d.doc_id % 8 = 0 THEN 'LICENSE' ELSE d.doc_id || '.txt' END AS name, own_license, own_score FROM docs d LEFT JOIN own USING (doc_id)),
lent AS (SELECT dir, own_license FROM files WHERE name = 'LICENSE' AND own_license IS NOT NULL),
near AS (SELECT f.doc_id, l.dir AS up, l.own_license AS license, row_number() OVER (PARTITION BY f.doc_id ORDER BY length(l.dir) DESC) AS rn FROM files f JOIN lent l ON f.dir = l.dir OR starts_with(f.dir, l.dir || '/'))
SELECT f.doc_id, f.dir || '/' || f.name AS path, f.own_license, f.own_score, coalesce(f.own_license, n.license) AS license,
  CASE WHEN f.own_license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN f.own_license IS NULL THEN n.up END AS from_dir
FROM files f LEFT JOIN near n ON n.doc_id = f.doc_id AND n.rn = 1"""
