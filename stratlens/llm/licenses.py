"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word ``K``-gram of a text has a hash (a cyclic polynomial of its words' hashes).  The
grams whose hash some license template has are joined, by hash and then by their words, to the places
where templates have them.  A place in the text less its place in the template is a diagonal; grams
vote for diagonals, neighbouring diagonals (an inserted or missing word or two) are merged, and a
merged span is verified by the share of the template's grams it holds and by its length.

A text is cut into words once, in a scan whose result (word counts and the few places of note) is
written; nothing after it reads texts, and its work is linear in a text's length.

Besides, phrases that name a license are found wherever their words stand in a row; they are labels
of full score.  Templates are a fixed, small table (``TEMPLATES``), the only thing broadcast.

Defined results: null texts are empty texts, without words or labels.  Rows are kept one to one,
with null or repeated ids; equal texts get equal results.  Where several templates of a label match,
the label is given once.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

K = 3
GAP = 2
SHARE = 0.5
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
NO_LIABILITY = "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
GNU = "as published by the free software foundation either version {0} of the license or at your option any later version"
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + AS_IS + " " + NO_LIABILITY),
    ("mit", "licensed under the mit license"),
    ("mit", "released under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution " + BSD_END),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license " + GNU.format("3") + " this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license " + GNU.format("2 1")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("cc-by", "licensed under cc by 4 0"),
    ("reserved", "all rights reserved no part of this publication may be reproduced"),
]


def _words(text) -> F.Column:
    """The words, A-Z in lower case.  ``lower`` makes the Kelvin sign, and no other character beyond ASCII, a letter a-z."""
    low = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\ufffd")))
    return F.array_remove(F.split(low, BREAK), "")


def _once(df: DataFrame, value, name: str, *keep) -> DataFrame:
    """``keep`` and one column; the generator keeps its expression from being computed anew for each use."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def _code(words, i) -> F.Column:
    """The rolling hash of the K words from place i on."""
    out = None
    for k in range(K):
        h = F.xxhash64(F.get(words, i + k))
        by = K - 1 - k
        turned = F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h
        out = turned if out is None else out.bitwiseXOR(turned)
    return out


def _gram(words, i) -> F.Column:
    return F.concat_ws(" ", *(F.get(words, i + k) for k in range(K)))


def templates(spark) -> DataFrame:
    """(label, template, code, gram, place, total) of every template gram."""
    values = ", ".join(f"('{label}', {n}, '{text}')" for n, (label, text) in enumerate(TEMPLATES))
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(label, template, text)")
    rows = _once(table, _words(F.col("text")), "words", "label", "template").withColumn("total", F.size("words") - K + 1)
    rows = rows.select("label", "template", "total", "words", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("place"))
    w, i = F.col("words"), F.col("place")
    return rows.select("label", "template", _code(w, i).alias("code"), _gram(w, i).alias("gram"), "place", "total")


def _base(words, i) -> F.Column:
    """The label of the phrase that stands at place i, or null."""
    out = None
    for phrase, label in PHRASES.items():
        test = None
        for k, want in enumerate(phrase.split()):
            same = F.get(words, i + k) == want
            test = same if test is None else test & same
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def places(docs: DataFrame, text: str, codes: list[int], scratch: Scratch) -> DataFrame:
    """row, doc_id, n_words, base (places and labels of phrases) and grams (places, hashes and words that templates may have)."""
    firsts = sorted({p.split()[0] for p in PHRASES} | {w for _, t in TEMPLATES for w in t.split()[: -K + 1]})
    rows = _once(docs.select("doc_id", F.col(text).alias("text")), _words(F.col("text")), "words", F.monotonically_increasing_id().alias("row"), "doc_id")
    w = F.col("words")
    # only a word that begins a phrase or a template gram is looked at further
    noted = F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(firsts), F.struct(i.alias("at"), _base(w, i).alias("label"), _code(w, i).alias("code")))))
    rows = _once(rows, noted, "noted", "row", "doc_id", "words").withColumn("n_words", F.size("words").cast("long"))
    inside = F.filter("noted", lambda x: x["code"].isin(codes) & (x["at"] <= F.col("n_words") - K))
    rows = rows.select(
        "row", "doc_id", "n_words", F.filter("noted", lambda x: x["label"].isNotNull()).alias("base"),
        F.transform(inside, lambda x: F.struct(x["at"].alias("at"), x["code"].alias("code"), _gram(w, x["at"]).alias("gram"))).alias("grams"),
    )
    return scratch.keep(rows, "places")


def spans(found: DataFrame, table: DataFrame) -> DataFrame:
    """(row, label, template, begin, stop, share) of verified template spans, in words."""
    grams = found.where(F.size("grams") > 0).select("row", F.explode("grams").alias("g")).select("row", "g.at", "g.code", "g.gram")
    hits = grams.join(F.broadcast(table), ["code", "gram"])
    votes = hits.groupBy("row", "label", "template", "total", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("at").alias("begin"), (F.max("at") + K).alias("stop")
    )
    by = "PARTITION BY row, template ORDER BY diagonal"
    near = votes.withColumn("new", F.expr(f"IF(diagonal - LAG(diagonal) OVER ({by}) <= {GAP}, 0, 1)")).withColumn("grp", F.expr(f"SUM(new) OVER ({by} ROWS UNBOUNDED PRECEDING)"))
    merged = near.groupBy("row", "label", "template", "total", "grp").agg(F.sum("votes").alias("votes"), F.min("begin").alias("begin"), F.max("stop").alias("stop"))
    share = F.least(F.lit(1.0), F.col("votes") / F.col("total"))
    return merged.withColumn("share", share).where((F.col("share") >= SHARE) & (F.col("stop") - F.col("begin") <= 1.5 * (F.col("total") + K - 1))).select("row", "label", "template", "begin", "stop", "share")


def scan(docs: DataFrame, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and n_spans."""
    scratch = scratch or Scratch(docs.sparkSession, "licenses")
    table = templates(docs.sparkSession)
    # as many hashes as the fixed templates have grams
    codes = sorted({r["code"] for r in table.select("code").collect()})
    found = places(docs, text, codes, scratch)
    per = spans(found, table).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"), F.countDistinct("template", "begin").alias("n_spans"))
    none = {"more": F.array().cast("array<string>"), "share": F.lit(0.0), "n_spans": F.lit(0).cast("long")}
    plain = found.where(F.size("grams") == 0).drop("grams").withColumns(none)
    out = found.where(F.size("grams") > 0).drop("grams").join(per, "row", "left").withColumns({k: F.coalesce(k, v) for k, v in none.items()}).unionByName(plain)
    own = F.array_distinct(F.transform("base", lambda h: h["label"]))
    at = F.transform("base", lambda h: h["at"].cast("long"))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(own, F.col("more"))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.col("share")).alias("score"), "n_spans",
    )
