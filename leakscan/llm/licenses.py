"""License scans: an exact set-similarity (containment) join of text blocks with licence notices.

A block is a run of neighbouring lines: from each line on, as many lines with words as it takes to have the notice's number
of words behind the first line, so a notice wrapped over lines stands in the block of the line it starts in. A notice
matches a block if at least ``THRESHOLD`` of the notice's distinct words are in the block. The words of the notices are
ordered by how many documents have them, over all documents; a match must hold one of the notice's ``size - need + 1`` rarest words (prefix filter), have ``need`` words at least (length filter) and
enough words left behind the first common one (positional filter); what remains is verified exactly. Only DataFrame
functions are used. The notices are a constant of this module, so the broadcast side has a fixed size.

Defined results: null and empty texts have no words, no places and no labels; a null id is carried through; repeated
rows give repeated results; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_or_empty
from .quality import let

#: Phrase and label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices by label, as their words appear (lower case, without punctuation). Statements of one line and
#: the texts that projects put at the top of their files or into a licence file.
NOTICES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is licensed under the gnu lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl", "this program is licensed under the gnu affero general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("wtfpl", "do what the fuck you want to public license"),
]
THRESHOLD = 0.9


def _spaced_phrases() -> list[str]:
    """Each phrase as it stands in a text whose words are joined by two spaces, so that neighbours share none."""
    return [" " + "  ".join(p.split()) + " " for p in PHRASES]


def _phrase_at(words: Column, word: Column, i: Column) -> Column:
    """Whether one of the phrases starts with ``word``, which stands at ``i``."""
    one = lambda p: reduce(Column.__and__, (F.get(words, i + k) == x for k, x in enumerate(p[1:], 1)), word == p[0])
    return reduce(Column.__or__, (one(p.split()) for p in PHRASES))


def lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _words(text: Column) -> Column:
    return F.filter(F.split(lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def word_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each of the given words stands, over all documents."""
    listed = F.array(*map(F.lit, words))
    rows = docs.select(F.explode(F.array_intersect(_words(text_or_empty()), listed)).alias("w")).groupBy("w").count().collect()
    return {w: 0 for w in words} | {r["w"]: r["count"] for r in rows}


def prefix_index(notices: list[tuple[str, str]], frequency: dict[str, int], threshold: float) -> list[tuple]:
    """(prefix word, its place, notice number, label, words, need, words with repeats) for each prefix word of each notice."""
    out = []
    for k, (label, notice) in enumerate(notices):
        ranked = sorted(set(notice.split()), key=lambda w: (frequency[w], w))
        need = math.ceil(threshold * len(ranked))
        out += [(w, i, k, label, ranked, need, len(notice.split())) for i, w in enumerate(ranked[: len(ranked) - need + 1])]
    return out


def _lines_holding(words: Column, ends: Column, most: Column) -> Column:
    """The words of the first line and of as many further lines as it takes to have ``most`` words behind the first."""
    enough = F.get(F.filter(ends, lambda e: e >= ends[0] + most), F.lit(0))
    return F.slice(words, F.lit(1), F.coalesce(enough, F.size(words)))


def _runs(text: Column, prefix: Column, most: int) -> Column:
    """(words, ends of lines within them) of each line's run up to ``most`` words behind the line, if it has a prefix word."""
    lines = F.filter(F.transform(F.split(text, "\n"), _words), lambda x: F.size(x) > 0)
    flagged = F.transform(lines, lambda x: F.struct(x.alias("w"), F.arrays_overlap(x, prefix).alias("hit")))

    def of(flagged: Column) -> Column:
        sum_up = lambda a, x: F.concat(a, F.array(F.get(a, F.size(a) - 1) + F.size(x["w"])))
        ends = F.aggregate(flagged, F.array(F.lit(0)), sum_up)  # where each line ends, in words; 0 first

        def run(ends: Column) -> Column:
            def lines_on(_, i: Column) -> Column:
                ahead = F.slice(ends, i + 2, most + 1)  # each line has a word at least, so these are enough
                n = F.size(F.filter(ahead, lambda e: e < ends[i + 1] + most)) + 1
                return F.struct(F.slice(flagged, i + 1, n).alias("own"), F.transform(F.slice(ends, i + 2, n), lambda e: e - ends[i]).alias("ends"))

            near = F.filter(F.transform(flagged, lines_on), lambda b: F.exists(b["own"], lambda x: x["hit"]))
            return F.transform(near, lambda b: F.struct(F.flatten(b["own"]["w"]).alias("words"), b["ends"].alias("ends")))

        return let(ends, run)

    return let(flagged, of)


def scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, base counts and places, matched labels and best containment."""
    spark, t = docs.sparkSession, F.col("t")
    vocabulary = sorted({w for _, n in notices for w in n.split()})
    index = prefix_index(notices, word_frequencies(docs.select("text"), vocabulary), threshold)
    rows = F.broadcast(spark.createDataFrame(index, "word string, place int, notice int, label string, words array<string>, need int, long int"))
    prefix = F.array(*(F.lit(w) for w in sorted({x[0] for x in index})))

    w, spaced = F.col("w"), F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" "))
    base = docs.select("doc_id", text_or_empty().alias("t")).withColumn("rid", F.monotonically_increasing_id()).withColumn("w", _words(t)).withColumn("s", spaced)
    counts = F.array(*((F.length("s") - F.length(F.replace("s", F.lit(x), F.lit("")))) / len(x) for x in _spaced_phrases())).cast("array<long>")
    some = reduce(Column.__or__, (F.contains("s", F.lit(x)) for x in _spaced_phrases()))
    base = base.withColumn("n", F.when(some, counts).otherwise(F.array(*[F.lit(0)] * len(PHRASES)).cast("array<long>")))
    blocks = _runs(t, prefix, max(x[6] for x in index))
    places = F.when(some, F.filter(F.transform(w, lambda x, i: F.when(_phrase_at(w, x, i), i)), lambda i: i.isNotNull()))
    base = base.withColumn("places", places).select(
        "rid", "doc_id", F.size(w).cast("long").alias("n_words"), "n",
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.when(F.arrays_overlap(w, prefix), blocks).alias("blocks"),
    )
    keys = ["rid", "doc_id", "n_words", "n", "first_word", "last_word"]
    each = base.select(*keys, F.explode_outer("blocks").alias("block"))
    each = each.select(*keys, "block", F.explode_outer(F.array_intersect("block.words", prefix)).alias("word"))
    left = F.size("words") - F.col("place")
    own = _lines_holding(F.col("block.words"), F.col("block.ends"), F.col("long"))
    found = each.join(rows, "word", "left").withColumn("own", F.when((F.size("block.words") >= F.col("need")) & (left >= F.col("need")), own))
    found = found.withColumn("share", F.size(F.array_intersect("own", "words")) / F.size("words"))
    met = F.col("share") * F.size("words") >= F.col("need") - 1e-9
    return found.groupBy(*keys).agg(F.collect_set(F.when(met, F.col("label"))).alias("matched"), F.max(F.when(met, F.col("share"))).alias("containment"))


def scan_report(docs: DataFrame) -> DataFrame:
    """The digest of ``scan``: counts, places, base labels, all labels and a score."""
    names = list(PHRASES.values())
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    base = F.array_compact(F.array(*(F.when(F.col("n")[i] > 0, F.lit(x)) for i, x in enumerate(names))))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scan(docs).select(
        "doc_id", "n_words", total.alias("n_base"), "first_word", "last_word", join(base).alias("base_labels"),
        join(F.concat(base, "matched")).alias("labels"), F.when(total > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def oracle_sql(notices: list[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan_report``: every notice against the run of every line, without any filter."""
    rows = []
    for label, notice in notices:
        words = sorted(set(notice.split()))
        rows.append(f"('{label}', {words}, {math.ceil(threshold * len(words))}, {len(notice.split())})")
    place = " OR ".join("(" + " AND ".join(f"w[i+{k}] = '{x}'" for k, x in enumerate(p.split(), 1)) + ")" for p in PHRASES)
    base = ", ".join(f"CASE WHEN len(list_filter(range(0, len(w)), lambda i: {' AND '.join(f"w[i+{k}] = '{x}'" for k, x in enumerate(p.split(), 1))})) > 0 THEN '{label}' END" for p, label in PHRASES.items())
    cut = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""WITH n(label, words, need, long) AS (VALUES {', '.join(rows)}),
     t AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
     d AS (SELECT doc_id, t, regexp_extract_all(t, '{cut}') AS w FROM t),
     b AS (SELECT doc_id, w, list_filter(range(0, len(w)), lambda i: {place}) AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM d),
     l AS (SELECT doc_id, i, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM
       (SELECT doc_id, unnest(list_transform(string_split(t, chr(10)), lambda x: len(regexp_extract_all(x, '{cut}')))) AS n, unnest(range(0, len(string_split(t, chr(10))))) AS i FROM d) WHERE n > 0)),
     e AS (SELECT doc_id, list(e ORDER BY i) AS ends FROM l GROUP BY doc_id),
     c AS (SELECT l.doc_id, label, need, len(words) AS size, len(list_intersect(words, w[s + 1 : coalesce(list_min(list_filter(ends, lambda x: x >= e + long)), len(w))])) AS common FROM l JOIN e USING (doc_id) JOIN d USING (doc_id), n),
     m AS (SELECT doc_id, list(DISTINCT label) AS matched, max(common / size) AS containment FROM c WHERE common >= need GROUP BY doc_id)
     SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
     array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(matched, [])))), ',') AS labels,
     CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END::DOUBLE AS score FROM b LEFT JOIN m USING (doc_id)"""  # noqa: S608
