"""License scans by diagonal voting: rolling word k-gram hashes join template positions and vote for offset diagonals.

A hit at document word i and template word j votes for diagonal i - j. Neighbouring diagonals of a template merge (words inserted
or left out) into a span that drifts by DRIFT words at most. A span is verified by alignment: its hits, in the document's order,
must rise in the template too, and the longest such chain counts as the share of the template's grams that the document holds in
order. Of overlapping spans of templates the one with the greatest share stays. Phrases are matched apart from templates, by
the same join: a phrase stands where its diagonal has every one of its grams.

Each row of the input gives one row. Null and empty texts have no words. Repeated rows each get theirs: equal ids with equal texts
(by 128 bits) are scanned as one and handed out again. An empty table gives an empty one, and other columns are not read. The
templates are a parameter of fixed size, so they are broadcast; grams of a document are exploded, voted map-side and shuffled by
document and template, so no word or phrase has a task of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, ascii_lower, fixed_table, text_of

#: Words to a gram of a template; a phrase's grams have two.
K = 4
#: Diagonals at most NEAR apart merge while they stay within DRIFT of the first; a span needs the share COVER of its template's grams.
NEAR, DRIFT, COVER = 4, 40, 0.5
#: Fixed values of the contract: phrase and label.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Public licence notices and their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher"),
]


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z]+", text.lower()) if w]


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """A row for each gram of each template: tpl, label, is_phrase, grams (of the template), t_pos, t_1 to t_4 (the last two null for a
    phrase), t_hash of the first two."""
    rows = []
    for i, (words, label, phrase) in enumerate([(_words(p), label, True) for p, label in phrases] + [(_words(t), label, False) for label, t in templates]):
        k = 2 if phrase else K
        if len(words) < k:
            raise ValueError(f"a phrase needs at least 2 words and a template {K}")
        rows += [(i, label, phrase, len(words) - k + 1, j, *words[j : j + k], *[None] * (K - k)) for j in range(len(words) - k + 1)]
    out = fixed_table(spark, rows, "tpl int, label string, is_phrase boolean, grams int, t_pos int, t_1 string, t_2 string, t_3 string, t_4 string")
    return out.withColumn("t_hash", F.xxhash64("t_1", "t_2"))


def longest_chain(hits: Column) -> Column:
    """Of (pos, t_pos) hits, the most that rise in both: the tails of patience sorting."""
    order = F.array_sort(F.transform(hits, lambda x: F.struct(x["pos"].alias("pos"), (-x["t_pos"]).alias("down"))))

    def step(tails: Column, x: Column) -> Column:
        t = -x["down"]
        at = F.size(F.filter(tails, lambda y: y < t))
        return F.concat(F.slice(tails, 1, at), F.array(t), F.slice(tails, at + 2, F.greatest(F.size(tails) - at - 1, F.lit(0))))

    return F.size(F.aggregate(order, F.array().cast("array<int>"), step))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Rows (_id, _h1, _h2, n_words, tpl, label, is_phrase, start, end, cover, _rows): each document (id and text) has one without tpl,
    whose _rows counts its rows, and one for each place of a phrase and each verified span of a template.

    start: the word where a phrase stands, or a span's first hit; end: the word behind its last."""
    text = text_of(text_col)
    words = F.filter(F.split(ascii_lower(text), WORD_GAP), lambda w: w != "")
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit("#"), text).alias("_h2"), words.alias("_w"))
    base = base.withColumn("n_words", F.size("_w").cast("long"))
    doc = ["_id", "_h1", "_h2", "n_words"]
    behind = lambda n: F.slice("_w", n + 1, F.greatest(F.size("_w"), F.lit(1)))
    pairs = F.arrays_zip(F.col("_w").alias("a"), behind(1).alias("b"), behind(2).alias("c"), behind(3).alias("d"))
    none = F.array(F.lit(None).cast("struct<a:string,b:string,c:string,d:string>"))
    rows = base.select(*doc, F.posexplode(F.concat(none, pairs)).alias("_p", "_g")).where((F.col("_p") == 0) | F.col("_g.b").isNotNull())
    rows = rows.select(*doc, (F.col("_p") - 1).alias("_pos"), *[F.col(f"_g.{x}").alias(f"_{x}") for x in "abcd"])
    known = F.broadcast(template_grams(docs.sparkSession, phrases, templates))
    same = (F.xxhash64("_a", "_b") == F.col("t_hash")) & (F.col("_a") == F.col("t_1")) & (F.col("_b") == F.col("t_2"))
    hits = rows.join(known, same & (F.col("is_phrase") | ((F.col("_c") == F.col("t_3")) & (F.col("_d") == F.col("t_4")))), "left")
    hits = hits.where(F.col("tpl").isNotNull() | (F.col("_pos") < 0)).withColumn("_diag", F.col("_pos") - F.col("t_pos"))
    tpl = ["tpl", "label", "is_phrase", "grams"]
    # A template has few grams, so a diagonal's hits are a set of bounded size, whatever the number of equal rows.
    votes = hits.groupBy(*doc, *tpl, "_diag").agg(F.collect_set("t_pos").alias("_held"), F.count(F.when(F.col("tpl").isNull(), 1)).alias("_rows"))
    votes = votes.where(F.col("tpl").isNull() | ~F.col("is_phrase") | (F.size("_held") == F.col("grams")))
    order = Window.partitionBy(*doc, "tpl").orderBy("_diag")
    gap = (F.col("_diag") - F.lag("_diag").over(order)) > F.when(F.col("is_phrase"), 0).otherwise(NEAR)
    merged = votes.withColumn("_run", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(order))
    first = F.min("_diag").over(Window.partitionBy(*doc, "tpl", "_run"))
    merged = merged.withColumn("_part", F.floor((F.col("_diag") - first) / DRIFT))
    placed = F.transform("_held", lambda t: F.struct((F.col("_diag") + t).cast("int").alias("pos"), t.alias("t_pos")))
    merged = merged.groupBy(*doc, *tpl, "_run", "_part").agg(F.flatten(F.collect_list(placed)).alias("_hits"), F.sum("_rows").alias("_rows"))
    place = F.col("_hits.pos")
    merged = merged.withColumns(
        {
            "start": F.array_min(place).cast("long"),
            "end": (F.array_max(place) + F.when(F.col("is_phrase"), 2).otherwise(K)).cast("long"),
            "cover": F.when(F.col("is_phrase"), 1.0).when(F.col("tpl").isNotNull(), longest_chain(F.col("_hits")) / F.col("grams")),
        }
    )
    return merged.where(F.col("tpl").isNull() | (F.col("cover") >= COVER)).drop("_run", "_part", "_hits", "grams")


SPAN = "struct<cover:double,words:bigint,label:string,start:bigint,end:bigint>"


def overlapping(found: Column) -> Column:
    """Spans in groups that no span leaves: in order of their starts, a span that begins at or behind all ends before it opens one."""
    begin = F.struct(F.lit(0).cast("long").alias("till"), F.array().cast(f"array<{SPAN}>").alias("open"), F.array().cast(f"array<array<{SPAN}>>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["till"]
        return F.struct(
            F.greatest(s["till"], x["end"]).alias("till"),
            F.when(fresh, F.array(x)).otherwise(F.concat(s["open"], F.array(x))).alias("open"),
            F.when(fresh & (F.size(s["open"]) > 0), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
        )

    placed = F.transform(found, lambda x: F.struct(x["start"].alias("at"), x.alias("x")))
    ordered = F.transform(F.array_sort(placed, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)), lambda p: p["x"])
    return F.aggregate(ordered, begin, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def best_of_overlapping(found: Column) -> Column:
    """Of (cover, words, label, start, end) spans, those that no overlapping one beats: a greater share, then more words. Only spans of a
    group of overlapping ones are compared with one another, so notices in a row cost no more than each by itself."""
    beats = lambda o, s: (o["start"] < s["end"]) & (s["start"] < o["end"]) & (F.struct(o["cover"], o["words"], o["label"]) > F.struct(s["cover"], s["words"], s["label"]))
    return F.flatten(F.transform(overlapping(found), lambda group: F.filter(group, lambda s: ~F.exists(group, lambda o: beats(o, s)))))


def license_scan(docs: DataFrame) -> DataFrame:
    found = spans(docs.select("doc_id", "text"))
    base, span = F.col("is_phrase"), F.struct("cover", (F.col("end") - F.col("start")).alias("words"), "label", "start", "end")
    out = found.groupBy("_id", "_h1", "_h2", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("_base"),
        F.collect_list(F.when(~base, span)).alias("_spans"),
        F.sum("_rows").cast("int").alias("_rows"),
    )
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    out = out.withColumn("_spans", best_of_overlapping(F.col("_spans")))
    phrase = F.when(F.size("_base") > 0, 1.0).otherwise(0.0)
    out = out.withColumns({"base_labels": named(F.col("_base")), "labels": named(F.concat("_base", "_spans.label")), "score": F.greatest(phrase, F.coalesce(F.array_max("_spans.cover"), F.lit(0.0)))})
    out = out.withColumn("_again", F.explode(F.array_repeat(F.lit(1), F.col("_rows"))))
    return out.select(F.col("_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


#: The contract's base columns.
SQL = r"""
with d as (select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
p as (select * from (values (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) p(ph, label)),
place as (select rid, i - 1 pos, label from (select rid, w, unnest(generate_series(1, len(w))) i from d) x, p where w[i] = ph[1] and w[i:i + len(ph) - 1] = ph)
select any_value(doc_id) doc_id, any_value(len(w))::bigint n_words, count(label) n_base, min(pos) first_word, max(pos) last_word, coalesce(string_agg(distinct label, ',' order by label), '') base_labels
from d left join place using (rid) group by rid
"""
