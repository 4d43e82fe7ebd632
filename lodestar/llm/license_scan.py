"""License scans by diagonal voting.

Rolling word k-grams of every document meet the grams of license templates in a Spark join; each meeting votes
for the diagonal (document place minus template place). Votes are summed by diagonal, neighbouring diagonals are
merged, so that an inserted or lost word doesn't break a match, and spans are verified by the share of the template
that they cover; of overlapping matches the best stays. A base phrase is a template whose diagonal must have every vote.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._cluster import Tables

# Phrases whose words must stand consecutively, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_WARRANTY = "in no event shall the {who} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_AS_IS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {kind} public license as published by the free software foundation either version {n} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {kind} public license for more details"
# Texts and notices of well-known public licenses, by label.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-terms": "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "gpl": _GNU.format(kind="general", n=3),
    "lgpl": _GNU.format(kind="lesser general", n=3).replace("this program", "this library"),
    "agpl": _GNU.format(kind="affero general", n=3),
    "bsd-2-clause": _BSD + _AS_IS + _WARRANTY.format(who="copyright holder or contributors"),
    "bsd-3-clause": _BSD + "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _AS_IS + _WARRANTY.format(who="copyright holder or contributors"),
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "epl": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented",
    "boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
    "cc": "this work is licensed under a creative commons attribution",
    "cc0": "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}
#: Words of a gram in notices; base phrases use two.
NOTICE_GRAM = 4
#: Diagonals at most so far apart are neighbours.
BAND = 4
#: A match's diagonals lie at most so far apart, so that a chain of neighbours can't drift away from its template.
DRIFT = 24
#: Least share of a notice's grams for a label.
COVER = 0.5


def _templates(base: dict[str, str], notices: dict[str, str]):
    """(template, kind, label, grams needed, k) and the gram rows (k, gram, text, template, place)."""
    heads, grams = [], []
    for kind, of, k in (("base", base, 2), ("notice", notices, NOTICE_GRAM)):
        for text, label in of.items() if kind == "base" else ((t, n) for n, t in of.items()):
            words = text.split()
            k_ = min(k, len(words))
            (_, _, w), *_ = K.hashed(pa.array([text]), K.SYMBOLS, True)
            h, whole = w.grams(k_)
            number = len(heads)
            heads.append((number, kind, label, int(whole.sum())))
            grams += [(k_, int(K.signed(h)[p]), " ".join(words[p : p + k_]), number, int(p)) for p in np.flatnonzero(whole)]
    return heads, grams


def _meetings(grams):
    """Words of each document (place -1) and the places whose gram some template has."""
    by_k = {k: np.unique(np.array([g[1] for g in grams if g[0] == k], dtype=np.int64).view(K.U)) for k in {g[0] for g in grams}}

    def run(batches):
        tables = {}
        for k, wanted in by_k.items():
            tables[k] = np.zeros(1 << 16, dtype=bool)
            tables[k][(wanted & K.U(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            rows, ids, text = batch.columns
            for i, j, w in K.hashed(text, K.SYMBOLS, True):
                doc = np.repeat(np.arange(i, j), w.counts)
                out = [(np.arange(i, j), np.full(j - i, -1), np.zeros(j - i, np.int64), [None] * (j - i), w.counts)]
                for k, wanted in by_k.items():
                    h, whole = w.grams(k)
                    at = np.flatnonzero(tables[k][(h & K.U(0xFFFF)).astype(np.int64)] & whole)
                    at = at[np.isin(h[at], wanted)]
                    said = [b" ".join(w.data[w.starts[p + x] : w.ends[p + x]].tobytes() for x in range(k)).decode("utf-8", "replace") for p in at]
                    out.append((doc[at], at - w.bounds[doc[at] - i], K.signed(h[at]), said, w.counts[doc[at] - i]))
                at, place, gram, said, n = zip(*out)
                at = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([rows.take(at), ids.take(at), pa.array(np.concatenate(place), pa.int64()), pa.array(np.concatenate(gram), pa.int64()), pa.array([x for part in said for x in part], pa.string()), pa.array(np.concatenate(n), pa.int64())], names=["row", "id", "place", "gram", "said", "n_words"])

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None, spans: bool = False):
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score; with spans, also the matches.

    A-Z become a-z; words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; null texts have none. n_base counts every place where a base
    phrase's words stand consecutively; first_word and last_word are the least and greatest such place. labels adds
    notices of which at least COVER is there and of which no overlapping one covers more. score is 1 with a base label, else the greatest share of a notice.
    Rows that repeat an id are judged each by itself; null ids are kept; other columns are ignored; an empty table
    gives an empty result. Templates are parameters held by the driver; only places that meet one are shuffled.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "license")
    heads, grams = _templates(BASE if base is None else base, NOTICES if notices is None else notices)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"row long, id {docs.schema[id_col].dataType.simpleString()}, place long, gram long, said string, n_words long"
    met = tables("meetings", rows.mapInArrow(_meetings(grams), schema))

    places = spark.createDataFrame([g[1:] for g in grams], "gram long, phrase string, template int, spot long")
    head = spark.createDataFrame(heads, "template int, kind string, label string, needed long")
    votes = met.where("place >= 0").join(F.broadcast(places), "gram").where("said = phrase")
    diagonals = votes.groupBy("row", "template", (F.col("place") - F.col("spot")).alias("diagonal")).agg(F.collect_set("spot").alias("spots"), F.min("place").alias("first"), F.max("place").alias("last"))
    diagonals = diagonals.join(F.broadcast(head), "template")

    exact = diagonals.where("kind = 'base' AND size(spots) = needed").select("row", "template", "label", F.col("diagonal").alias("start"))
    of = F.array_sort(F.collect_list(F.struct("diagonal", "first", "last", "spots")))
    # diagonals in order: one joins the match before it if it is its neighbour and the match stays narrow
    fresh = lambda x: F.struct(x["diagonal"].alias("low"), x["diagonal"].alias("high"), x["first"].alias("start"), x["last"].alias("end"), x["spots"].alias("spots"))
    joins = lambda m, x: (x["diagonal"] - m["high"] <= BAND) & (x["diagonal"] - m["low"] <= DRIFT)
    grown = lambda m, x: F.struct(m["low"].alias("low"), x["diagonal"].alias("high"), F.least(m["start"], x["first"]).alias("start"), F.greatest(m["end"], x["last"]).alias("end"), F.array_union(m["spots"], x["spots"]).alias("spots"))
    step = lambda acc, x: F.when((F.size(acc) > 0) & joins(F.try_element_at(acc, F.lit(-1)), x), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown(F.try_element_at(acc, F.lit(-1)), x)))).otherwise(F.concat(acc, F.array(fresh(x))))
    none = F.array().cast("array<struct<low:bigint,high:bigint,start:bigint,end:bigint,spots:array<bigint>>>")
    loose = diagonals.where("kind = 'notice'").groupBy("row", "template", "label", "needed").agg(of.alias("of"))
    loose = loose.select("row", "template", "label", "needed", F.explode(F.aggregate("of", none, step)).alias("m"))
    loose = loose.select("row", "template", "label", "m.start", "m.end", (F.size("m.spots") / F.col("needed")).alias("share"), F.size("m.spots").alias("n"))
    # licenses share sentences: of matches that overlap, the one that covers most of its template stays, then the longer one
    cover = loose.where(F.col("share") >= COVER)
    rivals = cover.groupBy("row").agg(F.collect_list(F.struct("share", "n", "label", "start", "end")).alias("rivals"))
    beats = lambda r: (r["start"] <= F.col("end")) & (r["end"] >= F.col("start")) & (F.struct(r["share"], r["n"], r["label"]) > F.struct("share", "n", "label"))
    cover = cover.join(rivals, "row").where(~F.exists("rivals", beats)).drop("rivals")

    b = exact.groupBy("row").agg(F.count(F.lit(1)).alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"), F.array_sort(F.collect_set("label")).alias("base"))
    m = loose.groupBy("row").agg(F.max("share").alias("share")).join(cover.groupBy("row").agg(F.collect_set("label").alias("found")), "row", "left")
    none = F.array().cast("array<string>")
    out = met.where("place = -1").select("row", "id", "n_words").join(b, "row", "left").join(m, "row", "left")
    own = F.coalesce("base", none)
    out = out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.array_join(own, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(own, F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size(own) > 0, 1.0).otherwise(F.least(F.coalesce(F.col("share"), F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
    if not spans:
        return out
    found = exact.select("row", "label", "start", F.lit(1.0).alias("share")).unionByName(cover.select("row", "label", "start", "share"))
    return out, met.where("place = -1").select("row", F.col("id").alias(id_col)).join(found, "row").drop("row")
