"""Licence scan with a positional rare-token index, in SQL functions only.

Base: places where a named phrase's words stand one after another. The method
adds labels from licence notices: the words of TEMPLATES without function words
form an index (word, template, position). A template stands at a shift if the share
of its indexed words that stand at their places there is MIN_SCORE or more. Then
at least one of its total - ceil(MIN_SCORE * total) + 1 rarest words stands in
place, so only these are looked up: words are ranked by their IDF over the files
that hold licence words, and the postings of a template's rarest ones, met with the
file's positions, give all (template, shift) that can reach the score. There all
words of the template are looked up at their places. If the score is reached and
the template's mandatory key phrases stand in the file word for word, the file gets
its label, however many other notices it holds. No shift that counts is lost.

Words are runs of a-z, 0-9 and all characters from U+0080 on, A-Z lower-cased.
Defined cases: null text is empty, with 0 words, no labels ('') and null places;
repeated rows are scanned each; an empty table gives an empty result.

Scale: the text is read once, row by row, into a slim table: counts, places, and
positions of licence words for files that hold two different ones at least. Only
hits are shuffled (by row, template and shift), and labels return by the row's
number. The index and its rare part are broadcast; they are as small as TEMPLATES.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.llm.util import load, lower_ascii, written

#: Base phrases and labels (fixed values).
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Licence notices: label, words, mandatory key phrases (fixed values).
TEMPLATES = [
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["distribute this software for any purpose with or without fee"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ["permission is hereby granted free of charge", "associated documentation files"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]
#: Function words, which the index leaves out.
STOP = set("a and any are as at by for in is it of or that the this to under with you met use".split())
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_SCORE = 0.5
INDEX = [(w, label, i) for label, text, _ in TEMPLATES for i, w in enumerate(text.split()) if w not in STOP]
VOCABULARY = sorted({w for w, _, _ in INDEX})
KEYS = sorted({k for _, _, keys in TEMPLATES for k in keys})


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _starts(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase begins."""
    parts = phrase.split()
    here = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), here)


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: rid (a number of its own), n_words, base places, licence words with positions, key phrases."""
    flat = F.trim(F.regexp_replace(lower_ascii(F.coalesce(F.col(text), F.lit(""))), SEPARATORS, " "))
    rows = docs.select(F.col(doc_id).alias("doc_id"), flat.alias("flat"))
    rows = rows.select("doc_id", F.concat(F.lit(" "), "flat", F.lit(" ")).alias("flat"),
                       F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " ")).alias("words"))
    rows = rows.withColumn("licence", F.array_intersect("words", _strings(VOCABULARY)))
    none = F.array().cast("array<int>")
    places = [F.when(F.contains("flat", F.lit(f" {p} ")), _starts(F.col("words"), p)).otherwise(none).alias(label) for p, label in BASE]
    several = F.size("licence") > 1
    held = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: F.array_contains("licence", x["word"]))
    keys = F.filter(_strings(KEYS), lambda k: F.contains(F.col("flat"), F.concat(F.lit(" "), k, F.lit(" "))))
    return written(rows.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").cast("long").alias("n_words"), F.struct(*places).alias("base"),
        F.when(several, F.col("licence")).alias("licence"), F.when(several, held).alias("held"), F.when(several, keys).alias("keys")), "licence-words")


def rarest(slim: DataFrame) -> DataFrame:
    """(word, template, at): of each template the rarest indexed words one of which every counting shift must hold.

    IDF from the files with two different licence words at least; ties go by word and place. As small as TEMPLATES."""
    spark = slim.sparkSession
    files = slim.where("licence is not null")
    df = files.select(F.explode("licence").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    index = spark.createDataFrame(INDEX, "word string, template string, at int")
    ranked = index.join(F.broadcast(df), "word", "left").na.fill(0, ["df"]).join(F.broadcast(files.agg(F.count("*").alias("n"))), F.lit(True))
    mine = Window.partitionBy("template")
    ranked = ranked.withColumn("rank", F.row_number().over(mine.orderBy(idf.desc(), "word", "at"))).withColumn("total", F.count("*").over(mine))
    return ranked.where(F.col("rank") <= F.col("total") - F.ceil(F.col("total") * MIN_SCORE) + 1).select("word", "template", "at")


def template_labels(slim: DataFrame) -> DataFrame:
    """(rid, labels, score) of the documents that match a template."""
    spark = slim.sparkSession
    total = {label: sum(x == label for _, x, _ in INDEX) for label, _, _ in TEMPLATES}
    # bounded by TEMPLATES
    index = F.broadcast(spark.createDataFrame(INDEX, "word string, template string, at int"))
    weights = spark.createDataFrame([(label, total[label], keys) for label, _, keys in TEMPLATES], "template string, total int, must array<string>")
    held = slim.where("held is not null").select("rid", F.explode("held").alias("h")).select("rid", F.col("h.word").alias("word"), F.col("h.pos").alias("pos"))
    may = held.join(F.broadcast(rarest(slim)), "word").select("rid", "template", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    # a template whose key phrases are not in the file gives no label
    keyed = slim.where("held is not null").select("rid", "keys").join(F.broadcast(weights), F.size(F.array_except("must", "keys")) == 0) \
        .select("rid", "template", "total")
    may = may.join(keyed, ["rid", "template"])
    due = may.join(index, "template").select("rid", "template", "shift", "total", "word", (F.col("shift") + F.col("at")).alias("pos"))
    shifts = due.join(held, ["rid", "word", "pos"]).groupBy("rid", "template", "shift", "total").agg(F.count("*").alias("hits"))
    score = F.col("hits") / F.col("total")
    return shifts.where(score >= MIN_SCORE).groupBy("rid").agg(F.collect_set("template").alias("labels"), F.max(score).alias("score"))


def licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, places, base_labels, method_labels, score); places: word numbers of all base phrases."""
    slim = scanned(docs, doc_id, text)
    base = F.filter(F.array(*[F.when(F.size(F.col(f"base.`{label}`")) > 0, F.lit(label)) for _, label in BASE]), lambda x: x.isNotNull())
    places = F.flatten(F.array(*[F.col(f"base.`{label}`") for _, label in BASE]))
    none = F.array().cast("array<string>")
    return slim.join(template_labels(slim), "rid", "left").select(
        "doc_id", "n_words", places.alias("places"), base.alias("base_labels"),
        F.coalesce("labels", none).alias("method_labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: base places and all labels of every document."""
    found = licences(load(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"),
                        F.array_max("places").cast("long").alias("last_word"), joined(F.col("base_labels")).alias("base_labels"),
                        joined(F.concat("base_labels", "method_labels")).alias("labels"), F.round("score", 6).alias("score"))


def _oracle() -> str:
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    rows = lambda xs: ", ".join(xs)
    return rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
phrases(phrase, label) AS (VALUES {rows(f"(['{"', '".join(p.split())}'], '{label}')" for p, label in BASE)}),
pos AS (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM w),
base AS (SELECT rid, i - 1 AS place, label FROM pos JOIN phrases ON words[i] = phrase[1] AND words[i:i + len(phrase) - 1] = phrase),
b AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS ls FROM base GROUP BY rid),
idx(word, template, place) AS (VALUES {rows(f"('{w}', '{t}', {i})" for w, t, i in INDEX)}),
tot AS (SELECT template, count(*) AS total FROM idx GROUP BY template),
must(template, phrase) AS (VALUES {rows(f"('{t}', ['{"', '".join(k.split())}'])" for t, _, ks in TEMPLATES for k in ks)}),
hit AS (SELECT rid, i, words[i] AS word FROM pos WHERE words[i] IN ({quoted(VOCABULARY)})),
few AS (SELECT rid FROM hit GROUP BY rid HAVING count(DISTINCT word) > 1),
held AS (SELECT hit.* FROM hit JOIN few ON few.rid = hit.rid),
shifts AS (
  SELECT held.rid, template, i - place AS shift, count(DISTINCT place) AS hits
  FROM held JOIN idx ON idx.word = held.word GROUP BY 1, 2, 3),
keyed AS (
  SELECT rid, m.template FROM must AS m JOIN pos ON words[i] = phrase[1] AND words[i:i + len(phrase) - 1] = phrase
  GROUP BY rid, m.template HAVING count(DISTINCT phrase) = (SELECT count(*) FROM must x WHERE x.template = m.template)),
m AS (
  SELECT s.rid, list(DISTINCT s.template) AS ls, max(hits / total) AS score
  FROM shifts s JOIN tot ON tot.template = s.template JOIN keyed ON keyed.rid = s.rid AND keyed.template = s.template
  WHERE hits / total >= {MIN_SCORE} GROUP BY s.rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(m.ls, [])))), ',') AS labels, round(coalesce(score, 0.0), 6)::DOUBLE AS score
FROM w LEFT JOIN b ON b.rid = w.rid LEFT JOIN m ON m.rid = w.rid
"""


ORACLE_SQL = _oracle()
