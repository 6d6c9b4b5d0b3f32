"""License scans by a positional index of rare tokens, in DataFrame functions only.

The index holds the words of the notices below with their places. The licence words are ranked
by their rarity in the corpus (inverse document frequency over all files), and of each notice so many
of the rarest are looked up, with all their places in the file, that wherever the notice holds AGREE of
them stand, whichever words it lacks. A notice's place in the file follows from each hit: file place
less notice place. Words that were put in or left out move a notice's other words, so a word counts
within DRIFT places of its own. Where at least AGREE hits give places so near each other for the same
notice, the notice is a candidate at all places near them; it counts where its key phrase stands word by
word and at least COVERED of its words stand about where they should. No notice that holds is left out, however many others the file has.

Base phrases are counted beside that, wherever their words stand consecutively. All steps are
expressions on one row, so nothing is shuffled but the word frequencies, at most one row a
licence word and task. Words are runs of digits, letters and characters beyond ASCII; only A-Z is
lower-cased for what counts: no other character lower-cases to a letter of a phrase or to a separator.

Several notices at one place all count, so there are no ties; an empty table stays empty.
Null and empty texts have no words: counts 0, places null, labels empty, score 0. Long texts are
scanned whole. Words are lower-cased for notices as for base phrases. Repeated rows give equal rows. Other columns are kept, those named like a new one are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import id_text, table

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, notice, key phrase.
NOTICES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("cc0-1.0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "copyright and related and neighboring rights"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "to alter it and redistribute it freely"),
    ("bsl-1.0", "boost software license version 1 0", "boost software license"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "shall be included in all copies or substantial portions of the software"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "governing permissions and limitations under the license"),
)
#: Words of notices that say nothing of licences.
COMMON = (
    "a", "all", "an", "and", "any", "are", "as", "be", "but", "by", "can", "code", "for", "form", "forms", "from", "held", "in", "into", "is", "it", "its", "kind", "made", "may", "name", "names", "no", "of", "on", "or", "person", "published",
    "see", "source", "subject", "terms", "that", "the", "this", "to", "under", "use", "used", "will", "with", "without", "work", "you", "0", "1", "2", "3", "4",
)
AGREE, COVERED, DRIFT = 2, 0.8, 3
UPPER = string.ascii_uppercase

#: What separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A candidate is one number: notice * SPAN + place + BEFORE.
SPAN, BEFORE = 1 << 40, 1 << 20


def vocabulary() -> list[str]:
    """The licence words: those of notices that are not COMMON."""
    return sorted({w for _, notice, _ in NOTICES for w in notice.split()} - set(COMMON))


def lowered(text: Column) -> Column:
    """A-Z as a-z; other characters, which may lower-case to one of these, stay."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    return F.filter(F.split(lowered(text), SEPARATORS), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.expr("cast(array() as array<string>)")


def _let(value: Column, body) -> Column:
    """body of the value, which is then computed once a row, also where body uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _phrase_places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively."""
    first, *rest = phrase.split()

    def place(w: Column, i: Column) -> Column:
        here = w == first
        for k, other in enumerate(rest, 1):
            here = here & (F.get(words, i + k) == other)
        return F.when(here, i)

    return F.filter(F.transform(words, place), lambda i: i.isNotNull())


def word_rarity(files: DataFrame) -> dict[str, float]:
    """The inverse document frequency of the licence words in files (words array), over all rows."""
    found = files.select(F.array_intersect("words", _strings(vocabulary())).alias("w"))
    counts = found.select(F.explode(F.concat(F.array(F.lit("")), "w")).alias("w")).groupBy("w").count()  # the empty word counts rows
    df = {r["w"]: r["count"] for r in counts.collect()}  # a row for each licence word at most
    n = df.pop("", 0)
    return {w: float(n + 1) / (1 + df.get(w, 0)) for w in vocabulary()}


def looked_up(rarity: dict[str, float]) -> list[str]:
    """Of each notice the fewest of its rarest words of which AGREE places stand wherever the notice holds."""
    every: set[str] = set()
    for _, notice, key in NOTICES:
        words = notice.split()
        start = len(notice[: notice.index(key)].split())
        in_key = range(start, start + len(key.split()))  # these places always stand
        lacking = max(m for m in range(len(words)) if (len(words) - m) / len(words) >= COVERED)
        chosen: set[str] = set()
        for word in sorted(set(words) - set(COMMON), key=lambda w: (-rarity[w], w)):
            chosen.add(word)
            places = [q for q, w in enumerate(words) if w in chosen]
            sure = sum(q in in_key for q in places)
            if sure + max(0, len(places) - sure - lacking) >= AGREE:
                break
        else:
            raise ValueError(f"too few licence words in the notice: {notice}")
        every |= chosen
    return sorted(every)


def _candidates(words: Column, chosen: list[str]) -> Column:
    """Places near which at least AGREE hits of the chosen licence words put the same notice, as numbers."""
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(chosen))
    postings = {w: [(t, q) for t, (_, notice, _) in enumerate(NOTICES) for q, x in enumerate(notice.split()) if x == w] for w in chosen}
    index = F.create_map(*(x for w, places in postings.items() for x in (F.lit(w), F.array(*(F.lit(t * SPAN + BEFORE - q).cast("long") for t, q in places)))))
    numbers = F.array_sort(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h["w"]), lambda p: p + h["i"]))))
    # Two words of a notice may have moved DRIFT places to either side of it.
    agreed = _let(numbers, lambda all_: F.array_distinct(F.filter(all_, lambda x, i: x - F.get(all_, i - (AGREE - 1)) <= 2 * DRIFT)))
    return F.array_distinct(F.flatten(F.transform(agreed, lambda x: F.transform(F.sequence(F.lit(-DRIFT), F.lit(DRIFT)), lambda d: x + d))))


def _matches(words: Column, candidates: Column) -> Column:
    """Label and coverage of the candidates that hold."""
    notices = F.array(*(F.struct(F.lit(label).alias("label"), _strings(notice.split()).alias("words"), _strings(key.split()).alias("key"), F.lit(len(notice[: notice.index(key)].split())).alias("at")) for label, notice, key in NOTICES))

    def match(c: Column) -> Column:
        notice = F.get(notices, F.floor(c / SPAN).cast("int"))
        place = (F.pmod(c, F.lit(SPAN)) - BEFORE).cast("int")
        from_key = place + notice["at"]
        stands = F.when(from_key >= 0, F.slice(words, from_key + 1, F.size(notice["key"])) == notice["key"]).otherwise(False)

        def about(w: Column, j: Column) -> Column:
            first = F.greatest(place + j - DRIFT, F.lit(0))
            return F.coalesce(F.array_contains(F.slice(words, first + 1, F.greatest(place + j + DRIFT + 1 - first, F.lit(0))), w), F.lit(False))

        covered = F.size(F.filter(F.transform(notice["words"], about), lambda x: x)) / F.size(notice["words"])
        return F.when(F.when(stands, covered >= COVERED).otherwise(False), F.struct(notice["label"].alias("label"), covered.alias("covered")))

    return F.filter(F.transform(candidates, match), lambda m: m.isNotNull())


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    names = [c for c in docs.columns if c not in new]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chosen = looked_up(word_rarity(docs.select(words_of(text).alias("words"))))
    files = docs.select(*names, text.alias("__text")).withColumn("__words", words_of(F.col("__text")))
    # Rows without a phrase's or notice's words skip the work on places.
    none = F.expr("cast(array() as array<int>)")
    lower = lowered(F.col("__text"))
    places = [F.when(lower.contains(phrase.split()[-1]), _phrase_places(F.col("__words"), phrase)).otherwise(none) for phrase, _ in BASE]
    has = F.arrays_overlap("__words", _strings(chosen))
    no_match = F.expr("cast(array() as array<struct<label: string, covered: double>>)")
    files = files.select(*names, "__words", *(p.alias(f"__base{i}") for i, p in enumerate(places)), F.when(has, _candidates(F.col("__words"), chosen)).alias("__candidates"))
    files = files.withColumn("__matches", F.when(F.size("__candidates") > 0, _matches(F.col("__words"), F.col("__candidates"))).otherwise(no_match))
    every = F.concat(*(f"__base{i}" for i in range(len(BASE))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"__base{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE))))
    files = files.select(*names, F.size("__words").cast("long").alias("n_words"), every.alias("__every"), labels.alias("__labels"), "__matches")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.array_max(F.transform("__matches", lambda m: m["covered"]))
    return files.select(
        *names,
        "n_words",
        F.size("__every").cast("long").alias("n_base"),
        F.array_min("__every").cast("long").alias("first_word"),
        F.array_max("__every").cast("long").alias("last_word"),
        joined(F.col("__labels")).alias("base_labels"),
        joined(F.concat("__labels", F.transform("__matches", lambda m: m["label"]))).alias("labels"),
        F.coalesce(best, F.when(F.size("__labels") > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and notices in every document."""
    return scan(id_text(table(spark, sf_dir, "documents"))).drop("text")


def _oracle() -> str:
    """The rows of op2_license_scan in DuckDB SQL: every place where a notice's key phrase stands, without an index."""
    texts = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)
    return f"""with letters as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as upper_case),
  files as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), upper_case, lower(upper_case)), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents, letters),
  phrases as (select label, string_split(phrase, ' ') as phrase from (values {texts(BASE)}) x(phrase, label)),
  notices as (select label, string_split(notice, ' ') as notice, string_split(key, ' ') as key, len(string_split(notice[:strpos(notice, key) - 1], ' ')) - 1 as ahead from (values {texts(NOTICES)}) x(label, notice, key)),
  places as (select rid, words, w, i - 1 as i from (select rid, words, unnest(words) as w, generate_subscripts(words, 1) as i from files)),
  base as (select rid, label, i from places join phrases on w = phrase[1] where words[i + 1 : i + len(phrase)] = phrase),
  keyed as (select rid, label, notice, words, i - ahead as place from places join notices on w = key[1] where words[i + 1 : i + len(key)] = key),
  held as (select rid, label, len(list_filter(range(len(notice)), lambda j: place + j + {DRIFT} >= 0 and coalesce(list_contains(words[greatest(place + j - {DRIFT}, 0) + 1 : place + j + {DRIFT} + 1], notice[j + 1]), false))) / len(notice) as covered from keyed),
  counted as (select rid, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by 1),
  labelled as (select rid, string_agg(distinct label, ',' order by label) as labels, max(covered) as covered from (select rid, label, null as covered from base union all select rid, label, covered from held where covered >= {COVERED}) group by 1)
  select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
    coalesce(covered, case when n_base > 0 then 0.5 else 0 end)::double as score from files left join counted using (rid) left join labelled using (rid)"""


ORACLE_SQL = _oracle()
