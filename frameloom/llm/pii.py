"""PII: personal data by pattern, and terms that give it away by corpus co-occurrence.

Four kinds of values are found by pattern (email, ip, card, phone). They are the protected
entities. A term in a text with such a value, wherever it stands, reveals it as far as knowing the term makes the value more
likely: with N the sum of the rows that each entity has, of which c are those of the entity e, the share of the
information -log(c/N) that the term t gives is

    disclosure(t, e) = log(P(e | t) / P(e)) / -log P(e),

1 if the term occurs with that value only, 0 if it tells nothing. P(e | t) is the number of
rows with t and e over the number of rows with t in the whole corpus; both count rows, so copies
cancel. A term is removed from REMOVE on, generalised from GENERALISE on, at all its places in all
texts, also those without the value, but for words within values; the strongest disclosure counts. It needs SUPPORT
distinct texts, so copies of one document, and words that occur once, don't count as evidence, while
a line that different documents share does.

Offsets are code points, ends exclusive. Matches of a kind are leftmost and don't overlap; one that
fails its check is dropped, without retries. Null and empty texts have no spans. Texts are read
whole. Repeated rows get the same spans each; rows are told apart
by document id and text hash. Of overlapping spans the first, and of those that start together the
longest, takes the place of all. An empty table has no spans. Other columns are carried by sanitise() and
ignored by find_pii(), whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import CACHE_ENTRIES, id_text, keep, open_fs, shared_dir, small_batches, table

#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+); a match can only start where a run of digits does, so long runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

#: The least letters of a term.
TERM_LETTERS = 3
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
WORD = re.compile(r"[^\W\d_]{%d,}" % TERM_LETTERS)
#: Slots of a worker's table of hashes. It is of this size for any number of them; what shares a slot by chance goes when counts are joined.
SLOTS = 1 << 24
#: A slot has the logarithm of a count, in STEP parts of a power of two; 0 is free.
STEP, MOST = 8, 250
#: What takes a span's place in the text; a term's class may say more.
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The four kinds in order, each by start."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", *m.span()) for m in _emails(text)]
    if "." in text:
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return found


#: The characters before an at sign, read backwards.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")


def _emails(text: str) -> Iterator[re.Match]:
    """The matches of EMAIL, tried only where an at sign follows; a run of local characters is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.fullmatch(text, max(done, start - 64), start):
            start = max(done, start - 64)
        low = max(done, start - 64)
        run = len(_LOCAL.match(text[low:start][::-1]).group()) if start > low else 0
        m = EMAIL.match(text, start - run) if start - run < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _join(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def terms_outside(text: str, taken: list[Span]) -> Iterator[re.Match]:
    """The words of a text that no span overlaps."""
    spans, k, reach = sorted((s, e) for _, s, e in taken), 0, 0
    for m in WORD.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= m.start():
            yield m


@lru_cache(maxsize=3)
def _slots(uri: str) -> np.ndarray:
    """The largest code of the hashes of each slot, from a stored table (hash, code)."""
    filesystem, path = open_fs(uri)
    table = np.zeros(SLOTS, np.uint8)
    for batch in pyarrow.dataset.dataset(path, filesystem=filesystem, format="parquet").to_batches(columns=["hash", "code"]):
        h, code = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        np.maximum.at(table, h & (SLOTS - 1), code.astype(np.uint8))
    return table


def _term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def find_base(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, text_hash) as (doc_id, text_hash, base, entities, terms); terms: the distinct ones of a text with entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, text_hash in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = base_spans(text)
                entities = {_term_hash(f"{kind}:{text[start:end].lower()}") for kind, start, end in spans}
                terms = {m.group().lower() for m in terms_outside(text, spans)} if spans else ()
                rows.append({"doc_id": doc_id, "text_hash": text_hash, "base": [{"kind": k, "start": s, "end": e} for k, s, e in spans], "entities": list(entities), "terms": [_term_hash(t) for t in terms]})
            yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)

    return docs.mapInArrow(run, "doc_id long, text_hash long, base array<struct<kind string, start int, end int>>, entities array<long>, terms array<long>")


_FOUND = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("base", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("entities", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64()))])


def document_counts(texts: DataFrame) -> DataFrame:
    """In how many rows each term occurs, over whole texts: term, df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            h = np.fromiter(map(_term_hash, counts), np.int64, len(counts))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["term", "df"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                counts.update({w.lower() for w in set(WORD.findall(text))})
            if len(counts) > 700_000:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return texts.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _pairs(found: DataFrame, entities_uri: str, terms_uri: str) -> DataFrame:
    """Rows' pairs (entity, term, text_hash) of which the counts allow a disclosure of GENERALISE, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, rarity = _slots(entities_uri), _slots(terms_uri)
        for batch in batches:
            for text_hash, entities, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = np.array(terms, np.int64)
                code = rarity[t & (SLOTS - 1)].astype(np.int64)
                t, size = t[code > 0], MOST - code[code > 0]
                for e in entities:
                    near = t[size < int(reach[e & (SLOTS - 1)])]
                    if len(near):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), e)), pa.array(near), pa.array(np.full(len(near), text_hash))], names=["entity", "term", "text_hash"])

    return found.where(F.size("terms") > 0).select("text_hash", "entities", "terms").mapInArrow(run, "entity long, term long, text_hash long")


def disclosures(found: DataFrame, docs: DataFrame, uri: str, support: int = SUPPORT) -> DataFrame:
    """Terms that reveal a value, from the least threshold on, with the largest disclosure: term, disclosure."""
    # Rows of a text first: copies count as rows, but are one piece of evidence.
    of_text = found.select("text_hash", F.explode("entities").alias("entity")).groupBy("entity", "text_hash").agg(F.count("*").alias("n"))
    every = keep(of_text.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts")), f"{uri}/entities")
    total = float(every.agg(F.sum("n_entity")).first()[0] or 0)
    # P(e | t) is at most c / df, so a disclosure of GENERALISE needs df <= c * (N / c) ** (1 - GENERALISE).
    n = F.col("n_entity")
    step = lambda c: F.floor(F.log2(c) * STEP + 1e-6)
    most = n * F.pow(F.lit(total) / n, F.lit(1 - GENERALISE))
    able = every.where((F.col("texts") >= support) & (n < total)).select(F.col("entity").alias("hash"), "n_entity", most.alias("most"))
    able = keep(able.withColumn("code", F.least(F.lit(255), 1 + step(F.col("most"))).cast("int")), f"{uri}/able")
    highest = able.agg(F.max("most")).first()[0]
    if highest is None:
        return able.select(F.col("hash").alias("term"), F.lit(0.0).alias("disclosure")).limit(0)
    counts = document_counts(docs).where((F.col("df") >= support) & (F.col("df") <= highest + 1))
    counts = keep(counts.select(F.col("term").alias("hash"), "df", F.greatest(F.lit(1), MOST - step(F.col("df"))).cast("int").alias("code")), f"{uri}/counts")
    near = _pairs(found, f"{uri}/able", f"{uri}/counts").groupBy("entity", "term", "text_hash").agg(F.count("*").alias("n"))
    both_in = near.groupBy("entity", "term").agg(F.sum("n").alias("joint"), F.count("*").alias("texts"))
    joint = keep(both_in.where(F.col("texts") >= support).drop("texts"), f"{uri}/joint")
    both = joint.join(counts.select(F.col("hash").alias("term"), "df"), "term").join(able.select(F.col("hash").alias("entity"), "n_entity"), "entity")
    p_entity = F.col("n_entity") / F.lit(total)
    score = F.log(F.col("joint") / F.col("df") / p_entity) / -F.log(p_entity)
    return both.select("term", score.alias("disclosure")).where(F.col("disclosure") >= GENERALISE).groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def places(docs: DataFrame, terms_uri: str) -> DataFrame:
    """All places of the stored terms in docs (doc_id, text, text_hash), and of few others: doc_id, text_hash, term, start, end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _slots(terms_uri)
        known: dict[str, bool] = {}
        for batch in batches:
            rows = []
            for doc_id, text, text_hash in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = set(WORD.findall(text))
                for w in words:
                    if w not in known:
                        known[w] = bool(table[_term_hash(w.lower()) & (SLOTS - 1)])
                if any(map(known.__getitem__, words)):
                    found = ((m, _term_hash(m.group().lower())) for m in terms_outside(text, base_spans(text)) if known[m.group()])
                    rows += [{"doc_id": doc_id, "text_hash": text_hash, "term": t, "start": m.start(), "end": m.end()} for m, t in found]
                if len(known) > CACHE_ENTRIES:
                    known.clear()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_PLACES)

    return docs.mapInArrow(run, "doc_id long, text_hash long, term long, start int, end int")


_PLACES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def find_pii(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text_hash, base and terms, arrays of (kind, start, end).

    A term's kind is ``removed`` if its disclosure reaches REMOVE, else ``term``. Intermediate
    tables go to the shared folder uri.
    """
    plain = id_text(docs, id_col, text_col)
    hashed = plain.withColumn("text_hash", F.xxhash64("text"))
    found = keep(find_base(hashed), f"{uri}/found")
    strong = keep(disclosures(found, plain, uri).withColumnRenamed("term", "hash").withColumn("code", F.lit(1)), f"{uri}/strong")
    empty = F.expr("cast(array() as array<struct<kind string, start int, end int>>)")
    if strong.isEmpty():
        return found.select("doc_id", "text_hash", "base", empty.alias("terms"))
    kind = F.when(F.col("disclosure") >= REMOVE, "removed").otherwise("term")
    hits = places(hashed, f"{uri}/strong").join(strong.select(F.col("hash").alias("term"), kind.alias("kind")), "term")
    # A row is named by its id and text; equal rows have equal spans, which the set holds once.
    spans = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("terms"))
    same = [F.col("f.doc_id").eqNullSafe(F.col("s.doc_id")), F.col("f.text_hash") == F.col("s.text_hash")]
    joined = found.select("doc_id", "text_hash", "base").alias("f").join(spans.alias("s"), same, "left")
    return joined.select("f.doc_id", "f.text_hash", "base", F.coalesce("terms", empty).alias("terms"))


def general(term: str) -> str:
    """The class that stands for a generalised term: an acronym, a name, or any other word."""
    return "[ACRONYM]" if term.isupper() else "[NAME]" if term[0].isupper() else LABELS["term"]


def replace_spans(text: str, spans: list[Span]) -> str:
    """The text with each span's label in its place; of overlapping spans the first stands for all."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= done:
            out += [text[done:start], general(text[start:end]) if kind == "term" else LABELS[kind]]
        done = max(done, end)
    return "".join([*out, text[done:]])


def strong_terms(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored table (hash, disclosure, code) of the terms that reveal a value."""
    plain = id_text(docs, id_col, text_col)
    found = keep(find_base(plain.withColumn("text_hash", F.xxhash64("text"))).drop("base"), f"{uri}/found")
    return keep(disclosures(found, plain, uri).withColumnRenamed("term", "hash").withColumn("code", F.lit(1)), f"{uri}/strong")


@lru_cache(maxsize=2)
def _strong(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the stored terms, sorted, and whether each is removed: 9 bytes a term."""
    filesystem, path = open_fs(uri)
    table = pyarrow.dataset.dataset(path, filesystem=filesystem, format="parquet").to_table(columns=["hash", "disclosure"]).sort_by("hash")
    return table.column("hash").to_numpy(), table.column("disclosure").to_numpy() >= REMOVE


def term_spans(text: str, base: list[Span], terms_uri: str) -> list[Span]:
    """The places of the stored terms in a text."""
    hashes, removed = _strong(terms_uri)
    if not len(hashes):
        return []
    words = list(terms_outside(text, base))
    h = np.array([_term_hash(m.group().lower()) for m in words], np.int64)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return [("removed" if removed[at[i]] else "term", *words[i].span()) for i in np.flatnonzero(hashes[at] == h).tolist()]


def sanitise(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with personal data and revealing terms replaced in the text; null texts stay null, other columns as they are. No text is shuffled."""
    strong_terms(docs, uri, id_col, text_col)
    terms_uri = f"{uri}/strong"

    def replace(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            base = base_spans(x or "")
            spans = base + term_spans(x or "", base, terms_uri)
            out.append(x if x is None or not spans else replace_spans(x, spans))
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, F.arrow_udf(replace, "string").asNondeterministic()(F.col(text_col).cast("string"))).select(*docs.columns)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of every document's personal data, and all spans with the revealing terms."""
    small_batches(spark)
    found = find_pii(table(spark, sf_dir, "documents"), shared_dir(spark, "pii"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "terms")).alias("spans"))


def digest(spans: list[Span]) -> str:
    """base_sha256 of spans in order."""
    return hashlib.sha256(_join(spans).encode()).hexdigest()
