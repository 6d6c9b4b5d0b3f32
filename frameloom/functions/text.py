"""Text rules as column expressions; a Python UDF only where a rule recurses."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.numbers import round_binary

#: Words that say nothing in an overlap score.
STOPWORDS = (
    "a", "also", "an", "and", "are", "as", "at", "be", "been", "but", "by", "did", "do", "does", "down", "for", "from", "had", "has",
    "have", "he", "her", "his", "i", "if", "in", "into", "is", "it", "its", "just", "me", "my", "no", "not", "of", "off", "on", "or",
    "our", "she", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "up", "was", "we", "were",
    "what", "when", "where", "which", "while", "who", "will", "with", "you", "your", "yours",
)
#: Openers that are cut, and words and phrases that are banned.
OPENERS = ("discover", "imagine")
BANNED_WORDS = ("bespoke", "delve", "nestled", "tapestry")
BANNED_PHRASES = ("imagine a place", "where luxury meets")


def py_zfill(value: Column, width: int) -> Column:
    """Zero-padded to a width; longer values stay whole, which lpad would cut."""
    text = value.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def py_split(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(py_split(F.coalesce(text, F.lit(""))))


def tokenize(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-cased runs of a-z, 0-9 and apostrophes, without stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(*stopwords))


def overlap_score(a: Column, b: Column) -> Column:
    """Share of the distinct tokens of a that b has; 0 without tokens."""
    mine = F.array_distinct(tokenize(a))
    return F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, tokenize(b))) / F.size(mine)).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    return F.split(F.trim(text), "(?<=[.!?])\\s+")


def strip_opener(text: Column, openers: tuple[str, ...] = OPENERS) -> Column:
    """Without its first word if that is an opener; what follows gets a capital, the rest stays as it is."""
    trimmed = F.trim(text)
    first = F.regexp_replace(F.lower(F.regexp_extract(trimmed, "^(\\S+)", 1)), "[.,!?;:]+$", "")
    rest = F.regexp_replace(trimmed, "^\\S+[\\s,;:]*", "")
    return F.when(first.isin(*openers) & (rest != ""), F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, 1 << 30))).otherwise(text)


def banned_terms(text: Column, words: tuple[str, ...] = BANNED_WORDS, phrases: tuple[str, ...] = BANNED_PHRASES) -> Column:
    """Sorted banned phrases that the text contains and banned words that it has as whole words."""
    lower = F.lower(text)
    hits = {p: lower.contains(p) for p in phrases} | {w: lower.rlike(rf"\b{w}\b") for w in words}
    return F.array_compact(F.array(*(F.when(hits[term], F.lit(term)) for term in sorted(hits))))


def trim_sentences(text: Column, least: int, most: int) -> Column:
    """The longest run of first sentences of at most ``most`` words, if it has ``least``; else the text as it is."""
    parts = sentences(text)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " "))
    good = F.filter(prefixes, lambda p: (word_count(p) <= most) & (word_count(p) >= least))
    return F.when((word_count(text) > most) & (F.size(good) > 0), F.element_at(good, -1)).otherwise(text)


def trim_overflow(segments: DataFrame, least: int, most: int) -> DataFrame:
    """(doc, segment, text): the last segment of a document of more than ``most`` words loses last sentences until it fits, if ``least`` words stay."""
    whole = Window.partitionBy("doc")
    counted = segments.withColumn("n", word_count(F.col("text"))).withColumn("total", F.sum("n").over(whole)).withColumn("last", F.max("segment").over(whole) == F.col("segment"))
    parts, rest = sentences(F.col("text")), F.col("total") - F.col("n")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), " "))
    fits = F.filter(heads, lambda h: (rest + word_count(h)).between(least, most))
    cut = F.col("last") & (F.col("total") > most) & (F.size(fits) > 0)
    return counted.select("doc", "segment", F.when(cut, F.get(fits, F.size(fits) - 1)).otherwise(F.col("text")).alias("text"))


#: What counts as a price, a share and a number.
PRICE, SHARE, NUMBER = "\\$([0-9][0-9,]*(?:\\.[0-9]+)?)", "([0-9]+(?:\\.[0-9]+)?)\\s*%", "[0-9][0-9,]*(?:\\.[0-9]+)?"


def speak_units(text: Column) -> Column:
    """Currency and percent signs as words: $1,900 is 1,900 dollars, 10 % is 10 percent."""
    return F.regexp_replace(F.regexp_replace(text, PRICE, "$1 dollars"), SHARE, "$1 percent")


def slug(text: Column, joint: str = "_") -> Column:
    """Lower-case words joined by a sign; other characters go."""
    kept = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9\\s_-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "[\\s_-]+", joint), f"^{joint}+|{joint}+$", "")


def norm_key(text: Column) -> Column:
    """Lower case, white space collapsed: the key of equal texts."""
    return F.lower(F.trim(F.regexp_replace(text, "\\s+", " ")))


def embedding_text(description: Column, category: Column) -> Column:
    """``description | category``; nulls are empty, never skipped."""
    return F.concat(F.trim(F.coalesce(description, F.lit(""))), F.lit(" | "), F.trim(F.coalesce(category, F.lit(""))))


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()


def spell_number(n: int) -> str:
    """Cardinal words below a thousand million; larger numbers stay digits."""
    if n >= 1_000_000_000:
        return str(n)
    for size, name in ((1_000_000, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            head = f"{spell_number(n // size)} {name}"
            return f"{head} {spell_number(n % size)}" if n % size else head
    if n < 20:
        return _ONES[n]
    return _TENS[n // 10] + (f" {_ONES[n % 10]}" if n % 10 else "")


def speak_numbers(text: Column) -> Column:
    """Digits as words, decimals after 'point'. An Arrow UDF: the spelling recurses."""
    def say(m: re.Match) -> str:
        whole, _, part = m.group().replace(",", "").partition(".")
        said = spell_number(int(whole))
        return f"{said} point {' '.join(_ONES[int(d)] for d in part)}" if part else said

    number = re.compile(NUMBER)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else number.sub(say, x) for x in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def event_id(*parts: Column) -> Column:
    """sha256 of parts joined by newlines; a null part is an error, concat_ws would skip it."""
    missing = parts[0].isNull()
    for p in parts[1:]:
        missing = missing | p.isNull()
    digest = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", *parts), 256))
    return F.when(missing, F.raise_error(F.lit("event id of a null part")).cast("string")).otherwise(digest)


def fingerprint(hashes: Column) -> Column:
    """rfp2: and the sha256 of ordered hashes joined by |; null if one is null or empty, or if there is none."""
    whole = F.size(hashes) > 0
    return F.when(whole & F.forall(hashes, lambda x: x.isNotNull() & (x != "")), F.concat(F.lit("rfp2:"), F.sha2(F.array_join(hashes, "|"), 256)))


#: What is stripped before and after a caption word.
WRAP_BEFORE, WRAP_AFTER = "^[\"'“”‘’(\\[{<«»—–-]+", "[\"'“”‘’)\\]}>«»—–]+$"


def caption_word(word: Column) -> Column:
    """A caption word without what wraps it; a word that is nothing else stays."""
    bare = F.regexp_replace(F.regexp_replace(word, WRAP_BEFORE, ""), WRAP_AFTER, "")
    return F.when(bare != "", bare).otherwise(word)


def music_filename(name: Column, id_: Column) -> Column:
    """A stable file name: signs become an underscore, dots and underscores at the ends go."""
    safe = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.concat(F.lit("music_"), F.when(safe != "", safe).otherwise("track"), F.lit("_"), id_, F.lit(".mp3"))


def drive_uri(uri: Column, file_id: Column) -> Column:
    """drive:<id> from a uri of that form or from a bare id; null where either is something else."""
    good = uri.startswith("drive:") & (uri != "drive:")
    bare = ~file_id.rlike("^(https?://|drive:)")
    return F.when(uri.isNotNull() & (uri != ""), F.when(good, uri)).when((file_id != "") & bare, F.concat(F.lit("drive:"), file_id))


def duration_label(seconds: Column) -> Column:
    """pgc_<whole seconds>s, halves to even."""
    return F.concat(F.lit("pgc_"), F.bround(seconds).cast("int"), F.lit("s"))


def asset_floor(videos: Column, base: int, per_extra: int) -> Column:
    return F.lit(base) + F.lit(per_extra) * F.greatest(videos - 1, F.lit(0))


def rounded_or_null(text: Column, places: int = 3) -> Column:
    """A number rounded to so many places, on its binary value; null for any other text."""
    return round_binary(text.try_cast("double"), places)


def output_path(path: Column, variant: Column, seconds: Column) -> Column:
    """The path of a variant: a duration at the end of the name gives way to its own."""
    ext = F.regexp_extract(path, "(\\.[^./]+)$", 1)
    root = F.regexp_replace(F.regexp_replace(path, "\\.[^./]+$", ""), "_[0-9]+s$", "")
    return F.concat(root, F.lit("_v"), variant.cast("string"), F.lit("_"), F.bround(seconds).cast("int"), F.lit("s"), F.when(ext != "", ext).otherwise(".mp4"))


def _object(text: Column) -> Column:
    """The text if it is a JSON object, else null."""
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)


def fenced_json(text: Column) -> Column:
    """The JSON object of an answer that may stand between code fences; null for anything else."""
    bare = F.trim(F.regexp_replace(text, "^\\s+|\\s+$", ""))
    fenced = F.regexp_extract(bare, "(?s)^```(?:json)?\\s*(.*?)\\s*```$", 1)
    return _object(F.when(fenced != "", fenced).otherwise(bare))


def salvaged_json(text: Column) -> Column:
    """The JSON object from the first to the last brace; null if that is none."""
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), _object(F.substring(text, first, last - first + 1)))
