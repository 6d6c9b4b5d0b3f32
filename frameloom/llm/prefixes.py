"""Token counts at every prefix of a text, for a sentencepiece BPE model with byte fallback.

Greedy merging has one property that a dynamic program can use: a sequence of pieces is the
encoding of its text if and only if each two neighbours are the encoding of theirs. (No merge of
the encoding crosses one of its borders, so a border's two neighbours alone give themselves again;
and the first merge that crossed a border of another sequence would cross it in the two neighbours
too.) So the last piece of the encoding of a prefix is the one piece ending there that fits the last
piece of the shorter prefix before it, and

    count(prefix) = count(shorter prefix) + tokens of that piece,

which gives the exact count at every prefix, though the counts do not always rise with the prefix.

No piece joins a space to the character before it, or a mark to a Latin letter before it (the
vocabulary is searched for such pieces), so a text is cut there and each part is its own program. Programs are kept by prefix of a
part: a new word goes on from the longest known prefix.

A text's profile holds, for each of its code points, the tokens more (or fewer) that the prefix up
to it has than the one before. ``tokens_before`` and ``longest_within`` answer from profiles, without
any tokenizer. Null texts count as empty: no tokens, an empty profile. Long texts are profiled whole,
parts without spaces too. Extra columns are carried; one named like a new one is replaced. Repeated
rows and ids each keep their row.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import id_text, per_text, small_batches, table

LIMIT = 4096
#: Prefixes of parts, and pairs of pieces, that a worker keeps; parts of more characters are not kept.
PREFIXES, PAIRS, KEPT = 1_000_000, 300_000, 32
SPACE, LETTER = "▁", "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"


class Program(dict):
    """The dynamic program over one vocabulary; as a dictionary, the profiles of parts."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if sum(map(model.is_byte, ids)) != 256:
            raise ValueError("the model needs the 256 byte pieces")
        if model.encode("  a ") != model.encode(f"{SPACE}{SPACE}a{SPACE}") or model.decode(model.encode(" À  å ")) != " À  å ":
            raise ValueError("the model must leave texts as they are, but for a space before them")
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        ends: dict[str, set[int]] = {}
        for piece in self.score:
            if len(piece) > 1:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        #: Lengths, greatest first, of the pieces of three characters or more that end in these three.
        self.lengths = {end: sorted(n, reverse=True) for end, n in ends.items() if len(end) == 3}
        self.parts = re.compile(self._pattern(), re.DOTALL).findall
        self.fits: dict[tuple[str, str], bool] = {}
        #: By prefix of a part: of this or a longer part, the length of the last piece and the count at each prefix.
        self.known: dict[str, tuple[bytes, bytes]] = {"": (b"", b"")}

    def _pattern(self) -> str:
        """Parts of a text: no piece holds a space after another character, or a letter before one of these marks."""
        if any(SPACE in piece.lstrip(SPACE) for piece in self.score):
            return ".+"
        joined = set("".join(re.findall(f"{LETTER}([{re.escape(string.punctuation)}])", "\n".join(self.score))))
        marks = "".join(re.escape(c) for c in string.punctuation if c not in joined)
        return f"{SPACE}*{LETTER}+(?=[{marks}{SPACE}]|\\Z)|{SPACE}*[^{SPACE}]+|{SPACE}+"

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text, by greedy merging: best score first, then from the left."""
        pieces, score = list(text), self.score
        while True:
            found = [(-score[m], i) for i in range(len(pieces) - 1) if (m := pieces[i] + pieces[i + 1]) in score]
            if not found:
                return pieces
            i = min(found)[1]
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]

    def _fit(self, key: tuple[str, str]) -> bool:
        """Whether two pieces (the first empty at the begin of a part) are the encoding of their text."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        found = self.fits[key] = self.merge(key[0] + key[1]) == [x for x in key if x]
        return found

    def _go_on(self, part: str, last: list[int], counts: list[int]) -> None:
        """Add the last piece's length and the count for each prefix that is still to come; counts has the empty prefix too."""
        score, lengths, fits, fit = self.score, self.lengths, self.fits, self._fit
        for end in range(len(counts), len(part) + 1):
            # One piece fits and the order of trying is free: most often it is the last one with a character more.
            more = last[-1] + 1 if last else 1
            for n in (more, *lengths.get(part[max(end - 3, 0) : end], ()), 2):
                start = end - n
                if start >= 0 and n > 1 and (piece := part[start:end]) in score:
                    key = (part[start - last[start - 1] : start] if start else "", piece)
                    if fits[key] if key in fits else fit(key):
                        last.append(n)
                        counts.append(counts[start] + 1)
                        break
            else:
                piece = part[end - 1]
                last.append(1)
                counts.append(counts[end - 1] + (1 if piece in score else len(piece.encode())))

    def __missing__(self, part: str) -> bytes:
        if len(part) > KEPT:
            counts = [0]
            self._go_on(part, [], counts)
            return np.diff(counts).astype(np.int8).tobytes()  # a step is at most 4 up, and down by less than a piece's characters
        known = self.known
        if len(known) >= PREFIXES:
            self.clear()
            known.clear()
            known[""] = (b"", b"")
        at = len(part) - 1
        while part[:at] not in known:
            at -= 1
        lens, before = known[part[:at]]
        last, counts = list(lens[:at]), [0, *before[:at]]
        self._go_on(part, last, counts)
        made = bytes(last), bytes(counts[1:])
        for end in range(at + 1, len(part) + 1):
            known[part[:end]] = made
        steps = self[part] = bytes([b - a & 255 for a, b in zip(counts, counts[1:], strict=False)])
        return steps

    def profile(self, text: str) -> np.ndarray:
        """For each code point the tokens more that the prefix up to it has; the space that the model puts first counts with the first."""
        if not text:
            return np.empty(0, np.int8)
        steps = np.frombuffer(b"".join(map(self.__getitem__, self.parts(SPACE + text.replace(" ", SPACE)))), np.int8).copy()
        steps[1] += steps[0]
        return steps[1:]


@lru_cache(maxsize=2)
def program(path: str) -> Program:
    """One program for each worker process."""
    return Program(path)


def prefix_counts(docs: DataFrame, path: str, text_col: str = "text", profile_col: str = "profile", count_col: str = "n_tokens") -> DataFrame:
    """docs with each text's profile (binary, compressed) and its number of tokens, the count at its last prefix."""

    def work(texts: list[str | None]) -> list:
        p, squeeze = program(path), zstandard.ZstdCompressor(level=1).compress
        made = [p.profile(x or "") for x in texts]
        return [[squeeze(x.tobytes()) for x in made], [int(x.sum(dtype=np.int64)) for x in made]]

    return per_text(docs, f"{profile_col} binary, {count_col} long", work, text_col)


def counts(profile: bytes | None) -> np.ndarray:
    """The token counts at the prefixes of 0, 1, 2, .. code points."""
    return np.r_[0, np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(profile), np.int8), dtype=np.int64)] if profile else np.zeros(1, np.int64)


def _answer(profiled: DataFrame, question: str, profile_col: str, out_col: str, ask) -> DataFrame:
    def run(profiles: pa.Array, asked: pa.Array) -> pa.Array:
        return pa.array([None if a is None else ask(counts(p), a) for p, a in zip(profiles.to_pylist(), asked.to_pylist(), strict=True)], pa.int64())

    return profiled.withColumn(out_col, F.arrow_udf(run, "long")(F.col(profile_col), F.expr(question).cast("long")))


def tokens_before(profiled: DataFrame, at: str, profile_col: str = "profile", out_col: str = "tokens_before") -> DataFrame:
    """The tokens of the first ``at`` code points (an SQL expression; past the end: of the whole text; below 0: none; null: null)."""
    return _answer(profiled, at, profile_col, out_col, lambda c, a: int(c[min(max(a, 0), len(c) - 1)]))


def longest_within(profiled: DataFrame, budget: str, profile_col: str = "profile", out_col: str = "chars_within") -> DataFrame:
    """The code points of the longest prefix of at most ``budget`` tokens (an SQL expression; below 0: as 0; null: null)."""
    return _answer(profiled, budget, profile_col, out_col, lambda c, b: int(np.flatnonzero(c <= max(b, 0))[-1]))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens pass the limit of a window."""
    import public_tokenizers

    small_batches(spark)
    docs = id_text(table(spark, sf_dir, "documents"))
    sized = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    profiled = prefix_counts(sized, public_tokenizers.path("piece_bpe_32k.model"))
    return profiled.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
