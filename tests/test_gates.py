"""Script gates against a plain walk over each script, and units and numbers as words."""

import random
import re

from pyspark.sql import functions as F

from frameloom.functions import text as T
from frameloom.operators import gates as G

PROFILE = G.Profile(segments=3, words=(12, 24), segment_words=(2, 12), clips=(2, 5), most_clips=3)
OPENERS = {"imagine", "discover"}


def repaired(script):
    out = []
    for s in script:
        text = s["text"]
        if text and text.strip():
            first = text.split()[0].lower().rstrip(".,!?;:")
            rest = re.sub(r"^\S+[\s,;:]*", "", text.strip(), count=1).lstrip()
            if first in OPENERS and rest:
                text = rest[0].upper() + rest[1:]
        out.append({**s, "text": text})
    count = lambda t: len((t or "").split())
    total = sum(count(s["text"]) for s in out)
    if total > PROFILE.words[1]:
        kept = [p for p in re.split(r"(?<=[.!?])\s+", (out[-1]["text"] or "").strip()) if p]
        others = total - count(out[-1]["text"])
        while len(kept) > 1:
            kept = kept[:-1]
            now = others + count(" ".join(kept))
            if now < PROFILE.words[0]:
                break
            if now <= PROFILE.words[1]:
                out[-1]["text"] = " ".join(kept)
                break
    return out


def banned(script):
    whole = " ".join(s["text"] or "" for s in script).lower()
    return [f"banned:{p}" for p in T.BANNED_PHRASES if p in whole] + [f"banned:{w}" for w in T.BANNED_WORDS if re.search(rf"\b{w}\b", whole)]


def walk(script, inventory):
    script = repaired(script)
    words = [len((s["text"] or "").split()) for s in script]
    count = [] if len(script) == PROFILE.segments else [f"segments:{len(script)}"]
    texts = [f"no_text:{i}" for i, s in enumerate(script, 1) if s["text"] is None]
    sizes = [f"words:{i}:{n}" for i, n in enumerate(words, 1) if not PROFILE.segment_words[0] <= n <= PROFILE.segment_words[1]]
    floor = [f"below_floor:{sum(words)}"] if sum(words) < PROFILE.words[0] else []
    pauses = [f"pause_weight:{i}" for i, s in enumerate(script[:-1], 1) if s["pause"] not in (1, 2, 3)]
    ids = [s["clips"] if s["clips"] is not None else [s["clip"]] if s["clip"] is not None else None for s in script]
    structure = count + texts + [f"no_clips_field:{i}" for i, x in enumerate(ids, 1) if x is None]
    if not structure:
        flat = [c for x in ids for c in x]
        structure = sizes + [f"no_clips:{i}" if not x else f"many_clips:{i}:{len(x)}" for i, x in enumerate(ids, 1) if not 1 <= len(x) <= PROFILE.most_clips]
        structure += [] if PROFILE.clips[0] <= len(flat) <= PROFILE.clips[1] else [f"clips:{len(flat)}"]
        structure += [f"clip_twice:{c}" for c in {c for c in flat if flat.count(c) > 1}] + [f"unknown_clip:{c}" for c in set(flat) - inventory] + banned(script)
    return sum(words), ",".join(floor), ",".join(sorted(structure)), ",".join(sorted(count + texts + sizes + pauses + banned(script)))


def test_gates_against_a_walk(spark):
    rnd = random.Random(4)
    scripts, rows = {}, []
    for doc in range(250):
        script = []
        for k in range(rnd.choice([3, 3, 3, 3, 2, 4])):
            bits = [rnd.choice(["One two three.", "Four five!", "nestled here.", "Imagine a place?", "six", "Where luxury meets sand."]) for _ in range(rnd.randrange(0, 5))]
            text = rnd.choice(["", "", "Imagine, ", "DISCOVER: ", "imagine"]) + " ".join(bits)
            some = [f"c{rnd.randrange(30)}" for _ in range(rnd.randrange(0, 5) if rnd.random() < 0.5 else 1)]
            kind = rnd.random()
            script.append({"text": None if rnd.random() < 0.03 else text, "pause": rnd.choice([1, 2, 3, 3, 0, None]), "clips": some if kind < 0.85 else None, "clip": "c1" if 0.85 <= kind < 0.95 else None})
            s = script[-1]
            rows.append((doc, k * 2, s["text"], s["pause"], s["clips"], s["clip"]))
        scripts[doc] = script
    inventory = {f"c{i}" for i in range(27)}
    df = spark.createDataFrame(rows, "doc long, segment int, text string, pause_weight int, clips array<string>, clip_id string").repartition(3)
    found = {r.doc: (r.total_words, r.floor, r.structure, r.script) for r in G.gates(df, spark.createDataFrame([(c,) for c in inventory], "clip_id string"), PROFILE).collect()}
    want = {doc: walk(s, inventory) for doc, s in scripts.items()}
    assert found == want
    told = {x.split(":")[0] for _, *parts in want.values() for p in parts for x in p.split(",")}
    assert told == {"", "below_floor", "segments", "no_text", "no_clips_field", "words", "no_clips", "many_clips", "clips", "clip_twice", "unknown_clip", "banned", "pause_weight"}
    assert "" in {w[2] for w in want.values()} and G.gates(df.limit(0), df.select("clip_id"), PROFILE).isEmpty()


def test_units_and_numbers_as_words(spark):
    cases = {
        "only $1,900 or 10 % off": ("only 1,900 dollars or 10 percent off", "only one thousand nine hundred dollars or ten percent off"),
        "$4.99, 2.5%": ("4.99 dollars, 2.5 percent", "four point nine nine dollars, two point five percent"),
        "$1,250,000.50": ("1,250,000.50 dollars", "one million two hundred fifty thousand point five zero dollars"),
        "a $ and %": ("a $ and %", "a $ and %"),
        "": ("", ""),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", T.speak_units(F.col("t")).alias("u"), T.speak_numbers(T.speak_units(F.col("t"))).alias("n")).collect():
        assert (r.u, r.n) == cases[r.t]
