"""A publisher's scorings in plain words: "*3*3*32 – 4231 – t+4 – hp" as "3 flutes, 3 oboes, ..., timpani, 4 percussion, harp".

A scoring is read entry by entry. An entry is a list of tokens and its asides; readers are asked in turn what it stands
for, the first that knows answers with the entries to show, and what none knows is shown word by word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of players in a group of digits, plurals, abbreviations, and words that begin another version.
WINDS, BRASS = ("flute", "oboe", "clarinet", "bassoon"), ("horn", "trumpet", "trombone", "tuba")
PLURALS = {"tuba": "tubas", "piano": "pianos", "harp": "harps", "sax": "saxophones", "percussion": "percussion", "strings": "strings"}
ABBREVIATIONS = {
    "timp": "timpani", "perc": "percussion", "hp": "harp", "pf": "piano", "pno": "piano", "cel": "celesta", "str": "strings", "gtr": "guitar", "kybd": "keyboards", "kybds": "keyboards",
    "sax": "saxophones", "saxs": "saxophones", "saxe": "saxophones", "saxes": "saxophones", "tpt": "trumpets", "tpts": "trumpets", "tbn": "trombones", "tbns": "trombones",
    "flugel": "flugelhorns", "flugels": "flugelhorns", "picc": "piccolo", "opt": "optional", "red.": "reduction", "dbl": "doubling", "trgl": "triangle", "cymb.": "cymbal", "d.s.": "",
}
ENSEMBLES, SIZES = {"orchestra", "ensemble", "band", "quintet"}, {"chamber", "string", "brass", "wind", "full", "concert"}
POLITE = {"please", "indicate", "would", "could", "should", "prefer"}
PITCHED = ("trumpet", "cornet", "flugel", "clarinet", "horn")

MOST_PLAYERS, LONG_ASIDE = 12, 24
_ACCIDENTALS = ("flat", "sharp")
_SPLIT = re.compile(r"\([^)]*\)?|[,;–—]|[^\s,;–—()]+|\)")


@dataclass
class Entry:
    """Tokens, words and bracketed asides in their order."""

    tokens: list[str] = field(default_factory=list)

    @property
    def words(self) -> list[str]:
        return [t for t in self.tokens if t[0] != "("]


def entries(text: str) -> list[Entry]:
    """Cut at commas, semicolons and dashes outside brackets; a sentence that a stop ends is an entry too."""
    out, now = [], Entry()
    for m in _SPLIT.finditer(text):
        if m[0] in ",;–—":
            out.append(now)
            now = Entry()
            continue
        # A hyphen between two groups of digits parts them.
        parts = m[0].split("-") if "-" in m[0] else [m[0]]
        if len(parts) == 2 and _group(parts[0], 4, 6) and _group(parts[1], 4, 4):
            out += [Entry([*now.tokens, parts[0]]), Entry([parts[1]])]
            now = Entry()
        elif m[0] == "-" and now.tokens and _group(now.tokens[0], 4, 6):
            out.append(now)
            now = Entry()
        else:
            now.tokens.append(m[0])
    return [e for e in [*out, now] if e.tokens]


def players(n: int, name: str) -> str:
    return name if n == 1 else f"{n} {PLURALS.get(name, name + 's')}"


def _bare(word: str) -> str:
    return word.strip(".:*").lower()


def _number(word: str) -> int | None:
    return int(word) if word.isascii() and word.isdigit() else None


def _group(word: str, least: int, most: int) -> list[int]:
    """The digits of a group such as *3*232, each of which may have a star in front; none if it is no group."""
    digits = word.replace("*", "")
    starred = "**" in word or word.endswith("*")
    return [int(c) for c in digits] if digits.isdigit() and digits.isascii() and not starred and least <= len(digits) <= most else []


# ── versions ──────────────────────────────────────────────────────────────────


def _heads_version(words: list[str]) -> bool:
    """Whether an entry begins another version of the work."""
    low = [_bare(w) for w in words]
    if not low:
        return False
    if re.fullmatch(r"[2-9]\).*", words[0]) or (_number(low[0]) and words[1:2] == [")"]):
        return True
    pair = tuple(low[:2])
    if pair in (("full", "orchestra"), ("original", "piece"), ("original", "version"), ("also", "available"), ("also", "published")):
        return True
    if _number(low[0]) is not None and pair[1:] == ("player",) and low[2:3] == ["version"]:
        return True
    rest = low[1:] if low[0] == "reduced" else low
    rest = rest[1:] if rest and _number(rest[0]) is not None else rest
    return len(rest) >= 3 and rest[0] in SIZES and rest[1] in ENSEMBLES and rest[2] == "instrumentation"


def _first_version(found: list[Entry]) -> tuple[list[Entry], bool]:
    """The entries of the first version, and whether there are others. "2 options, 1)" in front of it is no entry."""
    if found and len(w := found[0].words) >= 2 and _number(w[0]) is not None and _bare(w[1]) in ("option", "options"):
        found = [Entry(found[0].tokens[2:]), *found[1:]] if len(found[0].tokens) > 2 else found[1:]
        if found and found[0].tokens and (numbered := re.fullmatch(r"1\)(.*)", found[0].tokens[0])):
            found = [Entry([*filter(None, [numbered[1]]), *found[0].tokens[1:]]), *found[1:]]
        elif found and found[0].tokens[:2] == ["1", ")"]:
            found = [Entry(found[0].tokens[2:]), *found[1:]]
    out: list[Entry] = []
    for entry in found:
        if out and _heads_version(entry.words):
            return out, True
        # A version may begin behind a stop inside an entry.
        for k, token in enumerate(entry.tokens[:-1]):
            if token.endswith(".") and _heads_version([t for t in entry.tokens[k + 1 :] if t[0] != "("]):
                return [*out, Entry([*entry.tokens[:k], token.rstrip(".")])], True
        out.append(entry)
    return out, False


# ── readers ───────────────────────────────────────────────────────────────────


def _keyless(tokens: list[str]) -> list[str]:
    """Without keys: "Bb", "B-flat", "in F sharp", and a letter in front of an instrument that has one."""
    out, i = [], 0
    while i < len(tokens):
        size = _key(tokens, i)
        if size and out and out[-1].lower() == "in":
            out.pop()
        if not size:
            out.append(tokens[i])
        i += size or 1
    return out


def _key(tokens: list[str], i: int) -> int:
    """How many tokens from i name a key; 0 if none does."""
    word = tokens[i].strip("*.")
    if not word or word[0] not in "ABCDEFGabcdefg":
        return 0
    rest = word[1:].lower()
    if rest in ("b", "♭", "#", "♯") or rest.lstrip("-") in _ACCIDENTALS:
        return 1
    if rest:
        return 0
    behind = [t.lower() for t in tokens[i + 1 : i + 3]]
    if behind and behind[0].strip("-.") in _ACCIDENTALS:
        return 2
    named = behind[1:] if behind[:1] == ["piccolo"] else behind[:1]
    return 1 if word.isupper() and named and named[0].startswith(PITCHED) else 0


def _drums(words: list[str]) -> list[str] | None:
    """t, t+4, 4p"""
    joined = "".join(words).lower()
    if m := re.fullmatch(r"t\+(\d+)", joined):
        return ["timpani", f"{m[1]} percussion"]
    if m := re.fullmatch(r"(\d+)p", joined):
        return [f"{m[1]} percussion"]
    return ["timpani"] if joined == "t" else None


def _parts(tokens: list[str]) -> list[str]:
    """Part numbers behind a name as players: "alto sax. 1-3" as "3 alto saxophones". Numbers must rise by less than twelve."""
    for k, token in enumerate(tokens):
        low, dash, high = token.rstrip(".*").partition("-")
        if k and dash and _number(low) is not None and _number(high) is not None and all(t[0] != "(" for t in tokens[:k]):
            n, last = int(high) - int(low) + 1, tokens[k - 1].removesuffix(".")
            if 1 < n <= MOST_PLAYERS and re.fullmatch(r"[A-Za-zé'-]+", last):
                one = last if last.lower().endswith(("ss", "is", "us")) or not last.lower().endswith("s") else last[:-1]
                return [str(n), *tokens[: k - 1], PLURALS.get(one, one + "s"), *tokens[k + 1 :]]
            return tokens
    return tokens


def _spelt(word: str) -> str:
    """A word with its abbreviation written out; marks around it stay."""
    core = word.strip("():,[]")
    low = core.lower()
    full = ABBREVIATIONS.get(low, ABBREVIATIONS.get(low.removesuffix(".")))
    if full is None:
        return word
    return word.replace(core, full, 1)


def _aside(token: str) -> str:
    """An aside with its abbreviations written out; a long one that addresses the reader is nothing."""
    inner = token.strip("()").strip()
    if len(token) >= LONG_ASIDE + 2 and ({_bare(w) for w in inner.split()} & POLITE or "covered by" in inner.lower()):
        return ""
    pieces = [" ".join(_spelt(w) for w in _parts(_keyless(p.split()))) for p in re.split(r"\s*[,;–—]\s*", inner)]
    shown = ", ".join(filter(None, ("timpani" if p.lower() == "t" else p for p in pieces)))
    return f"({shown})" if shown else ""


def _words(entry: Entry) -> list[str]:
    """The entries that an entry stands for."""
    if drums := _drums(entry.words):
        return drums
    tokens = []
    for t in _parts(_keyless(entry.tokens)):
        # Any part of "timp/perc" may be short.
        tokens.append(_aside(t) if t[0] == "(" else "/".join(map(_spelt, t.split("/"))))
    shown = " ".join(filter(None, tokens)).strip(" .,")
    return [re.sub(r"(?i)\bsus\.\s*(?=cymbal)", "suspended ", shown)] if shown else []


def readable(text: str) -> str:
    """A publisher's scoring as a list of plain names and numbers, of several versions the first."""
    found, others = _first_version(entries(text))
    out, i = [], 0
    while i < len(found):
        winds = _group(found[i].words[0], 4, 6) if len(found[i].words) == 1 else []
        behind = found[i + 1].words if i + 1 < len(found) else []
        brass = _group(behind[0], 4, 4) if behind else []
        if winds and brass:
            # More than four winds: the first four count.
            named = [players(n, name) for n, name in zip([*winds[:4], *brass], [*WINDS, *BRASS], strict=True) if n]
            out += named or [found[i].words[0], behind[0]]
            rest = Entry(found[i + 1].tokens[1:])
            out += _words(rest) if rest.tokens else []
            i += 2
            continue
        out += _words(found[i])
        i += 1
    shown = ", ".join(out)
    if others and shown:
        shown += " (also published in other scorings)"
    return shown[:1].lower() + shown[1:]


def readable_scoring(text: Column) -> Column:
    """readable as a Column; null stays null."""

    def shown(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else readable(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf("string")(shown)(text)
