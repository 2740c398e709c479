"""Display text: headings out, and a plain string section as one word."""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from .commentary import strip_commentary
from .markup import DISPLAY_CAP, clipped, replaced
from .scoring import TRUMPETS, Family, Grammar, grammar_of


def tidy(text: Column) -> Column:
    """Cut at a heading of the second level; deeper ones become labels; commas and blanks in a row as one."""
    cut = F.regexp_replace(text, r"(?s)(?<=.)(?<!=)==(?!=).*$", "")
    return F.trim(replaced(cut, (r"=+\s*([^=]*?)\s*=+", "$1, "), (r"\s+", " "), (r"(?:\s*,\s*)+", ", "), (r"^[,\s]+|[,\s]+$", "")))


# How sources write an undivided section of violins, violas, cellos and basses.
_ORD = r"(?:1st|2nd|first|second|II|I)"
_PAIR = rf"{_ORD}\s*(?:and|&)\s*{_ORD}"
_VIOLINS = "|".join((r"(?:1st|first)\s+violins,?\s+(?:2nd|second)\s+violins", r"violins?\s+I,?\s+violins?\s+II", rf"violins?\s*\(\s*{_PAIR}\s*\)", rf"violins?\s*,?\s*{_PAIR}", rf"{_PAIR}\s+violins", "violins"))
_SEP = r"(?:,\s*(?:and\s+)?|\s+and\s+|\s*&\s*)"
_SECTION = re.compile(rf"\b(?P<violin>{_VIOLINS}){_SEP}(?P<viola>violas){_SEP}(?P<cello>violoncellos|cellos|celli){_SEP}(?P<bass>(?:double[\s-]?|contra)?basses)", re.I)
_LABEL = re.compile(r"\b(?P<label>strings)\s*(?P<open>\(|[:,]+)\s*(?:(?P<harp>(?:\d+\s+)?harps?)(?:\s*,\s*(?:and\s+)?|\s+and\s+)\s*)?\Z", re.I)
_OF = re.compile(r"\bstring(?:s|\s+section)?(?P<of>\s+(?:of|containing)\s*)\Z", re.I)
_COUNTED = re.compile(
    r"(?:\d+[\s–—-]*|\b(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty)\s*)\Z", re.I
)


def plain_strings(text: str) -> str:
    """The enumeration of a plain string section as "strings"; left alone where a part has a number or a remark follows."""
    out, at, changed = "", 0, False
    while m := _SECTION.search(text, at):
        before, end = text[at : m.start()], m.end()
        label = _LABEL.search(before)
        if label and label["open"] == "(":
            close = re.match(r"\s*\)", text[end:])
            label, end = (label, end + close.end()) if close else (None, end)
        counted = any(_COUNTED.search(text[max(0, m.start(p) - 24) : m.start(p)]) for p in ("violin", "viola", "cello", "bass"))
        if counted or re.match(r"\s*\(", text[end:]):
            out, at = out + text[at : m.end()], m.end()
            continue
        if label:
            out += before[: label.end("label")] + (f", {label['harp']}" if label["harp"] else "")
        elif of := _OF.search(before):
            out += before[: of.start("of")]
        else:
            name = re.search("violin", m["violin"], re.I)[0]
            out += before + ("Strings" if name[0].isupper() else "strings")
        at, changed = end, True
    if not changed:
        return text
    return re.sub(r",\s*,", ",", re.sub(r"\s+,", ",", out + text[at:])).rstrip()


def collapse_strings(text: Column) -> Column:
    """plain_strings as a Column; null stays null."""

    @F.pandas_udf("string")
    def collapsed(texts):
        return texts.map(plain_strings, na_action="ignore")

    return collapsed(text)


def shipped(full: Column, source: Column) -> Column:
    """The text to ship: its string section collapsed and, unless it is a curated row, without commentary; null where nothing is left."""
    plain = collapse_strings(full)
    return F.when(source == "curated", plain).otherwise(strip_commentary(plain))


# Words that begin an item of a scoring, instruments outside the family, and general words for players.
_COUNT_WORDS = r"(?:\d{1,3}|an?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|single|double|triple|quadruple|pairs?(?:\s+of)?|solo|mixed|male|female)"
_INSTRUMENT = r"(?:piccolo|flutes?|oboes?|clarinets?|bassoons?|horns?|trumpets?|cornets?|trombones?|tubas?|timpani|harps?|violins?|violas?|cellos?|double\s+basses?|saxophones?|celesta|organ|pianos?)"
_GENERAL = r"(?:woodwinds?|brass|strings?|percussion|soprano|altos?|contralto|mezzo-soprano|tenors?|baritones?|bass|chorus(?:es)?|choirs?|voices?|soloists?|narrator|SATB\w*|SSAA?)"
CAPTION_REACH, ANCHOR_REACH, MARKER_REACH, COUNT_REACH = 300, 260, 700, 40
_SPECIFIC = re.compile(rf"\b(?:{_COUNT_WORDS}\s+){{0,2}}{_INSTRUMENT}\b", re.I)
_LOOSE = re.compile(rf"\b(?:{_COUNT_WORDS}\s+){{0,2}}{_GENERAL}\b", re.I)
_ITEM = re.compile(rf"(?:{_COUNT_WORDS}\s+){{0,2}}(?:{_INSTRUMENT}|{_GENERAL})\b", re.I)
_COUNT_BEFORE = re.compile(rf"(?:{_COUNT_WORDS}\s+){{1,2}}\Z", re.I)
_MARKER = re.compile(r":\s*,?\s*|\bthe following\s+(?:instruments?|instrumentation|forces)?\s*,?:?\s*|\bconsists? of\b\s*|\bcomprises?\b\s*", re.I)
_GROUP_LABEL = re.compile(r"(?P<label>[A-Z][^,]{0,29}),\s*")
_VERB = re.compile(r"\b(?:is|are|was|were|has|have|does|do)\b", re.I)


def without_captions(text: str, grammar: Grammar) -> str:
    """Without picture captions among the first 300 characters: items with a bar, and bare years, unless they name the family."""
    pieces = re.split(r"(,\s*)", text)
    items = list(zip(pieces[:-1:2], pieces[1::2], strict=True))
    begins = accumulate((len(item) + len(comma) for item, comma in items), initial=0)
    caption = re.compile(r"[^|]*\|.*|(?:1[5-9]|20)\d\d", re.S).fullmatch
    kept = [item + comma for (item, comma), at in zip(items, begins, strict=False) if at >= CAPTION_REACH or not caption(item) or grammar.name.search(item)]
    return "".join([*kept, pieces[-1]])


def _counted(text: str, at: int) -> int:
    """Where the number before position `at` begins, if there is one."""
    before = _COUNT_BEFORE.search(text[max(0, at - COUNT_REACH) : at])
    return at - len(before[0]) if before else at


def _announced(text: str, grammar: Grammar) -> list[int]:
    """Places behind a marker ("consists of", ":") where players follow, at once or behind one short label."""
    found = []
    for m in _MARKER.finditer(text, 0):
        if m.start() > MARKER_REACH:
            break
        at = m.end() + len(re.match(r"(?:,\s*)?", text[m.end() :])[0])
        label = _GROUP_LABEL.match(text, at)
        places = [at, label.end()] if label and not _VERB.search(label["label"]) else [at]
        found += [p for p in places if grammar.name.match(text, p) or _ITEM.match(text, p)][:1]
    return found


def without_lead_in(text: str, grammar: Grammar) -> str | None:
    """From the first instrument on, with its count; None if the text names no players near its beginning.

    Every place where the list may begin is a candidate: a specific instrument, best of all; then a place that a marker
    announces; then a general word ("brass", "soprano"), which prose uses too. Markers only back up a general word. A
    candidate at the very start settles it.
    """
    specific = [m.start() for m in (grammar.name.search(text), _SPECIFIC.search(text)) if m]
    general = [m.start() for m in [_LOOSE.search(text)] if m and m.start() <= ANCHOR_REACH]
    candidates = [(1, at) for at in [_counted(text, min(specific, default=0))] if specific and at <= ANCHOR_REACH] + [(3, at) for at in general]
    if not candidates:
        return None
    if general:
        candidates += [(2, at) for at in _announced(text, grammar)]
    return text[0 if 0 in (at for kind, at in candidates if kind != 2) else min(candidates)[1] :]


def scoring_display(text: Column, family: Family = TRUMPETS) -> Column:
    """A tidied passage without captions and lead-in, at most 400 characters; null if it names no players."""

    @F.pandas_udf("string")
    def shown(texts):
        grammar = grammar_of(family)
        return texts.map(lambda t: without_lead_in(without_captions(t, grammar), grammar), na_action="ignore")

    return F.substring(shown(tidy(text)), 1, DISPLAY_CAP)


# Phrases by which a product page goes from its scoring to prose; * is any word.
PROSE_OPENERS = (
    "note from the *", "notes from the *", "note for", "notes for", "note:", "program note", "program notes", "programme note", "programme notes", "about the *", "about this *",
    "commissioned", "co-commissioned", "premiered", "dedicated", "written for", "composed for", "the following", "includes the following", "contains the following", "uses the following",
    "view score", "view orchestral score", "duration:", "when I", "I was", "I had", "I have", "I wrote", "I began", "my * was", "my * is",
    "thanks", "special thanks", "many thanks", "with thanks", "my thanks",
)
WORKS_SPOKEN_OF = ("piece", "work", "fanfare", "concerto", "movement", "suite", "symphony")


def _opener(phrase: str) -> str:
    """A pattern for a phrase: any blanks between its words and in front of a colon; a note may stand behind a star or bracket."""
    words = [r"\w+" if w == "*" else re.escape(w.removesuffix(":")) for w in phrase.split()]
    return (r"[*(]?\s*" if phrase.startswith("note") else "") + r"\s+".join(words) + (r"\s*:" if phrase.endswith(":") else r"\b")


_PROSE = re.compile(r"\s+(?:" + "|".join(map(_opener, (*PROSE_OPENERS, *(f"{lead} {work}" for lead in ("this", "the") for work in WORKS_SPOKEN_OF)))) + ")", re.I)


def before_prose(text: str, grammar: Grammar) -> str:
    """Up to where prose begins outside brackets, unless only the whole text still holds players of the family."""
    m = _PROSE.search(re.sub(r"\([^)]*\)", lambda b: " " * len(b[0]), text))
    if not m:
        return text
    cut = text[: m.start()].strip()
    return text if not grammar.parse(cut)["total"] and grammar.parse(text)["total"] else cut


def cut_at_prose(text: Column, family: Family = TRUMPETS) -> Column:
    @F.pandas_udf("string")
    def cut(texts):
        grammar = grammar_of(family)
        return texts.map(lambda t: before_prose(t, grammar), na_action="ignore")

    return clipped(cut(text))
