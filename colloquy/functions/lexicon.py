"""Word lists and rule tables.

The stop words and opening words are our own choice of everyday English. Lists marked as fixed
values decide results and have to be as they are.
"""

from __future__ import annotations

import re

STOP_WORDS = (
    "a about after again all also am an and any are as at be because been before being both but by can could did do "
    "does doing done down each even every few for from get go going gone got had has have having he her here hers him "
    "his how i if in into is it its just kind know let like made may maybe me might more most much must my need no not "
    "now of off ok okay on once only or other our out over own please put really right said same say see she should "
    "since so some still such sure take than that the their them then there these they thing things think this those "
    "through to too under until up us use very want was way we well went were what when where which while who why will "
    "with would yeah yes yet you your"
).split()

# Capitalised only because they open a sentence.
OPENING_WORDS = tuple(w.capitalize() for w in STOP_WORDS) + ("Thanks", "Thank", "Hello", "Good", "Great", "One", "Two")

# Short words in capitals that are no acronyms. Fixed values.
SHORT_CAPS = "I A IS IT IN AT TO DO BE BY AN OR IF OF AS ON NO OK GO UP US WE MY ME".split()

# Words spoken twice on purpose; their repeats are kept. Fixed values.
EMPHASIS = ("very", "really", "no", "yes", "absolutely", "definitely")

# Sounds that are not a sentence. Fixed values.
FILLERS = ("mm", "uh", "um", "hmm", "hm", "ah", "oh")

# First words that make a segment a question when it lacks closing punctuation. Fixed values.
ASKING_WORDS = (
    "what when where who why how which whose whom is are was were do does did can could will would shall should may "
    "might have has had"
).split()

# First words of a genuine question. Fixed values.
QUESTION_WORDS = (
    "what who where when why how which is are was were can could will would should shall do does did have has had"
).split()

# Replies that ask nothing, tags that end a statement, and openings of an evasive answer. Fixed values.
BACKCHANNELS = "right okay ok yeah yes no really sure correct good".split() + ["got it"]
TAGS = ("right", "correct", "okay", "ok", "yeah", "isn't it", "aren't they", "don't you", "isn't that right", "you know")
UNSURE = ("i don't know", "i dont know", "not sure", "good question", "no idea", "i'm not sure", "im not sure")

# Trigger phrases: wordings, words that may or must (True) link the phrase to what follows, confidence, whether the
# speaker owns the task, reason. Wordings, order and confidences are fixed values.
ACTION_PHRASES = (
    (("i'll", "ill"), (), False, 0.90, True, "speaker commits"),
    (("i will",), (), False, 0.92, True, "speaker commits"),
    (("i'm going to", "im going to"), (), False, 0.88, True, "speaker commits"),
    (("action item",), (":",), False, 0.95, False, "named as action item"),
    (("can you",), (), False, 0.82, False, "asked of a listener"),
    (("we need to",), (), False, 0.75, False, "task for the group"),
    (("follow up",), (), False, 0.80, True, "follow-up"),
    (("please",), (), False, 0.78, False, "polite request"),
    (("let's", "lets"), (), False, 0.68, False, "suggested to the group"),
    (("we should",), (), False, 0.73, False, "recommended to the group"),
    (("next step", "next steps"), ("is", "are", ":"), True, 0.85, False, "named as next step"),
    (("you need to",), (), False, 0.79, False, "directed at a listener"),
    (("make sure",), ("to",), False, 0.77, False, "reminder"),
)
DECISION_PHRASES = (
    (("we decided", "we've decided"), (), False, 0.95, False, "said to be decided"),
    (("decision is",), (":",), False, 0.92, False, "named as decision"),
    (("we agreed", "we've agreed"), (), False, 0.92, False, "said to be agreed"),
    (("we moving forward with", "we're moving forward with"), (), False, 0.90, False, "going ahead"),
    (("we going with", "we're going with"), (), False, 0.90, False, "choice stated"),
    (("we go with", "we'll go with"), (), False, 0.88, False, "choice made"),
    (("let's go with", "lets go with"), (), False, 0.88, False, "choice made"),
    (("we use", "we'll use"), (), False, 0.88, False, "tool chosen"),
    (("we using", "we're using"), (), False, 0.82, False, "present practice"),
)


def one_of(values) -> str:
    """Alternatives of plain texts; blanks stand for any white space."""
    return "(?:" + "|".join(re.escape(v).replace(r"\ ", r"\s+") for v in values) + ")"


def whole_words(*leads: str) -> str:
    """Where one of the `one_of` alternatives stands as words, in any case.

    Letters that begin none of them are passed over first: word boundaries are dear to test.
    """
    begins = sorted({re.escape(said.lstrip("\\")[0]) for lead in leads for said in lead.removeprefix("(?:").removesuffix(")").split("|")})
    return rf"(?iU)(?=[{''.join(begins)}])\b(?:{'|'.join(leads)})\b"


def _link(words, must: bool) -> str:
    if not words:
        return r"\s+"
    linked = r"\s*(?:" + "|".join(w + (r"\b" if w.isalpha() else "") for w in words) + r")\s*"
    return linked if must else rf"(?:{linked}|\s+)"


def _rules(phrases):
    return tuple((one_of(said), _link(words, must), *rest) for said, words, must, *rest in phrases)


# Compiled: phrase, link, confidence, owned, reason. What follows up to the end of the sentence is the item.
ACTION_RULES, DECISION_RULES = _rules(ACTION_PHRASES), _rules(DECISION_PHRASES)
ITEM = "([^.!?]+)"

# Fixed values.
DUE_WORDS = ("this", "next"), ("week", "month")
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
MONTHS = "january february march april may june july august september october november december".split()
ORGANISATION_FORMS = "Corp Inc LLC Ltd Bank Group Financial Services Solutions Technologies Systems".split()
MAGNITUDES = ("million", "billion", "thousand")
TITLES = ("Mr", "Ms", "Mrs", "Dr", "Prof")

_NUMBER = "[0-9]+(?:[.][0-9]+)?"
_NAME = "[A-Z][a-z]+"
_MONTH_DAY = rf"{one_of(MONTHS)} [0-9]{{1,2}}(?:st|nd|rd|th)?(?:,? [0-9]{{4}})?"

# One rule per kind of entity; the whole match is the value.
ENTITY_PATTERNS = {
    # Names in a row, the last word a form of organisation.
    "organization": rf"\b{_NAME}(?: {_NAME})* {one_of(ORGANISATION_FORMS)}\b",
    # Two or more capitals; underscores may join further ones.
    "acronym": r"\b[A-Z]{2,}(?:_+[A-Z]+)*\b",
    # A dollar sign before a number, or the word behind a number with a magnitude.
    "dollars": rf"[$][0-9][0-9,]*(?:[.][0-9]+)?(?: ?(?i:{one_of(MAGNITUDES)}|k)\b)?|\b{_NUMBER} ?(?i:{one_of(MAGNITUDES)} dollars?)\b",
    # A number with the sign or the word.
    "percent": rf"\b{_NUMBER} ?(?:%|(?i:percent)\b)",
    # Month and day, perhaps a year; day, month and year in figures; quarter and year.
    "date": rf"\b(?i:{_MONTH_DAY})\b|\b[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}\b|\b[Qq][1-4] [0-9]{{4}}\b",
    # L or LN and at least four figures.
    "loan_id": r"\b[Ll][Nn]?[- ]?[0-9]{4,}\b",
    # Two to five capitals, a hyphen and at least three figures.
    "ticket": r"\b[A-Z]{2,5}-[0-9]{3,}\b",
    # A web scheme and what follows up to white space or a bracket.
    "url": r"\bhttps?://[^\s<>]+",
    # Anything but white space and separators around the sign, ending in a domain of letters.
    "email": r"[^\s@<>(),;:]+@[^\s@<>(),;:]+[.][A-Za-z]{2,}\b",
}
TITLED_PERSON = rf"\b{one_of(TITLES)}[.] {_NAME}(?: {_NAME})?\b"

# Tokens that may continue an entity begun by the token before.
CONTINUES_ENTITY = rf"^(?:[A-Z0-9$-]|(?i:{one_of(MAGNITUDES)}|k\b|dollar|percent))"

# Words that, standing behind a name after "this is", show that it only points at something.
POINTING = ("the", "a", "an")

# Capitalised words after "this is" that are no names. Fixed values.
NOT_NAMES = (
    "The This That There It So Just Actually Basically Also Well Okay Ok Right Sure Yes No Great Good Fine "
    + " ".join(d.capitalize() for d in WEEKDAYS)
    + " "
    + " ".join(m.capitalize() for m in MONTHS)
).split()

# Word rules: replacement, pattern of the single word, pattern to find in the words around it.
CONTEXT_RULES = (
    ("Friday EOD", r"(?i)^friday\.?$", r"(?i)\breport\b"),
    ("programme", r"(?i)^plan\.?$", r"(?i)\bdecided\b"),
    ("SKU", r"^item\.?$", r"(?i)\b(?:cost|price)\b"),
)
