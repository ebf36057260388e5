"""Fixed values of the analysers: word lists and suffix rules."""

from __future__ import annotations

from dataclasses import dataclass

STOP_V5 = (
    "a an and are as at be by can could do does for from how if in is it of on or should that the this to was were what when where which who why with would please tell give"
).split()
STOP_SMART = STOP_V5
STOP_BM25 = "a an and are as at be by for from how i in is it of on or pdf that the this to was were what when where which who why with".split()
LOW_SIGNAL = (
    "amount case different various accident metro system person people given give much applicable detail details information full form meaning mean define definition expand expansion"
).split()
ROUTE_NOISE = (
    "the and for with from this that what when where which how are is in on of to a an or by as be do does can could should please tell give provide show explain find if document documents docs information info"
).split()
VALUE_DIMENSIONS = (
    "amount compensation claim payable payment price cost fee rate limit maximum minimum speed pressure voltage current temperature time duration distance weight capacity quantity "
    "number count frequency height length width clearance allowance penalty fine threshold value range"
).split()
MONEY = "compensation claim payable payment".split()
STRUCTURED_CUES = "different various each every types categories classes cases conditions modes injuries items table schedule list".split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


@dataclass(frozen=True)
class Suffix:
    """If a word is longer than `longer`, ends in one of `ends` and in none of `unless`: drop `drop` letters, add `add`."""

    longer: int
    ends: tuple[str, ...]
    drop: int
    add: str = ""
    unless: tuple[str, ...] = ()


_PLURAL = Suffix(3, ("s",), 1, "", ("ss", "us", "is"))
STEM_V5 = (Suffix(6, ("ing",), 3), Suffix(5, ("ed",), 2), Suffix(4, ("ies",), 3, "y"), _PLURAL)
STEM_SMART = (Suffix(6, ("ing",), 3), Suffix(5, ("ed",), 2, "", ("eed",)), Suffix(4, ("ies",), 3, "y"), _PLURAL)
SINGULAR = (Suffix(4, ("ies",), 3, "y"), Suffix(3, ("sses", "shes", "ches", "xes", "zes"), 2), _PLURAL)
#: Of the route stemmer the first three rules end it; the others are followed by the loss of a final e.
STEM_ROUTE_LONG = (Suffix(7, ("ation",), 5), Suffix(6, ("tion",), 3), Suffix(6, ("ment",), 4))
STEM_ROUTE_SHORT = (Suffix(5, ("ing",), 3), Suffix(4, ("ed",), 2, "", ("eed",)), Suffix(4, ("ies",), 3, "y"), _PLURAL)

# Cues by which a question is understood
QUESTION_STARTS = ("can ", "could ", "do ", "does ", "explain ", "how ", "is ", "should ", "tell me ", "what ", "when ", "where ", "which ", "who ", "why ")
FOLLOWUP_STARTS = ("and ", "also ", "how about ", "same for ", "what about ", "what if ")
POINTING = "it that this same those them they there these".split()
REFERENCE_ACTIONS = "find mention mentioned mentions occurrence occurrences reference references search".split()
ANSWER_CUES = (
    "allowed amount capacity condition conditions date distance duration explain frequency height information info item items equipment equipments contents content carry carried keep kept possession required "
    "instruction instructions length limit limits maximum minimum number policy pressure procedure prohibited requirement requirements rule rules speed step steps temperature time timing value voltage weight"
).split()
ENUMERATION = "categories classes forms kinds methods modes types ways".split()
GOODS = "content contents equipment equipments item items inventory inventories things".split()
LIST_DIMENSIONS = [*GOODS, "document", "documents", *ENUMERATION]
LIST_RELATIONS = "carry carried contain contained contains have include included includes keep kept possession required".split()
SYNTHESIS_INTENTS = "comparison list procedure requirement summary troubleshooting".split()
REQUEST_VERBS = "clarify describe explain give list provide show summarize tell".split()
LEANING = "above applicable detail details general more previous procedure same then".split()
FOCUS_STOP = (
    "a about all an and are as at be by can could do does for from give how i in is it me of on or please provide applicable general then should that the this to was were what when where which who why with would"
).split()
REFERENCES = ["document", "documents", "docs", *REFERENCE_ACTIONS]
PROCEDURE_WORDS = "procedure procedures sop instruction instructions operation operating isolation reset inspection maintenance troubleshooting fault failure emergency evacuation recovery test check checks".split()
STOCK_WORDS = ("rolling stock", "train type", "trainset", "train set", "metro train", "emu", "dmrc", "rs", "vehicle type", "coach", "car")
