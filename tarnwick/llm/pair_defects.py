"""Broken prompt and response pairs, by ordered rules."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.arrow import bounded
from tarnwick.session import cut_lineage

#: In order: of several defects of one pair the first is the leading one.
DEFECTS = ("empty", "copied_question", "refusal", "other_language", "truncated")

# Word lists by language
COMMON = {
    "en": "the of and to is are was were be been has have had it its that this which with for from at by on not no an if when where before after under each every both who what how may must shall should into than then they there he she we you i",
    "de": "der die das den dem des und ist sind war wird werden wurde wurden nicht kein keine ein eine einen einem einer mit von zu zum zur auf aus bei nach vor für ohne wenn sobald dass wie wer was warum oder auch sich wieder dies unter darf dürfen muss müssen länger als in",
    "fr": "le la les un une des du de et est sont était été être a ont il elle on ne pas que qui quand comment pour par avec sans sur sous dans au aux ce cette ces se si dès après avant plus faut doit peut puis je nous vous",
    "es": "el la los las un una unos unas del de y es son era fue ser ha han se no que quien cuando cómo para por con sin sobre según en al este esta estos si después antes más hay debe deben puede cada cuánto otra vez lo le",
    "it": "il lo gli un una di del della delle e è sono era essere ha hanno si non che chi quando come per con senza su sotto nel nella al alla questo questa se dopo prima più deve può ogni",
    "pt": "o os as um uma do da dos das e é são era foi ser tem não que quem quando como para por com sem sobre em no na ao à este esta se depois antes mais deve pode cada essa esse isso meu minha você",
    "nl": "het een van en is zijn was werd worden niet geen met voor op bij naar uit zonder als wanneer dat wie wat hoe of ook zich weer onder mag moet langer dan ik wij kan kunnen deze dit heb hebben",
}
DANGLING = (
    "a an the of to in on at by for with from and or but nor as than that which who whose where when while because if although though unless until before after under over into is are was were be been being has have had "
    "not no this these those its their his her our your very more most such per via should shall must may might can could would will "
    "der die das den dem des ein eine einen einem einer und oder aber weil wenn dass ob als von zum zur für ohne im vom gegen zwischen sowie "
    "le la les un une des du de et ou mais parce que qui quand si dans sur sous par pour avec sans au aux est sont ne se ce cette "
    "el los las unos unas del y o pero porque como cuando donde en con sin por para al es son se su sus lo"
)
#: What one declines to do, in English.
SPEAK = (
    "help answer respond reply assist provide share discuss comment say tell give disclose reveal offer talk speak fulfil fulfill comply find know confirm advise explain state "
    "determine locate support supply serve meet handle process address cover judge verify hand do have"
)
DONE = "answered given provided shared disclosed revealed discussed fulfilled met handled processed supplied offered confirmed found determined met told said released"
#: By language: how someone refuses in the first person, or says that nothing can be said. {speak} and {done} stand for the words above.
REFUSALS = {
    "en": (
        r"\b(?:i|we)(?: \w+){0,2}? ?(?:can ?not|can't|could not|couldn't|won't|will not|would not|wouldn't|may not|must not|do not|don't|did not|didn't|am not|are not|'m not|'re not|not able|unable)(?: \w+){0,4}? (?:{speak})\b",
        r"\b(?:unable|impossible|not possible|not able|not permitted|not allowed|forbidden|prohibited)(?: for (?:me|us))? to (?:{speak})\b",
        r"\b(?:not permitted|not allowed|not possible|forbidden|impossible) for (?:me|us)\b",
        r"\b(?:request|question|query|answer|reply|information|topic|subject|matter|this|that)(?: \w+){0,4}? (?:can ?not|can't|could not|couldn't|may not|must not|will not|won't) be (?:{done})\b",
        r"\bno (?:answer|reply|response|information)(?: \w+){0,2}? (?:can|could|may|will|is|was) (?:be )?(?:{done}|possible|available)\b",
        r"\b(?:hence|thus|so|therefore),? (?:no (?:reply|answer|response)|(?:i|we) (?:can ?not|can't|won't))\b",
        r"\b(?:i|we)(?:'ll|'d)?(?: (?:will|would|must|should|have to|need to|shall|had|am going to|are going to|respectfully|therefore|thus))* (?:decline|refuse|abstain|pass|skip|rather not|prefer not)\b",
        r"\b(?:topic|subject|matter|question|area)(?: that| which)? (?:i|we) (?:leave|avoid|skip|keep out|stay out|stay away|steer clear|do not|don't|can ?not|can't|won't|will not|may not|must not)\b",
        r"\b(?:i|we)(?: \w+)? (?:lack|miss|have no|have not|haven't|have neither|am without|are without)\b.*\b(?:access|permission|information|authority|evidence|data|sources?|knowledge|material|answer|means|right|clearance)\b",
        r"\b(?:beyond|outside)(?: of)? (?:my|our|what (?:i|we))\b",
        r"\b(?:instructions|rules|guidelines|policy|policies|settings|orders|restrictions)(?: \w+){0,3}? (?:keep|prevent|stop|forbid|prohibit|bar|block|do not allow|don't allow|do not let|don't let)s?\b",
        r"\bnothing (?:in|on|among|from)? ?(?:my|our|i|we|that i|that we)\b",
        r"\bdo(?:es)? not (?:say|contain|mention|tell|hold|show|give) anything\b",
        r"\b(?:withheld|hidden|closed|barred|kept) (?:off|from) (?:me|us)\b",
        r"\b(?:withheld|hidden) from\b",
        r"\blet(?:'s| us) not (?:{speak}|go|get|enter|touch|open)?\b",
        r"\bas an? (?:ai|assistant|language model|chatbot|bot),? (?:i|we)\b",
    ),
    "de": (
        r"\b(?:kann|können|darf|dürfen|möchte|möchten|will|wollen|werde|werden) (?:ich|wir)\b.*\b(?:nicht|keine?[nrm]?|nichts)\b",
        r"\b(?:ich|wir) (?:kann|können|darf|dürfen|möchte|möchten|will|wollen|werde|werden|habe|haben|weiß|wissen|finde|finden)\b.*\b(?:nicht|keine?[nrm]?|nichts)\b",
        r"\b(?:liegen|liegt|ist|sind) (?:mir|uns)\b.*\b(?:keine?[nrm]?|nicht|unmöglich|untersagt|verboten)\b",
        r"\b(?:keine auskunft|muss (?:ich|wir) ablehnen|(?:ich|wir) (?:lehne|lehnen|muss|müssen|verweigere|verweigern)\b.*\b(?:ab|ablehnen|antwort|auskunft))\b",
    ),
    "fr": (
        r"\b(?:je|nous) (?:ne |n')(?:\w+ )?(?:peux|pouvons|puis|pourrais|pourrai|suis|sommes|dois|devons|veux|voulons|sais|savons|dispose|disposons|ai|avons|trouve|trouvons|souhaite)\b.*\b(?:pas|répondre|aucune?|rien|point)\b",
        r"\b(?:m'|nous )(?:est|a été) (?:impossible|interdit|défendu)\b",
        r"\b(?:je|nous) (?:refuse|refusons|dois refuser|devons refuser|m'abstiens|regrette de ne)\b",
        r"\bne (?:disent|dit|contiennent|contient|donnent|donne|précisent|précise) rien\b",
    ),
    "es": (
        r"\bno (?:puedo|podemos|podré|podría|soy capaz|somos capaces|debo|debemos|quiero|tengo|tenemos|dispongo|disponemos|cuento|contamos|sé|sabemos|encuentro|encontramos|estoy autorizad[oa])\b",
        r"\b(?:no (?:me|nos) (?:es|está|resulta|ha sido) (?:posible|permitido)|(?:me|nos) (?:es imposible|está prohibido|resulta imposible|niego|negamos))\b",
        r"\bno hay (?:datos|información|pruebas|fuentes|respuesta) para\b",
    ),
    "it": (
        r"\bnon (?:posso|possiamo|potrei|sono in grado|siamo in grado|sono autorizzat[oa]|ho|abbiamo|dispongo|disponiamo|so|sappiamo|trovo|troviamo|voglio|devo|dobbiamo)\b",
        r"\b(?:non (?:mi|ci) è (?:possibile|permesso|consentito)|(?:mi|ci) è (?:impossibile|vietato)|(?:mi rifiuto|devo rifiutare|ci rifiutiamo))\b",
    ),
    "pt": (
        r"\bnão (?:posso|podemos|poderei|consigo|conseguimos|sou capaz|somos capazes|estou autorizad[oa]|tenho|temos|disponho|dispomos|sei|sabemos|encontro|encontramos|devo|devemos|quero)\b",
        r"\b(?:não (?:me|nos) é (?:possível|permitido)|(?:me|nos) é (?:impossível|proibido)|recuso-me|tenho de recusar)\b",
    ),
    "nl": (
        r"\b(?:ik|wij|we) (?:kan|kunnen|mag|mogen|wil|willen|zal|zullen|heb|hebben|weet|weten|vind)\b.*\b(?:niet|geen|niets)\b",
        r"\b(?:kan|kunnen|mag|mogen|wil|willen|zal|zullen|heb|hebben) (?:ik|wij|we)\b.*\b(?:niet|geen|niets)\b",
    ),
    "pl": (r"\bnie (?:mogę|możemy|jestem w stanie|jesteśmy w stanie|wolno mi|mam (?:dostępu|informacji|prawa|danych)|posiadam|wiem|wiemy)\b", r"\b(?:odmawiam|odmawiamy|muszę odmówić)\b"),
    "tr": (r"\b(?:cevap|yanıt|yardım|bilgi)\w*\b.*\b\w*(?:emem|amam|emiyorum|amıyorum|emeyiz|amayız|emiyoruz|amıyoruz)\b",),
    "ru": (r"\bне (?:могу|можем|смогу|сможем|в состоянии|вправе|имею|имеем|располагаю|располагаем|буду|знаю|знаем)\b", r"\b(?:отказываюсь|вынужден[аы]? отказать|у (?:меня|нас) нет)\b"),
    "uk": (r"\bне (?:можу|можемо|зможу|зможемо|маю|маємо|вправі|знаю|знаємо)\b",),
    "el": (r"\bδεν (?:μπορώ|μπορούμε|είμαι σε θέση|έχω|έχουμε|γνωρίζω|επιτρέπεται)\b",),
    "ar": (r"(?:لا (?:أستطيع|يمكنني|أقدر|يمكننا|نستطيع|أملك|نملك|أعرف)|لست قادر|أعتذر عن|ليس (?:لدي|لدينا))",),
    "he": (r"(?:(?:אני|אנחנו) לא (?:יכול|יכולה|יכולים|יודע|יודעת)|אין (?:לי|באפשרותי))",),
    "hi": (r"(?:मैं|हम).*(?:नहीं).*(?:सकता|सकती|सकते|जानता|जानती)",),
    "zh": (r"(?:无法|無法|不能|不便|没有办法|沒有辦法|不可以|拒绝|拒絕)(?:为您|為您|给您|給您|向您|对此|對此)?(?:回答|提供|协助|協助|帮助|幫助|透露|讨论|討論|告诉|告訴|说明|說明|满足|滿足)",),
    "ja": (r"(?:お答え|回答|提供|お手伝い|開示|ご案内)(?:すること)?(?:は|が)?(?:でき(?:ません|ない|かねます)|(?:致|いた)しかねます|しかねます)",),
    "ko": (r"(?:답변|대답|제공|도와|알려)\S*\s*(?:드릴\s*)?수(?:가|는)?\s*없",),
}
#: Words without which no pattern of a Latin script can match; a sentence without them is not searched.
REFUSAL_CUES = (
    "not cannot can't couldn't won't wouldn't don't didn't haven't unable impossible forbidden prohibited no decline refuse abstain pass skip rather prefer topic subject matter question area "
    "lack miss without neither beyond outside instructions rules guidelines policy policies settings orders restrictions nothing anything withheld hidden closed barred kept let as hence thus so therefore "
    "nicht kein keine keinen keiner keinem nichts unmöglich untersagt verboten ablehnen lehne lehnen verweigere verweigern ne n'ai n'avons interdit défendu refuse refusons refuser abstiens regrette m'abstiens "
    "niego negamos imposible prohibido non impossibile vietato rifiuto rifiutare rifiutiamo não impossível proibido recuso recusar niet geen niets nie odmawiam odmawiamy odmówić cevap yanıt yardım bilgi"
)
FILLERS = (
    r"^(thank you|thanks)\b",
    r"\banything else\b",
    r"^(you may|please|you can|kindly) (contact|ask|try|rephrase|see)\b",
    r"^try (another|again|a different)\b",
    r"\bis of use\b",
    r"^(i am |i'm )?(very )?(sorry|unfortunately)\W*$",
    r"^(es tut mir leid|leider|désolé|je regrette|lo siento|por desgracia)\W*$",
)
LABELS = r"\b(answer|response|reply|result|sources?|references?|antwort|quellen?|réponse|respuesta|fuentes?|n/?a|null|none|nil|nan|undefined|no (content|answer|response|data|text|result)|empty|tbd|todo|placeholder|text|br|p)\b"
CITATION = r"\[S?\d+(\s*,\s*S?\d+)*\]"
CODE = r"[A-Z]{2}-\d+(/[A-Z])?"

INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad\x00]")
TAG = re.compile(r"<[^<>]{0,40}>")
CITED = re.compile(CITATION)
LISTED = re.compile(rf"(?is)\b(sources?|quellen|fuentes|références)\s*:\s*({CODE}[\s,;]*)*$")
UNSAID = re.compile(rf"(?:[\W_]|{LABELS})*", re.I)
WORD = re.compile(r"[^\W\d_]+")
BEYOND_LATIN = re.compile("[^\\W\\d_\\u0000-\\u024f]")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORDS = {"{speak}": "|".join(SPEAK.split()), "{done}": "|".join(DONE.split())}
REFUSING = re.compile("|".join(f"(?:{p})" for known in REFUSALS.values() for p in known).replace("{speak}", _WORDS["{speak}"]).replace("{done}", _WORDS["{done}"]))
CUE = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CUES = frozenset(REFUSAL_CUES.split())
FILLING = re.compile("|".join(f"(?:{p})" for p in FILLERS), re.I)
LONG = re.compile(r"([^\W\d_]+\W+){4}[^\W\d_]+")
FINAL_WORD = re.compile(r"([^\W_][\w'’/-]*)[\s\"'”»)*]*[.!?]+[\s\"'”»)*]*$")
ENDED = re.compile(r"[.!?…。！？][\"'”»)\]*_]*$")
OPENING = re.compile(r"^(pls|please|urgent|hi|hello|question|bitte|svp|porfavor)+")
ECHO = re.compile(r"^(question|answer|q|a|pls|please|urgent|frage|antwort|réponse|pregunta|respuesta)*$")
TAIL = re.compile(r"(?s)^(?:.*(?:[.!?…][\"'”»)\]*]*\s+|\n))?(.*)$")
NUMBER_ONLY = re.compile(r"^\d{1,3}[.)]?\s*$")
LAST = re.compile(r"([^\W_][\w'’/-]*)\W*$")
BARE_MARK = re.compile(r"(?:^|\n)\s*(?:\d{1,3}[.)]|[-*•])\s*$")
ITEM = re.compile(r"^(?:[-*•]|\(?\w{1,3}[.)])\s")
HANGING = re.compile(r"[,;:(\[{–—-]$")
NAMED = re.compile(rf"^({CODE}|\d+|[A-ZÀ-Þ\d/-]+)$")
_COMMON = {w: tuple(x for x, known in COMMON.items() if w in known.split()) for w in {w for known in COMMON.values() for w in known.split()}}
_DANGLING = frozenset(DANGLING.split())
_TURKISH = frozenset(("cevap", "cevab", "yanıt", "yardı", "bilgi"))


def _bare(text: str) -> str:
    return re.sub(r"[\W_]+", "", text).lower()


def language(words: list[str]) -> tuple[str | None, dict[str, int]]:
    """The language with the most common words, none where two have as many; and the count of each."""
    hits = dict.fromkeys(COMMON, 0)
    for word in words:
        for x in _COMMON.get(word, ()):
            hits[x] += 1
    first, second = sorted(hits.values(), reverse=True)[:2]
    return (max(hits, key=hits.__getitem__) if first > second else None), hits


def script(text: str) -> str | None:
    """The script of more than half of the letters, as its first word in their Unicode names."""
    if not BEYOND_LATIN.search(text):
        return "LATIN" if WORD.search(text) else None
    letters = [c for c in text if c.isalpha()]
    counts: dict[str, int] = {}
    for c in letters:
        name = unicodedata.name(c, "?").split(" ")[0]
        counts[name] = counts.get(name, 0) + 1
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] * 2 > len(letters) else None


def _refuses(sentences: list[str]) -> bool:
    """Some sentence refuses, and none answers: the rest are courtesies or short."""
    found = False
    for sentence in sentences:
        low = sentence.lower().replace("’", "'")
        cued = any(w in _CUES or w[:5] in _TURKISH for w in CUE.findall(low)) or BEYOND_LATIN.search(low)
        if cued and REFUSING.search(" ".join(low.replace(",", " ").split())):
            found = True
        elif LONG.search(sentence) and not FILLING.search(sentence):
            return False
    return found


def _foreign(q: str, text: str) -> bool:
    """Most common words of the answer are another language's than the question's, or its letters are of another script."""
    (asked, _), (said, hits) = language(WORD.findall(q.lower())), language(WORD.findall(text.lower()))
    if asked is not None and said is not None and asked != said and hits[said] >= 2 and hits[said] > 2 * hits[asked]:
        return True
    a, b = script(q), script(text)
    return a is not None and b is not None and a != b


def _breaks_off(text: str, r: str, sentences: list[str], copied: bool) -> tuple[bool, str | None]:
    """Whether the answer ends unfinished; or the word that decides it, by where sentences end."""
    tail = TAIL.match(text).group(1).strip()
    if NUMBER_ONLY.match(tail):
        tail = text
    match = LAST.search(tail)
    raw = match.group(1) if match else ""
    opened = sum(map(tail.count, "([{")) > sum(map(tail.count, ")]}"))
    if opened or r.count("```") % 2 or BARE_MARK.search(text):
        return True, None
    if ENDED.search(text):
        return False, None
    if HANGING.search(tail) or raw.lower() in _DANGLING:
        return True, None
    if copied:
        return False, None  # a question has no full stop
    if ITEM.match(tail):
        return False, None if NAMED.match(raw) else raw.lower()
    if len(sentences) <= 1 and len(WORD.findall(tail)) <= 8:
        return False, None  # a value, a name
    return True, None


def judge(question: str, response: str | None) -> tuple[list[str], str | None, set[str]]:
    """Every defect of a pair, in the order of DEFECTS; the last word where it decides, by where sentences end, about `truncated`;
    and the words at which the response's own sentences end.

    The rules do not shut each other out. Only of a response in which nothing is said there is nothing else to be said,
    but that a code fence is left open in it.
    """
    q, r = INVISIBLE.sub("", question), INVISIBLE.sub("", response or "")
    text = LISTED.sub(" ", TAG.sub(" ", CITED.sub(" ", r) if "[" in r else r) if "<" in r else CITED.sub(" ", r)).strip()
    if UNSAID.match(text).end() == len(text):
        return ["empty", "truncated"] if r.count("```") % 2 else ["empty"], None, set()
    nq, nr = _bare(q), _bare(text)
    own = OPENING.sub("", nq)
    copied = bool(own) and own in nr and bool(ECHO.match(nr.replace(nq, "").replace(own, "")))
    sentences = [s for s in SENTENCE.split(" ".join(text.split())) if s]
    broken, word = _breaks_off(text, r, sentences, copied)
    rules = (copied, not copied and _refuses(sentences), not copied and _foreign(q, text), broken)
    ends = {m.group(1).lower() for m in map(FINAL_WORD.search, (s[-60:] for s in sentences)) if m}
    return [name for name, hit in zip(DEFECTS[1:], rules) if hit], word, ends


def pair_defects(df: DataFrame, key: str, question: str, response: str, delivered: str | None = None) -> DataFrame:
    """Every defect that a pair shows: (key, defect, place), place 1 being the leading defect.

    Rules, in order: `empty` (nothing but marks, labels, citations, placeholders; null), `copied_question`,
    `refusal` (a refusing sentence and no other than courtesies), `other_language` (another script, or
    most common words from another language), `truncated` (an unclosed bracket, a dangling word or mark, or an
    end that is neither a sentence's nor a value's; of a list item: a last word at which no sentence of this
    table ends). Every rule that applies gives its row. A copied question is neither a refusal nor in another language, and
    lacks no full stop. An error message beside the pair is no defect, and is not read. Pairs without a question (null) are no pairs and give no rows. Of repeated keys the last by
    `delivered` counts, of equal ones the greatest. Null keys are left out. Other columns, whatever their names,
    are ignored; empty tables give an empty result. Whole texts are read, through compiled rules in Arrow batches;
    the words at which sentences end are counted over all rows.
    """
    at = F.coalesce(F.col(delivered), F.lit("0001-01-01").cast("timestamp")) if delivered else F.lit(0)
    rows = df.select(F.col(key).alias("id"), F.col(question).cast("string").alias("question"), F.col(response).cast("string").alias("response"), at.alias("at"))
    rows = rows.filter("id IS NOT NULL AND question IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for half in bounded(batches, "response") for piece in bounded([half], "question")):
            found, words, ends = [], [], []
            for q, r in zip(batch.column("question").to_pylist(), batch.column("response").to_pylist()):
                defects, word, last = judge(q, r)
                found.append(defects)
                words.append(word)
                ends.append(list(last))
            columns = [batch.column("id"), batch.column("at"), pa.array(found, pa.list_(pa.string())), pa.array(words, pa.string()), pa.array(ends, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "at", "defects", "word", "ends"])

    at_kind = rows.schema["at"].dataType.simpleString()
    judged = rows.mapInArrow(run, f"id {kind}, at {at_kind}, defects array<string>, word string, ends array<string>")
    judged = cut_lineage(judged)  # texts are judged once; both uses below read what was found
    best = F.max(F.struct("at", "defects", "word")).alias("best")
    pairs = judged.groupBy("id").agg(best).select("id", "best.defects", "best.word")
    ends = judged.select(F.explode("ends").alias("word")).distinct().withColumn("is_end", F.lit(True))
    broken = F.col("word").isNotNull() & F.col("is_end").isNull()
    # Only pairs that need it are joined: a hot word of theirs meets one row.
    asked = pairs.filter("word IS NOT NULL").join(ends, "word", "left")
    listed = asked.select("id", F.when(broken, F.concat("defects", F.array(F.lit("truncated")))).otherwise(F.col("defects")).alias("defects"))
    listed = listed.unionByName(pairs.filter("word IS NULL").select("id", "defects"))
    out = listed.select("id", F.posexplode("defects").alias("at", "defect"))
    return out.select(F.col("id").alias(key), "defect", (F.col("at") + 1).alias("place"))
