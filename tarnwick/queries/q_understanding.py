"""What a question asks for, by its words alone: mode, completeness, need of history, safety of rewrites, anchors."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions import words as W
from tarnwick.queries import registry_sql as S
from tarnwick.queries.registry import query
from tarnwick.sources import corpus as C

c = F.col
TOKEN = "[a-z0-9]+(?:[._/:#-][a-z0-9]+)*"


# The same rules twice: as columns, and as SQL.
def _has(words) -> Column:
    return F.arrays_overlap("terms", T.literal_array(list(words)))


def _left(*lists) -> Column:
    """Terms that are in none of the lists."""
    known = sorted({w for x in lists for w in x})
    return F.size(F.filter("terms", lambda t: ~t.isin(known)))


def _starts(starts) -> Column:
    found = F.lit(False)
    for s in starts:
        found = found | F.startswith(c("q"), F.lit(s))
    return found


def _sql_has(words) -> str:
    return f"list_has_any(terms, {S.listed(list(words))})"


def _sql_left(*lists) -> str:
    known = sorted({w for x in lists for w in x})
    return f"len(list_filter(terms, lambda t: NOT list_contains({S.listed(known)}, t)))"


def _sql_starts(starts) -> str:
    return "(" + " OR ".join(f"starts_with(q, '{s}')" for s in starts) + ")"


SUBJECT = (W.LIST_DIMENSIONS, W.LIST_RELATIONS, W.ANSWER_CUES, W.FOCUS_STOP, W.REQUEST_VERBS)
OF_KIND = " (" + "|".join(w if w.endswith("ies") else w[:-1] + "s?" for w in W.ENUMERATION) + ") of [a-z0-9]"
OF_PAPERS = " documents? (of|in|inside|for|with|carried|kept) "
BASE_SQL = f"base AS (SELECT qid, question, coalesce(intent, 'fact_lookup') AS intent, lower(trim(question)) AS q, {S.tokens('question', TOKEN)} AS seq, list_distinct({S.tokens('question', TOKEN)}) AS terms FROM query_plans)"
LIST_SQL = f"""listed AS (SELECT *, ({_sql_starts(("what is in ", "what are in "))} AND {_sql_left(W.FOCUS_STOP)} > 0) OR ({_sql_has(W.LIST_DIMENSIONS)} AND CASE WHEN {_sql_has(W.ENUMERATION)} THEN {_sql_left(*SUBJECT)} > 0 OR regexp_matches(' ' || array_to_string(seq, ' '), '{OF_KIND}')
 WHEN ({_sql_has(W.LIST_RELATIONS)} OR {_sql_has(W.GOODS)}) AND len(terms) >= 2 THEN {_sql_left(*SUBJECT)} > 0 ELSE {_sql_left(*SUBJECT)} > 0 AND ({_sql_has(W.GOODS)} OR regexp_matches(' ' || array_to_string(seq, ' ') || ' ', '{OF_PAPERS}')) END) AS is_list FROM base)"""


def _questions(spark, d):
    seq = T.tokens(c("question"), TOKEN)
    rows = C.plans(spark, d).select("qid", "question", F.coalesce("intent", F.lit("fact_lookup")).alias("intent"), F.lower(F.trim("question")).alias("q"), seq.alias("seq"), F.array_distinct(seq).alias("terms"))
    line = F.concat(F.lit(" "), F.array_join("seq", " "), F.lit(" "))
    subject = _left(*SUBJECT) > 0
    by_kind = F.when(_has(W.ENUMERATION), subject | line.rlike(OF_KIND)).when((_has(W.LIST_RELATIONS) | _has(W.GOODS)) & (F.size("terms") >= 2), subject).otherwise(subject & (_has(W.GOODS) | line.rlike(OF_PAPERS)))
    return rows.withColumn("is_list", (_starts(("what is in ", "what are in ")) & (_left(W.FOCUS_STOP) > 0)) | (_has(W.LIST_DIMENSIONS) & by_kind))


@query("q18_list_request", "Q18", sql=f"WITH {BASE_SQL}, {LIST_SQL} SELECT qid, is_list FROM listed")
def q18_list_request(spark, d):
    return _questions(spark, d).select("qid", "is_list")


GENERIC = (W.FOCUS_STOP, W.REQUEST_VERBS, W.LEANING)


@query("q2_search_mode", "Q2", sql=f"""WITH {BASE_SQL}, {LIST_SQL}
SELECT qid, CASE WHEN {_sql_has(W.REFERENCE_ACTIONS)} THEN 'references' WHEN question LIKE '%?' OR {_sql_starts(W.QUESTION_STARTS)} OR is_list THEN 'answer'
 WHEN intent = 'list' AND {_sql_left(*GENERIC, W.LIST_DIMENSIONS, W.LIST_RELATIONS, ["list"])} > 0 THEN 'answer'
 WHEN intent IN ('procedure', 'requirement', 'summary') AND {_sql_left(*GENERIC, W.ANSWER_CUES)} > 0 THEN 'answer'
 WHEN intent IN ('comparison', 'troubleshooting') AND {_sql_left(*GENERIC)} > 0 THEN 'answer'
 WHEN intent = 'definition' AND {_sql_has(["define", "definition"])} THEN 'answer'
 WHEN {_sql_has(W.ANSWER_CUES)} THEN 'answer' WHEN len(terms) = 0 THEN 'references' WHEN {_sql_starts(W.FOLLOWUP_STARTS)} OR list_contains({S.listed(W.REQUEST_VERBS)}, seq[1]) THEN 'answer'
 WHEN {_sql_has(W.REFERENCES)} THEN CASE WHEN {_sql_left(W.REFERENCES, W.FOCUS_STOP)} <= 2 THEN 'references' ELSE 'answer' END WHEN {_sql_left(*GENERIC)} <= 2 THEN 'references' ELSE 'answer' END AS mode FROM listed""")
def q2_search_mode(spark, d):
    """References only for wording that navigates, or for a bare name of one or two words; else an answer."""
    intent = c("intent")
    concrete = (
        F.when(intent == "list", _left(*GENERIC, W.LIST_DIMENSIONS, W.LIST_RELATIONS, ["list"]) > 0)
        .when(intent.isin("procedure", "requirement", "summary"), _left(*GENERIC, W.ANSWER_CUES) > 0)
        .when(intent.isin("comparison", "troubleshooting"), _left(*GENERIC) > 0)
        .otherwise((intent == "definition") & _has(["define", "definition"]))
    )
    asked = F.endswith("question", F.lit("?")) | _starts(W.QUESTION_STARTS) | c("is_list")
    few = F.when(_has(W.REFERENCES), _left(W.REFERENCES, W.FOCUS_STOP) <= 2).otherwise(_left(*GENERIC) <= 2)
    leans = _starts(W.FOLLOWUP_STARTS) | F.coalesce(F.get("seq", F.lit(0)).isin(W.REQUEST_VERBS), F.lit(False))
    answer = asked | concrete | _has(W.ANSWER_CUES)
    mode = F.when(_has(W.REFERENCE_ACTIONS), "references").when(answer, "answer").when(F.size("terms") == 0, "references").when(leans, "answer").when(few, "references").otherwise("answer")
    return _questions(spark, d).select("qid", mode.alias("mode"))


@query("q11_history_need", "Q11", sql=f"""WITH {S.AUDIT}, base AS (SELECT id, question, lower(trim(question)) AS q, {S.tokens('question', TOKEN)} AS terms FROM audit WHERE question IS NOT NULL)
SELECT id, CASE WHEN {_sql_starts(W.FOLLOWUP_STARTS)} OR {_sql_has(W.POINTING)} THEN true WHEN ({_sql_starts(W.QUESTION_STARTS)} AND len(terms) <= 8) OR (list_contains({S.listed(W.REQUEST_VERBS)}, terms[1]) AND len(terms) <= 9)
 THEN {_sql_left(W.FOCUS_STOP, W.ANSWER_CUES, W.REQUEST_VERBS, W.LEANING, ["tell", "regarding"])} = 0 ELSE false END AS needs FROM base""")
def q11_history_need(spark, d):
    """A question that points back, or names nothing of its own."""
    rows = C.audit(spark, d).filter("question IS NOT NULL").select("id", F.lower(F.trim("question")).alias("q"), T.tokens(c("question"), TOKEN).alias("terms"))
    short = (_starts(W.QUESTION_STARTS) & (F.size("terms") <= 8)) | (F.coalesce(F.get("terms", F.lit(0)).isin(W.REQUEST_VERBS), F.lit(False)) & (F.size("terms") <= 9))
    bare = _left(W.FOCUS_STOP, W.ANSWER_CUES, W.REQUEST_VERBS, W.LEANING, ["tell", "regarding"]) == 0
    return rows.select("id", F.when(_starts(W.FOLLOWUP_STARTS) | _has(W.POINTING), True).when(short, bare).otherwise(False).alias("needs"))


CONDITIONS = " (if|when|unless|in case of|in the event of|after|during) "
ACTIONS = " (do|done|action|actions|act|proceed|procedure|steps|handle|handled|operate|happens) "
ENUMERATE = " (list|all|which|what are) .*(types|kinds|modes|categories|items|steps|classes) "
DEFINE = " (define|definition|meaning|full form|stands for|what is meant by) "
SCOPED = " (line|rs)[- ]?[0-9]+ "


@query("q4_completeness", "Q4", sql=f"""WITH {BASE_SQL}, l AS (SELECT *, ' ' || array_to_string(seq, ' ') || ' ' AS line FROM base)
SELECT qid, CASE WHEN (regexp_matches(line, '{CONDITIONS}') AND regexp_matches(line, '{ACTIONS}')) OR intent IN ('procedure', 'troubleshooting', 'requirement') OR (intent = 'comparison' AND (regexp_matches(line, '{SCOPED}') OR regexp_matches(line, '{ACTIONS}'))) THEN 'cross_scope_procedure'
 WHEN intent = 'definition' OR regexp_matches(line, '{DEFINE}') THEN 'definition_enumeration' WHEN intent = 'list' OR regexp_matches(line, '{ENUMERATE}') THEN 'entity_enumeration' ELSE 'direct_lookup' END AS policy FROM l""")
def q4_completeness(spark, d):
    """How complete the evidence has to be: conditions come first, then definitions, lists and single facts."""
    line, intent = F.concat(F.lit(" "), F.array_join("seq", " "), F.lit(" ")), c("intent")
    crossing = (line.rlike(CONDITIONS) & line.rlike(ACTIONS)) | intent.isin("procedure", "troubleshooting", "requirement") | ((intent == "comparison") & (line.rlike(SCOPED) | line.rlike(ACTIONS)))
    policy = F.when(crossing, "cross_scope_procedure").when((intent == "definition") | line.rlike(DEFINE), "definition_enumeration").when((intent == "list") | line.rlike(ENUMERATE), "entity_enumeration").otherwise("direct_lookup")
    return _questions(spark, d).select("qid", policy.alias("policy"))


_ANY = "[A-Za-z0-9]+(?:[._/:#-][A-Za-z0-9]+)*"
_PROTECTED = "list_filter(regexp_extract_all({0}, '" + _ANY + "'), lambda t: regexp_matches(t, '[A-Z]') AND upper(t) = t AND length(t) >= 2)"


@query("q16_rewrite_safety", "Q16", sql=f"""WITH v AS (SELECT qid, question, unnest(search_queries) AS variant FROM query_plans), t AS (SELECT *, {S.tokens('question', TOKEN)} AS known, regexp_extract_all(variant, '{_ANY}') AS said, {_PROTECTED.format('question')} AS kept FROM v WHERE variant IS NOT NULL),
n AS (SELECT *, list_distinct(list_filter(said, lambda x: NOT list_contains(known, lower(x)) AND NOT list_contains({S.listed(W.FOCUS_STOP)}, lower(x)))) AS fresh FROM t)
SELECT DISTINCT qid, variant, length(variant) BETWEEN 1 AND greatest(900, length(question) * 7) AND len(list_filter(kept, lambda p: NOT list_contains(list_transform(said, lambda x: lower(x)), lower(p)))) = 0
 AND len(list_filter(fresh, lambda x: NOT regexp_full_match(x, '[A-Za-z]{{3,}}') OR upper(x) = x)) = 0 AND len(list_distinct(list_transform(fresh, lambda x: lower(x)))) <= 3 AS safe FROM n""")
def q16_rewrite_safety(spark, d):
    """A query for search may add up to three plain words; codes of the question stay, and none are invented."""
    rows = C.plans(spark, d).select("qid", "question", F.explode("search_queries").alias("variant")).filter("variant IS NOT NULL")
    found = lambda x: F.regexp_extract_all(x, F.lit(_ANY), F.lit(0))
    rows = rows.select("qid", "question", "variant", T.tokens(c("question"), TOKEN).alias("known"), found(c("variant")).alias("said"), F.filter(found(c("question")), lambda t: t.rlike("[A-Z]") & (F.upper(t) == t) & (F.length(t) >= 2)).alias("kept"))
    fresh = F.array_distinct(F.filter("said", lambda x: ~F.array_contains(c("known"), F.lower(x)) & ~F.lower(x).isin(W.FOCUS_STOP)))
    rows = rows.withColumn("fresh", fresh).withColumn("lower", F.transform("said", lambda x: F.lower(x)))
    whole = F.forall("kept", lambda p: F.array_contains(c("lower"), F.lower(p)))
    plain = F.forall("fresh", lambda x: x.rlike("^[A-Za-z]{3,}$") & (F.upper(x) != x))
    few = F.size(F.array_distinct(F.transform("fresh", lambda x: F.lower(x)))) <= 3
    length = F.char_length("variant").between(F.lit(1), F.greatest(F.lit(900), F.char_length("question") * 7))
    return rows.select("qid", "variant", (length & whole & plain & few).alias("safe")).distinct()


ANCHORS_SQL = f"""anchors AS (SELECT qid, intent, list_distinct(list_transform(list_filter(regexp_extract_all(question, '[A-Za-z0-9][A-Za-z0-9/-]*|"[^"]+"'), lambda t: regexp_matches(t, '[0-9"]') OR (upper(t) = t AND regexp_matches(t, '[A-Z]') AND length(t) >= 2)), lambda t: array_to_string(list_sort(list_distinct({S.tokens('t', '[a-z0-9]+')})), ' '))) AS groups FROM query_plans)"""


def anchors(question: Column) -> Column:
    """Groups of terms that an answer must hold: codes, numbers, capitals and quoted phrases, each as its sorted tokens."""
    found = F.regexp_extract_all(question, F.lit('[A-Za-z0-9][A-Za-z0-9/-]*|"[^"]+"'), F.lit(0))
    kept = F.filter(found, lambda t: t.rlike('[0-9"]') | ((F.upper(t) == t) & t.rlike("[A-Z]") & (F.length(t) >= 2)))
    return F.array_distinct(F.transform(kept, lambda t: F.array_join(F.array_sort(F.array_distinct(T.tokens(t, "[a-z0-9]+"))), " ")))


@query("t47_anchor_groups", "T47", "T49", sql=f"""WITH {ANCHORS_SQL} SELECT qid, array_to_string(list_sort(groups), '; ') AS anchors, round(CASE WHEN len(groups) = 0 THEN 0 WHEN intent = 'comparison' THEN 1.0 / len(groups) WHEN intent IN ('procedure', 'requirement', 'troubleshooting') AND len(groups) >= 3 THEN greatest(0.67, (len(groups) - 1) / len(groups)) ELSE 1 END, 6) AS required FROM anchors""")
def t47_anchor_groups(spark, d):
    rows = C.plans(spark, d).select("qid", "intent", anchors(c("question")).alias("groups"))
    return rows.select("qid", F.array_join(F.array_sort("groups"), "; ").alias("anchors"), F.round(required_coverage(c("intent"), F.size("groups")), 6).alias("required"))


def required_coverage(intent: Column, groups: Column) -> Column:
    """How much of the anchor groups one place must hold: one of them for a comparison, all but one of many for a procedure."""
    loose = F.coalesce(intent.isin("procedure", "requirement", "troubleshooting"), F.lit(False)) & (groups >= 3)
    return F.when(groups == 0, 0.0).when(intent == "comparison", F.lit(1.0) / groups).when(loose, F.greatest(F.lit(0.67), (groups - 1) / groups)).otherwise(1.0)


@query("r42_topic_history", "R42", sql=f"""WITH {S.AUDIT}, t AS (SELECT id, chat_session_id, created_at, event_type FROM audit WHERE question IS NOT NULL AND chat_session_id IS NOT NULL),
l AS (SELECT chat_session_id, max(created_at) AS since FROM t WHERE event_type = 'chat_question' GROUP BY ALL) SELECT id, chat_session_id FROM t JOIN l USING (chat_session_id) WHERE created_at >= since""")
def r42_topic_history(spark, d):
    """The turns of a session from its last question of its own topic on."""
    rows = C.audit(spark, d).filter("question IS NOT NULL AND chat_session_id IS NOT NULL")
    since = F.max(F.when(c("event_type") == "chat_question", c("created_at"))).over(Window.partitionBy("chat_session_id"))
    return rows.withColumn("since", since).filter("created_at >= since").select("id", "chat_session_id")


PHASES = {"chat_question": "ask", "chat_followup": "ask", "login": "session", "logout": "session", "login_failed": "session", "document_upload": "ingest"}


@query("x2_progress", "X2", sql=f"""WITH {S.AUDIT} SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS sequence, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PHASES.items())} ELSE 'other' END AS phase, trim(regexp_replace(left(coalesce(error_message, ''), 120), '\\s+', ' ', 'g')) AS detail FROM audit WHERE user_id IS NOT NULL""")
def x2_progress(spark, d):
    """Events of each user in order, with their phase and a detail made fit to show."""
    phases = F.create_map(*[F.lit(x) for pair in PHASES.items() for x in pair])
    rows = C.audit(spark, d).filter("user_id IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "id")).cast("long")
    detail = F.trim(F.regexp_replace(F.substring(F.coalesce("error_message", F.lit("")), 1, 120), r"\s+", " "))
    return rows.select("id", number.alias("sequence"), F.coalesce(F.try_element_at(phases, c("event_type")), F.lit("other")).alias("phase"), detail.alias("detail"))
