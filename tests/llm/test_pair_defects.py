import pytest

from tarnwick.llm.pair_defects import judge, pair_defects

Q = "Which signal has to be proved first near the yard?"


@pytest.mark.parametrize(
    ("question", "response", "found"),
    [
        (Q, None, ["empty"]), (Q, " \n​", ["empty"]), (Q, "**Answer:**", ["empty"]), (Q, "[S1] [S2]", ["empty"]), (Q, "<p></p>", ["empty"]), (Q, "N/A", ["empty"]), (Q, "Sources: AB-12, CD-34/E", ["empty"]),
        (Q, Q.upper() + "\n", ["copied_question"]), (Q, f"> {Q} {Q}", ["copied_question"]), (Q, Q + " The home signal is proved before the others are released.", []),
        (Q, "Sorry, I can't help with this question.", ["refusal"]), (Q, "Leider kann ich diese Frage nicht beantworten.", ["refusal"]), ("¿Quién puede cambiar las ofertas?", "Lo siento, no puedo responder a esta pregunta.", ["refusal"]),
        (Q, "The yard master cannot release the signal until it has been proved.", []),
        (Q, "Sobald die Signale wieder bereit sind, gibt der Schichtleiter den Betrieb frei.", ["other_language"]), (Q, "Сигнал должен быть проверен первым.", ["other_language"]),
        (Q, "The home signal is proved first. The distant signal must be", ["truncated"]), (Q, "1. The home signal (see", ["truncated"]), (Q, "The first one is proved.\n2.", ["truncated"]),
        (Q, "Non posso rispondere a questa domanda perché non ho le informazioni.", ["refusal", "other_language"]), (Q, "Não posso responder a essa pergunta.", ["refusal", "other_language"]),
        (Q, "Das darf ich leider nicht beantworten, weil die Frage nicht zu meinen Aufgaben gehört.", ["refusal", "other_language"]), (Q, "Ik kan deze vraag niet beantwoorden.", ["refusal", "other_language"]),
        (Q, "К сожалению, я не могу ответить на этот вопрос.", ["refusal", "other_language"]), (Q, "很抱歉，我无法回答这个问题。", ["refusal", "other_language"]), (Q, "申し訳ありませんが、お答えできません。", ["refusal", "other_language"]),
        (Q, "لا أستطيع الإجابة عن هذا السؤال.", ["refusal", "other_language"]), (Q, "This request cannot be answered (see", ["refusal", "truncated"]), (Q, Q + " (", ["copied_question", "truncated"]), (Q, "```", ["empty", "truncated"]),
        (Q, "The rules prevent us from sharing that.", ["refusal"]), (Q, "We do not have enough evidence for that.", ["refusal"]), (Q, "Drivers may not pass the signal until the guard has said that nothing stands beyond it.", []),
        (Q, "No answer from the signal box means that it must not be passed.", []),
        (Q, "Under AB-1234", []), (Q, "The yard master", []), (Q, "71 minutes", []), (Q, "Yes.", []),
    ],
)
def test_rules(question, response, found):
    assert judge(question, response)[0] == found


def test_list_items_end_where_sentences_end(spark):
    rows = [("a", Q, "- The home signal is proved", None), ("b", Q, "- The home signal is pro", None), ("c", Q, "It was proved.", None), ("d", None, None, None), ("b", Q, "- The home signal is pro", None), (None, Q, None, None)]
    df = spark.createDataFrame(rows, "id string, q string, r string, at timestamp").selectExpr("*", "1 as defect", "2 as place")
    found = {(r["id"], r["defect"]) for r in pair_defects(df, "id", "q", "r", "at").collect()}
    assert found == {("b", "truncated")}
    assert pair_defects(df.limit(0), "id", "q", "r").count() == 0


def test_long_text_and_hot_repeats(spark):
    df = spark.range(200).selectExpr("concat('k', if(id < 150, 0, id)) id", f"'{Q}' q", "if(id < 150, null, repeat('The signal is proved. ', 2000)) r")
    assert [(r["id"], r["defect"]) for r in pair_defects(df, "id", "q", "r").collect()] == [("k0", "empty")]
