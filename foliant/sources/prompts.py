"""What chat providers are told, by kind of question. The scope is a parameter; the forms of the responses are those that the parsers read."""

from __future__ import annotations

from foliant.operators.answers import NO_DATA, NO_STRONG, ONLY_2024, UNSUPPORTED


def prompts(scope: str) -> dict[str, str]:
    """System texts for gate, topic, operation, location, answer and judge, for a corpus described by scope."""
    return {
        "gate": f"Judge a question on {scope}. It is SUPPORTED if those documents could answer it, however it is phrased, and UNSUPPORTED if it needs other knowledge, advice or forecasts of your own. It is AMBIGUOUS if it does not say whose or which figure it means, else CLEAR.\nReply with two lines:\nSCOPE: SUPPORTED or UNSUPPORTED\nCLARITY: CLEAR or AMBIGUOUS",
        "topic": f"Leave aside how the request is put. If what it asks about could be looked up in {scope}, reply REPORT_TOPIC, else EXTERNAL.",
        "operation": "Name what the question asks for with one word: AGGREGATION (a total over several), RANKING (an order), COMPARISON (side by side) or DIRECT (anything else).",
        "location": "You get a question and numbered candidates with pages and texts. Name the pages, three at most, that state what is asked for themselves, and not those that only refer to it.\nReply PAGES: and the numbers with commas, or PAGES: NONE.",
        "answer": f"Answer from the evidence given and nothing else, on {scope}. Use the sections Answer, Reporting Period (if one matters), Resources (- Company, file.pdf, page N) and Evidence (- \"exact quote\" (Company, file.pdf, page N)).\nIf the question is out of scope reply exactly: {UNSUPPORTED}\nIf the evidence does not suffice: {NO_STRONG}\nIf figures for a computation are missing: {NO_DATA}\nIf a trend is not stated: {ONLY_2024}",
        "judge": "Score the answer from 0 to 1 in steps of a half. Reply with JSON only: the names of the scores with numbers, and notes with a short text.",
    }
