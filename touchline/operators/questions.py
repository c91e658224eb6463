"""Rule-based intent tagging of a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import contains_phrase, normalize_question

# --- Fixed values: phrase families, in reporting order -----------------------
# (intent, code, phrases)
SIGNALS = [
    ("SIMPLE_FACT", "MATCHED_STANDINGS",
     ["table", "standings", "league position", "top of the", "bottom of the", "who is top", "who's top"]),
    ("SIMPLE_FACT", "MATCHED_FIXTURES",
     ["next fixture", "next match", "play next", "playing next", "fixtures", "when do", "when does",
      "latest result", "last result", "latest results", "who won"]),
    ("LIVE_MATCH", "MATCHED_LIVE",
     ["right now", "at the moment", "live", "currently playing", "happening in this match",
      "current score", "what minute", "score now"]),
    ("HISTORICAL_STATISTICAL", "MATCHED_HISTORICAL",
     ["last five", "last 5", "recent form", "home form", "away form", "recent matches",
      "recent results", "compare", "head to head", "form guide"]),
    ("PREDICTION", "MATCHED_PREDICTION",
     ["predict", "prediction", "who will win", "chances", "win probability", "likely result",
      "odds of winning", "expected result", "model confidence"]),
    ("PREDICTION_EXPLANATION", "MATCHED_EXPLANATION",
     ["why does the model", "why is the model", "explain the prediction", "explain why the model",
      "what drives the prediction", "model favour", "model favor", "why the model"]),
    ("SCORELINE", "MATCHED_SCORELINE",
     ["most likely score", "likely scoreline", "scoreline", "expected goals", "correct score",
      "what score", "how many goals"]),
    ("RESEARCH", "MATCHED_RESEARCH",
     ["injury", "injuries", "injured", "suspended", "suspension", "team news", "manager said",
      "press conference", "reports", "transfer", "doubtful", "fitness"]),
    ("TACTICAL", "MATCHED_TACTICAL",
     ["tactically", "tactical", "press", "pressing", "buildup", "build up", "formation",
      "high line", "matchup", "match up", "style of play"]),
    ("WHAT_IF", "MATCHED_WHAT_IF",
     ["what if", "what would happen if", "how would the prediction change", "if instead",
      "suppose that", "hypothetically"]),
    ("SCOUTING", "MATCHED_SCOUTING",
     ["similar to", "players like", "stylistically similar", "comparable players", "scout",
      "find players", "player similarity"]),
]
SYNTHESIS_MARKERS = ["analyse", "analyze", "analysis", "considering", "taking into account",
                     "overall assessment", "full picture", "combining"]
LIVE_REASONING_MARKERS = ["why", "struggling", "struggle", "better so far", "explain"]
# dominant intent: intents it absorbs
SUBSUMPTION = {
    "PREDICTION_EXPLANATION": ["PREDICTION", "SCORELINE", "SIMPLE_FACT"],
    "PREDICTION": ["SCORELINE", "SIMPLE_FACT"],
    "SCORELINE": ["SIMPLE_FACT"],
    "RESEARCH": ["SIMPLE_FACT"],
    "TACTICAL": ["SIMPLE_FACT"],
    "LIVE_MATCH": ["SIMPLE_FACT"],
    "HISTORICAL_STATISTICAL": ["SIMPLE_FACT"],
    "WHAT_IF": ["SIMPLE_FACT", "PREDICTION", "SCORELINE"],
    "SCOUTING": ["SIMPLE_FACT"],
}
# --- End of fixed values ----------------------------------------------------


def tag_intents(rows: DataFrame, text: str) -> DataFrame:
    """Adds intent, matched intents, codes, failure and the live-reasoning flag.

    Several families that do not absorb one another are a conflict, unless the
    text asks for a synthesis; nothing is guessed.
    """
    q = F.col("_q")
    found = rows.withColumn("_q", normalize_question(F.col(text))).withColumns(
        {f"_s{i}": contains_phrase(q, phrases) for i, (_, _, phrases) in enumerate(SIGNALS)})
    hit = lambda i, v: F.when(F.col(f"_s{i}"), F.lit(v))
    found = found.withColumns({
        "matched": F.array_distinct(F.array_compact(F.array(*[hit(i, s[0]) for i, s in enumerate(SIGNALS)]))),
        "_codes": F.array_compact(F.array(*[hit(i, s[1]) for i, s in enumerate(SIGNALS)])),
    })
    # What is absorbed follows from the matched set as it was, whatever the order.
    absorbed = F.flatten(F.array(*[
        F.when(F.array_contains("matched", d), F.array(*[F.lit(x) for x in xs])).otherwise(F.array().cast("array<string>"))
        for d, xs in SUBSUMPTION.items()]))
    found = found.withColumns({
        "_effective": F.array_except("matched", absorbed),
        "live_reasoning": F.array_contains("matched", "LIVE_MATCH") & contains_phrase(q, LIVE_REASONING_MARKERS),
        "_synthesis": contains_phrase(q, SYNTHESIS_MARKERS),
    })
    n = F.size("_effective")
    complex_ = F.col("_synthesis") & (n >= 2)
    intent = F.when(complex_, "COMPLEX_SYNTHESIS").when(n == 1, F.get("_effective", F.lit(0)))
    failure = F.when(F.size("matched") == 0, "NO_CLEAR_INTENT").when(~complex_ & (n > 1), "MULTIPLE_INTENTS")
    codes = (
        F.when(complex_, F.array_append("_codes", F.lit("MATCHED_COMPLEX_SYNTHESIS")))
        .when((intent == "LIVE_MATCH") & F.col("live_reasoning"), F.array_append("_codes", F.lit("LIVE_REASONING_REQUESTED")))
        .otherwise(F.col("_codes")))
    return found.withColumns({"intent": intent, "codes": codes, "failure": failure}).select(
        *rows.columns, "intent", "matched", "codes", "failure", "live_reasoning")
