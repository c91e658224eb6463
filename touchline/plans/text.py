"""Queries over names, texts and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import text as txt
from touchline.operators import questions, teams
from touchline.plans import sqltext as Q
from touchline.plans.registry import register
from touchline.sources.contests import contests, table

WORDS = r"trim(regexp_replace(replace(lower(strip_accents(replace(replace({x}, '''', ''), '’', ''))), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
QWORDS = r"trim(regexp_replace(replace(lower(strip_accents({x})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}+.\-]+', ' ', 'g'))"
SUFFIX = r"regexp_replace({x}, '((^| )(fc|afc|cf))+$', '')"


def name_sql(x):
    return SUFFIX.format(x=WORDS.format(x=x))


@register("f8_name_normalisation", f"SELECT doc_id, md5({name_sql('text')}) digest, length({name_sql('text')}) n FROM documents")
def name_normalisation(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", txt.normalize_name(F.col("text")).alias("n"))
    return d.select("doc_id", F.md5("n").alias("digest"), F.length("n").alias("n"))


@register("f9_possessives", r"""SELECT conv_id, turn, md5(regexp_replace(replace(text, ' ', '''s '), '([\p{L}\p{N}_])[''’]s( |$)', '\1\2', 'g')) digest FROM conversations""")
def possessives(spark, sf):
    """Every word gets a possessive before they are all removed again."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.md5(txt.strip_possessives(F.replace(F.col("text"), F.lit(" "), F.lit("'s ")))).alias("digest"))


@register("f10_question_normalisation", f"SELECT conv_id, turn, md5({QWORDS.format(x='text')}) digest FROM conversations")
def question_normalisation(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.md5(txt.normalize_question(F.col("text"))).alias("digest"))


PHRASES = ["the", "und", "de la", "is"]


@register("f11_phrase_test", f"SELECT doc_id, " + ", ".join(
    rf"regexp_matches({QWORDS.format(x='text')}, '(^|[^\p{{L}}\p{{N}}_]){p}([^\p{{L}}\p{{N}}_]|$)') has_{i}" for i, p in enumerate(PHRASES)) + " FROM documents")
def phrase_test(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", txt.normalize_question(F.col("text")).alias("q"))
    return d.select("doc_id", *[txt.contains_phrase(F.col("q"), [p]).alias(f"has_{i}") for i, p in enumerate(PHRASES)])


def club_rows(spark, sf):
    """A club registry from the supplier table."""
    k = F.col("s_suppkey").cast("string")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("club_"), k).alias("canonical_id"), F.concat(F.lit("Club "), k).alias("canonical_name"),
        F.array(F.col("s_name")).alias("historical_names"),
        F.array(F.concat(F.lit("Club "), k, F.lit(" FC")), F.concat(F.lit("The Club "), k)).alias("aliases"),
        F.create_map(F.lit("schedule"), (F.col("s_suppkey") * 10).cast("string")).alias("provider_ids"),
        (F.col("s_suppkey") % 9 != 0).alias("has_history"))


def mentions(spark, sf):
    """Home clubs as differently spelled raw names, some unknown or blank."""
    k, m = F.col("home").cast("string"), F.col("match_id") % 6
    raw = (F.when(m == 0, F.concat(F.lit("Club "), k)).when(m == 1, F.concat(F.lit("CLUB-"), k, F.lit(" A.F.C. FC")))
           .when(m == 2, F.concat(F.lit("Clúb "), k, F.lit(" fc cf"))).when(m == 3, F.concat(F.lit("the  club "), k))
           .when(m == 4, F.concat(F.lit("Klub "), k)).otherwise(F.lit(" ")))
    return contests(spark, sf).select("match_id", "home", raw.alias("raw_name"), F.lit("schedule").alias("provider"),
                                      (F.col("home") * F.when(m == 5, 11).otherwise(10)).alias("provider_id"))


MENTIONS = f"""WITH {Q.CONTESTS}, mention AS (SELECT match_id, home, home * CASE WHEN match_id % 6 = 5 THEN 11 ELSE 10 END provider_id,
  CASE match_id % 6 WHEN 0 THEN 'Club ' || home WHEN 1 THEN 'CLUB-' || home || ' A.F.C. FC' WHEN 2 THEN 'Clúb ' || home || ' fc cf'
    WHEN 3 THEN 'the  club ' || home WHEN 4 THEN 'Klub ' || home ELSE ' ' END raw_name FROM contests),
res AS (SELECT m.*, CASE WHEN match_id % 6 IN (0, 2, 3) THEN 'club_' || home END canonical_id, CASE WHEN match_id % 6 IN (0, 2, 3) THEN home % 9 <> 0 END has_history
  FROM mention m)"""


@register("j9_alias_resolution", MENTIONS + " SELECT match_id, raw_name, canonical_id, CASE WHEN has_history THEN 'yes' WHEN NOT has_history THEN 'no' ELSE 'unknown' END has_history FROM res")
def alias_resolution(spark, sf):
    aliases = teams.alias_table(club_rows(spark, sf))
    known = F.when(F.col("has_history"), "yes").when(~F.col("has_history"), "no").otherwise("unknown")
    return teams.resolve_names(mentions(spark, sf), "raw_name", aliases).select(
        "match_id", "raw_name", "canonical_id", known.alias("has_history"))


@register("j9_unresolved_names", MENTIONS + " SELECT DISTINCT raw_name FROM res WHERE canonical_id IS NULL")
def unresolved(spark, sf):
    return teams.unresolved_names(mentions(spark, sf), "raw_name", teams.alias_table(club_rows(spark, sf)))


@register("j10_provider_ids", MENTIONS + " SELECT match_id, provider_id, 'club_' || s_suppkey canonical_id FROM mention LEFT JOIN supplier ON s_suppkey * 10 = provider_id")
def provider_ids(spark, sf):
    return teams.resolve_provider_ids(mentions(spark, sf), club_rows(spark, sf)).select("match_id", "provider_id", "canonical_id")


@register("x2_ambiguous_aliases", """WITH a AS (SELECT 'club ' || s_suppkey alias, s_suppkey k FROM supplier UNION SELECT 'side ' || s_suppkey % 60, s_suppkey FROM supplier)
SELECT 'ambiguous_alias' problem, alias detail, count(DISTINCT k) n FROM a GROUP BY alias HAVING count(DISTINCT k) > 1""")
def ambiguous_aliases(spark, sf):
    side = F.array(F.concat(F.lit("Side "), (F.split_part("canonical_id", F.lit("_"), F.lit(2)).cast("int") % 60).cast("string")))
    return teams.registry_problems(club_rows(spark, sf).withColumns({"historical_names": side, "aliases": side}))


@register("a23_resolution_coverage", MENTIONS + """ SELECT CASE WHEN trim(raw_name) = '' THEN 'malformed' WHEN canonical_id IS NULL THEN 'unresolved' ELSE 'resolved' END status,
  count(*) n, count(DISTINCT raw_name) n_names, count(DISTINCT provider_id) n_provider_ids FROM res GROUP BY status""")
def coverage(spark, sf):
    return teams.resolution_coverage(mentions(spark, sf), "raw_name", "provider_id", teams.alias_table(club_rows(spark, sf)))


def dictionary(spark, sf, longest):
    """Aliases from the benchmark items: their first word, and longer openings."""
    words = F.split(txt.normalize_name(F.col("text")), " ")
    items = table(spark, sf, "benchmark").select("item_id", words.alias("w"))
    places = [(1, 1), (2, 2), (4, 3)][:longest]  # start word, length
    each = items.select("item_id", F.explode(F.array(*[F.array_join(F.slice("w", s, n), " ") for s, n in places])).alias("alias"))
    return each.groupBy("alias").agg(F.min("item_id").cast("string").alias("canonical_id"))


@register("x1_entity_tags_words", f"""WITH item AS (SELECT split_part({name_sql('text')}, ' ', 1) alias, min(item_id)::VARCHAR canonical_id FROM benchmark GROUP BY 1),
tok AS (SELECT doc_id, unnest(t) alias, generate_subscripts(t, 1) start FROM (SELECT doc_id, string_split({name_sql('text')}, ' ') t FROM documents)),
hit AS (SELECT doc_id, canonical_id, alias, min(start) start FROM tok JOIN item USING (alias) GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) mention, canonical_id, alias mentioned_as FROM hit""")
def entity_tags_words(spark, sf):
    return teams.tag_entities(table(spark, sf, "documents"), "doc_id", "text", dictionary(spark, sf, 1), 1)


@register("x1_entity_tags", f"""WITH RECURSIVE item AS (SELECT alias, min(item_id)::VARCHAR canonical_id FROM (
    SELECT item_id, unnest([w[1], array_to_string(w[2:3], ' '), array_to_string(w[4:6], ' ')]) alias FROM (SELECT item_id, string_split({name_sql('text')}, ' ') w FROM benchmark)) GROUP BY 1),
gram AS (SELECT doc_id, start, n.span, array_to_string(t[start : start + n.span - 1], ' ') alias
  FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) start FROM (SELECT doc_id, string_split({name_sql('text')}, ' ') t FROM documents)), (VALUES (1), (2), (3)) n(span) WHERE start + n.span - 1 <= len(t)),
hit AS MATERIALIZED (SELECT doc_id, start, span, canonical_id, alias FROM gram JOIN item USING (alias)),
long AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span DESC, start) rn FROM hit WHERE span > 1),
walk AS (SELECT doc_id, rn, true ok, range(start, start + span) taken FROM long WHERE rn = 1
  UNION ALL SELECT l.doc_id, l.rn, NOT list_has_any(w.taken, range(l.start, l.start + l.span)),
    CASE WHEN list_has_any(w.taken, range(l.start, l.start + l.span)) THEN w.taken ELSE list_concat(w.taken, range(l.start, l.start + l.span)) END
  FROM walk w JOIN long l ON l.doc_id = w.doc_id AND l.rn = w.rn + 1),
good AS (SELECT l.* FROM long l JOIN walk w ON w.doc_id = l.doc_id AND w.rn = l.rn WHERE w.ok),
accepted AS (SELECT doc_id, start, span, canonical_id, alias FROM good UNION ALL
  SELECT * FROM hit h WHERE span = 1 AND NOT EXISTS (SELECT 1 FROM good g WHERE g.doc_id = h.doc_id AND h.start >= g.start AND h.start < g.start + g.span)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, canonical_id ORDER BY span DESC, start) k FROM accepted)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) mention, canonical_id, alias mentioned_as FROM firsts WHERE k = 1""")
def entity_tags(spark, sf):
    return teams.tag_entities(table(spark, sf, "documents"), "doc_id", "text", dictionary(spark, sf, 3), 3)


TEMPLATES = [
    "Who will win, Club {h} or Club {a}?", "What is Club {h}'s next match?", "Show me the table at the moment",
    "Why are Club {a} struggling right now?", "Predict the scoreline of Club {h} against Club {a}",
    "What injuries affect Club {h}'s next match?", "Analyse Club {h}'s recent form considering injuries and tactical matchup",
    "Compare the recent form and team news of Club {h}", "What if Club {a} gain +0.5?", "Information on Club {h}",
    "Why does the model favour Club {h}? What score is expected?", "Find players like the captain of Club {a}",
]


def asked(spark, sf):
    """One question per contest, and every conversation turn."""
    m = F.col("match_id") % len(TEMPLATES)
    text = F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES):
        text = F.when(m == i, F.lit(t)).otherwise(text)
    filled = F.replace(F.replace(text, F.lit("{h}"), F.col("home").cast("string")), F.lit("{a}"), F.col("away").cast("string"))
    ours = contests(spark, sf).select(F.concat(F.lit("m"), F.col("match_id").cast("string")).alias("qid"), filled.alias("text"))
    talk = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("qid"), "text")
    return ours.unionByName(talk)


def _intent_sql():
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    rx = lambda ps: lit(r"(^|[^\p{L}\p{N}_])(?:" + "|".join(p.replace(".", r"\.") for p in ps) + r")([^\p{L}\p{N}_]|$)")
    fill = "CASE match_id % 12 " + " ".join(f"WHEN {i} THEN {lit(t)}" for i, t in enumerate(TEMPLATES)) + " END"
    sig = ", ".join(f"regexp_matches(q, {rx(ps)}) s{i}" for i, (_, _, ps) in enumerate(questions.SIGNALS))
    by_intent: dict[str, list[str]] = {}
    for i, (intent, _, _) in enumerate(questions.SIGNALS):
        by_intent.setdefault(intent, []).append(f"s{i}")
    has = {k: "(" + " OR ".join(v) + ")" for k, v in by_intent.items()}
    eff = {k: f"({has[k]} AND NOT ({' OR '.join([has[d] for d, xs in questions.SUBSUMPTION.items() if k in xs] or ['false'])}))" for k in has}
    return f"""WITH {Q.CONTESTS}, asked AS (SELECT 'm' || match_id qid, replace(replace({fill}, '{{h}}', home::VARCHAR), '{{a}}', away::VARCHAR) AS text FROM contests
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations),
n AS (SELECT qid, {QWORDS.format(x='text')} q FROM asked),
s AS (SELECT qid, {sig}, regexp_matches(q, {rx(questions.SYNTHESIS_MARKERS)}) syn, regexp_matches(q, {rx(questions.LIVE_REASONING_MARKERS)}) rea FROM n),
e AS (SELECT *, {' + '.join(f'{v}::INT' for v in eff.values())} ne, list_filter([{', '.join(f"CASE WHEN {v} THEN '{k}' END" for k, v in eff.items())}], lambda x: x IS NOT NULL) eff,
  list_filter([{', '.join(f"CASE WHEN {v} THEN '{k}' END" for k, v in has.items())}], lambda x: x IS NOT NULL) mat,
  list_filter([{', '.join(f"CASE WHEN s{i} THEN '{c}' END" for i, (_, c, _) in enumerate(questions.SIGNALS))}], lambda x: x IS NOT NULL) codes FROM s),
o AS (SELECT *, CASE WHEN syn AND ne >= 2 THEN 'COMPLEX_SYNTHESIS' WHEN ne = 1 THEN eff[1] END intent, {has['LIVE_MATCH']} AND rea live_reasoning FROM e)
SELECT qid, intent, array_to_string(mat, ',') matched, array_to_string(list_concat(codes, CASE WHEN intent = 'COMPLEX_SYNTHESIS' THEN ['MATCHED_COMPLEX_SYNTHESIS']
    WHEN intent = 'LIVE_MATCH' AND live_reasoning THEN ['LIVE_REASONING_REQUESTED'] ELSE [] END), ',') codes,
  CASE WHEN len(mat) = 0 THEN 'NO_CLEAR_INTENT' WHEN NOT (syn AND ne >= 2) AND ne > 1 THEN 'MULTIPLE_INTENTS' END failure, live_reasoning FROM o"""


@register("x3_intent_tags", _intent_sql())
def intent_tags(spark, sf):
    t = questions.tag_intents(asked(spark, sf), "text")
    return t.select("qid", "intent", F.array_join("matched", ",").alias("matched"), F.array_join("codes", ",").alias("codes"), "failure", "live_reasoning")
